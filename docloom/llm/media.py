"""Media columns: interleaved sequences of text and media references, with payloads by digest.

A page becomes one ordered array of items: text, or a reference to a medium with its caption. Media
live in a store under the SHA-256 of their payload. References are exploded with their positions,
joined to the store by digest, and put together again, so items and captions stay aligned.

Payloads are kept losslessly as 8-bit grey PNG images of 64 pixels a row (one sample per byte, so a
payload is a positive multiple of 64 bytes; the padding is zeros). A task stores a payload once, however
often it meets it. What is read back must hash to its digest. Joins see digests and what was computed
from payloads, never payloads themselves, so a payload that many pages show costs no more than one.

Defined results: a null text is an empty payload, of 64 zeros. Null html is an empty sequence. A
reference to nothing in the store stays, unresolved. Rows that repeat are answered each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, fresh_path, materialise, prepare

WIDTH, LEVEL = 64, 1
PNG = b"\x89PNG\r\n\x1a\n"
SCHEME = "sha256:"
ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
_ARROW_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """A payload of a positive multiple of WIDTH bytes as a PNG."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # a filter byte of 0 in front of each line
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of such a PNG; ValueError if it is damaged or of another kind."""
    if data[:8] != PNG:
        raise ValueError("not a PNG")
    at, width, rows, packed = 8, 0, 0, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, rows, depth, colour = struct.unpack(">IIBB", body[:10])
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation and distinct values of the samples, and a 64-bit hash of which of 64 blocks are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8)
    blocks = x.reshape(-1, WIDTH)
    edges = np.linspace(0, len(x), 65).astype(int)
    means = np.add.reduceat(x.astype(np.int64), edges[:-1]) / np.maximum(1, np.diff(edges))
    bits = 0
    for b in means > x.mean():
        bits = bits << 1 | int(b)
    return f"mean={x.mean():.4f};dev={x.std():.4f};distinct={len(np.unique(x))};rows={len(blocks)};hash={bits:016x}"


# --- sequences --------------------------------------------------------------------------------


class _Reader(HTMLParser):
    MEDIA, HIDDEN = {"img", "video", "audio", "source", "embed"}, {"script", "style", "template", "noscript", "title"}
    BREAKS = set("p div article section figure figcaption h1 h2 h3 h4 h5 h6 li ul ol table tr td th blockquote pre br header footer main".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # open figures: where their items begin, and their caption; the parts of the caption that is being read
        self.items, self.words, self.hidden, self.figures, self.caption = [], [], 0, [], None

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text and self.caption is not None:
            self.caption.append(text)
        elif text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_caption(self):
        self.flush()
        if self.caption is not None:
            text, self.caption = " ".join(self.caption), None
            if text and self.figures:
                self.figures[-1][1] = text

    def end_figure(self):
        self.end_caption()
        begin, text = self.figures.pop()
        for x in self.items[begin:] if text else ():
            if x["kind"] == "media":
                x["caption"] = text

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        if tag in self.BREAKS:
            self.flush()
        if tag == "figure":
            self.figures.append([len(self.items), None])
        elif tag == "figcaption":
            self.end_caption()
            self.caption = []
        elif tag in self.MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                self.items.append({"kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt")})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.MEDIA:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in self.BREAKS:
            self.flush()

    def finish(self):
        """Close what the page left open."""
        self.close()
        self.end_caption()
        while self.figures:
            self.end_figure()

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def read_items(html: str | None) -> list[dict]:
    """The texts and media references of a page, in order; a figure's caption goes to its media."""
    r = _Reader()
    r.feed(html or "")
    r.finish()
    return [{"position": i, **x} for i, x in enumerate(r.items)]


def with_items(df: DataFrame, html: str = "html", out: str = "items") -> DataFrame:
    """df with the page replaced by its items."""
    prepare(df.sparkSession)
    at = df.columns.index(html)
    rest = [f for i, f in enumerate(df.schema.fields) if i != at]
    if out in {f.name for f in rest}:
        raise ValueError(f"{out} is already a column")
    schema = T.StructType([*rest, T.StructField(out, T.ArrayType(T.StructType.fromDDL("position int, kind string, text string, ref string, caption string")))])

    def run(batches):
        for batch in batches:
            items = [read_items(h) for h in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(items, pa.list_(_ARROW_ITEM))], names=schema.names)

    return df.mapInArrow(run, schema)


def references(df: DataFrame, items: str = "items") -> DataFrame:
    """A row per media reference, with the other columns, position, digest (null for other schemes) and caption."""
    rest = [c for c in df.columns if c != items]
    item = free_name(rest, "_item")
    ref = F.col(f"{item}.ref")
    return df.select(*rest, F.explode(F.filter(items, lambda x: x.kind == "media")).alias(item)).select(
        *rest, F.col(f"{item}.position").alias("position"), F.when(ref.startswith(SCHEME), F.substring(ref, len(SCHEME) + 1, 64)).alias("digest"), F.col(f"{item}.caption").alias("caption")
    )


def resolve(df: DataFrame, facts: DataFrame, items: str = "items") -> DataFrame:
    """df, with each item's struct extended by `fact`, the row of facts (one per digest) of its medium: null for texts.
    Joins by digest carry references only; facts come back by row and place, and texts move once."""
    rest = [c for c in df.columns if c != items]
    row, ref, of = (free_name([*df.columns, *facts.columns], n) for n in ("_row", "_ref", "_facts"))
    settled = materialise(df.withColumn(row, F.monotonically_increasing_id()))  # numbers of a settled table stay

    def digest(x):
        return F.when((x.kind == "media") & x.ref.startswith(SCHEME), F.substring(x.ref, len(SCHEME) + 1, 64))

    places = F.transform(items, lambda x, i: F.struct(i.alias("place"), digest(x).alias("digest")))
    refs = settled.select(row, F.explode(F.filter(places, lambda x: x.digest.isNotNull())).alias(ref)).select(row, f"{ref}.*")
    known = facts.select("digest", F.struct(*facts.columns).alias("fact"))
    told = refs.join(known, "digest").groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("place", "fact"))).alias(of))
    extended = F.transform(items, lambda x, i: x.withField("fact", F.try_element_at(of, i)))
    return settled.join(told, row, "left").select(*rest, F.coalesce(extended, F.array()).alias(items))


# --- the store --------------------------------------------------------------------------------


def page_of(digest: str, size: int) -> str:
    """The page that names one medium of the store, and shows it."""
    return f'<article><p>A text</p><figure><img src="{SCHEME}{digest}"><figcaption>{size} bytes</figcaption></figure></article>'


def store_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write to path a row per document: key, n_bytes, a page that shows its payload, the payload's digest,
    and the payload's PNG where its task had not stored it yet."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        met: set[bytes] = set()
        for batch in batches:
            keys, rows, size = batch.column(0), [], 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                raw = (t or "").encode("utf-8", "replace")
                payload = padded(raw)
                d = hashlib.sha256(payload)
                media = None if d.digest() in met else encode_png(payload)
                met.add(d.digest())
                rows.append((i, len(raw), page_of(d.hexdigest(), len(raw)), d.hexdigest(), media))
                size += len(media or b"")
                if size > 8 << 20 or i + 1 == len(keys):
                    of, n, page, digest, data = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(n, pa.int64()), pa.array(page), pa.array(digest), pa.array(data, pa.binary())], names=["key", "n_bytes", "page", "digest", "media"])
                    rows, size = [], 0

    slim.mapInArrow(run, f"key {dict(slim.dtypes)['key']}, n_bytes long, page string, digest string, media binary").write.option("compression", "zstd").parquet(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Facts of each stored medium, from its bytes: digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    prepare(spark)

    def run(batches):
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = decode_png(media)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest:
                    raise ValueError(f"damaged payload {digest}")
                rows.append((digest, len(payload), sha, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    stored = spark.read.parquet(path).where("media is not null").select("digest", "media")
    facts = stored.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return facts.dropDuplicates(["digest"])


def documents_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption for every document."""
    spark = docs.sparkSession
    path = fresh_path(spark, "media")
    store_texts(docs, path)
    pages = spark.read.parquet(path).select(F.col("key").alias("doc_id"), "n_bytes", "page")
    # apart, so that the join may split a digest that many documents share; payload_sha256 is the digest, as reading verified
    facts = materialise(read_media(spark, path).drop("payload_sha256"))
    shown = resolve(with_items(pages, "page"), facts).withColumn("medium", F.filter("items", lambda x: x.kind == "media")[0])
    return shown.select(
        "doc_id", "n_bytes", "medium.fact.payload_bytes", F.col("medium.fact.digest").alias("payload_sha256"), "medium.fact.tail_crc32",
        "medium.fact.media_bytes", "medium.fact.media_sha256", "medium.fact.feature", "medium.position", "medium.caption",
    )
