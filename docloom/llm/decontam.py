"""Benchmark decontamination: a prefix-filtered set join with exact verification.

A benchmark item becomes windows of WIDTH words (one shorter window if it has fewer). A window, as a
set of shingles of SHINGLE words, is contained in a document only if all its shingles are; so its
prefix, for containment 1, is a single shingle, best the rarest. The join is:

1. count how often each shingle of the benchmark occurs in all documents (rarity);
2. keep for each window its rarest shingle, with its offset in the window; windows with a shingle that
   occurs nowhere cannot be contained, and go;
3. join the places of documents where such a shingle occurs with the windows of that shingle, apply the
   length bound (the window is no longer than the document) and the positional bound (the window starts
   and ends inside it), and verify that all words agree, bytes included.

Windows, shingles, counts and places are tables, and no step depends on how many items there are: documents
are read twice, once to count and once for the places. To leave out at the scan what cannot join, the
executors get a bitmap of the hashes in question, of at most MOST_BITS bits; a false alarm costs a row, never
a result. Texts that repeat are joined once, by their digest. No document is compared with another, so
nothing depends on how often a passage occurs.

Defined results: a null text has no words. Items without words are ignored; items with a null id hit
words but are not listed; rows that repeat an item_id are one item with several texts. Documents
that repeat are answered each. Columns that a result would clash with are refused with a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, hash_word_bytes, hashed_texts, materialise, mix, prepare, shingles, words_of

WIDTH, SHINGLE = 13, 4
#: Bits of the largest bitmap, 32 MB, and of the smallest. It has 32 for each row, as long as that is between them.
MOST_BITS, LEAST_BITS = 1 << 28, 1 << 20
#: Counters that a task holds before it passes them on, and candidate places in one row.
COUNTERS, PLACES = 1 << 19, 2000


@dataclass
class Sieve:
    """A bitmap of hashes, with a bit for the lower half of each and one for the upper, and the shingle widths that they are of."""

    words: np.ndarray
    widths: list[int]

    def found(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in h, keys) of the shingles that may be in the set and are within one text, by width."""
        mask = np.uint64(len(self.words) * 64 - 1)
        for q in self.widths:
            keys = keys_of(h, q)
            at = np.arange(len(keys))
            for half in (0, 32):
                bit = (keys[at] >> np.uint64(half)) & mask
                at = at[np.flatnonzero((self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))]
            at = at[np.searchsorted(bounds, at, "right") == np.searchsorted(bounds, at + q - 1, "right")]
            yield at, keys[at]


def keys_of(h: np.ndarray, width: int) -> np.ndarray:
    """The keys of the shingles of a width, that tell widths apart too."""
    return mix(shingles(h, width) + np.uint64(width))


def sieve(keys: DataFrame) -> Sieve | None:
    """The sieve of a table (s, q), None of an empty one; its bitmap is made on the executors, of MOST_BITS bits at most."""
    rows, widths = keys.agg(F.count(F.lit(1)), F.collect_set("q")).first()  # SHINGLE widths at most
    if not rows:
        return None
    size = 64
    while size < min(MOST_BITS, max(LEAST_BITS, 32 * rows)):
        size *= 2
    half = keys.select(F.explode(F.array("s", F.shiftright("s", 32))).alias("s"))
    marks = half.select(F.shiftright(F.col("s").bitwiseAND(size - 1), 6).alias("w"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("b"))
    marks = marks.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # a row per 64 bits at most
    words = np.zeros(size // 64, np.uint64)
    words[marks["w"].to_numpy()] = marks["b"].to_numpy().view(np.uint64)
    return Sieve(words, sorted(widths))


def windows_of(benchmark: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """Distinct (id, window, n, item, keys): the digest of a window, its words joined by blanks, their number, an item
    that has it, and the keys of its shingles in their order."""

    def run(batches):
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(t)
                n = min(width, len(w))
                for a in range(0, len(w) - n + 1 if n else 0, 10_000):
                    end = min(a + 10_000, len(w) - n + 1)
                    rows = [b" ".join(w[i : i + n]) for i in range(a, end)]
                    q = min(SHINGLE, n)
                    keys = keys_of(hash_word_bytes(b" ".join(w[a : end + n - 1]))[0], q).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([hashlib.md5(r).digest() for r in rows], pa.binary()), pa.array([r.decode() for r in rows]), pa.array([n] * len(rows), pa.int32()), pa.array([name] * len(rows), pa.string()),
                         pa.array([keys[i : i + n - q + 1] for i in range(len(rows))], pa.list_(pa.int64()))],
                        names=["id", "window", "n", "item", "keys"],
                    )

    return benchmark.select(F.col(item).cast("string"), F.col(text)).mapInArrow(run, "id binary, window string, n int, item string, keys array<long>").dropDuplicates(["id", "item"])


def shingles_of(windows: DataFrame) -> DataFrame:
    """s, q, o, id, n: the key and width of each shingle of each window, and its offset there."""
    return windows.select((F.col("n") - F.size("keys") + 1).alias("q"), F.posexplode("keys").alias("o", "s"), "id", "n").select("s", "q", "o", "id", "n")


def rarity(docs: DataFrame, text: str, wanted: Sieve) -> DataFrame:
    """s, c: how often the shingles that pass a sieve occur in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        b = shared.value
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["s", "c"])

        for batch in batches:
            met = [k for _, _, h, bounds, _ in hashed_texts(batch.column(0).to_pylist()) for _, k in b.found(h, bounds)]
            if met:
                new, n = np.unique(np.concatenate(met), return_counts=True)
                keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            if len(keys) > COUNTERS:
                yield out()
                keys, counts = keys[:0], counts[:0]
        yield out()

    return docs.select(text).mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))


def prefixes(windows: DataFrame, own: DataFrame, counts: DataFrame) -> DataFrame:
    """s, q, o, id, n, window: the rarest shingle of each window, the first of equals."""
    rarest = own.join(counts, "s").groupBy("id").agg(F.min(F.struct("c", "o", "s", "q", "n")).alias("x"), F.count(F.lit(1)).alias("known")).where("known = x.n - x.q + 1")
    return rarest.select("id", "x.s", "x.q", "x.o", "x.n").join(windows.select("id", "window"), "id")


def places(docs: DataFrame, text: str, wanted: Sieve | None, width: int, names: dict[str, str]) -> DataFrame:
    """The other columns of docs, and by names: words, digest of the text, part, and candidates. Part 0 is the document's row,
    and tells whether it has candidates; further parts hold more candidates of a text that has very many. A candidate is a
    key, its place among the words around it, where these begin in the document, and the words, joined by blanks."""
    at = docs.columns.index(text)
    rest = [f for i, f in enumerate(docs.schema.fields) if i != at]
    schema = T.StructType([*rest, *(T.StructField(names[n], T._parse_datatype_string(t)) for n, t in (("n_words", "long"), ("digest", "binary"), ("part", "int"), ("cands", "array<struct<s:bigint,at:int,lo:bigint,words:string>>")))])
    kind = pa.list_(pa.struct([("s", pa.int64()), ("at", pa.int32()), ("lo", pa.int64()), ("words", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        b = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            others = [c for i, c in enumerate(batch.columns) if i != at]
            for first, last, h, bounds, data in hashed_texts(texts):
                found: list[list[dict]] = [[] for _ in data]
                words: dict[int, list[bytes]] = {}
                for spots, keys in b.found(h, bounds) if b else ():
                    of = np.searchsorted(bounds, spots, "right") - 1
                    for p, s, t in zip(spots.tolist(), keys.view(np.int64).tolist(), of.tolist(), strict=True):
                        if t not in words:
                            words[t] = words_of(data[t].decode())
                        p -= int(bounds[t])
                        lo = max(0, p - width + 1)
                        found[t].append({"s": s, "at": p - lo, "lo": lo, "words": b" ".join(words[t][lo : p + width]).decode()})
                rows = [(t, k, found[t][k * PLACES : (k + 1) * PLACES]) for t in range(len(data)) for k in range(max(1, -(-len(found[t]) // PLACES)))]
                for a in range(0, len(rows), 1000):
                    t, part, cands = zip(*rows[a : a + 1000], strict=True)
                    take = pa.array([first + i for i in t])
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(take) for c in others), pa.array([int(bounds[i + 1] - bounds[i]) for i in t], pa.int64()), pa.array([hashlib.md5(data[i]).digest() for i in t], pa.binary()), pa.array(part, pa.int32()), pa.array(cands, kind)],
                        names=schema.names,
                    )

    return docs.mapInArrow(run, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


HITS = "array<struct<start:bigint,end:bigint>>"


def verified(cands: DataFrame, prefix: DataFrame, windows: DataFrame) -> DataFrame:
    """digest, hits, items of the texts that contain a window; cands has digest, s, at, lo and words."""
    both = cands.join(prefix, "s").withColumn("w", F.split("words", " "))
    begin = F.col("at") - F.col("o")
    inside = both.where((begin >= 0) & (begin + F.col("n") <= F.size("w")))
    met = materialise(inside.where(F.array_join(F.slice("w", begin + 1, F.col("n")), " ") == F.col("window")).select("digest", "id", (F.col("lo") + begin).alias("start"), "n"))

    def merge(batches):
        for batch in batches:
            spans = [[{"start": a, "end": e} for a, e in _merged([(x["start"], x["end"]) for x in r])] for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["digest", "hits"])

    spans = met.groupBy("digest").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("hits")).mapInArrow(merge, f"digest binary, hits {HITS}")
    listed = met.select("digest", "id").distinct().join(windows.where("item is not null").select("id", "item"), "id")
    items = listed.groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return spans.join(items, "digest", "left").select("digest", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """The columns of docs but the text, and three more: n_words, hits (merged [start, end) runs of hit words, as an
    array of structs) and items (sorted ids of the items with an occurring window)."""
    prepare(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    if clash := {"n_words", "hits", "items"} & set(others):
        raise ValueError(f"{clash} are already columns")
    names = {"n_words": "n_words"} | {n: free_name([*others, "n_words", "hits", "items"], n) for n in ("digest", "part", "cands")}
    digest, part, cands = names["digest"], F.col(names["part"]), F.col(names["cands"])
    windows = materialise(windows_of(benchmark, item, item_text, width))
    single = windows.dropDuplicates(["id"])
    own = shingles_of(single)
    prefix, wanted = None, sieve(own)
    if wanted:
        prefix = materialise(prefixes(single, own, rarity(docs, text, wanted)))
        wanted = sieve(prefix)
    found = materialise(places(docs, text, wanted, width, names))
    rows = found.where(part == 0)
    none = [F.array().cast(HITS).alias("hits"), F.array().cast("array<string>").alias("items")]
    if wanted is None:
        return rows.select(*others, "n_words", *none)
    listed = found.where(F.size(cands) > 0).select(F.col(digest).alias("digest"), part.alias("part"), cands.alias("cands")).dropDuplicates(["digest", "part"])
    hits = materialise(verified(listed.select("digest", F.explode("cands").alias("x")).select("digest", "x.*"), prefix, windows))
    mine = rows.where(F.size(cands) > 0).select(*others, "n_words", digest)
    joined = mine.join(hits.withColumnRenamed("digest", digest) if digest != "digest" else hits, digest, "left")
    return rows.where(F.size(cands) == 0).select(*others, "n_words", *none).unionAll(joined.select(*others, "n_words", *(F.coalesce(n, x).alias(n) for n, x in zip(("hits", "items"), none, strict=True))))


def n_hit(hits="hits"):
    return F.aggregate(hits, F.lit(0).cast("long"), lambda s, x: s + x.end - x.start)


def is_contaminated(hit, words):
    return (hit > 0) & (hit * 20 >= words)


def documents_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = find_overlaps(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated(n_hit(), F.col("n_words")).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's filter: documents without any hit word. A window of a benchmark item within a long document
    is as much of a leak as in a short one, so no share of the document excuses it."""
    name = free_name(docs.columns, "_digest")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias(name)
    hit = materialise(find_overlaps(docs.select(digest, "text"), benchmark).where(n_hit() > 0).select(name).distinct())
    return docs.select("*", digest).join(hit, name, "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, win FROM (SELECT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0))),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns)),
m AS (SELECT dw.rid, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
