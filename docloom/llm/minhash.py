"""Near-duplicates: DartMinHash signatures, banded joining, exact verification, connected classes.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; a
class is a connected component of links, and copies of one text are one node of that graph.

1. Every text gets a DartMinHash signature of BANDS * ROWS coordinates, and a bucket for each band. At a
   similarity of 0.8 a pair shares no bucket with a probability of 2e-5. By default a text is a set, and its
   shingles weigh 1; as a multiset (multiset=True) a shingle weighs as often as it occurs, and the similarity is the
   weighted one, the sum of the smaller weights over that of the larger.
2. Every bucket elects a leader, the member with the least hash, and its members are verified against
   it by their exact sets. Members that differ elect another leader, for ROUNDS
   rounds. So a bucket of m members makes m pairs a round, not m * m.
3. Links make components. Buckets that still hold several components may hide a link between two
   members that were never compared. Their members go through an exact prefix-filtered join instead:
   each probes with its rarest n - ceil(0.8 n) + 1 shingles, and is indexed under its rarest
   n - ceil(8 n / 9) + 1, as of linked texts the smaller one's index and the larger one's probes must
   meet. Shingles that join different components, sizes that allow a similarity of 0.8, and places that
   leave enough shingles to share make the pairs. A passage that many texts share is common, so it
   stands behind a text's own shingles, and is in an index only where there is little else.
4. Components of all links are the classes; a class is named by its smallest document id.

Nothing is collected but counts and checksums. Every loop writes its tables to the shared folder.

Sets are of 64-bit hashes; a multiset is verified as the set of (shingle, number of its occurrence), whose similarity
is the weighted one.

Defined results: a null text is an empty one. Texts of fewer than five words have one shingle, of all
their words; texts without words are linked only to equal texts. Rows that repeat share a class.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, hashed_texts, materialise, mix, prepare, shingles
from .dart import signatures

SHINGLE, SIMILARITY, BANDS, ROWS, ROUNDS, SEED = 5, 0.8, 36, 6, 2, 3
#: Elements (400 at least for each text) that are signed at once: their darts take some 10 MB an array.
MOST_ELEMENTS = 40_000


def shingle_set(word_hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingles of a text; one of all its words if it has fewer than width, none if it has none."""
    if not len(word_hashes):
        return np.zeros(0, np.uint64)
    return np.unique(shingles(word_hashes, min(width, len(word_hashes))))


def shingle_bag(word_hashes: np.ndarray, multiset: bool, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text and their weights: 1, or how often they occur."""
    if not len(word_hashes):
        return np.zeros(0, np.uint64), np.zeros(0)
    elements, counts = np.unique(shingles(word_hashes, min(width, len(word_hashes))), return_counts=True)
    return elements, counts.astype(np.float64) if multiset else np.ones(len(elements))


def occurrences(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sorted set of (element, number of its occurrence), hashed; the elements themselves, where all weigh 1."""
    times = weights.astype(np.int64)
    if not len(times) or times.max() == 1:
        return elements
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    each = np.repeat(elements, times)
    return np.unique(np.where(nth == 0, each, mix(each + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))


def bucket_names(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A number per band and signature, that names both the band and its coordinates."""
    out = np.zeros((len(signature), bands), np.uint64)
    for j in range(rows):
        out = mix(out * np.uint64(3) + signature[:, j::rows][:, :bands])
    return mix(out ^ mix(np.arange(1, bands + 1, dtype=np.uint64)))


def _texts(batch, at, seen):
    """(row, digest, text) of the texts in a batch that `seen` has not met."""
    for i, t in enumerate(batch.column(at).to_pylist()):
        d = hashlib.md5((t or "").encode("utf-8", "replace")).digest()
        yield i, d, t or "", d not in seen
        seen.add(d)


def signed(docs: DataFrame, key: str, text: str, bands: int, rows: int, seed: int, multiset: bool = False) -> DataFrame:
    """key, node (a 128-bit digest of the text), n (the weight of its shingles), buckets: the last two null for texts without words and where the task met the text before."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            nodes, fresh, texts = [], [], []
            for i, d, t, new in _texts(batch, 1, seen):
                nodes.append(d)
                if new:
                    fresh.append(i)
                    texts.append(t)
            buckets: list = [None] * len(nodes)
            sizes: list = [None] * len(nodes)
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def sign():
                if held:
                    bounds = np.concatenate([[0], np.cumsum([len(s) for _, s, _ in held])])
                    weights = np.concatenate([w for *_, w in held]) if multiset else None  # none: all weigh 1
                    names = bucket_names(signatures(np.concatenate([s for _, s, _ in held]), weights, bounds, bands * rows, seed), bands, rows).view(np.int64)
                    for (i, *_), n in zip(held, names, strict=True):
                        buckets[i] = n
                    held.clear()

            size = 0
            for first, last, h, bounds, _ in hashed_texts(texts):
                for j in range(last - first):
                    s, w = shingle_bag(h[bounds[j] : bounds[j + 1]], multiset)
                    if len(s):
                        held.append((fresh[first + j], s, w))
                        sizes[fresh[first + j]] = int(w.sum())
                        size += max(len(s), 400)
                    if size > MOST_ELEMENTS:
                        sign()
                        size = 0
            sign()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(buckets, pa.list_(pa.int64()))], names=["key", "node", "n", "buckets"])

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"key {dict(slim.dtypes)['key']}, node binary, n int, buckets array<long>")


def sets_of(docs: DataFrame, text: str, nodes: DataFrame, multiset: bool = False) -> DataFrame:
    """node, n, tokens (sorted 64-bit hashes of its shingles, or of their occurrences, as bytes) of the texts in nodes (one column, node)."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            ids, texts = [], []
            for _, d, t, new in _texts(batch, 0, seen):
                if new:
                    ids.append(d)
                    texts.append(t)
            out_ids, n, data = [], [], []
            for first, last, h, bounds, _ in hashed_texts(texts):
                for j in range(last - first):
                    s = occurrences(*shingle_bag(h[bounds[j] : bounds[j + 1]], multiset))
                    out_ids.append(ids[first + j]), n.append(len(s)), data.append(s.astype("<u8").tobytes())
            if out_ids:
                yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.binary()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], names=["node", "n", "tokens"])

    found = docs.select(text).mapInArrow(run, "node binary, n int, tokens binary")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def elected(members: DataFrame) -> DataFrame:
    """The (bucket, node, n) rows of buckets with several nodes, each with its bucket's leader and leader_n;
    leaders themselves are left out. The order of candidates is the same in all buckets, so that groups
    that share many buckets mostly share a leader too."""
    order = F.struct(F.xxhash64("node").alias("h"), "node", "n")
    chosen = members.groupBy("bucket").agg(F.min(order).alias("a"), F.max(order).alias("z")).where("a.node <> z.node")
    # settled apart, so that the join may split a bucket that many texts share
    chosen = materialise(chosen.select("bucket", F.col("a.node").alias("leader"), F.col("a.n").alias("leader_n")))
    return members.join(chosen, "bucket").where("node <> leader")


def led_pairs(led: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of leaders and members whose sizes allow the similarity."""
    return led.where(F.least("n", "leader_n") >= similarity * F.greatest("n", "leader_n") - 1e-9).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    mine = sets.select(F.col("node").alias("a"), F.col("tokens").alias("t_a"))
    other = sets.select(F.col("node").alias("b"), F.col("tokens").alias("t_b"))
    both = pairs.join(mine, "a").join(other, "b").select("a", "b", "t_a", "t_b")

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                k = np.searchsorted(q, p)
                common = int((q[np.minimum(k, len(q) - 1)] == p).sum()) if len(q) else 0
                if common >= similarity * (len(p) + len(q) - common) - 1e-9:
                    keep.append(i)
            if keep:
                rows = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node in reach) of the nodes of links (a, b); by alternating large and small stars."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large)
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small)
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return materialise(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def open_pairs(members: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that may be linked, of different components that share a bucket, by exact prefix filtering."""
    named = members.join(classes, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    named = materialise(named)
    mixed = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    nodes = named.join(materialise(mixed), "bucket", "left_semi").select("node", "component").distinct()

    def explode(batches):
        for batch in batches:
            lists = [np.frombuffer(t, "<i8") for t in batch.column(2).to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            for a in range(0, len(lists), 200):
                of = pa.array(np.repeat(np.arange(a, min(len(lists), a + 200)), sizes[a : a + 200]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(np.repeat(sizes[a : a + 200], sizes[a : a + 200]), pa.int32()), pa.array(np.concatenate(lists[a : a + 200]) if len(of) else [], pa.int64())], names=["node", "component", "n", "token"])

    rows = sets.join(nodes, "node").select("node", "component", "tokens").mapInArrow(explode, "node binary, component binary, n int, token long")
    rows = materialise(rows)
    count = materialise(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    place = F.row_number().over(W.partitionBy("node").orderBy("df", "token"))
    prefix = rows.join(count, "token", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("i", place)
    ceil = lambda share: F.ceil(F.col("n") * F.lit(share) - 1e-9)
    prefix = materialise(prefix.where((F.col("i") <= F.col("n") - ceil(similarity) + 1) & (F.col("df") > 1)).select("node", "component", "n", "i", "token"))
    shared = prefix.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    shared = materialise(shared)
    left = prefix.join(shared, "token", "left_semi")
    both = 2 * similarity / (1 + similarity)
    index = left.where(F.col("i") <= F.col("n") - ceil(both) + 1)
    right = index.select(F.col("node").alias("b"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("i").alias("j"), "token")
    smaller = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") < F.col("node")))
    needed = F.ceil((F.col("n") + F.col("m")) * F.lit(both / 2) - 1e-9)
    room = 1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= needed
    pairs = left.join(right, (left.token == right.token) & smaller & (F.col("component") != F.col("c")) & (F.col("m") >= F.col("n") * F.lit(similarity) - 1e-9) & room)
    return pairs.select(F.col("node").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS, seed: int = SEED, multiset: bool = False) -> DataFrame:
    """key, node (the text's digest) and class (a node that names the class) of every row of docs. Words and bands are as
    the module says; rounds is at least 1."""
    if rounds < 1:
        raise ValueError("members are compared with leaders for one round at least")
    prepare(docs.sparkSession)
    table = materialise(signed(docs, key, text, bands, rows, seed, multiset))
    all_members = table.where("buckets is not null").select("node", "n", F.explode("buckets").alias("bucket"))
    led = materialise(materialise(elected(all_members)).distinct())  # apart, so that a large bucket is split before it is deduplicated
    leaders = led.select("bucket", F.col("leader").alias("node")).distinct()
    members = led.select("bucket", "node").unionAll(leaders)
    sets = materialise(sets_of(docs, text, members.select("node").distinct(), multiset))
    links = None
    for i in range(rounds):
        found = materialise(verified(led_pairs(led, similarity), sets, similarity))
        links = found if links is None else links.unionAll(found)
        if i + 1 < rounds:
            failed = led.join(found.select(F.col("a").alias("leader"), F.col("b").alias("node")), ["leader", "node"], "left_anti")
            led = materialise(elected(failed.select("bucket", "node", "n")))
    classes = components(links)
    rest = materialise(verified(open_pairs(members, classes, sets, similarity), sets, similarity))
    if not rest.isEmpty():
        star = classes.select(F.col("node").alias("a"), F.col("component").alias("b"))
        classes = components(star.unionAll(rest))
    return table.select("key", "node").join(classes, "node", "left").select("key", "node", F.coalesce("component", "node").alias("class"))


def documents_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the document's class) for every document."""
    found = materialise(near_duplicates(docs))
    least = materialise(found.groupBy("class").agg(F.min("key").alias("class_id")))
    return found.join(least, "class").select(F.col("key").alias("doc_id"), "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The pipeline's filter: of each class the document with the smallest doc_id (null last), once."""
    found = materialise(near_duplicates(docs))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "node")
    digest, key, node = (free_name(docs.columns, n) for n in ("_digest", "_key", "_node"))
    kept = found.groupBy("class").agg(F.min(order).alias("m")).select(F.col("m.key").alias(key), F.col("m.node").alias(node))
    named = docs.withColumn(digest, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    mine = named.join(kept, named["doc_id"].eqNullSafe(kept[key]) & (named[digest] == kept[node]), "left_semi")
    repeated = found.groupBy("key", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        mine = mine.dropDuplicates(["doc_id", digest])
    return mine.drop(digest)
