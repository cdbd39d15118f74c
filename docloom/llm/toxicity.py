"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Texts are folded first: lower case, no accents, homoglyphs and digits as the letters they stand for,
everything else a space. Patterns are whole words (" word ") or word beginnings (" begin"), with a
weight; phrases that excuse a word take its weight back. A text's strength is the sum of its
weights over log2(2 + words), and a logistic curve makes it a score. Texts are folded piece by piece and
matched as a whole, so no cut can part a phrase; matching and excusing take time in proportion to the text.

Lexicon and phrases are learned. Of a bounded sample of labelled rows each task counts, by label, in how many
texts a word or beginning of a word occurs; those that a likelihood-ratio test finds tied to toxic rows are
candidates. Phrases of a candidate and a word beside it that are clean text's excuse it. Candidates that are rare
elsewhere, where they are not excused, become patterns weighted by their log-odds. Rows of a class of
near-duplicates (by their minhash signatures) count as one text of their label, so that copies of one toxic text do not make its
other words toxic, nor copies of a clean one excuse a word. max_patterns bounds what the driver gets; where
that leaves out a pattern, a warning says so.

Defined results: null is scored as an empty text; an empty text scores as any text without matches.
Without labelled rows of both classes, every score is 0. Rows that repeat are scored each. Columns that a result
would clash with are refused with a ValueError.
"""

from __future__ import annotations

import math
import warnings
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK, crc_mod, fold, free_name, hash_below, materialise, prepare
from .minhash import BANDS, ROWS, SEED, SIMILARITY, signed

BEGINNINGS = (4, 5, 6, 7)
#: Of a pattern's texts, with classes of equal size, this share is toxic; of a candidate's, whose other texts may be excused.
LEAST_PRECISION, CANDIDATE_PRECISION = 0.97, 0.6
#: Clean texts that a phrase which excuses is in, at least.
LEAST_CLEAN = 5
ROWS_PER_CLASS, MAX_PATTERNS, LEAST_G = 4000, 4000, 20.0
#: The tasks that share the sample.
TASKS = 32


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    bias: float = -50.0
    _auto: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_auto": None}

    def automaton(self):
        if self._auto is None:
            a = ahocorasick.Automaton()
            for p, w in self.weights.items():
                a.add_word(p, (p, w, 0))
            for e in self.exceptions:
                p = f" {' '.join(fold(e).split())} "
                a.add_word(p, (p, 0.0, len(p)))
            a.make_automaton()
            self._auto = a
        return self._auto

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(end, pattern, weight) of the patterns in a folded text that no phrase excuses."""
        found: list[tuple[int, str, float]] = []
        begins, ends = [], []
        for end, (p, w, n) in self.automaton().iter(folded) if self.weights else ():
            if n:
                begins.append(end - n + 2), ends.append(end)  # the blank in front may end the pattern of another word
            else:
                found.append((end, p, w))
        if ends:  # how many phrases have begun by a place, and how many have ended before it
            at = np.array([e for e, *_ in found], np.int64)
            within = np.searchsorted(np.sort(begins), at, "right") > np.searchsorted(ends, at, "left")
            found = [x for x, excused in zip(found, within, strict=True) if not excused]
        return found

    def strength(self, text: str | None) -> float:
        """Sum of the weights found, less the excused ones, over log2(2 + words)."""
        folded = folded_words(text)
        return sum(w for *_, w in self.hits(folded)) / math.log2(2 + folded.count(" ") - 1)

    def score(self, text: str | None) -> float:
        return _logistic(self.bias + self.slope * self.strength(text))

    def patterns_in(self, text: str | None) -> set[str]:
        return {p for _, p, _ in self.hits(folded_words(text))}

    def phrases_in(self, text: str | None) -> set[str]:
        """The words with a pattern, each with the word before it, and with the one after it."""
        folded = folded_words(text)
        found = self.hits(folded)
        if not found:
            return set()
        words = folded.split()
        begins = list(accumulate((len(w) + 1 for w in words), initial=1))
        out: set[str] = set()
        for end, p, _ in found:
            i = bisect_right(begins, end - len(p) + 2) - 1
            out.update(" ".join(words[j : j + 2]) for j in (i - 1, i) if j >= 0 and j + 1 < len(words))
        return out


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def _pieces(text: str):
    """A long text in pieces cut at white space."""
    at = 0
    while len(text) - at > CHUNK:
        cut = at + CHUNK
        while cut < len(text) and not text[cut].isspace():
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def folded_words(text: str | None) -> str:
    """The folded words of a text between single blanks, with one before and after."""
    return f" {' '.join(w for piece in _pieces(text or '') for w in fold(piece).split())} "


def candidates(text: str | None) -> set[str]:
    """The patterns that a text holds: its words and their beginnings."""
    out: set[str] = set()
    for w in set(folded_words(text).split()):
        if len(w) >= 3:
            out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in BEGINNINGS if len(w) >= n)
    return out


def sample(labelled: DataFrame, rows_per_class: int, seed: int) -> DataFrame:
    """About rows_per_class keys of each class, by a hash of the key: (key, toxic)."""
    sizes = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}  # two rows
    chosen = F.lit(False)
    for label in (0, 1):
        chosen = chosen | ((F.col("toxic") == label) & hash_below(F.col("key"), rows_per_class / max(1, sizes.get(label, 0)), seed))
    return labelled.where(chosen)


def with_copies(rows: DataFrame) -> DataFrame:
    """text, toxic and class: null for a text without copies or near-duplicates among the rows, a bounded sample.

    One task gets the signatures of the sample's distinct texts, 2 KB each, and links a text to the first one of a
    band's bucket if four fifths of their coordinates agree."""
    single = signed(rows, "node", "text", BANDS * ROWS, 1, SEED).where("buckets is not null").select("node", "buckets").dropDuplicates(["node"])

    def link(batches):
        held = [(n, np.array(x, np.int64)) for b in batches for n, x in zip(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), strict=True)]
        held.sort(key=lambda x: x[0])
        signs = np.stack([x for _, x in held]) if held else np.zeros((0, BANDS * ROWS), np.int64)
        up = np.arange(len(held))

        def top(i):
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for band in range(0, BANDS * ROWS, ROWS) if held else ():
            _, first, of = np.unique(signs[:, band : band + ROWS], axis=0, return_index=True, return_inverse=True)
            leader = first[of.reshape(-1)]
            for i in np.flatnonzero((leader != np.arange(len(held))) & ((signs == signs[leader]).mean(1) >= SIMILARITY)):
                x, y = sorted((top(i), top(leader[i])))
                up[y] = x
        tops = [top(i) for i in range(len(held))]
        several = Counter(tops)
        keep = [i for i, x in enumerate(tops) if several[x] > 1]
        yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in keep], pa.binary()), pa.array([held[tops[i]][0] for i in keep], pa.binary())], names=["node", "class"])

    near = single.repartition(1).mapInArrow(link, "node binary, class binary")
    copied = rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("node")
    classes = copied.join(near, "node", "full_outer").select("node", F.coalesce("class", "node").alias("class"))
    return rows.join(F.broadcast(materialise(classes)), "node", "left").select("text", "toxic", "class")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows_per_class: int = ROWS_PER_CLASS, max_patterns: int = MAX_PATTERNS, seed: int = 7) -> ToxicityModel:
    """A model from the documents that labels name. rows_per_class bounds the sample of each class: its keys are
    that many at most, in expectation, and its rows twice as many, where keys repeat."""
    prepare(docs.sparkSession)
    marks = labels.select(F.col(key).alias("key"), F.col(label).alias("toxic")).where("key is not null and toxic in (0, 1)").groupBy("key").agg(F.max("toxic").alias("toxic"))
    chosen = sample(marks, rows_per_class, seed)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key").select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = materialise(rows.withColumn("node", F.unhex(F.md5(F.col("text").cast("binary")))).repartition(TASKS))
    # again by text: a key may have any number of rows
    rows = sample(rows.withColumnRenamed("node", "key"), 2 * rows_per_class, seed + 1).withColumnRenamed("key", "node")
    rows = materialise(with_copies(rows))
    texts = F.count_if(F.col("class").isNull()) + F.count_distinct("class")
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").agg(texts).collect()}
    if len(sizes) < 2:
        return ToxicityModel({})

    pos_n, neg_n = float(sizes[1]), float(sizes[0])
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    share = (pos + neg) / (pos_n + neg_n)
    precision = (pos / pos_n) / ((pos / pos_n) + (neg / neg_n))

    def term(seen, all_, rate):
        return F.when(seen > 0, seen * F.log(seen / (rate * all_))).otherwise(0.0)

    g = 2 * (term(pos, pos_n, share) + term(neg, neg_n, share) + term(pos_n - pos, pos_n, 1 - share) + term(neg_n - neg, neg_n, 1 - share))
    weight = F.log(((pos + 0.5) / (pos_n + 1)) / ((neg + 0.5) / (neg_n + 1)))

    def tied(find: Callable[[str | None], set[str]], least: float) -> list:
        """The strongest patterns that are tied to toxic rows, with a precision of `least`."""
        strong = tally(rows, find).where(pos >= 3).select("p", g.alias("g"), weight.alias("w"), precision.alias("precision")).where((F.col("precision") >= least) & (F.col("g") >= LEAST_G))
        found = strong.orderBy(F.desc("g"), F.desc(F.length("p")), "p").limit(max_patterns + 1).collect()
        if len(found) > max_patterns:
            warnings.warn(f"more than {max_patterns} patterns are tied to toxic rows; the weakest are left out", stacklevel=3)
        return found[:max_patterns]

    found = tied(candidates, CANDIDATE_PRECISION)
    wide = ToxicityModel({r["p"]: r["w"] for r in found})
    clean = tally(rows, wide.phrases_in).where((neg >= LEAST_CLEAN) & (1 - precision >= LEAST_PRECISION)) if found else None
    excuses = [r["p"] for r in clean.orderBy(F.desc("neg"), "p").select("p").limit(max_patterns).collect()] if found else []
    if excuses:
        wide.exceptions, wide._auto = tuple(excuses), None
        found = tied(wide.patterns_in, LEAST_PRECISION)
    chosen_weights = _prune({r["p"]: r["w"] for r in found if r["precision"] >= LEAST_PRECISION})
    model = ToxicityModel(chosen_weights, tuple(excuses))

    def measure(batches):
        for batch in batches:
            x = [model.strength(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1).cast(pa.float64())], names=["x", "y"])

    # a row per strength in steps of a hundredth, up to 100, and label
    step = F.round(F.least("x", F.lit(100.0)), 2).alias("x")
    xy = rows.select("text", "toxic").mapInArrow(measure, "x double, y double").groupBy(step, "y").count().orderBy("x", "y").toArrow()
    model.slope, model.bias = fit_curve(xy["x"].to_numpy(), xy["y"].to_numpy(), xy["count"].to_numpy().astype(float))
    return model


def tally(rows: DataFrame, find: Callable[[str | None], set[str]]) -> DataFrame:
    """p, pos, neg: in how many texts of each label `find` finds p; rows of one class count as one text."""

    def count(batches):
        single: list[Counter] = [Counter(), Counter()]
        shared: dict[bytes, list[set]] = {}
        for batch in batches:
            for t, y, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c is None:
                    single[y].update(find(t))
                else:
                    shared.setdefault(c, [set(), set()])[y].update(find(t))
        for c, (neg, pos) in [(None, single), *shared.items()]:
            names = [*pos, *(p for p in neg if p not in pos)]
            for a in range(0, len(names), 50_000):
                part = names[a : a + 50_000]
                columns = [[n[p] for p in part] if c is None else [int(p in n) for p in part] for n in (pos, neg)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([c] * len(part), pa.binary()), *(pa.array(n, pa.int64()) for n in columns)], names=["p", "class", "pos", "neg"])

    once = [F.when(F.col("class").isNull(), F.sum(n)).otherwise(F.max(n)).alias(n) for n in ("pos", "neg")]
    return rows.mapInArrow(count, "p string, class binary, pos long, neg long").groupBy("p", "class").agg(*once).groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _prune(weights: dict[str, float]) -> dict[str, float]:
    """Strongest first, without patterns that begin with a chosen one or that a chosen one begins with."""
    out: dict[str, float] = {}
    begun: set[str] = set()
    for p, w in weights.items():
        if p in begun or any(p[:n] in out for n in range(4, len(p) + 1)):
            continue
        out[p] = w
        begun.update(p[:n] for n in range(4, len(p) + 1))
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, times: np.ndarray, penalty: float = 0.002, rounds: int = 50) -> tuple[float, float]:
    """Slope and bias of a logistic curve through points that count so many times; classes weigh the same."""
    n = times.sum()
    w = np.where(y > 0, 0.5 / max(1, times[y > 0].sum()), 0.5 / max(1, times[y <= 0].sum())) * n * times
    a = np.stack([x, np.ones_like(x)], 1)
    b = np.zeros(2)
    pen = np.diag([penalty, penalty * 0.1]) * n * 0.01
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (w * (p - y)) + pen @ b
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + pen
        step = np.linalg.solve(hess, grad)
        b = b - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return max(0.0, float(b[0])), float(b[1])


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """df with one more column, the score."""
    prepare(df.sparkSession)
    if out in df.columns:
        raise ValueError(f"{out} is already a column")
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in batches:
            s = [m.score(t) if m.weights else 0.0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def held_out(key):
    return crc_mod(key, 3) == 1


def fit_documents(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The contract's model: from labels whose crc32(doc_id) mod 3 is not 1."""
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


def documents_toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit_documents(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The pipeline's filter: documents that score below `least`."""
    score = free_name(docs.columns, "toxicity")
    return score_toxicity(docs, fit_documents(docs, labels), "text", score).where(F.col(score) < least).select(*docs.columns)
