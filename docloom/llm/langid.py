"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every n-gram (one to three letters, word ends as spaces) of a text goes to one of BUCKETS counters. A
language's model is the smoothed log-probability of each counter; the matrix of all languages is
broadcast (languages x BUCKETS floats, whatever the number of documents: 33 MB at MOST_LANGUAGES) and texts are
scored in batches by numpy: gather a language's row at the n-grams' counters, and sum by text.

Defined results: a null or empty text, or one without letters, is `und` with score 0; so is every text
when no labelled rows exist. Where labels name more than MOST_LANGUAGES languages, those with most rows are
learned, and a warning says so. Ties go to the language whose name sorts first. Repeated rows are
answered each. Texts are read whole, in pieces that overlap by what an n-gram needs.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, code_points, crc_mod, free_name, letter_table, prepare, through

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
MOST_LANGUAGES = 256
UND = "und"


def gram_buckets(points: np.ndarray, starts: int) -> list[np.ndarray]:
    """For each n: the counter of the n-gram at each of the first `starts` places; -1 where it has no letter or two spaces meet."""
    out = []
    p = points.astype(np.uint32)
    blank = p == 32
    g = np.zeros(len(p), np.uint32)
    bad = np.zeros(len(p), bool)
    for n in ORDERS:
        m = len(p) - n + 1
        if m <= 0:
            break
        g = g[:m] * np.uint32(0x01000193) + p[n - 1 : n - 1 + m]
        bad = blank.copy() if n == 1 else bad[:m] | (blank[n - 2 : n - 2 + m] & blank[n - 1 : n - 1 + m])
        h = (g + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - 15)
        b = h.astype(np.int32)
        b[bad[:m]] = -1
        if n == 2:
            bad = bad.copy()
        out.append(b[:starts])
    return out


def segments(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(text numbers, where each starts, places that n-grams may start at, code points through letter_table)
    of runs of about CHUNK code points; pieces of longer texts run on into the next piece."""
    table_ = letter_table()
    held: list[tuple[int, str]] = []
    size = 0
    tail = " " * (ORDERS[-1] - 1)  # so that an n-gram of any length starts at every place

    def flush():
        ids = np.array([i for i, _ in held])
        joined = "".join(f" {t} " for _, t in held)
        lengths = np.array([len(t) + 2 for _, t in held])
        return ids, np.concatenate([[0], np.cumsum(lengths)[:-1]]), len(joined), through(table_, code_points(joined + tail))

    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > CHUNK:
            yield flush()
            held, size = [], 0
        if len(t) <= CHUNK:
            held.append((i, t))
            size += len(t) + 2
        else:
            whole = f" {t} "
            for a in range(0, len(whole), CHUNK):
                piece = whole[a : a + CHUNK + len(tail)]
                yield np.array([i]), np.array([0]), min(CHUNK, len(whole) - a), through(table_, code_points(piece + tail))
    if held:
        yield flush()


@dataclass
class LanguageModel:
    """languages in order, their log-probabilities (languages x BUCKETS) and log-priors."""

    languages: list[str]
    log_probs: np.ndarray
    log_priors: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The best language of each text and its posterior probability."""
        n, k = len(texts), len(self.languages)
        total, grams = np.zeros((n, k)), np.zeros(n, np.int64)
        for ids, starts, limit, points in segments(texts):
            for b in gram_buckets(points, limit):
                keep = b >= 0
                grams[ids] += np.add.reduceat(keep, starts, dtype=np.int64)
                b = np.where(keep, b, BUCKETS)
                for j in range(k):
                    total[ids, j] += np.add.reduceat(self.log_probs[j][b], starts, dtype=np.float64)
        if not k:
            return [UND] * n, np.zeros(n)
        total += self.log_priors
        best = total.argmax(1)
        score = 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(1)
        return [self.languages[j] if g else UND for j, g in zip(best, grams, strict=True)], np.where(grams > 0, score, 0.0)


def fit(labelled: DataFrame, text: str, lang: str, key: str, rows_per_language: int = 2000, smoothing: float = 0.5, seed: int = 6, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """A model from labelled rows, of most_languages languages at most. Of each about rows_per_language rows are used,
    chosen by a hash of the key; their n-grams are counted on the executors, and only counters reach the driver."""
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    found = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(most_languages + 1).collect()
    if len(found) > most_languages:
        warnings.warn(f"labels name more than {most_languages} languages; those with the fewest rows are not learned", stacklevel=2)
    sizes = {r[0]: r[1] for r in found[:most_languages]}
    if not sizes:
        return LanguageModel([], np.zeros((0, BUCKETS + 1), np.float32), np.zeros(0))
    languages = sorted(sizes)
    limits = F.create_map(*(F.lit(x) for name in languages for x in (name, int(min(1, rows_per_language / sizes[name]) * (1 << 30)))))
    chosen = F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(1 << 30)) < F.try_element_at(limits, F.col("l"))  # null: not learned
    number = {name: i for i, name in enumerate(languages)}

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(names):
                counts = held.setdefault(number[name], np.zeros(BUCKETS, np.int64))
                for _, _, limit, points in segments([t for t, x in zip(texts, names, strict=True) if x == name]):
                    for b in gram_buckets(points, limit):
                        counts += np.bincount(b[b >= 0], minlength=BUCKETS)
        for i, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[used])], names=["l", "b", "n"])

    counted = rows.where(chosen).select("l", "t").mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros((len(languages), BUCKETS))
    matrix[counted["l"].to_numpy(), counted["b"].to_numpy()] = counted["n"].to_numpy()
    matrix += smoothing
    log_probs = np.zeros((len(languages), BUCKETS + 1), np.float32)  # the last column is for places without an n-gram
    log_probs[:, :BUCKETS] = np.log(matrix / matrix.sum(1, keepdims=True))
    all_rows = sum(sizes.values())
    return LanguageModel(languages, log_probs, np.log([sizes[x] / all_rows for x in languages]))


def identify(df: DataFrame, model: LanguageModel, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with two more columns: the language and its posterior probability."""
    from pyspark.sql import types as T

    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    at = df.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in batches:
            names, scores = m.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_out, score_out])

    if {lang_out, score_out} & set(df.columns):
        raise ValueError(f"{lang_out} or {score_out} is already a column")
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))


def held_out(key):
    return crc_mod(key, 4) == 2


def fit_documents(docs: DataFrame) -> LanguageModel:
    """The contract's model: from rows with a lang whose crc32(doc_id) mod 4 is not 2."""
    return fit(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()), "text", "lang", "doc_id")


def documents_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    slim = docs.select("doc_id", "text")
    return identify(slim, fit_documents(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The pipeline's filter: documents whose language is known with a probability of `least` or more."""
    lang, score = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "lang_score")
    scored = identify(docs, fit_documents(docs), "text", lang, score)
    return scored.where((F.col(lang) != UND) & (F.col(score) >= least)).select(*docs.columns)
