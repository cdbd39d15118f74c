"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

If n rows are dealt to shards by a uniform permutation, the number of rows that partition p sends to
shard s follows a multivariate hypergeometric law. So the counts can be drawn first. Every task
then deals its own rows by a local permutation that has exactly these counts, rows are exchanged, and
each destination permutes what it got. Sizes are exact, and nobody holds a permutation of all rows.

The matrix is never built. Partitions are the leaves of a binary tree; at a node the counts of its
left half are drawn from those of the whole, with a generator seeded by the node. A task walks from the
root to its leaf, so every task knows its own row of one and the same matrix, and a task that runs
again after an executor is lost deals the same. Every shard consists of several cells of known size; a
cell is what one task permutes, and slots count through a shard's cells.

Defined results: a null text has size 8 and the checksum of no bytes; repeated rows are placed each.
An empty table gives an empty result. Columns that a result would clash with are refused with a ValueError.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepare

SHARDS, SEED, CELL_ROWS = 24, 10, 1 << 17
#: monotonically_increasing_id holds the partition above these bits, and the row's place below.
PLACE_BITS = 33


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good; numpy's generator ends at 10**9."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mean = n * good / total
    spread = math.sqrt(max(1.0, mean * (bad / total) * ((total - n) / (total - 1))))
    a, b = max(low, int(mean - 12 * spread)), min(high, int(mean + 12 * spread) + 1)
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))  # p(k+1) / p(k)
    logp = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.exp(logp - logp.max())
    return int(a + rng.choice(len(p), p=p / p.sum()))


def split(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of n from the colours."""
    out, rest = np.zeros_like(colours), int(colours.sum())
    for i, c in enumerate(colours):
        rest -= int(c)
        out[i] = hypergeometric(rng, int(c), rest, n) if n else 0
        n -= int(out[i])
    return out


def matrix_row(sizes: np.ndarray, cells: np.ndarray, leaf: int, seed: int) -> np.ndarray:
    """How many rows partition `leaf` sends to each cell; sizes and cells have the same sum."""
    low, high, here = 0, len(sizes), cells.astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    while high - low > 1:
        mid = (low + high) // 2
        left = split(np.random.default_rng([seed, low, high]), here, int(ends[mid] - ends[low]))
        if leaf < mid:
            high, here = mid, left
        else:
            low, here = mid, here - left
    return here


def cell_sizes(rows: int, shards: int, per_shard: int) -> np.ndarray:
    """Sizes of all cells, shard by shard: shards differ by one row at most, and so do a shard's cells."""
    even = lambda n, k: np.array([n // k + (i < n % k) for i in range(k)], np.int64)
    return np.concatenate([even(int(s), per_shard) for s in even(rows, shards)])


def shuffle_to_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, cells_per_shard: int | None = None, shard_out: str = "shard", slot_out: str = "slot") -> DataFrame:
    """All rows and columns of df, with the shard and the slot in it (gapless from 0) of a uniform
    shuffle; shards differ by one row at most. One number per input partition reaches the driver.
    df must deliver the same rows to the same partitions each time that it is read, as scans do."""
    spark = df.sparkSession
    prepare(spark)
    if {shard_out, slot_out} & set(df.columns):
        raise ValueError(f"{shard_out} or {slot_out} is already a column")
    origin = free_name(df.columns, "_origin")
    cell = free_name([*df.columns, origin], "_cell")
    marked = df.withColumn(origin, F.monotonically_increasing_id())
    counted = marked.groupBy(F.shiftright(origin, PLACE_BITS).alias("p")).count().collect()  # one row a partition
    held = dict(sorted((r[0], r[1]) for r in counted))
    number = {p: i for i, p in enumerate(held)}
    sizes = np.array(list(held.values()), np.int64)
    rows = int(sizes.sum())
    per = cells_per_shard or max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / shards), math.ceil(rows / shards / CELL_ROWS))
    cells = cell_sizes(rows, shards, per)
    shared = spark.sparkContext.broadcast((number, sizes, cells))
    dealt: dict[int, np.ndarray] = {}

    @F.pandas_udf("int")
    def deal(origins: pd.Series) -> pd.Series:
        o = origins.to_numpy()
        parts, places = o >> PLACE_BITS, o & ((1 << PLACE_BITS) - 1)
        out = np.empty(len(o), np.int32)
        for p in np.unique(parts):
            if p not in dealt:
                dealt.clear()
                number_, sizes_, cells_ = shared.value
                i = number_[int(p)]
                mine = np.repeat(np.arange(len(cells_), dtype=np.int32), matrix_row(sizes_, cells_, i, seed))
                dealt[p] = np.random.default_rng([seed, 1, i]).permutation(mine)
            out[parts == p] = dealt[p][places[parts == p]]
        return pd.Series(out)

    sent = marked.withColumn(cell, deal(F.col(origin))).repartitionById(max(1, len(cells)), F.col(cell))
    from pyspark.sql import Window as W

    again = W.partitionBy(cell).orderBy(F.xxhash64(F.lit(seed), origin), origin)
    shard, nth = F.floor(F.col(cell) / per).cast("int"), (F.col(cell) % per).cast("long")
    held_by = F.lit(rows // shards) + (shard < rows % shards).cast("long")  # the sizes of cell_sizes
    even, odd = F.floor(held_by / per), held_by % per
    place = F.row_number().over(again)
    lost = F.lead(origin).over(again).isNull() & (place != even + (nth < odd).cast("long"))
    slot = F.when(lost, F.raise_error(F.lit("a partition held other rows when it was read again"))).otherwise(nth * even + F.least(nth, odd) + place - 1)
    return sent.withColumns({slot_out: slot.cast("long"), shard_out: shard}).drop(cell, origin)


def documents_shards(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    placed = shuffle_to_shards(docs.select("doc_id", "text"))
    utf8 = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select(
        "doc_id", (F.octet_length(utf8) + 8).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
