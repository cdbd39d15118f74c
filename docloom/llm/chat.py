"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Chat services often log the whole conversation again at every turn. A conversation that is a proper
beginning of a longer one holds nothing new, and goes; of equal conversations the smallest id stays.
A turn's two 64-bit hashes (of its place, role and text) are summed along the conversation, which
gives every beginning a 128-bit hash from one window; an anti-join drops conversations whose whole
hash is the hash of a proper beginning of another. What stays is rendered.

Beginnings and whole hashes are reduced to one row each before the join, so that a first turn that
all conversations share is one row. Only ids and hashes pass the window; texts are gathered once, for
the conversations that stay, each of which becomes one row.

Defined results: turns are ordered by turn number (null first), then role, then text; repeated rows
are turns of their own. A null role or text is an empty one. Rows with a null conversation id form
one conversation, with a null id, which is below every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEEDS = (11, 29)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n, h1, h2, last): for each n the hash of the first n turns, and whether they are all."""
    slim = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        *(F.xxhash64(F.lit(s), F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias(f"t{s}") for s in SEEDS),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # Ties of turn number and role are ordered by text in rendering; equal sums need the same order here, so the hashes go in that order too.
    order = W.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", F.sha2(F.col("text"), 256))
    ranked = slim.withColumn("n", F.row_number().over(order))
    running = W.partitionBy("conv").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    ahead = F.lead("n").over(W.partitionBy("conv").orderBy("n"))
    # the place goes into the hash, so that sums depend on the order; 38 digits hold any number of 64-bit terms
    sums = [F.sum(F.xxhash64(F.lit(s), "n", f"t{s}").cast("decimal(20,0)")).over(running).cast("decimal(30,0)").alias(f"h{i}") for i, s in enumerate(SEEDS, 1)]
    return ranked.select("conv", "n", *sums, ahead.isNull().alias("last"))


def maximal(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One column, conv: the conversations that are no beginning of another and the first of their equals."""
    hashes = prefix_hashes(turns, conv, turn, role, text)
    whole = hashes.where("last").groupBy("n", "h1", "h2").agg(F.min(F.struct(F.col("conv").isNotNull().alias("known"), "conv")).alias("first"))
    beginnings = hashes.where("not last").select("n", "h1", "h2").distinct()
    return whole.join(beginnings, ["n", "h1", "h2"], "left_anti").select("first.conv")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(f"{CLOSE}\n"))


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, text of the maximal conversations."""
    kept = maximal(turns, conv, turn, role, text).select(F.col("conv").alias("kept"))
    slim = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    mine = slim.join(kept, slim.conv_id.eqNullSafe(kept.kept), "left_semi")
    in_order = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", F.sha2(F.col("text"), 256).alias("tie"), "text")))
    return mine.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), in_order.alias("t")).select(
        "conv_id", "n_turns", F.array_join(F.transform("t", lambda x: render_turn(x.role, x.text)), "").alias("text")
    )


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS n FROM conversations),
r AS (SELECT conv_id, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM t),
p AS (SELECT conv_id, n, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY n) AS text,
             count(*) OVER (PARTITION BY conv_id) AS n_turns FROM r),
w AS (SELECT min(conv_id) AS conv_id, n_turns, text FROM p WHERE n = n_turns GROUP BY n_turns, text)
SELECT conv_id, n_turns, text FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.n_turns AND p.n = w.n_turns AND p.text = w.text)
"""
