"""Dependencies between cells: direct edges and transitive impact."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DocumentSet
from ..session import settle

#: Edges of a document that one task walks.
WHOLE = 1 << 16
REACHED = ["doc", "seed_entity", "seed_field", "entity", "field"]


def edges(docs: DocumentSet) -> DataFrame:
    """Distinct direct dependencies: doc, entity, field, dep_entity, dep_field."""
    refs = F.array_distinct(F.transform(F.filter("expr", lambda n: n.op == "reference"), lambda n: F.struct(n.e.alias("e"), n.f.alias("f"))))
    rows = docs.cells.where("kind = 'formula'").select("doc", "entity", "field", F.explode(refs).alias("d"))
    return rows.select("doc", "entity", "field", F.col("d.e").alias("dep_entity"), F.col("d.f").alias("dep_field"))


def dependencies(docs: DocumentSet) -> DataFrame:
    """A row per formula, with its sorted direct dependencies: an empty array where it has none."""
    refs = F.array_sort(F.array_distinct(F.transform(F.filter("expr", lambda n: n.op == "reference"), lambda n: F.struct(n.e.alias("entity"), n.f.alias("field")))))
    return docs.cells.where("kind = 'formula'").select("doc", "entity", "field", refs.alias("dependencies"))


def affected_by(all_edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The formulas downstream of each seed (doc, entity, field), without the seed itself:
    doc, seed_entity, seed_field, entity, field. Documents of at most WHOLE edges are walked by one task each; larger
    ones take a round per step of distance, whose new rows are settled and told from all earlier ones by one join."""
    back = settle(all_edges.select("doc", F.col("dep_entity").alias("at_entity"), F.col("dep_field").alias("at_field"), "entity", "field"))
    sizes = back.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    least, most = sizes.agg(F.min("n"), F.max("n")).first()
    start = seeds.select("doc", F.col("entity").alias("seed_entity"), F.col("field").alias("seed_field")).distinct()
    if not most or most <= WHOLE:
        return _walked(back, start)
    if least > WHOLE:
        return _by_rounds(back, start)
    big = settle(sizes.where(F.col("n") > WHOLE).select("doc"))
    split = [[t.join(big, "doc", how) for t in (back, start)] for how in ("left_anti", "left_semi")]
    return _walked(*split[0]).unionAll(_by_rounds(*split[1]))


def _walked(back: DataFrame, start: DataFrame) -> DataFrame:
    """Breadth first from each seed, one document in one task."""
    none = F.lit(None).cast("string")
    rows = back.unionByName(start.select("doc", F.col("seed_entity").alias("at_entity"), F.col("seed_field").alias("at_field"), none.alias("entity"), none.alias("field")))

    def of_document(doc: str, users: dict[tuple, list], seeds: list) -> Iterator[pa.RecordBatch]:
        for seed in seeds:
            seen, front = {seed}, [seed]
            while front:
                front = [u for at in front for u in users.get(at, ()) if u not in seen and not seen.add(u)]
            seen.discard(seed)
            reached = list(seen)
            for a in range(0, len(reached), 10_000):
                part = reached[a : a + 10_000]
                columns = [[doc] * len(part), [seed[0]] * len(part), [seed[1]] * len(part), [x[0] for x in part], [x[1] for x in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=REACHED)

    def run(batches):
        here, users, seeds = None, {}, []
        for batch in batches:
            for doc, e, f, entity, field in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc != here:
                    yield from of_document(here, users, seeds)
                    here, users, seeds = doc, {}, []
                if entity is None:
                    seeds.append((e, f))
                else:
                    users.setdefault((e, f), []).append((entity, field))
        yield from of_document(here, users, seeds)

    return rows.repartition("doc").sortWithinPartitions("doc").mapInArrow(run, ", ".join(f"{c} string" for c in REACHED))


def _by_rounds(back: DataFrame, start: DataFrame) -> DataFrame:
    front = start.select("*", F.col("seed_entity").alias("at_entity"), F.col("seed_field").alias("at_field"))
    seen: list[DataFrame] = []
    while True:
        step = front.join(back, ["doc", "at_entity", "at_field"]).where("not (entity = seed_entity and field = seed_field)").select(*REACHED).distinct()
        if seen:
            step = step.join(reduce(DataFrame.unionAll, seen), REACHED, "left_anti")
        step = settle(step)
        seen.append(step)
        if step.isEmpty():
            return reduce(DataFrame.unionAll, seen)
        front = step.select("doc", "seed_entity", "seed_field", F.col("entity").alias("at_entity"), F.col("field").alias("at_field"))
