"""Relational tables as documents: a table is a schema, a row an entity, a column a field.

A formula is written once per table. In it, [self.field] is a cell of the row's own entity, and [link.field]
one of the entity that the row's reference field `link` points to. All cells of a table come from one scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import parse, to_postfix
from ..model import CELLS, DOCUMENTS, EXPR, SCHEMA_FIELDS, SCHEMAS, DocumentSet


@dataclass(frozen=True)
class TableSpec:
    """How a table becomes a schema. entity: the Column with a row's entity id; cells of null columns are absent."""

    schema: str
    rows: DataFrame
    entity: Column
    numbers: dict[str, Column] = field(default_factory=dict)
    texts: dict[str, Column] = field(default_factory=dict)
    booleans: dict[str, Column] = field(default_factory=dict)
    #: field: (target schema, Column with the target's entity id)
    references: dict[str, tuple[str, Column]] = field(default_factory=dict)
    formulas: dict[str, str] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()


def _nodes(text: str, spec: TableSpec) -> Column:
    def entity(name: str) -> Column:
        return spec.entity if name == "self" else spec.references[name][1]

    nodes = [
        F.struct(F.lit(n["op"]).alias("op"), F.lit(n["num"]).cast("double").alias("num"), (entity(n["e"]) if n["e"] else F.lit(None)).cast("string").alias("e"), F.lit(n["f"]).cast("string").alias("f"))
        for n in to_postfix(parse(text))
    ]
    return F.array(*nodes).cast(EXPR)


def _cells(doc: Column, spec: TableSpec) -> DataFrame:
    def cell(name: str, kind: str, **x: Column) -> Column:
        types = {"num": "double", "txt": "string", "flag": "boolean", "ref": "string", "expr": EXPR}
        return F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), *(x.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()))

    cells = [cell(n, "number", num=c) for n, c in spec.numbers.items()]
    cells += [cell(n, "text", txt=c) for n, c in spec.texts.items()]
    cells += [cell(n, "boolean", flag=c) for n, c in spec.booleans.items()]
    cells += [cell(n, "reference", ref=c) for n, (_, c) in spec.references.items()]
    cells += [cell(n, "formula", expr=_nodes(t, spec)) for n, t in spec.formulas.items()]
    if not cells:
        return spec.rows.sparkSession.createDataFrame([], CELLS)
    rows = spec.rows.select(doc.alias("doc"), spec.entity.cast("string").alias("entity"), F.explode(F.array(*cells)).alias("c")).select("doc", "entity", "c.*")
    return rows.where("kind = 'formula' or num is not null or txt is not null or flag is not null or ref is not null")


def from_tables(spark: SparkSession, specs: list[TableSpec], doc: str = "tables", title: str = "Tables") -> DocumentSet:
    """One document of several tables."""
    fields = []
    for s in specs:
        kinds = {n: "number" for n in (*s.numbers, *s.formulas)} | {n: "text" for n in s.texts} | {n: "boolean" for n in s.booleans} | {n: "reference" for n in s.references}
        fields += [(doc, s.schema, n, t, s.references[n][0] if t == "reference" else None, n not in s.optional) for n, t in kinds.items()]
    key = F.lit(doc)
    entities = [s.rows.select(key.alias("doc"), s.entity.cast("string").alias("entity_key"), s.entity.cast("string").alias("entity_id"), F.lit(s.schema).alias("schema")) for s in specs]
    return DocumentSet(
        spark.createDataFrame([(doc, doc, title)], DOCUMENTS), spark.createDataFrame([(doc, s.schema, s.schema) for s in specs], SCHEMAS), spark.createDataFrame(fields, SCHEMA_FIELDS),
        reduce(DataFrame.unionAll, entities), reduce(DataFrame.unionAll, [_cells(key, s) for s in specs]),
    )
