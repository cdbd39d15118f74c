"""Documents as tables.

A DocumentSet holds any number of documents in five tables, keyed by `doc`. A document has typed schemas,
entities of a schema, and cells: one value of a kind (number, text, boolean, reference, formula) in the
column of its kind. Absence of a row is the only missing value. Expressions are postfix arrays.

Where a set is made, its session is told to join by measured sizes (session.join_by_size), whatever the set is made of.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import join_by_size

EXPR = "array<struct<op:string,num:double,e:string,f:string>>"
DOCUMENTS = "doc string, id string, title string"
SCHEMAS = "doc string, schema_key string, schema_id string"
SCHEMA_FIELDS = "doc string, schema_key string, field string, type string, ref_schema string, required boolean"
ENTITIES = "doc string, entity_key string, entity_id string, schema string"
CELLS = f"doc string, entity string, field string, kind string, num double, txt string, flag boolean, ref string, expr {EXPR}"
VALUE = ("kind", "num", "txt", "flag", "ref", "expr")
KINDS = ("number", "text", "boolean", "reference", "formula")


@dataclass(frozen=True)
class DocumentSet:
    documents: DataFrame
    schemas: DataFrame
    schema_fields: DataFrame
    entities: DataFrame
    cells: DataFrame

    def __post_init__(self) -> None:
        join_by_size(self.spark)

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    def with_(self, **tables: DataFrame) -> DocumentSet:
        return replace(self, **tables)

    def only(self, doc: str) -> DocumentSet:
        """The document of one key."""
        return DocumentSet(*(t.where(F.col("doc") == doc) for t in self.tables()))

    def without(self, docs: DataFrame) -> DocumentSet:
        """The documents but those that docs (one column, doc) names."""
        return DocumentSet(*(t.join(docs, "doc", "left_anti") for t in self.tables()))

    def tables(self) -> tuple[DataFrame, ...]:
        return self.documents, self.schemas, self.schema_fields, self.entities, self.cells

    def union(self, other: DocumentSet) -> DocumentSet:
        return DocumentSet(*(a.unionByName(b) for a, b in zip(self.tables(), other.tables(), strict=True)))


def comparable(value: Column) -> Column:
    """A value for equality: numbers by value, so that 0.0 and -0.0 are equal, formulas by structure."""
    return F.struct(
        value.kind.alias("kind"), (value.num + F.lit(0.0)).alias("num"), value.txt.alias("txt"), value.flag.alias("flag"), value.ref.alias("ref"),
        F.transform(value.expr, lambda n: F.struct(n.op, n.num + F.lit(0.0), n.e, n.f)).alias("expr"),
    )


def is_finite(x: Column) -> Column:
    return x.between(F.lit(-1.7976931348623157e308), F.lit(1.7976931348623157e308))


def is_identifier(x: Column) -> Column:
    return x.rlike(r"^[a-z0-9][a-z0-9_-]*\z")


def is_blank(x: Column) -> Column:
    """Nothing but Unicode white space."""
    return x.rlike(r"^[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*\z")


def empty_set(spark: SparkSession) -> DocumentSet:
    return DocumentSet(*(spark.createDataFrame([], s) for s in (DOCUMENTS, SCHEMAS, SCHEMA_FIELDS, ENTITIES, CELLS)))


# --- one document in Python ---------------------------------------------------------------------
#
# {"id", "title", "schemas": {key: {"id", "fields": {field: {"type", "ref_schema", "required"}}}},
#  "entities": {key: {"id", "schema", "fields": {field: (kind, payload)}}}}; a formula's payload is an expression.


def rows_of(doc: str, document: dict) -> tuple[list, list, list, list, list]:
    """The rows of the five tables."""
    from .functions.formula import to_postfix

    schemas, fields, entities, cells = [], [], [], []
    for key, s in document["schemas"].items():
        schemas.append((doc, key, s["id"]))
        fields += [(doc, key, f, d["type"], d["ref_schema"], d["required"]) for f, d in s["fields"].items()]
    for key, e in document["entities"].items():
        entities.append((doc, key, e["id"], e["schema"]))
        for f, (kind, x) in e["fields"].items():
            at = KINDS.index(kind)
            payload = [None] * 5
            payload[at] = [(n["op"], n["num"], n["e"], n["f"]) for n in to_postfix(x)] if kind == "formula" else float(x) if kind == "number" else x
            cells.append((doc, key, f, kind, *payload))
    return [(doc, document["id"], document["title"])], schemas, fields, entities, cells


def from_python(spark: SparkSession, documents: dict[str, dict]) -> DocumentSet:
    """A set of documents written in Python, by key."""
    parts: tuple[list, ...] = ([], [], [], [], [])
    for doc, d in documents.items():
        for into, rows in zip(parts, rows_of(doc, d), strict=True):
            into += rows
    return DocumentSet(*(spark.createDataFrame(rows, schema) for rows, schema in zip(parts, (DOCUMENTS, SCHEMAS, SCHEMA_FIELDS, ENTITIES, CELLS), strict=True)))


def to_python(docs: DocumentSet, doc: str) -> dict:
    """One document of the set, collected; for writing single files."""
    from .functions.formula import from_postfix

    one = docs.only(doc)
    head = one.documents.first()
    out = {"id": head["id"], "title": head["title"], "schemas": {}, "entities": {}}
    for r in sorted(one.schemas.collect(), key=lambda r: r["schema_key"].encode()):
        out["schemas"][r["schema_key"]] = {"id": r["schema_id"], "fields": {}}
    for r in sorted(one.schema_fields.collect(), key=lambda r: r["field"].encode()):
        out["schemas"][r["schema_key"]]["fields"][r["field"]] = {"type": r["type"], "ref_schema": r["ref_schema"], "required": r["required"]}
    for r in sorted(one.entities.collect(), key=lambda r: r["entity_key"].encode()):
        out["entities"][r["entity_key"]] = {"id": r["entity_id"], "schema": r["schema"], "fields": {}}
    for r in sorted(one.cells.collect(), key=lambda r: r["field"].encode()):
        payload = r[{"number": "num", "text": "txt", "boolean": "flag", "reference": "ref", "formula": "expr"}[r["kind"]]]
        out["entities"][r["entity"]]["fields"][r["field"]] = (r["kind"], from_postfix(payload) if r["kind"] == "formula" else payload)
    return out
