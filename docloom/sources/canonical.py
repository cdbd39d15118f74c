"""Canonical writing: documents, calculated values and evaluated exports as JSON text.

Members come in a fixed order, maps sorted by key, two spaces of indent, one line end at the end; numbers
are spelled by numbers.json_text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import json_text
from ..model import DocumentSet
from ..operators.calc import Calculation
from ..session import ship

EXPORT_VERSION = 1
#: Documents that are Python objects at once, in the distributed writers.
FEW = 500


def dumps(x, indent: int = 0) -> str:
    """Pretty JSON of dicts, lists, strings, booleans, ints and floats."""
    inner, outer = "  " * (indent + 1), "  " * indent
    if isinstance(x, dict):
        body = ",\n".join(f"{inner}{json.dumps(k, ensure_ascii=False)}: {dumps(v, indent + 1)}" for k, v in x.items())
        return f"{{\n{body}\n{outer}}}" if x else "{}"
    if isinstance(x, list):
        return "[\n" + ",\n".join(inner + dumps(v, indent + 1) for v in x) + f"\n{outer}]" if x else "[]"
    if isinstance(x, bool) or x is None:
        return json.dumps(x)
    if isinstance(x, float):
        return json_text(x)
    return json.dumps(x, ensure_ascii=False)


def _ordered(m: dict) -> list:
    return sorted(m.items(), key=lambda kv: kv[0].encode())


def _expression(x: tuple):
    if x[0] == "number":
        return {"op": "number", "args": x[1]}
    if x[0] == "reference":
        return {"op": "reference", "args": {"entity": x[1], "field": x[2]}}
    return {"op": x[0], "args": {"left": _expression(x[1]), "right": _expression(x[2])}}


def encode(document: dict) -> str:
    """The canonical text of a document in Python."""

    def kind(d: dict) -> dict:
        return {"type": d["type"]} | ({"schema": d["ref_schema"]} if d["type"] == "reference" else {})

    return dumps({
        "format_version": 1, "id": document["id"], "title": document["title"],
        "schemas": {k: {"id": s["id"], "fields": {f: {"field_type": kind(d), "required": d["required"]} for f, d in _ordered(s["fields"])}} for k, s in _ordered(document["schemas"])},
        "entities": {k: {"id": e["id"], "schema": e["schema"], "fields": {f: {"kind": t, "value": _expression(x) if t == "formula" else x} for f, (t, x) in _ordered(e["fields"])}} for k, e in _ordered(document["entities"])},
    }) + "\n"


def encode_export(document: dict, values: dict[tuple[str, str], float]) -> str:
    """The evaluated export of a document in Python: formulas as numbers, references as {"reference": id}."""

    def cell(e: str, f: str, t: str, x):
        return values[e, f] if t == "formula" else {"reference": x} if t == "reference" else x

    return dumps({
        "format_version": EXPORT_VERSION, "document_id": document["id"], "title": document["title"],
        "entities": {k: {"schema": e["schema"], "fields": {f: cell(k, f, t, x) for f, (t, x) in _ordered(e["fields"])}} for k, e in _ordered(document["entities"])},
    }) + "\n"


def encode_values(values: dict[tuple[str, str], float]) -> str:
    """A map of "entity.field" to numbers, sorted by that text."""
    return dumps(dict(_ordered({f"{e}.{f}": x for (e, f), x in values.items()}))) + "\n"


# --- distributed ------------------------------------------------------------------------------------


def _gathered(docs: DocumentSet) -> DataFrame:
    """A row per document, with its rows of the other tables as arrays."""
    out = docs.documents
    for name, t in (("schemas", docs.schemas), ("schema_fields", docs.schema_fields), ("entities", docs.entities), ("cells", docs.cells)):
        out = out.join(t.groupBy("doc").agg(F.collect_list(F.struct(*[c for c in t.columns if c != "doc"])).alias(name)), "doc", "left")
    return out


def _document(r) -> dict:
    from ..functions.formula import from_postfix

    rows = lambda x: [] if x is None else list(x)
    out = {"id": r["id"], "title": r["title"], "schemas": {s["schema_key"]: {"id": s["schema_id"], "fields": {}} for s in rows(r["schemas"])}, "entities": {e["entity_key"]: {"id": e["entity_id"], "schema": e["schema"], "fields": {}} for e in rows(r["entities"])}}
    for d in rows(r["schema_fields"]):
        out["schemas"][d["schema_key"]]["fields"][d["field"]] = {"type": d["type"], "ref_schema": d["ref_schema"], "required": bool(d["required"])}
    for c in rows(r["cells"]):
        x = c[{"number": "num", "text": "txt", "boolean": "flag", "reference": "ref", "formula": "expr"}[c["kind"]]]
        x = from_postfix(x) if c["kind"] == "formula" else float(x) if c["kind"] == "number" else bool(x) if c["kind"] == "boolean" else x
        out["entities"][c["entity"]]["fields"][c["field"]] = (c["kind"], x)
    return out


def _texts(rows: DataFrame, text: Callable[[dict], str]) -> DataFrame:
    """doc, text of every row; one document is in one task, and few at a time are Python objects."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FEW):
                some = batch.slice(at, FEW).to_pandas().to_dict("records")
                yield pa.RecordBatch.from_arrays([pa.array([r["doc"] for r in some], pa.string()), pa.array([text(r) for r in some], pa.string())], names=["doc", "text"])

    return rows.mapInArrow(run, "doc string, text string")


def canonical_texts(docs: DocumentSet) -> DataFrame:
    """doc, text: every document's canonical text."""
    return _texts(_gathered(docs), lambda r: encode(_document(r)))


def export_rows(calculation: Calculation) -> DataFrame:
    """The export as rows: doc, entity, schema, field, number, text, boolean, reference; one of the last four is set."""
    docs = calculation.docs
    owners = docs.entities.select("doc", F.col("entity_key").alias("entity"), "schema")
    joined = docs.cells.join(owners, ["doc", "entity"]).join(calculation.values, ["doc", "entity", "field"], "left")
    return joined.select("doc", "entity", "schema", "field", F.when(F.col("kind") == "formula", F.col("value")).otherwise(F.col("num")).alias("number"), F.col("txt").alias("text"), F.col("flag").alias("boolean"), F.col("ref").alias("reference"))


def _values(r: dict) -> dict[tuple[str, str], float]:
    return {(v["entity"], v["field"]): v["value"] for v in ([] if r["values"] is None else r["values"])}


def export_texts(calculation: Calculation) -> DataFrame:
    """doc, text: every document's evaluated export."""
    values = calculation.values.groupBy("doc").agg(F.collect_list(F.struct("entity", "field", "value")).alias("values"))
    return _texts(_gathered(calculation.docs).join(values, "doc", "left"), lambda r: encode_export(_document(r), _values(r)))


def values_texts(calculation: Calculation) -> DataFrame:
    """doc, text: the calculated values of every document."""
    values = calculation.values.groupBy("doc").agg(F.collect_list(F.struct("entity", "field", "value")).alias("values"))
    return _texts(calculation.docs.documents.select("doc").join(values, "doc", "left"), lambda r: encode_values(_values(r)))


def save(path: str, text: str) -> None:
    """Write a new file; an existing one is never replaced."""
    with open(path, "x", encoding="utf-8", newline="") as f:
        f.write(text)
