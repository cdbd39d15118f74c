"""Validation: thirteen kinds of findings, as rows (doc, path, code, message).

Findings are not deduplicated: a formula that repeats a bad reference is found twice. sorted_findings
gives the contractual order of a document's findings: path, code (in the order of CODES), message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DocumentSet, is_blank, is_finite, is_identifier
from ..session import settle

#: In their order.
CODES = (
    "EmptyIdentifier", "InvalidIdentifier", "EmptyTitle", "KeyMismatch", "MissingSchema", "MissingRequiredField", "UnexpectedField",
    "TypeMismatch", "MissingReference", "ReferenceTypeMismatch", "NonFiniteNumber", "MissingFormulaReference", "FormulaReferenceTypeMismatch",
)


def _found(df: DataFrame, path: Column, code: str | Column, message: Column) -> DataFrame:
    return df.select("doc", path.alias("path"), (F.lit(code) if isinstance(code, str) else code).alias("code"), message.alias("message"))


def _say(template: str, *values: str | Column) -> Column:
    """The template with columns in its places {}."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, text in zip(values, parts[1:], strict=True):
        out += [F.col(v) if isinstance(v, str) else v, F.lit(text)]
    return F.concat(*out)


def identifier_findings(df: DataFrame, kind: str, name: str, path: Column) -> DataFrame:
    """Empty identifiers, and those against the grammar."""
    bad = df.where(~is_identifier(F.col(name)))
    code = F.when(F.col(name) == "", "EmptyIdentifier").otherwise("InvalidIdentifier")
    grammar = _say(f"{kind} id '{{}}' must be a lowercase identifier using only a-z, 0-9, '_' or '-', starting with a letter or digit", name)
    return _found(bad, path, code, F.when(F.col(name) == "", f"{kind} id must not be empty").otherwise(grammar))


def title_findings(docs: DocumentSet) -> DataFrame:
    return _found(docs.documents.where(is_blank(F.col("title"))), F.lit("title"), "EmptyTitle", F.lit("document title must not be empty"))


def key_findings(docs: DocumentSet) -> DataFrame:
    s = _found(docs.schemas.where("schema_key <> schema_id"), _say("schemas.{}.id", "schema_key"), "KeyMismatch", _say("schema map key '{}' does not match id '{}'", "schema_key", "schema_id"))
    e = _found(docs.entities.where("entity_key <> entity_id"), _say("entities.{}.id", "entity_key"), "KeyMismatch", _say("entity map key '{}' does not match id '{}'", "entity_key", "entity_id"))
    return s.unionAll(e)


def missing_schema_findings(docs: DocumentSet) -> DataFrame:
    known = docs.schemas.select("doc", F.col("schema_key").alias("schema"))
    return _found(docs.entities.join(known, ["doc", "schema"], "left_anti"), _say("entities.{}.schema", "entity_key"), "MissingSchema", _say("schema '{}' does not exist", "schema"))


def _placed(docs: DocumentSet) -> DataFrame:
    """Entities whose schema exists: doc, entity, schema."""
    known = docs.schemas.select("doc", F.col("schema_key").alias("schema"))
    return docs.entities.join(known, ["doc", "schema"]).select("doc", F.col("entity_key").alias("entity"), "schema")


def _declared(docs: DocumentSet) -> DataFrame:
    return docs.schema_fields.select("doc", F.col("schema_key").alias("schema"), "field", "type", "ref_schema", "required")


def required_findings(docs: DocumentSet) -> DataFrame:
    wanted = _placed(docs).join(_declared(docs).where("required"), ["doc", "schema"])
    missing = wanted.join(docs.cells.select("doc", "entity", "field"), ["doc", "entity", "field"], "left_anti")
    return _found(missing, _say("entities.{}.fields.{}", "entity", "field"), "MissingRequiredField", _say("required field '{}' is missing", "field"))


def unexpected_findings(docs: DocumentSet) -> DataFrame:
    cells = docs.cells.select("doc", "entity", "field").join(_placed(docs), ["doc", "entity"])
    extra = cells.join(_declared(docs).select("doc", "schema", "field"), ["doc", "schema", "field"], "left_anti")
    return _found(extra, _say("entities.{}.fields.{}", "entity", "field"), "UnexpectedField", _say("field '{}' is not declared by schema '{}'", "field", "schema"))


def cell_findings(docs: DocumentSet) -> DataFrame:
    """Kinds that don't fit, references that lead nowhere or elsewhere, numbers that aren't finite."""
    cells = docs.cells.join(_placed(docs), ["doc", "entity"]).join(_declared(docs), ["doc", "schema", "field"])
    path = _say("entities.{}.fields.{}", "entity", "field")
    fits = (F.col("type") == F.col("kind")) | ((F.col("type") == "number") & (F.col("kind") == "formula"))
    kinds = _found(cells.where(~fits), path, "TypeMismatch", _say("field '{}' expects {}, but found {}", "field", "type", "kind"))
    numbers = _found(cells.where((F.col("type") == "number") & (F.col("kind") == "number") & ~is_finite(F.col("num"))), path, "NonFiniteNumber", F.lit("numeric values must be finite"))
    links = cells.where("type = 'reference' and kind = 'reference'")
    targets = docs.entities.select("doc", F.col("entity_key").alias("ref"), F.col("schema").alias("target_schema"))
    led = links.join(targets, ["doc", "ref"], "left")
    gone = _found(led.where("target_schema is null"), path, "MissingReference", _say("referenced entity '{}' does not exist", "ref"))
    other = _found(led.where("target_schema <> ref_schema"), path, "ReferenceTypeMismatch", _say("field '{}' expects a reference to schema '{}', but '{}' uses schema '{}'", "field", "ref_schema", "ref", "target_schema"))
    return reduce(DataFrame.unionAll, [kinds, numbers, gone, other])


def formula_findings(docs: DocumentSet) -> DataFrame:
    """Formulas in numeric fields: literals that aren't finite, references without a numeric declaration."""
    cells = docs.cells.where("kind = 'formula'").join(_placed(docs), ["doc", "entity"]).join(_declared(docs).where("type = 'number'"), ["doc", "schema", "field"])
    nodes = cells.select("doc", _say("entities.{}.fields.{}", "entity", "field").alias("path"), F.explode("expr").alias("n"))
    literal = _found(nodes.where((F.col("n.op") == "number") & ~is_finite(F.col("n.num"))), F.col("path"), "NonFiniteNumber", F.lit("numeric values must be finite"))
    refs = nodes.where("n.op = 'reference'").select("doc", "path", F.col("n.e").alias("e"), F.col("n.f").alias("f"))
    targets = docs.entities.select("doc", F.col("entity_key").alias("e"), F.col("schema").alias("ts"))
    schemas = docs.schemas.select("doc", F.col("schema_key").alias("ts"), F.lit(True).alias("has_schema"))
    fields = docs.schema_fields.select("doc", F.col("schema_key").alias("ts"), F.col("field").alias("f"), F.col("type").alias("tt"))
    led = refs.join(targets, ["doc", "e"], "left").join(schemas, ["doc", "ts"], "left").join(fields, ["doc", "ts", "f"], "left")
    said = "formula reference '{}.{}' "
    lost = F.when(F.col("ts").isNull(), "has no target entity").when(F.col("has_schema").isNull(), "has no target schema").when(F.col("tt").isNull(), "has no target field")
    missing = _found(led.where("tt is null"), F.col("path"), "MissingFormulaReference", F.concat(_say(said, "e", "f"), lost))
    other = _found(led.where("tt <> 'number'"), F.col("path"), "FormulaReferenceTypeMismatch", _say(said + "does not target a numeric field", "e", "f"))
    return reduce(DataFrame.unionAll, [literal, missing, other])


def validate(docs: DocumentSet) -> DataFrame:
    """All findings of all documents."""
    return reduce(DataFrame.unionAll, [
        identifier_findings(docs.documents, "document", "id", F.lit("id")),
        title_findings(docs),
        key_findings(docs),
        identifier_findings(docs.schemas, "schema", "schema_id", _say("schemas.{}.id", "schema_key")),
        identifier_findings(docs.schema_fields, "field", "field", _say("schemas.{}.fields.{}", "schema_key", "field")),
        identifier_findings(docs.entities, "entity", "entity_id", _say("entities.{}.id", "entity_key")),
        missing_schema_findings(docs), required_findings(docs), unexpected_findings(docs), cell_findings(docs), formula_findings(docs),
    ])


def sorted_findings(findings: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, CODES)), F.col("code"))
    return findings.orderBy("doc", "path", place, "message")


def faults(docs: DocumentSet) -> DataFrame:
    """doc, path, code, message: the findings of each document, or, where it has none, the first error of its calculation."""
    from .calc import calculate, error_text

    found = settle(validate(docs))
    sound = docs if found.isEmpty() else docs.without(settle(found.select("doc").distinct()))
    return found.unionAll(settle(error_text(calculate(sound).first_errors())))


def findings_of(docs: DocumentSet) -> list[tuple[str, str, str]]:
    """(path, code, message) of the findings, in order, on the driver: for single documents."""
    return [(r["path"], r["code"], r["message"]) for r in sorted_findings(validate(docs)).collect()]
