"""Read-only views of documents: overview, explanations, descriptions, and inert suggestions."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formula import ComplexityError, check_complexity, postfix_text
from ..functions.numbers import overview_text
from ..model import DocumentSet
from ..session import ship
from .calc import Calculation, CalculationError, calculate
from .diff import in_order, render, semantic_diff
from .edits import EditError, cell_of, value_of, with_cell
from .graph import affected_by, dependencies
from .validate import findings_of


def label(name: Column, identifier: Column) -> Column:
    """The name, or the identifier in words with one capital."""
    words = F.array_join(F.filter(F.split(identifier, "_"), lambda w: w != ""), " ")
    return F.coalesce(name, F.when(words == "", identifier).otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 30))))


def counts(docs: DocumentSet) -> DataFrame:
    """doc, schema_count, entity_count, formula_count."""
    n = lambda df, name: df.groupBy("doc").agg(F.count(F.lit(1)).alias(name))
    out = docs.documents.select("doc").join(n(docs.schemas, "schema_count"), "doc", "left").join(n(docs.entities, "entity_count"), "doc", "left")
    out = out.join(n(docs.cells.where("kind = 'formula'"), "formula_count"), "doc", "left")
    return out.select("doc", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("schema_count", "entity_count", "formula_count")))


def field_kinds(docs: DocumentSet) -> DataFrame:
    """doc, entity, schema, label, field, field_kind (input, reference or formula), target_schema, and the cell's value."""
    names = docs.cells.where("field = 'name' and kind = 'text'").select("doc", "entity", F.col("txt").alias("name"))
    owners = docs.entities.select("doc", F.col("entity_key").alias("entity"), "entity_id", "schema").join(names, ["doc", "entity"], "left").withColumn("label", label(F.col("name"), F.col("entity_id"))).drop("name")
    declared = docs.schema_fields.select("doc", F.col("schema_key").alias("schema"), "field", "type", "ref_schema")
    joined = docs.cells.join(owners, ["doc", "entity"]).join(declared, ["doc", "schema", "field"], "left")
    points = (F.col("kind") == "reference") & (F.col("type") == "reference")
    kind = F.when(F.col("kind") == "formula", "formula").when(points, "reference").otherwise("input")
    return joined.select("doc", "entity", "entity_id", "schema", "label", "field", kind.alias("field_kind"), F.when(points, F.col("ref_schema")).alias("target_schema"), "kind", "num", "txt", "flag", "ref")


def number_text(x: Column) -> Column:
    """Numbers as the overview spells them."""
    @F.pandas_udf("string")
    def spell(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or v != v else overview_text(v)).astype(object)

    return spell(x)


def overview(docs: DocumentSet, calculation: Calculation | None = None) -> DataFrame:
    """field_kinds with `display`, what a reader sees of the cell."""
    ship(docs.spark)
    calculation = calculation or calculate(docs)
    rows = field_kinds(docs).join(calculation.values, ["doc", "entity", "field"], "left")
    number = number_text(F.when(F.col("kind") == "formula", F.col("value")).when(F.col("kind") == "number", F.col("num")))
    display = F.when(F.col("kind").isin("formula", "number"), F.coalesce(number, F.lit("unavailable"))).when(F.col("kind") == "text", F.col("txt")).when(F.col("kind") == "boolean", F.col("flag").cast("string")).otherwise(F.concat(F.lit("→ "), "ref"))
    return rows.withColumn("display", display).select("doc", "entity", "schema", "label", "field", "field_kind", "target_schema", "display")


@dataclass(frozen=True)
class Explanation:
    field: str
    display: str
    expression: str | None
    dependencies: list[str]
    affected: list[tuple[str, str]]


def explain_field(docs: DocumentSet, doc: str, entity: str, field: str) -> Explanation:
    """One cell: its value, formula, direct dependencies, and the formulas downstream with their values."""
    cell = cell_of(docs, doc, entity, field)
    one = docs.only(doc)
    calculation = calculate(one)
    try:
        calculation.check()
    except CalculationError as e:
        raise EditError("Calculation", f"could not calculate document: {e}") from e
    values = calculation.values
    mine = (F.col("entity") == entity) & (F.col("field") == field)
    number = values.where(mine).first()
    kind, x = value_of(cell)
    display = overview_text(number["value"]) if number else x if kind == "text" else ("true" if x else "false") if kind == "boolean" else f"→ {x}"
    deps = dependencies(one).where(mine).first()
    seeds = one.cells.where(mine).select("doc", "entity", "field")
    downstream = affected_by(calculation.edges, seeds).join(values, ["doc", "entity", "field"]).orderBy("entity", "field").collect()
    return Explanation(
        f"{entity}.{field}", display, postfix_text(cell["expr"]) if kind == "formula" else None,
        [f"{d['entity']}.{d['field']}" for d in (deps["dependencies"] if deps else [])], [(f"{r['entity']}.{r['field']}", overview_text(r["value"])) for r in downstream],
    )


def entity_fields(docs: DocumentSet) -> DataFrame:
    """doc, id, schema, fields: a row per entity, with the sorted names of its fields."""
    own = docs.cells.groupBy("doc", F.col("entity").alias("entity_key")).agg(F.array_sort(F.collect_list("field")).alias("fields"))
    return docs.entities.join(own, ["doc", "entity_key"], "left").select("doc", F.col("entity_key").alias("id"), "schema", F.coalesce("fields", F.array().cast("array<string>")).alias("fields"))


def describe_documents(docs: DocumentSet) -> DataFrame:
    """doc, id, title, schemas, entities: the structure without values, sorted. A document is one row, and its entities one
    array; entity_fields gives them as rows, for documents of any size."""
    field = F.struct("field", "type", "ref_schema", "required")
    fields = docs.schema_fields.groupBy("doc", "schema_key").agg(F.array_sort(F.collect_list(field)).alias("fields"))
    schemas = docs.schemas.join(fields, ["doc", "schema_key"], "left").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("schema_key").alias("id"), F.coalesce("fields", F.array().cast("array<struct<field:string,type:string,ref_schema:string,required:boolean>>")).alias("fields")))).alias("schemas"))
    entities = entity_fields(docs).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", "schema", "fields"))).alias("entities"))
    return docs.documents.join(schemas, "doc", "left").join(entities, "doc", "left")


class FormulaExplanationError(ValueError):
    pass


def explain_formula(docs: DocumentSet, doc: str, entity: str, field: str) -> dict:
    """field, expression, value and direct dependencies of a formula."""
    cell = docs.cells.where((F.col("doc") == doc) & (F.col("entity") == entity) & (F.col("field") == field)).first()
    if cell is None:
        raise FormulaExplanationError(f"formula field '{entity}.{field}' does not exist")
    if cell["kind"] != "formula":
        raise FormulaExplanationError(f"field '{entity}.{field}' is not a formula")
    one = docs.only(doc)
    calculation = calculate(one)
    calculation.check()
    mine = (F.col("entity") == entity) & (F.col("field") == field)
    value = calculation.values.where(mine).first()
    if value is None:
        raise FormulaExplanationError(f"formula field '{entity}.{field}' has no calculated value")
    deps = dependencies(one).where(mine).first()["dependencies"]
    return {"field": f"{entity}.{field}", "expression": postfix_text(cell["expr"]), "value": value["value"], "dependencies": [f"{d['entity']}.{d['field']}" for d in deps]}


def explain_impact(before: DocumentSet, after: DocumentSet) -> tuple[DataFrame, DataFrame]:
    """The changes in order, and the report of each document."""
    changes = semantic_diff(before, after)
    return in_order(changes), render(changes, before, after)


class SuggestionError(ValueError):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def suggest_field_change(docs: DocumentSet, doc: str, entity: str, field: str, value: tuple) -> dict:
    """A checked proposal, that changes nothing: {field, value, requires_approval}. value is (kind, payload)."""
    from ..operators.merge import diagnostics_text

    name = f"{entity}.{field}"
    try:
        cell = cell_of(docs, doc, entity, field)
    except EditError as e:
        raise SuggestionError(e.kind, str(e)) from e
    if cell["kind"] == "formula" and value[0] != "formula":
        raise SuggestionError("FormulaEdit", f"field '{name}' is a formula; suggest a change to its inputs instead")
    if value_of(cell) == value:
        raise SuggestionError("NoChange", f"'{name}' already has that value")
    schema = docs.entities.where((F.col("doc") == doc) & (F.col("entity_key") == entity)).first()["schema"]
    declared = docs.schema_fields.where((F.col("doc") == doc) & (F.col("schema_key") == schema) & (F.col("field") == field)).first()
    if declared is None:
        raise SuggestionError("MissingField", f"field '{name}' does not exist")
    if declared["type"] != ("number" if value[0] == "formula" else value[0]):
        raise SuggestionError("TypeMismatch", f"value for '{name}' does not match its schema type")
    if value[0] == "formula":
        try:
            check_complexity(value[1])
        except ComplexityError as e:
            raise SuggestionError("ExpressionComplexity", f"formula for '{name}' exceeds authoring complexity limits: {e}") from e
    proposed = with_cell(docs, doc, entity, field, value).only(doc)
    if found := findings_of(proposed):
        raise SuggestionError("InvalidDocument", f"suggestion would make the document invalid: {diagnostics_text(found)}")
    try:
        calculate(proposed).check()
    except CalculationError as e:
        raise SuggestionError("Calculation", f"suggestion would make calculation fail: {e}") from e
    return {"field": name, "value": value, "requires_approval": True}
