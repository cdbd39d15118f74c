"""Semantic comparison of two versions of each document.

before and after are sets whose documents pair up by `doc`. Changes are rows:
doc, section, k1, k2, ord, kind, before, after, causes. Sections: 0 document, 1 schemas (k1 schema, k2
field), 2 entities (k1 entity, k2 field), 3 impacts. before and after are display structs
(text, value, definition), of which one member is set. Stored values are compared by numbers (0.0 equals
-0.0) and by formula structure; derived values by their bits.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import debug_string, plain
from ..model import VALUE, DocumentSet, comparable
from ..session import settle, ship
from .calc import Calculation, CalculationError, calculate, error_text
from .graph import affected_by

VALUE_TYPE = "struct<kind:string,num:double,txt:string,flag:boolean,ref:string,expr:array<struct<op:string,num:double,e:string,f:string>>>"
DEFINITION_TYPE = "struct<type:string,ref_schema:string,required:boolean>"
SIDE = f"struct<text:string,value:{VALUE_TYPE},definition:{DEFINITION_TYPE}>"
CAUSES = "array<struct<entity:string,field:string>>"
COLUMNS = ["doc", "section", "k1", "k2", "ord", "kind", "before", "after", "causes"]


def _side(text: Column | None = None, value: Column | None = None, definition: Column | None = None) -> Column:
    null = lambda x, t: (F.lit(None) if x is None else x).cast(t)
    return F.struct(null(text, "string").alias("text"), null(value, VALUE_TYPE).alias("value"), null(definition, DEFINITION_TYPE).alias("definition"))


def _rows(df: DataFrame, section: int, kind: Column | str, k1: Column | None = None, k2: Column | None = None, order: int = 0, before: Column | None = None, after: Column | None = None, causes: Column | None = None) -> DataFrame:
    text = lambda x: (F.lit(None).cast("string") if x is None else x)
    side = lambda x: (F.lit(None).cast(SIDE) if x is None else x)
    return df.select(
        "doc", F.lit(section).alias("section"), text(k1).alias("k1"), text(k2).alias("k2"), F.lit(order).alias("ord"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        side(before).alias("before"), side(after).alias("after"), (F.lit(None).cast(CAUSES) if causes is None else causes).alias("causes"),
    )


def _union_keys(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A full outer join: keys, b and a (structs of the values, null where a side has no row)."""
    b = before.select(*keys, F.struct(*values).alias("b"))
    a = after.select(*keys, F.struct(*values).alias("a"))
    return b.join(a, keys, "full_outer")


def document_changes(before: DocumentSet, after: DocumentSet) -> DataFrame:
    both = _union_keys(before.documents, after.documents, ["doc"], ["id", "title"]).where("b is not null and a is not null")
    ids = _rows(both.where("b.id <> a.id"), 0, "DocumentIdChanged", order=0, before=_side(F.col("b.id")), after=_side(F.col("a.id")))
    titles = _rows(both.where("b.title <> a.title"), 0, "DocumentTitleChanged", order=1, before=_side(F.col("b.title")), after=_side(F.col("a.title")))
    return ids.unionAll(titles)


def schema_changes(before: DocumentSet, after: DocumentSet) -> DataFrame:
    both = _union_keys(before.schemas, after.schemas, ["doc", "schema_key"], ["schema_id"])
    kind = F.when(F.col("b").isNull(), "SchemaAdded").otherwise("SchemaRemoved")
    whole = _rows(both.where("b is null or a is null"), 1, kind, F.col("schema_key"))
    kept = both.where("b is not null and a is not null").select("doc", "schema_key")
    fields = _union_keys(before.schema_fields, after.schema_fields, ["doc", "schema_key", "field"], ["type", "ref_schema", "required"]).join(kept, ["doc", "schema_key"], "left_semi")
    changed = fields.where("not (b <=> a)")
    kind = F.when(F.col("b").isNull(), "SchemaFieldAdded").when(F.col("a").isNull(), "SchemaFieldRemoved").otherwise("SchemaFieldChanged")
    rows = _rows(changed, 1, kind, F.col("schema_key"), F.col("field"), 1, F.when(F.col("b").isNotNull(), _side(definition=F.col("b"))), F.when(F.col("a").isNotNull(), _side(definition=F.col("a"))))
    return whole.unionAll(rows)


def entity_changes(before: DocumentSet, after: DocumentSet) -> tuple[DataFrame, DataFrame]:
    """Changes of entities, and those of fields of entities on both sides."""
    both = _union_keys(before.entities, after.entities, ["doc", "entity_key"], ["schema"])
    kind = F.when(F.col("b").isNull(), "EntityAdded").otherwise("EntityRemoved")
    whole = _rows(both.where("b is null or a is null"), 2, kind, F.col("entity_key"))
    kept = both.where("b is not null and a is not null")
    moved = _rows(kept.where("b.schema <> a.schema"), 2, "EntitySchemaChanged", F.col("entity_key"), before=_side(F.col("b.schema")), after=_side(F.col("a.schema")))
    cells = _union_keys(before.cells, after.cells, ["doc", "entity", "field"], list(VALUE)).join(kept.select("doc", F.col("entity_key").alias("entity")), ["doc", "entity"], "left_semi")
    changed = cells.where(F.col("b").isNull() | F.col("a").isNull() | ~comparable(F.col("b")).eqNullSafe(comparable(F.col("a"))))
    kind = F.when(F.col("b").isNull(), "FieldAdded").when(F.col("a").isNull(), "FieldRemoved").otherwise("FieldChanged")
    fields = _rows(changed, 2, kind, F.col("entity"), F.col("field"), 1, F.when(F.col("b").isNotNull(), _side(value=F.col("b"))), F.when(F.col("a").isNotNull(), _side(value=F.col("a"))))
    return whole.unionAll(moved), fields


def impacts(before: Calculation, after: Calculation, fields: DataFrame) -> DataFrame:
    """Formulas whose derived value differs, with the changed fields that cause it."""
    formulas = lambda c: c.docs.cells.where("kind = 'formula'").select("doc", "entity", "field")
    either = formulas(before).unionAll(formulas(after)).distinct()
    values = before.values.withColumnRenamed("value", "x").join(after.values.withColumnRenamed("value", "y"), ["doc", "entity", "field"])
    # text tells 0.0 from -0.0, and agrees for no two different finite numbers
    moved = values.where(F.col("x").cast("string") != F.col("y").cast("string")).join(either, ["doc", "entity", "field"], "left_semi")
    changed = fields.select("doc", F.col("k1").alias("entity"), F.col("k2").alias("field")).distinct()
    reach = lambda c: affected_by(c.edges, changed)
    itself = changed.select("doc", F.col("entity").alias("seed_entity"), F.col("field").alias("seed_field"), "entity", "field")
    why = reach(before).unionAll(reach(after)).unionAll(itself).distinct()
    grouped = why.groupBy("doc", "entity", "field").agg(F.array_sort(F.collect_list(F.struct(F.col("seed_entity").alias("entity"), F.col("seed_field").alias("field")))).alias("causes"))
    told = moved.join(grouped, ["doc", "entity", "field"], "left")
    number = lambda c: _side(value=F.struct(F.lit("number").alias("kind"), F.col(c).alias("num"), *(F.lit(None).cast(t).alias(n) for n, t in (("txt", "string"), ("flag", "boolean"), ("ref", "string"), ("expr", "array<struct<op:string,num:double,e:string,f:string>>")))))
    return _rows(told, 3, "FormulaImpact", F.col("entity"), F.col("field"), 0, number("x"), number("y"), F.coalesce("causes", F.array().cast(CAUSES)))


def semantic_diff(before: DocumentSet, after: DocumentSet, before_calc: Calculation | None = None, after_calc: Calculation | None = None) -> DataFrame:
    """All changes of all documents. Calculations may be given where they are at hand; a failing one raises ValueError, before's first."""
    calcs = []
    for said, docs, calc in (("original", before, before_calc), ("changed", after, after_calc)):
        try:
            if calc is None:
                calc = calculate(docs)
                calc.check()
        except CalculationError as e:
            raise ValueError(f"could not calculate the {said} document: {e}") from e
        calcs.append(calc)
    entities, fields = entity_changes(before, after)
    return reduce(DataFrame.unionAll, [document_changes(before, after), schema_changes(before, after), entities, fields, impacts(*calcs, fields)])


def diff_each(before: DocumentSet, after: DocumentSet) -> tuple[DataFrame, DataFrame]:
    """(changes, failures): semantic_diff of every pair that can be calculated, and of the others doc, side, path, code,
    message of the first error, before's first. One bad document stops no other."""
    errors = [error_text(calculate(docs).first_errors()).withColumn("side", F.lit(said)) for said, docs in (("original", before), ("changed", after))]
    first = settle(errors[0])
    failures = first.unionAll(settle(errors[1].join(first.select("doc"), "doc", "left_anti").select(*first.columns)))
    bad = failures.select("doc").distinct()
    return semantic_diff(before.without(bad), after.without(bad)), failures.select("doc", "side", "path", "code", "message")


def in_order(changes: DataFrame) -> DataFrame:
    """Documents; then schemas and their fields; then entities and theirs; then impacts."""
    return changes.orderBy("doc", "section", "k1", "ord", "k2")


# --- text -----------------------------------------------------------------------------------------


def definition_text(d) -> str:
    kind = f"reference({d['ref_schema']})" if d["type"] == "reference" else d["type"]
    return f"{kind} ({'required' if d['required'] else 'optional'})"


def value_text(v) -> str:
    from ..functions.formula import postfix_text

    kind = v["kind"]
    if kind == "number":
        return plain(v["num"])
    if kind == "text":
        return f'"{v["txt"]}"'
    if kind == "boolean":
        return "true" if v["flag"] else "false"
    return f"reference({v['ref']})" if kind == "reference" else postfix_text(v["expr"])


def change_text(kind: str, k2: str | None, before, after) -> str:
    """The line of one change."""
    if kind == "DocumentIdChanged":
        return f"id: {before['text']} -> {after['text']}"
    if kind == "DocumentTitleChanged":
        return f"title: {debug_string(before['text'])} -> {debug_string(after['text'])}"
    if kind == "EntitySchemaChanged":
        return f"schema: {before['text']} -> {after['text']}"
    if kind in ("SchemaAdded", "SchemaRemoved", "EntityAdded", "EntityRemoved"):
        return {"S": "schema", "E": "entity"}[kind[0]] + (" added" if kind.endswith("Added") else " removed")
    show = (lambda s: definition_text(s["definition"])) if kind.startswith("Schema") else (lambda s: value_text(s["value"]))
    if kind == "FormulaImpact":
        return f"affected {k2}: {show(before)} -> {show(after)}"
    if kind.endswith("Changed"):
        return f"{k2}: {show(before)} -> {show(after)}"
    return f"{k2} added: {show(after)}" if kind.endswith("Added") else f"{k2} removed: {show(before)}"


def with_lines(changes: DataFrame) -> DataFrame:
    """changes with `line`, the text of each."""
    ship(changes.sparkSession)

    @F.pandas_udf("string")
    def line(payload: pd.DataFrame) -> pd.Series:
        return pd.Series([change_text(k, f, b, a) for k, f, b, a in zip(payload["kind"], payload["k2"], payload["before"], payload["after"], strict=True)], dtype=object)

    return changes.withColumn("line", line(F.struct("kind", "k2", "before", "after")))


def humanised(x: Column) -> Column:
    """Words of an identifier between underscores, each with a capital."""
    words = F.filter(F.split(x, "_"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def headings(docs: DocumentSet) -> DataFrame:
    """doc, k1 (entity), heading: the schema's name in words, and the entity's name or id."""
    names = docs.cells.where("field = 'name' and kind = 'text'").select("doc", F.col("entity").alias("entity_key"), "txt")
    return docs.entities.join(names, ["doc", "entity_key"], "left").select("doc", F.col("entity_key").alias("k1"), F.concat_ws(" ", humanised(F.col("schema")), F.coalesce("txt", "entity_id")).alias("heading"))


def render(changes: DataFrame, before: DocumentSet, after: DocumentSet) -> DataFrame:
    """doc, text: the report of each document of `before` or `after`."""
    b, a = headings(before).withColumnRenamed("heading", "hb"), headings(after).withColumnRenamed("heading", "ha")
    heads = b.join(a, ["doc", "k1"], "full_outer").select("doc", "k1", F.coalesce("ha", "hb").alias("heading"))
    group = F.least("section", F.lit(2))
    lines = with_lines(changes).withColumn("g", group).join(heads, ["doc", "k1"], "left")
    sections = lines.groupBy("doc", "g", "k1").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", F.coalesce("k2", F.lit("")).alias("k2"), "line"))), lambda x: x.line), "\n").alias("body"), F.first("heading").alias("heading")
    )
    title = F.when(F.col("g") == 0, "Document").when(F.col("g") == 1, F.concat(F.lit("Schema "), "k1")).otherwise(F.col("heading"))
    text = sections.select("doc", F.struct("g", F.coalesce("k1", F.lit("")).alias("k1"), F.concat(title, F.lit("\n"), "body").alias("t")).alias("s")).groupBy("doc").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x.t), "\n\n"), F.lit("\n")).alias("text"))
    every = before.documents.select("doc").unionAll(after.documents.select("doc")).distinct()
    return every.join(text, "doc", "left").select("doc", F.coalesce("text", F.lit("No semantic changes.\n")).alias("text"))
