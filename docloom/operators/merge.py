"""Three-way merge of two versions of each document against their base.

Each part (identifier, title, field definition, cell) is chosen on its own: if both sides agree, that; if
one side still is as the base, the other; otherwise the part is in conflict. Schemas and entities that
all three sides have are merged part by part; others are one part as a whole, so that a removal
against an edit, or two different additions under one key, is one conflict. Formulas are atomic.

Every part takes one full outer join of the three sides by its key. Conflicts are rows
(doc, path, kind, base, ours, theirs); documents without any have a merged version.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import VALUE, DocumentSet, comparable
from ..session import settle
from .calc import CalculationError, calculate
from .diff import DEFINITION_TYPE, VALUE_TYPE
from .validate import faults, findings_of

SIDES = ("base", "ours", "theirs")
PART = (
    f"struct<text:string,value:{VALUE_TYPE},definition:{DEFINITION_TYPE},id:string,schema:string,"
    f"fields:array<struct<field:string,definition:{DEFINITION_TYPE}>>,cells:array<struct<field:string,value:{VALUE_TYPE}>>>"
)
_MEMBERS = ("text", "value", "definition", "id", "schema", "fields", "cells")
_TYPES = ("string", VALUE_TYPE, DEFINITION_TYPE, "string", "string", f"array<struct<field:string,definition:{DEFINITION_TYPE}>>", f"array<struct<field:string,value:{VALUE_TYPE}>>")


class MergeError(ValueError):
    pass


def part(**members: Column) -> Column:
    """A side of a conflict; members that are not given are null."""
    return F.struct(*(members.get(n, F.lit(None)).cast(t).alias(n) for n, t in zip(_MEMBERS, _TYPES, strict=True))).cast(PART)


def same(kind: str, a: Column, b: Column) -> Column:
    """Equality of two parts (absence equals absence); numbers by value."""
    if kind == "FieldValue":
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(comparable(a.value).eqNullSafe(comparable(b.value)))
    if kind == "Entity":
        flat = lambda x: F.struct(x.id, x.schema, F.transform(x.cells, lambda c: F.struct(c.field, comparable(c.value))))
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(flat(a).eqNullSafe(flat(b)))
    return a.eqNullSafe(b)


def three_way(sides: list[DataFrame], keys: list[str], kind: str) -> DataFrame:
    """keys, base, ours, theirs (parts, null where absent) and pick: ours, theirs or conflict. sides have keys and `part`."""
    named = [s.select(*keys, F.col("part").alias(n)) for s, n in zip(sides, SIDES, strict=True)]
    joined = named[0].join(named[1], keys, "full_outer").join(named[2], keys, "full_outer")
    b, o, t = (F.col(n) for n in SIDES)
    pick = F.when(same(kind, o, t), "ours").when(same(kind, o, b), "theirs").when(same(kind, t, b), "ours").otherwise("conflict")
    return joined.withColumn("pick", pick)


def chosen(parts: DataFrame) -> DataFrame:
    """keys and `part` of what was picked and is present."""
    out = parts.where("pick <> 'conflict'").withColumn("part", F.when(F.col("pick") == "ours", F.col("ours")).otherwise(F.col("theirs")))
    return out.where("part is not null").drop(*SIDES, "pick")


def conflicts_of(parts: DataFrame, path: Column, kind: str) -> DataFrame:
    return parts.where("pick = 'conflict'").select("doc", path.alias("path"), F.lit(kind).alias("kind"), *SIDES)


@dataclass(frozen=True)
class Merge:
    """conflicts of all documents; merged versions of those without."""

    conflicts: DataFrame
    merged: DocumentSet


def _with_whole(docs: DocumentSet) -> tuple[DataFrame, DataFrame]:
    """Schemas and entities as whole parts: doc, key, part."""
    definition = F.struct("type", "ref_schema", "required")
    fields = docs.schema_fields.groupBy("doc", F.col("schema_key").alias("key")).agg(F.array_sort(F.collect_list(F.struct("field", definition.alias("definition")))).alias("fields"))
    schemas = docs.schemas.withColumnRenamed("schema_key", "key").join(fields, ["doc", "key"], "left")
    schemas = schemas.select("doc", "key", part(id=F.col("schema_id"), fields=F.coalesce("fields", F.array().cast(_TYPES[5]))).alias("part"))
    cell = F.struct("field", F.struct(*VALUE).alias("value"))
    cells = docs.cells.groupBy("doc", F.col("entity").alias("key")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    entities = docs.entities.withColumnRenamed("entity_key", "key").join(cells, ["doc", "key"], "left")
    entities = entities.select("doc", "key", part(id=F.col("entity_id"), schema=F.col("schema"), cells=F.coalesce("cells", F.array().cast(_TYPES[6]))).alias("part"))
    return schemas, entities


def merge_parts(base: DocumentSet, ours: DocumentSet, theirs: DocumentSet) -> Merge:
    """The merge without the gates on inputs and result."""
    sets = [base, ours, theirs]
    found: list[DataFrame] = []

    def heads(column: str, kind: str) -> DataFrame:
        parts = three_way([d.documents.select("doc", part(text=F.col(column)).alias("part")) for d in sets], ["doc"], kind)
        found.append(conflicts_of(parts, F.lit(column), kind))
        return chosen(parts).select("doc", F.col("part.text").alias(column))

    documents = heads("id", "DocumentId").join(heads("title", "DocumentTitle"), "doc")
    wholes = [_with_whole(d) for d in sets]
    everywhere = F.col("base").isNotNull() & F.col("ours").isNotNull() & F.col("theirs").isNotNull()

    def keyed(at: int, name: str, kind: str, members: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
        parts = settle(three_way([w[at] for w in wholes], ["doc", "key"], kind))
        single = parts.where(~everywhere)
        found.append(conflicts_of(single, F.concat(F.lit(f"{name}."), "key"), kind))
        common = parts.where(everywhere)
        own = {}
        for column, member, member_kind in members:
            sides = [common.select("doc", "key", part(text=F.col(f"{s}.{column}")).alias("part")) for s in SIDES]
            p = three_way(sides, ["doc", "key"], member_kind)
            found.append(conflicts_of(p, F.concat(F.lit(f"{name}."), "key", F.lit(f".{member}")), member_kind))
            own[column] = chosen(p).select("doc", "key", F.col("part.text").alias(column))
        return chosen(single), common.select("doc", "key"), own

    whole_schemas, common_schemas, own = keyed(0, "schemas", "Schema", [("id", "id", "SchemaId")])
    definition = F.struct("type", "ref_schema", "required")
    sides = [d.schema_fields.join(common_schemas.withColumnRenamed("key", "schema_key"), ["doc", "schema_key"], "left_semi").select("doc", "schema_key", "field", part(definition=definition).alias("part")) for d in sets]
    fields = three_way(sides, ["doc", "schema_key", "field"], "FieldDefinition")
    found.append(conflicts_of(fields, F.concat(F.lit("schemas."), "schema_key", F.lit(".fields."), "field"), "FieldDefinition"))
    schemas = whole_schemas.select("doc", F.col("key").alias("schema_key"), F.col("part.id").alias("schema_id")).unionByName(own["id"].select("doc", F.col("key").alias("schema_key"), F.col("id").alias("schema_id")))
    schema_fields = chosen(fields).select("doc", "schema_key", "field", "part.definition.*").unionByName(
        whole_schemas.select("doc", F.col("key").alias("schema_key"), F.explode("part.fields").alias("x")).select("doc", "schema_key", "x.field", "x.definition.*")
    )

    whole_entities, common_entities, own = keyed(1, "entities", "Entity", [("id", "id", "EntityId"), ("schema", "schema", "SchemaId")])
    sides = [d.cells.join(common_entities.withColumnRenamed("key", "entity"), ["doc", "entity"], "left_semi").select("doc", "entity", "field", part(value=F.struct(*VALUE)).alias("part")) for d in sets]
    cells = three_way(sides, ["doc", "entity", "field"], "FieldValue")
    found.append(conflicts_of(cells, F.concat(F.lit("entities."), "entity", F.lit(".fields."), "field"), "FieldValue"))
    entities = whole_entities.select("doc", F.col("key").alias("entity_key"), F.col("part.id").alias("entity_id"), F.col("part.schema").alias("schema")).unionByName(
        own["id"].join(own["schema"], ["doc", "key"]).select("doc", F.col("key").alias("entity_key"), F.col("id").alias("entity_id"), "schema")
    )
    merged_cells = chosen(cells).select("doc", "entity", "field", "part.value.*").unionByName(
        whole_entities.select("doc", F.col("key").alias("entity"), F.explode("part.cells").alias("x")).select("doc", "entity", "x.field", "x.value.*")
    )
    conflicts = reduce(DataFrame.unionAll, found)
    merged = DocumentSet(documents, schemas, schema_fields, entities, merged_cells)
    return Merge(conflicts, merged)


def merge(base: DocumentSet, ours: DocumentSet, theirs: DocumentSet) -> Merge:
    """merge_parts, with inputs and merged documents validated and calculated; the first fault is raised as MergeError."""
    for side, docs in zip(SIDES, (base, ours, theirs), strict=True):
        if found := findings_of(docs):
            raise MergeError(f"invalid {side.capitalize()} input: {diagnostics_text(found)}")
        try:
            calculate(docs).check()
        except CalculationError as e:
            raise MergeError(f"could not calculate {side.capitalize()} input: {e}") from e
    out = merge_parts(base, ours, theirs)
    conflicts = settle(out.conflicts)
    clean = DocumentSet(*(settle(t.join(conflicts.select("doc").distinct(), "doc", "left_anti")) for t in out.merged.tables()))
    if found := findings_of(clean):
        raise MergeError(f"invalid merged document: {diagnostics_text(found)}")
    try:
        calculate(clean).check()
    except CalculationError as e:
        raise MergeError(f"could not calculate merged document: {e}") from e
    return Merge(conflicts.orderBy("doc", "path"), clean)


def merge_each(base: DocumentSet, ours: DocumentSet, theirs: DocumentSet) -> tuple[Merge, DataFrame]:
    """The merge of all documents whose inputs pass the gates, and failures as rows: doc, side, path, code, message. side is
    the first input that fails, or merged; a document has a row per finding, or one for its calculation. One bad
    document stops no other."""
    sets, failures = [base, ours, theirs], []
    for i, side in enumerate(SIDES):
        found = faults(sets[i]).select("doc", F.lit(side).alias("side"), "path", "code", "message")
        failures.append(found)
        if not found.isEmpty():
            bad = settle(found.select("doc").distinct())
            sets = [d.without(bad) for d in sets]
    out = merge_parts(*sets)
    conflicts = settle(out.conflicts)
    clean = DocumentSet(*map(settle, out.merged.without(conflicts.select("doc").distinct()).tables()))
    found = faults(clean).select("doc", F.lit("merged").alias("side"), "path", "code", "message")
    merged = clean if found.isEmpty() else clean.without(settle(found.select("doc").distinct()))
    return Merge(conflicts, merged), reduce(DataFrame.unionAll, [*failures, found])


def diagnostics_text(found: list[tuple[str, str, str]]) -> str:
    from ..functions.numbers import debug_string

    return "[" + ", ".join(f"Diagnostic {{ path: {debug_string(p)}, code: {c}, message: {debug_string(m)} }}" for p, c, m in found) + "]"


# --- conflicts as text ------------------------------------------------------------------------------


def conflict_side_text(kind: str, side) -> str:
    """One side of a conflict in debug notation."""
    from ..functions.formula import from_postfix
    from ..functions.numbers import debug_string as q
    from ..functions.numbers import debug_text

    def expression(x) -> str:
        if x[0] == "number":
            return f"Number({debug_text(x[1])})"
        if x[0] == "reference":
            return f"Reference(FieldRef {{ entity: EntityId({q(x[1])}), field: FieldId({q(x[2])}) }})"
        return f"{x[0].capitalize()} {{ left: {expression(x[1])}, right: {expression(x[2])} }}"

    def value(v) -> str:
        if v["kind"] == "number":
            return f"Number({debug_text(v['num'])})"
        if v["kind"] == "text":
            return f"Text({q(v['txt'])})"
        if v["kind"] == "boolean":
            return f"Boolean({'true' if v['flag'] else 'false'})"
        return f"Reference(EntityId({q(v['ref'])}))" if v["kind"] == "reference" else f"Formula({expression(from_postfix(v['expr']))})"

    def definition(d) -> str:
        kind = f"Reference {{ schema: SchemaId({q(d['ref_schema'])}) }}" if d["type"] == "reference" else d["type"].capitalize()
        return f"FieldDefinition {{ field_type: {kind}, required: {'true' if d['required'] else 'false'} }}"

    if side is None:
        return "None"
    fields = lambda rows, show, name: "{" + ", ".join(f"FieldId({q(r['field'])}): {show(r[name])}" for r in rows) + "}"
    if kind in ("DocumentId", "SchemaId", "EntityId"):
        body = f"{kind}({kind}({q(side['text'])}))"
    elif kind == "DocumentTitle":
        body = f"DocumentTitle({q(side['text'])})"
    elif kind == "FieldDefinition":
        body = f"FieldDefinition({definition(side['definition'])})"
    elif kind == "FieldValue":
        body = f"FieldValue({value(side['value'])})"
    elif kind == "Schema":
        body = f"Schema(Schema {{ id: SchemaId({q(side['id'])}), fields: {fields(side['fields'], definition, 'definition')} }})"
    else:
        body = f"Entity(Entity {{ id: EntityId({q(side['id'])}), schema: SchemaId({q(side['schema'])}), fields: {fields(side['cells'], value, 'value')} }})"
    return f"Some({body})"
