"""More queries of the catalog, by operator: codecs, spellings, failures, changes of every kind, merges with gates, views.

Most run on one small document for each part, so that a million documents are a million rows. Their SQL writes results
out by hand: texts from templates, messages as constants.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.formula import FormulaError, parse, to_text
from ..model import DocumentSet
from ..operators import describe as A
from ..operators import diff as D
from ..operators import edits as W
from ..operators import merge as M
from ..operators import validate as V
from ..operators.calc import calculate
from ..session import settle, ship
from ..sources.canonical import canonical_texts, export_texts, values_texts
from ..sources.relational import TableSpec, from_tables
from ..sources.strict import decode_files, tables_of
from .catalog import PART_SQL, key, parts, query, shop, table

FIELDS = (("brand", "text", True), ("name", "text", True), ("price", "number", True), ("size", "number", False), ("worth", "number", True))


def values(rows: list[tuple], columns: str) -> str:
    """A VALUES list of texts, numbers, truth values and nulls."""
    spell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(spell, r)) + ')' for r in rows)}) AS t({columns})"


def each_part(s, d, version: str = "base") -> DocumentSet:
    """A document for each part."""
    docs = parts(s, d, version)
    entities = docs.entities.withColumn("doc", F.col("entity_key"))
    keys = entities.select("doc")
    fields = F.array(*(F.struct(F.lit("parts").alias("schema_key"), F.lit(f).alias("field"), F.lit(t).alias("type"), F.lit(None).cast("string").alias("ref_schema"), F.lit(r).alias("required")) for f, t, r in FIELDS))
    return DocumentSet(
        keys.select("doc", F.col("doc").alias("id"), F.lit("Part").alias("title")), keys.select("doc", F.lit("parts").alias("schema_key"), F.lit("parts").alias("schema_id")),
        keys.select("doc", F.explode(fields).alias("x")).select("doc", "x.*"), entities, docs.cells.withColumn("doc", F.col("entity")),
    )


# --- codecs -------------------------------------------------------------------------------------------

HEAD = """{
  "format_version": 1,
  "id": "part-@K",
  "title": "Part",
  "schemas": {
    "parts": {
      "id": "parts",
      "fields": {
@FIELDS
      }
    }
  },
  "entities": {
    "part-@K": {
      "id": "part-@K",
      "schema": "parts",
      "fields": {
        "brand": {
          "kind": "text",
          "value": "@BRAND"
        },
        "name": {
          "kind": "text",
          "value": "@NAME"
        },
        "price": {
          "kind": "number",
          "value": @PRICE
        },
        "size": {
          "kind": "number",
          "value": @SIZE
        },
        "worth": {
          "kind": "formula",
          "value": {
            "op": "add",
            "args": {
              "left": {
                "op": "multiply",
                "args": {
                  "left": {
                    "op": "reference",
                    "args": {
                      "entity": "part-@K",
                      "field": "price"
                    }
                  },
                  "right": {
                    "op": "number",
                    "args": 2.0
                  }
                }
              },
              "right": {
                "op": "number",
                "args": 1.0
              }
            }
          }
        }
      }
    }
  }
}
"""
FIELD = """        "@F": {
          "field_type": {
            "type": "@T"
          },
          "required": @R
        }"""
DOCUMENT = HEAD.replace("@FIELDS", ",\n".join(FIELD.replace("@F", f).replace("@T", t).replace("@R", "true" if r else "false") for f, t, r in FIELDS))
EXPORT = """{
  "format_version": 1,
  "document_id": "part-@K",
  "title": "Part",
  "entities": {
    "part-@K": {
      "schema": "parts",
      "fields": {
        "brand": "@BRAND",
        "name": "@NAME",
        "price": @PRICE,
        "size": @SIZE,
        "worth": @WORTH
      }
    }
  }
}
"""
VALUES_TEXT = """{
  "part-@K.price": @PRICE,
  "part-@K.size": @SIZE,
  "part-@K.worth": @WORTH
}
"""


def filled(template: str) -> str:
    """SQL: a template's text of every part."""
    out = "'" + template.replace("\n", "' || chr(10) || '") + "'"
    for name, x in (("K", "p_partkey"), ("BRAND", "p_brand"), ("NAME", "p_name"), ("PRICE", "p_retailprice"), ("SIZE", "CAST(p_size AS DOUBLE)"), ("WORTH", "p_retailprice * 2 + 1")):
        out = f"replace({out}, '@{name}', CAST({x} AS VARCHAR))"
    return f"SELECT 'part-' || p_partkey AS doc, {out} AS text FROM part"


@query("canonical_document_texts", filled(DOCUMENT))
def canonical_document_texts(s, d):
    return canonical_texts(each_part(s, d))


@query("export_document_texts", filled(EXPORT))
def export_document_texts(s, d):
    return export_texts(calculate(each_part(s, d)))


@query("calculated_texts", filled(VALUES_TEXT))
def calculated_texts(s, d):
    return values_texts(calculate(each_part(s, d)))


BAD = "invalid version-1 .ro representation: "
#: What to replace in a good document, by what, and the error.
DAMAGE = [
    ("{", "{", None, None), ('"required": true', '"required": 1', "InvalidRepresentation", BAD + "required must be a boolean"), ('"type": "text"', '"type": "texts"', "InvalidRepresentation", BAD + "unknown v1 field type 'texts'"),
    ('"kind": "number"', '"kind": "amount"', "InvalidRepresentation", BAD + "unknown v1 value kind 'amount'"), ('"op": "multiply"', '"op": "power"', "InvalidRepresentation", BAD + "unknown v1 expression op 'power'"),
    ('"schema": "parts"', '"schema": "ghosts"', "InvalidRepresentation", BAD + "entity schema 'ghosts' does not exist"), ('"id": "parts"', '"id": "other"', "InvalidRepresentation", BAD + "schema map key 'parts' does not match nested id 'other'"),
    ('"id": "parts"', '"id": "Parts"', "InvalidRepresentation", BAD + "schema id 'Parts' must use the legacy identifier grammar"), ('"field": "price"', '"field": "Price"', "InvalidRepresentation", BAD + "formula reference field 'Price' must use the legacy identifier grammar"),
    ('"title": "Part",', "", "InvalidRepresentation", BAD + "missing field `title` in document"), ('"title"', '"subtitle"', "InvalidRepresentation", BAD + "unknown field `subtitle` in document"),
    ('"format_version": 1', '"format_version": 2', "UnsupportedVersion", "unsupported .ro format version 2; this build supports 1"), ('"format_version": 1,', "", "VersionMissing", "missing required .ro format version"),
    ('"format_version": 1', '"format_version": "1"', "VersionMalformed", "malformed .ro format version"), ('"format_version": 1', '"format_version": 4294967296', "VersionMalformed", "malformed .ro format version"),
    ('"title"', '"\\u0069d"', "DuplicateMember", "duplicate JSON member 'id'"), ('"text"', '{"type": "text"}', "InvalidRepresentation", BAD + "type must be a string"),
]


@query("decode_documents", f"""
SELECT 'part-' || p_partkey AS doc, error, message, CASE WHEN error IS NULL THEN CAST(5 AS BIGINT) END AS cells, CASE WHEN error IS NULL THEN p_retailprice END AS price
FROM part JOIN {values([(i, e, m) for i, (_, _, e, m) in enumerate(DAMAGE)], 'i, error, message')} ON i = p_partkey % {len(DAMAGE)}""")
def decode_documents(s, d):
    """A file of each part, most of them damaged, each in its own way."""
    p = table(s, d, "part")
    text = F.lit(DOCUMENT)
    for name, x in (("K", "p_partkey"), ("BRAND", "p_brand"), ("NAME", "p_name"), ("PRICE", "p_retailprice"), ("SIZE", "p_size")):
        text = F.replace(text, F.lit(f"@{name}"), F.col(x).cast("string"))
    out = text
    for i, (old, new, _, _) in enumerate(DAMAGE):
        out = F.when(F.col("p_partkey") % len(DAMAGE) == i, F.replace(text, F.lit(old), F.lit(new))).otherwise(out)
    decoded = settle(decode_files(p.select(key("part", "p_partkey").alias("path"), out.cast("binary").alias("content"))))
    cells = tables_of(decoded).cells.groupBy("doc").agg(F.count(F.lit(1)).alias("cells"), F.max(F.when(F.col("field") == "price", F.col("num"))).alias("price"))
    return decoded.select("doc", "error", "message").join(cells, "doc", "left").select("doc", "error", "message", "cells", "price")


# --- spellings and formula texts ------------------------------------------------------------------------

_PLAIN = "regexp_replace(CAST({0} AS VARCHAR), '\\.0$', '')"
#: SQL of k * 10^21: its digits without zeros at the end, with a point after the first.
_MANTISSA = "CASE WHEN length(rtrim(CAST(k AS VARCHAR), '0')) = 1 THEN CAST(k AS VARCHAR)[1] ELSE CAST(k AS VARCHAR)[1] || '.' || rtrim(CAST(k AS VARCHAR), '0')[2:] END"
_LARGE = f"{_MANTISSA} || 'e' || (20 + length(CAST(k AS VARCHAR)))"


@query("number_spellings", f"""
SELECT k, 'small' AS x, {_PLAIN.format('v')} AS plain, {_PLAIN.format('v')} AS formula, {_PLAIN.format('v')} AS overview, CAST(v AS VARCHAR) AS json FROM (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) / 8 AS v FROM part)
UNION ALL SELECT k, 'price', {_PLAIN.format('v')}, {_PLAIN.format('v')}, {_PLAIN.format('v')}, CAST(v AS VARCHAR) FROM (SELECT p_partkey AS k, -p_retailprice AS v FROM part)
UNION ALL SELECT k, 'large', CAST(k AS VARCHAR) || '000000000000000000000', {_LARGE}, CAST(k AS VARCHAR) || '000000000000000000000', {_LARGE} FROM (SELECT p_partkey AS k FROM part WHERE p_partkey > 0)""")
def number_spellings(s, d):
    ship(s)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"k": f["k"], "x": f["x"], **{n: [spell(v) for v in f["v"]] for n, spell in (("plain", N.plain), ("formula", N.formula_text), ("overview", N.overview_text), ("json", N.json_text))}})

    k = F.col("p_partkey")
    large = F.concat(k.cast("string"), F.lit("e21")).cast("double")
    rows = table(s, d, "part").select(k.alias("k"), F.explode(F.create_map(F.lit("small"), F.col("p_size") / 8.0, F.lit("price"), -F.col("p_retailprice"), F.lit("large"), F.when(k > 0, large))).alias("x", "v"))
    return rows.where("v is not null").mapInPandas(run, "k long, x string, plain string, formula string, overview string, json string")


#: Formula texts with a key in them, and their canonical text or error.
TEXTS = [
    ("-[p@.a]+ .5e1*-2", "((0 - [p@.a]) + (5 * -2))", None, None), ("+ +\t7.250", "7.25", None, None), ("--[p@.a]", "(0 - (0 - [p@.a]))", None, None), ("max(-1e3,\r\n [p@.a] )/1e-9", "(max(-1e3, [p@.a]) / 1e-9)", None, None),
    ("((@))", "@", None, None), ("1 - 2 - (3 - 4) * 5 / 6", "((1 - 2) - (((3 - 4) * 5) / 6))", None, None),
    ("7 *", None, 3, "expected expression"), ("min(3; 4)", None, 5, "expected ',' between function arguments"), ("[p.Ab]", None, 3, "invalid reference field identifier"), ("abs(2)", None, 0, "unknown function 'abs'; expected min or max"),
    ("4 5 6", None, 2, "unexpected trailing content"), ("3e+", None, 3, "expected exponent digits"), ("9e999", None, 0, "numeric literal must be finite"), ("(2 + 3", None, 6, "expected ')' after expression"),
    ("7" * 4200, None, 4096, "expression exceeds 4096-byte limit"), ("(" * 70 + "2", None, 64, "expression exceeds 64-nesting limit"), ("*".join(["2"] * 140), None, 256, "expression exceeds 256-node limit"), ("-".join(["3"] * 70), None, 139, "expression exceeds 64-depth limit"),
]


@query("formula_texts", f"""
SELECT p_partkey, replace(canonical, '@', CAST(p_partkey AS VARCHAR)) AS canonical, CAST(place AS BIGINT) AS error_at, message
FROM part JOIN {values([(i, *t[1:]) for i, t in enumerate(TEXTS)], 'i, canonical, place, message')} ON i = p_partkey % {len(TEXTS)}""")
def formula_texts(s, d):
    ship(s)

    def run(frames):
        for frame in frames:
            out = []
            for k in frame["p_partkey"]:
                try:
                    out.append((k, to_text(parse(TEXTS[k % len(TEXTS)][0].replace("@", str(k)))), None, None))
                except FormulaError as e:
                    out.append((k, None, e.position, e.message))
            yield pd.DataFrame(out, columns=["p_partkey", "canonical", "error_at", "message"]).astype({"error_at": "Int64"})

    return table(s, d, "part").select("p_partkey").mapInPandas(run, "p_partkey long, canonical string, error_at long, message string")


# --- failures --------------------------------------------------------------------------------------------

#: Formulas of a part's fields a and b, by its key: a cycle, a text, no finite result, a division by zero, a gap, none.
FAILING = [
    {"a": "[self.b] + 1", "b": "[self.a] * 2"}, {"a": "1 + [self.name]", "b": "[self.a] * 2"}, {"a": "[self.price] * 2", "b": "[self.price] * 1e308 * 10"},
    {"a": "[self.price] - 1", "b": "[self.a] / ([self.price] - [self.price])"}, {"a": "[self.none] + 1", "b": "2"}, {"a": "[self.price] / 4", "b": "min([self.a], 0)"},
]
#: code, field that it is about, and the formulas' path.
FAILED = [("Cycle", "a", "ab"), ("NonNumericReference", "name", None), ("NonFiniteResult", "b", None), ("DivisionByZero", "b", None), ("MissingReference", "none", None)]


def failing_parts(s, d) -> DocumentSet:
    p = table(s, d, "part")
    specs = [
        TableSpec(f"s{i}", p.where(F.col("p_partkey") % len(FAILING) == i), key("part", "p_partkey"), numbers={"price": F.col("p_retailprice")}, texts={"name": F.col("p_name")}, formulas=f)
        for i, f in enumerate(FAILING)
    ]
    docs = from_tables(s, specs, "all")
    return docs.with_(cells=docs.cells.withColumn("doc", F.col("entity")), entities=docs.entities.withColumn("doc", F.col("entity_key")))


@query("calc_document_errors", f"""
SELECT 'part-' || p_partkey AS doc, code, 'part-' || p_partkey AS at_entity, field AS at_field, CASE WHEN code = 'Cycle' THEN 'part-' || p_partkey || '.a,part-' || p_partkey || '.b,part-' || p_partkey || '.a' END AS path
FROM part JOIN {values([(i, c, f) for i, (c, f, _) in enumerate(FAILED)], 'i, code, field')} ON i = p_partkey % {len(FAILING)}""")
def calc_document_errors(s, d):
    return calculate(failing_parts(s, d)).first_errors().withColumn("path", F.array_join("path", ","))


@query("calc_document_values", f"""
SELECT 'part-' || p_partkey AS doc, 'a' AS field, p_retailprice / 4 AS value FROM part WHERE p_partkey % {len(FAILING)} = 5
UNION ALL SELECT 'part-' || p_partkey, 'b', least(p_retailprice / 4, 0) FROM part WHERE p_partkey % {len(FAILING)} = 5
UNION ALL SELECT 'part-' || p_partkey, 'a', p_retailprice * 2 FROM part WHERE p_partkey % {len(FAILING)} = 2
UNION ALL SELECT 'part-' || p_partkey, 'a', p_retailprice - 1 FROM part WHERE p_partkey % {len(FAILING)} = 3
UNION ALL SELECT 'part-' || p_partkey, 'b', 2 FROM part WHERE p_partkey % {len(FAILING)} = 4""")
def calc_document_values(s, d):
    return calculate(failing_parts(s, d)).values.where("field <> 'price'").select("doc", "field", "value")


@query("validate_finite", """
SELECT 'part-' || p_partkey AS doc, 'entities.part-' || p_partkey || '.fields.' || CASE WHEN p_partkey % 2 = 0 THEN 'price' ELSE 'worth' END AS path, 'NonFiniteNumber' AS code, 'numeric values must be finite' AS message FROM part WHERE p_partkey % 7 = 0""")
def validate_finite(s, d):
    docs = each_part(s, d)
    k = F.substring_index("entity", "-", -1).cast("long")
    hit = (k % 7 == 0) & (F.col("field") == F.when(k % 2 == 0, "price").otherwise("worth"))
    nodes = F.transform("expr", lambda n: F.struct(n.op.alias("op"), F.when(n.num == 2, F.lit(float("inf"))).otherwise(n.num).alias("num"), n.e.alias("e"), n.f.alias("f")))
    return V.validate(docs.with_(cells=docs.cells.withColumns({"num": F.when(hit & (F.col("kind") == "number"), F.lit(float("nan"))).otherwise(F.col("num")), "expr": F.when(hit, nodes).otherwise(F.col("expr"))})))


@query("validate_formula_types", """
SELECT 'part-' || p_partkey AS doc, 'entities.part-' || p_partkey || '.fields.worth' AS path, 'FormulaReferenceTypeMismatch' AS code, 'formula reference ''part-' || p_partkey || '.brand'' does not target a numeric field' AS message FROM part""")
def validate_formula_types(s, d):
    docs = each_part(s, d)
    expr = F.transform("expr", lambda n: F.struct(n.op.alias("op"), n.num.alias("num"), n.e.alias("e"), F.when(n.f == "price", F.lit("brand")).otherwise(n.f).alias("f")))
    return V.validate(docs.with_(cells=docs.cells.withColumn("expr", expr)))


@query("validate_schemas", """
SELECT 'part-' || p_partkey AS doc, 'schemas.Things.id' AS path, 'InvalidIdentifier' AS code, 'schema id ''Things'' must be a lowercase identifier using only a-z, 0-9, ''_'' or ''-'', starting with a letter or digit' AS message FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT 'part-' || p_partkey, 'schemas.Things.fields.', 'EmptyIdentifier', 'field id must not be empty' FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT 'part-' || p_partkey, 'schemas.extra.id', 'KeyMismatch', 'schema map key ''extra'' does not match id ''other''' FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT 'part-' || p_partkey, 'id', 'EmptyIdentifier', 'document id must not be empty' FROM part WHERE p_partkey % 3 = 0""")
def validate_schemas(s, d):
    docs = each_part(s, d)
    k = F.substring_index("doc", "-", -1).cast("long")
    keys = docs.documents.select("doc")
    schemas = keys.where(k % 5 == 0).select("doc", F.lit("Things").alias("schema_key"), F.lit("Things").alias("schema_id")).unionAll(keys.where(k % 4 == 0).select("doc", F.lit("extra"), F.lit("other")))
    fields = keys.where(k % 5 == 0).select("doc", F.lit("Things").alias("schema_key"), F.lit("").alias("field"), F.lit("text").alias("type"), F.lit(None).cast("string").alias("ref_schema"), F.lit(False).alias("required"))
    docs = docs.with_(documents=docs.documents.withColumn("id", F.when(k % 3 == 0, "").otherwise(F.col("id"))), schemas=docs.schemas.unionByName(schemas), schema_fields=docs.schema_fields.unionByName(fields))
    return V.validate(docs)


# --- changes -----------------------------------------------------------------------------------------------


def changed_parts(s, d) -> tuple[DocumentSet, DocumentSet]:
    """Every part's document in two versions, that differ in each kind of change."""
    before, after = each_part(s, d), each_part(s, d, "theirs")
    after = after.with_(
        documents=after.documents.withColumns({"id": F.concat("id", F.lit("-b")), "title": F.lit('The "part"')}),
        entities=after.entities.unionByName(after.entities.withColumns({"entity_key": F.lit("new"), "entity_id": F.lit("new")})).withColumn("schema", F.when(F.col("entity_key") == "new", "parts").otherwise("things")),
        schemas=after.schemas.unionByName(after.schemas.withColumns({"schema_key": F.lit("things"), "schema_id": F.lit("things")})),
        schema_fields=after.schema_fields.where("field <> 'brand'").withColumn("required", F.col("field") != "price"),
        cells=after.cells.where("field <> 'brand'").unionByName(after.cells.where("field = 'name'").withColumns({"field": F.lit("note"), "kind": F.lit("boolean"), "txt": F.lit(None).cast("string"), "flag": F.lit(True)})),
    )
    gone = before.entities.withColumns({"entity_key": F.lit("old"), "entity_id": F.lit("old")})
    old = before.schemas.withColumns({"schema_key": F.lit("old"), "schema_id": F.lit("old")})
    return before.with_(entities=before.entities.unionByName(gone), schemas=before.schemas.unionByName(old)), after


_CHANGED = f"""
WITH b AS ({PART_SQL['base']}), a AS ({PART_SQL['theirs']}), j AS (SELECT k, 'part-' || k AS e, b.price AS bp, a.price AS ap, b.size AS bs, a.size AS az, b.brand FROM b JOIN a USING (k)),
c AS (SELECT e, 0 AS s, NULL AS k1, NULL AS k2, 0 AS o, 'DocumentIdChanged' AS kind, 'id: ' || e || ' -> ' || e || '-b' AS line FROM j
UNION ALL SELECT e, 0, NULL, NULL, 1, 'DocumentTitleChanged', 'title: "Part" -> "The \\"part\\""' FROM j
UNION ALL SELECT e, 1, 'old', NULL, 0, 'SchemaRemoved', 'schema removed' FROM j
UNION ALL SELECT e, 1, 'parts', 'brand', 1, 'SchemaFieldRemoved', 'brand removed: text (required)' FROM j
UNION ALL SELECT e, 1, 'parts', 'price', 1, 'SchemaFieldChanged', 'price: number (required) -> number (optional)' FROM j
UNION ALL SELECT e, 1, 'parts', 'size', 1, 'SchemaFieldChanged', 'size: number (optional) -> number (required)' FROM j
UNION ALL SELECT e, 1, 'things', NULL, 0, 'SchemaAdded', 'schema added' FROM j
UNION ALL SELECT e, 2, 'new', NULL, 0, 'EntityAdded', 'entity added' FROM j
UNION ALL SELECT e, 2, 'old', NULL, 0, 'EntityRemoved', 'entity removed' FROM j
UNION ALL SELECT e, 2, e, NULL, 0, 'EntitySchemaChanged', 'schema: parts -> things' FROM j
UNION ALL SELECT e, 2, e, 'brand', 1, 'FieldRemoved', 'brand removed: "' || brand || '"' FROM j
UNION ALL SELECT e, 2, e, 'note', 1, 'FieldAdded', 'note added: true' FROM j
UNION ALL SELECT e, 2, e, 'price', 1, 'FieldChanged', 'price: ' || {_PLAIN.format('bp')} || ' -> ' || {_PLAIN.format('ap')} FROM j WHERE bp <> ap
UNION ALL SELECT e, 2, e, 'size', 1, 'FieldRemoved', 'size removed: ' || {_PLAIN.format('bs')} FROM j WHERE bs IS NOT NULL AND az IS NULL
UNION ALL SELECT e, 3, e, 'worth', 0, 'FormulaImpact', 'affected worth: ' || {_PLAIN.format('bp * 2 + 1')} || ' -> ' || {_PLAIN.format('ap * 2 + 1')} FROM j WHERE bp <> ap)
"""


@query("diff_every_kind", _CHANGED + "SELECT e AS doc, row_number() OVER (PARTITION BY e ORDER BY s, k1 NULLS FIRST, o, k2 NULLS FIRST) AS place, kind, line FROM c")
def diff_every_kind(s, d):
    """The lines of all changes, in their order. The versions' own keys differ, so only documents of both are compared."""
    before, after = changed_parts(s, d)
    both = before.documents.select("doc").join(after.documents.select("doc"), "doc", "left_anti")
    changes = settle(D.with_lines(D.in_order(D.semantic_diff(before.without(both), after)).withColumn("at", F.monotonically_increasing_id())))
    return changes.select("doc", F.row_number().over(Win.partitionBy("doc").orderBy("at")).cast("long").alias("place"), "kind", "line")


@query("impact_reports", f"""
WITH b AS ({PART_SQL['base']}), a AS ({PART_SQL['ours']})
SELECT 'part-' || k AS doc, CASE WHEN b.price = a.price AND b.size IS NOT DISTINCT FROM a.size THEN 'No semantic changes.' || chr(10) ELSE 'Parts ' || b.name || chr(10)
  || CASE WHEN b.price <> a.price THEN 'price: ' || {_PLAIN.format('b.price')} || ' -> ' || {_PLAIN.format('a.price')} || chr(10) ELSE '' END
  || CASE WHEN b.size <> a.size THEN 'size: ' || {_PLAIN.format('b.size')} || ' -> ' || {_PLAIN.format('a.size')} || chr(10) ELSE '' END
  || CASE WHEN b.price <> a.price THEN 'affected worth: ' || {_PLAIN.format('(b.price * 2 + 1)')} || ' -> ' || {_PLAIN.format('(a.price * 2 + 1)')} || chr(10) ELSE '' END END AS text FROM b JOIN a USING (k)""")
def impact_reports(s, d):
    before, after = each_part(s, d), each_part(s, d, "ours")
    gone = before.documents.select("doc").join(after.documents.select("doc"), "doc", "left_anti")
    return A.explain_impact(before.without(gone), after)[1]


@query("diff_failures", f"""
SELECT 'part-' || p_partkey AS doc, 'original' AS side, 'part-' || p_partkey || '.' || field AS path, code, CASE code WHEN 'NonNumericReference' THEN 'formula reference ''part-' || p_partkey || '.name'' is not numeric'
  WHEN 'NonFiniteResult' THEN 'calculation for ''part-' || p_partkey || '.b'' produced a non-finite result' WHEN 'DivisionByZero' THEN 'formula ''part-' || p_partkey || '.b'' divided by zero' WHEN 'MissingReference' THEN 'formula reference ''part-' || p_partkey || '.none'' does not exist'
  ELSE 'formula dependency cycle: [FieldRef {{ entity: EntityId("part-' || p_partkey || '"), field: FieldId("a") }}, FieldRef {{ entity: EntityId("part-' || p_partkey || '"), field: FieldId("b") }}, FieldRef {{ entity: EntityId("part-' || p_partkey || '"), field: FieldId("a") }}]' END AS message
FROM part JOIN {values([(i, c, f) for i, (c, f, _) in enumerate(FAILED)], 'i, code, field')} ON i = p_partkey % {len(FAILING)}""")
def diff_failures(s, d):
    docs = failing_parts(s, d)
    return D.diff_each(docs, docs)[1]


# --- merges --------------------------------------------------------------------------------------------------


def _schema_versions(s, d) -> list[DocumentSet]:
    base = each_part(s, d)
    out = [base]
    for side, kind in (("ours", "text"), ("theirs", "boolean")):
        one = base.schemas.withColumns({"schema_key": F.lit("extra"), "schema_id": F.lit("extra")})
        field = lambda schema, name, t, r: base.schemas.select("doc", F.lit(schema).alias("schema_key"), F.lit(name).alias("field"), F.lit(t).alias("type"), F.lit(None).cast("string").alias("ref_schema"), F.lit(r).alias("required"))  # noqa: B023, E731
        fields = base.schema_fields.withColumn("required", (F.col("field") == "size") if side == "ours" else F.col("required"))
        fields = fields.withColumn("type", F.when((F.col("field") == "size") & (side == "theirs"), "text").otherwise(F.col("type")))
        out.append(base.with_(schemas=base.schemas.unionByName(one), schema_fields=reduce(DataFrame.unionByName, [fields, field("extra", "x", kind, True), field("parts", side, "text", False)])))
    return out


@query("merge_schemas", """
SELECT 'part-' || p_partkey AS doc, unnest(['schemas.extra', 'schemas.parts.fields.size']) AS path, unnest(['Schema', 'FieldDefinition']) AS kind, unnest(['None', 'Some(FieldDefinition(FieldDefinition { field_type: Number, required: false }))']) AS base,
  unnest(['Some(Schema(Schema { id: SchemaId("extra"), fields: {FieldId("x"): FieldDefinition { field_type: Text, required: true }} }))', 'Some(FieldDefinition(FieldDefinition { field_type: Number, required: true }))']) AS ours,
  unnest(['Some(Schema(Schema { id: SchemaId("extra"), fields: {FieldId("x"): FieldDefinition { field_type: Boolean, required: true }} }))', 'Some(FieldDefinition(FieldDefinition { field_type: Text, required: false }))']) AS theirs FROM part""")
def merge_schemas(s, d):
    """Two versions that add different schemas under one key, and turn one field's definition two ways."""
    ship(s)
    sides = "base ours theirs".split()

    @F.pandas_udf("base string, ours string, theirs string")
    def told(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({n: [M.conflict_side_text(k, v) for k, v in zip(x["kind"], x[n], strict=True)] for n in sides})

    conflicts = M.merge_parts(*_schema_versions(s, d)).conflicts
    return conflicts.select("doc", "path", "kind", told(F.struct("kind", *sides)).alias("t")).select("doc", "path", "kind", "t.*")


@query("merge_schema_fields", f"""
SELECT 'part-' || p_partkey AS doc, field, required FROM part, {values([("brand", False), ("name", False), ("ours", False), ("price", False), ("theirs", False), ("worth", False)], 'field, required')}""")
def merge_schema_fields(s, d):
    """What both versions agree on, or one alone changes: fields that ours no longer requires, and fields that each adds."""
    merged = M.merge_parts(*_schema_versions(s, d)).merged
    return merged.schema_fields.where("schema_key = 'parts'").select("doc", "field", "required")


@query("merge_failures", """
SELECT 'part-' || p_partkey AS doc, 'ours' AS side, 'entities.part-' || p_partkey || '.fields.name' AS path, 'MissingRequiredField' AS code, 'required field ''name'' is missing' AS message FROM part WHERE p_partkey % 10 = 1
UNION ALL SELECT 'part-' || p_partkey, 'theirs', 'part-' || p_partkey || '.worth', 'NonFiniteResult', 'calculation for ''part-' || p_partkey || '.worth'' produced a non-finite result' FROM part WHERE p_partkey % 10 = 2
UNION ALL SELECT 'part-' || p_partkey, 'merged', 'part-' || p_partkey || '.worth', 'Cycle', 'formula dependency cycle: [FieldRef { entity: EntityId("part-' || p_partkey || '"), field: FieldId("price") }, FieldRef { entity: EntityId("part-' || p_partkey || '"), field: FieldId("worth") }, FieldRef { entity: EntityId("part-' || p_partkey || '"), field: FieldId("price") }]' FROM part WHERE FALSE""")
def merge_failures(s, d):
    return M.merge_each(*gated(s, d))[1]


def gated(s, d) -> list[DocumentSet]:
    """Versions of which some lack a required field, and some cannot be calculated."""
    base = each_part(s, d)
    k = F.substring_index("doc", "-", -1).cast("long")
    ours = base.with_(cells=base.cells.where(~((k % 10 == 1) & (F.col("field") == "name"))).withColumn("num", F.when((F.col("field") == "price") & (k % 10 == 3), F.col("num") + 1).otherwise(F.col("num"))))
    theirs = base.with_(cells=base.cells.withColumn("num", F.when((F.col("field") == "price") & (k % 10 == 2), 1.7e308).when((F.col("field") == "size") & (k % 10 == 3), F.lit(0.0)).otherwise(F.col("num"))))
    return [base, ours, theirs]


@query("merge_documents", """
SELECT 'part-' || p_partkey AS doc, CASE WHEN p_partkey % 10 = 3 THEN p_retailprice + 1 ELSE p_retailprice END AS price, CASE WHEN p_partkey % 10 = 3 THEN 0 ELSE CAST(p_size AS DOUBLE) END AS size FROM part WHERE p_partkey % 10 NOT IN (1, 2)""")
def merge_documents(s, d):
    """One bad document stops no other: what is merged of the documents that pass."""
    cells = M.merge_each(*gated(s, d))[0].merged.cells.where("kind = 'number'")
    return cells.groupBy("doc").agg(F.max(F.when(F.col("field") == "price", F.col("num"))).alias("price"), F.max(F.when(F.col("field") == "size", F.col("num"))).alias("size"))


# --- views, edits and suggestions ------------------------------------------------------------------------------


@query("overview_display", f"""
SELECT 'part-' || p_partkey AS entity, 'worth' AS field, 'formula' AS field_kind, {_PLAIN.format('(p_retailprice * 2 + 1)')} AS display FROM part
UNION ALL SELECT 'part-' || p_partkey, 'price', 'input', {_PLAIN.format('p_retailprice')} FROM part
UNION ALL SELECT 'part-' || p_partkey, 'size', 'input', {_PLAIN.format('CAST(p_size AS DOUBLE)')} FROM part
UNION ALL SELECT 'part-' || p_partkey, 'name', 'input', p_name FROM part UNION ALL SELECT 'part-' || p_partkey, 'brand', 'input', p_brand FROM part""")
def overview_display(s, d):
    return A.overview(parts(s, d)).select("entity", "field", "field_kind", "display")


@query("explain_rate", f"""
WITH c AS (SELECT c_custkey, c_acctbal * 3 AS rated FROM customer WHERE c_nationkey = 2)
SELECT 'customer-' || c_custkey || '.rated' AS cell, {_PLAIN.format('rated')} AS shown FROM c
UNION ALL SELECT 'order-' || o_orderkey || '.score', {_PLAIN.format('(greatest(o_totalprice, rated) - o_totalprice / 4)')} FROM orders JOIN c ON o_custkey = c_custkey
UNION ALL SELECT 'nation-2.rate', '3'""")
def explain_rate(s, d):
    x = A.explain_field(shop(s, d), "shop", "nation-2", "rate")
    return s.createDataFrame([(x.field, x.display), *x.affected], "cell string, shown string")


@query("explain_formula_view", """
SELECT 'customer-7.rated' AS field, '([customer-7.balance] * [nation-' || c_nationkey || '.rate])' AS expression, c_acctbal * (c_nationkey + 1) AS value, 'customer-7.balance,nation-' || c_nationkey || '.rate' AS dependencies FROM customer WHERE c_custkey = 7""")
def explain_formula_view(s, d):
    docs = shop(s, d)
    x = A.explain_formula(docs, "shop", "customer-7", "rated")
    return s.createDataFrame([(x["field"], x["expression"], x["value"], ",".join(x["dependencies"]))], "field string, expression string, value double, dependencies string")


@query("starter_values", "SELECT * FROM " + values([
    ("alric", "level", 4.0), ("iron_sword", "attack_interval", 0.9), ("iron_sword", "damage", 36.0), ("iron_sword", "dps", 40.0), ("iron_sword", "price", 120.0), ("shop", "gold_per_match", 50.0), ("shop", "matches_for_sword", 2.4),
    ("shop", "upgrade_cost", 200.0), ("tempered_blade", "price", 200.0),
], "entity, field, value"))
def starter_values(s, d):
    return calculate(W.create_document(s, "game-balance", "g", "G")).values.select("entity", "field", "value")


@query("set_formula_diff", """
SELECT 'part-2' AS entity, 'worth' AS field, unnest(['FieldChanged', 'FormulaImpact']) AS kind, unnest([NULL, p_retailprice * 2 + 1]) AS before, unnest([NULL, p_retailprice * 3 - 1]) AS after FROM part WHERE p_partkey = 2""")
def set_formula_diff(s, d):
    changes = W.set_formula(each_part(s, d), "part-2", "part-2", "worth", "[part-2.price] * 3 - 1").changes
    return changes.select(F.col("k1").alias("entity"), F.col("k2").alias("field"), "kind", F.col("before.value.num").alias("before"), F.col("after.value.num").alias("after"))


#: Edits and suggestions that are refused, and why.
REFUSED = [
    (lambda g: W.set_scalar(g, "g", "nobody", "level", "1"), "MissingEntity", "entity 'nobody' does not exist"), (lambda g: W.set_scalar(g, "g", "alric", "mana", "1"), "MissingField", "field 'alric.mana' does not exist"),
    (lambda g: W.set_scalar(g, "g", "iron_sword", "dps", "1"), "FormulaEdit", "field 'iron_sword.dps' is a formula; edit its inputs instead"), (lambda g: W.set_scalar(g, "g", "alric", "level", "four"), "InvalidValue", "'four' is not a valid number value for 'alric.level'"),
    (lambda g: W.rename_entity(g, "g", "shop", "shop"), "NoOpEntityRename", "cannot rename entity 'shop' to itself"), (lambda g: W.duplicate_entity(g, "g", "shop", "alric"), "EntityAlreadyExists", "entity 'alric' already exists"),
    (lambda g: A.suggest_field_change(g, "g", "alric", "level", ("text", "4")), "TypeMismatch", "value for 'alric.level' does not match its schema type"), (lambda g: A.suggest_field_change(g, "g", "alric", "level", ("number", 4.0)), "NoChange", "'alric.level' already has that value"),
]


@query("refused_edits", "SELECT * FROM " + values([(i, k, m) for i, (_, k, m) in enumerate(REFUSED)], "i, kind, message"))
def refused_edits(s, d):
    game = W.settled(W.create_document(s, "game-balance", "g", "G"))
    out = []
    for i, (edit, _, _) in enumerate(REFUSED):
        try:
            edit(game)
            out.append((i, None, None))
        except (W.EditError, A.SuggestionError) as e:
            out.append((i, e.kind, str(e)))
    return s.createDataFrame(out, "i int, kind string, message string")


@query("suggested_change", "SELECT 'alric.level' AS field, 5.0::DOUBLE AS value, TRUE AS requires_approval")
def suggested_change(s, d):
    x = A.suggest_field_change(W.settled(W.create_document(s, "game-balance", "g", "G")), "g", "alric", "level", ("number", 5.0))
    return s.createDataFrame([(x["field"], x["value"][1], x["requires_approval"])], "field string, value double, requires_approval boolean")
