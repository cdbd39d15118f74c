"""Strict reading of document files: bytes to tables, with one typed error per file at most.

Stages, the first failure wins: UTF-8, JSON syntax, duplicate members (at any depth, after escapes are
decoded), format version (missing, malformed, unsupported), representation. The version is judged by its
spelling: only an unsigned integer from 1 to 2^32 - 1 is well-formed. Readers are closed-world: unknown
members are errors. Decoding runs in Python on the executors, one file a row; files are never collected.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import OPERATORS, is_identifier
from ..model import CELLS, DOCUMENTS, ENTITIES, SCHEMA_FIELDS, SCHEMAS, DocumentSet, rows_of
from ..session import settle, ship

VERSION, SUPPORTED = 1, (1,)
#: Kinds of errors, in the order of the stages.
ERRORS = ("InvalidUtf8", "InvalidJson", "DuplicateMember", "VersionMissing", "VersionMalformed", "UnsupportedVersion", "InvalidRepresentation", "InvalidDocument")
_NAMES = ("documents", "schemas", "schema_fields", "entities", "cells")
_SCHEMAS = (DOCUMENTS, SCHEMAS, SCHEMA_FIELDS, ENTITIES, CELLS)


class FormatError(ValueError):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Number(str):
    """A JSON number, by its spelling."""


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


def _syntax(text: str):
    """The value of a text, with objects as lists of pairs, and numbers spelled."""
    out = json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_no_constant, object_pairs_hook=lambda pairs: ("object", pairs))
    return out


def _first_duplicate(x) -> str | None:
    """The member that is first seen twice, in the order of the text."""
    if isinstance(x, tuple):
        seen = set()
        for name, value in x[1]:
            if name in seen:
                return name
            seen.add(name)
            if (found := _first_duplicate(value)) is not None:
                return found
    elif isinstance(x, list):
        for value in x:
            if (found := _first_duplicate(value)) is not None:
                return found
    return None


def _bad(message: str) -> FormatError:
    return FormatError("InvalidRepresentation", f"invalid version-1 .ro representation: {message}")


def _object(x, what: str, members: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict:
    """An object with exactly these members."""
    if not isinstance(x, tuple):
        raise _bad(f"{what} must be an object")
    got = dict(x[1])
    for name in got:
        if name not in members and name not in optional:
            raise _bad(f"unknown field `{name}` in {what}")
    for name in members:
        if name not in got:
            raise _bad(f"missing field `{name}` in {what}")
    return got


def _map(x, what: str) -> dict:
    if not isinstance(x, tuple):
        raise _bad(f"{what} must be an object")
    return dict(x[1])


def _text(x, what: str) -> str:
    if not isinstance(x, str) or isinstance(x, Number):
        raise _bad(f"{what} must be a string")
    return x


def _number(x, what: str) -> float:
    if not isinstance(x, Number):
        raise _bad(f"{what} must be a number")
    value = float(x)
    if not math.isfinite(value):
        raise _bad(f"{what} must be finite")
    return value


def _boolean(x, what: str) -> bool:
    if not isinstance(x, bool):
        raise _bad(f"{what} must be a boolean")
    return x


def _identifier(x, kind: str) -> str:
    text = _text(x, kind)
    if not is_identifier(text):
        raise _bad(f"{kind} '{text}' must use the legacy identifier grammar")
    return text


def _expression(x) -> tuple:
    node = _object(x, "expression", ("op", "args"))
    op = _text(node["op"], "op")
    if op == "number":
        return "number", _number(node["args"], "formula number")
    if op == "reference":
        ref = _object(node["args"], "formula reference", ("entity", "field"))
        return "reference", _identifier(ref["entity"], "formula reference entity"), _identifier(ref["field"], "formula reference field")
    if op not in OPERATORS:
        raise _bad(f"unknown v1 expression op '{op}'")
    sides = _object(node["args"], "operands", ("left", "right"))
    return op, _expression(sides["left"]), _expression(sides["right"])


def _field_type(x) -> tuple[str, str | None]:
    got = _object(x, "field type", ("type",), ("schema",))
    kind = _text(got["type"], "type")
    if kind == "reference":
        if got.get("schema") is None:
            raise _bad("v1 reference field type requires member 'schema'")
        return kind, _text(got["schema"], "schema")
    if kind not in ("number", "text", "boolean"):
        raise _bad(f"unknown v1 field type '{kind}'")
    if "schema" in got:
        raise _bad(f"v1 field type '{kind}' does not allow member 'schema'")
    return kind, None


def _value(x) -> tuple:
    got = _object(x, "value", ("kind", "value"))
    kind = _text(got["kind"], "kind")
    if kind == "number":
        return kind, _number(got["value"], "number value")
    if kind == "text":
        return kind, _text(got["value"], "text value")
    if kind == "boolean":
        return kind, _boolean(got["value"], "boolean value")
    if kind == "reference":
        return kind, _identifier(got["value"], "entity reference")
    if kind == "formula":
        return kind, _expression(got["value"])
    raise _bad(f"unknown v1 value kind '{kind}'")


def _version(x) -> int:
    """The version of a document's value, judged by its spelling."""
    members = dict(x[1]) if isinstance(x, tuple) else {}
    if "format_version" not in members:
        raise FormatError("VersionMissing", "missing required .ro format version")
    token = members["format_version"]
    if not isinstance(token, Number) or not token.isdigit() or not 1 <= int(token) < 1 << 32:
        raise FormatError("VersionMalformed", "malformed .ro format version")
    if int(token) not in SUPPORTED:
        raise FormatError("UnsupportedVersion", f"unsupported .ro format version {int(token)}; this build supports {VERSION}")
    return int(token)


def decode(data: bytes) -> dict:
    """The document of a file's bytes, in Python; FormatError at the first failing stage before validation."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise FormatError("InvalidUtf8", f"invalid .ro UTF-8: {e}") from e
    try:
        x = _syntax(text)
        json.dumps(x).encode()  # lone surrogates are no text
    except (ValueError, RecursionError) as e:
        raise FormatError("InvalidJson", f"invalid .ro JSON: {e}") from e
    if (name := _first_duplicate(x)) is not None:
        raise FormatError("DuplicateMember", f"duplicate JSON member '{name}'")
    _version(x)
    top = _object(x, "document", ("format_version", "id", "title", "schemas", "entities"))
    out = {"id": _text(top["id"], "document id"), "title": _text(top["title"], "title"), "schemas": {}, "entities": {}}
    for key, s in _map(top["schemas"], "schemas").items():
        got = _object(s, "schema", ("id", "fields"))
        fields = {}
        for f, d in _map(got["fields"], "fields").items():
            definition = _object(d, "field definition", ("field_type", "required"))
            kind, target = _field_type(definition["field_type"])
            fields[f] = {"type": kind, "ref_schema": target, "required": _boolean(definition["required"], "required")}
        out["schemas"][key] = {"id": _text(got["id"], "schema id"), "fields": fields}
    for key, e in _map(top["entities"], "entities").items():
        got = _object(e, "entity", ("id", "schema", "fields"))
        out["entities"][key] = {"id": _text(got["id"], "entity id"), "schema": _text(got["schema"], "entity schema"), "fields": {f: _value(v) for f, v in _map(got["fields"], "fields").items()}}
    _check(out)
    return out


def _check(d: dict) -> None:
    """What one document's representation must keep beyond its shape, in sorted order."""
    _identifier(d["id"], "document id")
    order = lambda m: sorted(m, key=str.encode)
    for key in order(d["schemas"]):
        s = d["schemas"][key]
        _identifier(key, "schema map key")
        _identifier(s["id"], "schema id")
        if key != s["id"]:
            raise _bad(f"schema map key '{key}' does not match nested id '{s['id']}'")
        for f in order(s["fields"]):
            _identifier(f, "schema field id")
            target = s["fields"][f]["ref_schema"]
            if s["fields"][f]["type"] == "reference":
                _identifier(target, "reference field target schema")
                if target not in d["schemas"]:
                    raise _bad(f"reference field target schema '{target}' does not exist")
    for key in order(d["entities"]):
        e = d["entities"][key]
        _identifier(key, "entity map key")
        _identifier(e["id"], "entity id")
        if key != e["id"]:
            raise _bad(f"entity map key '{key}' does not match nested id '{e['id']}'")
        _identifier(e["schema"], "entity schema")
        if e["schema"] not in d["schemas"]:
            raise _bad(f"entity schema '{e['schema']}' does not exist")
        for f in order(e["fields"]):
            _identifier(f, "entity field id")
            if f not in d["schemas"][e["schema"]]["fields"]:
                raise _bad(f"entity field '{f}' is not declared by schema '{e['schema']}'")


# --- distributed ------------------------------------------------------------------------------------

DECODED = "doc string, error string, message string, tables string"


def decode_files(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """A row per file: doc, error and message (null for good files), tables (the rows, as JSON)."""
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tables = rows_of(doc, decode(data or b""))
                    out.append((doc, None, None, json.dumps(dict(zip(_NAMES, tables, strict=True)))))
                except FormatError as e:
                    out.append((doc, e.kind, str(e), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["doc", "error", "message", "tables"])

    return files.select(F.col(key).cast("string"), F.col(content).cast("binary")).mapInArrow(run, DECODED)


def tables_of(decoded: DataFrame) -> DocumentSet:
    """The five tables of the good files."""
    good = decoded.where("error is null")
    out = []
    for name, schema in zip(_NAMES, _SCHEMAS, strict=True):
        rows = good.select(F.explode(F.from_json(F.get_json_object("tables", f"$.{name}"), "array<array<string>>")).alias("r"))
        columns = [c.strip().split(" ", 1) for c in schema.split(", ")] if name != "cells" else [["doc", "string"], ["entity", "string"], ["field", "string"], ["kind", "string"], ["num", "double"], ["txt", "string"], ["flag", "boolean"], ["ref", "string"], ["expr", ""]]
        picked = []
        for i, (c, t) in enumerate(columns):
            x = F.col("r")[i]
            if c == "expr":
                nodes = F.from_json(x, "array<array<string>>")
                picked.append(F.transform(nodes, lambda n: F.struct(n[0].alias("op"), n[1].cast("double").alias("num"), n[2].alias("e"), n[3].alias("f"))).alias(c))
            else:
                picked.append(x.cast(t).alias(c))
        out.append(rows.select(*picked))
    return DocumentSet(*out)


def read_files(spark: SparkSession, path: str, pattern: str = "*.ro") -> tuple[DocumentSet, DataFrame]:
    """(the good files' documents, keyed by path; doc, error, message of the others)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    decoded = settle(decode_files(files.select("path", "content")))
    return tables_of(decoded), decoded.where("error is not null").select("doc", "error", "message")
