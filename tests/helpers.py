"""Documents for tests, and naive Python versions of the operators."""

from __future__ import annotations

import math
import random

from docloom.functions.formula import OPERATORS, parse


def number(x):
    return ("number", float(x))


def text(x):
    return ("text", x)


def formula(t):
    return ("formula", parse(t))


def link(x):
    return ("reference", x)


def flag(x):
    return ("boolean", x)


def field(kind, required=True, target=None):
    return {"type": kind, "ref_schema": target, "required": required}


def document(entities: dict, schemas: dict | None = None, id_="doc", title="Doc") -> dict:
    """entities: {id: (schema, {field: value})}; schemas: {id: {field: definition}}, by default declared as used."""
    if schemas is None:
        kinds = {"number": "number", "formula": "number", "text": "text", "boolean": "boolean"}
        schemas = {}
        for s, cells in entities.values():
            for f, (kind, x) in cells.items():
                schemas.setdefault(s, {})[f] = field("reference", False, entities[x][0]) if kind == "reference" else field(kinds[kind], False)
            schemas.setdefault(s, {})
    return {
        "id": id_, "title": title, "schemas": {s: {"id": s, "fields": {f: dict(x) for f, x in fields.items()}} for s, fields in schemas.items()},
        "entities": {e: {"id": e, "schema": s, "fields": dict(cells)} for e, (s, cells) in entities.items()},
    }


class Failed(Exception):
    pass


def evaluate(doc: dict) -> dict:
    """Values by (entity, field), or Failed(code, entity, field, path), depth first."""
    values: dict = {}
    stack: list = []

    def visit(e, f):
        if (e, f) in values:
            return values[e, f]
        if (e, f) in stack:
            raise Failed("Cycle", e, f, [*stack[stack.index((e, f)) :], (e, f)])
        if e not in doc["entities"] or f not in doc["entities"][e]["fields"]:
            raise Failed("MissingReference", e, f, None)
        kind, x = doc["entities"][e]["fields"][f]
        if kind not in ("number", "formula"):
            raise Failed("NonNumericReference", e, f, None)
        stack.append((e, f))

        def finite(v):
            if not math.isfinite(v):
                raise Failed("NonFiniteResult", e, f, None)
            return v

        def run(t):
            if t[0] == "number":
                return finite(t[1])
            if t[0] == "reference":
                return visit(t[1], t[2])
            a, b = run(t[1]), run(t[2])
            if t[0] == "divide":
                if b == 0:
                    raise Failed("DivisionByZero", e, f, None)
                return finite(a / b)
            return finite({"add": a + b, "subtract": a - b, "multiply": a * b, "minimum": min(a, b), "maximum": max(a, b)}[t[0]])

        values[e, f] = finite(x) if kind == "number" else run(x)
        stack.pop()
        return values[e, f]

    for e in sorted(doc["entities"]):
        for f in sorted(doc["entities"][e]["fields"]):
            if doc["entities"][e]["fields"][f][0] in ("number", "formula"):
                visit(e, f)
    return values


def random_expression(r: random.Random, refs: list, depth=0):
    if depth == 3 or r.random() < 0.35:
        return ("reference", *r.choice(refs)) if refs and r.random() < 0.7 else ("number", float(r.choice([0, 1, 2, -3, 0.5, 1e200])))
    return (r.choice(OPERATORS), random_expression(r, refs, depth + 1), random_expression(r, refs, depth + 1))


def random_document(r: random.Random, n=4) -> dict:
    names = [f"e{i}" for i in range(n)]
    refs = [(e, f) for e in names for f in ("a", "b", "c", "t")]
    if r.random() < 0.3:
        refs.append(("gone", "a"))
    safe = r.random() < 0.6
    entities = {}
    for i, e in enumerate(names):
        cells = {"a": number(r.choice([1, 2, 0, -4.5]))}
        usable = [(x, f) for x, f in refs if not safe or (x in names[:i] and f in ("a", "b")) or (x, f) == (e, "a")]
        for f in ("b", "c"):
            if r.random() < 0.8:
                cells[f] = ("formula", random_expression(r, usable))
        if r.random() < 0.5:
            cells["t"] = text("x")
        entities[e] = ("s", cells)
    schemas = {"s": {"a": field("number", False), "b": field("number", False), "c": field("number", False), "t": field("text", False)}}
    return document(entities, schemas)
