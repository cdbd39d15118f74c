"""Command line over single document files: python -m docloom.cli COMMAND ...

Prints to standard output; a failure is one line, `error: ...`, on standard error, and a status of 1.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .model import DocumentSet, from_python, to_python
from .operators import edits as W
from .operators.calc import CalculationError, calculate
from .operators.describe import counts, explain_field, overview
from .operators.diff import render, semantic_diff
from .operators.merge import MergeError, conflict_side_text, merge
from .operators.validate import findings_of
from .sources.canonical import encode, encode_export, encode_values, save
from .sources.strict import FormatError, decode

PROGRAM = "docloom"


class CommandError(ValueError):
    pass


#: One file is little data: one partition each, and interpreted plans, as compiling them takes longer than running them.
SMALL = {
    "spark.sql.shuffle.partitions": "1", "spark.sql.leafNodeDefaultParallelism": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false",
    "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
}


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.master("local[2]").appName(PROGRAM).config(map=SMALL).getOrCreate()


def diagnostics(found: list) -> str:
    from .operators.merge import diagnostics_text

    return f"semantic document is invalid: {diagnostics_text(found)}"


def load(path: str, key: str | None = None) -> tuple[DocumentSet, str]:
    """A file's document as a set, validated; and its key in the set."""
    try:
        with open(path, "rb") as f:
            data = f.read()
    except OSError as e:
        raise CommandError(f"failed to read '{path}': {e.strerror}") from e
    document = decode(data)
    key = key or "document"
    docs = from_python(session(), {key: document})
    if found := findings_of(docs):
        raise FormatError("InvalidDocument", diagnostics(found))
    return docs, key


def checked_text(docs: DocumentSet, key: str) -> str:
    """The canonical text of a document, which must be valid."""
    if found := findings_of(docs.only(key)):
        raise FormatError("InvalidDocument", diagnostics(found))
    return encode(to_python(docs, key))


def write_new(path: str, text: str) -> None:
    try:
        save(path, text)
    except FileExistsError as e:
        raise CommandError(f"'{path}' already exists; refusing to overwrite it") from e
    except OSError as e:
        raise CommandError(f"failed to create '{path}': {e.strerror}") from e


def field_of(text: str) -> tuple[str, str]:
    parts = text.split(".")
    if len(parts) != 2 or not all(parts):
        raise CommandError(f"invalid field '{text}'; expected entity.field (for example, iron_sword.damage)")
    return parts[0], parts[1]


def default_id(path: str) -> str:
    """An identifier from a file's name: letters and digits in lower case, - and _ kept, other runs one -."""
    stem = os.path.splitext(os.path.basename(path))[0]
    out, gap = "", False
    for c in stem if stem.strip() else "document":
        if c.isascii() and (c.isalnum() or c in "_-"):
            out += ("-" if gap and out else "") + c.lower()
            gap = False
        else:
            gap = True
    return out.rstrip("-_") or "document"


def values_of(docs: DocumentSet) -> dict[tuple[str, str], float]:
    calculation = calculate(docs)
    calculation.check()
    return {(r["entity"], r["field"]): r["value"] for r in calculation.values.collect()}


def distinct(a: argparse.Namespace) -> None:
    if a.input == a.output:
        raise CommandError(f"output '{a.output}' is the same as the input; choose a new path")


def report(edit: W.Edit) -> str:
    return render(edit.changes, edit.before, edit.after).first()["text"]


# --- commands ------------------------------------------------------------------------------------------


def init(a) -> str:
    id_ = a.id if a.id is not None else default_id(a.path)
    docs = W.create_document(session(), a.template, id_, a.title if a.title is not None else id_, "document")
    write_new(a.path, checked_text(docs, "document"))
    n = counts(docs).first()
    last = f"  {PROGRAM} explain {a.path} iron_sword.dps\n" if a.template == "game-balance" else "  define schemas and entities in the canonical .ro document\n"
    return f"initialized {a.path}\n{n['entity_count']} entities · {n['formula_count']} formulas · ready to explore\n\nNext:\n  {PROGRAM} show {a.path}\n{last}"


def validate(a) -> str:
    docs, _ = load(a.path)
    calculate(docs).check()
    return f"valid {a.path}\n"


def calculate_(a) -> str:
    docs, _ = load(a.path)
    return encode_values(values_of(docs))


def show(a) -> str:
    docs, key = load(a.path)
    calculation = calculate(docs)
    calculation.check()
    head, n = docs.documents.first(), counts(docs).first()
    out = f"{head['title']}\n{head['id']} · {n['schema_count']} schemas · {n['entity_count']} entities · {n['formula_count']} formulas\n"
    rows = overview(docs, calculation).orderBy("entity", "field").collect()
    fields: dict[str, list] = {}
    for r in rows:
        fields.setdefault(r["entity"], []).append(r)
    for e in docs.entities.orderBy("entity_key").collect():
        own = fields.get(e["entity_key"], [])
        words = " ".join(w for w in e["entity_id"].split("_") if w)
        label = own[0]["label"] if own else words[:1].upper() + words[1:] or e["entity_id"]
        out += f"\n{e['schema']} · {label} [{e['entity_id']}]\n"
        for r in own:
            note = {"formula": " (formula)", "reference": f" (reference → {r['target_schema']})", "input": ""}[r["field_kind"]]
            out += f"  {r['field']}: {r['display']}{note}\n"
    return out


def explain(a) -> str:
    docs, key = load(a.path)
    x = explain_field(docs, key, *field_of(a.field))
    out = f"{x.field} = {x.display}\n"
    if x.expression is not None:
        out += f"formula: {x.expression}\n"
    if x.dependencies:
        out += "depends on:\n" + "".join(f"  - {d}\n" for d in x.dependencies)
    if x.affected:
        out += "affects:\n" + "".join(f"  - {f} = {v}\n" for f, v in x.affected)
    if x.expression is None and not x.dependencies and not x.affected:
        out += "stored input; no formulas depend on this field\n"
    return out


def set_(a) -> str:
    distinct(a)
    docs, key = load(a.input)
    edit = W.set_scalar(docs, key, *field_of(a.field), a.value)
    text = report(edit)
    write_new(a.output, checked_text(edit.after, key))
    return f"{text.rstrip()}\nwrote {a.output}\n\nNext:\n  {PROGRAM} diff {a.input} {a.output}\n"


def _edited(a, make, said: str, after: str) -> str:
    distinct(a)
    docs, key = load(a.input)
    edit = make(docs, key)
    text = report(edit)
    write_new(a.output, checked_text(edit.after, key))
    return f"{text}{said}wrote {a.output}\n\nNext:\n  {PROGRAM} {after}\n"


def duplicate(a) -> str:
    return _edited(a, lambda d, k: W.duplicate_entity(d, k, a.source, a.target), f"duplicated {a.source} as {a.target}\n", f"show {a.output}")


def rename(a) -> str:
    return _edited(a, lambda d, k: W.rename_entity(d, k, a.source, a.target), f"renamed {a.source} -> {a.target}\n", f"show {a.output}")


def remove(a) -> str:
    return _edited(a, lambda d, k: W.remove_entity(d, k, a.entity), f"removed {a.entity}\n", f"show {a.output}")


def formula_set(a) -> str:
    return _edited(a, lambda d, k: W.set_formula(d, k, *field_of(a.field), a.expression), "", f"explain {a.output} {a.field}")


def diff(a) -> str:
    (before, _), (after, _) = load(a.before), load(a.after)
    return render(semantic_diff(before, after), before, after).first()["text"]


def merge_(a) -> str:
    base, ours, theirs = (load(p)[0] for p in (a.base, a.ours, a.theirs))
    out = merge(base, ours, theirs)
    if rows := out.conflicts.collect():
        lines = "\n".join(f"  {r['path']}\n" + "\n".join(f"    {s}: {conflict_side_text(r['kind'], r[s])}" for s in ("base", "ours", "theirs")) for r in rows)
        raise CommandError(f"merge conflicts:\n{lines}")
    text = render(semantic_diff(base, out.merged), base, out.merged).first()["text"]
    write_new(a.output, checked_text(out.merged, "document"))
    return f"{text}wrote {a.output}\n"


def export(a) -> str:
    docs, key = load(a.input)
    write_new(a.output, encode_export(to_python(docs, key), values_of(docs)))
    return f"exported {a.output}\n"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog=PROGRAM, description="Typed semantic documents: inspect, edit, compare and merge.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(within, name: str, run, *arguments: str, output: bool = False):
        p = within.add_parser(name)
        for x in arguments:
            p.add_argument(x)
        if output:
            p.add_argument("--output", required=True)
        p.set_defaults(run=run)
        return p

    p = command(commands, "init", init, "path")
    p.add_argument("--id")
    p.add_argument("--title")
    p.add_argument("--template", choices=W.TEMPLATES, default="game-balance")
    command(commands, "validate", validate, "path")
    command(commands, "calculate", calculate_, "path")
    command(commands, "show", show, "path")
    command(commands, "explain", explain, "path", "field")
    command(commands, "set", set_, "input", "field", "value", output=True)
    entity = commands.add_parser("entity").add_subparsers(dest="action", required=True)
    command(entity, "duplicate", duplicate, "input", "source", "target", output=True)
    command(entity, "rename", rename, "input", "source", "target", output=True)
    command(entity, "remove", remove, "input", "entity", output=True)
    formula = commands.add_parser("formula").add_subparsers(dest="action", required=True)
    command(formula, "set", formula_set, "input", "field", output=True).add_argument("--expression", required=True)
    command(commands, "diff", diff, "before", "after")
    command(commands, "merge", merge_, "base", "ours", "theirs", output=True)
    command(commands, "export", export, "input", "output")
    return top


def run(arguments: list[str]) -> str:
    """The output of a command; ValueError with its message where it fails."""
    fixed = []
    for x in arguments:  # an expression may begin with a hyphen
        if fixed and fixed[-1] == "--expression":
            fixed[-1] = f"--expression={x}"
        else:
            fixed.append(x)
    a = parser().parse_args(fixed)
    return a.run(a)


def main() -> int:
    try:
        sys.stdout.write(run(sys.argv[1:]))
        return 0
    except (ValueError, CalculationError, MergeError) as e:
        sys.stderr.write(f"error: {e}\n")
        return 1


if __name__ == "__main__":
    sys.exit(main())
