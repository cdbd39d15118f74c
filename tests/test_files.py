import os

import pytest
from helpers import document, field, flag, formula, link, number, text

from docloom import cli
from docloom.model import from_python, to_python
from docloom.operators.calc import calculate
from docloom.operators.edits import template
from docloom.sources.canonical import canonical_texts, encode, encode_values, export_rows, export_texts, save
from docloom.sources.strict import FormatError, decode, read_files
from docloom.streaming.ingest import ingest

SHAPES = document({
    "alpha": ("node", {"n": number(-0.0), "sum": formula("min([beta.n], 2) / 1e-7 - -3"), "yes": flag(True), "t": text('Café\n"\\\u0001'), "r": link("beta")}),
    "beta": ("node", {"n": number(4)}),
}, {"node": {"n": field("number"), "sum": field("number", False), "yes": field("boolean", False), "t": field("text", False), "r": field("reference", False, "node")}, "empty": {}})

GOLDEN = """{
  "format_version": 1,
  "id": "doc",
  "title": "Doc",
  "schemas": {
    "empty": {
      "id": "empty",
      "fields": {}
    },
    "s": {
      "id": "s",
      "fields": {
        "a": {
          "field_type": {
            "type": "number"
          },
          "required": true
        },
        "r": {
          "field_type": {
            "type": "reference",
            "schema": "s"
          },
          "required": false
        }
      }
    }
  },
  "entities": {
    "e": {
      "id": "e",
      "schema": "s",
      "fields": {
        "a": {
          "kind": "formula",
          "value": {
            "op": "add",
            "args": {
              "left": {
                "op": "number",
                "args": 1.0
              },
              "right": {
                "op": "reference",
                "args": {
                  "entity": "e",
                  "field": "b"
                }
              }
            }
          }
        }
      }
    }
  }
}
"""


def test_golden_bytes():
    d = document({"e": ("s", {"a": formula("1 + [e.b]")})}, {"s": {"r": field("reference", False, "s"), "a": field("number")}, "empty": {}})
    assert encode(d) == GOLDEN
    assert decode(GOLDEN.encode()) == d


def test_round_trips():
    for d in (SHAPES, template("game-balance", "g", "G"), template("empty", "g", "G")):
        text_ = encode(d)
        assert encode(decode(text_.encode())) == text_
        assert decode(text_.encode()) == d


def version(v: str) -> bytes:
    return f'{{"format_version":{v},"id":"doc","title":"D","schemas":{{}},"entities":{{}}}}'.encode()


@pytest.mark.parametrize(("data", "kind"), [
    (b"\xff{", "InvalidUtf8"), (b"{", "InvalidJson"), (b"NaN", "InvalidJson"), (version("1") + b" x", "InvalidJson"), (b'{"a":{"b":1,"b":2}', "InvalidJson"),
    (b'{"a":{"b":1,"\\u0062":2}}', "DuplicateMember"), (b'{"format_version":2,"format_version":2}', "DuplicateMember"), (b"{}", "VersionMissing"), (b"[1]", "VersionMissing"),
    *((version(v), "VersionMalformed") for v in ('"1"', "1.0", "1e0", "0", "-1", "-0", "4294967296", "null", "true")), (version("2"), "UnsupportedVersion"),
    (version("1").replace(b'"title":"D"', b'"title":"D","more":1'), "InvalidRepresentation"), (version("1").replace(b'"doc"', b'"Doc"'), "InvalidRepresentation"), (version("1").replace(b'"title":"D",', b""), "InvalidRepresentation"),
    (GOLDEN.replace('"type": "number"', '"type": "number", "schema": null').encode(), "InvalidRepresentation"), (GOLDEN.replace('"schema": "s"\n          }', '"schema": "gone"\n          }').encode(), "InvalidRepresentation"),
    (GOLDEN.replace('"args": 1.0', '"args": 1e999').encode(), "InvalidRepresentation"), (GOLDEN.replace('"e": {\n      "id": "e"', '"e": {\n      "id": "f"').encode(), "InvalidRepresentation"),
    (GOLDEN.replace('"op": "add"', '"op": "power"').encode(), "InvalidRepresentation"),
])
def test_strict_reading(data, kind):
    with pytest.raises(FormatError) as e:
        decode(data)
    assert e.value.kind == kind


def test_files_of_a_folder(spark, tmp_path):
    good = {"a.ro": SHAPES, "b.ro": template("game-balance", "g", "G")}
    for name, d in good.items():
        save(str(tmp_path / name), encode(d))
    (tmp_path / "bad.ro").write_bytes(b'{"format_version": 1.0}')
    docs, errors = read_files(spark, str(tmp_path))
    assert [(os.path.basename(r["doc"]), r["error"]) for r in errors.collect()] == [("bad.ro", "VersionMalformed")]
    by = {os.path.basename(r["doc"]): r["doc"] for r in docs.documents.collect()}
    assert {n: to_python(docs, by[n]) for n in good} == good
    assert {os.path.basename(r["doc"]): r["text"] for r in canonical_texts(docs).collect()} == {n: encode(d) for n, d in good.items()}
    with pytest.raises(FileExistsError):
        save(str(tmp_path / "a.ro"), "")
    out = tmp_path / "tables"
    ingest(spark, str(tmp_path), str(out), str(tmp_path / "log")).awaitTermination(120)
    assert spark.read.parquet(str(out / "cells")).count() == docs.cells.count()
    assert spark.read.parquet(str(out / "errors")).count() == 1


def test_exports(spark):
    c = calculate(from_python(spark, {"d": document({"a": ("s", {"x": number(1), "y": formula("[a.x] / 4"), "r": link("a"), "b": flag(False), "t": text("é")})})}))
    assert export_texts(c).first()["text"] == (
        '{\n  "format_version": 1,\n  "document_id": "doc",\n  "title": "Doc",\n  "entities": {\n    "a": {\n      "schema": "s",\n      "fields": {\n        "b": false,\n'
        '        "r": {\n          "reference": "a"\n        },\n        "t": "é",\n        "x": 1.0,\n        "y": 0.25\n      }\n    }\n  }\n}\n'
    )
    rows = {r["field"]: (r["number"], r["text"], r["boolean"], r["reference"]) for r in export_rows(c).collect()}
    assert rows["y"] == (0.25, None, None, None) and rows["r"] == (None, None, None, "a")
    assert encode_values({("a", "z"): 1.0, ("a-b", "c"): 2.0}) == '{\n  "a-b.c": 2.0,\n  "a.z": 1.0\n}\n'


def test_command_line(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    a, b, c, m = p("My Game!.ro"), p("b.ro"), p("c.ro"), p("m.ro")
    assert cli.run(["init", a]).startswith(f"initialized {a}\n4 entities · 3 formulas · ready to explore\n")
    assert '"id": "my-game"' in open(a, encoding="utf-8").read()
    assert cli.run(["validate", a]) == f"valid {a}\n"
    assert "weapons · Iron Sword [iron_sword]\n  attack_interval: 0.9\n  damage: 36\n  dps: 40 (formula)\n" in cli.run(["show", a])
    assert cli.run(["explain", a, "iron_sword.damage"]) == "iron_sword.damage = 36\naffects:\n  - iron_sword.dps = 40\n"
    assert cli.run(["set", a, "iron_sword.damage", "45", "--output", b]) == f"Weapons Iron Sword\ndamage: 36 -> 45\naffected dps: 40 -> 50\nwrote {b}\n\nNext:\n  docloom diff {a} {b}\n"
    cli.run(["formula", "set", a, "iron_sword.dps", "--output", c, "--expression", "-[iron_sword.damage]"])
    assert cli.run(["merge", a, b, c, "--output", m]).endswith(f"affected dps: 40 -> -45\nwrote {m}\n")
    for arguments, message in (
        (["set", a, "iron_sword.damage", "1", "--output", a], f"output '{a}' is the same as the input; choose a new path"),
        (["init", a], f"'{a}' already exists; refusing to overwrite it"),
        (["explain", a, "x"], "invalid field 'x'; expected entity.field (for example, iron_sword.damage)"),
    ):
        with pytest.raises(ValueError) as e:
            cli.run(arguments)
        assert str(e.value) == message


@pytest.mark.parametrize(("path", "want"), [("a/My Game!.ro", "my-game"), ("_x_.ro", "_x"), ("--.ro", "document"), (" .ro", "document"), ("été 2.ro", "t-2"), ("A_b-C.ro", "a_b-c")])
def test_default_identifiers(path, want):
    assert cli.default_id(path) == want
