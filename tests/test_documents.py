import random

import pytest
from helpers import Failed, document, evaluate, field, flag, formula, link, number, random_document, text
from pyspark.sql import functions as F

from docloom.model import from_python, to_python
from docloom.operators import calc, graph
from docloom.operators import edits as W
from docloom.operators.calc import CalculationError, calculate
from docloom.operators.describe import SuggestionError, counts, describe_documents, explain_field, explain_formula, overview, suggest_field_change
from docloom.operators.diff import in_order, render, semantic_diff
from docloom.operators.graph import affected_by, dependencies, edges
from docloom.operators.merge import MergeError, conflict_side_text, merge, merge_parts
from docloom.operators.validate import findings_of, sorted_findings, validate
from docloom.session import shared_folder


def test_every_finding(spark):
    schemas = {"s": {"n": field("number"), "t": field("text", False), "r": field("reference", False, "u"), "f": field("number", False), "Bad": field("number", False), "b": field("boolean", False)}, "u": {"x": field("text", False)}}
    d = document({
        "e1": ("s", {"n": number(1), "r": link("gone"), "zz": number(1)}),
        "e2": ("s", {"t": number(2), "r": link("e1"), "f": formula("[gone.n] + [gone.n] + [e1.q] + [e1.t]"), "b": flag(True)}),
        "e3": ("lost", {"n": number(float("nan"))}),
        "e4": ("s", {"n": number(float("inf")), "f": ("formula", ("add", ("number", float("inf")), ("reference", "e3", "n"))), "t": formula("1")}),
        "E5": ("u", {}),
    }, schemas, id_="", title="  \n")
    d["schemas"]["u"]["id"] = "v"
    d["entities"]["e1"]["id"] = "other"
    d["schemas"]["a\n"] = {"id": "a\n", "fields": {}}
    grammar = "must be a lowercase identifier using only a-z, 0-9, '_' or '-', starting with a letter or digit"
    want = [
        ("entities.E5.id", "InvalidIdentifier", f"entity id 'E5' {grammar}"),
        ("entities.e1.fields.r", "MissingReference", "referenced entity 'gone' does not exist"),
        ("entities.e1.fields.zz", "UnexpectedField", "field 'zz' is not declared by schema 's'"),
        ("entities.e1.id", "KeyMismatch", "entity map key 'e1' does not match id 'other'"),
        ("entities.e2.fields.f", "MissingFormulaReference", "formula reference 'e1.q' has no target field"),
        ("entities.e2.fields.f", "MissingFormulaReference", "formula reference 'gone.n' has no target entity"),
        ("entities.e2.fields.f", "MissingFormulaReference", "formula reference 'gone.n' has no target entity"),
        ("entities.e2.fields.f", "FormulaReferenceTypeMismatch", "formula reference 'e1.t' does not target a numeric field"),
        ("entities.e2.fields.n", "MissingRequiredField", "required field 'n' is missing"),
        ("entities.e2.fields.r", "ReferenceTypeMismatch", "field 'r' expects a reference to schema 'u', but 'e1' uses schema 's'"),
        ("entities.e2.fields.t", "TypeMismatch", "field 't' expects text, but found number"),
        ("entities.e3.schema", "MissingSchema", "schema 'lost' does not exist"),
        ("entities.e4.fields.f", "NonFiniteNumber", "numeric values must be finite"),
        ("entities.e4.fields.f", "MissingFormulaReference", "formula reference 'e3.n' has no target schema"),
        ("entities.e4.fields.n", "NonFiniteNumber", "numeric values must be finite"),
        ("entities.e4.fields.t", "TypeMismatch", "field 't' expects text, but found formula"),
        ("id", "EmptyIdentifier", "document id must not be empty"),
        ("schemas.a\n.id", "InvalidIdentifier", f"schema id 'a\n' {grammar}"),
        ("schemas.s.fields.Bad", "InvalidIdentifier", f"field id 'Bad' {grammar}"),
        ("schemas.u.id", "KeyMismatch", "schema map key 'u' does not match id 'v'"),
        ("title", "EmptyTitle", "document title must not be empty"),
    ]
    assert findings_of(from_python(spark, {"d": d})) == want


@pytest.mark.parametrize("whole", [1 << 16, 9, 2])  # all documents in one task each, some, and nearly none
def test_calculation_agrees_with_depth_first(spark, whole, monkeypatch):
    monkeypatch.setattr(calc, "WHOLE", whole)
    r = random.Random(11)
    docs = {f"d{i}": random_document(r) for i in range(60)}
    docs |= {
        "cycle": document({"a": ("s", {"x": formula("[b.y]+1")}), "b": ("s", {"y": formula("[c.w]*2")}), "c": ("s", {"w": formula("[b.y]")})}),
        "early": document({"a": ("s", {"x": formula("(1/0)+[a.y]"), "y": formula("[a.x]")})}),
        "zeros": document({"a": ("s", {"x": formula("min(0, -0)"), "z": number(-0.0)})}),
    }
    c = calculate(from_python(spark, docs))
    values: dict = {}
    for row in c.values.collect():
        values.setdefault(row["doc"], {})[row["entity"], row["field"]] = row["value"]
    errors = {x["doc"]: (x["code"], x["at_entity"], x["at_field"], x["path"]) for x in c.first_errors().collect()}
    failed = 0
    for name, d in docs.items():
        try:
            want = evaluate(d)
        except Failed as e:
            failed += 1
            code, entity, f, path = e.args
            assert errors[name] == (code, entity, f, [".".join(p) for p in path] if path else None), name
        else:
            assert name not in errors and values.get(name, {}) == want, name
    assert 5 < failed < 60
    with pytest.raises(CalculationError, match="formula dependency cycle"):
        c.check("cycle")


@pytest.mark.parametrize("whole", [1 << 16, 10])
def test_long_chains(spark, whole, monkeypatch):
    monkeypatch.setattr(calc, "WHOLE", whole)
    length = 3000 if whole > 10 else 13
    chain = {"x0": number(1)} | {f"x{i}": formula(f"[a.x{i - 1}] + 1") for i in range(1, length)}
    docs = from_python(spark, {"chain": document({"a": ("s", chain)}), "short": document({"a": ("s", {"x0": number(2), "x1": formula("[a.x0] * 2")})})})
    values = {(v["doc"], v["field"]): v["value"] for v in calculate(docs).values.collect()}
    assert values == {("chain", f"x{i}"): i + 1.0 for i in range(length)} | {("short", "x0"): 2.0, ("short", "x1"): 4.0}


@pytest.mark.parametrize("whole", [1 << 16, 8, 0])
def test_impact_agrees_with_a_walk(spark, whole, monkeypatch):
    monkeypatch.setattr(graph, "WHOLE", whole)
    r = random.Random(21)
    links = {(d, r.randrange(12), r.randrange(12)) for d in ("a", "b", "c") for _ in range({"a": 14, "b": 5, "c": 30}[d])}
    all_edges = spark.createDataFrame([(d, "e", f"f{x}", "e", f"f{y}") for d, x, y in links], "doc string, entity string, field string, dep_entity string, dep_field string")
    seeds = spark.createDataFrame([(d, "e", f"f{x}") for d in ("a", "b", "c", "none") for x in (0, 3, 3, 20)], "doc string, entity string, field string")
    want = set()
    for d in ("a", "b", "c"):
        for x in (0, 3):
            seen, todo = set(), [x]
            while todo:
                y = todo.pop()
                new = {u for dd, u, t in links if dd == d and t == y} - seen
                seen |= new
                todo += new
            want |= {(d, f"f{x}", f"f{u}") for u in seen - {x}}
    got = [(g["doc"], g["seed_field"], g["field"]) for g in affected_by(all_edges, seeds).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    nothing = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(master="yarn", getConf=lambda: nothing, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=nothing, sparkContext=cluster))


def test_dependencies_and_impact(spark):
    docs = from_python(spark, {"d": document({"sword": ("w", {"damage": number(100), "interval": number(1.25), "dps": formula("[sword.damage]/[sword.interval]"), "burst": formula("[sword.dps]*2+[sword.dps]"), "fixed": formula("1+1")})})})
    deps = {r["field"]: [d["field"] for d in r["dependencies"]] for r in dependencies(docs).collect()}
    assert deps == {"dps": ["damage", "interval"], "burst": ["dps"], "fixed": []}
    seeds = docs.cells.where("field = 'damage'").select("doc", "entity", "field")
    assert sorted(r["field"] for r in affected_by(edges(docs), seeds).collect()) == ["burst", "dps"]


@pytest.fixture(scope="module")
def game(spark):
    return W.settled(W.create_document(spark, "game-balance", "game-balance", "Moonfall"))


def test_views(spark, game):
    assert findings_of(game) == []
    assert tuple(counts(game).first()) == ("game-balance", 4, 4, 3)
    shown = {(r["entity"], r["field"]): (r["display"], r["field_kind"], r["target_schema"]) for r in overview(game).collect()}
    assert shown["iron_sword", "dps"] == ("40", "formula", None) and shown["shop", "matches_for_sword"][0] == "2.4"
    assert shown["alric", "weapon"] == ("→ iron_sword", "reference", "weapons")
    x = explain_field(game, "game-balance", "iron_sword", "price")
    assert (x.display, x.expression, x.dependencies, x.affected) == ("120", None, [], [("shop.matches_for_sword", "2.4")])
    assert explain_formula(game, "game-balance", "shop", "upgrade_cost") == {"field": "shop.upgrade_cost", "expression": "[tempered_blade.price]", "value": 200.0, "dependencies": ["tempered_blade.price"]}
    told = describe_documents(game).first()
    assert [s["id"] for s in told["schemas"]] == ["characters", "economy", "items", "weapons"] and told["entities"][0]["fields"] == ["level", "name", "weapon"]


def test_edits(spark, game):
    doc = "game-balance"
    buffed = W.set_scalar(game, doc, "iron_sword", "damage", "45")
    assert [(r["kind"], r["k2"]) for r in in_order(buffed.changes).collect()] == [("FieldChanged", "damage"), ("FormulaImpact", "dps")]
    assert render(buffed.changes, buffed.before, buffed.after).first()["text"] == "Weapons Iron Sword\ndamage: 36 -> 45\naffected dps: 40 -> 50\n"
    copy = W.duplicated(game, doc, "iron_sword", "steel")
    assert [n["e"] for n in copy.cells.where("entity = 'steel' and field = 'dps'").first()["expr"]] == ["steel", "steel", None]
    turned = W.renamed(game, doc, "iron_sword", "steel")
    assert turned.cells.where("ref = 'iron_sword' or entity = 'iron_sword' or exists(expr, n -> n.e = 'iron_sword')").isEmpty() and findings_of(turned) == []
    assert findings_of(W.removed(game, doc, "shop")) == []


@pytest.mark.parametrize(("edit", "kind", "message"), [
    (lambda g, d: W.remove_entity(g, d, "iron_sword"), "EntityReferenced", "cannot remove entity 'iron_sword' because it is referenced by alric.weapon, shop.matches_for_sword, tempered_blade.grants_weapon"),
    (lambda g, d: W.remove_entity(g, d, "gone"), "MissingEntity", "entity 'gone' does not exist"),
    (lambda g, d: W.set_scalar(g, d, "iron_sword", "gone", "1"), "MissingField", "field 'iron_sword.gone' does not exist"),
    (lambda g, d: W.set_scalar(g, d, "iron_sword", "dps", "3"), "FormulaEdit", "field 'iron_sword.dps' is a formula; edit its inputs instead"),
    (lambda g, d: W.set_scalar(g, d, "iron_sword", "damage", " 3"), "InvalidValue", "' 3' is not a valid number value for 'iron_sword.damage'"),
    (lambda g, d: W.set_scalar(g, d, "iron_sword", "damage", "inf"), "InvalidValue", "'inf' is not a valid finite number value for 'iron_sword.damage'"),
    (lambda g, d: W.set_scalar(g, d, "iron_sword", "damage", "36.0"), "NoChange", "'iron_sword.damage' already has that value"),
    (lambda g, d: W.set_scalar(g, d, "iron_sword", "attack_interval", "0"), "Calculation", "could not calculate document: formula 'iron_sword.dps' divided by zero"),
    (lambda g, d: W.set_scalar(g, d, "alric", "weapon", "shop"), "InvalidDocument", "edit would make the document invalid: entities.alric.fields.weapon: field 'weapon' expects a reference to schema 'weapons', but 'shop' uses schema 'economy'"),
    (lambda g, d: W.set_formula(g, d, "alric", "name", "1"), "NonNumericFormulaField", "field 'alric.name' is not numeric; formulas require a numeric field"),
    (lambda g, d: W.set_formula(g, d, "iron_sword", "dps", "1+"), "InvalidFormula", "invalid formula for 'iron_sword.dps': formula parse error at byte 2: expected expression"),
    (lambda g, d: W.set_formula(g, d, "iron_sword", "dps", "[iron_sword.damage]/[iron_sword.attack_interval]"), "NoChange", "'iron_sword.dps' already has that value"),
    (lambda g, d: W.rename_entity(g, d, "gone", "gone"), "NoOpEntityRename", "cannot rename entity 'gone' to itself"),
    (lambda g, d: W.rename_entity(g, d, "shop", "Shop"), "InvalidEntityIdentifier", "entity id 'Shop' is not a valid semantic identifier"),
    (lambda g, d: W.duplicate_entity(g, d, "shop", "alric"), "EntityAlreadyExists", "entity 'alric' already exists"),
])
def test_refused_edits(game, edit, kind, message):
    with pytest.raises(W.EditError) as e:
        edit(game, "game-balance")
    assert (e.value.kind, str(e.value)) == (kind, message)


def test_suggestions(game):
    ask = lambda e, f, v: suggest_field_change(game, "game-balance", e, f, v)
    for (e, f, v), kind in {
        ("gone", "x", number(1)): "MissingEntity", ("shop", "x", number(1)): "MissingField", ("iron_sword", "dps", number(1)): "FormulaEdit",
        ("iron_sword", "damage", number(36)): "NoChange", ("iron_sword", "damage", text("36")): "TypeMismatch", ("iron_sword", "damage", formula("[iron_sword.dps]")): "Calculation",
    }.items():
        with pytest.raises(SuggestionError) as x:
            ask(e, f, v)
        assert x.value.kind == kind
    assert ask("iron_sword", "damage", number(40))["requires_approval"] is True


def weapon(**cells):
    base = {"damage": number(100), "interval": number(1.25), "dps": formula("[sword.damage] / [sword.interval]"), "name": text("Sword")}
    return {k: v for k, v in (base | cells).items() if v is not None}


def test_changes(spark):
    schema = {"weapon": {"damage": field("number"), "interval": field("number"), "dps": field("number"), "name": field("text"), "rarity": field("text", False)}}
    base = document({"sword": ("weapon", weapon())}, schema)
    other = document({"sword": ("weapon", weapon(damage=number(120), rarity=text("rare"))), "axe": ("weapon", weapon(name=text("Axe"), dps=number(1)))}, schema, id_="doc2", title='T"')
    other["schemas"]["weapon"]["fields"]["rarity"]["required"] = True
    other["schemas"]["marker"] = {"id": "marker", "fields": {}}
    zero = document({"sword": ("weapon", weapon(damage=number(-0.0), interval=number(1)))}, schema)
    minus = document({"sword": ("weapon", weapon(damage=number(0.0), interval=number(1)))}, schema)
    before, after = from_python(spark, {"a": base, "same": base, "zero": zero}), from_python(spark, {"a": other, "same": base, "zero": minus})
    changes = semantic_diff(before, after)
    texts = {r["doc"]: r["text"] for r in render(changes, before, after).collect()}
    assert texts["same"] == "No semantic changes.\n"
    # 0.0 and -0.0 are equal as stored values, but not as derived ones
    assert texts["zero"] == "Weapon Sword\naffected dps: -0 -> 0\n"
    assert texts["a"] == (
        'Document\nid: doc -> doc2\ntitle: "Doc" -> "T\\""\n\nSchema marker\nschema added\n\nSchema weapon\nrarity: text (optional) -> text (required)\n\n'
        'Weapon Axe\nentity added\n\nWeapon Sword\ndamage: 100 -> 120\nrarity added: "rare"\naffected dps: 80 -> 96\n'
    )
    rows = [(r["kind"], r["k1"], r["k2"]) for r in in_order(changes.where("doc = 'a'")).collect()]
    assert rows == [("DocumentIdChanged", None, None), ("DocumentTitleChanged", None, None), ("SchemaAdded", "marker", None), ("SchemaFieldChanged", "weapon", "rarity"), ("EntityAdded", "axe", None), ("FieldChanged", "sword", "damage"), ("FieldAdded", "sword", "rarity"), ("FormulaImpact", "sword", "dps")]


def naive_merge(b: dict, o: dict, t: dict):
    """(merged, conflict paths) of three documents."""
    bad = []

    def choose(path, x, y, z):
        if y == z or z == x:
            return y
        if y == x:
            return z
        bad.append(path)
        return None

    out = {"id": choose("id", b["id"], o["id"], t["id"]), "title": choose("title", b["title"], o["title"], t["title"]), "schemas": {}, "entities": {}}
    for kind, extra in (("schemas", ()), ("entities", ("schema",))):
        for k in {*b[kind], *o[kind], *t[kind]}:
            sides = [d[kind].get(k) for d in (b, o, t)]
            if None in sides:
                whole = choose(f"{kind}.{k}", *sides)
            else:
                whole = {x: choose(f"{kind}.{k}.{x}", *(s[x] for s in sides)) for x in ("id", *extra)}
                fields = {f: choose(f"{kind}.{k}.fields.{f}", *(s["fields"].get(f) for s in sides)) for f in {f for s in sides for f in s["fields"]}}
                whole["fields"] = {f: x for f, x in fields.items() if x is not None}
            if whole is not None:
                out[kind][k] = whole
    return out, sorted(bad)


def mutate(r: random.Random, d: dict) -> dict:
    import copy

    d = copy.deepcopy(d)
    for _ in range(r.randint(0, 4)):
        what = r.randrange(7)
        e = r.choice(sorted(d["entities"])) if d["entities"] else None
        if what == 0:
            d["title"] = r.choice(["A", "B"])
        elif what == 1 and e:
            d["entities"].pop(e)
        elif what == 2:
            d["entities"][r.choice(["new", "newer"])] = {"id": "new", "schema": "s", "fields": {"a": number(r.randint(1, 2))}}
        elif what == 3 and e:
            d["entities"][e]["fields"].pop(r.choice("abct"), None)
        elif what == 4 and e:
            d["entities"][e]["fields"][r.choice("abc")] = r.choice([number(r.randint(1, 3)), formula("1 + 2"), formula("1 + 3")])
        elif what == 5:
            d["schemas"]["s"]["fields"][r.choice(["a", "q"])] = field("number", r.random() < 0.5)
        elif what == 6:
            d["schemas"][r.choice(["u", "v"])] = {"id": "u", "fields": {"x": field(r.choice(["text", "number"]))}}
    return d


def test_merges_agree_with_naive(spark):
    r = random.Random(3)
    triples = {}
    for i in range(50):
        base = random_document(r)
        triples[f"m{i}"] = (base, mutate(r, base), mutate(r, base))
    sets = [from_python(spark, {k: v[j] for k, v in triples.items()}) for j in range(3)]
    out = merge_parts(*sets)
    conflicts: dict = {}
    for row in out.conflicts.collect():
        conflicts.setdefault(row["doc"], []).append(row["path"])
    clean = 0
    for name, three in triples.items():
        merged, bad = naive_merge(*three)
        assert sorted(conflicts.get(name, [])) == bad, name
        clean += not bad
    assert 5 < clean < 50
    some = [n for n, three in triples.items() if not naive_merge(*three)[1]][:4]
    for name in some:
        got, want = to_python(out.merged, name), naive_merge(*triples[name])[0]
        assert got == want, name


def test_merge_gates(spark, game):
    doc = "game-balance"
    ours = game.with_(cells=W.with_cell(game, doc, "iron_sword", "damage", number(45)).cells)
    theirs = game.with_(cells=W.with_cell(game, doc, "iron_sword", "damage", number(50)).cells)
    rows = merge(game, ours, theirs).conflicts.collect()
    assert [(r["path"], conflict_side_text(r["kind"], r["ours"])) for r in rows] == [("entities.iron_sword.fields.damage", "Some(FieldValue(Number(45.0)))")]
    broken = game.with_(cells=W.with_cell(game, doc, "iron_sword", "attack_interval", number(0)).cells)
    with pytest.raises(MergeError, match="could not calculate Ours input: formula 'iron_sword.dps' divided by zero"):
        merge(game, broken, theirs)


def test_empty_set(spark):
    from docloom.model import empty_set

    docs = empty_set(spark)
    assert sorted_findings(validate(docs)).count() == 0
    assert calculate(docs).values.count() == 0 and calculate(docs).first_errors().count() == 0
    assert semantic_diff(docs, docs).count() == 0
    assert docs.documents.select(F.count("doc")).first()[0] == 0
