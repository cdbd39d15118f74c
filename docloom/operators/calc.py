"""Evaluation of all numbers and formulas.

A document of at most WHOLE cells is evaluated by one task, in topological order; a larger one level by level: a formula
is evaluated once all cells that it refers to have a result, each level one join and one aggregation in the JVM, until
at most WHOLE of its formulas are left, which one task finishes. Both give the same results. Failures are rows. What
never becomes ready is a cycle, or depends on one. The serial semantics (the first failure in depth-first order of the
fields) are found for each document that fails: from the results where they tell, and by replaying the unresolved rest
where a cycle is in reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CYCLE, MISSING, NOT_FINITE, NOT_NUMERIC, RESULT, ZERO, bad, good, run_postfix
from ..model import EXPR, DocumentSet, is_finite
from ..session import settle, ship
from .graph import edges as edges_of

KEY = ["doc", "entity", "field"]
#: Cells of a document that one task evaluates whole.
WHOLE = 1 << 16
SOLVED = f"doc string, entity string, field string, expr {EXPR}, result {RESULT}"
ERROR = "doc string, code string, at_entity string, at_field string, path array<string>"


class CalculationError(ValueError):
    def __init__(self, code: str, at: str, path: list[str] | None = None):
        said = {
            MISSING: f"formula reference '{at}' does not exist",
            NOT_NUMERIC: f"formula reference '{at}' is not numeric",
            "DivisionByZero": f"formula '{at}' divided by zero",
            CYCLE: "formula dependency cycle: [" + ", ".join('FieldRef {{ entity: EntityId("{}"), field: FieldId("{}") }}'.format(*p.split(".")) for p in path or ()) + "]",
            NOT_FINITE: f"calculation for '{at}' produced a non-finite result",
        }
        super().__init__(said[code])
        self.code, self.at, self.path = code, at, path


@dataclass(frozen=True)
class Calculation:
    """results: doc, entity, field, kind, result of all numeric cells that were evaluated; unresolved: formulas that weren't."""

    docs: DocumentSet
    edges: DataFrame
    results: DataFrame
    unresolved: DataFrame

    @property
    def values(self) -> DataFrame:
        return self.results.where("result.code is null").select(*KEY, F.col("result.value").alias("value"))

    @property
    def failures(self) -> DataFrame:
        failed = self.results.where("result.code is not null").select(*KEY, "result.code", "result.at_entity", "result.at_field")
        return failed.unionAll(self.unresolved.select(*KEY, F.lit(CYCLE), "entity", "field"))

    def first_errors(self) -> DataFrame:
        """Of each document that fails: what a serial evaluation in order of entity and field would stop at."""
        failed = self.failures
        first = failed.groupBy("doc").agg(F.min_by(F.struct("code", "at_entity", "at_field", "entity", "field"), F.struct("entity", "field")).alias("x")).select("doc", "x.*")
        plain = first.where(F.col("code") != CYCLE).select("doc", "code", "at_entity", "at_field", F.lit(None).cast("array<string>").alias("path"))
        rest = self.unresolved.join(first.where(F.col("code") == CYCLE).select("doc", F.col("entity").alias("root_entity"), F.col("field").alias("root_field")), "doc")
        if rest.isEmpty():
            return plain
        ship(self.docs.spark)
        known = self.results.select("doc", F.col("entity").alias("dep_entity"), F.col("field").alias("dep_field"), "result")
        # the operands of an unresolved formula in their order, with what is known of them
        ops = rest.select("doc", "entity", "field", "root_entity", "root_field", F.posexplode("expr").alias("i", "n"))
        told = ops.select("doc", "entity", "field", "root_entity", "root_field", "i", "n.op", "n.num", F.col("n.e").alias("dep_entity"), F.col("n.f").alias("dep_field")).join(_leaves(self.docs, known), ["doc", "dep_entity", "dep_field"], "left")
        flat = told.select("doc", "entity", "field", "root_entity", "root_field", "i", "op", "num", "dep_entity", "dep_field", "result.value", "result.code", "result.at_entity", "result.at_field")
        return plain.unionAll(flat.groupBy("doc").applyInPandas(_replay, ERROR))

    def check(self, doc: str | None = None) -> None:
        """Raise the first error, of one document or of any."""
        errors = self.first_errors()
        row = (errors if doc is None else errors.where(F.col("doc") == doc)).orderBy("doc").first()
        if row:
            raise CalculationError(row["code"], f"{row['at_entity']}.{row['at_field']}", row["path"])


def error_text(errors: DataFrame) -> DataFrame:
    """doc, path, code, message of first errors, in the words of CalculationError."""
    ship(errors.sparkSession)

    @F.pandas_udf("string")
    def say(x: pd.DataFrame) -> pd.Series:
        return pd.Series([str(CalculationError(c, at, None if p is None else list(p))) for c, at, p in zip(x["code"], x["path"], x["trail"], strict=True)], dtype=object)

    named = errors.select("doc", F.concat_ws(".", "at_entity", "at_field").alias("path"), "code", F.col("path").alias("trail"))
    return named.select("doc", "path", "code", say(F.struct("path", "code", "trail")).alias("message"))


def _leaves(docs: DocumentSet, known: DataFrame) -> DataFrame:
    """Results of cells that are no numbers, beside the known ones."""
    other = docs.cells.where("kind not in ('number', 'formula')").select("doc", F.col("entity").alias("dep_entity"), F.col("field").alias("dep_field"), bad(NOT_NUMERIC, F.col("entity"), F.col("field")).alias("result"))
    return known.unionAll(other)


def _replay(rows: pd.DataFrame) -> pd.DataFrame:
    """Depth-first evaluation of a document's unresolved formulas from its first root, iterative over references."""
    from ..functions.columns import CYCLE, MISSING, NOT_FINITE

    doc, root = rows["doc"].iloc[0], (rows["root_entity"].iloc[0], rows["root_field"].iloc[0])
    nodes = {k: g.sort_values("i").to_dict("records") for k, g in rows.groupby(["entity", "field"])}

    def stop(code, at, path=None):
        return pd.DataFrame([{"doc": doc, "code": code, "at_entity": at[0], "at_field": at[1], "path": path}])

    import math

    done: dict[tuple, float] = {}
    trail, frames = [root], [[0, []]]
    while trail:
        here, (i, stack) = trail[-1], frames[-1]
        if i == len(nodes[here]):
            done[here] = stack[-1]
            trail.pop()
            frames.pop()
            continue
        n = nodes[here][i]
        op = n["op"]
        if op == "reference":
            dep = (n["dep_entity"], n["dep_field"])
            if dep in nodes and dep not in done:
                if dep in trail:
                    path = [*trail[trail.index(dep) :], dep]
                    return stop(CYCLE, dep, [".".join(p) for p in path])
                trail.append(dep)
                frames.append([0, []])
                continue
            if dep in done:
                x = done[dep]
            elif n["code"] is not None and not (isinstance(n["code"], float) and math.isnan(n["code"])):
                return stop(n["code"], (n["at_entity"], n["at_field"]))
            elif n["value"] is None or math.isnan(n["value"]):
                return stop(MISSING, dep)
            else:
                x = n["value"]
        elif op == "number":
            x = n["num"]
        else:
            b, a = stack.pop(), stack.pop()
            if op == "divide" and b == 0:
                return stop("DivisionByZero", here)
            with_ = {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b, "divide": lambda: a / b, "minimum": lambda: min(a, b), "maximum": lambda: max(a, b)}
            x = with_[op]()
        if not math.isfinite(x):
            return stop(NOT_FINITE, here)
        stack.append(x)
        frames[-1][0] += 1
    raise AssertionError("an unresolved formula was resolved")


# --- one document in one task -------------------------------------------------------------------------


def run_python(nodes: list, found: dict, entity: str, field: str) -> tuple:
    """(value, code, at_entity, at_field) of a postfix array, as columns.run_postfix has it; found holds such results by (entity, field)."""
    stack: list[float] = []
    for n in nodes:
        op = n["op"]
        if op == "reference":
            x, *failure = found.get((n["e"], n["f"]), (None, MISSING, n["e"], n["f"]))
            if failure[0] is not None:
                return None, *failure
        elif op == "number":
            x = n["num"]
        else:
            b, a = stack.pop(), stack.pop()
            if op == "divide" and b == 0:
                return None, ZERO, entity, field
            x = a + b if op == "add" else a - b if op == "subtract" else a * b if op == "multiply" else a / b if op == "divide" else min(a, b) if op == "minimum" else max(a, b)
        if not math.isfinite(x):
            return None, NOT_FINITE, entity, field
        stack.append(x)
    return stack[0], None, None, None


def solve(formulas: dict[tuple, list], found: dict[tuple, tuple]) -> Iterator[tuple]:
    """((entity, field), result) of the formulas of a document, in topological order; found is extended. The rest is left out."""
    refs = {k: {(n["e"], n["f"]) for n in nodes if n["op"] == "reference"} for k, nodes in formulas.items()}
    waits = {k: sum(d in formulas and d not in found for d in deps) for k, deps in refs.items()}
    users: dict[tuple, list] = {}
    for k, deps in refs.items():
        for d in deps:
            if d in formulas and d not in found:
                users.setdefault(d, []).append(k)
    ready = [k for k, n in waits.items() if not n]
    while ready:
        k = ready.pop()
        found[k] = run_python(formulas[k], found, *k)
        yield k, found[k]
        for u in users.get(k, ()):
            waits[u] -= 1
            if not waits[u]:
                ready.append(u)


_NODES = pa.list_(pa.struct([("op", pa.string()), ("num", pa.float64()), ("e", pa.string()), ("f", pa.string())]))
_RESULT = pa.struct([("value", pa.float64()), ("code", pa.string()), ("at_entity", pa.string()), ("at_field", pa.string())])


def solved_whole(rows: DataFrame) -> DataFrame:
    """SOLVED of the formulas in rows, one document in one task: entity, field, num and expr (of which one is set, or neither
    for a cell that is no number), and found (what is known of other cells). Of solved formulas expr is null, of others result."""
    ship(rows.sparkSession)

    def of_document(doc: str, held: list) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple] = {}
        formulas: dict[tuple, list] = {}
        for entity, field, num, expr, known in held:
            k = (entity, field)
            if expr is not None:
                formulas[k] = expr
                found.update({(x["k"]["e"], x["k"]["f"]): tuple(x["result"].values()) for x in known or ()})
            elif num is None:
                found[k] = (None, NOT_NUMERIC, *k)
            else:
                found[k] = (num, None, None, None) if math.isfinite(num) else (None, NOT_FINITE, *k)
        out = [(k, None, dict(zip(("value", "code", "at_entity", "at_field"), r, strict=True))) for k, r in solve(formulas, found)]
        out += [(k, nodes, None) for k, nodes in formulas.items() if k not in found]
        for a in range(0, len(out), 10_000):
            keys, nodes, results = zip(*out[a : a + 10_000], strict=True)
            columns = [pa.array([doc] * len(keys)), pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(nodes, _NODES), pa.array(results, _RESULT)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "entity", "field", "expr", "result"])

    def run(batches):
        doc, held = None, []
        for batch in batches:
            docs, *others = (c.to_pylist() for c in batch.columns)
            for d, *row in zip(docs, *others, strict=True):
                if d != doc and held:
                    yield from of_document(doc, held)
                    held = []
                doc = d
                held.append(row)
        if held:
            yield from of_document(doc, held)

    return rows.select("doc", "entity", "field", "num", "expr", "found").repartition("doc").sortWithinPartitions("doc").mapInArrow(run, SOLVED)


# --- large documents, level by level -------------------------------------------------------------------

FOUND = f"array<struct<k:struct<e:string,f:string>,result:{RESULT}>>"


def _gathered(told: DataFrame) -> DataFrame:
    """A row per formula: KEY, expr, found, open (references without a result). told has a row per formula and open
    reference d: KEY, expr, found, d, and its result where there is one now."""
    d = F.col("d")
    entry = F.when(F.col("result").isNotNull(), F.struct(d.alias("k"), "result"))
    per = told.groupBy(*KEY).agg(
        F.first("expr").alias("expr"), F.first("found").alias("before"), F.collect_list(entry).alias("now"), F.collect_list(F.when(d.isNotNull() & F.col("result").isNull(), d)).alias("open")
    )
    return per.select(*KEY, "expr", F.concat("before", "now").alias("found"), "open")


def _stepped(told: DataFrame) -> DataFrame:
    """_gathered, settled, with the result where no reference is open; what only open formulas need is null elsewhere."""
    result = F.when(F.size("open") == 0, run_postfix(F.col("expr"), F.map_from_entries(F.col("found")), F.col("entity"), F.col("field")))
    # in a projection after the result's: in one with it, generated code gave null results (Spark 4.1.2)
    left = [F.when(F.col("result").isNull(), F.col(c)).alias(c) for c in ("expr", "found", "open")]
    return settle(_gathered(told).withColumn("result", result).select(*KEY, *left, "result"))


def _by_levels(cells: DataFrame) -> list[DataFrame]:
    """SOLVED of the formulas of large documents, as settled tables."""
    refs = F.array_distinct(F.transform(F.filter("expr", lambda n: n.op == "reference"), lambda n: F.struct(n.e.alias("e"), n.f.alias("f"))))
    formulas = cells.where("kind = 'formula'").select(*KEY, "expr", F.lit(None).cast(FOUND).alias("found"), F.explode_outer(refs).alias("d"))
    at = [F.col("d.e").alias("dep_entity"), F.col("d.f").alias("dep_field")]
    result = F.when(F.col("kind") == "number", _number()).when(F.col("kind") != "formula", bad(NOT_NUMERIC, F.col("entity"), F.col("field")))
    known = cells.select("doc", F.col("entity").alias("dep_entity"), F.col("field").alias("dep_field"), F.lit(True).alias("there"), result.alias("result"))
    gone = F.when(F.col("there").isNull() & F.col("d").isNotNull(), bad(MISSING, F.col("d.e"), F.col("d.f")))
    told = formulas.select("*", *at).join(known, ["doc", "dep_entity", "dep_field"], "left").withColumn("result", F.coalesce("result", gone))
    out: list[DataFrame] = []
    state = _stepped(told.withColumn("found", F.array().cast(FOUND)))
    while True:
        solved, rest = state.where("result is not null"), state.where("result is null")
        out.append(solved.select(*KEY, "expr", "result"))
        open_ = state.groupBy("doc").agg(F.count_if(F.col("result").isNull()).alias("n"), F.count_if(F.col("result").isNotNull()).alias("done"))
        most, few, done = open_.agg(F.max("n"), F.count_if((F.col("n") > 0) & (F.col("n") <= WHOLE)), F.sum("done")).first()
        if not most:
            return out
        new = solved.select("doc", F.col("entity").alias("dep_entity"), F.col("field").alias("dep_field"), "result")
        told = rest.select(*KEY, "expr", "found", F.explode("open").alias("d")).select("*", *at).join(new, ["doc", "dep_entity", "dep_field"], "left")
        if few:  # one task solves what is left of a document
            small = None if most <= WHOLE else settle(open_.where((F.col("n") > 0) & (F.col("n") <= WHOLE)).select("doc"))
            last = _gathered(told if small is None else told.join(small, "doc", "left_semi"))
            out.append(settle(solved_whole(last.withColumn("num", F.lit(None).cast("double")))))
            if small is None:
                return out
            rest, told = (t.join(small, "doc", "left_anti") for t in (rest, told))
        if not done:
            return [*out, rest.select(*KEY, "expr", "result")]
        state = _stepped(told)


def _number():
    return F.when(is_finite(F.col("num")), good(F.col("num"))).otherwise(bad(NOT_FINITE, F.col("entity"), F.col("field")))


def calculate(docs: DocumentSet) -> Calculation:
    """Results of all documents of the set."""
    cells = docs.cells.select(*KEY, "kind", "num", "expr")
    sizes = cells.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    least, most = sizes.agg(F.min("n"), F.max("n")).first()
    small, large = (cells, None) if not most or most <= WHOLE else (None, cells)
    if most and least <= WHOLE < most:
        big = settle(sizes.where(F.col("n") > WHOLE).select("doc"))
        small, large = cells.join(big, "doc", "left_anti"), cells.join(big, "doc", "left_semi")
    parts = _by_levels(large) if large is not None else []
    if small is not None:
        with_formulas = small.withColumn("found", F.lit(None).cast(FOUND))
        parts.append(settle(solved_whole(with_formulas)))
    solved = reduce(DataFrame.unionAll, parts)
    numbers = cells.where("kind = 'number'").select(*KEY, "kind", _number().alias("result"))
    results = numbers.unionAll(solved.where("result is not null").select(*KEY, F.lit("formula").alias("kind"), "result"))
    return Calculation(docs, edges_of(docs), results, solved.where("result is null").select(*KEY, "expr"))
