"""Formulas as Columns: compiled to expressions, or run over the postfix array row by row in the JVM.

A result is a struct (value, code, at_entity, at_field). code is null for success; otherwise it names the
first failure from left to right, and at_ the cell it is about. Every operation is one binary64 operation
with a finite check after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import is_finite
from .formula import parse

RESULT = "struct<value:double,code:string,at_entity:string,at_field:string>"
MISSING, NOT_NUMERIC, ZERO, CYCLE, NOT_FINITE = "MissingReference", "NonNumericReference", "DivisionByZero", "Cycle", "NonFiniteResult"


def good(value: Column) -> Column:
    return F.struct(value.alias("value"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("at_entity"), F.lit(None).cast("string").alias("at_field"))


def bad(code: Column | str, entity: Column, field: Column) -> Column:
    return F.struct(F.lit(None).cast("double").alias("value"), (F.lit(code) if isinstance(code, str) else code).alias("code"), entity.alias("at_entity"), field.alias("at_field"))


def operate(op: Column | str, a: Column, b: Column) -> Column:
    """One operation; null for a division by zero."""
    table = {"add": a + b, "subtract": a - b, "multiply": a * b, "divide": F.try_divide(a, b), "minimum": F.least(a, b), "maximum": F.greatest(a, b)}
    if isinstance(op, str):
        return table[op]
    out = None
    for name, x in table.items():
        out = F.when(op == name, x) if out is None else out.when(op == name, x)
    return out


def compile_expression(expression: tuple, slot: Callable[[str, str], Column]) -> tuple[Column, Column]:
    """(value, failure code) Columns of one expression; slot gives a reference's Column. Left failures come first."""
    if expression[0] == "number":
        return F.lit(float(expression[1])), F.lit(None).cast("string")
    if expression[0] == "reference":
        x = slot(expression[1], expression[2])
        return x, F.when(x.isNull(), F.lit(MISSING)).when(~is_finite(x), F.lit(NOT_FINITE))
    (a, fail_a), (b, fail_b) = (compile_expression(x, slot) for x in expression[1:])
    x = operate(expression[0], a, b)
    fail = F.coalesce(fail_a, fail_b, F.when(b == 0, F.lit(ZERO)) if expression[0] == "divide" else F.lit(None).cast("string"), F.when(~is_finite(x), F.lit(NOT_FINITE)))
    return x, fail


def formula_columns(text: str, slots: dict[str, Column]) -> tuple[Column, Column]:
    """(value, failure code) of a formula text over rows: slots maps "entity.field" to Columns. value is null on failure."""
    value, fail = compile_expression(parse(text), lambda e, f: slots[f"{e}.{f}"].cast("double"))
    return F.when(fail.isNull(), value), fail


def run_postfix(expr: Column, found: Column, entity: Column, field: Column) -> Column:
    """The result of a postfix array; found maps struct(e, f) to the results of the cells referred to."""
    none = F.lit(None).cast("string")

    def state(stack, code=none, e=none, f=none):
        return F.struct(stack.alias("stack"), code.alias("code"), e.alias("e"), f.alias("f"))

    def step(acc, n):
        size = F.size(acc.stack)
        a, b = F.get(acc.stack, size - 2), F.get(acc.stack, size - 1)
        ref = F.element_at(found, F.struct(n.e.alias("e"), n.f.alias("f")))
        x = operate(n.op, a, b)
        rest = F.slice(acc.stack, 1, F.greatest(size - 2, F.lit(0)))
        return (
            F.when(acc.code.isNotNull(), acc)
            .when(n.op == "number", F.when(is_finite(n.num), state(F.concat(acc.stack, F.array(n.num)))).otherwise(state(acc.stack, F.lit(NOT_FINITE), entity, field)))
            .when(n.op == "reference", F.when(ref.code.isNull(), state(F.concat(acc.stack, F.array(ref.value)))).otherwise(state(acc.stack, ref.code, ref.at_entity, ref.at_field)))
            .when((n.op == "divide") & (b == 0), state(acc.stack, F.lit(ZERO), entity, field))
            .when(~is_finite(x), state(acc.stack, F.lit(NOT_FINITE), entity, field))
            .otherwise(state(F.concat(rest, F.array(x))))
        )

    def finish(acc):
        return F.when(acc.code.isNull(), good(F.get(acc.stack, F.lit(0)))).otherwise(bad(acc.code, acc.e, acc.f))

    return F.aggregate(expr, state(F.array().cast("array<double>")), step, finish)
