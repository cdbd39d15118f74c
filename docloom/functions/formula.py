"""The formula language: text to expression, expression to canonical text, and limits.

An expression is a tuple: ("number", x), ("reference", entity, field), or (operator, left, right) with
an operator of OPERATORS. In tables it is a postfix array of structs (see to_postfix).

Grammar: numbers, [entity.field], + - * / (left to right, * and / first), unary + and -, parentheses,
min(a, b) and max(a, b). Positions in errors count UTF-8 bytes.
"""

from __future__ import annotations

import math
import re

from .numbers import formula_text

MAX_BYTES, MAX_NODES, MAX_DEPTH = 4096, 256, 64
OPERATORS = ("add", "subtract", "multiply", "divide", "minimum", "maximum")
IDENTIFIER = re.compile(r"[a-z0-9][a-z0-9_-]*")
_BINARY = {b"+": ("add", 1), b"-": ("subtract", 1), b"*": ("multiply", 2), b"/": ("divide", 2)}
_SYMBOL = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}
_CALLS = {b"min": "minimum", b"max": "maximum"}
_SPACE = re.compile(rb"[ \t\n\x0c\r]*")
_NUMBER = re.compile(rb"([0-9]*)(\.?)([0-9]*)")
_EXPONENT = re.compile(rb"[eE][+-]?")
_DIGITS = re.compile(rb"[0-9]+")
_NAME = re.compile(rb"[A-Za-z][A-Za-z0-9_]*")


def is_identifier(text: str) -> bool:
    return IDENTIFIER.fullmatch(text) is not None


class FormulaError(ValueError):
    """A text that is no formula: the byte where that shows, and why."""

    def __init__(self, position: int, message: str):
        super().__init__(f"formula parse error at byte {position}: {message}")
        self.position, self.message = position, message


class ComplexityError(ValueError):
    """An expression beyond the limits."""


class _Reading:
    """Operator-precedence reading of one text."""

    def __init__(self, data: bytes):
        self.data, self.at, self.nodes, self.depth = data, 0, 0, 0

    def skip(self) -> bytes:
        self.at = _SPACE.match(self.data, self.at).end()
        return self.data[self.at : self.at + 1]

    def need(self, byte: bytes, message: str) -> None:
        if self.skip() != byte:
            raise FormulaError(self.at, message)
        self.at += 1

    def node(self, position: int) -> None:
        if self.nodes == MAX_NODES:
            raise FormulaError(position, f"expression exceeds {MAX_NODES}-node limit")
        self.nodes += 1

    def nested(self, position: int, read):
        if self.depth == MAX_DEPTH:
            raise FormulaError(position, f"expression exceeds {MAX_DEPTH}-nesting limit")
        self.depth += 1
        out = read()
        self.depth -= 1
        return out

    def expression(self, least: int = 1) -> tuple:
        left = self.operand()
        while (found := _BINARY.get(self.skip())) and found[1] >= least:
            self.node(self.at)
            self.at += 1
            left = (found[0], left, self.expression(found[1] + 1))
        return left

    def operand(self) -> tuple:
        first = self.skip()
        start = self.at
        if not first:
            raise FormulaError(start, "expected expression")
        if first in b"+-":
            self.at += 1
            inner = self.nested(start, self.operand)
            if first == b"+":
                return inner
            if inner[0] == "number":
                return ("number", -inner[1])
            self.node(start)
            self.node(start)
            return ("subtract", ("number", 0.0), inner)
        if first == b"(":
            self.at += 1
            return self.nested(start, lambda: self.closed(self.expression, b")", "expected ')' after expression"))
        if first == b"[":
            return self.reference()
        if first.isdigit() or first == b".":
            return self.number()
        if first.isalpha():
            return self.call()
        raise FormulaError(start, "expected number, reference, function, or '('")

    def closed(self, read, byte: bytes, message: str) -> tuple:
        out = read()
        self.need(byte, message)
        return out

    def number(self) -> tuple:
        start = self.at
        m = _NUMBER.match(self.data, start)
        if not m[1] and not m[3]:
            raise FormulaError(start, "expected digits in numeric literal")
        self.at = m.end()
        if e := _EXPONENT.match(self.data, self.at):
            d = _DIGITS.match(self.data, e.end())
            if not d:
                raise FormulaError(e.end(), "expected exponent digits")
            self.at = d.end()
        x = float(self.data[start : self.at])
        if math.isinf(x):
            raise FormulaError(start, "numeric literal must be finite")
        self.node(start)
        return ("number", x)

    def reference(self) -> tuple:
        start = self.at
        close = self.data.find(b"]", start)
        if close < 0:
            raise FormulaError(len(self.data), "expected ']' after reference")
        parts = self.data[start + 1 : close].split(b".")
        if len(parts) != 2:
            raise FormulaError(close if len(parts) == 1 else start + 2 + len(parts[0]) + len(parts[1]), "reference must contain exactly one '.'")
        begin = start + 1
        for kind, part in zip(("entity", "field"), parts, strict=True):
            good = re.match(rb"[a-z0-9][a-z0-9_-]*", part)
            if not good or good.end() < len(part):
                raise FormulaError(begin + (good.end() if good else 0), f"invalid reference {kind} identifier")
            begin += len(part) + 1
        self.at = close + 1
        self.node(start)
        return ("reference", parts[0].decode(), parts[1].decode())

    def call(self) -> tuple:
        start = self.at
        name = _NAME.match(self.data, start)[0]
        if name not in _CALLS:
            raise FormulaError(start, f"unknown function '{name.decode()}'; expected min or max")
        self.at += len(name)
        self.skip()
        opened = self.at
        self.need(b"(", "expected '(' after function name")
        self.node(start)

        def arguments():
            left = self.closed(self.expression, b",", "expected ',' between function arguments")
            return (_CALLS[name], left, self.closed(self.expression, b")", "expected ')' after function arguments"))

        return self.nested(opened, arguments)


def parse(text: str) -> tuple:
    """The expression of a text; FormulaError where there is none or a limit is passed."""
    data = text.encode()
    if len(data) > MAX_BYTES:
        raise FormulaError(MAX_BYTES, f"expression exceeds {MAX_BYTES}-byte limit")
    reading = _Reading(data)
    out = reading.expression()
    if reading.skip():
        raise FormulaError(reading.at, "unexpected trailing content")
    try:
        check_complexity(out)
    except ComplexityError as e:
        raise FormulaError(len(data), str(e)) from e
    return out


def check_complexity(expression: tuple) -> None:
    """ComplexityError for more than 256 nodes, a depth over 64 or canonical text over 4096 bytes, tested in
    depth-first order, left before right; depth and nodes before bytes."""
    nodes, size, waiting = 0, 0, [(expression, 1)]
    while waiting:
        x, depth = waiting.pop()
        if depth > MAX_DEPTH:
            raise ComplexityError(f"expression exceeds {MAX_DEPTH}-depth limit")
        nodes += 1
        if nodes > MAX_NODES:
            raise ComplexityError(f"expression exceeds {MAX_NODES}-node limit")
        if x[0] in OPERATORS:
            size += 5 if x[0] in _SYMBOL else 7
            waiting += [(x[2], depth + 1), (x[1], depth + 1)]
        else:
            size += len(to_text(x).encode())
    if size > MAX_BYTES:
        raise ComplexityError(f"canonical expression exceeds {MAX_BYTES}-byte limit")


def to_text(expression: tuple) -> str:
    """Canonical text, with all parentheses."""
    return postfix_text(to_postfix(expression))


def to_postfix(expression: tuple) -> list[dict]:
    """Nodes in evaluation order: {op, num, e, f}."""
    out, waiting = [], [expression]
    while waiting:
        x = waiting.pop()
        if x[0] == "number":
            out.append({"op": "number", "num": x[1], "e": None, "f": None})
        elif x[0] == "reference":
            out.append({"op": "reference", "num": None, "e": x[1], "f": x[2]})
        else:
            out.append({"op": x[0], "num": None, "e": None, "f": None})
            waiting += [x[1], x[2]]
    return out[::-1]


def from_postfix(nodes) -> tuple:
    stack: list[tuple] = []
    for n in nodes:
        op = n["op"]
        if op == "number":
            stack.append(("number", n["num"]))
        elif op == "reference":
            stack.append(("reference", n["e"], n["f"]))
        else:
            right = stack.pop()
            stack.append((op, stack.pop(), right))
    return stack.pop()


def postfix_text(nodes) -> str:
    stack: list[str] = []
    for n in nodes:
        op = n["op"]
        if op == "number":
            stack.append(formula_text(n["num"]))
        elif op == "reference":
            stack.append(f"[{n['e']}.{n['f']}]")
        else:
            right, left = stack.pop(), stack.pop()
            stack.append(f"({left} {_SYMBOL[op]} {right})" if op in _SYMBOL else f"{op[:3]}({left}, {right})")
    return stack.pop()
