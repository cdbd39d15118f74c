"""Spellings of binary64 numbers: plain, scientific, formula text, overview text, JSON and debug."""

from __future__ import annotations

import math
from decimal import Decimal


def _digits(x: float) -> tuple[str, str, int]:
    """Sign, shortest round-trip digits without outer zeros, and the power of ten of the first digit."""
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    stripped = text.rstrip("0")
    if not stripped:
        return "-" if sign else "", "0", 0
    return "-" if sign else "", stripped, exponent + len(text) - 1


def plain(x: float) -> str:
    """No exponent ever: 40, 56.25, -0."""
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "inf" if x > 0 else "-inf"
    sign, digits, power = _digits(x)
    if power < 0:
        return f"{sign}0.{'0' * (-power - 1)}{digits}"
    whole, rest = digits[: power + 1].ljust(power + 1, "0"), digits[power + 1 :]
    return f"{sign}{whole}.{rest}" if rest else f"{sign}{whole}"


def scientific(x: float) -> str:
    """One digit, a point if more follow, and the power: 4e1, 5.625e1, 0e0."""
    if not math.isfinite(x):
        return plain(x)
    sign, digits, power = _digits(x)
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{power}"


def formula_text(x: float) -> str:
    """The shorter of plain and scientific; plain if they tie."""
    a, b = plain(x), scientific(x)
    return b if len(b) < len(a) else a


def overview_text(x: float) -> str:
    """Whole numbers without a fraction, others plainly."""
    return plain(x)


def json_text(x: float) -> str:
    """Always a fraction or an exponent: 50.0, 0.00001, 1e-6, 1e16."""
    sign, digits, power = _digits(x)
    if -5 <= power < 16:
        text = plain(x)
        return text if "." in text else f"{text}.0"
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{power}"


def debug_text(x: float) -> str:
    """As json_text, but with exponents from below 1e-4 on."""
    if not math.isfinite(x):
        return plain(x)
    _, digits, power = _digits(x)
    if digits != "0" and (power < -5 or power >= 16):
        return scientific(x)
    text = plain(x)
    return text if "." in text else f"{text}.0"


def debug_string(s: str) -> str:
    """A string in double quotes, with escapes."""
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}
    return '"' + "".join(named.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in s) + '"'
