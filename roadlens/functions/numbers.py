"""Number expressions with one meaning in every SQL dialect."""

from __future__ import annotations


def rounded(expression: str, digits: int = 4) -> str:
    """Half up on the double itself: engines differ in what `round` does with halves."""
    return f"(floor(({expression}) * 1e{digits} + 5e-1) / 1e{digits})"


def clamp(expression: str, low: str, high: str) -> str:
    """NULL stays NULL, where greatest and least would skip it."""
    return f"(CASE WHEN ({expression}) IS NULL THEN NULL ELSE greatest({low}, least({high}, {expression})) END)"


def ratio(a: str, b: str, default: str = "NULL") -> str:
    """a / b, or default where b is 0."""
    return f"(CASE WHEN ({b}) = 0 THEN {default} ELSE ({a}) / ({b}) END)"


def bands(value: str, steps: list[tuple[str, str]], default: str) -> str:
    """CASE over `value` with conditions such as '> 5', the first that holds."""
    return "(CASE " + " ".join(f"WHEN {value} {test} THEN {out}" for test, out in steps) + f" ELSE {default} END)"
