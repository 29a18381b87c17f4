"""Impurity and gain as SQL expressions over class counts.

The arguments are SQL expressions (mostly column names) and so are the results;
use them with ``F.expr`` or ``selectExpr``.
"""

from __future__ import annotations

# Fixed value: the smallest double, the gain of a cut that must not be taken.
INVALID_GAIN = "-1.7976931348623157E308D"
LARGEST = "1.7976931348623157E308D"


def total(counts: list[str]) -> str:
    return "(" + " + ".join(counts) + ")"


def gini(counts: list[str]) -> str:
    n = total(counts)
    squares = total([f"{c} * {c}" for c in counts])
    return f"(CASE WHEN {n} = 0 THEN 0D ELSE 1D - {squares} / ({n} * {n}) END)"


def entropy(counts: list[str]) -> str:
    n = total(counts)
    parts = total([f"(CASE WHEN {c} = 0 THEN 0D ELSE -({c} / {n}) * log2({c} / {n}) END)" for c in counts])
    return f"(CASE WHEN {n} = 0 THEN 0D ELSE {parts} END)"


def variance(count: str, sum_: str, sum_squares: str) -> str:
    return f"(CASE WHEN {count} = 0 THEN 0D ELSE ({sum_squares} - {sum_} * {sum_} / {count}) / {count} END)"


IMPURITY = {"gini": gini, "entropy": entropy}


def split_gain(parent: list[str], left: list[str], impurity: str = "gini",
               min_instances: int = 1, min_info_gain: float = 1e-6) -> str:
    """Gain of a cut; an invalid cut gets the smallest double."""
    measure = IMPURITY[impurity]
    right = [f"({p} - {l})" for p, l in zip(parent, left)]
    n, n_left, n_right = total(parent), total(left), total(right)
    gain = f"({measure(parent)} - {n_left} / {n} * {measure(left)} - {n_right} / {n} * {measure(right)})"
    return (f"(CASE WHEN {n_left} >= {min_instances} AND {n_right} >= {min_instances} "
            f"AND {gain} >= {min_info_gain!r}D THEN {gain} ELSE {INVALID_GAIN} END)")
