"""Softmax, argmax and losses over array columns, inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def softmax(logits: Column) -> Column:
    """Probabilities of an array<double>; shifted by the maximum, so large logits do not overflow."""
    shifted = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    return F.transform(shifted, lambda v: v / total(shifted))


def argmax(x: Column) -> Column:
    """Index of the maximum; the first one on ties."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def top_probability(logits: Column) -> Column:
    """The largest softmax probability: 1 / sum(exp(v - max))."""
    return F.lit(1.0) / F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(logits)))


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax(logits)[label]."""
    top = F.array_max(logits)
    spread = F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return top + F.ln(spread) - F.get(logits, label.cast("int"))


def linear(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """weights @ x + bias as an array."""
    rows = [F.aggregate(F.zip_with(x, F.lit(list(w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.lit(float(b)) for w, b in zip(weights, bias, strict=True)]
    return F.array(*rows)
