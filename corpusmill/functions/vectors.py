"""Vector functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

lit = F.lit


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """L2-normalized; a zero vector stays zero."""
    n = F.greatest(norm(v), lit(1e-12))
    return F.transform(v, lambda x: x / n)


def mean_of(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def view(kind: str, source: Column, target: Column) -> Column:
    """Input, output or averaged embedding."""
    if kind not in ("input", "output", "average"):
        raise ValueError(f"unknown embedding view: {kind}")
    return {"input": source, "output": target}.get(kind, mean_of(source, target) if kind == "average" else None)
