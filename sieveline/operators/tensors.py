"""Tensors as array columns: decoding of boxes and resampling by index arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(tensor: Column, predictions: int, values: int, transposed: Column, width: float, height: float, least: float) -> Column:
    """Boxes (i, class, score, x, y, w, h) of a detector's output whose best class
    (the first at a tie, none below 0) scores at least ``least``.

    A prediction is a centre, a size and a score per class, in shares of the image;
    they lie one behind the other, or value by value where ``transposed``.
    """
    at = lambda i, j: F.get(tensor, F.when(transposed, F.lit(j) * predictions + i).otherwise(i * values + j).cast("int")).cast("double")

    def box(i: Column) -> Column:
        scores = F.array(*[at(i, 4 + c) for c in range(values - 4)])
        best = F.greatest(F.array_max(scores), F.lit(0.0))
        cx, cy, w, h = (at(i, j) for j in range(4))
        return F.struct(
            i.alias("i"), F.when(best > 0, F.array_position(scores, best).cast("int") - 1).otherwise(0).alias("class"), best.alias("score"),
            ((cx - w / 2) * width).alias("x"), ((cy - h / 2) * height).alias("y"), (w * width).alias("w"), (h * height).alias("h"),
        )

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(predictions - 1)), box), lambda b: b["score"] >= least)


def anchored(scores: Column, regressions: Column, anchors: Column, width: float, height: float, least: float, size: int = 128, step: int = 16) -> Column:
    """Faces (i, score, x, y, w, h): logistic scores of at least ``least``, boxes by
    their distance from ``anchors`` (structs of x and y), ``step`` numbers each."""

    def face(i: Column) -> Column:
        reg = lambda j: F.get(regressions, i * step + j).cast("double") / size
        anchor = F.get(anchors, i)
        cy, cx, h, w = reg(0) + anchor["y"], reg(1) + anchor["x"], reg(2), reg(3)
        score = 1 / (1 + F.exp(-F.get(scores, i).cast("double")))
        return F.struct(i.alias("i"), score.alias("score"), ((cx - w / 2) * width).alias("x"), ((cy - h / 2) * height).alias("y"), (w * width).alias("w"), (h * height).alias("h"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(scores) - 1), face), lambda b: b["score"] >= least)


def resized(grid: Column, from_size: tuple[int, int], to_size: tuple[int, int]) -> Column:
    """The grid (rows one behind the other) at another size, each cell from the
    nearest one at or before its place."""
    (w0, h0), (w1, h1) = from_size, to_size
    source = lambda k, n0, n1: F.least(F.floor(k * (n0 / n1)), F.lit(n0 - 1))
    at = lambda k: (source(F.floor(k / w1), h0, h1) * w0 + source(k % w1, w0, w1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(w1 * h1 - 1)), lambda k: F.get(grid, at(k)))
