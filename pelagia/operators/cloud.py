"""Point clouds: neighbours (by k-d splits, see ``kdtree``), voxels, transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pelagia.operators.kdtree import nearest  # noqa: F401


def _cell(size: float, *axes: str) -> list[Column]:
    return [F.floor(F.col(a) / size).cast("long").alias(f"c{a}") for a in axes]


def voxels(points: DataFrame, size: float) -> DataFrame:
    return points.select(*_cell(size, "x", "y", "z")).distinct()
