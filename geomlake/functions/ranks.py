"""Ranks and correlations as window and aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def average_rank(value: str, *groups: str) -> Column:
    """Rank from 1 inside the groups, equal values sharing their mean rank.

    The mean of the ranks from below and from above: both windows have the groups' partitioning,
    where counting ties would take a shuffle by value.
    """
    w = Window.partitionBy(*groups)
    n = F.count(F.lit(1)).over(w)
    return (F.rank().over(w.orderBy(value)) + n + 1 - F.rank().over(w.orderBy(F.desc(value)))) / F.lit(2.0)


def ordinal_rank(value: str, *groups: str, ties: tuple[str, ...]) -> Column:
    """Rank from 0 inside the groups, equal values ordered by `ties`."""
    return F.row_number().over(Window.partitionBy(*groups).orderBy(value, *ties)) - 1


def partial(xy: Column, xz: Column, yz: Column) -> Column:
    """First-order partial correlation from three correlations; 0 where degenerate."""
    norm = F.sqrt(F.greatest((1 - xz * xz) * (1 - yz * yz), F.lit(0.0)))
    return F.when(norm > 1e-10, (xy - xz * yz) / norm).otherwise(0.0)
