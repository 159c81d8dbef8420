"""Declared models and runs: what can be asked for, and what a request needs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Run(NamedTuple):
    """A comparison: its target and what is taken out of both sides."""

    label: str
    target: str
    nuisance: tuple[str, ...] = ()
    kind: str = "partial"


class Registry:
    """Known models with their streams, and runs over them; requests are checked before work starts."""

    def __init__(self, models: dict[str, tuple[str, ...]], runs: tuple[Run, ...] = ()):
        self.models, self.runs = models, {r.label: r for r in runs}
        for run in runs:
            for name in (run.target, *run.nuisance):
                self.model(name.partition(".")[0])
            if run.target in run.nuisance:
                raise ValueError(f"{run.label} takes its own target out")

    def model(self, name: str) -> tuple[str, ...]:
        if name not in self.models:
            raise KeyError(f"no model {name!r}; there are {sorted(self.models)}")
        return self.models[name]

    def run(self, label: str) -> Run:
        if label not in self.runs:
            raise KeyError(f"no run {label!r}; there are {sorted(self.runs)}")
        return self.runs[label]

    def joint(self, name: str) -> bool:
        """Whether a model has a stream of its own for both modalities together."""
        return "av" in self.model(name)

    def table(self, spark: SparkSession) -> DataFrame:
        """model, stream: one row for each declared stream."""
        return spark.createDataFrame([(m, s) for m, streams in sorted(self.models.items()) for s in streams], "model string, stream string")

    def missing(self, present: DataFrame, spark: SparkSession) -> DataFrame:
        """Declared streams that a table (model, stream) does not have."""
        return self.table(spark).join(present.select("model", "stream").distinct(), ["model", "stream"], "left_anti")


def markdown(rows: DataFrame, *columns: str, order: str) -> DataFrame:
    """line_no, line: a small result as the lines of a Markdown table, in the order of one column.

    For reports: a result that goes into a document has few rows, which one window can number.
    """
    from pyspark.sql import Window

    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.orderBy(order)) + 1).alias("line_no"), bar([F.col(c).cast("string") for c in columns]).alias("line"))
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "|" + "-|" * len(columns))]
    return rows.sparkSession.createDataFrame(head, "line_no int, line string").unionByName(body)
