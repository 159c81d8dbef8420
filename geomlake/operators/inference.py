"""Statistical inference: t-tests, nulls by permutation and bootstrap, corrections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomlake.functions.special import t_upper_p
from geomlake.operators import aggregates


def t_one_sample(rows: DataFrame, value: str, *groups: str) -> DataFrame:
    """groups, n, m, t, df of the mean against 0."""
    n = F.count(value)
    held = rows.groupBy(*groups).agg(n.alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"))
    return held.select(*groups, "n", "m", F.when(F.col("sd") > 0, F.col("m") / (F.col("sd") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"))


def one_tailed(rows: DataFrame, t: str = "t", df: str = "df") -> DataFrame:
    """Adds p of a larger t."""
    return rows.withColumn("p", t_upper_p(F.col(t), F.col(df)))


def correlation_t(r: Column, n: Column) -> Column:
    return r * F.sqrt((n - 2) / (1 - r * r))


def fdr(rows: DataFrame, p: str, *families: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds q, the Benjamini-Hochberg adjusted p inside each family."""
    order = Window.partitionBy(*families).orderBy(p, *ties)
    ranked = rows.withColumns({"_rk": F.row_number().over(order), "_m": F.count(F.lit(1)).over(Window.partitionBy(*families))})
    down = Window.partitionBy(*families).orderBy(F.desc("_rk")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rk")).over(down))).drop("_rk", "_m")


def max_stat(null: DataFrame, observed: DataFrame, value: str, alpha: float, *families: str) -> DataFrame:
    """observed with p (of its value against the null maxima, + 1 over + 1) and the critical value, to be exceeded.

    null: families, perm, value. Maxima are one number a permutation, sorted into one array a family.
    """
    maxima = null.groupBy(*families, "perm").agg(F.max(value).alias("top"))
    n = F.size("tops")
    place = F.greatest(F.lit(1), n + 1 - F.floor(F.lit(alpha) * (n + 1) + 1e-9).cast("int"))
    table = maxima.groupBy(*families).agg(F.array_sort(F.collect_list("top")).alias("tops"))
    table = table.withColumn("critical", F.get(F.col("tops"), F.least(place, n) - 1))
    held = observed.join(F.broadcast(table), list(families)) if families else observed.join(F.broadcast(table))  # one row a family
    p = (F.size(F.filter("tops", lambda x: x >= F.col(value) - 1e-12)) + 1) / (n + 1)
    return held.withColumn("p", p).drop("tops")


def flips(n_perm: int, subjects: np.ndarray) -> np.ndarray:
    """Reproducible signs (permutations by subjects) from integers."""
    return 1.0 - 2.0 * (((np.arange(n_perm)[:, None] + 1) * 7919 + subjects * 104_729) % 1_000_003 // 8 % 2)


def signed_sums(rows: DataFrame, group: str, subject: str, x: str, n_perm: int) -> DataFrame:
    """group, perm, at, s, q, n: sums over subjects of sign-flipped arrays x, of their squares, and how many there are.

    perm -1 is as observed. A batch is one matrix product of signs and rows, so no row is multiplied by
    the number of permutations.
    """
    kind = dict(rows.dtypes)[group]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.schema.field(0).type
            names, ids = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            values = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            for name in set(names.tolist()):
                here = names == name
                part = np.vstack([values[here].sum(axis=0), flips(n_perm, ids[here]) @ values[here], (values[here] ** 2).sum(axis=0)])
                before, n = held.get(name, (0.0, 0))
                held[name] = (before + part, n + int(here.sum()))
        for name, (part, n) in held.items():
            sums, width = part[:-1], part.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * sums.size, key), pa.array(np.repeat(np.arange(-1, n_perm, dtype=np.int32), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(sums))), pa.array(sums.ravel()), pa.array(np.tile(part[-1], len(sums))), pa.array(np.full(sums.size, n))],
                [group, "perm", "at", "s", "q", "n"],
            )

    found = rows.select(group, F.col(subject).cast("long").alias(subject), x).mapInArrow(add, f"{group} {kind}, perm int, at int, s double, q double, n long")
    return found.groupBy(group, "perm", "at").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))


def resamples(rows: DataFrame, item: str, n_boot: int) -> DataFrame:
    """boot, item, w_<item>: how often each resample, of as many draws as there are items, takes an item.

    Draws are an arithmetic hash of resample and draw, so every engine makes the same; counts are those
    of drawing with replacement, and an item without a draw has no row.
    """
    items = aggregates.global_rank(rows.select(item).distinct(), F.col(item), name="_rank")
    items = items.select(item, (F.col("_rank").cast("long") - 1).alias("_j")).join(items.agg(F.count(F.lit(1)).alias("_n")))  # one row
    p = 1_000_003
    drawn = items.select("_n", "_j", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("boot"))
    drawn = drawn.withColumn("_x", ((F.col("boot").cast("long") + 1) * 7919 + F.col("_j") * 104_729 + 17) % p)
    at = ((F.col("_x") * F.col("_x") % p) * F.col("_x") % p) % F.col("_n")
    counts = drawn.groupBy("boot", at.alias("_j")).agg(F.count(F.lit(1)).alias(f"w_{item}"))
    return counts.join(items.select(item, "_j"), "_j").select("boot", item, f"w_{item}")


def bootstrap_variance(rows: DataFrame, value: str, weight: Column, *groups: str) -> DataFrame:
    """groups, var: variance over resamples (boot) of the weighted mean."""
    means = rows.withColumn("_w", weight).groupBy(*groups, "boot").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("m"))
    return means.groupBy(*groups).agg(F.var_samp("m").alias("var"))


def welch_rest(rows: DataFrame, value: str, member: str, *groups: str) -> DataFrame:
    """groups, member, t, df of each member's rows against all others of its group, from sums of members alone."""
    own = rows.groupBy(member, *groups).agg(F.count(value).alias("na"), F.avg(value).alias("ma"), (F.var_samp(value) * (F.count(value) - 1)).alias("sa"))
    whole = rows.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("m"), (F.var_samp(value) * (F.count(value) - 1)).alias("s"))
    held = own.join(whole, list(groups)).withColumn("nb", F.col("n") - F.col("na"))
    held = held.withColumn("mb", (F.col("n") * F.col("m") - F.col("na") * F.col("ma")) / F.col("nb"))
    # Sums of squares about the mean: the whole's less the member's and what lies between both.
    gap = F.col("ma") - F.col("mb")
    held = held.withColumn("sb", F.col("s") - F.col("sa") - F.col("na") * F.col("nb") / F.col("n") * gap * gap)
    va, vb = (F.col(f"s{x}") / (F.col(f"n{x}") - 1) / F.col(f"n{x}") for x in "ab")
    df = (va + vb) * (va + vb) / (va * va / (F.col("na") - 1) + vb * vb / (F.col("nb") - 1))
    return held.select(*groups, member, (gap / F.sqrt(va + vb)).alias("t"), df.alias("df"))
