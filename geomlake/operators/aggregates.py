"""Group summaries, masks, overlap, selection and spatial statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomlake.functions import ranks
from geomlake.sources import store


def r2(rows: DataFrame, y: str, p: str, *groups: str, whole: tuple[str, ...] = ()) -> DataFrame:
    """groups, n, r2: 1 - SSE / SST, null if SST is below 1e-12. With `whole`, the mean is taken over these columns' groups."""
    m = F.avg(y).over(Window.partitionBy(*(whole or groups)))
    held = rows.withColumn("_m", m)
    sst = F.sum((F.col(y) - F.col("_m")) ** 2)
    return held.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.when(sst > 1e-12, 1 - F.sum((F.col(y) - F.col(p)) ** 2) / sst).alias("r2"))


def dice(a: Column, b: Column) -> Column:
    """Aggregate over two boolean columns; null if both are empty."""
    both, size = F.count_if(a & b), F.count_if(a) + F.count_if(b)
    return F.when(size > 0, 2 * both / size)


def jaccard(a: Column, b: Column) -> Column:
    either = F.count_if(a | b)
    return F.when(either > 0, F.count_if(a & b) / either)


def elbow(curve: DataFrame, dim: str, value: str, *groups: str, falling: bool = False) -> DataFrame:
    """groups, dim: where the running best, brought to 0..1, lies farthest above the chord from first to last."""
    upto = Window.partitionBy(*groups).orderBy(dim).rowsBetween(Window.unboundedPreceding, 0)
    v = -F.col(value) if falling else F.col(value)
    best = curve.withColumn("_v", F.max(v).over(upto))
    w = Window.partitionBy(*groups)
    scale = lambda c: (F.col(c) - F.min(c).over(w)) / F.greatest(F.max(c).over(w) - F.min(c).over(w), F.lit(1e-30))
    gap = best.withColumn("_gap", F.round(scale("_v") - scale(dim), 12))
    return gap.groupBy(*groups).agg(F.max_by(dim, F.struct("_gap", -F.col(dim))).alias(dim))


def balance_entropy(sizes: DataFrame, n: str, *groups: str) -> DataFrame:
    """groups, k, entropy: of the sizes' shares over log k; 0 for one cluster."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0)))
    held = sizes.withColumn("_p", p)
    k = F.count(F.lit(1))
    return held.groupBy(*groups).agg(k.alias("k"), F.when(k > 1, -F.sum(F.col("_p") * F.log("_p")) / F.log(k)).otherwise(0.0).alias("entropy"))


def morans_i(field: DataFrame, *groups: str, queen: bool = False, value: str = "value") -> DataFrame:
    """groups, i: Moran's I on a grid (row, col): equi-joins on shifted cells, cells outside the grid left out."""
    steps = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr or dc) and (queen or not (dr and dc))]
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    z = field.withColumn("_z", F.col(value) - F.avg(value).over(w))
    moved = z.select(*groups, F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in steps])).alias("c"), F.col("_z").alias("_y"))
    moved = moved.select(*groups, "c.row", "c.col", "_y")
    lag = z.join(moved, [*groups, "row", "col"]).groupBy(*groups).agg(F.sum(F.col("_z") * F.col("_y")).alias("num"), F.count(F.lit(1)).alias("w"))
    own = z.groupBy(*groups).agg(F.sum(F.col("_z") * F.col("_z")).alias("den"), F.count(F.lit(1)).alias("n"))
    return own.join(lag, list(groups)).select(*groups, (F.col("n") / F.col("w") * F.col("num") / F.col("den")).alias("i"))


def top_percent(rows: DataFrame, value: str, percent: float, *ties: str) -> DataFrame:
    """The ceil(n percent / 100) rows of largest value.

    The rows' number is one aggregate; the cut value comes from a distributed sort with a limit.
    """
    n = rows.count()
    return rows.orderBy(F.desc(value), *ties).limit(-(-int(n * percent * 1_000_000) // 100_000_000))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by an arithmetic order of the key: the same rows on every engine and partitioning."""
    return rows.orderBy((F.col(key) * 7919 + seed * 104_729) % 1_000_003, key).limit(n)


def relabelled(rows: DataFrame, raw: str) -> DataFrame:
    """Adds key: 0 for label -1, others numbered from 1 in their order. Labels are few, rows are not: the numbers are joined."""
    names = rows.select(raw).where(F.col(raw) != -1).distinct()
    keys = names.withColumn("key", F.row_number().over(Window.orderBy(raw)))
    return rows.join(keys, raw, "left").withColumn("key", F.coalesce("key", F.lit(0)))


def _placed(rows: DataFrame, groups: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows, range-partitioned by groups and order and stored, with their partition and how many of their group lie in earlier ones."""
    part = store.stored(rows.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = part.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each group and partition
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return part.join(sizes.select(*groups, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), [*groups, "_part"])


def average_ranked(rows: DataFrame, value: str, name: str, *groups: str) -> DataFrame:
    """Adds the rank from 1 inside the groups, equal values sharing their mean rank; no task holds a whole group.

    Equal values meet in one range partition, so ranks inside it and its offset are enough.
    """
    held = _placed(rows, groups, (value,)).withColumn(name, ranks.average_rank(value, *groups, "_part") + F.col("_before"))
    return held.drop("_part", "_before")


def numbered(rows: DataFrame, name: str, groups: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Adds the row's number from 0 in its group's order; no task holds a whole group."""
    held = _placed(rows, groups, order).withColumn(name, ranks.ordinal_rank(order[0], *groups, "_part", ties=order[1:]) + F.col("_before"))
    return held.drop("_part", "_before")


def spearman(rows: DataFrame, a: str, b: str, *groups: str) -> DataFrame:
    """groups, n and rho of the Spearman correlation of a and b inside each group."""
    ranked = average_ranked(average_ranked(rows, a, "_ra", *groups), b, "_rb", *groups)
    return ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("rho"))


def global_rank(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds a rank from 1 over all rows without bringing them to one task.

    Rows are range-partitioned by the order and stored with their place in their partition; the
    partitions' sizes, one number each, become offsets. Orders must be total for one answer.
    """
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = store.stored(placed.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    table = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return placed.join(F.broadcast(table), "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("int")).drop("_part", "_at", "_before")  # a row for each partition
