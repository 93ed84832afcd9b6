"""Ordered computations whose groups may be larger than one task can hold.

A plain window puts a whole group into one task. Every operator here keeps that cheap plan while the
largest group is small, and otherwise range-partitions rows by (group, order), works inside the ranges
and carries totals across them. Both plans give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import cut_lineage

#: Largest group that is still sorted by a single task.
GROUP_ROWS = 1_000_000
#: Rows below which a range of rows is not cut further, whatever the limit.
RANGE_ROWS = 100_000
#: Events kept in one array cell.
CHUNK_EVENTS = 10_000

#: Rows up to which a looked-up side is broadcast; each is a few hundred bytes at most.
BROADCAST_ROWS = 100_000

_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in total), from one map-side combined count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    return int(row["largest"] or 0), int(row["total"] or 0)


def broadcast_if_small(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a count proves the side small; otherwise leave the join to Spark."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def _sort(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _range_partitioned(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], total: int, limit: int
) -> DataFrame:
    """Rows in (keys, order) ranges of about ``limit`` rows, or RANGE_ROWS if that is more, with the range number kept as a column.

    A range may be of any size, since sorting spills; each is a task, a file and a sample at the driver, so small ones only cost.
    The range bounds are sampled, so the numbered rows are written once: a later pass, or a task that is
    run again after an executor was lost, sees the same numbers.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * total / max(limit, RANGE_ROWS)))
    by = [F.col(k) for k in keys] + list(order)
    return cut_lineage(df.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    folds: Mapping[str, tuple[str, Column]],
    totals: bool = False,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Add running ``sum``/``min``/``max`` columns per group, up to and including the row.

    ``folds`` maps an output name to (fold, expression). ``totals`` adds ``<name>_total``, the fold over the
    whole group. ``order`` should be unique in a group.
    """
    order = _sort(order)
    largest, total = group_sizes(df, keys)
    if largest <= limit:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        columns = {name: _FOLDS[fold](expr).over(upto) for name, (fold, expr) in folds.items()}
        if totals:
            columns |= {f"{n}_total": _FOLDS[fold](expr).over(whole) for n, (fold, expr) in folds.items()}
        return df.withColumns(columns)

    ranged = _range_partitioned(df, keys, order, total, limit)
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    per_range = ranged.groupBy("_range", *keys).agg(
        *[_FOLDS[fold](expr).alias(f"_p_{name}") for name, (fold, expr) in folds.items()]
    )
    carried = per_range.select(
        "_range",
        *keys,
        *[_FOLDS[fold](F.col(f"_p_{n}")).over(before).alias(f"_c_{n}") for n, (fold, _) in folds.items()],
        *(
            [_FOLDS[fold](F.col(f"_p_{n}")).over(whole).alias(f"{n}_total") for n, (fold, _) in folds.items()]
            if totals
            else []
        ),
    )
    local = ranged.withColumns({name: _FOLDS[fold](expr).over(inside) for name, (fold, expr) in folds.items()})
    joined = _null_safe_join(local, carried, ["_range", *keys])

    def combine(name: str, fold: str) -> Column:
        if fold == "sum":
            return F.coalesce(F.col(f"_c_{name}") + F.col(name), F.col(name), F.col(f"_c_{name}"))
        pick = F.least if fold == "min" else F.greatest
        return pick(F.col(f"_c_{name}"), F.col(name))

    return joined.withColumns({name: combine(name, fold) for name, (fold, _) in folds.items()}).drop(
        "_range", *[f"_c_{name}" for name in folds]
    )


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "pos", limit: int = GROUP_ROWS
) -> DataFrame:
    """Number the rows of each group from 0 in the given order."""
    numbered = running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, limit=limit)
    return numbered.withColumn(name, F.col(name) - 1)


def spread_chunks(df: DataFrame, size: int, ahead: int, pos: str = "pos") -> DataFrame:
    """Copy each row to every chunk that needs it: its own and those for which it is look-ahead.

    Chunk ``c`` owns positions ``[c * size, (c + 1) * size)`` and also sees the next ``ahead`` rows, so
    anything that starts in a chunk and spans at most ``ahead + 1`` rows can be computed inside it.
    """
    first = F.floor(F.greatest(F.col(pos) - ahead, F.lit(0)) / size).cast("bigint")
    last = F.floor(F.col(pos) / size).cast("bigint")
    return df.withColumn("chunk", F.explode(F.sequence(first, last)))


def following(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    leads: Mapping[str, tuple[str, int]],
    limit: int = GROUP_ROWS,
    size: int = CHUNK_EVENTS,
) -> DataFrame:
    """Add values of later rows of the group (name -> (column, distance)) and the position ``pos``."""
    order = _sort(order)
    largest, _ = group_sizes(df, keys)
    if largest <= limit:
        w = Window.partitionBy(*keys).orderBy(*order)
        ahead = {name: F.lead(col, distance).over(w) for name, (col, distance) in leads.items()}
        return df.withColumns({"pos": (F.row_number().over(w) - 1).cast("bigint"), **ahead})
    reach = max(distance for _, distance in leads.values())
    spread = spread_chunks(positions(df, keys, order, limit=limit), size, reach)
    w = Window.partitionBy(*keys, "chunk").orderBy("pos")
    ahead = {name: F.lead(col, distance).over(w) for name, (col, distance) in leads.items()}
    own = F.floor(F.col("pos") / size) == F.col("chunk")
    return spread.withColumns(ahead).filter(own).drop("chunk")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    limit: int = GROUP_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles per group with linear interpolation, one column per entry of ``probabilities``.

    With ``weight``, a row stands for that many equal ones.

    Equal values are counted before the shuffle; the two neighbouring order statistics are then found from
    running counts, so no group is ever gathered in one buffer. Nulls are ignored.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n")
    )
    cumulated = running(counted, keys, [value], {"_upto": ("sum", F.col("_n"))}, totals=True, limit=limit)
    aggregates = []
    for name, p in probabilities.items():
        rank = F.lit(float(p)) * (F.col("_upto_total") - 1)
        aggregates += [
            F.min(F.when(F.col("_upto") > F.floor(rank), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(rank), F.col(value))).alias(f"_hi_{name}"),
        ]
    bounds = cumulated.groupBy(*keys).agg(F.max("_upto_total").alias("_total"), *aggregates)
    out = []
    for name, p in probabilities.items():
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    return bounds.select(*keys, *out)


def describe(df: DataFrame, keys: Sequence[str], value: str, limit: int = GROUP_ROWS) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of ``value`` per group."""
    moments = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(value).alias("count"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).cast("double").alias("min"),
            F.max(value).cast("double").alias("max"),
        )
    )
    quarters = quantiles(df, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, limit)
    if not keys:
        # both sides hold exactly one row
        return moments.join(F.broadcast(quarters), F.lit(True), "left")
    return _null_safe_join(moments, quarters, keys)


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide metric columns as (name, value) rows, so that one pass describes them all."""
    return df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in columns], name, value)


def hash_rank(df: DataFrame, keys: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """Add ``rank`` (0-based, by seeded hash) and ``rank_total`` per group, without one task per group.

    The first four hex digits of a hash split every group into 65,536 even buckets; bucket counts give
    the offsets. Needs few distinct groups: the count table then has a fixed upper size.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col))))
    # never null, or the join below would push a hash test of every input row down to the scan
    hashed = hashed.withColumn("_bucket", F.coalesce(F.substring("_h", 1, 4), F.lit("")))
    counts = hashed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("rank_total"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_h", id_col)
    return (
        hashed.join(offsets, [*keys, "_bucket"])
        .withColumn("rank", F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_h", "_bucket", "_before")
    )
