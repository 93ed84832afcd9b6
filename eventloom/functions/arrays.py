"""Column functions over event, interval, probability and score arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.checks import check_strategies, check_top_k


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, array_sum(values) / F.size(values))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def interval_stats(intervals: Column) -> Column:
    """Struct of mean, max, population deviation, share of zeros and sum; zeros for an empty array.

    One pass with running moments: nothing inside the fold refers to another fold over the array.
    """
    start = F.struct(
        F.lit(0.0).alias("n"),
        F.lit(0.0).alias("mean"),
        F.lit(0.0).alias("m2"),
        F.lit(0.0).alias("top"),
        F.lit(0.0).alias("zeros"),
        F.lit(0.0).alias("total"),
    )

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(
            n.alias("n"),
            mean.alias("mean"),
            (acc["m2"] + (x - acc["mean"]) * (x - mean)).alias("m2"),
            F.when(acc["n"] == 0, x).otherwise(F.greatest(acc["top"], x)).alias("top"),
            (acc["zeros"] + F.when(x == 0, 1.0).otherwise(0.0)).alias("zeros"),
            (acc["total"] + x).alias("total"),
        )

    def finish(acc: Column) -> Column:
        n = F.greatest(acc["n"], F.lit(1.0))
        return F.struct(
            (acc["total"] / n).alias("ti_mean"),
            acc["top"].alias("ti_max"),
            F.sqrt(acc["m2"] / n).alias("ti_std"),
            (acc["zeros"] / n).alias("ti_zeros"),
            acc["total"].alias("ti_sum"),
        )

    return F.aggregate(intervals, start, step, finish)


def log_softmax_nll(logits: Column, target: Column) -> Column:
    """Negative log-likelihood of event ``target`` (0-based) under the softmax of ``logits``."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.log(total) + top - F.element_at(logits, target + 1)


def rank_of_target(logits: Column, target: Column) -> Column:
    """1-based rank of the true event; equal values rank by lower event id."""
    truth = F.element_at(logits, target + 1)
    better = F.size(F.filter(logits, lambda x: x > truth))
    tied_before = F.size(F.filter(F.slice(logits, 1, target), lambda x: x == truth))
    return better + tied_before + 1


def topk_miss(logits: Column, target: Column, top_k: int) -> Column:
    """1 when the true event is not among the ``top_k`` likeliest; ``top_k`` is capped at their number."""
    check_top_k(top_k)
    return (rank_of_target(logits, target) > F.least(F.lit(top_k), F.size(logits))).cast("int")


def last_n(values: Column, n: int) -> Column:
    """The last ``n`` items, or all of a shorter array."""
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - n + 1), n)


def window_scores(miss: Column, nll: Column, strategies: list[str]) -> dict[str, Column]:
    """Score columns of one window from its per-position misses and negative log-likelihoods.

    ``nll_p95`` keeps the positions: its quantile is taken over all positions of a block.
    """
    columns = {
        "topk_last": F.element_at(miss, -1).cast("double"),
        "topk_all": array_mean(F.transform(miss, lambda x: x.cast("double"))),
        "topk_last3": array_mean(F.transform(last_n(miss, 3), lambda x: x.cast("double"))),
        "nll_mean": array_mean(nll),
        "nll_p95": nll,
        "nll_max": F.array_max(nll),
    }
    return {name: columns[name] for name in check_strategies(strategies)}
