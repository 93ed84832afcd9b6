"""Parameter and column checks that fail while a plan is built, before any job runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET_MODES = ("one_step", "many_to_many")
STRATEGIES = ("topk_last", "topk_all", "topk_last3", "nll_mean", "nll_p95", "nll_max")


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def check_target_mode(mode: str) -> None:
    if mode not in TARGET_MODES:
        raise ValueError(f"target_mode must be one of {', '.join(TARGET_MODES)}: {mode}")


def check_window(size: int, stride: int) -> None:
    if size < 1 or stride < 1:
        raise ValueError("window size and stride must be at least 1")


def check_top_k(top_k: int) -> None:
    if top_k < 1:
        raise ValueError("top_k must be at least 1")


def check_strategies(strategies: Iterable[str]) -> list[str]:
    strategies = list(strategies)
    unknown = sorted(set(strategies) - set(STRATEGIES))
    if unknown or not strategies:
        raise ValueError(f"unknown scoring strategies: {unknown or 'none given'}")
    return strategies


def check_split_ratios(train_normal: float, val_normal: float, val_anomaly: float) -> None:
    if min(train_normal, val_normal) < 0 or train_normal + val_normal >= 1.0:
        raise ValueError("normal ratios must be non-negative and leave something for the test split")
    if not 0.0 <= val_anomaly <= 1.0:
        raise ValueError("the anomaly ratio must lie between 0 and 1")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def check_windows(df: DataFrame, size: int, mode: str) -> DataFrame:
    """Check a window table: columns, a non-empty train split, and array lengths in every row."""
    check_target_mode(mode)
    require_columns(df, ["block_id", "split", "window", "target"])
    require_rows(df.filter(F.col("split") == "train"), "the train split holds no windows")
    good = F.size("window") == size
    if mode == "many_to_many":
        good = good & (F.size("target") == size)
    bad = df.filter(~good)
    if not bad.isEmpty():
        raise ValueError(f"windows must hold {size} events")
    return df
