"""Joins of a row table with one-row-per-key summaries, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwave.functions.columns import any_of


def attach(rows: DataFrame, per_key: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join ``rows`` with a summary that has one row per key.

    One plan at every size: a small summary is broadcast and a hot key's
    partition is split by adaptive execution, since the summary has a single
    row to repeat.  Nothing runs before the result is asked for.

    In a left join, rows with a missing key match nothing but would all be
    sent to one task; a hash of the row spreads them.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    added = [c for c in per_key.columns if c not in keys] if how != "left_semi" else []
    names = [f"_key_{k}" for k in keys]
    right = per_key.dropna(subset=keys).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], *added, F.lit(0).cast("long").alias("_known"))
    same = [F.col(k) == F.col(n) for k, n in zip(keys, names)]
    returned = [*rows.columns, *added]
    if how != "left":
        return rows.join(right, same, how).select(*returned)
    missing = any_of([F.col(k).isNull() for k in keys])
    spread = F.when(missing, F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("long"))
    return (rows.withColumn("_spread", spread)
            .join(right, [F.col("_spread") == F.col("_known"), *same], how).select(*returned))


def first_per_key(frame: DataFrame, keys, order) -> DataFrame:
    """One whole row per key: the first in a declared order, ties by the rest.

    A minimum over a struct is combined before the shuffle, so a key with a
    huge number of rows reaches its task as one row per input partition.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in frame.columns if c not in keys and c not in order]
    picked = frame.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return picked.selectExpr(*[c if c in keys else f"_row.{c} as {c}" for c in frame.columns])


def require_unique(frame: DataFrame, keys) -> DataFrame:
    """Fail when a declared key repeats; the frame is returned unchanged.

    Windows over a person's visits stay as small as the visit schedule only
    if (study, person, wave) is a key, so untrusted input is checked first.
    """
    keys = list(keys)
    repeated = frame.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{keys} is not a key: {repeated[0].asDict()}")
    return frame


def null_safe_left_join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Left join on equal keys where null equals null."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, match, "left").drop(*(f"_right_{k}" for k in keys))
