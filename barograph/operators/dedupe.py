"""Unions of alert batches and duplicates by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that is last in ``order``.

    Written as an aggregation instead of a ranking window, so a key with very
    many copies is reduced on every input partition before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(latest).select(*[c if c in keys else F.col(f"_last.`{c}`").alias(c) for c in df.columns])


def union_batches(old: DataFrame, new: DataFrame, seq: str = "batch_seq") -> DataFrame:
    """Both batches by column name; ``seq`` says which is newer."""
    before = old if seq in old.columns else old.withColumn(seq, F.lit(0).cast("long"))
    if seq in new.columns:
        return before.unionByName(new, allowMissingColumns=True)
    # The new batch follows whatever the old table holds.
    following = F.coalesce(before.agg(F.max(seq)).scalar(), F.lit(0)).cast("long") + 1
    return before.unionByName(new.withColumn(seq, following), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("alert_id",), seq: str = "batch_seq", tie: Sequence[str] = ()) -> DataFrame:
    """Append ``new`` to ``old``; for equal keys the later batch wins.

    Within one batch the order of equal keys is decided by ``tie``.
    """
    return keep_last(union_batches(old, new, seq), keys, [seq, *tie])
