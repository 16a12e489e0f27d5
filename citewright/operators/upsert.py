"""Replacing rows by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How many buckets a table replaced by key has unless told otherwise.
BUCKETS = 64


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def without_keys(stored: DataFrame, changed: DataFrame, keys: Sequence[str], broadcast: bool = False) -> DataFrame:
    """The stored rows whose key is not among ``changed``.

    With ``broadcast``, for few changes, the stored rows stay where they are.
    """
    gone = changed.select(*keys).distinct()
    return stored.join(F.broadcast(gone) if broadcast else gone, list(keys), "left_anti")


def replace_by_key(
    stored: DataFrame, incoming: DataFrame, changed: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """``incoming`` in place of every stored row whose key is among ``changed``.

    A changed key without an incoming row just loses its stored rows.
    """
    return without_keys(stored, changed, keys).unionByName(incoming)
