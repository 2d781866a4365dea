"""Joins with the cardinality that the caller expects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df` itself; ValueError with up to five examples where a key occurs twice."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"not unique on {keys}: {[tuple(r[k] for k in keys) for r in twice]}")
    return df


def many_to_one_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return left.join(assert_unique(right, keys), keys, how)


def one_to_one_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return assert_unique(left, keys).join(assert_unique(right, keys), keys, how)


def suffix_join(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join; columns that both sides have get a suffix each, others keep their names. Any cardinality."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    renamed = [side.withColumnsRenamed({c: c + suffix for c in both}) for side, suffix in zip((left, right), suffixes)]
    return renamed[0].join(renamed[1], keys)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """`df` with `value` of its `key` in `table` as `name`; null where there is none. ValueError if a key is there twice."""
    pairs = table.select(F.col(key), F.col(value).alias(name))
    return many_to_one_join(df, pairs, [key])


def absent(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in `other`; null keys are nowhere, so they come out."""
    return df.join(other.select(key), key, "left_anti")


def completed(report: DataFrame, keys: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """`report` with a row for each of `keys`, counts 0 where it had none; other keys drop out."""
    return keys.select(key).distinct().join(report, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
