"""Exact percentiles per group over any number of rows, from states that merge across partitions and days.

The state of a field in a group is the table of its distinct values with their counts. States of disjoint rows merge by
adding counts, and nothing is lost, so that percentiles of any union are exact: the stated error bound is zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.plans.shared import checked_broadcast, ship, written


def value_counts(records: DataFrame, groups: dict[str, Column], fields: list[str]) -> DataFrame:
    """State: one row per group, field_name and distinct value, with `n`, over the values that are present.

    Null and not-a-number are not counted; null group values form a group of their own; minus zero is zero. The rows are
    pre-aggregated before the shuffle, so a group or value that holds most rows costs no more than any other.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(fields)])
    long = records.select(*[c.alias(g) for g, c in groups.items()], F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = long.groupBy(*groups, "f", (F.col("value") + F.lit(0.0)).alias("value")).agg(F.count("*").alias("n"))
    return counted.select(*groups, F.element_at(F.array(*map(F.lit, fields)), F.col("f") + 1).alias("field_name"), "value", "n")


def merged(state: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """The state of coarser groups (months of days, all sites): counts of equal values add up."""
    return state.groupBy(*[c.alias(g) for g, c in groups.items()], "field_name", "value").agg(F.sum("n").alias("n"))


def trailing(state: DataFrame, day: str, length: int) -> DataFrame:
    """The state of running unions: under each day the counts of the `length` days that end with it, of its other groups.

    Every calendar day whose span holds a value has a state, also one without rows of its own; rows without a day form a
    group of their own, once. Counts of equal values are added before they are shuffled.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    reach = F.when(F.col(day).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(length - 1)))
    keys = [c for c in state.columns if c != "n"]
    spread = state.select(*[c for c in keys if c != day], "n", day, F.explode(reach).alias("_later")).withColumn(day, F.date_add(day, F.col("_later")))
    return spread.groupBy(*keys).agg(F.sum("n").alias("n"))


def _running_counts(keys: list[str]):
    """Within a sorted partition: the count of rows of the same group up to and with each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy(zero_copy_only=False)
            new = np.zeros(len(n), dtype=bool)
            for k in keys:
                codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            first_key = tuple(batch.column(k)[0].as_py() for k in keys)
            new[0] = first_key != last_key
            total = np.cumsum(n)
            starts = np.flatnonzero(new)
            base = np.zeros(len(n), dtype=np.int64)
            base[starts] = total[starts] - n[starts]
            base = np.maximum.accumulate(base)
            upto = total - base
            open_end = starts[0] if len(starts) else len(n)
            upto[:open_end] += carried  # the group goes on from the batch before
            carried, last_key = int(upto[-1]), tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
            yield batch.append_column("upto", pa.array(upto, pa.int64()))

    return run


def exact_percentiles(state: DataFrame, groups: list[str], percents: list[float], partitions: int | None = None) -> DataFrame:
    """One row per group and field_name: n, error_bound, and `p<percent>` for each of `percents` (0 to 100).

    A percentile is the linear interpolation between the neighbouring order statistics of all n values. The state is
    sorted over all partitions by group and value; the counts of each partition give every group's offset there; the
    positions that the percentiles need are looked up in the partitions that hold them. A group of any size spreads
    over as many partitions as its distinct values fill. An empty state gives an empty result.
    """
    spark, keys = state.sparkSession, [*groups, "field_name"]
    ship(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = state.select(*keys, "value", "n").repartitionByRange(partitions, *keys, "value").sortWithinPartitions(*keys, "value")
    schema = T.StructType([*ranged.schema.fields, T.StructField("upto", T.LongType())])
    local = ranged.mapInArrow(_running_counts(keys), schema).withColumn("part", F.spark_partition_id())
    local = written(local, "percentile-state")

    slices = local.groupBy(*keys, "part").agg(F.max("upto").alias("held"))
    of_group = Window.partitionBy(*keys)
    slices = slices.select(
        *keys, "part", "held",
        F.sum("held").over(of_group).alias("total"),
        (F.sum("held").over(of_group.orderBy("part")) - F.col("held")).alias("offset"),
    )
    places = F.array(*[((F.col("total") - 1) * F.lit(p / 100.0)) for p in percents])
    ends = F.flatten(F.transform(places, lambda x: F.array(F.floor(x), F.ceil(x))))  # positions from 0, two per percentile
    wanted = slices.withColumn("at", ends).where(
        F.exists("at", lambda x: (x >= F.col("offset")) & (x < F.col("offset") + F.col("held")))
    )
    small = checked_broadcast(wanted.select(*[F.col(k).alias(f"w_{k}") for k in keys], F.col("part").alias("w_part"), "offset", "total", "at"))
    same = (F.col("part") == F.col("w_part")) & F.col("field_name").eqNullSafe(F.col("w_field_name"))
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"w_{g}"))
    upto = F.col("offset") + F.col("upto")
    holds = lambda i: (F.element_at("at", i + 1) < upto) & (F.element_at("at", i + 1) >= upto - F.col("n"))
    hits = local.join(small, same).where(F.exists("at", lambda x: (x < upto) & (x >= upto - F.col("n"))))
    found = hits.groupBy(*keys, "total").agg(*[F.max(F.when(holds(i), F.col("value"))).alias(f"v{i}") for i in range(2 * len(percents))])

    def interpolated(k: int, p: float) -> Column:
        x = (F.col("total") - 1) * F.lit(p / 100.0)
        low, high = F.col(f"v{2 * k}"), F.col(f"v{2 * k + 1}")
        return (low + (high - low) * (x - F.floor(x))).alias(f"p{p:g}".replace(".", "_"))

    return found.select(*keys, F.col("total").alias("n"), F.lit(0.0).alias("error_bound"), *[interpolated(k, p) for k, p in enumerate(percents)])
