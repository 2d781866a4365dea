"""Filling missing values from similar records: the own entity in time order, then its place and time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.cells import on_scale
from cohortspark.plans.shared import checked_broadcast


@dataclass(frozen=True)
class Scale:
    """A field to fill. Values outside `low` to `high` count as missing.

    `numeric` fields are interpolated between the observed days around them; others are categories with whole
    codes from `low` to `high`, carried from the nearest observed day.
    """

    field: str
    low: int
    high: int
    numeric: bool


CLINICAL = (Scale("education", 1, 5, False), Scale("ses", 1, 5, False), Scale("mmse", 0, 30, True))


def _summary(s: Scale, value: Column, prefix: str) -> list[Column]:
    """Mergeable summary of a field: sum and count, or the counts of its categories."""
    if s.numeric:
        return [F.sum(value).alias(f"{prefix}{s.field}_sum"), F.count(value).alias(f"{prefix}{s.field}_n")]
    return [F.count_if(value == code).alias(f"{prefix}{s.field}_{code}") for code in range(s.low, s.high + 1)]


def _merged(s: Scale, prefix: str) -> list[Column]:
    names = [f"{prefix}{s.field}_sum", f"{prefix}{s.field}_n"] if s.numeric else [f"{prefix}{s.field}_{c}" for c in range(s.low, s.high + 1)]
    return [F.sum(n).alias(n) for n in names]


def _typical(s: Scale, prefix: str) -> Column:
    """Mean, or the most frequent category (the smallest of equals), of a summary; null where nothing was observed."""
    if s.numeric:
        return F.try_divide(F.col(f"{prefix}{s.field}_sum"), F.col(f"{prefix}{s.field}_n"))
    counts = {c: F.col(f"{prefix}{s.field}_{c}") for c in range(s.low, s.high + 1)}
    most = F.greatest(*counts.values())
    return F.when(most > 0, F.coalesce(*[F.when(n == most, F.lit(float(c))) for c, n in counts.items()]))


def fill_missing(
    records: DataFrame,
    entity: str,
    place: str,
    time: str,
    scales: tuple[Scale, ...] = CLINICAL,
    max_gap_days: int = 400,
) -> DataFrame:
    """`records` with each field of `scales` filled, and how: `<field>_filled`, `<field>_method`, `<field>_distance`.

    `<field>_filled` is the field's own value where it is on its scale (method null: present values are untouched).
    Otherwise the first of these that is known, named in the method, the distance in days beside it:

    - `same_day`: the entity's value observed on the same day (mean, or most frequent category), distance 0;
    - `interpolated` (numeric): linear between the entity's observed days before and after, distance to the nearer;
      `carried` (categories, and numerics observed on one side only): the value of the nearest observed day, the
      earlier of equals, if at most `max_gap_days` away (interpolation has no limit: both ends are observed);
    - `place_month`, `place`, `overall`: mean or most frequent category of the place in that month, of the place, of
      all records; distance null.

    A field observed nowhere stays null, with method `none`. Records without entity or time take the last three; null
    places share one group. Ties, repeated records and extra columns are fine; columns named like the results are
    replaced. The input columns come through unchanged.

    Every group is first reduced to one row per entity and day (partial aggregation on the map side), so a window never
    holds more rows than days have passed, however many records an entity has. The records join back on entity and
    day, and those without an entity are spread over salted keys.
    """
    made = {f"{s.field}_{x}" for s in scales for x in ("filled", "method", "distance")}
    inner = {c: f"in{i}" for i, c in enumerate(records.columns) if c not in made}  # so that no column's name can clash
    kept = records.select([F.col(f"`{c}`").alias(n) for c, n in inner.items()])
    entity, place, time = inner[entity], inner[place], inner[time]
    day, month = F.to_date(time), F.trunc(F.to_date(time), "month")
    own = {s.field: on_scale(F.col(inner[s.field]).cast("double"), s.low, s.high) for s in scales}
    if any(not s.numeric for s in scales):  # a category is a whole code
        own |= {s.field: F.when(own[s.field] == F.floor(own[s.field]), own[s.field]) for s in scales if not s.numeric}

    observed = kept.select(F.col(entity).alias("_cs_e"), F.col(place).alias("_cs_p"), day.alias("_cs_d"), month.alias("_cs_m"), *[own[s.field].alias(s.field) for s in scales])
    daily = observed.where(F.col("_cs_e").isNotNull() & F.col("_cs_d").isNotNull()).groupBy("_cs_e", "_cs_d").agg(*[c for s in scales for c in _summary(s, F.col(s.field), "")])
    daily = daily.select("_cs_e", F.col("_cs_d").alias("_cs_day"), *[_typical(s, "").alias(f"v_{s.field}") for s in scales])
    before = Window.partitionBy("_cs_e").orderBy("_cs_day").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_cs_e").orderBy(F.col("_cs_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = {s.field: F.when(F.col(f"v_{s.field}").isNotNull(), F.struct("_cs_day", F.col(f"v_{s.field}").alias("v"))) for s in scales}
    near = daily.withColumns({f"b_{s.field}": F.last(seen[s.field], ignorenulls=True).over(before) for s in scales})
    near = near.withColumns({f"a_{s.field}": F.last(seen[s.field], ignorenulls=True).over(after) for s in scales})

    def from_entity(s: Scale) -> Column:
        """(value, method, distance) from the entity's own days, or null."""
        b, a, v = F.col(f"b_{s.field}"), F.col(f"a_{s.field}"), F.col(f"v_{s.field}")
        to_b, to_a = F.date_diff("_cs_day", b["_cs_day"]), F.date_diff(a["_cs_day"], F.col("_cs_day"))
        made = lambda value, method, distance: F.struct(value.alias("value"), F.lit(method).alias("method"), distance.alias("distance"))
        line = b["v"] + (a["v"] - b["v"]) * to_b / (to_a + to_b)
        back = to_a.isNull() | (to_b <= to_a)
        nearest, gap = F.when(to_b.isNotNull() & back, b["v"]).otherwise(a["v"]), F.least(to_b, to_a)
        pick = F.when(v.isNotNull(), made(v, "same_day", F.lit(0)))
        if s.numeric:
            pick = pick.when(to_b.isNotNull() & to_a.isNotNull(), made(line, "interpolated", gap))
        return pick.when(gap <= max_gap_days, made(nearest, "carried", gap))

    near = near.select("_cs_e", F.col("_cs_day").alias("_cs_d"), *[from_entity(s).alias(f"_cs_e_{s.field}") for s in scales])

    monthly = checked_broadcast(observed.groupBy("_cs_p", "_cs_m").agg(*[c for s in scales for c in _summary(s, F.col(s.field), "")]))
    monthly_of = monthly.select(F.col("_cs_p").alias("_cs_pm"), "_cs_m", *[_typical(s, "").alias(f"_cs_pm_{s.field}") for s in scales])
    places = monthly.groupBy(F.col("_cs_p").alias("_cs_pp")).agg(*[c for s in scales for c in _merged(s, "")])
    places = checked_broadcast(places.select("_cs_pp", *[_typical(s, "").alias(f"_cs_pp_{s.field}") for s in scales]))
    overall = monthly.groupBy().agg(*[c for s in scales for c in _merged(s, "")]).select(*[_typical(s, "").alias(s.field) for s in scales]).first()

    salted = F.coalesce(F.col(entity).cast("string"), F.concat(F.lit("\0"), F.pmod(F.hash(time, place, *[inner[s.field] for s in scales]), F.lit(997)).cast("string")))
    keyed = kept.withColumns({"_cs_e": salted, "_cs_d": day, "_cs_m": month})
    joined = (
        keyed.join(near.withColumn("_cs_e", F.col("_cs_e").cast("string")), ["_cs_e", "_cs_d"], "left")
        .join(monthly_of, F.col("_cs_pm").eqNullSafe(F.col(place)) & monthly_of["_cs_m"].eqNullSafe(keyed["_cs_m"]), "left")
        .join(places, F.col("_cs_pp").eqNullSafe(F.col(place)), "left")
    )

    def filled(s: Scale) -> dict[str, Column]:
        e, default = F.col(f"_cs_e_{s.field}"), F.lit(overall[s.field]).cast("double")
        month_v, place_v = F.col(f"_cs_pm_{s.field}"), F.col(f"_cs_pp_{s.field}")
        missing = own[s.field].isNull()
        method = F.coalesce(e["method"], F.when(month_v.isNotNull(), "place_month"), F.when(place_v.isNotNull(), "place"), F.when(default.isNotNull(), "overall"), F.lit("none"))
        return {
            f"{s.field}_filled": F.coalesce(own[s.field], e["value"], month_v, place_v, default),
            f"{s.field}_method": F.when(missing, method),
            f"{s.field}_distance": F.when(missing, e["distance"]),
        }

    results = {k: v for s in scales for k, v in filled(s).items()}
    return joined.select(*[F.col(n).alias(c) for c, n in inner.items()], *[v.alias(k) for k, v in results.items()])


def filled_cells(filled: DataFrame, key: str, scales: tuple[Scale, ...] = CLINICAL) -> DataFrame:
    """One row per cell that was missing: key, field_name, value, method, distance."""
    cells = F.array(*[
        F.struct(F.lit(s.field).alias("field_name"), F.col(f"{s.field}_filled").alias("value"), F.col(f"{s.field}_method").alias("method"), F.col(f"{s.field}_distance").alias("distance"))
        for s in scales
    ])
    return filled.select(key, F.inline(F.filter(cells, lambda c: c["method"].isNotNull())))
