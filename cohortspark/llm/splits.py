"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.draws import digest
from cohortspark.plans.shared import checked_broadcast, discard, written

#: Places at which the first range may begin, per stratum; the one with the least deviation of shares is taken.
TURNS = 16


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node, in the type's order, of all that are tied to each node in any steps.

    Edges are read both ways; null ends, self-links and repeated edges tie nothing. Only nodes with an edge to another
    come out. Alternating large-star and small-star: each round points the neighbours of every node at the smallest
    among them; minima are pre-aggregated before each shuffle and joined back, so the neighbours of a hub are never
    brought together. Each round is a table written to the shared folder. O(log² n) rounds; more than `max_rounds` raise.
    """
    pairs = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    pairs = written(pairs, "edges")  # u > v

    def star(both: DataFrame, keep: Column) -> DataFrame:
        """Each neighbour `y` of `x` that `keep` allows, and x itself, point at the smallest around x."""
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        least = least.select("x", F.least("x", "m").alias("m"))
        linked = both.join(least, "x").where(keep).select(F.col("y").alias("u"), F.col("m").alias("v"))
        own = least.select(F.col("x").alias("u"), F.col("m").alias("v"))
        return linked.union(own).where(F.col("u") != F.col("v")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = state(pairs)
    for _ in range(max_rounds):
        both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).union(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
        large = star(both, F.col("y") > F.col("x"))
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = star(large.select(F.col("u").alias("x"), F.col("v").alias("y")), F.lit(True))
        last, pairs = pairs, written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(last)
        after = state(pairs)
        if after == before:
            ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return ends.union(pairs.select("v", "v").distinct())
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def related_groups(subjects: DataFrame, links: DataFrame) -> DataFrame:
    """(subject_id, group_id) of every subject that is related to another one with records.

    `subjects` has one row per subject_id with records; `links` has subject_a, subject_b. Groups may be tied through ids
    without records, which neither come out nor name a group: group_id is the smallest id of those with records.
    """
    members = connected_components(links, "subject_a", "subject_b").withColumnRenamed("node", "subject_id").join(subjects.select("subject_id"), "subject_id", "left_semi")
    named = members.groupBy("component").agg(F.min("subject_id").alias("group_id"), F.count("*").alias("size")).where("size > 1")
    return members.join(named, "component").select("subject_id", "group_id")


def bounds(shares: dict[str, float]) -> dict[str, float]:
    """Upper end of each split's range of [0, 1)."""
    upto, out = 0.0, {}
    for name, share in shares.items():
        upto = round(upto + share, 12)
        out[name] = upto
    return out


def _hash_places(groups: DataFrame, seed: int) -> DataFrame:
    """`groups` (group_id, rows, stratum) with `place`: where the middle of its rows lies, from 0 to 1, when the rows of a
    stratum are laid out in the order of the hash of their group.

    The hash's head cuts each stratum into parts; a window runs in each, and the parts' totals give the offsets.
    """
    hashed = groups.withColumn("_h", digest(seed, F.col("group_id"))).withColumn("_part", F.substring("_h", 1, 3))
    held = hashed.groupBy("stratum", "_part").agg(F.sum("rows").alias("held"))
    whole = Window.partitionBy("stratum")  # 4,096 parts at most
    parts = held.select("stratum", "_part", (F.sum("held").over(whole.orderBy("_part")) - F.col("held")).alias("before"), F.sum("held").over(whole).alias("total"))
    own = Window.partitionBy("stratum", "_part").orderBy("_h", "group_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = hashed.join(checked_broadcast(parts), ["stratum", "_part"])
    middle = 2 * (F.col("before") + F.sum("rows").over(own)) - F.col("rows")
    return joined.select("group_id", "rows", "stratum", "total", (middle / (2 * F.col("total"))).alias("place"))


def split_subjects(weights: DataFrame, links: DataFrame, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """(subject_id, group_id, n_rows, n_positive, split): every subject in one split, related ones in the same.

    `weights` has one row per subject_id with n_rows and n_positive (rows with label 1). Subjects without relations are
    their own group. The hash of a group's id gives its place among the rows of its stratum (groups with positive rows, and
    without, so that label shares come out alike), and [0, 1) is cut into ranges in proportion to `shares`. A group of any
    size goes where its middle lies, so shares deviate by half of the groups that lie on a bound at most; where the first
    range begins is turned, per stratum, to the one of TURNS places with the least deviation. `split_report` states it.
    """
    groups = related_groups(weights, links)
    members = weights.select("subject_id", "n_rows", "n_positive").join(groups, "subject_id", "left").withColumn("group_id", F.coalesce("group_id", "subject_id"))
    members = written(members, "split-members")
    sized = members.groupBy("group_id").agg(F.sum("n_rows").alias("rows"), (F.sum("n_positive") > 0).alias("stratum"))
    placed = written(_hash_places(sized, seed), "split-places")
    ends = bounds(shares)

    def split(turn) -> Column:
        turned = F.col("place") + turn / TURNS
        turned = turned - F.floor(turned)
        out = F.lit(list(ends)[-1])
        for name in reversed(list(ends)):
            out = F.when(turned < ends[name], name).otherwise(out)
        return out

    tried = placed.select("stratum", "rows", "total", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("turn"), "place")
    got = tried.withColumn("split", split(F.col("turn"))).groupBy("stratum", "turn").agg(*[(F.sum(F.when(F.col("split") == s, F.col("rows")).otherwise(0)) / F.max("total")).alias(s) for s in shares])
    off = got.select("stratum", "turn", F.round(F.greatest(*[F.abs(F.col(f"`{s}`") - share) for s, share in shares.items()], F.lit(0.0)), 9).alias("off"))
    best = off.groupBy("stratum").agg(F.min(F.struct("off", "turn"))["turn"].alias("turn"))
    assigned = placed.join(checked_broadcast(best), "stratum").select("group_id", split(F.col("turn")).alias("split"))
    return members.join(assigned, "group_id").select("subject_id", "group_id", "n_rows", "n_positive", "split")


def split_report(splits: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Per split: subjects, rows, share of rows, its deviation from `shares`, and share of positive rows."""
    per = splits.groupBy("split").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_subjects"), F.sum("n_positive").alias("n_positive"))
    all_rows = F.sum("n_rows").over(Window.partitionBy())  # over one row per split
    goal = F.lit(None).cast("double")
    for name, share in shares.items():
        goal = F.when(F.col("split") == name, share).otherwise(goal)
    return per.select("split", "n_subjects", "n_rows", (F.col("n_rows") / all_rows).alias("row_share"), (F.col("n_rows") / all_rows - goal).alias("deviation"), (F.col("n_positive") / F.col("n_rows")).alias("positive_share"))
