import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import percentiles, splits, survivor


def test_percentiles_of_days_and_unions(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["b", None]), rng.randint(0, 3), rng.choice([0.0, -0.0, 1.5, None, float("nan"), rng.gauss(0, 3)]), rng.choice([5, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "site string, day int, x double, y int")
    days = percentiles.value_counts(df, {"site": F.col("site"), "day": F.col("day")}, ["x", "y"])
    percents = [0, 10, 33.3, 50, 99, 100]
    for state, key in ((days, lambda s, d: (s, d)), (percentiles.merged(days, {"site": F.col("site")}), lambda s, d: (s,)), (percentiles.merged(days, {}), lambda s, d: ())):
        want = defaultdict(list)
        for s, d, x, y in rows:
            for name, v in (("x", x), ("y", y)):
                if v is not None and v == v:
                    want[(*key(s, d), name)].append(float(v))
        groups = [c for c in state.columns if c in ("site", "day")]
        got = percentiles.exact_percentiles(state, groups, percents, partitions=7).collect()
        assert len(got) == len(want)
        for r in got:
            values = want[(*[r[g] for g in groups], r.field_name)]
            assert r.n == len(values) and r.error_bound == 0.0
            assert np.allclose([r[f"p{p:g}".replace(".", "_")] for p in percents], np.percentile(values, percents))
    assert percentiles.exact_percentiles(days.limit(0), ["site", "day"], [50]).count() == 0


def test_trailing_days(spark):
    rng = random.Random(6)
    start = dt.date(2024, 2, 26)
    rows = [(rng.choice(["hot"] * 8 + ["b"]), rng.choice([None, *[start + dt.timedelta(i) for i in (0, 1, 4, 5, 11)]]), float(rng.randint(0, 4))) for _ in range(400)]
    df = spark.createDataFrame(rows, "site string, day date, x double")
    state = percentiles.value_counts(df, {"site": F.col("site"), "day": F.col("day")}, ["x"])
    want = Counter()
    for site, day, x in rows:
        for k in range(3 if day else 1):
            want[site, day + dt.timedelta(k) if day else None, x] += 1
    got = {(r.site, r.day, r.value): r.n for r in percentiles.trailing(state, "day", 3).collect()}
    assert got == want and percentiles.trailing(state.limit(0), "day", 3).count() == 0
    with pytest.raises(ValueError):
        percentiles.trailing(state, "day", 0)


def components_by_hand(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_components(spark, kind):
    rng = random.Random(2)
    ids = [f"n{i:03d}" for i in range(200)]
    if kind == "random":
        edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(120)] + [(None, ids[0]), (ids[1], ids[1])]
    elif kind == "path":
        edges = [(ids[i], ids[i + 1]) for i in range(60)]
        rng.shuffle(edges)
    else:
        edges = [(ids[150], x) for x in ids] * 2
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.component for r in splits.connected_components(df, "a", "b").collect()}
    assert got == components_by_hand(edges)


def test_groups_need_records(spark):
    links = spark.createDataFrame([("a", "z"), ("z", "c"), ("d", "y"), ("a", "a"), (None, "a")], "subject_a string, subject_b string")
    subjects = spark.createDataFrame([("c",), ("a",), ("d",), ("q",)], "subject_id string")
    assert {tuple(r) for r in splits.related_groups(subjects, links).collect()} == {("a", "a"), ("c", "a")}
    assert splits.related_groups(subjects, links.limit(0)).count() == 0 and splits.related_groups(subjects.limit(0), links).count() == 0


def test_splits(spark):
    rng = random.Random(3)
    weights = [(f"s{i:04d}", rng.choice([1, 2, 3]), rng.choice([0, 1])) for i in range(4000)] + [("hot", 3000, 0)]
    links = [(f"s{rng.randrange(4000):04d}", f"s{rng.randrange(4000):04d}") for _ in range(300)]
    w = spark.createDataFrame(weights, "subject_id string, n_rows long, n_positive long")
    edges = spark.createDataFrame(links, "subject_a string, subject_b string")
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    result = splits.split_subjects(w, edges, shares)
    rows = result.collect()
    assert len(rows) == 4001 and {r.split for r in rows} == set(shares)
    by_subject = {r.subject_id: r.split for r in rows}
    assert all(by_subject[a] == by_subject[b] for a, b in links)
    report = {r.split: r for r in splits.split_report(result, shares).collect()}
    for s, share in shares.items():  # one subject holds a quarter of the rows
        assert abs(report[s].row_share - share) < 0.02 and report[s].deviation == pytest.approx(report[s].row_share - share)
    assert by_subject == {r.subject_id: r.split for r in splits.split_subjects(w.repartition(5), edges, shares).collect()}
    assert splits.split_subjects(w.limit(0), edges.limit(0), shares).count() == 0


SCHEMA = "record_id long, who string, visit string, site string, source_rank int, updated_at timestamp, x double, y double, value string, group_id string"


def resolved(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    fields = {n: F.when(~F.isnan(n), F.col(n)) for n in ("x", "y")}
    return survivor.resolve(df, ["who", "visit"], fields, **options)


def test_survivors(spark):
    rng = random.Random(7)
    at = lambda: rng.choice([None, dt.datetime(2024, 1, rng.randint(1, 4))])
    number = lambda: rng.choice([None, float("nan"), 1.0, 2.0, 3.0])
    rows = [(i, rng.choice(["hot"] * 200 + [f"p{k}" for k in range(150)] + [None]), rng.choice(["1", "2"]), rng.choice(["s1", "s2", None]), rng.choice([None, 1, 2]), at(), number(), number(), "clash", "clash") for i in range(600)]
    groups = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            groups[r[1], r[2]].append(r)
    last = dt.datetime(9999, 1, 1)
    want = {}
    for members in groups.values():
        if len(members) > 1:
            for j, f in ((6, "x"), (7, "y")):
                held = [m for m in members if m[j] is not None and m[j] == m[j]]
                if held:
                    best = min(held, key=lambda m: (m[4] if m[4] is not None else 99, -(m[5].timestamp() if m[5] else -last.timestamp()), m[0]))
                    want[min(m[0] for m in members), f] = (best[0], best[j])
    out = resolved(spark, rows).facts.collect()
    got = {(r.group_id, r.field_name): (r.record_id, r.value) for r in out if r.survives}
    assert got == want
    judged = Counter((r.group_id, r.field_name) for r in out if r.judged_true)
    assert set(judged) == {(r.group_id, r.field_name) for r in out} and set(judged.values()) == {1} and all(0 <= r.p_true <= 1 for r in out)


def planted(rng, n, sites):
    """Records of n visits from sites that tell the truth with given probabilities; a wrong value is over 100."""
    rows, i = [], 0
    for p in range(n):
        truth = float(rng.randint(1, 50))
        for site, right in sites:
            i += 1
            rows.append((i, f"p{p}", "1", site, 1, None, truth if rng.random() < right else float(rng.randint(101, 140)), truth, "", ""))
    return rows


def test_planted_wrong_values_are_rejected(spark):
    found = resolved(spark, planted(random.Random(9), 600, [("good", 0.97), ("bad", 0.4), ("worse", 0.3)]))
    quality = {(r.field_name, r.source): r for r in found.report().collect()}
    assert quality["x", "good"].sensitivity > 0.85 > quality["x", "bad"].sensitivity > quality["x", "worse"].sensitivity and found.quality.converged
    assert quality["x", "good"].specificity > quality["x", "bad"].specificity and len(quality) == 6
    x = found.facts.where("field_name = 'x'").withColumn("right", F.col("value") <= 50)
    true, false = x.where("judged_true and right").count(), x.where("judged_true and not right").count()
    assert true + false == 600 and false < 60
    outvoted = x.where("n_records = 1 and right").count()
    assert x.where("n_records = 1 and right and judged_true").count() > 0.8 * outvoted > 50
    assert found.facts.where("field_name = 'y' and not judged_true").count() == 0
    report = {r.field_name: r for r in survivor.overruled(found.facts).collect()}
    assert report["y"].n_overruled == report["y"].n_contested == 0 and report["x"].n_cells == 600 and report["x"].n_contested > 400


def test_trust_weighs_the_order_against_the_sources(spark):
    rows = planted(random.Random(4), 200, [("bad", 0.3), ("good", 0.97), ("fair", 0.9)])  # the bad source comes first
    right = lambda trust: resolved(spark, rows, trust=trust).facts.where("field_name = 'x' and survives and value <= 50").count()
    first, weighed, none = right(float("inf")), right(0.5), right(0.0)
    assert first < 90 and weighed > 170 and none > 170
    assert survivor.overruled(resolved(spark, rows).facts).where("field_name = 'x'").first().n_overruled > 100
    assert survivor.overruled(resolved(spark, rows, trust=0.0).facts).where("n_overruled > 0").count() == 0


def test_stages_run_only_for_what_depends_on_them(spark, monkeypatch):
    ran = []
    for name in ("fit_quality", "_probabilities", "written"):
        monkeypatch.setattr(survivor, name, lambda *a, real=getattr(survivor, name), name=name, **k: ran.append(name) or real(*a, **k))
    models = lambda: [name for name in ran if name != "written"]
    rows = planted(random.Random(6), 100, [("bad", 0.3), ("good", 0.97), ("fair", 0.9)])  # the bad source comes first
    rows += [(i, "p0", "2", "bad", rank, day, x, None, "", "") for i, rank, day, x in ((900, None, None, 1.0), (901, 2, None, 2.0), (902, 2, dt.datetime(2024, 1, 2), float("nan")), (903, 2, dt.datetime(2024, 1, 1), 3.0))]
    rows += [(950, "p1", None, "bad", 1, None, 1.0, 1.0, "", ""), (951, "p1", None, "bad", 1, None, 2.0, 2.0, "", "")]
    picked = lambda df: sorted((r.group_id, r.field_name, r.value, r.record_id) for r in df.collect())

    found = resolved(spark, rows)
    by_order = picked(found.survivors())
    assert ran == [] and len(by_order) == 201 and (900, "x", 3.0, 903) in by_order
    found.report().collect()
    assert models() == ["fit_quality"]
    assert picked(found.facts.where("survives")) == by_order and models() == ["fit_quality", "_probabilities"]

    weighed = picked(resolved(spark, rows, trust=0.5).survivors())
    assert models()[2:] == ["fit_quality", "_probabilities"] and weighed != by_order
    fit = survivor.fit_quality

    def turned(*args):  # the best source taken for the worst
        q = fit(*args)
        q.sensitivity, q.specificity = 1 - q.sensitivity, 1 - q.specificity
        return q

    monkeypatch.setattr(survivor, "fit_quality", turned)
    assert picked(resolved(spark, rows, trust=0.5).survivors()) != weighed and picked(resolved(spark, rows).survivors()) == by_order


def test_p5_found_fits_no_model(spark, sf, monkeypatch):
    from cohortspark.llm import queries

    def refuse(*args):
        raise AssertionError("no row of p5_found depends on this")

    for name in ("fit_quality", "_probabilities"):
        monkeypatch.setattr(survivor, name, refuse)
    assert queries.p5_found(spark, sf).count() > 0
    with pytest.raises(AssertionError):
        queries.p5_judged_values(spark, sf).count()


def test_several_true_values_of_a_multi_valued_field(spark):
    rng, rows = random.Random(8), []
    for p in range(300):
        for site in ("a", "b", "c"):
            for value in (1.0, 2.0):  # both true
                rows.append((len(rows), f"p{p}", "1", site, 1, None, value, value, "", ""))
        if rng.random() < 0.3:
            rows.append((len(rows), f"p{p}", "1", "noise", 1, None, 9.0, 9.0, "", ""))
    facts = resolved(spark, rows, multi_valued=["x"]).facts
    counts = {(r.field_name, r.value): r.n for r in facts.where("judged_true").groupBy("field_name", "value").agg(F.count("*").alias("n")).collect()}
    assert counts["x", 1.0] == counts["x", 2.0] == 300 and ("x", 9.0) not in counts
    assert sum(n for (f, _), n in counts.items() if f == "y") == 300  # one each


def test_more_sources_than_a_word_has_bits(spark):
    rows = planted(random.Random(3), 4, [(f"s{i:03d}", 0.0 if i < 40 else 1.0) for i in range(150)])
    found = resolved(spark, rows)
    assert len(found.quality.sources) == 150
    assert {(r.value > 50, r.judged_true) for r in found.facts.where("field_name = 'x'").collect()} == {(False, True), (True, False)}
    by_source = {r.source: r.sensitivity for r in found.report().where("field_name = 'x'").collect()}
    assert min(by_source[f"s{i:03d}"] for i in range(40, 150)) > max(by_source[f"s{i:03d}"] for i in range(40))


def test_no_duplicates_and_none(spark):
    one = [(1, "a", "1", "s", 1, None, 1.0, None, "", "")]
    assert resolved(spark, one).facts.count() == 0 and resolved(spark, []).facts.count() == 0 and resolved(spark, []).report().count() == 0
    same = resolved(spark, one * 2 + [(1, "b", "1", None, None, None, None, None, "", "")] * 2).facts.collect()
    assert [(r.group_id, r.field_name, r.value, r.n_records, r.survives) for r in same] == [(1, "x", 1.0, 2, True)]
