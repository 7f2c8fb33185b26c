"""Exact order statistics and drift profiles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from martflow.functions import quantiles as qt
from martflow.operators import profiles


def _data():
    rnd = random.Random(11)
    groups = {
        "ties": [1.0] * 3000 + [2.0] * 40 + [7.5],
        "skew": [math.exp(rnd.gauss(0, 12)) * rnd.choice([-1, 1]) for _ in range(2500)],
        "ints": [float(rnd.randint(0, 400)) for _ in range(1500)],
        "one": [3.25],
        "two": [5.0, -5.0],
        None: [float(k) for k in range(200)],
    }
    return groups, [(g, v) for g, vs in groups.items() for v in vs] + [("ints", None), ("none", None)]


@pytest.mark.parametrize("parts", [1, 9])
def test_quantiles_equal_a_sorted_list(spark, parts):
    groups, rows = _data()
    df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
    shares = {"p1": 0.01, "med": 0.5, "p90": 0.9, "p99": 0.99, "all": 1.0, "none": 0.0}
    got = {r["k"]: r for r in qt.exact_quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs = sorted(vs)
        for name, p in shares.items():
            assert got[k][name] == vs[max(1, len(vs) - math.floor(len(vs) - len(vs) * p)) - 1], (k, name)
    between = {r["k"]: r for r in qt.interpolated_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}).collect()}
    want = {r["k"]: r for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("m"), F.percentile("v", 0.9).alias("q"))
            .collect() if r["m"] is not None}
    assert set(between) == set(want)
    for k, r in want.items():
        assert between[k]["m"] == pytest.approx(r["m"], rel=1e-12) and between[k]["q"] == pytest.approx(r["q"], rel=1e-12)


def test_quantiles_of_counts_whole_table_and_empty_input(spark):
    groups, rows = _data()
    df = spark.createDataFrame(rows, "k string, v double")
    counts = df.groupBy("k", "v").agg(F.count("v").alias("n"))
    assert sorted(qt.exact_quantiles(counts, ["k"], "v", {"m": 0.5}, weight="n").collect(), key=str) \
        == sorted(qt.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect(), key=str)
    everything = sorted(v for _, v in rows if v is not None)
    assert qt.exact_quantiles(df, [], "v", {"m": 0.25}).first()["m"] == everything[math.ceil(len(everything) * 0.25) - 1]
    assert qt.exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).collect() == []


def _frame(spark, seed, n):
    rnd = random.Random(seed)
    rows = [(rnd.gauss(seed, 3), float(rnd.randint(0, 60)), float(rnd.randint(0, 3)), rnd.choice([None, 1.0, 2.0]))
            for _ in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double")


def test_merged_profiles_are_the_profile_of_the_union(spark):
    x, y = _frame(spark, 1, 500), _frame(spark, 2, 300)
    names = ["a", "b", "c", "d"]
    merged = profiles.merge(profiles.profile(x, names), profiles.profile(y, names))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, profiles.profile(x.unionByName(y), names).collect()))


def test_drift_of_profiles_by_hand(spark):
    x, y = _frame(spark, 1, 700), _frame(spark, 3, 400)
    names = ["a", "b", "c", "d"]
    got = {r["feature"]: r for r in profiles.drift(profiles.paired(profiles.profile(x, names), profiles.profile(y, names)), ["b"]).collect()}
    assert {k: r["method"] for k, r in got.items()} == {
        "a": profiles.WASSERSTEIN_METHOD, "b": profiles.JS_METHOD, "c": profiles.JS_METHOD, "d": profiles.JS_METHOD}
    ref, cur = ([r["a"] for r in t.collect()] for t in (x, y))
    points = sorted({*ref, *cur})
    area = sum(abs(sum(v <= p for v in ref) / len(ref) - sum(v <= p for v in cur) / len(cur)) * (q - p)
               for p, q in zip(points, points[1:]))
    mean = sum(ref) / len(ref)
    assert got["a"]["stat_value"] == pytest.approx(area / math.sqrt(sum((v - mean) ** 2 for v in ref) / len(ref)), abs=2e-6)
    for name in ("b", "c", "d"):
        ref, cur = ([r[name] for r in t.collect() if r[name] is not None] for t in (x, y))
        js = 0.0
        for v in {*ref, *cur}:
            p, q = ref.count(v) / len(ref), cur.count(v) / len(cur)
            js += sum(0.5 * z * math.log(2 * z / (p + q)) for z in (p, q) if z)
        assert got[name]["stat_value"] == pytest.approx(math.sqrt(js), abs=2e-6)


def test_drift_plan_joins_no_melted_rows(spark):
    """The plan reads both sides as counts: rows are melted below an aggregate only."""
    x, y = _frame(spark, 1, 50), _frame(spark, 2, 50)
    ref = profiles.profile(x, ["a", "b"])
    plan = profiles.drift(profiles.paired(ref, profiles.profile(y, ["a", "b"])), ["b"])._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    for k, line in enumerate(lines):
        if "Generate explode" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            above = [ln for ln in lines[:k] if len(ln) - len(ln.lstrip(" :+-")) < depth]
            path, limit = [], depth
            for ln in reversed(above):
                own = len(ln) - len(ln.lstrip(" :+-"))
                if own < limit:
                    path.append(ln)
                    limit = own
            nearest = next(ln for ln in path if "Join" in ln or "Aggregate" in ln)
            assert "Aggregate" in nearest


def test_cuts_are_written_before_rows_meet_them(spark):
    import glob

    from martflow.session import checkpoint_dir
    before = set(glob.glob(f"{checkpoint_dir(spark)}/quantiles/*/cuts_*"))
    df = spark.range(5000).select(F.lit("g").alias("k"), F.col("id").cast("double").alias("v"))
    assert qt.exact_quantiles(df, ["k"], "v", {"med": 0.5}).first()["med"] == 2499.0
    assert len(set(glob.glob(f"{checkpoint_dir(spark)}/quantiles/*/cuts_*")) - before) >= 1
