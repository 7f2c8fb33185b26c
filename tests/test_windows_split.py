"""Bucketed windows against plain ones (NULL partitions included), the
stratified split, the independent sample, and what identifies written tables."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import SF_SMALL
from martflow.config import DEFAULT
from martflow.functions.windows import dense_rank_desc, running_totals
from martflow.operators import modeldata as md


def _rows(n=400):
    rnd = random.Random(4)
    return [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(40)]), i) for i in range(n)]


def test_dense_rank_with_null_partitions(spark):
    df = spark.createDataFrame(_rows(), "category string, revenue long, id long")
    got = {r.id: r.rk for r in dense_rank_desc(df, ["category"], "revenue", "rk").collect()}
    plain = F.dense_rank().over(Window.partitionBy("category").orderBy(F.desc_nulls_last("revenue")))
    assert got == {r.id: r.rk for r in df.withColumn("rk", plain).collect()}


def test_null_category_alone(spark):
    df = spark.createDataFrame([(None, 10, 1), (None, 20, 2), (None, 20, 3)], "category string, revenue long, id long")
    got = dense_rank_desc(df, ["category"], "revenue", "rk").collect()
    assert sorted((r.id, r.rk) for r in got) == [(1, 2), (2, 1), (3, 1)]


def test_running_totals_in_many_buckets(spark):
    rnd = random.Random(5)
    values = sorted({round(rnd.gauss(0, 1) ** 3, 3) for _ in range(900)})
    rows = [(rnd.choice(["x", None]), v, rnd.randrange(9)) for v in values]
    df = spark.createDataFrame(rows, "p string, v double, n long")
    for part in ([], ["p"]):
        got = running_totals(df, part, "v", ["n"], bucket_rows=3)
        w = Window.partitionBy(*part).orderBy("v") if part else Window.orderBy("v")
        want = df.withColumns({"cum_n": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                               "next_v": F.lead("v").over(w)})
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_split_keeps_the_class_share_to_the_row(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(1000, 4333)], "user_id long, churned int")
    got = md.train_test_split(df).groupBy("churned", "split").count().collect()
    n = {(r.churned, r.split): r["count"] for r in got}
    for c in (0, 1):
        total = n[c, "test"] + n[c, "train"]
        assert n[c, "test"] == int(total * DEFAULT.test_fraction + 0.5)


def test_sample_does_not_follow_the_split(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(5000)], "user_id long, churned int")
    split = md.train_test_split(df)
    sample = md.fixed_sample(split, 1000)
    share = sample.where("split = 'test'").count() / 1000
    assert 0.15 < share < 0.25


def test_written_tables_belong_to_a_run_and_to_the_code(spark, monkeypatch):
    from pathlib import Path

    from martflow.plans import pipeline as pl
    key = lambda **kw: pl.Pipeline(spark, SF_SMALL, **kw).key
    assert key() == key() != key(run_id="other")
    before = key()
    real = Path.read_bytes
    monkeypatch.setattr(Path, "read_bytes", lambda self: real(self) + b"# edited" * (self.name == "gold.py"))
    assert key() != before


def test_one_table_is_written_per_table_asked_for(spark, monkeypatch):
    from martflow.plans import pipeline as pl
    written = []
    real = pl.materialize
    monkeypatch.setattr(pl, "materialize", lambda s, df, name, key: written.append(name) or real(s, df, name, key))
    p = pl.Pipeline.fixture(spark, SF_SMALL)
    assert written == []
    p.s("customers_clean")
    assert written == ["bronze_users", "silver_customers_clean"]
