"""The numeric contract both engines rely on: ratio rounding is HALF_UP on
the exact rational value; money sums in cents are exact."""

import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from martflow.oracle.sqlfn import rnd


def _half_up(p: int, q: int, d: int) -> float:
    v = Fraction(p, q)
    sign = -1 if v < 0 else 1
    scaled = abs(v) * 10 ** d
    k = (scaled.numerator * 2 + scaled.denominator) // (2 * scaled.denominator)
    return float(Decimal(sign * k) / (Decimal(10) ** d))


def test_spark_round_and_sql_rnd_equal_exact_half_up(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(-5000, 5000), rng.randint(1, 4000)) for _ in range(3000)]
    pairs += [(1, 8), (5, 10000 * 2), (-1, 8), (1225, 10000), (12345, 100000)]   # exact ties
    for d in (1, 2, 4, 6):
        df = spark.createDataFrame(pairs, "p long, q long")
        got = [r.x for r in df.select(F.round(F.col("p") / F.col("q"), d).alias("x")).collect()]
        con = duckdb.connect()
        con.execute("CREATE TABLE t (p BIGINT, q BIGINT, i INTEGER)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(p, q, i) for i, (p, q) in enumerate(pairs)])
        sql = [r[0] for r in con.execute(f"SELECT {rnd('p', 'q', d)} FROM t ORDER BY i").fetchall()]
        want = [_half_up(p, q, d) for p, q in pairs]
        assert got == want, d
        assert sql == want, d


def test_strict_enforce_raises_inside_the_plan(spark):
    from martflow.operators import quality as q
    df = spark.createDataFrame([(1, 5.0), (2, -1.0)], "id long, price double")
    acc, _ = q.enforce(df, [q.check_rule("positive_price", "price > 0")], strict=True)
    try:
        acc.collect()
        raise AssertionError("strict mode accepted a broken row")
    except Exception as e:  # noqa: BLE001
        assert "constraint violated: positive_price" in str(e)
