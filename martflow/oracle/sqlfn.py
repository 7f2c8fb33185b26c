"""Small SQL-text helpers for the DuckDB oracle.

``rnd(p, q, d)`` is exact half-up rounding of the rational p/q (integers,
q > 0) to ``d`` decimals, written in integer arithmetic; it equals Spark's
``round(p / q, d)`` (HALF_UP on the decimal value) bit for bit.
"""


def rnd(p: str, q: str, d: int) -> str:
    s = 10 ** d
    return (f"(CASE WHEN ({p}) >= 0 THEN ((({p}) * {2 * s} + ({q})) // (2 * ({q}))) "
            f"ELSE -(((-({p})) * {2 * s} + ({q})) // (2 * ({q}))) END) / {s}.0")


def gratio(p: str, q: str, d: int, guard: str | None = None) -> str:
    """CASE WHEN q > 0 THEN round(p/q, d) END (guarded ratio)."""
    g = guard or f"({q}) > 0"
    return f"CASE WHEN {g} THEN {rnd(p, q, d)} END"


def cents(x: str) -> str:
    return f"CAST(round(({x}) * 100) AS BIGINT)"


def isum(x: str) -> str:
    """Integer sum as BIGINT (DuckDB widens to HUGEINT)."""
    return f"CAST(sum({x}) AS BIGINT)"


def count_if(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def add_days(ts: str, n: str) -> str:
    return f"({ts} + to_days(CAST({n} AS INTEGER)))"


def month(ts: str) -> str:
    return f"CAST(date_trunc('month', {ts}) AS TIMESTAMP)"


def ddiff(end: str, start: str) -> str:
    """Spark datediff(end, start): whole days between the dates, as INTEGER."""
    return f"CAST(date_diff('day', CAST({start} AS DATE), CAST({end} AS DATE)) AS INTEGER)"
