"""Data-quality profiles, constraints and integrity checks.

Every check returns a long-form DataFrame and evaluates all rules of a table
in **one** aggregate (the reference runs one count job per rule). Rules are
SQL expression strings, so the same text runs in Spark and in the DuckDB
oracle.

Rule semantics: a *violation predicate* counts rows where it is TRUE (NULL
does not count, like a filter). CHECK constraints (C10) are the opposite
form: a row breaks a CHECK only when the predicate is FALSE (NULL passes).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from martflow.functions.exprs import side_by_side
from martflow.functions.quantiles import exact_quantiles


@dataclass(frozen=True)
class Rule:
    name: str
    violation: str            # SQL predicate that marks a violating row
    tolerance: int = 0        # passed when violations <= tolerance
    max_share: float | None = None   # or: passed when violations < total * max_share


def check_rule(name: str, check: str) -> Rule:
    """A CHECK constraint as a rule: broken only when ``check`` is FALSE."""
    return Rule(name, f"NOT coalesce(({check}), true)")


def rule_report(df: DataFrame, table: str, rules: list[Rule]) -> DataFrame:
    """(table, check, violations, total, passed) for every rule, one scan."""
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, r in enumerate(rules):
        aggs.append(F.count(F.when(F.expr(r.violation), 1)).alias(f"_v{i}"))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r.name).alias("check"), F.col(f"_v{i}").alias("violations"),
                              F.lit(r.tolerance).alias("tol"),
                              F.lit(r.max_share).cast("double").alias("share"))
                     for i, r in enumerate(rules)])
    out = one.select(F.col("_total").alias("total"), F.explode(rows).alias("r"))
    passed = F.when(F.col("r.share").isNotNull(), F.col("r.violations") < F.col("total") * F.col("r.share")) \
        .otherwise(F.col("r.violations") <= F.col("r.tol"))
    return out.select(F.lit(table).alias("table"), F.col("r.check").alias("check"),
                      F.col("r.violations").alias("violations"), "total", passed.alias("passed"))


def enforce(df: DataFrame, rules: list[Rule], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """C10 apply: evaluate every rule per row once; rows with no broken rule
    are accepted, the rest quarantined with ``broken_rules``. ``strict``
    makes the accepted side raise on the first broken row instead
    (``raise_error`` inside the plan, no extra job)."""
    broken = F.filter(F.array(*[F.when(F.expr(r.violation), F.lit(r.name)) for r in rules]),
                      lambda x: x.isNotNull())
    tagged = df.withColumn("broken_rules", broken)
    ok = F.size("broken_rules") == 0
    accepted = tagged.filter(ok).drop("broken_rules")
    if strict:
        accepted = tagged.withColumn("_chk", F.when(~ok, F.raise_error(
            F.concat(F.lit("constraint violated: "), F.array_join("broken_rules", ",")))))
        accepted = accepted.filter(F.col("_chk").isNull()).drop("_chk", "broken_rules")
    return accepted, tagged.filter(~ok)


# ----------------------------------------------------------------- C10 rule lists
# The Silver CHECK constraints of the reference (names and predicates).
CONSTRAINTS: dict[str, list[Rule]] = {
    "customers_clean": [check_rule("pk_not_null", "user_id IS NOT NULL")],
    "orders_clean": [check_rule("pk_not_null", "order_id IS NOT NULL"),
                     check_rule("valid_days_to_ship", "days_to_ship >= 0 OR days_to_ship IS NULL"),
                     check_rule("valid_days_to_deliver", "days_to_deliver >= 0 OR days_to_deliver IS NULL")],
    "order_items_clean": [check_rule("pk_not_null", "order_item_id IS NOT NULL"),
                          check_rule("positive_price", "sale_price > 0"),
                          check_rule("positive_sale_price", "sale_price > 0")],
    "products_clean": [check_rule("pk_not_null", "product_id IS NOT NULL"),
                       check_rule("valid_margin", "retail_price >= cost")],
    "inventory_clean": [check_rule("pk_not_null", "inventory_item_id IS NOT NULL"),
                        check_rule("valid_days_to_sell", "days_to_sell >= 0 OR days_to_sell IS NULL")],
    "events_clean": [check_rule("pk_not_null", "event_id IS NOT NULL")],
    "distribution_centers_clean": [check_rule("pk_not_null", "distribution_center_id IS NOT NULL")],
}

# ----------------------------------------------------------------- C14 rule lists
# The reference's Gold business rules (names, predicates, tolerances).
GOLD_RULES: dict[str, list[Rule]] = {
    "customer_360": [
        Rule("return_rate <= 1", "return_rate > 1"),
        Rule("avg_order_value >= 0", "avg_order_value < 0"),
        Rule("lifetime_spend >= 0", "lifetime_spend < 0"),
        Rule("days_since_last_order >= 0", "days_since_last_order < 0"),
        Rule("first_order_at <= last_order_at", "first_order_at > last_order_at"),
        Rule("favorite_category only when orders > 0", "order_count = 0 AND favorite_category IS NOT NULL"),
        Rule("lifetime_spend >= avg_order_value (within rounding tolerance)",
             "order_count > 0 AND lifetime_spend < avg_order_value - 0.01"),
        Rule("cart_abandonment_rate between 0 and 1", "cart_abandonment_rate < 0 OR cart_abandonment_rate > 1"),
        Rule("browse_to_buy_ratio >= 0", "browse_to_buy_ratio < 0"),
    ],
    "product_performance": [
        Rule("units_sold >= 0", "units_sold < 0"),
        Rule("return_rate <= 1", "return_rate > 1"),
        Rule("sell_through_rate between 0 and 1", "sell_through_rate < 0 OR sell_through_rate > 1"),
        Rule("margin_pct between -1 and 1",
             "margin_pct IS NOT NULL AND (margin_pct < -1 OR margin_pct > 1)"),
        Rule("first_sold_at <= last_sold_at", "first_sold_at > last_sold_at"),
    ],
    "inventory_health": [
        Rule("turnover_rate between 0 and 1",
             "turnover_rate IS NOT NULL AND (turnover_rate < 0 OR turnover_rate > 1)"),
        Rule("days_of_supply >= 0", "days_of_supply IS NOT NULL AND days_of_supply < 0"),
        Rule("dead stock rate < 50% (sanity)", "is_dead_stock = true", max_share=0.5),
        Rule("units_in_stock >= 0", "units_in_stock < 0"),
        Rule("stock_value >= 0", "stock_value IS NOT NULL AND stock_value < 0"),
    ],
    "fulfillment_metrics": [
        Rule("on_time_rate between 0 and 1", "on_time_rate < 0 OR on_time_rate > 1"),
        Rule("return_rate between 0 and 1",
             "return_rate IS NOT NULL AND (return_rate < 0 OR return_rate > 1)"),
        Rule("avg_delivery_days >= 0 (excluding 1 known synthetic artifact)",
             "avg_delivery_days IS NOT NULL AND avg_delivery_days < 0", tolerance=1),
        Rule("on_time_deliveries <= total_deliveries", "on_time_deliveries > total_deliveries"),
    ],
    "funnel_analytics": [
        Rule("session_to_purchase_rate between 0 and 1",
             "session_to_purchase_rate IS NOT NULL AND "
             "(session_to_purchase_rate < 0 OR session_to_purchase_rate > 1)"),
        Rule("sessions > 0", "sessions <= 0"),
        Rule("total_events >= sessions", "total_events < sessions"),
    ],
}

# ----------------------------------------------------------------- C15 / C16 rule lists
# The reference's feature and dataset validation rules.
FEATURE_RULES: dict[str, list[Rule]] = {
    "transactional": [
        Rule("no negative spend", "lifetime_spend < 0"),
        Rule("order_count > 0", "order_count <= 0"),
        Rule("days_since_last_order >= 0", "days_since_last_order < 0"),
        Rule("return_rate between 0 and 1",
             "return_rate IS NOT NULL AND (return_rate < 0 OR return_rate > 1)"),
    ],
    "behavioral": [
        Rule("avg_session_depth >= 0", "avg_session_depth IS NOT NULL AND avg_session_depth < 0"),
        Rule("cart_abandonment_rate between 0 and 1",
             "cart_abandonment_rate IS NOT NULL AND (cart_abandonment_rate < 0 OR cart_abandonment_rate > 1)"),
    ],
    "product": [
        Rule("price_sensitivity_score between -1 and 1",
             "price_sensitivity_score IS NOT NULL AND "
             "(price_sensitivity_score < -1 OR price_sensitivity_score > 1)"),
    ],
}

DATASET_RULES = [
    Rule("no null target", "churned IS NULL"),
    Rule("no null user_id", "user_id IS NULL"),
]


def _stack(df_one_row: DataFrame, pairs: list[tuple[str, Column]], key: str = "check",
           value: str = "value") -> DataFrame:
    arr = F.array(*[F.struct(F.lit(k).alias(key), v.cast("double").alias(value)) for k, v in pairs])
    return df_one_row.select(F.explode(arr).alias("r")).select(f"r.{key}", f"r.{value}")


# ----------------------------------------------------------------- C1, C2
def null_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and column: NULL count, string 'null' count, total.
    One aggregate per table; columns starting with '_' are skipped."""
    parts = []
    for name, df in tables.items():
        cols = [f for f in df.schema.fields if not f.name.startswith("_")]
        aggs = [F.count(F.lit(1)).alias("_total")]
        for i, f in enumerate(cols):
            aggs.append(F.count(F.when(F.col(f.name).isNull(), 1)).alias(f"_n{i}"))
            sentinel = (F.count(F.when(F.col(f.name) == "null", 1)) if isinstance(f.dataType, StringType)
                        else F.lit(0).cast("long"))
            aggs.append(sentinel.alias(f"_s{i}"))
        one = df.agg(*aggs)
        arr = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"_n{i}").alias("null_count"),
                                 F.col(f"_s{i}").alias("null_string_count")) for i, f in enumerate(cols)])
        parts.append(one.select(F.lit(name).alias("table"), F.col("_total").alias("total"),
                                F.explode(arr).alias("r"))
                     .select("table", "r.column", "r.null_count", "r.null_string_count", "total"))
    return reduce(DataFrame.unionByName, parts)


def sentinel_counts(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Actual NULLs vs the string 'null' for the listed columns, one scan."""
    aggs = []
    for c in columns:
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}__null"),
                 F.count(F.when(F.col(c) == "null", 1)).alias(f"{c}__sentinel")]
    one = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__null").alias("actual_nulls"),
                             F.col(f"{c}__sentinel").alias("sentinel_nulls")) for c in columns])
    return one.select(F.explode(arr).alias("r")).select(F.lit(table).alias("table"), "r.*")


# ----------------------------------------------------------------- C3, C4, C5
def fk_orphans(children: list[tuple[DataFrame, str, str]], parent: DataFrame, parent_key: str,
               ignore_null_keys: bool) -> DataFrame:
    """Orphan rows of all relations to one parent, ``children`` being (table, key,
    relation): (relation, child_rows, orphans, orphan_pct, passed).

    Bronze form (C3) counts NULL keys as orphans; Silver form (C4) ignores them. Keys of the
    parent and of all children meet in one aggregate per key (one exchange, combined before it, so a hot
    key is a row per task); NULL keys are counted beside it and never shuffled."""
    kind = parent.schema[parent_key].dataType
    met = parent.select(F.col(parent_key).alias("key"), F.lit(-1).alias("child"))
    for i, (df, key, _) in enumerate(children):
        met = met.unionByName(df.select(F.col(key).cast(kind).alias("key"), F.lit(i).alias("child")))
    per_key = met.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.max(F.col("child") == -1).alias("known"), *[F.count_if(F.col("child") == i).alias(f"n{i}") for i in range(len(children))])
    lost = per_key.where(~F.col("known")).agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"lost{i}")
                                                for i in range(len(children))])
    sizes = [df.agg(F.count(F.lit(1)).alias(f"rows{i}"), F.count_if(F.col(key).isNull()).alias(f"null{i}"))
             for i, (df, key, _) in enumerate(children)]
    rows = F.array(*[F.struct(F.lit(name).alias("relation"), F.col(f"rows{i}").alias("child_rows"),
                              (F.col(f"lost{i}") + (F.lit(0) if ignore_null_keys else F.col(f"null{i}"))).alias("orphans"))
                     for i, (_, _, name) in enumerate(children)])
    share = F.round(F.col("orphans") * 100 / F.greatest(F.col("child_rows"), F.lit(1)), 2)
    return (side_by_side(lost, *sizes).select(F.explode(rows).alias("r")).select("r.*")
            .select("relation", "child_rows", "orphans", share.alias("orphan_pct"), (F.col("orphans") == 0).alias("passed")))


# The relations checked by the reference.
BRONZE_FKS = [("orders", "user_id", "users", "id"), ("order_items", "order_id", "orders", "order_id"),
              ("order_items", "user_id", "users", "id"), ("order_items", "product_id", "products", "id"),
              ("inventory_items", "product_id", "products", "id"), ("events", "user_id", "users", "id")]
SILVER_FKS = [("orders_clean", "user_id", "customers_clean", "user_id"),
              ("order_items_clean", "order_id", "orders_clean", "order_id"),
              ("order_items_clean", "user_id", "customers_clean", "user_id"),
              ("order_items_clean", "product_id", "products_clean", "product_id"),
              ("inventory_clean", "product_id", "products_clean", "product_id"),
              ("products_clean", "distribution_center_id", "distribution_centers_clean",
               "distribution_center_id")]


def fk_report(tables: dict[str, DataFrame], fks: list[tuple], ignore_null_keys: bool) -> DataFrame:
    parents = dict.fromkeys((p, pk) for _, _, p, pk in fks)
    parts = [fk_orphans([(tables[c], ck, f"{c}.{ck} -> {p}.{pk}") for c, ck, p2, pk2 in fks if (p2, pk2) == (p, pk)],
                        tables[p], pk, ignore_null_keys) for p, pk in parents]
    return reduce(DataFrame.unionByName, parts)


def event_user_orphans(events: DataFrame, users: DataFrame, user_key: str = "id") -> DataFrame:
    """Events with a non-null user that is not a known user."""
    return fk_orphans([(events, "user_id", "events.user_id (non-null) -> users")], users, user_key, True)


# ----------------------------------------------------------------- C6
def cardinality_top(df: DataFrame, table: str, columns: list[str], top: int = 10) -> DataFrame:
    """Distinct count and the top values per listed column.

    Columns are stacked to (column, value) once, so one aggregate serves
    all columns; the per-column ranking runs over the (small) value counts."""
    st = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                       for c in columns])).alias("r")).select("r.*")
    counts = st.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    card = counts.groupBy("column").agg(F.count("value").alias("cardinality"))
    # row_number <= top alone in its window: planned as WindowGroupLimit,
    # which also trims to ``top`` rows per column before the shuffle.
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_first("value"))
    top_rows = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return top_rows.join(card, "column").withColumn("table", F.lit(table))


# ----------------------------------------------------------------- C7, C8
def lifecycle_checks(items: DataFrame, inventory: DataFrame) -> DataFrame:
    """Timestamp-order violations, unsold units and date range (long form)."""
    i = items.agg(
        F.count(F.when(F.col("shipped_at") < F.col("created_at"), 1)).alias("shipped_before_created"),
        F.count(F.when(F.col("delivered_at") < F.col("shipped_at"), 1)).alias("delivered_before_shipped"),
        F.count(F.when(F.col("returned_at") < F.col("delivered_at"), 1)).alias("returned_before_delivered"))
    v = inventory.agg(F.count(F.when(F.col("sold_at") < F.col("created_at"), 1)).alias("sold_before_created"),
                      F.count(F.when(F.col("sold_at").isNull(), 1)).alias("unsold_units"))
    j = side_by_side(i, v)
    return _stack(j, [(k, F.col(k)) for k in ("shipped_before_created", "delivered_before_shipped",
                                              "returned_before_delivered", "sold_before_created",
                                              "unsold_units")])


def item_date_range(items: DataFrame) -> DataFrame:
    """First and last item creation time."""
    return items.agg(F.min("created_at").alias("min_created"), F.max("created_at").alias("max_created"))


def status_distribution(df: DataFrame, table: str) -> DataFrame:
    """Rows per status."""
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("count")).withColumn("table", F.lit(table))


def numeric_distribution(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Min, max, avg, p1, p99 and non-positive count per numeric column; the
    percentiles are exact, from refined histograms."""
    st = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                       for c in columns])).alias("r")).select("r.*")
    edges = exact_quantiles(st, ["column"], "value", {"p1": 0.01, "p99": 0.99})
    return (st.groupBy("column")
            .agg(F.min("value").alias("min"), F.max("value").alias("max"),
                 F.round(F.avg("value"), 4).alias("avg"),
                 F.count(F.when(F.col("value") <= 0, 1)).alias("non_positive"))
            .join(edges, "column", "left")
            .select("column", "min", "max", "avg", "p1", "p99", "non_positive", F.lit(table).alias("table")))


def negative_margin_count(products: DataFrame) -> DataFrame:
    """Products priced below cost."""
    return products.agg(F.count(F.when(F.col("retail_price") < F.col("cost"), 1)).alias("negative_margin"))


# ----------------------------------------------------------------- C9
def pk_check(df: DataFrame, table: str, key: str) -> DataFrame:
    """Total, NULL keys, duplicate keys (total - distinct, NULL counted as
    one distinct value like ``distinct()`` does)."""
    k = F.col(key)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(k.isNull(), 1)).alias("null_keys"),
                  (F.count_distinct(k) + F.max(k.isNull().cast("int"))).alias("_distinct")) \
        .select(F.lit(table).alias("table"), "total", "null_keys",
                (F.col("total") - F.col("_distinct")).alias("duplicate_keys"),
                ((F.col("null_keys") == 0) & (F.col("total") == F.col("_distinct"))).alias("passed"))


# ----------------------------------------------------------------- T25: cast failures
def cast_failures(raw: DataFrame, table: str, schema, rename: dict[str, str] | None = None) -> DataFrame:
    """Per Silver column: source values that were non-NULL but became NULL
    under ``try_cast`` to the declared type (malformed input), one scan.
    ``rename`` maps Silver names to raw names (e.g. user_id -> id)."""
    rename = rename or {}
    pairs = []
    for f in schema.fields:
        src = rename.get(f.name, f.name)
        if src in raw.columns:
            bad = F.col(src).isNotNull() & F.col(src).try_cast(f.dataType).isNull()
            pairs.append((f.name, F.count(F.when(bad, 1))))
    one = raw.agg(*[v.alias(f"_c{i}") for i, (_, v) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"_c{i}").alias("cast_failures"))
                    for i, (n, _) in enumerate(pairs)])
    return one.select(F.lit(table).alias("table"), F.explode(arr).alias("r")).select("table", "r.*")


# ----------------------------------------------------------------- C11
def reconciliation(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """C11: (table, expected_rows, actual_rows, match) from two count tables
    (see ``sources.io.table_counts``)."""
    return (expected.withColumnRenamed("row_count", "expected_rows")
            .join(actual.withColumnRenamed("row_count", "actual_rows"), "table", "full")
            .withColumn("match", F.coalesce(F.col("expected_rows") == F.col("actual_rows"), F.lit(False))))


# ----------------------------------------------------------------- C12
def silver_spot_checks(s: dict[str, DataFrame]) -> DataFrame:
    """Seven Silver checks as (check, value, passed); schema checks are
    evaluated on the declared schema, data checks in one aggregate each."""
    c = s["customers_clean"].agg(F.count(F.when(F.col("city") == "null", 1)).alias("v1"),
                                 F.count(F.when(F.col("country") == "Brasil", 1)).alias("v2"))
    o = s["orders_clean"].agg(F.count(F.when(F.col("shipped_at").isNotNull()
                                             & F.col("days_to_ship").isNull(), 1)).alias("v3"))
    i = s["order_items_clean"].agg(F.count(F.when((F.col("status") == "Returned") != F.col("is_returned"), 1))
                                   .alias("v4"))
    p = s["products_clean"].agg(F.count(F.when(F.col("brand") == "Unknown", 1)).alias("v7"))
    has_prod_cols = int(any(x.startswith("product_") and x != "product_id" for x in s["inventory_clean"].columns))
    has_ip = int("ip_address" in s["events_clean"].columns)
    j = side_by_side(c, o, i, p)
    out = _stack(j, [("string 'null' city values", F.col("v1")), ("'Brasil' country values", F.col("v2")),
                     ("shipped orders without days_to_ship", F.col("v3")),
                     ("is_returned differs from status", F.col("v4")),
                     ("denormalised product_* columns in inventory", F.lit(has_prod_cols)),
                     ("ip_address column in events", F.lit(has_ip)),
                     ("brands replaced by 'Unknown'", F.col("v7"))])
    return out.withColumn("passed", F.col("value") == 0)


# ----------------------------------------------------------------- C13
def gold_spot_checks(g: dict[str, DataFrame]) -> DataFrame:
    """Headline numbers of each Gold table as (check, value)."""
    c = g["customer_360"].agg(
        F.count(F.when(F.col("order_count") > 0, 1)).alias("customers_with_orders"),
        F.count(F.when(F.col("order_count") == 0, 1)).alias("customers_without_orders"),
        F.round(F.avg(F.when(F.col("lifetime_spend") > 0, F.col("lifetime_spend"))), 2).alias("avg_lifetime_spend"),
        F.max("lifetime_spend").alias("max_lifetime_spend"),
        F.count("favorite_category").alias("with_favorite_category"))
    p = g["product_performance"].agg(F.count(F.when(F.col("units_sold") == 0, 1)).alias("never_sold_products"))
    i = g["inventory_health"].agg(F.count(F.when(F.col("is_dead_stock"), 1)).alias("dead_stock_products"),
                                  F.count(F.when(F.col("reorder_signal"), 1)).alias("reorder_signals"))
    f = g["fulfillment_metrics"].agg(
        F.count_distinct("distribution_center_id").alias("distribution_centers"),
        F.count_distinct("order_month").alias("months"),
        F.round(F.sum(F.round(F.col("on_time_rate") * 10000).cast("long"))
                / (F.count("on_time_rate") * 10000), 4).alias("avg_on_time_rate"))
    a = g["funnel_analytics"].agg(F.count_distinct("user_id").alias("funnel_users"),
                                  F.count("sessions_mom_change").alias("rows_with_mom_change"))
    j = side_by_side(c, p, i, f, a)
    names = ["customers_with_orders", "customers_without_orders", "avg_lifetime_spend", "max_lifetime_spend",
             "with_favorite_category", "never_sold_products", "dead_stock_products", "reorder_signals",
             "distribution_centers", "months", "avg_on_time_rate", "funnel_users", "rows_with_mom_change"]
    return _stack(j, [(n, F.col(n)) for n in names])


# ----------------------------------------------------------------- C14-C16
def gold_rule_report(g: dict[str, DataFrame]) -> DataFrame:
    """C14: the 26 Gold business rules."""
    return reduce(DataFrame.unionByName, [rule_report(g[t], t, rules) for t, rules in GOLD_RULES.items()])


def constraint_report(s: dict[str, DataFrame]) -> DataFrame:
    """C10 as a report: violations of every Silver CHECK constraint."""
    return reduce(DataFrame.unionByName, [rule_report(s[t], t, rules) for t, rules in CONSTRAINTS.items()])


def temporal_integrity(stamped) -> DataFrame:
    """C15 (7): of the rows that the feature groups really read (``Stamped``), the newest
    per source lies before its cutoff (T17)."""
    def newest(df: DataFrame, source: str) -> DataFrame:
        late = F.max(F.col("created_at") >= F.col("cutoff"))
        return df.agg(F.max("created_at").alias("max_ts"), late.alias("late")).select(
            F.lit(source).alias("source"), "max_ts", (~F.coalesce("late", F.lit(False))).alias("passed"))

    return (newest(stamped.orders, "orders").unionByName(newest(stamped.item_rows(), "order_items"))
            .unionByName(newest(stamped.events, "events")))


def feature_validation(fb) -> DataFrame:
    """C15 (1-6): row-count consistency plus range rules of the feature groups."""
    txn, beh, prod = fb.transactional(), fb.behavioral(), fb.product()
    rules = reduce(DataFrame.unionByName, [
        rule_report(txn, "transactional", FEATURE_RULES["transactional"]),
        rule_report(beh, "behavioral", FEATURE_RULES["behavioral"]),
        rule_report(prod, "product", FEATURE_RULES["product"])])
    n_txn = txn.agg(F.count(F.lit(1)).alias("n"))
    n_elig = fb.eligible().agg(F.count(F.lit(1)).alias("m"))
    cnt = (side_by_side(n_txn, n_elig)
           .select(F.lit("transactional").alias("table"), F.lit("row count = eligible").alias("check"),
                   F.abs(F.col("n") - F.col("m")).alias("violations"), F.col("m").alias("total"),
                   (F.col("n") == F.col("m")).alias("passed")))
    return cnt.unionByName(rules)


def dataset_validation(ds: DataFrame, eligible: DataFrame) -> DataFrame:
    """Null target / key, count = eligible, unique key, churn rate in
    (5%, 95%), metadata present."""
    rules = rule_report(ds, "churn_feature_dataset", DATASET_RULES)
    agg = ds.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("d"),
                 F.sum("churned").alias("c"))
    m = eligible.agg(F.count(F.lit(1)).alias("m"))
    meta = int(all(c in ds.columns for c in ("feature_cutoff_date", "prediction_window_days",
                                              "feature_version", "pipeline_run_timestamp")))
    j = side_by_side(agg, m)
    rate = F.col("c") / F.col("n")
    extra = j.select(F.explode(F.array(
        F.struct(F.lit("row count = eligible").alias("check"), F.abs(F.col("n") - F.col("m")).alias("violations"),
                 (F.col("n") == F.col("m")).alias("passed")),
        F.struct(F.lit("unique user_id").alias("check"), (F.col("n") - F.col("d")).alias("violations"),
                 (F.col("n") == F.col("d")).alias("passed")),
        F.struct(F.lit("churn rate in (5%, 95%)").alias("check"),
                 F.when((rate > 0.05) & (rate < 0.95), 0).otherwise(1).cast("long").alias("violations"),
                 ((rate > 0.05) & (rate < 0.95)).alias("passed")),
        F.struct(F.lit("metadata columns present").alias("check"), F.lit(1 - meta).cast("long").alias("violations"),
                 F.lit(bool(meta)).alias("passed")))).alias("r"), F.col("n").alias("total")) \
        .select(F.lit("churn_feature_dataset").alias("table"), "r.check", "r.violations", "total", "r.passed")
    return rules.unionByName(extra)


# ----------------------------------------------------------------- C17
def distribution_summary(ds: DataFrame, features: list[str]) -> DataFrame:
    """C17: mean, median, p95, min, max per feature (long form, one job)."""
    st = ds.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                       for c in features])).alias("r")).select("r.*")
    middle = exact_quantiles(st, ["feature"], "value", {"median": 0.5, "p95": 0.95})
    ends = st.groupBy("feature").agg(F.round(F.avg("value"), 2).alias("mean"), F.round(F.min("value"), 2).alias("min"),
                                     F.round(F.max("value"), 2).alias("max"))
    return ends.join(middle, "feature", "left").select(
        "feature", "mean", F.round("median", 2).alias("median"), F.round("p95", 2).alias("p95"), "min", "max")


# ----------------------------------------------------------------- C18
def missing_customer_diagnosis(fb) -> DataFrame:
    """Eligible customers without any pre-cutoff item, with their order
    and item counts and date ranges, and a verdict. One grouped pass instead
    of per-customer jobs; dates are summarised (min / max), never collected."""
    cutoff = fb.cutoff
    kept_items = fb.silver["order_items_clean"].filter(F.col("status") != "Cancelled")
    items = kept_items.groupBy("user_id").agg(
        F.count(F.when(F.col("created_at") < cutoff, 1)).alias("pre_cutoff_items"),
        F.count(F.lit(1)).alias("all_items"),
        F.min("created_at").alias("first_item_at"), F.max("created_at").alias("last_item_at"))
    orders = fb.stamped.orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("pre_cutoff_orders"),
        F.min("created_at").alias("first_order_at"), F.max("created_at").alias("last_order_at"))
    d = orders.join(items, "user_id", "left").fillna({"pre_cutoff_items": 0, "all_items": 0})
    d = d.filter(F.col("pre_cutoff_items") == 0)
    return d.withColumn("verdict", F.when((F.col("all_items") > 0) & (F.col("first_item_at") >= cutoff),
                                          "processing lag: items created after the cutoff")
                        .otherwise("no items"))
