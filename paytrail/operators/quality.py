"""Integrity rules of the SQL schema, re-aimed as data-quality reports.

Each check returns one summary row per (table, column) so an empty violation
set still reports what was checked; ``*_violations`` variants return the
offending rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrail.operators.broadcast import broadcast_if_small
from paytrail.schemas import (LENGTH_LIMITS, ORDER_STATUSES, PAYMENT_METHODS, PAYMENT_STATUSES,
                              PRICE_MAX_ABS)

ENUM_RULES = {
    ("orders", "status"): ORDER_STATUSES,
    ("payments", "status"): PAYMENT_STATUSES,
    ("payments", "method"): PAYMENT_METHODS,
    ("payment_events", "status"): PAYMENT_STATUSES,
}
REQUIRED = {
    "orders": ["id", "tracking_id", "customer_email", "status"],
    "order_items": ["order_id", "product_id", "product_name", "file_type", "price", "quantity"],
    "payments": ["order_id", "amount", "currency", "status"],
    "payment_events": ["order_id", "event_type", "status"],
}
UNIQUE = [("orders", "id"), ("orders", "tracking_id"), ("payments", "order_id")]


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def _unpivot(agg: DataFrame, table: str, names: list[str], value: str) -> DataFrame:
    """One aggregate row with a column per check -> one row per check."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return agg.selectExpr(f"stack({len(names)}, {pairs}) AS (column_name, {value})").select(
        F.lit(table).alias("table_name"), "column_name", value)


def check_enums(tables: dict[str, DataFrame]) -> DataFrame:
    """Per enum column, rows checked and rows whose value is not a member
    (one aggregate pass per table)."""
    out = []
    for table in dict.fromkeys(t for t, _ in ENUM_RULES):
        rules = [(c, allowed) for (t, c), allowed in ENUM_RULES.items() if t == table]
        aggs = [F.count(F.lit(1)).alias("checked_rows")]
        aggs += [F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*allowed)).alias(c) for c, allowed in rules]
        agg = tables[table].agg(*aggs)
        pairs = ", ".join(f"'{c}', `{c}`" for c, _ in rules)
        out.append(agg.selectExpr("checked_rows", f"stack({len(rules)}, {pairs}) AS (column_name, invalid_rows)")
                   .select(F.lit(table).alias("table_name"), "column_name", "checked_rows", "invalid_rows"))
    return _union(out)


def enum_violations(tables: dict[str, DataFrame], key: dict[str, str]) -> DataFrame:
    out = []
    for (table, column), allowed in ENUM_RULES.items():
        df = tables[table]
        out.append(df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).select(
            F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
            F.col(key[table]).cast("string").alias("row_key"), F.col(column).cast("string").alias("value")))
    return _union(out)


def check_required(tables: dict[str, DataFrame]) -> DataFrame:
    """NULL count per NOT NULL column (one pass per table)."""
    out = []
    for table, cols in REQUIRED.items():
        agg = tables[table].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        out.append(_unpivot(agg, table, cols, "null_count"))
    return _union(out)


def check_unique(tables: dict[str, DataFrame]) -> DataFrame:
    """D3: per unique key, how many key values repeat and how many rows they hold.

    Counting is a partial + final hash aggregate, so a hot key is combined
    map-side before the shuffle.
    """
    out = []
    for table, column in UNIQUE:
        counts = tables[table].filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        out.append(counts.agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"),
                              F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))
                   .select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
                           "duplicate_keys", "duplicate_rows"))
    return _union(out)


def duplicate_keys(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def check_lengths(tables: dict[str, DataFrame]) -> DataFrame:
    """VARCHAR(n) overflow per column and DECIMAL(10,2) overflow of prices."""
    out = []
    for table, limits in LENGTH_LIMITS.items():
        df = tables[table]
        aggs = []
        for c, n in limits.items():
            aggs += [F.count_if(F.char_length(F.col(c)) > n).alias(f"{c}__over"),
                     F.coalesce(F.max(F.char_length(F.col(c))), F.lit(0)).alias(f"{c}__max")]
        agg = df.agg(*aggs)
        pairs = ", ".join(f"'{c}', {n}, `{c}__over`, `{c}__max`" for c, n in limits.items())
        out.append(agg.selectExpr(f"stack({len(limits)}, {pairs}) AS (column_name, max_allowed, too_long, max_length)")
                   .select(F.lit(table).alias("table_name"), "column_name", F.col("max_allowed").cast("int"),
                           "too_long", F.col("max_length").cast("int")))
    items = tables["order_items"]
    # DECIMAL(10,2) rounds further decimals; only the rounded value can overflow
    bad_price = F.abs(F.round(F.col("price"), 2)) >= PRICE_MAX_ABS
    out.append(items.agg(F.count_if(bad_price).alias("too_long")).select(
        F.lit("order_items").alias("table_name"), F.lit("price").alias("column_name"),
        F.lit(10).alias("max_allowed"), "too_long", F.lit(None).cast("int").alias("max_length")))
    return _union(out)


def order_defaults(orders: DataFrame, as_of) -> DataFrame:
    """D5 for orders: status created, metadata {}, created_at / updated_at = the clock.

    NULL input is treated as an omitted column.
    """
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    return (orders.withColumn("status", F.coalesce("status", F.lit("created")))
            .withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
            .withColumn("created_at", F.coalesce("created_at", now))
            .withColumn("updated_at", F.coalesce("updated_at", now)))


def payment_defaults(payments: DataFrame, status_col: str = "status") -> DataFrame:
    """D5 for payments: currency usd, status pending, method card."""
    return (payments.withColumn("currency", F.coalesce("currency", F.lit("usd")))
            .withColumn(status_col, F.coalesce(status_col, F.lit("pending")))
            .withColumn("method", F.coalesce("method", F.lit("card"))))


def apply_defaults(orders: DataFrame, payments: DataFrame, as_of) -> DataFrame:
    """Defaults on both tables, one row per order with its payment."""
    o = order_defaults(orders.select("id", "status", "metadata", "created_at", "updated_at"), as_of)
    p = payment_defaults(payments.select(F.col("order_id").alias("id"), "amount", "currency",
                                         F.col("status").alias("payment_status"), "method"), "payment_status")
    return o.join(p, "id", "left")


# ----------------------------------------------------------------- J8 / J9 ---
def _per_order(child: DataFrame) -> DataFrame:
    """Rows per order id: an order with very many rows reaches the join as one."""
    return child.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))


def _sum(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def check_foreign_keys(orders: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Per child table, rows whose order does not exist."""
    ids = orders.select(F.col("id").alias("order_id")).distinct().withColumn("parent", F.lit(True))
    out = []
    for table, df in children.items():
        j = _per_order(df).join(ids, "order_id", "left")
        out.append(j.agg(_sum("n").alias("checked_rows"), _sum(F.when(F.col("parent").isNull(), F.col("n"))).alias("orphan_rows"))
                   .select(F.lit(table).alias("table_name"), "checked_rows", "orphan_rows"))
    return _union(out)


def cascade_delete(deleted_ids: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Children of deleted orders removed (ON DELETE CASCADE)."""
    d = broadcast_if_small(deleted_ids.select(F.col("id").alias("order_id")))
    return {t: df.join(d, "order_id", "left_anti") for t, df in children.items()}


def cascade_summary(deleted_ids: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    d = deleted_ids.select(F.col("id").alias("order_id")).withColumn("gone", F.lit(True))
    out = []
    for t, df in children.items():
        j = _per_order(df).join(d, "order_id", "left")
        out.append(j.agg(_sum(F.when(F.col("gone").isNull(), F.col("n"))).alias("kept_rows"),
                         _sum(F.when(F.col("gone"), F.col("n"))).alias("deleted_rows"))
                   .select(F.lit(t).alias("table_name"), "kept_rows", "deleted_rows"))
    return _union(out)
