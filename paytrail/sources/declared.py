"""The model as declared Spark tables: column types, length limits and defaults.

Spark itself fills a column that an insert leaves out, keeps a NULL that an
insert names, and refuses a text over its ``VARCHAR(n)`` and a price over
``DECIMAL(10,2)``.  The tables live in the session's own catalog over a
given folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paytrail.operators.quality import ENUM_RULES, REQUIRED
from paytrail.schemas import LENGTH_LIMITS, PRICE_MAX_ABS
from paytrail.sources.tables import model_schemas

NOW = "current_timestamp()"
# What a column holds that an insert leaves out (``NOW`` stands for the clock).
DEFAULTS = {
    "orders": {"status": "'created'", "metadata": "map()", "created_at": NOW, "updated_at": NOW},
    "order_items": {"quantity": "1", "created_at": NOW},
    "payments": {"currency": "'usd'", "status": "'pending'", "method": "'card'", "created_at": NOW, "updated_at": NOW},
    "payment_events": {"data": "'{}'", "created_at": NOW},
}
PRICE_TYPE = "DECIMAL(10,2)"


def table_ddl(table: str, name: str, location: str, now: str = NOW) -> str:
    """CREATE TABLE of one model table; ``now`` is the SQL expression of the clock."""
    columns = []
    for f in model_schemas()[table].fields:
        limit = LENGTH_LIMITS[table].get(f.name)
        kind = f"VARCHAR({limit})" if limit else PRICE_TYPE if f.name == "price" else f.dataType.simpleString()
        default = DEFAULTS[table].get(f.name)
        if default == NOW:
            default = f"CAST({now} AS {f.dataType.simpleString()})"
        elif default == "map()":
            default = f"CAST(map() AS {f.dataType.simpleString()})"
        columns.append(f"`{f.name}` {kind}" + (f" DEFAULT {default}" if default else ""))
    return f"CREATE TABLE {name} ({', '.join(columns)}) USING parquet LOCATION '{location}'"


def create_tables(spark: SparkSession, root: str, prefix: str, now: str = NOW) -> dict[str, str]:
    """All four tables under ``root``, named ``prefix`` + table; model table -> catalog name."""
    names = {t: f"{prefix}{t}" for t in DEFAULTS}
    for t, name in names.items():
        spark.sql(table_ddl(t, name, f"{root.rstrip('/')}/{t}", now))
    return names


def insert(rows: DataFrame, name: str) -> None:
    """Insert ``rows`` by column name; columns that ``rows`` does not have take their defaults."""
    view = f"rows_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    try:
        rows.sparkSession.sql(f"INSERT INTO {name} BY NAME SELECT * FROM {view}")
    finally:
        rows.sparkSession.catalog.dropTempView(view)


# ------------------------------------------------------------ checks while writing ---
def violation_counts(table: str) -> dict[tuple[str, str], object]:
    """(rule, column) -> aggregate that counts the rows of ``table`` which break the rule."""
    out = {("enum", c): F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*allowed)) for (t, c), allowed in ENUM_RULES.items() if t == table}
    out |= {("required", c): F.count_if(F.col(c).isNull()) for c in REQUIRED[table]}
    out |= {("length", c): F.count_if(F.char_length(c) > n) for c, n in LENGTH_LIMITS[table].items()}
    if table == "order_items":
        out["length", "price"] = F.count_if(F.abs(F.round("price", 2)) >= PRICE_MAX_ABS)
    return out


class Observed:
    """Counts D1, D2 and D4 of rows in the pass that writes them; no other scan.

    ``frame`` is what to write; ``violations()`` waits for the write.
    """

    def __init__(self, rows: DataFrame, table: str):
        self.table, self._rules = table, violation_counts(table)
        self._seen = Observation(f"{table}-{uuid.uuid4().hex[:8]}")
        named = [c.alias(f"{rule}|{column}") for (rule, column), c in self._rules.items()]
        self.frame = rows.observe(self._seen, F.count(F.lit(1)).alias("rows"), *named)

    def violations(self) -> list[tuple[str, str, str, int, int]]:
        """(table, rule, column, rows, violations)."""
        got = self._seen.get
        return [(self.table, rule, column, got["rows"], got[f"{rule}|{column}"]) for rule, column in self._rules]
