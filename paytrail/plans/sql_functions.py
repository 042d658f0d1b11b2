"""The scalar rules as SQL functions, beside the SQL views.

Their bodies are SQL expressions, so Catalyst inlines them: a query that calls
them is planned like one that spells them out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from paytrail.schemas import PROVIDER_STATUS_MAP


def _status_case() -> str:
    return "CASE state " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PROVIDER_STATUS_MAP.items()) + " ELSE 'failed' END"


# name -> (parameters, result type, body)
FUNCTIONS = {
    "cents_to_dollars": ("cents BIGINT", "DOUBLE", "CAST(cents AS DOUBLE) / 100.0D"),
    "effective_quantity": ("quantity INT", "INT", "CASE WHEN coalesce(quantity, 0) <= 0 THEN 1 ELSE quantity END"),
    "line_cents": ("price DOUBLE, quantity INT", "BIGINT", "CAST(price * 100.0D * CAST(CASE WHEN coalesce(quantity, 0) <= 0 THEN 1 ELSE quantity END AS DOUBLE) AS BIGINT)"),
    "map_provider_status": ("state STRING", "STRING", _status_case()),
    "money_text": ("cents BIGINT", "STRING", "format_string('%.2f', CAST(cents AS DOUBLE) / 100.0D)"),
    "long_date_text": ("at TIMESTAMP_NTZ", "STRING", "date_format(at, 'MMMM d, yyyy')"),
    "int_param": ("value STRING, fallback INT, least INT", "INT",
                  "CASE WHEN value RLIKE '^[+-]?[0-9]+$' AND try_cast(value AS INT) >= least THEN try_cast(value AS INT) ELSE fallback END"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; call them in any ``spark.sql``."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
