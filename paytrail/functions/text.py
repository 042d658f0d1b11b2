"""String helpers used by documents, events and the outbox."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paytrail.schemas import TRACKING_URL_PREFIX


def or_empty(c: Column) -> Column:
    """Null-safe getter, null -> ''."""
    return F.coalesce(c, F.lit(""))


def keep_if_non_empty(new: Column, old: Column) -> Column:
    """Overwrite only with a non-empty value."""
    return F.when(F.coalesce(new, F.lit("")) != F.lit(""), new).otherwise(old)


def null_if_empty(c: Column) -> Column:
    """``omitempty``: '' becomes absent (null) so ``to_json`` drops it."""
    return F.when(c == F.lit(""), F.lit(None).cast("string")).otherwise(c)


def tracking_url(tracking_id: Column) -> Column:
    """Customer-facing tracking link."""
    return F.concat(F.lit(TRACKING_URL_PREFIX), tracking_id)


def long_date_text(ts: Column) -> Column:
    """Go's ``January 2, 2006`` layout."""
    return F.date_format(ts, "MMMM d, yyyy")


def int_param(value: str | None, default: int, minimum: int) -> int:
    """Integer parameter with fallback; values below ``minimum`` or
    unparsable text fall back to the default (as the list endpoints do)."""
    if value is None or value == "":
        return default
    try:
        parsed = int(str(value).strip())
    except ValueError:
        return default
    return parsed if parsed >= minimum else default


def provider_id(c: Column) -> Column:
    """Id of a provider reference, given as the id itself or as the expanded object."""
    return F.when(F.startswith(F.ltrim(c), F.lit("{")), F.get_json_object(c, "$.id")).otherwise(c)
