"""Instants out of ISO-8601 strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = r"(?i)(z|[+-]\d{2}:?\d{2})\s*$"


def iso_ms(text: Column) -> Column:
    """Epoch milliseconds (UTC, finer digits cut off) of an ISO-8601 string.

    ``T`` or a blank may part date and time, the fraction may have any length up to six digits after a point or comma, and
    the offset may be ``Z``, ``+hh:mm`` or ``+hhmm``. Without an offset the time is UTC whatever the session's zone. Null,
    empty and unreadable strings give null.
    """
    t = F.regexp_replace(F.trim(text), ",", ".")
    t = F.regexp_replace(F.upper(t), r"([+-]\d{2})(\d{2})$", "$1:$2")
    t = F.when(t.rlike(_OFFSET), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), F.unix_millis(t.try_cast("timestamp")))
