"""ISO 8601 text to epoch nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar dates, extended or basic, with an optional time of any precision and an optional
# offset. Spark alone would also take a bare year or a zone name, hence the gate.
_ISO = (
    r"^\d{4}(-\d{2}-\d{2}|\d{4})"
    r"([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
# What Spark parses as it stands; everything else is put in this form first.
_SPARK_FORM = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"


def _spark_form(text: Column) -> Column:
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    text = F.regexp_replace(text, ",", ".")
    text = F.regexp_replace(text, r"([T ]\d{2}):?(\d{2}):?(\d{2})", "$1:$2:$3")
    text = F.regexp_replace(text, r"([T ]\d{2}):?(\d{2})(?=$|Z|[+-])", "$1:$2:00")
    text = F.regexp_replace(text, r"([T ]\d{2})(?=$|Z|[+-])", "$1:00:00")
    text = F.regexp_replace(text, r"(:\d{2}|\.\d+)([+-]\d{2}):?(\d{2})$", "$1$2:$3")
    return F.regexp_replace(text, r"(:\d{2}|\.\d+)([+-]\d{2})$", "$1$2:00")


def parse_ts_ns(text: Column) -> Column:
    """Nanoseconds since the epoch, exact to the microsecond; null if it is no ISO time.

    A time without an offset is read as UTC, so that the answer does not depend on the
    machine. Years that do not fit BIGINT nanoseconds (1677 to 2262) give null.
    """
    formed = F.when(text.rlike(_SPARK_FORM), text).otherwise(_spark_form(text))
    micros = F.unix_micros(F.try_to_timestamp(formed))
    return F.when(text.rlike(_ISO), F.try_multiply(micros, F.lit(1000).cast("bigint")))
