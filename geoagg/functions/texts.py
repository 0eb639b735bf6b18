"""Number and time texts of metadata values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a decimal number and as an RFC 3339 time.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def parse_number(text: Column) -> Column:
    """The value of a decimal number, else null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_time(text: Column) -> Column:
    """The instant of an RFC 3339 text, else null."""
    return F.when(text.rlike(TIME), text.try_cast("timestamp"))


def shortest(value: Column) -> Column:
    """A number in its shortest digits; with an exponent of two digits at least below 1e-4 and from 1e6 on."""
    v = value.cast("double")
    plain = F.regexp_replace(F.format_string("%.17f", v), r"\.?0+$", "")
    text = v.cast("string")
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)", 1), r"\.", "")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)", 1), r"\.0$", "")
    exponent = F.floor(F.log10(F.abs(v))).cast("int")
    significant = F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", "")
    shown = F.concat(F.when(v < 0, "-").otherwise(""), F.substring(significant, 1, 1), F.when(F.length(significant) > 1, F.concat(F.lit("."), F.substring(significant, F.lit(2), F.length(significant)))).otherwise(""))
    scientific = F.concat(shown, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    whole = F.when(v == F.floor(v), v.cast("decimal(20,0)").cast("string"))
    small = (F.abs(v) < 1e-3) & (F.abs(v) >= 1e-4)
    return F.when(v == 0, "0").when((F.abs(v) < 1e-4) | (F.abs(v) >= 1e6), scientific).when(whole.isNotNull(), whole).when(small, plain).otherwise(mantissa)
