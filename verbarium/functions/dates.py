"""Date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish and English month names in the order of the year.
MONTHS_ES = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
MONTHS_EN = "january february march april may june july august september october november december".split()
_FORMATS = ("d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy", "d/M/yy", "yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d")


def parse_fuzzy(c: Column) -> Column:
    """Day-first dates with month names of either language, null if nothing fits."""
    text = F.lower(F.trim(c))
    for names in (MONTHS_ES, MONTHS_EN):
        for i, name in enumerate(names, 1):
            short = f"{name[:3]}(?:{name[3:]})?" if len(name) > 3 else name
            text = F.regexp_replace(text, rf"\b{short}\b\.?", str(i))
    text = F.regexp_replace(text, r"setiembre", "9")
    text = F.regexp_replace(text, r"^\D*(?=\d)", "")
    text = F.regexp_replace(text, r"(?<=\d)(st|nd|rd|th)\b", "")
    text = F.regexp_replace(text, r"t(?=\d)|,|\bde\b|\bdel\b|\ba las\b|\bat\b|hs?\.?$|z$", " ")
    text = F.regexp_replace(text, r"^\s*(\d{1,4})\s*[-/. ]\s*(\d{1,2})\s*[-/. ]\s*(\d{1,4})", "$1/$2/$3")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[.]\d+$", ""), r"\s+", " "))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in _FORMATS]).cast("timestamp_ntz")


def day(c: Column) -> Column:
    """C31."""
    return F.date_trunc("day", c)


def grid(first: Column, last: Column) -> Column:
    """The days from first to last."""
    return F.sequence(first.cast("date"), last.cast("date"), F.expr("interval 1 day"))


def date_from(c: Column, pattern: str) -> Column:
    """A date from year, month and day groups of a pattern; null without them."""
    year, month, number = (F.regexp_extract(c, pattern, i).try_cast("int") for i in (1, 2, 3))
    return F.when(year.isNotNull() & month.between(1, 12) & number.between(1, 31), F.try_make_timestamp_ntz(year, month, number, F.lit(0), F.lit(0), F.lit(0)).cast("date") if hasattr(F, "try_make_timestamp_ntz") else F.make_date(year, month, number))


def elapsed(start: Column, end: Column) -> Column:
    """Whole seconds."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)).cast("int")
