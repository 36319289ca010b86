"""Numbers as they are written in German and Swiss texts, as Column expressions; null for what is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(c: Column) -> Column:
    """Double of "1'234,5", "1’234.5", "1.234,5" or "12.5": apostrophes and spaces part thousands; of point and comma the
    last one is the decimal sign, and a single point before three digits parts thousands only after four digits or more."""
    s = F.regexp_replace(F.trim(c), "['’  ]", "")
    both = F.contains(s, F.lit(".")) & F.contains(s, F.lit(","))
    comma_last = F.rlike(s, F.lit(r",\d*$"))
    plain = (
        F.when(both & comma_last, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(s, F.lit(","), F.lit("")))
        .when(F.rlike(s, F.lit(r"^[+-]?\d{4,}\.\d{3}$")), F.replace(s, F.lit("."), F.lit("")))
        .otherwise(F.replace(s, F.lit(","), F.lit(".")))
    )
    return F.when(F.rlike(plain, F.lit(r"^[+-]?\d+(\.\d+)?$")), plain.cast("double"))


def truncated(c: Column, places: int = 1) -> Column:
    """Cut towards zero to so many decimals."""
    scaled = F.round(c * 10**places, 6)
    return F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)) / 10**places


def like_number(value: Column, like: Column) -> Column:
    """``value`` written as ``like`` is: with its decimals and its decimal sign."""
    places = F.length(F.regexp_extract(like, r"[.,](\d+)$", 1))
    text = F.when(places == 0, F.round(value).cast("bigint").cast("string"))
    for n in (1, 2, 3):
        text = text.when(places == n, F.format_string(f"%.{n}f", F.round(value, n)))
    text = text.otherwise(F.format_string("%.4f", F.round(value, 4)))
    return F.when(F.rlike(like, F.lit(r",\d+$")), F.replace(text, F.lit("."), F.lit(","))).otherwise(text)
