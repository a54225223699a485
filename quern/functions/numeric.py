"""Numbers, vectors and dates over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def round_to(x: Column, digits: int) -> Column:
    """Halves toward plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def round_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def unit_interval(x: Column) -> Column:
    """Cut to 0 and 1; null where it is no finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def number_or_null(text: Column) -> Column:
    """A number other than 0, else null."""
    return F.nullif(text.try_cast("double"), F.lit(0.0))


def backoff(attempt: Column) -> Column:
    """Milliseconds before another try: doubled from 5 seconds, 90 at most."""
    return F.least(5000 * F.pow(F.lit(2.0), attempt - 1), F.lit(90000.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def vector_problem(v: Column, size: int, tolerance: float = 1e-3) -> Column:
    """What is wrong with a vector: "missing", "dimension" or "norm"; null if nothing."""
    return F.when(v.isNull(), "missing").when(F.size(v) != size, "dimension").when(F.abs(norm(v) - 1) > tolerance, "norm")


def vector_text(v: Column) -> Column:
    return F.to_json(v)


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def age_on(birth: Column, on: Column) -> Column:
    """Whole years; a birthday later in the year hasn't come yet."""
    early = F.date_format(on, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(on) - F.year(birth) - early.cast("int")


def slot_minutes(slot: Column) -> Column:
    """Minutes since midnight of ``03:30 PM``."""
    part = lambda i: F.regexp_extract(slot, r"^(\d{1,2}):(\d{2}) ([AP]M)$", i)
    return part(1).try_cast("int") % 12 * 60 + part(2).try_cast("int") + F.when(part(3) == "PM", 720).otherwise(0)


def lead_days(scheduled: Column, day: Column) -> Column:
    return F.datediff(F.to_date(day), F.to_date(scheduled))


def lead_bin(days: Column) -> Column:
    """Right-closed bins of lead days; null outside."""
    edges = [(0, "0"), (2, "1-2"), (7, "3-7"), (30, "8-30"), (200, "31-200")]
    out = F.when(days <= -1, F.lit(None).cast("string"))
    for top, name in edges:
        out = out.when(days <= top, name)
    return out


def calendar(bounds: DataFrame) -> DataFrame:
    """A row for each day from ``first`` to ``last`` of the one row of ``bounds``, with its weekday."""
    days = bounds.where("first IS NOT NULL").select(F.explode(F.sequence("first", "last")).alias("day"))
    return days.withColumn("weekday", F.date_format("day", "EEE"))
