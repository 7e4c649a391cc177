"""Business-day arithmetic in closed form (no holiday calendar), weeks and trading sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONDAY = "DATE'1970-01-05'"


def is_business_day(d: Column) -> Column:
    return F.weekday(d) < 5


def bday_ord(d: Column) -> Column:
    """Number of weekdays from Monday 1970-01-05 up to d (weekends count as the following Monday)."""
    days = F.date_diff(d, F.expr(MONDAY))
    return (F.floor(days / 7.0) * 5 + F.least(F.weekday(d), F.lit(5))).cast("int")


def ord_bday(o: Column) -> Column:
    """The weekday with the given ordinal."""
    weeks = F.floor(o / 5.0).cast("int")
    return F.date_add(F.expr(MONDAY), (weeks * 7 + (o - weeks * 5)).cast("int"))


def bday_add(d: Column, n: int) -> Column:
    """n weekdays on; from a weekend, +1 is Monday and -1 is Friday."""
    roll = F.when(~is_business_day(d), 1).otherwise(0) if n > 0 else F.lit(0)
    return ord_bday(bday_ord(d) + n - roll)


def bday_distance(a: Column, b: Column) -> Column:
    """Weekdays in [a, b), 0 if b is not after a."""
    return F.greatest(bday_ord(b) - bday_ord(a), F.lit(0))


def iso_week(d: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def week_bounds(d: Column) -> tuple[Column, Column]:
    """Monday and Friday of the week."""
    start = F.to_date(F.date_trunc("WEEK", d))
    return start, F.date_add(start, 4)


def execution_timestamp(d: Column, hour: int, minute: int, second: int = 0) -> Column:
    return d.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute), F.lit(second))


def session_alignment(ts: Column, zone: str = "America/New_York") -> tuple[Column, Column]:
    """(signal day, bucket) of a UTC time: weekend and post-market items belong to the next weekday."""
    local = F.from_utc_timestamp(ts, zone)
    day, minute = F.to_date(local), F.hour(local) * 60 + F.minute(local)
    bucket = F.when(~is_business_day(day), "weekend").when(minute < 570, "pre_market").when(minute < 960, "regular").otherwise("post_market")
    signal = F.when(bucket.isin("weekend", "post_market"), bday_add(day, 1)).otherwise(day)
    return signal, bucket


def business_days(spark: SparkSession, start: Column, end: Column) -> DataFrame:
    """Weekday dimension (date, ordinal) of [start, end]."""
    days = spark.range(1).select(F.explode(F.sequence(start, end)).alias("date"))
    return days.where(is_business_day(F.col("date"))).select("date", bday_ord(F.col("date")).alias("ordinal"))


def weekly_fridays(spark: SparkSession, anchor: Column, n: int) -> DataFrame:
    """The last n Fridays up to the anchor."""
    friday = F.date_sub(anchor, F.pmod(F.weekday(anchor) + 3, F.lit(7)).cast("int"))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(friday, 7 * (n - 1)), friday, F.expr("interval 7 days"))).alias("as_of"))
