"""Scalar functions of the warehouse, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaselake.schemas import TIME_PATTERN


def event_time(text: Column) -> Column:
    """A source time string as an instant: strict pattern with six fraction digits,
    cut to milliseconds, in the session's zone (which jobs set to the sources'
    +08:00, so that bounds are printed in it too). Other texts give null."""
    shaped = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}$"), text)
    return F.date_trunc("millisecond", F.try_to_timestamp(shaped, F.lit(TIME_PATTERN)))


def day_of(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def second_of(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def members(comma_list: Column) -> Column:
    """A comma-separated list as an array, blanks around names dropped."""
    return F.transform(F.split(comma_list, ","), lambda x: F.trim(x))


def blank_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Null strings become empty ones, as the dimension tables keep them."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns})


def snake_case(name: str) -> str:
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def camel_case(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def renamed(df: DataFrame, rule) -> DataFrame:
    """All columns renamed by ``rule``, such as ``snake_case`` at a sink."""
    return df.select([F.col(c).alias(rule(c)) for c in df.columns])


def json_lines(df: DataFrame, rule=None) -> DataFrame:
    """One JSON object per row in column ``value``; null fields are left out."""
    named = renamed(df, rule) if rule else df
    return named.select(F.to_json(F.struct(*[F.col(c) for c in named.columns])).alias("value"))
