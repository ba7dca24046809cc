"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under `name`."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


# Output conventions, the same on both sides: numbers are rounded, times are text.

def rnd(col, digits: int = 6) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + 0.0


def rounded(digits: int, *names):
    return [rnd(n, digits).alias(n) for n in names]


def time_text(col="ts") -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def day_text(col="day") -> Column:
    return F.col(col).cast("date").cast("string")


def long(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("long")


def sql_rnd(expr: str, digits: int = 6, name: str | None = None) -> str:
    text = f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"
    return f"{text} AS {name}" if name else text


def sql_rounded(digits: int, *names) -> str:
    return ", ".join(sql_rnd(f'"{n}"', digits, f'"{n}"') for n in names)


def sql_time(expr: str = "ts", name: str = "ts") -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


def sql_day(expr: str = "day", name: str = "day") -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name}"
