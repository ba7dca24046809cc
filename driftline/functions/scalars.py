"""Scalar column functions.  All are plain Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EPS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NaN and infinities become NULL."""
    x = _c(x).cast("double")
    # NaN sorts above every number, so it fails the comparison as well.
    return F.when(F.abs(x) < float("inf"), x)


def ratio(a, b) -> Column:
    """a / b, NULL when b is zero."""
    return _c(a) / F.nullif(_c(b).cast("double"), F.lit(0.0))


def safe_log(x) -> Column:
    """Natural log; zero and negative input give NULL."""
    x = _c(x).cast("double")
    return F.when(x > 0, F.log(x))


def log_return(later, now) -> Column:
    return safe_log(ratio(later, now))


def coerce_numeric(x) -> Column:
    """Text or number to double; what does not parse, or is not finite, is NULL."""
    return finite(_c(x).try_cast("double"))


def clip(x, low=None, high=None) -> Column:
    x = _c(x)
    out = x
    if low is not None:
        out = F.when(x < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(x > high, F.lit(high)).otherwise(out)
    return out


def entropy(p) -> Column:
    """Shannon entropy (nats) of an array of probabilities."""
    return -F.aggregate(
        _c(p),
        F.lit(0.0),
        lambda acc, v: acc + v * F.log(F.greatest(F.least(v, F.lit(1.0)), F.lit(EPS))),
    )


def day_of(ts="ts") -> Column:
    return _c(ts).cast("date")


def day_number(ts="ts") -> Column:
    return F.datediff(day_of(ts), F.lit("1970-01-01").cast("date"))


def at_time(day, hhmm: str) -> Column:
    """Timestamp of a clock time on the given day."""
    hour, minute = (int(v) for v in hhmm.split(":"))
    step = F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute), F.lit(0))
    return _c(day).cast("timestamp_ntz") + step


def tuple_text(*cols) -> Column:
    """"(a,b,c)" """
    return F.concat(F.lit("("), F.concat_ws(",", *[_c(c).cast("string") for c in cols]), F.lit(")"))


def cycle_name(no, first_day, last_day) -> Column:
    return F.format_string("C%03d_%s_to_%s", _c(no).cast("int"), _c(first_day).cast("string"),
                           _c(last_day).cast("string"))


def seed_triplet(i) -> Column:
    """Struct of the three seeds of sweep number i."""
    i = _c(i).cast("long")
    return F.struct(
        (i * 13 + 5).alias("rs_5m"), (i * 17 + 7).alias("rs_30m"), (i * 19 + 11).alias("rs_1d")
    )


def triplet_text(a="rs_5m", b="rs_30m", c="rs_1d") -> Column:
    return F.concat_ws("_", *[_c(v).cast("string") for v in (a, b, c)])


def fold_number(path) -> Column:
    """Fold number from a file path, NULL when no part of it names one.

    A directory `fold_7` is fold 7, a sweep directory `S006` is fold 7 as well
    (sweeps count from 0) and `LIVE7_...` is fold 7.  The first such directory counts.
    """
    parts = F.split(_c(path), "/")

    def number(part):
        return F.coalesce(
            F.regexp_extract(part, r"(?i)^fold_(\d+)$", 1).try_cast("int"),
            F.regexp_extract(part, r"(?i)^s(\d+)$", 1).try_cast("int") + 1,
            F.regexp_extract(part, r"(?i)^live(\d+)_", 1).try_cast("int"),
        )

    return F.get(F.filter(F.transform(parts, number), lambda n: n.isNotNull()), F.lit(0))


def fold_name(n) -> Column:
    n = _c(n).cast("int")
    return F.when(n.isNotNull(), F.format_string("fold_%03d", n))
