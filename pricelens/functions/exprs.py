"""Column-expression helpers shared by every operator.

All of these are plain Catalyst expressions (no Python UDFs), so they stay inside whole-stage
codegen. Each one fixes a place where pandas and Spark semantics differ (see SURVEY §0).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nz(den) -> Column:
    """Denominator with 0 mapped to 1 (pandas ``.replace(0, 1)``); null stays null."""
    den = c(den)
    return F.when(den == 0, F.lit(1)).otherwise(den)


def safe_div(num, den) -> Column:
    """num / den with a zero denominator mapped to 1."""
    return c(num) / nz(den)


def try_div(num, den) -> Column:
    """num / den, null when den is 0 or null (ANSI-safe)."""
    den = c(den)
    return F.when(den != 0, c(num) / den)


def flag(cond: Column) -> Column:
    """Boolean → 0/1 int where a null comparison counts as False."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def guard_greatest(x, lo) -> Column:
    """``np.maximum(lo, x)`` keeping null when x is null."""
    x = c(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(lo)))


def clip(x, lo, hi) -> Column:
    x = c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def round_to(x, digits: int) -> Column:
    """Round through an explicit scale so Spark and DuckDB agree bit-for-bit: round(x·10^d)/10^d."""
    scale = float(10 ** digits)
    return F.round(c(x) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)  # + 0.0: no negative zero


def r6(x) -> Column:
    return round_to(x, 6)


def weekday(ts) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(c(ts))


def epoch_micros(ts) -> Column:
    """Epoch microseconds of a wall-clock timestamp (the session zone is UTC, T25)."""
    return F.unix_micros(c(ts).cast("timestamp"))


def floor_days_between(a, b) -> Column:
    """``(a - b).days`` — floored whole days between two timestamps."""
    return F.floor((epoch_micros(a) - epoch_micros(b)) / F.lit(float(DAY_MICROS)))


# --- fixed values: the holiday calendar used by the seasonality features --------------------
# Fixed values that must equal the reference's (major US holidays, 2020-2024, year, month, day):
US_HOLIDAYS = [
    (2020, 1, 1), (2020, 1, 20), (2020, 2, 17), (2020, 5, 25), (2020, 7, 4),
    (2020, 9, 7), (2020, 10, 12), (2020, 11, 11), (2020, 11, 26), (2020, 12, 25),
    (2021, 1, 1), (2021, 1, 18), (2021, 2, 15), (2021, 5, 31), (2021, 7, 4),
    (2021, 9, 6), (2021, 10, 11), (2021, 11, 11), (2021, 11, 25), (2021, 12, 25),
    (2022, 1, 1), (2022, 1, 17), (2022, 2, 21), (2022, 5, 30), (2022, 7, 4),
    (2022, 9, 5), (2022, 10, 10), (2022, 11, 11), (2022, 11, 24), (2022, 12, 25),
    (2023, 1, 1), (2023, 1, 16), (2023, 2, 20), (2023, 5, 29), (2023, 7, 4),
    (2023, 9, 4), (2023, 10, 9), (2023, 11, 11), (2023, 11, 23), (2023, 12, 25),
    (2024, 1, 1), (2024, 1, 15), (2024, 2, 19), (2024, 5, 27), (2024, 7, 4),
    (2024, 9, 2), (2024, 10, 14), (2024, 11, 11), (2024, 11, 28), (2024, 12, 25),
]
# The year-relative holiday list (month, day) used by the simpler proximity rule.
YEAR_HOLIDAYS = [(1, 1), (7, 4), (11, 24), (12, 25), (2, 14), (5, 10), (6, 15), (11, 27)]
HOLIDAY_WINDOW_DAYS = 7


def near_holiday_dates(holidays=US_HOLIDAYS, days: int = HOLIDAY_WINDOW_DAYS) -> list[_dt.date]:
    """Every calendar date whose floored distance to a listed holiday is within ``days``.

    ``abs(floor((t - h) / 1 day)) <= d`` with h at midnight equals ``date(t)`` within d days of h,
    so the proximity test reduces to a hash-set membership on the launch date (codegen'd InSet).
    """
    out = set()
    for y, m, d in holidays:
        h = _dt.date(y, m, d)
        for k in range(-days, days + 1):
            out.add(h + _dt.timedelta(days=k))
    return sorted(out)


def holiday_flag(ts, holidays=US_HOLIDAYS, days: int = HOLIDAY_WINDOW_DAYS) -> Column:
    """1 if the timestamp lies within ``days`` floored days of a listed holiday, else 0."""
    d = F.to_date(c(ts))
    return flag(d.isin([F.lit(x) for x in near_holiday_dates(holidays, days)]))


def year_holiday_flag(ts, days: int = HOLIDAY_WINDOW_DAYS) -> Column:
    """Within ``days`` of one of the fixed month-days of the date's own year (no wrap)."""
    d = F.to_date(c(ts))
    hol = F.array(*[F.make_date(F.year(d), F.lit(m), F.lit(dd)) for m, dd in YEAR_HOLIDAYS])
    return F.when(d.isNull(), F.lit(0)).otherwise(
        flag(F.exists(hol, lambda h: F.abs(F.datediff(d, h)) <= days)))


def positive_tiers(arr) -> Column:
    """Parsed tier list keeping positive prices; null/empty → []."""
    return F.filter(F.coalesce(c(arr), F.array().cast("array<double>")), lambda x: x > 0)


def parse_tiers_json(txt) -> Column:
    """JSON text → array<double>; malformed, scalar, object or mixed lists → null."""
    return F.from_json(c(txt), "array<double>")


def array_mean(arr) -> Column:
    """Left-to-right mean of a numeric array; 0 when empty."""
    arr = c(arr)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(arr) > 0, total / F.size(arr)).otherwise(F.lit(0.0))


def hash_unit(idcol, salt: int = 0) -> Column:
    """Deterministic pseudo-random integer in [0, 2^32) from an integer id.

    Knuth multiplicative hash of the low 31 bits, so the product of any non-negative id stays inside BIGINT;
    DuckDB computes the same with ``(((id + salt) % 2147483648) * 2654435761) % 4294967296``.
    """
    low = F.pmod(c(idcol) + F.lit(salt), F.lit(2147483648))
    return F.pmod(low * F.lit(2654435761), F.lit(4294967296))


def scalars(df, **aggs) -> dict:
    """Several one-row aggregates as columns usable on any row, from ONE scalar subquery.

    ``scalars(df, m=F.avg("x"), s=F.stddev_samp("x"))["m"]``. The struct subquery is planned once
    and reused wherever a field is referenced (no join, no driver round trip).
    """
    sub = df.agg(F.struct(*[v.alias(k) for k, v in aggs.items()]).alias("_s")).scalar()
    return {k: sub[k] for k in aggs}
