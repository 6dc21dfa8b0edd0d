"""Period starts for the dashboards, always relative to an explicit ``as_of``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.tenancy import attach, tenant_bound

PERIODS = ("week", "month", "year")
KINDS = (
    "rolling", "double", "to_date", "calendar", "current", "previous", "compare", "trend",
)


def day(col: Column) -> Column:
    return col.cast("date")


def _minus_months(col: Column, n: int) -> Column:
    """Shift back by months, keeping day and time.

    A day the target month lacks runs over into the next one (31 Dec less a
    month is 1 Dec), as in the original dashboards.
    """
    month = F.trunc(col, "month")
    into_month = col - month.cast("timestamp_ntz")
    return F.add_months(month, -n).cast("timestamp_ntz") + into_month


def _minus_days(col: Column, n: int) -> Column:
    return col - F.make_dt_interval(F.lit(n))


def _first(unit: str, col: Column) -> Column:
    return F.trunc(day(col), unit).cast("timestamp_ntz")


def period_start(period: str, as_of: Column, kind: str = "rolling") -> Column:
    """Start of the window that ends at ``as_of``.

    rolling   7 days / 1 month / 1 year back from the moment
    double    14 days / 2 months / 2 years back
    to_date   7 days back / first of the month / first of the year
    calendar  this Monday / first of the month / first of the year
    current   last 7 calendar days / first of the month / first of the year
    previous  the period of equal length just before ``current``
    compare   14 days back / first of last month / first of last year
    trend     13 days back / 6 days before the month / first of the year
    """
    now = as_of.cast("timestamp_ntz")
    if kind in ("rolling", "double"):
        # An unknown period falls back to the week.
        n = 1 if kind == "rolling" else 2
        if period == "month":
            return _minus_months(now, n)
        if period == "year":
            return _minus_months(now, 12 * n)
        return _minus_days(now, 7 * n)
    if period not in PERIODS:
        raise ValueError(f"unknown period: {period}")
    month, year = _first("month", now), _first("year", now)
    today = day(now).cast("timestamp_ntz")
    table = {
        "to_date": (_minus_days(now, 7), month, year),
        "calendar": (_first("week", now), month, year),
        "current": (_minus_days(today, 6), month, year),
        "previous": (_minus_days(today, 13), _minus_months(month, 1), _minus_months(year, 12)),
        "compare": (_minus_days(now, 14), _minus_months(month, 1), _minus_months(year, 12)),
        "trend": (_minus_days(now, 13), _minus_days(month, 6), year),
    }
    return dict(zip(PERIODS, table[kind]))[period]


def end_of_day(as_of: Column) -> Column:
    """Last second of the day of ``as_of``, the moment the dashboards look from."""
    return day(as_of).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(23), F.lit(59), F.lit(59)
    )


Start = Callable[[Column], Column]


def starting(period: str, kind: str) -> Start:
    return lambda now: period_start(period, end_of_day(now), kind)


def days_before(n: int) -> Start:
    return lambda now: _minus_days(now.cast("timestamp_ntz"), n)


def moment(now: Column) -> Column:
    return now.cast("timestamp_ntz")


def with_starts(
    df: DataFrame,
    clock: DataFrame,
    as_of: datetime | Column | None,
    **starts: Start,
) -> tuple[DataFrame, dict[str, Column]]:
    """Resolve period starts against ``as_of`` or, without it, the last sale.

    A given ``as_of`` folds to literals.  With a single shop the starts are
    scalar subqueries, which the scan can use as filters at run time.  With
    several shops they are attached as one row per shop.
    """
    if as_of is not None:
        now = as_of if isinstance(as_of, Column) else F.lit(as_of)
        return df, {name: fn(now) for name, fn in starts.items()}
    last = F.max("data_venda")
    if tenant_bound(clock) == 1:
        return df, {name: clock.agg(fn(last)).scalar() for name, fn in starts.items()}
    per_shop = clock.groupBy("client_key").agg(
        *[fn(last).alias(f"_start_{name}") for name, fn in starts.items()]
    )
    return attach(df, per_shop), {name: F.col(f"_start_{name}") for name in starts}


def since(
    df: DataFrame, period: str, kind: str, as_of=None, clock: DataFrame | None = None
) -> DataFrame:
    """Rows of ``df`` whose ``data_venda`` lies in the period."""
    df, at = with_starts(
        df, df if clock is None else clock, as_of, start=starting(period, kind)
    )
    return df.filter(F.col("data_venda") >= at["start"])


def items_since(
    itens: DataFrame, clock: DataFrame, as_of: datetime | Column | None, start: Start
) -> DataFrame:
    """Items from the month of the period's start on, where the table is laid out by month.

    With a given ``as_of`` the partitions are pruned before anything is read,
    with a single shop once its last sale is known.  With several shops the
    month in the join keys is left to prune.
    """
    if "mes" not in itens.columns or (as_of is None and tenant_bound(clock) != 1):
        return itens
    _, at = with_starts(clock, clock, as_of, start=start)
    return itens.filter(F.col("mes") >= F.trunc(at["start"], "month"))


def sale_keys(itens: DataFrame, vendas: DataFrame) -> list[str]:
    """Columns that join items with sales: the month too, where both tables are laid out by it."""
    keys = ["client_key", "venda_key"]
    return [*keys, "mes"] if "mes" in itens.columns and "mes" in vendas.columns else keys


def hours_before(col: Column, n: int) -> Column:
    return col.cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(n))


def seconds_between(later: Column, earlier: Column) -> Column:
    gap = later.cast("timestamp_ntz") - earlier.cast("timestamp_ntz")
    return gap.cast("interval second").cast("decimal(20,6)")


def whole_days(later: Column, earlier: Column) -> Column:
    """Full 24-hour days between two moments, rounded down."""
    return F.floor(seconds_between(later, earlier) / 86400).cast("bigint")
