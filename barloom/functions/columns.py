"""Column expressions that the panel operators share.

A missing value is always NULL, never NaN: quotients go through try_divide and
logarithms of what is not positive are NULL, so infinities do not arise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """c as a double: text that is no number, NaN and infinities become NULL."""
    x = _col(c).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def log_ratio_pct(a: str | Column, b: str | Column) -> Column:
    """ln(a / b) * 100; NULL unless the quotient is positive."""
    return F.ln(F.try_divide(_col(a), _col(b))) * 100


def share_pct(a: str | Column, b: str | Column) -> Column:
    """(a - b) / b * 100."""
    return F.try_divide(_col(a) - _col(b), _col(b)) * 100


def zero_to_null(c: str | Column) -> Column:
    return F.nullif(_col(c), F.lit(0.0))


def full(c: Column, n: int, agg: Callable[[Column], Column], w: WindowSpec) -> Column:
    """agg over the last n rows, NULL unless all n hold a value."""
    rows = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(rows) == n, agg(c).over(rows))


def log_return(c: str | Column, n: int, w: WindowSpec) -> Column:
    return log_ratio_pct(c, F.lag(_col(c), n).over(w))


def log_change(c: str | Column, n: int, w: WindowSpec) -> Column:
    """log_return of a quantity whose zeros count as missing."""
    return log_return(zero_to_null(c), n, w)


def rolling_vol(c: str | Column, n: int, w: WindowSpec) -> Column:
    """Sample standard deviation of the last n values."""
    return full(_col(c), n, F.stddev_samp, w)


def ma_gap(c: str | Column, n: int, w: WindowSpec) -> Column:
    """How far c lies above its own n-row mean, in percent."""
    return share_pct(c, full(_col(c), n, F.avg, w))


def rolling_zscore(c: str | Column, n: int, w: WindowSpec) -> Column:
    x = _col(c)
    return F.try_divide(x - full(x, n, F.avg, w), full(x, n, F.stddev_samp, w))


def forward_return(c: str | Column, h: int, w: WindowSpec) -> Column:
    """ln(value h rows ahead / value) * 100."""
    if h < 1:
        raise ValueError(f"the horizon must be at least 1, not {h}")
    return log_ratio_pct(F.lead(_col(c), h).over(w), c)


def direction(c: str | Column) -> Column:
    """1 where c is positive, else 0, also where it is missing."""
    return F.coalesce((_col(c) > 0).cast("int"), F.lit(0))


def weighted_average(value: str | Column, weight: str | Column) -> Column:
    """Aggregate: mean of value over rows where both are known and the weight is positive; NULL if none."""
    v, w = _col(value), _col(weight)
    ok = v.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def months_diff(a: Column, b: Column) -> Column:
    """Calendar months from b to a, days ignored."""
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def contract_period(contract: str | Column, product: str | Column) -> Column:
    """First day of the delivery month of CODE + YY + MM; NULL where the rest is no such month."""
    c, p = _col(contract), _col(product)
    rest = F.when(F.startswith(c, p), F.substring(c, F.length(p) + 1, F.length(c)))
    digits = F.regexp_extract(rest, r"^(\d{4})$", 1)
    year, month = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    return F.when(month.between(1, 12), F.make_date(year + 2000, month, F.lit(1)))
