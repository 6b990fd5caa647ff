"""Aggregates and arithmetic that give the same digits whatever the order of addition."""

from pyspark.sql import Column, functions as F

N = "double"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(x, k: int = 2) -> Column:
    """Round half away from zero to k decimals, by floor, so every engine agrees on the digits."""
    x = _col(x)
    size = F.floor(F.abs(x) * float(10 ** k) + 0.5).cast(N) / float(10 ** k)
    return F.when(x < 0, F.lit(0.0) - size).otherwise(size)


def ratio(num, den) -> Column:
    """num / den as double; null when den is zero."""
    return F.try_divide(_col(num).cast(N), _col(den).cast(N))


def pct(num, den, k: int | None = 2) -> Column:
    """100 * num / den, rounded to k decimals (k=None leaves it as it is)."""
    raw = F.try_divide(_col(num).cast(N) * 100.0, _col(den).cast(N))
    return raw if k is None else rnd(raw, k)


def rows() -> Column:
    return F.count(F.lit(1))


def total(c) -> Column:
    """Sum of an integer column as bigint."""
    return F.sum(_col(c).cast("bigint"))


def mean(c) -> Column:
    """Mean of an integer column: exact sum over the non-null count."""
    return ratio(total(c), F.count(_col(c)))


def scaled_sum(c, scale: int) -> Column:
    """Sum of a value that was rounded to 1/scale before, as whole units of it: exact and order-free."""
    return F.sum(F.floor(_col(c) * float(scale) + 0.5))


def exact_sum(c) -> Column:
    """Sum of a double as DECIMAL with nine decimals: order-free, no input is rounded to cents or tenths."""
    return F.sum(_col(c).cast("decimal(28,9)"))


def money_sum(c) -> Column:
    return exact_sum(c).cast(N)


def money_mean(c) -> Column:
    return ratio(money_sum(c), F.count(_col(c)))


def score_mean(c) -> Column:
    return ratio(exact_sum(c), F.count(_col(c)))


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def rank_label(position) -> Column:
    """1st, 2nd, 3rd, then nth."""
    p = _col(position)
    return (F.when(p == 1, "1st").when(p == 2, "2nd").when(p == 3, "3rd")
            .otherwise(F.concat(p.cast("string"), F.lit("th"))))


def padded(number, width: int) -> Column:
    """Number as text with leading zeros; a number wider than ``width`` keeps all its digits."""
    text = _col(number).cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def key_hash(key) -> Column:
    """Non-negative number below 2**32 from a string key, the same in every run."""
    return F.conv(F.substring(F.md5(_col(key)), 1, 8), 16, 10).cast("bigint")
