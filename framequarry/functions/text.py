"""Numbers as text, digit by digit as C prints them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def printed(x: Column, digits: int) -> Column:
    """``x`` with so many digits: the double itself is rounded, ties to even; format_string rounds its shortest decimal half up.

    Whether a product that looks like a tie is one follows from its rounding error, which two halves of ``x`` give exactly.
    """
    c = float(10**digits)
    p, t = x * c, x * 134217729.0  # 2^27 + 1
    high = t - (t - x)
    off = (high * c - p) + (x - high) * c
    tie = F.abs(p - F.floor(p)) == 0.5
    k = F.when(tie & (off > 0), F.floor(p) + 1).when(tie & (off < 0), F.floor(p)).otherwise(F.rint(p).cast("long"))
    whole, rest = F.abs(k) / F.lit(10**digits), F.abs(k) % F.lit(10**digits)
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(whole).cast("string"), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))
    return F.when(x.isNull(), F.lit(None).cast("string")).when(F.abs(p) < 2.0**50, text).otherwise(F.format_string(f"%.{digits}f", x))


def exact_sum(x: Column, digits: int = 6) -> Column:
    """Sum of doubles of at most so many decimals, the same in any order; of others (finer, huge, not finite) the plain sum."""
    d = F.when((F.abs(x) < 1e15) & (F.round(x, digits) == x), x).try_cast(f"decimal(27,{digits})")
    return F.when(F.count(d) == F.count(x), F.sum(d).cast("double")).otherwise(F.sum(x))


def steady_sum(x: Column, digits: int = 14) -> Column:
    """Sum of doubles below 1e14 in whole units of 10^-digits, so the same in any order and without its rounding errors; of others the plain sum."""
    d = F.when(F.abs(x) < 1e14, x).try_cast(f"decimal({14 + digits},{digits})")
    return F.when(F.count(d) == F.count(x), F.sum(d).cast("double")).otherwise(F.sum(x))
