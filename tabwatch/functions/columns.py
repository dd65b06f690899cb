"""Column-level helpers (all JVM-side expressions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabwatch.spec import NUMERIC_PATTERN


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """Division that yields NULL instead of raising on a zero denominator (ANSI mode)."""
    return F.try_divide(col_(num), col_(den))


def as_number(c) -> Column:
    """The column as double; NaN is missing, like NULL."""
    x = col_(c).cast("double")
    return F.when(~F.isnan(x), x)


def missing(df, name: str) -> Column:
    """NULL, or NaN in a floating-point column."""
    c = F.col(name)
    return c.isNull() | F.isnan(c) if df.schema[name].dataType.typeName() in ("float", "double") else c.isNull()


def to_number(c) -> Column:
    """Text -> double the way a lenient numeric parser would: plain decimal / exponent text only.

    ``try_cast`` alone accepts "1d", "NaN" and "Infinity"; the regex guard turns those into NULL.
    Non-string input is cast to double with NaN / inf mapped to NULL.
    """
    c = col_(c)
    text = c.cast("string")
    parsed = F.when(text.rlike(NUMERIC_PATTERN), F.trim(text).try_cast("double"))
    return F.when(F.abs(parsed) < F.lit(float("inf")), parsed)


def to_integral(c) -> Column:
    """Double -> int when integral and within range, else NULL (fractional targets are quarantined)."""
    c = col_(c)
    return F.when(c == F.floor(c), c.try_cast("int"))


def clip(c, lower, upper) -> Column:
    """Clip to [lower, upper]; NULL stays NULL (least/greatest would skip it) and NaN becomes NULL."""
    c = col_(c)
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), F.least(F.greatest(c, col_(lower)), col_(upper)))


def first_match(rules, c) -> Column:
    """Chained first-match-wins conditions: rules = ((op, value, label), ...); no match -> NULL."""
    c = col_(c)
    ops = {
        "<=": lambda x, v: x <= v, "<": lambda x, v: x < v, "==": lambda x, v: x == v,
        ">=": lambda x, v: x >= v, ">": lambda x, v: x > v, "!=": lambda x, v: x != v,
    }
    out = None
    for op, value, label in rules:
        cond = ops[op](c, F.lit(value))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def compare(op: str, left, right) -> Column:
    left, right = col_(left), col_(right)
    return {
        "==": left == right, "!=": left != right, "<": left < right,
        "<=": left <= right, ">": left > right, ">=": left >= right,
    }[op]


def hash_order(seed, key_cols) -> Column:
    """Seeded per-row shuffle key: md5 hex of seed and the row key (identical in DuckDB)."""
    parts = [F.lit(str(seed))] + [col_(k).cast("string") for k in key_cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_unit(h) -> Column:
    """First 32 bits of an md5 hex string as a number in [0, 2^32)."""
    return F.conv(F.substring(col_(h), 1, 8), 16, 10).cast("long")


def round_half_away(c, digits: int = 6) -> Column:
    """Round the binary double half away from zero: sign(x) * floor(|x| * 10^d + 0.5) / 10^d.

    ``F.round`` rounds the decimal text of the double (HALF_UP), so a value such as
    333/640 = 0.5203125 rounds differently from engines that round the binary value.
    This form is bit-identical with SQL ``round`` in DuckDB.
    """
    c = col_(c)
    scale = float(10 ** digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def case_lookup(key, values: dict, cast: str = "double") -> Column:
    """Literal per-key lookup as a CASE chain (keys bounded by the feature / label count).

    Used instead of ``create_map(...)[key]``, whose generated code does not compile in some
    aggregation contexts (the plan then falls back to interpreted evaluation).
    """
    key = col_(key)
    out = None
    for k, v in values.items():
        lit = F.lit(v).cast(cast)
        out = F.when(key == F.lit(k), lit) if out is None else out.when(key == F.lit(k), lit)
    return out if out is not None else F.lit(None).cast(cast)
