"""Column-expression building blocks shared by every operator.

All of these stay JVM-side (no Python UDFs): they compile into whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's str.strip() removes every Unicode whitespace character; SQL trim() only removes spaces.
_WS = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]"
# A plain decimal/exponent number (what a CSV numeric cell looks like); rejects 1.0d, 0x1p3, ...
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_SPECIAL = r"^[+-]?(inf|infinity|nan)$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """Python-compatible strip of leading/trailing whitespace. Text that starts and ends with a printable
    ASCII character, as nearly all cells do, is taken as it is, without the regular expression."""
    x = col(c)
    plain = F.ascii(x).between(0x21, 0x7E) & F.ascii(F.substring(x, -1, 1)).between(0x21, 0x7E)
    return F.when(plain, x).otherwise(F.regexp_replace(x, f"^{_WS}+|{_WS}+$", ""))


def is_blank(c: str | Column) -> Column:
    return strip_ws(c) == F.lit("")


def parse_number(c: str | Column) -> Column:
    """Text -> double like a lenient numeric parser; anything unparseable is NULL (never NaN).

    Infinity parses to +/-inf so a finiteness check can reject it; NaN text becomes NULL.
    """
    s = F.lower(strip_ws(c))
    return (
        F.when(s.rlike(_NUMBER), s.try_cast("double"))
        .when(s.rlike(r"^[+]?(inf|infinity)$"), F.lit(float("inf")))
        .when(s.rlike(r"^-(inf|infinity)$"), F.lit(float("-inf")))
    )


def is_finite(c: str | Column) -> Column:
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def finite_or_null(c: str | Column) -> Column:
    return F.when(is_finite(c), col(c))


def md5_uniform(salt: str, key: str | Column) -> Column:
    """Deterministic uniform in [0, 1): first 8 hex digits of md5('salt:key') / 2^32."""
    return F.conv(F.substring(md5_of(salt, key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def md5_of(salt: str, key: str | Column) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}:"), col(key).cast("string")))


def md5_below(h: Column, p: float) -> Column:
    """``md5_uniform(...) < p`` (0 < p < 1) for the hash ``h``, read from its digits: lower-case hex of one
    length sorts as the numbers do, and p * 2^32 is exact."""
    return h < F.lit(f"{math.ceil(p * 2**32):08x}")


def hex_prefix_int(h: Column, digits: int) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("decimal(38,0)")


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL (undefined stays NULL, never 0)."""
    return F.when(den != 0, num / den)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def cond_count(cond: Column) -> Column:
    """count_if that treats NULL (unknown) as False, like pandas comparisons with NaN."""
    return F.sum(F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)).cast("bigint")


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def label(feature: str) -> str:
    text = feature.replace("_", " ")
    return text[:1].upper() + text[1:].lower()


def canonical(c: Column, kind: T.DataType) -> Column:
    """The same value with the fields of every struct and the keys of every map in alphabetical order,
    at any depth."""
    if isinstance(kind, T.StructType):
        parts = [canonical(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"], canonical(e["value"], kind.valueType)))
        return F.map_from_entries(F.array_sort(entries, lambda x, y: F.when(x["key"] < y["key"], -1).otherwise(1)))
    return c


def to_json(df: DataFrame, column: str) -> Column:
    """JSON text of a nested column: canonical order, nulls written out."""
    return F.to_json(canonical(F.col(column), df.schema[column].dataType), {"ignoreNullFields": "false"})


def signed_hundredths(c: Column) -> Column:
    """Text of a double with its sign and two decimals, rounded from its exact binary value, ties to even.

    Spark's formatter rounds the shortest decimal text half up, which gives +0.18 for 0.175, a number
    just below. Here the value is split in two parts whose hundredfold is exact."""
    x = F.abs(c)
    near = x.cast("float").cast("double")
    high, low = near * 100.0, (x - near) * 100.0
    whole = F.floor(high + low)
    over = (high - whole - 0.5) + low
    n = F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), whole + 1).otherwise(whole)
    return F.concat(F.when(c < 0, "-").otherwise("+"), F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
