"""Scalar helpers with the semantics the operators need."""

from __future__ import annotations

from pyspark.sql import functions as F


def js_round(x: F.Column) -> F.Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def clamp(x: F.Column, low: float = 0.0, high: float = 1.0) -> F.Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_ratio(x: F.Column, y: F.Column, default: float = 0.0) -> F.Column:
    return F.when(y == 0, F.lit(default)).otherwise(x / y)


def uri_component(x: F.Column) -> F.Column:
    """Percent-encoding of all but letters, digits and ``-_.!~*'()``; a space is ``%20``."""
    out = F.url_encode(x)
    for code, char in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, code, char)
    return out


def code_hash(text: F.Column) -> F.Column:
    """The 31-multiplier hash of the characters modulo 2^32, over 2^32 - 1: a number in [0, 1]."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    total = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c) % F.lit(1 << 32))
    return total / F.lit(float((1 << 32) - 1))


def sha256(*parts: F.Column) -> F.Column:
    return F.sha2(F.concat_ws("|", *parts), 256)
