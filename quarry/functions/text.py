"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt_g(x: Column, digits: int = 4) -> Column:
    """printf ``%.<digits>g`` (trailing zeros stripped), as Python and C print it."""
    e = F.floor(F.log10(F.abs(x)))
    # rounding the mantissa can carry to 10.0: take the exponent after rounding
    carry = F.abs(F.round(x / F.pow(F.lit(10.0), e), digits - 1)) >= 10
    e2 = F.when(carry, e + 1).otherwise(e)
    strip = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    fixed = None
    for d in range(0, digits + 4):
        f = F.format_string(f"%.{d}f", x)
        cond = (F.lit(digits - 1) - e2) == d
        fixed = F.when(cond, f) if fixed is None else fixed.when(cond, f)
    m_txt = strip(F.format_string(f"%.{digits - 1}f", x / F.pow(F.lit(10.0), e2)))
    ae = F.abs(e2).cast("int").cast("string")
    sci = F.concat(m_txt, F.lit("e"), F.when(e2 < 0, "-").otherwise("+"),
                   F.when(F.abs(e2) < 10, F.concat(F.lit("0"), ae)).otherwise(ae))
    use_fixed = (e2 >= -4) & (e2 < digits)
    return (F.when(x.isNull() | F.isnan(x), F.lit("nan")).when(x == 0, F.lit("0"))
            .when(use_fixed, strip(fixed.otherwise(F.lit(None)))).otherwise(sci))


def thousands(x: Column, places: int = 0) -> Column:
    """digits in groups of three, ``places`` decimals."""
    return F.format_number(x, places)


def percent(x: Column, places: int = 1) -> Column:
    """a percentage with ``places`` decimals and its sign."""
    return F.format_string(f"%.{places}f%%", x.cast("double"))


def utc_text(ts: Column) -> Column:
    """a timestamp to the minute, in UTC whatever the session's time zone."""
    return F.concat(F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def to_record(*columns: str) -> Column:
    """a row's columns as a JSON record (nulls left out)."""
    return F.to_json(F.struct(*columns))


def from_record(text: Column, schema: str) -> Column:
    """a JSON record as a struct of ``schema``; null where the text is not one."""
    return F.from_json(text, schema)


def slug(c: Column, default: str = "chart") -> Column:
    """non-alphanumerics -> ``_``, lower case, trimmed; default when empty."""
    s = F.regexp_replace(F.lower(F.regexp_replace(c, "[^0-9A-Za-z]+", "_")), "^_+|_+$", "")
    return F.when((s == "") | s.isNull(), F.lit(default)).otherwise(s)


def compact_label(c: Column, max_len: int = 42) -> Column:
    """at most ``max_len`` characters, the last an ellipsis where text is cut
    (no blanks before it); a dash for nothing."""
    cut = F.concat(F.regexp_replace(F.substring(c, 1, max_len - 1), r"\s+$", ""), F.lit("\u2026"))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("\u2014")).when(F.length(c) > max_len, cut).otherwise(c)


def contains_any(c: Column, words: list[str]) -> Column:
    """substring test for any keyword."""
    out = None
    for w in words:
        t = c.contains(w)
        out = t if out is None else (out | t)
    return out if out is not None else F.lit(False)
