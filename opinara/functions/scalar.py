"""Casting, recoding, text and formatting expressions with survey-export semantics."""

from __future__ import annotations

import re
from statistics import NormalDist

from pyspark.sql import Column, functions as F

# Numbers in text exports, words read as true and false, percentile breaks of plots.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
TRUE_WORDS = ("T", "TRUE", "true", "True")
FALSE_WORDS = ("F", "FALSE", "false", "False")
PERCENTILE_BREAKS = (0.005, 0.1, 0.5, 0.9, 0.995)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_int(c: Column | str) -> Column:
    """Text to integer: decimals are cut towards zero, anything that is no number becomes null."""
    text = _col(c).cast("string")
    number = F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
    return number.try_cast("int")


def to_bool(c: Column | str) -> Column:
    """Text to boolean; other words, the digits included, become null."""
    text = _col(c).cast("string")
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


def to_ts(c: Column | str) -> Column:
    """ISO text to timestamp in the session time zone, null where it does not parse."""
    return F.try_to_timestamp(_col(c).cast("string"))


def if_else_na(cond: Column, yes, no) -> Column:
    """Two-way choice that is null where the condition is null (``when`` alone would say ``no``)."""
    return F.when(cond, yes).when(~cond, no)


def case_when(*pairs: tuple[Column, object], default=None) -> Column:
    """First matching branch; a null condition does not match."""
    out = F.when(*pairs[0])
    for cond, value in pairs[1:]:
        out = out.when(cond, value)
    return out if default is None else out.otherwise(default)


def extract_na(c: Column | str, pattern: str, group: int = 0) -> Column:
    """Matched text, or null (not ``''``) where the pattern does not occur."""
    text = _col(c)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def share_matching(c: Column | str, pattern: str) -> Column:
    """Share of rows whose text contains the pattern (an aggregate)."""
    return F.avg(_col(c).rlike(pattern).cast("int"))


def reverse_score(c: Column | str, lo: int, hi: int) -> Column:
    """Mirror a Likert answer within ``lo..hi``."""
    return F.lit(lo + hi) - _col(c)


def sentence_case(c: Column | str) -> Column:
    text = _col(c)
    return F.concat(F.upper(text.substr(1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter after every character that is neither letter, digit nor ``'``."""
    pieces = F.split(F.lower(_col(c)), r"(?<=[^\p{L}\p{N}'])")
    return F.array_join(
        F.transform(pieces, lambda w: F.concat(F.upper(w.substr(1, 1)), w.substr(F.lit(2), F.length(w)))),
        "",
    )


def wrap_text(c: Column | str, width: int) -> Column:
    """Fill lines word by word up to ``width`` characters; a longer word gets its own line."""
    words = F.filter(F.split(_col(c), r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def add(acc: Column, w: Column) -> Column:
        fits = F.length(acc["line"]) + 1 + F.length(w) <= width
        return (
            F.when(acc["line"] == "", F.struct(acc["done"].alias("done"), w.alias("line")))
            .when(fits, F.struct(acc["done"].alias("done"),
                                 F.concat(acc["line"], F.lit(" "), w).alias("line")))
            .otherwise(F.struct(F.concat(acc["done"], acc["line"], F.lit("\n")).alias("done"),
                                w.alias("line")))
        )

    return F.aggregate(words, start, add, lambda acc: F.concat(acc["done"], acc["line"]))


def round_even(c: Column | str, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(_col(c), digits)


def fmt_num(c: Column | str, digits: int = 2, leading_zero: bool = True) -> Column:
    """Fixed-point text; the sign of a number that rounds to zero is kept (``-0.00``)."""
    x = _col(c).cast("double")
    body = F.format_string(f"%.{digits}f", F.bround(F.abs(x), digits))
    if not leading_zero:
        body = F.regexp_replace(body, r"^0(?=\.)", "")
    return F.when(x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), body))


def fmt_pct(c: Column | str, digits: int = 0) -> Column:
    """Proportion to percent text."""
    return F.concat(fmt_num(_col(c) * 100, digits, leading_zero=False), F.lit("%"))


def fmt_estimate(mid, lo, hi, digits: int = 2, template: str = "d = {mid}, [{lo}, {hi}]") -> Column:
    """Point and interval put into a text template."""
    parts = {"mid": mid, "lo": lo, "hi": hi}
    out = [
        fmt_num(parts[piece[1:-1]], digits) if piece[:1] == "{" else F.lit(piece)
        for piece in re.split(r"(\{(?:mid|lo|hi)\})", template)
        if piece
    ]
    return F.concat(*out)


def normal_breaks(probs=PERCENTILE_BREAKS) -> list[tuple[float, float]]:
    """(percentile, standard-normal quantile) pairs for axis breaks; constants, not data."""
    return [(p, NormalDist().inv_cdf(p)) for p in probs]
