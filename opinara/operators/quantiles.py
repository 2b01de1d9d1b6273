"""Exact quantiles with linear interpolation, and central intervals built from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import running_total
from .shape import join_na

_ACCURACY = 10_000          # rank error of the sketch is at most n / accuracy
_SLACK = 2.0 / _ACCURACY    # brackets are cut twice as wide
_SMALL = 5 * _ACCURACY      # below this group size the bracket is the whole range


def quantiles(
    df: DataFrame,
    value: Column | str,
    by: Sequence[str],
    probs: Sequence[float],
    names: Sequence[str],
    one_pass: bool = False,
) -> DataFrame:
    """Exact interpolated quantiles per group, one column per probability; see ``quantile_columns``."""
    return quantile_columns(df, [value], by, probs, [names], one_pass)


def quantile_columns(
    df: DataFrame,
    values: Sequence[Column | str],
    by: Sequence[str],
    probs: Sequence[float],
    names: Sequence[Sequence[str]],
    one_pass: bool = False,
) -> DataFrame:
    """Exact interpolated quantiles of several columns per group, ``names[column][probability]``.

    Null values are left out. A group without any value gives no row; a column without values in a
    group that has others gives nulls.

    ``one_pass`` uses the built-in exact percentile, which keeps the distinct values of a group in
    one task: right where the group size is known to be small. The default works for groups of any
    size, including one group that holds most rows. All columns go through it together, the number
    of the column being part of the group:

    1. a mergeable sketch per group brackets every quantile, with a guaranteed rank error;
    2. one more pass counts rows per distinct value inside the brackets and only counts the rest,
       both as partial aggregates;
    3. the counts are sorted by range over all tasks, wherever their values lie, and running totals
       name the values that hold the wanted ranks.

    ``df`` is evaluated twice. Write it first (``cut_lineage``) if that costs more than reading it.
    """
    exprs = [(F.col(v) if isinstance(v, str) else v).cast("double") for v in values]
    if one_pass:
        cells = [e.alias(f"_x{i}") for i, e in enumerate(exprs)]
        out = df.select(*by, *cells).filter(F.coalesce(*[f"_x{i}" for i in range(len(exprs))]).isNotNull()).groupBy(*by).agg(
            *[F.percentile(f"_x{i}", F.array(*map(F.lit, probs))).alias(f"_q{i}") for i in range(len(exprs))])
        return out.select(*by, *[F.col(f"_q{i}")[j].alias(n) for i, row in enumerate(names) for j, n in enumerate(row)])
    if len(exprs) == 1:
        rows = df.select(*by, F.lit(0).alias("_c"), exprs[0].alias("_x"))
    else:
        rows = df.select(*by, F.posexplode(F.array(*exprs)).alias("_c", "_x"))
    ranked = _ranked(rows.filter(F.col("_x").isNotNull()), [*by, "_c"], probs)
    aggs = []
    for i, p in ((i, p) for i in range(len(exprs)) for p in range(len(probs))):
        pos = (F.col("_n") - 1) * F.lit(float(probs[p]))
        for rank, tag in ((F.floor(pos) + 1, "f"), (F.ceil(pos) + 1, "c")):
            holds = (F.col("_c") == i) & F.lit(rank).between(F.col("_first"), F.col("_last"))
            aggs.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{tag}_{i}_{p}"))
        aggs.append(F.max(F.when(F.col("_c") == i, pos - F.floor(pos))).alias(f"_w_{i}_{p}"))
    found = ranked.groupBy(*by).agg(*aggs)
    missed = F.raise_error(F.lit("a quantile lies outside its bracket"))

    def between(i: int, p: int) -> Column:
        low, high, w = (F.col(f"_{t}_{i}_{p}") for t in "fcw")
        found_both = F.when(low == high, low).otherwise(low + (high - low) * w)  # equal infinities stay
        return F.when(w.isNotNull() & (low.isNull() | high.isNull()), missed).otherwise(found_both).cast("double")

    return found.select(*by, *[between(i, p).alias(n) for i, row in enumerate(names) for p, n in enumerate(row)])


def _ranked(rows: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Distinct values near the quantiles with the first and the last rank of each in its group."""
    edges = [min(max(p + s * _SLACK, 0.0), 1.0) for p in probs for s in (-1, 1)]
    sketch = rows.groupBy(*by).agg(
        F.percentile_approx("_x", [float(e) for e in edges], _ACCURACY).alias("_e"),
        F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.count("_x").alias("_n"),
    )
    # A bracket that reaches the first or last rank must include the extreme value itself, and in a
    # small group the slack is less than the two ranks that interpolation needs.
    small = F.col("_n") < _SMALL
    lows = [F.when(small | F.lit(edges[2 * i] <= _SLACK), F.col("_min")).otherwise(F.col("_e")[2 * i])
            for i in range(len(probs))]
    highs = [F.when(small | F.lit(edges[2 * i + 1] >= 1 - _SLACK), F.col("_max")).otherwise(F.col("_e")[2 * i + 1])
             for i in range(len(probs))]
    sketch = sketch.select(*by, "_n", F.array(*lows).alias("_lo"), F.array(*highs).alias("_hi"))
    joined = join_na(rows, sketch, by, "inner")
    # Rows outside all brackets collapse to one count per gap between brackets.
    inside = reduce(lambda a, b: a | b, (
        F.col("_x").between(F.col("_lo")[i], F.col("_hi")[i]) for i in range(len(probs))))
    gap = reduce(lambda a, b: a + b, (
        (F.col("_x") > F.col("_hi")[i]).cast("int") for i in range(len(probs))))
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    gap_value = reduce(lambda acc, i: F.when(gap == i, F.col("_hi")[order[i - 1]]).otherwise(acc),
                       range(1, len(probs) + 1), F.lit(float("-inf")))
    counted = joined.groupBy(
        *by, "_n", F.when(inside, F.col("_x")).otherwise(gap_value).alias("_v"), inside.alias("_in"),
    ).agg(F.count(F.lit(1)).alias("_k"))
    # The gap after a bracket sorts behind the last value of the bracket.
    upto = running_total(counted, [*by, "_v", F.desc("_in")], {"_upto": "_k"})
    before = upto.groupBy(*by).agg(F.min(F.col("_upto") - F.col("_k")).alias("_before"))
    last = F.col("_upto") - F.col("_before")
    return join_na(upto.filter("_in"), before, by, "inner").withColumn("_last", last).withColumn(
        "_first", F.col("_last") - F.col("_k") + 1)


def median_qi(
    df: DataFrame,
    values: Mapping[str, Column | str] | Sequence[str],
    by: Sequence[str] = (),
    width: float = 0.95,
    one_pass: bool = False,
) -> DataFrame:
    """Median and central interval of columns or expressions, per group.

    One value gives ``x, lower, upper``; several give ``x, x_lower, x_upper`` each.
    """
    exprs = dict(values) if isinstance(values, Mapping) else {v: v for v in values}
    tail = (1 - width) / 2
    probs = (0.5, tail, 1 - tail)
    names = {n: [n, "lower", "upper"] if len(exprs) == 1 else [n, f"{n}_lower", f"{n}_upper"] for n in exprs}
    out = quantile_columns(df, list(exprs.values()), by, probs, list(names.values()), one_pass)
    return out.withColumn("width", F.lit(float(width)))


def interval_set(
    df: DataFrame,
    value: Column | str,
    by: Sequence[str],
    widths: Sequence[float] = (0.50, 0.80, 0.95, 0.99),
    one_pass: bool = False,
    name: str = "value",
) -> DataFrame:
    """Median with nested central intervals, one row per group and width, from one pass of quantiles."""
    tails = [(1 - w) / 2 for w in widths]
    probs = [0.5, *tails, *[1 - t for t in tails]]
    names = ["_mid", *[f"_lo{i}" for i in range(len(widths))], *[f"_hi{i}" for i in range(len(widths))]]
    q = quantiles(df, value, by, probs, names, one_pass)
    rows = [F.struct(F.lit(float(w)).alias("width"), F.col("_mid").alias(name),
                     F.col(f"_lo{i}").alias("lower"), F.col(f"_hi{i}").alias("upper"))
            for i, w in enumerate(widths)]
    return q.select(*by, F.inline(F.array(*rows)))


def group_median(df: DataFrame, value: Column | str, by: Sequence[str], name: str,
                 one_pass: bool = False) -> DataFrame:
    return quantiles(df, value, by, (0.5,), (name,), one_pass)


def interval_width(df: DataFrame, lower: str = "lower", upper: str = "upper",
                   out: str = "interval_width") -> DataFrame:
    return df.withColumn(out, F.col(upper) - F.col(lower))
