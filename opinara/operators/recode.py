"""Columns: names, selection, casts over many columns, recoding and standardising."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import if_else_na
from .shape import lookup


# -- names and selection ---------------------------------------------------------------------


def snake_case(name: str) -> str:
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.replace("%", "percent").replace("#", "number"))
    words = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", words)
    words = re.sub(r"[^0-9A-Za-z]+", "_", words).strip("_").lower()
    return words if not words[:1].isdigit() else f"x{words}"


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case column names; a repeated name gets ``_2``, ``_3``, …"""
    seen: dict[str, int] = {}
    out = []
    for name in map(snake_case, df.columns):
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*out)


def _match(columns: Sequence[str], spec: str) -> list[str]:
    if spec == "everything()":
        return list(columns)
    if spec.startswith("~"):
        return [c for c in columns if re.search(spec[1:], c)]
    if ":" in spec:
        first, last = (columns.index(c) for c in spec.split(":"))
        return list(columns[first : last + 1])
    if spec.endswith("*"):
        return [c for c in columns if c.startswith(spec[:-1])]
    if spec.startswith("*"):
        return [c for c in columns if c.endswith(spec[1:])]
    if spec not in columns:
        raise ValueError(f"no column {spec!r}")
    return [spec]


def select_cols(df: DataFrame, *specs: str) -> DataFrame:
    """Pick, order and rename columns.

    ``a``, ``a:b`` (range), ``a*`` (prefix), ``*a`` (suffix), ``~re`` (regex), ``everything()``,
    ``-spec`` (drop) and ``new=old``. Starting with a drop means starting from all columns.
    """
    picked: dict[str, str] = {}
    if specs and specs[0].startswith("-"):
        picked = {c: c for c in df.columns}
    for spec in specs:
        if spec.startswith("-"):
            for c in _match(df.columns, spec[1:]):
                picked.pop(c, None)
        elif "=" in spec and not spec.startswith("~"):
            new, old = spec.split("=")
            picked[old] = new
        else:
            for c in _match(df.columns, spec):
                picked.setdefault(c, c)
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in picked.items()])


def rename_re(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Rename every column by replacing the first match of a regular expression in its name."""
    return df.toDF(*[re.sub(pattern, replacement, c, count=1) for c in df.columns])


def across(
    df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column], names: str = "{col}"
) -> DataFrame:
    """Apply one expression to many columns in one projection."""
    return df.withColumns({names.format(col=c): fn(F.col(c)) for c in cols})


# -- values ----------------------------------------------------------------------------------


def text_columns(df: DataFrame) -> list[str]:
    return [name for name, dtype in df.dtypes if dtype == "string"]


def null_sentinels(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Texts that stand for a missing answer become null in every text column."""
    return across(df, text_columns(df), lambda c: F.when(~c.isin(*values), c))


def replace_values(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """Recode single values; other values stay."""
    branches = [(F.col(col) == F.lit(old), F.lit(new)) for old, new in mapping.items()]
    recoded = reduce(lambda acc, b: acc.when(*b), branches[1:], F.when(*branches[0]))
    return df.withColumn(out or col, recoded.otherwise(F.col(col)))


def recode_dict(
    df: DataFrame,
    col: str,
    mapping: DataFrame,
    keep_unmatched: bool,
    out: str | None = None,
    key: str = "key",
    value: str = "value",
    overrides: Sequence[tuple[Column, object]] = (),
) -> DataFrame:
    """Recode free text through a (key, value) table, ignoring case and surrounding blanks.

    Keys listed twice count once, so the join never multiplies rows. Frequent answers are spread
    over tasks where the dictionary is too large to broadcast. ``overrides`` are further branches, tested first.
    """
    table = mapping.groupBy(F.lower(F.trim(key)).alias("_key")).agg(F.min(value).alias("_value"))
    joined = lookup(df, table, [F.lower(F.trim(F.col(col)))], ["_key"])
    recoded = F.coalesce("_value", F.col(col)) if keep_unmatched else F.col("_value")
    for cond, new in reversed(overrides):
        recoded = F.when(cond, new).otherwise(recoded)
    return joined.withColumn(out or col, recoded).drop("_value")


def recode_factor(df: DataFrame, col: str, levels: Mapping, out: str | None = None) -> DataFrame:
    """Labels plus an explicit level order ``<out>_ord``; values outside the levels become null."""
    name = out or col
    label = order = F.lit(None)
    for i, (value, text) in reversed(list(enumerate(levels.items(), 1))):
        hit = F.col(col) == F.lit(value)
        label, order = F.when(hit, text).otherwise(label), F.when(hit, i).otherwise(order)
    labels = df.select("*", label.cast("string").alias("_label"), order.cast("int").alias(f"{name}_ord"))
    return labels.withColumn(name, F.col("_label")).drop("_label")


def dummy_code(df: DataFrame, spec: Mapping[str, Column]) -> DataFrame:
    """0/1 columns from conditions on design factors, null where a factor is null."""
    return df.withColumns({name: if_else_na(cond, 1, 0) for name, cond in spec.items()})


def cell_index(
    df: DataFrame, keys: Sequence[str], cells: Sequence[tuple], out: str = "kk", start: int = 1
) -> DataFrame:
    """Number design cells in the order given; combinations not listed become null.

    Cells are a literal of the design, so the index is a projection and needs no join.
    """
    index = F.lit(None).cast("int")
    for i, cell in reversed(list(enumerate(cells, start))):
        hit = reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in zip(keys, cell, strict=True)))
        index = F.when(hit, i).otherwise(index)
    return df.withColumn(out, index)


def z_score(
    df: DataFrame, cols: Sequence[str], na_rm: bool = True, names: str = "{col}"
) -> DataFrame:
    """Standardise by the mean and sample SD over all rows.

    The moments come from one partial aggregation and reach the rows as a scalar subquery. With
    ``na_rm=False`` a single missing value makes the whole column missing.
    """
    stats = []
    for c in cols:
        usable = F.lit(True) if na_rm else F.count(c) == F.count(F.lit(1))
        stats += [F.when(usable, F.avg(c)).alias(f"m_{c}"),
                  F.when(usable, F.stddev_samp(c)).alias(f"s_{c}")]
    moments = df.agg(F.struct(*stats).alias("moments")).scalar()
    return df.withColumns({
        names.format(col=c): (F.col(c) - moments[f"m_{c}"]) / moments[f"s_{c}"] for c in cols
    })


def pick_by(df: DataFrame, key: str, mapping: Mapping[object, str], out: str) -> DataFrame:
    """Take the value from the column that belongs to the row's key."""
    picked = F.lit(None)
    for value, source in mapping.items():
        picked = F.when(F.col(key) == F.lit(value), F.col(source)).otherwise(picked)
    return df.withColumn(out, picked)
