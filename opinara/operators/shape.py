"""Reshaping, joins with missing keys, crossing with literal grids, set operations."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import to_int

_CASTS = {"int": lambda c: to_int(c), "string": lambda c: c.cast("string"),
          "double": lambda c: c.try_cast("double"), "asis": lambda c: c}


# -- wide to long and back -------------------------------------------------------------------


def to_long(
    df: DataFrame,
    cols: Sequence[str],
    names_re: str,
    names: Sequence[tuple[str, str]],
    values_to: str,
    value_type: str = "asis",
    drop_na: bool = False,
) -> DataFrame:
    """Wide to long. ``names`` are (column, ``int`` or ``string``), one per group of ``names_re``.

    Column names are known when the plan is built, so the groups become literals: rows are
    expanded by one generator, without a shuffle and without matching names at run time.
    """
    keep = [c for c in df.columns if c not in set(cols)]
    cells = []
    for c in cols:
        match = re.fullmatch(names_re, c)
        if match is None:
            raise ValueError(f"column {c!r} does not match {names_re!r}")
        parts = [F.lit(int(text) if kind == "int" else text).alias(name)
                 for (name, kind), text in zip(names, match.groups(), strict=True)]
        cells.append(F.struct(*parts, _CASTS[value_type](F.col(f"`{c}`")).alias(values_to)))
    long = df.select(*[f"`{c}`" for c in keep], F.inline(F.array(*cells)))
    return long.filter(F.col(values_to).isNotNull()) if drop_na else long


def to_wide(
    df: DataFrame,
    names_from: Sequence[str],
    values_from: str,
    values: Sequence | None,
    by: Sequence[str],
    sep: str = "_",
    fill=None,
    prefix: str = "",
    drop_others: bool = False,
    most: int = 1_000,
) -> DataFrame:
    """Long to wide.

    A list of names saves the job that finds them; without it (None) all names that occur become
    columns, in order, up to ``most`` of them; more are an error, and no more than that reach the driver. A name missing from the list is an error when the rows are read, unless
    ``drop_others`` says that such rows are not wanted.
    """
    key = F.concat_ws(sep, *[F.col(c).cast("string") for c in names_from])
    if values is None:
        values = sorted(r[0] for r in df.select(key).distinct().limit(most + 1).collect())
        if len(values) > most:
            raise ValueError(f"more than {most} new columns; list the names or raise `most`")
    texts = [sep.join(map(str, v)) if isinstance(v, tuple) else str(v) for v in values]
    known = key if drop_others else F.when(key.isin(*texts), key).otherwise(
        F.raise_error(F.concat(F.lit("name without a column: "), key)))
    wide = df.withColumn("_name", known).groupBy(*by).agg(*[
        F.first(F.when(F.col("_name") == t, F.col(values_from)), ignorenulls=True).alias(prefix + t) for t in texts
    ])
    return wide if fill is None else wide.fillna(fill, subset=[prefix + t for t in texts])


# -- joins -----------------------------------------------------------------------------------


def join_na(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which a missing key matches a missing key; key columns appear once."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on))
    keys = {"right": lambda c: F.col(f"_r_{c}"), "full": lambda c: F.coalesce(c, f"_r_{c}")}
    pick = keys.get(how, F.col)
    rest = [c for c in left.columns if c not in on] + [c for c in right.columns if c not in on]
    return left.join(r, same, how).select(*[pick(c).alias(c) for c in on], *rest)


def natural_full_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on all shared columns."""
    return join_na(left, right, [c for c in left.columns if c in right.columns], "full")


_HOT_KEYS = 64    # most frequent keys that are salted
_SALTS = 32       # parts of a frequent key


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[Column], on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a lookup table, one row per key, to rows of which a few keys may hold nearly all.

    ``keys`` are expressions over ``df``, ``on`` the key columns of the table; the other columns of the table are
    added. Null keys match nothing. A table that the planner's own estimate lets it broadcast is joined as it is.
    Otherwise both sides are shuffled, and a mergeable sketch of the keys finds the most frequent ones, as part of
    the same query: their rows are dealt to several parts, each of which gets a copy of the few table rows
    concerned. No job runs while the plan is built, and no row count decides.
    """
    names = {c: f"_r_{c}" for c in on}
    right = table.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, (k == F.col(f"`{names[c]}`") for k, c in zip(keys, on, strict=True)))
    if _is_broadcast(table):
        return df.join(right, same, how).drop(*names.values())
    # Text of the hash, since the sketch counts distinct items of one type.
    top = df.select(F.xxhash64(*keys).alias("_h")).agg(F.expr(f"approx_top_k(_h, {_HOT_KEYS}, 10000)").alias("_top"))
    hot = top.select(F.transform("_top", lambda t: t["item"]).alias("_hot")).scalar()
    # Equal rows of different partitions differ in their part; the number of a partition survives a lost executor.
    spread = F.xxhash64(*[f"`{c}`" for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]) + F.spark_partition_id() * 7919
    dealt = df.withColumn("_part", F.when(F.array_contains(hot, F.xxhash64(*keys)), F.pmod(spread, F.lit(_SALTS))).otherwise(F.lit(0)).cast("int"))
    copies = F.when(F.array_contains(hot, F.xxhash64(*[F.col(f"`{c}`") for c in names.values()])), F.lit(_SALTS - 1)).otherwise(F.lit(0))
    right = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies)))
    return dealt.join(right, same & (F.col("_part") == F.col("_copy")), how).drop(*names.values(), "_part", "_copy")


def _is_broadcast(table: DataFrame) -> bool:
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


# -- literal grids ---------------------------------------------------------------------------


def seq(lo: float, hi: float, step: float) -> list:
    """``lo, lo + step, …`` up to ``hi``, integers if all three are."""
    n = int((hi - lo) / step + 1e-9)
    values = [lo + i * step for i in range(n + 1)]
    return [int(v) for v in values] if all(isinstance(v, int) for v in (lo, hi, step)) else values


def grid(spark: SparkSession, name: str, lo: float, hi: float, step: float) -> DataFrame:
    """One-column table of an arithmetic sequence."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, seq(lo, hi, step)))).alias(name))


def literal_table(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A table written out in the plan (code lists, rules), whose size Spark therefore knows."""
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def crossing(df: DataFrame, **grids: Sequence) -> DataFrame:
    """Distinct rows combined with every combination of the distinct grid values.

    The grids are literals in the plan, so this is a generator and not a join.
    """
    out = df.distinct()
    for name, values in grids.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, sorted(set(values))))))
    return out


def spread_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread few rows over all cores before each of them grows into many.

    A number is given so that adaptive execution does not merge the small partitions again.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def cross_tuples(df: DataFrame, names: Sequence[str], tuples: Sequence[tuple],
                 distinct: bool = True) -> DataFrame:
    """Rows combined with tuples whose values belong together."""
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, t, strict=True)])
             for t in dict.fromkeys(tuples)]
    return (df.distinct() if distinct else df).select("*", F.inline(F.array(*cells)))


# -- rows ------------------------------------------------------------------------------------


def bind_rows(parts: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Union by column name with a column that says where a row came from."""
    tagged = [df.withColumn(label, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def drop_missing(df: DataFrame, cols: Sequence[str] = ()) -> DataFrame:
    """Drop rows with a missing value in the named columns, or in any."""
    return df.dropna(subset=list(cols)) if cols else df.dropna()


