"""Who is in the sample: filters, duplicates, screening and exclusion rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .shape import lookup


def keep_ids(df: DataFrame, ids: DataFrame, on: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Rows whose key occurs in another table (semi-join; missing keys match missing keys)."""
    keys = ids.select(*[F.col(c).alias(f"_k_{c}") for c in on])
    same = (F.col(c).eqNullSafe(F.col(f"_k_{c}")) if null_safe else F.col(c) == F.col(f"_k_{c}")
            for c in on)
    return df.join(keys, reduce(lambda a, b: a & b, same), "left_semi")


def keep_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Drop every row whose key occurs more than once.

    One partial aggregation: a key that fills many partitions shrinks to one row per partition
    before the shuffle, and a group of one row is that row.
    """
    single = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[f"`{c}`" for c in df.columns])).alias("_row")
    )
    return single.filter("_n = 1").select("_row.*")


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[str], ties: bool = True) -> DataFrame:
    """Earliest rows per key; missing order values come last; ties survive unless told otherwise.

    The earliest order values per key come from a partial aggregation, and rows find them again
    by joining on key *and* order values, so a hot key is spread over its order values instead of
    being sorted in one window task.
    """
    ranks = F.struct(*[x for i, c in enumerate(order)
                       for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))])
    if not ties:
        row = F.struct(*[f"`{c}`" for c in df.columns])
        return df.groupBy(*key).agg(F.min_by(row, ranks).alias("_row")).select("_row.*")
    # A plain minimum already ignores missing values and keeps the aggregation hash-based.
    lowest = F.struct(F.min(order[0]).alias("v0")) if len(order) == 1 else F.min(ranks)
    best = df.groupBy(*key).agg(lowest.alias("_best")).select(
        *[F.col(c).alias(f"_k_{c}") for c in key],
        *[F.col(f"_best.v{i}").alias(f"_o_{c}") for i, c in enumerate(order)],
    )
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]
    same += [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in order]
    return df.join(best, reduce(lambda a, b: a & b, same), "left_semi")


def attach_flag(df: DataFrame, people: DataFrame, on: str = "id", flag: str = "exclude") -> DataFrame:
    """Bring a participant-level flag to the response rows."""
    return df.drop(flag).join(people.select(on, flag).distinct(), on, "left")


def screen(df: DataFrame, eligible: Sequence[tuple[Column, Column]], out: str = "exclude") -> DataFrame:
    """Exclude everybody who does not pass: each rule is (general condition, group condition).

    Unknown answers never make a row eligible.
    """
    passed = reduce(lambda a, b: a | b, (general & group for general, group in eligible))
    return df.withColumn(out, ~F.coalesce(passed, F.lit(False)))


def exclude_by_answer(
    df: DataFrame,
    rules: DataFrame,
    condition: str,
    answer: str,
    out: str = "exclude",
    trim: bool = False,
) -> DataFrame:
    """Exclude rows whose answer is missing, empty or listed as wrong for their condition.

    ``rules`` has the columns ``condition`` and ``answer``; entries match exactly, with case.
    Repeated entries count once. ``trim`` strips blanks on both sides of the comparison.
    """
    strip = F.trim if trim else (lambda c: c)
    wrong = rules.select(
        F.col("condition").alias("_condition"), strip(F.col("answer")).alias("_answer")
    ).distinct().withColumn("_hit", F.lit(True))
    joined = lookup(df, wrong, [F.col(condition), strip(F.col(answer))], ["_condition", "_answer"])
    empty = F.col(answer).isNull() | (F.col(answer) == "")
    return joined.withColumn(out, empty | F.coalesce("_hit", F.lit(False))).drop("_hit")


def exclude_by_checks(df: DataFrame, checks: Sequence[Column], out: str = "exclude") -> DataFrame:
    """Exclude rows that fail a check; a check that cannot be decided counts as failed."""
    failed = reduce(lambda a, b: a | b, (~c for c in checks))
    return df.withColumn(out, F.coalesce(failed, F.lit(True)))


def apply_exclusions(df: DataFrame, enabled: bool = True, flag: str = "exclude") -> DataFrame:
    """Keep included rows and drop the flag; with ``enabled=False`` keep everybody."""
    return (df.filter(~F.col(flag)) if enabled else df).drop(flag)
