"""Survey export to the long response table and the wide participant table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import to_int
from ..operators.recode import across, clean_names, null_sentinels, select_cols
from ..operators.shape import lookup, to_long
from ..sources.export import codebook

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class StudySpec:
    """What differs between studies.

    ``steps`` clean the answer rows in order (first submission, finished rows, recoding, exclusion).
    ``items`` selects the item columns, ``names_re``/``names`` take their names apart.
    ``wide`` are the columns of the participant table, as selection specs.
    """

    items: str
    names_re: str
    names: Sequence[tuple[str, str]]
    design: Sequence[str]
    wide: Sequence[str]
    steps: Sequence[Step] = ()
    derived: Mapping[str, Column] = field(default_factory=dict)
    integers: Sequence[str] = ()
    id: str = "id"
    flag: str = "exclude"
    placeholders: Mapping[str, str] = field(default_factory=dict)


class StudyTables(NamedTuple):
    long: DataFrame
    wide: DataFrame
    codebook: DataFrame


def answered_block(df: DataFrame, blocks: Mapping[str, str], out: str) -> DataFrame:
    """Name the item block(s) a person answered; one row per answered block, null without any."""
    found = []
    for name, spec in blocks.items():
        cols = select_cols(df, spec).columns
        any_answer = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in cols))
        found.append(F.when(any_answer, F.lit(name)))
    return df.withColumn(out, F.explode_outer(F.array_compact(F.array(*found))))


def study_tables(answers: DataFrame, labels: DataFrame, spec: StudySpec) -> StudyTables:
    """Long and wide tables from cleaned answers.

    A person's flag and design columns are on the same row as the answers, so they travel with
    the unpivot. The only shuffles are those of the cleaning steps and a small code list.
    """
    rows = reduce(lambda df, step: step(df), spec.steps, answers)
    rows = across(rows, [c for s in spec.integers for c in select_cols(rows, s).columns], to_int)
    rows = rows.withColumns(dict(spec.derived))
    item_cols = select_cols(rows, spec.items).columns
    kept = rows.select(spec.id, *spec.design, spec.flag, *item_cols)
    long = to_long(kept, item_cols, spec.names_re, spec.names, "response", "int", drop_na=True)
    names_re = r".*_([0-9]+)"
    book = codebook(labels, spec.items, names_re, placeholders=dict(spec.placeholders))
    return StudyTables(lookup(long, book, [F.col("action")], ["action"]), select_cols(rows, *spec.wide), book)


def panel_table(raw: DataFrame, integers: Sequence[str], sentinels: Sequence[str],
                columns: Sequence[str] = ("everything()",)) -> DataFrame:
    """Panel metadata with clean names, integers and missing answers instead of sentinel texts."""
    df = clean_names(raw)
    df = null_sentinels(across(df, [c for c in integers if c in df.columns], to_int), sentinels)
    return select_cols(df, *columns)
