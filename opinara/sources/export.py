"""Survey exports: text columns, a header and two metadata rows mixed in with the answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import extract_na
from ..operators.recode import clean_names, select_cols
from ..operators.shape import to_long

# Texts that a reader takes for a missing answer.
MISSING_TEXTS = ("", "NA")


def read_text_csv(
    spark: SparkSession, path: str | list[str], trim: bool = True, multiline: bool = False
) -> DataFrame:
    """CSV with a header, quoted free text and every column as string; missing texts are null.

    Files are split between tasks. ``multiline`` allows line breaks inside quoted answers, at the
    price of one task per file; a row with such a break is torn without it.
    """
    raw = clean_names(spark.read.csv(
        path, header=True, multiLine=multiline, escape='"', quote='"', inferSchema=False,
        ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim,
    ))
    return raw.select(
        *[F.when(~F.col(c).isin(*MISSING_TEXTS), F.col(c)).alias(c) for c in raw.columns]
    )


def is_answer(column: str = "finished") -> Column:
    """Rows that hold answers: rows have no order, so the flag column tells them from metadata."""
    return F.coalesce(F.col(column).isin("0", "1"), F.lit(False))


def read_export(
    spark: SparkSession, path, keep: Column | None = None, trim: bool = True, multiline: bool = False
) -> DataFrame:
    """Answer rows of an export."""
    rows = read_text_csv(spark, path, trim, multiline)
    return rows.filter(is_answer() if keep is None else keep)


def read_codebook(
    spark: SparkSession,
    path,
    columns: str,
    label_row: Column,
    names_re: str = r".*_([0-9]+)",
    separator: str = " - ",
    placeholders: dict[str, str] | None = None,
    multiline: bool = False,
) -> DataFrame:
    """(action, action_text) from the metadata row that carries the question texts."""
    labels = read_text_csv(spark, path, multiline=multiline).filter(label_row)
    return codebook(labels, columns, names_re, separator, placeholders)


def codebook(
    labels: DataFrame,
    columns: str,
    names_re: str = r".*_([0-9]+)",
    separator: str = " - ",
    placeholders: dict[str, str] | None = None,
    item: str = "action",
    text: str = "action_text",
) -> DataFrame:
    """Item codebook: text after the separator (null without one), placeholders filled, distinct."""
    cols = select_cols(labels, columns).columns
    long = to_long(labels.select(*cols), cols, names_re, [(item, "int")], text)
    label = extract_na(text, f"(?<={re.escape(separator)}).*")
    for placeholder, filled in (placeholders or {}).items():
        label = F.regexp_replace(label, re.escape(placeholder), filled)
    return long.select(item, label.alias(text)).distinct()


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, one file per partition, missing values as ``NA``."""
    df.write.mode(mode).csv(path, header=True, nullValue="NA", escape='"', quote='"')
