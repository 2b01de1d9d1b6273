"""Exact duplicates by progressive refinement: length, then a prefix hash, then a full hash.

Every step works on narrow rows. Texts whose length nobody shares leave at once; the rest are told
apart by a hash of their first characters; only rows whose length and prefix both occur again get a
full hash. The second scan recognises those rows with a bitmap of bounded size, so texts are never
shuffled. Native DataFrame functions only.

Defined results: a null text counts as empty, and empty texts are equal to each other. Texts are equal
when identical after lower-casing A-Z. Of equal texts the row with the largest id stays; a null id is
smaller than any other. Rows that repeat both id and text are one document: they carry the same marks,
and ``drop_duplicates`` returns one of them for each. An empty table gives an empty table. Columns of
the input keep their values; a name that clashes with an output column is replaced by the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch, apart, lower_ascii, marked_by_sieve, sieve

PREFIX_CHARS = 64


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      all_hashes: bool = False) -> DataFrame:
    """One narrow row per document: id, keep_id, group_size, kept, text_key (and text_sha256).

    ``text_key`` is a 64-bit hash of the raw text; with the id it finds the document again.
    ``all_hashes`` also hashes the texts that the refinement has already told apart.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"))
    coarse = rows.select(F.octet_length("_text").alias("_len"),
                         F.xxhash64(lower_ascii(F.substring("_text", 1, PREFIX_CHARS))).alias("_prefix"))
    coarse = scratch.write(coarse.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")), "coarse")
    # Lengths that occur once settle their rows without looking at the prefix counts again.
    lengths = coarse.groupBy("_len").agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_most"))
    repeated = lengths.filter("_rows > 1 and _most > 1").select("_len")
    suspects = coarse.filter("_n > 1").join(repeated, "_len", "left_semi")
    bits = sieve(suspects, F.xxhash64("_len", "_prefix"))

    keyed = rows.withColumns({
        "_len": F.octet_length("_text"),
        "_prefix": F.xxhash64(lower_ascii(F.substring("_text", 1, PREFIX_CHARS)))})
    keyed = marked_by_sieve(keyed, bits, F.xxhash64("_len", "_prefix"), "_suspect")
    digest = F.sha2(lower_ascii(F.col("_text")), 256)
    narrow = keyed.select("_id", F.xxhash64("_text").alias("text_key"), "_suspect",
                          (digest if all_hashes else F.when(F.col("_suspect"), digest)).alias("_sha"))
    narrow = scratch.write(narrow, "narrow")

    groups = narrow.filter("_suspect").groupBy("_sha").agg(
        F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    groups = scratch.write(groups.filter("_size > 1"), "groups")
    # The hot side is a plain scan, so Spark may split a group that holds many rows.
    left = narrow.withColumn("_join", F.when(F.col("_suspect"), F.col("_sha")).otherwise(
        F.concat(F.lit("-"), F.hex("text_key"), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    joined = left.join(groups.withColumnRenamed("_sha", "_join"), "_join", "left")
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    out = [F.col("_id").alias(id_col), keep.alias("keep_id"),
           F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
           F.col("_id").eqNullSafe(keep).alias("kept"), "text_key"]
    return joined.select(*out, *([F.col("_sha").alias("text_sha256")] if all_hashes else []))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns.

    Rows that are the only one of their text pass without any shuffle of the others' marks: only
    documents of repeated texts are joined, and of rows repeating id and text one is taken.
    """
    names = docs.columns
    docs, (id_col, text_col) = apart(docs, id_col, text_col)
    marks = duplicate_classes(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    repeated = scratch.write(marks.filter("group_size > 1").groupBy(
        name.alias("_name"), F.col("text_key").alias("_key")).agg(F.first("kept").alias("_kept")), "repeated")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.withColumns({"_name": name, "_key": F.xxhash64(text)})
    key = F.xxhash64("_name", "_key")
    rows = marked_by_sieve(rows, sieve(repeated, key), key, "_maybe")
    joined = rows.filter("_maybe").join(repeated, ["_name", "_key"], "left")
    parts = [rows.filter("not _maybe"), joined.filter("_kept is null"),
             joined.filter("_kept").dropDuplicates(["_name", "_key"])]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = parts[0].select(*columns)
    for part in parts[1:]:
        kept = kept.unionByName(part.select(*columns))
    return kept.toDF(*names)
