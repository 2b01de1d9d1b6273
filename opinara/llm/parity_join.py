"""Similarity join of n-gram sets by parity sketches.

Every shingle of a document flips bits of one block of a sketch: the block is the exclusive or of the
64-bit hashes of its shingles. Two sketches therefore differ in at most as many blocks as the sets
differ in shingles. Sets with Jaccard similarity t or more differ in at most (1-t)/(1+t) of their
summed sizes, so with one block more than that bound, at least one block is equal (pigeonhole). Size
bands keep the bound, and with it the number of blocks, the same for the two documents of a pair.
Documents post their blocks as keys; documents sharing a key are candidates, and candidates are
verified on whole sets.

A band looks at ``BLOCKS`` blocks: bands that need fewer repeat the split with other seeds, bands that
need more take the first ones. Blocks holding fewer than three shingles (two for the smallest sets) are
not posted: one very common shingle alone in a block would be a key of half the corpus. Equal blocks
hold equally many shingles, so both documents of a pair post or leave out the same ones. For a pair right
at the threshold a block is equal and posted with a probability of 0.09 to 0.21, by the place of its sizes
in the band, so with 128 blocks it goes unseen with a probability of 6e-6 at worst and 1e-13 at best; more
similar pairs are safer.

Defined results: words are what white space separates, after lower-casing A-Z. A set holds the distinct
shingles of ``words`` words; a shorter text is one shingle of all its words; null, empty and blank texts
have an empty set (size 0) and link with nothing. Equal sets are one class and always link. Repeated
rows and ids each get a row, and rows of one id may have different components. An empty table gives an empty
table; further columns of the input play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Rows, Scratch, WordTable, apart, marked_by_sieve, pieces, process_cache, sieve
from .linking import linked_components, shared_keys

BLOCKS = 128
SKETCH_BITS = 1024
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_GOLDEN = 0x9E3779B97F4A7C15
WORDS_KEPT = 250_000  # words remembered by one Python worker


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Turns UTF-8 texts into sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, words: int):
        self._k = words
        self._factors = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(_GOLDEN)) | np.uint64(1)
        self._hashes = Rows(None, np.uint64)
        self._table = WordTable(self._grow, self._hashes.clear, WORDS_KEPT)

    def _grow(self, fresh: list[bytes]) -> None:
        digest = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in fresh)
        self._hashes.extend(np.frombuffer(digest, np.uint64))

    def word_hashes(self, found: list[bytes]) -> np.ndarray:
        """The hash of every word, in order; words are given in lower case."""
        codes = self._table.codes(found)
        return self._hashes.view[codes]

    def of_words(self, h: np.ndarray) -> np.ndarray:
        """The shingle that begins at each word of a sequence of at least as many words, repeats included."""
        total = np.zeros(len(h) - self._k + 1, np.uint64)
        for j in range(self._k):
            total += h[j : len(h) - self._k + 1 + j] * self._factors[j]
        return mix(total + np.uint64(self._k))

    def of_hashes(self, h: np.ndarray) -> np.ndarray:
        """The sorted distinct shingles of a sequence of words; a shorter one is one shingle of all its words."""
        if len(h) >= self._k:
            return np.unique(self.of_words(h))
        total = (h * self._factors[: len(h)]).sum(dtype=np.uint64)
        return mix(np.array([total], np.uint64) + np.uint64(len(h)))

    def __call__(self, text: bytes | None) -> np.ndarray:
        found = text.lower().split() if text else []
        return self.of_hashes(self.word_hashes(found)) if found else np.empty(0, np.uint64)


def bands(size: int, share: float) -> list[tuple[int, int]]:
    """(band, bound on differing shingles) of a set. Band i takes pairs whose smaller set has 2^i to 2^(i+1) - 1."""
    top = size.bit_length() - 1
    out = []
    for i in (top, top - 1):
        small = (2 << i) - 1 if i >= 0 else 0
        large = int(small / share + 1e-9)
        if i >= 0 and size <= large:
            out.append((i, int((small + large) * (1 - share) / (1 + share) + 1e-9)))
    return out


def parity_keys(h: np.ndarray, share: float) -> np.ndarray:
    """The block keys of a set of shingle hashes."""
    keys = []
    for band, bound in bands(len(h), share) if len(h) else []:
        if not bound:
            continue  # only equal sets can link, and those are one class already
        blocks = bound + 1
        rounds = max(1, ceil(BLOCKS / blocks))
        seeds = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(_GOLDEN) + np.uint64(band)) | np.uint64(1)
        spread = mix(h[None, :] ^ seeds[:, None])
        block = ((spread >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        place = (block + np.arange(rounds, dtype=np.uint64)[:, None] * np.uint64(blocks)).ravel()
        flips = mix(spread + np.uint64(_GOLDEN)).ravel()
        if blocks > BLOCKS:
            use = place < BLOCKS
            place, flips = place[use], flips[use]
        order = np.argsort(place, kind="stable")
        place, flips = place[order], flips[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, np.int64)
        if len(first):
            held = np.diff(np.r_[first, len(place)])
            parity = np.bitwise_xor.reduceat(flips, first)
            key = mix(parity ^ mix(place[first] + np.uint64(band << 32)))
            keys.append(key[held >= (3 if band > 2 else 2)])
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def parity_bits(h: np.ndarray) -> np.ndarray:
    """The size of a set, then its parity sketch: each shingle flips one of ``SKETCH_BITS`` bits."""
    bits = np.bincount((h >> np.uint64(20)).astype(np.int64) & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
    return np.r_[len(h), np.packbits(bits.astype(np.uint8)).view(np.int64)].view(np.uint64)


def set_id(h: np.ndarray) -> int | None:
    """A 64-bit name of a set; none for the empty set."""
    if not len(h):
        return None
    whole = mix(np.array([np.bitwise_xor.reduce(h), np.add.reduce(h)], np.uint64))
    return int(mix(whole[:1] * np.uint64(3) + whole[1:] + np.uint64(len(h))).view(np.int64)[0])


def shingler(words: int) -> Shingler:
    return process_cache(("shingler", words), lambda: Shingler(words))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sketch_batches(batches: Iterator[pa.RecordBatch], words: int, share: float) -> Iterator[pa.RecordBatch]:
    shingle = shingler(words)
    for batch in pieces(batches):
        sets = [shingle(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_key"), pa.array([len(h) for h in sets], pa.int64()),
             pa.array([set_id(h) for h in sets], pa.int64()), lists([parity_keys(h, share) for h in sets])],
            ["id", "text_key", "size", "item", "keys"])


def _set_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    shingle = shingler(words)
    for batch in pieces(batches):
        sets = [shingle(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([set_id(h) for h in sets], pa.int64()), lists([parity_bits(h) for h in sets]), lists(sets)],
            ["item", "sketch", "whole"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                       percent: int = 75, with_text_key: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links), set_id.

    ``set_id`` numbers the classes of equal sets. Two sets link when
    100 * intersection >= percent * union.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    share = percent / 100
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    source = source.withColumn("text_key", F.xxhash64("text"))
    rows = source.mapInArrow(lambda it: _sketch_batches(it, words, share),
                             "id long, text_key long, size long, item long, keys array<long>")
    rows = scratch.write(rows, "sketches")
    postings = rows.filter("item is not null").select(F.explode("keys").alias("key"), "item", "size")
    members = shared_keys(postings, scratch)

    items = scratch.write(members.select("item").distinct(), "items")
    # One text of each class is read again, found by a sieve of text hashes.
    pick = rows.join(items, "item", "left_semi").groupBy("item").agg(F.min("text_key").alias("text_key"))
    pick = scratch.write(pick.select("text_key"), "pick")
    near = marked_by_sieve(source, sieve(pick, F.col("text_key")), F.col("text_key"), "_near").filter("_near")
    one = near.select("text_key", "text").join(pick, "text_key", "left_semi").dropDuplicates(["text_key"])
    sets = one.select("text").mapInArrow(lambda it: _set_batches(it, words), "item long, sketch array<long>, whole array<long>")
    sets = scratch.write(sets.filter("item is not null").dropDuplicates(["item"]), "sets")

    roots = linked_components(members, sets, percent, scratch)

    classes = rows.filter("item is not null").groupBy("item").agg(F.min("id").alias("_least"))
    classes = scratch.write(classes.join(roots, "item", "left").select(
        "item", "_least", F.coalesce("root", "item").alias("root")), "classes")
    least = classes.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = scratch.write(classes.join(least, "root").select("item", "root", "component_id"), "named")
    out = rows.select("id", "text_key", "size", "item").join(classes, "item", "left")
    return out.select(*(["text_key", F.col("root").alias("_root")] if with_text_key else []), F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                      F.coalesce("component_id", "id").alias("component_id"), F.col("item").alias("set_id"))


def drop_linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                percent: int = 75) -> DataFrame:
    """The documents that stay: one of each component, the one with the smallest id; null comes last.

    Documents with an empty set link with nothing and stay. Rows that repeat an id and a set are one
    document, of which one row stays; rows that repeat an id with texts that do not link are different ones.
    """
    scratch = Scratch(docs.sparkSession)
    names = docs.columns
    docs, (id_col, text_col) = apart(docs, id_col, text_col)
    found = jaccard_components(docs, id_col, text_col, words, percent, with_text_key=True)
    found = scratch.write(found.select(F.col(f"`{id_col}`").alias("_id"), "text_key", "_root", "set_id"), "found")
    linked = found.filter("set_id is not null")
    sizes = linked.groupBy("_root").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # Every row of a component with more than one row, but for one with the smallest id.
    groups = scratch.write(sizes.select("_root"), "groups")
    suspects = scratch.write(linked.join(groups, "_root", "left_semi"), "suspects")
    first = suspects.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "text_key")).alias("_first"))
    marks = suspects.join(scratch.write(first, "first"), "_root").select(
        F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_name"), "text_key",
        (F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("text_key") == F.col("_first.text_key"))).alias("_stay"))
    marks = scratch.write(marks.distinct(), "marks")
    rows = docs.withColumns({"_name": F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
                             "text_key": F.xxhash64(F.col(f"`{text_col}`").cast("string"))})
    key = F.xxhash64("_name", "text_key")
    rows = marked_by_sieve(rows, sieve(marks, key), key, "_maybe")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = rows.filter("_maybe").join(marks, ["_name", "text_key"], "left")
    kept = rows.filter("not _maybe").select(*columns).unionByName(joined.filter("_stay is null").select(*columns))
    return kept.unionByName(joined.filter("_stay").dropDuplicates(["_name", "text_key"]).select(*columns)).toDF(*names)
