"""Importance resampling towards a target, with features counted once per distinct line.

Texts are cut into lines at line feeds. A line that occurs again anywhere is worked on once: its features
(runs of one to ``LONGEST`` words, hashed into buckets) are found for the distinct line, and its counts are multiplied by its
occurrences. Runs that cross a line end belong to no line; they are found in each text from the words at the edges of its lines
and added separately. Lines that surely occur once need no second place: their features are found where
they stand. A bitmap of bounded size tells such lines from the others, so that texts are not shuffled, only keys of lines and the text
of lines that may repeat.

A run's CRC-32 is put together from those of its words: appending n bytes to a message is a linear map of its CRC, so whole
arrays of runs are hashed by a few table lookups each, whatever the length of their words.

The log ratio of bucket shares in target and source, with one added to every bucket, gives each bucket a gain; a document's weight is
the sum of the gains of its features. Adding Gumbel noise drawn from its id and taking the highest scores draws without replacement
in proportion to the exponentials of the weights.

Defined results: a null text has no features. Words are runs of ASCII letters and digits and of any characters beyond ASCII, with A-Z
lower-cased. Bytes that are not UTF-8 count as replacement characters. A null id is hashed as an empty one and sorts first. Rows that repeat an id or a text are documents
of their own. Without documents or target texts all counts are 0 and the formulas hold as they are. Further columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import global_index
from .common import SIEVE_BITS, Scratch, marked_by_sieve, pieces, sieve

LONGEST = 3  # words in a run
WORDS_AT_ONCE = 1 << 18
HEAVY_SHARE = 1_000  # lines with at least this part of all occurrences, so at most as many, are broadcast
_HAS_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
# Letters to lower case; every other ASCII character but digits and the line feed to a space.
_NORMAL = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() or c == 10 else c + 32 if chr(c).isupper() else 32
                for c in range(256))


# -- CRC-32 of runs of words -------------------------------------------------------------------


def _crc_steps() -> list[np.ndarray]:
    """Lookup tables (byte of the CRC x value) of the maps that append 1, 2, 4, ... zero bytes to a message."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    values = np.arange(256, dtype=np.uint32)
    one = np.stack([byte, *[values << np.uint32(8 * k - 8) for k in (1, 2, 3)]])
    tables = [one]
    for _ in range(39):
        tables.append(_apply(tables[-1], tables[-1]))
    return tables


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24])


class CrcShift:
    """What the CRC of a message becomes when bytes follow it, apart from the CRC of those bytes."""

    SHORT = 48

    def __init__(self):
        self._steps = _crc_steps()
        tables = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
        for _ in range(self.SHORT):
            tables.append(_apply(self._steps[0], tables[-1]))
        self._short = np.stack(tables).reshape(-1)

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        base = np.minimum(length, self.SHORT).astype(np.uint32) << np.uint32(10)
        out = self._short[base + (crc & 255)]
        for k in (1, 2, 3):
            out ^= self._short[base + np.uint32(256 * k) + ((crc >> np.uint32(8 * k)) & 255)]
        far = np.flatnonzero(length > self.SHORT)
        if len(far):
            rest, got = length[far].astype(np.int64), crc[far]
            for bit, table in enumerate(self._steps):
                on = (rest >> bit) & 1 == 1
                if on.any():
                    got = np.where(on, _apply(table, got), got)
            out[far] = got
        return out


# -- features --------------------------------------------------------------------------------


class Features:
    """Buckets of the runs of words in a number of texts at once."""

    def __init__(self, buckets: int):
        self._shift = CrcShift()
        self._buckets = np.uint32(buckets)
        self.dtype = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def _word_crcs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC of each word, of each word with a space before it, and the length of the latter."""
        coded = pa.array(words, pa.binary()).dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        crc = np.fromiter(map(zlib.crc32, kinds), np.uint32, len(kinds))
        length = np.fromiter(map(len, kinds), np.int64, len(kinds))
        spaced = self._shift(np.full(len(kinds), zlib.crc32(b" "), np.uint32), length) ^ crc
        at = coded.indices.to_numpy()
        return crc[at], spaced[at], length[at] + 1

    def __call__(self, words: list[bytes], line: np.ndarray, own: np.ndarray, text: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(text, bucket) of the runs of each length. ``line`` and ``text`` number the words' lines and texts.

        Runs inside a line count if ``own`` says so for the line; runs that cross lines of a text always do.
        """
        if not words:
            return []
        crc, spaced, length = self._word_crcs(words)
        out, run = [], crc
        for more in range(LONGEST):
            n = len(words) - more
            if n <= 0:
                break
            if more:
                run = self._shift(run[:n], length[more:]) ^ spaced[more:]
            first, last = line[:n], line[more:]
            counts = (own[first] | (first != last)) & (text[:n] == text[more:])
            out.append((text[:n][counts], (run[counts] % self._buckets).astype(self.dtype)))
        return out


def _split_features(features: Features, texts: Sequence[tuple[list[list[bytes]], list[bool]]]) -> list[bytes]:
    """The buckets of every text, given the words of its lines and whether the runs inside them count."""
    words: list[bytes] = []
    sizes, owns, of_text = [], [], []
    for number, (lines, own) in enumerate(texts):
        for line in lines:
            words += line
        sizes += map(len, lines)
        owns += own
        of_text += [number] * len(lines)
    line = np.repeat(np.arange(len(sizes)), sizes)
    parts = features(words, line, np.array(owns, bool), np.array(of_text, np.int64)[line] if len(line) else line)
    out = [b""] * len(texts)
    for text, bucket in parts:
        at = np.searchsorted(text, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            if at[i] < at[i + 1]:
                out[i] += bucket[at[i] : at[i + 1]].tobytes()
    return out


def _edges(words: list[bytes]) -> list[bytes]:
    """The words of a line that runs across its ends can hold."""
    edge = LONGEST - 1
    return words if len(words) <= 2 * edge else words[:edge] + words[-edge:]


def _grouped(texts: Iterator[tuple[int, object]]) -> Iterator[list]:
    """Items with their number of words, in groups of bounded size (one item at least)."""
    group, held = [], 0
    for size, item in texts:
        if group and held + size > WORDS_AT_ONCE:
            yield group
            group, held = [], 0
        group.append(item)
        held += size
    if group:
        yield group


def _documents(batches: Iterator[pa.RecordBatch], buckets: int, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per text: number of words, buckets found in place, and keys of the lines that are worked on elsewhere."""
    features, mask = Features(buckets), (1 << SIEVE_BITS) - 1

    def repeats(key: bytes) -> bool:
        slot = xxhash.xxh64_intdigest(key, 42) & mask
        return bool(bitmap[slot >> 3] >> (slot & 7) & 1)

    def cut(ids, texts):
        for id_, raw in zip(ids, texts, strict=True):
            lines, own, keys, size = [], [], Counter(), 0
            for line, plain in zip((raw or b"").split(b"\n"), (raw or b"").translate(_NORMAL).split(b"\n"), strict=True):
                words = plain.split()
                if not words:
                    continue
                size += len(words)
                key = hashlib.md5(line, usedforsecurity=False).digest()
                shared = repeats(key)
                if shared:
                    keys[key] += 1
                lines.append(_edges(words) if shared else words)
                own.append(not shared)
            yield size, (id_, size, lines, own, keys)

    for batch in pieces(batches):
        for group in _grouped(cut(batch.column("id"), batch.column("text").to_pylist())):
            found = _split_features(features, [(lines, own) for _, _, lines, own, _ in group])
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0].as_py() for g in group], batch.column("id").type), pa.array([g[1] for g in group], pa.int64()),
                 pa.array(found, pa.binary()), pa.array([list(g[4]) for g in group], pa.list_(pa.binary())),
                 pa.array([list(g[4].values()) for g in group], pa.list_(pa.int64()))], ["id", "words", "buckets", "keys", "times"])


def _lines(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Key, occurrences and buckets of distinct lines."""
    features = Features(buckets)

    def cut(batch):
        for line, n in zip(batch.column("line").to_pylist(), batch.column("n").to_pylist(), strict=True):
            words = line.translate(_NORMAL).split()
            yield len(words), (hashlib.md5(line, usedforsecurity=False).digest(), n, words)

    for batch in pieces(batches, 20_000):
        for group in _grouped(cut(batch)):
            found = _split_features(features, [([words], [True]) for *_, words in group])
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in group], pa.binary()), pa.array([g[1] for g in group], pa.int64()),
                                              pa.array(found, pa.binary())], ["key", "n", "buckets"])


def _bucket_sums(batches: Iterator[pa.RecordBatch], buckets: int, dtype: np.dtype) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in pieces(batches):
        for n, cells in zip(batch.column("n").to_pylist(), batch.column("buckets").to_pylist(), strict=True):
            found = np.frombuffer(cells, dtype)
            if len(found) < buckets // 8:
                np.add.at(total, found, n)
            else:
                total += n * np.bincount(found, minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "count"])


class Profile:
    """Features of a table of texts: documents, lines that may repeat, and counts per bucket."""

    def __init__(self, texts: DataFrame, buckets: int, scratch: Scratch, name: str):
        """``texts`` has the columns id and text."""
        sc = texts.sparkSession.sparkContext
        self.dtype = Features(buckets).dtype
        line = F.explode(F.split("text", "\n", -1))
        lines = texts.select(line.alias("line")).filter(F.col("line").rlike(_HAS_WORD)).select(F.col("line").cast("binary").alias("line"))
        keyed = lines.withColumn("key", F.unhex(F.md5("line")))
        again = scratch.write(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), f"{name}-keys")
        bits = sieve(again, F.col("key")).collect()  # at most 2 MiB, whatever the number of keys
        bitmap = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
        for chunk, part in bits:
            part = np.frombuffer(bytes(part), np.uint8)
            bitmap[chunk * len(part) : (chunk + 1) * len(part)] = part
        shared = sc.broadcast(bitmap)
        kind = dict(texts.dtypes)["id"]
        found = texts.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(
            lambda it: _documents(it, buckets, shared.value), f"id {kind}, words long, buckets binary, keys array<binary>, times array<long>")
        self.documents = scratch.write(found.withColumn("row", F.monotonically_increasing_id()), f"{name}-documents")

        # Lines whose bit is set: all that repeat, and as many others as the bitmap cannot tell apart.
        maybe = marked_by_sieve(keyed, sieve(again, F.col("key")), F.col("key"), "maybe").filter("maybe").select("line")
        distinct = maybe.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
        self.lines = scratch.write(distinct.mapInArrow(lambda it: _lines(it, buckets), "key binary, n long, buckets binary"), f"{name}-lines")
        shared.destroy()

        everything = self.documents.select(F.lit(1).cast("long").alias("n"), "buckets").unionByName(self.lines.select("n", "buckets"))
        dtype = self.dtype
        sums = everything.mapInArrow(lambda it: _bucket_sums(it, buckets, dtype), "bucket long, count long")
        self.counts = scratch.write(sums.groupBy("bucket").agg(F.sum("count").alias("count")), f"{name}-counts")


def bucket_gains(spark: SparkSession, source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, gain): thousandths of the log ratio of smoothed shares, rounded down."""
    totals = [df.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("double").alias("all")) for df in (source, target)]
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(F.broadcast(source.withColumnRenamed("count", "s")), "bucket", "left").join(
        F.broadcast(target.withColumnRenamed("count", "t")), "bucket", "left")  # at most a row a bucket
    s, t = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("s", "t"))
    all_s, all_t = (F.lit(df.first()[0]) for df in totals)
    ratio = (t + 1) * (all_s + float(buckets)) / ((s + 1) * (all_t + float(buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weights(df: DataFrame, gains: np.ndarray, dtype: np.dtype, keep: Sequence[str], schema: str) -> DataFrame:
    """Columns ``keep`` and the sum of the gains of the buckets of each row."""
    shared = df.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in pieces(batches):
            sums = [int(gain[np.frombuffer(b, dtype)].sum()) for b in batch.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(sums, pa.int64())], [*keep, "weight"])

    return df.select(*keep, "buckets").mapInArrow(weigh, f"{schema}, weight long")


def document_weights(profile: Profile, gains: np.ndarray, scratch: Scratch) -> DataFrame:
    """Rows (id, words, weight), one per document."""
    documents, kind = profile.documents, dict(profile.documents.dtypes)["id"]
    placed = _weights(documents, gains, profile.dtype, ["row", "id", "words"], f"row long, id {kind}, words long")
    lines = scratch.write(_weights(profile.lines, gains, profile.dtype, ["key", "n"], "key binary, n long"), "line-weights")
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = documents.select("row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("row", "p.keys", "p.times")
    pairs = pairs.withColumnRenamed("keys", "key")
    # Lines that many documents share would meet in one task: they are few, and go to all tasks instead.
    heavy = lines.filter(F.col("n") * HEAVY_SHARE >= total).select("key", "weight")
    met = pairs.join(F.broadcast(heavy), "key", "left")
    light = met.filter("weight IS NULL").drop("weight").join(lines.select("key", "weight"), "key")
    sums = met.filter("weight IS NOT NULL").unionByName(light).groupBy("row").agg(F.sum(F.col("weight") * F.col("times")).alias("shared"))
    return placed.join(sums, "row", "left").select("id", "words", (F.col("weight") + F.coalesce("shared", F.lit(0))).alias("weight"))


def gumbel(id_: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate drawn from the id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = 10_000, seed: int = 42,
             id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Every document's id, n_features, weight, score and, if it is drawn, rank.

    Drawn are ``percent`` hundredths of the documents that have ``min_words`` words, those with the highest scores.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = lambda c: F.make_valid_utf8(F.col(f"`{c}`").cast("string")).alias("text")
    source = Profile(docs.select(F.col(f"`{id_col}`").alias("id"), text(text_col)), buckets, scratch, "source")
    aim = Profile(target.select(F.lit(0).alias("id"), text(target_text_col)), buckets, scratch, "target")
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in bucket_gains(spark, source.counts, aim.counts, buckets).collect():  # a row a bucket
        gains[bucket] = gain
    words = F.col("words")
    n_features = sum((F.greatest(words - i, F.lit(0)) for i in range(1, LONGEST)), words)
    scored = document_weights(source, gains, scratch).withColumns({"n_features": n_features, "score": F.col("weight") + gumbel(F.col("id"), seed)})
    scored = scratch.write(scored, "scored")
    eligible = scored.filter(words >= min_words)
    drawn = percent * eligible.count() // 100
    ranked = global_index(eligible, [F.desc("score"), "id"])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.unionByName(scored.filter(words < min_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
