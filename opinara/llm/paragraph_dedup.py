"""Repeated passages by MinHash banding: lines that are alike, and runs of words wherever they stand.

Texts are cut into paragraphs at line breaks. The set of word shingles of every paragraph gets a MinHash
signature; bands of it are keys, with as many bands as the wanted recall takes at the similarity threshold.
Paragraphs that collide are verified by exact Jaccard similarity, links are merged into components, and of
each component the first occurrence stays.

A passage that begins or ends inside a line, or runs over several, has no paragraph of its own. For it, every
window of ``min_words`` words is a unit, whatever the lines. The key of a window is the MinHash of its runs of
``RUN`` words; neighbouring windows mostly share the place of the least hash, the anchor, so that a text posts
some two keys a window's length. Equal windows have equal anchors. The windows of an anchor are a block; where
all blocks of a key are equal, so are their windows, and else the windows of each different block are
compared one by one. No pairs are made, and every window that stands in two places is found.

Defined results: words are what white space separates, after lower-casing A-Z. Paragraphs of fewer than
``min_words`` words play no part, nor do null, empty and blank texts. Equal sets of shingles always link.
Of occurrences in the same place of rows that repeat an id, all carry the same marks. An empty table gives
an empty table. Further columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, marked_by_sieve, pieces, sieve
from .linking import linked_components, shared_keys
from .parity_join import Shingler, lists, mix, parity_bits, set_id, shingler

RUN = 16  # words of the runs whose least hash is the key of a window
GROUP_BYTES = 1_000_000  # texts worked on together, which bounds what a task builds at once
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93


def tuned_bands(similarity: float, recall: float, most: int = 40) -> tuple[int, int]:
    """(bands, rows): the most selective banding with at most ``most`` bands that finds pairs at the threshold
    with the given probability."""
    for rows in range(8, 0, -1):
        bands = ceil(log(1 - recall) / log(1 - similarity**rows))
        if bands <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def minhash_keys(h: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band of the MinHash signatures of sets of hashes, as rows of an array.

    The sets lie one after the other in ``h``, from the places ``first`` on; repeats change nothing.
    """
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(_GOLDEN)) | np.uint64(1)
    key = np.tile(np.arange(bands, dtype=np.uint64), (len(first), 1))
    spread = np.empty_like(h)
    for r in range(rows):
        for band in range(bands):
            least = np.minimum.reduceat(np.multiply(h, seeds[band * rows + r], out=spread), first)
            key[:, band] = mix(key[:, band] ^ least)
    return key


def paragraphs(text: str, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, start, length, words) of the paragraphs that are long enough; starts count code points."""
    at = 0
    for number, line in enumerate(text.split("\n")):
        raw = line.encode("utf-8", "replace")
        if len(raw) >= 2 * min_words - 1 and len(raw.split()) >= min_words:
            yield number, at, len(line), raw
        at += len(line) + 1


def ranges(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges, one range after the other, and the place where each begins."""
    first = np.cumsum(length) - length
    return np.arange(length.sum()) + np.repeat(start - first, length), first


def set_ids(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``set_id``, size) of sets that lie one after the other; ``h`` is sorted within each."""
    new = np.r_[True, h[1:] != h[:-1]]
    new[first] = True
    h, place = h[new], np.cumsum(new)[first] - 1
    size = np.diff(np.r_[place, len(h)]).astype(np.uint64)
    a, b = mix(np.bitwise_xor.reduceat(h, place)), mix(np.add.reduceat(h, place))
    return mix(a * np.uint64(3) + b + size).view(np.int64), size.astype(np.int64)


class Sums:
    """Hashes of runs of words: a polynomial over the words' hashes, from running totals."""

    def __init__(self, h: np.ndarray):
        power = np.full(len(h) + 1, _BASE, np.uint64)
        back = np.full(len(h) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        power[0] = back[0] = 1
        self._back = np.multiply.accumulate(back)
        self._total = np.r_[np.uint64(0), np.cumsum(h * np.multiply.accumulate(power)[:-1], dtype=np.uint64)]

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self._total[start + length] - self._total[start]) * self._back[start])


def anchors(h: np.ndarray, sizes: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """(text, at, lo, hi, key, block) of the anchors of texts of ``sizes`` words, which lie one after the other in ``h``.

    The windows of ``words`` words that begin at lo to hi have their least run of words at ``at``, the first one if
    several are least; the three count words of the text. ``block`` names the words of these windows and the place of the
    anchor among them.
    """
    run = min(RUN, words)
    text = np.flatnonzero(sizes >= words)
    begin = (np.cumsum(sizes) - sizes)[text]
    if not len(text):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    sums = Sums(h)
    least = sums(np.arange(len(h) - run + 1), run)
    place, width = np.arange(len(least)), 1

    def nearer(by: int) -> tuple[np.ndarray, np.ndarray]:
        left = least[:-by] <= least[by:]
        return np.where(left, least[:-by], least[by:]), np.where(left, place[:-by], place[by:])

    while 2 * width <= words - run + 1:
        least, place = nearer(width)
        width *= 2
    if width < words - run + 1:
        least, place = nearer(words - run + 1 - width)
    windows = sizes[text] - words + 1
    start, first = ranges(begin, windows)
    at = place[start]
    new = np.r_[True, at[1:] != at[:-1]]
    new[first] = True
    chosen = np.flatnonzero(new)
    lo, hi, at = start[chosen], start[np.r_[chosen[1:], len(start)] - 1], at[chosen]
    of = np.repeat(np.arange(len(text)), windows)[chosen]
    length = hi - lo + words
    block = mix(sums(lo, length) + mix((length << 32 | at - lo).astype(np.uint64)))
    return text[of], at - begin[of], lo - begin[of], hi - begin[of], sums(at, run), block


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches with at most about ``GROUP_BYTES`` of text, one text at least."""
    for batch in pieces(batches):
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + GROUP_BYTES, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


_UNITS = ("id long, row long, paragraph long, start long, length long, item long, size long, keys array<long>, "
          "at long, lo long, hi long, key long, block long")


def _unit_batches(batches: Iterator[pa.RecordBatch], min_words: int, words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The paragraphs, then the anchors, of groups of texts. Columns of the other kind are null."""
    shingle = shingler(words)
    names = [c.split()[0] for c in _UNITS.split(", ")]
    for batch in _groups(batches):
        found, sizes, lines = [], [], []  # lines: text, number, start, length, first word, words
        for i, text in enumerate(batch.column("text").to_pylist()):
            begin, at = len(found), 0
            for number, line in enumerate(text.split("\n")):
                raw = line.encode("utf-8", "replace").lower().split()
                if len(raw) >= min_words and raw:
                    lines.append((i, number, at, len(line), len(found), len(raw)))
                found += raw
                at += len(line) + 1
            sizes.append(len(found) - begin)
        h = shingle.word_hashes(found)
        ids, row = batch.column("id"), batch.column("row")
        if lines:
            i, number, at, length, begin, count = np.array(lines, np.int64).T
            flat, first = _line_shingles(shingle, h, begin, count, words)
            keys = minhash_keys(flat, first, bands, rows)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(flat)], strict=True):
                flat[a:b].sort()
            item, size = set_ids(flat, first)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)),
                                            pa.array(keys.ravel().view(np.int64)))
            yield _padded(names, len(lines), id=ids.take(pa.array(i)), row=row.take(pa.array(i)), paragraph=number, start=at,
                          length=length, item=item, size=size, keys=keys)
        i, at, lo, hi, key, block = anchors(h, np.array(sizes, np.int64), min_words)
        if len(i):
            yield _padded(names, len(i), id=ids.take(pa.array(i)), row=row.take(pa.array(i)), at=at, lo=lo, hi=hi,
                          key=key.view(np.int64), block=block.view(np.int64))


def _line_shingles(shingle: Shingler, h: np.ndarray, begin: np.ndarray, count: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of lines, one line after the other, and the place where each line begins."""
    if count.min() >= words:
        place, first = ranges(begin, count - words + 1)
        return shingle.of_words(h)[place], first
    sets = [shingle.of_hashes(h[b : b + n]) for b, n in zip(begin.tolist(), count.tolist(), strict=True)]
    return np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets[:-1]]])


def _padded(names: list[str], n: int, **cols) -> pa.RecordBatch:
    blank = {"keys": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays(
        [pa.array(c) if isinstance(c := cols.get(name), np.ndarray) else pa.nulls(n, blank.get(name, pa.int64())) if c is None else c
         for name in names], names)


def _flat(column: pa.ListArray, *fields: str) -> list[np.ndarray]:
    """The number of entries of each list of structs, then the fields of all entries."""
    entries = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return [sizes, *[pc.fill_null(pc.struct_field(entries, f).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for f in fields]]


def _window_batches(batches: Iterator[pa.RecordBatch], min_words: int, words: int) -> Iterator[pa.RecordBatch]:
    """The windows of the wanted blocks of texts."""
    shingle = shingler(words)
    for batch in pieces(batches, 200):
        sizes, block, n, at, lo, hi = _flat(batch.column("wanted"), "block", "n", "at", "lo", "hi")
        hashes, end = [], 0
        for text, size in zip(batch.column("text").to_pylist(), sizes.tolist(), strict=True):
            sums = Sums(shingle.word_hashes(text.encode("utf-8", "replace").lower().split()))
            begin, end = end, end + size
            hashes.append(sums(ranges(lo[begin:end], hi[begin:end] - lo[begin:end] + 1)[0], min_words))
        many = hi - lo + 1
        i = pa.array(np.repeat(np.repeat(np.arange(len(sizes)), sizes), many))
        pos = ranges(np.zeros_like(many), many)[0]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(i), batch.column("row").take(i), *[pa.array(np.repeat(c, many)) for c in (block, n, at)],
             pa.array(pos), pa.array(np.concatenate(hashes).view(np.int64))], ["id", "row", "block", "n", "at", "pos", "hash"])


def _word_places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and where lines break, in code points."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    blank = np.r_[True, (raw == 32) | ((raw >= 9) & (raw <= 13)), True]
    point = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return (point[np.flatnonzero(blank[:-1] & ~blank[1:])], point[np.flatnonzero(~blank[:-1] & blank[1:])],
            point[np.flatnonzero(raw == 10)])


def _span_batches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Overlapping windows as one span each, in code points, but for spans within a paragraph that is reported."""
    for batch in pieces(batches, 200):
        sizes, lo, hi, n, first_id, nameless, kept = _flat(batch.column("marks"), "lo", "hi", "n", "first_id", "nameless", "kept")
        of = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((lo, of))
        lo, end, n, first_id, nameless, kept = (c[order] for c in (lo, hi + min_words, n, first_id, nameless, kept))
        # Windows of later texts come after all those before: ends grow from text to text.
        shift = of * (int(end.max(initial=0)) + 1)
        reach = np.maximum.accumulate(end + shift)
        new = np.r_[True, lo[1:] + shift[1:] >= reach[:-1]] if len(lo) else np.empty(0, bool)
        begin = np.flatnonzero(new)
        out_text, out_lo, out_hi = of[begin], lo[begin], (reach - shift)[np.r_[begin[1:], len(lo)] - 1] if len(lo) else lo
        many, line_start, line_length = _flat(batch.column("lines"), "start", "length")
        line_end = np.cumsum(many)
        texts, spans = batch.column("text"), np.searchsorted(out_text, np.arange(len(sizes) + 1))
        start, length, number, use = (np.zeros(len(begin), np.int64) for _ in range(4))
        for i in range(batch.num_rows):
            a, b = spans[i], spans[i + 1]
            words, ends, breaks = _word_places(texts[i].as_py())
            start[a:b], length[a:b] = words[out_lo[a:b]], ends[out_hi[a:b] - 1] - words[out_lo[a:b]]
            number[a:b] = np.searchsorted(breaks, start[a:b])
            here = slice(line_end[i] - many[i], line_end[i])
            known = np.sort(line_start[here])
            known_end = np.r_[-1, np.sort(line_start[here] + line_length[here])]
            use[a:b] = start[a:b] + length[a:b] > known_end[np.searchsorted(known, start[a:b], "right")]
        cut = begin if len(begin) else np.empty(0, np.int64)
        least, most, nobody, stays = ((f.reduceat(c, cut) if len(cut) else c) for f, c in (
            (np.minimum, first_id), (np.maximum, n), (np.logical_or, nameless), (np.logical_or, kept)))
        table = pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(out_text)), pa.array(number), pa.array(start), pa.array(length),
             pa.array(least, pa.int64(), mask=nobody.astype(bool)), pa.array(most, pa.int64()), pa.array(stays.astype(bool))],
            ["id", "paragraph", "start", "length", "component_id", "occurrences", "kept"])
        yield table.filter(pa.array(use.astype(bool)))


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20,
                        words: int = 5, percent: int = 75, recall: float = 0.999999) -> DataFrame:
    """Rows (id, paragraph, start, length, component_id, occurrences, kept, run) for passages that occur again.

    Paragraphs (``run`` false) that are alike: ``component_id`` is the smallest id of the component; ``kept`` marks
    its first occurrence by (id, paragraph).

    Runs of words (``run`` true): windows of ``min_words`` consecutive words that stand in two places or more,
    of one text or several, overlapping windows put together. A run that lies within a paragraph of the result has
    no row of its own; else ``paragraph`` is the one it begins in. ``component_id`` is the smallest id that
    holds one of its windows, ``occurrences`` the most places a window of it has. A run is ``kept`` if one of its windows
    stands there first (by id, then by text and place), so that each window stays in some text.
    """
    scratch = Scratch(docs.sparkSession)
    bands, rows = tuned_bands(percent / 100, recall)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    source = source.filter("text is not null").withColumn("row", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text"))

    units = source.mapInArrow(lambda it: _unit_batches(it, min_words, words, bands, rows), _UNITS)
    units = scratch.write(units, "units")
    # The tables of one kind of unit go before those of the other are written.
    steps = Scratch(docs.sparkSession)
    lines = scratch.write(_alike(source, units, min_words, words, percent, steps), "lines")
    steps.release()
    marks = _repeated_windows(source, units, min_words, words, steps)
    known = marks.select("row", "mark", F.lit(None).cast("struct<start:bigint,length:bigint>").alias("line")).unionByName(
        lines.select("row", F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"), F.struct("start", "length").alias("line")))
    known = known.groupBy("row").agg(F.collect_set("mark").alias("marks"), F.collect_set("line").alias("lines"))
    known = scratch.write(known.filter(F.size("marks") > 0), "known")
    steps.release()
    scratch.release("units")
    spans = _texts_of(source, known).select("id", "text", "marks", "lines")
    spans = spans.mapInArrow(lambda it: _span_batches(it, min_words),
                             "id long, paragraph long, start long, length long, component_id long, occurrences long, kept boolean")
    out = lines.drop("row").withColumn("run", F.lit(False)).unionByName(spans.withColumn("run", F.lit(True)))
    return out.withColumnRenamed("id", id_col)


def _texts_of(source: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of the rows named in ``rows``, with the columns there."""
    return marked_by_sieve(source, sieve(rows, F.col("row")), F.col("row"), "_near").filter("_near").drop("_near").join(rows, "row")


def _repeated_windows(source: DataFrame, units: DataFrame, min_words: int, words: int, scratch: Scratch) -> DataFrame:
    """Rows (row, mark): windows that stand in two places or more, in ranges (lo, hi) of their first words in the text."""
    posted = units.filter("key is not null").select("id", "row", "at", "lo", "hi", "key", "block")
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), (F.min("block") != F.max("block")).alias("mixed"))
    shared = scratch.write(shared.filter("_n > 1").select("key", "mixed"), "shared")
    near = marked_by_sieve(posted, sieve(shared, F.col("key")), F.col("key"), "_near").filter("_near").drop("_near")
    near = scratch.write(near.join(shared, "key").drop("key"), "near")
    place = F.struct("id", "row", "at")
    blocks = near.groupBy("block", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row", "at", "lo", "hi")).alias("_at"))
    blocks = scratch.write(blocks.select("block", "mixed", "n", F.struct("_at.id", "_at.row", "_at.at").alias("first"), "_at.lo", "_at.hi"), "blocks")

    # One text of each block whose key has others too is read again.
    mixed = blocks.filter("mixed").groupBy(F.col("first.row").alias("row")).agg(
        F.collect_list(F.struct("block", "n", "first.at", "lo", "hi")).alias("wanted"))
    texts = _texts_of(source, scratch.write(mixed, "wanted-windows")).dropDuplicates(["row"]).select("id", "row", "text", "wanted")
    windows = texts.mapInArrow(lambda it: _window_batches(it, min_words, words),
                               "id long, row long, block long, n long, at long, pos long, hash long")
    windows = scratch.write(windows, "windows")
    again = windows.groupBy("hash").agg(F.sum("n").alias("_n"), F.min(place).alias("_first")).filter("_n > 1")
    some = windows.drop("n").join(scratch.write(again, "again"), "hash").groupBy("block").agg(
        F.min("pos").alias("_lo"), F.max("pos").alias("_hi"), F.max("_n").alias("n"), F.min("_first.id").alias("first_id"),
        F.max(F.col("_first.id").isNull()).alias("nameless"), F.max(place.eqNullSafe(F.col("_first"))).alias("own"),
        F.max("row").alias("_row"), F.max("at").alias("_at"))
    whole = blocks.filter("not mixed").select(
        "block", F.lit(0).cast("long").alias("_lo"), (F.col("hi") - F.col("lo")).alias("_hi"), "n", F.col("first.id").alias("first_id"),
        F.col("first.id").isNull().alias("nameless"), F.lit(True).alias("own"), F.col("first.row").alias("_row"), F.col("first.at").alias("_at"))
    found = scratch.write(whole.unionByName(some), "found")
    mark = F.struct((F.col("lo") + F.col("_lo")).alias("lo"), (F.col("lo") + F.col("_hi")).alias("hi"), "n", "first_id", "nameless",
                    (F.col("own") & (F.col("row") == F.col("_row")) & (F.col("at") == F.col("_at"))).alias("kept"))
    return near.drop("mixed", "n").join(found, "block").select("row", mark.alias("mark"))


def _alike(source: DataFrame, units: DataFrame, min_words: int, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Paragraphs that are alike."""
    found = units.filter("item is not null").select("id", "row", "paragraph", "start", "length", "item", "size", "keys")
    members = shared_keys(found.select(F.explode("keys").alias("key"), "item", "size"), scratch)
    items = scratch.write(members.select("item").distinct(), "items")

    # The sets of paragraphs that collide are read from the texts again, one occurrence of each.
    first = found.join(items, "item", "left_semi").groupBy("item").agg(F.min("row").alias("row"))
    wanted = scratch.write(first.select("row").distinct(), "wanted")
    near = _texts_of(source, wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = shingler(words)
        for batch in pieces(batches):
            hashes = [shingle(raw) for t in batch.column("text").to_pylist() for *_, raw in paragraphs(t, min_words)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(h) for h in hashes], pa.int64()), lists([parity_bits(h) for h in hashes]), lists(hashes)],
                ["item", "sketch", "whole"])

    features = near.select("text").mapInArrow(sets, "item long, sketch array<long>, whole array<long>")
    features = scratch.write(features.join(items, "item", "left_semi").dropDuplicates(["item"]), "sets")

    roots = linked_components(members, features, percent, scratch)

    rooted = found.drop("keys", "size").groupBy("item").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("id", "paragraph")).alias("_at"))
    rooted = scratch.write(rooted.join(roots, "item", "left").withColumn("root", F.coalesce("root", "item")), "rooted")
    groups = rooted.groupBy("root").agg(F.sum("_n").alias("occurrences"), F.min("_at").alias("_first"))
    named = rooted.join(groups.filter("occurrences > 1"), "root").select("item", "occurrences", "_first")
    named = scratch.write(named, "named")
    out = found.select("id", "row", "paragraph", "start", "length", "item").join(named, "item")
    return out.select("row", "id", "paragraph", "start", "length", F.col("_first.id").alias("component_id"),
                      "occurrences", F.struct("id", "paragraph").eqNullSafe(F.col("_first")).alias("kept"))
