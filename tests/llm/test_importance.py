"""Importance resampling: hashes put together from parts, and all results against brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import importance, queries
from compare import connect, difference

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    raw = (text or "").encode()
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in raw))


def runs(text):
    words = words_of(text)
    return [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, min_words=20, buckets=10_000):
    bucket = lambda run: zlib.crc32(run) % buckets
    found = [Counter(map(bucket, runs(t))) for _, t in docs]
    s, t = sum(found, Counter()), sum((Counter(map(bucket, runs(x))) for x in target), Counter())
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for (i, text), counts in zip(docs, found, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in counts.items())
        rows.append([i, sum(counts.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), len(words_of(text))])
    eligible = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): n for n, r in enumerate(eligible[: percent * len(eligible) // 100], 1)}
    return Counter((*r[:4], rank.get(id(r))) for r in rows)


def resampled(spark, docs, target, **kw):
    frame = spark.createDataFrame([(i, t, "x", 1, b"b") for i, t in docs], "doc_id long, text string, words string, weight int, buckets binary")
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    return Counter(map(tuple, importance.resample(frame.repartition(3), aim, **kw).collect()))


def made_up(n=400, seed=0):
    rng = random.Random(seed)
    vocabulary = ["Über", "naïve", "x", "don't", "A1", "日本", "foo", "Bar", "baz-qux", "É", "a" * 90, "12"] + [f"w{i}" for i in range(60)]
    shared = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 9, 30]))) for _ in range(12)]
    docs = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randrange(0, 14))) for _ in range(rng.randrange(0, 9))]
        docs.append((i, rng.choice(["\n", "\n\n", "\r\n", " \n\t"]).join(lines)))
    return docs, [t for _, t in docs[:20]] + [" ".join(rng.choices(vocabulary[:12], k=40)) for _ in range(5)]


def test_crc_of_runs():
    rng = random.Random(1)
    shift = importance.CrcShift()
    for size in (0, 1, 2, 31, 47, 48, 49, 63, 64, 65, 1000, 70_001):
        heads = [rng.randbytes(rng.randrange(30)) for _ in range(20)]
        tail = rng.randbytes(size)
        got = shift(np.array([zlib.crc32(h) for h in heads], np.uint32), np.full(20, size)) ^ np.uint32(zlib.crc32(tail))
        assert got.tolist() == [zlib.crc32(h + tail) for h in heads]


def test_against_brute_force(spark):
    docs, target = made_up()
    assert resampled(spark, docs, target) == brute(docs, target)
    assert resampled(spark, docs[:200], target, buckets=97, percent=30, min_words=3) == brute(docs[:200], target, 30, 3, 97)
    assert resampled(spark, docs[:90], target, buckets=70_000) == brute(docs[:90], target, buckets=70_000)


def test_odd_texts(spark):
    docs = [(0, None), (1, ""), (2, "\n\n"), (3, "..."), (4, "One"), (5, "one\ntwo"), (6, "a\nb\nc\nd"), (7, "a b\nc"), (8, "same line\nsame line\nsame line"),
            (9, "same line"), (10, "\x00nul\x7f \x1f"), (11, " em\xa0space line"), (12, "word " * 40_000), (13, "x" * 300_000), (14, "a\n" * 30_000),
            (15, "tie " * 25), (15, "tie " * 25), (15, "other " * 25), (None, "null id " * 20), (None, "null id " * 20), (-3, "minus " * 30), (16, "same line\n" * 9 + "end")]
    docs += [(100 + i, "a line that a third of all rows hold\n" + f"number {i}") for i in range(60)]
    target = ["One two", None, "", "same line\nand more"]
    assert resampled(spark, docs, target, percent=50) == brute(docs, target, 50)


def test_groups_of_texts_are_worked_on_alike(spark, monkeypatch):
    docs, target = made_up(80, 3)
    monkeypatch.setattr(importance, "WORDS_AT_ONCE", 5)
    monkeypatch.setattr(importance, "HEAVY_SHARE", 3)
    assert resampled(spark, docs, target) == brute(docs, target)


def test_empty_tables(spark):
    docs, target = made_up(40, 4)
    assert resampled(spark, [], target) == Counter()
    assert resampled(spark, docs, []) == brute(docs, [])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.QUERIES["op12_importance"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert Counter(map(tuple, got.collect())) == brute(docs, target)
    assert difference(spark, connect(SF), SF, lambda *_: got, queries.ORACLES["op12_importance"]) == ""
