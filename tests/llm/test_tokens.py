"""Token counts, packing, mixing and the pipeline."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinara.llm import mixing, packing, queries, token_histogram, tokens

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "Hello, World!", "don't  stop\n\tit's", "<|endoftext|> and x<|endoftext|>y", "ÉTÉ Straße ΟΔΟΣ naïve", "a b c 12,345 €9.50",
         "é x̸= (word) --- ... _under_score_", "日本語 テスト", "👍🏽 ok", "word " * 3000, "x" * 5000, "a\x1cb \x85 c"]


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_piece_encoder_gives_the_ids_of_the_tokenizer():
    encode = tokens.encoder(PATH)
    for _ in range(2):  # new and remembered pieces
        for text, ids in zip(TEXTS, encode([t.encode() if t else t for t in TEXTS]), strict=True):
            assert ids.tolist() == reference_ids(text), text
    assert [len(ids) for ids in encode([None, b"", b" "])] == [0, 0, 0]


def test_piece_encoder_remembers_a_bounded_number_of_pieces(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "KEPT", 300)
    rng = random.Random(3)
    tokenizer = Tokenizer.from_file(PATH)
    encode = tokens.PieceEncoder(tokenizer, True, True)
    texts = [" ".join("".join(rng.choices("abcéÀZ.'1", k=rng.randrange(1, 7))) for _ in range(50)) for _ in range(200)] + TEXTS
    for at in range(0, len(texts), 5):
        some = texts[at : at + 5]
        for text, ids in zip(some, encode([t.encode() if t else t for t in some]), strict=True):
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text
        assert len(encode._new) + len(encode._old) <= 2 * (300 + 3 * 5 * 50)


def test_text_batches_are_bounded_in_rows_and_bytes():
    texts = ["x" * n for n in (10, 0, 90, 500, 1, 1, 1, 1, 1, 99)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    got = [b.column("text").to_pylist() for b in tokens.text_batches([batch, batch.slice(0, 0)], rows=4, size=100)]
    assert [t for part in got for t in part] == texts
    assert all(len(part) <= 4 and sum(len(t or "") for t in part[:-1]) <= 100 for part in got)


def test_other_tokenizers_encode_whole_texts():
    path = public.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    assert tokens.encoder(path)([b"a  b\n c"])[0].tolist() == Tokenizer.from_file(path).encode("a  b\n c").ids


def test_histogram(spark):
    lengths = [0, 3, 3, 5, 9, 9, 9, 20]
    got = token_histogram.length_histogram(spark.createDataFrame([(n, 1) for n in lengths], "n_tokens long, length long"))
    for r in got.collect():
        assert r.n_docs == lengths.count(r.length)
        assert r.docs_longer == sum(n > r.length for n in lengths)
        assert r.tokens_longer == sum(n for n in lengths if n > r.length)
        assert r.truncated_total == sum(min(n, r.length) for n in lengths)
    for limit in (0, 4, 9, 15, 100):
        assert token_histogram.truncated_total(got, limit) == sum(min(n, limit) for n in lengths)
    assert token_histogram.quantile(got, 0.5) == 5
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    counts = {r.doc_id: r.n_tokens for r in token_histogram.token_counts(docs, PATH).collect()}
    assert counts == {i: len(reference_ids(t)) for i, t in enumerate(TEXTS)}
    assert token_histogram.length_histogram(token_histogram.token_counts(docs.limit(0), PATH)).count() == 0


def test_differencing_is_even():
    rng = random.Random(0)
    sizes = [rng.randrange(1, 1024) for _ in range(800)]
    groups = packing.differencing(sizes, 100)
    assert sorted(i for g in groups for i in g) == list(range(800))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert len(sums) == 100 and max(sums) - min(sums) < 20
    window, offset = packing.pack_block(np.array([3000, 3000, 3000, 4096, 10]), 4096)
    assert len(set(window[:4])) == 4 and set(offset.tolist()) <= {0, 3000, 10}


def check_packing(rows, texts, capacity):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in texts.items():
        ids = np.array([*reference_ids(text), 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return len(by_sequence)


def test_packing_round_trip(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int, offset int")
    for capacity in (64, 4096):
        rows = packing.pack(docs, PATH, 2, capacity, with_ids=True).collect()
        check_packing(rows, dict(enumerate(TEXTS)), capacity)
        assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(docs.limit(0), PATH, 2).count() == 0
    twice = packing.pack(docs.limit(3).unionByName(docs.limit(3)), PATH, 2).collect()
    assert len(twice) == 6


def brute_targets(sizes, cycle=(3, 1, 2), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        target = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return full | target
        for s in over:
            full[s] = 2 * sizes[s]
            left -= full[s]


def test_mixing(spark):
    rng = random.Random(4)
    docs, number = [], 0
    for source, n in ((None, 40), ("a", 900), ("b", 60), ("B", 200), ("é", 100), ("~", 30), ("", 50)):
        for _ in range(n):
            docs.append((number, " ".join("w" * rng.randrange(1, 4) for _ in range(int(rng.paretovariate(1.1) * 5) % 900)), source))
            number += 1
    docs += [(number, None, "a"), (number + 1, " \t\n", None), (0, docs[0][1], None)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, size int, target string")
    rows = mixing.mix(frame).collect()
    assert len(rows) == len(docs)
    sizes, got, want_rows = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        got[r.source] = got.get(r.source, 0) + r.taken
        want_rows[r.source] = (r.source_size, r.target)
        assert r.taken in (0, r.size, 2 * r.size)
    want = brute_targets(sizes)
    for s, (size, target) in want_rows.items():
        assert size == sizes[s] and abs(target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(got[s] - target) <= 0.03 * target + 60, (s, got[s], target)
    text = dict((d[0], d[1]) for d in docs)
    assert all(r.size == len((text[r.doc_id] or "").encode().split()) for r in rows)
    again = mixing.mix(frame.repartition(7)).collect()
    assert sorted((r.doc_id, r.text_key, r.taken) for r in rows) == sorted((r.doc_id, r.text_key, r.taken) for r in again)
    taken = mixing.take(frame)
    assert taken.columns == frame.columns and taken.count() == sum(r.copies for r in rows)
    assert mixing.mix(frame.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_pipeline_against_brute_force(spark):
    """Every stage on the rows its predecessor kept; decisions that need no model are recomputed by hand."""
    import corpus_pipeline as p
    from test_dedup import linked, lower

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(p.STAGES)
    calm = stages["toxicity"](spark, docs, SF).cache()
    scores = {r.doc_id: r.score for r in queries.toxic(spark, SF).collect()}
    assert calm.columns == docs.columns
    assert {r.doc_id for r in calm.collect()} == {i for i, s in scores.items() if s < 0.5}
    unique = stages["exact dedup"](spark, calm, SF).cache()
    groups = {}
    for r in calm.collect():
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(max(g) for g in groups.values())
    apart = stages["n-gram Jaccard"](spark, unique, SF).cache()
    want = linked([(r.doc_id, r.text) for r in unique.collect()])
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, (_, low) in want.items() if i == low)
    mixed = stages["mixing"](spark, apart, SF).cache()
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies.values()) <= {1, 2} and mixed.columns == docs.columns
    assert copies == {r.doc_id: r.copies for r in mixing.mix(apart).collect() if r.copies}
    packed = stages["packing"](spark, mixed, SF).collect()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    ids = {i: len(reference_ids(t)) + 1 for i, t in texts.items()}
    assert sum(r.length for r in packed) == sum(ids[i] * n for i, n in copies.items())
    assert p.run(spark, SF).agg(F.sum("length")).first()[0] == sum(r.length for r in packed)
