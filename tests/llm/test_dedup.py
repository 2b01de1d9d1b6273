"""Exact and near duplicates, components and repeated paragraphs against brute force."""

import hashlib
import random
import re

import pytest

from opinara.llm import exact_dedup, linking, paragraph_dedup, parity_join
from opinara.llm.components import components

SCHEMA = "doc_id long, text string, source string, item long, key string, size long"


def frame(spark, rows):
    """Documents with further columns whose names clash with working columns."""
    return spark.createDataFrame([(i, t, "s", 1, "k", 2) for i, t in rows], SCHEMA)


def lower(text):
    return (text or "").encode().lower()


def shingles(text):
    w = lower(text).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    """Smallest id reachable, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    best = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(best[a], best[b])
            changed |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    return {i: (len(sets[i]), best[i]) for i in sets}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    out, number = [], 0
    for size in (1, 3, 4, 5, 6, 8, 9, 12, 20, 35, 60, 120, 300):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 4, 9):
                words = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(words))
                    words[at : at + rng.choice((0, 1, 1))] = [rng.choice(vocabulary)]
                out.append((number, " ".join(words).title() if edits == 1 else " ".join(words)))
                number += 1
    line = " ".join(rng.choice(vocabulary) for _ in range(9))  # a line that many texts share
    for _ in range(120):
        out.append((number, f"{line}\n" + " ".join(rng.choice(vocabulary) for _ in range(40))))
        number += 1
    return out + [(number, None), (number + 1, ""), (number + 2, " \n\t ")]


def test_jaccard_components_match_all_pairs(spark, rows):
    got = parity_join.jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows)
    assert len(got) == len(rows)


def test_jaccard_on_a_family_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"x{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = parity_join.jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows)


def test_drop_linked_keeps_one_of_each_component(spark, rows):
    again = rows + [rows[0], rows[0]]  # repeated rows
    kept = parity_join.drop_linked(frame(spark, again))
    want = linked(rows)
    assert kept.columns == ["doc_id", "text", "source", "item", "key", "size"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, low) in want.items() if i == low)


def test_drop_linked_with_repeated_and_null_ids(spark):
    odd = [(1, "a b c d e f"), (1, "g h i j k l"), (None, "m n o p q r"), (None, "M n o p q r"), (None, "s t u v w x"), (None, None)]
    kept = [(r.doc_id, lower(r.text).decode()) for r in parity_join.drop_linked(frame(spark, odd)).collect()]
    want = [(1, "a b c d e f"), (1, "g h i j k l"), (None, ""), (None, "m n o p q r"), (None, "s t u v w x")]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_jaccard_edge_tables(spark):
    assert parity_join.jaccard_components(frame(spark, [])).count() == 0
    odd = [(1, "a b c"), (1, "d e f"), (None, "a b c"), (7, "A B C")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in
                 parity_join.jaccard_components(frame(spark, odd)).collect())
    assert got == [(0, 1, 1), (1, 1, 1), (1, 1, 1), (7, 1, 1)]


def test_parity_bounds():
    for size in range(1, 400):
        for other in range(size, int(size / 0.75) + 1):
            shared = [b for b in parity_join.bands(size, 0.75) if b in parity_join.bands(other, 0.75)]
            assert any(int((size + other) / 7) <= bound for _, bound in shared), (size, other)


def test_exact_dedup(spark, rows):
    docs = rows + [(900, "Same Text"), (901, "same text"), (902, "SAME TEXT"), (903, "ÉTÉ"), (904, "été"), (905, None)]
    groups = {}
    for i, t in docs:
        groups.setdefault(lower(t), []).append(i)
    got = exact_dedup.duplicate_classes(frame(spark, docs), all_hashes=True).collect()
    assert len(got) == len(docs)
    by_id = dict(docs)
    for r in got:
        same = groups[lower(by_id[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
        assert r.text_sha256 == hashlib.sha256(lower(by_id[r.doc_id])).hexdigest()
    kept = exact_dedup.drop_duplicates(frame(spark, docs + [docs[-2]] * 3))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.drop_duplicates(frame(spark, [])).count() == 0
    assert exact_dedup.duplicate_classes(frame(spark, [(None, "a"), (None, "A"), (3, "a")])).filter("kept").count() == 1


def test_components_against_union(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    ends = {x for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in ends}


def test_repeated_paragraphs(spark):
    rng = random.Random(2)

    def text(n):
        return " ".join(f"v{rng.randrange(5000)}" for _ in range(n))

    passage, lone = text(60), text(70)
    near = passage.split()
    near[30] = "changed"
    docs = [(1, f"{text(30)}\n{passage}\n{text(55)}"), (2, f"{passage.upper()}"), (3, f"{text(80)}\n\n{' '.join(near)}"),
            (4, lone), (5, None), (6, ""), (7, f"{text(40)} {text(30)}")]
    got = paragraph_dedup.repeated_paragraphs(frame(spark, docs), min_words=50).collect()
    assert sorted((r.doc_id, r.paragraph, r.component_id, r.occurrences, r.kept) for r in got) == [
        (1, 1, 1, 3, True), (2, 0, 1, 3, False), (3, 2, 1, 3, False)]
    spans = {r.doc_id: dict(docs)[r.doc_id][r.start : r.start + r.length] for r in got}
    assert spans[1] == passage and spans[3] == " ".join(near)
    assert paragraph_dedup.repeated_paragraphs(frame(spark, [])).count() == 0
    bands, width = paragraph_dedup.tuned_bands(0.75, 0.999999)
    assert 1 - (1 - 0.75**width) ** bands >= 0.999999


def test_repeated_runs_match_all_windows(spark):
    """Every window of 50 words that stands in two places lies in a row, wherever lines break."""
    rng = random.Random(8)

    def words(n):
        return [f"v{rng.randrange(9000)}" for _ in range(n)]

    def lay(w):  # lines of 7 to 70 words, other white space in between
        out = []
        while w:
            n = rng.randrange(7, 70)
            out.append(rng.choice((" ", "\t", "  ")).join(w[:n]))
            w = w[n:]
        return "\n".join(out)

    base = words(400)
    docs = [(0, lay(base)), (1, lay(base)), (2, " ".join(w.upper() for w in base)), (3, " ".join(["oh"] * 120)), (4, None), (5, " é ")]
    for i in range(10, 60):
        at, n = rng.randrange(300), rng.choice((49, 50, 51, 55, 70, 98))
        piece = base[at : at + n]
        if i % 5 == 0:
            piece[n // 2] = "changed"
        docs.append((i, lay(words(rng.randrange(90)) + ["É" * 3] + piece + words(rng.randrange(90)))))
    docs += [(None, " ".join(base[20:90])), docs[12], (70, lay(words(20) + base[:60] + words(9) + base[:60]))]

    places = {}
    for k, (i, t) in enumerate(docs):
        w = lower(t).split()
        for s in range(len(w) - 49):
            places.setdefault(tuple(w[s : s + 50]), []).append((k, s))
    got = paragraph_dedup.repeated_paragraphs(frame(spark, docs), min_words=50).collect()
    texts = {}
    for i, t in docs:
        texts.setdefault(i, t)
    lines = {(r.doc_id, r.start, r.start + r.length) for r in got if not r.run}
    want = []
    for k, (i, t) in enumerate(docs):
        marks = sorted((s, p) for p in places.values() if len(p) > 1 for q, s in p if q == k)
        spans = []
        for s, p in marks:
            if spans and s < spans[-1][1]:
                spans[-1][1] = s + 50
            else:
                spans.append([s, s + 50, []])
            spans[-1][2].append(p)
        spot = [m.span() for m in re.finditer(r"[^\x09-\x0d\x20]+", t or "")]
        for a, b, held in spans:
            start, end = spot[a][0], spot[b - 1][1]
            if not any(j == i and x <= start and end <= y for j, x, y in lines):
                ids = [docs[q][0] for p in held for q, _ in p]
                want.append((i, t[:start].count("\n"), start, end - start, None if None in ids else min(ids), max(map(len, held))))
    assert len(want) > 30
    have = [(r.doc_id, r.paragraph, r.start, r.length, r.component_id, r.occurrences) for r in got if r.run]
    assert sorted(have, key=str) == sorted(want, key=str)
    # Without the runs and lines that are not kept, every window is left somewhere.
    drop = [(r.doc_id, r.start, r.start + r.length) for r in got if r.run and not r.kept]
    for p in places.values():
        spot = [[m.span() for m in re.finditer(r"[^\x09-\x0d\x20]+", docs[q][1])][s : s + 50] for q, s in p] if len(p) > 1 else []
        assert not spot or not all(any(j == docs[q][0] and x <= w[0][0] and w[-1][1] <= y for j, x, y in drop)
                                   for (q, _), w in zip(p, spot, strict=True))
    assert any(r.run and not r.kept for r in got)


def test_links_between_items_of_large_and_small_keys(spark):
    """40 items share a passage and its key; each has a near copy that shares only a key of their own."""
    import numpy as np

    from opinara.llm.common import Scratch

    passage = list(range(1, 9))
    members, features, want = [], [], {}
    for i in range(40):
        own = [1000 * (i + 1) + k for k in range(40)]
        sets = {i: passage + own, 100 + i: own + [1000 * (i + 1) + 900]}  # 40 of 49
        for item, whole in sets.items():
            h = np.array(whole, np.uint64)
            features.append((item, parity_join.parity_bits(h).view(np.int64).tolist(), whole))
            members.append((5000 + i, item, len(whole)))
        members.append((1, i, len(sets[i])))
        want[i] = want[100 + i] = i
    got = linking.linked_components(
        spark.createDataFrame(members, "key long, item long, size long"),
        spark.createDataFrame(features, "item long, sketch array<long>, whole array<long>"), 75, Scratch(spark)).collect()
    low = {}
    for r in got:
        low[r.root] = min(r.item, low.get(r.root, r.item))
    assert {r.item: low[r.root] for r in got} == want


def test_hubs_of_a_round_are_bounded(spark, monkeypatch):
    """A key of 28 items in 25 components; no array holds more than 8 hubs, and all links are found."""
    import numpy as np

    from opinara.llm.common import Scratch

    monkeypatch.setattr(linking, "HUBS", 8)
    sets = {i: [500 * min(i, 24) + k for k in range(40)] + ([20_000 + i] if i >= 24 else []) for i in range(28)}
    for whole in sets.values():  # what all share, and what keeps own shingles from ruling items out
        whole += range(100_000, 100_030)
    for i in range(24):
        sets[i] = [500 * (i // 2) + k for k in range(40)] + [30_000 + i * 100 + k for k in range(12)] + list(range(100_000, 100_030))
    features = [(i, parity_join.parity_bits(np.array(w, np.uint64)).view(np.int64).tolist(), w) for i, w in sets.items()]
    largest, write = [], Scratch.write

    def spy(self, df, name):
        out = write(self, df, name)
        if name.startswith("hubs-") and "_hubs" in out.columns:
            largest.extend(len(r._hubs) for r in out.select("_hubs").collect())
        return out

    monkeypatch.setattr(Scratch, "write", spy)
    got = linking.linked_components(
        spark.createDataFrame([(1, i, len(w)) for i, w in sets.items()], "key long, item long, size long"),
        spark.createDataFrame(features, "item long, sketch array<long>, whole array<long>"), 75, Scratch(spark)).collect()
    root = {r.item: r.root for r in got}
    for a in sets:
        for b in sets:
            x, y = set(sets[a]), set(sets[b])
            assert (root[a] == root[b]) == (100 * len(x & y) >= 75 * len(x | y)), (a, b)
    assert largest and max(largest) <= 8


def test_rows_meet_the_hub_of_their_key_once(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        some = list(words)
        some[rng.randrange(100)] = f"x{rng.random()}"
        texts.append(" ".join(some))
    reads, write = [], linking.Scratch.write
    monkeypatch.setattr(linking.Scratch, "write", lambda self, df, name: (
        reads.append((name, any("/hubs-0/" in f for f in df.inputFiles()))), write(self, df, name))[1])
    got = parity_join.jaccard_components(frame(spark, list(enumerate(texts)))).collect()
    want = linked(list(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in got} == {i: low for i, (_, low) in want.items()}
    assert [name for name, read in reads if read] == ["met-0"]


def test_a_key_whose_strays_were_all_hubs_is_finished(spark, monkeypatch):
    """A key of a family of 30 near copies and four texts of their own: once the four have met all, no row of it goes on."""
    import numpy as np

    from opinara.llm.common import Scratch

    shared = list(range(100_000, 100_060))
    sets = {i: shared + list(range(70)) + [1_000 + i // 2] for i in range(30)}
    sets |= {30 + i: shared + [2_000 + 100 * (i // 2) + k for k in range(70)] + [3_000 + i] for i in range(4)}
    features = [(i, parity_join.parity_bits(np.array(w, np.uint64)).view(np.int64).tolist(), w) for i, w in sets.items()]
    rows, write = {}, Scratch.write

    def spy(self, df, name):
        out = write(self, df, name)
        rows[name] = out.count() if name.startswith("rooted-") else None
        return out

    monkeypatch.setattr(Scratch, "write", spy)
    got = linking.linked_components(
        spark.createDataFrame([(1, i, len(w)) for i, w in sets.items()], "key long, item long, size long"),
        spark.createDataFrame(features, "item long, sketch array<long>, whole array<long>"), 75, Scratch(spark)).collect()
    root = {r.item: r.root for r in got}
    assert {frozenset(i for i in root if root[i] == r) for r in root.values()} == {
        frozenset(range(30)), frozenset({30, 31}), frozenset({32, 33})}
    assert rows["rooted-1"] > 30 and rows["rooted-2"] == 0
