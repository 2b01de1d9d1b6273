"""Language, toxicity, page text and vectors: held-out accuracy, brute force, hand-written cases."""

import os

import numpy as np
import pytest

from opinara.llm import langid, permutation_index, queries, tag_paths, toxicity

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@needs_tables
def test_language_of_held_out_documents(spark):
    got = queries.language_id(spark, SF).filter("held_out").join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    rows = [r for r in got.collect() if r.lang is not None]
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_backoff_and_edges(spark):
    train = [(i, "the cat sat on the mat" if i % 2 else "die katze schlief gestern nacht", "en" if i % 2 else "de") for i in range(8)]
    model = langid.train(spark.createDataFrame([*train, (9, None, "en"), (10, "x", None)], "doc_id long, text string, lang string"))
    docs = [(1, "the mat"), (2, "Katzen schliefen"), (3, None), (4, ""), (5, "12 !! 34"), (1, "the mat")]
    got = langid.predict(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predict(empty, langid.train(empty)).count() == 0


@pytest.fixture(scope="module")
def chars(spark):
    words = "the idiot and the stupid moron are worthless pathetic trash of a loser and a clown with scum disgusting text " * 30
    return toxicity.train_chars(spark.createDataFrame([(words,)], "text string"))


@pytest.mark.parametrize(("written", "word"), [
    ("id1ot", "idiot"), ("st.u.p.i.d", "stupid"), ("iddiooot", "idiot"), ("tr@sh", "trash"), ("$cum", "scum"), ("m0r0n", "moron"),
    ("p4thet1c", "pathetic"), ("l0s3r", "loser"), ("w-o-r-t-h-l-e-s-s", "worthless"), ("c1own", "clown"), ("IDIOT!!", "idiot")])
def test_obfuscated_words_are_restored(chars, written, word):
    assert word in toxicity.restored_words(written, chars)


def test_toxicity_of_obfuscated_texts_and_edges(spark, chars):
    bad = ["you idiot", "such a moron here", "stupid idiot", "what a moron", "stupid text", "an idiot again"]
    fine = ["you and me", "such a text here", "what a day", "the cat", "a quiet day again", "with the text", "here and there", "again and again"]
    docs = [(i, f"{t} {i}", "clash") for i, t in enumerate((bad + fine) * 6)]
    labels = [(i, int(i % len(bad + fine) < len(bad))) for i in range(len(docs))] + [(0, None), (None, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), chars)
    new = [(1, "oh 1d10t", ""), (2, "i d i o t , m o r o n", ""), (3, "a day with the cat", ""), (4, None, ""), (5, "", "")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string, score string"), model).collect()}
    assert min(got[1], got[2]) > 0.5 > max(got[3], got[4], got[5])
    none = toxicity.train(frame, spark.createDataFrame([], "doc_id long, toxic int"), chars)
    assert {round(r.score, 6) for r in toxicity.score(frame, none).collect()} == {0.0}
    assert toxicity.score(frame.limit(0), model).count() == 0


@needs_tables
def test_toxicity_of_held_out_documents(spark):
    sf = SF.replace("0.01", "0.1")
    labels = queries.table(spark, sf, "labels").select("doc_id", "toxic")
    got = queries.toxic(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted for r in got if r.toxic == 1]) > 0.85
    assert np.mean([r.predicted for r in got if r.toxic == 0]) < 0.01


def test_page_text():
    page = ("<html><head><title>T</title><style>p{}</style><script>a='</p>'</script></head><body><header>Site. A, b.</header><nav><ul>"
            "<li>Home</ul></nav><div class='ad-box'>Buy, now. Today.</div><main><article><h1>Title &amp; more</h1>"
            "<p>First,\n  long &quot;sentence&quot; here, with words. And another one.<p>Second <b>bold</b>, text<br>goes on. Really.</p>"
            "<form>Name: <input></form><section class=\"comments\"><p>Nice, one. Thanks, all.</p></section></article></main>"
            "<aside>More, links. Here.</aside><footer>&copy; me.</footer>")
    want = "Title & more\n\nFirst, long \"sentence\" here, with words. And another one.\n\nSecond bold, text goes on. Really."
    assert tag_paths.main_text(page) == want
    assert tag_paths.main_text(page[: page.index("goes on")]) == want[: want.index(" goes on")]
    plain = "<body><div id='menu'>A | B | C</div><div class='post'><p>One, two. Three, four.</p><p>Five, six. Seven.</p></div><div>Imprint</div>"
    assert tag_paths.main_text(plain) == "One, two. Three, four.\n\nFive, six. Seven."
    for nothing in (None, "", "   ", "<p></p>", "<script>x", "<!-- a", "<"):
        assert tag_paths.main_text(nothing) in ("", "<")


def test_pages_keep_other_columns(spark):
    rows = [(1, "u", "<p>Hi, you. There.</p>", 5), (2, None, None, 6), (2, None, None, 6)]
    got = tag_paths.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"))
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.collect()) == [(1, "Hi, you. There.", 15), (2, "", 0), (2, "", 0)]


def test_page_text_outside_the_main_element():
    long, short = "Long, first part. It goes on, and on. " * 6, "A second, shorter part. It ends, here."
    split = f"<body><h1><b>The</b> <i>title</i></h1><div><p>{long}</p><p>{long}</p></div><div>Photo</div><div><p>{short}</p><p>End</p></div><div>Imprint</div>"
    parts = ["The title", long.strip(), long.strip(), "Photo", short, "End"]
    assert tag_paths.main_text(split) == "\n\n".join(parts)
    outside = f"<body><div>Menu</div><article>{f'<p>{long}</p>' * 4}</article><div><p>{long}</p></div><div>Imprint</div>"
    assert tag_paths.main_text(outside) == "\n\n".join([long.strip()] * 5)
    marked = f"<body><article><p>{long}</p></article><div class='comments'><p>{long}</p></div>"
    assert tag_paths.main_text(marked) == long.strip()


@needs_tables
def test_search_recall(spark):
    rows = queries.table(spark, SF, "embeddings").collect()
    ids = np.array([r.vec_id for r in rows])
    units = np.array([r.embedding for r in rows], float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    got = {}
    for r in queries.nearest(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        near = units @ units[at]
        near[at] = -2
        best = set(ids[np.lexsort((ids, -near))[:5]])
        found = sorted(got[ids[at]])
        assert [k for k, *_ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - near[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in found)
        hits, total = hits + len(best & {v for _, v, _ in found}), total + 5
    assert hits / total >= 0.9


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [0.0, 1.0]), (9, [1.0]), (0, [1.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, query string")
    got = permutation_index.search(frame, frame.filter("vec_id in (0, 4)"), k=5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 8)]
    assert permutation_index.search(frame.limit(0), frame.limit(0)).count() == 0
