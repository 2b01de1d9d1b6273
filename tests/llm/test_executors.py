"""Executors without this package, and input columns that carry the names operators use inside."""

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from opinara.llm import exact_dedup, langid, mixing, parity_join, toxicity

ROOT = Path(__file__).resolve().parents[2]
BARE = """
import sys
sys.path.insert(0, {root!r})  # of the driver only: workers start without it
from opinara.session import local_session
from opinara.llm import langid, toxicity
spark = local_session(2)
def found(_):
    import importlib.util
    return importlib.util.find_spec("opinara") is not None
assert not any(spark.sparkContext.parallelize([0], 1).map(found).collect())
docs = spark.createDataFrame([(i, "the cat sat on the mat" if i % 2 else "die katze schlief du idiot", "en" if i % 2 else "de", i % 2)
                              for i in range(40)], "doc_id long, text string, lang string, y int")
model = langid.train(docs)
got = langid.predict(docs, model).collect()
assert all((r.lang_pred == "en") == (r.doc_id % 2 == 1) for r in got), got
words = toxicity.train(docs, docs.selectExpr("doc_id", "1 - y AS toxic"), toxicity.train_chars(docs), least=1)
assert toxicity.score(docs, words).count() == 40
print("both ran")
"""


def test_models_reach_executors_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", BARE.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=300)
    assert "both ran" in done.stdout, done.stderr[-3000:]


def test_columns_named_like_helpers_keep_their_values(spark):
    """Null and repeated rows, empty texts and an empty table among them."""
    text = "one two three four five six seven eight nine ten"
    near = text + " eleven"
    data = [(1, text, "a"), (2, text, "a"), (3, near, "b"), (4, None, None), (5, "", "b"), (6, "something else altogether", "a"), (6, "something else altogether", "a")]
    helpers = ["_name", "_key", "_text", "text_key", "_take", "_from", "_chunk", "_at", "_maybe", "_in1", "_copies", "_rows"]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumns(
        {h: F.concat(F.lit(f"{h}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for h in helpers})
    chars = toxicity.train_chars(docs)
    model = toxicity.train(docs, spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, toxic int"), chars)
    results = {
        "exact": (exact_dedup.drop_duplicates(docs), {2, 3, 5, 6}), "near": (parity_join.drop_linked(docs), {1, 4, 5, 6}),
        "mix": (mixing.take(docs), None), "toxic": (toxicity.score(docs, model).drop("score"), {1, 2, 3, 4, 5, 6})}
    for name, (out, ids) in results.items():
        assert out.columns == docs.columns, name
        got = out.collect()
        assert ids is None or {r.doc_id for r in got} == ids, (name, got)
        assert all(r[h] == f"{h}:{r.doc_id}" for r in got for h in helpers), name
    none = docs.limit(0)
    for out in (exact_dedup.drop_duplicates(none), parity_join.drop_linked(none), mixing.take(none), toxicity.score(none, model).drop("score")):
        assert out.columns == docs.columns and out.count() == 0


def test_number_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "cat mat", "en"), (2, "½ ² ①", None), (3, "Ⅷ", None), (4, "cat½mat", None), (5, "x" * 200_000, None)],
                                 "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.train(docs, least=1)).collect()}
    assert got[2] == got[3] == ("und", 0.0) and got[4][0] == got[5][0] == "en"
