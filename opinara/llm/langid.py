"""Language identification with word-first backoff.

A word known from training scores by its log frequency in each language. A word never seen falls back to
its character n-grams, longest first: the first length of which any n-gram is known decides. The
scores of all words of a text are summed per language.

Training counts words and n-grams over a sample of labelled texts of bounded size (``max_texts``, whole
texts, drawn by a hash of the id); prediction reads every text as a whole.

Defined results: a text that is null or has no letter is ``und`` with score 0. Ties go to the language name
that sorts first. Without any labelled text every prediction is ``und``. Every row gives a row. An empty
table gives an empty table. Columns of the input play no part unless named.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Rows, WordTable, process_cache, share_value

_LETTERS = re.compile(r"[^\W\d_]+")
GRAMS = (5, 4, 3, 2, 1)
PIECES_KEPT = 500_000
_FLUSH = 400_000


def _words(text: str) -> list[str]:
    """Runs of letters. Number signs that the pattern takes for letters (``½``, ``Ⅷ``) part words as digits do."""
    out = []
    for run in _LETTERS.findall(text.lower()):
        out += [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
    return out


def _grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class LanguageModel:
    """Log frequencies per language, of words and of n-grams."""

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    name: str

    def word_scores(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        for n in GRAMS:
            found = [g for g in map(self.grams.get, _grams(word, n)) if g is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.languages), np.float32)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, kind, item, n); memory stays bounded by handing them on now and then."""
    counts: dict[str, Counter] = {}

    def rows() -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for lang, words in counts.items():
            grams: Counter = Counter()
            for word, n in words.items():
                for size in GRAMS:
                    for g in _grams(word, size):
                        grams[g] += n
            for kind, found in ((0, words), (1, grams)):
                cols[0] += [lang] * len(found)
                cols[1] += [kind] * len(found)
                cols[2] += found.keys()
                cols[3] += found.values()
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()),
             pa.array(cols[3], pa.int64())], ["lang", "kind", "item", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(_words(text or ""))
            if sum(map(len, counts.values())) > _FLUSH:
                yield rows()
    if counts:
        yield rows()


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_texts: int = 12_000, least: int = 3) -> LanguageModel:
    """Fit on labelled rows. Words and n-grams seen fewer than ``least`` times are left to backoff.

    The sample holds about ``max_texts`` texts at most, so the tables are bounded by it.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    total = rows.count()
    draw = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 20))
    if total > max_texts:
        rows = rows.filter(draw < int((1 << 20) * max_texts / total))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_count_batches, "lang string, kind int, item string, n long")
    table = counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    at = {lang: i for i, lang in enumerate(langs)}
    raw: tuple[dict, dict] = ({}, {})
    for lang, kind, item, n in zip(*(table.column(c).to_pylist() for c in ("lang", "kind", "item", "n")), strict=True):
        raw[kind].setdefault(item, np.zeros(len(langs), np.float32))[at[lang]] = n

    def logs(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {}
        by_size: dict[int, np.ndarray] = {}
        for item, n in found.items():
            size = len(item) if found is raw[1] else 0
            by_size[size] = by_size.get(size, 0) + n
        for item, n in found.items():
            mass = by_size[len(item) if found is raw[1] else 0]
            score = np.log((n + 0.5) / (mass + 0.5 * len(found)))
            out[item] = np.maximum(score - score.max(), -8).astype(np.float32)  # one word cannot decide alone
        return out

    return LanguageModel(langs, logs(raw[0]), logs(raw[1]), uuid.uuid4().hex)


def _scorer(load: Callable[[], LanguageModel], name: str) -> tuple[list[str], WordTable, Rows]:
    def make() -> tuple[list[str], WordTable, Rows]:
        model = load()
        width = len(model.languages)
        rows = Rows(width + 1, np.float32)  # the scores, and the number of words

        def grow(fresh: list[bytes]) -> None:
            new = np.zeros((len(fresh), width + 1), np.float32)
            for row, piece in zip(new, fresh, strict=True):
                for word in _words(piece.decode("utf-8", "replace")):
                    row[:width] += model.word_scores(word)
                    row[width] += 1
            rows.extend(new)

        return model.languages, WordTable(grow, rows.clear, PIECES_KEPT), rows

    return process_cache(("langid", name), make)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score). The score is the posterior share of the language, under equal priors."""
    load, name = share_value(docs.sparkSession, model), model.name
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table, found = _scorer(load, name)
        for batch in batches:
            preds, scores = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                pieces = text.split() if text else []
                codes = table.codes(pieces)
                total = found.view[codes].sum(axis=0, dtype=np.float64) if pieces else np.zeros(len(languages) + 1)
                if not total[-1] or not languages:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                shares = np.exp(total[:-1] - total[:-1].max())
                best = int(np.argmax(shares))
                preds.append(languages[best])
                scores.append(float(shares[best] / shares.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
