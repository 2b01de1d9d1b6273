"""Toxicity of texts by noisy-channel deobfuscation.

Words written with look-alike characters, separators, spaced letters or stretched letters are restored
first: a lattice holds what every character may stand for (a letter, nothing, or a repetition of the
letter before), and a Viterbi search finds the letters that a character model of the corpus and the channel
together find likeliest. The restored text is scored by words: words, and beginnings of words, that
occur in toxic texts rather than others. A logistic curve over the strongest evidence gives the score.

The character model counts the trigrams of all texts. Labels are learned from a sample of labelled
texts of bounded size (``max_texts``, whole texts, drawn by a hash of the id).

Defined results: null and empty texts have no evidence and get the score of such texts. Without both labels
in the sample every score is the share of toxic labels (0 without any). A document labelled twice is
toxic if any label says so. Every row gives a row, repeated or not. An empty table gives an empty table.
Columns of the input play no part unless named.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Rows, Scratch, WordTable, apart, pieces, process_cache, share_value

# What a character other than a letter may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
               "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
               "*": "aeiou", "#": "aeiou", "%": "aeiou"}
SEPARATORS = "._-*~'`^·•:,;/\\+=|#"
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGES = re.compile(r"^[\"'(\[{<«„“¿¡*#_~-]*(?=[^\W\d_])|[.,;:!?\"')\]}>»“”…]+$")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_TRAIL = re.compile(r"([^\w\s])\1+$|^([^\w\s])\2+")
_AROUND = ".,;:!?\"'()[]{}<>«»„“”…"  # marks around a word that are mere punctuation
PREFIXES = (6, 5, 4)
PIECES_KEPT = 200_000
_FLUSH = 300_000
_LOW = -12.0


@dataclass
class CharModel:
    """Trigram log probabilities of lower-case letters, with backoff to shorter contexts."""

    counts: dict[str, int]
    _cache: dict[str, float] = field(default_factory=dict)
    _contexts: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for gram, n in self.counts.items():
            self._contexts[gram[:-1]] = self._contexts.get(gram[:-1], 0) + n

    def log_p(self, gram: str) -> float:
        """Of the last letter after the letters before it."""
        got = self._cache.get(gram)
        if got is None:
            p = 1 / 64
            for start in (2, 1, 0):
                part = gram[start:] if len(gram) == 3 else gram[max(0, start - 3 + len(gram)):]
                n, total = self.counts.get(part, 0), self._contexts.get(part[:-1], 0)
                p = (n + 4 * p) / (total + 4)
            got = self._cache[gram] = max(math.log(p), _LOW)
        return got


def decode(piece: str, model: CharModel, beam: int = 24) -> str:
    """The likeliest letters behind a piece of text."""
    chars = piece.lower()
    # State: the last two letters (with ^ before the word), whether the last character was that letter.
    best: dict[tuple[str, str], tuple[float, str]] = {("^^", ""): (0.0, "")}
    for char in chars:
        following: dict[tuple[str, str], tuple[float, str]] = {}

        def offer(state: tuple[str, str], cost: float, word: str) -> None:
            if state not in following or following[state][0] < cost:
                following[state] = (cost, word)

        for (context, last), (cost, word) in best.items():
            if char.isalpha():
                offer((context[1] + char, char), cost - 0.05 + model.log_p(context + char), word + char)
                if char == last:
                    offer((context, char), cost - 1.0, word)
            else:
                for letter in LOOK_ALIKES.get(char, ""):
                    doubt = 1.2 if len(LOOK_ALIKES[char]) < 3 else 2.5
                    offer((context[1] + letter, char), cost - doubt + model.log_p(context + letter), word + letter)
                if char == last:
                    offer((context, char), cost - 1.0, word)
                offer((context, char), cost - (1.5 if char in SEPARATORS else 5.0), word)
        best = dict(sorted(following.items(), key=lambda x: -x[1][0])[:beam])
    scored = [(cost + model.log_p(context + "$"), word) for (context, _), (cost, word) in best.items()]
    return max(scored)[1] if scored else ""


def restored_words(piece: str, model: CharModel) -> list[str]:
    """The words of one piece between white space: as they stand, and restored where they look obfuscated."""
    core = piece.strip(_AROUND)
    if core.isalpha() and not _STRETCHED.search(core):
        return [core.lower()]
    plain = [w.lower() for w in _LETTERS.findall(piece)]
    body = _TRAIL.sub("", _EDGES.sub("", piece)) or piece
    if body and body[-1:] in "!?.,;:":
        body = _EDGES.sub("", body)
    letters = sum(c.isalpha() for c in body)
    odd = sum(not c.isalpha() for c in body)
    if len(body) > 40 or letters + odd < 3 or not letters:
        return plain
    if odd and (odd <= 2 * letters) and any(c in LOOK_ALIKES or c in SEPARATORS for c in body) or _STRETCHED.search(body.lower()):
        word = decode(body, model)
        return [*plain, word] if word and word not in plain else plain
    return plain


def _key(word: str, kind: int = 0) -> int:
    return zlib.crc32(word.encode(), kind)


def feature_keys(word: str) -> list[int]:
    """Keys of a word and of its beginnings, from the most to the least specific."""
    return [_key(word), *[_key(word[:n], n) if len(word) > n else 0 for n in PREFIXES]]


class TextReader:
    """Splits UTF-8 texts into restored words, remembered by piece."""

    def __init__(self, model: CharModel, row_of: Callable, width: int, dtype):
        self._model, self._row_of = model, row_of
        self._first, self._count = Rows(None, np.int64), Rows(None, np.int64)
        self._rows = Rows(width, dtype)
        self._single = Rows(None, np.bool_)
        self._table = WordTable(self._grow, self._reset, PIECES_KEPT)

    def _reset(self) -> None:
        for rows in (self._first, self._count, self._rows, self._single):
            rows.clear()

    def _grow(self, fresh: list[bytes]) -> None:
        counts, rows, single = [], [], []
        for piece in fresh:
            text = piece.decode("utf-8", "replace")
            words = restored_words(text, self._model)
            counts.append(len(words))
            rows += [self._row_of(w) for w in words]
            single.append(len(text.strip(SEPARATORS)) == 1)
        counts = np.array(counts, np.int64)
        base = len(self._rows.view)
        self._first.extend(base + np.cumsum(counts) - counts)
        self._count.extend(counts)
        self._single.extend(np.array(single, np.bool_))
        if rows:
            self._rows.extend(np.array(rows))

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The rows of all words of a text."""
        pieces = text.split() if text else []
        if not pieces:
            return self._rows.view[:0]
        codes = self._table.codes(pieces)
        extra = self._spaced(pieces, self._single.view[codes])
        codes = np.unique(codes)
        counts = self._count.view[codes]
        ends = np.cumsum(counts)
        within = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
        rows = self._rows.view[np.repeat(self._first.view[codes], counts) + within]
        return np.concatenate([rows, np.array(extra, rows.dtype)]) if extra else rows

    def _spaced(self, pieces: list[bytes], single: np.ndarray) -> list:
        """Words of letters standing alone: runs of three or more pieces of one character."""
        if single.sum() < 3:
            return []
        steps = np.diff(np.r_[0, single.astype(np.int8), 0])
        rows = []
        for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1), strict=True):
            if 3 <= b - a <= 40:
                run = "".join(p.decode("utf-8", "replace").strip(SEPARATORS) for p in pieces[a:b])
                rows += [self._row_of(w) for w in {run.lower(), decode(run, self._model)}]
        return rows


def _trigram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()

    def rows() -> pa.RecordBatch:
        plain: Counter = Counter()
        for word, n in words.items():
            core = word.decode("utf-8", "replace").strip(_AROUND).lower()
            if core.isalpha():
                plain[core] += n
        words.clear()
        grams: dict[tuple[str, ...], int] = {}
        for word, n in plain.items():
            if not _STRETCHED.search(word):  # the model is one of plain writing
                for gram in zip("^^" + word, "^" + word + "$", word + "$", strict=False):
                    grams[gram] = grams.get(gram, 0) + n
        return pa.RecordBatch.from_arrays([pa.array(["".join(g) for g in grams], pa.string()),
                                           pa.array(grams.values(), pa.int64())], ["gram", "n"])

    for batch in batches:
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words.update(text.split() if text else ())
            if len(words) > _FLUSH:
                yield rows()
    if words:
        yield rows()


def train_chars(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Count letter trigrams of all texts. The result is bounded by the alphabets that occur."""
    counts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_trigram_batches, "gram string, n long")
    table = counts.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    grams: Counter = Counter()
    for gram, n in zip(table.column("gram").to_pylist(), table.column("n").to_pylist(), strict=True):
        for start in range(3):  # every trigram counts for its shorter endings too
            grams[gram[start:]] += n
    return CharModel(dict(grams))


def _evidence(weights: np.ndarray) -> np.ndarray:
    """What the curve looks at: the strongest evidence, the three strongest, and how much there is."""
    top = np.sort(weights)[::-1][:3]
    top = np.r_[top, np.zeros(3 - len(top))]
    return np.array([top[0], top.mean(), math.log1p((weights > 2).sum())])


def _weights(keys: np.ndarray, known: np.ndarray, weight: np.ndarray, support: np.ndarray, least: int) -> np.ndarray:
    """Evidence of words (rows of keys): that of the most specific key with enough support."""
    if not len(keys) or not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = (known[at] == keys) & (support[at] >= least) & (keys != 0)
    first = hit.argmax(axis=1)
    rows = np.arange(len(keys))
    return np.where(hit.any(axis=1), weight[at[rows, first]], 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps, to the gradient."""
    z = np.c_[np.ones(len(x)), x]
    beta = np.zeros(z.shape[1])
    penalty = np.r_[1e-6, np.full(x.shape[1], ridge)]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (y - p) - penalty * beta
        if np.abs(grad).max() < 1e-6 * len(y):
            break
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), grad)
        beta += step / max(1.0, np.abs(step).max() / 2)
    return beta


@dataclass
class ToxicityModel:
    chars: CharModel
    known: np.ndarray
    weight: np.ndarray
    support: np.ndarray
    least: int
    beta: np.ndarray
    name: str

    def __post_init__(self) -> None:
        keep = self.support >= self.least
        self.evidence = dict(zip(self.known[keep].tolist(), self.weight[keep].tolist(), strict=True))

    def word_row(self, word: str) -> tuple[float, float]:
        """The key of a word, and its evidence: that of the most specific key known."""
        first = _key(word)
        found = self.evidence.get(first)
        if found is None:
            found = next((e for n in PREFIXES if len(word) > n and (e := self.evidence.get(_key(word[:n], n))) is not None), 0.0)
        return first, found

    def score(self, rows: np.ndarray) -> float:
        if len(rows):
            rows = rows[rows[:, 1] > 0]
            rows = rows[np.unique(rows[:, 0], return_index=True)[1]]
        x = _evidence(rows[:, 1] if len(rows) else np.empty(0))
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.beta[0] + x @ self.beta[1:])))))


def train(docs: DataFrame, labels: DataFrame, chars: CharModel, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_texts: int = 25_000, least: int = 4, prior: float = 12.0) -> ToxicityModel:
    """Fit on labelled documents; the sample and all that is gathered from it is bounded by ``max_texts``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    total = marks.count()
    if total > max_texts:
        marks = marks.filter(F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(1 << 20)) < int((1 << 20) * max_texts / total))
    # At most about max_texts short rows are sent to the executors.
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(
        F.broadcast(marks), "id").withColumn("text_key", F.xxhash64("text"))
    load_chars, chars_name = share_value(spark, chars), uuid.uuid4().hex

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = process_cache(("toxicity words", chars_name),
                               lambda: TextReader(load_chars(), feature_keys, 1 + len(PREFIXES), np.int64))
        for batch in batches:
            keys = [np.unique(reader(t), axis=0).ravel() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key"), batch.column("y"), pa.array(keys, pa.list_(pa.int64()))], ["text_key", "y", "keys"])

    texts = rows.select("text_key", "y", "text").mapInArrow(read, "text_key long, y int, keys array<long>")
    # Copies of a text count once.
    texts = scratch.write(texts.groupBy(F.coalesce("text_key", F.lit(0)).alias("text_key")).agg(
        F.max("y").alias("y"), F.first("keys").alias("keys")), "texts")
    sizes = dict(texts.groupBy("y").count().collect())
    toxic, all_ = sizes.get(1, 0), sum(sizes.values())
    name = uuid.uuid4().hex
    none = np.empty(0)
    if not toxic or toxic == all_:
        share = toxic / all_ if all_ else 0.0
        logit = 30.0 if share == 1 else -30.0
        return ToxicityModel(chars, none.astype(np.int64), none, none, least, np.array([logit, 0, 0, 0]), name)
    seen = texts.select("y", F.explode(F.array_distinct("keys")).alias("key")).filter("key <> 0")
    found = seen.groupBy("key").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).filter(
        (F.col("t") > 0) & (F.col("n") >= least))
    # A beginning says something of its own only if several words of toxic texts share it.
    width = 1 + len(PREFIXES)
    words = texts.filter("y = 1").select(F.explode(F.sequence(F.lit(1), F.size("keys"), F.lit(width))).alias("_at"), "keys")
    words = words.filter("size(keys) > 0").select(F.slice("keys", F.col("_at"), width).alias("w")).distinct()
    begins = words.select(F.col("w")[0].alias("word"), F.explode(F.slice("w", 2, width - 1)).alias("key")).filter("key <> 0")
    several = begins.groupBy("key").agg(F.count(F.lit(1)).alias("_words"))
    table = found.join(several, "key", "left").filter("_words is null or _words >= 3").orderBy("key").toArrow()
    known = table.column("key").to_numpy().astype(np.int64)
    t, n = (table.column(c).to_numpy().astype(float) for c in ("t", "n"))
    base = toxic / all_
    p = (t + prior * base) / (n + prior)
    weight = np.maximum(np.log(p / (1 - p)) - math.log(base / (1 - base)), 0.0)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for keys in batch.column("keys").to_pylist():
                w = _weights(np.array(keys, np.int64).reshape(-1, 1 + len(PREFIXES)), known, weight, n, least)
                got.append(_evidence(w).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(got, pa.list_(pa.float64()))], ["y", "x"])

    sample = texts.select("y", "keys").mapInArrow(evidence, "y int, x array<double>").toArrow()
    x = np.array(sample.column("x").to_pylist(), float).reshape(-1, 3)
    beta = _logistic(x, sample.column("y").to_numpy().astype(float))
    return ToxicityModel(chars, known, weight, n, least, beta, name)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """The documents with their score. All columns stay; one that clashes with ``out`` is replaced."""
    load, name = share_value(docs.sparkSession, model), model.name
    given, (text_col,) = apart(docs, text_col)
    names = [(inner, c) for inner, c in zip(given.columns, docs.columns, strict=True) if c != out]
    others = [inner for inner, _ in names]
    source = given.select(*others, F.col(text_col).cast("string").alias("_text"))
    fields = [f"{c} {given.schema[c].dataType.simpleString()}" for c in others]

    def make() -> tuple[ToxicityModel, TextReader]:
        model = load()
        return model, TextReader(model.chars, model.word_row, 2, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = process_cache(("toxicity", name), make)
        for batch in pieces(batches):
            scores = [model.score(reader(t)) for t in batch.column("_text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(scores, pa.float64())], [*others, "_score"])

    return source.mapInArrow(run, ", ".join([*fields, "_score double"])).toDF(*[c for _, c in names], out)
