"""Token ids and token counts of whole texts with a public tokenizer file.

Tokenizers that drop white space give the same ids for a text as for its pieces between white space, one
after another. Arrow splits a batch and numbers its distinct pieces, so that Python looks at each of them once a
batch. Workers remember the ids of pieces, and of their letters without the punctuation around them, and
encode only what is new. Other tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import process_cache

# Pieces and cores that a Python worker remembers, some 140 bytes each: so many of late, and as many before them.
# What it has forgotten it encodes again, which costs time only.
KEPT = 300_000
TEXTS_AT_ONCE, BYTES_AT_ONCE = 1_000, 1 << 21
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII without the apostrophe, which joins contractions


class PieceEncoder:
    """Ids of each of some UTF-8 texts, for a tokenizer whose splits drop white space."""

    def __init__(self, tokenizer, lowers: bool, plain: bool):
        self._tokenizer = tokenizer
        self._lowers = lowers
        # A word of a-z is one split and no byte of it is mapped, so that the model alone gives its ids.
        self._model = tokenizer.model if plain else None
        special = [re.escape(t.content.encode()) for t in tokenizer.get_added_tokens_decoder().values()]
        self._has_special = re.compile(b"|".join(special)).search if special else lambda piece: None
        # Ids, as bytes of 32-bit numbers, of the pieces and cores of late, and of those before.
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _known(self, piece: bytes) -> bytes | None:
        ids = self._new.get(piece)
        if ids is None and (ids := self._old.get(piece)) is not None:
            self._new[piece] = ids
        return ids

    def _encode(self, pieces: list[bytes]) -> None:
        """Remember the ids of pieces that are new."""
        known, others = self._new, []
        for p in pieces:
            if self._model is not None and p.isalpha() and p.islower() and not self._has_special(p):
                known[p] = array("I", [t.id for t in self._model.tokenize(p.decode())]).tobytes()
            else:
                others.append(p)
        for at in range(0, len(others), 1_000):
            some = others[at : at + 1_000]
            texts = [p.decode("utf-8", "replace") for p in some]
            for p, e in zip(some, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                known[p] = array("I", e.ids).tobytes()

    def _grow(self, fresh: list[bytes]) -> None:
        # Letters with ASCII punctuation around them split exactly there; other pieces are encoded whole.
        splits, wanted = [], {}
        special = self._has_special(b" ".join(fresh))
        for piece in fresh:
            core = piece.strip(_PUNCTUATION)
            if core.isalpha():  # of ASCII letters
                word = core.lower() if self._lowers else core
            elif core and not core.isascii() and core.decode("utf-8", "replace").isalpha():
                word = core
            else:
                word = core = b""
            if not core or special and self._has_special(piece) or word == piece:
                wanted[piece] = None
                continue
            at = piece.find(core)
            splits.append((piece, piece[:at], word, piece[at + len(core):]))
            for part in splits[-1][1:]:
                if part and part not in wanted and self._known(part) is None:
                    wanted[part] = None
        self._encode(list(wanted))
        known = self._new
        known[b""] = b""
        for piece, before, word, after in splits:
            known[piece] = known[before] + known[word] + known[after]

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array([t or b"" for t in texts], pa.large_binary()).view(pa.large_string()))
        words = split.flatten().view(pa.large_binary()).dictionary_encode()
        if not len(words):
            return [np.empty(0, np.uint32) for _ in texts]
        if len(self._new) > KEPT:
            self._new, self._old = {}, self._new
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        held = list(map(self._new.get, distinct))
        fresh = [w for w, ids in zip(distinct, held, strict=True) if ids is None and self._known(w) is None]
        if fresh:
            self._grow(fresh)
        held = [self._new[w] if ids is None else ids for w, ids in zip(distinct, held, strict=True)]
        length = np.fromiter(map(len, held), np.int64, len(held)) // 4
        start = np.cumsum(length) - length
        codes = words.indices.to_numpy()
        counts = length[codes]
        ends = np.cumsum(counts)
        ids = np.frombuffer(b"".join(held), np.uint32)[np.repeat(start[codes] - (ends - counts), counts) + np.arange(ends[-1])]
        return np.split(ids, np.r_[0, ends][split.offsets.to_numpy()[1:]])[:-1]


def text_batches(batches, rows: int = TEXTS_AT_ONCE, size: int = BYTES_AT_ONCE):
    """Arrow batches in parts of at most ``rows`` texts that begin within ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // size
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for start, stop in zip(first, np.r_[first[1:], len(part)], strict=True):
            for at in range(start, stop, rows):
                yield batch.slice(at, min(rows, stop - at))


def _steps(path: str, part: str) -> list[dict]:
    """The steps of the ``normalizer`` or ``pre_tokenizer`` in the tokenizer's own description."""
    def steps(node) -> list[dict]:
        node = node or {}
        inner = node.get("pretokenizers", []) + node.get("normalizers", [])
        return [node, *[p for child in inner for p in steps(child)]]

    with open(path, encoding="utf-8") as f:
        return steps(json.load(f).get(part))


def _drops_white_space(path: str) -> bool:
    """Whether the tokenizer's own description says that its pieces never hold white space."""
    return any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert")
               and p.get("pattern", {}).get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+") for p in _steps(path, "pre_tokenizer"))


def _lowers(path: str) -> bool:
    return any(p.get("type") == "Lowercase" for p in _steps(path, "normalizer"))


def _plain(path: str) -> bool:
    """Whether words of a-z reach the model as they are: no step but those known to leave them whole and alone."""
    normal = [p for p in _steps(path, "normalizer") if p and p.get("type") != "Sequence"]
    split = [p for p in _steps(path, "pre_tokenizer") if p.get("type") != "Sequence"]
    return (all(p["type"] in ("NFC", "Lowercase") or p["type"] == "Replace" and p["pattern"] == {"Regex": r"\s+"} for p in normal)
            and all(p["type"] == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex", True)
                    or p["type"] == "Split" and r"|[\p{L}]+|" in p["pattern"].get("Regex", "") for p in split))


def encoder(path: str) -> Callable[[list[bytes | None]], list[np.ndarray]]:
    """The encoder of a tokenizer file, kept for the life of the Python worker."""
    def make() -> Callable[[list[bytes | None]], list[np.ndarray]]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def whole(texts: list[bytes | None]) -> list[np.ndarray]:
            plain = [(t or b"").decode("utf-8", "replace") for t in texts]
            return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(plain, add_special_tokens=False)]

        if not _drops_white_space(path):
            return whole
        return PieceEncoder(tokenizer, _lowers(path), _plain(path))

    return process_cache(("encoder", path), make)
