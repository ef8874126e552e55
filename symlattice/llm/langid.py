"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words, and the score is
the language's share among all languages, equal priors.

The probabilities are counted on at most ``per_lang`` documents of each
language, by the hash of their id, from the vocabulary's own segmentations,
with add-half smoothing. Words are runs of letters, lower-cased, with the
vocabulary's word mark in front; pieces with capitals can't occur in them and
are left out (7,978 of the 32,000 in piece_bpe_32k.model). A text that is null or has no letter is
``und`` with score 0, and so is any text if no language was learnt.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.llm.learning import first_by_hash, remainder
from symlattice.session import checkpoint, slim

PER_LANG = 3_000
LONGEST = 16
#: Words that a task remembers, bytes of their table, and characters of text whose words are learnt together.
REMEMBERED, TABLE_BYTES, TOGETHER = 400_000, 32 << 20, 1 << 20
_WORDS = re.compile(r"[^\W\d_]+")
_MARK = "▁"
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(LONGEST + 1)], dtype=np.uint64)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the prefixes of words of one length, a row each."""
    out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _POWERS[1] + codes[:, j]
    return out


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray
    lens: np.ndarray
    probs: np.ndarray
    unknown: float
    slot: dict[str, int] = field(default_factory=dict)
    logs: np.ndarray | None = None

    def word_logs(self, words: list[str]) -> np.ndarray:
        """log P(word | language), a row each."""
        out = np.zeros((len(words), len(self.langs)))
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_len.setdefault(len(w), []).append(i)
        for n, members in by_len.items():
            step = max(1, (1 << 18) // (n + 1))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                out[part] = self._forward([_MARK + words[i] for i in part])
        return out

    def _forward(self, words: list[str]) -> np.ndarray:
        prefix = _prefixes(_codes(words))
        n = prefix.shape[1] - 1
        alpha = np.zeros((n + 1, len(words), len(self.langs)))
        alpha[0] = 1
        scale = np.zeros((len(words), len(self.langs)))
        for j in range(1, n + 1):
            now = alpha[j - 1] * self.unknown
            for k in range(1, min(LONGEST, j) + 1):
                key = prefix[:, j] - prefix[:, j - k] * _POWERS[k]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero((self.keys[at] == key) & (self.lens[at] == k))
                now[hit] += alpha[j - k, hit] * self.probs[at[hit]]
            alpha[j] = now
            if j % 8 == 0:  # keep the window of sums in range
                top = now.copy()
                scale += np.log(top)
                alpha[max(0, j - LONGEST) : j + 1] /= top
        return np.log(alpha[n]) + scale

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share) of each text. The words of some texts are learnt together, so that the forward passes run on long arrays."""
        out, held, size = [], [], 0
        for t in texts:
            held.append((t or "").lower())
            size += len(held[-1])
            if size >= TOGETHER:
                out += self._together(held)
                held, size = [], 0
        return out + self._together(held)

    def text(self, text: str | None) -> tuple[str, float]:
        return self.texts([text])[0]

    def _together(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        total, real, owner, words = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=bool), [], []
        for i, t in enumerate(texts):
            for at in _parts(t):
                found = _WORDS.findall(t, *at)
                owner.append((i, len(found)))
                words += found
                if len(words) >= self.room() // 4:
                    self._add(words, owner, total, real)
                    owner, words = [], []
        self._add(words, owner, total, real)
        for row, known in zip(total, real, strict=True):
            share = np.exp(row - row.max())
            best = int(share.argmax())
            out.append((self.langs[best], float(share[best] / share.sum())) if known else ("und", 0.0))
        return out

    def _add(self, words: list[str], owner: list[tuple[int, int]], total: np.ndarray, real: np.ndarray) -> None:
        """Add the words' logs to the totals of their texts; owner has (text, number of words) in order."""
        if not words:
            return
        new = set(words).difference(self.slot)
        if len(self.slot) + len(new) > self.room():
            self.slot, new = {}, set(words)
        if new:
            self.learn(sorted(new))
        slots = np.fromiter(map(self.slot.__getitem__, words), dtype=np.int64, count=len(words))
        text = np.repeat(*(np.array(x, dtype=np.int64) for x in zip(*owner, strict=True)))
        text, slots = text[slots >= 0], slots[slots >= 0]
        real[text] = True
        for k in range(len(self.langs)):
            total[:, k] += np.bincount(text, self.logs[slots, k], len(total))

    def room(self) -> int:
        """Words that are remembered: a bounded table, however many languages there are."""
        return max(4_000, min(REMEMBERED, TABLE_BYTES // (8 * len(self.langs))))

    def learn(self, words: list[str]) -> None:
        if self.logs is None:
            self.logs = np.zeros((self.room(), len(self.langs)))
        known = [w for w in words if any(map(str.isalpha, w))]
        first = len(self.slot)
        self.slot.update(zip(words, range(-1 - first, -1 - first - len(words), -1), strict=True))
        if known:
            at = np.array([-1 - self.slot[w] for w in known])
            self.logs[at] = self.word_logs(known)
            self.slot.update(zip(known, at.tolist(), strict=True))


def _parts(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of parts of a text of some TOGETHER characters each, cut between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + TOGETHER)
        while end < len(text) and _WORDS.match(text, end):
            end = _WORDS.match(text, end).end()
        yield at, end
        at = end


def _pieces(path: str) -> tuple[list[str], object]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())], sp


def fit(documents: DataFrame, path: str, per_lang: int = PER_LANG) -> Model:
    """documents: doc_id, text, lang."""
    known = documents.filter(F.col("lang").isNotNull() & (remainder("doc_id") != 1))
    sample = checkpoint(first_by_hash(known.select("doc_id", F.col("lang").alias("__lang")).distinct(), "doc_id", "__lang", per_lang))
    rows = known.join(slim(sample.select("doc_id").distinct()), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, sp = _pieces(path)
        for b in batches:
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by_lang.setdefault(lang, Counter()).update(_WORDS.findall((text or "").lower()))
            for lang, words in by_lang.items():
                pieces: Counter = Counter()
                for (_, times), ids in zip(words.items(), sp.encode(list(words)), strict=True):
                    for i in ids:
                        pieces[i] += times
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pieces), pa.string()), pa.array(list(pieces), pa.int32()), pa.array(list(pieces.values()), pa.int64())], names=["lang", "piece", "n"])

    # at most the vocabulary's size for each language
    found = rows.mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in found})
    pieces, _ = _pieces(path)
    counts = np.full((len(pieces), len(langs)), 0.5)
    for r in found:
        counts[r["piece"], langs.index(r["lang"])] += r["n"]
    use = [i for i, p in enumerate(pieces) if 0 < len(p) <= LONGEST and p == p.lower() and not p.startswith("<")]
    probs = counts[use] / counts[use].sum(axis=0) if langs else counts[use]
    keys = np.array([int(_prefixes(_codes([pieces[i]]))[0, -1]) for i in use], dtype=np.uint64)
    order = np.argsort(keys)
    return Model(langs, keys[order], np.array([len(pieces[i]) for i in use])[order], probs[order], 1e-9)


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = model.texts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["id", "lang_pred", "score"])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, "id long, lang_pred string, score double")
