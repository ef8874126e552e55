"""BPE encoding and decoding with a public word-end vocabulary.

A word's merges are found on a segment tree over the ranks of its adjacent
pairs: the root holds the lowest rank and, among equals, the leftmost place; a
merge changes three leaves, each in logarithmic time, until no pair is
mergeable. Trees of many distinct words are advanced in lockstep as numpy arrays.

The vocabulary file is parsed once, on the driver; tasks get its tables as arrays of
some megabytes. A parsed file would leave every Python worker over a hundred.

Words that a task has met are looked up by their white-space delimited form,
in a table of bounded size. Null texts count as empty; an empty text has no ids
and decodes to the empty text. Other columns pass through untouched.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: White space in Unicode; str.split() also takes the information separators 1C to 1F.
_SPACES = regex.compile(r"\p{White_Space}+")
_ODD = re.compile("[\x1c-\x1f]")
#: Distinct forms that a task remembers, and cells of the trees advanced together.
REMEMBERED = 250_000
CELLS = 1 << 18
NONE = np.int64(2**62)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Tables of one vocabulary file, as arrays."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shapes = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._compile()
        chars = _byte_chars()
        self.first = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        strings = [(tokens.get(i, "") + " ").encode() for i in range(max(tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.token_lens = np.array([len(s) for s in strings], dtype=np.int64)
        self.token_at = np.cumsum(self.token_lens) - self.token_lens

    def _compile(self) -> None:
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words = regex.compile(self.shapes + "|\n")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, a word being one pre-token's bytes."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                by_size.setdefault(max(0, len(w) - 2).bit_length(), []).append(i)
        for bits, members in by_size.items():
            step = max(1, CELLS >> bits)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._merge([words[i] for i in part], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], leaves: int) -> list[np.ndarray]:
        """Words with at most ``leaves`` adjacent pairs. tree[:, 1] is the root, leaf j is pair (j, next of j); keys are rank * leaves + place."""
        n, width = len(words), leaves + 1
        lens = np.array([len(w) for w in words], dtype=np.int64)
        inside = np.arange(width)[None, :] < lens[:, None]
        sym = np.full((n, width + 1), -1, dtype=np.int64)
        sym[:, :width][inside] = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        every = np.arange(n)
        sym[every, lens - 1] = self.last[[w[-1] for w in words]]
        tree = np.full((n, 2 * leaves), NONE, dtype=np.int64)
        paired = inside[:, 1:]
        rank = self.ranks(sym[:, :leaves][paired], sym[:, 1:width][paired])
        place = np.broadcast_to(np.arange(leaves), (n, leaves))[paired]
        tree[:, leaves:][paired] = np.where(rank == NONE, NONE, rank * leaves + place)
        half = leaves
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2
        nxt = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        nxt[every, lens - 1] = width  # column ``width`` stands for "none"
        prv = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()

        def put(rows, places, keys):
            at = places + leaves
            tree[rows, at] = keys
            while at.size and at[0] > 1:  # every leaf is equally deep
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while rows.size:
            root = tree[rows, 1]
            at = root % leaves
            right = nxt[rows, at]
            after = nxt[rows, right]
            sym[rows, at] = self.merged[root // leaves]
            sym[rows, right] = -1
            nxt[rows, at] = after
            prv[rows, after] = at
            gone = right < leaves
            put(rows[gone], right[gone], NONE)
            for a, b, ok in ((at, after, after < width), (prv[rows, at], at, prv[rows, at] >= 0)):
                ok_rows, left = rows[ok], a[ok]
                rank = self.ranks(sym[ok_rows, left], sym[ok_rows, b[ok]])
                put(ok_rows, left, np.where(rank == NONE, NONE, rank * leaves + left))
            ended = after >= width
            put(rows[ended & (at < leaves)], at[ended & (at < leaves)], NONE)
            rows = rows[tree[rows, 1] < NONE]
        alive = sym[:, :width] >= 0
        return np.split(sym[:, :width][alive], np.cumsum(alive.sum(axis=1))[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """Each token's string and a space after it."""
        out = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at : at + (1 << 18)]
            lens = self.token_lens[part]
            start = np.cumsum(lens) - lens
            out.append(self.token_bytes[np.repeat(self.token_at[part] - start, lens) + np.arange(int(lens.sum()))].tobytes())
        return b"".join(out)

    def __getstate__(self) -> dict:
        """Patterns are compiled where they are used."""
        return {k: v for k, v in self.__dict__.items() if k not in ("special_re", "words")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._compile()


class Encoder:
    """A task's encoder, with the forms that it remembers."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self):
        self.slot: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.at, self.len = np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, np.int64)

    @staticmethod
    def forms(text: str) -> list[str]:
        return [x for x in _SPACES.split(text) if x] if _ODD.search(text) else text.split()

    def learn(self, forms: list[str]) -> None:
        """Encode forms that aren't remembered."""
        v = self.vocab
        pieces: list[tuple[int, str | int]] = []  # (form, special id or text)
        for i, form in enumerate(forms):
            for part in v.special_re.split(form) if "<|" in form else (form,):
                if part:
                    pieces.append((i, v.special.get(part, part)))
        plain = [p for _, p in pieces if isinstance(p, str)]
        joined = "\n".join(p if p.isascii() else unicodedata.normalize("NFC", p).replace("Σ", "σ") for p in plain).lower()
        words, of = [], []
        at = 0
        order = [k for k, (_, p) in enumerate(pieces) if isinstance(p, str)]
        for w in v.words.findall(joined):
            if w == "\n":
                at += 1
            else:
                words.append(w.encode())
                of.append(at)
        distinct = list(dict.fromkeys(words))
        ids = dict(zip(distinct, v.encode_words(distinct), strict=True))
        parts: list[list[np.ndarray]] = [[] for _ in pieces]
        for w, p in zip(words, of, strict=True):
            parts[order[p]].append(ids[w])
        for k, (_, p) in enumerate(pieces):
            if isinstance(p, int):
                parts[k].append(np.array([p]))
        by_form: list[list[np.ndarray]] = [[] for _ in forms]
        for (i, _), part in zip(pieces, parts, strict=True):
            by_form[i].extend(part)
        lens = np.array([sum(map(len, x)) for x in by_form], dtype=np.int64)
        new = np.concatenate([y for x in by_form for y in x] or [np.zeros(0, np.int64)]).astype(np.int32)
        first, k = len(self.slot), len(forms)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        self.len[first : first + k] = lens
        self.at[first : first + k] = self.used + np.cumsum(lens) - lens
        self.used += len(new)
        self.slot.update(zip(forms, range(first, first + k), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        forms = [self.forms(t) for t in texts]
        counts = np.array([len(x) for x in forms], dtype=np.int64)
        every = [x for y in forms for x in y]
        del forms
        out, per = [], []
        for at in range(0, len(every), REMEMBERED // 4):
            part = every[at : at + REMEMBERED // 4]
            new = [x for x in dict.fromkeys(part) if x not in self.slot]
            if new and len(self.slot) + len(new) > REMEMBERED:
                self._forget()
                new = list(dict.fromkeys(part))
            if new:
                self.learn(new)
            slots = np.fromiter(map(self.slot.__getitem__, part), dtype=np.int64, count=len(part))
            lens = self.len[slots]
            start = np.cumsum(lens) - lens
            out.append(self.flat[np.repeat(self.at[slots] - start, lens) + np.arange(int(lens.sum()))])
            per.append(lens)
        ids, lens = np.concatenate(out or [np.zeros(0, np.int32)]), np.concatenate(per or [np.zeros(0, np.int64)])
        upto = np.concatenate([[0], np.cumsum(lens)])
        ends = np.cumsum(counts)
        return ids, upto[ends] - upto[ends - counts]


@lru_cache(maxsize=1)
def _encoder(shared) -> Encoder:
    return Encoder(shared.value)


def _groups(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` in all, one row at least."""
    at = 0
    upto = np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def _texts(vocab: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    raw = vocab.decode(ids)
    upto = np.concatenate([[0], np.cumsum(vocab.token_lens[ids])])
    last = np.cumsum(counts)
    return pa.array([raw[a : max(a, b - 1)].decode() for a, b in zip(upto[last - counts].tolist(), upto[last].tolist(), strict=True)], pa.string())


class Bpe:
    """Columns of ids and of decoded text; the file's tables travel to the tasks once, as a broadcast of fixed size."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            self.shared = spark.sparkContext.broadcast(Vocabulary(f.read()))

    def encode(self, text: Column) -> Column:
        shared = self.shared

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = _encoder(shared)
            for texts in batches:
                for a, b in _groups(_sizes(texts)):
                    yield _lists(*encoder.encode(texts[a:b].to_pylist()))

        return run(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        shared = self.shared

        @F.arrow_udf("string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            vocab = shared.value
            for lists in batches:
                counts = np.diff(np.asarray(lists.offsets, dtype=np.int64))
                flat, at = lists.flatten(), 0
                for a, b in _groups(counts, 1 << 19):
                    n = int(counts[a:b].sum())
                    yield _texts(vocab, np.asarray(flat[at : at + n], dtype=np.int64), counts[a:b])
                    at += n

        return run(ids)

    def both(self, text: Column) -> Column:
        """A struct of the ids and the text that they decode to, by one Python worker for a task instead of two."""
        shared = self.shared

        @F.arrow_udf("ids array<int>, decoded string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = _encoder(shared)
            for texts in batches:
                for a, b in _groups(_sizes(texts)):
                    ids, counts = encoder.encode(texts[a:b].to_pylist())
                    yield pa.StructArray.from_arrays([_lists(ids, counts), _decoded(encoder.vocab, ids, counts)], names=["ids", "decoded"])

        return run(F.coalesce(text, F.lit("")))


def _decoded(vocab: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The texts of all ids, some tokens at a time."""
    out, at = [], 0
    for a, b in _groups(counts, 1 << 17):
        n = int(counts[a:b].sum())
        out.append(_texts(vocab, ids[at : at + n].astype(np.int64), counts[a:b]))
        at += n
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def _sizes(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
