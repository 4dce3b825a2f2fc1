"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
by the forward algorithm a[e] = sum over l of a[e - l] * p(piece of length l
that ends at e); a text's is the product over its words. The probabilities are
learned from expected counts: each piece of each segmentation of a word counts
with the segmentation's share, by forward and backward passes, all pieces being
equally likely at first.

The passes run over all new words of a block at once; states are rescaled as
they go, so words have no greatest length. Words seen before are remembered.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_blocks

#: Words a worker remembers before it starts anew (none longer than LONG code points), and words it gathers before it counts their pieces.
MEMO_WORDS, LONG, GATHER_WORDS = 250_000, 100, 150_000
#: Words and code points that one pass takes together (a longer word is a pass of its own); steps after which states are rescaled.
PASS_WORDS, PASS_CHARS, STRIDE = 20_000, 1 << 18, 16
#: Probability of a code point that no piece covers, in every language; added to each piece's count.
UNSEEN, ADDED = 1e-8, 0.05

_B, _SHIFT = np.uint64(0x9E3779B97F4A7C55), np.uint64(44)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _class(kinds: str, which: Callable[[int], bool] = lambda c: True) -> str:
    """A regular expression's class of all code points whose category starts with one of the letters."""
    points = [c for c in range(0x40000) if unicodedata.category(chr(c))[0] in kinds and which(c)]
    starts = [c for k, c in enumerate(points) if not k or points[k - 1] != c - 1]
    ends = [c for k, c in enumerate(points) if k + 1 == len(points) or points[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, ...]:
    """Words as a letter, then letters, combining marks and joiners; the same for texts without numerals that count as word characters; these numerals; what a piece can be of a word."""
    marks = f"{_class('M')}\\u200c\\u200d"
    numerals = _class("N", lambda c: not chr(c).isdecimal())
    return re.compile(f"[{_class('L')}][{_class('L')}{marks}]*"), re.compile(rf"[^\W\d_]+(?:[{marks}]+[^\W\d_]*)*"), re.compile(f"[{numerals}]"), re.compile(f"▁?[{_class('L')}{marks}]*")


_ASCII, _LATIN = re.compile("[a-z]+"), re.compile("[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+")


def letters(text: str | None) -> list[str]:
    """The runs of letters, with their marks, of a text, in lower case."""
    if not text:
        return []
    low = text.lower()
    if low.isascii():
        return _ASCII.findall(low)
    try:
        low.encode("latin-1")
        return _LATIN.findall(low)
    except UnicodeEncodeError:
        exact, quick, numerals, _ = _patterns()
        return (exact if numerals.search(low) else quick).findall(low)


@lru_cache(2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Vocabulary:
    """The pieces that words can hold, as hashes sorted by length of piece."""

    def __init__(self, path: str):
        pieces, tables = _pieces(path), {}
        self.size = pieces.get_piece_size()
        for k in range(self.size):
            text = pieces.id_to_piece(k)
            if not (pieces.is_control(k) or pieces.is_unknown(k) or pieces.is_byte(k)) and _patterns()[3].fullmatch(text):
                tables.setdefault(len(text), []).append((self._hash(text), k))
        self.tables = {n: (np.array([h for h, _ in sorted(t)], np.uint64), np.array([k for _, k in sorted(t)], np.int32)) for n, t in tables.items()}
        self.flags = np.zeros(1 << 20, bool)  # which leading bits some piece has: most stretches are no piece
        for keys, _ in self.tables.values():
            self.flags[keys >> _SHIFT] = True
        self.longest = max(self.tables, default=1)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_B) + ord(c) + 1) & ((1 << 64) - 1)
        return h

    def batches(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Spans of words that a pass takes together."""
        lo = total = 0
        for hi, word in enumerate(words):
            if hi > lo and (hi - lo >= PASS_WORDS or total + len(word) > PASS_CHARS):
                yield lo, hi
                lo, total = hi, 0
            total += len(word)
        if lo < len(words):
            yield lo, len(words)

    def lattice(self, words: list[str]) -> Lattice:
        return Lattice(self, words)


@lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """All segmentations of some words: an edge for each piece at each place where it fits.

    A word has one state more than code points (with the mark of a word's start).
    States hold value and logarithm of scale, so that nothing under- or overflows.
    """

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        marked = ["▁" + w for w in words]
        self.longest = vocabulary.longest
        self.size = np.fromiter(map(len, marked), np.int64, len(marked))
        flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.before = np.arange(len(flat)) - start[self.word]  # code points of the word before this one
        left = self.size[self.word] - self.before
        places, lengths, pieces_, hashes = [], [], [], flat
        for n in range(1, self.longest + 1):
            if n > 1:
                hashes = hashes[: max(len(flat) - n + 1, 0)] * _B + flat[n - 1 :]
            if n in vocabulary.tables and len(hashes):
                keys, pieces = vocabulary.tables[n]
                may = np.flatnonzero((left[: len(hashes)] >= n) & vocabulary.flags[hashes >> _SHIFT])
                at = np.minimum(np.searchsorted(keys, hashes[may]), len(keys) - 1)
                same = keys[at] == hashes[may]
                places.append(may[same])
                lengths.append(np.full(int(same.sum()), n))
                pieces_.append(pieces[at[same]])
        self.place, length, self.piece = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, lengths, pieces_))
        self.piece = self.piece.astype(np.int64)
        self.tail = self.place + self.word[self.place]  # the states that an edge joins
        self.head = self.tail + length
        self.base = start + np.arange(len(words))
        self.order = np.argsort(-self.size, kind="stable")
        self.upto = np.searchsorted(-self.size[self.order], -np.arange(1, int(self.size.max(initial=0)) + 1), side="right")

    def _sweep(self, probs: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """Values and scales of all states, from the words' starts, or from their ends: in each step all edges that reach its states."""
        value = np.zeros((int((self.size + 1).sum()), probs.shape[1]))
        scale = np.zeros_like(value)
        sign = -1 if back else 1
        source, target = (self.head, self.tail) if back else (self.tail, self.head)
        done = self.before[self.place]
        when = self.size[self.word[self.place]] - done if back else done + self.head - self.tail
        by = np.lexsort((target, when))
        source, target, piece = source[by], target[by], self.piece[by]
        opens = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
        steps = np.searchsorted(when[by], np.arange(1, len(self.upto) + 2))
        first = np.searchsorted(opens, steps)
        origin = self.base + (self.size if back else 0)
        value[origin] = 1.0
        for step in range(1, len(self.upto) + 1):
            here = origin[self.order[: self.upto[step - 1]]] + sign * step
            value[here] = value[here - sign] * UNSEEN
            lo, hi = steps[step - 1], steps[step]
            if hi > lo:
                starts = opens[first[step - 1] : first[step]]
                value[target[starts]] += np.add.reduceat(value[source[lo:hi]] * probs[piece[lo:hi]], starts - lo)
            if step > STRIDE:
                scale[here] = scale[here - sign]
            if step % STRIDE == 0:
                total = value[here]
                for n in range(min(step, self.longest) + 1):
                    value[here - sign * n] /= total
                    scale[here - sign * n] += np.log(total)
        return value, scale

    def logs(self, probs: np.ndarray) -> np.ndarray:
        """Log-probability of each word by column of the probabilities, summed over all its segmentations."""
        value, scale = self._sweep(probs, False)
        end = self.base + self.size
        return np.log(value[end]) + scale[end]

    def expected(self, probs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each word as often as `times` says."""
        (ahead, up), (behind, down) = self._sweep(probs[:, None], False), self._sweep(probs[:, None], True)
        end, word = self.base + self.size, self.word[self.place]
        whole = np.log(ahead[end, 0]) + up[end, 0]
        share = ahead[self.tail, 0] * probs[self.piece] * behind[self.head, 0] * np.exp(up[self.tail, 0] + down[self.head, 0] - whole[word])
        return np.bincount(self.piece, share * times[word], len(probs))


def learn(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None) -> Model:
    """Expected piece counts by language over all documents outside the held-out fold (crc32 of the id modulo 3 is not 1).

    Workers count words, then expect pieces of the distinct words; what reaches the
    driver is one row for each language and piece, bounded by the vocabulary.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        even = np.full(vocabulary.size, 1.0 / vocabulary.size)
        words: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def settle() -> None:
            for lang, counter in words.items():
                total, some = sums.setdefault(lang, np.zeros(vocabulary.size)), list(counter)
                for lo, hi in vocabulary.batches(some):
                    total += vocabulary.lattice(some[lo:hi]).expected(even, np.array([counter[w] for w in some[lo:hi]], float))
            words.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi in text_blocks(batch, "text"):
                for lang, text in zip(langs[lo:hi], batch.column("text").slice(lo, hi - lo).to_pylist()):
                    words.setdefault(lang, Counter()).update(letters(text))
                if sum(map(len, words.values())) > GATHER_WORDS:
                    settle()
        settle()
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "piece", "n"])

    rows = documents.where(F.col(lang_col).isNotNull() & (crc_mod(id_col, 3) != 1)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    return Model.of(found, path)


@dataclass
class Model:
    """Piece probabilities by language."""

    langs: list[str]
    probs: np.ndarray
    path: str

    @classmethod
    def of(cls, found: pa.Table, path: str) -> Model:
        lang = np.array(found.column("lang").to_pylist(), object)
        piece, n = found.column("piece").to_numpy(), found.column("n").to_numpy()
        langs, size = sorted(set(lang.tolist())), _vocabulary(path).size
        counts = np.zeros((size, len(langs)))
        for k, name in enumerate(langs):
            counts[piece[lang == name], k] = np.round(n[lang == name], 6)  # sums differ in their last bits from run to run
        return cls(langs, (counts + ADDED) / (counts.sum(axis=0) + ADDED * size), path)

    def scorer(self) -> Scorer:
        """A worker's scorer for this model, with the words that it remembers from other tasks."""
        key = self.path, tuple(self.langs), hashlib.blake2b(self.probs.tobytes()).hexdigest()
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(self)
        return _scorers[key]


_scorers: dict[tuple, Scorer] = {}


class Scorer:
    def __init__(self, model: Model):
        self.probs, self.vocabulary = model.probs, _vocabulary(model.path)
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)))

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word by language."""
        found = [self.vocabulary.lattice(words[lo:hi]).logs(self.probs) for lo, hi in self.vocabulary.batches(words)]
        return np.concatenate([np.zeros((0, self.probs.shape[1])), *found])

    def text(self, words: list[str]) -> np.ndarray:
        """Log-probability of the words together."""
        try:
            at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        except KeyError:
            long = [w for w in words if len(w) > LONG]
            words = [w for w in words if len(w) <= LONG] if long else words
            new = [w for w in dict.fromkeys(words) if w not in self.memo]
            if len(self.memo) + len(new) > MEMO_WORDS:
                self.memo.clear()
                self.rows, new = self.rows[:0], list(dict.fromkeys(words))
            self.add(new)
            at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
            return self.rows[at].sum(axis=0) + self.words(long).sum(axis=0)
        return self.rows[at].sum(axis=0)

    def add(self, new: list[str]) -> None:
        n = len(self.memo)
        self.memo.update((w, n + k) for k, w in enumerate(new))
        if n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows[:n], np.zeros((max(n, len(new), 4096), self.rows.shape[1]))])
        self.rows[n : n + len(new)] = self.words(new)

    def learn_block(self, texts: list[list[str]]) -> None:
        """Remember the new words of many texts together: one forward pass for all of them."""
        new = list({w for words in texts for w in words if w not in self.memo and len(w) <= LONG})
        if len(self.memo) + len(new) <= MEMO_WORDS:
            self.add(sorted(new))


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every row.

    The score is the best language's share of the likelihood (equal priors).
    Null texts and texts without a letter are `und` with score 0, as are all
    rows where nothing could be learned; ties go to the first language by code
    point. Repeated rows each get their result; other columns are ignored.
    Texts are read whole, words of any length too.
    """
    langs = model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for lo, hi in text_blocks(batch, "text", 1 << 19):
                part, preds, scores = batch.slice(lo, hi - lo), [], []
                block = [letters(t) for t in part.column("text").to_pylist()]
                scorer.learn_block(block)
                for words in block:
                    if not words or not langs:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    logs = scorer.text(words)
                    best = int(logs.argmax())
                    preds.append(langs[best])
                    scores.append(float(1 / np.exp(logs - logs[best]).sum()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def classify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row, by what the other fold teaches."""
    made = identify(documents, learn(documents, id_col, text_col, lang_col), id_col, text_col)
    return made.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
