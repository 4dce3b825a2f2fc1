"""Benchmark decontamination.

Words are lower case without punctuation; in scripts without spaces every
character is a word. At every place of a text stands a window the size of an
item; the CGK random walk embeds windows and items so that few edits become few
differing places; tables keyed by sampled places of several walks give
candidates, and a semi-global edit distance verifies each. Longer items take
more walks, and still longer ones are embedded in pieces: one of them has at
most its share of the edits, and the whole item is verified around it.

Before they are embedded, windows that cannot be within the allowed edits are
passed over: d edits of n words leave at least n - 1 - 2d of the item's word
pairs in place, so a window with fewer pairs of items of that size is no match. Items of
few words allow no edit and are found by the hash of all their words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, by_size, mix, text_blocks, text_bytes, text_spans, word_hashes

#: Edits allowed by word of an item; an item of fewer words than FUZZY allows none.
EDIT_RATE, FUZZY = 0.2, 8
#: Tables by walk, places by table, and how many walks a window of n words takes: see test_decontaminate for the recall that they reach.
TABLES, PLACES = 4, 3
#: Words of an item that is embedded whole; longer ones are cut into equal pieces.
PIECE_WORDS = 60
#: Items handled in one pass over the documents; more of them take more passes.
ITEMS_A_PASS = 20_000
_FLAGS = 1 << 21
_PAD = np.uint64(0x5851F42D4C957F2D)
_M1 = np.uint64(0xBF58476D1CE4E5B9)


def walks(n: int) -> int:
    return 12 if n <= 24 else 24 if n <= 40 else 36


# ---------------------------------------------------------------- words


#: Bytes that separate words here: everything of ASCII but letters and digits. Case is lowered before.
SEPARATES = np.zeros(256, bool)
SEPARATES[:128] = True
SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

#: Blocks of code points of scripts written without spaces.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3040, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

_kinds: np.ndarray | None = None


def _kind(points: np.ndarray) -> np.ndarray:
    """1 for punctuation, symbols and separators, 2 for characters that are words of their own, 0 for the rest."""
    global _kinds
    if _kinds is None:
        _kinds = np.array([unicodedata.category(chr(c))[0] in "PSZ" for c in range(0x20000)]).astype(np.int8)
        for lo, hi in UNSPACED:
            part = _kinds[lo : hi + 1]
            part[part == 0] = 2
    return np.where(points < len(_kinds), _kinds[np.minimum(points, len(_kinds) - 1)], 2 * (points < 0x40000)).astype(np.int8)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and each row's offset into them."""
    lead = np.flatnonzero(raw >= 0xC2)
    if not len(lead):
        return word_hashes(raw, offsets, SEPARATES)
    b = raw[lead].astype(np.int64)
    size = 2 + (b >= 0xE0) + (b >= 0xF0)
    points = b & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
    for k in (1, 2, 3):
        more = size > k
        points[more] = points[more] << 6 | raw[lead[more] + k] & 0x3F
    kind = _kind(points)
    spread = lambda which: np.repeat(lead[which], size[which]) + np.arange(size[which].sum()) - np.repeat(np.cumsum(size[which]) - size[which], size[which])
    ends = (lead + size)[kind == 2]
    return word_hashes(raw, offsets, SEPARATES, spread(kind == 1), np.concatenate([lead[kind == 2], ends[ends < len(raw)]]))


def edits_allowed(n: int) -> int:
    return int(EDIT_RATE * n + 1e-9) if n >= FUZZY else 0


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any stretch of the text, and where the first best stretch ends."""
    row = np.zeros(len(text) + 1, np.int64)
    place = np.arange(len(text) + 1)
    for k, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
    return int(row.min()), int(row.argmin())


# ---------------------------------------------------------------- embedding


@dataclass
class Plan:
    """For each walk a seed for each step; at each step, which tables of which walks sample it. Steps end where windows do, nearly."""

    seeds: np.ndarray
    takes: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, n: int, count: int | None = None) -> Plan:
        count = walks(n) if count is None else count
        rng = np.random.default_rng([7, n])
        steps = max(PLACES, int(1.4 * n))
        seeds = rng.integers(1, 2**63, (count, steps), dtype=np.uint64)
        tables = np.argsort(rng.random((count, TABLES, steps)), axis=2)[:, :, :PLACES]
        sampled = np.zeros((steps, count, TABLES), bool)
        for k in range(PLACES):
            sampled[tables[:, :, k], np.arange(count)[:, None], np.arange(TABLES)[None, :]] = True
        return cls(seeds, [np.nonzero(s) for s in sampled])


def embed_keys(words: np.ndarray, start: np.ndarray, stop: np.ndarray, plan: Plan) -> np.ndarray:
    """Table keys of the sequences words[start:stop]: a row for each, a column for each table of each walk.

    A walk writes the word under it at every step and moves on one word or
    stays, by one random bit of (step, word); past the end it writes a pad. All
    walks of all sequences take a step together.
    """
    count = len(plan.seeds)
    padded = np.append(words, _PAD)
    at = np.repeat(start[None, :], count, axis=0)
    keys = np.repeat(np.arange(1, count * TABLES + 1, dtype=np.uint64).reshape(count, TABLES, 1), len(start), axis=2)
    for step, (walk, table) in enumerate(plan.takes):
        word = padded[np.where(at < stop, at, len(words))]
        if len(walk):
            keys[walk, table] = mix(keys[walk, table] * _M1 + word[walk])
        at += ((word ^ plan.seeds[:, step, None]) * _M1 >> np.uint64(63)).astype(np.int64)
    return keys.reshape(count * TABLES, -1).T


@dataclass
class Group:
    """Pieces of nearly one length, and their tables: all keys sorted, with the place in Index.pieces of each."""

    low: int
    high: int
    plan: Plan
    keys: np.ndarray
    pieces: np.ndarray

    @property
    def need(self) -> int:
        """Word pairs that a window within the allowed edits shares with its piece at least."""
        return min(n - 1 - 2 * edits_allowed(n) for n in range(self.low, self.high + 1))


def _chain(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of n words from each place."""
    key = words[: max(len(words) - n + 1, 0)].copy()
    for k in range(1, n):
        key = mix(key * _M1 + words[k : k + len(key)])
    return key


class Index:
    """What every task needs of the items, given as distinct texts: a few times their size, at most ITEMS_A_PASS of them."""

    def __init__(self, texts: list[str]):
        flat, first = words_of(*text_bytes(pa.array(texts, pa.string())))
        self.words = [flat[first[k] : first[k + 1]] for k in range(len(texts))]
        self.sets = [set(w.tolist()) for w in self.words]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, FUZZY):
            mine = [k for k, w in enumerate(self.words) if len(w) == n]
            if mine:
                keys = np.array([_chain(self.words[k], n)[0] for k in mine], np.uint64)
                order = np.argsort(keys, kind="stable")
                self.short[n] = keys[order], np.array(mine)[order]
        self.pieces: list[tuple[int, int, int]] = []  # item, first word, end
        for k, w in enumerate(self.words):
            cuts = np.linspace(0, len(w), -(-len(w) // PIECE_WORDS) + 1).astype(int).tolist() if len(w) >= FUZZY else []
            self.pieces += [(k, lo, hi) for lo, hi in zip(cuts, cuts[1:])]
        self.flags = np.zeros(_FLAGS, np.uint32)  # a bit for each group of sizes: which have such a word pair
        self.groups: list[Group] = []
        by_size = sorted((hi - lo, k) for k, (_, lo, hi) in enumerate(self.pieces))
        while by_size:
            low = by_size[0][0]
            high = int(low * 1.15)
            mine = [k for n, k in by_size if n <= high]
            by_size = by_size[len(mine) :]
            plan = Plan.of(low, walks(high))
            parts = [self.words[item][lo:hi] for item, lo, hi in (self.pieces[k] for k in mine)]
            for part in parts:
                self.flags[self._pair(part)] |= np.uint32(1 << len(self.groups))
            stops = np.cumsum([len(w) for w in parts])
            made = embed_keys(np.concatenate(parts), np.concatenate([[0], stops[:-1]]), stops, plan)
            keys, owner = made.ravel(), np.repeat(np.array(mine), made.shape[1])
            order = np.lexsort((owner, keys))
            self.groups.append(Group(low, high, plan, keys[order], owner[order]))

    @staticmethod
    def _pair(words: np.ndarray) -> np.ndarray:
        return (mix(words[:-1] * _M1 + words[1:]) & np.uint64(_FLAGS - 1)).astype(np.int64)

    def search(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, edits, end word) of the best match of each row and item that has one."""
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        best = self._search_short(words, row_of)
        looks: dict[tuple[int, int], list[tuple[int, int]]] = {}
        flags = self.flags[self._pair(words)] * (row_of[1:] == row_of[:-1]) if len(words) > 1 and self.groups else np.zeros(0, np.uint32)
        hits = np.flatnonzero(flags)
        flags = flags[hits]
        for k, group in enumerate(self.groups):
            for piece, start in self._candidates(group, words, first, row_of, hits[(flags >> np.uint32(k) & np.uint32(1)).astype(bool)]):
                item, begin, _ = self.pieces[piece]
                n, row = len(self.words[item]), int(row_of[start])
                slack = 2 * edits_allowed(n)
                looks.setdefault((row, item), []).append((max(int(first[row]), start - begin - slack), min(int(first[row + 1]), start - begin + n + slack)))
        for (row, item), spans in looks.items():
            found = min((self._verify(words, item, lo, hi) for lo, hi in _merged(spans)), key=lambda x: x[0])
            if found[0] <= edits_allowed(len(self.words[item])):
                best[(row, item)] = found
        return sorted((r, i, d, e) for (r, i), (d, e) in best.items())

    def _search_short(self, words: np.ndarray, row_of: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n, (keys, items) in self.short.items():
            made = _chain(words, n)
            at = np.minimum(np.searchsorted(keys, made), len(keys) - 1)
            for place in np.flatnonzero((keys[at] == made) & (row_of[: len(made)] == row_of[n - 1 :])).tolist() if len(made) else ():
                k = int(at[place])
                while k < len(keys) and keys[k] == made[place]:  # texts of the same words
                    best.setdefault((int(row_of[place]), int(items[k])), (0, place + n))
                    k += 1
        return best

    def _candidates(self, group: Group, words: np.ndarray, first: np.ndarray, row_of: np.ndarray, hits: np.ndarray) -> list[list[int]]:
        """Distinct (piece, window start) that share a table key; only windows with enough flagged word pairs are embedded."""
        reach, need = group.high + edits_allowed(group.high), group.need
        if len(hits) < need:
            return []
        head, tail = hits[: len(hits) - need + 1], hits[need - 1 :]
        dense = np.flatnonzero((tail - head <= reach - 2) & (row_of[head] == row_of[tail]))
        if not len(dense):
            return []
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, np.maximum(tail[dense] - reach + 2, first[row_of[head[dense]]]), 1)
        np.add.at(change, head[dense] + 1, -1)
        starts, found = np.flatnonzero(np.cumsum(change[:-1]) > 0), []
        for lo in range(0, len(starts), 4096):
            part = starts[lo : lo + 4096]
            keys = embed_keys(words, part, np.minimum(part + group.high, first[row_of[part] + 1]), group.plan)
            at = np.searchsorted(group.keys, keys.ravel(), side="left")
            n = np.searchsorted(group.keys, keys.ravel(), side="right") - at
            some = np.flatnonzero(n)
            n = n[some]
            place = np.repeat(at[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.unique(np.column_stack([group.pieces[place], np.repeat(part[some // keys.shape[1]], n)]), axis=0))
        return np.concatenate(found).tolist() if found else []

    def _verify(self, words: np.ndarray, item: int, lo: int, hi: int) -> tuple[int, int]:
        """Least edits between the item and any stretch of words[lo:hi], and where the first best one ends; many where that is plain."""
        text, mine = words[lo:hi], self.words[item]
        if len(self.sets[item].difference(text.tolist())) > edits_allowed(len(mine)):  # each distinct word that is missing takes an edit
            return len(mine), hi
        edits, end = edit_distance(mine, text)
        return edits, lo + end


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


# ---------------------------------------------------------------- tables


def _passes(items: DataFrame) -> Iterator[tuple[list[int], Index]]:
    """Keys of texts and their index for each ITEMS_A_PASS distinct texts of (key, t); only that many reach the driver at a time."""
    distinct = Written(items.select("key", "t").distinct(), "items")
    parts = max(1, -(-distinct.df.count() // ITEMS_A_PASS))
    for part in range(parts):
        mine = distinct.df if parts == 1 else distinct.df.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        found = sorted((r["t"], r["key"]) for r in mine.collect())
        yield [k for _, k in found], Index([t for t, _ in found])
    distinct.drop()


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.lower(F.col(text_col).cast("string")).alias("t")).where("t IS NOT NULL")
    return rows.withColumn("key", F.xxhash64("t"))


def find_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of the documents and item found in it: doc_id, item_id, edits, item_words, end_word.

    `edits` is the least around the places that the tables propose; `end_word` counts the
    words up to the end of the first best match there. Null and empty texts hold
    nothing; null items and items without a word are skipped; repeated rows and equal items are
    each reported; a null id stays null. Other columns are ignored; an empty
    table on either side gives no rows. Texts are searched whole.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("t"))
    spark, bench = documents.sparkSession, _items(items, item_id_col, item_text_col)
    found = None
    for keys, made in _passes(bench):
        shared = spark.sparkContext.broadcast((keys, made))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, index = shared.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for lo, hi in text_blocks(batch, "t"):
                    words, first = words_of(*text_bytes(batch.column("t").slice(lo, hi - lo)))
                    hits = [(ids[lo + r], keys[i], d, len(index.words[i]), e - int(first[r])) for r, i, d, e in index.search(words, first)]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits)], ["doc_id", "key", "edits", "item_words", "end_word"])

        one = docs.mapInArrow(run, "doc_id long, key long, edits long, item_words long, end_word long")
        found = one if found is None else found.unionByName(one)
    ids = bench.select("key", "item_id")
    return found.join(by_size(ids, ids.count()), "key").select("doc_id", "item_id", "edits", "item_words", "end_word")


def drop_leaks(documents: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows in which no item is found, with all their columns: one pass for each ITEMS_A_PASS items, no join; only texts go through Python."""
    left = documents
    for _, made in _passes(_items(items, item_id_col, item_text_col)):
        left = left.where(_clean(documents, made)(F.lower(F.col(text_col).cast("string"))))
    return left


def _clean(documents: DataFrame, made: Index) -> Callable[[Column], Column]:
    shared = documents.sparkSession.sparkContext.broadcast(made)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        good = np.ones(len(texts), bool)
        for lo, hi in text_spans(texts):
            words, first = words_of(*text_bytes(texts.slice(lo, hi - lo)))
            good[[lo + r for r, *_ in shared.value.search(words, first)]] = False
        return pa.array(good)

    return clean
