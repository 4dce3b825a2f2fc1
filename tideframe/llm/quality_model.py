"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from the bytes and word hashes of a block of texts, with
numpy only. Trees are learned on the driver from a bounded sample of labelled
rows (`SAMPLE`), flattened into arrays, and walked for all rows and trees of a
batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_blocks, text_bytes, text_spans, word_hashes

#: Labelled ids learned from at most, by the order of a hash of them. An id's label and statistics are the least of its rows.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, LEAST = 64, 60, 4, 0.15, 12
THRESHOLD = 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "shout": b"!?",
    "stop": b".",
    "comma": b",;:",
    "quote": b"\"'()[]{}",
    "line": b"\n",
    "blank": b" \t\x0b\x0c\r",
}
NAMES = [*_CLASSES, "other", "bytes", "words", "word_size", "word_spread", "distinct", "same_next", "same_second", "top_share", "pair_repeats", "line_words", "dup_lines", "stop_lines"]

_lookup = np.full(256, len(_CLASSES), np.uint8)
for _k, _set in enumerate(_CLASSES.values()):
    _lookup[list(_set)] = _k


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[edges[1:]] - total[edges[:-1]]


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys by row, and the largest count of one key."""
    if not len(keys):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]))
    counts = np.diff(np.append(new, len(k)))
    most = np.zeros(rows)
    np.maximum.at(most, r[new], counts)
    return np.bincount(r[new], minlength=rows).astype(float), most


def features(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text; shares are 0 where there is nothing to share."""
    raw, offsets = text_bytes(column)
    rows = len(offsets) - 1
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(row_of * (len(_CLASSES) + 1) + _lookup[raw], minlength=rows * (len(_CLASSES) + 1)).reshape(rows, -1).astype(float)
    size = np.maximum(np.diff(offsets), 1)
    words, first = word_hashes(raw, offsets)
    n = np.diff(first)
    some = np.maximum(n, 1)
    row = np.repeat(np.arange(rows), n)
    inside = ~(np.isin(_lookup[raw], (8, 9)))
    wide = _sums(inside, offsets)
    opens = inside & np.concatenate([[True], ~inside[:-1]]) if len(raw) else inside
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    opens[edges] = inside[edges]
    letters = np.concatenate([[0], np.cumsum(inside)])
    word_size = np.diff(np.append(letters[np.flatnonzero(opens)], letters[-1])).astype(float)
    same = lambda k: np.bincount(row[k:][(words[k:] == words[:-k]) & (row[k:] == row[:-k])], minlength=rows) / some if len(words) > k else np.zeros(rows)
    distinct, most = _distinct(words, row, rows)
    pairs = (words[1:] * np.uint64(31) + words[:-1]) if len(words) > 1 else words[:0]
    inner = row[1:] == row[:-1] if len(words) > 1 else np.zeros(0, bool)
    pair_kinds, _ = _distinct(pairs[inner], row[1:][inner] if len(words) > 1 else row[:0], rows)
    pair_n = np.maximum(n - 1, 1)
    lines, lfirst = word_hashes(raw, offsets, np.arange(256) == 10)
    ln = np.diff(lfirst)
    lsome = np.maximum(ln, 1)
    line_kinds, _ = _distinct(lines, np.repeat(np.arange(rows), ln), rows)
    ends = raw == 46
    last = np.zeros(len(raw), bool)
    if len(raw):
        last[:-1] = raw[1:] == 10
        last[offsets[1:][offsets[1:] > 0] - 1] = True
    spread = _sums(word_size**2, first) / some - (wide / some) ** 2
    return np.column_stack(
        [
            kinds / size[:, None],
            np.log1p(np.diff(offsets)),
            np.log1p(n),
            wide / some,
            np.sqrt(np.maximum(spread, 0)),
            distinct / some,
            same(1),
            same(2),
            most / some,
            1 - pair_kinds / pair_n * (n > 1),
            n / lsome,
            1 - line_kinds / lsome * (ln > 0),
            _sums(ends & last, offsets) / lsome,
        ]
    )


@dataclass(frozen=True)
class Trees:
    """Flat arrays, a row for each tree; a leaf points to itself, so every walk takes `DEPTH` steps."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        tree = np.arange(len(self.value))[None, :]
        node = np.zeros((len(x), len(self.value)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            down = x[rows, self.feature[tree, node]] <= self.cut[tree, node]
            node = np.where(down, self.left[tree, node], self.right[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node].sum(axis=1))))


def learn(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosting on the logistic loss; splits maximise the gain over histograms of equal-frequency bins."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
    base, width = float(np.log(share / (1 - share))), 2 ** (DEPTH + 1)
    shape = (max(trees, 1), width)
    feature, cut = np.zeros(shape, np.int64), np.full(shape, np.inf)
    left, value = np.tile(np.arange(width), (shape[0], 1)), np.zeros(shape)
    right = left.copy()
    if len(y) < 2 * LEAST or y.min() == y.max():
        return Trees(feature, cut, left, right, value, base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node, free = np.zeros(len(y), np.int64), 1
        level = [0]
        for depth in range(DEPTH + 1):
            nxt = []
            for k in level:
                mine = np.flatnonzero(node == k)
                g, h = grad[mine].sum(), hess[mine].sum()
                value[t, k] = -RATE * g / (h + 1.0)
                if depth == DEPTH or len(mine) < 2 * LEAST:
                    continue
                best = (1e-3, -1, -1)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[mine, f]
                    gs = np.cumsum(np.bincount(b, grad[mine], len(c) + 1))[:-1]
                    hs = np.cumsum(np.bincount(b, hess[mine], len(c) + 1))[:-1]
                    ns = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    gain[(ns < LEAST) | (len(mine) - ns < LEAST)] = -1
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (float(gain[at]), f, at)
                if best[1] < 0:
                    continue
                feature[t, k], cut[t, k] = best[1], cuts[best[1]][best[2]]
                left[t, k], right[t, k] = free, free + 1
                node[mine] = np.where(binned[mine, best[1]] <= best[2], free, free + 1)
                nxt += [free, free + 1]
                free += 2
            level = nxt
        raw += value[t, node]
    return Trees(feature, cut, left, right, value, base)


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Trees:
    """Learn from labelled documents outside the held-out fold (crc32 of the id modulo 5 is not 0).

    Rows with a null id or null label are not learned from. Without labelled
    documents of both kinds, the score is a constant.
    """
    lab = labels.select(F.col("doc_id").cast("long").alias("__tf_id"), F.col("quality").cast("int").alias("__tf_y")).where("__tf_id IS NOT NULL AND __tf_y IS NOT NULL")
    lab = lab.where(crc_mod("__tf_id", 5) != 0).groupBy("__tf_id").agg(F.min("__tf_y").alias("__tf_y"))
    lab = lab.orderBy(F.xxhash64("__tf_id"), "__tf_id").limit(sample)
    docs = documents.select(F.col(id_col).cast("long").alias("__tf_id"), F.col(text_col).cast("string").alias("__tf_t"))
    rows = docs.join(F.broadcast(lab), "__tf_id").select("__tf_id", "__tf_y", "__tf_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_blocks(batch, "__tf_t"):
                part = batch.slice(lo, hi - lo)
                made = features(part.column("__tf_t"))
                yield pa.RecordBatch.from_arrays([part.column("__tf_id"), part.column("__tf_y"), pa.array(list(made))], ["id", "y", "x"])

    made = rows.mapInArrow(run, "id long, y int, x array<double>").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toArrow().sort_by("id")
    x = np.array(made.column("x").to_pylist(), float).reshape(made.num_rows, len(NAMES))
    return learn(x, made.column("y").to_numpy().astype(float))


def score(documents: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted for every row; null and empty texts are scored by their (empty) statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_blocks(batch, "t"):
                part = batch.slice(lo, hi - lo)
                made = trees.scores(features(part.column("t")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made), pa.array((made >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row, repeated rows included; other columns are never inputs."""
    scored = score(documents, train(documents, labels, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the classifier does not reject, with all their columns: one pass, no join, and only texts go through Python."""
    trees = train(documents, labels, id_col, text_col)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, bool), *(trees.scores(features(texts.slice(lo, hi - lo))) >= THRESHOLD for lo, hi in text_spans(texts))]))

    return documents.where(good(F.col(text_col).cast("string")))
