"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of five-word shingles: weight = times it occurs x
(1 + idf_share x mean idf of its words), idf = ln((1 + N) / (1 + df)) / ln(1 + N), with
document counts kept in a count-min sketch of words, a table of fixed size
whatever the corpus. ICWS draws samples that two documents share with
probability equal to their weighted Jaccard similarity; bands of samples give
candidates; a link is a pair whose exact weighted Jaccard similarity reaches the bound.

Nothing emits all pairs of a group. Exact copies are one node from the start.
A bucket of a few nodes compares its pairs; a larger one compares each member
with two pivots. What a larger one still holds apart is compared whole, but for
pairs that share none of their rarest shingles, which cannot reach the bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, by_size, fold, mix, row_key, text_blocks, text_bytes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: How far idf moves a weight. Small: a shingle that thousands of copies share has little idf, and with full idf they would fall apart.
IDF_SHARE = 0.1
#: 12 bands of 3 samples find a pair of similarity 0.8 with probability 1 - (1 - 0.8^3)^12 = 0.9998.
BANDS, ROWS = 12, 3
#: Rows and columns of the count-min sketch of words, and buckets of shingles.
SKETCHES, BUCKETS, SHINGLE_BUCKETS = 3, 1 << 17, 1 << 18
#: Nodes of a bucket whose pairs are compared one by one.
SMALL = 8
#: Nodes and weight (nearly words) of the blocks in which the rest is compared, and elements that a block looks at together.
BLOCK_NODES, BLOCK_WEIGHT, BLOCK_ELEMENTS = 256, 100_000, 8_192
#: ICWS first looks at elements that can have a value below REACH / total weight; the minimum is there but for exp(-REACH).
REACH = 6.0
BLOCK = 1 << 19

_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- word statistics


def _column(words: np.ndarray, k: int) -> np.ndarray:
    """Where words stand in row k of the sketch: other bits of their hash for each row."""
    return (words >> np.uint64(17 * k) & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_idf(docs: DataFrame, text_col: str, share: float = IDF_SHARE) -> np.ndarray:
    """share x idf by row and column of the sketch, over all documents: a fixed number of sums, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs_seen = np.zeros((SKETCHES, BUCKETS), np.int64), 0
        for batch in batches:
            for lo, hi in text_blocks(batch, "t"):
                words, first = word_hashes(*text_bytes(batch.column("t").slice(lo, hi - lo)))
                sizes = np.diff(first)
                docs_seen += int((sizes > 0).sum())
                row = mix(np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes))
                words = words[np.unique(words ^ row, return_index=True)[1]]
                for k in range(SKETCHES):
                    counts[k] += np.bincount(_column(words, k), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        if docs_seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts.ravel()[at], docs_seen))], ["b", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    at, n = (found.column(c).to_numpy() for c in ("b", "n"))
    df, total = np.zeros(SKETCHES * BUCKETS), max(1, int(n[at == -1].sum()))
    df[at[at >= 0]] = n[at >= 0]
    return (share * np.log((1 + total) / (1 + np.minimum(df, total))) / np.log(1 + total)).astype(np.float32).reshape(SKETCHES, BUCKETS)


def word_gain(words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """What each word adds to a weight; the least of its counts in the sketch is the nearest to the true one."""
    return np.max([idf[k][_column(words, k)] for k in range(SKETCHES)], axis=0).astype(np.float64)


# ---------------------------------------------------------------- weighted shingles


def shingles(raw: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct shingles of all rows, in order of (row, hash): row offsets, hashes, weights; the words and their offsets; how often each shingle occurs.

    A row of fewer than five words but at least one has one shingle, all its words.
    """
    words, first = word_hashes(raw, offsets)
    counts = np.diff(first)
    rows = len(counts)
    gain = word_gain(words, idf)
    row_of = np.repeat(np.arange(rows), counts)
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        hashes, weight = words[:n].copy(), gain[:n].copy()
        for k in range(1, SHINGLE):
            hashes = mix(hashes * _M1 + words[k : n + k])
            weight += gain[k : n + k]
        whole = row_of[:n] == row_of[SHINGLE - 1 :]
        hashes, weight, row = hashes[whole], 1 + weight[whole] / SHINGLE, row_of[:n][whole]
    else:
        hashes, weight, row = words[:0], gain[:0], row_of[:0]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        keys = fold(words, first, 3)[short]
        means = np.array([gain[first[k] : first[k + 1]].mean() for k in short])
        hashes, weight, row = np.append(hashes, keys), np.append(weight, 1 + means), np.append(row, short)
    order = np.lexsort((hashes, row))
    hashes, weight, row = hashes[order], weight[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(hashes)))
    hashes, weight, row = hashes[at], weight[at] * times, row[at]
    return np.searchsorted(row, np.arange(rows + 1)), hashes, weight, words, first, times


def _values(z: np.ndarray, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ICWS for elements whose random bits start with z: ln a and t, from r, c ~ Gamma(2, 1) and beta ~ U(0, 1)."""
    fine = mix(z).view(np.uint16).reshape(-1, 4)
    u = (z.view(np.uint16).reshape(-1, 4) + (fine + 0.5) / 65536) / 65536
    beta = (mix(z ^ _M3) >> np.uint64(11)) * 2.0**-53
    r, c = -np.log(u[:, 0] * u[:, 1]), -np.log(u[:, 2] * u[:, 3])
    t = np.floor(log_weight / r + beta)
    return np.log(c) - r * (t - beta + 1), t


def icws(first: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row of samples for each row that has shingles; others get zeros.

    a >= c / (weight e^r) and c >= 1 - u3 u4, so a cheap bound from 16-bit
    uniforms tells which elements can be below REACH / total; where none is,
    the whole row is computed. The result is that of the full computation.
    """
    rows = len(first) - 1
    out = np.zeros((rows, len(_SEEDS)), np.uint64)
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    totals = np.ones(rows)
    totals[full] = np.add.reduceat(weight, first[:-1][full])
    row = np.repeat(np.arange(rows), sizes)
    log_weight, near = np.log(weight), np.log(REACH / totals)
    limit = (weight * (REACH / totals)[row] * 2.0**64 * 1.001).astype(np.float32)
    for k, seed in enumerate(_SEEDS):
        z = (hashes ^ seed) * _M1
        z ^= z >> np.uint64(29)
        z *= _M2
        z ^= z >> np.uint64(32)
        q = z.view(np.uint16).reshape(-1, 4).astype(np.float32)
        bound = q[:, 0] * q[:, 1] * (np.float32(2.0**32) - (q[:, 2] + 1) * (q[:, 3] + 1))
        best, which = np.full(rows, np.inf), np.zeros(rows, np.uint64)

        def settle(at: np.ndarray) -> None:
            value, t = _values(z[at], log_weight[at])
            mine = row[at]
            starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            least = np.minimum.reduceat(value, starts)
            hit = np.flatnonzero(value == np.repeat(least, np.diff(np.append(starts, len(mine)))))
            hit = hit[np.concatenate([[True], mine[hit][1:] != mine[hit][:-1]])]
            best[mine[hit]] = value[hit]
            which[mine[hit]] = mix(hashes[at][hit] ^ mix(t[hit].astype(np.int64).view(np.uint64) * _M3 + np.uint64(k)))

        some = np.flatnonzero(bound < limit)
        if len(some):
            settle(some)
        far = np.zeros(rows, bool)
        far[full] = best[full] > near[full]
        if far.any():
            settle(np.flatnonzero(far[row]))
        out[:, k] = which
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(samples), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mix(key * _M1 + samples[:, k])
        keys[:, b] = key
    return keys


def sketch(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """From (rid, x, t): rid, x, 128 bits of the word sequence (of the id without a word), total weight, band keys (null without a word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_blocks(batch, "t", BLOCK):
                part = batch.slice(lo, hi - lo)
                first, hashes, weight, words, wfirst, _ = shingles(*text_bytes(part.column("t")), idf)
                keys = band_keys(icws(first, hashes, weight)).view(np.int64)
                total = np.diff(np.concatenate([[0.0], np.cumsum(weight)])[first])
                offsets = np.arange(0, keys.size + 1, BANDS, dtype=np.int32)
                none = np.diff(first) == 0
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()), mask=pa.array(none))
                marks = [np.where(none, part.column("rid").to_numpy() if s == 1 else -1, fold(words, wfirst, s).view(np.int64)) for s in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("x"), *map(pa.array, marks), pa.array(total), bands], ["rid", "x", "fa", "fb", "w", "bands"])

    return docs.mapInArrow(run, "rid long, x long, fa long, fb long, w double, bands array<long>")


def similarities(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of two columns of texts, row by row; 0 where either has no word."""
    fa, ha, wa, *_ = shingles(*text_bytes(a), idf)
    fb, hb, wb, *_ = shingles(*text_bytes(b), idf)
    rows = len(fa) - 1
    ra, rb = (np.repeat(np.arange(rows), np.diff(f)) for f in (fa, fb))
    sums = [np.bincount(r, w, rows) for r, w in ((ra, wa), (rb, wb))]
    if not len(ha) or not len(hb):
        return np.zeros(rows)
    ka, kb = (mix(h ^ mix(r.astype(np.uint64) + np.uint64(1))) for h, r in ((ha, ra), (hb, rb)))
    order = np.argsort(kb)
    at = np.minimum(np.searchsorted(kb[order], ka), len(kb) - 1)
    same = kb[order][at] == ka
    common = np.bincount(ra[same], np.minimum(wa[same], wb[order][at][same]), rows)
    return common / np.maximum(sums[0] + sums[1] - common, 1e-12)


# ---------------------------------------------------------------- links and classes


class Corpus:
    """The documents as (rid, x, t), and where each node's text is: rid and x, a hash of the text as it stands."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, idf: np.ndarray):
        self.docs, self.places, self.idf = docs, nodes.select("node", "r.rid", "r.x"), idf

    def texts(self, nodes: DataFrame, name: str) -> Written:
        """(node, t) of the nodes (a column of distinct ones): no other text moves."""
        ends = Written(nodes, f"{name}-ends")
        n = ends.df.count()
        where = Written(self.places.join(by_size(ends.df, n), "node"), f"{name}-places")
        mine = self.docs.join(by_size(where.df, 3 * n), ["rid", "x"]).groupBy("node").agg(F.first("t").alias("t"))
        made = Written(mine, f"{name}-texts")
        ends.drop()
        where.drop()
        return made


def verify(pairs: DataFrame, corpus: Corpus, similarity: float, name: str) -> Written:
    """The pairs (a, b) whose texts reach the similarity."""
    texts = corpus.texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), name)
    both = pairs.join(texts.df.toDF("a", "ta"), "a").join(texts.df.toDF("b", "tb"), "b")
    idf = corpus.idf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_blocks(batch, "ta", BLOCK):
                part = batch.slice(lo, hi - lo)
                good = pa.array(similarities(part.column("ta"), part.column("tb"), idf) >= similarity - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], ["a", "b"])

    links = Written(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), f"{name}-links")
    texts.drop()
    return links


def connected(links: DataFrame, name: str) -> Written:
    """(node, comp): the least node of each component, for every node that has a link.

    Labels move to the least label of a neighbour, then jump to their label's
    label; each round is written, so a lost executor costs one round at most.
    """
    arcs = Written(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b").distinct(), f"{name}-arcs")
    labels = Written(arcs.df.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("comp")), f"{name}-labels")
    while True:
        near = arcs.df.join(labels.df.toDF("b", "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        moved = labels.df.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = labels.df.toDF("comp", "further")
        done = Written(moved.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), f"{name}-labels")
        left = done.df.where("old <> comp").limit(1).count()
        labels.drop()
        labels = Written(done.df.select("node", "comp"), f"{name}-labels")
        done.drop()
        if not left:
            arcs.drop()
            return labels


def _close(x: F.Column, y: F.Column, similarity: float) -> F.Column:
    """The lighter of two sets of this similarity has at least that share of the heavier one's weight."""
    return F.least(x, y) >= (similarity - 1e-6) * F.greatest(x, y)


def _pairs_within(groups: DataFrame, good: Callable[[F.Column, F.Column], F.Column]) -> DataFrame:
    """The good pairs of the array `m` of structs with a node, of bounded size."""
    later = lambda i: F.slice("m", i + 2, F.size("m"))
    made = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(later(i), lambda y: good(x, y)), lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")))))
    return groups.select(F.explode(made).alias("p")).select("p.a", "p.b")


def _pairs_with(members: DataFrame, pivots: DataFrame, similarity: float) -> DataFrame:
    """Each member of a large bucket with its bucket's pivots, an array `m` of (node, w)."""
    here = lambda p: (F.col("node") != p["node"]) & _close(F.col("w"), p["w"], similarity)
    rows = members.join(pivots, "key").select("node", F.explode(F.filter("m", here)).alias("p"))
    return rows.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))


def _pivots(members: DataFrame) -> DataFrame:
    """Two members of each bucket: the one met in most company, and the first by a hash.

    The first is the member whose buckets hold the most others: in a group made by
    editing one text, that is the text, to which all the others are near. Both orders
    are the same in all buckets, so a group's buckets choose the same few pivots.
    """
    company = members.groupBy("node").agg(F.sum("n").alias("met"))
    one = F.struct(F.xxhash64("node").alias("h"), F.struct("node", "w").alias("s"))
    found = members.join(company, "node").groupBy("key").agg(F.max(F.struct("met", one.alias("o"))).alias("p1"), F.min(one).alias("p2"))
    return found.select("key", F.array_distinct(F.array("p1.o.s", "p2.s")).alias("m"))


def _candidates(members: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) from the buckets of `members` (key, node, w, n)."""
    few = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("node", "w")).alias("m"))
    many = members.where(F.col("n") > SMALL)
    pairs = _pairs_within(few, lambda x, y: _close(x["w"], y["w"], similarity)).unionByName(_pairs_with(many, _pivots(many), similarity))
    return pairs.distinct()


# ---------------------------------------------------------------- what large buckets hold apart


def shingle_counts(texts: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Texts by hash bucket of shingles: the order from rare to common, a fixed number of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SHINGLE_BUCKETS, np.int64)
        for batch in batches:
            for lo, hi in text_blocks(batch, "t", BLOCK):
                _, hashes, *_ = shingles(*text_bytes(batch.column("t").slice(lo, hi - lo)), idf)
                counts += np.bincount((hashes & np.uint64(SHINGLE_BUCKETS - 1)).astype(np.int64), minlength=SHINGLE_BUCKETS)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["b", "n"])

    found = texts.select("t").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SHINGLE_BUCKETS, np.int64)
    counts[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return counts


def rare_shingles(raw: np.ndarray, offsets: np.ndarray, idf: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, left): of each row's shingles from rare to common, those after which too little is left to reach the similarity.

    What two texts share has at least that share of either one's weight, and none of
    it comes before the rarest shared one. So that one is among these in both, and
    `left`, the weight from it on, bounds what they share.
    """
    first, hashes, weight, *_ = shingles(raw, offsets, idf)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, counts[(hashes & np.uint64(SHINGLE_BUCKETS - 1)).astype(np.int64)], row))
    hashes, weight = hashes[order], weight[order]
    upto = np.concatenate([[0.0], np.cumsum(weight)])
    total, left = upto[first[1:]] - upto[first[:-1]], upto[first[1:]][row] - upto[:-1]
    keep = left >= (similarity - 1e-8) * total[row] - 1e-6
    return row[keep], hashes[keep], left[keep]


def block_links(left: pa.Array, right: pa.Array, left_comp: np.ndarray, right_comp: np.ndarray, idf: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places (left, right) of pairs of different components that reach the similarity, as many as join those components."""
    n, m = len(left), len(right)
    both = pa.concat_arrays([left, right])
    first, hashes, weight, _, _, times = shingles(*text_bytes(both), idf)
    row = np.repeat(np.arange(n + m), np.diff(first))
    total = np.bincount(row, weight, n + m)
    copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)  # the k-th of a shingle meets the k-th of another text
    keys, gain, row = mix(np.repeat(hashes, times) ^ mix(copy.astype(np.uint64))), np.repeat(weight / times, times), np.repeat(row, times)
    _, at, sizes = np.unique(keys, return_inverse=True, return_counts=True)
    some = np.flatnonzero(sizes[at] > 1)
    some = some[np.argsort(at[some], kind="stable")]
    _, at = np.unique(at[some], return_inverse=True)
    gain, row = gain[some], row[some]
    common = np.zeros((n, m))
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, BLOCK_ELEMENTS):
        here = slice(np.searchsorted(at, lo), np.searchsorted(at, lo + BLOCK_ELEMENTS))
        width = int(at[here][-1]) - lo + 1
        has, gains = np.zeros((n + m, width)), np.zeros(width)
        has[row[here], at[here] - lo] = 1
        gains[at[here] - lo] = gain[here]
        common += (has[:n] * gains) @ has[n:].T
    best = common / np.maximum(total[:n, None] + total[None, n:] - common, 1e-12)
    links, parent = [], {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for i, j in np.argwhere((best >= similarity - 1e-9) & (left_comp[:, None] != right_comp[None, :])).tolist():
        a, b = root(int(left_comp[i])), root(int(right_comp[j]))
        if a != b:
            parent[a] = b
            links.append((i, j))
    return links


def _blocks(rows: DataFrame) -> DataFrame:
    """From (key, node, w, comp): (key, lo, kind, hi, node, comp, at), the pairs of blocks of each key.

    A key's largest component is dealt into blocks of its own, which meet those of
    the others only: pairs inside a component are no matter any more.
    """
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    whole = sizes.groupBy("key").agg(F.max(F.struct("n", "comp", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k")).where("k > 1")
    count = lambda n, w: F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(w / BLOCK_WEIGHT), F.lit(1)).cast("int")
    dealt = whole.select("key", F.col("main.comp").alias("main"), count(F.col("main.n"), F.col("main.w")).alias("nm"), count(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("no"))
    mine = rows.join(dealt, "key").withColumn("at", F.pmod(F.xxhash64("node"), F.when(F.col("comp") == F.col("main"), F.col("nm")).otherwise(F.col("no"))).cast("int"))
    place = lambda lo, kind, hi: F.struct(lo.cast("int").alias("lo"), F.lit(kind).alias("kind"), hi.cast("int").alias("hi"))
    others, mains = F.sequence(F.lit(0), F.col("no") - 1), F.sequence(F.lit(0), F.col("nm") - 1)
    meets = F.when(F.col("comp") == F.col("main"), F.transform(others, lambda i: place(i, "main", F.col("at")))).otherwise(
        F.concat(F.transform(mains, lambda j: place(F.col("at"), "main", j)), F.transform(others, lambda j: place(F.least("at", j), "other", F.greatest("at", j))))
    )
    return mine.select("key", "node", "comp", (F.col("comp") == F.col("main")).alias("is_main"), "at", F.explode(meets).alias("p")).select("key", "p.lo", "p.kind", "p.hi", "node", "comp", "is_main", "at")


def compare_rest(rest: DataFrame, corpus: Corpus, similarity: float, links: DataFrame) -> Written:
    """The components after every pair of different ones in the buckets of `rest` (key, node, w, comp) is compared.

    Lossless: a pair at the bound shares one of its rarest shingles. Few nodes with
    such a shingle are compared as pairs; nodes with one that is less rare meet
    the others of their kind in their buckets, in bounded blocks spread over tasks.
    """
    idf = corpus.idf
    nodes = Written(rest.select("node", "w", "comp").distinct(), "rest-nodes")
    texts = corpus.texts(nodes.df.select("node"), "rest")
    counts = shingle_counts(texts.df, idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_blocks(batch, "t", BLOCK):
                row, hashes, left = rare_shingles(*text_bytes(batch.column("t").slice(lo, hi - lo)), idf, counts, similarity)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo).take(pa.array(row)), pa.array(hashes.view(np.int64)), pa.array(left)], ["node", "key", "left"])

    keyed = Written(texts.df.mapInArrow(run, "node long, key long, left double").join(nodes.df, "node"), "rare")
    several = keyed.df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key", "n")
    lists = Written(keyed.df.join(several, "key"), "rare-lists")
    few = lists.df.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("node", "w", "comp", "left")).alias("m"))
    enough = similarity / (1 + similarity)  # of both weights together must be shared

    def good(x: F.Column, y: F.Column) -> F.Column:
        return (x["comp"] != y["comp"]) & (F.least(x["left"], y["left"]) >= enough * (x["w"] + y["w"]) - 1e-6)

    pairs = Written(_pairs_within(few, good).distinct(), "rare-pairs")
    found = verify(pairs.df, corpus, similarity, "rare")
    all_links = Written(links.unionByName(found.df), "links")
    comps = connected(all_links.df, "rare")

    hard = lists.df.where(F.col("n") > SMALL).select("node").distinct()
    rows = Written(rest.select("key", "node", "w").join(hard, "node", "left_semi").join(comps.df, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "hard")
    blocks = _blocks(rows.df)

    def compare(table: pa.Table) -> pa.Table:
        side = np.array(table.column("at").to_pylist()) == table.column("lo")[0].as_py()
        if table.column("kind")[0].as_py() == "main":
            side = ~np.array(table.column("is_main").to_pylist(), bool)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        two = two if len(two) or table.column("lo")[0].as_py() != table.column("hi")[0].as_py() else one
        t, comp, node = table.column("t").combine_chunks(), table.column("comp").to_numpy(), table.column("node").to_numpy()
        found = block_links(t.take(pa.array(one)), t.take(pa.array(two)), comp[one], comp[two], idf, similarity) if len(one) and len(two) else []
        made = np.array([(node[one[i]], node[two[j]]) for i, j in found], np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(made.min(axis=1)), "b": pa.array(made.max(axis=1))})

    more = Written(blocks.join(texts.df, "node").groupBy("key", "lo", "kind", "hi").applyInArrow(compare, "a long, b long"), "rest-links")
    if more.df.limit(1).count():
        comps.drop()
        comps = connected(all_links.df.unionByName(more.df), "rest")
    for table in (nodes, texts, keyed, lists, pairs, found, all_links, rows, more):
        table.drop()
    return comps


def classes_of(df: DataFrame, id_col: str, text_col: str, similarity: float, idf_share: float) -> DataFrame:
    """(rid, x, class_id, kept) for every row: id, hash of the text, class, whether the row's text is the class's first."""
    docs = df.select(row_key(id_col, text_col).alias("rid"), F.xxhash64(F.col(text_col).cast("string")).alias("x"), F.col(text_col).cast("string").alias("t"))
    idf = word_idf(df, text_col, idf_share)
    rows = Written(sketch(docs, idf), "sketch").df
    found = Written(rows.groupBy("fa", "fb").agg(F.min(F.struct("rid", "x")).alias("r"), F.any_value("w").alias("w"), F.any_value("bands").alias("bands")), "nodes").df
    several = Written(found.groupBy("r.rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rid"), "several")
    many = several.df.count()
    nodes = found.withColumn("node", F.col("r.rid"))
    if many:  # ids of several texts: each text is a document of its own
        marked = found.join(by_size(several.df.toDF("rid2"), many), F.col("r.rid") == F.col("rid2"), "left")
        nodes = Written(marked.withColumn("node", F.when(F.col("rid2").isNull(), F.col("r.rid")).otherwise(-F.abs(F.shiftright(F.xxhash64("r.rid", "r.x"), 1)) - 1)).drop("rid2"), "nodes").df
    several.drop()
    corpus = Corpus(docs, nodes, idf)

    keyed = nodes.where("bands IS NOT NULL").select("node", "w", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = Written(keyed.join(shared, "key").select("key", "node", "w", "n"), "members")
    pairs = Written(_candidates(members.df, similarity), "pairs")
    links = verify(pairs.df, corpus, similarity, "first")
    comps = connected(links.df, "first")

    # Large buckets whose members are still in several components.
    labelled = Written(members.df.where(F.col("n") > SMALL).join(comps.df, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "labelled")
    apart = labelled.df.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key")
    rest = Written(labelled.df.join(apart, "key", "left_semi"), "rest")
    if rest.df.limit(1).count():
        comps.drop()
        comps = compare_rest(rest.df, corpus, similarity, links.df)
    for table in (members, pairs, links, labelled, rest):
        table.drop()

    classes = nodes.join(comps.df, "node", "left").select("fa", "fb", "r", F.coalesce("comp", "node").alias("class_id"), F.coalesce(F.col("comp") == F.col("node"), F.lit(True)).alias("first"))
    made = rows.select("rid", "x", "fa", "fb").join(classes, ["fa", "fb"])
    return made.select("rid", "x", "class_id", (F.col("first") & (F.col("rid") == F.col("r.rid")) & (F.col("x") == F.col("r.x"))).alias("kept"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, idf_share: float = IDF_SHARE) -> DataFrame:
    """(rid, class_id) for every row: the least id of the row's class of near duplicates.

    Classes are the connected components of links of at least the similarity;
    equal word sequences are one node. Texts without a word are in no class but
    their own id's. An id that stands for several texts names none of them: each is
    a document, under a negative number made from id and text, as a null id's
    is made from the text. Other columns are ignored; an empty table gives no
    rows. Long texts are read whole.
    """
    return classes_of(df, id_col, text_col, similarity, idf_share).select("rid", "class_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, idf_share: float = IDF_SHARE) -> DataFrame:
    """The table with one document of each class, the one of least id (or number in place of it); all columns pass through.

    Of rows that repeat its id and text the first by a hash of all columns stays, so reruns agree.
    """
    classes = Written(classes_of(df, id_col, text_col, similarity, idf_share), "classes")
    many = classes.df.where("kept").groupBy("rid", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rid").alias("__tf_rid"), F.col("x").alias("__tf_x"))
    gone = Written(classes.df.where("NOT kept").select(F.col("rid").alias("__tf_rid"), F.col("x").alias("__tf_x")).distinct(), "gone").df
    keys = ["__tf_rid", "__tf_x"]
    left = df.withColumns({"__tf_rid": row_key(id_col, text_col), "__tf_x": F.xxhash64(F.col(text_col).cast("string"))}).join(by_size(gone, 2 * gone.count()), keys, "left_anti")
    repeats = Written(many, "repeats")
    n = repeats.df.count()
    classes.drop()
    if n:
        twice = by_size(repeats.df, 2 * n)
        one = left.join(twice, keys, "left_semi").groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("r")).select("r.*")
        return left.join(twice, keys, "left_anti").select(*df.columns).unionByName(one)
    repeats.drop()
    return left.select(*df.columns)
