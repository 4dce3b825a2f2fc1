"""Token counts by prefix dynamic programming.

The count of every prefix (every code point) of a text is stored once; truncation
and budget questions are then looked up, and nothing is encoded again. The tokenizer drops
white space and never joins across it, so a prefix has the tokens of its whole
words, C[end of word j] = C[end of word j - 1] + w(word j), and those of its
last, partial word. Inside a run of letters or marks the prefixes follow from each
other too: the encoding of a prefix is that of a shorter one and one more
token, the one that forms a valid pair with the token before it.

Both shortcuts are properties of a tokenizer file; they are looked up or tried
when it is loaded, and without them texts, or prefixes, are encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks

#: Words remembered by a Python worker before it starts anew: bounds its memory, not its results. Longer words than LONG are not remembered.
MEMO_WORDS, LONG = 700_000, 200

#: Letters up to U+00FF: one code point each in normal form, with a plain lower case.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,]?)")
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


class PairwiseBpe:
    """Counts for all prefixes of a run of symbols, by byte-pair merges in order of rank.

    A sequence of tokens is the encoding of its text if and only if every two
    neighbours are the encoding of theirs. So each prefix has exactly one last token
    that fits the last token of what is before it.
    """

    def __init__(self, merges: Iterable, vocab: dict, suffix: str):
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(merges)}
        self.vocab, self.suffix = vocab, suffix
        self.longest = max((len(t.removesuffix(suffix)) if suffix else len(t)) for t in vocab)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.symbol = {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(others)}}
        self.fits: dict[tuple[str, str], bool] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            rank, at = min((self.rank.get(pair, len(self.rank)), k) for k, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.rank):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def fit(self, before: str, token: str, last: bool) -> bool:
        """Whether `token`, which ends the run if `last`, follows `before` (empty: starts the run) in an encoding."""
        end = self.suffix if last else ""
        key = before, token + end
        if key not in self.fits:
            want = [before, token + end] if before else [token + end]
            self.fits[key] = self.merge([*before, *token[:-1], token[-1] + end]) == want
        return self.fits[key]

    def prefixes(self, run: str) -> np.ndarray:
        """Tokens of run[:k] for k = 0 to its length, each as a run of its own."""
        text, ends = "", []
        for c in run:
            text += "".join(self.symbol[b] for b in c.encode())
            ends.append(len(text))
        count, last = np.zeros(len(text) + 1, np.int64), [""] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for lo in range(max(0, end - self.longest), end):
                token = text[lo:end]
                if token in self.vocab and self.fit(last[lo], token, False):
                    count[end], last[end] = count[lo] + 1, token
                    break
        if not self.suffix:
            return count[[0, *ends]]
        out = [0]
        for end in ends:
            lo = next(lo for lo in range(max(0, end - self.longest), end) if text[lo:end] + self.suffix in self.vocab and self.fit(last[lo], text[lo:end], True))
            out.append(int(count[lo]) + 1)
        return np.array(out)


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes, for a tokenizer file of the `tokenizers` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, int] = {}
        self.cores: dict[str, int] = {}
        self.inside: dict[str, np.ndarray] = {}
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        self.special = [t["content"] for t in conf.get("added_tokens") or []]
        # Both are tried on samples of all that they claim; a file that breaks them is encoded whole.
        letters = "aBcdEéÉñÜßzq"
        words = [w + m for k in range(len(letters)) for w in (letters[k:], letters[k:] * 3, letters[: k + 1]) for m in ("", ".", ",")]
        self.plain = all(self._encoded([w])[0] == self._encoded([w.rstrip(".,").lower()])[0] + (w[-1] in ".,") for w in words)
        gaps = (" ", "  ", "\n", "\t", " \r\n ", "\x0b", "\x0c")
        self.by_word = all(self._encoded([g + a + g + b + g])[0] == sum(self._encoded([a, b])) for g in gaps for a, b in (("a", "b"), ("It's", "it"), ("x1", "2."), ("...", "."), ("né", "e")))
        model, before = conf["model"], (conf.get("pre_tokenizer") or {}).get("pretokenizers") or []
        whole = self.by_word and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        whole = whole and [p["type"] for p in before] == ["Split", "ByteLevel"] and not before[1]["add_prefix_space"]
        self.bpe = PairwiseBpe(model["merges"], model["vocab"], model.get("end_of_word_suffix") or "") if whole else None

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[bytes]:
        """What can be counted apart: the words, or the text where the tokenizer joins them."""
        return text.encode().split() if self.by_word else [text.encode()] if text else []

    def learn(self, words: Iterable[bytes]) -> None:
        """Remember the counts of words that are not remembered yet.

        Where the tokenizer lowers case and splits letters from marks, a word of
        plain letters with a full stop or comma has its letters' count and one.
        """
        new = set(words).difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = set(words)
        if len(self.cores) + len(new) > MEMO_WORDS:
            self.cores.clear()
        parts = {}
        for word in new:
            text = word.decode()
            hit = _PLAIN.fullmatch(text) if self.plain else None
            parts[word] = (hit[1].lower(), len(hit[2])) if hit else (text, 0)
        unknown = list({core for core, _ in parts.values()}.difference(self.cores))
        for lo in range(0, len(unknown), 20_000):
            part = unknown[lo : lo + 20_000]
            self.cores.update(zip(part, self._encoded(part)))
        self.memo.update((word, self.cores[core] + more) for word, (core, more) in parts.items())

    def word_counts(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.learn(words)
            return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def _run(self, run: str) -> np.ndarray:
        """Counts of the prefixes of a run that the tokenizer does not split."""
        made = self.inside.get(run)
        if made is None:
            made = self.bpe.prefixes(run)
            if len(run) <= LONG:
                if len(self.inside) >= MEMO_WORDS:
                    self.inside.clear()
                self.inside[run] = made
        return made

    def _plain_prefixes(self, word: str) -> np.ndarray:
        """Counts of the prefixes of a word without special strings."""
        normal = self.tokenizer.normalizer.normalize_str(word) if self.bpe and self.tokenizer.normalizer else word
        if self.bpe is None or len(normal) != len(word) or any(a != b and a.lower() != b for a, b in zip(word, normal)):
            return np.array([0, *self._encoded([word[: k + 1] for k in range(len(word))])])
        out, base = np.zeros(len(word) + 1, np.int64), 0
        for _, (lo, hi) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
            run = normal[lo:hi]
            if run[0] == "'" and run[1:].isalpha():  # a contraction: cut short, it is a mark and letters
                counts = np.array([0, *self._encoded([run[: k + 1] for k in range(len(run))])])
            else:
                counts = self._run(run)
            out[lo + 1 : hi + 1] = base + counts[1:]
            base = int(out[hi])
        return out

    def word_prefixes(self, word: str) -> np.ndarray:
        """Tokens of word[:k] for k = 0 to its length. A special string is one token once it is whole, and plain text until then."""
        hits = [(word.find(s), s) for s in self.special if s in word]
        if not hits:
            return self._plain_prefixes(word)
        at, special = min(hits)
        head = self._plain_prefixes(word[: at + len(special) - 1])
        tail = self.word_prefixes(word[at + len(special) :])
        return np.concatenate([head, head[at] + 1 + tail])

    def prefixes(self, text: str) -> Prefixes:
        out, base, at = np.zeros(len(text) + 1, np.int64), 0, 0
        for m in _WORD.finditer(text) if self.by_word else re.finditer(r"(?s).+", text):
            out[at : m.start() + 1] = base
            out[m.start() : m.end() + 1] = base + self.word_prefixes(m[0])
            base, at = int(out[m.end()]), m.end()
        out[at:] = base
        return Prefixes(out)


class Prefixes:
    """The stored counts of one text: tokens of text[:k] for k = 0 to its length."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def at(self, n: int) -> int:
        """Tokens of text[:n]."""
        return int(self.counts[min(n, len(self.counts) - 1)])

    def fit(self, budget: int) -> int:
        """Code points of the longest prefix of at most `budget` tokens (a longer prefix can have fewer: a word's end may join tokens)."""
        within = np.flatnonzero(self.counts <= budget)
        return int(within[-1]) if len(within) else 0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(4)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, path: str | None = None) -> DataFrame:
    """One row for each row: bytes, tokens, whether it is over the limit, and the code points of its longest prefix within the limit.

    A null text is empty: 0 bytes, 0 tokens. Texts are counted whole, without
    begin, end or padding; special strings inside a text count as the library
    counts them. Rows are counted alone; an empty table gives no rows; other
    columns are ignored. Of the prefix counts a row needs those at the ends of words, and
    inside the one word that crosses the limit.
    """
    path = path or default_path()

    def within(counter: PrefixCounter, text: str, prefix: np.ndarray) -> int:
        if not len(prefix) or prefix[-1] <= limit:
            return len(text)
        if not counter.by_word:
            return counter.prefixes(text).fit(limit)
        k = int(np.searchsorted(prefix, limit, side="right"))
        word = next(islice(_WORD.finditer(text), k, None))
        return word.start() + Prefixes(counter.word_prefixes(word[0])).fit(limit - (int(prefix[k - 1]) if k else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for lo, hi in text_blocks(batch, "text"):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column("text").to_pylist()]
                words = [counter.split(t) for t in texts]
                counter.learn({w for some in words for w in some})
                prefixes = [np.cumsum(counter.word_counts(some)) for some in words]
                n = np.array([int(p[-1]) if len(p) else 0 for p in prefixes])
                columns = [part.column("doc_id"), pa.array([len(t.encode()) for t in texts]), pa.array(n), pa.array(n > limit), pa.array([within(counter, t, p) for t, p in zip(texts, prefixes)])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within long")


def prefix_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The stored form: for each row the exact token count of every prefix, from the empty one to the whole text.

    `element_at(tokens, n + 1)` answers a truncation to n code points. Null texts are
    empty and have one prefix; rows are counted alone; an empty table gives no rows; other columns are ignored.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for lo, hi in text_blocks(batch, "text", 1 << 18):
                part = batch.slice(lo, hi - lo)
                counts = [counter.prefixes(t or "").counts.astype(np.int32) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tokens array<int>")
