"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, scheme marks, plus signs, digits and
identifier cues; deterministic parsers then expand each anchor to its left and
right and validate what they find. The base kinds (email, ip, card, phone)
equal the leftmost, non-overlapping matches of their patterns; the other kinds
add spans and never remove one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, text_spans

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "login_url")

#: The character classes of the patterns, and the cues.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:\x20(?:no|nr|number|id))?\.?\x20?[:#=]?\x20?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}|[0-9](?:-?[0-9]){5,19})(?![A-Za-z0-9])")
_SECRET = re.compile(r"\x20?[:=]\x20?([\"']?)([A-Za-z0-9_+/=-]{16,256})\1(?![A-Za-z0-9])")
_USERINFO = re.compile(r"://([^\s/@:]+):([^\s/@]+)@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)")
_ACCOUNT_CUES = ("IBAN", "iban", "account", "Account", "acct", "Acct", "Konto", "compte", "cuenta")
_SECRET_CUES = ("token", "api_key", "apikey", "api-key", "secret", "password", "passwd")


@lru_cache(1)
def _automaton():
    import ahocorasick  # only here: without it the other operators work

    auto = ahocorasick.Automaton()
    for digit in "0123456789":
        auto.add_word(digit, ("digit", 1))
    for mark, what in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        auto.add_word(mark, (what, len(mark)))
    for cue in _ACCOUNT_CUES:
        auto.add_word(cue, ("account", len(cue)))
    for cue in _SECRET_CUES:
        auto.add_word(cue, ("secret", len(cue)))
    auto.make_automaton()
    return auto


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    bare = text.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order, as code points with the end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (what, length) in _automaton().iter(text):
        start, stop = last + 1 - length, last + 1
        if what == "digit":
            if start >= done["card"] and (m := _CARD.match(text, start)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
            if start >= done["ip"]:
                if m := _IP.match(text, start):
                    done["ip"] = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                        found["ip"].append(m.span())
                else:
                    done["ip"] = _DIGITS.match(text, start).end()
        elif what == "at":
            left = start
            while left > done["email"] and text[left - 1] in _LOCAL:
                left -= 1
            if left < start and (m := _DOMAIN.match(text, stop)):
                done["email"] = m.end()
                found["email"].append((left, m.end()))
        elif what == "plus":
            if start >= done["phone"] and (m := _PHONE.match(text, start)):
                done["phone"] = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif what == "scheme":
            left = start
            while left > done["login_url"] and text[left - 1] in _SCHEME:
                left -= 1
            if left < start and (m := _USERINFO.match(text, start)):
                done["login_url"] = m.end()
                found["login_url"].append((left, m.end()))
        elif what == "account":
            if start >= done["account"] and (m := _ACCOUNT.match(text, stop)) and (not m[1][0].isalpha() or iban(m[1])):
                done["account"] = m.end(1)
                found["account"].append(m.span(1))
        elif start >= done["secret"] and (m := _SECRET.match(text, stop)) and any(c.isdigit() for c in m[2]):
            done["secret"] = m.end(2)
            found["secret"].append(m.span(2))
    return found


def join_spans(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; where spans overlap, the first one's kind stands."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, spans in find_spans(text).items() for a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: counts by base kind, the digest of the base spans, all spans.

    A null text is empty and has no spans. Rows are read alone, so repeated
    rows give repeated results; an empty table gives no rows; other columns are
    ignored. Texts of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_blocks(batch, "text"):
                part = batch.slice(lo, hi - lo)
                spans = [find_spans(t or "") for t in part.column("text").to_pylist()]
                counts = [pa.array([len(found[k]) for found in spans]) for k in BASE]
                base = pa.array([hashlib.sha256(join_spans(found, BASE).encode()).hexdigest() for found in spans])
                every = [pa.array([join_spans(found, KINDS) for found in spans]), pa.array([sum(map(len, found.values())) for found in spans])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, base, *every], [x.split()[0] for x in SCHEMA.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with its text redacted; a null text stays null, the other columns pass through, an empty table stays empty."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([redact(t) for t in texts.slice(lo, hi - lo).to_pylist()], pa.string()) for lo, hi in text_spans(texts)] or [pa.array([], pa.string())])

    return df.withColumn(text_col, run(F.col(text_col).cast("string")))
