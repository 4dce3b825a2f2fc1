from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tideframe.llm import token_counts as tc

LIB = Tokenizer.from_file(tc.default_path())
COUNTER = tc.PrefixCounter(tc.default_path())


def lib(text):
    return len(LIB.encode(text, add_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aA 'stréΣ\n<|endoftext>\x1c ​1é", max_size=60) | st.lists(st.sampled_from(["the", "un", "believ", "ably", "'re", "'", "<|endoftext|>", "İ", "e\u0301", "...", "!!", "12", " ", "über", "日本"]), max_size=9).map("".join))
def test_every_prefix(text):
    """All stored counts against the library, which encodes each prefix."""
    made = COUNTER.prefixes(text)
    assert [made.at(n) for n in range(len(text) + 1)] == [lib(text[:n]) for n in range(len(text) + 1)]
    for budget in (0, 1, 3, 10):
        assert made.fit(budget) == max(n for n in range(len(text) + 1) if lib(text[:n]) <= budget)


def test_long_runs():
    for text in ("a" * 3000, "=-" * 700, "Donaudampfschifffahrtsgesellschaft" * 40):
        made = COUNTER.prefixes(text)
        assert all(made.at(n) == lib(text[:n]) for n in (1, 17, 500, len(text) // 2, len(text)))


def test_a_tokenizer_that_joins_over_spaces():
    """Byte-level pieces hold a leading space: texts and prefixes are then encoded whole."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), tc.PrefixCounter(path)
    text = "It's a test,  of naïve words.\n\n 123"
    assert not counter.by_word and counter.bpe is None
    made = counter.prefixes(text)
    assert [made.at(n) for n in range(len(text) + 1)] == [len(library.encode(text[:n], add_special_tokens=False)) for n in range(len(text) + 1)]


def test_prefix_table(documents):
    text = "It's a <|endoftext|> test, of unbelievable words: naïve déjà vu 12345. " * 4
    rows = tc.prefix_table(documents([(1, text), (2, None), (None, " ")])).collect()
    by = {r["doc_id"]: r["tokens"] for r in rows}
    assert by[1] == [lib(text[:n]) for n in range(len(text) + 1)] and by[2] == [0] and by[None] == [0, 0]
    assert tc.prefix_table(documents([(1, text)]).limit(0)).collect() == []


def test_chars_within(documents):
    text = "Unbelievably long words, naïve déjà vu; 12345 <|endoftext|>again. " * 9
    for limit in (0, 1, 5, 40, 10_000):
        got = tc.count_tokens(documents([(1, text), (2, None)]), limit=limit).collect()
        assert {r["doc_id"]: r["chars_within"] for r in got} == {1: max(n for n in range(len(text) + 1) if lib(text[:n]) <= limit), 2: 0}


def test_query(documents, monkeypatch):
    rows = [(1, None), (2, ""), (3, "Hello wörld"), (3, "Hello wörld"), (None, "x " * 5000), (4, "a" * 100_000), (5, " \n\t")]
    got = tc.count_tokens(documents(rows)).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((d or -1, len((t or "").encode()), lib(t or ""), lib(t or "") > 2048) for d, t in rows)
    assert tc.count_tokens(documents(rows).limit(0)).collect() == []


def test_memo_bound(monkeypatch):
    monkeypatch.setattr(tc, "MEMO_WORDS", 3)
    counter = tc.PrefixCounter(tc.default_path())
    for text in ("a b c d e", "f g", "a b c d e"):
        assert counter.word_counts(text.encode().split()).sum() == lib(text)
