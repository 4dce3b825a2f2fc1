import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tideframe.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if valid(k, m[0])] for k, p in PATTERNS.items()}


@settings(max_examples=400)
@given(st.text(alphabet="019.@-+ ()ab_%é", max_size=60))
def test_base_equals_patterns(text):
    found = pii.find_spans(text)
    assert {k: found[k] for k in pii.BASE} == brute(text)


@settings(max_examples=200)
@given(st.lists(st.sampled_from(["4539578763621486", "4539 5787 6362 1486", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "+1 (559) 555-3817", "+44", "a.b@c.de", "@x.y", "a@b@c.d", " ", ",", "x", "7", "-"]), max_size=8).map("".join))
def test_base_on_pieces(text):
    found = pii.find_spans(text)
    assert {k: found[k] for k in pii.BASE} == brute(text)


def test_added_kinds():
    text = 'IBAN: GB82 WEST 1234 5698 7654 32, IBAN GB00WEST12345698765432; token = "c80fd45a66f8564ae70609f7b2a26100e64e830e" ftp://me:pw@host.org/x account no. 12345678 the token of life'
    found = pii.find_spans(text)
    at = lambda kind: [text[a:b] for a, b in found[kind]]
    assert at("account") == ["GB82 WEST 1234 5698 7654 32", "12345678"]
    assert at("secret") == ["c80fd45a66f8564ae70609f7b2a26100e64e830e"]
    assert at("login_url") == ["ftp://me:pw@host.org"]
    assert pii.redact("mail a@b.cd now") == "mail [EMAIL] now" and pii.redact(None) is None


def test_query(documents):
    rows = [(1, "x@y.zz " * 3), (2, None), (2, None), (None, "1.2.3.4"), (3, ""), (4, "w " * 200_000 + "+12345678901")]
    got = sorted(pii.find_pii(documents(rows)).collect(), key=str)
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by[1]["n_email"] == 3 and by[None]["n_ip"] == 1 and by[4]["n_phone"] == 1 and by[2]["spans"] == ""
    assert by[4]["spans"] == "phone:400000:400012"
    assert pii.find_pii(documents(rows).limit(0)).collect() == []
    assert pii.redact_pii(documents([(1, "a@b.cd"), (2, None)])).select("text").collect() == [("[EMAIL]",), (None,)]


def test_redacted_tables(documents):
    """Nulls, long and repeated rows, clashing columns, an empty table; a redacted text holds no base span any more."""
    text = "mail a.b@x.org, call +1 (555) 123-4567 or see 10.0.0.1. " * 2000
    df = documents([(1, text), (1, text), (2, None), (3, ""), (None, "plain")])
    got = pii.redact_pii(df)
    assert got.columns == df.columns and dict(got.dtypes) == dict(df.dtypes)
    rows = sorted((r["doc_id"] or 0, r["text"]) for r in got.collect() if r["text"] is not None)
    assert rows[0] == (0, "plain") and rows[1] == rows[2] and rows[1][1].startswith("mail [EMAIL], call [PHONE] or see [IP].") and rows[3] == (3, "")
    assert not any(pii.find_spans(rows[1][1])[k] for k in pii.BASE)
    assert pii.redact_pii(df.limit(0)).collect() == []
