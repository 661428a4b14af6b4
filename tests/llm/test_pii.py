import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldtally.llm import pii

#: The plain patterns, in the order of kinds.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None, "", "a@b.c_x@d.ef a@b @c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0001.000255.1.1 1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112",
    "+1 (555) 010-9999 call +12345 +1234567890123456", "é🙂 x@y.zz 4242424242424242+442071234567 0.0.0.0", "a.b" * 2000 + "@x.y",
    "1" * 9000 + " " + "1 " * 6000, "@" * 500 + "+" * 500, "x@" + "a." * 5000 + "b", "79927398713 49927398716 6011000990139424 ",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    spans = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), order, m.end()))
    return [f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(spans)]


def reported(df):
    return [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.report(df).collect()]


def check(rows, got):
    wanted = []
    for d, t in rows:
        spans = brute(t)
        counts = [sum(s.startswith(k + ":") for s in spans) for k in PLAIN]
        wanted.append((d, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans)))
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_base_spans(documents_of):
    rows = [*enumerate(TEXTS), (1, "x@y.z"), (1, "x@y.z"), (None, "9.9.9.9")]
    check(rows, reported(documents_of(rows, "spans")))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("a@.+1 2-(4_%", max_size=40), min_size=60, max_size=60))
def test_base_spans_property(documents_of, texts):
    rows = list(enumerate(texts))
    got = [(r.doc_id, r.base_sha256) for r in pii.base(documents_of(rows)).select(
        "doc_id", F.sha2(pii.written(F.col("base")), 256).alias("base_sha256")).collect()]
    assert sorted(got) == [(d, hashlib.sha256(",".join(brute(t)).encode()).hexdigest()) for d, t in rows]


def test_empty_table(documents_of):
    assert pii.report(documents_of([])).count() == 0 and pii.sanitised(documents_of([])).count() == 0


@pytest.fixture(scope="module")
def revealing():
    """Zorblatt stands near one address alone, in unlike sentences; other words are everywhere."""
    plain = [(100 + i, f"the weather report number {i} tells of rain on the hills and no more") for i in range(60)]
    lead = ["ask", "tell", "write", "call", "meet"]
    tail = ["today", "soon", "please", "again", "tomorrow"]
    near = [(i, f"{lead[i]} Zorblatt {tail[i]} by q@corp.example of the {lead[-i]} report") for i in range(5)]
    copies = [(50 + i, "only Quixley here wrote r@corp.example of rain") for i in range(9)]
    return plain + near + copies


def test_terms_that_reveal(documents_of, revealing):
    rows = {r.doc_id: r.spans for r in pii.report(documents_of(revealing)).collect()}
    texts = dict(revealing)
    for i in range(5):
        terms = [s.split(":") for s in rows[i].split(",") if s.startswith("term:")]
        assert [texts[i][int(a) : int(b)] for _, a, b in terms] == ["Zorblatt"]
    assert all("term" not in s for d, s in rows.items() if d >= 5)  # copies of one passage are no evidence


def test_sanitised_text(documents_of, revealing):
    df = documents_of([*revealing, (7, None), (8, "a@b.cc, then +1 555 010 9999"), (8, "a@b.cc, then +1 555 010 9999")])
    out = pii.sanitised(df)
    assert out.columns == df.columns
    got = {(r.doc_id, r.text) for r in out.collect() if r.doc_id < 9}
    assert (7, None) in got and (8, "[EMAIL], then [PHONE]") in got and (0, "ask  today by [EMAIL] of the ask report") in got
    assert out.count() == df.count()
    assert {r.text for r in out.collect() if r.doc_id >= 100} == {t for d, t in revealing if d >= 100}


def terms_in(text, spans):
    return [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in spans.split(",") if s) if k == "term"]


def test_names_beside_the_mention(documents_of):
    lead, tail = ["ask", "tell", "write", "call", "please meet"], ["today", "soon", "now", "again", "later"]
    plain = [(100 + i, " ".join([*lead, *tail, "for the report on the rain and no more of it"])) for i in range(60)]
    near = [(i, f"{lead[i]} Jane Doe jane@x.example Quix {tail[i]} for the report") for i in range(5)]
    first = [(10 + i, f"Max Roe <roe@y.example> {tail[i]} for the report on rain") for i in range(5)]  # nothing before it
    copies = [(20 + i, "only Quixley Poe here wrote r@corp.example of rain") for i in range(9)]
    texts = dict(plain + near + first + copies)
    got = {r.doc_id: terms_in(texts[r.doc_id], r.spans) for r in pii.report(documents_of(list(texts.items()))).collect()}
    assert all(got[i] == ["Jane", "Doe", "Quix"] for i in range(5))
    assert all(got[10 + i] == ["Max", "Roe"] for i in range(5))
    assert not any(got[d] for d in got if d >= 20)


def test_terms_away_from_the_mention(documents_of, revealing):
    far = "the rain on the hills and no more " * 200
    more = [(200, f"é {far}Zorblatt of the report, ZORBLATT 1@zorblatt.example"), (None, "of zorblatt"), (None, "of zorblatt"), (201, far)]
    rows = [*revealing, *[(300 + i, d[1]) for i, d in enumerate(revealing[:60] * 40)], *more]
    df = documents_of(rows)
    got = {r.doc_id: r.spans for r in pii.report(df).collect() if r.doc_id is None or r.doc_id in (200, 201)}
    text = more[0][1]
    assert terms_in(text, got[200]) == ["Zorblatt", "ZORBLATT"] and terms_in("of zorblatt", got[None]) == ["zorblatt"] and not got[201]
    clean = [r.text for r in pii.sanitised(df).collect() if r.doc_id is None or r.doc_id == 200]
    assert len(clean) == 3 and not any("zorblatt" in t.lower() for t in clean)


@pytest.mark.parametrize("text", ["12 a " * 100_000, "write to user%d@mail.example.org now " * 20_000])
def test_long_texts_of_numbers_and_addresses(documents_of, text):
    """Time in proportion to the text: neither candidates nor spans are copied for each other."""
    import time

    if "%d" in text:
        text = text % tuple(range(20_000))
    began = time.perf_counter()
    rows = pii.sanitised(documents_of([(1, text)])).collect()
    got = reported(documents_of([(1, text)]))[0]
    assert time.perf_counter() - began < 60  # several jobs, two passes
    assert (got[1] == 20_000) == ("@" in text) and got[6].count("email") == got[1]
    assert rows[0].text.count("[EMAIL]") == got[1] and "mail.example" not in rows[0].text
