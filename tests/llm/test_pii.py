import random
import re
import time

import pytest

from churnscope.llm import pii as P

from .helpers import sha

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    check = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in P.CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and check(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in P.PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_of_random_texts():
    rnd = random.Random(1)
    for chars in ("a.@-+1234 ()b%_", "0123456789 -.", "+0123() .-x", "12."):
        for _ in range(4000):
            s = "".join(rnd.choice(chars) for _ in range(rnd.randint(0, 40)))
            assert P.base_spans(s) == brute(s)


@pytest.fixture(scope="module")
def model(spark):
    return P.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_model_adds_rewritten_forms(model):
    assert set(model) == set(P.KINDS)
    found = lambda s: [(k, s[a:b]) for k, a, b in P.all_spans(s, model)[1]]
    assert found("call me at (212) 555-0187 now") == [("phone", "(212) 555-0187")]
    assert found("my card 4111-1111-1111-1111.") == [("card", "4111-1111-1111-1111")]
    assert found("Version 3.2.1 of 2020-10-11") == []


def test_base_spans_stay_and_rows(spark, model):
    texts = ["mail a.b@c.de or +49 (30) 1234-567", None, "", "no data here", "ip 10.0.0.1 and 300.1.1.1", "7" * 4000,
             "x " * 50000 + "q@w.er", "a@b.c", "a@b.c"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_ip int")
    rows = {r.doc_id: r.pii for r in P.with_spans(df, model).select("doc_id", "pii").collect()}
    for i, t in enumerate(texts):
        base = brute(t or "")
        assert rows[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [rows[i][f"n_{k}"] for k in P.KINDS] == [sum(x[0] == k for x in base) for k in P.KINDS]
        every = [tuple(x.split(":")) for x in rows[i].spans.split(",") if x]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(every)
    assert rows[0].redacted == "mail [email] or [phone]"


def test_trees_learn_an_interaction():
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    m = P.fit_trees(x, y)
    assert ((P.tree_scores(m, x) > 0) == y).mean() > 0.95


def test_without_examples(spark):
    df = spark.createDataFrame([(1, "plain words")], "doc_id long, text string")
    assert P.fit(df) == {} and P.fit(df.limit(0)) == {}
    assert P.with_spans(df.limit(0), {}).collect() == []


def test_redaction_of_overlapping_spans():
    assert P.redact("abcdefgh", [("card", 1, 4), ("phone", 2, 6)]) == "a[card]gh"


def test_numbers_beside_numbers(model):
    found = lambda s: [(k, s[a:b]) for k, a, b in P.all_spans(s, model)[1]]
    assert ("phone", "+1 (826) 555-4081") in found("call +1 (826) 555-4081 190.137.223.204")
    assert ("ip", "190.137.223.204") in found("call +1 (826) 555-4081 190.137.223.204")
    assert ("card", "4111 1111 1111 1111") in found("card 4111 1111 1111 1111 2027")


def test_candidates_overlap_and_cover_groups():
    got = {s for s in ((k, "12 345 6789 0123456"[a:b]) for k, a, b in P.candidates("12 345 6789 0123456"))}
    assert got == {("phone", "12 345 6789"), ("phone", "345 6789"), ("phone", "345 6789 0123456"), ("card", "345 6789 0123456"),
                   ("phone", "0123456"), ("phone", "6789 0123456"), ("card", "12 345 6789 0123456")}


def planted(rnd):
    """(text, kind, string) of forms the base patterns do not find."""
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    kind = rnd.choice(["phone", "card", "email"])
    if kind == "phone":
        s = rnd.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
        return f"please call me at {s} or phone later", kind, s
    if kind == "card":
        body = "4" + digits(14)
        body += next(c for c in "0123456789" if P.luhn(body + c))
        s = "-".join(body[i:i + 4] for i in range(0, 16, 4))
        return f"paid by credit card {s.replace('-', ' ')} 20{digits(2)} thanks", kind, s.replace("-", " ")
    s = f"{rnd.choice(['ann', 'bob.r', 'kim'])}{digits(2)} at {rnd.choice(['post', 'mail', 'site'])} dot {rnd.choice(['org', 'net'])}"
    return f"write an email to {s} any time", kind, s


def test_recall_of_planted_forms(model):
    rnd = random.Random(9)
    hits = {}
    for _ in range(600):
        text, kind, s = planted(rnd)
        at = text.index(s)
        spans = P.all_spans(text, model)[1]
        hits.setdefault(kind, []).append(any(k == kind and min(b, at + len(s)) - max(a, at) >= 0.8 * len(s) for k, a, b in spans))
    recall = {k: sum(v) / len(v) for k, v in hits.items()}
    assert min(recall.values()) >= 0.9, recall


@pytest.mark.parametrize("text", ["7" * 1_000_000, "ab" * 500_000 + " x@y.z", "1." * 80_000, "+1 " * 300_000, "a@" * 500_000,
                                  "1 2 3 " * 40_000, "aaaa at bbbb " * 80_000])
def test_long_texts_of_one_kind_take_linear_time(text):
    begin = time.perf_counter()
    P.base_spans(text)
    P.candidates(text)
    assert time.perf_counter() - begin < 4
