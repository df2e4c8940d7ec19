import random

from brute import pii_base, pii_hash
from loam.llm import pii

TRICKY = [
    None,
    "",
    "a@b.c_d@e.f and x@y then q.r@mail.example.com.",
    "a@b.c@d.e a@@b.c @x.y",
    "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 1.2.3",
    "\U0001f600 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111 12345678901234567890",
    "+1 (826) 555-4081 190.137.223.204 +12 34567 +1+2 +1 234567890123456789 +4930123456.",
    "card: 378282246310005 call 555-123-4567 (555) 123-4567, mail joe (at) example (dot) com",
    "4111111111111111" * 3 + " 4111111111111111",
]


def expected(text):
    spans = pii_base(text)
    return tuple(sum(k == kind for k, _, _ in spans) for kind in pii.KINDS), pii_hash(spans)


def check(df, texts):
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == expected(text), text
        all_spans = set(filter(None, r.spans.split(",")))
        assert {f"{k}:{a}:{b}" for k, a, b in pii_base(text)} <= all_spans


def test_base_rules_against_brute_force(docs):
    rng = random.Random(5)
    texts = TRICKY + ["".join(rng.choice("12345 .-+@a()é\n") for _ in range(rng.randrange(200))) for _ in range(300)]
    check(pii.find(docs(texts)), texts)


def test_very_long_texts(docs):
    texts = ["1 " * 60_000, "a" * 300_000 + "@", "a.b@c.d, " * 5_000, "9" * 200_000, "x@y" + ".z" * 50_000, "1.2.3.4 " * 3_000]
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.find(docs(texts)).collect()}
    assert got == {0: (0, 0, 0, 0), 1: (0, 0, 0, 0), 2: (5000, 0, 0, 0), 3: (0, 0, 0, 0), 4: (1, 0, 0, 0), 5: (0, 3000, 0, 0)}
    check(pii.find(docs([t[:3000] for t in texts])), [t[:3000] for t in texts])


def test_loose_candidates_are_judged(docs):
    texts = ["call me: phone 555-123-4567 today", "mail joe (at) example (dot) com now", "version 1234567890123 x"] + ["write to a.b@mail.example.com or call +1 (826) 555-4081"] * 20
    got = {r.doc_id: r.spans for r in pii.find(docs(texts)).collect()}
    assert got[0] == "phone:15:27" and got[1].startswith("email:5:") and got[2] == ""


def test_redaction(docs, spark):
    texts = ["x \U0001f600 a@b.com, 1.2.3.4 y", "none", None, "+1 (826) 555-4081 190.137.223.204 du", "4111 1111 1111 1111"]
    texts += ["call +1 (888) 555-6841 or write a.b@mail.example.com"] * 30
    df = docs(texts)
    out = pii.redact(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] == "x \U0001f600 <EMAIL>, <IP> y" and got[1] == "none" and got[2] is None
    assert got[3] == "<PHONE> <IP> du"
    assert got[4] == "<CARD>"
    assert pii.redact(df.limit(0)).count() == 0


def test_empty_extra_and_repeated(docs, spark):
    from pyspark.sql import functions as F

    assert pii.find(docs([])).count() == 0
    df = docs([(None, "a@b.com"), (1, "a@b.com"), (1, "a@b.com")]).withColumns({"spans": F.lit(1), "email": F.lit(2), "start": F.lit(3)})
    assert sorted((r.doc_id or 0, r.n_email) for r in pii.find(df).collect()) == [(0, 1), (1, 1), (1, 1)]
    assert pii.redact(df).columns == df.columns


def test_em_learns_which_labeler_to_trust():
    good, bad = ("phone", 1, 1, 1, 1, 1, 1, 1), ("phone", -1, -1, -1, -1, 1, 1, 0)
    model = pii.fit([(good, 500), (bad, 500), (("phone", 1, 1, 0, 1, 1, 1, 1), 300)])
    assert model.reliability[0, 1, 1] > 0.9 and model.reliability[0, 0, -1] > 0.9
    score = lambda p: sum(model.weights[k] * v for k, v in pii.features(p).items())
    assert score(good) > 1 > -1 > score(bad)
