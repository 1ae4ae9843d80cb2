import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framesieve.llm import pii, queries, tagger

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def slow(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-1234567890 +()é", max_size=60))
def test_patterns(text):
    assert pii.base_spans(text) == slow(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 50_000):
        pii.base_spans(text)


def test_gradient():
    model = tagger.Tagger(["a", "b"], 3)
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, 100, (2, 6)), np.array([[0, 1, 2, 0, 3, 4], [3, 4, 4, 0, 0, 1]])
    _, grad = model._loss(ids, tags)
    for name, value in model.p.items():
        at = np.unravel_index(np.argmax(np.abs(grad[name])), value.shape)
        value[at] += 1e-5
        high, _ = model._loss(ids, tags)
        value[at] -= 2e-5
        low, _ = model._loss(ids, tags)
        value[at] += 1e-5
        assert abs((high - low) / 2e-5 - grad[name][at]) < 1e-5


def test_query(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.op3_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = slow(texts[r.doc_id])
        named = [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, _, k in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r.spans.split(",") if r.spans else [])


def test_model_finds_what_patterns_miss(spark, sf):
    """Data in other forms, and secrets, in texts that the model has not seen."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    model = pii.train(docs)
    assert model.losses[-1] < 0.2 * model.losses[0]
    shown = "a.0@mail.example.com|jo-x@site.org|10.20.30.40|172.31.4.255|4111 1111 1111 1111|4012888888881881|+1 (743) 555-3824|+44 20 7946 0958"
    kinds, rng = [0, 0, 1, 1, 2, 2, 3, 3], np.random.default_rng(99)
    texts, want = [], []
    for i in range(400):
        kind = i % 5
        if kind == 4:
            piece, a, b = pii.secret(rng)
        else:
            value = [v for v, k in zip(shown.split("|"), kinds) if k == kind][int(rng.integers(2))]
            piece = pii.other_form(value, kind, rng)
            a, b = 0, len(piece)
        lead = "Theron ered onthe in 1984, thash edea "
        texts.append(f"{lead}{piece} onre of the then. Onth ehi 12 thonst.")
        want.append((len(lead) + a, len(lead) + b, kind))
    hit, missed_by_base = [[] for _ in range(5)], 0
    extra = 0
    for (base, spans), gold in zip(pii.all_spans(model, texts), want):
        missed_by_base += gold not in base
        hit[gold[2]].append(any(s[2] == gold[2] and abs(s[0] - gold[0]) < 2 and abs(s[1] - gold[1]) < 2 for s in spans))
        extra += sum(min(s[1], gold[1]) <= max(s[0], gold[0]) for s in spans)
    recall = [float(np.mean(h)) for h in hit]
    assert missed_by_base > 300
    assert np.mean(recall) > 0.7 and recall[4] > 0.8, recall
    assert extra < 8


def test_labels_stand_where_they_say():
    rng = np.random.default_rng(1)
    text = "ask a.b@c.de or call +1 (743) 555-3824, paid with 4111 1111 1111 1111 from 10.20.30.40 on a day like this"
    for _ in range(50):
        for made, spans in pii.labelled(text, rng):
            assert all(pii._fits(made[a:b], kind) for a, b, kind in spans), (made, spans)
            assert sum(kind < 4 for _, _, kind in spans) == 4


def test_secrets_in_the_given_texts(spark, sf):
    """Tokens of the given documents are found, texts without personal data are left alone."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    token = re.compile('token = "([0-9a-f]{40})"')
    rows = {r.doc_id: r.n_secret for r in queries.op3_pii(spark, sf.replace("0.001", "0.01")).collect()}
    with_token = [i for i, t in texts.items() if token.search(t)]
    assert np.mean([rows[i] > 0 for i in with_token]) > 0.9
    assert np.mean([rows[i] > 0 for i in texts if i not in with_token]) < 0.01


def test_odd_rows(spark, odd_docs):
    extra = spark.createDataFrame(
        [(9, "mail a.b@c.de now", "x"), (10, "1" * 5000 + " x@" * 100, "y")], odd_docs.schema
    )
    docs = odd_docs.union(extra)
    model = pii.train(docs)
    got = pii.find(docs, model)
    assert got.count() == docs.count()
    out = pii.redacted(docs, model)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[9] == "mail <EMAIL> now" and texts[2] is None and texts[3] == ""
    assert pii.find(docs.limit(0), model).collect() == []
