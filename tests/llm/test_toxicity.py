import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm.queries import QUERIES
from docweave.llm.toxicity import BITS, features, fit, keep_clean, op5, score_documents, train, word_features


def made(n=1500, seed=1):
    rnd = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(300)], ["nasty", "vilest", "vilely"]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(rnd.randrange(5, 120))]
        toxic = rnd.random() < 0.12
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad) + rnd.choice(["", ",", "."]))
        rows.append((i, " ".join(w)))
        if rnd.random() < 0.5:
            labels.append((i, int(toxic), int(toxic)))
    return rows, labels


@pytest.fixture
def label_frame(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


def test_held_out_accuracy(frame, label_frame):
    rows, labels = made()
    got = {r.doc_id: r for r in op5(frame(rows), label_frame(labels)).collect()}
    assert len(got) == len(rows)
    truth = {i: any(x.startswith(("nasty", "vile")) for x in t.split()) for i, t in rows}
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if fold(i) == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_labels_of_fold_0_are_not_used(frame, label_frame):
    rows, labels = made(400)
    a, b = (fit(frame(rows), label_frame(x)) for x in (labels, [(i, 1 - t if fold(i) == 0 else t, q) for i, t, q in labels]))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_only_confirmed_positives_are_used(frame, label_frame):
    """Which documents are labelled negative doesn't matter, only how many: other documents take their label."""
    rows, labels = made(400)
    zeros = [x for x in labels if x[1] == 0 and fold(x[0]) != 0]
    named = {x[0] for x in labels}
    others = [i for i, _ in rows if i not in named and fold(i) != 0][:len(zeros)]
    rest = [x for x in labels if x not in zeros]
    swapped = rest + [(i, 0, 1) for i in others] + zeros[len(others):]
    assert len(others) > 50 and {x[0] for x in swapped} != named
    a, b = (fit(frame(rows), label_frame(x)) for x in (labels, swapped))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]
    fewer = fit(frame(rows), label_frame([x for x in labels if x[1] == 0 or x[0] % 2]))
    assert not np.array_equal(a[0], fewer[0])


def test_scores_against_plain(frame, label_frame, odd_rows):
    """A score is the sigmoid of the bias and the weights of a text's distinct features."""
    rows, labels = made(300)
    weights, bias = fit(frame(rows), label_frame(labels))
    docs = rows[:40] + [r for r in odd_rows if len(r[1] or "") < 5000]
    got = sorted((str(r.doc_id), r.text or "", r._score) for r in score_documents(frame(docs), (weights, bias)).collect())
    small = weights.astype(np.float32).astype(float)
    want = []
    for i, t in docs:
        feats = sorted({f for w in (t or "").lower().split() for f in word_features(w)})
        want.append((str(i), t or "", 1 / (1 + np.exp(-(small[feats].sum() + bias)))))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, sorted(want))) < 1e-4


def test_the_risk_stays_non_negative():
    """With a flexible model and few rows, calling all positives among the unlabelled negative must not win."""
    rnd = np.random.default_rng(0)
    pos = [np.unique(np.append(rnd.integers(0, 1000, 20), 5000)) for _ in range(40)]
    unl = [np.unique(np.append(rnd.integers(0, 1000, 20), 5000 if k < 30 else 6000)) for k in range(100)]
    w, b = train(pos, unl, 0.3)
    assert w[5000] > 0 >= w[6000] and w.shape == (1 << BITS,)


def test_features_against_plain():
    texts = ["Nasty, vile  words\nnasty WORDS ...", None, "", "été Été"]
    feats, counts = features(pa.array(texts))
    for t, got in zip(texts, np.split(feats, np.cumsum(counts)[:-1])):
        assert set(got.tolist()) == {f for w in (t or "").lower().split() for f in word_features(w)}


def test_odd_rows(frame, label_frame, odd_rows):
    docs = frame(odd_rows)
    got = op5(docs, label_frame([(10, 1, 0), (None, 1, 1), (11, None, 0), (12, 0, 1), (999, 1, 1)])).collect()
    assert len(got) == len(odd_rows) and all(r.score is not None for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    for labels in ([], [(10, 1, 1)]):
        out = score_documents(docs, fit(docs, label_frame(labels)))
        assert out.columns == [*docs.columns, "_score"] and out.count() == len(odd_rows)
    assert keep_clean(docs, label_frame([])).columns == docs.columns


def test_empty(frame, label_frame):
    assert op5(frame([]), label_frame([])).collect() == []


def test_registered(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    held = [(got[i], t) for i, t in labels.items() if i in got and got[i].held_out and t is not None]
    bad, good = [r for r, t in held if t == 1], [r for r, t in held if t == 0]
    # six held-out toxic documents at this size, of which four are caught; "never toxic" would catch none
    assert np.mean([r.predicted for r in bad]) >= 0.6 and np.mean([r.predicted for r in good]) <= 0.05
    assert np.mean([(a.score > b.score) + (a.score == b.score) / 2 for a in bad for b in good]) > 0.85
