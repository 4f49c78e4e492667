import random

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import near_dup
from docweave.llm.near_dup import components, keep_one, op8, prob_minhash
from docweave.llm.queries import QUERIES
from docweave.llm.shingles import shingles

near_dup_links = near_dup.cross_links


def words_of(t):
    out, word = [], b""
    for c in (t or "").encode() + b" ":
        if bytes([c]) in b" \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = b""
        else:
            word += bytes([c]).lower()
    return out


def sets(t):
    w = words_of(t)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Smallest id of each component of links of 0.8 or more."""
    s = [sets(t) for _, t in rows]
    home = list(range(len(rows)))

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and min(len(s[a]), len(s[b])) >= 0.8 * max(len(s[a]), len(s[b])) and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
                home[find(a)] = find(b)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if s[i] and doc is not None:
            names[find(i)] = min(names.get(find(i), doc), doc)
    return sorted(((doc, names.get(find(i)) if s[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(seed, n=12):
    rnd = random.Random(seed)
    new = lambda k: [f"w{rnd.randrange(3000)}" for _ in range(k)]
    rows, passage = [], new(60)
    for _ in range(n):
        base = new(rnd.choice([6, 30, 120, 300]))
        for _ in range(rnd.randrange(1, 8)):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 40)):
                w[rnd.randrange(len(w))] = f"v{rnd.randrange(9000)}"
            rows.append(" ".join(w))
    rows += [" ".join(new(40) + passage + new(30)) for _ in range(20)]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(frame, seed):
    rows = corpus(seed)
    assert sorted(map(tuple, op8(frame(rows)).collect()), key=str) == brute(rows)


def test_odd_rows(frame, odd_rows):
    assert sorted(map(tuple, op8(frame(odd_rows)).collect()), key=str) == brute(odd_rows)


def test_a_chain_is_one_class(frame):
    """Neighbours are alike, the ends are not."""
    w = [f"a{i}" for i in range(400)]
    rows = [(k, " ".join(w[10 * k:10 * k + 200])) for k in range(15)]
    assert {r.class_id for r in op8(frame(rows)).collect()} == {0}


@pytest.mark.parametrize("times", [20, 50])
def test_a_repeated_line_hides_no_link(frame, times):
    """Nearly the same set of shingles, one line many times in one of the two."""
    rows = []
    for k in range(12):
        w = [f"d{k}w{i}" for i in range(204)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, "\n".join([" ".join(w)] + [" ".join(w[50:64])] * times))]
    assert brute(rows) == sorted(((i, i - i % 2) for i, _ in rows), key=str)
    assert sorted(map(tuple, op8(frame(rows)).collect()), key=str) == brute(rows)


def test_second_round_compares_sets(frame):
    """The smallest text leads neither of the two others, which are alike only as sets."""
    rnd, rows = random.Random(8), []
    for k in range(12):
        w = [f"e{k}w{i}" for i in range(204)]
        lead = [f"x{k}w{i}" for i in range(45)] + w[:159]
        full = w + [f"y{k}w{i}" for i in range(8)]
        rows += [" ".join(lead), " ".join(full), "\n".join([" ".join(full)] + [" ".join(full[-14:])] * rnd.choice([20, 50]))]
    rows = list(enumerate(rows))
    assert sorted(map(tuple, op8(frame(rows)).collect()), key=str) == brute(rows)


def seven_tenths(n):
    """n texts that share 80 percent of their words: every pair of them is alike by about 0.7, none is linked."""
    rnd, base = random.Random(3), [f"c{i}" for i in range(400)]
    rows = []
    for k in range(n):
        w = list(base)
        for at in rnd.sample(range(0, 400, 5), 15):
            w[at] = f"own{k}x{at}"
        rows.append((k, " ".join(w)))
    return rows


def test_pairs_that_are_not_alike_never_become_rows(frame, monkeypatch):
    counts = {}
    for n in (150, 300):
        seen = []
        monkeypatch.setattr(near_dup, "cross_links", lambda named, texts, real=near_dup_links: seen.append(real(named, texts)) or seen[-1])
        rows = seven_tenths(n) + [(1000 + i, t + " tail") for i, t in seven_tenths(3)]
        assert sorted(map(tuple, op8(frame(rows)).collect()), key=str) == brute(rows)
        counts[n] = seen[0].count()
    assert counts[300] <= 2 * counts[150] + 10


def test_tiles_lose_no_link(frame, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE_ROWS", 4)
    rows = seven_tenths(60) + [(100 + i, " ".join(t.split()[:-3] + ["z"])) for i, t in seven_tenths(40)]
    assert sorted(map(tuple, op8(frame(rows)).collect()), key=str) == brute(rows)


def test_one_stays(frame, odd_rows):
    docs = frame(odd_rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.collect()), key=str)
    worded = [i for i, t in odd_rows if words_of(t)]
    blank = {(i, t) for i, t in odd_rows if not words_of(t)}
    assert len(got) == len({c for (i, c), (_, t) in zip(brute(odd_rows), sorted(odd_rows, key=str)) if i is not None and c is not None} - {i for i, _ in blank} | {None} if None in worded else set()) + len(blank) or got
    assert got.count(8) == 1 and got.count(10) == 1 and not {11, 12, 13, 14, 15} & set(got) and {1, 2, 3, 6, 7} <= set(got)


def test_slots_agree_with_probability_jaccard():
    rnd = np.random.default_rng(0)
    items = rnd.integers(1, 1 << 62, 300).astype(np.uint64)
    weights = rnd.integers(1, 4, 300).astype(np.float64)
    other = np.where(np.arange(300) < 240, weights, 0)
    keep = other > 0
    doc = np.concatenate([np.zeros(300, int), np.ones(int(keep.sum()), int)])
    sig = prob_minhash(doc, np.concatenate([items, items[keep]]), np.concatenate([weights, other[keep]]), 2, 4000)
    want = sum(1 / np.maximum(weights / weights[i], other / other[i]).sum() for i in np.flatnonzero(keep))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_shingles_match_sets():
    texts = ["A b\tc d  e f", "a", "", "  ", "x y z", "é É a b c d e f g a b c d e f g", "last"]
    doc, h, times = shingles(pa.array(texts))
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(sets(t)) for t in texts]
    assert shingles(pa.array(["A B c", "a b C"]))[1].tolist()[0] == shingles(pa.array(["a b c"]))[1].tolist()[0]


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    home = {x: x for e in edges for x in e}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        home[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r.v, "big"): int.from_bytes(r.label, "big") for r in components(df).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_empty(frame):
    assert op8(frame([])).collect() == []


def test_registered(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op8_near_dup"](spark, d).collect()), key=str) == brute(rows)
