import hashlib
import random

import numpy as np
import pytest

from docweave.llm import repeats
from docweave.llm.repeats import WINDOW, dedup_substrings, later_windows, op1
from docweave.llm.queries import QUERIES


def brute(rows):
    """Rows that share an id are one document; null ids come first."""
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        for s in range(len(raw) - WINDOW + 1):
            w, place = raw[s:s + WINDOW], (i is not None, i or 0, s)
            first[w] = min(first.get(w, place), place)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - WINDOW + 1):
            if first[raw[s:s + WINDOW]] < (i is not None, i or 0, s):
                gone[s:s + WINDOW] = True
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice("abcdeé \n") for _ in range(k))
    passages = [text(rnd.choice([95, 99, 100, 101, 140, 250, 600])) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [text(rnd.randrange(0, 200))]
        for _ in range(rnd.randrange(0, 4)):
            p = rnd.choice(passages)
            if rnd.random() < 0.3:
                p = p[rnd.randrange(20):]
            if rnd.random() < 0.2:
                at = rnd.randrange(len(p))
                p = p[:at] + "X" + p[at:]
            parts += [p, text(rnd.randrange(0, 60))]
        rows.append((i, "".join(parts)))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (n + 3, "ab" * 300), (n + 4, "c" * 99), (n + 5, "c" * 100), (n + 6, "c" * 150), (n + 7, rows[5][1] * 3)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(frame, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert sum(r[2] for r in want) > 1000
    assert rows_of(op1(frame(rows))) == want


@pytest.mark.parametrize("seed", [4, 5])
def test_window_by_window_and_in_bundles(frame, seed, monkeypatch):
    """Every anchor of several contexts is hot; then small bundles and segments."""
    rows = corpus(seed, 40)
    monkeypatch.setattr(repeats, "hot_anchors", lambda keyed, n: np.array(sorted({r.anchor % (1 << 64) for r in keyed.mapInArrow(
        lambda bs: (repeats.pa.RecordBatch.from_arrays([repeats.pa.array(repeats.context_rows(b)["anchor"].astype(np.uint64).view(np.int64))], ["anchor"])
                    for b in bs), "anchor long").distinct().collect()}), np.uint64))
    assert rows_of(op1(frame(rows))) == brute(rows)


def test_many_contexts_of_one_anchor(frame):
    rnd = random.Random(8)
    line = "a passage of this table that is longer than one hundred bytes, which many documents hold between other texts of theirs"
    text = lambda k: "".join(rnd.choice("abcdefg ") for _ in range(k))
    rows = [(i, text(80) + line + text(80)) for i in range(300)]
    assert rows_of(op1(frame(rows))) == brute(rows)


def test_odd_rows(frame, odd_rows):
    rows = [r for r in odd_rows if r[0] != 6] + [(6, odd_rows[10][1][:20_000])]
    assert rows_of(op1(frame(rows))) == brute(rows)


def test_segments(monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    rnd = random.Random(2)
    raw = "".join(rnd.choice("ab ") for _ in range(2000)).encode()
    off = np.array([0, 50, 700, 700, 1500, 2000])
    text, start, size, _ = repeats.contexts(np.frombuffer(raw, np.uint8), off)
    got = sorted(s + k for s, n in zip(start.tolist(), size.tolist()) for k in range(n - WINDOW + 1))
    assert got == [s for a, b in zip(off, off[1:]) for s in range(a, b - WINDOW + 1)]
    assert all(off[t] <= s and s + n <= off[t + 1] for t, s, n in zip(text, start, size))


def test_index_marks_later_windows():
    rnd = random.Random(6)
    parts = ["".join(rnd.choice("ab") for _ in range(130)) for _ in range(4)]
    texts = [parts[0], parts[1] + parts[0], parts[2], parts[0][5:] + parts[3], "a" * 250, parts[2]]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    got = set(later_windows(buf, off, np.arange(len(buf))).tolist())
    seen, want = set(), set()
    for a, b in zip(off, off[1:]):
        for s in range(a, b - WINDOW + 1):
            w = buf[s:s + WINDOW].tobytes()
            (want.add(s) if w in seen else seen.add(w))
    assert got == want


def test_spans(frame):
    p = "0123456789" * 10 + "end of it"
    got = {r.id: r for r in dedup_substrings(frame([(1, p), (2, "x" + p + "y")])).collect()}
    assert got[1].spans == [] and [tuple(s) for s in got[2].spans] == [(1, 110)] and bytes(got[2].kept) == b"xy"


def test_empty(frame):
    assert op1(frame([])).collect() == []


def test_registered(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert rows_of(QUERIES["op1_repeats"](spark, d)) == brute(rows)


def test_memory_of_a_task_is_bounded():
    """Hashes of 4 MB of text, and the settling of 1 MB of contexts, hold less than 64 MB at a time."""
    import tracemalloc

    import numpy as np

    from docweave.llm.repeats import MARK, contexts, settle
    rnd = np.random.default_rng(1)
    buf = rnd.integers(97, 123, 4 << 20).astype(np.uint8)
    rows = np.zeros(8_000, np.dtype([*MARK.descr, ("at", "<i8")]))
    rows["doc"], rows["len"], rows["anchor"], rows["at"] = np.arange(8_000), 130, np.arange(8_000) // 2, np.arange(8_000) * 130
    tracemalloc.start()
    try:
        contexts(buf, np.array([0, len(buf)]))
        first = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        settle(rows, buf)
        second = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert first < 64 << 20 and second < 64 << 20, (first >> 20, second >> 20)
