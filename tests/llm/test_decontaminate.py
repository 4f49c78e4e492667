import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from docweave.llm import decontaminate
from docweave.llm.decontaminate import EDIT_RATE, Q, Items, keep_unleaked, leaks, op9
from docweave.llm.queries import QUERIES


def normal(t):
    out = bytearray()
    for c in (t or "").encode():
        if c in b"\t\n\x0b\x0c\r ":
            if not out or out[-1] != 32:
                out.append(32)
        else:
            out += bytes([c]).lower()
    return bytes(out)


def distance(item, text):
    """Edits of the whole item against the best stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(rows, items):
    out = []
    for i, t in rows:
        found = []
        for k, x in items:
            n = len(normal(x))
            if n < Q:
                short = normal(x).strip()
                if short and re.search(rb"(?<![0-9A-Za-z\x80-\xff])" + re.escape(short) + rb"(?![0-9A-Za-z\x80-\xff])", normal(t)):
                    found.append((k, 0))
            else:
                d = distance(normal(x), normal(t))
                if d <= min(int(n * EDIT_RATE), (n - Q) // Q):
                    found.append((k, d))
        out.append((i, len(found), [k for k, _ in found], [d for _, d in found]))
    return sorted(out, key=str)


def cases(seed):
    rnd = random.Random(seed)
    letters = "abcdefgh éß"
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    items = [(k, text(rnd.choice([30, 45, 80, 120]))) for k in range(8)] + [(8, "short"), (9, None), (10, "")]
    items.append((11, items[0][1]))
    rows = [(0, None), (1, ""), (2, text(20))]
    for i in range(3, 40):
        k, x = rnd.choice(items[:8])
        x = list(x)
        for _ in range(rnd.randrange(0, 2 + len(x) // 8)):
            at = rnd.randrange(len(x))
            x[at:at + 1] = rnd.choice([[], [rnd.choice(letters)], [x[at], rnd.choice(letters)]]) or []
            x = x or ["a"]
        x = "".join(x)
        x = x.upper().replace(" ", "\n  ") if i % 5 == 0 else x
        rows.append((i, rnd.choice([text(60), ""]) + x + rnd.choice([text(90), ""])))
    return rows, items


@pytest.fixture
def bench(spark):
    return lambda items: spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(frame, bench, seed):
    rows, items = cases(seed)
    want = brute(rows, items)
    assert sum(r[1] for r in want) > 10
    assert sorted(map(tuple, op9(frame(rows), bench(items)).collect()), key=str) == want


def test_short_items(frame, bench):
    items = [(1, "short benchmark item"), (2, "Q: 42"), (3, "short"), (4, "  a\n"), (5, "née"), (6, "exactly8"), (7, " \t"), (8, "."), (9, "short")]
    rows = [(1, "see this short benchmark item here"), (2, "q:  42"), (3, "a shortcut"), (4, "ashort"), (5, "(short)"), (6, "xexactly8y"), (7, "née"), (8, "renée née"),
            (9, "short"), (10, "the end."), (11, "sho"), (12, "rt"), (13, None), (14, "short benchmark xtem")]
    assert sorted(map(tuple, op9(frame(rows, 1), bench(items)).collect()), key=str) == brute(rows, items)


def test_windows_lose_nothing(frame, bench, monkeypatch):
    rnd = random.Random(9)
    items = [(k, "".join(rnd.choice("abcdef gh") for _ in range(60))) for k in range(6)]
    rows = []
    for i in range(4):
        t = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
        for k, x in items[i:]:
            at = rnd.randrange(len(t))
            t = t[:at] + x[:30] + "z" + x[31:] + t[at:]
        rows.append((i, t))
    want = brute(rows, items)
    assert sum(r[1] for r in want) > 12
    monkeypatch.setattr(decontaminate, "WINDOW", 256)
    monkeypatch.setattr(decontaminate, "HITS", 500)
    got = Items([k for k, _ in items], [x for _, x in items]).matches(pa.array([t for _, t in rows]))
    assert sorted(zip(got[0].tolist(), got[1].tolist(), got[2].tolist())) == sorted((i, k, d) for i, _, ks, ds in want for k, d in zip(ks, ds))


def test_templated_items_and_a_long_text_in_bounded_memory():
    rnd = random.Random(2)
    head = "which of the following statements about the topic is true and why does it hold in general: "
    items = Items(list(range(100)), [head + "".join(rnd.choice("abcdefghij ") for _ in range(120)) for _ in range(100)])
    text = " ".join(head + "".join(rnd.choice("klmnop ") for _ in range(40)) for _ in range(600))
    tracemalloc.start()
    got = items.matches(pa.array([text + items.chars[17].tobytes().decode(), "nothing"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x.tolist() for x in got] == [[0], [17], [0]] and len(text) > 75_000 and peak < 500 << 20


def test_blocks_of_items(frame, bench, monkeypatch):
    rows, items = cases(3)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    monkeypatch.setattr(decontaminate, "BLOCKS_A_PASS", 3)
    assert sorted(map(tuple, op9(frame(rows), bench(items)).collect()), key=str) == brute(rows, items)


def test_odd_rows_and_columns(frame, bench, odd_rows):
    docs = frame(odd_rows)
    items = [(1, "this line is shared by very many documents of the table"), (2, "z" * 60), (3, "never there at all, in no text of this table")]
    out = leaks(docs, bench(items))
    assert out.columns == [*docs.columns, "_items", "_edits"] and out.count() == len(odd_rows)
    assert sorted((r.doc_id, r._items) for r in out.collect() if r._items) == [(7, [2]), *((i, [1]) for i in range(20, 40))]
    assert keep_unleaked(docs, bench(items)).count() == len(odd_rows) - 21


def test_empty(frame, bench):
    assert op9(frame([]), bench([(1, "a" * 50)])).collect() == []
    assert op9(frame([(1, "a" * 50)]), bench([])).collect()[0].n_items == 0


def test_registered(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: set(r.items) for r in QUERIES["op9_decontaminate"](spark, d).collect()}
    items = [(r.item_id, normal(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    rows = [(r.doc_id, normal(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    whole = {i: {k for k, x in items if x in t} for i, t in rows}
    assert got.keys() == whole.keys() and any(whole.values()) and all(whole[i] <= got[i] for i in got)
    assert not any(got[i] for i in got if not whole[i])
