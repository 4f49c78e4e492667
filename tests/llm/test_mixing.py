import re

import numpy as np
import pytest

from docweave.llm.mixing import _key, draw, mix_sources, n_slots, op11, permuted, shard_counts, slots
from docweave.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string, size int, rank long, row string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def wanted(rows):
    """Targets by the plain rule: share by weight, stop at three sizes, share the excess again."""
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    target, free, left = {}, set(size), float(sum(size.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over} if over else {s: left * weight[s] / w for s in free}
        left -= sum(3.0 * size[s] for s in over)
        free = free - over if over else set()
    return size, target


def frame_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, s, 1, 2, "x") for i, t, s in rows], SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


def check(rows, got):
    size, target = wanted(rows)
    sources = {}
    for i, t, s in rows:
        sources.setdefault((i is None, i, len(words(t))), []).append(s)
    assert sorted((r.doc_id is None, r.doc_id, r["size"]) for r in got) == sorted((i is None, i, len(words(t))) for i, t, _ in rows)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        options = {s for s in sources[(r.doc_id is None, r.doc_id, r["size"])] if r.source_size == size[s] and abs(r.target - target[s]) <= 1e-9 * (1 + target[s])}
        assert options
        taken[(r.source_size, round(r.target, 6))] = taken.get((r.source_size, round(r.target, 6)), 0) + r.taken
    for key, n in taken.items():  # sources alike in size and target are added up
        alike = [s for s in size if (size[s], round(target[s], 6)) == key]
        assert abs(n - sum(target[s] for s in alike)) <= 0.5 * len(alike) + 1e-6


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(3)
    out = [(i, " ".join("w" * int(x) for x in rnd.integers(1, 6, int(rnd.integers(0, 90)))), "hot" if i % 3 else f"s{i % 11}") for i in range(900)]
    out += [(None, "a b\tc\x0bd\x1ce f", None), (None, None, None), (5, "same row", "s1"), (5, "same row", "s1"), (5, None, "s1"),
            (901, "", "empty"), (902, None, "empty"), (903, "one", "tiny"), (904, "x " * 60_000, "long"), (905, " \n ", "été"), (906, "é ß 日本", "日本")]
    return out


def test_targets_sizes_and_words(spark, rows):
    check(rows, op11(frame_of(spark, rows)).collect())


def test_reruns_agree_however_rows_are_dealt(spark, rows):
    got = [sorted(map(str, op11(frame_of(spark, rows, n)).collect())) for n in (2, 5)]
    assert got[0] == got[1]


def test_blocks_hold_what_is_counted(spark, rows):
    m = mix_sources(frame_of(spark, rows), block_words=16, shard_blocks=50, keep_text=True)
    blocks, taken = m.blocks().collect(), {r.row: r.taken for r in m.taken().collect()}
    assert sum(taken.values()) == sum(r.n_words for r in blocks) == sum(len(words(r.text)) for r in blocks)
    by = {}
    for r in blocks:
        by.setdefault(r.shard, []).append(r.slot)
        assert len(words(r.text)) == r.n_words <= 16
    assert all(sorted(x) == list(range(len(x))) for x in by.values())  # each slot of a shard once
    assert sorted(by) == list(range(len(by))) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    stream = {}
    for r in sorted(m.rows.collect(), key=lambda r: (r.id is not None, r.id, r._tk, r.row)):
        stream.setdefault(r.source, []).extend(words(r.text))
    for r in blocks:
        assert words(r.text) == stream[r.source][r.block * 16:][:r.n_words]


def test_more_sources_than_a_task_draws_from(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 700:03d}") for i in range(2100)]
    check(rows, op11(frame_of(spark, rows)).collect())


def test_draws_are_exact_and_vary():
    quotas, sizes = np.array([500, 0, 30, 1, 469]), np.array([100] * 10)
    got = draw(quotas, sizes, np.random.default_rng(1))
    assert got.sum(0).tolist() == quotas.tolist() and got.sum(1).tolist() == sizes.tolist()
    assert len(set(got[:, 0])) > 3


def test_permutations_and_their_inverse():
    for n in (1, 2, 3, 10, 257, 4097):
        p = permuted(np.arange(n), n, 12345)
        assert sorted(p.tolist()) == list(range(n))
        assert permuted(p, n, 12345, back=True).tolist() == list(range(n))
    assert permuted(np.arange(500), 500, 1).tolist() != permuted(np.arange(500), 500, 2).tolist()


def test_slots_reach_the_quota_and_no_more(spark):
    for size in (1, 15, 16, 17, 100):
        for quota in {1, size // 2 + 1, size, size + 1, 2 * size, 3 * size - 1, 3 * size}:
            n = n_slots(size, quota, 16, 7, 3)
            blocks = -(-size // 16)
            w = [16] * (blocks - 1) + [size - 16 * (blocks - 1)]
            seq = [w[int(permuted(np.array([k % blocks]), blocks, _key(7, 3, k // blocks))[0])] for k in range(n)]
            assert sum(seq[:-1]) < quota <= sum(seq)
    src = spark.createDataFrame([("a", 100, 0, 250.0, 250, n_slots(100, 250, 16, 7, 0))], "source string, size long, rank long, target double, quota long, slots long")
    total = n_slots(100, 250, 16, 7, 0)
    got = slots(src, shard_counts(src, 4, 7), total, 16, 4, 7).collect()
    assert sum(r.words for r in got) == 250 and len({(r.shard, r.slot) for r in got}) == total


def test_empty(spark):
    assert op11(frame_of(spark, [])).collect() == []
    assert [r.taken for r in op11(frame_of(spark, [(1, None, None), (2, " ", "a")])).collect()] == [0, 0]


def test_registered(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(rows, QUERIES["op11_mixing"](spark, d).collect())
