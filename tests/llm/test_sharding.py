import zlib

import pytest

from docweave.llm.queries import QUERIES
from docweave.llm.sharding import find_splitters, op7, shard_documents, shard_rows


def check(rows, got, shards=24, slack=None):
    sizes = sorted((i is None, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id, r["size"], r.text_crc32) for r in got) == sizes
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert (r.law, r.grown_shard) == ("bytes", None)
    for s, part in by.items():
        assert 0 <= s < shards and sorted(r.slot for r in part) == list(range(len(part)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(shards):
        assert abs(sum(r["size"] for r in by.get(s, [])) - total / shards) <= 2 * largest if slack is None else slack


def test_sizes_slots_and_checksums(frame, odd_rows):
    check(odd_rows, op7(frame(odd_rows)).collect())


def test_a_third_of_all_rows_alike(frame):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 7)) for i in range(3000)]
    got = op7(frame(rows)).collect()
    check(rows, got)
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"same text")}) > 1


@pytest.mark.parametrize("doc_id", [77, None])
def test_repeated_rows_and_null_ids_are_dealt_out(frame, doc_id):
    rows = [(i, f"text {i} " * 20) for i in range(2000)] + [(doc_id, "one and the same row " * 9)] * 1000
    got = shard_documents(frame(rows)).collect()
    total, by = sum(r["size"] for r in got), {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert len(got) == 3000 and sorted(by) == list(range(24))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 24) <= 2 * max(r["size"] for r in got)
    if doc_id is None:
        nulls = [(None, f"text {i}") for i in range(3000)]
        assert len({r.shard for r in shard_documents(frame(nulls)).collect()}) == 24


def test_equal_texts_are_neighbours(frame):
    rows = [(i, f"text {i % 500}") for i in range(1500)]
    got = shard_documents(frame(rows), 4).collect()
    at = {}
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        at.setdefault(r.text_crc32, []).append((r.shard, r.slot))
    order = {k: i for i, k in enumerate((r.shard, r.slot) for r in sorted(got, key=lambda r: (r.shard, r.slot)))}
    assert all(order[v[-1]] - order[v[0]] == len(v) - 1 for v in at.values())


def test_splitters_are_refined_until_within_tolerance(frame):
    rows = shard_rows(frame([(i, "t" * (i % 50)) for i in range(2000)]))
    edges, number, cuts = find_splitters(rows, 3, 0.001, 100, fan_out=4, first_cells=2)
    assert int(number.sum()) == 2000 and number.max() <= 100 and edges == sorted(edges) and len(cuts) == 2


def test_empty(frame):
    assert op7(frame([])).collect() == []


def test_registered(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(rows, QUERIES["op7_sharding"](spark, d).collect())
