import hashlib

import oracle
import pytest

from docweave.llm.line_dedup import BLANK, dedup_lines, keep_bitmaps, op4

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    key = lambda x: x.strip(BLANK).translate(LOWER)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    top = {k: max(v, key=lambda i: (i is not None, i)) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_brute_force(frame, odd_rows):
    assert rows_of(op4(frame(odd_rows))) == brute(odd_rows)


@pytest.mark.parametrize("parts", ["1", "5", "16"])
def test_keys_across_task_borders(spark, frame, parts):
    common = ["a line that every document of this table holds", "Another Line of more than twenty signs", "ÄÖÜ äöü ÄÖÜ äöü ÄÖÜ äöü"]
    rows = [(i, "\n".join(common[: 1 + i % 3] + [f"own line number {i} of its own", common[0]])) for i in range(60)]
    rows += [(70, "twice in one document only\ntwice in one document only"), (71, "Twice in one document only")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert rows_of(op4(frame(rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bitmaps_and_columns(frame, odd_rows):
    docs = frame(odd_rows)
    maps = keep_bitmaps(docs).collect()
    assert maps and all(len(m.keep) < 200 for m in maps)
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped", "_kept_sha256"] and out.count() == len(odd_rows)


def test_clashing_columns(spark):
    line = "a line that is long enough to be shared"
    docs = spark.createDataFrame([(i, line, True, [1], "x", 2) for i in range(4)],
                                 "doc_id long, text string, keep boolean, places array<int>, label string, n_lines int")
    out = dedup_lines(docs)
    assert sorted((r.doc_id, r.text, r.keep, r._n_dropped) for r in out.collect()) == [(0, "", True, 1), (1, "", True, 1), (2, "", True, 1), (3, line, True, 0)]


def test_empty(frame):
    assert op4(frame([])).collect() == []


def test_oracle(spark):
    oracle.same(spark, "op4_line_dedup", "/root/testdata/sf0.001")
