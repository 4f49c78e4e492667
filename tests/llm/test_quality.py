import re

import oracle

from docweave.llm.quality import cascade_order, judge, measure, op3, rules, verdict


def brute(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    hit = {p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


TEXTS = ["a b c a b c", "a a a a a", "a a a", "x y z x y", "1 2 3 4 1 2 3 9 1 2 3 4", "#* $%&|<> é日 \x0b\x0c\r q", "l\nl\n \nl \nl", "a b c d " * 60, " ".join(map(str, range(200))),
         " ".join(map(str, range(200))) + " 1 2 3", "    x"]


def test_brute_force(frame, odd_rows):
    rows = list(enumerate(TEXTS, 1000)) + odd_rows
    got = sorted((tuple(r)[:7] for r in op3(frame(rows)).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_verdict_does_not_depend_on_the_order(frame, odd_rows):
    rows = odd_rows + [(500, "word " * 60), (501, "%% && " * 60), (502, "12345 9876 " * 40), (503, " ".join(f"clean{i}" for i in range(80)))]
    docs = frame(rows)
    a, b = ({(r.id, r.rejected_by is None) for r in judge(docs, seconds=cost).collect()}
            for cost in ({k: 1.0 for k in rules()}, {k: 1.0 / (i + 1) ** 4 for i, k in enumerate(rules())}))
    assert a == b and (503, True) in a and not {(500, True), (501, True), (502, True)} & a


def test_order_is_rejections_per_cost(frame):
    rows = [(i, "%%%% " * 80) for i in range(50)] + [(i, " ".join(f"w{j}x{i}" for j in range(90))) for i in range(50, 100)]
    m = measure(frame(rows))
    failed = {k: rules()[k] for k in ("long_word", "symbols", "few_distinct")}
    assert cascade_order(m, failed, seconds={"long_word": 1.0, "symbols": 2.0, "few_distinct": 1.0}) == ["few_distinct", "symbols", "long_word"]
    assert cascade_order(m, failed, seconds={"long_word": 1.0, "symbols": 1.0, "few_distinct": 9.0}) == ["symbols", "few_distinct", "long_word"]


def test_later_rules_are_not_reached(frame):
    """A rule behind one that rejects is not evaluated: it would fail the job."""
    from pyspark.sql import functions as F
    m = measure(frame([(1, "one " * 60)]))
    bad = F.raise_error(F.lit("reached")).cast("boolean")
    assert m.select(verdict(["first", "second"], {"first": F.col("n_words") > 0, "second": bad}).alias("v")).first().v is not None


def test_empty(frame):
    assert op3(frame([])).collect() == []


def test_oracle(spark):
    oracle.same(spark, "op3_quality", "/root/testdata/sf0.001")
