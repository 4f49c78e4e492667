import random
import re

from pyspark.sql import functions as F

from docweave.operators import chunking as CH
from docweave.plans import fixtures as FX

from locations import SF_SMALL


def test_pack_text_invariants():
    text = ("Alpha beta gamma. " * 300 + "\n\n" + "line one\nline two\n" * 200 + "\n\n" + "x" * 5000)
    chunks = CH.pack_text(text, 100)
    assert all(CH.approx_tokens(c) <= 100 for c in chunks)
    assert re.sub(r"\s+", "", "".join(chunks)) == re.sub(r"\s+", "", text)   # no character lost, order kept


def test_pick_three_positions(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(25)),)], "t string")
    r = df.select(CH.pick_three_window(F.col("t"), 10).alias("p")).first()["p"]
    assert (r["n_chunks"], r["first"].split()[0], r["mid"].split()[0], r["last"].split()[0]) == (3, "w0", "w10", "w20")
    df2 = spark.createDataFrame([("a b c",)], "t string")
    r2 = df2.select(CH.pick_three_window(F.col("t"), 10).alias("p")).first()["p"]
    assert r2["first"] == r2["mid"] == r2["last"] == "a b c"


def test_decode_limited_agrees_with_python(spark):
    for n in range(290, 310):
        d = FX.table(spark, SF_SMALL, "documents").select(F.substring(F.encode("text", "UTF-8"), 1, n).alias("b"))
        assert all(r.t == bytes(r.b).decode("utf-8", "replace") for r in d.select("b", CH.decode_lossy("b").alias("t")).collect())


def test_chunks_are_of_the_whole_text(spark, tmp_path):
    """A text of over 2,000,000 bytes: its middle and last chunk in the registered queries."""
    from docweave.plans.queries import REGISTRY
    from docweave.plans.q_chunks import WORDS
    words = [f"w{i}" for i in range(350_000)]
    n = -(-len(words) // WORDS)
    want = [" ".join(words[i * WORDS:(i + 1) * WORDS]) for i in (0, n // 2, n - 1)]
    rows = [(i, "web", "en", t) for i, t in enumerate(["readme", "other", *[" ".join(words)] * 9])]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = [x for x in REGISTRY["file_metrics"][0](spark, str(tmp_path)).collect() if x["chunk1_bytes"] > 100]
    assert [(x["chunk1_bytes"], x["chunk2_bytes"], x["chunk3_bytes"]) for x in r] == [tuple(len(c) for c in want)] * 9
    f = [x for x in REGISTRY["prompt_fields"][0](spark, str(tmp_path)).collect() if "w1 " in x["chunk_one"]]
    assert {(x["chunk_two"].strip(), x["chunk_three"].strip()) for x in f} == {tuple(want[1:])}


def test_edge_cases(spark):
    df = spark.createDataFrame([("   \n", True), ("", True), ("words here", False)], "t string, x boolean")
    rows = df.select(CH.chunk_triple(F.col("t"), F.col("x"), F.lit("text")).alias("c")).collect()
    assert [r["c"]["used"] for r in rows] == ["empty", "empty", "binary"]
    assert rows[2]["c"]["first"] == "[[binary content suppressed]]"


def test_chunks_are_bounded_by_bytes(spark):
    """Without spaces too: base64, minified code and CJK text; no chunk over 4 bytes a token."""
    texts = ["QUJD" * 100_000, "var a=function(b){return b[0].c&&d(e)};" * 5000, "日本語の文章" * 30_000, "a  \n\n  b " * 20_000, "é" * 9]
    for t in texts:
        chunks = CH.pack_text(t, 1000)
        assert max(len(c.encode()) for c in chunks) <= 4000
        assert re.sub(r"\s+", "", "".join(chunks)) == re.sub(r"\s+", "", t)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(CH.pick_three_window(F.col("t")).alias("p")).collect():
        assert all(len(c) <= CH.DEFAULT_WINDOW_WORDS * (CH.MAX_WORD + 1) for c in (r["p"]["first"], r["p"]["mid"], r["p"]["last"]))


def test_a_slow_sizer_is_asked_little():
    calls = []

    def sizer(s):
        calls.append(len(s))
        return len(s)

    assert "".join(CH.pack_text("x" * 20_000, 100, sizer)) == "x" * 20_000 and len(calls) < 200 * 20


def test_packed_in_the_engine(spark):
    """Every chunk fits, all words stay in order, and each cut is at the coarsest boundary that fits."""
    rnd = random.Random(4)
    words = ["alpha", "b", "été", "日本語", "end.", "what?", "x" * 30, "\u3000", "\x0c"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\n", "\n \n", "\t"]) for _ in range(n)) for n in (0, 1, 5, 200, 3000)]
    texts += ["QUJD" * 3000, "日本語の文章" * 900, "a\u3000b " * 2000, "   \n", "é" * 9, "z" * 98, "z" * 99, "one\n\n" + "word " * 300, None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", CH.packed_chunks("t", 25).alias("c")).collect()
    for r in got:
        t, c = texts[r["i"]] or "", r["c"]
        assert all(0 < len(x.encode()) <= 98 and x == x.strip() for x in c)
        if max(map(len, t.encode().split()), default=0) <= 90 and "日本語の" not in t:
            assert " ".join(c).split() == t.split()
        assert re.sub(r"\s+", "", "".join(c)) == re.sub(r"\s+", "", t)
        at = 0
        for x in c[:-1]:
            at = t.index(x, at)
            after, at = t[at + len(x):], at + len(x)
            room, gap = (x + after).encode()[:98].decode("utf-8", "ignore")[1:], re.match(r"\s*", after).group()
            if re.search(r"\n[ \t\x0b-\r]*\n", room):
                assert re.search(r"\n[ \t\x0b-\r]*\n", gap)
            elif "\n" in room:
                assert "\n" in gap
            elif re.search(r"[.!?]\s", room):
                assert x[-1] in ".!?" and gap
    assert [r["c"] for r in got if texts[r["i"]] == "z" * 98] == [["z" * 98]]
    assert got[-2]["c"][0] == "one" and got[-1]["c"] == []


def test_packed_picks_run_without_python(spark):
    df = spark.createDataFrame([("a b. " * 5000,)], "t string")
    picked = df.select(CH.chunk_triple("t", F.lit(True), F.lit("text"), mode="packed").alias("c"))
    assert "Python" not in picked._jdf.queryExecution().executedPlan().toString()
    r, chunks = picked.first()["c"], df.select(CH.packed_chunks("t").alias("c")).first()["c"]
    assert (r["first"], r["mid"], r["last"], r["n_chunks"]) == (chunks[0], chunks[len(chunks) // 2], chunks[-1], len(chunks))
