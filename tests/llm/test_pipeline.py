import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docweave.llm.pipeline import STAGES, run
from docweave.llm.queries import QUERIES
from test_line_dedup import brute as line_brute
from test_near_dup import brute as near_brute


def test_names():
    assert [n for n, _ in STAGES] == ["toxicity", "line dedup", "near duplicates", "benchmark decontamination", "bpe"]


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = stage(spark, docs, d)
        if name != "bpe":
            assert after.columns == columns and after.dtypes == docs.dtypes
            after = spark.createDataFrame(after.collect(), docs.schema)
        got = after.collect()
        seen.append(len(got))
        if name == "toxicity":
            bad = {r.doc_id for r in QUERIES["op5_toxicity"](spark, d).collect() if r.predicted}
            assert {r.doc_id for r in got} == {i for i, _ in before} - bad
        elif name == "line dedup":
            want = {(i, s) for i, _, _, s in line_brute(before)}
            assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in got} == want
            assert all(r.n_chars == len(r.text) for r in got)
        elif name == "near duplicates":
            assert {r.doc_id for r in got} == {c for _, c in near_brute(before)}
        elif name == "benchmark decontamination":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            leaked = {i for i, t in before if any(x in " ".join(t.lower().split()) for x in items)}
            assert {r.doc_id for r in got} == {i for i, _ in before} - leaked
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            library.no_truncation()
            for (i, t) in before[:50]:
                ids = library.encode(t, add_special_tokens=False).ids
                assert next(r for r in got if r.doc_id == i).ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        docs = after
    assert run(spark, d).count() == seen[-1] and sorted(seen, reverse=True) == seen


def test_empty_and_odd(spark, frame, odd_rows):
    rows = [(i, t, "en", "s", 1) for i, t in odd_rows]
    for some in (rows, []):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            if name != "bpe":
                docs = spark.createDataFrame(out.collect(), docs.schema)
            else:
                assert out.count() == docs.count()
