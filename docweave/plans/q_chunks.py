"""Queries for chunking (K1-K4), binary suppression (C14) and per-file metrics (M2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as FX
from .queries import register
from ..functions import paths as P
from ..functions import text as TX
from ..operators import chunking as CH
from ..operators import metrics as M
from ..sources.corpus import corpus_from_table, fingerprint

WORDS = CH.DEFAULT_WINDOW_WORDS


def _lang_case_sql(ext: str) -> str:
    whens = " ".join(f"when {ext} in ({', '.join(repr(e) for e in exts)}) then '{lang}'"
                     for lang, exts in CH.LANGUAGE_EXTENSIONS.items())
    return f"case {whens} end"


_EXT_SQL = "case when regexp_matches(name, '^.+\\.([^.]*)$') then lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) end"


@register("route_splitter", f"""
select project, path, case when ext in ('md', 'markdown', 'mdx') then 'markdown'
  when {_lang_case_sql('ext')} is not null then 'code' else 'text' end as splitter,
  case when ext in ('md', 'markdown', 'mdx') then null else {_lang_case_sql('ext')} end as language
from (select project, path, {_EXT_SQL} as ext from (select project, path, regexp_extract(path, '[^/]*$', 0) as name from corpus_v) a) b""",
          ("corpus_v",))
def route_splitter(spark, sf):
    c = FX.corpus_v(spark, sf)
    r = CH.route_splitter(F.lit("text/plain"), P.extension(P.path_name("path")))
    return c.select("project", "path", r["splitter"].alias("splitter"), r["language"].alias("language"))


_WORDS_SQL = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"


@register("token_chunks", f"""
select doc_id, cast(i as int) as chunk_no, cast(n as int) as n_chunks,
  array_to_string(list_slice(w, i * {WORDS} + 1, i * {WORDS} + {WORDS}), ' ') as text,
  cast(len(list_slice(w, i * {WORDS} + 1, i * {WORDS} + {WORDS})) as int) as n_words
from (select doc_id, w, cast(ceil(len(w) / {WORDS}) as bigint) as n from (select doc_id, {_WORDS_SQL} as w from documents) a) b,
  range(n) t(i)""")
def token_chunks(spark, sf):
    d = FX.table(spark, sf, "documents")
    return CH.window_chunks(d, "text", WORDS, keys=["doc_id"])


@register("token_chunks_packed", f"""
select doc_id, sha256(array_to_string(w, ' ')) as words_sha256, cast(0 as bigint) as n_oversize, len(w) > 0 as has_chunks,
  cast(len(w) as bigint) as n_words
from (select doc_id, {_WORDS_SQL} as w from documents) a""")
def token_chunks_packed(spark, sf):
    """Per document what packing must keep: all words in order, and no chunk over the bound in bytes."""
    d = FX.table(spark, sf, "documents")
    ch = d.select("doc_id", CH.packed_chunks("text", 1000).alias("chunks"))
    words = F.filter(F.split(F.array_join("chunks", " "), r"(?U)\s+"), lambda x: x != "")
    return ch.select("doc_id", F.sha2(F.array_join(words, " "), 256).alias("words_sha256"),
                     F.size(F.filter("chunks", lambda c: F.octet_length(c) > 4 * 1000)).cast("long").alias("n_oversize"),
                     (F.size("chunks") > 0).alias("has_chunks"), F.size(words).cast("long").alias("n_words"))


def _pick_sql(words: str = "w", n: str = "n") -> str:
    def chunk(i):
        return f"array_to_string(list_slice({words}, ({i}) * {WORDS} + 1, ({i}) * {WORDS} + {WORDS}), ' ')"
    return f"{chunk('0')} as first, {chunk(f'{n} // 2')} as mid, {chunk(f'{n} - 1')} as last"


@register("pick_three", f"""
select doc_id, {_pick_sql()}, cast(n as int) as n_chunks
from (select doc_id, w, cast(ceil(len(w) / {WORDS}) as bigint) as n from (select doc_id, {_WORDS_SQL} as w from documents) a) b""")
def pick_three(spark, sf):
    d = FX.table(spark, sf, "documents")
    return d.select("doc_id", CH.pick_three_window(F.col("text"), WORDS).alias("p")).select("doc_id", "p.*")


def _triple_sql(text: str, is_text: str, splitter: str) -> str:
    """SQL of the chunk triple with the edge cases (binary, blank)."""
    ph = TX.BINARY_PLACEHOLDER
    return f"""case when not {is_text} then '{ph}' when not regexp_matches({text}, '\\S') then '' else first end as first,
  case when not {is_text} then '{ph}' when not regexp_matches({text}, '\\S') then '' else mid end as mid,
  case when not {is_text} then '{ph}' when not regexp_matches({text}, '\\S') then '' else last end as last,
  case when not {is_text} then 'binary' when not regexp_matches({text}, '\\S') then 'empty' else {splitter} end as used"""


@register("chunk_edge_cases", f"""
select kind, id, {_triple_sql('text', 'true', "'text'")}
from (select kind, id, text, {_pick_sql()} from (
  select kind, id, text, w, cast(ceil(len(w) / {WORDS}) as bigint) as n from (
    select kind, id, text, {_WORDS_SQL} as w from (
      select 'conv' as kind, conv_id * 1000 + turn as id,
        case when (conv_id + turn) % 5 = 0 then ' ' || chr(10) || chr(9) || ' ' else text end as text from conversations
      union all select 'bench', item_id, text from benchmark) s0) s1) s2) s3""")
def chunk_edge_cases(spark, sf):
    conv = FX.table(spark, sf, "conversations").select(
        F.lit("conv").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.lit(" \n\t ")).otherwise(F.col("text")).alias("text"))
    bench = FX.table(spark, sf, "benchmark").select(F.lit("bench").alias("kind"), F.col("item_id").alias("id"), "text")
    u = conv.unionByName(bench)
    t = CH.chunk_triple(F.col("text"), F.lit(True), F.lit("text"), mode="window", n_words=WORDS)
    return u.select("kind", "id", t.alias("t")).select("kind", "id", "t.first", "t.mid", "t.last", "t.used")


_HEADS2_SQL = """select doc_id, text, case doc_id % 9 when 2 then unhex('00') || encode(text) else encode(text) end as head from documents"""
_IS_TEXT_SQL = """(case when n = 0 then true when regexp_matches(hx, '^(..)*00') then false
  else len(list_filter(regexp_extract_all(hx, '..'), lambda x: x in ('0A', '0D', '09') or (x >= '20' and x <= '7E'))) * 100 >= n * 85 end)"""


@register("suppress_binary", f"""
select doc_id, {_triple_sql('text', 'is_text', "'text'")}
from (select doc_id, text, is_text, {_pick_sql()} from (
  select doc_id, text, {_IS_TEXT_SQL} as is_text, w, cast(ceil(len(w) / {WORDS}) as bigint) as n from (
    select doc_id, text, left(hex(head), 8192) as hx, length(left(hex(head), 8192)) // 2 as n, {_WORDS_SQL} as w
    from ({_HEADS2_SQL}) h) s1) s2) s3""")
def suppress_binary(spark, sf):
    d = FX.table(spark, sf, "documents")
    head = F.when(F.col("doc_id") % 9 == 2, F.concat(F.unhex(F.lit("00")), F.encode("text", "UTF-8"))) \
        .otherwise(F.encode("text", "UTF-8"))
    h = d.select("doc_id", head.alias("head"))
    t = CH.chunk_triple(CH.decode_lossy("head"), TX.is_probably_text("head"), F.lit("text"), mode="window", n_words=WORDS)
    return h.select("doc_id", t.alias("t")).select("doc_id", "t.first", "t.mid", "t.last", "t.used")


@register("file_metrics", f"""
select project, path, size_label, file_type, content_type, used as splitter_used,
  cast(strlen(first) as bigint) as chunk1_bytes, cast(strlen(mid) as bigint) as chunk2_bytes, cast(strlen(last) as bigint) as chunk3_bytes
from (select project, path, size_label, file_type, content_type, {_triple_sql('content', 'is_text', 'splitter')}
  from (select *, {_pick_sql()} from (
    select project, path, content, w, cast(ceil(len(w) / {WORDS}) as bigint) as n, {_IS_TEXT_SQL} as is_text,
      case when b < 1024 then cast(b as varchar) || ' B' when b < 1048576 then printf('%.1f', round_even(b / 1024.0, 1)) || ' KB'
        else printf('%.1f', round_even(b / 1048576.0, 1)) || ' MB' end as size_label,
      coalesce({_EXT_SQL.replace('lower(', '(')}, 'unknown') as file_type, 'text/plain' as content_type,
      case when {_EXT_SQL} in ('md', 'markdown', 'mdx') then 'markdown' when {_lang_case_sql(_EXT_SQL)} is not null then 'code'
        else 'text' end as splitter
    from (select project, path, content, regexp_extract(path, '[^/]*$', 0) as name, strlen(content) as b,
            left(hex(encode(content)), 8192) as hx, length(left(hex(encode(content)), 8192)) // 2 as n, {_WORDS_SQL.replace('text', 'content')} as w
          from corpus_v) a) b) c) d""", ("corpus_v",))
def file_metrics(spark, sf):
    c = corpus_from_table(FX.corpus_v(spark, sf))
    fp = fingerprint(c, keep_head=True).withColumn("chunks", CH.chunk_triple(
        CH.decode_lossy("head"), F.col("is_text"), F.col("splitter"), mode="window", n_words=WORDS)).drop("head")
    return M.file_metrics(fp, fp)
