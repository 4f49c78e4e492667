"""Queries for content operators (C1-C13) and the project context."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as FX
from .queries import register
from ..functions import paths as P
from ..functions import text as TX
from ..operators import content as CO
from ..operators.chunking import decode_lossy
from ..sources.corpus import corpus_from_table

# ---------------------------------------------------------------- sizes derived from the data

_BYTES_SQL = """case doc_id % 6 when 0 then strlen(text) when 1 then strlen(text) * 1024
  when 2 then strlen(text) * 1048576 + doc_id when 3 then strlen(text) * 1073741824
  when 4 then strlen(text) * 1099511627776 else (strlen(text) % 1000) * 1125899906842624 end"""


def _bytes_col():
    n = F.octet_length("text").cast("long")
    i = F.col("doc_id") % 6
    return (F.when(i == 0, n).when(i == 1, n * 1024).when(i == 2, n * 1048576 + F.col("doc_id"))
            .when(i == 3, n * 1073741824).when(i == 4, n * 1099511627776)
            .otherwise((n % 1000) * 1125899906842624)).cast("long")


def _human_sql(b: str) -> str:
    parts = [f"when {b} < 1024 then cast({b} as varchar) || ' B'"]
    for k, u in enumerate(["KB", "MB", "GB", "TB"], start=1):
        lo = 1024 ** k
        cond = f"{b} < {lo * 1024}" if k < 4 else "true"
        parts.append(f"when {cond} then printf('%.1f', round_even({b} / {float(lo)}, 1)) || ' {u}'")
    return "case " + " ".join(parts) + " end"


@register("human_bytes", f"""
select doc_id, bytes, {_human_sql('bytes')} as size_label from (select doc_id, {_BYTES_SQL} as bytes from documents) s""")
def human_bytes(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id", _bytes_col().alias("bytes"))
    return d.select("doc_id", "bytes", TX.human_bytes("bytes").alias("size_label"))


def _decimal_sql(b: str) -> str:
    parts = [f"when {b} <= 0 then '0 B'", f"when {b} < 1000 then cast({b} as varchar) || ' B'"]
    for k, u in enumerate(["kB", "MB", "GB", "TB", "PB", "EB"], start=1):
        d = 1000 ** k
        q = f"(({b})::hugeint * 100 // {d})"
        r = f"(({b})::hugeint * 100 % {d})"
        h = f"({q} + case when 2 * {r} > {d} or (2 * {r} = {d} and {q} % 2 = 1) then 1 else 0 end)"
        txt = (f"case when {h} % 100 = 0 then cast({h} // 100 as varchar) "
               f"when {h} % 10 = 0 then cast({h} // 100 as varchar) || '.' || cast(({h} % 100) // 10 as varchar) "
               f"else cast({h} // 100 as varchar) || '.' || lpad(cast({h} % 100 as varchar), 2, '0') end")
        cond = f"{b} < {d * 1000}" if k < 6 else "true"
        parts.append(f"when {cond} then {txt} || ' {u}'")
    return "case " + " ".join(parts) + " end"


@register("decimal_size_label", f"""
select doc_id, bytes, {_decimal_sql('bytes')} as size_label from (select doc_id, {_BYTES_SQL} as bytes from documents) s""")
def decimal_size_label(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id", _bytes_col().alias("bytes"))
    return d.select("doc_id", "bytes", TX.decimal_size_label("bytes").alias("size_label"))


_AGE_SQL_SECS = """case doc_id % 4 when 0 then doc_id % 120 when 1 then n_chars * 7 when 2 then n_chars * 97
  else n_chars * 3001 end"""


def _age_sql(s: str) -> str:
    """The wording by its own numbers, not the engine's table."""
    year, month, week, day = 31556952, 2629746, 604800, 86400
    return f"""case when {s} > {547 * day} then cast(greatest({s} // {year}, 2) as varchar) || ' years ago'
  when {s} > {345 * day} then 'a year ago' when {s} > {45 * day} then cast(greatest({s} // {month}, 2) as varchar) || ' months ago'
  when {s} > {29 * day} then 'a month ago' when {s} > 907200 then cast(greatest({s} // {week}, 2) as varchar) || ' weeks ago'
  when {s} > 561600 then 'a week ago' when {s} > 129600 then cast(greatest({s} // {day}, 2) as varchar) || ' days ago'
  when {s} > 79200 then 'a day ago' when {s} > 5400 then cast(greatest({s} // 3600, 2) as varchar) || ' hours ago'
  when {s} > 2700 then 'an hour ago' when {s} > 90 then cast(greatest({s} // 60, 2) as varchar) || ' minutes ago'
  when {s} > 45 then 'a minute ago' when {s} > 10 then cast({s} as varchar) || ' seconds ago' else 'now' end"""


@register("age_label", f"""
select doc_id, mtime, {_age_sql('secs')} as age
from (select doc_id, {_AGE_SQL_SECS} as secs,
        strftime(timestamp '{FX.RUN_TS}' - to_seconds({_AGE_SQL_SECS}), '%Y-%m-%dT%H:%M:%SZ') as mtime from documents) s""")
def age_label(spark, sf):
    d = FX.table(spark, sf, "documents")
    i = F.col("doc_id") % 4
    n = F.col("n_chars")
    secs = (F.when(i == 0, F.col("doc_id") % 120).when(i == 1, n * 7).when(i == 2, n * 97).otherwise(n * 3001)).cast("long")
    run_ts = F.to_timestamp(F.lit(FX.RUN_TS))
    mtime = F.timestamp_seconds(F.unix_timestamp(run_ts) - secs)
    from .queries import ts_text
    return d.select("doc_id", ts_text(mtime).alias("mtime"), TX.age_label(mtime, run_ts).alias("age"))


# ---------------------------------------------------------------- heads with derived binary variants

def _heads(spark, sf):
    """Document bytes, with signature-prefixed and NUL-prefixed variants derived from the text."""
    d = FX.table(spark, sf, "documents")
    body = F.encode("text", "UTF-8")
    k = F.col("doc_id") % 9
    head = (F.when(k == 0, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), body))
            .when(k == 1, F.concat(F.unhex(F.lit("1F8B08")), body))
            .when(k == 2, F.concat(F.unhex(F.lit("00")), body))
            .when(k == 3, F.concat(F.unhex(F.lit("25504446")), body))
            .otherwise(body))
    return d.select("doc_id", F.substring(head, 1, TX.MAX_TEXT_BYTES).alias("head"))


_HEADS_SQL = """select doc_id, text, case doc_id % 9 when 0 then unhex('89504E470D0A1A0A') || encode(text)
  when 1 then unhex('1F8B08') || encode(text) when 2 then unhex('00') || encode(text)
  when 3 then unhex('25504446') || encode(text) else encode(text) end as head from documents"""


def _ctype_sql() -> str:
    return """case when starts_with(hx, '89504E470D0A1A0A') then 'image/png' when starts_with(hx, '1F8B') then 'application/gzip'
  when starts_with(hx, '25504446') then 'application/pdf'
  when regexp_matches(text, '^\\s*(<![dD][oO][cC][tT][yY][pP][eE]\\s+[hH][tT][mM][lL]|<[hH][tT][mM][lL])') and doc_id % 9 > 3 then 'text/html'
  when regexp_matches(text, '^\\s*<\\?xml') and doc_id % 9 > 3 then 'application/xml'
  when regexp_matches(left(hx, 8192), '^(..)*00') then 'application/octet-stream'
  else 'text/plain' end"""


@register("content_type", f"""
select 'doc' as kind, doc_id as id, {_ctype_sql()} as content_type from (select *, hex(head) as hx from ({_HEADS_SQL}) h) s
union all
select 'page', page_id, case when regexp_matches(html, '^\\s*(<![dD][oO][cC][tT][yY][pP][eE]\\s+[hH][tT][mM][lL]|<[hH][tT][mM][lL])') then 'text/html'
  when regexp_matches(html, '^\\s*<\\?xml') then 'application/xml' else 'text/plain' end from pages""")
def content_type(spark, sf):
    h = _heads(spark, sf).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"),
                                 TX.content_type("head").alias("content_type"))
    p = FX.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                                            TX.content_type(F.encode("html", "UTF-8")).alias("content_type"))
    return h.unionByName(p)


_TEXT_SQL = """case when n = 0 then true when regexp_matches(hx, '^(..)*00') then false
  else len(list_filter(regexp_extract_all(hx, '..'), lambda x: x in ('0A', '0D', '09') or (x >= '20' and x <= '7E'))) * 100 >= n * 85 end"""


@register("is_probably_text", f"""
select doc_id, {_TEXT_SQL} as is_text
from (select doc_id, hx, length(hx) // 2 as n from (select doc_id, left(hex(head), 8192) as hx from ({_HEADS_SQL}) h) s) s2""")
def is_probably_text(spark, sf):
    return _heads(spark, sf).select("doc_id", TX.is_probably_text("head").alias("is_text"))


@register("decode_limited", """
select doc_id, text, case when text = '' then '' when strlen(right(text, 1)) = 1 then left(text, length(text) - 1)
  else left(text, length(text) - 1) || chr(65533) end as text_cut
from documents""")
def decode_limited(spark, sf):
    """Whole texts decoded with the 2,000,000-byte limit, and the same bytes cut one byte short of the
    end: a character split by the cut becomes one replacement sign."""
    d = FX.table(spark, sf, "documents").select(
        "doc_id", F.substring(F.encode("text", "UTF-8"), 1, TX.MAX_TEXT_BYTES).alias("b"),
        F.expr("substring(encode(text, 'UTF-8'), 1, octet_length(text) - 1)").alias("c"))
    return d.select("doc_id", decode_lossy("b").alias("text"), decode_lossy("c").alias("text_cut"))


@register("first_n_words", """
select doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1, 500), ' ') as words_500,
  array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1, 7), ' ') as words_7
from documents""")
def first_n_words(spark, sf):
    d = FX.table(spark, sf, "documents")
    return d.select("doc_id", TX.first_n_words("text", 500).alias("words_500"), TX.first_n_words("text", 7).alias("words_7"))


_README_ORDER = ", ".join(f"'{n}'" for n in CO.README_NAMES)


@register("project_context", f"""
with cand as (select project, path, content, list_position([{_README_ORDER}], path) as pos from corpus_v
              where path in ({_README_ORDER})),
best as (select project, arg_min(content, pos) as content from cand group by project)
select p.project, case when b.content is null then 'false' else 'true' end as documented,
  coalesce(array_to_string(list_slice(list_filter(regexp_split_to_array(b.content, '\\s+'), lambda x: x <> ''), 1, 500), ' '), '') as snippet
from (select distinct project from corpus_v) p left join best b using (project)""", ("corpus_v",))
def project_context(spark, sf):
    c = corpus_from_table(FX.corpus_v(spark, sf))
    projects = c.select("project").distinct()
    return CO.project_context(c, projects)


@register("preview", """
select doc_id, case when strlen(text) <= 400 then text
  else left(text, len(list_filter(list_transform(range(1, 401), lambda k: strlen(left(text, k))), lambda x: x <= 400)))
       || '… (' || cast(strlen(text) as varchar) || ' bytes total)' end as preview
from documents""")
def preview(spark, sf):
    d = FX.table(spark, sf, "documents")
    return d.select("doc_id", TX.preview("text", 400).alias("preview"))


def _noisy_text():
    """Text with control characters and Unicode line breaks appended for a third of the rows."""
    return F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\x07\x0b x\u2028y\u2029z\ufeff\x85\t\r\n"))) \
        .otherwise(F.col("text"))


@register("sanitize_yaml_text", """
select doc_id, replace(replace(replace(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g'),
  chr(8232), ' '), chr(8233), ' '), chr(65279), ' ') as sanitized
from (select doc_id, case when doc_id % 3 = 0 then text || chr(7) || chr(11) || ' x' || chr(8232) || 'y' || chr(8233) || 'z'
  || chr(65279) || chr(133) || chr(9) || chr(13) || chr(10) else text end as t from documents) s""")
def sanitize_yaml_text(spark, sf):
    d = FX.table(spark, sf, "documents")
    return d.select("doc_id", TX.sanitize_yaml_text(_noisy_text()).alias("sanitized"))


@register("indent_lines", """
select conv_id, turn, case when t = '' then '' else '  ' || replace(replace(regexp_replace(t, '\\r?\\n$', ''), chr(13) || chr(10), chr(10)),
  chr(10), chr(10) || '  ') end as indented
from (select conv_id, turn, case when (conv_id + turn) % 3 = 0 then replace(text, '. ', '.' || chr(13) || chr(10)) || chr(10)
  when (conv_id + turn) % 3 = 1 then replace(text, '. ', '.' || chr(10)) else text || chr(10) || chr(10) end as t from conversations) s""")
def indent_lines(spark, sf):
    c = FX.table(spark, sf, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 3
    t = (F.when(k == 0, F.concat(F.replace("text", F.lit(". "), F.lit(".\r\n")), F.lit("\n")))
         .when(k == 1, F.replace("text", F.lit(". "), F.lit(".\n"))).otherwise(F.concat("text", F.lit("\n\n"))))
    return c.select("conv_id", "turn", TX.indent_lines(t, 2).alias("indented"))


@register("regex_escape", """
select project, path, regexp_replace(name, '([\\\\.+*?()|\\[\\]{}^$#&\\-~])', '\\\\\\1', 'g') as name_re,
  regexp_replace(stem, '([\\\\.+*?()|\\[\\]{}^$#&\\-~])', '\\\\\\1', 'g') as stem_re
from (select project, path, name,
  case when regexp_matches(name, '^.+\\.([^.]*)$') then regexp_extract(name, '^(.+)\\.[^.]*$', 1) else name end as stem
  from (select project, path, regexp_extract(path, '[^/]*$', 0) || case when doc_id % 5 = 0 then '+(v1)[x]{2}#a&b~c^d$' else '' end as name
        from corpus_v) a) b""", ("corpus_v",))
def regex_escape(spark, sf):
    c = FX.corpus_v(spark, sf)
    name = F.concat(P.path_name("path"), F.when(F.col("doc_id") % 5 == 0, F.lit("+(v1)[x]{2}#a&b~c^d$")).otherwise(F.lit("")))
    return c.select("project", "path", TX.regex_escape(name).alias("name_re"), TX.regex_escape(P.stem(name)).alias("stem_re"))
