"""Registered queries of the operators, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op4_line_dedup(spark, sf_dir):
    from .line_dedup import op4
    return op4(table(spark, sf_dir))


SQL["op4_line_dedup"] = r"""
with parts as (
  select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (
  select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from parts),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
shared as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (
  select l.*, s.keeper is not null and l.doc_id <> s.keeper as dropped from keyed l left join shared s using (k))
select doc_id, count(*) as n_lines, cast(sum(dropped::int) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""


@query
def op6_token_file(spark, sf_dir):
    from .token_file import op6
    return op6(table(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@query
def op7_sharding(spark, sf_dir):
    from .sharding import op7
    return op7(table(spark, sf_dir))


@query
def op10_bpe(spark, sf_dir):
    from .bpe import op10
    return op10(table(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query
def op5_toxicity(spark, sf_dir):
    from .toxicity import op5
    return op5(table(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op8_near_dup(spark, sf_dir):
    from .near_dup import op8
    return op8(table(spark, sf_dir))


@query
def op9_decontaminate(spark, sf_dir):
    from .decontaminate import op9
    return op9(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op1_repeats(spark, sf_dir):
    from .repeats import op1
    return op1(table(spark, sf_dir))


@query
def op2_pii(spark, sf_dir):
    from .pii import op2
    return op2(table(spark, sf_dir))


@query
def op3_quality(spark, sf_dir):
    from .quality import op3
    return op3(table(spark, sf_dir))


SQL["op3_quality"] = r"""
with t as (
  select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') as lines from t),
g as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
r as (
  select doc_id, i from g qualify count(*) over (partition by doc_id, gram) > 1),
c as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from r) group by doc_id),
m as (
  select w.doc_id, text, words, len(lines) as n_lines, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(c.n, 0) as n_repeat_words
  from w left join c on w.doc_id = c.doc_id),
b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 15 * n_words or 10 * n_symbols > 3 * n_words
    or 10 * n_dup_lines > 6 * n_lines or 2 * len(regexp_extract_all(text, '\p{L}+')) < n_words
    or 20 * len(list_distinct(words)) < n_words or 5 * length(regexp_replace(text, '[^0-9]+', '', 'g')) > 2 * word_chars
    or regexp_matches(text, '[^\x20\x09-\x0D]{1000}')) as kept
from b
"""


@query
def op11_mixing(spark, sf_dir):
    from .mixing import op11
    return op11(table(spark, sf_dir))


@query
def op13_phrases(spark, sf_dir):
    from .phrases import op13
    return op13(table(spark, sf_dir))


SQL["op13_phrases"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as words from pieces),
totals as (
  select lang, sum(len(words)) as n from w group by lang),
starts as (
  select lang, words, unnest(range(1, len(words) + 1)) as i from w),
f as (
  select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase, count(*) as a
  from starts, (select unnest([1, 2, 3, 4, 5]) as k) where i + k - 1 <= len(words) group by all having count(*) >= 100),
cand as (
  select lang, phrase, k, a, string_split(phrase, ' ') as words from f where k >= 2),
parts as (
  select distinct lang, array_to_string(words[i:i + m - 1], ' ') as part, a
  from (select *, unnest(range(1, k)) as i from cand where k > 2), (select unnest([2, 3, 4]) as m) where i + m - 1 <= k and m < k),
kept as (
  select c.* from cand c left join (select lang, part, max(a) as most from parts group by all) p on p.lang = c.lang and p.part = c.phrase
  where most is null or most < a),
cuts as (
  select *, array_to_string(words[:j], ' ') as lp, array_to_string(words[j + 1:], ' ') as rp from (select *, unnest(range(1, k)) as j from kept)),
scored as (
  select c.lang, c.phrase, c.a, x.a as l, y.a as r, t.n, j, (1000::hugeint * c.a * t.n) // (x.a::hugeint * y.a) as score
  from cuts c join totals t on t.lang = c.lang join f x on x.lang = c.lang and x.phrase = lp join f y on y.lang = c.lang and y.phrase = rp),
best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000
"""


@query
def op12_whitening(spark, sf_dir):
    from .whitening import op12
    return op12(table(spark, sf_dir, "embeddings"))
