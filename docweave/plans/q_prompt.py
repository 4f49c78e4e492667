"""Queries for prompts, enrichment and answers (E1-E8) and state replacement."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from . import fixtures as FX
from . import run as RUN
from .oracle_sql import (sql_clean_description, sql_ext, sql_html_escape, sql_indent, sql_parse_fields,
                         sql_regex_escape, sql_sanitize, sql_stem)
from .q_chunks import WORDS, _IS_TEXT_SQL, _lang_case_sql, _pick_sql, _triple_sql
from .q_content import _README_ORDER, _human_sql
from .queries import register, ts_text
from ..functions import answer as AN
from ..functions import text as TX
from ..operators import content as CO
from ..operators import enrich as EN
from ..operators import prompt as PR
from ..operators import state as ST
from ..session import materialize
from ..sources.corpus import corpus_from_table

ROOT_PREFIX = "/data/"


def _dirty_inputs(spark, sf):
    """The engine's own way: written corpus, plan and context, dirty rows through prompt_inputs_for_dirty."""
    cv = materialize(FX.corpus_v(spark, sf), "corpus")
    c = corpus_from_table(cv)
    prev = ST.as_state(FX.prev_v(spark, sf, cv))
    plan = materialize(ST.plan_changes(c, prev), "plan")
    ctx = materialize(CO.project_context(c, c.select("project")), "context")
    return c, prev, plan, RUN.prompt_inputs_for_dirty(c, plan, ctx, "window", WORDS)


def _prompts(spark, sf):
    c, prev, plan, inputs = _dirty_inputs(spark, sf)
    return prev, plan, RUN.build_prompts(inputs, root_prefix=ROOT_PREFIX)


_WORDS_C = "list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')"

FIELDS_SQL = f"""
with plan as (
  select c.*, case when p.path is null then 'new' when p.content_hash = c.content_hash and p.description <> '' then 'reuse'
    else 'changed' end as action
  from corpus_v c left join prev_v p using (project, path)),
cand as (select project, content, list_position([{_README_ORDER}], path) as pos from corpus_v where path in ({_README_ORDER})),
best as (select project, arg_min(array_to_string(list_slice({_WORDS_C}, 1, 500), ' '), pos) as snippet from cand group by project),
ctx as (select p.project, case when b.snippet is null then 'false' else 'true' end as documented, coalesce(b.snippet, '') as snippet
        from (select distinct project from corpus_v) p left join best b using (project)),
base as (select d.project, d.path, d.content_hash, d.content, cast(strlen(d.content) as bigint) as size,
           regexp_extract(d.path, '[^/]*$', 0) as name, ctx.documented, ctx.snippet
         from plan d left join ctx using (project) where d.action <> 'reuse'),
feat as (select *, {sql_ext('name')} as extension, coalesce({sql_ext('name')}, 'unknown') as file_type,
           left(hex(encode(content)), 8192) as hx, {_WORDS_C} as w from base),
feat2 as (select *, length(hx) // 2 as n, cast(ceil(len(w) / {WORDS}) as bigint) as nc from feat),
feat3 as (select *, {_IS_TEXT_SQL} as is_text,
            case when regexp_matches(left(hx, 8192), '^(..)*00') then 'application/octet-stream' else 'text/plain' end as content_type,
            case when {sql_ext('name', True)} in ('md', 'markdown', 'mdx') then 'markdown'
                 when {_lang_case_sql(sql_ext('name', True))} is not null then 'code' else 'text' end as splitter,
            {_pick_sql('w', 'nc')} from feat2),
tri as (select project, path, content_hash, size, name, file_type, content_type, documented, snippet,
          {_triple_sql('content', 'is_text', 'splitter')} from feat3),
fields as (select project, path, content_hash, size,
    '{ROOT_PREFIX}' || project || '/' || path as filename, {_human_sql('size')} as filesize, file_type as filetype,
    content_type as mimetype, 'linux' as operating_system, documented as project_is_documented,
    {sql_indent(sql_sanitize('snippet'))} as project_documentation,
    {sql_indent(sql_sanitize('first'))} as chunk_one, {sql_indent(sql_sanitize('mid'))} as chunk_two,
    {sql_indent(sql_sanitize('last'))} as chunk_three,
    {sql_regex_escape('name')} as filename_re, {sql_regex_escape(sql_stem('name'))} as filename_stem_re
  from tri)"""

_F_COLS = PR.FIELDS + PR.EXTRA_FIELDS


@register("prompt_fields", FIELDS_SQL + f"\nselect project, path, {', '.join(_F_COLS)} from fields",
          ("corpus_v", "prev_v"))
def prompt_fields(spark, sf):
    _, _, _, inputs = _dirty_inputs(spark, sf)
    return PR.prompt_fields(inputs, ROOT_PREFIX).select("project", "path", *_F_COLS)


def _render_sql(text: str) -> str:
    """The template taken apart here, not by the engine: every second piece is a field's name."""
    parts = []
    for i, piece in enumerate(re.split(r"\{\{(\w+)\}\}", text)):
        if i % 2:
            parts.append(sql_html_escape(f"coalesce({piece}, '')"))
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts) if parts else "''"


_T = PR.DEFAULT_TEMPLATE
RENDER_SQL = FIELDS_SQL + f""",
rendered as (select project, path, content_hash, size, filetype, filesize,
    {_render_sql(_T['system'])} as system, {_render_sql(_T['user_before'])} || {_render_sql(_T['user_after'])} as user
  from fields),
prompts as (select *, sha256(system || chr(10) || user) as prompt_hash from rendered)"""


@register("render_prompt", RENDER_SQL + "\nselect project, path, system, user, prompt_hash from prompts",
          ("corpus_v", "prev_v"))
def render_prompt(spark, sf):
    _, _, p = _prompts(spark, sf)
    return p.select("project", "path", "system", "user", "prompt_hash")


_CLIENT_SQL = """case (length(path) + size) % 4
  when 0 then '{"fileDescription":"This file holds ' || filetype || ' data of ' || filesize || '","joyThisFileBrings":'
    || cast(size % 10 + 1 as varchar) || ',"personalityEmoji":"📄"}'
  when 1 then '{"fileDescription":"provides notes for ' || project || '","joyThisFileBrings":'
    || cast(size % 10 + 1 as varchar) || ',"personalityEmoji":"📝"}'
  when 2 then 'not json: ' || filetype
  else '{"fileDescription":"Stores ' || filetype || ' text","howMuchJoyDoesThisFileBringYou":'
    || cast(size % 10 + 1 as varchar) || ',"emojiThatExpressesThisFilesPersonality":"🗂"}' end"""

ANSWERS_SQL = RENDER_SQL + f""",
answers as (select project, path, content_hash, prompt_hash, {_CLIENT_SQL} as answer from prompts)"""


@register("enrich", ANSWERS_SQL + "\nselect project, path, content_hash, answer, 1 as attempts, '' as error from answers",
          ("corpus_v", "prev_v"))
def enrich(spark, sf):
    _, _, p = _prompts(spark, sf)
    a = EN.enrich(p, EN.DeterministicClient(), max_concurrency=8)
    return a.select("project", "path", "content_hash", "answer", "attempts", F.coalesce("error", F.lit("")).alias("error"))


@register("retry_backoff", RENDER_SQL + f"""
select project, path, attempts,
  cast(coalesce(list_sum(list_transform(range(1, attempts), lambda a: least({EN.BACKOFF_BASE_MS} * (2 ** (a - 1)), {EN.BACKOFF_CAP_MS}))), 0) as bigint) as backoff_ms,
  case when size % 7 >= {EN.MAX_ATTEMPTS} then 'ConnectionError: temporary failure' else '' end as error,
  case when size % 7 >= {EN.MAX_ATTEMPTS} then '' else {_CLIENT_SQL} end as answer
from (select *, cast(least(size % 7 + 1, {EN.MAX_ATTEMPTS}) as int) as attempts from prompts) p""", ("corpus_v", "prev_v"))
def retry_backoff(spark, sf):
    _, _, p = _prompts(spark, sf)
    a = EN.enrich(p, EN.FlakyClient(), max_concurrency=8, sleep=lambda s: None)
    return a.select("project", "path", "attempts", "backoff_ms", F.coalesce("error", F.lit("")).alias("error"), "answer")


_PA = sql_parse_fields("answer")


@register("parse_answer", f"""
select doc_id, {_PA['ok']} as ok, {_PA['description']} as description, {_PA['joy']} as joy, {_PA['emoji']} as emoji
from answers_v""", ("answers_v",))
def parse_answer(spark, sf):
    a = FX.answers_v(spark, sf)
    d = AN.parse_answer(F.col("answer"))
    return a.select("doc_id", d.isNotNull().alias("ok"), d["description"].alias("description"), d["joy"].alias("joy"),
                    d["emoji"].alias("emoji"))


_LEADS = ["This file ", '"this script: ', "This configuration file - ", "this shell script contains ", "This files hold ",
          "  provides, ", "123 ", "THIS MODULE IS ", "'", ""]
_TAILS = {1: '"', 8: "'"}


@register("clean_description", """
select doc_id, raw, """ + sql_clean_description("raw") + """ as cleaned
from (select doc_id, case doc_id % 10 """ + " ".join(
    f"when {i} then '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(_LEADS)) + """ end
    || array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1, 6), ' ')
    || case doc_id % 10 """ + " ".join(f"when {i} then '{x.replace(chr(39), chr(39) * 2)}'" for i, x in _TAILS.items()) +
          """ else '' end as raw from documents) s""")
def clean_description(spark, sf):
    d = FX.table(spark, sf, "documents")
    k = F.col("doc_id") % 10
    lead = F.element_at(F.array(*[F.lit(x) for x in _LEADS]), (k + 1).cast("int"))
    tail = F.when(k == 1, F.lit('"')).when(k == 8, F.lit("'")).otherwise(F.lit(""))
    raw = F.concat(lead, TX.first_n_words("text", 6), tail)
    return d.select("doc_id", raw.alias("raw"), AN.clean_description(raw).alias("cleaned"))


def _contract_sql(a: str) -> str:
    """Violation codes over ``j`` (the answer when it is a JSON object, else '{}') and ``obj``."""
    obj = "obj"
    keys = ", ".join(f"'{k}'" for k in AN.CONTRACT_KEYS)

    def jt(k):
        return f"json_type(j, '$.{k}')"

    def ex(k):
        return f"json_exists(j, '$.{k}')"

    checks = [
        (f"not {obj}", "not_json"),
        (f"{obj} and not {ex(AN.KEY_DESCRIPTION)}", "missing_description"),
        (f"{obj} and {ex(AN.KEY_DESCRIPTION)} and {jt(AN.KEY_DESCRIPTION)} <> 'VARCHAR'", "description_type"),
        (f"{obj} and {jt(AN.KEY_DESCRIPTION)} = 'VARCHAR' and length(json_extract_string(j, '$.{AN.KEY_DESCRIPTION}')) < {AN.CONTRACT_MIN_DESCRIPTION}",
         "description_short"),
        (f"{obj} and not {ex(AN.KEY_JOY)}", "missing_joy"),
        (f"{obj} and {ex(AN.KEY_JOY)} and not coalesce({jt(AN.KEY_JOY)} in ('BIGINT', 'UBIGINT') and "
         f"try_cast(json_extract(j, '$.{AN.KEY_JOY}')::varchar as bigint) between 1 and 10, false)", "joy_not_1_to_10"),
        (f"{obj} and not {ex(AN.KEY_EMOJI)}", "missing_emoji"),
        (f"{obj} and {ex(AN.KEY_EMOJI)} and {jt(AN.KEY_EMOJI)} <> 'VARCHAR'", "emoji_type"),
        (f"{obj} and len(list_filter(json_keys(j), lambda k: k not in ({keys}))) > 0", "extra_keys"),
    ]
    codes = "concat_ws(',', " + ", ".join(f"case when coalesce({c}, false) then '{code}' end" for c, code in checks) + ")"
    framed = (f"coalesce(json_valid({a}) and regexp_matches({a}, '(?s)^\\s*\\{{.*\\}}\\s*$'), false)")
    return (f"{codes} from (select *, case when obj then {a} else '{{}}' end as j from (select *, "
            f"coalesce(case when {framed} then json_type(case when {framed} then {a} else '{{}}' end) = 'OBJECT' end, false) as obj")


@register("answer_contract", f"select doc_id, {_contract_sql('answer').replace(' from (select', ' as violations from (select', 1)} from answers_v) a) b",
          ("answers_v",))
def answer_contract(spark, sf):
    a = FX.answers_v(spark, sf)
    return a.select("doc_id", AN.contract_violations("answer").alias("violations"))


_PE = sql_parse_fields("answer")
RECORDS_SQL = ANSWERS_SQL + f""",
records as (select project, path, regexp_extract(path, '[^/]*$', 0) as name, content_hash,
    '{FX.RUN_TS.replace(' ', 'T')}Z' as updated_at,
    case when {_PE['ok']} then {sql_clean_description(_PE['description'])} else '' end as description,
    case when {_PE['ok']} then {_PE['joy']} end as joy,
    case when {_PE['ok']} then {_PE['emoji']} else '' end as emoji
  from answers)"""


@register("finalize_record", RECORDS_SQL + "\nselect * from records", ("corpus_v", "prev_v"))
def finalize_record(spark, sf):
    _, _, p = _prompts(spark, sf)
    a = EN.enrich(p, EN.DeterministicClient(), max_concurrency=8)
    r = EN.finalize_records(a, F.lit(FX.RUN_TS))
    return r.select("project", "path", "name", "content_hash", ts_text(F.col("updated_at")).alias("updated_at"),
                    F.col("doc.description").alias("description"), F.col("doc.joy").alias("joy"),
                    F.col("doc.emoji").alias("emoji"))


@register("replace_state", RECORDS_SQL + """
select project, path, content_hash, description from records
union all
select c.project, c.path, c.content_hash, p.description from corpus_v c join prev_v p using (project, path)
where p.content_hash = c.content_hash and p.description <> ''""", ("corpus_v", "prev_v"))
def replace_state(spark, sf):
    prev, plan, p = _prompts(spark, sf)
    a = EN.enrich(p, EN.DeterministicClient(), max_concurrency=8)
    r = EN.finalize_records(a, F.lit(FX.RUN_TS))
    s = ST.replace_state(ST.carry_forward(plan, prev), r)
    return s.select("project", "path", "content_hash", F.col("doc.description").alias("description"))
