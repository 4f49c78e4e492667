"""Queries for the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as FX
from .q_content import _age_sql, _decimal_sql
from .q_hierarchy import PREFIXES_SQL
from .queries import register
from ..operators import hierarchy as H
from ..operators import inventory as INV
from ..operators import reports as R
from ..operators import state as ST

ANN_SQL = """ann as (select project, path, trim(description) as description, trim(emoji) as personality,
    case when joy is null or joy = 'null' then '' when joy like '"%' then json_extract_string(joy, '$') else joy end as joy
  from state_v)"""
ANN_ANY = "ann_any as (select * from ann where description <> '' or personality <> '' or joy <> '')"


def _emoji_sql(x: str) -> str:
    return f"case when length({x}) = 1 and not contains({x}, chr(65039)) then {x} || chr(65039) else {x} end"


@register("annotate", f"""
with {ANN_SQL}, {ANN_ANY},
f as (select project, path from corpus_v),
d as ({PREFIXES_SQL.format(src='f')}),
n as (select project, path, 'file' as kind from f union all select project, path, 'dir' from d)
select n.project, n.path, n.kind, coalesce(a.description, '') as description, coalesce(a.personality, '') as personality,
  coalesce(a.joy, '') as joy
from n left join ann_any a using (project, path)""", ("state_v", "corpus_v"))
def annotate(spark, sf):
    c = FX.corpus_v(spark, sf)
    nodes = H.derive_nodes(c.select("project", "path")).select("project", "path", "kind")
    return R.annotate(nodes, ST.load_annotations(FX.state_v(spark, sf, c)))


@register("fun_columns", f"""
with {ANN_SQL}, {ANN_ANY}
select project, path, {_emoji_sql('personality')} as personality, joy from ann_any""", ("state_v",))
def fun_columns(spark, sf):
    a = ST.fun_columns(ST.load_annotations(FX.state_v(spark, sf)))
    return a.select("project", "path", "personality", "joy")


def _listing_files(spark, sf):
    c = FX.corpus_v(spark, sf)
    mtime = F.timestamp_seconds(F.unix_timestamp(F.lit(FX.RUN_TS)) - F.col("doc_id") * 3600)
    return c, c.select("project", "path", F.octet_length("content").cast("long").alias("size"), mtime.alias("mtime"))


LIST_SQL = f"""
with {ANN_SQL}, {ANN_ANY},
f as (select project, path, cast(strlen(content) as bigint) as size, timestamp '{FX.RUN_TS}' - to_seconds(doc_id * 3600) as mtime
      from corpus_v),
d as (select project, path, max(mtime) as mtime from (
        select project, mtime, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') as path
        from f, range(1, len(string_split(path, '/'))) t(i)) x group by project, path),
n as (select project, path, 'file' as type, size, mtime from f union all select project, path, 'dir', 0, mtime from d),
n2 as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, regexp_extract(path, '[^/]*$', 0) as name,
         cast(epoch(timestamp '{FX.RUN_TS}') - epoch(mtime) as bigint) as age_s from n),
rows as (select n2.project, dir, name, type, {_decimal_sql('size')} as size, {_age_sql('age_s')} as modified,
           coalesce(a.description, '') as description, {_emoji_sql("coalesce(a.personality, '')")} as personality,
           coalesce(a.joy, '') as joy
         from n2 left join ann_any a using (project, path) where not starts_with(name, '.'))
select project, dir, cast(row_number() over (partition by project, dir order by case when type = 'file' then 0 else 1 end,
  lower(name), name) - 1 as bigint) as idx, name, type, size, modified, description{{fun}} from rows{{where}}"""


@register("list_dir", LIST_SQL.replace("{fun}", "").replace("{where}", " where dir = 'en'"), ("state_v", "corpus_v"))
def list_dir(spark, sf):
    c, files = _listing_files(spark, sf)
    nodes = R.listing_nodes(files, F.lit(FX.RUN_TS))
    ann = ST.load_annotations(FX.state_v(spark, sf, c))
    return R.list_rows(nodes, ann, F.lit(FX.RUN_TS), directory="en") \
        .select("project", "dir", "idx", "name", "type", "size", "modified", "description")


@register("list_recursive", LIST_SQL.replace("{fun}", ", personality, joy").replace("{where}", ""), ("state_v", "corpus_v"))
def list_recursive(spark, sf):
    """Every directory's listing with the fun columns; index by a range sort."""
    c, files = _listing_files(spark, sf)
    nodes = R.listing_nodes(files, F.lit(FX.RUN_TS))
    ann = ST.load_annotations(FX.state_v(spark, sf, c))
    return R.list_rows(nodes, ann, F.lit(FX.RUN_TS), fun=True) \
        .select("project", "dir", "idx", "name", "type", "size", "modified", "description", "personality", "joy")


def _tree_sql(style: str) -> str:
    st = R.STYLES[style]

    def q(s):
        return "'" + s.replace("'", "''") + "'"

    return f"""
with tann as (select project, path, trim(description) as description from state_v where trim(description) <> ''),
f as (select project, path from corpus_v
      where not list_bool_or(list_transform(string_split(path, '/'), lambda c: starts_with(c, '.')))
        and not list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), ['target'])),
d as ({PREFIXES_SQL.format(src='f')}),
nodes as (select project, path, false as is_dir from f union all select project, path, true from d),
n1 as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) as parent_path, regexp_extract(path, '[^/]*$', 0) as name,
         len(string_split(path, '/')) as depth from nodes),
n2 as (select *, row_number() over (partition by project, parent_path order by case when is_dir then 0 else 1 end desc,
         lower(name) desc, name desc) = 1 as is_last from n1),
dflag as (select project, path as anc, depth, case when is_last then {q(st['cont'][1])} else {q(st['cont'][0])} end as cont
          from n2 where is_dir),
dexp as (select project, path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1),
           lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))) as anc from d),
pre as (select x.project, x.path as parent_path, string_agg(g.cont, '' order by g.depth) as prefix
        from dexp x join dflag g on g.project = x.project and g.anc = x.anc group by x.project, x.path),
lines as (select n2.project, n2.path, cast(n2.depth as bigint) as depth,
    array_to_string(list_transform(string_split(n2.path, '/'), lambda c, i: (case when i < n2.depth or n2.is_dir then '0' else '1' end)
      || lower(c) || chr(1) || c || chr(1)), '') as sort_key,
    coalesce(pre.prefix, '') || case when is_dir and is_last then {q(st['dir'][1])} when is_dir then {q(st['dir'][0])}
      when is_last then {q(st['file'][1])} else {q(st['file'][0])} end || n2.name
      || case when coalesce(t.description, '') <> '' then {q(R.DESC_SEP)} || t.description else '' end as line
  from n2 left join pre on pre.project = n2.project and pre.parent_path = n2.parent_path
  left join tann t on t.project = n2.project and t.path = n2.path)
select project, '' as path, cast(0 as bigint) as depth, '' as sort_key, project as line from (select distinct project from f) p
union all select * from lines"""


def _tree(spark, sf, style):
    c = FX.corpus_v(spark, sf)
    files = INV.prune_dirs(INV.drop_hidden(c.select("project", "path")), ["target"])
    ann = ST.load_annotations(FX.state_v(spark, sf, c), require="description")
    return R.tree_lines(files, ann, style)


@register("tree_view", _tree_sql("classic"), ("state_v", "corpus_v"))
def tree_view(spark, sf):
    return _tree(spark, sf, "classic")


@register("tree_style", _tree_sql("emoji"), ("state_v", "corpus_v"))
def tree_style(spark, sf):
    return _tree(spark, sf, "emoji")
