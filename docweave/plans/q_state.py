"""Queries for sources, state merge and change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as FX
from .queries import register
from ..operators import state as ST
from ..operators import metrics as M
from ..sources.corpus import corpus_from_table


def _corpus(spark, sf):
    return FX.corpus_v(spark, sf)


@register("scan_corpus", """
select project, path, cast(strlen(content) as bigint) as size, content_hash, 'sha256' as hash_algo,
  cast(octet_length(encode(content)) > 0 as boolean) as has_head
from corpus_v""", ("corpus_v",))
def scan_corpus(spark, sf):
    c = corpus_from_table(_corpus(spark, sf))
    return c.select("project", "path", "size", "content_hash", "hash_algo",
                    (F.octet_length("head") > 0).alias("has_head"))


@register("content_hash", """
select doc_id, sha256(text) as content_hash, cast(strlen(text) as bigint) as n_bytes from documents""")
def content_hash(spark, sf):
    d = FX.table(spark, sf, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("n_bytes"))


@register("plan_changes", """
select c.project, c.path, c.content_hash,
  case when p.path is null then 'new'
       when p.content_hash = c.content_hash and coalesce(p.description, '') <> '' then 'reuse'
       else 'changed' end as action
from corpus_v c left join prev_v p using (project, path)""", ("corpus_v", "prev_v"))
def plan_changes(spark, sf):
    c = corpus_from_table(_corpus(spark, sf))
    prev = ST.as_state(FX.prev_v(spark, sf))
    return ST.plan_changes(c, prev).select("project", "path", "content_hash", "action")


@register("plan_changes_forced", """
select c.project, c.path, case when p.path is null then 'new' else 'forced' end as action
from corpus_v c left join prev_v p using (project, path)""", ("corpus_v", "prev_v"))
def plan_changes_forced(spark, sf):
    c = corpus_from_table(_corpus(spark, sf))
    return ST.plan_changes(c, ST.as_state(FX.prev_v(spark, sf)), force=True).select("project", "path", "action")


@register("stale_keys", """
select project, path from prev_v p where not exists (select 1 from corpus_v c where c.project = p.project and c.path = p.path)""",
          ("corpus_v", "prev_v"))
def stale_keys(spark, sf):
    return ST.stale_keys(ST.as_state(FX.prev_v(spark, sf)), corpus_from_table(_corpus(spark, sf)))


@register("carry_forward", """
select c.project, c.path, regexp_extract(c.path, '[^/]*$', 0) as name, c.content_hash, p.description
from corpus_v c join prev_v p using (project, path)
where p.content_hash = c.content_hash and p.description <> ''""", ("corpus_v", "prev_v"))
def carry_forward(spark, sf):
    c = corpus_from_table(_corpus(spark, sf))
    prev = ST.as_state(FX.prev_v(spark, sf))
    plan = ST.plan_changes(c, prev)
    return ST.carry_forward(plan, prev).select("project", "path", "name", "content_hash",
                                               F.col("doc.description").alias("description"))


@register("rebase_state", """
select project, concat_ws('/', nullif(base, ''), path) as path, content_hash, description from nested_v""", ("nested_v",))
def rebase_state(spark, sf):
    return ST.rebase_state(FX.nested_v(spark, sf)).select("project", "path", "content_hash", "description")


@register("merge_states", """
select project, path, arg_max(content_hash, rk) as content_hash, arg_max(description, rk) as description
from (select project, path, content_hash, description, 0 as rk from prev_v
      union all select project, concat_ws('/', nullif(base, ''), path), content_hash, description, 1 from nested_v) u
group by project, path""", ("prev_v", "nested_v"))
def merge_states(spark, sf):
    m = ST.merge_states(FX.prev_v(spark, sf), FX.nested_v(spark, sf))
    return m.select("project", "path", "content_hash", "description")


@register("flatten_state", """
select project, path, arg_max(content_hash, ord) as content_hash, arg_max(description, ord) as description
from (select project, path, content_hash, description, 0 as ord from prev_v
      union all select project, concat_ws('/', nullif(base, ''), path), 'nested', description, 1 from nested_v) u
group by project, path""", ("prev_v", "nested_v"))
def flatten_state(spark, sf):
    prev = FX.prev_v(spark, sf).withColumn("ord", F.lit(0))
    nest = ST.rebase_state(FX.nested_v(spark, sf)).drop("base") \
        .withColumn("content_hash", F.lit("nested")).withColumn("ord", F.lit(1))
    return ST.flatten_state(prev.unionByName(nest)).select("project", "path", "content_hash", "description")


@register("load_annotations", """
select project, path, trim(description) as description, trim(emoji) as personality,
  case when joy is null or joy = 'null' then '' when joy like '"%' then json_extract_string(joy, '$') else joy end as joy
from state_v
where trim(description) <> '' or trim(emoji) <> ''
   or (case when joy is null or joy = 'null' then '' when joy like '"%' then json_extract_string(joy, '$') else joy end) <> ''
""", ("state_v",))
def load_annotations(spark, sf):
    return ST.load_annotations(FX.state_v(spark, sf), require="any")


@register("load_annotations_tree", """
select project, path, trim(description) as description from state_v where trim(description) <> ''""", ("state_v",))
def load_annotations_tree(spark, sf):
    return ST.load_annotations(FX.state_v(spark, sf), require="description").select("project", "path", "description")


@register("find_nested_states", """
with inv as (select project, path from corpus_v union all select project, path from markers_v),
marked as (select distinct project, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from inv
           where lower(regexp_extract(path, '[^/]*$', 0)) in ('.docstate.nu', '.docs.nuon'))
select m.project, m.dir from marked m
where not exists (select 1 from marked a where a.project = m.project and a.dir <> m.dir
                  and (a.dir = '' or starts_with(m.dir, a.dir || '/')))""", ("corpus_v", "markers_v"))
def find_nested_states(spark, sf):
    c = _corpus(spark, sf)
    inv = c.select("project", "path").unionByName(FX.markers_v(spark, sf, c))
    return ST.find_nested_states(inv)


@register("nearest_root", """
with inv as (select project, path from corpus_v union all select project, path from markers_v),
roots as (select distinct project, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from inv
          where regexp_extract(path, '[^/]*$', 0) = '.docstate.nuon'),
starts as (select distinct project, regexp_extract(path, '^(.*)/[^/]*$', 1) as start from inv)
select s.project, s.start,
  (select arg_max(r.dir, length(r.dir)) from roots r where r.project = s.project
     and (r.dir = '' or r.dir = s.start or starts_with(s.start, r.dir || '/'))) as root
from starts s""", ("corpus_v", "markers_v"))
def nearest_root(spark, sf):
    c = _corpus(spark, sf)
    inv = c.select("project", "path").unionByName(FX.markers_v(spark, sf, c))
    from ..functions.paths import parent_path
    starts = inv.select("project", parent_path("path").alias("start")).distinct()
    return ST.nearest_root(starts, ST.roots_from_inventory(inv))


@register("run_summary", """
with plan as (
  select c.project, case when p.path is null then 'new'
       when p.content_hash = c.content_hash and p.description <> '' then 'reuse' else 'changed' end as action
  from corpus_v c left join prev_v p using (project, path)),
w as (select project, count(*) as walked, count(*) filter (where action = 'new') as n_new,
        count(*) filter (where action = 'changed') as n_changed, count(*) filter (where action = 'reuse') as n_reuse,
        count(*) filter (where action = 'forced') as n_forced from plan group by project),
e as (select project, count(*) as existing from prev_v group by project),
s as (select project, count(*) as stale from prev_v p
      where not exists (select 1 from corpus_v c where c.project = p.project and c.path = p.path) group by project),
n as (select project, count(distinct base) as nested_states, count(*) as nested_rows from nested_v group by project)
select w.project, w.walked, coalesce(e.existing, 0) as existing, w.n_new, w.n_changed, w.n_reuse, w.n_forced,
  coalesce(s.stale, 0) as stale, coalesce(n.nested_states, 0) as nested_states, coalesce(n.nested_rows, 0) as nested_rows
from w left join e using (project) left join s using (project) left join n using (project)""",
          ("corpus_v", "prev_v", "nested_v"))
def run_summary(spark, sf):
    cv = _corpus(spark, sf)
    c = corpus_from_table(cv)
    prev = ST.as_state(FX.prev_v(spark, sf, cv))
    plan = ST.plan_changes(c, prev)
    return M.run_summary(plan, prev, ST.stale_keys(prev, c), nested=FX.nested_v(spark, sf, cv))


@register("nested_summary", """
select n.project, n.base, count(*) as rows, count(*) filter (where p.path is null) as added
from (select project, base, concat_ws('/', nullif(base, ''), path) as path from nested_v) n
left join prev_v p using (project, path)
group by n.project, n.base""", ("nested_v", "prev_v"))
def nested_summary(spark, sf):
    cv = _corpus(spark, sf)
    return M.nested_summary(FX.prev_v(spark, sf, cv), FX.nested_v(spark, sf, cv))
