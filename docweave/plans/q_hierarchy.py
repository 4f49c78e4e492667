"""Queries for the hierarchy (T1-T4), nested-state import (S2) and the state table write."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as FX
from .queries import register, ts_text
from ..functions.text import trim_ws
from ..operators import hierarchy as H
from ..session import scratch_path
from ..sources import state_io as SIO

PREFIXES_SQL = """select distinct project, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') as path
  from {src}, range(1, len(string_split(path, '/'))) t(i)"""


@register("derive_nodes", """
with f as (select project, path from corpus_v),
d as (""" + PREFIXES_SQL.format(src="f") + """),
n as (select project, path, 'file' as kind from f union all select project, path, 'dir' from d)
select project, path, regexp_extract(path, '^(.*)/[^/]*$', 1) as parent_path, regexp_extract(path, '[^/]*$', 0) as name,
  cast(len(string_split(path, '/')) as bigint) as depth, kind from n""", ("corpus_v",))
def derive_nodes(spark, sf):
    n = H.derive_nodes(FX.corpus_v(spark, sf).select("project", "path"))
    return n.withColumn("depth", F.col("depth").cast("long"))


@register("stamp_dirs", f"""
select project, dir as path, regexp_extract(dir, '[^/]*$', 0) as name, '{FX.RUN_TS.replace(' ', 'T')}Z' as updated_at,
  strftime(max(updated_at), '%Y-%m-%dT%H:%M:%SZ') as content_updated_at, count(*) as n_files
from (select project, updated_at, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') as dir
      from state_v, range(1, len(string_split(path, '/'))) t(i)) e
group by project, dir""", ("state_v",))
def stamp_dirs(spark, sf):
    d = H.stamp_dirs(FX.state_v(spark, sf), F.lit(FX.RUN_TS))
    return d.select("project", "path", "name", ts_text(F.col("updated_at")).alias("updated_at"),
                    ts_text(F.col("content_updated_at")).alias("content_updated_at"), "n_files")


@register("rollup_dirs", """
with f as (select s.doc_id, s.project, s.path, regexp_replace(s.description, '^\\s+|\\s+$', '', 'g') <> '' as documented,
             cast(strlen(c.content) as bigint) as size, l.quality, l.toxic
           from state_v s join corpus_v c using (project, path) left join labels l on l.doc_id = s.doc_id),
e as (select f.*, unnest(list_concat([''], list_transform(range(1, len(string_split(path, '/'))),
        lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/')))) as dir from f)
select project, dir, count(*) as n_files, count(*) filter (where documented) as n_documented, cast(sum(size) as bigint) as bytes,
  count(quality) as n_labeled, cast(coalesce(sum(quality), 0) as bigint) as quality_sum,
  cast(coalesce(sum(toxic), 0) as bigint) as toxic_sum
from e group by project, dir""", ("state_v", "corpus_v"))
def rollup_dirs(spark, sf):
    c = FX.corpus_v(spark, sf)
    sv = FX.state_v(spark, sf, c)
    labels = FX.table(spark, sf, "labels")
    files = sv.select("doc_id", "project", "path", (trim_ws(F.col("doc.description")) != "").alias("documented")) \
        .join(c.select("project", "path", F.octet_length("content").cast("long").alias("size")), ["project", "path"]) \
        .join(labels, "doc_id", "left")
    return H.rollup_dirs(files, {
        "n_files": F.count(F.lit(1)), "n_documented": F.count_if("documented"), "bytes": F.sum("size"),
        "n_labeled": F.count("quality"), "quality_sum": F.coalesce(F.sum("quality"), F.lit(0)).cast("long"),
        "toxic_sum": F.coalesce(F.sum("toxic"), F.lit(0)).cast("long")})


def _state(spark, sf):
    from ..operators.state import as_state
    return as_state(FX.state_v(spark, sf))


@register("nest_export", f"""
with f as (select project, path, content_hash, updated_at, description, joy, emoji from state_v),
d as ({PREFIXES_SQL.format(src='f')}),
ts as (select '"' || replace('{FX.RUN_TS}', ' ', 'T') || 'Z"' as t),
n as (
  select project, path, false as is_dir, '{{"kind":"file","name":' || to_json(regexp_extract(path, '[^/]*$', 0)) || ',"path":' || to_json(path)
    || ',"hash":' || to_json(content_hash) || ',"updated_at":"' || strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') || '","doc":{{"fileDescription":'
    || to_json(description) || ',"joyThisFileBrings":' || coalesce(joy, 'null') || ',"personalityEmoji":' || to_json(emoji) || '}}}}' as json from f
  union all select project, path, true, '{{"kind":"dir","name":' || to_json(regexp_extract(path, '[^/]*$', 0)) || ',"path":' || to_json(path)
    || ',"updated_at":' || t || ',"entries":[' from d, ts),
k as (
  select *, array_to_string(list_transform(string_split(path, '/'), lambda c, i: c || chr(1)
      || (case when i < len(string_split(path, '/')) or is_dir then '0' else '1' end) || chr(2)), '') as ord,
    row_number() over (partition by project, regexp_extract(path, '^(.*)/[^/]*$', 1) order by regexp_extract(path, '[^/]*$', 0), not is_dir) as rn from n)
select project, ord, case when is_dir then 'open' else 'file' end as part, case when rn = 1 then '' else ',' end || json as text from k
union all select project, ord || chr(1114111), 'close', ']}}' from k where is_dir
union all select distinct project, '', 'open', '{{"root":' || to_json(project) || ',"updated_at":' || t || ',"entries":[' from f, ts
union all select distinct project, chr(1114111), 'close', ']}}' from f""", ("state_v",))
def nest_export(spark, sf):
    """Nested JSON tree of every project in ordered fragments."""
    return H.nest_export(_state(spark, sf), F.lit(FX.RUN_TS))


@register("read_state", """
select project, 't' || cast(doc_id // 50 as varchar) as base, path, regexp_extract(path, '[^/]*$', 0) as name, content_hash,
  strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') as updated_at, case when doc_id % 13 = 9 then '' else description end as description,
  case when doc_id % 13 = 9 then null else joy end as joy, case when doc_id % 13 = 9 then '' else emoji end as emoji
from state_v where doc_id // 50 % 7 <> 4 and doc_id % 13 not in (5, 7)""", ("state_v",))
def read_state(spark, sf):
    """Nested trees flattened: directories of any depth, older keys, bad records left out alone, duplicates, trees cut off."""
    s = SIO.read_state_trees(FX.state_trees_v(spark, sf))
    return s.select("project", "base", "path", "name", "content_hash", ts_text(F.col("updated_at")).alias("updated_at"),
                    F.col("doc.description").alias("description"), F.col("doc.joy").alias("joy"),
                    F.col("doc.emoji").alias("emoji"))


@register("write_state", "select project, path, content_hash, description from state_v", ("state_v",))
def write_state(spark, sf):
    """Write the flat state partitioned by project into the shared folder and read it back."""
    path = scratch_path(spark, "state")
    SIO.write_state(_state(spark, sf), path)
    return spark.read.parquet(path).select("project", "path", "content_hash", F.col("doc.description").alias("description"))
