"""Queries for path operators and inventory filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as FX
from .queries import register
from ..functions import paths as P
from ..operators import inventory as INV

_REL_SQL = """
  select *,
    array_to_string(list_concat(list_transform(range(len(b) - common), lambda x: '..'),
                                list_slice(p, common + 1, len(p))), '/') as rel
  from (select *, coalesce(list_position(list_transform(list_slice(p, 1, m), lambda x, i: x <> b[i]), true) - 1, m) as common
        from (select *, least(len(p), len(b)) as m
              from (select *, case when path = '' then []::varchar[] else string_split(path, '/') end as p,
                              case when base = '' then []::varchar[] else string_split(base, '/') end as b
                    from ({src}) s0) s1) s2) s3"""


@register("relative_path", "select doc_id, rel as relative_path from (" + _REL_SQL.format(src="""
  select doc_id, project, path, case doc_id % 3 when 0 then 'en' when 1 then 'target/en' else '' end as base
  from corpus_v""") + ") r", ("corpus_v",))
def relative_path(spark, sf):
    c = FX.corpus_v(spark, sf)
    base = F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "target/en").otherwise("")
    return c.select("doc_id", P.relative_path("path", base).alias("relative_path"))


_CWDS = ["/data", "/data/{p}", "/data/{p}/sub/dir", "/other"]


@register("root_label", """
select project, cwd, coalesce(nullif(rel, ''), '.') as root_label from (""" + _REL_SQL.format(src="""
  select 0 as doc_id, project, ltrim(root, '/') as path, ltrim(cwd, '/') as base, cwd from (
    select distinct project, '/data/' || project as root from corpus_v) d,
    unnest(['/data', '/data/' || project, '/data/' || project || '/sub/dir', '/other']) t(cwd)""") + ") r",
          ("corpus_v",))
def root_label(spark, sf):
    projects = FX.corpus_v(spark, sf).select("project").distinct()
    cwds = F.array(*[F.concat(F.lit(c.split("{p}")[0]), F.col("project"), F.lit(c.split("{p}")[1])) if "{p}" in c
                     else F.lit(c) for c in _CWDS])
    x = projects.select("project", F.concat(F.lit("/data/"), "project").alias("root"), F.explode(cwds).alias("cwd"))
    return x.select("project", "cwd", P.root_label("root", "cwd").alias("root_label"))


@register("normalize_components", """
select page_id, case when len(k) > 0 then array_to_string(k, '/') end as normalized
from (select page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) || '/./' ||
        cast(page_id as varchar) || '/..', '/'), lambda c: c not in ('', '.', '..')) as k from pages) s""")
def normalize_components(spark, sf):
    p = FX.table(spark, sf, "pages")
    raw = F.concat(F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1), F.lit("/./"),
                   F.col("page_id").cast("string"), F.lit("/.."))
    return p.select("page_id", P.normalize_components(raw).alias("normalized"))


@register("path_parts", """
select project, path, name,
  case when regexp_matches(name, '^.+\\.([^.]*)$') then regexp_extract(name, '^.+\\.([^.]*)$', 1) end as extension,
  case when regexp_matches(name, '^.+\\.([^.]*)$') then regexp_extract(name, '^(.+)\\.[^.]*$', 1) else name end as stem,
  coalesce(case when regexp_matches(name, '^.+\\.([^.]*)$') then regexp_extract(name, '^.+\\.([^.]*)$', 1) end, 'unknown') as file_type,
  regexp_extract(path, '^(.*)/[^/]*$', 1) as parent_path, cast(len(string_split(path, '/')) as bigint) as depth
from (select project, path, regexp_extract(path, '[^/]*$', 0) as name from corpus_v) s""", ("corpus_v",))
def path_parts(spark, sf):
    c = FX.corpus_v(spark, sf)
    name = P.path_name("path")
    return c.select("project", "path", name.alias("name"), P.extension(name).alias("extension"),
                    P.stem(name).alias("stem"), P.file_type(name).alias("file_type"),
                    P.parent_path("path").alias("parent_path"), P.depth("path").cast("long").alias("depth"))


@register("drop_hidden", """
select project, path from corpus_v where not list_bool_or(list_transform(string_split(path, '/'), lambda c: starts_with(c, '.')))""",
          ("corpus_v",))
def drop_hidden(spark, sf):
    return INV.drop_hidden(FX.corpus_v(spark, sf).select("project", "path"))


@register("prune_dirs", """
select project, path from corpus_v
where not list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), ['target', 'node_modules'])""",
          ("corpus_v",))
def prune_dirs(spark, sf):
    return INV.prune_dirs(FX.corpus_v(spark, sf).select("project", "path"), ["target", "node_modules"])


@register("apply_ignore_rules", """
with files as (select project, path from corpus_v),
nodes as (select project, path, false as is_dir from files
          union select distinct project, array_to_string(list_slice(string_split(path, '/'), 1, i), '/'), true
          from files, range(1, len(string_split(path, '/'))) t(i)),
cand as (select project, path, is_dir, unnest(list_concat([''], list_transform(range(1, len(string_split(path, '/'))),
            lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/')))) as rule_dir from nodes),
m as (select c.project, c.path, c.is_dir, r.negated, r.level, r.rule_dir, r.seq from cand c join rules_v r
        on (r.project = c.project or r.project is null) and r.rule_dir = c.rule_dir
      where regexp_full_match(case when c.rule_dir = '' then c.path else substring(c.path, length(c.rule_dir) + 2) end, r.regex)
        and (not r.dir_only or c.is_dir)),
ign as (select project, path, is_dir from m group by project, path, is_dir
        having not arg_max(negated, [level, length(rule_dir), seq]))
select f.project, f.path from files f
where not exists (select 1 from ign i where i.project = f.project and
  ((not i.is_dir and i.path = f.path) or (i.is_dir and starts_with(f.path, i.path || '/'))))""",
          ("corpus_v", "rules_v"))
def apply_ignore_rules(spark, sf):
    c = FX.corpus_v(spark, sf).select("project", "path")
    return INV.apply_ignore_rules(c, FX.rules_v(spark, sf, c))


_LINES_SQL = """
with c as (select doc_id, project, path, regexp_extract(path, '[^/]*$', 0) as name from corpus_v),
lines as (
  select distinct project, line from (
    select project, '*.' || regexp_extract(name, '^.+\\.([^.]*)$', 1) as line from c
      where regexp_matches(name, '^.+\\.([^.]*)$') and regexp_extract(name, '^.+\\.([^.]*)$', 1) <> ''
    union all select project, '/' || split_part(path, '/', 1) || '/' from c where contains(path, '/')
    union all select project, '!' || path from c where doc_id % 7 = 0
    union all select project, '# comment' from c
    union all select project, unnest(['[z-a]', '[[]x', '[!a]*', 'a[+--]b', '[a&&b]']) from c) u),
parsed as (
  select project, line, starts_with(line, '!') as negated,
    case when starts_with(line, '!') then substring(line, 2) else line end as s1 from lines where not starts_with(line, '#')),
p2 as (select *, ends_with(s1, '/') as dir_only, rtrim(s1, '/') as s2 from parsed),
p3 as (select *, contains(s2, '/') as anchored, ltrim(s2, '/') as s3 from p2)
select project, '' as rule_dir, 2 as level, line,
  case line when '[z-a]' then '(?:.*/)?[^\\s\\S]' when '[[]x' then '(?:.*/)?[\\[]x' when '[!a]*' then '(?:.*/)?[^\\/a][^/]*'
    when 'a[+--]b' then '(?:.*/)?a[\\+-\\-]b' when '[a&&b]' then '(?:.*/)?[a\\&\\&b]'
    else case when anchored then '' else '(?:.*/)?' end || replace(replace(s3, '.', '\\.'), '*', '[^/]*') end as regex,
  negated, dir_only, anchored
from p3"""


@register("compile_ignore_patterns", _LINES_SQL, ("corpus_v",))
def compile_ignore_patterns(spark, sf):
    """Ignore lines derived from the corpus (extension globs, anchored directories, re-includes,
    comments) compiled by the Arrow UDF."""
    c = FX.corpus_v(spark, sf)
    ext = P.extension(P.path_name("path"))
    top = F.element_at(F.split("path", "/"), 1)
    lines = (c.where(ext.isNotNull() & (ext != "")).select("project", F.concat(F.lit("*."), ext).alias("line"))
             .unionByName(c.where(F.instr("path", "/") > 0).select("project", F.concat(F.lit("/"), top, F.lit("/")).alias("line")))
             .unionByName(c.where(F.col("doc_id") % 7 == 0).select("project", F.concat(F.lit("!"), "path").alias("line")))
             .unionByName(c.select("project", F.explode(F.array(*map(F.lit, ["# comment", "[z-a]", "[[]x", "[!a]*", "a[+--]b", "[a&&b]"]))).alias("line")))).distinct()
    lines = lines.select("project", F.lit("").alias("rule_dir"), F.lit(2).alias("level"),
                         F.xxhash64("line").alias("seq"), "line")
    return INV.compile_ignore_patterns(lines).select("project", "rule_dir", "level", "line", "regex", "negated",
                                                     "dir_only", "anchored")
