"""Path expressions (P1-P6). Paths are '/'-separated and relative to a project root.

Everything here is a Column -> Column function built from Spark built-ins, so it runs inside
whole-stage codegen and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_or_lit

EXT_PATTERN = r"^.+\.([^.]*)$"


def parts(path) -> Column:
    """Path components; the empty path has none."""
    p = col_or_lit(path)
    return F.when(p == "", F.array().cast("array<string>")).otherwise(F.split(p, "/"))


def path_name(path) -> Column:
    """Last component (the entry's own name)."""
    return F.element_at(F.split(col_or_lit(path), "/"), -1)


def parent_path(path) -> Column:
    """Directory holding the entry; '' for entries at the root."""
    p = col_or_lit(path)
    return F.when(F.instr(p, "/") == 0, F.lit("")).otherwise(F.regexp_extract(p, r"^(.*)/[^/]*$", 1))


def depth(path) -> Column:
    """Number of components."""
    return F.size(parts(path)).cast("int")


def extension(name) -> Column:
    """Text after the last dot; null when there is no dot or the only dot is leading.

    ``.env`` -> null, ``a.`` -> '', ``a.tar.gz`` -> 'gz'.
    """
    n = col_or_lit(name)
    return F.when(n.rlike(EXT_PATTERN), F.regexp_extract(n, EXT_PATTERN, 1))


def stem(name) -> Column:
    """Name without its extension (``a.tar.gz`` -> ``a.tar``, ``.env`` -> ``.env``)."""
    n = col_or_lit(name)
    ext = extension(n)
    return F.when(ext.isNull(), n).otherwise(F.regexp_extract(n, r"^(.+)\.[^.]*$", 1))


def file_type(name) -> Column:
    """Extension, or the word ``unknown`` when there is none."""
    return F.coalesce(extension(name), F.lit("unknown"))


def ancestors(path, include_self: bool = False, include_root: bool = False) -> Column:
    """Array of ancestor directory paths, shallowest first.

    ``a/b/c`` -> ``['a', 'a/b']``; ``include_root`` adds '' in front, ``include_self`` adds the path.
    """
    p = parts(path)
    n = F.size(p) if include_self else F.size(p) - 1
    pref = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.array_join(F.slice(p, 1, i), "/"),
    )
    pref = F.when(n >= 1, pref).otherwise(F.array().cast("array<string>"))
    if include_root:
        pref = F.concat(F.array(F.lit("")), pref)
    return pref


def is_hidden_path(path) -> Column:
    """True when any component starts with a dot (the entry or one of its directories)."""
    return F.exists(parts(path), lambda c: c.startswith("."))


def is_hidden_name(name) -> Column:
    """One-level test used by the list view: only the entry's own name."""
    return col_or_lit(name).startswith(".")


def under_pruned_dir(path, names: list[str]) -> Column:
    """True when a *directory* component (not the last one) is in ``names``."""
    if not names:
        return F.lit(False)
    p = parts(path)
    dirs = F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))


def normalize_components(path) -> Column:
    """Keep only normal components (drop '', '.', '..' and the root); null when none remain."""
    kept = F.filter(F.split(col_or_lit(path), "/"), lambda c: ~c.isin("", ".", ".."))
    return F.when(F.size(kept) > 0, F.array_join(kept, "/"))


def relative_path(path, base) -> Column:
    """``path`` expressed relative to ``base`` (both relative, '/'-separated).

    Common leading components are dropped, each remaining base component becomes '..'.
    Equal paths give ''. Empty base returns the path unchanged.
    """
    p = parts(path)
    b = parts(base)
    m = F.least(F.size(p), F.size(b))
    flags = F.transform(F.slice(p, 1, m), lambda x, i: x != F.element_at(b, i + 1))
    first_diff = F.array_position(flags, True)
    common = F.when(first_diff == 0, m).otherwise(first_diff - 1)
    ups = F.array_repeat(F.lit(".."), (F.size(b) - common).cast("int"))
    rest = F.slice(p, (common + 1).cast("int"), (F.size(p) - common).cast("int"))
    rest = F.when(F.size(p) - common > 0, rest).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(ups, rest), "/")


def root_label(root, cwd) -> Column:
    """Root relative to the working directory, '.' when empty."""
    rel = relative_path(F.regexp_replace(col_or_lit(root), "^/+", ""), F.regexp_replace(col_or_lit(cwd), "^/+", ""))
    return F.coalesce(F.nullif(rel, F.lit("")), F.lit("."))
