"""Corpus from a table (S1 on table input) and the fingerprint/profile step.

Canonical corpus columns: ``project, path, size, mtime, head, content_hash, hash_algo``.
``head`` holds the whole content, or its first ``head_bytes`` bytes where a caller asks for that; it is
produced lazily, so Catalyst prunes it from every plan that does not use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

HASH_ALGO = "sha256"


def corpus_from_table(df: DataFrame, project: str = "project", path: str = "path", content: str = "content",
                      mtime: str | None = None, content_is_binary: bool = False, head_bytes: int | None = None) -> DataFrame:
    """Accept any table with ``(project, path, content)`` as the inventory.

    The hash covers the whole content; ``head`` too, unless ``head_bytes`` limits it.
    """
    c = F.col(content)
    data = c if content_is_binary else F.encode(c, "UTF-8")
    return df.select(
        F.col(project).alias("project"),
        F.col(path).alias("path"),
        F.octet_length(c).cast("long").alias("size"),
        (F.col(mtime).cast("timestamp") if mtime else F.lit(None).cast("timestamp")).alias("mtime"),
        (data if head_bytes is None else F.substring(data, 1, head_bytes)).alias("head"),
        F.sha2(data, 256).alias("content_hash"),
        F.lit(HASH_ALGO).alias("hash_algo"),
    )


def fingerprint(corpus: DataFrame, text_sample: int = T.TEXT_SAMPLE_BYTES, keep_head: bool = False,
                text_rule: str = "bytes") -> DataFrame:
    """Per file: name, extension, type labels, text flag, splitter route. Content is dropped here, so
    nothing heavy ever reaches a shuffle."""
    from ..operators.chunking import route_splitter

    name = P.path_name("path")
    ext = P.extension(name)
    ctype = T.content_type("head", ext)
    return corpus.select(
        "project", "path", "size", "mtime", "content_hash",
        name.alias("name"), ext.alias("extension"), P.file_type(name).alias("file_type"),
        T.human_bytes("size").alias("size_label"), ctype.alias("content_type"),
        T.is_probably_text("head", text_sample, text_rule).alias("is_text"),
        *(["head"] if keep_head else []),
    ).withColumn("splitter", route_splitter(F.col("content_type"), F.col("extension")).getField("splitter")) \
     .withColumn("language", route_splitter(F.col("content_type"), F.col("extension")).getField("language"))
