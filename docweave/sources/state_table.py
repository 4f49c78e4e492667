"""The run's state as a bucketed table of generations (S5, D5): a run writes its changes, not the state.

    <out>/state/base-<id>/gen=<g>/...     rows of one write, hashed by (project, path) into buckets
    <out>/state/_pointers/<time>-<run>/   one line of JSON: base, buckets, live generations in order

The first generation of a base is a whole state. Later ones hold the rows that a run changed and a mark for each key that it
dropped; the newest generation's row of a key counts. All generations are hashed alike, so Spark reads the state by
bucket: merging generations and joining the state with the inventory need no exchange on the state's side. After
``MAX_GENERATIONS``, or when the changes outgrow the base, a run writes a new base.

A pointer is appended when everything it names is in place; readers take the newest complete one. A failed attempt leaves a
generation that no pointer names. Runs over one output folder follow one another.

Spark knows bucketed files by a catalog entry only: each base has one external table in the session's catalog, made again
from the files wherever it is missing. Dropping it deletes no data.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import DOC_SCHEMA, as_state

KEY = ["project", "path"]
REST = ["name", "content_hash", "hash_algo", "updated_at", "doc"]
MAX_GENERATIONS = 16
BUCKET_ROWS = 100_000
LEAST_BUCKETS = 8


@dataclass(frozen=True)
class Version:
    """A state: its base, the number of buckets, and the live generations (oldest first) with their rows."""

    out_dir: str
    base: str
    buckets: int
    generations: list[str] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    @property
    def location(self) -> str:
        return f"{self.out_dir}/state/{self.base}"

    @property
    def table(self) -> str:
        return "docweave_state_" + hashlib.sha256(self.location.encode()).hexdigest()[:16]

    @property
    def full(self) -> bool:
        """Whether the next write should be a new base."""
        return len(self.generations) >= MAX_GENERATIONS or sum(self.rows[1:]) > self.rows[0]


def _open(spark: SparkSession, v: Version) -> None:
    place = v.location.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {v.table} (project STRING, path STRING, name STRING, content_hash STRING, hash_algo STRING, "
              f"updated_at TIMESTAMP, doc {DOC_SCHEMA}, deleted BOOLEAN, gen STRING) USING parquet PARTITIONED BY (gen) "
              f"CLUSTERED BY (project, path) INTO {v.buckets} BUCKETS LOCATION '{place}'")


def _write(spark: SparkSession, v: Version, rows: DataFrame, run_id: str) -> Version:
    """One more generation; one file per bucket, as the rows are dealt the way the buckets are."""
    gen = f"{int(time.time() * 1e6):020d}-{run_id}-{uuid.uuid4().hex[:6]}"
    _open(spark, v)
    rows.select(*KEY, *REST, "deleted", F.lit(gen).alias("gen")).repartition(v.buckets, *KEY).write.mode("append").format("parquet") \
        .partitionBy("gen").bucketBy(v.buckets, *KEY).saveAsTable(v.table)
    kinds = "project string, path string"
    n = spark.read.schema(kinds).parquet(f"{v.location}/gen={gen}").count() if _exists(spark, f"{v.location}/gen={gen}") else 0
    return Version(v.out_dir, v.base, v.buckets, [*v.generations, gen] if n or not v.generations else v.generations, [*v.rows, n] if n or not v.generations else v.rows)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_base(spark: SparkSession, state: DataFrame, out_dir: str, run_id: str, rows: int) -> Version:
    """A whole state; ``rows`` (as known from the plan) sets the number of buckets."""
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    v = Version(out_dir.rstrip("/"), f"base-{run_id}-{uuid.uuid4().hex[:8]}", buckets)
    return _write(spark, v, as_state(state).withColumn("deleted", F.lit(False)), run_id)


def write_changes(spark: SparkSession, v: Version, changed: DataFrame, gone: DataFrame, run_id: str) -> Version:
    """One generation with the ``changed`` records and a mark for each key of ``gone``."""
    marks = gone.select(*KEY)
    for c in REST:
        marks = marks.withColumn(c, F.lit(None).cast(DOC_SCHEMA if c == "doc" else "timestamp" if c == "updated_at" else "string"))
    rows = as_state(changed).withColumn("deleted", F.lit(False)).unionByName(marks.withColumn("deleted", F.lit(True)))
    return _write(spark, v, rows, run_id)


def read_version(spark: SparkSession, v: Version) -> DataFrame:
    """The state's rows. The frame carries its version as ``state_version``, by which the next run knows what it may leave unwritten."""
    _open(spark, v)
    spark.sql(f"MSCK REPAIR TABLE {v.table}")
    t = spark.table(v.table).where(F.col("gen").isin(v.generations))
    if len(v.generations) == 1:
        out = t.select(*KEY, *REST)
    else:
        newest = F.max_by(F.struct(*REST, "deleted"), "gen").alias("r")
        out = t.groupBy(*KEY).agg(newest).where(~F.col("r.deleted")).select(*KEY, *(F.col(f"r.{c}").alias(c) for c in REST))
    out.state_version = v
    return out


def publish(spark: SparkSession, v: Version, run_id: str) -> None:
    """Makes the version the current one: a new pointer, named so that the newest sorts last."""
    line = json.dumps({"base": v.base, "buckets": v.buckets, "generations": v.generations, "rows": v.rows})
    pointer = f"{v.out_dir}/state/_pointers/{int(time.time() * 1e6):020d}-{run_id}"
    spark.createDataFrame([(line,)], "state string").coalesce(1).write.text(pointer)


def current_version(spark: SparkSession, out_dir: str) -> Version | None:
    """The version named by the newest complete pointer, or None."""
    base = out_dir.rstrip("/")
    jvm = spark.sparkContext._jvm
    d = jvm.org.apache.hadoop.fs.Path(f"{base}/state/_pointers")
    fs = d.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(d):
        return None
    for name in sorted((st.getPath().getName() for st in fs.listStatus(d) if st.isDirectory()), reverse=True):
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/state/_pointers/{name}/_SUCCESS")):
            x = json.loads(spark.read.text(f"{base}/state/_pointers/{name}").first()[0])
            return Version(base, x["base"], x["buckets"], x["generations"], x["rows"])
    return None


def drop_other_tables(spark: SparkSession, keep: list[Version]) -> None:
    """Catalog entries of bases that no kept version uses; their files stay."""
    names = {v.table for v in keep}
    held = {f"{v.out_dir}/state/base-" for v in keep}
    for t in spark.catalog.listTables():
        if t.name.startswith("docweave_state_") and t.name not in names and not t.isTemporary:
            where = [r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {t.name}").collect() if r.col_name == "Location"]
            if any(h in w for w in where for h in held):
                spark.sql(f"DROP TABLE IF EXISTS {t.name}")
