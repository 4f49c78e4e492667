"""Histogram sort: balanced, ordered shards from exact counts below iteratively refined key boundaries.

Only a narrow row per document (id, size, checksum, 64-bit sort key) is sorted. The key's upper half
comes from the text, the next quarter from the id and the last from the row's number in the written table of rows, so
equal texts are neighbours, and a large group of equal texts, of equal ids or of repeated rows can still be cut. Each round, every partition counts bytes and rows per cell between
boundaries; the driver adds the counts up and subdivides only cells that hold a splitter not yet
within tolerance, or too many rows. When all splitters are good the rows are exchanged once, by cell;
a row's slot is the count of rows before its cell plus its place in the cell.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LOW, HIGH = -(1 << 63), 1 << 63


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, size, text_crc32, key. A null text is empty. To be written before it is used: the
    key holds the row's number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(0xFFFF))
    key = F.xxhash64(text).bitwiseAND(F.lit(-1 << 32)).bitwiseOR(F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(0xFFFF0000))).bitwiseOR(own)
    return docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"))


def cell_counts(rows: DataFrame, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows between neighbouring boundaries, added up per partition, then over all."""
    inner = np.array(edges[1:-1], np.int64)
    n = len(edges) - 1

    def count(batches):
        size, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            cell = np.searchsorted(inner, b.column(0).to_numpy(zero_copy_only=False), "right")
            np.add.at(size, cell, b.column(1).to_numpy(zero_copy_only=False))
            number += np.bincount(cell, minlength=n)
        full = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(number[full])], ["cell", "size", "n"])

    size, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in (rows.select("key", "size").mapInArrow(count, "cell long, size long, n long")
              .groupBy("cell").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()):
        size[r.cell], number[r.cell] = r["size"], r.n
    return size, number


def find_splitters(rows: DataFrame, n_shards: int, tolerance: float, cell_rows: int, fan_out: int = 256,
                   first_cells: int = 1024) -> tuple[list[int], np.ndarray, list[int]]:
    """Refined cell boundaries, rows in each cell, and the cell at which each shard but the first begins.

    A splitter is good when its distance from the ideal place is at most ``tolerance`` of a shard, or
    when its cell is a single key."""
    edges = [LOW + (HIGH - LOW) * i // first_cells for i in range(first_cells)] + [HIGH]
    while True:
        size, number = cell_counts(rows, edges)
        below = [0, *np.cumsum(size).tolist()]
        total, split = below[-1], set()
        cuts = []
        for j in range(1, n_shards):
            ideal = total * j / n_shards
            c = max(0, min(bisect_left(below, ideal) - 1, len(edges) - 2))
            near = min((abs(below[k] - ideal), k) for k in (c, c + 1))
            cuts.append(near[1])
            if near[0] > tolerance * total / n_shards:
                split.add(c)
        split |= set(np.flatnonzero(number > cell_rows).tolist())
        split = {c for c in split if edges[c + 1] - edges[c] > 1}
        if not split:
            return edges, number, cuts
        edges = sorted(set(edges).union(*({edges[c] + (edges[c + 1] - edges[c]) * i // fan_out for i in range(fan_out)}
                                          for c in split)))


def shard_documents(docs: DataFrame, n_shards: int = 24, tolerance: float = 0.0005, cell_rows: int = 200_000,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot: shards of nearly equal bytes, slots without gaps from 0.

    Extra columns are not read. Repeated rows and null ids are rows like any other, each with a slot of its own,
    and fall into several shards where they are many. An empty table gives no rows."""
    rows = cut(shard_rows(docs, id_col, text_col), "shard-rows")
    edges, number, cuts = find_splitters(rows, n_shards, tolerance, cell_rows)
    inner = np.array(edges[1:-1], np.int64)
    shard = np.searchsorted(np.array(cuts), np.arange(len(number)), "right")
    before = np.concatenate([[0], np.cumsum(number)[:-1]])
    first = np.array([0, *cuts])[shard]
    offset = before - before[np.minimum(first, len(before) - 1)]

    def place(batches):
        for b in batches:
            cell = np.searchsorted(inner, b.column(b.schema.get_field_index("key")).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell.astype(np.int64)), pa.array(shard[cell].astype(np.int32)), pa.array(offset[cell])],
                [*b.schema.names, "cell", "shard", "before"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"id {kind}, size long, text_crc32 long, key long, cell long, shard int, before long")
    within = Window.partitionBy("cell").orderBy("key", "id", "text_crc32", "size")
    return placed.select("id", "size", "text_crc32", "shard",
                         (F.col("before") + F.row_number().over(within) - 1).cast("long").alias("slot"))


def op7(docs: DataFrame) -> DataFrame:
    """The contract's columns; law ``bytes``."""
    return shard_documents(docs).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
