"""Mixing sources to target weights: fixed-length blocks, multinomial draws per output shard, permuted indexes.

The words of a source, document after document, are packed into blocks of ``block_words`` words. A
source's target is its weight's share of all words, at most ``max_epochs`` times its own size; the
excess is shared again by weight. The target in words fixes how many slots of the output belong to the
source; output shards draw their source counts one after the other from a multinomial over the slots that
are left, so the draws are random and their sums exact. Slot k of a source is block ``k mod n`` under a
pseudorandom permutation of the n block indexes, keyed by the pass ``k div n``, so no block comes
twice in a pass. Blocks reach their slots by a join on (source, block index). The last slot of a source takes
only the words that its target still lacks.

Only narrow rows are sorted. A hot source spans many tasks: its word offsets come from sums per task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import M1, M2, cut, flat, mix, numbered, partitions, slices, text_key

BLOCK_WORDS = 512
SHARD_BLOCKS = 16_384
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
FAN_OUT = 256
WORD = re.compile(r"[^ \t-\r]+")
IS_WORD = np.ones(256, bool)
IS_WORD[[32, *range(9, 14)]] = False


def word_counts(texts: pa.Array) -> np.ndarray:
    data, off = flat(texts)
    inside = IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = off[:-1][off[:-1] < len(data)]
    first[begins] = inside[begins]  # the text before may end in a word
    return np.diff(np.concatenate([[0], np.cumsum(first)])[off])


# ------------------------------------------------------------------ permutations

def _rounds(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix(left ^ k) & mask), left
        else:
            left, right = right, left ^ (mix(right ^ k) & mask)
    return (left << np.uint64(half)) | right


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1 (Feistel rounds, walked until inside), or its inverse."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    keys = mix(np.arange(1, 7, dtype=np.uint64) * M1 ^ np.uint64(key & (1 << 64) - 1))
    x = _rounds(index.astype(np.uint64), half, keys, back)
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = _rounds(x[out], half, keys, back)
    return x.astype(np.int64)


def _key(seed: int, rank: int, epoch: int) -> int:
    return int(mix(np.array([seed], np.uint64) * M2 ^ mix(np.array([rank * 64 + epoch + 1], np.uint64)))[0])


def n_slots(size: int, quota: int, block_words: int, seed: int, rank: int) -> int:
    """Slots of a source of ``size`` words that hold at least ``quota`` words, the last one cut short."""
    if not size or not quota:
        return 0
    n = -(-size // block_words)
    full, rest = divmod(quota, size)
    if not rest:
        return full * n
    short = n * block_words - size  # what the last block lacks
    m = -(-rest // block_words)
    if int(permuted(np.array([n - 1]), n, _key(seed, rank, full), back=True)[0]) < m:
        m = -(-(rest + short) // block_words)
    return full * n + m


# ------------------------------------------------------------------ sources

def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, size`` -> ``source, size, rank, target``. Sources in code point order, null last, weigh ``weights``
    in turn. A target above ``max_epochs`` sizes stops there; the others share what is left by weight, until none is above."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    found = cut(numbered(sizes, F.asc_nulls_last("source")).withColumn("weight", w), "mix-weights")
    most = F.col("size") * F.lit(max_epochs)
    share, n_capped = 0.0, -1
    while True:
        capped = most < F.col("weight") * F.lit(share)
        r = found.agg(F.sum("size").alias("total"), F.sum(F.when(capped, most)).alias("taken"),
                      F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.count_if(capped).alias("n")).first()
        if r.n == n_capped or not r.open:
            break
        share, n_capped = ((r.total or 0) - (r.taken or 0)) / r.open, r.n
    return found.withColumn("target", F.least(F.col("weight") * F.lit(share), most.cast("double")))


# ------------------------------------------------------------------ draws

def draw(quotas: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Counts per shard and source: each shard draws from what is left, never more of a source than that. The
    sizes must add up to the quotas."""
    left, out = quotas.astype(np.int64).copy(), np.zeros((len(sizes), len(quotas)), np.int64)
    for j, n in enumerate(sizes):
        while n:
            p = (left - out[j]) / (left - out[j]).sum()
            more = np.minimum(rng.multinomial(n, p), left - out[j])
            out[j] += more
            n -= int(more.sum())
        left -= out[j]
    return out


def _draw_inside(seed: int, level: int):
    def inside(key, kids: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        kids, shards = kids.sort_values("child"), shards.sort_values("shard")
        got = draw(kids["slots"].to_numpy(), shards["n"].to_numpy(), np.random.default_rng([seed, level, int(key[0])]))
        skip, base = np.cumsum(got, 0) - got, np.cumsum(got, 1) - got + shards["base"].to_numpy()[:, None]
        j, i = np.nonzero(got)
        return pd.DataFrame({"node": kids["child"].to_numpy()[i], "shard": shards["shard"].to_numpy()[j], "n": got[j, i],
                             "base": base[j, i], "skip": skip[j, i]})

    return inside


def shard_counts(sources: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """``rank, slots`` -> ``rank, shard, n, skip, base``: how many slots of a shard each source gets, how many
    of the source's slots earlier shards hold, and the place of its first one in the shard before they are permuted.

    More than ``FAN_OUT`` sources are drawn in groups of ``FAN_OUT`` first, then inside each group, so no task holds
    more than that many sources."""
    spark = sources.sparkSession
    r = sources.agg(F.sum("slots").alias("total"), F.max("rank").alias("top")).first()
    total, depth = int(r.total or 0), 1
    while FAN_OUT ** depth <= (r.top or 0):
        depth += 1
    k = -(-total // shard_blocks)
    edge = lambda i: F.floor(i.cast("decimal(38,0)") * F.lit(total) / F.lit(max(k, 1))).cast("long")
    counts = spark.range(k).select(F.lit(0).cast("long").alias("node"), F.col("id").alias("shard"),
                                   (edge(F.col("id") + 1) - edge(F.col("id"))).alias("n"), F.lit(0).cast("long").alias("base"))
    for level in range(depth - 1, -1, -1):
        children = sources.groupBy(F.floor(F.col("rank") / FAN_OUT ** level).cast("long").alias("child")).agg(F.sum("slots").alias("slots")) \
            .withColumn("node", F.floor(F.col("child") / FAN_OUT).cast("long"))

        counts = children.where("slots > 0").groupBy("node").cogroup(counts.groupBy("node")).applyInPandas(
            _draw_inside(seed, level), "node long, shard long, n long, base long, skip long")
        if level:
            counts = cut(counts.drop("skip"), "mix-counts")
    return counts.withColumnRenamed("node", "rank")


def slots(sources: DataFrame, counts: DataFrame, total: int, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """``rank, shard, slot, block, words``: the block in each slot of the output and how many of its words it takes."""
    k = max(1, -(-total // shard_blocks))

    def fill(batches):
        for b in batches:
            for r in b.to_pylist():
                n, size = -(-r["size"] // block_words), r["size"]
                at = np.arange(r["skip"], r["skip"] + r["n"])
                block = np.empty(len(at), np.int64)
                for e in range(int(at[0]) // n, int(at[-1]) // n + 1):
                    here = np.flatnonzero(at // n == e)
                    block[here] = permuted(at[here] - e * n, n, _key(seed, r["rank"], e))
                words = np.where(block == n - 1, size - (n - 1) * block_words, block_words)
                if at[-1] == r["slots"] - 1 and (rest := r["quota"] % size):
                    last = np.arange((r["slots"] - 1) // n * n, r["slots"] - 1) % n  # the pass up to the last slot
                    seen = len(last) * block_words - (n * block_words - size) * int(
                        permuted(np.array([n - 1]), n, _key(seed, r["rank"], int(at[-1]) // n), back=True)[0] < len(last))
                    words[-1] = rest - seen
                shard = r["shard"]
                place = permuted(r["base"] + np.arange(len(at)), total * (shard + 1) // k - total * shard // k, _key(seed, -1 - shard & 0xFFFFFFFF, 63))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["rank"])), pa.array(np.full(len(at), shard)), pa.array(place),
                                                  pa.array(block), pa.array(words.astype(np.int64))], ["rank", "shard", "slot", "block", "words"])

    rows = counts.join(sources.select("rank", "size", "slots", "quota"), "rank").repartition(partitions(counts.sparkSession), "rank", "shard")
    return rows.mapInArrow(fill, "rank long, shard long, slot long, block long, words long")


# ------------------------------------------------------------------ the mix

@dataclass
class Mix:
    """``rows``: row, id, source, size (and text if kept); ``sources``: source, size, rank, target, quota, slots;
    ``segments``: row, rank, block and the words lo .. hi - 1 of the block that are the row's; ``slots``: see ``slots``."""

    rows: DataFrame
    sources: DataFrame
    segments: DataFrame
    slots: DataFrame

    def taken(self) -> DataFrame:
        """``row, taken``: words of each row that the mix holds, repeats counted; rows without any are left out."""
        words = F.greatest(F.lit(0), F.least("hi", "words") - F.col("lo"))
        return self.slots.join(self.segments, ["rank", "block"]).groupBy("row").agg(F.sum(words).alias("taken"))

    def blocks(self) -> DataFrame:
        """``shard, slot, source, block, n_words, text``: the mixed corpus, words separated by one space. Needs ``keep_text``."""
        def pieces(batches):
            for b in slices(batches):
                out = []
                for r in b.to_pylist():
                    words = WORD.findall(r["text"] or "")
                    out += [(r["rank"], s["block"], s["lo"], words[s["at"]:s["at"] + s["hi"] - s["lo"]]) for s in r["parts"]]
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())))],
                                                 ["rank", "block", "lo", "piece"])

        parts = self.segments.groupBy("row", "rank").agg(F.collect_list(F.struct("block", "lo", "hi", "at")).alias("parts"))
        cut_up = parts.join(self.rows.select("row", "text"), "row").mapInArrow(pieces, "rank long, block long, lo long, piece array<string>")
        whole = cut_up.groupBy("rank", "block").agg(F.flatten(F.array_sort(F.collect_list(F.struct("lo", "piece")))["piece"]).alias("all"))
        return self.slots.join(whole, ["rank", "block"]).join(self.sources.select("rank", "source"), "rank").select(
            "shard", "slot", "source", "block", F.col("words").alias("n_words"), F.array_join(F.slice("all", F.lit(1), F.col("words").cast("int")), " ").alias("text"))


def _packed(rows: DataFrame, sources: DataFrame, block_words: int) -> DataFrame:
    """``row, rank, block, lo, hi, at``: the blocks that each row's words fall into, sources packed in (id, text key) order."""
    spark = rows.sparkSession
    joined = rows.where("size > 0").join(sources.select(F.col("source").alias("_s"), "rank"), F.col("source").eqNullSafe(F.col("_s"))) \
        .select("rank", "id", "_tk", "row", "size")

    def offsets(batches):
        from pyspark import TaskContext
        pid, rank, total = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            ranks, size = b.column(0).to_numpy(), b.column(4).to_numpy()
            if not len(ranks):
                continue
            before = np.cumsum(size) - size
            first = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
            at = before - np.repeat(before[first], np.diff([*first, len(ranks)]))
            if ranks[0] == rank:
                at[ranks == rank] += total
            rank, total = int(ranks[-1]), int(at[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array(at), pa.array(np.full(len(at), pid, np.int32))],
                                             ["rank", "row", "size", "at", "pid"])

    order = ["rank", "id", "_tk", "row"]
    placed = cut(joined.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(
        offsets, "rank long, row long, size long, at long, pid int"), "mix-places")
    # one row per task and source
    sums = placed.groupBy("rank", "pid").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "pid", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    b = F.lit(block_words)
    start, end = F.col("start") + F.col("at"), F.col("start") + F.col("at") + F.col("size")
    spread = placed.join(starts, ["rank", "pid"]).select("row", "rank", start.alias("s"), end.alias("e"), F.explode(
        F.sequence(F.floor(start / b), F.floor((end - 1) / b))).alias("block"))
    lo, hi = F.greatest("s", F.col("block") * b), F.least("e", (F.col("block") + 1) * b)
    return spread.select("row", "rank", "block", (lo - F.col("block") * b).alias("lo"), (hi - F.col("block") * b).alias("hi"),
                         (lo - F.col("s")).alias("at"))


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, weights: tuple[int, ...] = WEIGHTS,
                max_epochs: int = MAX_EPOCHS, seed: int = 11, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> Mix:
    """The mix of all rows of ``docs``. A null text has no words, a null source is a source of its own; rows with equal
    id and text stand next to each other, each counted by itself. Rows without words and empty tables have no slot.
    Other columns are not read. Equal tables give equal mixes."""
    def count(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(word_counts(b.column(3)))], [*b.schema.names, "size"])

    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, source {docs.schema[source_col].dataType.simpleString()}"
    counted = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_key(text_col).alias("_tk"), F.col(text_col).alias("text")) \
        .mapInArrow(count, f"{kinds}, _tk long, text string, size long")
    rows = cut((counted if keep_text else counted.drop("text")).withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, max_epochs)

    def slot_counts(batches):
        for pdf in batches:
            yield pdf.assign(slots=[n_slots(s, q, block_words, seed, r) for s, q, r in zip(pdf["size"], pdf["quota"], pdf["rank"])])

    quota = F.least(F.round("target").cast("long"), F.col("size") * max_epochs)
    kind = rows.schema["source"].dataType.simpleString()
    sources = cut(targets.select("source", "size", "rank", "target", quota.alias("quota")).mapInPandas(
        slot_counts, f"source {kind}, size long, rank long, target double, quota long, slots long"), "mix-sources")
    counts = cut(shard_counts(sources, shard_blocks, seed), "mix-counts")
    total = int(sources.agg(F.sum("slots")).first()[0] or 0)
    return Mix(rows, sources, _packed(rows, sources, block_words), slots(sources, counts, total, block_words, shard_blocks, seed))


def op11(docs: DataFrame) -> DataFrame:
    """The contract's columns: each document's words and what the mix takes of them."""
    mixed = mix_sources(docs.select("doc_id", "text", "source"))
    rows, sources, taken = mixed.rows, mixed.sources, mixed.taken()
    full = rows.join(sources.select(F.col("source").alias("_s"), F.col("size").alias("source_size"), "target"),
                     F.col("source").eqNullSafe(F.col("_s")), "left")
    return full.join(taken, "row", "left").select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                                                  F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
