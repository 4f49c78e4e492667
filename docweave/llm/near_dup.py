"""Near duplicates by ProbMinHash, banding and exact verification.

Every distinct shingle of a text is a Poisson process whose arrivals fall into ``SLOTS`` slots; a slot keeps
the shingle that arrives first. Two texts agree in a slot with the probability Jaccard of their weighted
shingles. All texts of a slice go round by round; a shingle stops as soon as its next arrival is later than
the latest first arrival of its text.

Links are decided on the sets of shingles, so every text is signed with weight 1 per distinct shingle: two
texts agree in a slot with the Jaccard of their sets, however often a line is repeated in one of them. A text
that repeats a shingle is also signed with the weights, for more candidates (without repeats both are the same).

Equal texts are one vertex. Bands of ``BAND`` slots are keys; a key's smallest vertex (found with partial
sums, so a hot key costs a row per task) leads it, and each other vertex gets one edge to it, never all
pairs. The joins on the key can be split by Spark where a key is hot. Edges are checked on the shingle sets of the whole texts; the checked ones make components. As a leader can differ from two
texts that are alike, a second round goes through the bands that still hold several components and checks
every pair of different components whose sizes and slots allow the similarity. After it no candidate pair
across components is unchecked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, cut, mix, partitions, slices, text_key
from .shingles import shingles

SLOTS, BAND = 160, 5
SIZE, ALIKE = 5, 0.8
TILE_ROWS, TILE_BYTES = 512, 4 << 20


def uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53


def prob_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """The first item to arrive in each slot of each text (0 for texts without items)."""
    best = np.full(n_docs * slots, np.inf)
    first = np.zeros(n_docs * slots, np.uint64)
    time = np.zeros(len(doc))
    state = mix(item ^ M2)
    while len(doc):
        state = mix(state + M1)
        time = time - np.log(uniform(state)) / weight
        slot = doc * slots + (mix(state ^ M2) % np.uint64(slots)).astype(np.int64)
        early = np.flatnonzero(time < best[slot])
        np.minimum.at(best, slot[early], time[early])
        won = early[best[slot[early]] == time[early]]
        first[slot[won]] = item[won]
        live = time < best.reshape(n_docs, slots).max(1)[doc]
        doc, item, weight, time, state = doc[live], item[live], weight[live], time[live], state[live]
    return first.reshape(n_docs, slots)


def band_keys(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key for each band of each text."""
    n, slots = signature.shape
    key = np.broadcast_to(np.arange(slots // band, dtype=np.uint64) * M2, (n, slots // band))
    parts = signature.reshape(n, slots // band, band)
    for k in range(band):
        key = mix((key ^ parts[:, :, k]) * M1 + M2)
    return key.view(np.int64)


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, _tk, v (128-bit hash of the text; null without words), n (distinct shingles), keys (of both signatures),
    sig (a byte per slot of the signature of the set)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in slices(batches, text_col):
            texts = b.column(2)
            doc, item, times = shingles(texts, SIZE)
            n = np.bincount(doc, minlength=len(texts))
            first = prob_minhash(doc, item, np.ones(len(doc)), len(texts))
            sig = (mix(first) >> np.uint64(56)).astype(np.uint8)
            keys = band_keys(first)
            again = np.unique(doc[times > 1])
            rows = np.isin(doc, again)
            weighted = band_keys(prob_minhash(np.searchsorted(again, doc[rows]), item[rows], times[rows].astype(np.float64), len(again)))
            both, new = np.concatenate([keys, keys], 1), np.concatenate([np.ones(keys.shape, bool), np.zeros(keys.shape, bool)], 1)
            both[again, keys.shape[1]:], new[again, keys.shape[1]:] = weighted, weighted != keys[again]
            ends = np.concatenate([[0], np.cumsum(new.sum(1))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(both[new]))
            v = [xxhash.xxh3_128_digest(t.encode()) if k else None for t, k in zip(texts.to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(v, pa.binary()), pa.array(n), keys,
                                              pa.array([x.tobytes() for x in sig], pa.binary())], ["id", "_tk", "v", "n", "keys", "sig"])

    return docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("_tk"), F.col(text_col)).mapInArrow(
        run, f"id {kind}, _tk long, v binary, n long, keys array<long>, sig binary")


def band_members(vertices: DataFrame) -> DataFrame:
    """key, v, n, leader (the key's smallest vertex) of the band keys that several vertices share."""
    rows = vertices.select(F.explode("keys").alias("key"), "v")
    shared = rows.groupBy("key").agg(F.min("v").alias("leader"), F.max("v").alias("other")).where("leader <> other").select("key", "leader")
    return rows.join(shared, "key")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """v, set: the 48 upper bits of each distinct shingle's hash, ascending."""
    def run(batches):
        for b in slices(batches):
            doc, h, _ = shingles(b.column(1), SIZE)
            body = np.ascontiguousarray((h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))]) * 6
            sets = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays([b.column(0), sets.cast(pa.binary())], ["v", "set"])

    return texts.select("v", "text").mapInArrow(run, "v binary, set binary")


def _unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


class _Tile:
    """Rows of one key and pair of tiles, by size: each new row meets the rows before it that are of another component (and of the
    other tile), whose sizes allow the similarity and whose slots agree often enough (six standard deviations below it; a byte
    stands for a slot). What is left is compared set by set. A link joins the two components at once, so only
    links that join something leave the task, and rows of one component never meet again."""

    LEAST = SLOTS * ALIKE - 6 * (SLOTS * ALIKE * (1 - ALIKE)) ** 0.5

    def __init__(self, within: bool):
        self.within = within
        self.n, self.tile, self.home = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.sig = np.zeros((0, SLOTS), np.uint8)
        self.ids, self.sets, self.numbers = [], [], {}

    def add(self, ids: list, n: np.ndarray, labels: list, tile: np.ndarray, sig: np.ndarray, packed: list):
        old = len(self.n)
        home = np.array([self.numbers.setdefault(x, len(self.numbers)) for x in labels], np.int64)
        self.n, self.tile = np.concatenate([self.n, n]), np.concatenate([self.tile, tile])
        self.home, self.sig = np.concatenate([self.home, home]), np.concatenate([self.sig, sig])
        self.ids += ids
        self.sets += packed
        for i in range(old, len(self.n)):
            start = int(np.searchsorted(self.n, ALIKE * self.n[i]))
            near = self.home[start:i] != self.home[i]
            if not self.within:
                near &= self.tile[start:i] != self.tile[i]
            other = start + np.flatnonzero(near)
            other = other[(self.sig[other] == self.sig[i]).sum(1) >= self.LEAST] if len(other) else other
            for j in self._alike(i, other) if len(other) else ():
                if self.home[j] != self.home[i]:
                    yield min(self.ids[i], self.ids[j]), max(self.ids[i], self.ids[j])
                    gone, stays = self.home[j], self.home[i]
                    self.home[self.home == gone] = stays
                    self.numbers = {x: stays if k == gone else k for x, k in self.numbers.items()}

    def _alike(self, i: int, other: np.ndarray) -> list[int]:
        mine = _unpacked(self.sets[i])
        sizes = self.n[other]
        theirs = _unpacked(b"".join(self.sets[j] for j in other))
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
        return other[common >= ALIKE * (self.n[i] + sizes - common)].tolist()


def _tile_links(batches):
    """Rows sorted by key, pair of tiles and size to links between different components."""
    now, tile = None, None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
        borders = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        n, own = b.column(3).to_numpy(), b.column(4).to_numpy()
        ids, labels, sigs, sets = (b.column(i).to_pylist() for i in (5, 6, 7, 8))
        out = []
        for x, y in zip(borders, borders[1:]):
            if now is None or tuple(key[x]) != now:
                now = tuple(key[x])
                tile = _Tile(now[1] == now[2])
            sig = np.frombuffer(b"".join(sigs[x:y]), np.uint8).reshape(y - x, SLOTS)
            out += tile.add(ids[x:y], n[x:y], labels[x:y], own[x:y], sig, sets[x:y])
        a, c = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(c, pa.binary())], ["a", "b"])


def cross_links(named: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: links between different components that share a band key, as many as join them. ``named``: key, v, n, label, sig.

    A key's rows are dealt at random into tiles of about ``TILE_ROWS`` rows and ``TILE_BYTES`` of sets; every pair of a key's tiles is
    one group, so a hot key spreads over tasks and each holds two tiles at most."""
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / TILE_ROWS, F.sum("n") * 6 / TILE_BYTES)).cast("int")
    sized = named.groupBy("key").agg(tiles.alias("tiles"))
    rows = named.join(sized, "key").join(shingle_sets(texts.join(named.select("v").distinct(), "v", "left_semi")), "v")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int"))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = spread.select("key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "n", "tile", "v", "label", "sig", "set")
    return pair.repartition(partitions(named.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n") \
        .mapInArrow(_tile_links, "a binary, b binary").distinct()


def text_pairs(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of the edges whose texts' shingle sets have Jaccard ``ALIKE`` or more."""
    ta = texts.select(F.col("v").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("v").alias("b"), F.col("text").alias("tb"))
    both = edges.select("a", "b").join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")

    def check(batches):
        for b in slices(slices(batches, "ta"), "tb"):
            n = b.num_rows
            # the two sides' distinct shingles, counted together
            da, ha, _ = shingles(b.column(2), SIZE)
            db, hb, _ = shingles(b.column(3), SIZE)
            doc, h = np.concatenate([da, db]), np.concatenate([ha, hb])
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            twice = doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])] if len(doc) else doc
            common = np.bincount(twice, minlength=n)
            union = np.bincount(doc, minlength=n) - common
            yield b.select(["a", "b"]).filter(pa.array((common >= ALIKE * union) & (union > 0)))

    return both.mapInArrow(check, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """v, label: the smallest vertex of each vertex's component (only vertices with an edge).

    Alternating large and small stars; each round is cut off and the rounds grow with the logarithm of a
    component's length."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if state == seen:
            return now.select(F.col("u").alias("v"), F.col("v").alias("label")).unionByName(
                now.select("v", F.col("v").alias("label")).distinct())
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                                F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.where("u <> v").distinct(), "stars")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, _tk, class_id, is_first: the smallest id among the row's near duplicates, itself included, and
    whether the row is the one that names its class.

    Texts without a word are alone in their class. A text of one to four words is one shingle. Equal texts
    (repeated rows too) share a class; a null id is smaller than any other but never a class's name unless
    all its ids are null."""
    signed = cut(sign(docs, id_col, text_col), "signed")
    firsts = signed.where("v is not null").groupBy("v").agg(F.min(F.struct("id", "_tk")).alias("row"))
    own = firsts.select(F.col("v").alias("fv"), "row")
    vertices = cut(signed.join(own, (F.col("v") == F.col("fv")) & F.struct("id", "_tk").eqNullSafe(F.col("row")))
                   .dropDuplicates(["v"]).select("v", "row", "n", "keys", "sig"), "vertices")
    members = cut(band_members(vertices), "members")
    edges = cut(members.where("v <> leader").select(F.col("leader").alias("a"), F.col("v").alias("b")).distinct(), "candidates")

    wanted = members.select("v").distinct().join(vertices, "v") \
        .select("v", F.col("row.id").alias("_id"), F.col("row._tk").alias("_rk"))
    keyed = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("_tk"), F.col(text_col).alias("text"))
    texts = cut(keyed.join(wanted.hint("shuffle_hash"), keyed["id"].eqNullSafe(wanted["_id"]) & (keyed["_tk"] == wanted["_rk"]))
                .select("v", "text").dropDuplicates(["v"]), "texts")

    linked = cut(text_pairs(edges, texts), "links")
    labels = components(linked)
    # second round: bands that still hold several components
    named = members.join(labels, "v", "left").select("key", "v", F.coalesce("label", "v").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    named = named.join(mixed, "key", "left_semi").join(vertices.select("v", "n", "sig"), "v").select("key", "v", "n", "label", "sig")
    late = cut(cross_links(cut(named, "mixed"), texts), "late-links")
    if not late.isEmpty():
        labels = components(linked.unionByName(late))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_tk")).alias("first")
    homes = signed.where("v is not null").groupBy("v").agg(first).join(labels, "v", "left").select("v", "first", F.coalesce("label", "v").alias("label"))
    names = homes.groupBy("label").agg(F.min("first").alias("first"))
    of = homes.select("v", "label").join(names, "label").select("v", F.col("first.id").alias("class_id"), F.col("first._tk").alias("class_tk"))
    alone = F.col("v").isNull()
    return signed.join(of, "v", "left").select(
        "id", "_tk", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        (alone | (F.col("id").eqNullSafe(F.col("class_id")) & F.col("_tk").eqNullSafe(F.col("class_tk")))).alias("is_first"))


def op8(docs: DataFrame) -> DataFrame:
    return classes(docs).select(F.col("id").alias("doc_id"), "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id (one row of equal rows); all columns."""
    found = classes(docs).where("is_first").groupBy(F.col("id").alias("_id"), F.col("_tk").alias("_rk")).agg(F.count("*").alias("_rows"))
    keyed = docs.withColumn("_tk", text_key())
    kept = keyed.join(found.hint("shuffle_hash"), keyed["doc_id"].eqNullSafe(found["_id"]) & keyed["_tk"].eqNullSafe(found["_rk"])) \
        .drop("_id", "_rk")

    columns = docs.columns

    def first_rows(batches):
        """Equal rows stand in one partition, as they have one key."""
        seen = set()
        for b in batches:
            keep = []
            for doc, tk, n in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "_tk", "_rows"))):
                keep.append(n == 1 or (doc, tk) not in seen)
                if n > 1:
                    seen.add((doc, tk))
            yield b.filter(pa.array(keep, pa.bool_())).select(columns)

    return kept.mapInArrow(first_rows, docs.schema)
