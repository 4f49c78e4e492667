"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; any other text is unlabelled, a mixture whose toxic share
is the class prior. A linear model over hashed words and word beginnings (present or not) minimises

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with the logistic loss; when the second part falls below zero the step goes uphill on it instead, so
the model can't win by calling the positives in the unlabelled part negative. Only features clearly
more frequent among the positives than in the unlabelled part take part, so a long text of common words
gathers no weight. The model is fitted with numpy on bounded samples (``max_positive``, ``max_unlabelled`` documents, the smallest hashes of the id);
everything is scored in the scan tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, unique_words

BITS = 18
FOLDS = 5
STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„‘’…¿¡|"


def fold(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo the folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def word_features(part: str) -> list[int]:
    """Hashes of the bare word and of its first five and first four letters."""
    word = part.strip(STRIP)
    if not word:
        return []
    found = [zlib.crc32(word.encode())]
    if len(word) > 5:
        found.append(zlib.crc32(b"5" + word[:5].encode()))
    if len(word) > 4:
        found.append(zlib.crc32(b"4" + word[:4].encode()))
    return [x & ((1 << BITS) - 1) for x in found]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of all texts, one after the other, and how many each has."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    for c in "\n\t\r":
        texts = pc.replace_substring(texts, c, " ")
    words, index, counts = unique_words(texts)
    lists = [word_features(w) for w in words]
    table = np.full((len(lists), 3), -1, np.int64)
    for k in range(3):
        table[:, k] = [x[k] if len(x) > k else -1 for x in lists]
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    pairs = np.unique(doc << 32 | index.astype(np.int64))  # distinct words of each text
    found = table[pairs & 0xFFFFFFFF]
    keys = np.unique(np.where(found >= 0, (pairs >> 32 << BITS)[:, None] | found, -1))
    keys = keys[keys >= 0]
    return keys & ((1 << BITS) - 1), np.bincount(keys >> BITS, minlength=len(texts))


def sums(weights: np.ndarray, feats: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the weights of each row's features."""
    total = np.concatenate([[0.0], np.cumsum(weights[feats], dtype=np.float64)])
    border = np.concatenate([[0], np.cumsum(counts)])
    return np.diff(total[border])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """Sparse rows of present features."""

    def __init__(self, rows: list[np.ndarray]):
        self.counts = np.fromiter(map(len, rows), np.int64, len(rows))
        self.feats = np.concatenate(rows).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.counts)

    def score(self, weights, bias):
        return sums(weights, self.feats, self.counts) + bias

    def gradient(self, each: np.ndarray) -> np.ndarray:
        return np.bincount(self.feats, weights=each[self.row], minlength=1 << BITS)


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], evidence: float = 24.0, least: int = 4) -> np.ndarray:
    """Features that at least ``least`` positives hold, and more of them than of the unlabelled rows, by a
    likelihood ratio of ``evidence`` (about one in a million by chance)."""
    a, b = (np.bincount(np.concatenate(x), minlength=1 << BITS).astype(float) for x in (positive, unlabelled))
    share = len(positive) / (len(positive) + len(unlabelled))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(a > 0, a * np.log(a / ((a + b) * share)), 0) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0))
    return (ratio > evidence) & (a >= least) & (a / len(positive) > b / len(unlabelled))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.1,
          decay: float = 5e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk, over the telling features.

    Without positives or unlabelled rows the model is the prior alone."""
    weights, bias = np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return weights, bias
    seen = telling(positive, unlabelled)
    p, u = (Rows([x[seen[x]] for x in rows]) for rows in (positive, unlabelled))
    m, v = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for step in range(1, steps + 1):
        sp, su = sigmoid(p.score(weights, bias)), sigmoid(u.score(weights, bias))
        negative = np.mean(-np.log1p(-np.minimum(su, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(sp, 1 - 1e-12)))
        # gradients of the two parts by score: d loss(+) = s - 1, d loss(-) = s
        on_p, on_u = -prior * sp / len(sp), su / len(su)
        if negative < 0:
            on_p, on_u = -on_p, -on_u
        else:
            on_p = on_p + prior * (sp - 1) / len(sp)
        g = np.append((p.gradient(on_p) + u.gradient(on_u)) * seen + decay * weights, on_p.sum() + on_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights * seen, bias


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4_000, max_unlabelled: int = 8_000,
        id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """The model from the labels outside fold 0 and the texts of two bounded samples.

    Null labels and null ids take no part; a document labelled twice counts once as a positive; rows that share an id all
    stand for it; other columns are not read; without documents or labels the model is a prior."""
    known = labels.select(F.col("doc_id").alias("id"), "toxic", fold("doc_id").alias("fold")).where("fold <> 0 and toxic is not null")
    n, n_toxic = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    prior = min(0.5, max(0.01, (n_toxic or 0) / n)) if n else 0.1
    by = F.xxhash64("id")
    some = known.where("toxic = 1").select("id", F.lit(1).alias("toxic")).distinct().orderBy(by, "id").limit(max_positive)
    rest = docs.select(F.col(id_col).alias("id")).where(fold("id") != 0).where("id is not null").orderBy(by, "id").limit(max_unlabelled)
    sample = F.broadcast(some.unionByName(rest.select("id", F.lit(0).alias("toxic"))))  # at most the two bounds

    def extract(batches):
        for b in slices(batches, "text"):
            feats, counts = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<i4").tobytes() for x in np.split(feats, np.cumsum(counts)[:-1])], pa.binary())],
                                             ["toxic", "feats"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id").select("toxic", "text") \
        .mapInArrow(extract, "toxic int, feats binary").collect()
    rows = sorted(((r.toxic, r.feats) for r in rows))
    parts = [[np.frombuffer(f, "<i4") for t, f in rows if t == k] for k in (1, 0)]
    return train(*parts, prior)


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus _score, the modelled chance of the toxic label. Null and empty
    texts have the bias's score."""
    weights, bias = model[0].astype(np.float32), model[1]
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB

    def run(batches):
        for b in slices(batches, text_col):
            feats, counts = features(b.column(b.schema.get_field_index(text_col)))
            score = sigmoid(sums(sent.value, feats, counts) + bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*b.schema.names, "_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, unchanged."""
    return score_documents(docs, fit(docs, labels)).where("_score < 0.5").drop("_score")
