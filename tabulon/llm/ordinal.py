"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector is shared by all grades; ordered thresholds cut its score: P(grade <= k) = sigmoid(t_k - score).
Features are hashed: a text's words, its byte-class trigrams (as relative frequencies) and the share of words that
repeat the word before. The weights have a fixed size, so what is broadcast doesn't grow with the data.

The fit uses a bounded sample of labelled rows (SAMPLE, chosen by a hash of the id, held-out rows left out); feature
counts of the sample are made on the executors. Scoring reads every whole text where it stands, without a shuffle.

The query grades 0 for low quality, 1 for good but toxic, 2 for good and clean; it keeps documents whose probability
of grade 1 or more reaches one half.

Defined cases: null text counts as empty and scores like a text without features; labels that occur repeatedly for
an id count once (highest quality, lowest toxicity); without labels every grade is alike; null ids are held out of
the fit if their hash says so, as any id; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Chunk, checkpoint, chunks, crc_mod, documents, per_text, ready_workers
from tabulon.llm.quality_rules import BITS, grams

WORD_BITS = 18
#: Words, then trigrams, then the repeat share and its square root.
SIZE = (1 << WORD_BITS) + (1 << 3 * BITS) + 2
#: Labelled rows that the fit uses at most.
SAMPLE = 3000
HELD_OUT = 5
STEPS, RATE, DECAY = 120, 0.5, 1e-4
TRIGRAMS = np.uint32((1 << 3 * BITS) - 1)


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and their offsets by text, trigram buckets and theirs, and each text's share of repeated words."""
    starts, ends, at = c.words()
    h = c.hashes(starts, ends, lower=True)
    words = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[at[:-1][at[:-1] < len(h)]] = 0
    n = np.diff(at)
    share = per_text(same, at) / np.maximum(n, 1)
    tri = (grams(c)[0] & TRIGRAMS).astype(np.int64) + (1 << WORD_BITS)
    return words, at, tri, c.at, share


def scores(c: Chunk, w: np.ndarray) -> np.ndarray:
    """The linear score of each text."""
    words, wat, tri, tat, share = features(c)
    s = per_text(w[words].astype(np.float64), wat) / np.maximum(np.diff(wat), 1)
    s += per_text(w[tri].astype(np.float64), tat) / np.maximum(np.diff(tat), 1)
    return s + share * w[-2] + np.sqrt(share) * w[-1]


def sparse_rows(rows: DataFrame) -> DataFrame:
    """(grade, text) → (grade, idx, val): each text's distinct features."""
    ready_workers(rows.sparkSession)

    def run(batches):
        for b in batches:
            idx, val = [], []
            for c in chunks(b.column(1)):
                words, wat, tri, tat, share = features(c)
                for i in range(c.n):
                    w, n = np.unique(words[wat[i] : wat[i + 1]], return_counts=True)
                    t, m = np.unique(tri[tat[i] : tat[i + 1]], return_counts=True)
                    idx.append(np.concatenate([w, t, [SIZE - 2, SIZE - 1]]).astype(np.int32))
                    val.append(np.concatenate([n / max(n.sum(), 1), m / max(m.sum(), 1), [share[i], np.sqrt(share[i])]]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["grade", "idx", "val"])

    return rows.select("grade", "text").mapInArrow(run, "grade int, idx array<int>, val array<float>")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    """The fitted model: weights over hashed features and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: np.ndarray):
        self.weights, self.thresholds, self.grades = weights.astype(np.float32), thresholds, grades

    def tail(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, as columns."""
        return 1 - sigmoid(self.thresholds[None, :] - score[:, None])

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tail(score) @ np.diff(self.grades) if len(self.thresholds) else np.full(len(score), float(self.grades[0]))

    @classmethod
    def fit(cls, grade: np.ndarray, at: np.ndarray, idx: np.ndarray, val: np.ndarray, size: int = SIZE) -> CumulativeLink:
        """Full-batch AdaGrad on the ordinal likelihood; rows are idx/val between consecutive offsets of at."""
        grades = np.unique(grade).astype(np.float64) if len(grade) else np.zeros(1)
        k = len(grades) - 1
        if not k:
            return cls(np.zeros(size), np.zeros(0), grades)
        y = np.searchsorted(grades, grade)
        below = np.array([(y <= i).mean() for i in range(k)]).clip(1e-3, 1 - 1e-3)
        t = np.log(below / (1 - below))
        first, gaps = t[0], np.log(np.maximum(np.diff(t), 1e-2))
        w, seen, seen_t = np.zeros(size), np.full(size, 1e-8), np.full(k, 1e-8)
        n, lengths = len(y), np.diff(at)
        for _ in range(STEPS):
            t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            f = np.add.reduceat(np.append(w[idx] * val, 0.0), np.minimum(at[:-1], len(idx))) * (lengths > 0)
            a = np.where(y < k, sigmoid(t[np.minimum(y, k - 1)] - f), 1.0)
            b = np.where(y > 0, sigmoid(t[np.maximum(y - 1, 0)] - f), 0.0)
            p = np.maximum(a - b, 1e-9)
            df = (1 - a - b) / n
            g = np.bincount(idx, val * np.repeat(df, lengths), size) + DECAY * w / n
            dt = (np.bincount(y[y < k], (-a * (1 - a) / p)[y < k], k) + np.bincount(y[y > 0] - 1, (b * (1 - b) / p)[y > 0], k)) / n
            d = np.concatenate([[dt.sum()], np.exp(gaps) * np.cumsum(dt[::-1])[::-1][1:]])
            seen += g * g
            seen_t += d * d
            w -= RATE * g / np.sqrt(seen)
            step = 0.1 * d / np.sqrt(seen_t)
            first, gaps = first - step[0], gaps - step[1:]
        return cls(w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]), grades)


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> CumulativeLink:
    """The model from ratings (doc_id, grade): at most sample of them, in the order of a hash of the id."""
    chosen = ratings.filter(crc_mod(HELD_OUT) != 0).filter("grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(checkpoint(chosen.select(F.col("doc_id").alias("_id"), F.col("grade").cast("int").alias("grade"))))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("grade", "text")
    got = sparse_rows(rows).toArrow().combine_chunks()
    if not len(got):
        return CumulativeLink(np.zeros(SIZE), np.zeros(0), np.zeros(1))
    idx, val = (got.column(c).combine_chunks() for c in ("idx", "val"))
    at = idx.offsets.to_numpy().astype(np.int64)
    return CumulativeLink.fit(got.column("grade").to_numpy(), at - at[0], idx.flatten().to_numpy().astype(np.int64), val.flatten().to_numpy().astype(np.float64))


def rate(docs: DataFrame, model: CumulativeLink, grade: float = 1, chance: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, expected_grade, tail_probability (of that grade or more), kept."""
    spark = docs.sparkSession
    ready_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        k = int(np.searchsorted(m.grades, grade)) - 1
        for b in batches:
            parts = [scores(c, m.weights) for c in chunks(b.column(2))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            tail = m.tail(s)[:, k] if 0 <= k < len(m.thresholds) else np.full(len(s), float(k < 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m.expected(s)), pa.array(tail), pa.array(tail >= chance)], ["doc_id", "held_out", "expected_grade", "tail_probability", "kept"])

    held = docs.select("doc_id", (crc_mod(HELD_OUT) == 0).alias("held_out"), "text")
    return held.mapInArrow(run, f"doc_id {kind}, held_out boolean, expected_grade double, tail_probability double, kept boolean")


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade from quality and toxic."""
    per_id = labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.min("toxic").alias("t"))
    return per_id.select("doc_id", F.when(F.col("q") == 0, 0).when(F.col("t") == 1, 1).when(F.col("q") == 1, 2).alias("grade"))


def op6_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rate(docs, fit(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))))


QUERIES = {"op6_ordinal_quality": op6_ordinal_quality}
ORACLE_SQL: dict[str, str] = {}
