"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A window's words are vectors: the word's log odds of toxicity, the largest and the mean log odds of its character
n-grams, and a learned mean embedding of the n-grams. Two GRUs read the window in both directions, attention pools
their states, a logistic unit scores it. Windows of WINDOW words, from every STRIDE-th word, cover the whole text; all
are scored and the highest counts, after a calibration of document scores.

Everything is numpy and trained here. The fit uses a bounded sample of labelled rows (SAMPLE per class, chosen by a
hash of the id, held-out rows left out). Its log odds are counted on the executors. A label belongs to a whole text, and
a text's score is that of its highest window; so training goes in ROUNDS: the executors score every window of every
sampled text, at first by log odds, then by the network as it is, and hand on each text's highest window and, of clean
texts, MORE_CLEAN others next to it in rank; the driver trains on the windows of all rounds. A word of a window travels as its numbers: three
log odds and how often each row of the embedding occurs among its n-grams, at most 2**EMBED_BITS of them however long
it is. Sizes of all tables are fixed, so what is broadcast doesn't grow with the data.
Scoring reads texts where they stand, without a shuffle; word vectors are computed once per distinct word of a chunk.

Defined cases: null text counts as empty; a text without words scores 0; without labels all documents score the
same; repeated labels of an id, and labels of equal texts, count once (toxic if any is); null ids are members of no
sample; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Chunk, LOWER, checkpoint, chunks, crc_mod, documents, mix, ready_workers

WORD_BITS, GRAM_BITS, EMBED_BITS = 18, 18, 12
GRAM_SIZES = (3, 4, 5)
EMBED, HIDDEN, ATTEND = 6, 8, 8
INPUT = 3 + EMBED
WINDOW, STRIDE = 32, 16
#: Labelled rows of either class that the fit uses at most.
SAMPLE = 2500
HELD_OUT = 5
#: Adam steps: EPOCHS over the windows, STEPS at least; the rate falls to zero.
EPOCHS, STEPS, BATCH, RATE = 6, 800, 64, 0.01
#: Times that all windows of the sample are scored to choose training windows, and how many more a clean text gives.
ROUNDS, MORE_CLEAN = 2, 1


class Vocabulary:
    """The distinct words of a chunk with their buckets and those of their character n-grams."""

    def __init__(self, c: Chunk):
        starts, ends, self.at = c.words()
        low = LOWER[c.data]
        h = c.hashes(starts, ends, lower=True)
        _, first, self.token = np.unique(h, return_index=True, return_inverse=True)
        self.word = (h[first] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        self.starts, self.lengths = starts[first], (ends - starts)[first]
        self.gram, self.gram_at = self.grams(low)

    def grams(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of the n-grams of ``<word>``, and their offsets by word."""
        n = self.lengths + 2
        at = np.concatenate([[0], np.cumsum(n)])
        flat = np.arange(at[-1]) - np.repeat(at[:-1], n)
        source = np.repeat(self.starts, n) + flat - 1
        edge = (flat == 0) | (flat == np.repeat(n, n) - 1)
        symbols = np.where(edge, np.where(flat == 0, 1, 2), low[np.clip(source, 0, max(len(low) - 1, 0))] if len(low) else 0).astype(np.uint64)
        found, owner = [], []
        left = np.repeat(n, n) - flat
        who = np.repeat(np.arange(len(n)), n)
        key = symbols.copy()
        for size in range(2, max(GRAM_SIZES) + 1):
            key = key[: len(symbols) - size + 1] << np.uint64(8) | symbols[size - 1 :] if len(symbols) >= size else key[:0]
            if size in GRAM_SIZES:
                ok = np.flatnonzero(left[: len(key)] >= size)
                found.append(mix(key[ok] + np.uint64(size << 56)))
                owner.append(who[ok])
        found, owner = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return found[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int64)


def segment(fun, values: np.ndarray, at: np.ndarray, empty: float = 0.0) -> np.ndarray:
    """fun.reduceat over consecutive segments; empty ones give ``empty``."""
    size = np.diff(at)
    if not len(values):
        return np.full((len(size), *values.shape[1:]), empty, values.dtype)
    out = fun.reduceat(values, np.minimum(at[:-1], len(values) - 1), axis=0)
    out[size == 0] = empty
    return out


def odds_counts(rows: DataFrame) -> DataFrame:
    """(toxic, text) → (bucket, toxic, n): in how many texts each word bucket, then n-gram bucket, occurs."""
    ready_workers(rows.sparkSession)

    def run(batches):
        counts = np.zeros((2, (1 << WORD_BITS) + (1 << GRAM_BITS)), np.int32)
        for b in batches:
            toxic = b.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(b.column(1)):
                v = Vocabulary(c)
                for i in range(c.n):
                    own = np.unique(v.token[v.at[i] : v.at[i + 1]])
                    grams = np.concatenate([v.gram[v.gram_at[w] : v.gram_at[w + 1]] for w in own] or [v.gram[:0]])
                    counts[toxic[c.first + i], np.unique(v.word[own])] += 1
                    counts[toxic[c.first + i], np.unique(grams >> np.uint64(64 - GRAM_BITS)).astype(np.int64) + (1 << WORD_BITS)] += 1
        kind, bucket = np.nonzero(counts)
        for i in range(0, len(kind), 100_000):
            k, x = kind[i : i + 100_000], bucket[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(counts[k, x].astype(np.int64))], ["bucket", "toxic", "n"])

    return rows.select("toxic", "text").mapInArrow(run, "bucket int, toxic int, n long").groupBy("bucket", "toxic").agg(F.sum("n").alias("n"))


def log_odds(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Shrunk log odds of each bucket, scaled to about one."""
    a, b = counts[1], counts[0]
    odds = np.log((a + 0.5) / (totals[1] + 1)) - np.log((b + 0.5) / (totals[0] + 1))
    n = a + b
    return (odds * n / (n + 5) / 4).astype(np.float32)


# The network ------------------------------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def new_net(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shape = {"embed": (1 << EMBED_BITS, EMBED), "wf": (INPUT, 3 * HIDDEN), "wb": (INPUT, 3 * HIDDEN), "uf": (HIDDEN, 3 * HIDDEN), "ub": (HIDDEN, 3 * HIDDEN), "bf": (3 * HIDDEN,), "bb": (3 * HIDDEN,), "wa": (2 * HIDDEN, ATTEND), "ba": (ATTEND,), "va": (ATTEND,), "wo": (2 * HIDDEN,), "bo": (1,)}
    return {k: (np.zeros(s) if k[0] == "b" else rng.normal(0, 0.1 if k == "embed" else 1 / np.sqrt(s[0]), s)).astype(np.float32) for k, s in shape.items()}


def gru(x: np.ndarray, m: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, B, H) of a GRU over projected inputs x (T, B, 3H) with mask m (T, B); keep collects steps to go back."""
    steps, n, _ = x.shape
    h, out = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps):
        g = h @ u
        zr = sigmoid(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        new = np.where(m[t][:, None], new, h)
        if keep is not None:
            keep.append((h, z, r, c, g[:, 2 * HIDDEN :]))
        h = out[t] = new
    return out


def gru_back(dout: np.ndarray, m: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    steps, n, _ = dout.shape
    dx, du, dh = np.zeros((steps, n, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, gn = kept[t]
        dh = dh + dout[t]
        on = m[t][:, None]
        d = np.where(on, dh, 0)
        dz, dc = d * (h - c) * z * (1 - z), d * (1 - z) * (1 - c * c)
        dr = dc * gn * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dc], 1)
        dg = np.concatenate([dz, dr, dc * r], 1)
        du += h.T @ dg
        dh = np.where(on, d * z, dh) + dg @ u.T
    return dx, du


def pool(p: dict, states: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of windows by attention over states (T, B, 2H)."""
    a = np.tanh(states @ p["wa"] + p["ba"])
    s = np.where(m, a @ p["va"], np.float32(-1e9))
    w = np.exp(s - s.max(0))
    w /= w.sum(0)
    context = np.einsum("tb,tbh->bh", w, states)
    return context @ p["wo"] + p["bo"], (a, w, context)


def project(p: dict, fixed: np.ndarray, embedded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.concatenate([fixed, embedded], -1)
    return x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]


def logits(p: dict, xf: np.ndarray, xb: np.ndarray, m: np.ndarray) -> np.ndarray:
    states = np.concatenate([gru(xf, m, p["uf"]), gru(xb[::-1], m[::-1], p["ub"])[::-1]], 2)
    return pool(p, states, m)[0]


def gradients(p: dict, fixed: np.ndarray, embedded: np.ndarray, m: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean logistic loss: of the parameters, and of the embedded inputs (T, B, EMBED)."""
    xf, xb = project(p, fixed, embedded)
    kf: list = []
    kb: list = []
    states = np.concatenate([gru(xf, m, p["uf"], kf), gru(xb[::-1], m[::-1], p["ub"], kb)[::-1]], 2)
    logit, (a, w, context) = pool(p, states, m)
    d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    g = {"wo": context.T @ d, "bo": np.array([d.sum()], np.float32)}
    dcontext = d[:, None] * p["wo"]
    dw = np.einsum("bh,tbh->tb", dcontext, states)
    ds = w * (dw - (w * dw).sum(0))
    g["va"] = np.einsum("tb,tba->a", ds, a)
    da = ds[..., None] * p["va"] * (1 - a * a)
    flat = states.reshape(-1, 2 * HIDDEN)
    g["wa"], g["ba"] = flat.T @ da.reshape(-1, ATTEND), da.sum((0, 1))
    dstates = w[..., None] * dcontext + da @ p["wa"].T
    dxf, g["uf"] = gru_back(dstates[..., :HIDDEN], m, p["uf"], kf)
    dxb, g["ub"] = gru_back(dstates[::-1, :, HIDDEN:], m[::-1], p["ub"], kb)
    dxb = dxb[::-1]
    x = np.concatenate([fixed, embedded], -1).reshape(-1, INPUT)
    g["wf"], g["wb"] = x.T @ dxf.reshape(-1, 3 * HIDDEN), x.T @ dxb.reshape(-1, 3 * HIDDEN)
    g["bf"], g["bb"] = dxf.sum((0, 1)), dxb.sum((0, 1))
    dx = dxf @ p["wf"].T + dxb @ p["wb"].T
    return g, dx[..., 3:]


class Model:
    """Log-odds tables, network and calibration; scores chunks of texts."""

    def __init__(self, odds: np.ndarray):
        self.word_odds, self.gram_odds = odds[: 1 << WORD_BITS], odds[1 << WORD_BITS :]
        self.net = new_net()
        self.slope, self.offset = 1.0, 0.0

    def inputs(self, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Fixed inputs of the distinct words, and the embedding rows of their n-grams."""
        o = self.gram_odds[(v.gram >> np.uint64(64 - GRAM_BITS)).astype(np.int64)]
        n = np.maximum(np.diff(v.gram_at), 1)
        fixed = np.stack([self.word_odds[v.word], segment(np.maximum, o, v.gram_at), segment(np.add, o, v.gram_at) / n], 1)
        return fixed.astype(np.float32), (v.gram & np.uint64((1 << EMBED_BITS) - 1)).astype(np.int64)

    def embedded(self, v: Vocabulary, rows: np.ndarray) -> np.ndarray:
        n = np.maximum(np.diff(v.gram_at), 1)[:, None].astype(np.float32)
        return segment(np.add, self.net["embed"][rows], v.gram_at) / n

    def window_logits(self, v: Vocabulary, most: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins, ends and logits of all windows."""
        begin, end = windows(v.at)
        out = np.empty(len(begin), np.float32)
        fixed, rows = self.inputs(v)
        xf, xb = project(self.net, fixed, self.embedded(v, rows))
        for i in range(0, len(begin), most):
            at = begin[i : i + most] + np.arange(WINDOW)[:, None]
            words = v.token[np.minimum(at, len(v.token) - 1)]
            out[i : i + most] = logits(self.net, xf[words], xb[words], at < end[i : i + most])
        return begin, end, out

    def chunk_logits(self, c: Chunk) -> np.ndarray:
        """Highest window logit of each text; -inf without words."""
        v = Vocabulary(c)
        out = np.full(c.n, -np.inf)
        if len(v.token):
            begin, _, score = self.window_logits(v)
            np.maximum.at(out, np.searchsorted(v.at, begin, "right") - 1, score)
        return out

    def chance(self, logit: np.ndarray) -> np.ndarray:
        return np.where(np.isneginf(logit), 0.0, 1 / (1 + np.exp(-np.clip(self.slope * np.where(np.isneginf(logit), 0, logit) + self.offset, -30, 30))))


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends, in tokens, of all overlapping windows of texts with token offsets at."""
    n = np.diff(at)
    each = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    first = np.repeat(np.cumsum(each) - each, each)
    begin = np.repeat(at[:-1], each) + (np.arange(each.sum()) - first) * STRIDE
    return begin, np.minimum(begin + WINDOW, np.repeat(at[1:], each))


def training_windows(rows: DataFrame, model: Model, trained: bool) -> DataFrame:
    """(toxic, text) → (toxic, sizes, fixed, gram_n, gram, often): of every text the highest of all its windows, by the
    network if it is trained, else by log odds, and of clean texts MORE_CLEAN others in the order of rank.

    Per word of the window: fixed inputs, how many embedding rows its n-grams have, which, and how often each.
    """
    ready_workers(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = ["toxic", "fixed", "gram_n", "gram", "often"]

    def run(batches):
        m = shared.value
        for b in batches:
            toxic, found = b.column(0).to_numpy(zero_copy_only=False), []
            for c in chunks(b.column(1)):
                v = Vocabulary(c)
                if not len(v.token):
                    continue
                fixed, rows = m.inputs(v)
                if trained:
                    begin, end, rank = m.window_logits(v)
                else:
                    begin, end = windows(v.at)
                    weight = np.concatenate([(2 * fixed[:, 0] + fixed[:, 1])[v.token], np.full(WINDOW, -9)])
                    at = begin + np.arange(WINDOW)[:, None]
                    rank = np.where(at < end, weight[at], -9).max(0)
                text = np.searchsorted(v.at, begin, "right") - 1
                order = np.lexsort((begin, -rank, text))
                place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
                label = toxic[c.first + text[order]]
                for w in order[place <= np.where(label == 1, 0, MORE_CLEAN)].tolist():
                    words = v.token[begin[w] : end[w]]
                    size = np.diff(v.gram_at)[words]
                    pick = np.repeat(v.gram_at[words] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    key, often = np.unique(np.repeat(np.arange(len(words)), size) << EMBED_BITS | rows[pick], return_counts=True)
                    n = np.bincount(key >> EMBED_BITS, minlength=len(words))
                    found.append((int(toxic[c.first + text[w]]), fixed[words].tobytes(), n.astype(np.int32).tobytes(), (key & ((1 << EMBED_BITS) - 1)).astype(np.int32).tobytes(), often.astype(np.float32).tobytes()))
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(x, pa.binary()) for x in columns[1:])], names)

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, fixed binary, gram_n binary, gram binary, often binary")


class Windows:
    """Training windows: kinds, word offsets, and the words' numbers; each distinct window once, in a fixed order."""

    def __init__(self, rows: set):
        rows = sorted(rows)
        self.kinds = np.array([r[0] for r in rows], np.int64)
        parts = [np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in ((1, np.float32), (2, np.int32), (3, np.int32), (4, np.float32))]
        self.fixed, self.gram, self.often = parts[0].reshape(-1, 3), parts[2].astype(np.int64), parts[3]
        self.at = np.concatenate([[0], np.cumsum([len(r[2]) // 4 for r in rows])]).astype(np.int64)
        self.gram_at = np.concatenate([[0], np.cumsum(parts[1])]).astype(np.int64)
        total = segment(np.add, self.often, self.gram_at)
        self.share = (self.often / np.repeat(np.maximum(total, 1), np.diff(self.gram_at))).astype(np.float32)[:, None]

    def __len__(self) -> int:
        return len(self.kinds)


def train(model: Model, w: Windows, seed: int = 3) -> None:
    """Adam on windows, in place."""
    if not len(w) or w.kinds.min() == w.kinds.max():
        model.net["bo"][:] = 3 if len(w) and w.kinds.max() else -3
        return
    p, rng = model.net, np.random.default_rng(seed)
    first = {k: np.zeros_like(x) for k, x in p.items()}
    second = {k: np.zeros_like(x) for k, x in p.items()}
    step, steps = 0, max(STEPS, EPOCHS * -(-len(w) // BATCH))
    while step < steps:
        order = rng.permutation(len(w))
        for i in range(0, len(order), BATCH):
            take = order[i : i + BATCH]
            at = w.at[take] + np.arange(WINDOW)[:, None]
            m = at < w.at[take + 1]
            used, local = np.unique(np.where(m, at, w.at[take]), return_inverse=True)
            local = local.reshape(at.shape)
            size = np.diff(w.gram_at)[used]
            pick = np.repeat(w.gram_at[used] - np.cumsum(size) + size, size) + np.arange(size.sum())
            rows, share, near = w.gram[pick], w.share[pick], np.concatenate([[0], np.cumsum(size)])
            embedded = segment(np.add, p["embed"][rows] * share, near)
            g, dx = gradients(p, w.fixed[used][local], embedded[local], m, w.kinds[take])
            dword = np.zeros((len(used), EMBED), np.float32)
            np.add.at(dword, local, np.where(m[..., None], dx, 0))
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], rows, np.repeat(dword, size, 0) * share)
            step += 1
            for k in p:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] * g[k] - second[k])
                p[k] -= (RATE * max(0.0, 1 - step / steps) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


def calibrate(model: Model, logit: np.ndarray, toxic: np.ndarray) -> None:
    """Slope and offset of document scores by Newton steps on the logistic loss, with a little smoothing."""
    ok = np.isfinite(logit)
    x, y = logit[ok], toxic[ok].astype(float)
    if not len(x) or y.min() == y.max():
        return
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    goal = np.where(y == 1, hi, lo)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - goal) * x).sum() + 1e-3 * a, (p - goal).sum()])
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        d = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
    if a > 0:
        model.slope, model.offset = float(a), float(b)


def chances(docs: DataFrame, model: Model, extra: str, raw: bool = False) -> DataFrame:
    """docs (with the column extra) → that column, and score: the calibrated chance, or the raw logit."""
    spark = docs.sparkSession
    ready_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            parts = [m.chunk_logits(c) for c in chunks(b.column(1))]
            logit = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(logit if raw else m.chance(logit))], [extra, "score"])

    return docs.select(extra, "text").mapInArrow(run, f"{extra} {docs.schema[extra].dataType.simpleString()}, score double")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from labels (doc_id, toxic), of which at most sample of either class are used."""
    per_id = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(crc_mod(HELD_OUT) != 0)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [per_id.filter(F.col("toxic") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    chosen = F.broadcast(checkpoint(chosen[0].union(chosen[1]).select(F.col("doc_id").alias("_id"), "toxic")))
    rows = checkpoint(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic")))

    got = odds_counts(rows).toArrow()
    counts = np.zeros((2, (1 << WORD_BITS) + (1 << GRAM_BITS)))
    if len(got):
        counts[got.column("toxic").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    per_class = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    model = Model(log_odds(counts, np.array([per_class.get(0, 0), per_class.get(1, 0)])))
    found: set = set()
    for r in range(ROUNDS):
        got = training_windows(rows, model, r > 0).toArrow()
        found |= set(zip(*(got.column(k).to_pylist() for k in got.column_names), strict=True))
        train(model, Windows(found))
    logit = chances(rows, model, "toxic", raw=True).toArrow()
    calibrate(model, logit.column("score").to_numpy(), logit.column("toxic").to_numpy())
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = chances(docs, model, "doc_id")
    return scored.select("doc_id", (crc_mod(HELD_OUT) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict[str, str] = {}
