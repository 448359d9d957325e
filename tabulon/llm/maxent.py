"""LM scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

p(word | history) = p(class | history) * p(slot | class, history) * p(word | slot). The first two factors are softmaxes
whose weights are sums over hashed features of the history: of the class, the word before, the two before together,
the second and the third before alone, and a bias; of the slot, the word before and the two before together, both
crossed with the class, and a bias. Classes hold SLOTS slots each: one slot is the end of a text, one each the most
frequent words (classes are bins of them by frequency), and the rest of the vocabulary shares the TAILS slots of its
words' endings. There p(word | slot) is the word's share of its slot, behind a Good-Turing share for words that were
never seen; so the model is a proper distribution over the known words and one unknown of each ending.

Training is by distributed gradient updates: in each round every task runs AdaGrad steps over its texts from the
broadcast weights, and a weight's change is the mean over the tasks that touched it, by how many tokens did so there.
It needs the list of frequent words only, so no pass depends on the size of the vocabulary.

Counts are exact 64-bit sums by 64-bit word hash over all training documents, and neither counts nor vocabulary ever
reach the driver or a broadcast. Documents are written once with the group they belong to (GROUP_ROWS rows that stood
together). A group's distinct words travel as sorted hash arrays, cut into hash ranges; each range is merged and counted
in one task, which sends every group the counts of the words it asked for; and a group is scored beside its own sorted
arrays. There are as many ranges as files, so a range is about as large as a file's vocabulary whatever the corpus.
Every word occurs at most once in a group's arrays, so frequent words are no hot keys.

Tokens are words with A-Z in lower case, then one end token per text. Documents whose crc32(doc_id) mod 7 is 2 are
held out of all counts and training.

Defined cases: null text counts as empty (one end token); a null id hashes as ``null``; repeated rows count as often
as they occur; long texts are read in pieces of CHUNK_BYTES; without training documents all tokens are unknown; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import LOWER, Chunk, checkpoint, chunks, crc_mod, documents, mix, ready_workers, segment_sum, stored

CLASSES, SLOTS, TAILS = 32, 32, 256
FREQUENT = CLASSES * SLOTS - TAILS - 1
#: Features of class and slot, and the rows of weights of each (as a power of two).
CLASS_FEATURES, CLASS_BITS, SLOT_FEATURES, SLOT_BITS = 4, 13, 2, 14
#: Rows of weights that travel together.
BLOCK = 256
ROUNDS = 2
STEP, RATE = 4096, 0.15
#: Scores between plus and minus this have exponentials that 32-bit floats hold.
EXP_RANGE = 60
#: Documents of a group, as a power of two.
GROUP_ROWS = 14
#: Bytes of text handled at once.
CHUNK_BYTES = 1 << 21
MODULO, HELD_OUT = 7, 2
END, START = np.uint64(0x100), np.uint64(0x200)
_TAIL = np.uint64(TAILS - 1)
_SALT = np.array([0x1234567, 0x89ABCDE, 0xF012345, 0x6789ABC, 0x3456789, 0xABCDEF1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_CROSS = np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, with an end token after each text that ends here, and their offsets by text.

    The low bits of a word's hash tell its ending: a digest of its last two bytes, in lower case like the rest.
    """
    starts, ends, at = c.words()
    h = c.hashes(starts, ends, lower=True)
    if len(h):
        last = LOWER[c.data[ends - 1]].astype(np.uint64)
        second = np.where(ends - starts > 1, LOWER[c.data[np.maximum(ends - 2, 0)]], 0).astype(np.uint64)
        h = (np.maximum(h, np.uint64(1 << 12)) & ~_TAIL) | (last * np.uint64(31) + second * np.uint64(7)) & _TAIL
    n = np.diff(at) + int(c.ends)
    out_at = np.concatenate([[0], np.cumsum(n)])
    out = np.full(out_at[-1], END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(c.n) if c.ends else np.zeros(c.n, np.int64), np.diff(at))] = h
    return out, out_at


class Histories:
    """Token hashes of chunks with the three words before each; remembers the end of a text that goes on."""

    def __init__(self):
        self.tail = np.full(3, START, np.uint64)

    def of(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, offsets, and (3, tokens) hashes of the words one, two and three before."""
        h, at = tokens(c)
        n = len(h)
        place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
        before = np.full((3, n), START, np.uint64)
        for back in (1, 2, 3):
            if back < n:
                before[back - 1, back:] = h[:-back]
            outside = np.flatnonzero(place < back)
            before[back - 1, outside] = START if c.begins else self.tail[back - 1 - place[outside]]
        if not c.ends:
            self.tail = np.concatenate([h[::-1][:3], self.tail])[:3]
        else:
            self.tail = np.full(3, START, np.uint64)
        return h, at, before


def _hashed(keys: list[np.ndarray], salts: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(mix(k ^ s) >> np.uint64(64 - bits)).astype(np.int32) + (i << bits) for i, (k, s) in enumerate(zip(keys, salts, strict=True))], 1)


def class_rows(before: np.ndarray) -> np.ndarray:
    """(tokens, CLASS_FEATURES) rows of the class weights for each token's history."""
    one, two, three = before
    return _hashed([one, one * _CROSS + two, two, three], _SALT[:CLASS_FEATURES], CLASS_BITS)


def slot_rows(before: np.ndarray, group: np.ndarray) -> np.ndarray:
    """(tokens, SLOT_FEATURES) rows of the slot weights for each token's history and class."""
    one, two, _ = before
    crossed = (group.astype(np.uint64) + np.uint64(1)) * _CROSS
    return _hashed([one ^ crossed, (one * _CROSS + two) ^ crossed], _SALT[CLASS_FEATURES:], SLOT_BITS)


class Slots:
    """The slot of each word: 0 for the end, then the frequent words, then one per ending."""

    def __init__(self, frequent: np.ndarray):
        order = np.argsort(frequent)
        self.words, self.rank = frequent[order], order

    def of(self, h: np.ndarray) -> np.ndarray:
        out = CLASSES * SLOTS - TAILS + (h & _TAIL).astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            top = self.words[at] == h
            out[top] = 1 + self.rank[at[top]]
        out[h == END] = 0
        return out


def softmax(w: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    s = w[rows[:, 0]]
    for i in range(1, rows.shape[1]):
        s += w[rows[:, i]]
    s += bias
    ones = np.ones(s.shape[1], np.float32)
    if s.size and s.max() < EXP_RANGE:  # the rows' maxima matter only where exp would overflow or a row vanish
        e = np.exp(s)
        total = e @ ones
        if total.min() > np.exp(-EXP_RANGE):
            e *= (1 / total)[:, None]
            return e
    s -= s.max(1, keepdims=True)
    np.exp(s, out=s)
    s *= (1 / (s @ ones))[:, None]
    return s


def segment_rows(d: np.ndarray, order: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of d's rows, taken in this order, between consecutive edges; rows alone between theirs are copied."""
    size = np.diff(edge, append=len(order))
    out = d[order[edge]]
    several = np.flatnonzero(size > 1)
    if len(several):
        out[several] = np.add.reduceat(d[order[np.repeat(size > 1, size)]], np.cumsum(size[several]) - size[several], axis=0)
    return out


class Weights:
    """Weights and biases of both softmaxes."""

    def __init__(self, sizes: np.ndarray, used: np.ndarray):
        """sizes: tokens by slot; slots that no word can have are never predicted."""
        sizes = np.where(used, sizes + 1.0, 0.0).reshape(CLASSES, SLOTS)
        with np.errstate(divide="ignore"):
            self.class_bias = np.maximum(np.log(sizes.sum(1) / max(sizes.sum(), 1)), -1e9).astype(np.float32)
            self.slot_bias = np.maximum(np.log(sizes / np.maximum(sizes.sum(1, keepdims=True), 1)), -1e9).astype(np.float32)
        self.of_class = np.zeros((CLASS_FEATURES << CLASS_BITS, CLASSES), np.float32)
        self.of_slot = np.zeros((SLOT_FEATURES << SLOT_BITS, SLOTS), np.float32)

    def chances(self, before: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """p(slot | history) of each token's own slot."""
        out, group, inner = np.empty(len(slot)), slot // SLOTS, slot % SLOTS
        for i in range(0, len(slot), STEP):
            cut = slice(i, i + STEP)
            g, here = group[cut], np.arange(len(group[cut]))
            p = softmax(self.of_class, self.class_bias, class_rows(before[:, cut]))[here, g].astype(np.float64)
            out[cut] = p * softmax(self.of_slot, self.slot_bias[g], slot_rows(before[:, cut], g))[here, inner[cut]]
        return out

    def all_chances(self, before: np.ndarray) -> np.ndarray:
        """(tokens, slots) of p(slot | history)."""
        p = softmax(self.of_class, self.class_bias, class_rows(before)).astype(np.float64)
        parts = []
        for k in range(CLASSES):
            g = np.full(before.shape[1], k)
            parts.append(p[:, k : k + 1] * softmax(self.of_slot, self.slot_bias[g], slot_rows(before, g)))
        return np.concatenate(parts, 1)


class Learner:
    """AdaGrad steps of one task from the shared weights, and what changed."""

    def __init__(self, start: Weights):
        self.start = start
        self.tables = [start.of_class.copy(), start.of_slot.copy()]
        self.biases = [start.class_bias.copy(), start.slot_bias.copy()]
        self.seen = [np.full(len(t), 1e-2, np.float32) for t in self.tables]
        self.touched = [np.zeros(len(t), np.float32) for t in self.tables]
        self.total = 0

    def learn(self, before: np.ndarray, slot: np.ndarray) -> None:
        group, inner = slot // SLOTS, slot % SLOTS
        self.total += len(slot)
        for i in range(0, len(slot), STEP):
            cut = slice(i, i + STEP)
            g, here = group[cut], np.arange(len(group[cut]))
            rows = class_rows(before[:, cut])
            d = softmax(self.tables[0], self.biases[0], rows)
            d[here, g] -= 1
            self.biases[0] -= np.float32(RATE) * d.mean(0)
            self.step(0, rows, d, CLASS_BITS)
            rows = slot_rows(before[:, cut], g)
            d = softmax(self.tables[1], self.biases[1][g], rows)
            d[here, inner[cut]] -= 1
            order = np.argsort(g.astype(np.uint8), kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(g[order]) > 0])) if len(g) else order
            if len(g):
                self.biases[1][g[order][edge]] -= np.float32(RATE / len(g)) * np.add.reduceat(d[order], edge, axis=0)
            self.step(1, rows, d, SLOT_BITS)

    def step(self, which: int, rows: np.ndarray, d: np.ndarray, bits: int) -> None:
        w, seen, touched = self.tables[which], self.seen[which], self.touched[which]
        for f in range(rows.shape[1]):
            key = (rows[:, f] - (f << bits)).astype(np.uint16)
            order = np.argsort(key, kind="stable")
            key = key[order]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sums = segment_rows(d, order, edge)
            at = key[edge].astype(np.int64) + (f << bits)
            seen[at] += np.einsum("ij,ij->i", sums, sums) / np.float32(SLOTS)
            sums *= (np.float32(RATE) / np.sqrt(seen[at]))[:, None]
            w[at] -= sums
            touched[at] += np.diff(np.append(edge, len(key))).astype(np.float32)

    def changes(self):
        """(block, bytes): half-precision changes of a block's rows, and how many tokens touched each; biases last."""
        block = 0
        for new, old, touched in zip(self.tables, (self.start.of_class, self.start.of_slot), self.touched, strict=True):
            for i in range(0, len(new), BLOCK):
                if touched[i : i + BLOCK].any():
                    change = np.clip(new[i : i + BLOCK] - old[i : i + BLOCK], -6e4, 6e4).astype(np.float16)
                    yield block, change.tobytes() + touched[i : i + BLOCK].tobytes()
                block += 1
        change = np.vstack([self.biases[0][None] - self.start.class_bias, self.biases[1] - self.start.slot_bias])
        yield block, np.clip(change, -6e4, 6e4).astype(np.float16).tobytes() + np.full(len(change), self.total, np.float32).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = len(data) // (2 * SLOTS + 4)
    return np.frombuffer(data, np.float16, rows * SLOTS).reshape(rows, SLOTS).astype(np.float64), np.frombuffer(data, np.float32, rows, rows * SLOTS * 2).astype(np.float64)


def updates(texts: DataFrame, slots, weights) -> list[tuple[int, bytes]]:
    """One distributed round: for each block the mean changes (float32), weighted by the tokens that touched a row."""

    def run(batches):
        learner, history = Learner(weights.value), Histories()
        for b in batches:
            for c in chunks(b.column(0), CHUNK_BYTES, cut=True):
                h, _, before = history.of(c)
                learner.learn(before, slots.value.of(h))
        if learner.total:
            for block, data in learner.changes():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])

    def merge(batches):
        at, sums, weight = None, None, None

        def done():
            mean = sums / np.maximum(weight, 1)[:, None]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["block", "data"])

        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                change, n = _unpacked(data.as_buffer())
                if block != at:
                    if at is not None:
                        yield done()
                    at, sums, weight = block, np.zeros_like(change), np.zeros_like(n)
                sums += change * n[:, None]
                weight += n
        if at is not None:
            yield done()

    schema = "block int, data binary"
    out = texts.select("text").mapInArrow(run, schema)
    got = out.repartition("block").sortWithinPartitions("block").mapInArrow(merge, schema).toArrow()
    return list(zip(got.column("block").to_pylist(), got.column("data").to_pylist(), strict=True))


def moved(w: Weights, changes: list[tuple[int, bytes]]) -> Weights:
    """The weights after a round."""
    first = (CLASS_FEATURES << CLASS_BITS) // BLOCK
    last = first + (SLOT_FEATURES << SLOT_BITS) // BLOCK
    for block, data in changes:
        change = np.frombuffer(data, np.float32).reshape(-1, SLOTS)
        if block == last:
            w.class_bias, w.slot_bias = w.class_bias + change[0], w.slot_bias + change[1:]
        elif block < first:
            w.of_class[block * BLOCK : (block + 1) * BLOCK] += change
        else:
            w.of_slot[(block - first) * BLOCK : (block - first + 1) * BLOCK] += change
    return w


# Counts ----------------------------------------------------------------------------------------------------------

_COUNTED = "kind int, gid long, part int, h binary, n binary, word long, often long"
ANSWER, WORDS, SUMS = 0, 1, 2


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, text and gid, the group: written once, so that all passes see the same groups."""
    return stored(docs.select("doc_id", (crc_mod(MODULO) == HELD_OUT).alias("held_out"), "text", F.shiftright(F.monotonically_increasing_id(), GROUP_ROWS).alias("gid")))


def ranges_of(rows: DataFrame) -> int:
    """A power of two of about as many hash ranges as rows has files."""
    return 1 << max(len(rows.inputFiles()) - 1, 0).bit_length()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(h), np.int64)
    np.add.at(n, back, np.concatenate([p[1] for p in parts]))
    return h, n


def requests(rows: DataFrame, ranges: int) -> DataFrame:
    """gid, part, h, n: each group's distinct tokens by hash range, sorted, and how often its training texts have them."""

    def run(batches):
        gid, held = None, []

        def done():
            h, n = _merged(held)
            part = (h >> np.uint64(32)).astype(np.int64) * ranges >> 32
            at = np.searchsorted(part, np.arange(ranges + 1))
            full = np.flatnonzero(np.diff(at))
            blobs = [pa.array([x[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()) for x in (h, n)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(full), gid)), pa.array(full.astype(np.int32)), *blobs], ["gid", "part", "h", "n"])

        for b in batches:
            own = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if own[i] != gid:
                    if held:
                        yield done()
                    gid, held = int(own[i]), []
                trained = ~b.column(1).slice(i, j - i).to_numpy(zero_copy_only=False)
                for c in chunks(b.column(2).slice(i, j - i), CHUNK_BYTES, cut=True):
                    h, at = tokens(c)
                    kinds, back = np.unique(h, return_inverse=True)
                    held.append((kinds, np.bincount(back, np.repeat(trained[c.first : c.first + c.n], np.diff(at)), len(kinds)).astype(np.int64)))
                    if len(held) > 16:
                        held = [_merged(held)]
        if held:
            yield done()

    return rows.select("gid", "held_out", "text").mapInArrow(run, "gid long, part int, h binary, n binary")


def counted(asked: DataFrame, ranges: int) -> DataFrame:
    """What every hash range knows once it is merged: the counts each group asked for (ANSWER), the most frequent words
    of the range (WORDS), and by ending the tokens, words and words seen once and twice (SUMS)."""
    names = [x.split()[0] for x in _COUNTED.split(", ")]

    def record(kind, part, gid=(0,), h=(None,), n=(None,), word=(0,), often=(0,)):
        size = max(map(len, (gid, word)))
        values = [np.full(size, kind), gid if len(gid) == size else np.zeros(size), np.full(size, part), *(list(x) if len(x) == size else [None] * size for x in (h, n)), *(x if len(x) == size else np.zeros(size) for x in (word, often))]
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t, from_pandas=False) if isinstance(v, list) else pa.array(np.asarray(v).astype(np.int64)).cast(t) for v, t in zip(values, types, strict=True)], names)

    def run(batches):
        part, held = None, []

        def done():
            h, n = _merged([(a, b) for _, a, b in held])
            for i in range(0, len(held), 64):
                some = held[i : i + 64]
                yield record(ANSWER, part, [g for g, _, _ in some], [own.tobytes() for _, own, _ in some], [n[np.searchsorted(h, own)].tobytes() for _, own, _ in some])
            ending = (h & _TAIL).astype(np.int64)
            ending[h == END] = TAILS
            sums = [np.bincount(ending, w, TAILS + 1).astype(np.int64) for w in (n, n > 0, n == 1)]
            yield record(SUMS, part, n=[np.stack(sums).tobytes()])
            top = np.flatnonzero((n > 0) & (h != END))
            top = top[np.argsort(-n[top], kind="stable")[:FREQUENT]]
            if len(top):
                yield record(WORDS, part, word=h[top].view(np.int64), often=n[top])

        for b in batches:
            for gid, k, h, n in zip(*(b.column(x).to_pylist() for x in range(4)), strict=True):
                if k != part:
                    if held:
                        yield from done()
                    part, held = k, []
                held.append((gid, np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64)))
        if held:
            yield from done()

    return asked.repartitionById(ranges, F.col("part")).sortWithinPartitions("part").mapInArrow(run, _COUNTED)


def _summed(counts: DataFrame) -> np.ndarray:
    """(3, endings and end): tokens, words, and words seen once; added up on the executors first."""

    def run(batches):
        out = np.zeros((3, TAILS + 1), np.int64)
        for b in batches:
            for x in b.column(0):
                out += np.frombuffer(x.as_buffer(), np.int64).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["n"])

    got = counts.filter(F.col("kind") == SUMS).select("n").mapInArrow(run, "n binary").coalesce(1).mapInArrow(run, "n binary").toArrow()
    out = np.zeros((3, TAILS + 1), np.int64)
    for x in got.column("n").to_pylist():
        out += np.frombuffer(x, np.int64).reshape(3, -1)
    return out


class Maxent:
    """A trained model: the words' slots, weights, the corpus totals, and of each ending's slot what its words need."""

    def __init__(self, slots: Slots, weights: Weights, sums: np.ndarray, frequent: np.ndarray, counts: np.ndarray):
        self.slots, self.weights = slots, weights
        self.tokens, self.words = int(sums[0].sum()), int(sums[1].sum())
        total, once = sums[0, :TAILS].astype(float), sums[2, :TAILS].astype(float)
        np.add.at(total, (frequent & _TAIL).astype(np.int64), -counts.astype(float))
        np.add.at(once, (frequent & _TAIL).astype(np.int64), -(counts == 1).astype(float))
        self.tail_tokens = total
        self.unseen = np.where(total > 0, (once + 0.5) / (total + 1), 1.0)

    def shares(self, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
        """p(word | slot) from the words' counts."""
        tail = slot - (CLASSES * SLOTS - TAILS)
        own = np.maximum(tail, 0)
        known = (1 - self.unseen[own]) * n / np.maximum(self.tail_tokens[own], 1)
        return np.where(tail < 0, 1.0, np.where(n > 0, known, self.unseen[own]))


def fit(rows: DataFrame, rounds: int = ROUNDS) -> tuple[Maxent, DataFrame]:
    """From grouped documents the model of those not held out, and the counts of all groups' words."""
    spark = rows.sparkSession
    ready_workers(spark)
    ranges = ranges_of(rows)
    counts = checkpoint(counted(requests(rows, ranges), ranges))
    top = counts.filter(F.col("kind") == WORDS).orderBy(F.desc("often"), "word").limit(FREQUENT).select("word", "often").collect()
    frequent = np.array([r.word for r in top], np.int64).view(np.uint64)
    often = np.array([r.often for r in top], np.int64)
    sums = _summed(counts)
    slots = Slots(frequent)
    sizes, used = np.zeros(CLASSES * SLOTS), np.zeros(CLASSES * SLOTS, bool)
    used[0] = used[1 : 1 + len(frequent)] = used[-TAILS:] = True
    sizes[0], sizes[1 : 1 + len(often)] = sums[0, TAILS], often
    weights = Weights(sizes, used)
    model = Maxent(slots, weights, sums, frequent, often)
    sizes[-TAILS:] = model.tail_tokens
    weights = model.weights = Weights(sizes, used)
    texts = rows.filter("not held_out").select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).alias("share"))
    shared = spark.sparkContext.broadcast(slots)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(weights)
        weights = moved(weights, updates(texts.filter(F.col("share") == r), shared, sent))
    model.weights = weights
    return model, counts


def _balanced(gid: Column, parts: int) -> Column:
    """The task of a group: partitions of the documents, and the groups inside each, in turn."""
    bits = 33 - GROUP_ROWS
    return F.pmod(F.shiftright(gid, bits) + gid.bitwiseAND(F.lit((1 << bits) - 1)), F.lit(parts)).cast("int")


def score_documents(rows: DataFrame, model: Maxent, counts: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = rows.sparkSession
    ready_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        m, gid, words, often, table, history = shared.value, None, [], [], None, Histories()
        base = np.log10(m.tokens + m.words + 1)
        for b in batches:
            own, is_text = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((own[1:] != own[:-1]) | (is_text[1:] != is_text[:-1])) + 1).tolist(), len(own)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if own[i] != gid:
                    gid, words, often, table = own[i], [], [], None
                if not is_text[i]:
                    words += [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(3).slice(i, j - i)]
                    often += [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(4).slice(i, j - i)]
                    continue
                if table is None:  # hash ranges in order: the whole is sorted, but where a group was read in two parts
                    table = np.concatenate(words), np.concatenate(often)
                    if not (table[0][1:] > table[0][:-1]).all():
                        kinds, first = np.unique(table[0], return_index=True)
                        table = kinds, table[1][first]
                    words, often = [], []
                n_tokens, n_known, plain, score = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), np.zeros(j - i), np.zeros(j - i)
                for c in chunks(b.column(7).slice(i, j - i), CHUNK_BYTES, cut=True):
                    h, at, before = history.of(c)
                    kinds, back = np.unique(h, return_inverse=True)
                    n = table[1][np.searchsorted(table[0], kinds)]
                    slot = m.slots.of(kinds)
                    logs = np.log10(np.maximum(m.weights.chances(before, slot[back]), 1e-300)) + np.log10(np.maximum(m.shares(slot, n), 1e-300))[back]
                    k = slice(c.first, c.first + c.n)
                    n_tokens[k] += np.diff(at)
                    n_known[k] += segment_sum((n > 0).astype(np.int64)[back], at)
                    plain[k] += segment_sum((np.log10(n + 1.0) - base)[back], at)
                    score[k] += segment_sum(logs, at)
                yield pa.RecordBatch.from_arrays([b.column(5).slice(i, j - i), b.column(6).slice(i, j - i), *map(pa.array, (n_tokens, n_known, plain, score))], names)

    parts = max(len(rows.inputFiles()), 1)
    texts = rows.select("gid", F.lit(1).alias("is_text"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("h"), F.lit(None).cast("binary").alias("n"), "doc_id", "held_out", "text")
    answers = counts.filter(F.col("kind") == ANSWER).select("gid", F.lit(0).alias("is_text"), "part", "h", "n", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text"))
    both = texts.unionByName(answers).repartitionById(parts, _balanced(F.col("gid"), parts)).sortWithinPartitions("gid", "is_text", "part")
    out = both.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_corpus(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """All documents scored by the model of those that are not held out."""
    ready_workers(docs.sparkSession)
    rows = grouped(docs)
    model, counts = fit(rows, rounds)
    return score_documents(rows, model, counts)


def op3_maxent(spark, sf_dir: str) -> DataFrame:
    return score_corpus(documents(spark, sf_dir))


QUERIES = {"op3_maxent": op3_maxent}
ORACLE_SQL: dict[str, str] = {}
