"""Word n-grams: perplexity under a modified Kneser-Ney model of whole words, counted over all documents.

Units are the words as they stand, by 64-bit hash; none is folded into another, pruned or sampled. A text's n-grams
would vouch for themselves, so texts are dealt into two folds and each is scored by the counts of the other fold; all
texts are counted and all are scored. The fold is that of the text's least n-gram hash, so equal texts are in one, and
near copies mostly.

No counts of n-grams reach the driver or a broadcast. Trigrams are dealt by the hash of their middle word into
ranges, and a range merges what it is sent into sorted hash arrays. So it has the counts of its trigrams, of their first
two words as contexts, of their last two words as continuations, and of the middle word as a context, all complete.
Missing are the words' own continuation counts: every range sends those of its words to key ranges, which add them up
and answer in the same order. A middle word that alone would fill a range is dealt on by the last word; its contexts are
then counts of several ranges and are added up by the key ranges too. Which words these are, a sample says: it
changes where counts are made, not what they are.

Dealing all trigrams at once would take many times the input's disk. So ranges are taken in groups, each of which reads
the texts again and keeps its trigrams only while it lasts: first all groups count, then, as discounts and words' counts
are known, all ranges count again, in other groups, and add up the logarithms by text. The sample also has the words
that are sent as numbers of two bytes; all others are sent as their hashes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import chunks, held, mix, ready_workers, text_digest
from tabulon.session import shared_folder

ORDER, FOLDS = 3, 2
START = np.uint64(0x200)
#: Trigrams that one task collects before it deals them to the ranges; bytes of text per range.
GROUP_WORDS, RANGE_BYTES = 3 << 19, 1 << 22
#: Groups of ranges that are counted and that are scored one after the other.
COUNTED, SCORED = 3, 3
#: Bytes of text whose arrays fit the processor's caches.
CHUNK_BYTES = 1 << 17
#: Of so many texts, one is in the sample, and the first of each task are. Of it each task tells so many frequent middle
#: words, and about BOOK_TASKS of any number of tasks so many words for the book, which has at most RARE words.
SAMPLE, SAMPLE_FIRST, FREQUENT, BOOK_WORDS, BOOK_TASKS, RARE = 16, 256, 1024, 1 << 15, 4, 0xFFFF
#: Bits of a hash that lead to a word of the book.
BOOK_BITS = 20
ASK, KEPT, SUMS, ANSWER, NAMES = range(5)
#: Counts of a context per fold: in all, and successors seen 1, 2, 3+ times.
CONTEXT = 4 * FOLDS
_ROW = "kind int, part int, src long, data binary"
_CROSS = np.uint64(0xC2B2AE3D27D4EB4F)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _pack(*arrays: np.ndarray) -> bytes:
    """Flat arrays as bytes; whole numbers that are no hashes take as few bytes as their largest needs."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        if a.dtype == np.int64:
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        out += [a.dtype.str.encode().ljust(8), np.array([len(a)], np.int64).tobytes(), a.tobytes()]
    return b"".join(out)


def _unpack(data: pa.Buffer) -> list[np.ndarray]:
    out, at = [], 8
    for _ in range(int(np.frombuffer(data, np.int64, 1)[0])):
        kind, n = np.dtype(bytes(data[at : at + 8]).decode().strip()), int(np.frombuffer(data, np.int64, 1, at + 8)[0])
        out.append(np.frombuffer(data, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


def _rows(kind: int, parts, src, data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    ints = [pa.array(np.broadcast_to(np.asarray(x, t), n)) for x, t in ((kind, np.int32), (parts, np.int32), (src, np.int64))]
    return pa.RecordBatch.from_arrays([*ints, pa.array(data, pa.binary())], ["kind", "part", "src", "data"])


def _key(words: list[np.ndarray]) -> np.ndarray:
    h = mix(words[0])
    for w in words[1:]:
        h = mix(h * _CROSS + w)
    return h


def _range(h: np.ndarray, ranges) -> np.ndarray:
    """The range of each hash."""
    return (h >> np.uint64(32)).astype(np.int64) * ranges >> 32


def _cuts(sorted_keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each hash range begins."""
    return np.searchsorted(_range(sorted_keys, ranges), np.arange(ranges + 1))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each distinct key stands, by ascending key, and each key's place among these."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    inv = np.empty(len(s), np.int64)
    inv[order] = np.cumsum(new) - 1
    return order[new], inv


def _added(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    return np.rint(np.bincount(at, x, size)).astype(np.int64)


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=0).astype(np.int64)


def _places(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int64)


class Deal:
    """Which range a trigram belongs to, and the words that go by numbers; answers come from ``keys`` key ranges."""

    def __init__(self, ranges: int, heavy: np.ndarray, split: np.ndarray, book: np.ndarray):
        """heavy: sorted words, whose trigrams take split ranges; book: words, the most frequent first."""
        self.ranges, self.keys, self.heavy, self.split, self.book = ranges, -(-ranges // 8), heavy, split, book
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def _lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """By the first bits of a hash: whether a heavy word has them, and the number of a word of the book that has."""
        if self._tables is None:
            heavy, numbers = np.zeros(1 << 12, bool), np.zeros(1 << BOOK_BITS, np.uint16)
            heavy[self.heavy >> np.uint64(52)] = True
            numbers[(self.book >> np.uint64(64 - BOOK_BITS))[::-1]] = np.arange(len(self.book))[::-1]
            self._tables = heavy, numbers
        return self._tables

    def heavy_at(self, words: np.ndarray) -> np.ndarray:
        """Where heavy words are."""
        i = np.flatnonzero(np.take(self._lookup()[0], words >> np.uint64(52)))
        return i[np.isin(words[i], self.heavy)]

    def parts(self, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
        part = _range(middle, self.ranges)
        i = self.heavy_at(middle)
        if len(i):
            part[i] += _range(mix(last[i] * _CROSS), self.split[np.searchsorted(self.heavy, middle[i])])
            part[i] %= self.ranges
        return part

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The words' numbers in the book, or RARE."""
        if not len(self.book):
            return np.full(len(words), RARE, np.uint16)
        n = np.take(self._lookup()[1], words >> np.uint64(64 - BOOK_BITS))
        n[np.take(self.book, n) != words] = RARE
        return n

    def words(self, numbers: np.ndarray, rare: np.ndarray) -> np.ndarray:
        out = np.take(self.book, numbers, mode="clip") if len(self.book) else np.empty(len(numbers), np.uint64)
        out[numbers == RARE] = rare
        return out

    def groups(self, n: int) -> list[tuple[int, int]]:
        """The ranges in up to n groups: begins and ends."""
        n = min(n, self.ranges)
        return [(i * self.ranges // n, (i + 1) * self.ranges // n) for i in range(n)]


def _trigrams(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For every word of texts that begin at ``at``: the two before it, or START, and itself."""
    out = [h]
    for _ in range(ORDER - 1):
        x = np.empty_like(h)
        x[1:] = out[0][:-1]
        x[at[:-1][at[:-1] < at[1:]]] = START
        out.insert(0, x)
    return out


def _most(words: np.ndarray, n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words and their counts."""
    first, inv = _grouped(words)
    words, n = words[first], _added(inv, n, len(first))
    often = np.lexsort((words, -n))[:limit]
    return words[often], n[often]


def dealing(docs: DataFrame) -> Deal:
    """The ranges for the size of all texts, and by a sample the middle words that would fill one, and the book."""
    ready_workers(docs.sparkSession)

    def run(batches):
        held()
        size, seen, middle, all_words = 0, 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        task = TaskContext.get().partitionId()
        for b in batches:
            size += int(b.column(0).to_numpy(zero_copy_only=False).sum())
            for c in chunks(b.column(1), CHUNK_BYTES):
                starts, ends, at = c.words()
                own = _trigrams(c.hashes(starts, ends), at)
                middle.append(own[-2])
                all_words.append(own[-1])
                seen += len(starts)
        told = [_most(x, np.ones(len(x)), n) for x, n in ((np.concatenate(middle), FREQUENT), (np.concatenate(all_words), BOOK_WORDS))]
        if task * 0x9E3779B1 % (1 << 32) * max(task, BOOK_TASKS) >> 32 >= BOOK_TASKS:
            told[1] = told[1][0][:0], told[1][1][:0]
        yield _rows(SUMS, 0, 0, [_pack(np.array([size, seen]), *told[0], *told[1])])

    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = docs.select(length, F.when((F.rand(7) * SAMPLE < 1) | (row < SAMPLE_FIRST), F.col("text")))
    got = [_unpack(x.as_buffer()) for x in rows.mapInArrow(run, _ROW).select("data").toArrow().column("data")]
    size, seen = (sum(int(x[0][i]) for x in got) for i in (0, 1))
    ranges = 1 << (size // RANGE_BYTES).bit_length()
    words, n, book, often = (np.concatenate([np.zeros(0, t), *(x[i] for x in got)]) for i, t in ((1, np.uint64), (2, np.int64), (3, np.uint64), (4, np.int64)))
    words, n = _most(words, n, len(words))
    split = np.minimum(np.ceil(n * ranges / max(seen, 1)), ranges).astype(np.int64)
    heavy = np.flatnonzero(split > 1)
    heavy = heavy[np.argsort(words[heavy])]
    return Deal(ranges, words[heavy], split[heavy], _most(book, often, RARE)[0])


def occurrences(docs: DataFrame, shared: Broadcast, begin: int, end: int, named: bool) -> DataFrame:
    """The trigrams of all texts that ranges from begin to end count: their words and folds; named: and whose they are."""
    ready_workers(docs.sparkSession)

    def run(batches):
        held()
        deal, task, groups = shared.value, TaskContext.get().partitionId(), 0
        none = lambda: ([[] for _ in range(ORDER)], [], [], [], [], 0, 0)
        words, parts, owner, digests, folds, size, texts = none()

        def done():
            part, own, names, fold = map(np.concatenate, (parts, owner, digests, folds))
            order = np.argsort(part.astype(np.uint16) if end - begin <= 1 << 16 else part, kind="stable")
            at = np.searchsorted(part[order], np.arange(end - begin + 1))
            own, w = own[order], [np.concatenate(x)[order] for x in words]
            numbers, src = [deal.numbers(x) for x in w], task << 24 | groups
            for k in np.flatnonzero(np.diff(at)):
                i = slice(at[k], at[k + 1])
                data = [x for n, y in zip(numbers, w, strict=True) for x in (n[i], y[i][n[i] == RARE])]
                if named:
                    first = np.flatnonzero(np.diff(own[i], prepend=-1))
                    doc, often = own[i][first], np.diff(first, append=at[k + 1] - at[k])
                    data += [_steps(doc), often * FOLDS + fold[doc]]
                else:
                    data.append(np.packbits(fold[own[i]].astype(bool)))
                yield _rows(ASK, begin + k, src, [_pack(*data)])
            if named:
                often = np.bincount(own, minlength=len(fold))
                yield _rows(NAMES, begin + src % (end - begin), src, [_pack(names.ravel(), often.astype(np.int64))])

        for b in batches:
            own_digests = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, 2) if named else np.zeros((b.num_rows, 0), np.uint64)
            for c in chunks(b.column(0), CHUNK_BYTES):
                starts, ends, at = c.words()
                n = len(starts)
                if not n:
                    continue
                own = _trigrams(c.hashes(starts, ends), at)
                part = deal.parts(own[-2], own[-1]) - begin
                i = np.flatnonzero(part.view(np.uint64) < end - begin)
                least = np.minimum.reduceat(_key(own), np.minimum(at[:-1], n - 1))
                folds.append((least % np.uint64(FOLDS)).astype(np.int64))
                for x, w in zip(words, own, strict=True):
                    x.append(w[i])
                parts.append(part[i])
                owner.append(np.repeat(np.arange(texts, texts + c.n), np.diff(at))[i])
                digests.append(own_digests[c.first : c.first + c.n])
                size, texts = size + len(i), texts + c.n
                if size >= GROUP_WORDS:
                    yield from done()
                    groups += 1
                    words, parts, owner, digests, folds, size, texts = none()
        if size:
            yield from done()

    return docs.select("text", *[text_digest().alias("digest")] * named).mapInArrow(run, _ROW)


def _by_part(df: DataFrame, ranges: int, run, schema: str, begin: int = 0) -> DataFrame:
    """run(part, rows) for all rows of a part together; rows are (kind, src, data) in this order; parts are from begin on."""

    def each(batches):
        held()
        part, rows = None, []
        for b in batches:
            for kind, k, src, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if k != part:
                    if rows:
                        yield from run(part, rows)
                    part, rows = k, []
                rows.append((kind, src, _unpack(data.as_buffer())))
        if rows:
            yield from run(part, rows)

    return df.repartitionById(ranges, F.col("part") - begin).sortWithinPartitions("part", "kind", "src").mapInArrow(each, schema)


class Tables:
    """Tables of rows in the shared folder, by kind."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def stored(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.partitionBy("kind").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(_ROW).parquet(path).select("kind", "part", "src", "data")
        out._tabulon_path = path
        return out

    def dropped(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._tabulon_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _asked(rows, deal: Deal) -> tuple[list[np.ndarray], np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Of ASK rows: the trigrams' words, their folds, and, if these were asked for, per row src, texts and how many
    trigrams each has."""
    words, folds, whose = [[] for _ in range(ORDER)], [], []
    for _, src, data in rows:
        for i, x in enumerate(words):
            x.append(deal.words(data[2 * i], data[2 * i + 1]))
        if len(data) == 2 * ORDER + 1:
            folds.append(np.unpackbits(data[-1], count=len(data[0])))
        else:
            steps, often = data[2 * ORDER], data[-1].astype(np.int64)
            folds.append(np.repeat(often % FOLDS, often // FOLDS))
            whose.append((src, _places(steps), often // FOLDS))
    return [np.concatenate(x) for x in words], np.concatenate(folds), whose


def _context(at: np.ndarray, counts: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The counts of contexts (CONTEXT) from those of the n-grams that follow them."""
    out = []
    for c in counts:
        more = np.flatnonzero(c > 2)
        one, two, three = (np.bincount(at[i], minlength=size) for i in (c == 1, c == 2, more))
        out += [one + 2 * two + _added(at[more], c[more], size), one, two, three]
    return out


def _kinds(at: np.ndarray, counts: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Per fold, how many n-grams were seen."""
    return [np.bincount(at[c > 0], minlength=size) for c in counts]


class Counts:
    """All counts of a range: of trigrams, pairs, contexts and words, as far as its trigrams tell."""

    def __init__(self, words: list[np.ndarray], fold: np.ndarray, deal: Deal):
        first, self.inv = _grouped(_key(words))
        u, v, w = (x[first] for x in words)
        self.three = [np.bincount(self.inv[fold == f], minlength=len(first)) for f in range(FOLDS)]
        keys = _key([u, v])
        first, self.before = _grouped(keys)
        keys, heavy = keys[first], deal.heavy_at(v[first])
        self.two_context = _context(self.before, self.three, len(first))
        first, self.after = _grouped(_key([v, w]))
        v, w = v[first], w[first]
        self.two = _kinds(self.after, self.three, len(first))
        first, self.middle = _grouped(v)
        self.one_context = _context(self.middle, self.two, len(first))
        one, one_heavy = mix(v[first]), deal.heavy_at(v[first])
        first, self.last = _grouped(w)
        self.words = w[first]
        self.one = _kinds(self.last, self.two, len(first))
        # contexts whose counts are in several ranges, by ascending key
        self.shared = heavy, one_heavy
        keys = np.concatenate([keys[heavy], one[one_heavy]])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.columns = [np.concatenate([x[heavy], y[one_heavy]])[self.order] for x, y in zip(self.two_context, self.one_context, strict=True)]

    def answered(self, rows) -> None:
        """Puts the sums of all ranges in place of this range's counts; rows are those of the key ranges in order."""
        got = [np.concatenate(x).astype(np.int64) for x in zip(*(r[2] for r in rows), strict=True)]
        if len(got[0]) != len(self.words) or len(got[FOLDS]) != len(self.keys):
            raise RuntimeError("the texts changed between two readings")
        self.one = got[:FOLDS]
        n = len(self.shared[0])
        for x, y, c in zip(self.two_context, self.one_context, got[FOLDS:], strict=True):
            back = np.empty(len(c), np.int64)
            back[self.order] = c
            x[self.shared[0]], y[self.shared[1]] = back[:n], back[n:]

    def logs(self, d: Discounts) -> list[np.ndarray]:
        """Per fold, log10 of the probability of each trigram's last word after the others, if other folds have it."""
        out = []
        for f in range(FOLDS):
            p = (self.one[f] - d.off[1, f][np.minimum(self.one[f], 3)]) / max(d.total[f], 1) + d.any[f]
            for n, counts, context, at, low in ((2, self.two, self.one_context, self.middle, self.last), (3, self.three, self.two_context, self.before, self.after)):
                total, *seen = (x.astype(float) for x in context[4 * f : 4 * f + 4])
                off = sum(x * y for x, y in zip(seen, d.off[n, f, 1:], strict=True))
                weight = np.where(total > 0, off / np.maximum(total, 1), 1.0)
                c, i = counts[f], slice(None)
                if n == ORDER:
                    i = np.flatnonzero(sum(counts) > c)
                    c, at, low = c[i], at[i], low[i]
                p = (c - d.off[n, f][np.minimum(c, 3)]) / np.maximum(total, 1)[at] + weight[at] * p[low]
            out.append(np.zeros(len(counts[f])))
            out[-1][i] = np.log10(p)
        return out


def _sums(counts: list[np.ndarray]) -> list[int]:
    """Per fold: how many were seen 1, 2, 3, 4 and over 2 times, and all counts."""
    return [x for c in counts for x in (*(int((c == i).sum()) for i in (1, 2, 3, 4)), int((c > 2).sum()), int(c.sum()))]


def counted(asked: DataFrame, shared: Broadcast, keys: int, begin: int, end: int) -> DataFrame:
    """Ranges from begin to end, counted: how many n-grams have which counts (SUMS), and by key range the sums of what the
    ranges know of words and shared contexts, and which of them each range has (KEPT)."""

    def count(part, rows):
        c = Counts(*_asked(rows, shared.value)[:2], shared.value)
        yield _rows(SUMS, part % keys, part, [_pack(np.array([_sums(c.two), _sums(c.three)], np.int64).ravel())])
        one, more = _cuts(c.words, keys), _cuts(c.keys, keys)
        for k in range(keys):
            i, j = slice(one[k], one[k + 1]), slice(more[k], more[k + 1])
            if one[k] < one[k + 1] or more[k] < more[k + 1]:
                yield _rows(ASK, k, part, [_pack(c.words[i], *(x[i] for x in c.one), c.keys[j], *(x[j] for x in c.columns))])

    def add(part, rows):
        for _, src, data in (r for r in rows if r[0] == SUMS):
            yield _rows(SUMS, part, src, [_pack(*data)])
        asks = [r for r in rows if r[0] == ASK]
        if not asks:
            return
        kept = [np.array([r[1] for r in asks])]
        for to, n in ((0, FOLDS), (FOLDS + 1, CONTEXT)):
            columns = [np.concatenate([r[2][i] for r in asks]) for i in range(to, to + n + 1)]
            first, inv = _grouped(columns[0])
            size = [len(r[2][to]) for r in asks]
            at = np.cumsum([0, *size])
            steps = [_steps(inv[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            kept += [np.array(size), np.concatenate(steps), columns[0][first], *(_added(inv, x, len(first)) for x in columns[1:])]
        yield _rows(KEPT, part, begin, [_pack(*kept)])

    return _by_part(_by_part(asked, end - begin, count, _ROW, begin), keys, add, _ROW)


def answers(kept: DataFrame, keys: int) -> DataFrame:
    """What the key ranges answer to the ranges, in their order (ANSWER), and how many words have which counts (SUMS)."""

    def run(part, rows):
        columns, at = [], 1
        for n in (FOLDS, CONTEXT):
            words, *x = (np.concatenate([r[2][at + 2 + i] for r in rows]) for i in range(n + 1))
            first, inv = _grouped(words)
            sums = [_added(inv, y, len(first)) for y in x]
            if n == FOLDS:
                yield _rows(SUMS, part, part, [_pack(np.array(_sums(sums), np.int64))])
            columns.append((at, inv, sums))
            at += n + 3
        before = [0] * 2
        for r in rows:
            to, out = r[2][0].tolist(), [[] for _ in r[2][0]]
            for which, (at, inv, sums) in enumerate(columns):
                size, steps, n = r[2][at], r[2][at + 1], len(r[2][at + 2])
                own, ends = inv[before[which] : before[which] + n], np.cumsum([0, *size.tolist()])
                for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    places = own[_places(steps[i:j])]
                    out[k] += [x[places] for x in sums]
                before[which] += n
            for k, x in zip(to, out, strict=True):
                yield _rows(ANSWER, k, part, [_pack(*x)])

    return _by_part(kept.filter(F.col("kind") == KEPT), keys, run, _ROW)


class Discounts:
    """Of each order and fold: what is taken off counts of 0, 1, 2 and 3 or more; of words: all counts, kinds, weight."""

    def __init__(self, sums: list[np.ndarray]):
        """sums of the orders from 1 on: (folds, 6) numbers of n-grams seen 1, 2, 3, 4 and over 2 times, and all counts."""
        self.off = np.zeros((ORDER + 2, FOLDS, 4))
        for n, of_order in enumerate(sums, 1):
            for f, (*of, _, _) in enumerate(of_order.tolist()):
                y = of[0] / max(of[0] + 2 * of[1], 1)
                self.off[n, f, 1:] = [min(max(i - (i + 1) * y * of[i] / of[i - 1], 0.1), i - 0.05) if of[i - 1] else 0.5 for i in (1, 2, 3)]
        one = sums[0].astype(float)
        seen = one[:, [0, 1, 4]]
        self.total, kinds = one[:, 5], seen.sum(1)
        self.any = np.where(self.total > 0, (self.off[1, :, 1:] * seen).sum(1) / np.maximum(self.total, 1), 1.0) / (kinds + 1)


def scored(asked: DataFrame, told: DataFrame, shared: Broadcast, off: Broadcast, keys: int, begin: int, end: int) -> DataFrame:
    """Sums of log10 by text of the ranges from begin to end, dealt by digest: ANSWER rows of digests, sums and how many
    n-grams these are of."""

    def score(part, rows):
        asks = [r for r in rows if r[0] == ASK]
        if asks:
            words, fold, whose = _asked(asks, shared.value)
            c = Counts(words, fold, shared.value)
            c.answered([r for r in rows if r[0] == ANSWER])
            logs = np.stack(c.logs(off.value))[(fold + 1) % FOLDS, c.inv]
            ends = np.cumsum(np.concatenate([x[2] for x in whose]))
            sums = np.add.reduceat(logs, np.concatenate([[0], ends[:-1]])).astype(np.float32)
            at = 0
            for src, doc, _ in whose:
                yield _rows(SUMS, src % keys, src, [_pack(_steps(doc), sums[at : at + len(doc)], np.array([part]))])
                at += len(doc)
        for _, src, data in (r for r in rows if r[0] == NAMES):
            yield _rows(NAMES, src % keys, src, [_pack(*data)])

    def add(part, rows):
        sums = sorted(((src, int(x[2][0]), x) for kind, src, x in rows if kind == SUMS), key=lambda x: x[:2])
        at = 0
        for _, src, (names, often) in (r for r in rows if r[0] == NAMES):
            names, log = names.reshape(-1, 2), np.zeros(len(often))
            while at < len(sums) and sums[at][0] == src:
                steps, x, _ = sums[at][2]
                log[_places(steps)] += x
                at += 1
            order = np.argsort(names[:, 0])
            order = order[often[order] > 0]
            cuts = _cuts(names[order, 0], keys)
            for k in np.flatnonzero(np.diff(cuts)):
                i = order[cuts[k] : cuts[k + 1]]
                yield _rows(ANSWER, k, begin << 48 | src, [_pack(names[i].ravel(), log[i], often[i].astype(np.int64))])

    told = told.filter((F.col("kind") == ANSWER) & (F.col("part") >= begin) & (F.col("part") < end))
    return _by_part(_by_part(asked.unionByName(told), end - begin, score, _ROW, begin), keys, add, _ROW)


def by_text(sums: DataFrame, ranges: int) -> DataFrame:
    """digest and perp from the groups' sums of log10; a text's copies have equal sums."""

    def run(part, rows):
        names, log, often = (np.concatenate(x) for x in zip(*(r[2] for r in rows), strict=True))
        names, inv = np.unique(names.reshape(-1, 2), axis=0, return_inverse=True)
        perp = -np.bincount(inv, log) / np.bincount(inv, often)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in names], pa.binary()), pa.array(perp)], ["digest", "perp"])

    return _by_part(sums, ranges, run, "digest binary, perp double")


def _summed(rows: DataFrame, orders: int) -> np.ndarray:
    got = rows.filter(F.col("kind") == SUMS).select("data").toArrow().column("data")
    return sum((_unpack(x.as_buffer())[0].astype(np.int64) for x in got), np.zeros(orders * FOLDS * 6, np.int64)).reshape(orders, FOLDS, 6)


def _in_groups(docs: DataFrame, deal: Deal) -> DataFrame:
    """Sums of log10 by text, of all groups."""
    sc, tables, keys = docs.sparkSession.sparkContext, Tables(docs.sparkSession), deal.keys
    shared = sc.broadcast(deal)
    union = lambda x: x[0] if len(x) == 1 else union([x[0].unionByName(x[1]), *x[2:]])
    kept = [tables.stored(counted(occurrences(docs, shared, *g, False), shared, keys, *g)) for g in deal.groups(COUNTED)]
    told = tables.stored(answers(union(kept), keys))
    off = sc.broadcast(Discounts([*_summed(told, 1), *sum(_summed(x, 2) for x in kept)]))
    for x in kept:
        tables.dropped(x)
    out = [tables.stored(scored(occurrences(docs, shared, *g, True), told, shared, off, keys, *g)) for g in deal.groups(SCORED)]
    tables.dropped(told)
    return union(out)


def perplexities(docs: DataFrame) -> DataFrame:
    """digest (text_digest) and perp, mean -log10 probability per word, of each distinct text with a word."""
    spark, deal = docs.sparkSession, dealing(docs)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # a group's shuffle files go when it has been stored
    try:
        sums = _in_groups(docs, deal)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return by_text(sums, deal.keys)
