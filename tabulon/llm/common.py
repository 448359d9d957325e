"""What several operators of this subpackage share: checkpoints, broadcasts of checked size, and text as numpy arrays.

Words are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``; UTF-8 never uses these bytes inside a longer
character, so words are found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import checkpoint, ship, stored  # noqa: F401 - the operators take these from here

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that may be broadcast; beyond this, joins are left to the planner.
BROADCAST_ROWS = 500_000
#: Bytes of text that are turned into arrays at once; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else df as it is. df must be cheap to count."""
    return F.broadcast(df) if df.count() <= rows else df


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: str = "text"):
    """Column: the number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def text_digest(text: str = "text"):
    """Column: 128-bit digest of a text as 16 bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


# Text as arrays ------------------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Chunk:
    """Some texts: rows ``first`` up to ``first + n`` of a batch, as one byte array.

    ``at`` has n + 1 offsets of the texts in ``data``. A long text may come in pieces, each a chunk of its own with
    whole words; ``begins`` and ``ends`` say whether this one holds the text's first and last.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int, begins: bool = True, ends: bool = True):
        self.data, self.at, self.first, self.n, self.begins, self.ends = data, at, first, len(at) - 1, begins, ends

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words in ``data``, and the offsets of each text's words (n + 1)."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.n + 1, np.int64)
        black = (self.data != 32) & (self.data - np.uint8(9) > 4)
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.at] = True
        before = np.empty(len(black), bool)
        before[0] = False
        before[1:] = black[:-1]
        starts = np.flatnonzero(black & (~before | edge[:-1]))
        after = np.empty(len(black), bool)
        after[-1] = False
        after[:-1] = black[1:]
        ends = np.flatnonzero(black & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.at)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of a polynomial hash of data."""
        up, _ = _power(len(data))
        out, x = np.zeros(len(data) + 1, np.uint64), np.take(_BYTE, data, mode="clip")
        x *= up
        np.cumsum(x, out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the byte ranges; equal for equal bytes wherever they stand."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        s = self.sums(LOWER[self.data] if lower else self.data)
        _, down = _power(len(self.data) + 1)
        return mix((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A number for each byte range, equal for equal bytes only: grouped by their hashes h, then compared byte by byte
    with the first of the group; if two unlike ranges share a hash, all are told apart by their bytes."""
    if not len(h):
        return np.zeros(0, np.int64)
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[order[1:]], h[order[:-1]], out=new[1:])
    first, ids = order[new], np.empty(len(h), np.int64)
    ids[order] = np.cumsum(new) - 1
    again = np.flatnonzero(first[ids] != np.arange(len(h)))
    one, two, n = starts[again], starts[first[ids[again]]], (ends - starts)[again]
    same = (n == (ends - starts)[first[ids[again]]]).all()
    if same and len(n):
        begin = np.repeat(np.cumsum(n) - n, n)
        inside = np.arange(len(begin)) - begin
        same = (data[np.repeat(one, n) + inside] == data[np.repeat(two, n) + inside]).all()
    if same:
        return ids
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[s:e].tobytes(), len(known)) for s, e in zip(starts, ends, strict=True)], np.int64)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, cut: bool = False) -> Iterator[Chunk]:
    """The texts of a column in chunks of about limit bytes; with cut a longer text comes in pieces, cut after white
    space, so that memory is bounded by limit and the longest word."""
    if not len(column):
        return
    data, at = texts_of(column)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        begin, end = int(at[first]), int(at[last])
        if cut and end - begin > limit:
            yield from _pieces(data, begin, end, limit, first)
        else:
            yield Chunk(data[begin:end], at[first : last + 1] - begin, first)
        first = last


def _pieces(data: np.ndarray, begin: int, end: int, limit: int, row: int) -> Iterator[Chunk]:
    begins = True
    while begin < end or begins:
        stop = min(begin + limit, end)
        if stop < end:
            white = np.flatnonzero(SPACE[data[begin:stop]])
            if len(white):
                stop = begin + int(white[-1]) + 1
            else:  # a word longer than limit
                while stop < end and not SPACE[data[stop - 1]]:
                    white = np.flatnonzero(SPACE[data[stop : stop + limit]])
                    stop = stop + int(white[0]) + 1 if len(white) else min(stop + limit, end)
        yield Chunk(data[begin:stop], np.array([0, stop - begin]), row, begins, stop == end)
        begin, begins = stop, False


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets."""
    s = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=s[1:])
    return s[at[1:]] - s[at[:-1]]


def crc_mod(n: int, column: str = "doc_id"):
    """Column: crc32 of doc_id as text, modulo n; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % n


def ready_workers(spark: SparkSession, rows: int = 512) -> None:
    """Sends this package to the executors' Python, once per application, and bounds the rows of an Arrow batch, as
    texts can be long."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


_held: dict = {}


def held(key=None, make=None):
    """What a Python worker keeps between tasks: one thing at a time, so that the stages of a job don't add up."""
    if key is None or key not in _held:
        _held.clear()
        if key is not None:
            _held[key] = make()
    return _held.get(key)


def segment_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets, each added up by itself."""
    if not len(values):
        return np.zeros(len(at) - 1, values.dtype)
    out = np.add.reduceat(values, np.minimum(at[:-1], len(values) - 1))
    out[np.diff(at) == 0] = 0
    return out
