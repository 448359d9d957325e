"""BPE encoding and decoding with a public vocabulary file, by contiguous rank arrays.

A word's parts and the ranks of its adjacent pairs stand in arrays; the least rank is looked for, its boundary is
deleted and the two neighbouring ranks are looked up anew, until no pair can merge. Many short words of one width
are rows of the same arrays, so one numpy step serves all of them. Long words use a heap over a linked list, which
gives the same merges without the quadratic scan. Encoded words are kept in a bounded table per Python worker.

Texts are split, their distinct words found and the words' ids put back in place by Arrow, a group of about GROUP bytes
at a time; only distinct words meet Python. A longer text comes in pieces cut at white space, which no token crosses.

The vocabulary is read on the driver and broadcast; it is as large as the file, whatever the data. Texts are mapped
where they stand: no shuffle. Which characters are letters, numbers or white space and what their lower case is differs
between versions of Unicode; so these tables are read off the public tokenizers library on the driver, by showing it
every character once (without that library, the regex module's and Python's own tables serve).

Rules taken from the file: NFC, lower case by character, words by the file's pattern, byte-level symbols, end-of-word
suffix. Special tokens in a text are recognised before all that. Without a decoder in the file, decoding joins the
token strings by a space.

Defined cases: null text counts as empty, which has no tokens and decodes to the empty string; null or repeated ids
pass through; other columns are ignored by the digest form.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tabulon.llm.common import chunks, documents, held, per_text, ready_workers

#: Bytes up to which a word is one row of the rank arrays.
SHORT = 48
#: Bytes of words and ids kept per worker, about; when full, the tables start anew (speed only).
KEPT = 96 << 20
#: Bytes of text handled at once.
GROUP = 4 << 20
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(free))
        free += b not in plain
    return out


@lru_cache(1)
def characters() -> dict | None:
    """Ranges of letters, numbers and white space, and lower-case forms that differ, as the tokenizers library has them."""
    try:
        from tokenizers import Regex, normalizers, pre_tokenizers
    except ImportError:
        return None
    planes = (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000))  # the others hold no such characters
    every = [chr(i) for i in planes]
    text = "".join(every)
    out: dict = {}
    for name, pattern in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("s", r"\s+")):
        found = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text)
        out[name] = "".join(f"{regex.escape(p[0])}-{regex.escape(p[-1])}" for p, _ in found)
    low = normalizers.Lowercase().normalize_str("\n".join(every)).split("\n")
    out["lower"] = {ord(c): x for c, x in zip((c for c in every if c != "\n"), (x for i, x in enumerate(low) if not 10 <= i <= 11), strict=True) if c != x}
    return out


def composed(word: str) -> str:
    """NFC; what needs combining classes that versions of Unicode don't agree on is left to the library."""
    if any(unicodedata.category(c) in ("Cn", "Mn", "Mc", "Me") and not "\u0300" <= c <= "\u036f" for c in word):
        try:
            from tokenizers import normalizers
        except ImportError:
            return unicodedata.normalize("NFC", word)
        return normalizers.NFC().normalize_str(word)
    return unicodedata.normalize("NFC", word)


def _with_ranges(pattern: str, tables: dict) -> str:
    """The pattern with its classes spelled out; they may stand inside brackets only."""
    bare = regex.sub(r"\[(?:\\.|[^\]])*\]", "", pattern)
    if regex.search(r"\\[pPsS]", bare):
        raise ValueError("a class outside brackets")
    return pattern.replace(r"\p{L}", tables["L"]).replace(r"\p{N}", tables["N"]).replace(r"\s", tables["s"])


def load(path: str | None = None) -> dict:
    """What encoding needs of a vocabulary file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    suffix = model["end_of_word_suffix"] or ""
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tables = characters()
    return {
        "tokens": {**{i: t for t, i in vocab.items()}, **{i: t for t, i in special.items()}},
        "inner": [vocab[s] for s in byte_symbols()],
        "final": [vocab[s + suffix] for s in byte_symbols()],
        "pairs": np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64),
        "split": split.replace(r"\s", r"\p{White_Space}") if tables is None else _with_ranges(split, tables),
        "ascii": _with_ranges(split, {"L": "A-Za-z", "N": "0-9", "s": "\t-\r "}),
        "lower": tables and tables["lower"],
        "special": special,
    }


class Encoder:
    """Encodes and decodes texts; made once per worker from load()'s tables."""

    def __init__(self, tables: dict):
        self.tokens, self.special = tables["tokens"], tables["special"]
        self.inner, self.final = (np.array(tables[k], np.int32) for k in ("inner", "final"))
        left, right, self.merged = tables["pairs"].T
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        self.keys, self.rank = keys[order][first], order[first].astype(np.int32)
        self.ranks = dict(zip(zip(left.tolist(), right.tolist(), strict=True), range(len(left)), strict=True))
        self.splitter = (regex if tables["lower"] is None else re).compile(tables["split"])
        self.ascii_splitter = re.compile(tables["ascii"])
        self.white = regex.compile(r"\p{White_Space}+")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.odd = regex.compile("[\x1c-\x1f]")
        self.lower = tables["lower"]
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_bytes = self.shown_bytes = 0
        self.shown: dict[str, tuple[str, str, int]] = {}
        self.id_text = {i: str(i) for i in self.tokens}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of adjacent parts; NONE where they don't merge or one is missing (-1)."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank[at], NONE)

    def short_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of words, all of which are rows of the same arrays."""
        n = np.array([len(w) for w in words])
        width = int(n.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        inside = np.arange(width) < n[:, None]
        parts = np.where(inside, self.inner[raw], -1).astype(np.int32)
        rows = np.arange(len(words))
        parts[rows, n - 1] = self.final[raw[rows, n - 1]]
        out: list = [None] * len(words)
        ranks = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        ids = rows
        while len(ids):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            rows = np.arange(len(ids))
            least = ranks[rows, at] if ranks.shape[1] else np.full(len(ids), NONE)
            done = least == NONE
            if done.any():
                for i, p in zip(ids[done].tolist(), parts[done].tolist(), strict=True):
                    out[i] = tuple(x for x in p if x >= 0)
                parts, ranks, ids, at, least = parts[~done], ranks[~done], ids[~done], at[~done], least[~done]
                rows = np.arange(len(ids))
                if not len(ids):
                    break
            parts[rows, at] = self.merged[least]
            stay = np.ones(parts.shape, bool)
            stay[rows, at + 1] = False
            parts = parts[stay].reshape(len(ids), -1)
            stay = np.ones(ranks.shape, bool)
            stay[rows, at] = False
            ranks = ranks[stay].reshape(len(ids), -1)
            if ranks.shape[1]:
                lo = np.maximum(at - 1, 0)
                ranks[rows, lo] = np.where(at > 0, self.pair_ranks(parts[rows, lo], parts[rows, lo + 1]), ranks[rows, lo])
                has = at < ranks.shape[1]
                hi = np.minimum(at, ranks.shape[1] - 1)
                ranks[rows, hi] = np.where(has, self.pair_ranks(parts[rows, hi], parts[rows, hi + 1]), ranks[rows, hi])
        return out

    def long_word(self, word: bytes) -> tuple[int, ...]:
        """The same merges by a heap of (rank, place) over a linked list."""
        raw = np.frombuffer(word, np.uint8)
        parts = self.inner[raw].tolist()
        parts[-1] = int(self.final[raw[-1]])
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return tuple(p for p in parts if p >= 0)

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known yet."""
        if self.known_bytes > KEPT:
            self.known.clear()
            self.known_bytes = 0
        new = [(w, w.encode()) for w in words if w not in self.known]
        found = []
        for low, high in ((0, 8), (8, 16), (16, SHORT)):
            if some := [(w, b) for w, b in new if low < len(b) <= high]:
                found += zip((w for w, _ in some), self.short_words([b for _, b in some]), strict=True)
        found += [(w, self.long_word(b)) for w, b in new if len(b) > SHORT]
        self.known.update(found)
        self.known_bytes += sum(150 + len(w) + 8 * len(ids) for w, ids in found)

    def pieces(self, word: str) -> list[str]:
        """What the pattern finds in a word between white space."""
        if word.isascii():
            low = word.lower()
            return [low] if low.isalpha() else self.ascii_splitter.findall(low)
        low = composed(word)
        low = low.translate(self.lower) if self.lower is not None else "".join(c.lower() for c in low) if "Σ" in low else low.lower()
        return self.splitter.findall(low)

    def split(self, text: str) -> list[str]:
        return self.white.split(text) if self.odd.search(text) else text.split()

    def prepare(self, words: list[str]) -> list[tuple[str, str, int]]:
        """Each white-space word's ids and tokens as text, and how many."""
        if self.shown_bytes > KEPT:
            self.shown.clear()
            self.shown_bytes = 0
        shown = self.shown
        missing = [w for w in words if w not in shown]
        found = [self.pieces(w) for w in missing]
        self.learn(list({p for ps in found for p in ps}))
        known, id_text, tokens = self.known, self.id_text, self.tokens
        for w, ps in zip(missing, found, strict=True):
            ids = known[ps[0]] if len(ps) == 1 else [i for p in ps for i in known[p]]
            shown[w] = one = (" ".join([id_text[i] for i in ids]), " ".join([tokens[i] for i in ids]), len(ids))
            self.shown_bytes += 350 + len(w) + len(one[0]) + len(one[1])
        return [shown[w] for w in words]

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens: (segment, whether it is one)."""
        out, at = [], 0
        if self.marks and "<" in text or self.marks and not all(m.startswith("<") for m in self.special):
            for m in self.marks.finditer(text):
                out += [(text[at : m.start()], False), (m[0], True)]
                at = m.end()
        return [*out, (text[at:], False)]

    def encode_odd(self, text: str) -> tuple[str, str]:
        """Ids in decimal and decoded tokens, each joined by a space, of a text with special tokens or rare separators."""
        parts = [([s], True) if mark else (self.split(s), False) for s, mark in self.segments(text)]
        self.prepare(list({w for p, mark in parts if not mark for w in p}))
        words = [(self.id_text[self.special[w]], w) if mark else self.shown[w][:2] for p, mark in parts for w in p if w]
        return " ".join([a for a, _ in words if a]), " ".join([b for a, b in words if a])

    def encode_array(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """For each text (no nulls) its ids in decimal and its decoded tokens, each joined by a space, and how many."""
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        for m in self.special:
            odd = odd | pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        split = pc.utf8_split_whitespace(plain)
        words = split.flatten().dictionary_encode()
        distinct, codes = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())]).astype(np.int64)
        shown = self.prepare(distinct)
        n = np.array([s[2] for s in shown], np.int64)
        if len(n) and not n.all():  # empty strings beside outer white space
            stay = n[codes] > 0
            at = np.concatenate([[0], np.cumsum(per_text(stay.astype(np.int64), at))])
            codes = codes[stay]
        offsets, codes_, size = pa.array(at.astype(np.int32)), pa.array(codes), per_text(n[codes], at)
        joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([s[k] for s in shown], pa.string()).take(codes_)), " ") for k in (0, 1)]
        if not odd.any():
            return *joined, size
        strange = [self.encode_odd(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        back = np.empty(len(texts), np.int64)
        back[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(texts))
        both = [pa.concat_arrays([j, pa.array([s[i] for s in strange], pa.string())]).take(pa.array(back)) for i, j in enumerate(joined)]
        return *both, np.concatenate([size, [len(s[0].split()) for s in strange]])[back].astype(np.int64)

    def encode_texts(self, texts: list[str]) -> list[tuple[str, str]]:
        ids, tokens, _ = self.encode_array(pa.array(texts, pa.string()))
        return list(zip(ids.to_pylist(), tokens.to_pylist(), strict=True))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_texts([text])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def encoder_of(tables) -> Encoder:
    """The worker's encoder for a broadcast."""
    return held(("bpe", tables.id), lambda: Encoder(tables.value))


def encoded(enc: Encoder, column: pa.Array):
    """(row, begins, ends, ids, tokens, n) for every text of a column, or every piece of a long one, in order; ids and
    tokens are Arrow strings."""
    for c in chunks(column, GROUP, cut=True):
        texts = pa.StringArray.from_buffers(c.n, pa.py_buffer(c.at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c.data)))
        ids, tokens, n = enc.encode_array(texts)
        for i in range(c.n):
            yield c.first + i, c.begins, c.ends, ids[i], tokens[i], int(n[i])


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    ready_workers(spark)
    tables = _Shared(spark.sparkContext.broadcast(load(path)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoder_of(tables)
        for b in batches:
            total, digests = [], []
            for _, begins, ends, ids, tokens, n in encoded(enc, b.column(1)):
                if begins:
                    held_n, sums = 0, (hashlib.sha256(), hashlib.sha256())
                for s, x in zip(sums, (ids, tokens), strict=True):
                    if held_n and n:
                        s.update(b" ")
                    s.update(x.as_buffer())
                held_n += n
                if ends:
                    total.append(held_n)
                    digests.append([s.hexdigest() for s in sums])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), *(pa.array([d[k] for d in digests], pa.string()) for k in (0, 1))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), n_tokens, decoded: the encoded corpus itself."""
    spark = docs.sparkSession
    ready_workers(spark)
    tables = _Shared(spark.sparkContext.broadcast(load(path)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoder_of(tables)
        for b in batches:
            counts, ids, decoded = np.zeros(b.num_rows, np.int64), [], [""] * b.num_rows
            for row, _, _, found, tokens, n in encoded(enc, b.column(1)):
                if n:
                    ids.append(np.fromstring(found.as_py(), np.int32, sep=" "))
                    decoded[row] = f"{decoded[row]} {tokens.as_py()}" if counts[row] else tokens.as_py()
                counts[row] += n
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(counts), pa.array(decoded, pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, decoded string")


class _Shared:
    """A broadcast with an id that workers can keep things by."""

    def __init__(self, held):
        self.held, self.id = held, held._jbroadcast.id()

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self):
        return self.held.value


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir))


QUERIES = {"op8_bpe": op8_bpe}
ORACLE_SQL: dict[str, str] = {}
