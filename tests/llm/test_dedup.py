import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabulon.llm import exact_dedup, line_dedup, simhash
from tests.llm.helpers import WORD, docs_of, empty_docs, odd_docs


def test_exact_groups(spark):
    got = {r.doc_id: r for r in exact_dedup.group_records(docs_of(spark, ["a", "b", "a", "c", "a"]), smallest=False).collect()}
    assert [got[i].keep_id for i in range(5)] == [4, 1, 4, 3, 4]
    assert [got[i].kept for i in range(5)] == [False, True, False, True, True]
    assert got[0].group_size == 3 and got[0].text_sha256 == hashlib.sha256(b"a").hexdigest()
    small = {r.doc_id: r.keep_id for r in exact_dedup.group_records(docs_of(spark, ["a", "b", "a"])).collect()}
    assert small == {0: 0, 1: 1, 2: 0}


def test_exact_collision_is_told_apart(spark):
    docs = docs_of(spark, ["ab", "cd", "ab", "xyz", "cd", "q"])
    weak = F.unhex(F.lpad(F.length("text").cast("string"), 2, "0"))  # the length as hash: texts of one length collide
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.group_records(docs, hash_of=weak, smallest=False).collect()}
    assert got == {0: (2, 2, False), 2: (2, 2, True), 1: (4, 2, False), 4: (4, 2, True), 3: (3, 1, True), 5: (5, 1, True)}


def test_exact_odd_rows(spark):
    got = exact_dedup.group_records(odd_docs(spark), smallest=False).collect()
    assert len(got) == 12
    empty = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 4 and {r.keep_id for r in empty} == {2} and sum(r.kept for r in empty) == 1
    twice = [r for r in got if r.doc_id == 3 and r.group_size == 2]
    assert sum(r.kept for r in twice) == 1
    assert exact_dedup.group_records(empty_docs(spark)).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.dedup_documents(docs_of(spark, ["a", "b", "a"])).collect()) == [0, 1]
    assert exact_dedup.dedup_documents(odd_docs(spark)).count() == sum(r.kept for r in exact_dedup.group_records(odd_docs(spark)).collect())


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    for t in [None, "", "a", "A b", "a B c", "a b c d a b c d", "Ünï cödé x", " \n"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_gray_index_equals_brute_force():
    rng = np.random.default_rng(5)
    fp = []
    for base in rng.integers(0, 2**64, 40, dtype=np.uint64):
        for _ in range(25):
            fp.append(int(base) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    fp = np.unique(np.array(fp, np.uint64))
    group = rng.integers(0, 3, len(fp))
    index = simhash.GrayIndex(fp, group)
    who, node = index.search(index.fp, index.root)
    near = (np.bitwise_count(index.fp[:, None] ^ index.fp[None, :]) <= 3) & (group[index.order][:, None] == group[index.order][None, :])
    assert set(zip(who.tolist(), node.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))


@pytest.mark.parametrize("group", [3, 20_000])
def test_components_equal_brute_force(spark, group):
    rng = np.random.default_rng(9)
    fp = []
    for base in rng.integers(0, 2**64, 60, dtype=np.uint64):
        x = int(base)
        for _ in range(8):  # a chain: each within 3 bits of the one before
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            fp.append(x)
    fp = np.unique(np.array(fp, np.uint64))
    parent = simhash.connect(np.arange(len(fp)), *np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3))
    table = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    edges = simhash.checkpoint(simhash.linked(table, group))
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    mine = [got.get(int(x), int(x)) for x in fp.view(np.int64)]
    assert len(set(zip(mine, parent.tolist()))) == len(set(mine)) == len(set(parent.tolist()))


def test_near_groups(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [base, base, base.replace("word7 ", "other "), "quite another text than those", "", " \n"]
    got = {r.doc_id: r for r in simhash.near_groups(docs_of(spark, texts)).collect()}
    want = [brute_fingerprint(t) for t in texts]
    assert [got[i].fp % 2**64 for i in range(6)] == want
    assert got[1].component_id == 0 and got[3].component_id == 3 and got[4].component_id == got[5].component_id == 4
    assert got[2].component_id == (0 if (want[0] ^ want[2]).bit_count() <= 3 else 2)
    odd = simhash.near_groups(odd_docs(spark)).collect()
    assert len(odd) == 12
    kept = simhash.keep_first(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert kept.count() == len({r.label for r in odd})
    assert simhash.near_groups(empty_docs(spark)).count() == 0


def test_keep_first_keeps_one_of_each_group(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(None, a), (None, b), (None, c), (None, c), (5, d), (5, e), (5, e), (9, e), (None, d)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    got = [(r.doc_id, r.text) for r in simhash.keep_first(docs).collect()]
    assert len(got) == 5 and set(got) == {(None, a), (None, b), (None, c), (5, d), (5, e)}


def brute_lines(texts, least):
    """Texts after deletion of later copies of runs with at least so many words."""
    lines = [(t or "").split("\n") for t in texts]
    worded = [[(i, s, len(WORD.findall(s))) for i, s in enumerate(ls) if WORD.search(s)] for ls in lines]
    seen, gone = set(), [set() for _ in texts]
    runs = []
    for d, ws in enumerate(worded):
        for a in range(len(ws)):
            for b in range(a + 1, len(ws) + 1):
                if sum(w[2] for w in ws[a:b]) >= least:
                    runs.append(((d, a), tuple(w[1] for w in ws[a:b]), ws[a][0], ws[b - 1][0]))
    for (d, _), run, first, last in sorted(runs, key=lambda r: r[0]):
        if (run,) in seen:
            gone[d].update(i for i, _, _ in worded[d] if first <= i <= last)
        seen.add((run,))
    for g, ws in zip(gone, worded):  # blank lines between two deleted ones go with them
        for (i, _, _), (j, _, _) in zip(ws, ws[1:]):
            if i in g and j in g:
                g.update(range(i, j))
    return ["\n".join(s for i, s in enumerate(ls) if i not in g) for ls, g in zip(lines, gone)]


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    pool = [" ".join(f"v{rng.integers(9)}" for _ in range(rng.integers(1, 5))) for _ in range(14)] + ["", "  "]
    texts = ["\n".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(0, 30))) for _ in range(40)]
    texts += [texts[3], texts[3] + "\nand more of it", "same line here\n" * 6]
    for least in (1, 4, 10):
        got = {r.doc_id: r.text for r in line_dedup.cleaned(docs_of(spark, texts), least).collect()}
        assert [got[i] or "" for i in range(len(texts))] == brute_lines(texts, least)


def test_line_dedup_repeated_rows_are_one_document(spark):
    passage = "\n".join(" ".join(f"p{i}x{k}" for k in range(4)) for i in range(13))
    short = "alpha beta gamma\ndelta epsilon zeta"  # six words: too few for a run, unless rows count twice
    rows = [(1, passage), (1, passage), (2, "another head\n" + passage), (3, "first\n" + short), (3, "first\n" + short), (4, "second\n" + short), (4, "second\n" + short)]
    rows += [(None, "head of a null id\n" + passage)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in line_dedup.cleaned(docs).collect()}
    assert got == {(1, passage), (2, "another head"), (3, "first\n" + short), (4, "second\n" + short), (None, "head of a null id")}


def test_line_dedup_odd_rows(spark):
    docs = odd_docs(spark)
    out = line_dedup.cleaned(docs, 4)
    assert out.columns == [*docs.columns, "n_deleted"] and out.count() == 12
    assert {r.n_deleted for r in out.filter("doc_id = 3").collect()} == {0}
    assert line_dedup.cleaned(empty_docs(spark)).count() == 0


def test_suffix_levels_are_intervals(spark):
    docs = docs_of(spark, ["a\nb\nc\nd", "x\na\nb\nc", "b\nc\na"])
    levels = line_dedup.suffix_levels(line_dedup.line_rows(docs))
    for k, level in enumerate(levels[:2]):
        seqs = {0: "abcd", 1: "xabc", 2: "bca"}
        rows = {(r.doc_id, r.pos): (r.h, r.off) for r in level.collect()}
        want = {}
        for d, s in seqs.items():
            for p in range(len(s) - (1 << k) + 1):
                want.setdefault(s[p : p + (1 << k)], []).append((d, p))
        groups = {}
        for place, rank in rows.items():
            groups.setdefault(rank, []).append(place)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_earlier_runs_are_the_longest(spark):
    """The longest run at each line that also begins earlier, against all pairs of places."""
    rng = np.random.default_rng(7)
    seqs = ["".join(rng.choice(list("ab" if k % 3 else "abcd"), rng.integers(0, 40))) for k in range(12)]
    seqs += [seqs[1] + seqs[4], "a" * 21, "xyz" * 9]
    runs = line_dedup.earlier_runs(line_dedup.suffix_levels(line_dedup.line_rows(docs_of(spark, ["\n".join(s) for s in seqs]))))
    got = {(r.doc_id, r.pos): r.n for r in runs.collect()}
    places = [(d, p) for d, s in enumerate(seqs) for p in range(len(s))]
    for i, (d, p) in enumerate(places):
        want = max((next((n for n in range(len(seqs[d]) - p + 1) if seqs[e][q : q + n + 1] != seqs[d][p : p + n + 1] or n == min(len(seqs[d]) - p, len(seqs[e]) - q)), 0) for e, q in places[:i]), default=0)
        assert got.get((d, p), 0) == want, (d, p)


def test_line_ids_that_share_one_half(spark):
    """Lines whose ids clash in 64 of 128 bits stay apart."""
    lines = spark.createDataFrame([(d, 0, p, p, 5, h2, 9, 0) for d, seq in enumerate(([1, 2, 1], [1, 2], [2, 1], [3])) for p, h2 in enumerate(seq)], "doc_id long, th long, pos int, line int, h long, h2 long, words int, before long")
    levels = line_dedup.suffix_levels(lines)
    ranks = {}
    for r in levels[0].collect():
        ranks.setdefault(r.off, set()).add((r.doc_id, r.pos))
    assert sorted(map(sorted, ranks.values())) == [[(0, 0), (0, 2), (1, 0), (2, 1)], [(0, 1), (1, 1), (2, 0)]]


def test_forest_of_one_dense_group():
    """Thousands of fingerprints within 3 bits of a centre: one tree, in bounded steps."""
    rng = np.random.default_rng(11)
    fp = np.unique(np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(4000)], np.uint64))
    a, b = simhash.forest(fp, np.zeros(len(fp), np.int64))
    assert len(a) == len(fp) - 1 and len(set(b.tolist())) == 1
