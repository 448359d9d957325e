import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulon.llm import bpe, common, maxent, mixing, ordinal, quality_rules, toxicity
from tabulon.llm.common import chunks
from tests.llm.helpers import WORD, docs_of, empty_docs, odd_docs

ENCODER = bpe.Encoder(bpe.load())
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def same_as_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    ids, shown = next(iter(ENCODER.encode_texts([text])))
    assert ids == " ".join(map(str, want))
    assert shown == LIBRARY.decode(want, skip_special_tokens=False) == ENCODER.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8", max_codepoint=0x2FFF), st.sampled_from(" 'stdmrevl<|>\n\x1ćΣ")), max_size=80))
def test_bpe_equals_library(text):
    same_as_library(text)


def test_bpe_every_character_equals_library():
    """All planes: each character alone between letters, then random mixes of them."""
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["a" + "b ".join(every[i : i + 512]) for i in range(0, len(every), 512)]
    rng = np.random.default_rng(4)
    low, high = np.array(every[:0x3400]), np.array(every)
    texts += ["".join(rng.choice(low if k % 2 else high, 40)) for k in range(4000)]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    got = ENCODER.encode_texts(texts)
    bad = [t for t, w, g in zip(texts, want, got) if g[0] != " ".join(map(str, w))]
    assert not bad, [hex(ord(c)) for c in bad[0]][:50]


def test_bpe_pieces_and_bounded_tables(spark, monkeypatch):
    texts = ["one two  three " * 40, "x" * 300 + " y", "", None, " <|endoftext|> a" * 9, "Σ\u00a0b " * 30]
    whole = bpe.Encoder(bpe.load())
    monkeypatch.setattr(bpe, "GROUP", 64)
    monkeypatch.setattr(bpe, "KEPT", 2000)
    found = [[] for _ in texts]
    for row, _, _, ids, _, n in bpe.encoded(ENCODER, pa.array(texts)):
        found[row] += ids.as_py().split()
    assert [" ".join(f) for f in found] == [a for a, _ in whole.encode_texts([t or "" for t in texts])]


def test_bpe_cases():
    for t in ["", "don't we'll I'M", "<|endoftext|>a<|startoftext|><|end", "ab" * 400, "Σ ΑΣ İ", "\x1c a\x1d", "thethethe" * 30, "1234 ½"]:
        same_as_library(t)


def test_bpe_rows(spark):
    got = bpe.encode_digests(odd_docs(spark)).collect()
    assert len(got) == 12
    for r in got:
        if r.n_tokens == 0:
            assert r.ids_sha256 == r.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_digests(empty_docs(spark)).count() == 0
    row = bpe.encode_documents(docs_of(spark, ["Hello, world"])).first()
    assert row.ids == LIBRARY.encode("Hello, world", add_special_tokens=False).ids and row.n_tokens == len(row.ids)


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    often = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if often[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_rules_equal_brute_force(spark):
    texts = [None, "", " \n ", "a\nb\na\n\na", "x | y # é ü 😀", "a b c d e f g h " * 3, "l\n" * 5, "\n\nq\n", "one two\r\none two\r\none two"]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in quality_rules.quality_records(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    odd = {(r.doc_id, r.n_words, r.n_repeat_words) for r in quality_rules.quality_records(odd_docs(spark)).collect()}
    assert (4, 60_000, 60_000) in odd and len(odd) == 10
    assert quality_rules.quality_records(empty_docs(spark)).count() == 0


def test_exact_ids_tell_clashing_hashes_apart():
    c = next(chunks(pa.array(["ab cd ab ce abc"])))
    starts, ends, _ = c.words()
    for h in (c.hashes(starts, ends), np.zeros(5, np.uint64), np.array([1, 1, 1, 1, 2], np.uint64)):
        ids = common.exact_ids(c.data, starts, ends, h)
        assert ids[0] == ids[2] and len(set(ids.tolist())) == 4


def test_kneser_ney_is_a_distribution(spark):
    model = quality_rules.fit(docs_of(spark, ["the cat sat on the mat", "The dog! 12", None, "é ü"]))
    for context in (0, 20 << 12 | 8 << 6 | 5, 5 << 12 | 3 << 6 | 1):
        total = model.lookup(np.arange(64) | context << 6).sum()
        assert abs(total - 1) < 1e-6


def test_perplexity_bands_reject_other_text(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("aeiou")) + rng.choice(list("lmnrst")) for _ in range(rng.integers(1, 4)))
    texts = [" ".join(word() for _ in range(80)) for _ in range(150)] + [" ".join("QXZK|%$" for _ in range(60)), " ".join(f"x{i}zq#" for i in range(60))]
    rows = quality_rules.quality_records(docs_of(spark, texts)).collect()
    assert all(r.kept for r in rows if r.doc_id < 150)
    assert not any(r.kept for r in rows if r.doc_id >= 150)
    assert quality_rules.keep_good(docs_of(spark, texts)).count() == 150


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


def brute_maxent(texts, held, model):
    """(n_tokens, n_known, base, score) of each text by plain Python: counts in dictionaries, the model's weights alone."""
    keys = [[int(x) for x in maxent.tokens(next(chunks(pa.array([t or ""]))))[0]] for t in texts]
    words = [tokens_of(t) for t in texts]
    c, code = Counter(), {}
    for ks, ws, out in zip(keys, words, held):
        code.update(zip(ws, ks))
        if not out:
            c.update(ws)
    n, v = sum(c.values()), len(c)
    top = sorted((w for w in c if w is not None), key=lambda w: (-c[w], code[w] - (code[w] >> 63 << 64)))[: maxent.FREQUENT]
    place = {w: 1 + i for i, w in enumerate(top)} | {None: 0}
    slot = {w: place.get(w, maxent.CLASSES * maxent.SLOTS - maxent.TAILS + code[w] % maxent.TAILS) for w in code}
    total, once = Counter(), Counter()
    for w, k in c.items():
        if w not in place:
            total[slot[w]] += k
            once[slot[w]] += k == 1

    def share(w):
        s = slot[w]
        if w in place:
            return 1.0
        unseen = (once[s] + 0.5) / (total[s] + 1) if total[s] else 1.0
        return (1 - unseen) * c[w] / total[s] if c[w] else unseen

    def row(key, i, bits):
        h, m = (key ^ int(maxent._SALT[i])) % 2**64, 0xD6E8FEB86659FD93
        h = (h ^ h >> 32) * m % 2**64
        h = (h ^ h >> 32) * m % 2**64
        return ((h ^ h >> 32) >> 64 - bits)

    def soft(scores, at):
        top = max(scores)
        return math.exp(scores[at] - top) / sum(math.exp(x - top) for x in scores)

    w, cross, out = model.weights, int(maxent._CROSS), []
    for ks, ws in zip(keys, words):
        score = 0.0
        for i, word in enumerate(ws):
            one, two, three = (ks[i - b] if i >= b else int(maxent.START) for b in (1, 2, 3))
            g, inner = divmod(slot[word], maxent.SLOTS)
            pair = (one * cross + two) % 2**64
            rows = [row(k, f, maxent.CLASS_BITS) + (f << maxent.CLASS_BITS) for f, k in enumerate((one, pair, two, three))]
            p = soft([float(w.class_bias[k]) + sum(float(w.of_class[r, k]) for r in rows) for k in range(maxent.CLASSES)], g)
            by = (g + 1) * cross % 2**64
            rows = [row(k ^ by, 4 + f, maxent.SLOT_BITS) + (f << maxent.SLOT_BITS) for f, k in enumerate((one, pair))]
            p *= soft([float(w.slot_bias[g, k]) + sum(float(w.of_slot[r, k]) for r in rows) for k in range(maxent.SLOTS)], inner)
            score += math.log10(p * share(word))
        out.append((len(ws), sum(x in c for x in ws), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ws), score, n))
    return out


def zipf_texts(n=120, kinds=1500, seed=12):
    rng = np.random.default_rng(seed)
    words = [f"w{i * 7919 % 10007}" for i in range(kinds)]
    return [" ".join(words[min(int(x), kinds - 1)] for x in rng.zipf(1.2, rng.integers(0, 60))) for _ in range(n)]


def test_maxent_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(maxent, "CHUNK_BYTES", 64)  # pieces on the driver's side of the test only
    texts = ["the cat sat", "The dog sat down", None, "", "a a a b", "cat É é", *zipf_texts(), "the cat sat"]
    docs = docs_of(spark, texts).repartition(3)
    rows = maxent.grouped(docs)
    model, counts = maxent.fit(rows)
    got = {r.doc_id: r for r in maxent.score_documents(rows, model, counts).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    for i, (n, known, base, score, total) in enumerate(brute_maxent(texts, held, model)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held[i])
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-4)


def test_maxent_upper_case_endings_are_the_same_words(spark):
    texts = ["CAT cat caT Cat", "A a I i", "THE the tHE", "a cat", "É é ÉA éa"] * 3
    assert all(len(set(maxent.tokens(next(chunks(pa.array([w, w.lower(), w.swapcase()]))))[0].tolist())) == 2 for w in ("CAT", "A", "xY", "x-Q"))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(t for t, out in zip(texts, held) if not out for t in tokens_of(t))
    n, v = sum(c.values()), len(c)
    for r in maxent.score_corpus(docs_of(spark, texts)).collect():
        words = tokens_of(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words), sum(w in c for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)


def test_maxent_learns_what_follows(spark):
    rng = np.random.default_rng(3)
    def text():
        out = [f"s{rng.integers(40)}"]
        while len(out) < 60:
            out.append(f"s{(int(out[-1][1:]) * 7 + 1 + int(rng.integers(2))) % 40}")
        return " ".join(out)
    rows = maxent.score_corpus(docs_of(spark, [text() for _ in range(300)])).filter("held_out").collect()
    assert sum(r.score for r in rows) > 0.75 * sum(r.base_score for r in rows)


def test_maxent_pieces_read_like_whole_texts():
    texts = pa.array([" ".join(zipf_texts(40)), "", None, "x" * 300 + " y", "a b"])
    def read(cut):
        history, out = maxent.Histories(), [[] for _ in range(5)]
        for c in chunks(texts, 50, cut):
            h, at, before = history.of(c)
            for i in range(c.n):
                out[c.first + i].append((h[at[i] : at[i + 1]], before[:, at[i] : at[i + 1]]))
        return [[np.concatenate([p[k] for p in parts], -1).tolist() for k in (0, 1)] for parts in out]
    assert read(True) == read(False)


def test_maxent_counts_beyond_32_bits(spark):
    """A word that stands 3 * 2**31 times is counted and scored as such."""
    def blob(*x, t=np.int64):
        return np.array(x, t).tobytes()
    word, end = 0x5000, int(maxent.END)
    asked = spark.createDataFrame([(g, 0, blob(end, word, t=np.uint64), blob(1, 2**31)) for g in range(3)], "gid long, part int, h binary, n binary")
    counts = maxent.counted(asked, 1).collect()
    assert all(np.frombuffer(r.n, np.int64).tolist() == [3, 3 * 2**31] for r in counts if r.kind == maxent.ANSWER)
    assert [(r.word, r.often) for r in counts if r.kind == maxent.WORDS] == [(word, 3 * 2**31)]


def test_maxent_is_a_distribution_over_words(spark):
    texts = zipf_texts(60)
    rows = maxent.grouped(docs_of(spark, texts))
    model, _ = maxent.fit(rows)
    c = Counter(t for i, x in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens_of(x))
    known = {w: maxent.tokens(next(chunks(pa.array([w]))))[0][0] if w else maxent.END for w in c}
    h = np.array(list(known.values()), np.uint64)
    slot = model.slots.of(h)
    before = np.array([[5 << 12, 7 << 12, int(h[3])], [9 << 12, int(h[2]), 3 << 12], [0x200, 0x200, int(h[1])]], np.uint64)
    p = model.weights.all_chances(before)
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    of_known = p[:, slot] @ model.shares(slot, np.array(list(c.values())))
    tails = np.arange(maxent.TAILS) + maxent.CLASSES * maxent.SLOTS - maxent.TAILS
    of_unknown = p[:, tails] @ model.shares(tails, np.zeros(len(tails), np.int64))
    assert np.allclose(of_known + of_unknown, 1, atol=1e-5)


def test_maxent_fast_steps_equal_plain_ones():
    rng = np.random.default_rng(4)
    w, rows = rng.normal(size=(64, 32)).astype(np.float32), rng.integers(0, 64, (500, 4))
    for bias in (0, 200, -200, np.where(np.arange(32) < 5, 0, -1e9), np.where(rng.random((500, 1)) < 0.5, 150, -150)):
        s = w[rows].sum(1, dtype=np.float64) + bias
        e = np.exp(s - s.max(1, keepdims=True))
        assert np.allclose(maxent.softmax(w, np.float32(bias), rows), e / e.sum(1, keepdims=True), rtol=1e-3, atol=1e-7)
    d = rng.normal(size=(500, 32)).astype(np.float32)
    for key in (rng.integers(0, 400, 500), np.arange(500), np.zeros(500, int)):
        order = np.argsort(key, kind="stable")
        kinds, edge = np.unique(key[order], return_index=True)
        want = np.stack([d[key == k].sum(0) for k in kinds])
        assert np.allclose(maxent.segment_rows(d, order, edge), want, atol=1e-4)


def test_maxent_odd_rows(spark):
    got = maxent.score_corpus(odd_docs(spark)).collect()
    assert len(got) == 12 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert maxent.score_corpus(empty_docs(spark)).count() == 0
    alone = docs_of(spark, ["a b", "c"]).filter(maxent.crc_mod(7) == 2)
    rows = maxent.score_corpus(alone.union(docs_of(spark, [""] * 30).filter(maxent.crc_mod(7) == 2))).collect()
    assert rows and all(r.n_known == 0 and r.train_tokens == 0 for r in rows)


def test_mixing_fills_targets(spark):
    docs = docs_of(spark, ["a " * 50] * 40, source="a").union(docs_of(spark, ["b " * 30] * 10, source="b", start=100)).union(docs_of(spark, ["c c"], source=None, start=200))
    rows = mixing.mix_records(docs).collect()
    size = {"a": 2000, "b": 300, "c": 2}
    taken = {k: sum(r.taken for r in rows if r.source_size == s) for k, s in size.items()}
    total = 2302
    assert taken["b"] == 900 and taken["c"] == 6 and taken["a"] == total - 906
    assert all(r.taken <= 3 * r.size for r in rows)
    again = {r.doc_id: r.taken for r in mixing.mix_records(docs).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == total
    odd = mixing.mix_records(odd_docs(spark)).collect()
    assert len(odd) == 12 and all(r.taken <= 3 * r.size for r in odd)
    assert mixing.mix_records(empty_docs(spark)).count() == 0 and mixing.mix_documents(empty_docs(spark)).count() == 0


def test_mixing_meets_the_budget_inside_equal_rows(spark):
    """Null ids of one size: the cut falls among equal rows, and not a word of the budget is left."""
    named = docs_of(spark, ["b " * 9] * 13, source="b")
    nameless = docs_of(spark, ["a " * 7, "x " * 7] * 15, source="a").withColumn("doc_id", F.lit(None).cast("long"))
    docs = named.union(nameless).union(docs_of(spark, ["c " * 5] * 200, source="c", start=500)).repartition(7)
    rows = mixing.mix_records(docs).collect()
    for source_size, n in ((117, 13), (210, 30), (1000, 200)):
        own = [r for r in rows if r.source_size == source_size]
        assert len(own) == n and sum(r.taken for r in own) == round(own[0].target)
        assert sum(r.taken % r.size > 0 for r in own) <= 1
    want = Counter((r.doc_id, r.taken) for r in rows)
    assert Counter((r.doc_id, r.taken) for r in mixing.mix_records(docs).collect()) == want
    words = Counter()
    for r in mixing.mix_documents(docs).collect():
        words[r.source] += len(WORD.findall(r.text))
    assert words == {"a": sum(r.taken for r in rows if r.doc_id is None), "b": 351, "c": sum(r.taken for r in rows if r.source_size == 1000)}


def labelled(spark, n=240):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "ka lo mi nu".split() for b in "ra so ti pu de fa".split()]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(n)]
    toxic = [i % 3 == 0 for i in range(n)]
    texts = [t + " vile" + str(rng.choice(list("abc"))) + " " + " ".join(rng.choice(words, 30)) if x else t for t, x in zip(texts, toxic)]
    junk = [i % 5 == 1 for i in range(n)]
    texts = [t.upper().replace(" ", "!! ") if j else t for t, j in zip(texts, junk)]
    labels = spark.createDataFrame([(i, 0 if j else 1, int(x)) for i, (x, j) in enumerate(zip(toxic, junk))], "doc_id long, quality int, toxic int")
    return docs_of(spark, texts), labels, toxic, junk


def test_ordinal_grades(spark):
    docs, labels, _, junk = labelled(spark)
    model = ordinal.fit(docs, ordinal.graded(labels))
    assert (np.diff(model.thresholds) > 0).all() and list(model.grades) == [0, 1, 2]
    rows = {r.doc_id: r for r in ordinal.rate(docs, model).collect()}
    assert np.mean([rows[i].kept != j for i, j in enumerate(junk)]) > 0.97
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in rows.values())
    assert len(ordinal.rate(odd_docs(spark), model).collect()) == 12
    none = ordinal.fit(docs, ordinal.graded(labels.limit(0)))
    assert ordinal.rate(docs, none).count() == len(junk)
    assert ordinal.rate(empty_docs(spark), model).count() == 0


def test_toxicity(spark):
    docs, labels, toxic, _ = labelled(spark)
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i in rows if rows[i].held_out]
    assert held == [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([rows[i].predicted == toxic[i] for i in held]) > 0.9
    odd = toxicity.score_documents(odd_docs(spark), model).collect()
    assert len(odd) == 12 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels.limit(0))).count() == len(toxic)
    assert toxicity.score_documents(empty_docs(spark), model).count() == 0


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_net().items()}
    fixed, embedded = rng.normal(size=(5, 3, 3)), rng.normal(size=(5, 3, toxicity.EMBED))
    m = np.arange(5)[:, None] < np.array([5, 3, 1])
    y = np.array([1, 0, 1])

    def loss():
        z = toxicity.logits(p, *toxicity.project(p, fixed, embedded), m)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g, _ = toxicity.gradients(p, fixed, embedded, m, y)
    for k in ("uf", "ub", "wf", "wb", "wa", "va", "wo", "bf"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        p[k][i] += 1e-4
        up = loss()
        p[k][i] -= 2e-4
        down = loss()
        p[k][i] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][i]) < 1e-2 * max(1e-2, abs(g[k][i])) + 2e-4, k


def brute_logit(model, text):
    """The highest window logit of one text, word by word and gate by gate in plain Python."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(low)
    p = {k: v.astype(float).tolist() for k, v in model.net.items()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    mixed = lambda k: int(toxicity.mix(np.array([k % 2**64], np.uint64))[0])

    def inputs(word):
        symbols = [1, *word.encode(), 2]
        grams = [mixed(sum(b << 8 * (size - 1 - j) for j, b in enumerate(symbols[i : i + size])) + (size << 56)) for size in toxicity.GRAM_SIZES for i in range(len(symbols) - size + 1)]
        c = next(chunks(pa.array([word])))
        h = int(c.hashes(*c.words()[:2], lower=True)[0])
        odds = [float(model.gram_odds[g >> 64 - toxicity.GRAM_BITS]) for g in grams]
        embed = [sum(p["embed"][g % (1 << toxicity.EMBED_BITS)][k] for g in grams) / max(len(grams), 1) for k in range(toxicity.EMBED)]
        return [float(model.word_odds[h >> 64 - toxicity.WORD_BITS]), max(odds, default=0.0), sum(odds) / max(len(odds), 1), *embed]

    def gru(xs, w, u, b):
        n, h, out = toxicity.HIDDEN, [0.0] * toxicity.HIDDEN, []
        for x in xs:
            a = [sum(xi * w[i][j] for i, xi in enumerate(x)) + b[j] for j in range(3 * n)]
            g = [sum(hi * u[i][j] for i, hi in enumerate(h)) for j in range(3 * n)]
            z, r = [sig(a[j] + g[j]) for j in range(n)], [sig(a[n + j] + g[n + j]) for j in range(n)]
            c = [math.tanh(a[2 * n + j] + r[j] * g[2 * n + j]) for j in range(n)]
            h = [c[j] + z[j] * (h[j] - c[j]) for j in range(n)]
            out.append(h)
        return out

    best, at = -math.inf, 0
    while words:
        xs = [inputs(w) for w in words[at : at + toxicity.WINDOW]]
        states = [f + b for f, b in zip(gru(xs, p["wf"], p["uf"], p["bf"]), gru(xs[::-1], p["wb"], p["ub"], p["bb"])[::-1])]
        raw = [sum(math.tanh(sum(s[i] * p["wa"][i][j] for i in range(len(s))) + p["ba"][j]) * p["va"][j] for j in range(toxicity.ATTEND)) for s in states]
        e = [math.exp(x - max(raw)) for x in raw]
        context = [sum(w * s[i] for w, s in zip(e, states)) / sum(e) for i in range(2 * toxicity.HIDDEN)]
        best = max(best, sum(x * w for x, w in zip(context, p["wo"])) + p["bo"][0])
        if at + toxicity.WINDOW >= len(words):
            break
        at += toxicity.STRIDE
    return best


def test_toxicity_equals_brute_force(spark):
    docs, labels, _, _ = labelled(spark, 60)
    model = toxicity.fit(docs, labels)
    texts = ["ka ra VILEa lo", "mu " * 40 + "vileb x" * 3, "é " + "supercalifragilistic" * 30, *[r.text for r in docs.limit(3).collect()]]
    got = model.chunk_logits(next(chunks(pa.array(texts))))
    for t, x in zip(texts, got):
        assert math.isclose(x, brute_logit(model, t), rel_tol=2e-3, abs_tol=2e-3)
    assert model.chunk_logits(next(chunks(pa.array([" "]))))[0] == -np.inf


def test_toxicity_trains_on_whole_words_and_all_windows(spark):
    """A word's end beyond 64 bytes, and a window far from the text's first, both count."""
    rng = np.random.default_rng(2)
    fill = lambda n: " ".join(rng.choice(["ka", "lo", "mi", "nu", "ra", "so"], n))
    texts = [f"{fill(rng.integers(5, 90))} {'z' * 80}{'vex' if i % 2 else 'mop'} {fill(rng.integers(5, 90))}" for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, texts)
    rows = toxicity.score_documents(docs, toxicity.fit(docs, labels)).filter("held_out").collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in rows]) > 0.95


def test_toxicity_equal_texts_with_different_labels(spark):
    texts = ["same words here"] * 40 + ["other words there"] * 40
    docs = docs_of(spark, texts).repartition(7)
    labels = spark.createDataFrame([(i, 1, int(i < 40 and i % 2)) for i in range(80)], "doc_id long, quality int, toxic int")
    a, b = (toxicity.fit(docs, labels) for _ in range(2))
    assert all((a.net[k] == b.net[k]).all() for k in a.net) and (a.slope, a.offset) == (b.slope, b.offset)
    rows = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, a).collect()}
    assert rows[0] == 1 and rows[50] == 0


def test_windows_cover_all_words():
    begin, end = toxicity.windows(np.array([0, 0, 5, 40, 200]))
    covered = {t for b, e in zip(begin, end) for t in range(b, e)}
    assert covered == set(range(200)) and (end - begin <= toxicity.WINDOW).all()


def test_chunk_hashes_depend_on_bytes_alone():
    c = next(chunks(pa.array(["ab cd ab", None, "", "cd  ab\tAB"])))
    s, e, at = c.words()
    assert at.tolist() == [0, 3, 3, 3, 6]
    h = c.hashes(s, e, lower=True)
    assert h[0] == h[2] == h[4] == h[5] and h[1] == h[3] != h[0]
