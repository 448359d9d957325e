"""The quality query and the whole pipeline against plain Python over a small table."""

import math
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer
import public_tokenizers

import corpus_pipeline
from tabulon.llm import mixing, quality_rules
from tests.llm.helpers import WORD, docs_of
from tests.llm.test_dedup import brute_fingerprint, brute_lines
from tests.llm.test_text import brute_rules


def brute_perplexity(texts):
    """Mean -log10 probability per 4-gram of byte classes under modified Kneser-Ney, by dictionaries."""
    rows = [[0, 0, 0, *(int(quality_rules.CLASS[b]) for b in (t or "").encode())] for t in texts]
    top = Counter(tuple(r[i - 3 : i + 1]) for r in rows for i in range(3, len(r)))
    counts = {4: top}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, total, kinds = {}, {}, {}
    for n, c in counts.items():
        of = Counter(c.values())
        y = of[1] / max(of[1] + 2 * of[2], 1)
        d = {i: min(max(i - (i + 1) * y * of[i + 1] / of[i], 0.1), i - 0.05) if of[i] else 0.5 for i in (1, 2, 3)}
        discount[n] = lambda k, d=d: d[min(k, 3)]
        total[n], kinds[n] = Counter(), defaultdict(float)
        for g, k in c.items():
            total[n][g[:-1]] += k
            kinds[n][g[:-1]] += discount[n](k)

    def p(g):
        n = len(g)
        if not n:
            return 1 / 64
        if g[:-1] not in total[n]:
            return p(g[1:])
        k = counts[n][g]
        own = (k - discount[n](k)) / total[n][g[:-1]] if k else 0
        return own + kinds[n][g[:-1]] / total[n][g[:-1]] * p(g[1:])

    return [-sum(math.log10(p(tuple(r[i - 3 : i + 1]))) for i in range(3, len(r))) / (len(r) - 3) if len(r) > 3 else None for r in rows]


def brute_kept(docs):
    """doc_id → whether the rules keep (doc_id, text, lang)."""
    failed, perp = {}, dict(zip([d[0] for d in docs], brute_perplexity([d[1] for d in docs])))
    for i, t, _ in docs:
        n, _, _, _, again = brute_rules(t)
        failed[i] = n < 20 or 100 * again > 30 * n
    groups = defaultdict(list)
    for i, _, lang in docs:
        if not failed[i]:
            groups[lang].append(math.floor(perp[i] / quality_rules.BIN + 0.5))

    def middle(x):
        x = sorted(x)
        return x[(len(x) + 1) // 2 - 1]

    med = {k: middle(v) for k, v in groups.items()}
    mad = {k: middle([abs(b - med[k]) for b in v]) for k, v in groups.items()}
    shared = sum(mad[k] * len(v) for k, v in groups.items()) / max(sum(map(len, groups.values())), 1)
    spread = {k: max((mad[k] * len(v) + shared * quality_rules.PRIOR) / (len(v) + quality_rules.PRIOR), 1.0) for k, v in groups.items()}
    wide = lambda i, t, k: spread[k] * quality_rules.BIN * math.sqrt(1 + quality_rules.SHORT_GRAMS / max(len((t or "").encode()), 1))
    near = lambda i, t, k: abs(perp[i] - med[k] * quality_rules.BIN) <= quality_rules.LOWER_DEVIATIONS * wide(i, t, k)
    return {i: not failed[i] and near(i, t, lang) for i, t, lang in docs}, perp


def small_table(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("aeiou")) + rng.choice(list("lmnrst")) for _ in range(rng.integers(1, 4)))
    line = lambda: " ".join(word() for _ in range(rng.integers(5, 14)))
    shared = [line() + " " + line() for _ in range(3)]
    texts = []
    for i in range(60):
        ls = [line() for _ in range(rng.integers(3, 9))]
        if i % 4 == 0:
            ls.insert(1, shared[i % 3])
        texts.append("\n".join(ls))
    texts += [texts[5], texts[6] + "\n", texts[7].replace(" ", "  ", 3), "short", "", None, " ".join(["QX|#"] * 40), " ".join(f"ZZ{i}#%|" for i in range(50))]
    a = docs_of(spark, texts[:40], source="a")
    b = docs_of(spark, texts[40:], lang="fr", source="b", start=40)
    return a.union(b).select("doc_id", "text", "lang", "source", "n_chars")


def test_quality_query_equals_brute_force(spark):
    docs = small_table(spark)
    kept, perp = brute_kept([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    for r in quality_rules.quality_records(docs).collect():
        assert r.kept == kept[r.doc_id]
        assert (r.perp is None) == (perp[r.doc_id] is None) and (r.perp is None or math.isclose(r.perp, perp[r.doc_id], rel_tol=1e-4))


def test_pipeline_equals_brute_force(spark, tmp_path):
    small_table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(((r.doc_id, r.text, r.lang, r.source) for r in docs.collect()))

    kept, _ = brute_kept([r[:3] for r in rows])
    rows = [r for r in rows if kept[r[0]]]
    rows = [(i, t, lang, source) for (i, _, lang, source), t in zip(rows, brute_lines([r[1] for r in rows], 10))]
    fp = [brute_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    rows = [r for k, r in enumerate(rows) if group[k] == k]

    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix_records(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t, _, _ in rows:
        n, size = taken[i]
        while n > 0:
            part = t if n >= size else " ".join(WORD.findall(t)[:n])
            want.append((i, tuple(library.encode(part, add_special_tokens=False).ids)))
            n -= size
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted(want)
    assert all(r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in got)


def test_stages_keep_the_columns(spark):
    docs = small_table(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
