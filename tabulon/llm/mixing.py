"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key (MD5 of its id). Within a source, documents are ranged by key into equal key
ranges; word counts are summed per (source, range) with map-side combining, prefix sums run over these small sums,
and only the one range in which a source's budget ends is sorted row by row. The result is one cut point per source,
and every document is decided by comparing itself with its source's cut: no document row is shuffled, so a source
with a third of all rows is no hot key.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share 100% of all words; a target stops at
``max_epochs`` times its source's size and the excess is shared again by weight until none is above.

Defined cases: null text has size 0; a document without words has no part in the mix itself; null source is a source of its own; a repeated (doc_id, size) row is the same
document several times, and if the cut falls among such equals they are taken one after another, in the order in which
they are stored, until the budget is met to the word; an empty table gives an empty mix; other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import WORD, checkpoint, documents, n_words, small

#: Key ranges of a source; a power of two up to 2**32.
RANGES = 4096
MAX_EPOCHS = 3


def random_key() -> Column:
    """A document's key: 32 hex digits that depend on its id alone."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size → also target (double), by filling sources up to their caps in the order of cap per weight.

    The windows run over one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("double")
    s = sizes.withColumn("w", weight).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    s = s.withColumn("per_weight", F.col("cap") / F.col("w"))
    fill = Window.orderBy("per_weight", F.col("source").asc_nulls_last())
    before, all_rows = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({
        "rest": F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "rest_w": F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    s = s.withColumn("full", F.col("cap") * F.col("rest_w") <= F.col("rest") * F.col("w"))
    s = s.withColumn("first", F.min(F.when(~F.col("full"), F.struct("per_weight", F.col("source").isNull().alias("n"), "source", "rest", "rest_w"))).over(all_rows))
    share = F.col("first.rest") * F.col("w") / F.col("first.rest_w")
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def cuts(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (doc_id, source, size, key) to one row per source: source_size, target, whole epochs, and the cut of the last.

    Documents before (cut_key, cut_id, cut_size) in the source's order are taken once more, the ``cut_n`` equal ones at
    it ``cut_got`` words together, those after it not; a null cut_key means none.
    """
    ranged = sizes.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - RANGES.bit_length() + 1))
    sums = checkpoint(ranged.groupBy("source", "range").agg(F.sum("size").alias("words")))
    per_source = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    t = targets(per_source, weights, max_epochs).withColumn("budget", F.round("target").cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("epochs", whole).withColumn("left", F.col("budget") - F.col("epochs") * F.col("source_size"))
    t = checkpoint(t.withColumnRenamed("source", "s"))
    same = F.col("source").eqNullSafe(F.col("s"))

    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    at = sums.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(small(t), same)
    at = at.filter((F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("words")))
    at = checkpoint(at.select("s", F.col("range").alias("r"), "before", "left"))

    inside = ranged.join(small(at), same & (F.col("range") == F.col("r")))
    equal = inside.groupBy("s", "key", "doc_id", "size", "before", "left").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("s").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn("got", F.col("left") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(ahead), F.lit(0)))
    equal = equal.filter((F.col("got") > 0) & (F.col("got") <= F.col("size") * F.col("n")))
    cut = equal.select(F.col("s").alias("c"), F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), F.col("got").alias("cut_got"), F.col("n").alias("cut_n"))
    return checkpoint(t.join(cut, F.col("s").eqNullSafe(F.col("c")), "left").drop("c", "budget", "left"))


def _decide(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows with doc_id, source, size and key → also source_size, target, epochs, part (words of the last epoch)."""
    me, there = [F.struct(*cols) for cols in (("key", "doc_id", "size"), (F.col("cut_key").alias("key"), F.col("cut_id").alias("doc_id"), F.col("cut_size").alias("size")))]
    at_cut = F.col("cut_key").isNotNull() & (me <= there) & ~(me < there)
    d = rows.join(small(cut), F.col("source").eqNullSafe(F.col("s"))).withColumn("at_cut", at_cut)
    away = F.when(F.col("cut_key").isNotNull() & (me < there), F.col("size")).otherwise(F.lit(0))
    if cut.filter("cut_n > 1").isEmpty():
        return d.withColumn("part", F.when(F.col("at_cut"), F.col("cut_got")).otherwise(away).cast("long"))
    return d.filter(~F.col("at_cut")).withColumn("part", away.cast("long")).unionByName(_in_turn(d.filter("at_cut")))


def _in_turn(equal: DataFrame) -> DataFrame:
    """The equal rows at the sources' cuts → also part: each source's first rows are taken whole, one as far as cut_got goes.

    Rows are numbered by their place in a checkpoint: within each of its partitions, after prefix sums over these.
    """
    d = checkpoint(equal).withColumn("place", F.monotonically_increasing_id())
    d = d.withColumn("block", F.shiftright("place", 33))
    ahead = Window.partitionBy("b_s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.groupBy(F.col("s").alias("b_s"), F.col("block").alias("b")).agg(F.count("*").alias("n"))
    blocks = checkpoint(blocks.select("b_s", "b", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")))
    d = d.withColumn("turn", F.row_number().over(Window.partitionBy("s", "block").orderBy("place")) - 1)
    d = d.join(small(blocks), F.col("s").eqNullSafe(F.col("b_s")) & (F.col("block") == F.col("b")))
    part = F.col("cut_got") - (F.col("turn") + F.col("ahead")) * F.col("size")
    d = d.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), part)).cast("long"))
    return d.drop("place", "block", "b_s", "b", "ahead", "turn")


def mix_records(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    rows = checkpoint(docs.select("doc_id", "source", n_words().alias("size"), random_key().alias("key")))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")
    return _decide(rows, cuts(rows, weights, max_epochs)).select("doc_id", "size", "source_size", "target", taken)


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: documents as often as they are taken, the one at a cut as its first words, same columns."""
    names = docs.columns
    rows = checkpoint(docs.select("doc_id", "source", n_words().alias("size"), random_key().alias("key")))
    held = docs.select("doc_id", "source", n_words().alias("size"), random_key().alias("key"), F.struct(*names).alias("_doc"))
    d = _decide(held, cuts(rows, weights, max_epochs)).select("_doc", "size", "epochs", "part")
    rest = F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_take", F.explode(F.concat(F.array_repeat(F.col("size"), F.when(F.col("size") > 0, F.col("epochs")).otherwise(0).cast("int")), rest)))
    text = F.col("_doc.text")
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("_take").cast("int")), " ")
    text = F.when(F.col("_take") < F.col("size"), head).otherwise(text).alias("text")
    out = {"text": text}
    if "n_chars" in names:
        out["n_chars"] = F.length(text).cast("long")
    return d.select(*[out.get(c, F.col("_doc")[c]).alias(c) for c in names])


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_records(documents(spark, sf_dir))


ORACLE = r"""
with d as (select doc_id, source, md5(coalesce(cast(doc_id as varchar), 'null')) as key,
  cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, 3 * source_size as cap, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as w from s0),
s2 as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest_w from s1),
s3 as (select *, cap * rest_w <= rest * w as is_full from s2),
f as (select rest, rest_w from s3 where not is_full order by cap / w, source nulls last limit 1),
s4 as (select source, source_size, case when is_full then cast(cap as double) else cast(f.rest as double) * w / f.rest_w end as target from s3 left join f on true),
s5 as (select *, cast(round(target) as bigint) as budget, case when source_size > 0 then cast(round(target) as bigint) // source_size else 0 end as epochs from s4),
p as (select d.*, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from d)
select p.doc_id, p.size, s5.source_size, s5.target,
  cast(epochs * size + greatest(0, least(size, budget - epochs * s5.source_size - before)) as bigint) as taken
from p join s5 on p.source is not distinct from s5.source
"""

QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLE_SQL = {"op4_mix_sources": ORACLE}
