"""Line dedup: later copies of repeated line runs, by a suffix array over line ids; DataFrame functions only.

Every document is its sequence of lines with at least one word; a line's id is a 128-bit digest of its text. All
suffixes of all sequences are ordered by distributed prefix doubling: after round k a suffix's rank (64 bits of the id
of its first line, offset) orders it by its first 2**k lines, and equal ranks form one interval of the suffix array whose
longest common prefix is at least 2**k lines. Only suffixes that share their rank go on to the next round, so unique
text leaves at once; rounds end when none is left, however long the longest repeated run is. Offsets within an interval
come from two-level prefix sums over distinct followers, ranged by a hash of the follower's whole rank, so neither a
line nor a follower that a third of all rows hold needs a task of its own.

The intervals then give, for every suffix, the longest run at its beginning that also begins earlier elsewhere: from
the top round down, a suffix's run of n lines is extended by the 2**k lines behind it; the suffixes with equal run and
equal rank behind it form an interval of common prefix n + 2**k, and all of it but its first place take the longer run.
The first place of every interval found stays as its witness, as it has no earlier copy itself. Of these runs the
maximal ones (not inside the run of the line before) with at least ``min_words`` words are later copies; their lines are
deleted, with the blank lines between two deleted ones (so of a line repeated over and over in one text its first
place is left). The first occurrence in (doc_id, text digest, line) order stays.

Only digests, ranks and word counts are shuffled. Texts move once, when they are rewritten. What the rounds hand on is
written as tables in the shared folder: unlike a checkpoint, a table read again carries no constraints of the plans
before it, which would grow from round to round on the driver.

Defined cases: null text counts as empty; lines without words are no part of a run and stay; rows with equal
(doc_id, text) are one document and get one outcome; null ids order last; empty tables give empty results; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import WORD, checkpoint, documents, free, stored

#: Words that a repeated run must have.
MIN_WORDS = 10
_DOC = ["doc_id", "th"]


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, th (text digest), line (place among all lines), pos (place among worded lines), h and h2 (line id),
    words, before (words of the lines before).

    One row per place: rows that repeat a document, if any, are first reduced to one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    again = checkpoint(named.groupBy(*_DOC).agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("d"), F.col("th").alias("t")))
    if again.head(1):
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
        repeated = named.join(again, same, "left_semi").groupBy(*_DOC).agg(F.min("text").alias("text"))
        named = named.join(again, same, "left_anti").unionByName(repeated)
    lines = F.split("text", "\n", -1)
    counted = F.transform(lines, lambda s, i: F.struct(i.alias("line"), F.xxhash64(s).alias("h"), F.xxhash64(F.lit(1), s).alias("h2"), F.regexp_count(s, F.lit(WORD)).alias("words")))
    worded = F.filter(counted, lambda s: s["words"] > 0)
    rows = named.select(*_DOC, F.posexplode(worded).alias("pos", "s")).select(*_DOC, "pos", "s.line", "s.h", "s.h2", "s.words")
    upto = Window.partitionBy(*_DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)).cast("long"))


def _rank_pairs(pairs: DataFrame) -> DataFrame:
    """(h, off, nh, noff, n) distinct pairs → also less: suffixes of the interval (h, off) with a smaller follower.

    Followers are ordered by a hash of their rank, then the rank: one order for all, and even ranges.
    """
    pairs = pairs.withColumn("x", F.xxhash64("nh", "noff")).withColumn("part", F.shiftright("x", 56))
    parts = pairs.groupBy("h", "off", "part").agg(F.sum("n").alias("pn"))
    ahead = Window.partitionBy("h", "off").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows at most
    parts = stored(parts.select("h", "off", "part", F.coalesce(F.sum("pn").over(ahead), F.lit(0)).alias("base")))
    inside = Window.partitionBy("h", "off", "part").orderBy("x", "nh", "noff").rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return pairs.join(parts, ["h", "off", "part"]).select("h", "off", "nh", "noff", "n", (F.col("base") + F.col("inner")).alias("less"))


def suffix_levels(lines: DataFrame) -> list[DataFrame]:
    """Prefix doubling. Level k has doc_id, th, pos, h, off of every suffix that shares its first 2**k lines.

    (h, off) is the rank: h, half of the first line's id, orders intervals of depth 1, off is the place of the
    2**k-line interval inside. A suffix absent from level k stands alone in the suffix array at that depth.
    """
    often = lines.groupBy("h", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    ahead = Window.partitionBy("h").orderBy("h2").rowsBetween(Window.unboundedPreceding, -1)  # one row, or two halves that clash
    often = stored(often.select("h", "h2", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("off")))
    level = stored(lines.join(often, ["h", "h2"]).select(*_DOC, "pos", "h", "off"))
    levels = []
    while level.head(1):
        levels.append(level)
        ahead = 1 << len(levels) - 1
        next_at = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(ahead, ahead)
        now = stored(level.withColumns({"nh": F.first("h").over(next_at), "noff": F.first("off").over(next_at)}).filter("noff is not null"))
        pairs = stored(now.groupBy("h", "off", "nh", "noff").agg(F.count("*").alias("n")))
        ranked = _rank_pairs(pairs).filter("n > 1")
        ranked = stored(ranked.select("h", "off", "nh", "noff", (F.col("off") + F.col("less")).alias("to")))
        level = stored(now.join(ranked, ["h", "off", "nh", "noff"]).select(*_DOC, "pos", "h", F.col("to").alias("off")))
    return levels


def earlier_runs(levels: list[DataFrame]) -> DataFrame | None:
    """doc_id, th, pos, n: of each suffix the longest run of n > 0 lines that begins earlier elsewhere as well.

    While it grows a run is named by two 64-bit hashes (a, b) of the ranks it is made of; ``first`` marks witnesses.
    """
    runs = None
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th", "pos")
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        zero = F.lit(0).cast("long")
        grown = level.select(*_DOC, "pos", zero.alias("n"), zero.alias("a"), zero.alias("b"), F.lit(False).alias("first"), "h", "off")
        if runs is not None:
            at = level.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("pos").alias("p"), "h", "off")
            own = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
            begun = runs.filter("not first").select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("pos").alias("p"))
            fresh = grown.join(begun, own & (F.col("pos") == F.col("p")), "left_anti")
            longer = runs.join(at, own & (F.col("pos") + F.col("n") == F.col("p"))).drop("d", "t", "p")
            grown = fresh.unionByName(longer)
        grown = stored(grown.withColumns({"a": F.xxhash64("n", "a", "b", "h", "off"), "b": F.xxhash64(F.lit(k), "b", "a", "off", "h"), "n": F.col("n") + (1 << k)}).drop("h", "off"))
        lead = grown.groupBy("n", "a", "b").agg(F.min(place).alias("least"), F.count("*").alias("size")).filter("size > 1")
        lead = stored(lead.select("n", "a", "b", "least"))
        taken = stored(grown.filter("not first").join(lead, ["n", "a", "b"]).filter(place > F.col("least")).select(*_DOC, "pos", "n", "a", "b"))
        witnesses = lead.select("least.doc_id", "least.th", "least.pos", "n", "a", "b", F.lit(True).alias("first"))
        grew = taken.withColumn("first", F.lit(False))
        if runs is None:
            runs = grew.unionByName(witnesses)
        else:
            done = taken.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("pos").alias("p"))
            stay = runs.filter("not first").join(done, own & (F.col("pos") == F.col("p")), "left_anti")
            runs = stay.unionByName(runs.filter("first")).unionByName(grew).unionByName(witnesses)
        runs = stored(runs)
    return runs if runs is None else runs.filter("not first").select(*_DOC, "pos", "n")


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, first_line, last_line: the stretches of lines that are later copies, merged where worded lines touch."""
    lines = stored(line_rows(docs))
    runs = earlier_runs(suffix_levels(lines))
    if runs is None:
        return lines.filter("false").select(*_DOC, F.col("line").alias("first_line"), F.col("line").alias("last_line"))
    doc = Window.partitionBy(*_DOC).orderBy("pos")
    runs = runs.withColumn("over", F.lag(F.col("pos") + F.col("n")).over(doc)).withColumn("last", F.lag("pos").over(doc))
    maximal = stored(runs.filter("last is null or last < pos - 1 or over < pos + n").select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "pos", "n"))
    ends = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
    at = lines.select(*_DOC, F.col("pos").alias("p"), "line", "words", "before")
    first = maximal.join(at, ends & (F.col("pos") == F.col("p"))).select("d", "t", "pos", "n", F.col("line").alias("first_line"), F.col("before").alias("start"))
    both = first.join(at, ends & (F.col("pos") + F.col("n") - 1 == F.col("p"))).filter(F.col("before") + F.col("words") - F.col("start") >= min_words)
    later = both.select(*_DOC, "pos", "n", "first_line", F.col("line").alias("last_line"))

    doc = Window.partitionBy(*_DOC).orderBy("pos", "n")
    upto = F.max(F.col("pos") + F.col("n")).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col("pos") > upto, F.lit(True)), F.lit(1)).otherwise(F.lit(0))
    merged = later.withColumn("new", new).withColumn("run", F.sum("new").over(doc))
    return merged.groupBy(*_DOC, "run").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line")).drop("run")


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS, count: str | None = "n_deleted") -> DataFrame:
    """docs with later copies deleted from text (and n_chars to match, where it is a column), plus the lines deleted.

    The count's column gets a longer name where docs has one of that name; count=None leaves it out.
    """
    i, h, c, gone, held = free(docs, "cut_id", "cut_th", "cuts", "gone", "held_lines")
    cuts = later_runs(docs, min_words).groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("first_line", "last_line"))).alias(c))
    cuts = checkpoint(cuts.withColumnsRenamed({"doc_id": i, "th": h}))
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.join(cuts.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(i)) & (th == F.col(h)), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda s, at: ~F.exists(c, lambda r: at.between(r["first_line"], r["last_line"])))
    text = F.when(F.col(c).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    deleted = F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, r: a + r["last_line"] - r["first_line"] + 1), F.lit(0).cast("long"))
    rows = rows.select(*docs.columns, text.alias(held), deleted.alias(gone))
    out = {"text": F.col(held).alias("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(held).cast("long").alias("n_chars")
    return rows.select(*[out.get(x, F.col(x)) for x in docs.columns], *([F.col(gone).alias(free(docs, count)[0])] if count else []))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    d = cleaned(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "n_deleted", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("clean_sha256"))


ORACLE = r"""
with d as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as all_lines from documents),
l0 as (select doc_id, unnest(all_lines) as s, unnest(range(len(all_lines))) as line from d),
l1 as (select *, len(regexp_extract_all(s, '[^ 	-
]+')) as words from l0),
l as (select *, row_number() over (partition by doc_id order by line) - 1 as pos from l1 where words > 0),
p as (select *, sum(words) over (partition by doc_id order by pos) as upto, sum(words) over (partition by doc_id) as total from l),
w as (select *, upto - words as before from p),
r as (select *, count(*) over (partition by doc_id order by before range between current row and 9 following) as ahead,
  count(*) over (partition by doc_id order by upto range between 9 preceding and current row) as back from w),
runs as (select doc_id, pos as start, ahead as n from r where total - before >= 10
  union select doc_id, pos - back + 1, back from r where upto >= 10),
k as (select runs.doc_id, start, n, min(line) as first_line, max(line) as last_line, string_agg(s, chr(10) order by pos) as run
  from runs join l on l.doc_id = runs.doc_id and l.pos between start and start + n - 1 group by all),
f as (select *, row_number() over (partition by run order by doc_id, start) as nr from k),
cut as (select distinct l.doc_id, l.line from f join l on l.doc_id = f.doc_id and l.line between first_line and last_line where nr > 1),
flag as (select l1.doc_id, l1.line, case when words > 0 then (cut.line is not null)::int end as g from l1 left join cut on l1.doc_id = cut.doc_id and l1.line = cut.line),
gone as (select doc_id, line from flag qualify coalesce(g, least(last_value(g ignore nulls) over (partition by doc_id order by line rows between unbounded preceding and current row),
  first_value(g ignore nulls) over (partition by doc_id order by line rows between current row and unbounded following))) = 1
  and (g is not null or (last_value(g ignore nulls) over (partition by doc_id order by line rows between unbounded preceding and current row) is not null
  and first_value(g ignore nulls) over (partition by doc_id order by line rows between current row and unbounded following) is not null))),
c as (select l0.doc_id, count(gone.line) as n_deleted, coalesce(string_agg(case when gone.line is null then l0.s end, chr(10) order by l0.line), '') as t
  from l0 left join gone on l0.doc_id = gone.doc_id and l0.line = gone.line group by l0.doc_id)
select doc_id, n_deleted, sha256(t) as clean_sha256 from c
"""

QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE_SQL = {"op10_line_dedup": ORACLE}
