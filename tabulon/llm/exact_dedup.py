"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

Rows go through three steps. (1) A map-only pass leaves 16 bytes of MD5 and the SHA-256 per document; these are
grouped with map-side combining, so a text that a third of all rows share sends one row per task. (2) Texts whose
hash occurs more than once meet byte for byte: they are grouped by (hash, text), again combined on the map side.
A hash with two different texts is a collision, and its rows are grouped by their bytes instead. (3) Each row is
joined to its group's small record; the planner can split a hot hash there because both sides are plain exchanges.

Defined cases: null text counts as empty; ids may be null (they lose against any id) or repeated (of equal rows
exactly one is kept); an empty table gives an empty result; other columns are ignored by the digest form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import checkpoint, documents, free, small, text_digest

#: Hashes of 16 bytes that may be broadcast to find the texts to compare.
BROADCAST_HASHES = 1_000_000


def group_records(docs: DataFrame, hash_of: Column | None = None, smallest: bool = True) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest doc_id stays, or the largest with smallest=False. hash_of replaces the hash in tests.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.select("doc_id", text.alias("text"), (text_digest() if hash_of is None else hash_of).alias("h"))
    rows = checkpoint(hashed.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "h", F.sha2("text", 256).alias("text_sha256")))
    order = (F.bitwise_not("doc_id") if smallest else F.col("doc_id")).alias("o")
    best = F.max(F.struct(order, "uid")).alias("best")
    groups = checkpoint(rows.groupBy("h").agg(best, F.count("*").alias("group_size")))

    repeated = small(groups.filter("group_size > 1").select("h"), BROADCAST_HASHES)
    compared = hashed.select("h", "text").join(repeated, "h", "left_semi").groupBy("h", "text").agg(F.count("*").alias("n"))
    clashes = checkpoint(compared.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1").select("h"))

    clash = bool(clashes.head(1))
    if clash:
        groups = checkpoint(groups.join(clashes, "h", "left_anti"))
    records = _decided(rows.join(groups, "h", "left" if not clash else "inner"), smallest)
    if clash:
        mixed = checkpoint(hashed.join(clashes, "h", "left_semi").withColumns({"uid": F.monotonically_increasing_id(), "text_sha256": F.sha2("text", 256)}))
        classes = checkpoint(mixed.groupBy("h", "text").agg(best, F.count("*").alias("group_size")))
        records = records.unionByName(_decided(mixed.join(classes, ["h", "text"]), smallest))
    return records


def _decided(rows: DataFrame, smallest: bool) -> DataFrame:
    keep = F.col("best.o")
    return rows.select("doc_id", (F.bitwise_not(keep) if smallest else keep).alias("keep_id"), "group_size", (F.col("best.uid") == F.col("uid")).alias("kept"), "text_sha256")


def dedup_documents(docs: DataFrame, smallest: bool = True) -> DataFrame:
    """The documents that stay, with all their columns and texts. Of wholly equal (doc_id, text) rows one stays."""
    own, i, s = free(docs, "own_sha", "kept_id", "kept_sha")
    kept = group_records(docs, smallest=smallest).filter("kept").select(F.col("doc_id").alias(i), F.col("text_sha256").alias(s))
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    rows = docs.withColumn(own, sha).join(kept, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(s)), "left_semi")
    return rows.dropDuplicates(["doc_id", own]).drop(own)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return group_records(documents(spark, sf_dir), smallest=False)


ORACLE = """
with t as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.text) as text_sha256
from t join g on t.text = g.text
"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE_SQL = {"op5_exact_dedup": ORACLE}
