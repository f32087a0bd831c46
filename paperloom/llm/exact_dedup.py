"""Exact deduplication in three combining stages, on built-in expressions only.

1. Locally: the partial aggregate of each input partition merges equal texts
   before anything is shuffled.
2. Salted: groups (digest, salt, text) merge what the partitions left; the salt
   comes from the row's id, so that a text which makes up a third of all rows is
   merged by `salts` tasks.
3. Globally: the winners of the salts, at most `salts` rows a text, merge.

The text itself is part of the grouping key of every stage, so two texts merge
only if their whole contents are equal; the digest only says where they meet.
Rows then find their group by digest. Should a digest stand for several texts
(which the combined groups show), its rows find their group by the text too.

Results in special cases: null counts as empty, and empty texts are copies of
each other; the row with the largest id stays; null ids lose against others (a
group of null ids only has keep_id null and keeps nothing); rows with an id that
occurs twice are kept or dropped together; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, told_apart

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t")).select("id", "t", digest(F.col("t")).alias("d"))


def combine(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(d, t, keep_id, n) for each different text t."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    merged = salted.groupBy("d", "salt", "t").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    return merged.groupBy("d", "t").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Rows (id, d, keep_id, group_size), one per document."""
    rows = _rows(docs, id_col, text_col, digest)
    texts = combine(rows, salts)
    by_digest = materialize(texts.groupBy("d").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("texts")))
    one = by_digest.filter("texts = 1").drop("texts")
    found = rows.select("id", "d").join(one, "d").select("id", "d", "keep_id", "group_size")
    several = by_digest.filter("texts > 1").select("d")
    if not several.isEmpty():
        clash = rows.join(several, "d").join(texts.join(several, "d").withColumnRenamed("n", "group_size"), ["d", "t"])
        found = found.unionByName(clash.select("id", "d", "keep_id", "group_size"))
    return found


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (the digest)."""
    found = groups_of(docs, id_col, text_col, salts, digest)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("d").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of each group of equal texts, that of the largest id, all columns as they were.

    Of repeated rows one stays; a null id loses against others, but of a group
    of null ids one row stays.
    """
    rows, row = told_apart(docs, id_col)
    names = [F.col(f"`{c}`") for c in docs.columns]
    if row == id_col:
        kept = exact_dedup(rows, id_col, text_col, salts).filter("kept").select(id_col)
    else:
        ranked = rows.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row")).alias("rank"), F.col(f"`{text_col}`").alias("text"))
        kept = exact_dedup(ranked, "rank", "text", salts).filter("kept").select(F.col("rank.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*names)


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
