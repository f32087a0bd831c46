"""Mixing sources to target weights, on built-in expressions only.

Sources, in code point order (null last), weigh 1, 2, 3, repeating (or as a
weight table says), and share a budget of words. A source's target stops at
`max_epochs` times its size; what it can't take is shared again by weight among
the others. The targets of that process are min(max_epochs * size, level *
weight), and the level follows from running sums over the sources in order of
size for weight, so no loop is needed.

Of a source, floor(target / size) whole epochs come first. The rest is drawn
without replacement after Efraimidis and Spirakis: a document's key is an
exponential variate divided by its quality weight, documents are taken in
ascending order of key, and the prefix whose words come nearest to the rest is
in. A source may hold a third of all rows, so the running sum isn't made by one
window a source: rows are cut into ranges of (source, key) of about CELL_ROWS
rows, the ranges' sums are accumulated, and each range sums up its own rows.

Variates come from md5 of seed and id: reruns agree, whatever the partitioning.

Results in special cases: null texts have size 0; a document of size 0 takes 0
words; a source without words has target 0; an empty table gives no rows; rows
with the same id draw the same variate; null ids draw that of an empty id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, told_apart

MAX_EPOCHS, SEED, CELL_ROWS = 3, "mix-1", 20_000


def quality_weight(text: Column, size: Column) -> Column:
    """1 for prose of six characters a word, less the further its words are from that."""
    return F.when(size == 0, F.lit(1.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.abs(F.length(text).cast("double") / size - 7.0)))


def variate(id_: Column, seed: str) -> Column:
    """Uniform in (0, 1), of 52 bits."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: DataFrame | None = None) -> DataFrame:
    """(source, source_size, target) from (source, source_size). The windows span the sources, not the documents."""
    if weights is None:
        place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        weighed = sizes.withColumn("w", ((place - 1) % 3 + 1).cast("double"))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("w"))
        weighed = sizes.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["w"])
    cap = F.col("source_size") * max_epochs
    weighed = weighed.withColumn("r", F.when(F.col("w") > 0, cap / F.col("w")))
    order = [F.col("r").asc_nulls_last(), F.col("source").asc_nulls_last()]
    upto, rest = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    total, everything = F.sum("source_size").over(Window.partitionBy()), Window.partitionBy()
    level = (total - F.coalesce(F.sum(cap).over(upto), F.lit(0))).cast("double") / F.sum("w").over(rest)
    x = weighed.withColumn("pos", F.row_number().over(Window.orderBy(*order))).withColumn("lv", F.when(F.col("w") > 0, level))
    x = x.withColumn("first", F.min(F.when(F.col("lv") * F.col("w") <= cap, F.col("pos"))).over(everything))
    x = x.withColumn("lam", F.max(F.when(F.col("pos") == F.col("first"), F.col("lv"))).over(everything))
    capped = F.col("first").isNull() | (F.col("pos") < F.col("first"))
    target = F.when(F.col("w") <= 0, F.lit(0.0)).when(capped, cap.cast("double")).otherwise(F.col("lam") * F.col("w"))
    return x.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS, seed: str = SEED, weights: DataFrame | None = None, quality_col: str | None = None, cell_rows: int = CELL_ROWS, row_col: str | None = None) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken; and row_col, where another column tells rows apart."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), text.alias("t"), (F.col(f"`{row_col}`") if row_col else F.lit(None).cast("long")).alias("row"), (F.col(f"`{quality_col}`").cast("double") if quality_col else F.lit(None).cast("double")).alias("q"))
    rows = rows.withColumn("size", n_words(F.col("t")))
    weight = F.coalesce(F.col("q"), quality_weight(F.col("t"), F.col("size")))
    rows = materialize(rows.select("id", "row", "source", "size", (-F.log(variate(F.col("id"), seed)) / F.greatest(weight, F.lit(1e-9))).alias("key")))
    per_source = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    cells = max(1, -(-(per_source.agg(F.sum("docs")).first()[0] or 0) // cell_rows))
    plan = targets(per_source.drop("docs"), max_epochs, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("epochs", epochs).withColumn("over", F.col("target") - F.col("epochs") * F.col("source_size"))
    # ranges of about equal size, whatever the keys' distribution; equal keys are in one
    rows = materialize(rows.repartitionByRange(cells, "source", "key").withColumn("cell", F.spark_partition_id()))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).alias("c")
    cells = cells.join(plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source"))).select("c.source", "c.cell", "c.before", "p.source_size", "p.target", "p.epochs", "p.over").alias("c")
    so_far = Window.partitionBy("source", "cell").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("size").over(so_far)).alias("r")
    x = summed.join(cells, F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.cell") == F.col("c.cell")))
    drawn = F.col("c.before") + F.col("r.upto") - F.col("r.size") / 2.0 <= F.col("c.over")
    taken = F.col("r.size") * F.col("c.epochs") + F.when(drawn, F.col("r.size")).otherwise(F.lit(0))
    return x.select(F.col("r.id").alias(id_col), F.col("r.source").alias("source"), F.col("r.size").alias("size"), F.col("c.source_size").alias("source_size"), F.col("c.target").alias("target"), taken.cast("long").alias("taken"), *([F.col("r.row").alias(row_col)] if row_col and row_col != id_col else []))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row as many times as the mix takes it, all columns as they were. Rows of one id, or of none, are drawn each by itself, with one variate."""
    rows, row = told_apart(docs, id_col)
    taken = mix(rows, id_col=id_col, row_col=row, **options)
    times = taken.filter("taken > 0").select(F.col(row).alias("_id"), (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    d = rows.alias("d").join(times, F.col(f"d.`{row}`") == F.col("_id"))
    return d.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("__time__")).drop("__time__")


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, length(coalesce(text, ''))::DOUBLE AS chars,
    (('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT *, -ln(u) / (CASE WHEN size = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + abs(chars / size - 7.0::DOUBLE)) END) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 3 / w, source ASC NULLS LAST) AS pos,
    (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (ORDER BY source_size * 3 / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
f AS (SELECT *, min(CASE WHEN lv * w <= source_size * 3 THEN pos END) OVER () AS first FROM o),
l AS (SELECT *, max(CASE WHEN pos = first THEN lv END) OVER () AS lam FROM f),
t AS (SELECT source, source_size, CASE WHEN first IS NULL OR pos < first THEN (source_size * 3)::DOUBLE ELSE lam * w END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t)
SELECT k.doc_id, k.size, e.source_size, e.target,
  (k.size * e.epochs + CASE WHEN sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE - k.size / 2.0::DOUBLE
    <= e.target - (e.epochs * e.source_size)::DOUBLE THEN k.size ELSE 0 END)::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""
