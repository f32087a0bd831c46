"""Pages, text boxes and image measurements."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import some

# Words that certificate pages have.
RICH_WORDS = ("certificate", "certify", "income", "community", "birth", "death", "aadhaar", "unique identification", "pan card", "driving licence", "license", "son of", "daughter of", "wife of", "residing", "resident", "tahsildar", "government", "revenue", "department")


def may_ingest(path: Column, size: Column, limit: int = 16 * 1024 * 1024) -> Column:
    return F.lower(path).rlike(r"\.(png|jpg|jpeg|pdf)$") & (size <= limit)


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def merge(pages: DataFrame) -> DataFrame:
    """Text and confidence of documents from their pages (id, page, embedded, ocr, conf).

    Embedded text of 150 characters or more with two or more words that
    certificates have is taken as it is, at 0.95; other pages take the scan's
    text, with the embedded text behind it unless it is part of it. Pages
    without any text add nothing.
    """
    pages = pages.select("id", "page", some(F.col("embedded")).alias("embedded"), F.nullif("ocr", F.lit("")).alias("ocr"), "conf")
    pages = pages.withColumn("low", F.when(F.length("embedded") >= 150, F.lower("embedded")))
    words = sum((F.contains("low", F.lit(w)).cast("int") for w in RICH_WORDS), F.lit(0))
    pages = pages.withColumn("rich", F.coalesce(words >= 2, F.lit(False)))
    embedded, ocr, rich = F.col("embedded"), F.col("ocr"), F.col("rich")
    both = F.when(embedded.isNull() | F.contains(ocr, embedded), ocr).otherwise(F.concat_ws("\n", ocr, embedded))
    one = pages.select("id", "page", F.when(rich, embedded).otherwise(both).alias("t"), F.when(rich, 0.95).otherwise(F.col("conf")).alias("c"))
    texts = F.transform(F.array_sort(F.filter(F.collect_list(F.struct("page", "t")), lambda x: x["t"].isNotNull())), lambda x: x["t"])
    return one.groupBy("id").agg(F.array_join(texts, "\n\n").alias("text"), F.round(F.coalesce(F.avg("c"), F.lit(0.9)), 6).alias("confidence"), F.count("*").alias("pages"))


def mean_confidence(boxes: DataFrame, least: float = 0.12) -> DataFrame:
    return boxes.filter(F.col("conf") >= least).groupBy("id").agg(F.round(F.avg("conf"), 6).alias("confidence"), F.count("conf").alias("boxes"))


def labels(images: DataFrame) -> DataFrame:
    return images.select(
        "id",
        F.when(F.col("blur") < 80, "blurry").otherwise("sharp").alias("blur_label"),
        F.when(F.col("brightness") < 70, "dark").when(F.col("brightness") > 190, "bright").otherwise("good").alias("brightness_label"),
        F.when(F.abs("skew") > 1.0, "tilted").otherwise("straight").alias("skew_label"),
    )


def scale(longest_side: Column) -> Column:
    """How far a scan is enlarged before recognition: to 1800 pixels, by 2 to 3."""
    return F.greatest(F.lit(2.0), F.least(F.lit(3.0), F.lit(1800.0) / longest_side))


def sample_boxes(lineitem: DataFrame) -> DataFrame:
    """Text boxes from order lines: (id, x, y, height, text)."""
    n = F.col("l_linenumber")
    return lineitem.select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 700).cast("double").alias("x"), (n * 17 + F.col("l_suppkey") % 9).cast("double").alias("y"), (F.col("l_quantity") / 2 + 8).alias("height"), F.concat(F.lit("w"), n.cast("string")).alias("text"))


def arrange(boxes: list[tuple[float, float, float, str]]) -> list[str]:
    """Lines in reading order from boxes (x, y, height, text): each box, from the top, joins the first line whose mean centre is near."""
    rows: list[list[tuple[float, float, float, str]]] = []
    mean_height = sum(b[2] for b in boxes) / len(boxes) if boxes else 0.0
    near = max(14.0, 0.65 * mean_height)
    for box in sorted(boxes, key=lambda b: b[1]):
        for row in rows:
            if abs(box[1] - sum(b[1] for b in row) / len(row)) < near:
                row.append(box)
                break
        else:
            rows.append([box])
    return [" ".join(b[3] for b in sorted(row, key=lambda b: b[0])) for row in rows]


def lines(boxes: DataFrame) -> DataFrame:
    """(id, line, text): the lines of each document, from its own boxes."""
    packed = boxes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("x", "y", "height", "text"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, t) for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, t in enumerate(arrange([(x["x"], x["y"], x["height"], x["text"]) for x in b]))]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["id", "line", "text"])

    return packed.mapInArrow(run, "id long, line long, text string")
