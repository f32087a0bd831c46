"""What the corpus operators share: lineage cuts, word rules and sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, an own one on a local master, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="paperloom-"))
    return _own_dir[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the stage it was in, and
    passes that follow read the table and don't compute it again. Whoever owns
    the shared folder expires its contents; `forget` drops all of this session.
    """
    path = f"{shared_dir(df.sparkSession)}/paperloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Drop every table that `materialize` wrote into the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/paperloom")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def told_apart(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """The rows, and the name of a column that no two of them share: the ids, or if some are null or repeated, a number in a written copy."""
    key = F.col(f"`{id_col}`")
    if docs.groupBy(key.alias("k")).agg(F.count("*").alias("n")).filter("k IS NULL OR n > 1").isEmpty():
        return docs, id_col
    name = "_row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id())), name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() does that for texts of single bytes."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
