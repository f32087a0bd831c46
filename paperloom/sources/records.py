"""The record store: schema, a deterministic corpus in it, readers and sinks."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_identifier

TEXTS = "document_type citizen_name certificate_number aadhaar_number dob district issue_date upload_date ocr_text file_path extra_fields verification_status verified_by verified_at field_corrections verification_flags consistency_results".split()
RECORD = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.StringType()) for c in TEXTS], T.StructField("quality_score", T.DoubleType()), T.StructField("quality_report", T.StringType())])
DEFAULTS = {"extra_fields": "{}", "verification_status": "needs_review", "field_corrections": "{}", "verification_flags": "[]", "consistency_results": "{}", "quality_report": "{}"}

#: A corpus of records, one per order, in SQL that Spark and DuckDB read alike. {orders}, {customer} and {nation} are the tables.
CORPUS_SQL = """
with base as (
 select o.o_orderkey as id, cast(o.o_orderkey % 5 as int) as k,
  split_part('Ramesh|Kavitha|Boopathy|Gopal|Ananya|Senthil|Priya|Meena|Suresh|Deepa|Rajesh|Anand|Vignesh|Lakshmi|Kumar|Divya','|',cast(c.c_custkey % 16 as int)+1)
   || ' ' || split_part('A|B|G|K|M|N|R|S|T|V','|',cast(floor(c.c_custkey/16) as int) % 10 + 1) as nm,
  split_part('Senthil|Gopal|Rajesh|Mohan|Selvam','|',cast(c.c_custkey % 5 as int)+1) as fat,
  split_part('Tiruppur|Salem|Coimbatore|Chennai|Erode|Madurai|Tiruchirappalli|Dindigul|Namakkal|Karur|Dharmapuri|Krishnagiri|Thanjavur|Tiruvarur|Nagapattinam|Vellore|Ranipet|Tiruvannamalai|Viluppuram|Cuddalore|Tirunelveli|Tenkasi|Thoothukudi|Kanyakumari|Theni','|',n.n_nationkey+1) as dist,
  split_part('avinashi|salem|pollachi|guindy|bhavani|melur|musiri|palani|Rasipuram|karur|hosur|nowhere','|',cast(o.o_orderkey % 12 as int)+1) as taluk,
  'TN-' || cast(4202000000000 + (o.o_orderkey - case when o.o_orderkey % 10 = 0 then 5 else 0 end) * 7919 as varchar(20)) as cert,
  cast(year(o.o_orderdate) as varchar(4)) as yy, lpad(cast(month(o.o_orderdate) as varchar(2)),2,'0') as mm, lpad(cast(day(o.o_orderdate) as varchar(2)),2,'0') as dd,
  cast(floor(o.o_totalprice) as bigint) as inc, o.o_orderkey % 13 as q13
 from {orders} o join {customer} c on o.o_custkey=c.c_custkey join {nation} n on c.c_nationkey=n.n_nationkey),
made as (
 select id, k, nm, fat, taluk, inc, q13, yy, mm, dd,
  case when id % 17 = 0 then substr(cert, 1, 9) || '?' || substr(cert, 11) when id % 31 = 0 then 'TN' || substr(cert, 4) else cert end as cert,
  case when q13 = 0 then '' when id % 23 = 0 then substr(dist, 1, length(dist) - 2) || 'ux' else dist end as dist,
  case when k = 3 or id % 7 = 0 then cast(2000 + id % 7000 as varchar(4)) || ' ' || lpad(cast(id * 37 % 10000 as varchar(4)),4,'0') || ' ' || lpad(cast(id * 91 % 10000 as varchar(4)),4,'0') end as aadhaar,
  lpad(cast(1 + id % 31 as varchar(2)),2,'0') || '-' || lpad(cast(1 + id % 12 as varchar(2)),2,'0') || '-' || cast(case when id % 19 = 0 then 2001 else 1950 + id % 40 end as varchar(4)) as dob
 from base)
select id,
 case k when 0 then 'Income Certificate' when 1 then 'Birth Certificate' when 2 then 'Community Certificate' when 3 then 'Aadhaar Card' else 'Student Permission Form' end as document_type,
 case when id % 29 = 0 then null when id % 37 = 0 then nm || ' 9' when id % 41 = 0 then 'Thiru ' || nm else nm end as citizen_name,
 case when k in (0, 1, 2) then cert end as certificate_number, aadhaar as aadhaar_number,
 case when k in (1, 3) or id % 3 = 0 then dob end as dob, dist as district, dd || '-' || mm || '-' || yy as issue_date,
 yy || '-' || mm || '-' || dd || 'T00:00:00+00:00' as upload_date,
 case k
  when 0 then 'REVENUE DEPARTMENT' || chr(10) || 'INCOME CERTIFICATE' || chr(10) || 'Certificate No: ' || cert || chr(10) || 'This is to certify that Thiru ' || nm || ' son of Thiru ' || fat || ' residing at Door No. 2' || chr(10) || 'annual income is Rs. ' || cast(inc as varchar(20))
  when 1 then 'CERTIFICATE OF BIRTH' || chr(10) || 'Certificate Number: ' || cert || chr(10) || 'Child Name: ' || nm || chr(10) || 'Date of Birth: ' || dob
  when 2 then 'COMMUNITY CERTIFICATE' || chr(10) || 'Certificate No: ' || cert || chr(10) || 'This is to certify that Selvan ' || nm || ' son of Thiru ' || fat || ' residing at Door No. 2'
  when 3 then 'Unique Identification Authority of India' || chr(10) || nm || chr(10) || aadhaar
  else 'STUDENT   PERMISSION FORM' || chr(10) || chr(10) || '  Name: ' || nm || case when id % 2 = 0 then chr(10) || 'PAN: ABCDE' || lpad(cast(id % 10000 as varchar(4)),4,'0') || 'F' else chr(10) || 'DL No: TN38 2011' || lpad(cast(id % 10000000 as varchar(7)),7,'0') end end
  || chr(10) || case when q13=0 then '' else 'District: ' || dist || chr(10) end || case when id % 11 = 0 then taluk || ' Taluk' || chr(10) else '' end || 'Date: ' || dd || '/' || mm || '/' || yy as ocr_text,
 '/store/doc' || cast(id as varchar(20)) || case when id % 6 = 0 then '.PDF' when id % 6 = 1 then '.jpeg' when id % 6 = 2 then '.txt' else '.png' end as file_path,
 '{{"Taluk": "' || taluk || '", "Father / Guardian": "' || fat || case when id % 15 = 0 then ' ' || nm else '' end || '", "Annual Income": "Rs. ' || cast(inc as varchar(20)) || '"'
  || case k when 1 then ', "Father''s Name": "' || case when id % 15 = 0 then nm else fat end || '"' when 2 then ', "Community": "Backward Class' || case when id % 26 = 0 then ' ?' else '' end || '"' when 3 then ', "Gender": "' || case when id % 2 = 0 then 'Male' else 'Female' end || '"'
    when 4 then case when id % 2 = 0 then ', "PAN Number": "ABCDE' || lpad(cast(id % 10000 as varchar(4)),4,'0') || case when id % 22 = 0 then '9' else 'F' end || '"' else ', "Driving Licence Number": "TN38' || case when id % 21 = 0 then '' else ' 2011' || lpad(cast(id % 10000000 as varchar(7)),7,'0') end || '"' end else '' end
  || case when id % 58 = 0 then ', "Applicant Name": "' || nm || '"' else '' end || '}}' as extra_fields,
 case cast(id % 4 as int) when 0 then 'auto_verified' when 1 then 'needs_review' when 2 then 'manually_verified' else 'reviewed' end as verification_status,
 taluk, case when id % 15 = 0 then nm else fat end as father, 'Rs. ' || cast(inc as varchar(20)) as annual_income,
 case when id % 10 = 9 then null else cast(id % 160 as double) end as blur, case when id % 9 = 8 then null else cast(id % 240 as double) end as brightness,
 case when id % 8 = 7 then null else cast(id % 90 as double) / 10 - 4 end as skew, case when id % 7 = 6 then null when id % 7 = 5 then cast(id % 100 as double) else cast(id % 101 as double) / 100 end as ocr_confidence
from made
"""


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt out evenly (or by columns) to a few tasks a core. A file is read by one task for each row group at most, and those are few for what costs much a row."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def corpus(spark: SparkSession, sf_dir: str, evenly: bool | str = False) -> DataFrame:
    """One record per order, with the measurements that come with a scan. `evenly`: records are made by many tasks (`spread`), however few read the orders; with a column, orders are dealt out by it, once if they are joined by it."""
    names = {}
    for t in ("orders", "customer", "nation"):
        rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        (spread(rows, *([evenly] if isinstance(evenly, str) else [])) if evenly and t == "orders" else rows).createOrReplaceTempView(f"paperloom_{t}")
        names[t] = f"paperloom_{t}"
    return spark.sql(CORPUS_SQL.format(**names))


def duplicate_log(records: DataFrame) -> DataFrame:
    """Blocked uploads: one for each tenth record."""
    return records.filter("id % 10 = 0").select("id", F.concat(F.lit("upload_"), F.col("id").cast("string"), F.lit(".png")).alias("filename"), F.lit("A record with the same certificate number already exists.").alias("reason"), F.concat(F.substr("upload_date", F.lit(1), F.lit(10)), F.lit(" 00:00:00")).alias("detected_at"))


def conform(df: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """The schema's columns in order: missing ones with their defaults, others cast, extra ones dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


#: What repeats are found by. They are stored with the records, so that a search for repeats reads no texts.
KEYS = T.StructType([T.StructField("text_sha256", T.StringType()), T.StructField("certificate_key", T.StringType())])
APPENDED = "epoch=-1"  # the folder of what isn't a stream's; a file beside such folders wouldn't be read


def keyed(df: DataFrame) -> DataFrame:
    """Records with their `KEYS`: the digest of the text, and the certificate number without signs (null: none)."""
    return df.withColumns({"text_sha256": F.sha2(F.coalesce("ocr_text", F.lit("")).cast("binary"), 256), "certificate_key": F.nullif(normalize_identifier(F.col("certificate_number")), F.lit(""))})


def keys(spark: SparkSession, path: str, but: int | None = None) -> DataFrame:
    """The `KEYS` of all records of a store, except those of one epoch. Texts are read only from files that were written without keys."""
    files = spark.read.schema(T.StructType([*RECORD.fields, *KEYS.fields, T.StructField("epoch", T.IntegerType())])).parquet(path)
    if but is not None:
        files = files.filter(~F.col("epoch").eqNullSafe(but))
    return files.filter("text_sha256 IS NOT NULL").select(*KEYS.names).union(keyed(files.filter("text_sha256 IS NULL")).select(*KEYS.names))


def read(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path))


def append(records: DataFrame, path: str) -> None:
    keyed(conform(records)).write.mode("append").parquet(f"{path}/{APPENDED}")


def reset(spark: SparkSession, *paths: str) -> int:
    """Delete all files in folders (the store, its log, the uploads) and keep the folders; the number of files. Ids begin anew."""
    hadoop, deleted = spark._jvm.org.apache.hadoop.fs, 0
    for path in map(hadoop.Path, paths):
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            continue
        deleted += fs.getContentSummary(path).getFileCount()
        for item in fs.listStatus(path):
            fs.delete(item.getPath(), True)
    return deleted


def uploads(spark: SparkSession, folder: str, limit: int = 16 * 1024 * 1024) -> DataFrame:
    """Files that may be ingested: images and PDFs up to a size, with their digests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(F.lower("path").rlike(r"\.(png|jpg|jpeg|pdf)$") & (F.col("length") <= limit)).select("path", "length", F.sha2("content", 256).alias("sha256"))


def with_new_ids(new: DataFrame, store: DataFrame, ranges: int = 4096) -> DataFrame:
    """New records get the ids after the store's largest, in order of their own key `id`.

    Records are numbered within ranges of their key that hold about equally
    many of them, however their keys cluster; a range begins after the records
    of those before it. No task sees more than a range.
    """
    from pyspark.sql import Window

    last = store.agg(F.max("id").alias("last")).first()["last"] or 0
    cuts = new.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or [0]))
    # a key's range is found in two steps: its block of cuts, then its place in the block
    side = math.isqrt(len(cuts)) + 1
    blocks = [cuts[k : k + side] for k in range(0, len(cuts), side)]
    fixed = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    passed = lambda bounds: F.size(F.filter(bounds, lambda c: c <= F.col("id")))
    rows = new.withColumn("_block", passed(fixed([b[0] for b in blocks], "array<bigint>")))
    inner = passed(F.get(fixed(blocks, "array<array<bigint>>"), F.col("_block") - 1))
    rows = rows.withColumn("_range", F.when(F.col("_block") == 0, 0).otherwise((F.col("_block") - 1) * side + inner))
    # one row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("id"))
    return rows.join(F.broadcast(starts), "_range").withColumn("id", last + F.col("_start") + place).select(*new.columns)
