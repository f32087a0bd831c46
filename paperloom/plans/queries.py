"""The queries of the record domain, each beside its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extractors
from ..functions import text as tx
from ..functions import vocab
from ..operators import assistant, corrections, dashboard, dedup, pages, rules
from ..sources import records as store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF, NOW = "1998-06-01", "2024-01-01T00:00:00+00:00"
RECORDS = "WITH records AS (" + store.CORPUS_SQL.format(orders="orders", customer="customer", nation="nation") + ")"


def query(sql: str | None = None, name: str | None = None, evenly: bool | str = False):
    """Register a query on the records; its SQL reads the CTE `records`. `evenly`: for what costs much a record."""

    def put(f: Callable[[DataFrame], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(store.corpus(spark, sf_dir, evenly))
        if sql:
            ORACLES[key] = f"{RECORDS}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
        return f

    return put


def on_documents(sql: str | None = None):
    """Register a query on the documents table."""

    def put(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Scans, sources, sinks ------------------------------------------------------------------------------------------------


@query("SELECT id, document_type, citizen_name, certificate_number, aadhaar_number, dob, district, issue_date FROM records")
def scan_identifiers(r):
    return r.select("id", "document_type", "citizen_name", "certificate_number", "aadhaar_number", "dob", "district", "issue_date")


@query("""SELECT id, document_type, citizen_name, json_extract_string(extra_fields, '$.Taluk') AS taluk_name, json_extract_string(extra_fields, '$."Father / Guardian"') AS guardian,
  json_extract_string(extra_fields, '$."Annual Income"') AS income, 0::BIGINT AS corrections FROM records WHERE id = 7""")
def doc_detail(r):
    return dashboard.detail(store.conform(r), 7)


@query(""", n AS (SELECT *, (SELECT max(id) FROM records) + row_number() OVER (ORDER BY id) AS new_id FROM records)
SELECT new_id AS id, document_type, citizen_name, verification_status FROM n""")
def ingest_batch(r):
    return store.with_new_ids(r, r).select("id", "document_type", "citizen_name", "verification_status")


_LOG = ", log AS (SELECT id, 'upload_' || id || '.png' AS filename, 'A record with the same certificate number already exists.' AS reason, substr(upload_date, 1, 10) || ' 00:00:00' AS detected_at FROM records WHERE id % 10 = 0)"


@query(_LOG + " SELECT * FROM log")
def duplicate_log(r):
    return store.duplicate_log(r)


@query("SELECT id, document_type, '{}' AS field_corrections, '[]' AS verification_flags, extra_fields, NULL::DOUBLE AS quality_score, NULL::VARCHAR AS verified_by FROM records")
def conform_schema(r):
    return store.conform(r).select("id", "document_type", "field_corrections", "verification_flags", "extra_fields", "quality_score", "verified_by")


@query("""SELECT id, file_path, (id * 7919) % 20000000 AS n_bytes FROM records WHERE regexp_matches(lower(file_path), '\\.(png|jpg|jpeg|pdf)$') AND (id * 7919) % 20000000 <= 16777216""")
def ingest_gate(r):
    return r.select("id", "file_path", (F.col("id") * 7919 % 20000000).alias("n_bytes")).filter(pages.may_ingest(F.col("file_path"), F.col("n_bytes")))


@query("SELECT id, lower(file_path) LIKE '%.pdf' AS is_pdf FROM records")
def is_pdf(r):
    return r.select("id", pages.is_pdf(F.col("file_path")).alias("is_pdf"))


#: Pages of every kind: rich text, one word of certificates only, short or blank text, text that the scan has, neither.
_PAGES_SQL = """SELECT l_orderkey AS id, l_linenumber AS page,
  CASE cast((l_orderkey + l_linenumber) % 8 as int) WHEN 0 THEN rpad('Revenue certificate of the district ', 200, 'x') WHEN 1 THEN 'page ' || cast(l_linenumber as varchar(9)) WHEN 2 THEN rpad('Certificate of merit ', 200, 'y')
   WHEN 3 THEN '   ' WHEN 4 THEN cast(l_partkey as varchar(20)) WHEN 6 THEN 'Government department' WHEN 7 THEN rpad(' INCOME of the daughter of ', 160, 'z') END AS embedded,
  CASE WHEN (l_orderkey + l_linenumber) % 8 <> 5 AND l_partkey % 9 <> 0 THEN 'scan ' || cast(l_partkey as varchar(20)) END AS ocr, CASE WHEN l_quantity < 10 THEN NULL ELSE l_quantity / 50 END AS conf FROM {lineitem}"""
_PAGES = ", p AS (" + _PAGES_SQL.format(lineitem="lineitem") + ")"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PAGES_SQL, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


QUERIES["page_text_merge"] = lambda spark, sf_dir: pages.merge(_pages(spark, sf_dir))
_RICH = "length(trim(embedded)) >= 150 AND " + " + ".join(f"contains(lower(embedded), {_q(w)})::INT" for w in pages.RICH_WORDS) + " >= 2"
ORACLES["page_text_merge"] = "WITH" + _PAGES[1:] + f""", k AS (SELECT id, page, nullif(trim(embedded), '') AS e, ocr, conf, coalesce({_RICH}, false) AS rich FROM p),
t AS (SELECT id, page, CASE WHEN rich THEN e WHEN e IS NULL OR contains(ocr, e) THEN ocr WHEN ocr IS NULL THEN e ELSE ocr || chr(10) || e END AS txt, CASE WHEN rich THEN 0.95 ELSE conf END AS c FROM k)
SELECT id, coalesce(string_agg(txt, chr(10) || chr(10) ORDER BY page, txt), '') AS text, round(coalesce(avg(c), 0.9), 6) AS confidence, count(*) AS pages FROM t GROUP BY id"""
QUERIES["ocr_conf_mean"] = lambda spark, sf_dir: pages.mean_confidence(_pages(spark, sf_dir))
ORACLES["ocr_conf_mean"] = "WITH" + _PAGES[1:] + " SELECT id, round(avg(conf), 6) AS confidence, count(conf) AS boxes FROM p WHERE conf >= 0.12 GROUP BY id"
QUERIES["box_lines"] = lambda spark, sf_dir: pages.lines(pages.sample_boxes(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


@query("""SELECT id, CASE WHEN blur < 80 THEN 'blurry' ELSE 'sharp' END AS blur_label, CASE WHEN brightness < 70 THEN 'dark' WHEN brightness > 190 THEN 'bright' ELSE 'good' END AS brightness_label,
 CASE WHEN abs(skew) > 1.0 THEN 'tilted' ELSE 'straight' END AS skew_label FROM records WHERE blur IS NOT NULL AND brightness IS NOT NULL AND skew IS NOT NULL""")
def image_labels(r):
    return pages.labels(r.filter("blur IS NOT NULL AND brightness IS NOT NULL AND skew IS NOT NULL"))


@query("SELECT id, greatest(2.0::DOUBLE, least(3.0::DOUBLE, 1800.0::DOUBLE / (200 + id % 2000))) AS scale FROM records")
def enhance_params(r):
    return r.select("id", pages.scale(200 + F.col("id") % 2000).alias("scale"))


# Filters, searches, pages ---------------------------------------------------------------------------------------------


@query("SELECT id, citizen_name, district FROM records WHERE document_type = 'Income Certificate' AND district = 'Salem' AND citizen_name ILIKE '%ra%'")
def filter_documents(r):
    return dashboard.filtered(r, search="ra", kind="Income Certificate", district="Salem", status="All", columns=("citizen_name",)).select("id", "citizen_name", "district")


_SEARCH = "(citizen_name ILIKE '%gopal%' OR certificate_number ILIKE '%gopal%' OR aadhaar_number ILIKE '%gopal%' OR district ILIKE '%gopal%' OR ocr_text ILIKE '%gopal%')"


@query(f"SELECT id, document_type FROM records WHERE {_SEARCH}")
def search_documents(r):
    return dashboard.filtered(r, search="GOPAL").select("id", "document_type")


@query("SELECT id, verification_status FROM records WHERE verification_status IN ('auto_verified', 'manually_verified', 'verified')")
def filter_verified(r):
    return dashboard.filtered(r, status="verified").select("id", "verification_status")


@query("SELECT count(*) AS n FROM records WHERE document_type = 'Birth Certificate' AND verification_status = 'needs_review'")
def filtered_count(r):
    return dashboard.filtered(r, kind="Birth Certificate", status="needs_review").agg(F.count("*").alias("n"))


@query("""SELECT id, coalesce(nullif(citizen_name, ''), json_extract_string(extra_fields, '$."Applicant Name"')) AS shown_name, nullif(district, '') AS shown_place FROM records""")
def doc_listing(r):
    return dashboard.listing(r, ("Citizen Name", "Applicant Name", "Name", "Child Name"), ("District",))


@query("SELECT id, document_type, issue_date FROM records ORDER BY id DESC LIMIT 5")
def recent_documents(r):
    return dashboard.page(r, 5).select("id", "document_type", "issue_date")


@query(_LOG + " SELECT id, filename FROM log ORDER BY id DESC LIMIT 5")
def recent_duplicates(r):
    return dashboard.page(store.duplicate_log(r), 5).select("id", "filename")


@query("SELECT id, citizen_name FROM records ORDER BY id DESC LIMIT 50 OFFSET 100")
def page_documents(r):
    return dashboard.page(r, 50, 100).select("id", "citizen_name")


@query("SELECT DISTINCT district FROM records WHERE district IS NOT NULL AND trim(district) <> ''")
def distinct_districts(r):
    return dashboard.distinct_values(r, "district")


@query("SELECT DISTINCT document_type FROM records WHERE document_type IS NOT NULL AND trim(document_type) <> ''")
def distinct_types(r):
    return dashboard.distinct_values(r, "document_type")


# Aggregates -----------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM records")
def total_documents(r):
    return r.agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM records WHERE id % 10 = 0")
def duplicates_blocked(r):
    return store.duplicate_log(r).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT district) AS n FROM records WHERE trim(district) <> ''")
def district_count(r):
    return r.filter("trim(district) <> ''").agg(F.countDistinct("district").alias("n"))


@query("SELECT count(*) FILTER (verification_status = 'needs_review') AS pending, count(*) FILTER (verification_status IN ('auto_verified', 'manually_verified', 'verified')) AS verified FROM records")
def status_counts(r):
    return dashboard.status_counts(r)


@query("""SELECT count(*) AS total, count(DISTINCT district) FILTER (trim(district) <> '') AS districts, count(*) FILTER (verification_status = 'needs_review') AS pending,
 count(*) FILTER (verification_status IN ('auto_verified', 'manually_verified', 'verified')) AS verified, (SELECT count(*) FROM records WHERE id % 10 = 0) AS blocked, max(id) AS newest FROM records""")
def dashboard_stats(r):
    return dashboard.stats(r, store.duplicate_log(r))


_JSON = "json_extract_string(extra_fields, '$.\"{}\"')"


@query(_LOG + """, t AS (SELECT document_type AS k, count(*) AS n FROM records GROUP BY 1)
SELECT (SELECT count(*) FROM records) AS total, (SELECT string_agg(k || '=' || n, ', ' ORDER BY n DESC, k) FROM t) AS types,
 (SELECT string_agg(id || ' ' || document_type || ' ' || coalesce(district, ''), ', ' ORDER BY id DESC) FROM (SELECT * FROM records ORDER BY id DESC LIMIT 5)) AS documents,
 (SELECT string_agg(filename || ' ' || detected_at, ', ' ORDER BY id DESC) FROM (SELECT * FROM log ORDER BY id DESC LIMIT 5)) AS duplicates""")
def dashboard_overview(r):
    x = dashboard.overview(r, store.duplicate_log(r))
    join = lambda c, f: F.array_join(F.transform(c, f), ", ")
    types = join("type_breakdown", lambda t: F.concat(t["document_type"], F.lit("="), t["n"].cast("string")))
    documents = join("recent_documents", lambda t: F.concat_ws(" ", t["id"].cast("string"), t["document_type"], F.coalesce(t["district"], F.lit(""))))
    return x.select("total", types.alias("types"), documents.alias("documents"), join("recent_duplicates", lambda t: F.concat_ws(" ", t["filename"], t["detected_at"])).alias("duplicates"))


# Classification -------------------------------------------------------------------------------------------------------


def _classify_sql(c: str) -> tuple[str, str]:
    t = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    kind = " ".join(f"WHEN regexp_matches({t}, {_q(p)}, 'i') THEN {_q(k)}" for k, ps in vocab.TYPE_PATTERNS for p in ps)
    used = " ".join(f"WHEN regexp_matches({t}, {_q(p)}, 'i') THEN {_q(p)}" for k, ps in vocab.TYPE_PATTERNS for p in ps)
    blank = f"{c} IS NULL OR {t} = ''"
    return f"CASE WHEN {blank} THEN 'Unknown' {kind} ELSE 'Unknown' END", f"CASE WHEN {blank} THEN NULL {used} END"


@query("SELECT id, {} AS kind, {} AS pattern FROM records".format(*_classify_sql("ocr_text")))
def classify_documents(r):
    kind, pattern = tx.classify(F.col("ocr_text"))
    return r.select("id", kind.alias("kind"), pattern.alias("pattern"))


@on_documents("SELECT doc_id, {} AS kind FROM documents".format(_classify_sql("text")[0]))
def classify_texts(d):
    return d.select("doc_id", tx.classify(F.col("text"))[0].alias("kind"))


@query("SELECT {} AS kind, count(*) AS n FROM records GROUP BY 1".format(_classify_sql("ocr_text")[0]))
def type_breakdown(r):
    return r.select(tx.classify(F.col("ocr_text"))[0].alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


@query("SELECT id, CASE document_type WHEN 'Income Certificate' THEN 'income_certificate' WHEN 'Birth Certificate' THEN 'birth_certificate' WHEN 'Community Certificate' THEN 'community_certificate' WHEN 'Aadhaar Card' THEN 'aadhaar' ELSE 'generic' END AS extractor FROM records")
def extractor_route(r):
    return r.select("id", tx.extractor_of(F.col("document_type")).alias("extractor"))


# Extraction -----------------------------------------------------------------------------------------------------------


@query("SELECT id, array_to_string(list_filter(list_transform(string_split(regexp_replace(ocr_text, '[ \\t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS lines FROM records")
def normalize_text(r):
    return r.select("id", tx.normalize_lines(F.col("ocr_text")).alias("lines"))


_TALUK_SQL = "CASE lower(trim({})) " + " ".join(f"WHEN '{t}' THEN '{d}'" for t, d in vocab.TALUKS.items()) + " END"


@query("SELECT id, coalesce(" + ", ".join(f"CASE WHEN regexp_matches(ocr_text, '\\b{d}\\b', 'i') THEN '{d}' END" for d in vocab.DISTRICTS) + ", " + _TALUK_SQL.format("nullif(regexp_extract(ocr_text, '\\b([A-Za-z]{4,15})\\s+Taluk\\b', 1, 'i'), '')") + ") AS district FROM records")
def extract_district(r):
    return r.select("id", tx.district_in_text(F.col("ocr_text")).alias("district"))


@query(r"""SELECT id, coalesce(regexp_replace(upper(nullif(regexp_extract(ocr_text, '\b(TN-[A-Z0-9\-]{8,24})\b', 1, 'i'), '')), '^-+|-+$', '', 'g'),
 'TN-' || substr(nullif(regexp_extract(ocr_text, '\b(TN[0-9]{10,18})\b', 1, 'i'), ''), 3),
 (SELECT CASE WHEN length(v) >= 6 THEN CASE WHEN upper(v) LIKE 'TN%' AND upper(v) NOT LIKE 'TN-%' THEN 'TN-' || substr(v, 3) ELSE v END END FROM (SELECT nullif(regexp_extract(ocr_text, '(?:Certificate\s*(?:Number|No\.?)|unique\s*certificate\s*number)[^\w\n]*([A-Z0-9\-/]+)', 1, 'i'), '') AS v)),
 (SELECT CASE WHEN length(v) >= 6 THEN v END FROM (SELECT nullif(regexp_extract(ocr_text, '(?:Cert(?:ificate)?|Reg(?:istration)?)\s*(?:No\.?|#)\s*[:\-]?\s*([A-Z0-9\-/]+)', 1, 'i'), '') AS v))) AS certificate FROM records""")
def extract_certificate(r):
    return r.select("id", tx.extract_certificate(F.col("ocr_text")).alias("certificate"))


@query(r"SELECT id, nullif(regexp_extract(ocr_text, '(?:^|[^\d])\b([2-9]\d{3}\s\d{4}\s\d{4})\b', 1), '') AS aadhaar FROM records")
def extract_aadhaar(r):
    return r.select("id", tx.extract_aadhaar(F.col("ocr_text")).alias("aadhaar"))


@query(r"""SELECT id, (SELECT lpad(d, 2, '0') || '-' || lpad(m, 2, '0') || '-' || y FROM (SELECT regexp_extract(ocr_text, p, 1, 'i') AS d, regexp_extract(ocr_text, p, 2, 'i') AS m, regexp_extract(ocr_text, p, 3, 'i') AS y
  FROM (SELECT '(?:Date|நாள்)\s*[:\-]?\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4})' AS p))) AS issue FROM records""")
def extract_date(r):
    return r.select("id", tx.extract_date(F.col("ocr_text")).alias("issue"))


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '^(?:This is to certify that|certify that|Thiru|Tmt|Selvan|Selvi|Mr\.?|Mrs\.?|Ms\.?|Shri|Smt\.?|Dr\.?)\s+', '', 'i'), '\s+(?:son|daughter|wife|s/o|d/o|w/o|residing|rcsiding|at Door|Door|Village|Town|Taluk|District)[^\n]*', '', 'gi'), '[^\p{{L}}\p{{N}}_\s.]', '', 'g'), '\s+', ' ', 'g'))"
_VALID = "CASE WHEN length({0}) BETWEEN 2 AND 60 AND regexp_matches({0}, '[A-Za-z]') AND NOT list_has_any(list_transform(regexp_extract_all({0}, '[A-Za-z]+'), lambda w: lower(w)), [" + ",".join(map(_q, vocab.NOT_NAMES)) + "]) AND length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g')) / length({0}) >= 0.6 THEN {0} END"


@query("SELECT id, " + _CLEAN.format("citizen_name") + " AS name FROM records")
def clean_name(r):
    return r.select("id", tx.clean_name(F.col("citizen_name")).alias("name"))


@query(", c AS (SELECT id, " + _CLEAN.format("citizen_name") + " AS n FROM records) SELECT id, " + _VALID.format("n") + " AS name FROM c")
def validate_name(r):
    return r.select("id", tx.valid_name(F.col("citizen_name")).alias("name"))


@query(r"SELECT id, nullif(regexp_extract(ocr_text, '\b([A-Z]{5}[0-9]{4}[A-Z])\b', 1), '') AS pan FROM records")
def extract_pan(r):
    return r.select("id", tx.extract_pan(F.col("ocr_text")).alias("pan"))


@query(r"SELECT id, upper(trim(regexp_replace(nullif(regexp_extract(ocr_text, '\b([A-Z]{2}[- ]?\d{2}[- ]?\d{4}[- ]?\d{7})\b', 1, 'i'), ''), '\s+', ' ', 'g'))) AS licence FROM records")
def extract_dl(r):
    return r.select("id", tx.extract_licence(F.col("ocr_text")).alias("licence"))


def _extracted(extractor: str):
    """All records' texts through one extractor, as (id, field, value); regular expressions with lookahead aren't DuckDB's."""
    return lambda r: r.select("id", F.explode(extractors.extract(extractor, F.col("ocr_text"))).alias("field", "value"))


for _key, _extractor in (("extract_income", "income_certificate"), ("extract_birth", "birth_certificate"), ("extract_community", "community_certificate"), ("extract_pan_card", "pan_card"), ("extract_dl_card", "driving_licence"), ("extract_aadhaar_card", "aadhaar"), ("extract_generic", "generic")):
    query(None, _key, evenly=True)(_extracted(_extractor))


@query(None)
def fuzzy_district(r):
    return r.select("id", "district", extractors.close_district(F.initcap("district"), 0.7).alias("close"))


# Promotion, status ----------------------------------------------------------------------------------------------------


@query(", c AS (SELECT *, " + _CLEAN.format("citizen_name") + " AS n FROM records), v AS (SELECT *, " + _VALID.format("n") + """ AS g FROM c)
SELECT id, coalesce(g, nullif(trim(citizen_name), '')) AS name, coalesce(nullif(district, ''), """ + _TALUK_SQL.format("taluk") + ") AS place, coalesce(nullif(certificate_number, ''), nullif(aadhaar_number, '')) AS number FROM v")
def promote_fields(r):
    name = F.coalesce(tx.valid_name(F.col("citizen_name")), F.nullif(F.trim("citizen_name"), F.lit("")))
    place = F.coalesce(F.nullif("district", F.lit("")), tx.taluk_district(F.col("taluk")))
    return r.select("id", name.alias("name"), place.alias("place"), F.coalesce(F.nullif("certificate_number", F.lit("")), F.nullif("aadhaar_number", F.lit(""))).alias("number"))


@query("SELECT id, taluk, " + _TALUK_SQL.format("taluk") + " AS taluk_district FROM records")
def taluk_district_join(r):
    return r.select("id", "taluk", tx.taluk_district(F.col("taluk")).alias("taluk_district"))


_RAW = f"coalesce(nullif({_JSON.format('Citizen Name')}, ''), nullif(citizen_name, ''), nullif({_JSON.format('Name')}, ''), nullif({_JSON.format('Applicant Name')}, ''), nullif({_JSON.format('Child Name')}, ''))"


@query(f", f AS (SELECT *, {_RAW} AS raw FROM records), c AS (SELECT *, " + _CLEAN.format("raw") + " AS n FROM f), v AS (SELECT *, " + _VALID.format("n") + f""" AS g FROM c)
SELECT id, coalesce(g, trim(raw)) AS citizen_name, coalesce(nullif(certificate_number, ''), nullif({_JSON.format('Registration Number')}, ''), nullif({_JSON.format('PAN Number')}, ''), nullif({_JSON.format('Driving Licence Number')}, '')) AS certificate_number,
 nullif(aadhaar_number, '') AS aadhaar_number, nullif(dob, '') AS dob, coalesce(nullif(district, ''), """ + _TALUK_SQL.format(_JSON.format("Taluk")) + ") AS district, nullif(issue_date, '') AS issue_date FROM v")
def promote_record(r):
    return dashboard.promoted(r).select("id", *dashboard.PROMOTED)


@query(None)
def verification_flags(r):
    return dashboard.flags(r)


@query(None)
def store_records(r):
    return dashboard.stored(r.drop("verification_status"), AS_OF, NOW)


@query(None)
def reanalyze_corrected(r):
    return dashboard.reanalysed(r, corrections.sample(r), "officer", NOW)


# Verification ---------------------------------------------------------------------------------------------------------


_ODD = "[?~*!|{}\\\\<>^§]"


@on_documents(f"SELECT doc_id, regexp_matches(coalesce(text, ''), {_q(_ODD)}) AS odd FROM documents")
def suspicious_chars(d):
    return d.select("doc_id", F.coalesce("text", F.lit("")).rlike(vocab.SUSPICIOUS).alias("odd"))


def _flat(r: DataFrame, info, *more) -> DataFrame:
    return r.select("id", info.alias("x"), *more).select("id", F.col("x.flagged").alias("flagged"), F.col("x.confidence").alias("confidence"), F.col("x.reasons").alias("reasons"), F.col("x.suggestion").alias("suggestion"))


_REASONS = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), '; ')"
_SHAPES = r"(regexp_matches({0}, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') OR regexp_matches({0}, '^[A-Z]{{2}}[0-9]{{2}}\s?[0-9]{{11}}$'))"
_V_CERT = f"""SELECT id, (v IS NULL OR (NOT known AND (odd <> '' OR bare OR head OR length(v) < 6))) AS flagged,
 (CASE WHEN v IS NULL THEN 0.20 WHEN known THEN 0.98 ELSE least(0.95, CASE WHEN odd <> '' THEN 0.50 END, CASE WHEN bare THEN 0.75 END, CASE WHEN head THEN 0.60 END, CASE WHEN length(v) < 6 THEN 0.55 END) END)::DOUBLE AS confidence,
 CASE WHEN v IS NULL THEN 'Certificate Number was not detected by OCR' WHEN known THEN '' ELSE {_REASONS.format("CASE WHEN odd <> '' THEN 'Uncertain OCR character ''' || odd || ''' detected in identifier' END, CASE WHEN bare THEN 'Missing standard hyphen separator in TN certificate prefix' END, CASE WHEN head THEN 'Header label OCR fragments found attached to number' END, CASE WHEN length(v) < 6 THEN 'Identifier length (' || length(v) || ') is unusually short for a government certificate' END")} END AS reasons,
 CASE WHEN bare AND NOT known THEN 'TN-' || substr(v, 3) END AS suggestion
FROM (SELECT id, v, {_SHAPES.format('v')} AS known, regexp_extract(v, {_q('(' + _ODD + ')')}, 1) AS odd, v LIKE 'TN%' AND v NOT LIKE 'TN-%' AND length(v) > 4 AS bare, regexp_matches(lower(v), 'rmtr|certificateno|date') AS head FROM (SELECT id, nullif(trim(certificate_number), '') AS v FROM records))"""


@query(_V_CERT)
def verify_certificate(r):
    return _flat(r, rules.verify_certificate(F.col("certificate_number")))


@query(r"""SELECT id, (v IS NULL OR length(d) <> 12) AS flagged, (CASE WHEN v IS NULL THEN 0.20 WHEN length(d) <> 12 THEN 0.45 ELSE 0.98 END)::DOUBLE AS confidence,
 CASE WHEN v IS NULL THEN 'Aadhaar number was not detected in document' WHEN length(d) = 16 THEN '16-digit Virtual ID (VID) extracted instead of 12-digit Aadhaar number' WHEN length(d) <> 12 THEN 'Contains ' || length(d) || ' digits instead of expected 12 digits' ELSE '' END AS reasons,
 CASE WHEN length(d) = 12 AND v <> substr(d, 1, 4) || ' ' || substr(d, 5, 4) || ' ' || substr(d, 9) THEN substr(d, 1, 4) || ' ' || substr(d, 5, 4) || ' ' || substr(d, 9) END AS suggestion
FROM (SELECT id, v, regexp_replace(v, '\D', '', 'g') AS d FROM (SELECT id, nullif(trim(CASE WHEN id % 3 = 0 THEN replace(aadhaar_number, ' ', '') ELSE aadhaar_number END), '') AS v FROM records))""")
def verify_aadhaar(r):
    return _flat(r, rules.verify_aadhaar(F.when(F.col("id") % 3 == 0, F.replace("aadhaar_number", F.lit(" "), F.lit(""))).otherwise(F.col("aadhaar_number"))))


@query(r"""SELECT id, (v IS NULL OR regexp_matches(v, '\d') OR length(v) < 2) AS flagged, (CASE WHEN v IS NULL THEN 0.20 ELSE least(0.95, CASE WHEN regexp_matches(v, '\d') THEN 0.60 END, CASE WHEN length(v) < 2 THEN 0.40 END) END)::DOUBLE AS confidence,
 CASE WHEN v IS NULL THEN 'Citizen Name could not be extracted' WHEN regexp_matches(v, '\d') THEN 'Numeric digits found inside person name' ELSE '' END AS reasons, NULL::VARCHAR AS suggestion
FROM (SELECT id, nullif(trim(citizen_name), '') AS v FROM records)""")
def verify_name(r):
    return _flat(r, rules.verify_name(F.col("citizen_name"), "Citizen Name"))


_KNOWN = "lower(v) IN (" + ",".join(_q(d.lower()) for d in vocab.DISTRICTS) + ")"


@query(f"""SELECT id, (v IS NOT NULL AND NOT {_KNOWN}) AS flagged, (CASE WHEN v IS NULL THEN 0.50 WHEN {_KNOWN} THEN 0.95 ELSE 0.50 END)::DOUBLE AS confidence,
 CASE WHEN v IS NOT NULL AND NOT {_KNOWN} THEN 'District ''' || v || ''' not recognized in standard Tamil Nadu district registry' ELSE '' END AS reasons, NULL::VARCHAR AS suggestion FROM (SELECT id, nullif(trim(district), '') AS v FROM records)""")
def verify_district(r):
    return _flat(r, rules.verify_district(F.col("district")))


_D3 = "split_part(replace(v, '/', '-'), '-', {})"


@query(f"""SELECT id, coalesce(d < 1 OR d > 31 OR m < 1 OR m > 12 OR y < 1900 OR y > 2100, false) AS flagged, (CASE WHEN v IS NULL THEN 0.50 WHEN d < 1 OR d > 31 OR m < 1 OR m > 12 OR y < 1900 OR y > 2100 THEN 0.40 ELSE 0.95 END)::DOUBLE AS confidence,
 coalesce({_REASONS.format("CASE WHEN d < 1 OR d > 31 THEN 'Invalid day value (' || d || ') in date' END, CASE WHEN m < 1 OR m > 12 THEN 'Invalid month value (' || m || ') in date' END, CASE WHEN y < 1900 OR y > 2100 THEN 'Invalid year value (' || y || ') in date' END")}, '') AS reasons, NULL::VARCHAR AS suggestion
FROM (SELECT id, v, {_D3.format(1)}::INT AS d, {_D3.format(2)}::INT AS m, {_D3.format(3)}::INT AS y FROM (SELECT id, CASE WHEN id % 43 = 0 THEN '35/14/2022' ELSE dob END AS v FROM records))""")
def verify_date(r):
    return _flat(r, rules.verify_date(F.when(F.col("id") % 43 == 0, F.lit("35/14/2022")).otherwise(F.col("dob"))))


_EXTRA = f""", o AS (SELECT * FROM (SELECT id, k AS field, json_extract_string(extra_fields, '$."' || k || '"') AS v FROM records, (VALUES ('Taluk'), ('Annual Income'), ('Community'), ('Gender'), ('PAN Number'), ('Driving Licence Number')) t(k)) WHERE trim(v) <> ''),
 b AS (SELECT id, field, regexp_matches(v, {_q(_ODD)}) AS odd FROM o), ob AS (SELECT id, count(*) AS n, count_if(odd) AS odds FROM b GROUP BY id)"""
_FLAGS = _EXTRA + f""", f AS (SELECT r.id, document_type, verification_status AS cur, nullif(trim(certificate_number), '') AS c, nullif(trim(aadhaar_number), '') AS a, nullif(trim(citizen_name), '') AS n, nullif(trim(district), '') AS v, nullif(trim(json_extract_string(extra_fields, '$."Father / Guardian"')), '') AS p, dob, issue_date, ob.n AS others, ob.odds FROM records r LEFT JOIN ob ON ob.id = r.id),
g AS (SELECT id, cur, others, odds, CASE WHEN document_type IN ('Community Certificate', 'Income Certificate', 'Birth Certificate') THEN (c IS NULL OR (NOT {_SHAPES.format('c')} AND (regexp_matches(c, {_q(_ODD)}) OR (c LIKE 'TN%' AND c NOT LIKE 'TN-%' AND length(c) > 4) OR length(c) < 6)))::INT END AS fc,
 CASE WHEN document_type = 'Aadhaar Card' OR a IS NOT NULL THEN (a IS NULL OR length(regexp_replace(a, '\\D', '', 'g')) <> 12)::INT END AS fa, (n IS NULL OR regexp_matches(n, '\\d'))::INT AS fn, (v IS NOT NULL AND NOT {_KNOWN})::INT AS fd,
 regexp_matches(p, '\\d')::INT AS fp, (dob <> '')::INT AS hb, (issue_date <> '')::INT AS hi FROM f),
v AS (SELECT id, cur, (coalesce(fc, 0) + coalesce(fa, 0) + fn + fd + coalesce(fp, 0) + coalesce(odds, 0))::BIGINT AS flagged, ((fc IS NOT NULL)::INT + (fa IS NOT NULL)::INT + 2 + (fp IS NOT NULL)::INT + coalesce(hb, 0) + coalesce(hi, 0) + coalesce(others, 0))::BIGINT AS fields FROM g),
vs AS (SELECT id, flagged, fields, CASE WHEN cur = 'manually_verified' THEN cur WHEN flagged > 0 THEN 'needs_review' ELSE 'auto_verified' END AS status FROM v)"""


@query(_FLAGS + " SELECT id, flagged, fields, status FROM vs")
def verification_report(r):
    return dashboard.verification_report(r)


@query(_EXTRA + " SELECT id, field, odd AS flagged, (CASE WHEN odd THEN 0.60 ELSE 0.95 END)::DOUBLE AS confidence, CASE WHEN odd THEN 'Uncertain OCR characters detected' ELSE '' END AS reasons FROM b")
def verify_extra_fields(r):
    return dashboard.verify_others(r)


@query(None)
def verify_district_close(r):
    return _flat(r, rules.verify_district(F.col("district"), extractors.close_district(F.initcap("district"), 0.75)))


@query(None)
def consistency_report_close(r):
    return dashboard.consistency(r, AS_OF, extractors.close_district(F.initcap("district"), 0.7))


@query("""SELECT id, CASE WHEN citizen_name IS NULL OR p = 0 THEN '' ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || trim(replace(substr(ocr_text, s + 1, e - s), chr(10), ' ')) || (CASE WHEN e < length(ocr_text) THEN '...' ELSE '' END) END AS snippet
FROM (SELECT *, greatest(0, p - 51) AS s, least(length(ocr_text), p - 1 + length(v) + 50) AS e FROM (SELECT id, ocr_text, citizen_name, trim(citizen_name) AS v,
 CASE WHEN strpos(lower(ocr_text), lower(trim(citizen_name))) > 0 THEN strpos(lower(ocr_text), lower(trim(citizen_name))) WHEN length(split_part(trim(citizen_name), ' ', 1)) >= 3 THEN strpos(lower(ocr_text), lower(split_part(trim(citizen_name), ' ', 1))) ELSE 0 END AS p FROM records))""")
def ocr_context(r):
    return r.select("id", tx.context(F.col("ocr_text"), F.col("citizen_name")).alias("snippet"))


# Consistency ----------------------------------------------------------------------------------------------------------


_DAY = r"try_strptime(regexp_extract({0}, '\b(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})\b', 3) || '-' || regexp_extract({0}, '\b(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})\b', 2) || '-' || regexp_extract({0}, '\b(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})\b', 1), '%Y-%m-%d')::DATE"


@query("SELECT id, " + _DAY.format("dob") + " AS day FROM records")
def parse_date(r):
    return r.select("id", tx.parse_date(F.col("dob")).alias("day"))


@query(f"""SELECT id, CASE WHEN i > DATE '{AS_OF}' THEN 'Issue Date Validity' WHEN i < b THEN 'DOB vs Issue Date Chronology' WHEN b IS NOT NULL THEN 'Date Chronology' END AS finding,
 CASE WHEN i > DATE '{AS_OF}' OR i < b THEN 'Failed' WHEN b IS NOT NULL THEN 'Passed' END AS status FROM (SELECT id, {_DAY.format("dob")} AS b, {_DAY.format("issue_date")} AS i FROM records)""")
def date_chronology(r):
    return r.select("id", rules.date_check(F.col("document_type"), F.col("dob"), F.col("issue_date"), AS_OF).alias("x")).select("id", F.col("x.check").alias("finding"), F.col("x.status").alias("status"))


@query("SELECT id, CASE WHEN lower(a) = lower(b) AND length(a) > 2 THEN 'Warning' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'Passed' END AS parent_check, CASE WHEN m IS NULL OR district = '' THEN NULL WHEN lower(m) <> lower(trim(district)) THEN 'Warning' ELSE 'Passed' END AS place_check FROM (SELECT id, district, "
       + _CLEAN.format("citizen_name") + " AS a, " + _CLEAN.format("father") + " AS b, " + _TALUK_SQL.format("taluk") + " AS m FROM records)")
def cross_field_checks(r):
    a, b, m = tx.clean_name(F.col("citizen_name")), tx.clean_name(F.col("father")), tx.taluk_district(F.col("taluk"))
    parent = F.when((F.lower(a) == F.lower(b)) & (F.length(a) > 2), "Warning").when(a.isNotNull() & b.isNotNull(), "Passed")
    place = F.when(m.isNull() | (F.col("district") == ""), F.lit(None)).when(F.lower(m) != F.lower(F.trim("district")), "Warning").otherwise("Passed")
    return r.select("id", parent.alias("parent_check"), place.alias("place_check"))


_REQ = " UNION ALL ".join(f"SELECT {_q(k)} AS document_type, {_q(f)} AS field" for k, fs in vocab.REQUIRED.items() for f in fs)
_KEYS = ", ".join(f"({_q(k)})" for k in ("Taluk", "Father / Guardian", "Annual Income", "Father's Name", "Community", "Gender", "PAN Number", "Driving Licence Number", "Applicant Name"))
_COLUMNS = " UNION ALL ".join(f"SELECT id, {_q(k)} AS field, {c} AS v FROM records WHERE {c} <> ''" for k, c in corrections.COLUMNS.items())
#: A record's fields: those of its JSON, its columns, and aliases where there is neither.
_FIELDS = f""", kv0 AS (SELECT * FROM (SELECT id, k AS field, json_extract_string(extra_fields, '$."' || k || '"') AS v FROM records, (VALUES {_KEYS}) t(k)) WHERE v IS NOT NULL UNION ALL {_COLUMNS}),
kv AS (SELECT * FROM kv0 UNION ALL SELECT id, 'Citizen Name', v FROM kv0 WHERE field = 'Applicant Name' AND v <> '' AND id NOT IN (SELECT id FROM kv0 WHERE field = 'Citizen Name')
 UNION ALL SELECT id, 'Certificate Number', v FROM kv0 WHERE field IN ('PAN Number', 'Driving Licence Number') AND v <> '' AND id NOT IN (SELECT id FROM kv0 WHERE field = 'Certificate Number'))"""


@query(f"{_FIELDS}, req AS ({_REQ}), want AS (SELECT r.id, q.field FROM records r JOIN req q ON q.document_type = CASE WHEN r.document_type IN (SELECT document_type FROM req) THEN r.document_type ELSE 'Generic Document' END) SELECT w.id, w.field, coalesce(trim(kv.v), '') <> '' AS present FROM want w LEFT JOIN kv ON kv.id = w.id AND kv.field = w.field")
def required_presence(r):
    return dashboard.required_presence(r)


_FORMAT = (
    "CASE WHEN field IN ('Date of Birth', 'Issue Date') THEN CASE WHEN " + _DAY.format("v") + " IS NULL THEN 'Failed' ELSE 'Passed' END WHEN field = 'Aadhaar Number' THEN CASE WHEN NOT regexp_matches(regexp_replace(v, '\\s+', '', 'g'), '^\\d{12}$') THEN 'Failed' ELSE 'Passed' END"
    " WHEN field = 'PAN Number' THEN CASE WHEN regexp_matches(upper(v), '^[A-Z]{5}[0-9]{4}[A-Z]$') THEN 'Passed' ELSE 'Failed' END WHEN field = 'Driving Licence Number' THEN CASE WHEN length(regexp_replace(v, '[\\s-]', '', 'g')) < 9 THEN 'Warning' ELSE 'Passed' END WHEN field = 'Annual Income' THEN CASE WHEN regexp_matches(v, '[1-9]') THEN 'Passed' ELSE 'Failed' END"
    + f" WHEN field = 'Certificate Number' THEN CASE WHEN length(v) < 5 OR regexp_matches(v, '[?~*!^]') THEN 'Warning' ELSE 'Passed' END WHEN field = 'District' THEN CASE WHEN {_KNOWN} THEN 'Passed' ELSE 'Warning' END WHEN field IN ('Citizen Name', 'Father''s Name', 'Applicant Name') THEN CASE WHEN regexp_matches(v, '\\d') THEN 'Warning' ELSE 'Passed' END ELSE 'Passed' END"
)


@query(_FIELDS + ", p AS (SELECT id, field, trim(v) AS v FROM kv WHERE trim(v) <> '') SELECT id, field, " + _FORMAT + " AS status FROM p")
def field_format(r):
    return dashboard.fields(r).filter("trim(value) <> ''").select("id", "field", rules.field_format(F.col("field"), F.col("value")).alias("status"))


@query(", n AS (SELECT id, lower(" + _CLEAN.format("citizen_name") + ") AS n, " + _DAY.format("dob") + " AS d FROM records) SELECT a.id, min(b.id) AS other FROM n a JOIN n b ON a.n = b.n AND a.d <> b.d AND a.id <> b.id WHERE length(a.n) >= 3 GROUP BY a.id")
def historical_conflict(r):
    return corrections.historical_conflict(r)


_OPT = " UNION ALL ".join(f"SELECT {_q(k)} AS document_type, {_q(f)} AS field" for k, fs in vocab.OPTIONAL.items() for f in fs)
_CHECKED = f"""{_FIELDS}, req AS ({_REQ}), opt AS ({_OPT}), ty AS (SELECT id, CASE WHEN document_type IN (SELECT document_type FROM req) THEN document_type ELSE 'Generic Document' END AS t FROM records),
p AS (SELECT kv.id, kv.field, trim(kv.v) AS v, ty.t FROM kv JOIN ty ON ty.id = kv.id WHERE trim(kv.v) <> ''),
f1 AS (SELECT id, field, CASE WHEN EXISTS (SELECT 1 FROM (SELECT * FROM req UNION ALL SELECT * FROM opt) a WHERE a.document_type = t AND a.field = p.field) THEN {_FORMAT} ELSE 'Passed' END AS status FROM p),
f2 AS (SELECT ty.id, req.field, 'Failed' AS status FROM ty JOIN req ON req.document_type = ty.t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = ty.id AND p.field = req.field)),
by_key AS (SELECT r.id, max(v) FILTER (field = 'Citizen Name') AS name, coalesce(max(nullif(v, '')) FILTER (field = 'Father''s Name'), max(nullif(v, '')) FILTER (field = 'Father / Guardian')) AS father, max(nullif(v, '')) FILTER (field = 'Taluk') AS taluk, max(v) FILTER (field = 'District') AS district,
  max(v) FILTER (field = 'Date of Birth') AS dob, max(v) FILTER (field = 'Issue Date') AS issue_date FROM records r LEFT JOIN kv ON kv.id = r.id GROUP BY r.id),
days AS (SELECT id, {_DAY.format("dob")} AS b, {_DAY.format("issue_date")} AS i FROM by_key),
f3 AS (SELECT id, 'date' AS field, CASE WHEN i > DATE '{AS_OF}' OR i < b THEN 'Failed' WHEN b IS NOT NULL AND i IS NOT NULL THEN 'Passed' END AS status FROM days),
cl AS (SELECT id, district, {_CLEAN.format("name")} AS a, {_CLEAN.format("father")} AS b, {_TALUK_SQL.format("taluk")} AS m FROM by_key),
f4 AS (SELECT id, 'parent' AS field, CASE WHEN lower(a) = lower(b) AND length(a) > 2 THEN 'Warning' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'Passed' END AS status FROM cl),
f5 AS (SELECT id, 'place' AS field, CASE WHEN m IS NULL OR district IS NULL THEN NULL WHEN lower(m) <> lower(trim(district)) THEN 'Warning' ELSE 'Passed' END AS status FROM cl),
al AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4 UNION ALL SELECT * FROM f5),
cons AS (SELECT id, count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status = 'Warning') AS warnings, count(*) FILTER (status = 'Passed') AS passed FROM al GROUP BY id)"""


@query(_CHECKED + " SELECT *, CASE WHEN failed > 0 THEN 'Failed' WHEN warnings > 0 THEN 'Warning' ELSE 'Passed' END AS status FROM cons")
def consistency_report(r):
    return dashboard.consistency(r, AS_OF)


@query(_CHECKED + _FLAGS + " SELECT vs.id, CASE WHEN vs.flagged > 0 OR cons.failed > 0 THEN 'needs_review' ELSE 'auto_verified' END AS status FROM vs JOIN cons ON cons.id = vs.id")
def initial_status(r):
    return dashboard.initial_status(r, AS_OF)


# Quality --------------------------------------------------------------------------------------------------------------


_IMG = """round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, (CASE WHEN blur IS NULL THEN 35.0::DOUBLE WHEN blur < 40 THEN greatest(10.0::DOUBLE, blur * 0.5::DOUBLE) WHEN blur < 80 THEN (blur - 40) * 0.5::DOUBLE + 20 ELSE least(45.0::DOUBLE, (blur - 80) * 0.1::DOUBLE + 35) END)
 + (CASE WHEN brightness IS NULL THEN 28.0::DOUBLE WHEN brightness < 60 THEN greatest(5.0::DOUBLE, brightness * 0.3::DOUBLE) WHEN brightness > 200 THEN greatest(10.0::DOUBLE, 35.0::DOUBLE - (brightness - 200) * 0.4::DOUBLE) WHEN brightness < 85 OR brightness > 180 THEN 28.0::DOUBLE ELSE 35.0::DOUBLE END)
 + (CASE WHEN skew IS NULL THEN 16.0::DOUBLE WHEN abs(skew) > 5 THEN greatest(2.0::DOUBLE, 20.0::DOUBLE - abs(skew) * 2) WHEN abs(skew) > 1.5 THEN 14.0::DOUBLE ELSE 20.0::DOUBLE END))), 1)"""
_OCR = "CASE WHEN ocr_confidence >= 0 THEN round(least(100.0::DOUBLE, CASE WHEN ocr_confidence <= 1 THEN ocr_confidence * 100 ELSE ocr_confidence END), 1) END"


@query(f"SELECT id, {_IMG} AS image_score FROM records")
def image_quality_score(r):
    return r.select("id", rules.image_score(F.col("blur"), F.col("brightness"), F.col("skew")).alias("image_score"))


@query(f"SELECT id, {_OCR} AS ocr_score FROM records")
def ocr_score(r):
    return r.select("id", rules.ocr_score(F.col("ocr_confidence")).alias("ocr_score"))


_COMPLETE = f"{_FIELDS}, req AS ({_REQ}), want AS (SELECT r.id, q.field FROM records r JOIN req q ON q.document_type = CASE WHEN r.document_type IN (SELECT document_type FROM req) THEN r.document_type ELSE 'Generic Document' END), done AS (SELECT w.id, count(*) FILTER (coalesce(trim(kv.v), '') <> '') AS present, count(*) AS required FROM want w LEFT JOIN kv ON kv.id = w.id AND kv.field = w.field GROUP BY w.id), comp AS (SELECT *, round(present / required * 100.0::DOUBLE, 1) AS score FROM done)"


@query(_COMPLETE + " SELECT id, present, required, score FROM comp")
def completeness_score(r):
    return dashboard.with_fields(r).select("id", rules.completeness(F.col("document_type"), F.col("_m")).alias("x")).select("id", F.col("x.present").cast("long").alias("present"), F.col("x.required").cast("long").alias("required"), F.col("x.score").alias("score"))


_SCORED = _COMPLETE + f""", s AS (SELECT r.id, c.score AS c, CASE WHEN r.blur IS NOT NULL OR r.brightness IS NOT NULL OR r.skew IS NOT NULL THEN {_IMG} END AS i, {_OCR} AS o FROM records r JOIN comp c ON c.id = r.id),
w AS (SELECT *, 0.4::DOUBLE + CASE WHEN i IS NULL THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN o IS NULL THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END AS t FROM s),
q AS (SELECT id, round(least(100.0::DOUBLE, c * (0.4::DOUBLE / t) + coalesce(i * (0.3::DOUBLE / t), 0.0::DOUBLE) + coalesce(o * (0.3::DOUBLE / t), 0.0::DOUBLE))::VARCHAR::DECIMAL(38, 20), 1)::DOUBLE AS score FROM w)"""


@query(_SCORED + " SELECT id, score FROM q")
def quality_score(r):
    return dashboard.scored(r).select("id", "score")


@query(_SCORED + " SELECT CASE WHEN score >= 85 THEN 'Good quality and completeness' WHEN score >= 65 THEN 'Review recommended' ELSE 'Manual review strongly recommended' END AS category, count(*) AS n FROM q GROUP BY 1")
def quality_category(r):
    return dashboard.scored(r).groupBy(rules.category(F.col("score")).alias("category")).agg(F.count("*").alias("n"))


_SAID = "concat_ws(' ', CASE WHEN miss <> '' THEN 'Missing required fields: ' || miss || '.' END, CASE WHEN blur < 40 THEN printf('High image blur detected (variance: %.1f < 40).', blur) WHEN blur < 80 THEN printf('Moderate image softness/blur detected (variance: %.1f).', blur) END, CASE WHEN brightness < 60 THEN printf('Image is underexposed / too dark (mean: %.1f).', brightness) WHEN brightness > 200 THEN printf('Image is overexposed / washed out (mean: %.1f).', brightness) WHEN brightness < 85 OR brightness > 180 THEN 'Image brightness is sub-optimal.' END, CASE WHEN abs(skew) > 5 THEN printf('Significant page rotation / tilt detected (%+.1f°).', skew) WHEN abs(skew) > 1.5 THEN printf('Minor page skew detected (%+.1f°).', skew) END, CASE WHEN o < 70 THEN printf('OCR recognition confidence is low (%.1f%%).', o) END)"
_ADVICE = "CASE WHEN score >= 85 THEN 'Document details are clear and extraction is complete. Ready for verification.' WHEN score >= 65 THEN CASE WHEN miss <> '' THEN 'Review and supply missing field(s): ' || miss || '.' WHEN i < 65 THEN 'Review document image; upload a clearer scan if fine details are illegible.' ELSE 'Review highlighted fields before final approval.' END WHEN miss <> '' AND i < 50 THEN 'Critical fields are missing and image is degraded. Re-scan or manually input values.' WHEN miss <> '' THEN 'Critical fields missing (' || miss || '). Human correction required.' ELSE 'Low extraction confidence. Verify all fields against original document.' END"
_ORDER = "CASE w2.field " + " ".join(f"WHEN {_q(f)} THEN {k}" for f, k in {f: k for t in ("Aadhaar Card", "Birth Certificate", "Community Certificate", "Income Certificate") for k, f in enumerate(vocab.REQUIRED[t])}.items()) + " END"


@query(_SCORED + f""", lack AS (SELECT w2.id, coalesce(string_agg(w2.field, ', ' ORDER BY {_ORDER}) FILTER (coalesce(trim(kv.v), '') = ''), '') AS miss FROM want w2 LEFT JOIN kv ON kv.id = w2.id AND kv.field = w2.field GROUP BY w2.id),
al AS (SELECT r.id, blur, brightness, skew, miss, score, i, o, c FROM records r JOIN lack ON lack.id = r.id JOIN q ON q.id = r.id JOIN s ON s.id = r.id)
SELECT id, score AS overall_score, CASE WHEN score >= 85 THEN 'Good quality and completeness' WHEN score >= 65 THEN 'Review recommended' ELSE 'Manual review strongly recommended' END AS category, {_ADVICE} AS recommendation, i AS image_quality_score, o AS ocr_confidence_score, c AS field_completeness_score, miss AS missing_required_fields, {_SAID} AS score_reduction_factors FROM al""")
def quality_report(r):
    return dashboard.quality_report(r)


@query(_COMPLETE + " SELECT id, CASE WHEN id % 3 = 0 THEN 71.5::DOUBLE ELSE score END AS overall_score FROM comp")
def quality_lookup(r):
    return dashboard.quality_lookup(r.withColumn("quality_report", F.when(F.col("id") % 3 == 0, '{"overall_score": 71.5, "category": "Review recommended"}').otherwise("{}")))


@query(_CHECKED + _FLAGS + ", want AS (SELECT ty.id, req.field FROM ty JOIN req ON req.document_type = ty.t), comp AS (SELECT w.id, round(count(*) FILTER (coalesce(trim(kv.v), '') <> '') / count(*) * 100.0::DOUBLE, 1) AS score FROM want w LEFT JOIN kv ON kv.id = w.id AND kv.field = w.field GROUP BY w.id) SELECT vs.id, CASE WHEN failed > 0 THEN 'Failed' WHEN warnings > 0 THEN 'Warning' ELSE 'Passed' END AS consistency, vs.status AS verification, comp.score AS quality FROM vs JOIN cons ON cons.id = vs.id JOIN comp ON comp.id = vs.id")
def revalidate(r):
    return dashboard.revalidate(r, AS_OF)


# Duplicates -----------------------------------------------------------------------------------------------------------


@on_documents("SELECT doc_id AS id, sha256(coalesce(text, '')) AS digest, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id, doc_id <> min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS is_duplicate FROM documents")
def hash_duplicates(d):
    return dedup.by_content(d)


_NID = "regexp_replace(upper(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_NNAME = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(coalesce({0}, '')), '^(?:Selvan|Selvi|Thiru|Tmt|Thirumathi|Mr\.?|Mrs\.?|Ms\.?|Shri|Smt\.?|Dr\.?)\s+', '', 'i'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')))"
_NDATE = r"CASE WHEN coalesce({0}, '') = '' THEN '' WHEN regexp_matches({0}, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{4}}\b') THEN lpad(regexp_extract({0}, '\b(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})\b', 1), 2, '0') || '-' || lpad(regexp_extract({0}, '\b(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})\b', 2), 2, '0') || '-' || regexp_extract({0}, '\b(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})\b', 3) ELSE trim({0}) END"


@query("SELECT id, " + _NID.format("certificate_number") + " AS certificate, " + _NID.format("aadhaar_number") + " AS aadhaar FROM records")
def normalize_identifier(r):
    return r.select("id", tx.normalize_identifier(F.col("certificate_number")).alias("certificate"), tx.normalize_identifier(F.col("aadhaar_number")).alias("aadhaar"))


@query("SELECT id, " + _NNAME.format("citizen_name") + " AS name FROM records")
def normalize_name(r):
    return r.select("id", tx.normalize_name(F.col("citizen_name")).alias("name"))


@query("SELECT id, " + _NDATE.format("dob") + " AS day FROM records")
def normalize_date(r):
    return r.select("id", tx.normalize_date(F.col("dob")).alias("day"))


@query(f""", k AS (SELECT id, nullif({_NID.format('aadhaar_number')}, '') AS a, nullif({_NID.format('certificate_number')}, '') AS c FROM records),
hit AS (SELECT x.id, y.id AS rec, 0 AS rk FROM k x JOIN k y ON x.a = y.a AND x.id <> y.id UNION ALL SELECT x.id, y.id, 1 FROM k x JOIN k y ON x.c = y.c AND x.id <> y.id),
best AS (SELECT id, min(rec * 2 + rk) AS m FROM hit GROUP BY id)
SELECT k.id, (m // 2)::BIGINT AS record_id, m IS NOT NULL AS is_duplicate, CASE WHEN m IS NULL THEN 'No matching Aadhaar or certificate number was found.' WHEN m % 2 = 0 THEN 'A record with the same Aadhaar number already exists.' ELSE 'A record with the same certificate number already exists.' END AS reason FROM k LEFT JOIN best ON best.id = k.id""")
def identifier_duplicates(r):
    return dedup.by_identifier(r, r)


_LCS = "200.0::DOUBLE * list_reduce(list_transform(string_split(x, ''), lambda c: [c]), lambda acc, ch: list_reduce(list_transform(range(len(y)), lambda j: [j]), lambda r, j: list_append(r, CASE WHEN y[j[1] + 1] = ch[1] THEN acc[j[1] + 1] + 1 ELSE greatest(acc[j[1] + 2], r[-1]) END), [0]), list_transform(range(len(y) + 1), lambda z: 0))[-1] / (length(x) + length(y))"


@query(None)
def token_sort_ratio(r):
    names = r.select(tx.normalize_name(F.col("citizen_name")).alias("name")).distinct()
    files = names.filter("name <> ''").select("name", F.substring_index("name", " ", 1).alias("word"))
    pairs = files.join(files.withColumnRenamed("name", "other"), "word")
    return pairs.select("name", "other", F.round(tx.token_sort_ratio(F.col("name"), F.col("other")), 6).alias("sim"))


ORACLES["token_sort_ratio"] = RECORDS + f""", n AS (SELECT DISTINCT {_NNAME.format('citizen_name')} AS name FROM records), p AS (SELECT a.name, b.name AS other, array_to_string(list_sort(string_split(a.name, ' ')), ' ') AS x, array_to_string(list_sort(string_split(b.name, ' ')), ' ') AS y FROM n a JOIN n b ON split_part(a.name, ' ', 1) = split_part(b.name, ' ', 1) WHERE a.name <> '' AND b.name <> '')
SELECT name, other, round({_LCS}, 6) AS sim FROM p"""


_ADV = f""", k AS (SELECT id, {_NID.format('certificate_number')} AS c, {_NID.format('aadhaar_number')} AS a, {_NNAME.format('citizen_name')} AS n, {_NDATE.format("coalesce(nullif(issue_date, ''), dob)")} AS d, lower(trim(coalesce(district, ''))) AS p FROM records), cand AS (SELECT * FROM k WHERE id % 20 = 0),
names AS (SELECT x.n AS n1, y.n AS n2, array_to_string(list_sort(string_split(x.n, ' ')), ' ') AS x, array_to_string(list_sort(string_split(y.n, ' ')), ' ') AS y FROM (SELECT DISTINCT n FROM cand WHERE length(n) >= 3) x, (SELECT DISTINCT n FROM k WHERE length(n) >= 3) y WHERE least(length(x.n), length(y.n)) * 200 >= (length(x.n) + length(y.n)) * 85),
sims AS (SELECT n1, n2, {_LCS} AS sim FROM names),
ex AS (SELECT x.id, y.id AS record_id FROM cand x JOIN k y ON x.c = y.c AND x.id <> y.id WHERE x.c <> '' UNION SELECT x.id, y.id FROM cand x JOIN k y ON x.a = y.a AND x.id <> y.id WHERE x.a <> ''),
fz AS (SELECT x.id, y.id AS record_id, sim, (x.d <> '' AND x.d = y.d) AS sd, (x.p <> '' AND x.p = y.p) AS sp FROM cand x JOIN sims ON sims.n1 = x.n AND sim >= 85 JOIN k y ON y.n = sims.n2 AND y.id <> x.id),
m AS (SELECT id, record_id, 'Exact Match' AS match_type, 100.0::DOUBLE AS score FROM ex UNION ALL SELECT id, record_id, 'Possible Duplicate', round((CASE WHEN sp THEN least(100.0::DOUBLE, CASE WHEN sd THEN greatest(sim, 95.0::DOUBLE) ELSE sim END + 5) WHEN sd THEN greatest(sim, 95.0::DOUBLE) ELSE sim END)::VARCHAR::DECIMAL(38, 20), 1)::DOUBLE FROM fz
 WHERE (sd OR (sp AND sim >= 90) OR sim >= 95) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.id = fz.id AND ex.record_id = fz.record_id))"""


def _searched(r: DataFrame) -> DataFrame:
    """The stated query set: records whose id is divisible by 20, against all records."""
    return r.filter("id % 20 = 0")


@query(_ADV + " SELECT * FROM m", evenly="o_custkey")
def advanced_duplicates(r):
    return dedup.advanced(_searched(r), r)


@query(_ADV + ", s AS (SELECT id, count(*) AS matches, count(*) FILTER (match_type = 'Exact Match') AS exact FROM m GROUP BY id) SELECT cand.id, coalesce(matches, 0) AS matches, coalesce(exact, 0) AS exact, CASE WHEN exact > 0 THEN 'Exact Match' WHEN matches > 0 THEN 'Possible Duplicate' ELSE 'No Likely Duplicate Found' END AS status FROM cand LEFT JOIN s ON s.id = cand.id", evenly=True)
def duplicate_status(r):
    return dedup.status(_searched(r), r)


@query(_ADV + " SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, record_id DESC) AS rank FROM m", evenly="o_custkey")
def duplicate_ranking(r):
    return dedup.ranking(_searched(r), r)


@query(f""", k AS (SELECT id, sha256(coalesce(ocr_text, '')) AS h, nullif({_NID.format('aadhaar_number')}, '') AS a, nullif({_NID.format('certificate_number')}, '') AS c FROM records)
SELECT id, CASE WHEN id <> min(id) OVER (PARTITION BY h) THEN 'file' WHEN (a IS NOT NULL AND count(*) OVER (PARTITION BY a) > 1) OR (c IS NOT NULL AND count(*) OVER (PARTITION BY c) > 1) THEN 'identifier' END AS blocked_by FROM k""")
def dedup_decision(r):
    return dedup.decision(r)


@query(_FIELDS + " SELECT id, field, v FROM kv0")
def hydrated_fields(r):
    return r.select("id", F.explode(corrections.hydrated()).alias("field", "v"))


# Corrections ----------------------------------------------------------------------------------------------------------


_CHANGES = ", ch AS (SELECT id, 'Citizen Name' AS field, citizen_name AS old, 'Corrected ' || id AS new FROM records WHERE id % 50 = 0 UNION ALL SELECT id, 'District', district, CASE WHEN id % 100 = 0 THEN district ELSE 'Salem' END FROM records WHERE id % 50 = 0)"


@query(_CHANGES + f" SELECT id AS document_id, field AS field_name, coalesce(old, '') AS old_value, new AS new_value, 'officer' AS corrected_by, '{NOW}' AS corrected_at, 'checked by hand' AS notes FROM ch WHERE coalesce(old, '') <> new")
def audit_rows(r):
    return corrections.audit(r, corrections.sample(r), "officer", NOW, "checked by hand")


@query(_CHANGES + " SELECT count(*) AS changes, count(DISTINCT id) AS records FROM ch WHERE coalesce(old, '') <> new")
def correction_diff(r):
    return corrections.changed(r, corrections.sample(r)).agg(F.count("*").alias("changes"), F.countDistinct("id").alias("records"))


@query(f"""SELECT id, CASE WHEN id % 50 = 0 THEN 'Corrected ' || id ELSE citizen_name END AS citizen_name, certificate_number, aadhaar_number, dob, CASE WHEN id % 50 = 0 AND id % 100 <> 0 THEN 'Salem' ELSE district END AS district, issue_date,
 CASE WHEN id % 50 = 0 THEN 'Corrected ' || id END AS json_name, CASE WHEN id % 100 = 0 THEN trim(district) WHEN id % 50 = 0 THEN 'Salem' END AS json_district, taluk AS json_taluk,
 CASE WHEN id % 50 = 0 THEN 'manually_verified' ELSE verification_status END AS verification_status, CASE WHEN id % 50 = 0 THEN 'officer' END AS verified_by, CASE WHEN id % 50 = 0 THEN '{NOW}' END AS verified_at FROM records""")
def apply_corrections(r):
    x = corrections.apply(store.conform(r), corrections.sample(r), "officer", NOW, "checked by hand")
    json = lambda c, k: F.try_element_at(F.from_json(c, "map<string,string>"), F.lit(k))
    return x.select("id", "citizen_name", "certificate_number", "aadhaar_number", "dob", "district", "issue_date", json("extra_fields", "Citizen Name").alias("json_name"), json("extra_fields", "District").alias("json_district"), json("extra_fields", "Taluk").alias("json_taluk"), "verification_status", "verified_by", "verified_at")


@query(_CHANGES + f" SELECT id, '{NOW}' AS at, 'officer' AS reviewer, field, coalesce(old, '') AS old_value, new AS new_value, 'checked by hand' AS notes FROM ch WHERE coalesce(old, '') <> new")
def correction_entries(r):
    return corrections.history_entries(corrections.apply(store.conform(r), corrections.sample(r), "officer", NOW, "checked by hand"))


@query(f"SELECT id, CASE WHEN id = 7 THEN 'reviewed' ELSE verification_status END AS verification_status, CASE WHEN id = 7 THEN 'officer' END AS verified_by, CASE WHEN id = 7 THEN '{NOW}' END AS verified_at FROM records")
def mark_reviewed(r):
    return corrections.mark_reviewed(store.conform(r), 7, "officer", NOW).select("id", "verification_status", "verified_by", "verified_at")


@query(_CHANGES + ", a AS (SELECT id, field, coalesce(old, '') || ' -> ' || new AS step FROM ch WHERE coalesce(old, '') <> new) SELECT id, string_agg(step, '; ' ORDER BY field) AS history, count(*) AS steps FROM a GROUP BY id")
def correction_history(r):
    return corrections.history(corrections.changed(r, corrections.sample(r)))


# Questions ------------------------------------------------------------------------------------------------------------


def _ask(question: str, columns: tuple[str, ...] | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = store.corpus(spark, sf_dir)
        out = assistant.ask(question, r, store.duplicate_log(r))
        return out.select(*columns) if columns else out

    return run


QUERIES["nl_search_docs"] = _ask("Show income certificates in Tiruppur", ("id", "citizen_name", "district"))
ORACLES["nl_search_docs"] = RECORDS + " SELECT id, citizen_name, district FROM records WHERE document_type = 'Income Certificate' AND lower(district) LIKE '%tiruppur%' ORDER BY id DESC LIMIT 15"
QUERIES["nl_count"] = _ask("How many birth certificates from Salem?")
ORACLES["nl_count"] = RECORDS + " SELECT count(*) AS n FROM records WHERE document_type = 'Birth Certificate' AND lower(district) LIKE '%salem%'"
QUERIES["nl_search_dups"] = _ask("Check prevented duplicates", ("id", "filename", "detected_at"))
ORACLES["nl_search_dups"] = RECORDS + _LOG + " SELECT id, filename, detected_at FROM log ORDER BY id DESC LIMIT 10"
QUERIES["nl_free_text"] = _ask("kavitha door", ("id", "citizen_name"))
_ANY6 = "(lower(citizen_name) LIKE '%{0}%' OR lower(district) LIKE '%{0}%' OR lower(document_type) LIKE '%{0}%' OR lower(certificate_number) LIKE '%{0}%' OR lower(ocr_text) LIKE '%{0}%' OR lower(extra_fields) LIKE '%{0}%')"
ORACLES["nl_free_text"] = RECORDS + f" SELECT id, citizen_name FROM records WHERE {_ANY6.format('kavitha')} AND {_ANY6.format('door')} ORDER BY id DESC LIMIT 15"


@query(r"""SELECT id, s LIKE 'SELECT%' AND NOT regexp_matches(s, '--|;|\bREPLACE INTO\b|\b(?:""" + "|".join(vocab.FORBIDDEN_SQL) + r""")\b') AS safe FROM (SELECT id, CASE CAST(id % 4 AS INT) WHEN 0 THEN 'SELECT * FROM T WHERE ID = ' || id WHEN 1 THEN 'DROP TABLE T' WHEN 2 THEN 'SELECT 1; DELETE FROM T' ELSE 'SELECT UPDATED FROM T' END AS s FROM records)""")
def sql_guard(r):
    s = F.when(F.col("id") % 4 == 0, F.concat(F.lit("select * from t where id = "), F.col("id").cast("string"))).when(F.col("id") % 4 == 1, "DROP TABLE t").when(F.col("id") % 4 == 2, "SELECT 1; DELETE FROM t").otherwise(" select updated from t")
    return r.select("id", assistant.is_safe(s).alias("safe"))


_QUESTIONS = ", qs AS (SELECT id, document_type, district, certificate_number, CASE CAST(id % 3 AS INT) WHEN 0 THEN 'Show ' || lower(document_type) || ' records in ' || district WHEN 1 THEN 'find ' || coalesce(certificate_number, 'nothing') || ' please' ELSE 'records of ' || CAST(2000 + id % 100 AS VARCHAR(4)) END AS question FROM records)"


@query(_QUESTIONS + f""" SELECT id, 'document_type' AS entity, document_type AS v FROM qs WHERE id % 3 = 0 UNION ALL SELECT id, 'district', district FROM qs WHERE id % 3 = 0 AND district IN ({",".join(map(_q, assistant.QUESTION_DISTRICTS))})
 UNION ALL SELECT id, 'name', 'permission form' FROM qs WHERE id % 3 = 0 AND document_type = 'Student Permission Form' UNION ALL SELECT id, 'certificate_number', regexp_extract(certificate_number, '^TN-[0-9]+') FROM qs WHERE id % 3 = 1 AND certificate_number LIKE 'TN-%' UNION ALL SELECT id, 'year', CAST(2000 + id % 100 AS VARCHAR) FROM qs WHERE id % 3 = 2""")
def nl_entities(r):
    show = F.concat(F.lit("Show "), F.lower("document_type"), F.lit(" records in "), "district")
    find = F.concat(F.lit("find "), F.coalesce("certificate_number", F.lit("nothing")), F.lit(" please"))
    asked = r.select("id", F.when(F.col("id") % 3 == 0, show).when(F.col("id") % 3 == 1, find).otherwise(F.concat(F.lit("records of "), (2000 + F.col("id") % 100).cast("string"))).alias("question"))
    return asked.select("id", F.explode(assistant.entities_of(F.col("question"))).alias("entity", "v"))


_ASKED = ["How many birth certificates are there?", "How many records from Salem?", "How many documents are digitized?", "How many duplicates were blocked?", "Find records in Atlantis", "Check prevented duplicates", "show records of Salem", "find TN-4202000055433"]


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = store.corpus(spark, sf_dir)
    return spark.createDataFrame([(q, assistant.respond(q, r, store.duplicate_log(r))) for q in _ASKED], "question string, answer string")


QUERIES["nl_answer"] = _answers
ORACLES["nl_answer"] = RECORDS + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {_q(q)} AS question, {a} AS answer"
    for q, a in zip(
        _ASKED,
        [
            "'Found ' || (SELECT count(*) FROM records WHERE document_type = 'Birth Certificate') || ' registered Birth Certificate(s) in the database.'",
            "'Found ' || (SELECT count(*) FROM records WHERE lower(district) LIKE '%salem%') || ' digitized record(s) from Salem district.'",
            "'There are currently ' || (SELECT count(*) FROM records) || ' digitized government document record(s) in the platform.'",
            "'The deduplication engine has prevented ' || (SELECT count(*) FROM records WHERE id % 10 = 0) || ' duplicate document upload attempt(s) so far.'",
            "'No digitized records found. Try searching by a different name, district, or certificate number.'",
            "'Retrieved ' || (SELECT least(10, count(*)) FROM records WHERE id % 10 = 0) || ' prevented duplicate attempt(s) from the audit log.'",
            "(SELECT 'Found ' || count(*) || ' matching records (' || array_to_string(list_slice(list_sort(list_distinct(list(document_type))), 1, 2), ', ') || '). You can inspect any record using the cards below.' FROM (SELECT * FROM records WHERE lower(district) LIKE '%salem%' ORDER BY id DESC LIMIT 15))",
            """(SELECT 'Found 1 ' || document_type || ' for ' || citizen_name || ' in ' || coalesce(nullif(district, ''), 'Tamil Nadu') || ' (Certificate/ID: ' || certificate_number || ' issued on ' || issue_date || ')' ||
 CASE verification_status WHEN 'auto_verified' THEN ' (Status: Automated consistency and quality checks passed).' WHEN 'needs_review' THEN ' (Status: OCR-extracted, pending human review).' WHEN 'manually_verified' THEN ' (Status: Manually Verified).' ELSE ' (Status: Reviewed).' END FROM records WHERE certificate_number = 'TN-4202000055433')""",
        ],
        strict=True,
    )
) + ")"
