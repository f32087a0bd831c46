"""Filters, pages, counts and reports over the record store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import blank, clean_name, some, taluk_district, valid_name
from ..sources.records import RECORD, conform
from . import rules
from .corrections import apply, hydrated

SEARCHED = ("citizen_name", "certificate_number", "aadhaar_number", "district", "ocr_text")


def filtered(r: DataFrame, search: str = "", kind: str = "", district: str = "", status: str = "", columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Records that meet all given conditions; blank and "All" stand for none. % and _ in a search are wildcards."""
    given = lambda x: x.strip() not in ("", "All")
    conds: list[Column] = []
    if search.strip():
        # the escape sign occurs in no search, so a backslash is an ordinary character
        conds.append(reduce(lambda a, b: a | b, [F.coalesce(F.ilike(F.col(c), F.lit(f"%{search.strip()}%"), F.lit("\x01")), F.lit(False)) for c in columns]))
    if given(kind):
        conds.append(F.col("document_type") == kind)
    if given(district):
        conds.append(F.col("district") == district)
    if given(status):
        conds.append(F.col("verification_status").isin(*vocab.VERIFIED) if status == "verified" else F.col("verification_status") == status)
    return reduce(DataFrame.filter, conds, r)


def page(r: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    out = r.orderBy(F.desc("id"))
    return (out.offset(offset) if offset else out).limit(limit)


def distinct_values(r: DataFrame, column: str) -> DataFrame:
    return r.filter(F.trim(column) != "").select(column).distinct().orderBy(column)


def extra() -> Column:
    return F.from_json("extra_fields", "map<string,string>")


def detail(r: DataFrame, id_: int) -> DataFrame:
    """One record with its JSON columns parsed; no rows if there is none."""
    x = r.filter(F.col("id") == id_).withColumn("x", F.coalesce(extra(), F.create_map().cast("map<string,string>")))
    at = lambda k: F.try_element_at("x", F.lit(k))
    return x.select("id", "document_type", "citizen_name", at("Taluk").alias("taluk_name"), at("Father / Guardian").alias("guardian"), at("Annual Income").alias("income"), F.size(F.map_keys(F.from_json("field_corrections", "map<string,string>"))).cast("long").alias("corrections"))


def listing(r: DataFrame, names: tuple[str, ...], places: tuple[str, ...]) -> DataFrame:
    """Name and place of records, from their other fields where the column is blank."""
    x = r.withColumn("x", extra())
    pick = lambda c, keys: F.coalesce(F.nullif(F.col(c), F.lit("")), *[F.nullif(F.try_element_at("x", F.lit(k)), F.lit("")) for k in keys])
    return x.select("id", pick("citizen_name", names).alias("shown_name"), pick("district", places).alias("shown_place"))


def _pending() -> Column:
    return F.count_if(F.col("verification_status") == "needs_review").alias("pending")


def _verified() -> Column:
    return F.count_if(F.col("verification_status").isin(*vocab.VERIFIED)).alias("verified")


def status_counts(r: DataFrame) -> DataFrame:
    return r.agg(_pending(), _verified())


def stats(r: DataFrame, log: DataFrame) -> DataFrame:
    """The dashboard's figures: one pass over the records and one over the log."""
    mine = r.agg(F.count("*").alias("total"), F.countDistinct(F.when(F.trim("district") != "", F.col("district"))).alias("districts"), _pending(), _verified(), F.max("id").alias("newest"))
    return mine.join(F.broadcast(log.agg(F.count("*").alias("blocked"))), F.lit(True))  # one row each


def overview(r: DataFrame, log: DataFrame, recent: int = 5) -> DataFrame:
    """One row: the dashboard's figures, records by type, and the newest records and blocked uploads.

    Types are few, newest rows are `recent`; nothing else meets in one task.
    """
    types = r.groupBy("document_type").agg(F.count("*").alias("n"))
    by_type = types.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "document_type", "n"))), lambda x: F.struct(x["document_type"].alias("document_type"), x["n"].alias("n"))).alias("type_breakdown"))

    def newest(d: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
        return page(d, recent).agg(F.sort_array(F.collect_list(F.struct(*columns)), asc=False).alias(name))

    lists = [by_type, newest(r, ("id", "document_type", "citizen_name", "certificate_number", "district", "upload_date"), "recent_documents"), newest(log, ("id", "filename", "reason", "detected_at"), "recent_duplicates")]
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), lists, stats(r, log))  # one row each


# Fields that stand for another one where that isn't there, in order.
ALIASES = {
    "Certificate Number": ("PAN Number", "Driving Licence Number", "Registration Number"),
    "Citizen Name": ("Name", "Applicant Name", "Child Name", "Card Holder's Name"),
    "Date of Birth": ("DOB",),
}


def with_fields(r: DataFrame) -> DataFrame:
    """With `_m`, a record's fields by name: those in its JSON, its columns where the JSON doesn't have their key, and aliases where neither has."""
    x = r.withColumn("_h", hydrated())
    others = {k: F.coalesce(*[F.nullif(F.try_element_at("_h", F.lit(a)), F.lit("")) for a in names]) for k, names in ALIASES.items()}
    more = F.map_filter(F.create_map(*[c for k, v in others.items() for c in (F.lit(k), v)]), lambda k, v: v.isNotNull() & ~F.map_contains_key("_h", k))
    return x.withColumn("_m", F.map_concat("_h", more)).drop("_h")


def fields(r: DataFrame) -> DataFrame:
    # outer: a filter on the map's size, which the other one brings, would repeat all that makes the map
    return with_fields(r).select("id", "document_type", F.explode_outer("_m").alias("field", "value")).filter("field IS NOT NULL")


def required_presence(r: DataFrame) -> DataFrame:
    """(id, field, present) for the fields that each record's type requires."""
    required = F.create_map(*[x for k, v in vocab.REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    names = F.coalesce(F.try_element_at(required, F.col("document_type")), F.try_element_at(required, F.lit("Generic Document")))
    x = with_fields(r).select("id", F.col("_m").alias("m"), F.explode(names).alias("field"))
    return x.select("id", "field", (F.coalesce(F.trim(F.try_element_at("m", F.col("field"))), F.lit("")) != "").alias("present"))


def _with(r: DataFrame, close: Column | None) -> tuple[DataFrame, Column | None]:
    """The closest districts as a column of their own: functions on arrays can't call Python."""
    return (r, None) if close is None else (r.withColumn("_close", close), F.col("_close"))


STANDARD = ("Certificate Number", "certificate_number", "Aadhaar Number", "aadhaar_number", "Citizen Name", "citizen_name", "Applicant Name", "Name", "Child Name", "Father / Guardian", "Father's Name", "Father / Husband Name", "District", "district", "Date of Birth", "dob", "DOB", "Issue Date", "issue_date")


def other_fields(parsed: Column | None = None) -> Column:
    """The fields of a record's JSON that have no rules of their own, without blank ones."""
    return F.map_filter(extra() if parsed is None else parsed, lambda k, v: ~k.isin(*STANDARD) & (F.coalesce(v, F.lit("")) != "") & ~blank(v))


def flagged(r: DataFrame, close: Column | None = None) -> DataFrame:
    """With `_flagged` and `_fields`: how many of a record's fields the rules flag, and how many they judge.

    Name and district always count; a father's name, dates and fields without
    rules where there are any. The JSON is parsed once and each value trimmed
    once, in projections of their own; no function on arrays holds a rule.
    """
    values = {"_cert": "certificate_number", "_aad": "aadhaar_number", "_name": "citizen_name", "_place": "district", "_dob": "dob", "_issue": "issue_date"}
    x = r.withColumn("_x", extra())
    x = x.withColumn("_father", F.coalesce(*[F.nullif(F.try_element_at("_x", F.lit(k)), F.lit("")) for k in ("Father / Guardian", "Father's Name", "Father / Husband Name")]))
    x = x.withColumns({"_father": some(F.col("_father")), **{k: some(F.col(c)) for k, c in values.items()}, "_others": F.map_values(other_fields(F.col("_x")))})
    given = lambda c, rule: F.when(F.col(c).isNotNull(), rule)
    judged = {
        "_1": F.when(F.col("document_type").isin("Community Certificate", "Income Certificate", "Birth Certificate"), rules.verify_certificate(F.col("_cert"), True)["flagged"]),
        "_2": F.when((F.col("document_type") == "Aadhaar Card") | F.col("_aad").isNotNull(), rules.verify_aadhaar(F.col("_aad"), True)["flagged"]),
        "_3": rules.verify_name(F.col("_name"), "Citizen Name", True)["flagged"],
        "_4": given("_father", rules.verify_name(F.col("_father"), "Father / Guardian", True)["flagged"]),
        "_5": rules.verify_district(F.col("_place"), close, True)["flagged"],
        "_6": given("_dob", rules.verify_date(F.col("_dob"), True)["flagged"]),
        "_7": given("_issue", rules.verify_date(F.col("_issue"), True)["flagged"]),
    }
    x = x.withColumns(judged)
    odd = F.size(F.filter("_others", lambda v: v.rlike(vocab.SUSPICIOUS)))
    add = lambda cols: sum((c.cast("int") for c in cols), F.lit(0))
    mine = [F.col(k) for k in judged]
    counted = x.withColumns({"_flagged": add(F.coalesce(c, F.lit(False)) for c in mine) + F.greatest(F.coalesce(odd, F.lit(0)), F.lit(0)), "_fields": add(c.isNotNull() for c in mine) + F.greatest(F.coalesce(F.size("_others"), F.lit(0)), F.lit(0))})
    return counted.drop("_x", "_father", "_others", *values, *judged)


def verification_report(r: DataFrame, close: Column | None = None) -> DataFrame:
    """(id, flagged, fields, status) by the rules on all fields of a record."""
    r, close = _with(r, close)
    return flagged(r, close).select("id", F.col("_flagged").cast("long").alias("flagged"), F.col("_fields").cast("long").alias("fields"), rules.overall_status(F.col("verification_status"), F.col("_flagged")).alias("status"))


def verify_others(r: DataFrame) -> DataFrame:
    """(id, field, flagged, confidence, reasons) of the fields without rules of their own."""
    x = r.select("id", F.explode(other_fields()).alias("field", "v")).select("id", "field", rules.verify_other(F.col("v")).alias("x"))
    return x.select("id", "field", F.col("x.flagged").alias("flagged"), F.col("x.confidence").alias("confidence"), F.col("x.reasons").alias("reasons"))


def quality_report(r: DataFrame, measured: bool = True) -> DataFrame:
    """A record's whole quality report; without its measurements only completeness counts."""
    none = F.lit(None).cast("double")
    missing = rules.missing_fields(F.col("document_type"), F.col("_m"))
    x = scored(r if measured else r.withColumns(dict.fromkeys(("blur", "brightness", "skew", "ocr_confidence"), none)), missing.alias("missing"), "blur", "brightness", "skew")
    return x.select("id", *_quality_columns())


def _quality_columns() -> list[Column]:
    """The report on records `scored` with their missing fields and measurements."""
    said = rules.factors(F.col("missing"), F.col("blur"), F.col("brightness"), F.col("skew"), F.col("ocr"))
    return [F.col("score").alias("overall_score"), rules.category(F.col("score")).alias("category"), rules.recommendation(F.col("score"), F.col("missing"), F.col("image")).alias("recommendation"), F.col("image").alias("image_quality_score"), F.col("ocr").alias("ocr_confidence_score"), F.col("complete").alias("field_completeness_score"), F.array_join("missing", ", ").alias("missing_required_fields"), F.array_join(said, " ").alias("score_reduction_factors")]


def quality_lookup(r: DataFrame) -> DataFrame:
    """(id, overall_score): from the stored report if it has a score, else from completeness."""
    stored = F.try_element_at(F.from_json("quality_report", "map<string,string>"), F.lit("overall_score")).try_cast("double")
    x = with_fields(r).select("id", stored.alias("s"), rules.completeness(F.col("document_type"), F.col("_m"))["score"].alias("c"))
    return x.select("id", F.coalesce("s", "c").alias("overall_score"))


def revalidate(r: DataFrame, as_of: str, close: Column | None = None) -> DataFrame:
    """Consistency, verification and quality of records after edits, in one pass; nothing is stored."""
    r, close = _with(r, close)
    x = with_fields(flagged(r, close)).select("id", "verification_status", _statuses(as_of, close).alias("s"), "_flagged", rules.completeness(F.col("document_type"), F.col("_m"))["score"].alias("q"))
    consistent = F.when(F.array_contains("s", "Failed"), "Failed").when(F.array_contains("s", "Warning"), "Warning").otherwise("Passed")
    return x.select("id", consistent.alias("consistency"), rules.overall_status(F.col("verification_status"), F.col("_flagged")).alias("verification"), F.col("q").alias("quality"))


def scored(r: DataFrame, *more) -> DataFrame:
    """Records with their completeness, image, recognition and overall scores; no image measurements, no image score."""
    measured = F.col("blur").isNotNull() | F.col("brightness").isNotNull() | F.col("skew").isNotNull()
    x = with_fields(r).select("id", rules.completeness(F.col("document_type"), F.col("_m"))["score"].alias("complete"), F.when(measured, rules.image_score(F.col("blur"), F.col("brightness"), F.col("skew"))).alias("image"), rules.ocr_score(F.col("ocr_confidence")).alias("ocr"), *more)
    return x.withColumn("score", rules.overall_score(F.col("complete"), F.col("image"), F.col("ocr")))


def _statuses(as_of: str, close: Column | None = None) -> Column:
    """Of records `with_fields`: status of each field and check of a record: required ones fail if blank, other than the type's own fields aren't checked."""
    by_type = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    of = lambda d: F.coalesce(F.try_element_at(by_type(d), F.col("document_type")), F.try_element_at(by_type(d), F.lit("Generic Document")))
    required, known = of(vocab.REQUIRED), F.array_union(of(vocab.REQUIRED), of(vocab.OPTIONAL))
    given = F.map_filter("_m", lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")
    present = F.transform(F.map_entries(given), lambda e: F.when(F.array_contains(known, e["key"]), rules.field_format(e["key"], e["value"], close)).otherwise("Passed"))
    missing = F.transform(F.array_except(required, F.map_keys(given)), lambda _: F.lit("Failed"))
    at = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at("_m", F.lit(k)), F.lit("")) for k in keys])
    a, b, m, place_of = clean_name(at("Citizen Name", "Name")), clean_name(at("Father's Name", "Father / Guardian", "Father / Husband Name")), taluk_district(at("Taluk")), at("District")
    parent = F.when((F.lower(a) == F.lower(b)) & (F.length(a) > 2), "Warning").when(a.isNotNull() & b.isNotNull(), "Passed")
    place = F.when(m.isNull() | place_of.isNull(), F.lit(None)).when(F.lower(m) != F.lower(F.trim(place_of)), "Warning").otherwise("Passed")
    checks = F.array(rules.date_check(F.col("document_type"), at("Date of Birth", "DOB"), at("Issue Date"), as_of)["status"], parent, place)
    return F.array_compact(F.concat(present, missing, checks))


def consistency(r: DataFrame, as_of: str, close: Column | None = None) -> DataFrame:
    """(id, failed, warnings, passed, status) over a record's fields and checks; conflicts with other records are apart (historical_conflict). `close`: the district closest to the record's by spelling, which then passes."""
    r, close = _with(r, close)
    x = with_fields(r).select("id", _statuses(as_of, close).alias("s"))
    n = lambda what: F.size(F.filter("s", lambda v: v == what)).cast("long")
    x = x.select("id", n("Failed").alias("failed"), n("Warning").alias("warnings"), n("Passed").alias("passed"))
    return x.withColumn("status", F.when(F.col("failed") > 0, "Failed").when(F.col("warnings") > 0, "Warning").otherwise("Passed"))


def initial_status(r: DataFrame, as_of: str) -> DataFrame:
    """(id, status) at upload: verified unless a field is flagged or a check fails. One pass, no join."""
    x = with_fields(flagged(r))
    return x.select("id", F.when((F.col("_flagged") > 0) | F.array_contains(_statuses(as_of), "Failed"), "needs_review").otherwise("auto_verified").alias("status"))


def with_flags(r: DataFrame, close: Column | None = None) -> DataFrame:
    """With `_flags`, a record's flagged fields with the reasons."""
    x = r.withColumn("_x", extra())
    father = F.coalesce(*[F.nullif(F.try_element_at("_x", F.lit(k)), F.lit("")) for k in ("Father / Guardian", "Father's Name", "Father / Husband Name")])
    values = {"_cert": F.col("certificate_number"), "_aad": F.col("aadhaar_number"), "_name": F.col("citizen_name"), "_father": father, "_place": F.col("district"), "_dob": F.col("dob"), "_issue": F.col("issue_date")}
    x = x.withColumns({**{k: some(c) for k, c in values.items()}, "_others": other_fields(F.col("_x"))})
    said = lambda name, rule, when=None: F.when(rule["flagged"] if when is None else when & rule["flagged"], F.struct(F.lit(name).alias("field"), F.split(rule["reasons"], "; ").alias("reasons")))
    judged = [
        said("Certificate Number", rules.verify_certificate(F.col("_cert"), True), F.col("document_type").isin("Community Certificate", "Income Certificate", "Birth Certificate")),
        said("Aadhaar Number", rules.verify_aadhaar(F.col("_aad"), True), (F.col("document_type") == "Aadhaar Card") | F.col("_aad").isNotNull()),
        said("Citizen Name", rules.verify_name(F.col("_name"), "Citizen Name", True)),
        said("Father / Guardian", rules.verify_name(F.col("_father"), "Father / Guardian", True), F.col("_father").isNotNull()),
        said("District", rules.verify_district(F.col("_place"), close, True)),
        said("Date of Birth", rules.verify_date(F.col("_dob"), True), F.col("_dob").isNotNull()),
        said("Issue Date", rules.verify_date(F.col("_issue"), True), F.col("_issue").isNotNull()),
    ]
    x = x.withColumns({f"_{k}": c for k, c in enumerate(judged)})
    more = F.transform(F.map_entries("_others"), lambda e: F.struct(e["key"].alias("field"), rules.verify_other(e["value"]).alias("x")))
    more = F.transform(F.filter(more, lambda e: e["x"]["flagged"]), lambda e: F.struct(e["field"].alias("field"), F.split(e["x"]["reasons"], "; ").alias("reasons")))
    every = F.array_compact(F.array(*[f"_{k}" for k in range(len(judged))]))
    none = F.array().cast("array<struct<field:string,reasons:array<string>>>")
    return x.withColumn("_flags", F.concat(every, F.coalesce(more, none))).drop("_x", "_others", *values, *[f"_{k}" for k in range(len(judged))])


def flags(r: DataFrame, close: Column | None = None) -> DataFrame:
    """(id, verification_flags): JSON list of a record's flagged fields with the reasons, as it is stored at upload."""
    r, close = _with(r, close)
    return with_flags(r, close).select("id", F.to_json("_flags").alias("verification_flags"))


PROMOTED = ("citizen_name", "certificate_number", "aadhaar_number", "dob", "district", "issue_date")


def promoted(r: DataFrame) -> DataFrame:
    """Records with the columns that their fields give (`PROMOTED`).

    A column takes the first of its fields that isn't empty. Names are cleaned,
    or only trimmed where nothing valid is left; a taluk gives the district
    where no field does.
    """
    first = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at("_m", F.lit(k)), F.lit("")) for k in keys])
    # The fields that a column takes, in order.
    names = ("Citizen Name", "Name", "Applicant Name", "Child Name")
    numbers = ("Certificate Number", "Registration Number", "PAN Number", "Driving Licence Number")
    x = r.withColumn("_m", hydrated()).withColumn("_raw", first(*names))
    name = F.coalesce(F.nullif(valid_name(F.col("_raw")), F.lit("")), F.trim("_raw"))
    columns = (name, first(*numbers), first("Aadhaar Number"), first("Date of Birth", "DOB"), F.coalesce(first("District"), taluk_district(first("Taluk"))), first("Issue Date"))
    return x.withColumns(dict(zip(PROMOTED, columns, strict=True))).drop("_m", "_raw")


def stored(r: DataFrame, as_of: str, now: str, close: Column | None = None) -> DataFrame:
    """New records as they are stored, in the store's schema: promoted columns, first status, flags, consistency and quality.

    A status that a record brings stays. Everything is made in one pass, without
    a join or a later update.
    """
    measures = ("blur", "brightness", "skew", "ocr_confidence")
    r = r.withColumns({c: F.lit(None).cast("double") for c in measures if c not in r.columns})
    x, close = _with(promoted(r), close)
    x = with_flags(x, close)
    kept = [c for c in RECORD.names if c in x.columns and c not in ("id", "quality_score", "quality_report")]
    missing = rules.missing_fields(F.col("document_type"), F.col("_m"))
    x = scored(x, *kept, *measures[:3], "_flags", missing.alias("missing"), _statuses(as_of, close).alias("_s"))
    n = lambda what: F.size(F.filter("_s", lambda v: v == what))
    overall = F.when(n("Failed") > 0, "Failed").when(n("Warning") > 0, "Warning").otherwise("Passed")
    given = F.nullif(F.trim("verification_status"), F.lit("")) if "verification_status" in x.columns else F.lit(None).cast("string")
    first = F.when((F.size("_flags") > 0) | F.array_contains("_s", "Failed"), "needs_review").otherwise("auto_verified")
    made = {
        "verification_status": F.coalesce(given, first),
        "verification_flags": F.to_json("_flags"),
        "consistency_results": F.to_json(F.struct(overall.alias("overall_status"), n("Failed").alias("failed"), n("Warning").alias("warnings"), n("Passed").alias("passed"))),
        "quality_score": F.col("score"),
        "quality_report": F.to_json(F.struct(*_quality_columns())),
        "upload_date": F.lit(now),
    }
    return conform(x.withColumns(made))


def reanalysed(r: DataFrame, corrections_: DataFrame, reviewer: str, now: str, notes: str | None = None) -> DataFrame:
    """The verification report of records right after their corrections; an id that the store lacks is an error."""
    return verification_report(apply(r, corrections_, reviewer, now, notes).join(corrections_.select("id"), "id", "left_semi"))
