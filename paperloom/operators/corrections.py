"""Corrections by hand: differences, audit rows, copies of the store with the corrections in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_name, parse_date, some

COLUMNS = {"Citizen Name": "citizen_name", "Certificate Number": "certificate_number", "Aadhaar Number": "aadhaar_number", "Date of Birth": "dob", "District": "district", "Issue Date": "issue_date"}


def _parsed(column: str) -> Column:
    return F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))


def sample(r: DataFrame) -> DataFrame:
    """Corrections (id, changes) of each fiftieth record."""
    district = F.when(F.col("id") % 100 == 0, F.col("district")).otherwise("Salem")
    return r.filter("id % 50 = 0").select("id", F.create_map(F.lit("Citizen Name"), F.concat(F.lit("Corrected "), F.col("id").cast("string")), F.lit("District"), district).alias("changes"))


def changed(r: DataFrame, corrections: DataFrame) -> DataFrame:
    """(id, field, old_value, new_value) where a correction differs from what is stored: in the JSON, else in the column."""
    columns = F.create_map(*[x for k, c in COLUMNS.items() for x in (F.lit(k), F.col(c))])
    x = r.select("id", columns.alias("c"), _parsed("extra_fields").alias("e")).join(corrections, "id").select("id", "c", "e", F.explode_outer("changes").alias("field", "v")).filter("field IS NOT NULL")
    old = F.coalesce(some(F.try_element_at("e", F.col("field"))), some(F.try_element_at("c", F.col("field"))), F.lit(""))
    x = x.select("id", "field", old.alias("old_value"), F.trim(F.coalesce("v", F.lit(""))).alias("new_value"))
    return x.filter(F.col("old_value") != F.col("new_value"))


def audit(r: DataFrame, corrections: DataFrame, reviewer: str, now: str, notes: str | None = None) -> DataFrame:
    """Rows of the audit log for corrections: document_id, field_name, old_value, new_value, corrected_by, corrected_at, notes."""
    x = changed(r, corrections)
    return x.select(F.col("id").alias("document_id"), F.col("field").alias("field_name"), "old_value", "new_value", F.lit(reviewer).alias("corrected_by"), F.lit(now).alias("corrected_at"), F.lit(notes).cast("string").alias("notes"))


def apply(r: DataFrame, corrections: DataFrame, reviewer: str, now: str, notes: str | None = None) -> DataFrame:
    """The store with corrected fields in its JSON and columns, the history of corrections, and their records marked as verified by hand.

    A column takes the first of its names that the corrected JSON has with a
    value. The history has one entry for each correction, by its time: reviewer,
    changes (old and new by field) and notes. Corrections of an id that the
    store lacks raise an error.
    """
    ghosts = corrections.join(r, "id", "left_anti").limit(1).collect()
    if ghosts:
        raise ValueError(f"Document with ID {ghosts[0]['id']} does not exist.")
    steps = changed(r, corrections).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct(F.col("old_value").alias("old"), F.col("new_value").alias("new")))))).alias("_steps"))  # a record's own fields
    x = r.join(corrections.select("id", F.transform_values("changes", lambda k, v: F.trim(F.coalesce(v, F.lit("")))).alias("_changes")), "id", "left").join(steps, "id", "left")
    hit = F.col("_changes").isNotNull()
    old = _parsed("extra_fields")
    x = x.withColumn("_extra", F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key("_changes", k)), F.col("_changes")))
    at = lambda c, names: F.coalesce(*[F.nullif(F.try_element_at("_extra", F.lit(k)), F.lit("")) for k in names], F.col(c))
    # The fields that a column takes, in order.
    names = {"citizen_name": ("Citizen Name", "Applicant Name", "Name"), "certificate_number": ("Certificate Number",), "aadhaar_number": ("Aadhaar Number",), "dob": ("Date of Birth", "DOB"), "district": ("District",), "issue_date": ("Issue Date",)}
    shape = "map<string,struct<reviewer:string,changes:map<string,struct<old:string,new:string>>,notes:string>>"
    entry = F.struct(F.lit(reviewer).alias("reviewer"), F.coalesce("_steps", F.create_map().cast("map<string,struct<old:string,new:string>>")).alias("changes"), F.lit(notes).cast("string").alias("notes"))
    past = F.coalesce(F.from_json(F.coalesce("field_corrections", F.lit("{}")) if "field_corrections" in r.columns else F.lit("{}"), shape), F.create_map().cast(shape))
    history = F.to_json(F.map_concat(F.map_filter(past, lambda k, v: k != now), F.create_map(F.lit(now), entry)))
    put = {
        **{c: at(c, ks) for c, ks in names.items()},
        "extra_fields": F.to_json("_extra"),
        "verification_status": F.lit("manually_verified"),
        "verified_by": F.lit(reviewer),
        "verified_at": F.lit(now),
        "field_corrections": history,
    }
    have = {c: F.col(c) if c in r.columns else F.lit("{}" if c == "field_corrections" else None).cast("string") for c in put}
    return x.withColumns({c: F.when(hit, v).otherwise(have[c]) for c, v in put.items()}).drop("_changes", "_steps", "_extra")


def history_entries(r: DataFrame) -> DataFrame:
    """(id, at, reviewer, field, old_value, new_value, notes): the corrections that records' histories hold, one row a changed field."""
    shape = "map<string,struct<reviewer:string,changes:map<string,struct<old:string,new:string>>,notes:string>>"
    x = r.select("id", F.explode_outer(F.from_json("field_corrections", shape)).alias("at", "e")).filter("at IS NOT NULL")
    x = x.select("id", "at", "e.reviewer", "e.notes", F.explode_outer("e.changes").alias("field", "c")).filter("field IS NOT NULL")
    return x.select("id", "at", "reviewer", "field", F.col("c.old").alias("old_value"), F.col("c.new").alias("new_value"), "notes")


def mark_reviewed(r: DataFrame, id_: int, reviewer: str, now: str) -> DataFrame:
    hit = F.col("id") == id_
    put = {"verification_status": "reviewed", "verified_by": reviewer, "verified_at": now}
    return r.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in put.items()})


def history(audit: DataFrame) -> DataFrame:
    """Each record's changes in one line, by field."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("field", F.concat(F.coalesce("old_value", F.lit("")), F.lit(" -> "), F.col("new_value")).alias("s")))), lambda x: x["s"])
    return audit.groupBy("id").agg(F.array_join(steps, "; ").alias("history"), F.count("*").alias("steps"))


def historical_conflict(r: DataFrame) -> DataFrame:
    """(id, other): the first other record of the same cleaned name with another date of birth.

    Pairs of a name are not formed: for each name and date the smallest id is
    kept, and of a name's dates the two with the smallest ids answer for all.
    """
    x = r.select("id", F.lower(clean_name(F.col("citizen_name"))).alias("n"), parse_date(F.col("dob")).alias("d")).filter("length(n) >= 3 AND d IS NOT NULL")
    firsts = x.groupBy("n", "d").agg(F.min("id").alias("first"))
    lead = firsts.groupBy("n").agg(F.min(F.struct("first", "d")).alias("m1"))
    second = firsts.join(lead, "n").filter("d <> m1.d").groupBy("n").agg(F.min("first").alias("f2"))
    known = lead.join(second, "n")
    out = x.join(known, "n").select("id", F.when(F.col("d") != F.col("m1.d"), F.col("m1.first")).otherwise(F.col("f2")).alias("other"))
    return out


def hydrated() -> Column:
    """A record's fields: those in its JSON, and its columns where the JSON doesn't have their key."""
    extra = _parsed("extra_fields")
    pairs = {"Citizen Name": "citizen_name", "Certificate Number": "certificate_number", "Aadhaar Number": "aadhaar_number", "District": "district", "Date of Birth": "dob", "Issue Date": "issue_date"}
    columns = F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), F.col(c))])
    return F.map_concat(extra, F.map_filter(columns, lambda k, v: (F.coalesce(v, F.lit("")) != "") & ~F.map_contains_key(extra, k)))
