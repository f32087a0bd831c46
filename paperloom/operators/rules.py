"""Rules on fields as column expressions: verification, consistency, quality, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import blank, case_of, clean_name, grouped, parse_date, some


def _info(reasons: list[Column], confidences: list[Column], base: float, value: Column, suggestion: Column | None = None) -> Column:
    """Struct (value, flagged, confidence, reasons, suggestion): a rule's reason and confidence are null where it isn't met."""
    flagged = reduce(lambda a, b: a | b, [r.isNotNull() for r in reasons], F.lit(False))
    return F.struct(value.alias("value"), flagged.alias("flagged"), F.least(F.lit(base), *confidences).alias("confidence"), F.concat_ws("; ", *reasons).alias("reasons"), (suggestion if suggestion is not None else F.lit(None).cast("string")).alias("suggestion"))


def _fixed(flagged: bool, confidence: float, reason: str, value: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((value if value is not None else none).alias("value"), F.lit(flagged).alias("flagged"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reasons"), none.alias("suggestion"))


def verify_certificate(c: Column, tidy: bool = False) -> Column:
    """`tidy`: the value has been through `some`, here and below."""
    v = c if tidy else some(c)
    odd = F.regexp_extract(v, f"({vocab.SUSPICIOUS})", 1)
    bare = v.startswith("TN") & ~v.startswith("TN-") & (F.length(v) > 4)
    header = F.lower(v).rlike("rmtr|certificateno|date")
    rules = [
        (odd != "", F.concat(F.lit("Uncertain OCR character '"), odd, F.lit("' detected in identifier")), 0.50),
        (bare, F.lit("Missing standard hyphen separator in TN certificate prefix"), 0.75),
        (header, F.lit("Header label OCR fragments found attached to number"), 0.60),
        (F.length(v) < 6, F.concat(F.lit("Identifier length ("), F.length(v).cast("string"), F.lit(") is unusually short for a government certificate")), 0.55),
    ]
    known = v.rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]$") | v.rlike(r"^[A-Z]{2}[0-9]{2}\s?[0-9]{11}$")
    hyphened = F.when(bare, F.concat(F.lit("TN-"), F.substr(v, F.lit(3))))
    return F.when(v.isNull(), _fixed(True, 0.20, "Certificate Number was not detected by OCR")).when(known, _fixed(False, 0.98, "", v)).otherwise(_info([F.when(a, b) for a, b, _ in rules], [F.when(a, n) for a, _, n in rules], 0.95, v, hyphened))


def verify_aadhaar(c: Column, tidy: bool = False) -> Column:
    v = c if tidy else some(c)
    d = F.regexp_replace(v, r"\D", "")
    wrong = F.length(d) != 12
    said = F.when(F.length(d) == 16, "16-digit Virtual ID (VID) extracted instead of 12-digit Aadhaar number").otherwise(F.concat(F.lit("Contains "), F.length(d).cast("string"), F.lit(" digits instead of expected 12 digits")))
    odd = v.rlike(vocab.SUSPICIOUS)
    return F.when(v.isNull(), _fixed(True, 0.20, "Aadhaar number was not detected in document")).otherwise(_info([F.when(wrong, said), F.when(odd, F.lit("Uncertain OCR character detected in Aadhaar string"))], [F.when(wrong, 0.45), F.when(odd, 0.50)], 0.98, v, F.when(~wrong & (v != grouped(d)), grouped(d))))


def verify_name(c: Column, field: str, tidy: bool = False) -> Column:
    v = c if tidy else some(c)
    odd = F.regexp_extract(v, f"({vocab.SUSPICIOUS})", 1)
    noise = case_of([(F.contains(F.lower(v), F.lit(w)), F.lit(w)) for w in vocab.NAME_NOISE])
    rules = [
        (odd != "", F.concat(F.lit("Uncertain character '"), odd, F.lit("' detected in name")), 0.50),
        (v.rlike(r"\p{Nd}"), F.lit("Numeric digits found inside person name"), 0.60),
        (noise.isNotNull(), F.concat(F.lit("Extracted name contains non-name keyword '"), noise, F.lit("'")), 0.40),
        (F.contains(v, F.lit("'")), F.lit("Unwanted apostrophe/punctuation in name"), 0.70),
        (F.length(v) < 2, F.lit(f"{field} is too short (< 2 characters)"), 0.40),
    ]
    without = F.when(F.contains(v, F.lit("'")), F.regexp_replace(F.trim(F.regexp_replace(v, "['`’]", " ")), r"\s+", " "))
    return F.when(v.isNull(), _fixed(True, 0.20, f"{field} could not be extracted")).otherwise(_info([F.when(a, b) for a, b, _ in rules], [F.when(a, n) for a, _, n in rules], 0.95, v, without))


def verify_district(c: Column, close: Column | None = None, tidy: bool = False) -> Column:
    """`close`: the district that is closest by spelling, where there is one."""
    v = c if tidy else some(c)
    close = close if close is not None else F.lit(None).cast("string")
    known = F.lower(v).isin(*[d.lower() for d in vocab.DISTRICTS])
    near = _info([F.concat(F.lit("District '"), v, F.lit("' likely misspelling of official district '"), close, F.lit("'"))], [F.lit(0.70)], 0.95, v, close)
    far = _info([F.concat(F.lit("District '"), v, F.lit("' not recognized in standard Tamil Nadu district registry"))], [F.lit(0.50)], 0.95, v)
    return F.when(v.isNull(), _fixed(False, 0.50, "")).when(known, _fixed(False, 0.95, "", v)).when(close.isNotNull(), near).otherwise(far)


def verify_date(c: Column, tidy: bool = False) -> Column:
    v = c if tidy else some(c)
    parts = F.split(F.replace(v, F.lit("/"), F.lit("-")), "-")
    n = [F.try_element_at(parts, F.lit(k)).try_cast("int") for k in (1, 2, 3)]
    bad = F.greatest(*[x.isNull() for x in n])
    rules = [((n[0] < 1) | (n[0] > 31), "day", n[0]), ((n[1] < 1) | (n[1] > 12), "month", n[1]), ((n[2] < 1900) | (n[2] > 2100), "year", n[2])]
    good = _info([F.when(a, F.concat(F.lit(f"Invalid {w} value ("), x.cast("string"), F.lit(") in date"))) for a, w, x in rules], [F.when(a, 0.40) for a, _, _ in rules], 0.95, v)
    shape = _info([F.concat(F.lit("Date '"), v, F.lit("' does not conform to DD-MM-YYYY structure"))], [F.lit(0.50)], 0.95, v)
    return F.when(v.isNull(), _fixed(False, 0.50, "")).when(F.size(parts) != 3, shape).when(bad, _info([F.lit("Date contains non-numeric characters")], [F.lit(0.50)], 0.95, v)).otherwise(good)


def verify_other(c: Column) -> Column:
    """A field without rules of its own."""
    v = some(c)
    odd = v.rlike(vocab.SUSPICIOUS)
    return F.when(v.isNotNull(), _info([F.when(odd, F.lit("Uncertain OCR characters detected"))], [F.when(odd, 0.60)], 0.95, v))


def overall_status(current: Column, flagged: Column) -> Column:
    return F.when(current == "manually_verified", current).when(flagged > 0, "needs_review").otherwise("auto_verified")


def field_format(field: Column, value: Column, close: Column | None = None) -> Column:
    """Passed, Warning or Failed: the first rule whose words the field's name has."""
    v, low = F.trim(value), F.lower(field)
    day = parse_date(v)
    digits = F.regexp_replace(v, r"\s+", "")
    plain = F.regexp_replace(v, r"[\s\-]", "")
    money = F.regexp_replace(v, r"\D", "")
    name = clean_name(v)
    known = F.lower(v).isin(*[d.lower() for d in vocab.DISTRICTS])
    known = known | close.isNotNull() if close is not None else known
    grade = lambda *rules: case_of([(a, F.lit(b)) for a, b in rules], F.lit("Passed"))
    return case_of(
        [
            (low.rlike("date|dob"), grade((day.isNull(), "Failed"), (~F.year(day).between(1900, 2030), "Warning"))),
            (F.contains(low, F.lit("aadhaar")), grade((~digits.rlike(r"^\d{12}$"), "Failed"), (digits.rlike("^[01]"), "Warning"))),
            (F.contains(low, F.lit("pan")), grade((~F.upper(v).rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]$"), "Failed"))),
            (low.rlike("driving|licence"), grade(((F.length(plain) < 9) | ~plain.rlike(r"^\p{L}{2}"), "Warning"))),
            (F.contains(low, F.lit("certificate number")), grade((F.length(v) < 5, "Warning"), (v.rlike(r"[?~*!^]"), "Warning"))),
            (F.contains(low, F.lit("district")), grade((~known, "Warning"))),
            (F.contains(low, F.lit("income")), grade((~money.rlike("[1-9]"), "Failed"))),
            (low.rlike("name|citizen"), grade((F.length(name) < 2, "Failed"), (name.rlike(r"\p{Nd}"), "Warning"))),
        ],
        F.lit("Passed"),
    )


def date_check(kind: Column, dob: Column, issue: Column, as_of: str) -> Column:
    """How issue date, birth and day of the check agree: (check, status) of the first finding, null without two dates."""
    b, i = parse_date(dob), parse_date(issue)
    age = F.floor(F.date_diff(i, b) / 365)
    told = lambda check, status: F.struct(F.lit(check).alias("check"), F.lit(status).alias("status"))
    return F.when(i > F.lit(as_of).cast("date"), told("Issue Date Validity", "Failed")).when(i < b, told("DOB vs Issue Date Chronology", "Failed")).when((kind == "Driving Licence") & (age < 18), told("Minimum Age Requirement", "Failed")).when(b.isNotNull() & i.isNotNull(), told("Date Chronology", "Passed"))


def image_score(blur: Column, brightness: Column, skew: Column) -> Column:
    b = F.when(blur.isNull(), 35.0).when(blur < 40, F.greatest(F.lit(10.0), blur * 0.5)).when(blur < 80, (blur - 40) * 0.5 + 20).otherwise(F.least(F.lit(45.0), (blur - 80) * 0.1 + 35))
    x = F.when(brightness.isNull(), 28.0).when(brightness < 60, F.greatest(F.lit(5.0), brightness * 0.3)).when(brightness > 200, F.greatest(F.lit(10.0), F.lit(35.0) - (brightness - 200) * 0.4)).when((brightness < 85) | (brightness > 180), 28.0).otherwise(35.0)
    a = F.abs(skew)
    s = F.when(a.isNull(), 16.0).when(a > 5, F.greatest(F.lit(2.0), F.lit(20.0) - a * 2)).when(a > 1.5, 14.0).otherwise(20.0)
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), b + x + s)), 1)


def ocr_score(confidence: Column) -> Column:
    return F.when(confidence >= 0, F.round(F.least(F.lit(100.0), F.when(confidence <= 1, confidence * 100).otherwise(confidence)), 1))


def completeness(kind: Column, fields: Column) -> Column:
    """(present, required, score) of a type's required fields in a map of fields."""
    required = F.create_map(*[x for k, v in vocab.REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    names = F.coalesce(F.try_element_at(required, kind), F.try_element_at(required, F.lit("Generic Document")))
    present = F.size(F.filter(names, lambda n: ~F.coalesce(blank(F.try_element_at(fields, n)), F.lit(True))))
    return F.struct(present.alias("present"), F.size(names).alias("required"), F.round(present / F.size(names) * 100.0, 1).alias("score"))


def overall_score(complete: Column, image: Column, ocr: Column, weights: dict[str, float] | None = None) -> Column:
    """Mean of the scores that there are, by weight."""
    w = weights or vocab.WEIGHTS
    parts = [(complete, w["field_completeness"]), (image, w["image_quality"]), (ocr, w["ocr_confidence"])]
    total = sum((F.when(c.isNotNull(), x).otherwise(0.0) for c, x in parts[1:]), F.lit(parts[0][1]))
    mean = sum((F.when(c.isNotNull(), c * (F.lit(x) / total)).otherwise(0.0) for c, x in parts[1:]), complete * (F.lit(parts[0][1]) / total))
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), mean)), 1)


def category(score: Column) -> Column:
    return F.when(score >= 85, "Good quality and completeness").when(score >= 65, "Review recommended").otherwise("Manual review strongly recommended")


def missing_fields(kind: Column, fields: Column) -> Column:
    """The fields that a type requires and a map of fields lacks, in order."""
    required = F.create_map(*[x for k, v in vocab.REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    names = F.coalesce(F.try_element_at(required, kind), F.try_element_at(required, F.lit("Generic Document")))
    return F.filter(names, lambda n: F.coalesce(blank(F.try_element_at(fields, n)), F.lit(True)))


def factors(missing: Column, blur: Column, brightness: Column, skew: Column, ocr: Column) -> Column:
    """What lowers a record's quality score: array of sentences."""
    one, signed = lambda c: F.format_string("%.1f", c), lambda c: F.format_string("%+.1f", c)
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    tilt = F.abs(skew)
    return F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, said("Missing required fields: ", F.array_join(missing, ", "), ".")),
            F.when(blur < 40, said("High image blur detected (variance: ", one(blur), " < 40).")).when(blur < 80, said("Moderate image softness/blur detected (variance: ", one(blur), ").")),
            F.when(brightness < 60, said("Image is underexposed / too dark (mean: ", one(brightness), ").")).when(brightness > 200, said("Image is overexposed / washed out (mean: ", one(brightness), ").")).when((brightness < 85) | (brightness > 180), "Image brightness is sub-optimal."),
            F.when(tilt > 5, said("Significant page rotation / tilt detected (", signed(skew), "°).")).when(tilt > 1.5, said("Minor page skew detected (", signed(skew), "°).")),
            F.when(ocr < 70, said("OCR recognition confidence is low (", one(ocr), "%).")),
        )
    )


def recommendation(score: Column, missing: Column, image: Column) -> Column:
    lacks, names = F.size(missing) > 0, F.array_join(missing, ", ")
    middle = F.when(lacks, F.concat(F.lit("Review and supply missing field(s): "), names, F.lit("."))).when(image < 65, "Review document image; upload a clearer scan if fine details are illegible.").otherwise("Review highlighted fields before final approval.")
    low = F.when(lacks & (image < 50), "Critical fields are missing and image is degraded. Re-scan or manually input values.").when(lacks, F.concat(F.lit("Critical fields missing ("), names, F.lit("). Human correction required."))).otherwise("Low extraction confidence. Verify all fields against original document.")
    return F.when(score >= 85, "Document details are clear and extraction is complete. Ready for verification.").when(score >= 65, middle).otherwise(low)
