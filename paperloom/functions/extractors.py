"""Fields of a document by type, as a map column from field to value.

A field is a list of candidates; the first that isn't blank counts. Nulls and
texts without any field give an empty map.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx
from . import vocab
from .text import I, found, let

# Labels, titles and clauses by which fields are found.
TITLE = r"(?:Selvan|Selvi|Thiru|Tmt|Thirumathi)"
KIN = r"(?:son|daughter|wife|s/o|d/o|w/o)"
SENTENCE = rf"(?:certi[tf]y\s+that\s+)?{TITLE}\s+([A-Za-z\s\.]+?)\s+{KIN}\s+(?:of\s+)?{TITLE}?\s*([A-Za-z\s\.]+?)(?=\s+(?:residing|Door|at|\d|,|\.))"
TITLED = rf"\b{TITLE}\s+([A-Za-z\s\.]+?)(?=\s+(?:[:\w/]+\s+{TITLE}|son|:on|daughter|wife|s/o|d/o|w/o|residing|Door|\d|$))"
SOLO = rf"(?:certi[tf]y\s+that\s+)?{TITLE}\s+([A-Za-z\s\.]+?)(?=\s+(?:son|daughter|wife|s/o|d/o|w/o|belongs|residing|Door|\d|$))"
DAY = r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})"
BORN = r"(?:DOB|Date\s+of\s+Birth)\s*[:\-/]?\s*" + DAY
PLACES = ("state", "tamil", "nadu", "district")
PAN_WORDS = tuple("income tax department govt government india permanent account number card signature father name date birth incometax holder pan".split())
LICENCE_WORDS = tuple("driving licence license transport department union india form signature authority date issue validity motor vehicles act badge blood group vehicle renewal valid expiry endorsement".split())
ROLL_NOISE = ("submitted", "holder", "number", "card", "aadhaar", "dob")
HEADINGS = ("CERTIFICATE", "COMMUNITY", "CASTE", "GOVERNMENT")
# Fixed values of Aadhaar cards: words of their print, marks of bad recognition, misreadings of a name, relations, places that end a name.
CARD_WORDS = tuple(
    "proof identity citizenship birth dob state tamil nadu address pin code mobile help uidai download unique authority india government aadhaar information letter scanning scanner regulations submitted verified holder online secure update updated benefit service services lock unlock biometric biometrics consent seeking entity entities valid validity enrolment enrollment father husband mother sub district dist taluk village town road street nagar colony post po vtc door male female transgender vid www http portal your iddress addresss to card signature signed date year not".split()
)
CARD_NOISE = tuple("as ugy ng pnef q gcn dr no c qu sp pmn agg gug ong gan caw cac naa gen gengb rcaa".split())
MISREAD = {"gapall": "Gopal", "gopa": "Gopal"}
RELATION = r"(?:[SDWC]/?O)"
NAME_ENDS = r"(?:,|\d|THALAKARAI|GANDHI|NAGAR|MELAPPALAYAM|/|$)"


def close_district(c: Column, cutoff: float) -> Column:
    """The district closest by spelling (Ratcliff and Obershelp's ratio), null below the cutoff.

    The ratio has no built-in function; batches go through Arrow, and each
    spelling is compared once a batch.
    """

    @F.pandas_udf("string")
    def closest(words: pd.Series) -> pd.Series:
        import difflib

        known = {w: next(iter(difflib.get_close_matches(w, vocab.DISTRICTS, n=1, cutoff=cutoff)), None) for w in words.dropna().unique()}
        return words.map(known).astype(object)

    return closest(c)


def labelled_district(c: Column) -> Column:
    """By label, by the word before "District"."""
    cap = lambda p: F.initcap(found(c, I + p))
    return F.coalesce(close_district(cap(r"(?:District|மாவட்டம்)\s*[:\-]?\s*([A-Za-z]+)"), 0.7), close_district(cap(r"\b([A-Za-z]{4,15})\s+District\b"), 0.65))


def _district(c: Column, near: Column) -> Column:
    """By label, else by name anywhere, by taluk."""
    return F.coalesce(near, tx.district_in_text(c))


def _without(name: Column, words: tuple[str, ...], least: int = 2) -> Column:
    """A name of some length that has none of the words in it."""
    return let(name, lambda n: F.when((F.length(n) >= least) & ~F.lower(n).rlike("|".join(words)), n))


def _name(c: Column, pattern: str, flags: str = I) -> Column:
    return tx.some(tx.clean_name(found(c, flags + pattern)))


def _day(c: Column, pattern: str) -> Column:
    return F.replace(found(c, I + pattern), F.lit("/"), F.lit("-"))


def _map(pairs: list[tuple[str, Column]]) -> Column:
    """Map from field to value, without blank values."""
    return F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), tx.some(v))]), lambda k, v: v.isNotNull())


def _nth(names: Column, k: int) -> Column:
    return tx.clean_name(F.try_element_at(names, F.lit(k)))


def _sentence(c: Column) -> Column:
    """(head, kin): who a sentence is about, whose child or wife that is."""
    return let(found(c, I + SENTENCE, 1), lambda head: F.struct(tx.clean_name(head).alias("head"), F.when(head.isNotNull(), tx.clean_name(found(c, I + SENTENCE, 2))).alias("kin")))


def _income(c: Column, near: Column) -> Column:
    titled = F.regexp_extract_all(c, F.lit(I + TITLED), F.lit(1))

    def people(s: Column, titled: Column) -> Column:
        return let(
            _without(s["head"], (*PLACES, "village")),
            lambda whole: F.struct(
                F.coalesce(whole, _without(_nth(titled, 1), (*PLACES, "village", "taluk")), _name(c, r"^\s*1\s+([A-Za-z\s\.]+?)\s+(?:Self|Head|Father)", "(?ium)"), _name(c, r"(?:Applicant\s+Name|Name\s+of\s+the\s+family\s+Member)\s*[:\-]?\s*([A-Za-z\s\.]+)")).alias("name"),
                F.coalesce(_without(s["kin"], PLACES), F.when(whole.isNull(), _without(_nth(titled, 2), PLACES)), _name(c, rf"{KIN}\s+(?:of\s+)?{TITLE}?\s*([A-Za-z\s\.]+?)(?=\s+(?:residing|rcsiding|at Door|Door|Village|\n))")).alias("father"),
            ),
        )

    money = lambda d: F.concat(F.lit("Rs. "), F.format_number(d.try_cast("bigint"), 0))
    paid = money(F.translate(found(c, I + r"(?:Rs\.?|INR)\s*([0-9oO]{4,8})"), "oO", "00"))
    words = F.when(c.rlike(I + "Thousand"), found(c, I + r"([A-Za-z\s]+?\s+Thousand)"))

    def told(x: Column) -> Column:
        seventy = F.contains(x["words"], F.lit("Seventy"))
        both = F.when(seventy & x["paid"].isNotNull(), F.concat(x["paid"], F.lit(" (Seventy Eight Thousand)"))).when(seventy, F.concat(F.lit("Rupees "), tx.some(x["words"]), F.lit(" Only")))
        return F.coalesce(both, x["paid"], money(found(c, I + r"Total\s+Annual\s+Income.*?(\d{4,8})")))

    taluk = F.when(c.rlike(I + "Taluk|வட்டம்"), F.coalesce(found(c, I + r"\b([A-Za-z]+)\s+Taluk\b"), found(c, I + r"(?:Taluk|வட்டம்)\s*[:\-]?\s*([A-Za-z]+)")))
    village = F.when(c.rlike(I + "Villag"), found(c, I + r"\b([A-Za-z]+)\s+Villag[ec]\b"))
    place = lambda w, *no: let(w, lambda w: F.when((F.length(w) > 3) & ~F.lower(w).isin(*no), F.initcap(w)))
    income = let(F.struct(words.alias("words"), paid.alias("paid")), told)
    named = let(_sentence(c), lambda s: let(titled, lambda t: people(s, t)))
    return let(named, lambda p: _map([("Certificate Number", tx.extract_certificate(c)), ("Citizen Name", p["name"]), ("Father / Husband Name", p["father"]), ("Annual Income", income), ("District", _district(c, near)), ("Taluk", place(taluk, "the", "and", "town")), ("Village", place(village, "the", "and")), ("Issue Date", tx.extract_date(c))]))


def _birth(c: Column, near: Column) -> Column:
    parent = lambda who: _name(c, rf"(?:{who}'?s?\s+Name|{who})\s*[:\-]?\s*([A-Za-z\s\.]+?)(?:,|\n|$)")
    name = _name(c, r"(?:Child\s+Name|Name\s+of\s+Child|Name)\s*[:\-]?\s*([A-Za-z\s\.]+?)(?=\s*(?:\n|Date|DOB|Father|Mother|District|$))")
    born = _day(c, r"(?:Date\s+of\s+Birth|DOB|பிறந்த\s+நாள்)\s*[:\-/]?\s*" + DAY)
    place = found(c, I + r"Place\s+of\s+Birth\s*[:\-]?\s*([A-Za-z0-9\s,]+?)(?:\.|\n|$)")
    return _map([("Certificate Number", tx.extract_certificate(c)), ("Citizen Name", name), ("Date of Birth", born), ("Father's Name", parent("Father")), ("Mother's Name", parent("Mother")), ("Place of Birth", place), ("District", _district(c, near)), ("Issue Date", tx.extract_date(c))])


def _community(c: Column, near: Column) -> Column:
    labelled = _name(c, r"(?:Applicant\s+Name|Name)\s*[:\-]?\s*([A-Za-z\s\.]+?)(?=\s*(?:\n|Community|Caste|Father|$))")
    solo = _without(tx.clean_name(found(c, I + SOLO)), (*PLACES, "village"))
    name = lambda s: F.coalesce(_without(s["head"], (*PLACES, "village")), solo, let(labelled, lambda x: F.when(~F.lower(x).isin("certificate", "government", "tamil nadu"), x)))
    father = lambda s: F.coalesce(_without(s["kin"], PLACES), _name(c, rf"{KIN}\s+(?:of\s+)?{TITLE}?\s*([A-Za-z\s\.]+?)(?=\s+(?:residing|Door|at|\d|,|\.|\n))"))
    caste = tx.some(found(c, I + r"belongs\s+to\s+([A-Za-z0-9\s\-]+?)\s+Community"))
    group = tx.some(found(c, I + r"recognized\s+as\s+(?:a\s+)?([A-Za-z\s]+?)\s+as\s+per"))
    direct = found(c, I + r"belongs\s+to\s+(?:the\s+|a\s+)?([A-Za-z0-9\s\-]+?\s*(?:Community|Class|Caste))")
    labels = F.transform(F.regexp_extract_all(c, F.lit(I + r"(?:Community|Caste|சாதி)\s*[:\-]?\s*([A-Za-z0-9\s\-]+?)(?:,|\.|\n|$)"), F.lit(1)), lambda x: F.trim(x))
    label = F.try_element_at(F.filter(labels, lambda x: ~F.upper(x).isin(*HEADINGS)), F.lit(1))
    community = let(caste, lambda x: F.coalesce(F.concat(x, F.lit(" ("), group, F.lit(")")), x, direct, label))
    return let(_sentence(c), lambda s: _map([("Certificate Number", tx.extract_certificate(c)), ("Citizen Name", name(s)), ("Father / Guardian", father(s)), ("Community", community), ("District", _district(c, near)), ("Issue Date", tx.extract_date(c))]))


def _pan(c: Column, near: Column) -> Column:
    born = found(c, I + r"(?:Date\s+of\s+Birth|DOB|Date\s+of\s+Issue)\s*[:\-/]?\s*" + DAY)

    def above(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: x.rlike(r"\b" + DAY + r"\b") | x.rlike(I + r"\bDOB\b")), F.lit(True)).cast("int")
        return let(at, lambda at: F.when(at > 1, F.slice(lines, F.greatest(at - 4, F.lit(1)), F.least(at - 1, F.lit(4)))))

    plain = F.filter(let(F.split(c, "\n"), above), lambda x: ~x.rlike(r"\d") & (F.length(x) <= 50))
    fits = F.filter(F.transform(plain, tx.clean_name), lambda n: (F.length(n) >= 2) & ~F.lower(n).rlike("|".join(PAN_WORDS)))
    label = lambda p: _without(_name(c, p + r"\s*[:\-]?\s*([A-Za-z\s\.]{2,40}?)(?:\s*(?:\n|$))", "(?ium)"), PAN_WORDS)
    people = let(
        fits,
        lambda f: F.struct(
            tx.valid_name(F.coalesce(label(r"^\s*(?:Name|Card\s+Holder'?s?\s*Name)"), F.try_element_at(f, F.lit(1)))).alias("name"),
            tx.valid_name(F.coalesce(label(r"^\s*Father'?s?\s*(?:Name)?"), F.try_element_at(f, F.lit(2)))).alias("father"),
        ),
    )
    day = let(born, lambda b: F.when(b.isNull(), tx.extract_date(c)).when(F.substring(b, -4, 4).try_cast("int").between(1950, 2030), tx.normalize_date(b)))
    father = lambda p: F.when(p["name"].isNull() | (F.lower(p["name"]) != F.lower(p["father"])), p["father"])
    return let(F.struct(people.alias("people"), tx.extract_pan(c).alias("pan")), lambda x: _map([("Certificate Number", x["pan"]), ("PAN Number", x["pan"]), ("Date of Birth", day), ("Citizen Name", x["people"]["name"]), ("Father / Guardian", father(x["people"]))]))


def _licence(c: Column, near: Column) -> Column:
    label = _without(_name(c, r"(?:Name|Holder)\s*[:\-]?\s*([A-Za-z\s\.]{2,40}?)(?=\s*(?:S/O|D/O|W/O|DOB|Date|Address|Father|$|\n))"), LICENCE_WORDS)
    fits = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"\d") & ~F.lower(x).rlike("|".join(LICENCE_WORDS)) & tx.clean_name(x).rlike(r"^[A-Za-z\s.]{4,40}$"))
    name = tx.valid_name(F.coalesce(label, tx.clean_name(F.try_element_at(fits, F.lit(1)))))
    father = tx.valid_name(found(c, I + r"(?:S/O|D/O|W/O|Father'?s?\s+Name)\s*[:\-]?\s*([A-Za-z\s\.]{2,40}?)(?:,|\n|$)"))
    issued = _day(c, r"(?:Date\s+of\s+Issue|Issue\s+Date|Issued\s+On)\s*[:\-]?\s*" + DAY)
    valid = _day(c, r"(?:Valid(?:ity)?\s+(?:Till|Upto|Until|To)|Expiry|Expires)\s*[:\-]?\s*" + DAY)
    blood = found(c, r"\b(?:A|B|AB|O)[+-]\b", 0)
    return let(F.struct(tx.extract_licence(c).alias("number"), tx.extract_date(c).alias("date")), lambda x: _map([("Certificate Number", x["number"]), ("Driving Licence Number", x["number"]), ("Date of Birth", F.coalesce(_day(c, BORN), x["date"])), ("Citizen Name", name), ("Father / Guardian", father), ("Issue Date", F.coalesce(issued, x["date"])), ("Valid Till", valid), ("Blood Group", blood), ("District", _district(c, near))]))


def _generic(c: Column, near: Column) -> Column:
    name = _name(c, r"(?:Name\s*(?:of\s+(?:the\s+)?Student|of\s+Applicant)?|Applicant)\s*[:\-]?\s*([A-Za-z\s\.]+?)(?=\s+(?:Roll|Reg|DOB|Date|No|\d)|$|\n)")
    roll = F.upper(found(c, I + r"\b(?:Roll\s*(?:No|Number|#)?|Reg(?:istration)?\s*(?:No|Number|#))\s*[:\-]?\s*([A-Za-z0-9\-]+)"))
    return _map([("Certificate Number", tx.extract_certificate(c)), ("Aadhaar Number", tx.extract_aadhaar(c)), ("Citizen Name", name), ("Roll Number", let(roll, lambda x: F.when(~F.lower(x).rlike("|".join(ROLL_NOISE)), x))), ("District", _district(c, near)), ("Date of Birth", _day(c, BORN)), ("Issue Date", tx.extract_date(c))])


def _card_name(raw: Column) -> Column:
    """The name that a piece of a line has, null for other print: its words up to the first mark of bad recognition or short small word."""
    s = F.regexp_replace(F.regexp_replace(raw, "['\"`]", ""), r"([a-z])([A-Z])\b", "$1 $2")
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(s, r"[^a-zA-Z\s]", " "), r"\.", ""), r"\s+"), lambda w: w != "")

    def kept(words: Column) -> Column:
        ends = F.transform(words, lambda w, i: F.lower(w).isin(*CARD_NOISE) | ((i > 0) & (F.length(w) < 3) & w.rlike("^[a-z]")))
        return let(F.array_position(ends, F.lit(True)).cast("int"), lambda end: F.when(end > 0, F.slice(words, 1, F.greatest(end - 1, F.lit(0)))).otherwise(words))

    def name(kept: Column) -> Column:
        read = let(F.array_join(kept, " "), lambda n: F.coalesce(*[F.when(F.lower(n) == k, v) for k, v in MISREAD.items()], n))
        print_ = F.exists(kept, lambda w: F.lower(w).isin(*CARD_WORDS))
        return let(read, lambda n: F.when(F.length(n).between(2, 40) & ~print_ & F.exists(kept, lambda w: F.length(w) >= 3), n))

    return let(let(words, kept), name)


def _first(names: Column) -> Column:
    return F.try_element_at(F.array_compact(names), F.lit(1))


def _aadhaar(c: Column, near: Column) -> Column:
    """The name stands before a relation, at or at most two lines above the birth date, or between "To" and a relation."""
    head = r"^([A-Za-z\s.']{2,30}?)\s+"

    def people(lines: Column, names: Column) -> Column:
        beside = _first(F.transform(lines, lambda x: _card_name(found(x, I + head + RELATION + r"\s*[:\-]"))))

        def near_birth(x: Column, i: Column) -> Column:
            here = x.rlike(I + r"\bDOB\b") & ~x.rlike("(?iu)proof|identity|citizenship")
            return F.when(here, F.array(_card_name(found(x, I + head + r"[0-9a-z./]*\s*DOB")), F.get(names, i - 1), F.get(names, i - 2))).otherwise(F.array().cast("array<string>"))

        birth = _first(F.flatten(F.transform(lines, near_birth)))
        to = F.array_position(F.transform(lines, lambda x: x.rlike(I + r"^To\b")), F.lit(True)).cast("int")
        after = lambda to: F.transform(lines, lambda x, i: (i + 1 >= to) & x.rlike(I + rf"\b{RELATION}\b"))
        posted = let(to, lambda to: let(F.array_position(after(to), F.lit(True)).cast("int"), lambda kin: _first(F.when((to > 0) & (kin > to + 1), F.reverse(F.slice(names, to + 1, F.greatest(kin - to - 1, F.lit(0))))))))
        parents = F.transform(lines, lambda x: _card_name(found(x, I + r"\b(?:[SDW]/?O|C/O)\s*[:\-]?\s*([A-Za-z\s.']{2,30}?)" + NAME_ENDS)))
        return let(F.coalesce(beside, birth, posted), lambda name: F.struct(name.alias("name"), _first(F.filter(parents, lambda x: F.coalesce(x != name, F.lit(True)))).alias("father")))

    named = let(F.split(c, "\n"), lambda lines: let(F.transform(lines, _card_name), lambda names: people(lines, names)))
    born = I + r"(?:DOB|Date\s+of\s+Birth|பிறந்த\s+நாள்)[^\d]*(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
    day = F.when(c.rlike(born), F.concat_ws("-", F.lpad(F.regexp_extract(c, born, 1), 2, "0"), F.lpad(F.regexp_extract(c, born, 2), 2, "0"), F.regexp_extract(c, born, 3)))
    vid = found(c, I + r"\bVID\s*[:\-]?\s*(\d{4}\s\d{4}\s\d{4}\s\d{4})\b")
    enrolment = found(c, I + r"enroll?ment\s*(?:no\.?|number)?\s*[:\-]?\s*(\d{4}/\d{5}/\d{5})")
    pin = F.coalesce(found(c, I + r"\bPIN\s*(?:Code)?\s*[:\-]?\s*(\d{6})\b"), found(c, r"\b(6\d{5})\b"))
    return let(named, lambda p: _map([("VID", vid), ("Aadhaar Number", tx.extract_aadhaar(c)), ("Enrolment Number", enrolment), ("Date of Birth", day), ("Gender", F.initcap(found(c, I + r"\b(Male|Female|Transgender)\b"))), ("Citizen Name", p["name"]), ("Father / Guardian", p["father"]), ("District", _district(c, near)), ("PIN Code", pin)]))


BY_NAME = {"aadhaar": _aadhaar, "aadhaar_card": _aadhaar, "income_certificate": _income, "birth_certificate": _birth, "community_certificate": _community, "pan_card": _pan, "driving_licence": _licence, "generic": _generic}


def extract(extractor: str, ocr_text: Column) -> Column:
    """The fields that an extractor finds in a text: map from field to value, without blank values.

    What several fields need is computed once a row. The closest districts come
    from Python and so are found beside the rest.
    """
    text = tx.normalize_lines(ocr_text)
    near = F.lit(None).cast("string") if BY_NAME[extractor] is _pan else labelled_district(text)
    return let(F.struct(text.alias("text"), near.alias("near")), lambda x: BY_NAME[extractor](x["text"], x["near"]))
