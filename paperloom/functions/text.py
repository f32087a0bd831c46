"""Scalar functions on text columns: normalising, classifying and extracting, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

I = "(?iu)"  # letters of either case, in any script


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row, however often it is used. A Python function may be in the value only."""
    return F.get(F.transform(F.array(value), use), 0)


def blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"^\s*$")


def some(c: Column) -> Column:
    """The value without white space around it, or null if it is blank."""
    return let(F.regexp_replace(c, r"^\s+|\s+$", ""), lambda s: F.when(s != "", s))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """regexp_extract, null without a match or for an empty group."""
    return let(F.regexp_extract(c, pattern, group), lambda s: F.when(s != "", s))


def case_of(pairs: list[tuple[Column, object]], otherwise: object = None) -> Column:
    out = reduce(lambda w, p: w.when(*p) if w is not None else F.when(*p), pairs, None)
    return out.otherwise(otherwise)


def normalize_lines(c: Column) -> Column:
    """One space for runs of blanks; lines without space around them; no empty lines."""
    lines = F.transform(F.split(F.regexp_replace(c, r"[ \t]+", " "), r"\r\n|\n|\r"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalize_identifier(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def normalize_name(c: Column) -> Column:
    s = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), I + r"^(?:Selvan|Selvi|Thiru|Tmt|Thirumathi|Mr\.?|Mrs\.?|Ms\.?|Shri|Smt\.?|Dr\.?)\s+", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " ")))


_DATE = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b"


def normalize_date(c: Column) -> Column:
    d, m, y = (F.regexp_extract(c, _DATE, k) for k in (1, 2, 3))
    return F.when(c.isNull() | (c == ""), "").when(d != "", F.concat_ws("-", F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), y)).otherwise(F.trim(c))


def parse_date(c: Column) -> Column:
    """The first day-month-year in a text as a date; null if there is none or no such day."""
    d, m, y = (F.regexp_extract(c, _DATE, k) for k in (1, 2, 3))
    return F.when(d != "", F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))


def classify(c: Column) -> tuple[Column, Column]:
    """(document type, pattern that matched): the first type, in order, with a pattern that occurs."""
    # no pattern has an anchor, so the text is searched as it is; one search a type, one a pattern only for its own
    kinds = case_of([(c.rlike(f"{I}(?:{'|'.join(ps)})"), F.lit(t)) for t, ps in vocab.TYPE_PATTERNS], F.lit("Unknown"))
    return kinds, case_of([(c.rlike(I + p), F.lit(p)) for _, ps in vocab.TYPE_PATTERNS for p in ps])


def extractor_of(kind: Column) -> Column:
    """The extractor's name for a type: its name in snake case, generic where there is none."""
    named = {"Income Certificate": "income_certificate", "Birth Certificate": "birth_certificate", "Community Certificate": "community_certificate", "Aadhaar Card": "aadhaar", "PAN Card": "pan_card", "Driving Licence": "driving_licence"}
    return case_of([(kind == k, F.lit(v)) for k, v in named.items()], F.lit("generic"))


def extract_certificate(c: Column) -> Column:
    a = F.upper(found(c, I + r"\b(TN-[A-Z0-9\-]{8,24})\b"))
    b = F.concat(F.lit("TN-"), F.substr(found(c, I + r"\b(TN[0-9]{10,18})\b"), F.lit(3)))
    label = found(c, I + r"(?:Certificate\s*(?:Number|No\.?)|சான்றிதழ்\s*எண்|unique\s*certificate\s*number)[^\w\n]*([A-Z0-9\-/]+)")
    label = let(label, lambda s: F.when(F.length(s) >= 6, F.when(F.upper(s).startswith("TN") & ~F.upper(s).startswith("TN-"), F.concat(F.lit("TN-"), F.substr(s, F.lit(3)))).otherwise(s)))
    other = found(c, I + r"(?:Cert(?:ificate)?|Reg(?:istration)?)\s*(?:No\.?|#)\s*[:\-]?\s*([A-Z0-9\-/]+)")
    return F.coalesce(F.regexp_replace(a, r"^-+|-+$", ""), b, label, let(other, lambda s: F.when(F.length(s) >= 6, s)))


def grouped(digits: Column) -> Column:
    return F.concat(F.substr(digits, F.lit(1), F.lit(4)), F.lit(" "), F.substr(digits, F.lit(5), F.lit(4)), F.lit(" "), F.substr(digits, F.lit(9)))


def extract_aadhaar(c: Column) -> Column:
    label = F.regexp_replace(found(c, I + r"Your\s+Aadhaar\s+No[^\d\n]*\n\s*([2-9]\d{3}\s?\d{4}\s?\d{4})"), r"\s+", "")
    spaced = found(c, r"(?<!\d)(?<!VID\s)(?<!VID:\s)\b([2-9]\d{3}\s\d{4}\s\d{4})(?!\s\d{4})\b")
    vid = F.regexp_replace(F.regexp_extract(c, I + r"\bVID\s*[:\-]?\s*(\d{4}\s\d{4}\s\d{4}\s\d{4})\b", 1), " ", "")
    runs = F.filter(F.regexp_extract_all(c, F.lit(r"(?<!\d)([2-9]\d{11})(?!\d)"), F.lit(1)), lambda m: ~vid.startswith(m))
    return F.coalesce(let(label, lambda s: grouped(F.when(F.length(s) == 12, s))), spaced, let(F.try_element_at(runs, F.lit(1)), grouped))


def _in_range(d: Column, m: Column, y: Column) -> Column:
    return y.try_cast("int").between(1950, 2030) & m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)


def extract_date(c: Column) -> Column:
    """The labelled date if it is in range, else the first in range; no calendar check."""
    p = I + r"(?:Date|நாள்)\s*[:\-]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{4})"
    parts = lambda x: F.split(x, "[/-]")
    show = lambda x: F.concat_ws("-", F.lpad(x[0], 2, "0"), F.lpad(x[1], 2, "0"), x[2])
    labelled = let(parts(F.regexp_extract(c, p, 1)), lambda x: F.when((F.size(x) == 3) & _in_range(x[0], x[1], x[2]), show(x)))
    every = F.transform(F.regexp_extract_all(c, F.lit(_DATE), F.lit(0)), parts)
    first = let(F.try_element_at(F.filter(every, lambda x: _in_range(x[0], x[1], x[2])), F.lit(1)), lambda x: F.when(x.isNotNull(), show(x)))
    return F.coalesce(labelled, first)


def clean_name(c: Column) -> Column:
    s = F.regexp_replace(F.trim(c), I + r"^(?:This is to certify that|certify that|Thiru|Tmt|Selvan|Selvi|Mr\.?|Mrs\.?|Ms\.?|Shri|Smt\.?|Dr\.?)\s+", "")
    s = F.regexp_replace(s, I + r"\s+(?:son|daughter|wife|s/o|d/o|w/o|residing|rcsiding|at Door|Door|Village|Town|Taluk|District)[^\n]*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}_\s.]", ""), r"\s+", " "))


def valid_name(c: Column) -> Column:
    def checked(s: Column) -> Column:
        words = F.transform(F.regexp_extract_all(s, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))
        letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
        good = F.length(s).between(2, 60) & let(words, lambda w: (F.size(w) > 0) & ~F.arrays_overlap(w, F.array(*map(F.lit, vocab.NOT_NAMES)))) & (letters / F.length(s) >= 0.6)
        return F.when(good, s)

    return let(c, lambda x: F.when(~blank(x), let(clean_name(x), checked)))


def extract_pan(c: Column) -> Column:
    label = F.upper(found(c, I + r"(?:PAN|Permanent\s+Account\s+Number)[^\w\n]*([A-Z0-9]{10})\b"))
    return F.coalesce(found(c, r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"), let(label, lambda s: F.when(s.rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]$"), s)))


def extract_licence(c: Column) -> Column:
    a = F.upper(F.trim(F.regexp_replace(found(c, I + r"\b([A-Z]{2}[- ]?\d{2}[- ]?\d{4}[- ]?\d{7})\b"), r"\s+", " ")))
    b = F.upper(found(c, I + r"\b([A-Z]{2}[0-9]{2}\s?[0-9]{11})\b"))
    label = F.upper(some(found(c, I + r"(?:DL\s*No\.?|Licence\s*No\.?|License\s*No\.?)[^\w\n]*([A-Z0-9\-\s/]{8,20})")))
    return F.coalesce(a, b, let(label, lambda s: F.when((F.length(s) >= 8) & s.rlike(r"\d"), s)))


def taluk_district(taluk: Column) -> Column:
    """District of a taluk, from a literal map of fixed size."""
    pairs = F.create_map(*[F.lit(x) for kv in vocab.TALUKS.items() for x in kv])
    return F.try_element_at(pairs, F.lower(F.trim(taluk)))


def district_in_text(c: Column) -> Column:
    """First district, in list order, that occurs as a word; else that of a taluk that is named."""
    fold = lambda w: F.lower(F.translate(w, "ıſKİ", "iski"))  # noqa: E731  the other letters that match an ASCII one in either case
    words = F.regexp_extract_all(c, F.lit(I + rf"\b(?:{'|'.join(vocab.DISTRICTS)})\b"), F.lit(0))
    first = lambda w: F.initcap(F.get(F.array_intersect(F.array(*[F.lit(d.lower()) for d in vocab.DISTRICTS]), F.transform(w, fold)), 0))
    hit = let(words, lambda w: F.when(F.size(w) > 0, first(w)))
    return F.coalesce(hit, taluk_district(found(c, I + r"\b([A-Za-z]{4,15})\s+Taluk\b")))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by rows of the usual table, held in one array."""
    chars = lambda s: F.filter(F.split(s, ""), lambda x: x != "")

    def table(bs: Column) -> Column:
        def row(acc: Column, ch: Column) -> Column:
            step = lambda r, j: F.array_append(r, F.when(F.element_at(bs, (j + 1).cast("int")) == ch, F.element_at(acc, (j + 1).cast("int")) + 1).otherwise(F.greatest(F.element_at(acc, (j + 2).cast("int")), F.element_at(r, -1))))
            return F.aggregate(F.sequence(F.lit(0), F.size(bs) - 1), F.array(F.lit(0)), step)

        return F.element_at(F.aggregate(chars(a), F.array_repeat(F.lit(0), F.size(bs) + 1), row), -1)

    return F.when((a == "") | (b == ""), 0).otherwise(let(chars(b), table))


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda x: x != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (length + length) of the texts with their words sorted."""
    ratio = lambda x, y: F.when((x == "") & (y == ""), 100.0).otherwise(lcs_length(x, y) * 200.0 / (F.length(x) + F.length(y)))
    return let(F.struct(sorted_tokens(a).alias("x"), sorted_tokens(b).alias("y")), lambda s: ratio(s["x"], s["y"]))


def context(text: Column, value: Column, window: int = 50) -> Column:
    """What surrounds a value in a text, in one line; where the value isn't found, its first word of three letters or more."""
    v = F.trim(value)
    word = F.substring_index(v, " ", 1)
    pos = F.instr(F.lower(text), F.lower(v))
    pos = F.when(pos > 0, pos).when(F.length(word) >= 3, F.instr(F.lower(text), F.lower(word))).otherwise(0) - 1
    start = F.greatest(F.lit(0), pos - window)
    end = F.least(F.length(text), pos + F.length(v) + window)
    piece = F.trim(F.regexp_replace(F.substr(text, start + 1, end - start), "\n", " "))
    out = F.concat(F.when(start > 0, "...").otherwise(""), piece, F.when(end < F.length(text), "...").otherwise(""))
    return F.when(blank(value) | F.coalesce(text == "", F.lit(True)) | (pos < 0), "").otherwise(out)
