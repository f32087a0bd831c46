"""Plain-English questions about records: entities, predicates, a read-only guard."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

# How questions name types and districts, and words that are no names.
QUESTION_TYPES = {
    "Income Certificate": [r"income\s+cert", r"income", r"annual\s+income"],
    "Birth Certificate": [r"birth\s+cert", r"birth", r"date\s+of\s+birth"],
    "Community Certificate": [r"community\s+cert", r"community", r"caste"],
    "Aadhaar Card": [r"aadhaar", r"aadhar", r"uidai"],
    "Student Permission Form": [r"student\s+permission", r"permission\s+form", r"permission", r"student\s+form"],
}
QUESTION_DISTRICTS = "Ariyalur Chengalpattu Chennai Coimbatore Cuddalore Dharmapuri Dindigul Erode Kallakurichi Kanchipuram Kanyakumari Karur Krishnagiri Madurai Mayiladuthurai Nagapattinam Namakkal Nilgiris Perambalur Pudukkottai Ramanathapuram Ranipet Salem Sivagangai Tenkasi Thanjavur Theni Thoothukudi Tiruchirappalli Trichy Tirunelveli Tirupathur Tiruppur Tiruvallur Tiruvannamalai Tiruvarur Vellore Viluppuram Virudhunagar".split()
COMMANDS = set("search show find list get how what check tell view income birth community aadhaar student permission form certificate card records documents document record all roll number date year district".split())
NO_QUESTION = "Please type a question or choose a prompt to search government records."
NO_STORE = "Database file not found. Please upload documents first."
FIRST_SUGGESTIONS = ["Show all income certificates", "How many documents are digitized?", "Find records in Tiruppur"]
FREE_TEXT = ("citizen_name", "district", "document_type", "certificate_number", "ocr_text", "extra_fields")
SUGGESTIONS = ["Show all income certificates", "Find records from Tiruppur", "How many documents are digitized?", "Check prevented duplicates"]


class UnsafeSQL(ValueError):
    pass


def guard(sql: str) -> None:
    """Raise UnsafeSQL unless the statement only reads."""
    up = sql.strip().upper()
    if not up.startswith("SELECT"):
        raise UnsafeSQL("only SELECT is allowed")
    if "--" in up or ";" in up or re.search(r"\bREPLACE INTO\b|\b(?:" + "|".join(vocab.FORBIDDEN_SQL) + r")\b", up):
        raise UnsafeSQL("the statement may write")


def is_safe(sql: Column) -> Column:
    """The guard on a column of statements."""
    up = F.upper(F.regexp_replace(sql, r"^\s+|\s+$", ""))
    return up.startswith("SELECT") & ~up.rlike(r"--|;|\bREPLACE INTO\b|\b(?:" + "|".join(vocab.FORBIDDEN_SQL) + r")\b")


def entities(question: str) -> dict[str, str]:
    low, out = question.lower(), {}
    for kind, patterns in QUESTION_TYPES.items():
        if any(re.search(rf"\b{p}\b", low) for p in patterns):
            out["document_type"] = kind
            break
    if d := next((d for d in QUESTION_DISTRICTS if re.search(rf"\b{d.lower()}\b", low)), None):
        out["district"] = d
    for key, pattern, flags in (("certificate_number", r"\b(TN-[A-Za-z0-9\-]+)\b", re.I), ("roll_number", r"\b(\d{2}[A-Za-z]{2,4}[A-Za-z0-9]{2,4})\b", 0), ("aadhaar_number", r"\b(\d{4}\s?\d{4}\s?\d{4})\b", 0), ("year", r"\b(20\d{2})\b", 0)):
        if m := re.search(pattern, question, flags):
            out[key] = m[1].upper()
    places = {d.lower() for d in QUESTION_DISTRICTS}
    if m := re.search(r"(?:for|named|citizen|student|applicant|person|name\s*(?:is|:)?)\s+([A-Za-z]+(?:\s+[A-Za-z\.]*)?)", question, re.I):
        name, test = m[1].strip(), m[1].strip().lower()
    elif m := re.search(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+|\s+[A-Z]\.?))\b", question):
        name, test = m[1].strip(), m[1].split()[0].lower()
    else:
        return out
    if test not in COMMANDS and test not in places:
        out["name"] = name
    return out


def entities_of(questions: Column) -> Column:
    """`entities` on a column of questions: map from kind to value; nulls have none."""

    @F.pandas_udf("map<string,string>")
    def find(q: pd.Series) -> pd.Series:
        return q.map(lambda x: entities(x) if isinstance(x, str) else {})

    return find(questions)


def _like(column: str, term: str) -> Column:
    # % and _ of a term are wildcards, as in the store's own LIKE; the escape sign occurs in no term
    return F.ilike(F.col(column), F.lit(f"%{term}%"), F.lit("\x01"))


def _conditions(question: str, found: dict[str, str]) -> list[tuple[Callable[[], Column], str, list[str]]]:
    """What a question about documents asks for: each condition as a filter, and as text with its bindings."""
    out: list[tuple[Callable[[], Column], str, list[str]]] = []
    if kind := found.get("document_type"):
        out.append((lambda: F.col("document_type") == kind, "document_type = ?", [kind]))
    if place := found.get("district"):
        out.append((lambda: _like("district", place), "LOWER(district) LIKE ?", [f"%{place.lower()}%"]))
    for number in (found[k] for k in ("certificate_number", "roll_number") if k in found):
        out.append((lambda number=number: (F.col("certificate_number") == number) | _like("extra_fields", number), "(certificate_number = ? OR extra_fields LIKE ?)", [number, f"%{number}%"]))
    if "aadhaar_number" in found:
        n = found["aadhaar_number"].replace(" ", "")
        bare = lambda: F.contains(F.replace("aadhaar_number", F.lit(" "), F.lit("")), F.lit(n))
        out.append((lambda: bare() | _like("extra_fields", n), "(REPLACE(aadhaar_number, ' ', '') LIKE ? OR extra_fields LIKE ?)", [f"%{n}%"] * 2))
    if year := found.get("year"):
        out.append((lambda: _like("issue_date", year) | _like("upload_date", year), "(issue_date LIKE ? OR upload_date LIKE ?)", [f"%{year}%"] * 2))
    if name := found.get("name"):
        out.append((lambda: _like("citizen_name", name), "LOWER(citizen_name) LIKE ?", [f"%{name.lower()}%"]))
    if out or counts(question):
        return out
    words = [w for w in re.findall(r"\w+", question.lower()) if len(w) > 2 and w not in vocab.STOP_WORDS][:3]
    anywhere = lambda w: reduce(or_, [F.coalesce(_like(c, w), F.lit(False)) for c in FREE_TEXT])
    said = "(" + " OR ".join(f"LOWER({c}) LIKE ?" for c in FREE_TEXT) + ")"
    return [(lambda w=w: anywhere(w), said, [f"%{w}%"] * len(FREE_TEXT)) for w in words]


def predicate(question: str, found: dict[str, str]) -> Column | None:
    """The filter that a question about documents stands for; None for all."""
    conds = [c() for c, _, _ in _conditions(question, found)]
    return reduce(and_, conds) if conds else None


def display_sql(question: str, found: dict[str, str], bound: bool = True) -> str:
    """A question as the statement that a reader is shown, with its bindings in a comment; nothing runs it."""
    kind = intent(question)
    if kind.endswith("duplicates"):
        return "SELECT COUNT(*) FROM duplicate_logs" if counts(question) else "SELECT id, filename, reason, detected_at FROM duplicate_logs ORDER BY id DESC LIMIT 10"
    conds = _conditions(question, found)
    texts = [t for _, t, _ in conds]
    if any(t.startswith("(LOWER(citizen_name)") for t in texts):  # free text is one condition
        texts = ["(" + " AND ".join(texts) + ")"]
    sql = f"SELECT {'COUNT(*)' if counts(question) else '*'} FROM government_documents" + (" WHERE " + " AND ".join(texts) if texts else "")
    sql += "" if counts(question) else " ORDER BY id DESC LIMIT 15"
    bindings = [x for _, _, b in conds for x in b]
    return sql + (f" /* bindings: {", ".join(f"'{x}'" for x in bindings)} */" if bound and bindings else "")


def counts(question: str) -> bool:
    return any(k in question.lower() for k in ("how many", "count", "total", "number of"))


def intent(question: str) -> str:
    what = "duplicates" if any(k in question.lower() for k in ("duplicate", "blocked", "prevented", "rejected")) else "records"
    return ("count_" if counts(question) else "search_") + what


def ask(question: str, records: DataFrame, log: DataFrame) -> DataFrame:
    """A count, or the newest 15 documents or 10 blocked uploads, that answer a question."""
    kind = intent(question)
    if kind.endswith("duplicates"):
        return log.agg(F.count("*").alias("n")) if kind.startswith("count") else log.orderBy(F.desc("id")).limit(10)
    where = predicate(question, entities(question))
    hits = records if where is None else records.filter(where)
    return hits.agg(F.count("*").alias("n")) if kind.startswith("count") else hits.orderBy(F.desc("id")).limit(15)


def answer(question: str, found: dict[str, str], n: int, rows: list[dict]) -> str:
    """The sentence for a question's result."""
    kind = intent(question)
    if kind == "count_duplicates":
        return f"The deduplication engine has prevented {n} duplicate document upload attempt(s) so far."
    if kind == "count_records":
        if "document_type" in found:
            return f"Found {n} registered {found['document_type']}(s) in the database."
        if "district" in found:
            return f"Found {n} digitized record(s) from {found['district']} district."
        return f"There are currently {n} digitized government document record(s) in the platform."
    if kind == "search_duplicates":
        return f"Retrieved {n} prevented duplicate attempt(s) from the audit log." if n else "No duplicate upload attempts have been recorded. All documents uploaded are unique."
    if n == 0:
        parts = [f"{k} '{found[f]}'" for k, f in (("type", "document_type"), ("district", "district"), ("name", "name")) if f in found]
        return f"No digitized records found{' with ' + ', '.join(parts) if parts else ''}. Try searching by a different name, district, or certificate number."
    if n == 1:
        r = rows[0]
        when = r.get("issue_date") or r.get("upload_date")
        number = r.get("certificate_number") or _json(r.get("extra_fields")).get("Roll Number") or "N/A"
        return f"Found 1 {r.get('document_type') or 'Document'} for {r.get('citizen_name') or 'Citizen'} in {r.get('district') or 'Tamil Nadu'} (Certificate/ID: {number}{' issued on ' + when if when else ''}){_standing(r)}"
    kinds = sorted({r.get("document_type") or "Document" for r in rows})
    return f"Found {n} matching records ({', '.join(kinds[:2])}). You can inspect any record using the cards below."


def _json(text: str | None) -> dict:
    try:
        out = json.loads(text or "{}")
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def _standing(r: dict) -> str:
    """How far a record has been looked at, as the end of a sentence."""
    if _json(r.get("field_corrections")):
        return f" (Status: Human-reviewed with verified corrections by {r.get('verified_by') or 'Officer'})."
    status = r.get("verification_status")
    # What the statuses of a machine are called.
    named = {"auto_verified": "Automated consistency and quality checks passed", "needs_review": "OCR-extracted, pending human review"}
    return f" (Status: {named.get(status) or status.replace('_', ' ').title()})." if status else ""


@dataclass
class Response:
    query: str
    intent: str
    sql: str
    answer: str
    count: int = 0
    records: list[dict] = field(default_factory=list)
    suggestions: list[str] = field(default_factory=lambda: list(SUGGESTIONS))
    is_count: bool = False


def process(question: str | None, records: DataFrame | None, log: DataFrame | None) -> Response:
    """A question from its text to its answer; at most 15 rows reach the driver.

    Intent "empty" without a question, "error" where the search fails. Without
    a store (None) the answer says so.
    """
    asked = (question or "").strip()
    if not asked:
        return Response("", "empty", "", NO_QUESTION, suggestions=list(FIRST_SUGGESTIONS))
    found, kind = entities(asked), intent(asked)
    bare = display_sql(asked, found, bound=False)
    guard(bare)
    if records is None or log is None:
        return Response(asked, kind, bare, NO_STORE)
    try:
        rows = [r.asDict() for r in ask(asked, records, log).collect()]
    except (PySparkException, Py4JError) as e:
        return Response(asked, "error", bare, f"Could not execute query: {e}")
    number = rows[0]["n"] if counts(asked) else len(rows)
    said = answer(asked, found, number, rows)
    rows = [] if counts(asked) else [{**r, "extra_fields": _json(r["extra_fields"])} if isinstance(r.get("extra_fields"), str) else r for r in rows]
    return Response(asked, kind, display_sql(asked, found), said, number, rows, is_count=counts(asked))


def respond(question: str | None, records: DataFrame | None, log: DataFrame | None) -> str:
    """The sentence that answers a question."""
    return process(question, records, log).answer
