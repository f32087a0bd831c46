"""Replacing personal data by surrogates, on built-in expressions only.

Detection is one regular expression with an alternative for each type: e-mail
addresses, IBANs, phone numbers, IPv4 and IPv6 addresses, card numbers, social
security numbers, long hexadecimal secrets, keys with a service's prefix, and
names after a title.

A surrogate is of the entity's type and format: digits become digits, letters
become letters of the same case and script (Latin, Greek, Cyrillic), separators
stay; addresses keep four octets from 0 to 255, e-mails get a mail domain
reserved for examples, cards that pass the Luhn test and IBANs that pass theirs
get check digits that pass it. Of names the title stays, first names come from
lists of the script and gender (the title's, else the name's own), and surnames
are made of syllables of the script. A surname has the same surrogate with any
title and first name, so "Mr Smith" and "Dr Ann Smith" stay relatives. All of it
follows from SHA-512 of a secret key, the type, the entity (case folded) and an
attempt number, so an entity has the same surrogate wherever it occurs.

Distinctness is checked over the corpus: where different entities draw one
surrogate, or a surrogate is itself an entity of the corpus, all but the first
draw again with the next attempt, until nothing collides. Later attempts are
longer (a syllable, a second first name, a suffix), so no format runs out. Rounds
work on tables of distinct entities, surnames first; documents are only joined to
the surrogates of the entities they hold, by a digest of the document, and
documents without entities are not shuffled at all. Entities that make up more
than a HOT-th of all mentions are at most HOT; these are broadcast, so no
frequent entity is one task's work.

Results in special cases: null texts stay null with no entities; overlapping
matches count once, the leftmost and then the first type in the list; repeated
rows get equal results; null ids are treated like others; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: An entity is frequent if it has more than this share of all mentions: 1 in HOT.
HOT = 1000
#: Attempts after which a surrogate gets longer.
PATIENCE = 3
# What counts as an entity, titles and first names.
MALE_TITLES, FEMALE_TITLES, OTHER_TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur"), ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme"), ("Dr", "Prof")
MALE = {
    "Latin": "Adam Alain Andreas Bruno Carl Carlos David Diego Emil Felix Georg Hugo Ivan Jan Jean Jonas Karl Leo Louis Luis Marco Martin Max Miguel Noah Oscar Paul Pedro Peter Pierre Rafael Simon Stefan Thomas Tom Victor".split(),
    "Cyrillic": "Алексей Андрей Борис Виктор Денис Егор Игорь Кирилл Лев Максим Никита Олег Павел Роман Сергей Юрий".split(),
    "Greek": "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Λεωνίδας Μάριος Νίκος Πέτρος Σπύρος Χρήστος".split(),
}
FEMALE = {
    "Latin": "Alice Ana Anna Bella Carla Carmen Clara Claire Diana Elena Emma Eva Greta Helen Ida Ines Irene Jana Julia Laura Lea Lena Lucia Maria Marie Marta Mia Nina Nora Olga Paula Rosa Sara Sofia Sophie Vera".split(),
    "Cyrillic": "Алина Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лариса Марина Нина Ольга Полина Светлана Юлия".split(),
    "Greek": "Αγγελική Άννα Βασιλική Δήμητρα Ειρήνη Ελένη Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
}
#: What surnames begin with, have inside, and end with.
SURNAMES = {
    "Latin": ("Al Bar Ber Bor Cal Dan Del Dor Fal Far Gar Gor Hal Har Hol Jan Kel Kor Lan Lin Mar Mor Nor Pal Per Ral Ros Sal Tor Val Wal Wil".split(), "ba be bi bo da de di do fa fe la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te ti to va ve".split(), "berg den der dorf field ford ham hart ley man mann mer mont nard ner rell sen son stein ton vale ville well win".split()),
    "Cyrillic": ("Бел Бор Вар Вол Гор Дан Ден Зар Зим Кал Кор Лан Лар Мар Мед Мор Нов Пав Пол Род Сав Сел Тар Тим".split(), "ба бе ва ве го да де ди за ка ла ле ли ма ме ми на не ни ра ре ро са та те то".split(), "ев енко ич ов ский ченко ук як".split()),
    "Greek": ("Αλ Βασ Γαλ Δημ Ευαγ Ζαφ Θεο Καρ Κων Λαμ Μαρ Νικ Παπ Πετ Σαβ Σταμ Τριαν Χατζ".split(), "βα γε δα δι κα κο λα λι μα με να νι ρα ρο σα τα τι".split(), "άκης έας ίδης όπουλος άτος".split()),
}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAME_WORD = r"[\p{Lu}][\p{L}'’-]+"
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])",
    "apikey": r"\b(?:(?:sk|pk|rk)[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{16,}|gh[opsu]_[A-Za-z0-9]{30,}|xox[abp]-[A-Za-z0-9-]{20,}|AKIA[0-9A-Z]{16})\b",
    "hex": r"\b(?=[0-9A-Fa-f]*\d)(?=[0-9A-Fa-f]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])",
    "name": rf"\b(?:{'|'.join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES))})\.? {_NAME_WORD}(?: {_NAME_WORD})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap signs without which no pattern can fit.
HINT = rf"@|\d{{2}}|\d\.\d|[0-9A-Fa-f]{{32}}|[0-9A-Fa-f]:[0-9A-Fa-f:]|[sprk]k[-_]|gh[opsu]_|xox[abp]-|AKIA|\b(?:{'|'.join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES))})\.? \p{{Lu}}"
_LATIN_UP, _LATIN_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GREEK_UP, _GREEK_LOW = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "αβγδεζηθικλμνξοπρστυφχψω"
_CYR_UP, _CYR_LOW = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "абвгдежзиклмнопрстуфхцчшщэюя"


def type_of(entity: Column) -> Column:
    """The first type whose pattern fits the whole entity."""
    out = None
    for kind, pattern in PATTERNS.items():
        fits = entity.rlike(f"^(?:{pattern})$")
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out


def _draw(seed: Column, place: Column | int) -> Column:
    """A number from 0 to 4095 for a place of an entity. Places beyond the seed's digits take later ones of it, shifted by their turn."""
    p = place if isinstance(place, Column) else F.lit(place)
    at = (p * 3) % 126 + 1
    return (F.conv(F.substr(seed, at.cast("int"), F.lit(3)), 16, 10).cast("int") + F.floor(p * 3 / 126).cast("int") * 1543) % 4096


def _pick(options: str, n: Column) -> Column:
    return F.substr(F.lit(options), (n % len(options) + 1).cast("int"), F.lit(1))


def _shape(entity: Column, seed: Column, hexadecimal: Column) -> Column:
    """Characters of the same kind, case and script; all others as they are."""

    def one(c: Column, i: Column) -> Column:
        n = _draw(seed, i)
        return (
            F.when(c.between("0", "9") & ~(((i == 0) | ((i == 1) & entity.startswith("+"))) & (c != "0")), _pick("0123456789", n))
            .when(c.between("0", "9"), _pick("123456789", n))
            .when(hexadecimal & c.between("a", "f"), _pick("abcdef", n))
            .when(hexadecimal & c.between("A", "F"), _pick("ABCDEF", n))
            .when(c.between("A", "Z"), _pick(_LATIN_UP, n))
            .when(c.between("a", "z"), _pick(_LATIN_LOW, n))
            .when(c.rlike(r"\p{IsGreek}") & c.rlike(r"\p{Lu}"), _pick(_GREEK_UP, n))
            .when(c.rlike(r"\p{IsGreek}"), _pick(_GREEK_LOW, n))
            .when(c.rlike(r"\p{IsCyrillic}") & c.rlike(r"\p{Lu}"), _pick(_CYR_UP, n))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYR_LOW, n))
            .when(c.rlike(r"\p{IsLatin}") & c.rlike(r"\p{Lu}"), _pick(_LATIN_UP, n))
            .when(c.rlike(r"\p{IsLatin}"), _pick(_LATIN_LOW, n))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, from its end."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (c.cast("int") * (i % 2 + 1)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals, A being 10."""
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(word.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")


def _by_script(script: Column, of: dict, made) -> Column:
    """made(options) for the script's options."""
    return F.when(script == "Cyrillic", made(of["Cyrillic"])).when(script == "Greek", made(of["Greek"])).otherwise(made(of["Latin"]))


def _one_of(options: list[str], n: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(options)), " "), (n % len(options) + 1).cast("int"))


def _cased(word: Column, like: Column) -> Column:
    return F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(word)).otherwise(word)


def name_parts(entity: Column) -> tuple[Column, Column, Column, Column]:
    """(title with its space, first name or "", surname, gender m, f or "") of a name."""
    title, rest = F.regexp_extract(entity, r"^(\p{L}+\.? )", 1), F.regexp_replace(entity, r"^\p{L}+\.? ", "")
    first, last = F.when(F.instr(rest, " ") > 0, F.substring_index(rest, " ", 1)).otherwise(""), F.substring_index(rest, " ", -1)
    bare = F.regexp_replace(title, r"\W+$", "")
    known = lambda of: first.isin(*[n for names in of.values() for n in names])
    gender = F.when(bare.isin(*MALE_TITLES), "m").when(bare.isin(*FEMALE_TITLES), "f").when(known(MALE), "m").when(known(FEMALE), "f").otherwise("")
    return title, first, last, gender


def _faced(entity: Column, kind: Column) -> Column:
    """What must differ between surrogates: names without their titles, all else as a whole, case folded."""
    return F.lower(F.when(kind == "name", F.regexp_replace(entity, r"^\p{L}+\.? ", "")).otherwise(entity))


def identified(entities: DataFrame) -> DataFrame:
    """With `same`, what two mentions of one entity (entity, kind) have in common, and the parts of names."""
    x = entities.withColumns(dict(zip(("title", "first", "last", "gender"), name_parts(F.col("entity")), strict=True)))
    of_name = F.when(F.col("first") != "", F.lower(F.concat_ws(" ", "gender", "first", "last"))).otherwise(F.lower("last"))
    return x.withColumn("same", F.when(F.col("kind") == "name", of_name).otherwise(F.lower("entity")))


def drawn(entities: DataFrame, key: str, out: str = "surrogate") -> DataFrame:
    """With what stands for each of `identified` entities at its `attempt`: a pure function of the columns. `family` stands for a name's surname."""
    entity, kind, attempt, seed = (F.col(c) for c in ("entity", "kind", "attempt", "_seed"))
    # each projection names what the next one uses more than once
    x = entities.withColumn("_seed", F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "same", attempt.cast("string")).cast("binary"), 512))
    # formats that hold few entities grow when attempts fail
    more = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / PATIENCE).cast("int")), lambda k: F.when(k > 0, _pick("0123456789", _draw(seed, k + 11))).otherwise("")), "")
    male = (F.col("gender") == "m") | ((F.col("gender") == "") & (_draw(seed, 3) % 2 == 0))
    x = x.withColumns({"_shaped": _shape(entity, seed, kind.isin("hex", "ipv6")), "_more": more, "_script": _script(F.when(kind == "name", F.col("first")).otherwise(entity)), "_male": male})
    shaped, more, script = F.col("_shaped"), F.col("_more"), F.col("_script")
    names = lambda of: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / PATIENCE).cast("int")), lambda k: _by_script(script, of, lambda options: _one_of(options, _draw(seed, k + 6)))), "-")
    inner = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / PATIENCE).cast("int")), lambda k: F.when(k > 0, _by_script(script, SURNAMES, lambda parts: _one_of(parts[1], _draw(seed, k + 4)))).otherwise("")), "")
    surname = F.concat(_by_script(script, SURNAMES, lambda parts: _one_of(parts[0], _draw(seed, 1))), inner, _by_script(script, SURNAMES, lambda parts: _one_of(parts[2], _draw(seed, 2))))
    only, tight, land = F.regexp_replace(entity, r"\D", ""), F.replace(entity, F.lit(" "), F.lit("")), F.substr(entity, F.lit(1), F.lit(2))
    turned = lambda t, digits: F.concat(F.substr(t, F.lit(5), F.length(t)), F.substr(t, F.lit(1), F.lit(2)), digits)
    x = x.withColumns({
        "_first": F.when((kind == "name") & (F.col("first") != ""), F.when(F.col("_male"), names(MALE)).otherwise(names(FEMALE))),
        "_surname": F.when(kind == "surname", surname),
        "_made": F.when(kind == "card", F.regexp_replace(shaped, r"\D", "")),
        "_luhn": F.when(kind == "card", _luhn(only) % 10 == 0),
        "_account": F.when(kind == "iban", F.concat(land, F.lit("00"), F.replace(F.substr(shaped, F.lit(5), F.length(shaped)), F.lit(" "), F.lit("")))),
        "_valid": F.when(kind == "iban", _mod97(turned(tight, F.substr(tight, F.lit(3), F.lit(2)))) == 1),
    })
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    reserved = _one_of([f"example.{t}" for t in ("com", "net", "org")], _draw(seed, 41))
    mail = F.concat(F.substr(shaped, F.lit(1), F.length(local)), more, F.lit("@"), F.when(F.instr(domain, ".") < F.length(domain), F.concat(F.lit("mail"), (_draw(seed, 40) % 1000).cast("string"), F.lit("."), reserved)))
    octets = F.concat_ws(".", *[((_draw(seed, 30 + k) % (223 if k == 0 else 256)) + (1 if k == 0 else 0)).cast("string") for k in range(4)])
    made = F.col("_made")
    check = ((10 - _luhn(F.concat(F.substr(made, F.lit(1), F.length(made) - 1), F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(F.col("_luhn"), F.concat(F.substr(shaped, F.lit(1), F.length(shaped) - 1), check)).otherwise(shaped)
    iban = F.concat(land, F.when(F.col("_valid"), F.lpad((98 - _mod97(turned(F.col("_account"), F.lit("00")))).cast("string"), 2, "0")).otherwise(F.substr(shaped, F.lit(3), F.lit(2))), F.substr(shaped, F.lit(5), F.length(shaped)))
    name = F.concat(F.col("title"), F.coalesce(F.concat(_cased(F.col("_first"), F.col("first")), F.lit(" ")), F.lit("")), _cased(F.col("family"), F.col("last")))
    mark = F.regexp_extract(entity, r"^(?:[sprk]k[-_](?:(?:live|test|proj)[-_]?)?|gh[opsu]_|xox[abp]-|AKIA)", 0)  # which service's it is
    grown = lambda c, sep: F.when(more != "", F.concat(c, F.lit(sep), more)).otherwise(c)
    said = F.when(kind == "surname", F.col("_surname")).when(kind == "email", mail).when(kind == "ip", grown(octets, ":")).when(kind == "card", grown(card, "-")).when(kind == "iban", grown(iban, " ")).when(kind == "name", name).when(kind == "apikey", F.concat(mark, F.substr(grown(shaped, ""), F.length(mark) + 1, F.lit(1 << 20)))).otherwise(grown(shaped, "-"))
    return x.withColumn(out, said).select(*entities.columns, out)


def _settle(base: DataFrame, key: str, max_rounds: int) -> DataFrame:
    """(kind, same, attempt) of `identified` entities: the first attempts at which all surrogates of a kind differ and none is an entity's face."""
    settled = None
    open_ = base.withColumn("attempt", F.lit(0))
    faces = materialize(base.select("kind", _faced(F.col("entity"), F.col("kind")).alias("out")).distinct())
    for _ in range(max_rounds):
        tried = drawn(open_, key, "out").withColumn("out", _faced(F.col("out"), F.col("kind")))
        taken = faces if settled is None else faces.union(settled.select("kind", "out"))
        rank = F.row_number().over(Window.partitionBy("kind", "out").orderBy("same"))
        judged = tried.withColumn("rank", rank).join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "out"], "left")
        judged = materialize(judged.select(*open_.columns, "out", ((F.col("rank") == 1) & F.col("taken").isNull()).alias("good")))
        good = judged.filter("good").select("kind", "same", "attempt", "out")
        settled = good if settled is None else settled.union(good)
        open_ = judged.filter("NOT good").drop("out", "good").withColumn("attempt", F.col("attempt") + 1)
        if open_.isEmpty():
            return settled.select("kind", "same", "attempt")
    raise RuntimeError("surrogates didn't become distinct")


def distinct_surrogates(entities: DataFrame, key: str, max_rounds: int = 60) -> DataFrame:
    """(entity, kind, surrogate) from distinct (entity, kind); no two different entities share a surrogate, and none is an entity. Case variants of an entity count as one."""
    known = identified(entities)
    surnames = known.filter("kind = 'name'").groupBy(F.lower("last").alias("same")).agg(F.min("last").alias("entity"))
    none = F.lit("")
    surnames = materialize(surnames.select("entity", F.lit("surname").alias("kind"), none.alias("title"), none.alias("first"), F.col("entity").alias("last"), none.alias("gender"), "same", none.alias("family")))
    families = drawn(surnames.join(_settle(surnames, key, max_rounds), ["kind", "same"]), key)
    families = materialize(families.select(F.col("same").alias("_last"), F.col("surrogate").alias("family")))
    known = known.withColumn("_last", F.when(F.col("kind") == "name", F.lower("last"))).join(families.hint("merge"), "_last", "left").drop("_last")
    known = materialize(known)
    one = F.min(F.struct(*[c for c in known.columns if c not in ("kind", "same")])).alias("one")
    base = materialize(known.groupBy("kind", "same").agg(one).select("kind", "same", "one.*"))
    return drawn(known.join(_settle(base, key, max_rounds), ["kind", "same"]), key).select("entity", "kind", "surrogate")


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text with surrogates, n_entities, kinds. Whoever has the key can match surrogates to entities."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    found = F.when(F.col("t").rlike(HINT), F.regexp_extract_all("t", F.lit(ANY), F.lit(0)))
    digest = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("t")).cast("binary"))
    spotted = rows.select("id", "t", F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    have = spotted.filter(F.size("found") > 0).select("id", "t", "found", digest.alias("k"))
    have = materialize(have)
    pairs = have.select("k", F.explode(F.array_distinct("found")).alias("entity")).distinct()
    entities = materialize(pairs.groupBy("entity").agg(F.count("*").alias("n")).withColumn("kind", type_of(F.col("entity"))))
    surrogates = materialize(distinct_surrogates(entities.select("entity", "kind"), key))
    many = (entities.agg(F.sum("n")).first()[0] or 0) // HOT
    hot = surrogates.join(entities.filter(F.col("n") > many).select("entity"), "entity", "left_semi") if many else surrogates.limit(0)
    cool = surrogates.join(entities.filter(F.col("n") <= many).select("entity"), "entity", "left_semi") if many else surrogates
    hot = F.broadcast(materialize(hot))  # fewer than HOT rows
    met = pairs.join(hot, "entity").unionByName(pairs.join(hot.select("entity"), "entity", "left_anti").join(cool, "entity"))
    maps = met.groupBy("k").agg(F.collect_list(F.struct("entity", "surrogate", "kind")).alias("m"))  # a document's own entities
    joined = have.join(maps, "k")
    lookup = F.map_from_entries(F.transform("m", lambda x: F.struct(x["entity"], x["surrogate"])))
    gaps = F.split("t", ANY, -1)
    text = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("found")), F.col("found"), lambda g, e: F.concat(g, F.element_at(F.col("lookup"), e))), ""), F.element_at(gaps, -1))
    out = joined.withColumn("lookup", lookup).select("id", text.alias("text"), F.size("found").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["kind"]))), ",").alias("kinds"))
    rest = spotted.filter(F.size("found") == 0).select("id", F.col("t").alias("text"), F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)
