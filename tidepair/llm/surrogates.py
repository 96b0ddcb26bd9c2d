"""Surrogates for personal data: keyed, of the same type and format, distinct and coreferent.

DataFrame expressions only. Entities are found by patterns; each gets a replacement that is a
keyed function of its canonical value, so one value has one surrogate everywhere. Numbers run
through a keyed permutation of their digits (a Feistel network by modular addition) and keep
separators, country code and checksum residue; addresses and names are spelled from keyed
letters of the same script, case and gender. Values whose surrogates meet each other, or meet a
value that occurs, are given new ones until none do.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.session import stage

#: The key is a parameter of every function; keep the one in use secret.
KEY = "change-me"
#: The session setting that names the key of the registered query.
KEY_SETTING = "spark.tidepair.surrogates.key"
ROUNDS = 4
#: From this attempt on, spelled surrogates grow by a few letters, so short formats can't run out.
LONGER = 2
#: Up to this attempt a surrogate may not occur as a value; later ones need only be distinct,
#: since the numbers in use may fill their whole space.
AVOID = 8

_NOT_IN = r"(?<![\p{L}\p{N}])"
_MALE = r"Mr\.?|Mister|Herrn?|Señor|Sr\.|Monsieur|господин"
_FEMALE = r"Mrs\.?|Ms\.?|Miss|Frau|Señora|Sra\.|Madame|Mme\.?|госпожа"
_EITHER = r"Dr\.|Prof\."
# Loops over groups are possessive throughout (nothing that follows could use what they give back):
# the matcher walks those, where it would recurse into others, so the length of a match is free.
_TOKEN = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}++(?:\p{Lu}\p{Ll}++)*+(?:[-'’]\p{Lu}\p{Ll}++)*+"
#: A title opens a name of its own.
_NAME = rf"(?!(?:{_MALE}|{_FEMALE}|{_EITHER}) )" + _TOKEN
_DOTTED = r"(?:\p{Lu}\.)(?:-?\p{Lu}\.)*+"
_INITIAL = rf"(?:{_DOTTED}|\p{{Lu}}(?![\p{{L}}\p{{N}}'’.-]))"
_PARTICLE = r"(?:[Vv][oa]n|vom|zu[mr]?|[Dd]e|del|[Dd]ella|den|der|des|[Dd]i|d[ao]s?|[Dd]u|l[aeo]s?|el|al|bin|ibn|te[rn]|y)(?![\p{L}\p{N}'’-])"
#: A name token with the few initials and particles in front of it.
_STEP = rf"(?:(?:{_INITIAL}|{_PARTICLE}) ){{0,6}}{_NAME}"
#: Patterns by kind, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "ip": _NOT_IN + r"(?<![0-9]\.)(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![\p{L}\p{N}]|\.[0-9])",
    "phone": _NOT_IN + r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}])",
    "ssn": _NOT_IN + r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}])",
    "card": _NOT_IN + r"(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{13,19})(?![\p{L}\p{N}])",
    "name": _NOT_IN + rf"(?:{_MALE}|{_FEMALE}|{_EITHER}) {_STEP}(?: {_STEP})*+(?: {_DOTTED})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

_SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "greek": "βα βε βο γα γε γο δα δε δι δο ζα ζε θα θε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε το φα φε".split(),
    "cyrillic": "ба бе би бо ва ве ви во да де ди до га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то".split(),
}
_ENDINGS = {"latin": {"given_f": "na", "given_m": "ron", "given": "lis", "surname": "mer"}, "greek": {"given_f": "να", "given_m": "ρων", "given": "λις", "surname": "μερ"}, "cyrillic": {"given_f": "на", "given_m": "рон", "given": "лис", "surname": "мер"}}
_ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}


def _noise(key: str, *of: Column) -> Column:
    return F.xxhash64(F.lit(key), *of)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _kind(raw: Column) -> Column:
    """Kind of a match; the patterns exclude each other on a whole match."""
    kind = F.when(F.contains(raw, F.lit("@")), "email")
    for name in ("ip", "ssn", "phone", "card"):
        kind = kind.when(raw.rlike(f"^(?:{PATTERNS[name]})$"), name)
    return kind.otherwise("name")


def _permuted(digits: Column, key: str, tweak: Column) -> Column:
    """Another digit string of the same length; a bijection for each length and tweak.

    Halves of at most ten digits are added to noise of each other, modulo powers of ten.
    """
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size_a, size_b = F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), n - half).cast("long")
    start = F.struct(
        F.coalesce(F.substring(digits, F.lit(1), half).try_cast("long"), F.lit(0).cast("long")).alias("a"),
        F.coalesce(F.substring(digits, half + 1, n - half).try_cast("long"), F.lit(0).cast("long")).alias("b"),
    )

    def turn(s, k):
        a = F.pmod(s["a"] + F.pmod(_noise(key, n, k, tweak, s["b"]), size_a), size_a)
        return F.struct(a.alias("a"), F.pmod(s["b"] + F.pmod(_noise(key, n, k + 100, tweak, a), size_b), size_b).alias("b"))

    pad = lambda s: F.concat(F.when(half > 0, F.lpad(s["a"].cast("string"), half, "0")).otherwise(""), F.lpad(s["b"].cast("string"), n - half, "0"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, pad)


def _luhn(digits: Column) -> Column:
    """The checksum of card numbers, modulo 10."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _card(value: Column, key: str, tweak: Column) -> Column:
    """All but the last digit permuted; the last keeps the checksum's residue."""
    body = _permuted(F.substring(value, F.lit(1), F.length(value) - 1), key, tweak)
    return F.concat(body, F.pmod(_luhn(value) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))


def _ip(value: Column, key: str, tweak: Column) -> Column:
    parts = F.transform(F.split(value, "[.]"), lambda x: x.cast("long"))
    start = F.struct((F.get(parts, 0) * 256 + F.get(parts, 1)).alias("a"), (F.get(parts, 2) * 256 + F.get(parts, 3)).alias("b"))

    def turn(s, k):
        a = F.pmod(s["a"] + _noise(key, k, tweak, s["b"]) % 65536, F.lit(65536))
        return F.struct(a.alias("a"), F.pmod(s["b"] + _noise(key, k + 100, tweak, a) % 65536, F.lit(65536)).alias("b"))

    octets = lambda s: F.concat_ws(".", *[f.cast("string") for h in ("a", "b") for f in (F.floor(s[h] / 256), s[h] % 256)])
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, octets)


def _phone(value: Column, key: str, tweak: Column) -> Column:
    """The country code (canonical values end it with a blank) stays, the rest is permuted."""
    code, rest = F.regexp_extract(value, r"^(\+[0-9]+ )?", 0), F.regexp_replace(value, r"^\+[0-9]+ ", "")
    return F.concat(code, _permuted(rest, key, tweak))


def _letter(c: Column, at: Column) -> Column:
    """A keyed letter of the script of ``c``."""
    pick = lambda s: F.substring(F.lit(_ALPHABETS[s]), (F.pmod(at, F.lit(len(_ALPHABETS[s]))) + 1).cast("int"), F.lit(1))
    out = F.when(c.rlike(_SCRIPTS["cyrillic"]), pick("cyrillic")).when(c.rlike(_SCRIPTS["greek"]), pick("greek"))
    return out.otherwise(pick("latin"))


def _email(value: Column, key: str, tweak: Column) -> Column:
    """The local part letter by letter and digit by digit; the domain under a reserved one."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)

    def other(i):
        c, at = F.substring(local, i, F.lit(1)), _noise(key, value, i, tweak)
        return F.when(c.rlike("[0-9]"), F.pmod(at, F.lit(10)).cast("string")).when(c.rlike(r"\p{L}"), _letter(c, at)).otherwise(c)

    spelled = F.array_join(F.transform(F.sequence(F.lit(1), F.length(local)), other), "")
    more = F.substring(F.translate(F.hex(_noise(key, value, tweak)), "0123456789ABCDEF", "bcdfghklmnprstvz"), 1, 6)
    spelled = F.concat(spelled, F.when(tweak >= LONGER, more).otherwise(""))
    host = F.translate(F.lpad(F.substring(F.hex(_noise(key, domain)), -8, 8), 8, "0"), "0123456789ABCDEF", "bcdfghklmnprstvz")
    return F.concat(spelled, F.lit("@"), host, F.lit(".example.org"))


def _token(kind: Column, value: Column, key: str, tweak: Column) -> Column:
    """A name of keyed syllables with the ending of its kind, in the script of ``value``."""

    def spelled(script):
        syllables = F.array(*map(F.lit, _SYLLABLES[script]))
        of = F.transform(F.sequence(F.lit(1), F.when(tweak >= LONGER, 7).otherwise(4)), lambda i: F.element_at(syllables, (F.pmod(_noise(key, kind, value, i, tweak), F.lit(len(_SYLLABLES[script]))) + 1).cast("int")))
        ending = F.lit("")
        for name, tail in _ENDINGS[script].items():
            ending = F.when(kind == name, tail).otherwise(ending)
        return F.initcap(F.concat(F.array_join(of, ""), ending))

    out = F.when(value.rlike(_SCRIPTS["cyrillic"]), spelled("cyrillic")).when(value.rlike(_SCRIPTS["greek"]), spelled("greek"))
    return out.otherwise(spelled("latin"))


def _initials(value: Column, key: str) -> Column:
    """Each letter turned to another of its alphabet, by a keyed step; letters of none count as E."""
    alphabets = [a.upper() for a in _ALPHABETS.values()]
    steps = [1 + int.from_bytes(hashlib.blake2b(f"{key}:{a}".encode()).digest()[:8], "big") % (len(a) - 1) for a in alphabets]
    known = "".join(alphabets)
    turned = "".join(a[n:] + a[:n] for a, n in zip(alphabets, steps, strict=True))
    return F.translate(F.regexp_replace(value, rf"[\p{{Lu}}&&[^{known}]]", "E"), known, turned)


def surrogate(kind: Column, value: Column, key: str, tweak: Column) -> Column:
    """Replacement of a canonical value; ``tweak`` numbers the attempts."""
    return (
        F.when(kind == "email", _email(value, key, tweak))
        .when(kind == "ip", _ip(value, key, tweak))
        .when(kind == "phone", _phone(value, key, tweak))
        .when(kind == "ssn", _permuted(value, key, tweak))
        .when(kind == "card", _card(value, key, tweak))
        .when(kind == "initial", _initials(value, key))
        .when(kind == "particle", value)
        .otherwise(_token(kind, value, key, tweak))
    )


def _parts(raw: Column) -> Column:
    """(kind, value) structs of a match: one, or one for each name token after a title: the last is the
    surname, particles stay, initials are turned, all others are given names.

    Case, separators and brackets don't count: an address is lower-cased, numbers are digits.
    """
    one = lambda kind, value: F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    kind = _kind(raw)
    words = F.split(raw, " ")
    given = F.when(raw.rlike(f"^(?:{_FEMALE}) "), "given_f").when(raw.rlike(f"^(?:{_MALE}) "), "given_m").otherwise("given")
    names = F.slice(words, 2, F.size(words) - 1)
    initial = lambda w: w.rlike(f"^{_INITIAL}$")
    last = F.size(names) - F.when(initial(F.element_at(names, -1)), 2).otherwise(1)
    of = lambda w, i: F.when(initial(w), "initial").when(w.rlike(f"^{_PARTICLE}$") & (i < last), "particle").when(i < last, given).otherwise("surname")
    tokens = F.transform(names, lambda w, i: F.struct(of(w, i).alias("kind"), w.alias("value")))
    coded = r"^(\+[0-9]{1,3})(?=[ .(-])"
    code = F.when(raw.rlike(coded), F.concat(F.regexp_extract(raw, coded, 1), F.lit(" "))).otherwise("")
    phone = F.concat(code, _digits(F.regexp_replace(raw, coded, "")))
    return (
        F.when(kind == "email", one("email", F.lower(raw)))
        .when(kind == "ip", one("ip", raw))
        .when(kind == "ssn", one("ssn", _digits(raw)))
        .when(kind == "phone", one("phone", phone))
        .when(kind == "card", one("card", _digits(raw)))
        .otherwise(tokens)
    )


def _dressed(raw: Column, kind: Column, new: Column) -> Column:
    """A canonical surrogate in the match's format: its separators, or its letters' case."""
    chars = F.sequence(F.lit(1), F.length(raw))
    numerals = _digits(new)
    seen = lambda i: F.length(_digits(F.substring(raw, F.lit(1), i)))
    number = F.array_join(F.transform(chars, lambda i: F.when(F.substring(raw, i, F.lit(1)).rlike("[0-9]"), F.substring(numerals, seen(i), F.lit(1))).otherwise(F.substring(raw, i, F.lit(1)))), "")
    local = F.length(F.substring_index(raw, "@", 1))
    cased = F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(new)), lambda i: F.when((i <= local) & F.substring(raw, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substring(new, i, F.lit(1)))).otherwise(F.substring(new, i, F.lit(1)))), ""
    )
    return F.when(kind == "email", cased).when(kind == "ip", new).otherwise(number)


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, value) of all texts; initials and particles need not be distinct."""
    found = docs.select(F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(ANY), F.lit(0))).alias("raw")).distinct()
    return found.select(F.explode(_parts(F.col("raw"))).alias("e")).select("e.kind", "e.value").where(~F.col("kind").isin("initial", "particle")).distinct()


def overrides(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, surrogate) of the values that can't keep their first surrogate.

    Of values with one surrogate the least keeps it; a surrogate that itself occurs as a value
    of its kind is given up. Each round gives the others their next attempt and checks it
    against all values and all surrogates taken. A given name behind a title without gender takes
    the surrogate that it has behind the titles of one gender, if it stands behind those of one
    only. Only counts come to the driver.
    """
    found = stage(found, "entities")
    settled = stage(found.withColumn("tweak", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, F.lit(0))), "surrogates")
    while True:
        least = settled.groupBy("kind", "surrogate").agg(F.min(F.struct("tweak", "value")).alias("first"), F.count("value").alias("n"))
        owned = found.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("occurs"))
        bad = least.join(owned, ["kind", "surrogate"], "left").where("n > 1 or occurs")
        marked = settled.join(bad, ["kind", "surrogate"], "left")
        again = F.coalesce(F.col("occurs") & (F.col("tweak") < AVOID), F.lit(False)) | (F.col("n").isNotNull() & (F.col("first.value") != F.col("value")))
        tweak = F.when(again, F.col("tweak") + 1).otherwise(F.col("tweak"))
        moved = stage(marked.select("kind", "value", tweak.alias("tweak"), F.col("surrogate").alias("old"), again.alias("again")), "attempts")
        if not moved.where("again").limit(1).count():
            break
        fresh = F.when(F.col("again"), surrogate(F.col("kind"), F.col("value"), key, F.col("tweak"))).otherwise(F.col("old"))
        settled = stage(moved.select("kind", "value", "tweak", fresh.alias("surrogate")), "surrogates")
    named = settled.where(F.col("kind").isin("given_f", "given_m")).groupBy("value").agg(F.count("kind").alias("genders"), F.min("surrogate").alias("known"))
    neutral = settled.where("kind = 'given'").join(named.where("genders = 1"), "value").select("kind", "value", F.col("known").alias("surrogate"))
    own = settled.where("tweak > 0").select("kind", "value", "surrogate").join(neutral.select("kind", "value"), ["kind", "value"], "left_anti")
    return own.unionByName(neutral)


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, n_entities, kinds) of every row, with every entity replaced.

    ``kinds`` lists the kinds in order, joined by commas. Where a text names somebody by title, the
    same names are replaced wherever else they stand in it as words, too. Text without entities stays as it is;
    a null text stays null with none. Equal values get equal surrogates in all rows, different
    ones different surrogates. Repeated rows are replaced alike; an empty table gives an empty
    result; other columns are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("raws", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    changed = stage(overrides(entities(docs), key), "overrides")
    # Overrides meet only the texts that hold such a value, by digest of the text.
    held = rows.select(F.md5(F.col("text").cast("binary")).alias("digest"), F.explode("raws").alias("raw"))
    held = held.select("digest", F.explode(_parts(F.col("raw"))).alias("e")).select("digest", "e.kind", "e.value").distinct()
    held = held.join(changed, ["kind", "value"])
    held = stage(held.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "value"), "surrogate"))).alias("special")), "special")
    rows = rows.join(held, F.md5(F.col("text").cast("binary")) == F.col("digest"), "left").drop("digest")

    def final(part):
        own = surrogate(part["kind"], part["value"], key, F.lit(0))
        return F.coalesce(F.element_at("special", F.concat_ws(":", part["kind"], part["value"])), own)

    each = F.transform("raws", lambda raw: F.struct(raw.alias("raw"), _parts(raw).alias("parts")))
    rows = rows.withColumn("found", each)
    told = F.transform("found", lambda e: F.struct(e["raw"].alias("raw"), F.transform(e["parts"], lambda p: F.struct(p["kind"], p["value"], final(p).alias("new"))).alias("parts")))
    rows = rows.withColumn("found", told)
    named = lambda e: F.filter(e["parts"], lambda p: F.substring_index(p["kind"], "_", 1).isin("given", "surname"))
    rows = rows.withColumn("bare", F.array_distinct(F.flatten(F.transform("found", lambda e: F.transform(named(e), lambda p: F.struct(p["value"], p["new"]))))))
    new = F.transform("found", lambda e: F.struct(e["raw"].alias("raw"), F.get(e["parts"], 0)["kind"].alias("kind"), F.transform(e["parts"], lambda p: p["new"]).alias("new")))
    rows = rows.withColumn("found", new)
    is_name = lambda e: F.substring_index(e["kind"], "_", 1).isin("given", "surname", "initial", "particle")
    written = F.transform(
        "found",
        lambda e: F.when(is_name(e), F.concat_ws(" ", F.substring_index(e["raw"], " ", 1), e["new"])).otherwise(_dressed(e["raw"], e["kind"], F.get(e["new"], 0))),
    )
    rows = rows.withColumn("written", written)
    text = F.array_join(F.transform(F.split("text", ANY, -1), lambda piece, i: F.concat(piece, F.coalesce(F.get("written", i), F.lit("")))), "")
    shown = F.transform("found", lambda e: F.when(is_name(e), "name").otherwise(e["kind"]))
    word = lambda value: F.concat(F.lit(_NOT_IN), value, F.lit(r"(?![\p{L}\p{N}])"))
    plain = F.aggregate("bare", F.col("titled"), lambda t, name: F.regexp_replace(t, word(name["value"]), name["new"]))
    rows = rows.withColumn("titled", text)
    return rows.select(
        "doc_id",
        F.when(F.size("bare") > 0, plain).when(F.size("raws") > 0, F.col("titled")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("raws").isNull(), 0).otherwise(F.size("raws")).cast("long").alias("n_entities"),
        F.coalesce(F.array_join(shown, ","), F.lit("")).alias("kinds"),
    )
