"""PII surrogates: every detected entity gets a keyed replacement of its own kind.

Detected are e-mail addresses, telephone numbers (behind + or 00, or in national forms with
separators: North American, Spanish, or behind a trunk 0) and card numbers, social security numbers, IP addresses
and names of persons (behind a title, or starting with a known given name; a name runs over initials,
particles and capitalised words, six at most, up to the surname, its last word). A replacement depends on
the key and the entity alone, and keeps the entity's form: e-mail addresses keep the shape, script
and case of each character and the top-level domain; numbers keep their punctuation, country code or trunk 0,
network digit and check digit; private addresses stay private; names keep gender, script,
case and particles, and initials are shifted in the alphabet.

Entities are compared in a normal form, so that spellings of one entity share a replacement
(coreference), in all documents: letters without case, numbers without punctuation, and each part of
a name by itself. Replacements of different entities differ, and none is an entity of the corpus:
in rounds, candidates are checked against each other, the accepted ones and the originals, and the
losers draw again. After a few rounds the space grows, so that a form with few values can't run out:
names are joined from two or more, e-mail addresses and telephone numbers get more characters, and
addresses of 192.168.0.0/16 and 172.16.0.0/12 come from 10.0.0.0/8 (in the end from all addresses).
What is left after ``MOST_ROUNDS`` rounds is an error; only full spaces of card and social security
numbers or of all IP addresses could come to that.

Everything is built-in expressions. Defined cases: a null text stays null; domains of any number of
labels and names with any number of initials are one entity; texts without an entity
are returned as they are; repeated rows are a row each; columns of ``docs`` are kept (no name that
starts with ``_pii`` may be among them); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.session import stage

# Titles by gender, and given names and surnames by script and gender.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Srta", "Госпожа"],
          "m": ["Mr", "Herr", "Monsieur", "Sr", "Господин"], "n": ["Dr", "Prof"]}
GIVEN = {
    "latin f": ["Mary", "Anna", "Laura", "Julia", "Emma", "Sophie", "Clara", "Elena", "Maria", "Lucy", "Helen", "Marta",
                "Nina", "Alice", "Irene", "Ruth", "Sarah", "Eva", "Carmen", "Claire"],
    "latin m": ["James", "John", "Peter", "Paul", "Thomas", "Martin", "David", "Daniel", "Robert", "Carlos", "Pierre",
                "Hans", "Michael", "Simon", "Luis", "Victor", "Oscar", "Felix", "Hugo", "George"],
    "cyrillic f": ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Светлана", "Татьяна", "Юлия", "Вера"],
    "cyrillic m": ["Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Николай", "Михаил", "Андрей", "Павел", "Олег"],
}
SURNAMES = {
    "latin n": ["Smith", "Miller", "Schmidt", "Weber", "Fischer", "Moreau", "Laurent", "Garcia", "Romero", "Walker",
                "Turner", "Bennett", "Keller", "Vogel", "Dupont", "Lefevre", "Navarro", "Castillo", "Hughes", "Palmer"],
    "cyrillic f": ["Иванова", "Смирнова", "Кузнецова", "Попова", "Соколова", "Лебедева", "Козлова", "Новикова", "Морозова", "Волкова"],
    "cyrillic m": ["Иванов", "Смирнов", "Кузнецов", "Попов", "Соколов", "Лебедев", "Козлов", "Новиков", "Морозов", "Волков"],
}
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_CYRILLIC, _GREEK, _ACCENTED = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω", "áâàäåçéêèëíîìïñóôòöúûùü"
#: The kind of initials, which are shifted in the alphabet by the key and not drawn.
INITIAL = "initial"
#: Rounds in which names are drawn from the lists alone; then two or more are joined.
SINGLE_ROUNDS = 4
#: Rounds after which an address may leave its private or loopback range, and those that end in an error.
RANGE_ROUNDS, MOST_ROUNDS = 12, 100

_GIVEN_NAMES = "|".join(form for names in GIVEN.values() for n in names for form in (n, n.upper()))
_TITLES = "|".join(t for titles in TITLES.values() for t in titles)
_NAME = r"(?:[dl]['’])?\p{Lu}[\p{L}'’-]+"
# Possessive groups run in a loop; others take a stack frame for each repetition.
_INITIAL = r"(?:\p{Lu}\.-?)++|\p{Lu}(?= )"
_PARTICLE = (r"d[aeiou]|de l[ae]s?|de los|del|dell[ao]|dalla|degli|dei|d[aeo]s|l[ae]|von|van|(?:von|van) (?:de[nrm]?|het)|von und zu|zu|ter|ten"
             rf"|a[fv]|bin|ibn|ben|el|al|y(?! (?:{_TITLES}|{_GIVEN_NAMES})(?!\p{{L}}))")
#: What may stand before the last word of a name, which is the surname.
_BEFORE = rf"(?:(?:{_NAME}|{_INITIAL}|{_PARTICLE}) ){{0,6}}"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)++"
_S = r"[ ./\u00a0\u2011-]"
#: With a country code: 10 digits after +1; 7 to 15 digits in any grouping; shorter ones with a separator.
PHONE = (rf"(?<![\w+])\+(?:1{_S}?(?:\(\d{{3}}\)|\d{{3}}){_S}?\d{{3}}{_S}?\d{{4}}(?!\d)|\d{{1,3}}{_S}?\(\d{{1,5}}\)(?:{_S}?\d){{4,11}}(?!\d)"
         rf"|\d(?:{_S}?\d){{6,14}}(?!\d)|\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]\d{{2,4}}){{1,4}}(?!\d))")
#: Without: North American and Spanish groups, a trunk 0 (no date), and 00 for the plus.
_NO_DIGIT = r"(?<![\w+]|\d[./-])"
AMERICAN = (rf"{_NO_DIGIT}(?:1[ .-])?(?:\(\d{{3}}\)[ .-]?\d{{3}}[ .-]?\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{4}}"
            r"|[2-9]\d\d[ /-][2-9]\d\d[ -]\d{4})(?!\d|[.-]\d)")
SPANISH = rf"{_NO_DIGIT}[6-9]\d(?:\d[ .-]\d\d|[ .-]\d{{3}})(?:[ .-]\d\d){{2}}(?!\d|[.-]\d)"
TRUNK = (rf"{_NO_DIGIT}(?!\d\d[./ -]\d\d[./ -]\d{{4}}(?!\d)|\d\d[./-]\d\d[./-]\d\d(?!\d|[./-]\d))"
         rf"(?:\(0[1-9]\d{{0,4}}\){_S}?|(?=(?:\d{_S}?){{9}})0[1-9]\d{{0,4}}{_S})\d(?:{_S}?\d){{4,9}}(?!\d)")
DOUBLE_0 = rf"{_NO_DIGIT}00[1-9]\d{{0,2}}{_S}(?:\(0\))?\d(?:{_S}?\d){{5,11}}(?!\d)"
#: Country codes by their length.
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: Unseparated: every run of 16 digits; other lengths behind a prefix that has cards of that length.
CARD = (r"(?<![\d-])(?:\d{16}|4\d{12}(?:\d{6})?|3(?:0[0-59]|[689]\d)\d{11}|3[47]\d{13}|(?:6(?:011|4[4-9]\d|5\d\d|2\d\d)|35(?:2[89]|[3-8]\d))\d{13,15}"
        r"|(?:5018|5020|5038|5893|6304|6759|676[1-3])\d{9,15}"
        r"|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|3\d{3}[ -]\d{6}[ -]\d{4,5})(?![\d-])")
PERSON = (rf"(?<![\p{{L}}\p{{N}}])(?:(?:(?:{_TITLES})\.? ){{1,3}}|(?:{_GIVEN_NAMES})(?:-{_NAME})? ){_BEFORE}{_NAME}")
#: The first that matches at a place counts.
PII = "|".join([EMAIL, PHONE, IP, SSN, CARD, AMERICAN, SPANISH, DOUBLE_0, TRUNK, PERSON])


def _shifted(raw: Column, key: str) -> Column:
    """Initials as other letters of their script, the same for the same letter."""
    before = after = ""
    for letters in (_UPPER, "".join(sorted(set(_CYRILLIC.upper())))):
        by = 1 + int(hashlib.sha256(key.encode()).hexdigest(), 16) % (len(letters) - 1)
        before, after = before + letters, after + letters[by:] + letters[:by]
    return F.translate(raw, before, after)


def has_pii(text: Column) -> Column:
    """Whether a text holds an entity; most texts are settled by two cheap looks."""
    near = text.contains("@") | text.rlike(r"\d[ .()-]{0,2}\d") | text.rlike(rf"\b(?:{_TITLES}|{_GIVEN_NAMES})\b")
    return F.coalesce(F.when(near, text.rlike(PII)).otherwise(F.lit(False)), F.lit(False))


def _any_of(word: Column, words: list[str]) -> Column:
    return F.lower(word).isin([w.lower() for w in words])


def _bare(word: Column) -> Column:
    return F.rtrim(word, F.lit("."))


def parts(found: Column) -> Column:
    """One entity as an array of (kind, norm, raw): parts without kind stay as they are."""
    def one(kind: str, norm: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), norm.alias("norm"), found.alias("raw")))

    digits = F.regexp_replace(found, r"\D", "")
    # A number with its country code; "0" stands for an unknown one behind a trunk 0.
    called = F.regexp_replace(F.regexp_replace(found, r"\(0\)", ""), r"^00|\D", "")
    national = (F.when(found.rlike(f"^(?:{AMERICAN})$"), F.concat(F.lit("1 1"), F.substring(digits, -10, 10)))
                .when(found.rlike(f"^(?:{SPANISH})$"), F.concat(F.lit("34 34"), digits))
                .when(~found.startswith("00"), F.concat(F.lit("0 "), digits)))
    words = F.split(found, " ")
    titles = [t for held in TITLES.values() for t in held]
    count = F.size(words)
    head = F.size(F.filter(words, lambda w, i: (i < count - 1) & _any_of(_bare(w), titles)))
    names = F.slice(words, head + 1, count)
    initial = lambda w: w.rlike(r"^(?:\p{Lu}|(?:\p{Lu}\.-?)++)$")
    whole = lambda w: w.rlike(r"\p{Lu}") & ~initial(w)
    known = lambda w, *which: _any_of(F.substring_index(w, "-", 1), [n for k in which for n in GIVEN[k]])
    begins = whole(names[0]) & ((head == 0) | (F.size(F.filter(names, whole)) > 1))
    titled = lambda which: (head > 0) & F.exists(F.slice(words, 1, head), lambda w: _any_of(_bare(w), TITLES[which]))
    last = F.element_at(words, -1)
    gender = (F.when(titled("f"), "f").when(titled("m"), "m").when(begins & known(names[0], "latin f", "cyrillic f"), "f")
              .when(begins & known(names[0], "latin m", "cyrillic m"), "m").when(last.rlike("(?:ова|ева|ина|ая)$"), "f").otherwise("m"))
    nothing = F.lit(None).cast("string")

    def part(kind: Column, norm: Column, raw: Column) -> Column:
        return F.struct(kind.alias("kind"), norm.alias("norm"), raw.alias("raw"))

    def named(word: Column, i: Column) -> Column:
        cyrillic = word.rlike(r"\p{IsCyrillic}")
        given = ((i == 0) & begins) | ((i < F.size(names) - 1) & known(word, *GIVEN))
        kind = (F.when(~word.rlike(r"\p{Lu}"), nothing).when(initial(word), INITIAL)
                .when(given, F.concat(F.lit("given "), F.when(cyrillic, "cyrillic ").otherwise("latin "), gender))
                .when(cyrillic, F.concat(F.lit("surname cyrillic "), gender)).otherwise("surname latin n"))
        return part(kind, F.when(kind.isNotNull(), F.lower(word)), word)

    person = F.concat(F.transform(F.slice(words, 1, head), lambda w: part(nothing, nothing, w)), F.transform(names, named))
    return (
        F.when(found.contains("@"), one("email", F.lower(found)))
        .when(found.startswith("+"), one("phone", F.concat(F.regexp_extract(called, _COUNTRY, 1), F.lit(" "), called)))
        .when(found.rlike(f"^{IP}$"), one("ip", found))
        .when(found.rlike(f"^{SSN}$"), one("ssn", digits))
        .when(found.rlike(f"^(?:{CARD})$"), one("card", digits))
        .when(found.rlike(r"^[\d(]"), one("phone", F.coalesce(
            national, F.concat(F.regexp_extract(called, _COUNTRY, 1), F.lit(" "), called))))
        .otherwise(person))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of ten for a valid card number."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return _sum(F.transform(F.filter(each, lambda d: d.isNotNull()), lambda d: F.when(d > 9, d - 9).otherwise(d)))


def candidates(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """Add ``candidate``, in normal form, to rows of (kind, norm)."""
    salted = lambda more: F.sha2(F.concat_ws("\n", F.lit(key), "kind", more, F.lit(str(attempt))), 512)
    drawn = entities.withColumn("_pii_hash", salted(F.col("norm"))).withColumn(
        "_pii_host", salted(F.substring_index("norm", "@", -1)))

    def byte(hashed: str, i: Column) -> Column:
        return F.conv(F.substring(F.col(hashed), (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def letter(letters: str, number: Column) -> Column:
        return F.substring(F.lit(letters), number % len(letters) + 1, F.lit(1))

    def shaped(text: Column, hashed: str) -> Column:
        """Another character of the same class at each place."""
        return F.array_join(F.transform(F.split(text, ""), lambda c, i: (
            F.when(c.rlike("[a-z]"), letter(_LOWER, byte(hashed, i))).when(c.rlike("[A-Z]"), letter(_UPPER, byte(hashed, i)))
            .when(c.rlike(r"\d"), letter(_DIGITS, byte(hashed, i))).when(c.rlike(r"\p{IsCyrillic}"), letter(_CYRILLIC, byte(hashed, i)))
            .when(c.rlike(r"\p{IsGreek}"), letter(_GREEK, byte(hashed, i))).when(c.rlike(r"\p{IsLatin}"), letter(_ACCENTED, byte(hashed, i)))
            .when(c.rlike(r"[\p{L}\p{N}]"), letter(_LOWER, byte(hashed, i))).otherwise(c))), "")

    def longer(letters: str) -> Column:
        """More characters in each round after the first few: a form with few values can't run out."""
        return F.concat(F.lit(""), *[letter(letters, byte("_pii_hash", F.lit(63 - i % 64))) for i in range(max(0, attempt - SINGLE_ROUNDS + 1))])

    norm = F.col("norm")
    host, top = F.substring_index(norm, "@", -1), F.substring_index(norm, ".", -1)
    email = F.concat(
        shaped(F.substring_index(norm, "@", 1), "_pii_hash"), longer(_LOWER), F.lit("@"),
        shaped(F.substring(host, F.lit(1), F.length(host) - F.length(top) - 1), "_pii_host"), F.lit("."), top)
    country = F.substring_index(norm, " ", 1)
    number = F.substring_index(norm, " ", -1)
    phone = F.concat(country, F.lit(" "), country, shaped(F.substring(number, F.length(country) + 1, F.length(number)), "_pii_hash"), longer(_DIGITS))
    octets = F.split(norm, r"\.")
    private = F.when(octets[0].isin("10", "127"), 1).when((octets[0] == "192") & (octets[1] == "168"), 2).when(
        (octets[0] == "172") & octets[1].try_cast("int").between(16, 31), 2).otherwise(0)
    if attempt >= SINGLE_ROUNDS:  # the small private ranges may be full: 10.0.0.0/8 is private too
        octets = F.when(private == 2, F.array(F.lit("10"), *[F.get(octets, i) for i in (1, 2, 3)])).otherwise(octets)
        private = F.least(private, F.lit(1 if attempt < RANGE_ROUNDS else 0))
    ip = F.array_join(F.transform(octets, lambda o, i: F.when(i < private, o).otherwise(
        (byte("_pii_hash", i) % 254 + 1).cast("string"))), ".")
    body = F.concat(F.substring(norm, 1, 1), shaped(F.substring(norm, F.lit(2), F.length(norm) - 2), "_pii_hash"))
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10)
    off = F.when(_luhn(norm) % 10 == 0, 0).otherwise(1 + byte("_pii_hash", F.lit(63)) % 9)
    card = F.concat(body, ((check + off) % 10).cast("string"))

    def name(lists: dict[str, list[str]], prefix: str) -> Column:
        out = F.lit(None).cast("string")
        for which, names in lists.items():
            held = F.array(*[F.lit(n.lower()) for n in names])
            count = 1 + max(0, attempt - SINGLE_ROUNDS + 1)
            drawn_names = [F.get(held, F.conv(F.substring("_pii_hash", 1 + 8 * k, 7), 16, 10).cast("int") % len(names)) for k in range(min(count, 15))]
            out = F.when(F.col("kind") == f"{prefix} {which}", F.concat_ws("-", *drawn_names)).otherwise(out)
        return out

    kind = F.col("kind")
    made = (F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip)
            .when(kind == "ssn", shaped(norm, "_pii_hash")).when(kind == "card", card)
            .when(kind.startswith("given"), name(GIVEN, "given")).otherwise(name(SURNAMES, "surname")))
    return drawn.withColumn("candidate", made).drop("_pii_hash", "_pii_host")


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, candidate) for distinct (kind, norm): all candidates of a kind differ, and none
    is a norm of its kind. Each round reads written tables only."""
    left = originals = stage(entities.select("kind", "norm").distinct(), "pii_entities")
    taken: list[DataFrame] = []
    attempt = 0
    while not left.isEmpty():
        if attempt == MOST_ROUNDS:
            raise RuntimeError(f"no surrogates are left for {[r['kind'] for r in left.select('kind').distinct().collect()]}")
        drawn = candidates(left, key, attempt)
        first = drawn.groupBy("kind", "candidate").agg(F.min("norm").alias("norm"))
        free = first.join(originals.select("kind", F.col("norm").alias("candidate")), ["kind", "candidate"], "left_anti")
        for before in taken:
            free = free.join(before.select("kind", "candidate"), ["kind", "candidate"], "left_anti")
        won = stage(free.select("kind", "norm", "candidate"), "pii_won")
        taken.append(won)
        left = stage(left.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"), "pii_left")
        attempt += 1
    if not taken:
        return originals.withColumn("candidate", F.col("norm"))
    return reduce(DataFrame.unionByName, taken)


def _in_form(raw: Column, kind: Column, made: Column, norm: Column) -> Column:
    """A candidate written as the original is: its punctuation or its case. Of a telephone number the
    country code is left out where the original has none, and ``(0)`` and a leading 00 stay."""
    number = F.substring_index(made, " ", -1)
    held = F.when((kind == "phone") & raw.rlike(r"^(?:\+|00)"), F.regexp_replace(
        F.regexp_replace(raw, r"\(0\)", "(_)"), "^00", "__")).otherwise(raw)
    left_out = F.length(F.substring_index(norm, " ", -1)) - F.length(F.regexp_replace(held, r"\D", ""))
    numbers = F.aggregate(
        F.split(held, ""), F.struct(F.lit("").alias("out"), (left_out + 1).alias("at")),
        lambda a, c: F.when(c.rlike(r"\d"), F.struct(
            F.concat(a["out"], F.substring(number, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        lambda a: F.concat(F.translate(a["out"], "_", "0"), F.substring(number, a["at"], F.length(number))))
    cased = (F.when(raw == F.upper(raw), F.upper(made)).when(raw == F.lower(raw), made)
             .when(kind == "email", made).otherwise(F.array_join(F.transform(F.split(made, "-"), lambda w: F.initcap(w)), "-")))
    return F.when(kind.isin("phone", "ssn", "card"), numbers).when(kind == "ip", made).otherwise(cased)


def with_surrogates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and ``pii_count``, how many there were. Who has the
    ``key`` can tell which surrogate stands for a guessed entity, so it must be kept secret.

    Only texts with an entity are moved. Their entities are listed once for equal texts, by a hash.
    """
    hit = has_pii(F.col(text))
    keyed = docs.where(hit).withColumn("_pii_key", F.sha2(F.col(text), 256))
    listed = stage(
        keyed.select("_pii_key", F.regexp_extract_all(F.col(text), F.lit(PII), F.lit(0)).alias("found"))
        .dropDuplicates(["_pii_key"]), "pii_found")
    split = (
        listed.select("_pii_key", F.posexplode("found").alias("i", "one"))
        .select("_pii_key", "i", F.posexplode(parts(F.col("one"))).alias("j", "part"))
        .select("_pii_key", "i", "j", "part.*"))
    known = stage(assigned(split.where(F.col("kind") != INITIAL), key), "pii_assigned")
    written = split.join(known, ["kind", "norm"], "left").withColumn(
        "made", F.when(F.col("kind") == INITIAL, _shifted(F.col("raw"), key)).otherwise(F.coalesce(_in_form(F.col("raw"), F.col("kind"), F.col("candidate"), F.col("norm")), F.col("raw"))))
    whole = written.groupBy("_pii_key", "i").agg(F.sort_array(F.collect_list(F.struct("j", "made"))).alias("p")).select(
        "_pii_key", "i", F.array_join(F.transform("p", lambda p: p["made"]), " ").alias("made"))
    by_text = whole.groupBy("_pii_key").agg(F.sort_array(F.collect_list(F.struct("i", "made"))).alias("_pii_made"))
    both = keyed.join(by_text, "_pii_key")
    rebuilt = F.array_join(F.transform(
        F.split(F.col(text), PII, -1), lambda p, i: F.concat(p, F.coalesce(F.get("_pii_made", i)["made"], F.lit("")))), "")
    changed = both.withColumn("pii_count", F.size("_pii_made").cast("bigint")).withColumn(text, rebuilt)
    same = docs.where(~hit).withColumn("pii_count", F.lit(0).cast("bigint"))
    columns = [*docs.columns, "pii_count"]
    return same.select(*columns).unionByName(changed.select(*columns))
