"""Surrogates for personal data, with DataFrame and SQL functions only.

Entities are found by patterns; each is replaced by a surrogate of the same type and format that depends on a secret key and
on the entity alone, so it is the same in all documents. The surrogate is a keyed permutation of the texts of a format:
every letter or digit is shifted within its own class (script and case) by a keyed digest of all that stands before it, once
forwards and once backwards. So distinct entities of a format have distinct surrogates. Card numbers keep their distance from
a valid check digit, addresses keep octets in range, phone numbers their country code, e-mail addresses their last label.

Names are found by what stands before them (a form of address, or a phrase that announces a name), by a listed given name with a
surname, or by the form of a surname after another capitalised word. They are replaced word by word, so that all mentions of a person agree:
"Mrs Anna Schmidt", "Anna Schmidt" and "Frau Schmidt" keep one given name and one surname, and in a document that has a name its words
are replaced where they stand alone too. A listed given name goes to another of its gender and script, the next in a keyed cycle. Any
other word gets an invented surname of its script, made of syllables; endings that tell gender or kin (-ov, -ova) stay, so members of
a family keep a common stem.

The surrogates of all distinct entities and words of names are then checked: one that two of them share, or that is another of
the corpus itself, is drawn again (next attempt) until it is free. Formats with few texts may have no free one left: after ``ATTEMPTS``
attempts a value keeps its first surrogate, which no other has, though the corpus may hold it as an entity (itself replaced everywhere).

Limits: names in scripts without capitals, and names that neither their context nor their form tells, aren't found. Within a document
that has a name, an ordinary word that looks just like a part of it is replaced too.

Defined results: a null text stays null with no entities; repeated rows are treated alike; other columns are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import bounded_broadcast, cut, key as join_key

#: Names by gender and script.
FEMALE = ("Agnes", "Alice", "Ana", "Anna", "Astrid", "Beatriz", "Camille", "Carla", "Carmen", "Catherine", "Charlotte", "Claire", "Clara", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Greta", "Hanna", "Helen", "Ingrid", "Isabel", "Jane", "Julia", "Karin", "Katharina", "Laura", "Lucia", "Lucy", "Margaret", "Maria", "Marie", "Martha", "Mary", "Nadia", "Nora", "Olga", "Olivia", "Patricia", "Paula", "Petra", "Rosa", "Sarah", "Sofia", "Susan", "Svetlana", "Teresa", "Ursula", "Vera")
MALE = ("Adam", "Albert", "Alexander", "Andreas", "Anton", "Antonio", "Boris", "Bruno", "Carlos", "Charles", "Daniel", "David", "Diego", "Dmitri", "Emil", "Felix", "Fernando", "Frank", "George", "Hans", "Henry", "Hugo", "Ivan", "James", "Jan", "Jean", "John", "Jorge", "Juan", "Klaus", "Louis", "Luis", "Marco", "Martin", "Max", "Michael", "Miguel", "Oscar", "Otto", "Pablo", "Paul", "Pedro", "Peter", "Philip", "Pierre", "Richard", "Robert", "Sergei", "Thomas", "William")
FEMALE_CYRILLIC = ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья", "Татьяна", "Юлия")
MALE_CYRILLIC = ("Алексей", "Борис", "Виктор", "Иван", "Михаил", "Николай", "Олег", "Павел", "Сергей", "Юрий")
#: Forms of address, after which a capitalised word is a name.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "г-н", "г-жа")
#: Phrases after which a capitalised word is a name.
PHRASES = ("my name is ", "My name is ", "Name: ", "name: ", "Dear ", "Liebe ", "Lieber ", "Querida ", "Querido ", "Chère ", "Cher ", "ich heiße ", "Ich heiße ", "je m'appelle ", "Je m'appelle ", "me llamo ", "Me llamo ", "Меня зовут ", "меня зовут ")
#: Endings of surnames, and those that tell gender or kin.
ENDINGS = ("berg", "dottir", "enko", "escu", "ez", "idis", "mann", "opoulos", "poulou", "shvili", "sen", "son", "ssen", "stein", "yan", "енко", "швили", "ян")
GENDERED = ("skaya", "skaia", "sky", "skiy", "ski", "ska", "ova", "eva", "ina", "ov", "ev", "in", "ская", "ский", "ова", "ева", "ина", "ов", "ев", "ин")
_NAMES = "|".join((*FEMALE, *MALE, *FEMALE_CYRILLIC, *MALE_CYRILLIC))
_WORD = r"\p{Lu}\p{Ll}+"
#: A place where a name may begin: looked at first, so that a search passes by all others.
_CAPITAL = r"(?<!\w)(?=[\p{Lu}г])"
_FORM = rf"{_WORD} \p{{Lu}}\p{{Ll}}{{2,}}(?:{'|'.join((*ENDINGS, *(g for g in GENDERED if len(g) > 2)))})"
#: Patterns of entities in order of precedence.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "secret": r"(?<!\w)(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{32,}+(?!\w)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "phone": r"(?<!\w)\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}(?: \d{3} |\.\d{3}\.|-\d{3}-)\d{4}(?![\w-])|(?<![\w.-])0\d{2,4} \d{3,4} ?\d{3,4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "name": rf"{_CAPITAL}(?:(?:{'|'.join(TITLES)})\.? {_WORD}(?: {_WORD})?|(?<={'|'.join(PHRASES)}){_WORD}(?: {_WORD})?|(?:{_NAMES}) {_WORD}|{_FORM})(?![\p{{L}}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Where an entity may be at all; a cheap first look at each text.
_FIRST = "".join(sorted({p[0] for p in PHRASES}))
HINT = rf"\d|@|{_CAPITAL}(?:(?:{'|'.join(TITLES)}|{_NAMES})\.? |{_FORM}(?!\p{{L}}))|(?<!\w)(?=[{_FIRST}])(?:{'|'.join(PHRASES)})"
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
HEX = "0123456789abcdef"
#: Draws of a surrogate at most.
ATTEMPTS = 12
#: Parts of the syllables of invented surnames, by script.
SYLLABLES = {
    "Latin": (("b", "br", "d", "dr", "f", "g", "gr", "h", "k", "kl", "l", "m", "n", "p", "r", "s", "st", "t", "tr", "v"), ("a", "e", "i", "o", "u"), ("", "l", "ll", "m", "n", "nd", "r", "rt", "s", "t")),
    "Cyrillic": (("б", "бр", "в", "г", "гр", "д", "ж", "з", "к", "кл", "л", "м", "н", "п", "р", "с", "ст", "т", "тр", "х"), ("а", "е", "и", "о", "у"), ("", "к", "л", "м", "н", "р", "с", "ст", "т", "х")),
}


def _draw(secret: str, *parts) -> Column:
    """A keyed number of 48 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(secret), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256), 1, 12), 16, 10).cast("long")


def _shift(c: Column, by: Column, classes) -> Column:
    out = c
    for letters in classes:
        at = F.instr(F.lit(letters), c)
        out = F.when(at > 0, F.substring(F.lit(letters), (F.pmod(at - 1 + by, F.lit(len(letters))) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _passed(source: Column, secret: str, kind: str, attempt: Column, turn: str, classes) -> Column:
    def one(held: Column, i: Column) -> Column:
        return F.concat(held, _let(_draw(secret, kind, attempt, turn, F.substring(source, F.lit(1), i - 1)), lambda by: _shift(F.substring(source, i, F.lit(1)), by, classes)))

    places = F.when(F.length(source) > 0, F.sequence(F.lit(1), F.length(source))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(""), one)


def _permuted(text: Column, secret: str, kind: str, attempt: Column, classes=CLASSES) -> Column:
    """A permutation of the texts of one format: forwards, then backwards."""
    forwards = _let(text, lambda t: _passed(t, secret, kind, attempt, "forwards", classes))
    return F.reverse(_let(F.reverse(forwards), lambda t: _passed(t, secret, kind, attempt, "backwards", classes)))


def _luhn(digits: Column) -> Column:
    """The check digit for ``digits``."""
    backwards = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, (F.substring(backwards, i, F.lit(1)).cast("int") * 2).cast("int")).otherwise(F.substring(backwards, i, F.lit(1)).cast("int")) - F.when((i % 2 == 1) & (F.substring(backwards, i, F.lit(1)).cast("int") > 4), 9).otherwise(0))
    return F.pmod(-total, F.lit(10)).cast("int")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _card(v: Column, secret: str, attempt: Column) -> Column:
    body = F.substring(v, F.lit(1), F.length(v) - 1)
    distance = F.substring(v, F.length(v), F.lit(1)).cast("int") - _let(_digits(body), _luhn)
    return _let(_permuted(body, secret, "card", attempt), lambda new: F.concat(new, F.pmod(_let(_digits(new), _luhn) + distance, F.lit(10)).cast("int").cast("string")))


def _octets(source: Column, secret: str, attempt: Column, turn: str) -> Column:
    def one(i: Column) -> Column:
        before = F.array_join(F.transform(F.slice(source, F.lit(1), i - 1), lambda o: o.cast("string")), ".")
        return F.pmod(F.element_at(source, i) + _draw(secret, "ip", attempt, turn, i, before), F.lit(256)).cast("int")

    return F.transform(F.sequence(F.lit(1), F.lit(4)), one)


def _ip(v: Column, secret: str, attempt: Column) -> Column:
    octets = F.transform(F.split(v, r"\."), lambda o: o.cast("int"))
    forwards = _let(octets, lambda o: _octets(o, secret, attempt, "forwards"))
    backwards = _let(F.reverse(forwards), lambda o: _octets(o, secret, attempt, "backwards"))
    return F.array_join(F.transform(F.reverse(backwards), lambda o: o.cast("string")), ".")


def _cycle(secret: str) -> Column:
    """Each listed name and the next in the keyed cycle of its gender and script."""
    pairs = []
    for names in (FEMALE, MALE, FEMALE_CYRILLIC, MALE_CYRILLIC):
        order = sorted(names, key=lambda n: hashlib.sha256(f"{secret}\x1f{n}".encode()).digest())
        pairs += [x for a, b in zip(order, [*order[1:], order[0]], strict=True) for x in (F.lit(a), F.lit(b))]
    return F.create_map(*pairs)


def _title() -> Column:
    return F.array(*[F.lit(t) for t in TITLES], *[F.lit(t + ".") for t in TITLES])


def _listed() -> Column:
    return F.array(*[F.lit(n) for n in (*FEMALE, *MALE, *FEMALE_CYRILLIC, *MALE_CYRILLIC)])


def name_words(v: Column) -> Column:
    """The words of a name but for forms of address."""
    return F.filter(F.split(v, " "), lambda w: ~F.array_contains(_title(), w))


def _syllables(stem: Column, parts: tuple, secret: str, attempt: Column) -> Column:
    """Syllables drawn for ``stem``, more of them on later attempts."""

    def pick(n: Column, shift: int, letters: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, letters)), (F.pmod(F.shiftright(n, shift), F.lit(len(letters))) + 1).cast("int"))

    def one(i: Column) -> Column:
        return _let(_draw(secret, "surname", attempt, i, stem), lambda n: F.concat(*[pick(n, 16 * k, letters) for k, letters in enumerate(parts)]))

    count = (F.lit(2) + F.least(attempt.cast("int"), F.lit(4))).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), count), one), "")


def _surname(w: Column, secret: str, attempt: Column) -> Column:
    """An invented surname of the script of ``w`` with its ending of gender or kin. Later attempts have more syllables, so there is always a
    free one; a word of another script is permuted."""
    ending = F.regexp_extract(w, rf"\p{{Lu}}\p{{Ll}}{{2,}}?({'|'.join(GENDERED)})\z", 1)
    stem = F.substring(w, F.lit(1), F.length(w) - F.length(ending))
    made = _permuted(w, secret, "name", attempt)
    for script, parts in SYLLABLES.items():
        capital = _let(_syllables(stem, parts, secret, attempt), lambda t: F.concat(F.upper(F.substring(t, F.lit(1), F.lit(1))), F.substring(t, F.lit(2), F.length(t))))
        made = F.when(F.regexp_like(w, F.lit(rf"\A\p{{Is{script}}}+\z")), F.concat(capital, ending)).otherwise(made)
    return made


def _name(v: Column, secret: str, own) -> Column:
    """A name word by word; ``own`` looks a word's exception up."""
    cycle = _cycle(secret)
    part = lambda w: F.when(F.array_contains(_title(), w), w).otherwise(F.coalesce(cycle[w], own(w), _surname(w, secret, F.lit(0))))
    return F.array_join(F.transform(F.split(v, " "), part), " ")


def _hex(v: Column, secret: str, attempt: Column) -> Column:
    """Secrets in one case keep it, and are one secret in both; in mixed ones every letter keeps its case."""
    one = _let(_permuted(F.lower(v), secret, "secret", attempt, (HEX,)), lambda new: F.when(v == F.lower(v), new).otherwise(F.upper(new)))
    mixed = _permuted(v, secret, "secret", attempt, (HEX[:10], HEX[10:], HEX[10:].upper()))
    return F.when((v == F.lower(v)) | (v == F.upper(v)), one).otherwise(mixed)


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        # the matched text alone: what stands around it was checked when it was found
        out = F.when(F.regexp_like(value, F.lit(rf"\A(?:{pattern})\z")), F.lit(kind)).otherwise(out)
    return out


def _plausible_card(v: Column) -> Column:
    """Digits in groups of four, as many as cards have, or with a valid check digit: other long numbers stay."""
    digits = _digits(v)
    valid = _let(F.substring(digits, F.lit(1), F.length(digits) - 1), _luhn) == F.substring(digits, F.length(digits), F.lit(1)).cast("int")
    return F.regexp_like(v, F.lit(r"\A\d{4}([ -])\d{4}\1\d{4}")) | F.length(digits).isin(15, 16) | valid


def surrogate(value: Column, kind: Column, secret: str, attempt: Column, own=None) -> Column:
    """The surrogate of an entity, or of a word of a name (kind ``surname``); ``own`` looks the exceptions of words up."""
    split = lambda head: (F.regexp_extract(value, head, 1), F.regexp_extract(value, head, 2))
    local, tail = split(r"(?s)\A(.*)(\.[^.]*)\z")
    code, number = split(r"(?s)\A(\+\d{1,3})?(.*)\z")
    country, account = split(r"(?s)\A(..)(.*)\z")
    return (
        F.when(kind == "email", F.concat(_permuted(local, secret, "email", attempt), tail))
        .when(kind == "ip", _ip(value, secret, attempt))
        .when(kind == "phone", F.concat(code, _permuted(number, secret, "phone", attempt)))
        .when(kind == "card", _card(value, secret, attempt))
        .when(kind == "iban", F.concat(country, _permuted(account, secret, "iban", attempt)))
        .when(kind == "secret", _hex(value, secret, attempt))
        .when(kind == "surname", _surname(value, secret, attempt))
        .when(kind == "name", _name(value, secret, own or (lambda w: F.lit(None).cast("string"))))
        .otherwise(_permuted(value, secret, "ssn", attempt))
    )


def _first_found(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.regexp_like(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def found_in(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) with ``found``, the entities of each text in order, and ``pattern``, which finds just these: that of all kinds,
    and the words of the names that the text has."""
    first = docs.withColumn("found", _first_found(F.col("text")))
    names = F.filter("found", lambda v: kind_of(v) == "name")
    words = F.array_distinct(F.flatten(F.transform(names, name_words)))
    first = first.withColumn("words", F.when(F.size("found") > 0, words).otherwise(F.array().cast("array<string>")))
    more = F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))
    out = first.withColumn("pattern", F.when(F.size("words") > 0, more).otherwise(F.lit(ANY)))
    again = F.when(F.size("words") > 0, F.regexp_extract_all("text", "pattern", F.lit(0))).otherwise(F.col("found"))
    return out.withColumn("found", again).drop("words")


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, value, rows): the distinct entities of all documents, and the words of names (``surname``) in place of names."""
    own = found_in(docs.select(F.col(text_col).cast("string").alias("text")))
    values = own.select(F.explode("found").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("rows")).select(kind_of(F.col("value")).alias("kind"), "value", "rows")
    values = values.filter((F.col("kind") != "card") | _plausible_card(F.col("value")))
    parts = values.filter("kind = 'name'").select(F.explode(name_words(F.col("value"))).alias("value"), "rows").filter(~F.array_contains(_listed(), F.col("value")))
    parts = parts.groupBy("value").agg(F.sum("rows").alias("rows")).select(F.lit("surname").alias("kind"), "value", "rows")
    return values.filter("kind <> 'name'").unionByName(parts)


def exceptions(found: DataFrame, secret: str, attempts: int = ATTEMPTS) -> DataFrame:
    """(value, surrogate) of entities whose first surrogate isn't free: each with the first later one that is. After ``attempts`` those
    left keep a first surrogate that they share with no other entity; where several share it, which permutations rule out, the
    last attempt's with the value's digest."""
    first = cut(found.select("value", surrogate(F.col("value"), F.col("kind"), secret, F.lit(0)).alias("surrogate"), "kind"), "surrogates")
    shared = first.groupBy("surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first")).filter("n > 1")
    real = first.join(first.select(F.col("value").alias("surrogate")), "surrogate", "left_semi")
    twice = first.join(shared, "surrogate").filter("value <> first").select("value", "kind").withColumn("twice", F.lit(True))
    both = real.select("value", "kind").withColumn("twice", F.lit(False)).unionByName(twice)
    open_ = cut(both.groupBy("value", "kind").agg(F.max("twice").alias("twice")), "open")
    done = first.filter("false").select("value", "surrogate")
    for attempt in range(1, attempts + 1):
        if not open_.take(1):
            break
        tried = open_.select("value", "kind", surrogate(F.col("value"), F.col("kind"), secret, F.lit(attempt)).alias("surrogate"))
        taken = first.select("surrogate").unionByName(first.select(F.col("value").alias("surrogate"))).unionByName(done.select("surrogate"))
        free = tried.join(taken, "surrogate", "left_anti")
        free = cut(free.groupBy("surrogate").agg(F.min("value").alias("value")).select("value", "surrogate"), "free")
        done = done.unionByName(free)
        open_ = cut(open_.join(free.select("value"), "value", "left_anti"), "open")
    last = surrogate(F.col("value"), F.col("kind"), secret, F.lit(attempts))
    rest = open_.filter("twice").select("value", F.concat(last, F.substring(F.sha2("value", 256), 1, 16)).alias("surrogate"))
    return cut(done.unionByName(rest), "exceptions")


def replace_entities(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``doc_id, text`` (with surrogates), ``n_entities`` and ``kinds`` (of the entities, in order)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    special = exceptions(cut(entities(texts), "entities"), secret)
    rows = found_in(texts)
    none = F.lit(None).cast("map<string,string>")
    if special.take(1):
        # each row's own exceptions, by its id and text: only rows that hold one have any
        by_row = {"k": join_key(F.col("doc_id")), "sha": F.when(F.size("found") > 0, F.sha2("text", 256))}
        rows = rows.withColumns(by_row)
        held = rows.filter(F.size("found") > 0).select("k", "sha", F.explode("found").alias("v")).select("k", "sha", F.explode(F.concat(F.array("v"), name_words(F.col("v")))).alias("value"))
        maps = held.distinct().join(bounded_broadcast(special), "value").groupBy("k", "sha").agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("own"))
        rows = rows.join(bounded_broadcast(cut(maps, "own-exceptions")), ["k", "sha"], "left").drop("k", "sha")
    else:
        rows = rows.withColumn("own", none)
    own = lambda v: F.col("own")[v]
    kind = lambda v: F.when((kind_of(v) == "card") & ~_plausible_card(v), F.lit("number")).otherwise(kind_of(v))
    new = F.transform("found", lambda v: _let(kind(v), lambda k: F.when(k == "number", v).otherwise(F.coalesce(own(v), surrogate(v, k, secret, F.lit(0), own)))))
    some = F.size("found") > 0
    cutup = rows.select("doc_id", "text", "found", F.when(some, F.split("text", F.col("pattern"), -1)).alias("gaps"), F.when(some, new).alias("new"))
    joined = F.concat(F.element_at("gaps", 1), F.array_join(F.zip_with("new", F.slice("gaps", 2, F.size("new")), lambda e, g: F.concat(e, g)), ""))
    kinds = F.filter(F.transform("found", kind), lambda k: k != "number")
    kinds = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(kinds)
    out = cutup.select("doc_id", F.when(some, joined).otherwise(F.col("text")).alias("text"), kinds.alias("kinds"))
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_entities"), "kinds")
