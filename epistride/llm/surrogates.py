"""Surrogates for personal data: keyed, of the same type and format, distinct, and the same wherever an entity recurs.

DataFrame functions only. Entities are found by patterns, brought to a normal
form (letters of an address in lower case, digits of a number, the single
names of a person), and each distinct normal form gets one surrogate: digits
from a keyed digest in place of digits, letters in place of letters of the
same script and case, valid octets and check digits, names whose ending
matches the gender that the title tells. Candidates that meet another
surrogate or a real entity are drawn again until all are distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from epistride.llm.keyed import spread_lookup
from epistride.session import stored

#: Candidates are drawn so many times at most; after some draws each kind's space of candidates grows, so a full one is left.
ROUNDS = 48
_FIXED_DRAWS = 6

# Patterns of entities. All begin where no ASCII letter or digit stands before; a cheap look at the first
# character keeps the search quick elsewhere.
EMAIL = r"(?=[A-Za-z0-9_%+])(?<![._%+\-])[A-Za-z0-9_%+][A-Za-z0-9._%+\-]*+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?=[0-9])(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_SECRET_NAME = r"(?:[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd|[Ss]ecret|[Tt]oken|TOKEN|[Aa]pi[_\-]?[Kk]ey|API_KEY)"
_SECRET_HEAD = rf"{_SECRET_NAME}[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?"
# A secret's value runs to its end, however long; points only within it, and signs of equality behind it. All loops are
# possessive, which Java runs without recursion. An address that stands as a value is found as an address.
_SECRET_CHAR = r"[A-Za-z0-9_+/~\-]"
_SECRET_VALUE = rf"(?!{EMAIL})(?!{IPV4}(?!{_SECRET_CHAR}))(?:{_SECRET_CHAR}|\.++(?={_SECRET_CHAR})){{8,}}+=*+"
SECRET = (
    rf"(?=[PpSsTtAa]){_SECRET_HEAD}{_SECRET_VALUE}"
    r"|A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?:sk|pk|ghp|gho|xoxb|xoxp)[_\-][A-Za-z0-9_\-]{16,}+"
    r"|(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"
)
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?=[0-9])(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
CARD = r"(?=[0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3})(?![0-9])"
PHONE = r"\+[0-9]{1,3}(?:[ .\-]?\([0-9]{1,4}\))?(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
# Titles by the gender they tell.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин", "κύριος", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Sra", "Srta", "госпожа", "Госпожа", "κυρία", "Κυρία"],
    "n": ["Dr", "Prof"],
}
_NAME = r"\p{Lu}[\p{Ll}\p{Lu}'’\-]{1,30}"
_PERSON_TITLE = "(?:" + "|".join(t for titles in TITLES.values() for t in titles) + ")"
_INITIALS = "".join(sorted({t[0] for titles in TITLES.values() for t in titles}))
PERSON = rf"(?=[{_INITIALS}])(?<!\p{{L}}){_PERSON_TITLE}\.? {_NAME}(?: {_NAME}){{0,2}}"
#: In order of precedence.
KINDS = {"email": EMAIL, "ipv4": IPV4, "secret": SECRET, "iban": IBAN, "ssn": SSN, "card": CARD, "phone": PHONE, "person": PERSON}
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
#: What a text must hold for any pattern to match: a digit, an at sign, a title, or the name or mark of a secret.
HINT = rf"[0-9@]|(?=[{_INITIALS}]){_PERSON_TITLE}\.? \p{{Lu}}|(?=[PpSsTtAaskpgx])(?:{_SECRET_HEAD}[A-Za-z_+/~.\-]|AKIA|ASIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[_\-])"


# Letters that names are made of, by script.
SOUNDS = {
    "latin": (list("bdfgklmnprstvz"), list("aeiou")),
    "cyrillic": (list("бвгдзклмнпрст"), list("аеиоу")),
    "greek": (list("βγδζκλμνπρστφ"), list("αεηιου")),
}
ENDINGS = {
    "latin": {"m": ["n", "s", "rd", "ld"], "f": ["a", "ia", "ina", "elle"], "n": ["er", "mann", "ski", "son"]},
    "cyrillic": {"m": ["н", "р", "лий", "слав"], "f": ["а", "на", "лия", "ина"], "n": ["ко", "ман", "ук", "ин"]},
    "greek": {"m": ["ος", "ης", "ας", "ων"], "f": ["α", "η", "ια", "ινα"], "n": ["ιδη", "ου", "ακη", "ογλου"]},
}


def kind_of(raw: Column) -> Column:
    """The kind of an entity found by ``ANY``."""
    title = raw.rlike("^" + _PERSON_TITLE + r"\.? ")
    kind = F.when(raw.contains("@"), "email").when(raw.rlike(f"^(?:{IPV4})$"), "ipv4").when(title, "person")
    kind = kind.when(raw.rlike(f"^(?:{PHONE})$"), "phone").when(raw.rlike(f"^(?:{SSN})$"), "ssn").when(raw.rlike(f"^(?:{CARD})$"), "card")
    return kind.when(raw.rlike(f"^(?:{IBAN})$"), "iban").otherwise("secret")


def _chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _parts(kind: Column, raw: Column) -> Column:
    """(part, norm, gender) of an entity: one, but for persons one for each name.

    A name is the same entity wherever it stands; the title tells the gender
    of the given names behind it.
    """
    single = (
        F.when(kind == "email", F.lower(raw))
        .when(kind.isin("phone", "ssn", "card"), F.concat(F.when(raw.startswith("+"), "+").otherwise(""), _digits(raw)))
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_replace(raw, f"^{_SECRET_HEAD}", ""))
        .otherwise(raw)
    )
    title = F.regexp_extract(raw, "^(" + _PERSON_TITLE + r")\.? ", 1)
    gender = F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise("n")
    names = F.slice(F.split(raw, " "), 2, 10)

    def script(name: Column) -> Column:
        return F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")

    def named(name: Column, place: Column) -> Column:
        given = place < F.size(names) - 1
        part = F.concat_ws(":", F.lit("name"), script(name))
        return F.struct(part.alias("part"), F.lower(name).alias("norm"), F.when(given, gender).otherwise("n").alias("gender"))

    plain = F.array(F.struct(kind.alias("part"), single.alias("norm"), F.lit("n").alias("gender")))
    return F.when(kind == "person", F.transform(names, named)).otherwise(plain)


def _stream(key: str, part: Column, norm: Column, draw: int) -> Column:
    """256 hexadecimal digits, a keyed digest of the entity and the number of the draw."""
    seed = F.sha2(F.concat(F.lit(f"{key}|{draw}|"), part, F.lit("|"), norm), 256)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{key}|{block}|"), seed), 256) for block in range(4)])


def _byte(stream: Column, place: Column) -> Column:
    return F.conv(F.substr(stream, place * 2 % 256 + 1, F.lit(2)), 16, 10).cast("int")


def _alike(text: Column, stream: Column, digits: str = "0123456789", lower: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Digits for digits and letters for letters of the same case; marks stay. A leading digit stays above 0."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        pick = lambda letters: F.substr(F.lit(letters), b % len(letters) + 1, F.lit(1))
        return (
            F.when(c.rlike("^[1-9]$") & (i == 0), (b % 9 + 1).cast("string"))
            .when(c.rlike("^[0-9]$"), pick(digits))
            .when(c.rlike("^[a-z]$"), pick(lower))
            .when(c.rlike("^[A-Z]$"), pick(lower.upper()))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn(body: Column) -> Column:
    """The check digit behind ``body``."""
    n = F.length(body)

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.transform(_chars(body), weighed), F.lit(0), lambda s, d: s + d)
    return ((10 - total % 10) % 10).cast("string")


def _iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of an account number."""

    def step(rest97: Column, c: Column) -> Column:
        letter = c.rlike("^[A-Z]$")
        return F.when(letter, (rest97 * 100 + F.ascii(c) - 55) % 97).otherwise((rest97 * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)

    mod = F.aggregate(_chars(F.concat(rest, country, F.lit("00"))), F.lit(0), step)
    return F.lpad((98 - mod).cast("string"), 2, "0")


def _octets(norm: Column, stream: Column, wide: bool) -> Column:
    """Four octets, each with as many digits as before; any valid ones where ``wide``."""

    def one(octet: Column, i: Column) -> Column:
        b = _byte(stream, i * 2) * 256 + _byte(stream, i * 2 + 1)
        if wide:
            return (b % 254 + 1).cast("string")
        sized = F.when(F.length(octet) == 1, b % 9 + 1).when(F.length(octet) == 2, b % 90 + 10).otherwise(b % 155 + 100)
        return sized.cast("string")

    return F.array_join(F.transform(F.split(norm, r"\."), one), ".")


def _name(part: Column, gender: Column, stream: Column, syllables: int) -> Column:
    """A name made of syllables of the part's script, with an ending for its gender."""
    script = F.split(part, ":")[1]

    def made(name: str) -> Column:
        first, second = SOUNDS[name]
        pick = lambda letters, place: F.get(F.array(*[F.lit(x) for x in letters]), _byte(stream, F.lit(place)) % len(letters))
        sounds = [pick(letters, 2 * k + p) for k in range(syllables) for p, letters in enumerate((first, second))]
        ending = reduce(
            lambda column, g: column.when(gender == g, pick(ENDINGS[name][g], 60)), ("m", "f"), F.when(F.lit(False), "")
        ).otherwise(pick(ENDINGS[name]["n"], 61))
        return F.concat(*sounds, ending)

    return F.when(script == "cyrillic", made("cyrillic")).when(script == "greek", made("greek")).otherwise(made("latin"))


def candidate(part: Column, norm: Column, gender: Column, stream: Column, draw: int) -> Column:
    """The ``draw``-th candidate surrogate of a normal form, from its ``_stream``.

    From a certain draw on candidates are longer than the normal form, by one
    more digit for every second draw.
    """
    longer = max(0, (draw - _FIXED_DRAWS) // 2 + 1)
    tail = F.concat(*[(_byte(stream, F.lit(70 + i)) % 10).cast("string") for i in range(longer)]) if longer else F.lit("")
    alike = _alike(norm, stream)
    # The last label of an address's domain stays.
    address = F.concat(tail, _alike(F.regexp_extract(norm, r"^(.*)\.[^.]*$", 1), stream), F.regexp_extract(norm, r"(\.[^.]*)$", 1))
    body = F.concat(alike.substr(F.lit(1), F.length(norm) - 1), tail)
    valid = _luhn(norm.substr(F.lit(1), F.length(norm) - 1)) == F.right(norm, F.lit(1))
    # The country code of a number with a plus stays.
    code = F.regexp_extract(norm, r"^(\+(?:1|7|[2-69][0-9]|8[0-9]))", 1)
    phone = F.concat(code, _alike(norm.substr(F.length(code) + 1, F.length(norm)), stream), tail)
    country, rest = F.left(norm, F.lit(2)), F.concat(_alike(norm.substr(F.lit(5), F.length(norm)), stream), tail)
    hexadecimal = _alike(norm, stream, lower="abcdef")
    marked = F.regexp_extract(norm, r"^(AKIA|ASIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[_\-])", 1)
    secret = F.when(norm.rlike("^[0-9a-f]+$"), hexadecimal).otherwise(
        F.concat(marked, _alike(norm.substr(F.length(marked) + 1, F.length(norm)), stream))
    )
    return (
        F.when(part == "email", address)
        .when(part == "ipv4", _octets(norm, stream, wide=draw >= 4))
        .when(part == "card", F.when(valid, F.concat(body, _luhn(body))).otherwise(F.concat(alike, tail)))
        .when(part == "phone", phone)
        .when(part == "iban", F.concat(country, _iban_check(country, rest), rest))
        .when(part.startswith("name:"), _name(part, gender, stream, 3 + draw // 2))
        .when(part == "secret", F.concat(secret, tail))
        .otherwise(F.concat(alike, tail))
    )


def distinct_surrogates(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(part, norm, surrogate) for distinct (part, norm), with gender: no two share a surrogate and none is a real entity of the table.

    Of several that draw the same candidate the least keeps it; the others
    draw again. Ends with an error if some still collide after ``rounds``.
    """
    real = entities.select("part", F.col("norm").alias("candidate"))
    pending, taken = entities, None
    for draw in range(rounds):
        # The digest is a column of its own, else each character would ask for it anew.
        drawn = pending.withColumn("stream", _stream(key, F.col("part"), F.col("norm"), draw))
        drawn = drawn.withColumn("candidate", candidate(F.col("part"), F.col("norm"), F.col("gender"), F.col("stream"), draw))
        won = drawn.groupBy("part", "candidate").agg(F.min("norm").alias("norm")).join(real, ["part", "candidate"], "left_anti")
        if taken is not None:
            won = won.join(taken.select("part", F.col("surrogate").alias("candidate")), ["part", "candidate"], "left_anti")
        won = won.select("part", "norm", F.col("candidate").alias("surrogate"))
        taken = stored(won if taken is None else taken.unionByName(won), "surrogates")
        pending = entities.join(taken, ["part", "norm"], "left_anti")
        if pending.isEmpty():
            return taken
    raise ValueError(f"some surrogates still collide after {rounds} draws")


def _masked(raw: Column, digits: Column) -> Column:
    """``raw`` with its digits replaced in order; further digits stand behind."""

    def one(c: Column, i: Column) -> Column:
        place = F.length(_digits(raw.substr(F.lit(1), i + 1)))
        return F.when(c.rlike("^[0-9]$"), digits.substr(place, F.lit(1))).otherwise(c)

    more = digits.substr(F.length(_digits(raw)) + 1, F.length(digits))
    return F.concat(F.array_join(F.transform(_chars(raw), one), ""), more)


def _spaced(raw: Column, letters: Column) -> Column:
    """``raw`` with its characters other than spaces replaced in order; further ones stand behind."""

    def one(c: Column, i: Column) -> Column:
        place = F.length(F.replace(raw.substr(F.lit(1), i + 1), F.lit(" "), F.lit("")))
        return F.when(c != " ", letters.substr(place, F.lit(1))).otherwise(c)

    more = letters.substr(F.length(F.replace(raw, F.lit(" "), F.lit(""))) + 1, F.length(letters))
    return F.concat(F.array_join(F.transform(_chars(raw), one), ""), more)


def replacements(raws: DataFrame, key: str) -> DataFrame:
    """(raw, kind, replacement) for distinct entity texts ``raw``, each in its own format and case."""
    kinds = raws.select("raw", kind_of(F.col("raw")).alias("kind"))
    parts = kinds.select("raw", "kind", F.posexplode(_parts(F.col("kind"), F.col("raw"))).alias("place", "p"))
    parts = stored(parts.select("raw", "kind", "place", "p.part", "p.norm", "p.gender"), "entity-parts")
    # A title that tells the gender settles it for the name everywhere.
    gender = F.coalesce(F.min(F.when(F.col("gender") != "n", F.col("gender"))), F.lit("n"))
    chosen = distinct_surrogates(stored(parts.groupBy("part", "norm").agg(gender.alias("gender")), "distinct-entities"), key)
    found = spread_lookup(parts, chosen, ["part", "norm"], ["raw"])
    found = found.groupBy("raw", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "surrogate"))), lambda s: s["surrogate"]).alias("s"))
    raw, first = F.col("raw"), F.get("s", F.lit(0))
    names = F.split(raw, " ")

    def cased(name: Column, i: Column) -> Column:
        new = F.get("s", i - 1)
        new = F.when((name == F.upper(name)) & (F.length(name) > 1), F.upper(new)).otherwise(F.initcap(new))
        return F.when(i == 0, name).otherwise(new)

    replacement = (
        F.when(F.col("kind") == "person", F.array_join(F.transform(names, cased), " "))
        .when(F.col("kind").isin("phone", "ssn", "card"), _masked(raw, _digits(first)))
        .when(F.col("kind") == "iban", _spaced(raw, first))
        .when(F.col("kind") == "secret", F.concat(F.regexp_extract(raw, f"^({_SECRET_HEAD})", 1), first))
        .when((F.col("kind") == "email") & (raw == F.upper(raw)), F.upper(first))
        .otherwise(first)
    )
    return found.select("raw", "kind", replacement.alias("replacement"))


def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_entities, entities) of every row, personal data replaced.

    entities lists (kind, replacement) in the order of the text. A text
    without entities, empty or null, comes back as it is. Rows that repeat an
    id and text each come back. The key decides all surrogates; keep it secret.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ANY), F.lit(False))
    marked = plain.filter(has).withColumn("row", F.md5(F.concat_ws("|", F.col("id").cast("string"), "text").cast("binary")))
    found = marked.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(ANY), 0)).alias("place", "raw")).distinct()
    found = stored(found, "entities")
    new = replacements(found.select("raw").distinct(), key)
    told = spread_lookup(found, new, ["raw"], ["row", "place"])
    told = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "replacement"))).alias("told"))
    gaps = F.split("text", ANY, -1)
    pieces = F.arrays_zip(gaps.alias("gap"), F.transform("told", lambda t: t["replacement"]).alias("new"))
    # concat of a gap and what stood behind it; nothing stands behind the last one.
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(p["new"], F.lit("")))), "")
    listed = F.transform("told", lambda t: F.struct(t["kind"].alias("kind"), t["replacement"].alias("replacement")))
    # Written first, so that copies of one row that very many rows are can be split.
    changed = marked.join(stored(told, "told"), "row").select("id", text.alias("text"), F.size("told").cast("long").alias("n_entities"), listed.alias("entities"))
    none = F.array().cast("array<struct<kind:string,replacement:string>>")
    same = plain.filter(~has).select("id", "text", F.lit(0).cast("long").alias("n_entities"), none.alias("entities"))
    return changed.unionByName(same)
