"""PII surrogates: detected entities get keyed, type-consistent replacements.

Emails, phone numbers (international, and national as (555) 123-4567 or 555-123-4567), IPv4 and IPv6
addresses, IBANs, payment cards, national ids, and names after a title or a cue ("my name is") are found
by one pattern over the whole text.

A surrogate belongs to an entity's canonical key, not to its spelling: the digits of a number, the
lower-cased mail, the lower-cased tokens of a name without its title. `4111-1111-1111-1111` and
`4111111111111111` thus get one surrogate, written as each of them was; `Mr. John Smith`, `Mr John Smith`
and `Mr. Smith` share that of smith (coreference). A surrogate is derived from sha256(key, type,
canonical key, attempt): digits become digits and letters letters of the same script; separators,
letter case, country codes, top-level domains, titles and cues stay; IPv4 octets stay in range, a card that
passes its checksum still does, an IBAN's check digits fit; a given name ends in a or n by the gender of
most titles that it has in the corpus. A collision check over the whole mapping - two keys with one
surrogate, or a surrogate that is some real key - sends the later keys to their next attempt, until
there is none (distinctness).

Only DataFrame operations. The pattern runs once over the corpus and writes the entities of touched
documents; the mapping has a row per distinct key, never per occurrence. Where the touched documents hold
no more than `broadcast_entities` entities their replacements are broadcast, else documents with a sign of
an entity are joined by shuffling and the others pass unmoved.

Edge cases: a null text stays null; texts without an entity are unchanged; rows that share doc_id and
text are changed alike; a null doc_id is told apart by its text; an empty table gives an empty
result; columns other than doc_id and text pass through, whatever their names (n_entities alone is
replaced). Texts may be of any length; an entity is found up to the lengths in its pattern.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import let, materialize, release

# Titles by the gender that they tell, cues that a name follows, and the detectors by type,
# in order of precedence.
TITLES = {
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Signora|Doña|Lady|Госпожа",
    "m": "Mr|Herr|Monsieur|Señor|Sr|Signor|Don|Sir|Господин",
    "": "Mx|Dr|Prof|Doctor|Professor|Доктор|Профессор",
}
CUES = "[Mm]y name is|I am called|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m'appelle|[Mm]e llamo|[Mm]i nombre es|[Mm]i chiamo|[Мм]еня зовут|(?:Name|Contact|Kontakt|Patient|Nombre|Nom|Имя):"
PREFIX = rf"(?:(?:{'|'.join(TITLES.values())})\.? |(?:{CUES}) (?:(?:{'|'.join(TITLES.values())})\.? )?)"
NAME = r"\p{Lu}(?:\p{Ll}{0,30}[-'’]\p{Lu}?)?\p{Ll}{1,30}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "phone": r"(?=[+(\d])(?:(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\d-]))",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ip": r"(?=\d)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?=\d)(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
    "name": rf"(?=[A-ZА-Яijmм])(?<!\p{{L}}){PREFIX}{NAME}(?: {NAME}){{0,2}}(?!\p{{L}})",
}
NUMBERS = "|".join(f"(?:{PATTERNS[name]})" for name in ("phone", "iban", "ip", "ssn", "card"))


def detector(mail: bool, ipv6: bool) -> str:
    """All patterns, or all but those that a text without an @, or without two colons close by, can't match."""
    parts = [PATTERNS["email"]] * mail + [PATTERNS["ipv6"]] * ipv6 + [rf"(?=[\d+(A-Z])(?:{NUMBERS})", PATTERNS["name"]]
    return "|".join(f"(?:{p})" for p in parts)


#: Country codes by their first digits: one digit, two digits, else three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"
CONSONANTS = {"latin": "bcdfghjklmnprstvz", "cyrillic": "бвгджзклмнпрст"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу"}
LOWER = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя"}


def has_sign(text: Column) -> Column:
    """A cheap sign of every pattern's matches: a digit, an @, two colons as an IPv6 address has them, or a name."""
    return text.rlike("[0-9@]|:[0-9A-Fa-f]{0,4}:") | text.rlike(PATTERNS["name"])


def by_signs(text: Column, make) -> Column:
    """make(detector) for the detector that fits the text's signs: the dear patterns are tried only where they may match."""
    mail, ipv6 = F.contains(text, F.lit("@")), text.rlike(":[0-9A-Fa-f]{0,4}:")
    return F.when(mail, F.when(ipv6, make(detector(True, True))).otherwise(make(detector(True, False)))).when(ipv6, make(detector(False, True))).otherwise(make(detector(False, False)))


def kind(value: Column) -> Column:
    return reduce(lambda c, kv: F.when(value.rlike(f"^(?:{kv[1]})$"), kv[0]).otherwise(c), reversed(PATTERNS.items()), F.lit("card"))


def entities(text: Column) -> Column:
    """The entities of a text, in their order."""
    return by_signs(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))


def canonical(type_: Column, value: Column) -> Column:
    """What an entity is, as an array: a name's tokens in lower case, one key for everything else."""
    digits = F.regexp_replace(value, r"\D", "")
    phone = F.regexp_replace(F.regexp_replace(value, r"[^\d+]", ""), r"^\+?1(?=\d{10}$)", "")
    name = F.split(F.lower(F.regexp_replace(value, f"^{PREFIX}", "")), " ")
    one = F.when(type_ == "email", F.lower(value)).when(type_ == "phone", phone).when(type_ == "iban", F.regexp_replace(value, " ", "")).when(type_ == "ip", value).when(type_ == "ipv6", F.lower(value)).otherwise(digits)
    return F.when(type_ == "name", name).otherwise(F.array(one))


def gender(type_: Column, value: Column) -> Column:
    """1 for a woman, -1 for a man, 0 if unknown: of the given name, by the title before it."""
    titled = lambda g: value.rlike(rf"^(?:(?:{CUES}) )?(?:{TITLES[g]})\.? ")
    return F.when((type_ == "name") & titled("f"), 1).when((type_ == "name") & titled("m"), -1).otherwise(0)


def _digit(digest: Column, i: Column) -> Column:
    """A number 0..255 from the digest's i-th pair of hexadecimal digits, which repeat."""
    return F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(alphabet: str, number: Column) -> Column:
    return F.substr(F.lit(alphabet), number % len(alphabet) + 1, F.lit(1))


def scrambled(value: Column, digest: Column, letters: str = LOWER["latin"]) -> Column:
    """Each digit and letter of a canonical key replaced by another of its kind and script; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        n = _digit(digest, i)
        latin = F.when(c.rlike(r"^\p{Lu}$"), F.upper(_letter(letters, n))).otherwise(_letter(letters, n))
        return F.when(c.rlike(r"^\d$"), (n % 10).cast("string")).when(c.rlike(r"^\p{L}$"), latin).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def name_like(token: Column, sex: Column, digest: Column) -> Column:
    """A lower-case name of the same script and length, consonants and vowels in turn, which ends by its gender."""

    def one(c: Column, i: Column) -> Column:
        n = _digit(digest, i)
        pick = lambda s: F.when(i % 2 == 0, _letter(CONSONANTS[s], n)).otherwise(_letter(VOWELS[s], n))
        return F.when(c.rlike(r"^\p{IsCyrillic}$"), pick("cyrillic")).when(c.rlike(r"^\p{L}$"), pick("latin")).otherwise(c)

    def ended(name: Column) -> Column:
        cyrillic = name.rlike(r"\p{IsCyrillic}$")
        end = F.when(sex > 0, F.when(cyrillic, "а").otherwise("a")).otherwise(F.when(cyrillic, "н").otherwise("n"))
        return F.when(sex == 0, name).otherwise(F.concat(F.substr(name, F.lit(1), F.length(name) - 1), end))

    return let(F.array_join(F.transform(F.split(token, ""), one), ""), ended)


def luhn(digits: Column) -> Column:
    """The checksum of a string of digits, 0 if it passes."""

    def each(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when((F.length(digits) - i) % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(digits, ""), each), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and capital letters, A as 10 and so on."""
    number = lambda c: F.when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).otherwise(c.try_cast("int"))
    add = lambda r, n: F.when(n > 9, (r * 100 + n) % 97).otherwise((r * 10 + n) % 97)
    return F.aggregate(F.transform(F.split(text, ""), lambda c: F.coalesce(number(c), F.lit(0))), F.lit(0), add)


def surrogate(type_: Column, value: Column, sex: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical key."""
    digest = F.sha2(F.concat_ws("\x00", F.lit(key), type_, value, attempt.cast("string")), 256)

    def build(d: Column) -> Column:
        octets = F.array_join(F.transform(F.split(value, r"\."), lambda c, i: (_digit(d, i) % 254 + 1).cast("string")), ".")
        tld = F.regexp_extract(value, r"\.[a-z]+$", 0)
        email = F.concat(scrambled(F.substr(value, F.lit(1), F.length(value) - F.length(tld)), d), tld)
        country = F.regexp_extract(value, COUNTRY, 0)
        phone = F.concat(country, scrambled(F.substr(value, F.length(country) + 1), d))
        # from the fourth attempt on a name gets longer: short ones have few surrogates
        longer = F.concat(value, F.repeat(F.lit("n"), F.floor(attempt / 3).cast("int")))
        card = scrambled(value, d)
        # the last digit is moved so that the checksum passes: it counts once
        last = ((F.right(card, F.lit(1)).cast("int") + 10 - luhn(card)) % 10).cast("string")
        card = F.when(luhn(value) == 0, F.concat(F.substr(card, F.lit(1), F.length(card) - 1), last)).otherwise(card)
        account = scrambled(F.substr(value, F.lit(5)), d)
        check = F.lpad((98 - mod97(F.concat(account, F.left(value, F.lit(2)), F.lit("00")))).cast("string"), 2, "0")
        iban = F.concat(F.left(value, F.lit(2)), check, account)
        return (
            F.when(type_ == "email", email).when(type_ == "phone", phone).when(type_ == "ip", octets).when(type_ == "ipv6", scrambled(value, d, "abcdef"))
            .when(type_ == "name", name_like(longer, sex, d)).when(type_ == "card", card).when(type_ == "iban", iban).otherwise(scrambled(value, d))
        )

    return let(digest, build)


def dressed(type_: Column, value: Column, plain: Column) -> Column:
    """An array of surrogates of canonical keys, written as the entity was: its title, separators and case."""

    def filled(significant: str) -> Column:
        """The surrogate's last characters in the places of the entity's significant ones."""
        n = F.length(F.regexp_replace(value, f"[^{significant}]", ""))
        chars = F.regexp_replace(plain[0], f"[^{significant}]", "")

        def one(c: Column, i: Column) -> Column:
            before = F.length(F.regexp_replace(F.substr(value, F.lit(1), i), f"[^{significant}]", ""))
            at = before - (n - F.length(chars))
            return F.when(c.rlike(f"^[{significant}]$") & (at >= 0), F.substr(chars, at + 1, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.split(value, ""), one), "")

    cased = F.array_join(F.transform(F.split(plain[0], ""), lambda c, i: F.when(F.substr(value, i + 1, F.lit(1)).rlike("^[A-Z]$"), F.upper(c)).otherwise(c)), "")
    letter = lambda token, i: F.substr(token, i + 1, F.lit(1))
    like = lambda s, token: F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when(letter(token, i).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)), "")
    tokens = F.split(F.regexp_replace(value, f"^{PREFIX}", ""), " ")
    name = F.concat(F.regexp_extract(value, f"^{PREFIX}", 0), F.array_join(F.zip_with(plain, tokens, like), " "))
    return F.when(type_ == "name", name).when(type_.isin("email", "ipv6"), cased).when(type_ == "ip", plain[0]).when(type_ == "iban", filled("A-Z0-9")).otherwise(filled("0-9"))


def mapping(found: DataFrame, key: str, rounds: int = 30) -> DataFrame:
    """(type, value, surrogate) of the distinct canonical keys in found(type, value, sex): distinct surrogates,
    none of which is a key of the same type. sex is summed: most titles decide."""
    values = found.groupBy("type", "value").agg(F.signum(F.sum("sex")).cast("int").alias("sex")).withColumn("attempt", F.lit(0))
    columns = ("type", "value", "sex", "attempt")
    make = lambda df: materialize(df.select(*columns, surrogate(F.col("type"), F.col("value"), F.col("sex"), F.col("attempt"), key).alias("surrogate")))
    current = make(values)
    for _ in range(rounds):
        # of the keys that share a surrogate the one with most attempts, then the first, keeps it
        shared = current.withColumn("turn", F.row_number().over(Window.partitionBy("type", "surrogate").orderBy(F.desc("attempt"), "value")))
        real = current.select("type", F.col("value").alias("surrogate")).withColumn("real", F.lit(True))
        again = shared.join(real, ["type", "surrogate"], "left").withColumn("again", (F.col("turn") > 1) | F.col("real").isNotNull())
        checked = materialize(again.select(*columns, "surrogate", "again"))
        release(current)
        if checked.where("again").isEmpty():
            return checked.select("type", "value", "surrogate")
        moved = make(checked.where("again").select("type", "value", "sex", (F.col("attempt") + 1).alias("attempt")))
        current = materialize(checked.where("not again").select(*columns, "surrogate").unionByName(moved))
        release(checked, moved)
    raise ValueError(f"surrogates still collide after {rounds} attempts")


def replacements(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text_hash, new): the replacement of every entity of a touched document, in their order."""
    # exploding keeps the filter on its result from being computed beside it, with the pattern once more
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.array(entities(F.col("text")))).alias("found"))
    found = materialize(rows.where(F.size("found") > 0).dropDuplicates(["doc_id", "text_hash"]))
    values = found.select(F.explode("found").alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))
    values = values.select("entity", "n", kind(F.col("entity")).alias("type"))
    keyed = materialize(values.select("*", canonical(F.col("type"), F.col("entity")).alias("keys"), gender(F.col("type"), F.col("entity")).alias("sex")))
    # a gender belongs to the first of two tokens or more, once for each occurrence
    tokens = keyed.select("entity", "type", "keys", (F.col("sex") * F.col("n")).alias("sex"), F.posexplode("keys").alias("at", "value"))
    tokens = tokens.withColumn("sex", F.when((F.col("at") == 0) & (F.size("keys") > 1), F.col("sex")).otherwise(0).cast("long"))
    named = tokens.join(mapping(tokens, key), ["type", "value"])
    plain = named.groupBy("entity", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("plain"))
    table = materialize(plain.select("entity", dressed(F.col("type"), F.col("entity"), F.col("plain")).alias("new")))
    each = found.select("doc_id", "text_hash", F.posexplode("found").alias("at", "entity")).join(table, "entity")
    new = F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"])
    out = materialize(each.groupBy("doc_id", "text_hash").agg(new.alias("new")))
    release(found, keyed, table)
    return out


def pseudonymise(docs: DataFrame, key: str = "surrogate-key-1", broadcast_entities: int = 500_000) -> DataFrame:
    """docs with entities replaced in text, and n_entities: how many of them."""
    table = replacements(docs.select("doc_id", F.col("text").cast("string").alias("text")), key)
    # the row travels as one struct, so that its columns' names meet no other
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.col("text").cast("string").alias("old"))
    few = (table.agg(F.sum(F.size("new"))).first()[0] or 0) <= broadcast_entities
    rows = rows.withColumn("signed", F.lit(True) if few else F.coalesce(has_sign(F.col("old")), F.lit(False)))
    same = F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("old") == F.col("text_hash"))
    joined = rows.where("signed").join(F.broadcast(table) if few else table, same, "left").select("row", "old", "new")
    between = by_signs(F.col("old"), lambda p: F.split("old", p, -1))
    replaced = let(between, lambda parts: F.array_join(F.transform(parts, lambda part, i: F.concat(part, F.coalesce(F.get(F.col("new"), i), F.lit("")))), ""))
    text = F.when(F.col("new").isNull(), F.col("old")).otherwise(replaced)
    n = F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_entities")
    shaped = lambda text: [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "n_entities"]
    changed = joined.select(*shaped(text), n)
    return changed if few else changed.unionByName(rows.where("not signed").select(*shaped(F.col("old")), F.lit(0).cast("long").alias("n_entities")))
