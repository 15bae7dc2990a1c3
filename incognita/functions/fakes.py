"""Realistic replacement values as native column expressions.

Each fake is a pure function of (seed, type, original): one MD5 digest per value,
cut into 32-bit slices which pick from short word lists or form digits. The same
input gives the same fake in every row, column, table, partition and run with one
seed, without shared state, a shuffle or a Python worker.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from incognita.functions.arrays import literal_array
from incognita.rules import SAFE_EMAIL_DOMAINS

# --- Invented word lists --------------------------------------------------
FIRST_NAMES = (
    "Anton Berta Clemens Dora Emil Frieda Gustav Hedwig Ida Jakob Klara Ludwig "
    "Mathilde Norbert Ottilie Paul Quirin Rosa Siegfried Thea Ulrich Viktoria "
    "Wilhelm Xaver Yvonne Zeno Jörg Käthe Björn Änne Günter Sören"
).split()
LAST_STEMS = (
    "Acker Birken Dorn Eich Feld Gersten Hage Kalt Linden Moor Nuss Ober "
    "Pfeil Reben Stein Tannen Ufer Vogel Wald Zander"
).split()
LAST_ENDINGS = "mann meier bauer hofer wirth müller berger bach huber schmied".split()
STREET_STEMS = (
    "Ahorn Buchen Dorf Erlen Fichten Garten Heide Kirch Linden Markt "
    "Nelken Park Quell Rosen Schul Tal"
).split()
STREET_ENDINGS = "straße weg allee gasse platz ring".split()
CITY_STEMS = (
    "Alten Brunn Eber Fried Grün Hohen Königs Lauter Mühl Neuen "
    "Ober Rothen Schön Unter Weiden Wolfs"
).split()
CITY_ENDINGS = "burg berg dorf feld hausen heim stadt tal".split()
COUNTRIES = (
    "Deutschland Österreich Schweiz Frankreich Italien Spanien Portugal Polen "
    "Tschechien Ungarn Dänemark Schweden Norwegen Finnland Belgien Niederlande "
    "Luxemburg Irland Griechenland Kroatien"
).split()
LEGAL_FORMS = ["GmbH", "AG", "KG", "OHG", "e.V.", "GmbH & Co. KG"]
WORDS = (
    "amsel birke distel efeu farn ginster hafer iris jasmin klee lupine mohn "
    "nelke olive primel quitte raps salbei tulpe ulme veilchen wicke ysop zeder"
).split()
RESERVED_TLDS = ["example", "test", "invalid"]
# --- End of word lists ----------------------------------------------------

DEFAULT_SEED = "incognita"

Generator = Callable[[Column, Column], Column]


def digest(kind: str | Column, value: Column, seed: str = DEFAULT_SEED) -> Column:
    """Hex digest that all choices for one value are cut from."""
    kind_col = F.lit(kind) if isinstance(kind, str) else kind
    return F.md5(F.concat_ws("|", F.lit(seed), kind_col, value))


def pick(key: Column, slot: int, n: int) -> Column:
    """A number 0..n-1 from the slot-th of the four 32-bit slices of a digest."""
    part = F.conv(F.substring(key, 1 + 8 * slot, 8), 16, 10).cast("bigint")
    return F.pmod(part, F.lit(n).cast("bigint"))


def _choose(key: Column, slot: int, words: list[str]) -> Column:
    return F.get(literal_array(words), pick(key, slot, len(words)).cast("int"))


def _digits(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _plain(words: list[str]) -> list[str]:
    """Lower case with everything but a-z, 0-9, dot, underscore, hyphen removed."""
    allowed = set("abcdefghijklmnopqrstuvwxyz0123456789._-")
    return ["".join(c for c in unicodedata.normalize("NFC", w).lower() if c in allowed) for w in words]


def _compound(key: Column, slot: int, stems: list[str], endings: list[str]) -> Column:
    return F.concat(_choose(key, slot, stems), _choose(key, slot + 1, endings))


def first_name(value: Column, key: Column) -> Column:
    return _choose(key, 0, FIRST_NAMES)


def last_name(value: Column, key: Column) -> Column:
    return _compound(key, 1, LAST_STEMS, LAST_ENDINGS)


def full_name(value: Column, key: Column) -> Column:
    return F.concat_ws(" ", first_name(value, key), last_name(value, key))


def _local_part(key: Column) -> Column:
    last = _compound(key, 1, _plain(LAST_STEMS), _plain(LAST_ENDINGS))
    return F.concat(_choose(key, 0, _plain(FIRST_NAMES)), F.lit("."), last)


def email(value: Column, key: Column) -> Column:
    return F.concat(_local_part(key), F.lit("@"), _choose(key, 3, SAFE_EMAIL_DOMAINS))


def username(value: Column, key: Column) -> Column:
    return _local_part(key)


def phone(value: Column, key: Column) -> Column:
    area = (pick(key, 0, 900) + 100).cast("string")
    return F.concat(F.lit("+49 "), area, F.lit(" "), _digits(pick(key, 1, 10_000_000), 7))


def street(value: Column, key: Column) -> Column:
    return _compound(key, 0, STREET_STEMS, STREET_ENDINGS)


def house_number(value: Column, key: Column) -> Column:
    return (pick(key, 0, 199) + 1).cast("string")


def postcode(value: Column, key: Column) -> Column:
    return _digits(pick(key, 0, 99_999) + 1, 5)


def city(value: Column, key: Column) -> Column:
    return _compound(key, 0, CITY_STEMS, CITY_ENDINGS)


def country(value: Column, key: Column) -> Column:
    return _choose(key, 0, COUNTRIES)


def birthdate(value: Column, key: Column) -> Column:
    """Moved by 30 to 365 days either way, in the format of the original;
    a value that is no date becomes some ISO date."""
    shift = (pick(key, 0, 336) + 30) * (pick(key, 1, 2) * 2 - 1)
    days = shift.cast("int")
    german = F.when(value.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.try_to_date(value, "dd.MM.yyyy"))
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}(?:[ T].*)?$"), value.try_cast("date"))
    some_day = F.date_add(F.lit("1970-01-01").cast("date"), pick(key, 2, 20_000).cast("int"))
    return F.when(german.isNotNull(), F.date_format(F.date_add(german, days), "dd.MM.yyyy")).otherwise(
        F.date_format(F.coalesce(F.date_add(iso, days), some_day), "yyyy-MM-dd")
    )


def age(value: Column, key: Column) -> Column:
    return (pick(key, 0, 63) + 18).cast("string")


def iban(value: Column, key: Column) -> Column:
    """German IBAN with valid check digits.

    The check number is 98 - (account followed by "DE00" in digits) mod 97; with
    the account as two nine-digit halves this stays in 64-bit arithmetic.
    """
    left, right = pick(key, 0, 10**9), pick(key, 1, 10**9)
    rest = F.pmod(left * (10**15 % 97) + right * (10**6 % 97) + 131400 % 97, F.lit(97))
    return F.concat(F.lit("DE"), _digits(F.lit(98) - rest, 2), _digits(left, 9), _digits(right, 9))


def bic(value: Column, key: Column) -> Column:
    letters = F.translate(F.substring(key, 1, 6), "0123456789abcdef", "ABCDEFGHIJKLMNOP")
    return F.concat(F.substring(letters, 1, 4), F.lit("DE"), F.substring(letters, 5, 2), F.lit("XXX"))


def company(value: Column, key: Column) -> Column:
    return F.concat_ws(" ", last_name(value, key), _choose(key, 3, LEGAL_FORMS))


def password(value: Column, key: Column) -> Column:
    """12 to 20 characters."""
    text = F.base64(F.unhex(F.sha2(key, 256)))
    return F.substring(text, F.lit(1), (pick(key, 0, 9) + 12).cast("int"))


def ip(value: Column, key: Column) -> Column:
    octets = [F.conv(F.substring(key, 1 + 2 * i, 2), 16, 10) for i in range(4)]
    return F.concat_ws(".", *octets)


def ipv6(value: Column, key: Column) -> Column:
    return F.concat_ws(":", *[F.substring(key, 1 + 4 * i, 4) for i in range(8)])


def mac(value: Column, key: Column) -> Column:
    return F.upper(F.concat_ws(":", *[F.substring(key, 1 + 2 * i, 2) for i in range(6)]))


def domain(value: Column, key: Column) -> Column:
    return F.concat_ws(".", _choose(key, 0, WORDS), _choose(key, 1, RESERVED_TLDS))


def url(value: Column, key: Column) -> Column:
    return F.concat(F.lit("https://"), domain(value, key))


def ssn(value: Column, key: Column) -> Column:
    return (pick(key, 0, 900_000_000) + 100_000_000).cast("string")


def tax_id(value: Column, key: Column) -> Column:
    head = (pick(key, 0, 900_000) + 100_000).cast("string")
    return F.concat(head, _digits(pick(key, 1, 100_000), 5))


def uuid(value: Column, key: Column) -> Column:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(key, start, length) for start, length in cuts])


def word(value: Column, key: Column) -> Column:
    return _choose(key, 0, WORDS)


GENERATORS: dict[str, Generator] = {
    "first_name": first_name,
    "last_name": last_name,
    "full_name": full_name,
    "email": email,
    "phone": phone,
    "street": street,
    "house_number": house_number,
    "postcode": postcode,
    "city": city,
    "country": country,
    "birthdate": birthdate,
    "age": age,
    "iban": iban,
    "bic": bic,
    "bank": company,
    "company": company,
    "username": username,
    "password": password,
    "ip": ip,
    "ipv6": ipv6,
    "mac": mac,
    "domain": domain,
    "url": url,
    "ssn": ssn,
    "tax_id": tax_id,
    "uuid": uuid,
    "word": word,
}

# Spark types a column may keep, as every fake of the type fits them.
NATIVE_TYPES: dict[str, set[str]] = {
    "age": {"tinyint", "smallint", "int", "bigint"},
    "house_number": {"smallint", "int", "bigint"},
    "postcode": {"int", "bigint"},
    "ssn": {"int", "bigint"},
    "tax_id": {"bigint"},
    "birthdate": {"date", "timestamp", "timestamp_ntz"},
}


def register_type(name: str, generator: Generator) -> None:
    """Add or replace a fake type: ``generator(original, digest) -> Column``."""
    GENERATORS[name] = generator


def generate(kind: str, value: Column, key: Column) -> Column:
    """The fake for a value whose digest is already at hand; a type nobody
    registered gives a plain word."""
    return GENERATORS.get(kind, word)(value, key)


def generate_by(kind: Column, kinds: list[str], value: Column, key: Column) -> Column:
    """Like :func:`generate` where the type is itself a column; ``kinds`` lists
    the types that can occur, so that the plan holds only those."""
    out = None
    for name in dict.fromkeys(kinds):
        fake = generate(name, value, key)
        out = F.when(kind == name, fake) if out is None else out.when(kind == name, fake)
    return word(value, key) if out is None else out.otherwise(word(value, key))


def fake(kind: str, value: Column, seed: str = DEFAULT_SEED, preserve=None) -> Column:
    """One-expression form: NULL and preserved values stay, others are replaced."""
    text = value.cast("string")
    made = generate(kind, text, digest(kind, text, seed))
    keep = text.isNull() if preserve is None else text.isNull() | preserve.matches(text)
    return F.when(keep, text).otherwise(made)
