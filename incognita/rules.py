"""Rule data: which names and values count as personal data.

Everything in the first part of this module is a fixed value of the rule set.
The helpers below turn the text into small Python objects.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


# --- Fixed values ---------------------------------------------------------

# normalised column name, type, generator name, weight
COLUMN_RULES_TEXT = """
firstname       first_name    firstName       10
first_name      first_name    firstName       10
vorname         first_name    firstName       10
lastname        last_name     lastName        10
last_name       last_name     lastName        10
nachname        last_name     lastName        10
name            full_name     name            8
fullname        full_name     name            8
full_name       full_name     name            8
email           email         safeEmail       10
mail            email         safeEmail       9
e_mail          email         safeEmail       10
contact_email   email         safeEmail       10
email_address   email         safeEmail       10
user_email      email         safeEmail       9
customer_email  email         safeEmail       9
phone           phone         phoneNumber     10
telefon         phone         phoneNumber     10
mobile          phone         phoneNumber     9
mobilnummer     phone         phoneNumber     10
fax             phone         phoneNumber     8
street          street        streetName      10
strasse         street        streetName      10
straße          street        streetName      10
address         street        streetAddress   9
adresse         street        streetAddress   9
housenumber     house_number  buildingNumber  8
hausnummer      house_number  buildingNumber  8
zip             postcode      postcode        10
plz             postcode      postcode        10
postal_code     postcode      postcode        10
city            city          city            10
stadt           city          city            10
ort             city          city            10
country         country       country         6
land            country       country         6
birthdate       birthdate     date            10
birthday        birthdate     date            10
geburtsdatum    birthdate     date            10
dob             birthdate     date            10
age             age           numberBetween   5
alter           age           numberBetween   5
iban            iban          iban            10
bic             bic           swiftBicNumber  10
bank            bank          company         6
konto           iban          iban            8
account         iban          iban            7
company         company       company         8
firma           company       company         8
organisation    company       company         8
org             company       company         7
username        username      userName        9
user_name       username      userName        9
login           username      userName        8
password        password      password        10
passwort        password      password        10
ip              ip            ipv4            10
ip_address      ip            ipv4            10
ipv4            ip            ipv4            10
ipv6            ip            ipv6            10
mac             mac           macAddress      9
mac_address     mac           macAddress      9
hostname        domain        domainName      6
url             url           url             7
website         url           url             7
webseite        url           url             7
ssn             ssn           randomNumber    10
tax_id          tax_id        randomNumber    10
steuernummer    tax_id        randomNumber    10
person_id       uuid          uuid            7
customer_id     uuid          uuid            6
employee_id     uuid          uuid            6
member_id       uuid          uuid            6
"""

# type, weight, regular expression; the first matching line decides
VALUE_PATTERNS_TEXT = r"""
email        10  [a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}
phone_de     9   (?:\+49|0)[\s\-]?[\d\s\-]{6,20}
iban         10  [A-Z]{2}\d{2}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{2}
ipv4         10  \b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b
ipv6         10  (?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}
url          8   https?:\/\/(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&\/=]*)
uuid         7   [0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}
postcode_de  7   \b\d{5}\b
date_iso     6   \d{4}-\d{2}-\d{2}
date_de      6   \d{2}\.\d{2}\.\d{4}
"""

# type, regular expression: the word-bounded variants used for office documents
DOCUMENT_PATTERNS_TEXT = r"""
email  \b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b
phone  \b(?:\+49|0)[\s\-/]?[\d\s\-/]{6,20}\b
iban   \b[A-Z]{2}\d{2}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{2}\b
ipv4   \b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b
url    \bhttps?:\/\/(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&\/=]*)\b
uuid   \b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b
"""

# table name, score multiplier
TABLE_CONTEXT_TEXT = """
users      1.5
customers  1.5
contacts   1.5
members    1.5
persons    1.5
people     1.5
employees  1.5
accounts   1.3
clients    1.4
patients   1.5
students   1.4
orders     1.2
invoices   1.2
leads      1.3
"""

SAFE_EMAIL_DOMAINS = ["example.test", "example.invalid", "example.local"]

DEFAULT_PRESERVE_WORDS = """
admin administrator root system guest anonymous null test demo support noreply
no-reply postmaster webmaster hostmaster abuse info sales marketing help contact
""".split()

# pattern type -> fake type; anything else becomes a plain word
PATTERN_FAKE_TYPES = {
    "email": "email",
    "phone_de": "phone",
    "iban": "iban",
    "ipv4": "ip",
    "ipv6": "ip",
    "url": "url",
    "uuid": "uuid",
    "postcode_de": "postcode",
    "date_iso": "birthdate",
    "date_de": "birthdate",
}

# --- End of fixed values --------------------------------------------------

HIGH_SCORE, MEDIUM_SCORE = 9, 6


@dataclass(frozen=True)
class ColumnRule:
    name: str
    type: str
    faker: str
    weight: int


@dataclass(frozen=True)
class Pattern:
    """A value pattern. ``regex`` is the rule as stated, ``spark_regex`` the
    form handed to Spark (see :func:`ascii_word_boundaries`)."""

    type: str
    regex: str
    weight: int
    fake_type: str
    # a short regex that occurs in every match, "" if there is none known
    needs: str = ""
    # what is known of the edges of a match, see EDGES
    edges: tuple = ()

    @property
    def spark_regex(self) -> str:
        return linear_email(ascii_word_boundaries(self.regex, *self.edges))


DIGIT = "[0-9]"

# What every match of a built-in pattern holds. These start with a rare character or a digit,
# so looking for them first is far cheaper than the full scan, and it settles most
# texts.
NEEDED = {
    "email": "@[a-zA-Z0-9.-]",
    "phone_de": DIGIT,
    "phone": DIGIT,
    "iban": DIGIT,
    "ipv4": r"\.[0-9]{1,3}\.[0-9]",
    "ipv6": ":[0-9a-fA-F]{1,4}:[0-9a-fA-F]",
    "url": "://",
    "uuid": "-[0-9a-fA-F]{4}-[0-9a-fA-F]",
    "postcode_de": DIGIT,
    "date_iso": "-[0-9]{2}-[0-9]",
    "date_de": r"\.[0-9]{2}\.[0-9]",
}

# What is known of the edges of a built-in pattern's match: the class of its first character, whether
# that is always a word character, whether the last one is.
EDGES = {
    "phone": ("[+0]", False, False),
    "iban": ("[A-Z]", True, True),
    "ipv4": ("[0-9]", True, True),
    "uuid": ("[0-9a-fA-F]", True, True),
    "postcode_de": ("[0-9]", True, True),
    "url": ("h", True, False),
}

# Spark's regex engine counts letters such as "ü" as word characters for \b;
# the rules mean ASCII words, so each \b becomes an explicit look-around.
_WORD = "[A-Za-z0-9_]"
ASCII_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def ascii_word_boundaries(
    regex: str, first: str = "", word_start: bool = False, word_end: bool = False
) -> str:
    """``\\b`` for ASCII words. Looking at the first character before looking around
    settles most positions, and next to a character known to be a word character
    half of the general test is settled already."""
    if first and regex.startswith(r"\b"):
        before = f"(?<!{_WORD})" if word_start else ASCII_BOUNDARY
        regex = f"(?={first}){before}{regex[2:]}"
    if word_end and regex.endswith(r"\b"):
        regex = regex[:-2] + f"(?!{_WORD})"
    return regex.replace(r"\b", ASCII_BOUNDARY)


def linear_email(regex: str) -> str:
    """Let an e-mail scan start only where a local part can start.

    The stated pattern retries from every character of a run of local-part
    characters, which is quadratic on long unbroken runs (base64 and the like).
    A leftmost match always starts at the head of such a run or right after the
    match before it, so anchoring there finds the same matches in linear time.
    """
    local = "[a-zA-Z0-9._%+-]"
    if not regex.startswith(local + "+@"):
        return regex
    return rf"(?:\G|(?<!{local})){local}++@" + regex[len(local) + 2 :]


def _lines(text: str) -> list[str]:
    return [line for line in text.splitlines() if line.strip()]


COLUMN_RULES: list[ColumnRule] = [
    ColumnRule(name, kind, faker, int(weight))
    for name, kind, faker, weight in (line.split() for line in _lines(COLUMN_RULES_TEXT))
]

TABLE_CONTEXT: dict[str, float] = {
    table: float(factor) for table, factor in (line.split() for line in _lines(TABLE_CONTEXT_TEXT))
}


def _built_in(kind: str, regex: str, weight: int, fake_type: str) -> Pattern:
    return Pattern(kind, regex, weight, fake_type, NEEDED.get(kind, ""), EDGES.get(kind, ()))


def _value_patterns(text: str) -> list[Pattern]:
    out = []
    for line in _lines(text):
        kind, weight, regex = line.split(maxsplit=2)
        out.append(_built_in(kind, regex, int(weight), PATTERN_FAKE_TYPES.get(kind, "word")))
    return out


STANDARD_PATTERNS: list[Pattern] = _value_patterns(VALUE_PATTERNS_TEXT)

DOCUMENT_PATTERNS: list[Pattern] = [
    _built_in(kind, regex, 0, "ip" if kind == "ipv4" else kind)
    for kind, regex in (line.split(maxsplit=1) for line in _lines(DOCUMENT_PATTERNS_TEXT))
]


def corrected_patterns() -> list[Pattern]:
    """The standard set with three known weaknesses mended: compact German
    IBANs are found (and tried before phone numbers), a phone number neither
    starts inside a longer run of digits nor ends on blanks, and therefore no
    longer eats ISO dates or line breaks."""
    phone = r"(?<![A-Za-z0-9_\-])(?:\+49|0)[\s\-]?(?:\d[ \-]?){5,18}\d(?!\d)"
    german_iban = _built_in("iban", r"\bDE\d{2}[ ]?(?:\d{4}[ ]?){4}\d{2}\b", 10, "iban")
    mended = {"phone_de": _built_in("phone_de", phone, 9, "phone")}
    general = [mended.get(p.type, p) for p in STANDARD_PATTERNS]
    return [german_iban, *general]


PATTERN_SETS = {
    "standard": STANDARD_PATTERNS,
    "corrected": corrected_patterns(),
    "document": DOCUMENT_PATTERNS,
}


def patterns_for(name_or_list: str | list[Pattern], types: list[str] | None = None) -> list[Pattern]:
    """A named pattern set (or an own list), optionally only the given types,
    in the order of ``types`` as that order breaks ties."""
    chosen = PATTERN_SETS[name_or_list] if isinstance(name_or_list, str) else list(name_or_list)
    if types is None:
        return list(chosen)
    return [p for t in types for p in chosen if p.type == t]


def normalize(name: str) -> str:
    return re.sub("[- ]", "_", name).lower()


def column_rule(name: str, rules: list[ColumnRule] | None = None) -> ColumnRule | None:
    """Driver-side lookup of one column name (schemas are small)."""
    by_name = {r.name: r for r in (COLUMN_RULES if rules is None else rules)}
    return by_name.get(normalize(name))
