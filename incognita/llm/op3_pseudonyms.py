"""Format-preserving pseudonyms for personal numbers, dates and addresses in text.

A value that passes its kind's checks is read as a number in mixed radix (a digit has ten
states, a letter 26, separators none) and permuted by a keyed Feistel network over exactly that
range; check digits are computed anew, and results that break the kind's rules are permuted again
until they fit. So a pseudonym has the form of its value and is valid, and equal values have equal
pseudonyms in every document, run and table with one key, however they are punctuated.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incognita.llm.common import column, small_batches, table

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A permutation of 0 … size - 1 that key and tweak choose.

    A balanced network over the next power of four, walked until the result lies in the range.
    """
    if size <= 1:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    width = -(-half // 8)
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            told = tweak.encode() + b"\0" + bytes([r]) + right.to_bytes(width, "big")
            f = hashlib.blake2b(told, key=key, digest_size=max(16, width)).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def permute_text(text: str, key: bytes, tweak: str) -> str:
    """Digits become digits, small and capital ASCII letters their like; the rest stays.

    Punctuation takes no part in the tweak, so a value has the same digits however it is written.
    """
    classes = [next((c for c in (DIGITS, LOWER, UPPER) if ch in c), "") for ch in text]
    value, size = 0, 1
    for ch, c in zip(text, classes, strict=True):
        if c:
            value, size = value * len(c) + c.index(ch), size * len(c)
    form = "".join({DIGITS: "9", LOWER: "a", UPPER: "A"}.get(c, "") for c in classes)
    value = feistel(value, size, key, f"{tweak}:{form}")
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if c := classes[i]:
            value, d = divmod(value, len(c))
            out[i] = c[d]
    return "".join(out)


def walked(text: str, key: bytes, tweak: str, fits: Callable[[str], bool]) -> str:
    """Permuted until it fits; as the value itself fits, the walk ends there at the latest."""
    out = permute_text(text, key, tweak)
    while not fits(out):
        out = permute_text(out, key, tweak)
    return out


def fill(form: str, value: str) -> str:
    """``form`` with its letters and digits replaced by those of ``value`` in turn."""
    it = iter(value)
    return "".join(next(it) if ch.isascii() and ch.isalnum() else ch for ch in form)


def plain(text: str) -> str:
    return "".join(ch for ch in text if ch.isascii() and ch.isalnum())


# --- kinds: what a value must be, and its pseudonym -----------------------------------------


def luhn(digits: str) -> int:
    """Sum by which a card number is tested, modulo 10; 0 is valid."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and not luhn(digits) and len(set(digits)) > 1


def card(text: str, key: bytes) -> str | None:
    """13 to 19 digits with a valid check digit; the first digit stays."""
    digits = plain(text)
    if not is_card(digits):
        return None
    body = digits[0] + permute_text(digits[1:-1], key, "card")
    return fill(text, body + str((10 - luhn(body + "0")) % 10))


def _iban_number(text: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in text[4:] + text[:4]))


# fixed values: characters of an account number by country
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def valid_iban(text: str) -> bool:
    value = plain(text)
    return 15 <= len(value) <= 34 and IBAN_LENGTHS.get(value[:2], len(value)) == len(value) and _iban_number(value) % 97 == 1


def iban(text: str, key: bytes) -> str | None:
    """Country, two check digits, 11 to 30 characters, as many as the country has; the country stays."""
    if not valid_iban(text):
        return None
    value = plain(text)
    body = permute_text(value[4:], key, "iban" + value[:2])
    check = 98 - _iban_number(value[:2] + "00" + body) % 97
    return fill(text, f"{value[:2]}{check:02d}{body}")


def phone(text: str, key: bytes) -> str | None:
    """International numbers of 8 to 15 digits; the country code stays. In +1, numbers whose area and
    exchange begin with 2 to 9 become such numbers, others others."""
    code = re.match(r"\+(1|7|[2-9][0-9])", text)
    digits = plain(text)
    if code is None or not 8 <= len(digits) <= 15:
        return None
    lead = code[1]
    national = digits[len(lead) :]

    def usual(x: str) -> bool:
        return lead != "1" or len(x) != 10 or (x[0] in "23456789" and x[3] in "23456789")

    like = usual(national)
    return fill(text, lead + walked(national, key, "phone" + lead, lambda x: usual(x) == like))


def ipv4(text: str, key: bytes) -> str | None:
    """Four numbers up to 255, the first not 0."""
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or not parts[0]:
        return None
    value = int.from_bytes(bytes(parts), "big")
    while True:
        value = feistel(value, 1 << 32, key, "ipv4")
        if value >> 24:
            return ".".join(str(b) for b in value.to_bytes(4, "big"))


def ssn(text: str, key: bytes) -> str | None:
    """Area not 000, 666 or 9xx, group not 00, serial not 0000."""

    def fits(x: str) -> bool:
        return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"

    digits = plain(text)
    return fill(text, walked(digits, key, "ssn", fits)) if fits(digits) else None


def date(text: str, key: bytes) -> str | None:
    """Calendar days of 1900 to 2099, written year-month-day, day.month.year or month/day/year."""
    a, b, c = (int(x) for x in re.split(r"[-./]", text))
    order = {"-": (a, b, c), ".": (c, b, a), "/": (c, a, b)}[re.search(r"[-./]", text)[0]]
    try:
        day = datetime.date(*order).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + feistel(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
    return new.strftime({"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%m/%d/%Y"}[re.search(r"[-./]", text)[0]])


def email(text: str, key: bytes) -> str | None:
    """The part before the @; the domain stays."""
    local, _, domain = text.rpartition("@")
    return f"{permute_text(local, key, 'email' + domain.lower())}@{domain}"


# in the order in which they take a stretch of text
KINDS: dict[str, tuple[re.Pattern, Callable[[str, bytes], str | None]]] = {
    "email": (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])"), email),
    "iban": (re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)"), iban),
    "date": (re.compile(r"(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\w-]|[./][0-9])"), date),
    "ipv4": (re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])"), ipv4),
    "ssn": (re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), ssn),
    "phone": (re.compile(r"(?<![\w+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){4,12}(?!\w))"), phone),
    "card": (re.compile(r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,}(?![\w-])"), card),
}
IBAN_START = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?=[ ]?[A-Z0-9])")
MAY_HOLD = re.compile(r"[0-9@]")
GROUP = re.compile(r"[0-9]+")

Change = tuple[str, int, int, str]  # kind, start, end, pseudonym


def usual_card(sizes: list[int]) -> bool:
    """Whether cards are written in groups of these sizes."""
    fours = len(sizes) > 3 and all(k == 4 for k in sizes[:-1]) and sizes[-1] <= 4
    return len(sizes) == 1 or fours or sizes in ([4, 6, 5], [4, 6, 4])


def card_spans(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of a run of groups of digits that are valid card numbers; none overlap.

    Groups in a stretch already taken by another value are left out. What is left is tried as a
    whole first, then each shorter stretch from group to group: those in the usual groups first,
    then by an issuer's first digit, then the longest, then the first.
    """
    parts: list[list[tuple[int, int]]] = [[]]
    for g in GROUP.finditer(text, start, end):
        if any(a < g.end() and g.start() < b for a, b in taken):
            parts.append([])
        else:
            parts[-1].append(g.span())
    out: list[tuple[int, int]] = []
    for groups in parts:
        found = []
        for i in range(len(groups)):
            digits, sizes = "", []
            for j in range(i, len(groups)):
                a, b = groups[j]
                digits, sizes = digits + text[a:b], [*sizes, b - a]
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and is_card(digits):
                    part = i > 0 or j < len(groups) - 1
                    found.append((part, not usual_card(sizes), digits[0] not in "3456", -len(digits), i, j))
        used: set[int] = set()
        for *_, i, j in sorted(found):
            if used.isdisjoint(range(i, j + 1)):
                used.update(range(i, j + 1))
                out.append((groups[i][0], groups[j][1]))
    return sorted(out)


def iban_spans(text: str, taken: list[tuple[int, int]], listed: bool) -> list[tuple[int, int]]:
    """Valid account numbers that reach into none of ``taken`` (by start); none overlap. Their
    countries are those in the list of lengths, or others.

    What follows a number may look like one more group of it, so from each start all stretches that
    end where a word ends are tried, the longest first.
    """
    pattern, out, behind, at = KINDS["iban"][0], [], 0, 0
    for start in IBAN_START.finditer(text):
        a = start.start()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if (text[a : a + 2] in IBAN_LENGTHS) != listed or a < behind or (at < len(taken) and taken[at][0] <= a):
            continue
        limit = taken[at][0] if at < len(taken) else len(text)
        m = pattern.match(text, a, limit)
        while m:
            b = m.end()
            if not (b < len(text) and (text[b].isalnum() or text[b] == "_")) and valid_iban(m[0]):
                out.append((a, b))
                behind = b
                break
            m = pattern.match(text, a, b - 1)
    return out


def changes(text: str, key: bytes) -> list[Change]:
    """Valid values by start, in code points; none overlap."""
    out: list[Change] = []
    if not MAY_HOLD.search(text):
        return out
    for kind, (pattern, pseudonym) in KINDS.items():
        starts = [c[1] for c in out]  # of the kinds before, in order; those of one kind never overlap
        more = []
        if kind == "iban":
            for listed in (True, False):  # a word before a number may by chance look like its country
                taken = sorted(c[1:3] for c in out + more)
                more += [(kind, a, b, pseudonym(text[a:b], key)) for a, b in iban_spans(text, taken, listed)]
        for m in pattern.finditer(text) if kind != "iban" else ():
            if kind == "card":
                # only what touches the run: the value before its start may reach into it
                near = out[max(0, bisect.bisect_right(starts, m.start()) - 1) : bisect.bisect_left(starts, m.end())]
                spans = card_spans(text, *m.span(), [(a, b) for _, a, b, _ in near])
                more += [(kind, a, b, new) for a, b in spans if (new := pseudonym(text[a:b], key)) is not None]
                continue
            i = bisect.bisect_right(starts, m.start())
            if i and out[i - 1][2] > m.start():
                continue
            if i < len(starts) and starts[i] < m.end():  # only what lies before the next value
                m = pattern.match(text, m.start(), starts[i])
                if m is None:
                    continue
            new = pseudonym(m[0], key)
            if new is not None:
                more.append((kind, *m.span(), new))
        if more:
            out = sorted(out + more, key=lambda c: c[1])
    return out


def applied(text: str, found: list[Change]) -> str:
    out, at = [], 0
    for _, a, b, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with the values in ``text`` replaced, their number in ``n_values`` and the places
    they had as kind:start:end in ``value_spans``. NULL stays NULL and holds none; columns of
    these names are replaced. The key is the secret: who has it can undo the replacement."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[column(c) for c in docs.columns if c.lower() not in ("n_values", "value_spans")])
    schema = T.StructType(list(docs.schema.fields)).add("n_values", "long").add("value_spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, counts, spans = [], [], []
            for value in batch.column(at).to_pylist():
                found = changes(value, key) if value else []
                texts.append(applied(value, found) if found else value)
                counts.append(len(found))
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in found))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            columns += [pa.array(counts, pa.int64()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_values", "value_spans"])

    return docs.mapInArrow(run, schema)


QUERY_KEY = b"a key for the registered query only"


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal numbers, dates and addresses replaced; repeated rows alike.

    NULL texts stay NULL and empty ones empty, both without values; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, QUERY_KEY).select("doc_id", "text", "n_values", F.col("value_spans").alias("spans"))
