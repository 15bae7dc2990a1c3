"""Fakes of the built-in patterns for Arrow batches of originals.

``fakes`` states every fake as an expression. Inside an array Spark interprets such an expression value by
value, so the matches in texts get theirs here: the same digest, and numpy picks words and forms digits
for all matches of one type at once. The values are the same, tested against the expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from hashlib import md5
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from incognita.functions import fakes as fk
from incognita.rules import SAFE_EMAIL_DOMAINS

# Originals and their digests, a row of 16 bytes each.
Maker = Callable[[list[bytes], np.ndarray], pa.Array]


def _slices(digests: np.ndarray) -> np.ndarray:
    """The four 32-bit slices of each digest."""
    return digests.view(">u4").astype(np.uint32)


@cache
def _in_sequence(*words: tuple[str, ...]) -> pa.Array:
    return pa.array(["".join(some) for some in product(*words)], pa.string())


def _choose(digests: np.ndarray, *words: tuple[str, ...]) -> pa.Array:
    """A word of each list in a row, chosen by the slice of the same place."""
    keys, at = _slices(digests), np.zeros(len(digests), np.int64)
    for slot, some in enumerate(words):
        at = at * len(some) + keys[:, slot] % np.uint32(len(some))
    return _in_sequence(*words).take(pa.array(at))


def strings(text: bytes | np.ndarray, sizes: np.ndarray) -> pa.Array:
    """ASCII text cut into strings of these sizes; an error above 2 GB, which one array can't hold."""
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(text)]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), buffers).cast(pa.string())


def _strings(cells: np.ndarray) -> pa.Array:
    """Rows of ASCII codes as strings."""
    return strings(cells, np.full(len(cells), cells.shape[1]))


def _filled(n: int, shape: str, /, **numbers: np.ndarray) -> np.ndarray:
    """Rows of ASCII codes of a shape, where each run of a letter holds the digits of that number."""
    out = np.empty((n, len(shape)), np.uint8)
    out[:] = np.frombuffer(shape.encode(), np.uint8)
    for letter, number in numbers.items():
        left = number.astype(np.uint32)
        for place in range(shape.rindex(letter), shape.index(letter) - 1, -1):
            rest = left // np.uint32(10)
            out[:, place] = left - rest * np.uint32(10) + 48
            left = rest
    return out


def _email(values: list[bytes], digests: np.ndarray) -> pa.Array:
    plain = fk._plain
    first = tuple(f"{w}." for w in plain(fk.FIRST_NAMES))
    domains = tuple(f"@{d}" for d in SAFE_EMAIL_DOMAINS)
    return _choose(digests, first, tuple(plain(fk.LAST_STEMS)), tuple(plain(fk.LAST_ENDINGS)), domains)


def _url(values: list[bytes], digests: np.ndarray) -> pa.Array:
    return _choose(digests, tuple(f"https://{w}." for w in fk.WORDS), tuple(fk.RESERVED_TLDS))


def _phone(values: list[bytes], digests: np.ndarray) -> pa.Array:
    keys = _slices(digests)
    area, number = keys[:, 0] % np.uint32(900) + np.uint32(100), keys[:, 1] % np.uint32(10_000_000)
    return _strings(_filled(len(keys), "+49 aaa nnnnnnn", a=area, n=number))


def _postcode(values: list[bytes], digests: np.ndarray) -> pa.Array:
    return _strings(_filled(len(digests), "nnnnn", n=_slices(digests)[:, 0] % np.uint32(99_999) + np.uint32(1)))


def _iban(values: list[bytes], digests: np.ndarray) -> pa.Array:
    keys = _slices(digests).astype(np.int64)
    left, right = keys[:, 0] % 10**9, keys[:, 1] % 10**9
    rest = (left * (10**15 % 97) + right * (10**6 % 97) + 131400 % 97) % 97
    return _strings(_filled(len(keys), "DEccaaaaaaaaabbbbbbbbb", c=98 - rest, a=left, b=right))


@cache
def _two_octets() -> pa.Array:
    return pa.array([f"{a}.{b}" for a in range(256) for b in range(256)], pa.string())


def _ip(values: list[bytes], digests: np.ndarray) -> pa.Array:
    pairs = digests.view(">u2").astype(np.int64)
    halves = [_two_octets().take(pa.array(pairs[:, i])) for i in (0, 1)]
    return pc.binary_join_element_wise(*halves, ".")


def _uuid(values: list[bytes], digests: np.ndarray) -> pa.Array:
    signs = np.frombuffer(b"0123456789abcdef", np.uint8)
    out = np.full((len(digests), 36), ord("-"), np.uint8)
    places = np.array([i for i in range(36) if i not in (8, 13, 18, 23)])
    out[:, places[0::2]] = signs[digests >> 4]
    out[:, places[1::2]] = signs[digests & 15]
    return _strings(out)


def _birthdate(values: list[bytes], digests: np.ndarray) -> pa.Array:
    """Of originals written as 2024-01-15 or 15.01.2024."""
    cells = np.frombuffer(b"".join(values), np.uint8).reshape(-1, 10)
    keys, digit = _slices(digests).astype(np.int64), cells.astype(np.int64) - 48
    german = cells[:, 2] == ord(".")

    def number(*places: int) -> np.ndarray:
        out = np.zeros(len(digit), np.int64)
        for p in places:
            out = out * 10 + digit[:, p]
        return out

    year = np.where(german, number(6, 7, 8, 9), number(0, 1, 2, 3))
    month = np.where(german, number(3, 4), number(5, 6))
    day = np.where(german, number(0, 1), number(8, 9))
    first = ((year - 1970) * 12 + month - 1).astype("datetime64[M]")
    moved = first.astype("datetime64[D]") + (day - 1)
    real = (month >= 1) & (month <= 12) & (day >= 1) & (moved.astype("datetime64[M]") == first)
    moved += (keys[:, 0] % 336 + 30) * (keys[:, 1] % 2 * 2 - 1)
    moved = np.where(real, moved, (keys[:, 2] % 20_000).astype("datetime64[D]"))
    german &= real

    month_at, year_at = moved.astype("datetime64[M]"), moved.astype("datetime64[Y]")
    y = year_at.astype(np.int64) + 1970
    m = (month_at - year_at.astype("datetime64[M]")).astype(np.int64) + 1
    d = (moved - month_at.astype("datetime64[D]")).astype(np.int64) + 1
    out = np.where(
        german[:, None],
        _filled(len(y), "dd.mm.yyyy", d=d, m=m, y=abs(y)),
        _filled(len(y), "yyyy-mm-dd", d=d, m=m, y=abs(y)),
    )
    made, signed = _strings(out), np.flatnonzero((y < 0) | (y > 9999))
    if len(signed):
        texts = made.to_pylist()
        for i in signed.tolist():
            shown = f"-{-y[i]:04}" if y[i] < 0 else f"+{y[i]}"
            texts[i] = f"{d[i]:02}.{m[i]:02}.{shown}" if german[i] else f"{shown}-{m[i]:02}-{d[i]:02}"
        made = pa.array(texts, pa.string())
    return made


_MAKERS: dict[str, tuple[fk.Generator, Maker]] = {
    "email": (fk.email, _email),
    "url": (fk.url, _url),
    "phone": (fk.phone, _phone),
    "postcode": (fk.postcode, _postcode),
    "iban": (fk.iban, _iban),
    "ip": (fk.ip, _ip),
    "uuid": (fk.uuid, _uuid),
    "birthdate": (fk.birthdate, _birthdate),
}


def can_make(kinds: list[str]) -> bool:
    """Whether fakes of these types can be made here; not if another generator was registered for one."""
    return all(k in _MAKERS and fk.GENERATORS.get(k) is _MAKERS[k][0] for k in kinds)


def fakes_of(values: list[bytes], kinds: list[str], which: np.ndarray, seed: str) -> pa.Array:
    """The fake of each value, which is a match of a built-in pattern; its type is ``kinds[which]``."""
    if not values:
        return pa.array([], pa.string())
    names = list(dict.fromkeys(kinds))
    own = np.array([names.index(k) for k in kinds])[which]
    order = np.argsort(own, kind="stable")
    grouped = [values[i] for i in order.tolist()]
    counts, at, made = np.bincount(own, minlength=len(names)).tolist(), 0, []
    for name, count in zip(names, counts, strict=True):
        if count:
            some, head = grouped[at : at + count], f"{seed}|{name}|".encode()
            digests = b"".join([md5(head + v).digest() for v in some])
            made.append(_MAKERS[name][1](some, np.frombuffer(digests, np.uint8).reshape(-1, 16)))
            at += count
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return pa.concat_arrays(made).take(pa.array(back))
