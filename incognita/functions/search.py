"""Search of the built-in patterns in Arrow batches.

The texts of a batch are laid in a row as UTF-8 bytes, a zero byte between them: the patterns know
ASCII characters only and none matches a zero byte, so matches are those of each text alone. Numpy
tells for all texts at once where a match may start, from a few classes of bytes; the stated pattern
is tried there only. What comes back is one list of matches a text. Patterns of one's own are Java
expressions and are searched by Spark's functions instead, see ``text``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from incognita.functions.fakes_in_batches import fakes_of, strings
from incognita.rules import Pattern

PIECE = 1 << 18  # bytes of texts that are searched at once, or one longer text
_AHEAD = 40  # more than the places behind a start that are looked at

Spans = tuple[np.ndarray, np.ndarray]
Scan = Callable[["Bytes"], Spans]


class Bytes:
    """Texts in a row, and where bytes of some classes stand in them. The arrays hold one place in front
    of the first byte and some behind the last."""

    def __init__(self, text: bytes):
        self.text = text
        self.codes = np.zeros(len(text) + 1 + _AHEAD, np.uint8)
        self.codes[1 : len(text) + 1] = np.frombuffer(text, np.uint8)

    def ahead(self, marks: np.ndarray, by: int) -> np.ndarray:
        """For each byte, the mark of the one ``by`` places ahead."""
        return marks[1 + by : 1 + by + len(self.text)]

    def of(self, character: str, by: int = 0) -> np.ndarray:
        return self.ahead(self.codes, by) == ord(character)

    @cached_property
    def digit(self) -> np.ndarray:
        return self.codes - 48 < 10

    @cached_property
    def hexadecimal(self) -> np.ndarray:
        return self.digit | ((self.codes | 32) - 97 < 6)

    @cached_property
    def word(self) -> np.ndarray:
        return self.digit | ((self.codes | 32) - 97 < 26) | (self.codes == ord("_"))

    @cached_property
    def upper(self) -> np.ndarray:
        return self.codes - 65 < 26

    @cached_property
    def dialled(self) -> np.ndarray:
        """Digits, white space, hyphens and slashes: what telephone numbers are made of."""
        out = self.digit | (self.codes - 9 < 5)
        for c in " -/":
            out |= self.codes == ord(c)
        return out

    @cached_property
    def continued(self) -> np.ndarray | None:
        """The places of bytes that do not begin a character; None if there are none at all."""
        return None if self.text.isascii() else np.flatnonzero(self.codes & 0xC0 == 0x80) - 1


# --- where a match may start ---------------------------------------------------------------


def _phone(t: Bytes) -> np.ndarray:
    two = t.dialled[:-1] & t.dialled[1:]
    six = two[:-4] & two[2:-2] & two[4:]
    return np.flatnonzero((t.of("0") & t.ahead(six, 1)) | (t.of("+") & t.ahead(six, 3)))


def _iban(t: Bytes) -> np.ndarray:
    return np.flatnonzero(t.ahead(t.upper, 0) & t.ahead(t.upper, 1) & t.ahead(t.digit, 2) & t.ahead(t.digit, 3))


def _groups(t: Bytes, marks: np.ndarray, width: int, behind: str, count: int) -> np.ndarray:
    """Where up to ``width`` marked bytes stand in front of the first of ``count`` such characters with at
    most ``width`` bytes between them."""
    at = np.flatnonzero(t.of(behind))
    gaps = np.diff(at)
    near = np.concatenate([[0], np.cumsum((gaps >= 2) & (gaps <= width + 1))])
    last = max(0, len(at) - count + 1)
    low, out = at[:last][near[count - 1 : count - 1 + last] - near[:last] == count - 1], []
    for _ in range(width):
        low = low[marks[low]] - 1
        out.append(low)
    return np.sort(np.concatenate(out))


def _ipv4(t: Bytes) -> np.ndarray:
    starts = _groups(t, t.digit, 3, ".", 3)
    return starts[~t.word[starts]]


def _ipv6(t: Bytes) -> np.ndarray:
    return _groups(t, t.hexadecimal, 4, ":", 7)


def _url(t: Bytes) -> np.ndarray:
    return np.flatnonzero(t.of("h") & t.of("t", 1) & t.of("t", 2) & t.of("p", 3))


_STARTS = {"phone_de": _phone, "phone": _phone, "iban": _iban, "ipv4": _ipv4, "ipv6": _ipv6, "url": _url}

# Patterns of one width, with the class of the characters that are not written out.
_FIXED = {"uuid": "hexadecimal", "postcode_de": "digit", "date_iso": "digit", "date_de": "digit"}



# --- scans ---------------------------------------------------------------------------------


def _spans(starts: list[int], ends: list[int]) -> Spans:
    return np.array(starts, np.int64), np.array(ends, np.int64)


def _tried(regex: str, starts: Callable[[Bytes], np.ndarray]) -> Scan:
    """The pattern, tried at every place where it may start and no match before it stands."""
    match = re.compile(regex.encode()).match

    def scan(t: Bytes) -> Spans:
        text, end, low, high = t.text, 0, [], []
        for at in starts(t).tolist():
            if at >= end and (m := match(text, at)):
                end = m.end()
                low.append(at)
                high.append(end)
        return _spans(low, high)

    return scan


def _of_one_width(kind: str, shape: str, first: bool, last: bool) -> Scan:
    """Matches of a shape such as ``0000-00-00``, where 0 stands for any byte of the class; on request with
    a word border in front of the first and behind the last one."""
    signs = [(i, c) for i, c in enumerate(shape) if c != "0"]
    others = [i for i, c in enumerate(shape) if c == "0"]

    def scan(t: Bytes) -> Spans:
        marks, may = getattr(t, kind), np.ones(len(t.text), bool)
        for i, c in signs:
            may &= t.of(c, i)
        if not signs:
            for i in others:
                may &= t.ahead(marks, i)
        starts = np.flatnonzero(may)
        for i in others if signs else ():
            starts = starts[marks[starts + 1 + i]]
        if first:
            starts = starts[~t.word[starts]]
        if last:
            starts = starts[~t.word[starts + 1 + len(shape)]]
        if len(starts) > 1 and np.diff(starts).min() < len(shape):  # the left-most of overlapping ones
            end, apart = 0, []
            for at in starts.tolist():
                if at >= end:
                    end = at + len(shape)
                    apart.append(at)
            starts = np.array(apart, np.int64)
        return starts, starts + len(shape)

    return scan


def _addresses(regex: str, border: str, local: str) -> Scan:
    """E-mail addresses: a leftmost match starts at the head of a run of local-part characters, with a
    border at the first one of the run that has it, or within what is left of a run behind a match."""
    rest = re.compile(regex[len(border) + len(local) + 1 :].encode())
    first = re.compile((border + local).encode())
    run = re.compile(local.encode())
    allowed = frozenset(c for c in range(128) if run.match(bytes([c])))

    def scan(t: Bytes) -> Spans:
        text, end, starts, ends = t.text, 0, [], []
        for at in np.flatnonzero(t.of("@")).tolist():
            if at < end:
                continue
            low = at
            while low > end and text[low - 1] in allowed:
                low -= 1
            if border and low < at:
                head = first.search(text, low, at)
                low = head.start() if head else at
            if low < at and (m := rest.match(text, at)):
                end = m.end()
                starts.append(low)
                ends.append(end)
        return _spans(starts, ends)

    return scan


_LOCAL = re.compile(r"(\\b)?(\[[^\]]*\])\+@")
_REPEATED = re.compile(r"(?:\[0-9a-fA-F\]|\\d)\{(\d+)\}")


@cache
def scan_of(p: Pattern) -> Scan:
    """Gives first and last place (exclusive) of the leftmost, non-overlapping matches of a built-in pattern."""
    local = _LOCAL.match(p.regex)
    if local:
        return _addresses(p.regex, local[1] or "", local[2])
    if p.type in _FIXED:
        first, last = p.regex.startswith(r"\b"), p.regex.endswith(r"\b")
        shape = _REPEATED.sub(lambda m: "0" * int(m[1]), p.regex.removeprefix(r"\b").removesuffix(r"\b"))
        return _of_one_width(_FIXED[p.type], shape.replace(r"\.", "."), first, last)
    return _tried(p.regex, _STARTS[p.type])


def scanner(p: Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    """The same for one text, in characters."""

    def scan(text: str) -> Iterator[tuple[int, int]]:
        t = Bytes(text.encode())
        starts, ends = scan_of(p)(t)
        first = _characters(t, starts, np.zeros(len(starts), np.int64))
        return zip(first.tolist(), (first + ends - starts).tolist(), strict=True)

    return scan


def _characters(t: Bytes, places: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Characters between places in the bytes and the beginnings of their texts."""
    if t.continued is None:
        return places - begin
    return places - begin - (np.searchsorted(t.continued, places) - np.searchsorted(t.continued, begin))


# --- batches -------------------------------------------------------------------------------


def kept_of_overlapping(starts: np.ndarray, ordinals: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which ones stay, in ascending order: of overlapping ones the right-most, at equal starts the
    earlier pattern."""
    order = _in_order(starts, ordinals)
    low, high = starts[order], ends[order]
    apart = np.ones(len(order) + 1, bool)  # begins behind all before it
    apart[1:-1] = low[1:] >= np.maximum.accumulate(high)[:-1]
    keep = apart[:-1] & apart[1:]
    some = np.flatnonzero(~keep)
    some = some[np.lexsort((ordinals[order[some]], -low[some]))]
    last = 1 << 62
    for i, a, b in zip(some.tolist(), low[some].tolist(), high[some].tolist(), strict=True):
        if b <= last:
            keep[i] = True
            last = a
    return order[keep]


def _in_order(starts: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    """By position, then by pattern; the matches of one pattern come sorted, which a stable sort makes use of."""
    return np.argsort(starts * (int(ordinals.max(initial=0)) + 1) + ordinals, kind="stable")


def _pieces(column: pa.Array) -> Iterator[tuple[pa.Array, Bytes, np.ndarray, np.ndarray]]:
    """Runs of texts (as they are, in a row) with the first place of each, and the place behind its last."""
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:  # bytes that are no UTF-8 read as they do in the JVM
        cells = column.cast(pa.binary()).to_pylist()
        column = pa.array([b if b is None else b.decode("utf-8", "replace") for b in cells], pa.string())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    total, a = np.concatenate([[0], np.cumsum(sizes)]), 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PIECE, "right")) - 1)
        part = column.slice(a, b - a)
        cells = pc.fill_null(part.cast(pa.large_binary()), b"")
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], cells), pa.scalar(b"\0", cells.type))[0].as_py()
        begin = total[a:b] - total[a]
        yield part, Bytes(text), begin, begin + sizes[a:b] - 1
        a = b


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *arrays])


def found_in(
    column: pa.Array, patterns: tuple[Pattern, ...], resolve: bool, last: str = "score", seed: str = ""
) -> pa.Array:
    """The matches in each text as start, end, type, value and, as ``last``, score, ordinal or fake, sorted
    by position and pattern."""
    scans = [scan_of(p) for p in patterns]
    firsts, sizes, kinds, values, counts = [], [], [], [], []
    for _, t, begin, _ in _pieces(column):
        found = [scan(t) for scan in scans]
        starts, ends = (_joined([f[k] for f in found]) for k in (0, 1))
        ordinals = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        order = kept_of_overlapping(starts, ordinals, ends) if resolve else _in_order(starts, ordinals)
        starts, ends = starts[order], ends[order]
        behind = np.append(np.searchsorted(starts, begin), len(starts))
        counts.append(np.diff(behind))
        firsts.append(_characters(t, starts, np.repeat(begin, counts[-1])))
        sizes.append(ends - starts)
        kinds.append(ordinals[order])
        text = t.text
        values += [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    first, size, ordinal = _joined(firsts), _joined(sizes), _joined(kinds)
    which = pa.array(ordinal, pa.int32())
    if last == "fake":
        made = fakes_of(values, [p.fake_type for p in patterns], ordinal, seed)
    else:
        made = which if last == "ordinal" else pa.array([p.weight for p in patterns], pa.int32()).take(which)
    cells = {
        "start": pa.array(first, pa.int32()),
        "end": pa.array(first + size, pa.int32()),
        "type": pa.array([p.type for p in patterns], pa.string()).take(which),
        "value": strings(b"".join(values), size),
        last: made,
    }
    offsets = pa.array(np.concatenate([[0], np.cumsum(_joined(counts))]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(cells.values()), list(cells)))


def cut_in(column: pa.Array, pattern: Pattern) -> pa.Array:
    """The texts as gap, match, gap, ..., gap; NULL stays NULL."""
    scan, out = scan_of(pattern), []
    for part, t, begin, behind in _pieces(column):
        starts, ends = scan(t)
        cuts = np.stack([starts, ends], 1).reshape(-1)
        low = np.concatenate([begin, cuts])
        by = np.argsort(low, kind="stable")  # a text's beginning stands before a match that begins there
        high = np.concatenate([cuts, behind])
        high.sort(kind="stable")
        parts = [t.text[a:b] for a, b in zip(low[by].tolist(), high.tolist(), strict=True)]
        counts = 1 + 2 * np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
        at = np.concatenate([[0], np.cumsum(counts)])
        lists = pa.ListArray.from_arrays(
            pa.array(at, pa.int32()), pa.array(parts, pa.binary()).cast(pa.string()), mask=part.is_null()
        )
        out.append(lists)
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))
