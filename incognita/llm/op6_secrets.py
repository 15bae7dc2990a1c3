"""Secret scans: fixed patterns, and two character Markov models for what no pattern knows.

One model learns random strings, the other ordinary identifiers; a string is told by the ratio
of the two likelihoods. The labelled samples come from the corpus itself: values that the fixed
patterns have found (random) and long words elsewhere (ordinary). Words with digits have no label
in a corpus, so the ordinary model also learns made-up dates, versions, numbers and names of files.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incognita.llm.common import column, small_batches, table, written

# fixed values: patterns and least lengths as stated
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same as runs of any length of which short ones are dropped
KINDS = ("assign", "access", "hex", "markov")

WORD = re.compile(r"[A-Za-z0-9+/_=-]{16,}")  # what the models look at
SAMPLE = 4000  # strings of each label the models are fitted on, at most
SAMPLE_ROWS = 20_000  # documents these are taken from, about
MARGIN = 0.1  # nats per character by which random must be likelier

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))

IDENTIFIERS = 1500  # made-up identifiers with digits that the ordinary model is fitted on, too
NAMES = """account archive article backup batch build chapter chart client config copy data default demo device
draft edition example figure file final folder graph group header image index input invoice item layer letter level
library license linux list local log main manual map meeting member message model module month name network node note
number office order output package page paper part photo picture plan player point policy product profile project
python record release report request result review sample scan scene screen section server session sheet source
special station status step store student study summary system table target team template test text ticket title train
update user value version video volume week window winter world year""".split()

Span = tuple[str, int, int]


def identifiers(n: int, seed: int = 20_240_607) -> list[str]:
    """Ordinary strings with digits as WORD takes them: dates and times, versions, book, card, phone
    and account numbers, paths, numbered names; the same at every call."""
    rng = random.Random(seed)

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def name() -> str:
        word = rng.choice(NAMES)
        return rng.choice([word, word, word, word.capitalize(), word.upper()])

    def numbered() -> str:
        return rng.choice(["", "", "v", name() + rng.choice(["", "-", "_"])]) + str(rng.randrange(10 ** rng.randint(1, 4)))

    def day() -> str:
        y, m, d = rng.randint(1950, 2049), rng.randint(1, 12), rng.randint(1, 28)
        return rng.choice(["{0}-{1:02}-{2:02}", "{0}-{1:02}-{2:02}", "{0}/{1:02}/{2:02}", "{2:02}/{1:02}/{0}", "{0}{1:02}{2:02}"]).format(y, m, d)

    def moment() -> str:
        mark = rng.choice(["-", "", "_"])
        clock = mark.join(f"{rng.randrange(x):02}" for x in (24, 60, 60))
        return day() + rng.choice("_T-") + clock + rng.choice(["", "", "Z", "+0" + rng.choice("012") + "00"])

    def version() -> str:
        parts = rng.choice("-_").join(str(rng.randrange(rng.choice([3, 10, 40, 400]))) for _ in range(rng.randint(2, 4)))
        return name() + rng.choice(["-", "_", "-v", "/v", "="]) + parts + rng.choice(["", "", "-" + name(), "-beta" + digits(1), "-rc" + digits(1), "-x86_64"])

    def grouped(*sizes: int) -> str:
        return rng.choice(["-", "-", "/"]).join(digits(k) for k in sizes)

    def book() -> str:
        a = rng.randint(2, 6)
        tail = rng.choice("0123456789X") if rng.random() < 0.5 else digits(1)
        return rng.choice(["978-", "979-", "ISBN-", "ISBN-978-"]) + f"{digits(rng.randint(1, 2))}-{digits(a)}-{digits(8 - a)}-{tail}"

    def account() -> str:
        country = rng.choice(["DE", "FR", "ES", "IT", "NL", "GB", "AT", "CH", "BE", "PL", "PT", "SE", "DK", "LU"])
        bank = rng.choice(["", "", "", "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4))])
        return country + digits(2) + bank + digits(rng.randint(12, 20))

    def phone() -> str:
        return "+" + rng.choice(["-", ""]).join([digits(rng.randint(1, 2)), digits(3), digits(rng.randint(3, 4)), digits(rng.randint(4, 5))])

    def path() -> str:
        parts = [rng.choice([name, name, numbered, day])() for _ in range(rng.randint(2, 5))]
        return rng.choice(["/", ""]) + "/".join([*parts, numbered()])

    def chain() -> str:
        parts = [rng.choice([name, name, numbered])() for _ in range(rng.randint(1, 4))]
        return rng.choice("-_-_=").join([*parts, rng.choice([numbered, numbered, day])()])

    kinds = [
        moment,
        lambda: day() + rng.choice(["/", "_", "--", "-"]) + day(),
        lambda: name() + rng.choice("-_") + rng.choice([day, moment])(),
        version,
        book,
        lambda: grouped(4, 4, 4, 4),
        lambda: grouped(*(rng.randint(1, 6) for _ in range(rng.randint(3, 6)))),
        account,
        phone,
        path,
        chain,
    ]
    out: list[str] = []
    while len(out) < n:
        made = kinds[len(out) % len(kinds)]()
        if len(made) >= 16 and not made.isdigit():
            out.append(made)
    return out


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns: leftmost, not overlapping within a kind, in code points."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _codes(text: str) -> np.ndarray:
    return _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 127)]


SIZE = len(ALPHABET) + 1  # characters and one for all others; the start is one more state


def bigrams(samples: Iterable[str]) -> np.ndarray:
    """How often each character follows each state in whole strings; the last state is the start."""
    counts = np.zeros((SIZE + 1, SIZE), np.int64)
    for s in samples:
        codes = _codes(s)
        if len(codes):
            counts[SIZE, codes[0]] += 1
            counts[:SIZE] += np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE).reshape(SIZE, SIZE)
    return counts


@dataclass
class MarkovModel:
    """log P(next character | character), with a start state; add-half smoothing."""

    logs: np.ndarray

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> MarkovModel:
        smooth = counts + 0.5
        return cls(np.log(smooth / smooth.sum(axis=1, keepdims=True)))

    def score(self, text: str) -> float:
        codes = _codes(text)
        return float(self.logs[-1, codes[0]] + self.logs[codes[:-1], codes[1:]].sum()) if len(codes) else 0.0


@dataclass
class SecretModel:
    random: MarkovModel
    ordinary: MarkovModel
    margin: float = MARGIN

    @classmethod
    def of_counts(cls, random_ones: np.ndarray, ordinary: np.ndarray, margin: float = MARGIN) -> SecretModel:
        """From the bigrams of strings of either label and, for the ordinary model, of made-up
        identifiers with digits; without samples of both labels nothing is found later."""
        both = random_ones.any() and ordinary.any()
        made = bigrams(identifiers(IDENTIFIERS))
        return cls(MarkovModel.of_counts(random_ones), MarkovModel.of_counts(ordinary + made), margin if both else float("inf"))

    @classmethod
    def fit(cls, labelled: list[tuple[str, bool]], margin: float = MARGIN) -> SecretModel:
        """From (string, is it random)."""
        return cls.of_counts(*(bigrams(s for s, r in labelled if r is want) for want in (True, False)), margin)

    def ratio(self, text: str) -> float:
        """Log-likelihood ratio per character; above ``margin`` the string counts as random."""
        return (self.random.score(text) - self.ordinary.score(text)) / max(len(text), 1)

    def spans(self, text: str, taken: list[Span]) -> list[Span]:
        """Random strings that touch no span already taken. Digits alone are numbers, no secrets."""
        return [
            ("markov", m.start(), m.end())
            for m in free_words(text, taken)
            if not m[0].isdigit() and self.ratio(m[0]) > self.margin
        ]


def free_words(text: str, taken: list[Span]) -> Iterator[re.Match[str]]:
    """Words the models look at that touch none of the spans, which are sorted by start; one merge."""
    at, reach = 0, 0  # spans that start before the word's end, and how far they go
    for m in WORD.finditer(text):
        while at < len(taken) and taken[at][1] < m.end():
            reach = max(reach, taken[at][2])
            at += 1
        if reach <= m.start():
            yield m


def find_secrets(text: str | None, model: SecretModel | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans by start, then kind); NULL counts as empty."""
    base = base_spans(text or "")
    more = model.spans(text or "", base) if model else []
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


SAMPLES = pa.schema([("s", pa.string()), ("random", pa.bool_())])


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled strings of each text: values the patterns found, and long words besides."""
    for batch in batches:
        rows: set[tuple[str, bool]] = set()
        for text in batch.column(0).to_pylist():
            taken = base_spans(text or "")
            for kind, a, b in taken:
                value = ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
                if len(value) >= 16:
                    rows.add((value, True))
            # a word with digits could be an unlabelled secret, so it is no sample of either label
            rows.update((m[0], False) for m in free_words(text or "", taken) if not any(c.isdigit() for c in m[0]))
        listed = sorted(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in listed], SAMPLES.types[i]) for i in (0, 1)], schema=SAMPLES)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams of the strings of either label, summed over the task."""
    total = np.zeros((2, SIZE + 1, SIZE), np.int64)
    for batch in batches:
        for s, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[int(r)] += bigrams([s])
    flat = total.reshape(-1)
    some = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(flat[some])], ["cell", "n"])


def fit_model(docs: DataFrame, text: str = "text", sample: int = SAMPLE, rows: int = SAMPLE_ROWS) -> SecretModel:
    """Models from ``sample`` strings a label at most, chosen by hash among those of about ``rows``
    documents, which are chosen by hash of doc_id (if there is one) and length.

    The chosen documents are read once. Strings count whole: their bigrams are added up in the
    tasks, and only those counts come to the driver.
    """
    small_batches(docs.sparkSession)
    share = min(1.0, rows / max(docs.count(), 1))
    by = [column(c) for c in docs.columns if c == "doc_id"] + [F.octet_length(column(text))]
    chosen = docs.filter(F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int(share * (1 << 30))).select(column(text))
    strings = chosen.mapInArrow(_samples, "s string, random boolean").distinct()
    strings = written(strings.withColumn("h", F.xxhash64("s")), "strings")
    kept = None
    for label in (True, False):
        of = strings.filter(F.col("random") == label)
        last = of.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        part = of.filter(F.col("h") <= F.lit(last).cast("long"))
        kept = part if kept is None else kept.unionByName(part)
    counts = np.zeros(2 * (SIZE + 1) * SIZE, np.int64)
    for r in kept.select("s", "random").mapInArrow(_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r.cell] = r.n
    ordinary, random_ones = counts.reshape(2, SIZE + 1, SIZE)
    return SecretModel.of_counts(random_ones, ordinary)


def scan(docs: DataFrame, model: SecretModel | None, text: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` with ``secret_spans`` (kind, start, end), ``base_spans`` (their number that the
    patterns gave: n_assign, n_access, n_hex and base_sha256) and, if asked, the text with every
    secret replaced by its kind in brackets. Columns of these names are replaced."""
    small_batches(docs.sparkSession)
    own = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}
    kept = [c for c in docs.columns if c.lower() not in own]
    docs = docs.select(*[column(c) for c in kept])
    schema = T.StructType(list(docs.schema.fields))
    for name, kind in own.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: dict[str, list] = {c: [] for c in own}
            texts = []
            for value in batch.column(text).to_pylist():
                base, spans = find_secrets(value, model)
                for kind in KINDS[:3]:
                    cells["n_" + kind].append(sum(k == kind for k, _, _ in base))
                cells["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cells["spans"].append(joined(spans))
                texts.append(replaced(value, spans) if redact else None)
            columns = {c: batch.column(c) for c in kept}
            if redact:
                columns[text] = pa.array(texts, pa.string())
            arrays = [*columns.values(), *(pa.array(v, pa.int64() if c[0] == "n" else pa.string()) for c, v in cells.items())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *own])

    return docs.mapInArrow(run, schema)


def replaced(text: str | None, spans: list[Span]) -> str | None:
    """The text with each run of overlapping spans replaced by the first one's kind."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document.

    A NULL text counts as empty; a document without secrets has no spans and the digest of the
    empty string. Repeated rows give repeated rows, an empty table gives none. Texts are scanned
    whole, in time that grows with their length.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit_model(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
