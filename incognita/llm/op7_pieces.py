"""SentencePiece encoding and decoding with seeded merge-dropout.

The pieces of a merge-type model are built from characters by taking the best-scored candidate
merge from an agenda again and again. With dropout a candidate (two neighbouring pieces at one
place) is skipped if a keyed hash of seed, document, place and length says so: the same seed
gives the same pieces on every run and retry, another seed other pieces, and all of them decode
to the same text. Without dropout the pieces are those of the model's own library.

White space is written as U+2581, a character of its own in the model. One that stands in a text
is encoded as bytes, as are characters that the model doesn't know.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incognita.llm.common import column, free_name, mix, pieces, small_batches, table

SPACE = "▁"
DROPOUT = 0.1
SEED = 20_240_607
AT_ONCE = 1 << 18  # bytes of text whose symbols are held as numbers at once, about
LONG = 200  # characters from which a run without white space takes the agenda one by one
NEVER = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15)

Pieces = tuple[tuple[str, float, bool], ...]  # text, score, is a byte; by id


def load_pieces(path: str) -> Pieces:
    """The pieces of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        text = "" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i)
        out.append((text, model.get_score(i), model.is_byte(i)))
    return tuple(out)


class Merges:
    """Tables of one model: symbols of characters, candidate merges and their rank, pieces as bytes.

    A symbol is the id of a piece, or -1 - c for a character c that is none.
    """

    def __init__(self, vocabulary: Pieces):
        ids = {t: i for i, (t, _, byte) in enumerate(vocabulary) if t and not byte}
        self.bytes = np.zeros(256, np.int64)
        texts = []
        for i, (t, _, byte) in enumerate(vocabulary):
            if byte:
                value = int(t[3:5], 16)
                self.bytes[value] = i
                texts.append(bytes([value]))
            else:
                texts.append(t.replace(SPACE, " ").encode())
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        for t, i in ids.items():
            if len(t) == 1:
                self.symbol[ord(t)] = i
        self.symbol[0x20] = ids[SPACE]
        self.symbol[ord(SPACE)] = -1 - ord(SPACE)
        self.space = ids[SPACE]
        order = {s: r for r, s in enumerate(sorted({s for _, s, _ in vocabulary}, reverse=True))}
        self.rank = np.array([order[s] for _, s, _ in vocabulary], np.int64)
        self.merged: dict[tuple[int, int], int] = {}
        for t, i in ids.items():
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    self.merged[a, b] = i
        # the same as an open hash table of arrays
        keys = np.array([a << 32 | b for a, b in self.merged], np.int64)
        values = np.array(list(self.merged.values()), np.int32)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            taken, which = np.unique(slot[left[free]], return_index=True)
            won = left[free][which]
            self.keys[taken], self.values[taken] = keys[won], values[won]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.flat = np.frombuffer(b"".join(texts), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the piece that a and b make, or -1."""
        out = np.full(len(a), -1, np.int32)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[at].astype(np.int64) << 32 | b[at]
        slot = self._slot(keys)
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (there >= 0)
            at, keys, slot = at[go], keys[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


@cache
def merges(vocabulary: Pieces) -> Merges:
    return Merges(vocabulary)


def skipped(key: np.ndarray, start: np.ndarray, length: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate at ``start`` with ``length`` characters of document ``key`` is skipped."""
    if dropout <= 0:
        return np.zeros(len(start), bool)
    h = mix(key + mix(start.astype(np.uint64) * np.uint64(1 << 20) + length.astype(np.uint64)))
    return (h >> np.uint64(11)).astype(np.float64) < dropout * float(1 << 53)


def agenda(model: Merges, symbols: list[int], start: int, key: np.uint64, dropout: float) -> list[int]:
    """Merges of one run of symbols by a heap of candidates."""
    n = len(symbols)
    symbols, size = list(symbols), [1] * n
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i] if i >= 0 else -1
        if i < 0 or j < 0 or (piece := model.merged.get((symbols[i], symbols[j]))) is None:
            return
        place, length = np.array([start + i]), np.array([size[i] + size[j]])
        if not skipped(np.array([key]), place, length, dropout)[0]:
            heapq.heappush(heap, (int(model.rank[piece]), i, size[i], size[j], piece))

    for i in range(n):
        offer(i)
    while heap:
        _, i, a, b, piece = heapq.heappop(heap)
        j = right[i]
        if j < 0 or size[i] != a or size[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i], size[i], size[j] = piece, a + b, 0
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    return [symbols[i] for i in range(n) if size[i]]


def merge_all(
    model: Merges, symbols: np.ndarray, run: np.ndarray, start: np.ndarray, key: np.ndarray, dropout: float
) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, run) after all merges, by run. Every round does the best merge of every run.

    ``run`` numbers the runs from 0, ``start`` and ``key`` give each character's place and document.
    """
    done_symbols, done_runs = [], []
    sizes = np.bincount(run)
    long = np.flatnonzero(sizes > LONG)
    for r in long:
        a, b = np.searchsorted(run, [r, r + 1])
        done_symbols.append(np.array(agenda(model, symbols[a:b].tolist(), int(start[a]), key[a], dropout), np.int32))
        done_runs.append(np.full(len(done_symbols[-1]), r))
    if len(long):
        keep = sizes[run] <= LONG
        symbols, run, start, key = symbols[keep], run[keep], start[keep], key[keep]
    length = np.ones(len(symbols), np.int64)

    def candidates(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, priority) of the pairs that begin at these places."""
        piece = np.full(len(at), -1, np.int32)
        priority = np.full(len(at), NEVER)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[run[at[inner]] == run[at[inner] + 1]]
        i = at[inner]
        piece[inner] = model.find(symbols[i], symbols[i + 1])
        inner = inner[piece[inner] >= 0]
        i = at[inner]
        inner = inner[~skipped(key[i], start[i], length[i] + length[i + 1], dropout)]
        # the rank, then the place; places in a run grow to the right
        priority[inner] = model.rank[piece[inner]] << 40 | start[at[inner]]
        return piece, priority

    piece, priority = candidates(np.arange(len(symbols)))
    while len(symbols):
        opens = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        best = np.minimum.reduceat(priority, opens)
        count = np.diff(np.append(opens, len(symbols)))
        over = np.repeat(best == NEVER, count)
        if over.any():
            done_symbols.append(symbols[over])
            done_runs.append(run[over])
            keep = ~over
            symbols, run, start, key, length = (x[keep] for x in (symbols, run, start, key, length))
            piece, priority = piece[keep], priority[keep]
            best, count = best[best != NEVER], count[best != NEVER]
            if not len(symbols):
                break
        at = np.flatnonzero(priority == np.repeat(best, count))
        symbols[at] = piece[at]
        length[at] += length[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, run, start, key, length = (x[keep] for x in (symbols, run, start, key, length))
        piece, priority = piece[keep], priority[keep]
        at = at - np.arange(len(at))  # every merge before has taken one symbol away
        near = np.zeros(len(symbols), bool)
        near[at] = True
        near[at[at > 0] - 1] = True
        touched = np.flatnonzero(near)
        piece[touched], priority[touched] = candidates(touched)
    all_symbols = np.concatenate([np.empty(0, np.int32), *done_symbols])
    all_runs = np.concatenate([np.empty(0, np.int64), *done_runs])
    order = np.argsort(all_runs, kind="stable")
    return all_symbols[order], all_runs[order]


def encode_rows(
    model: Merges, data: np.ndarray, at: np.ndarray, keys: np.ndarray, dropout: float
) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each row) for rows of UTF-8 bytes; ``keys``: a number per row."""
    rows = len(at) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.diff(lead[at])
    row = np.repeat(np.arange(rows), chars)
    # each row that isn't empty gets one white space in front
    before = np.cumsum(chars > 0)
    symbols = np.full(len(points) + (before[-1] if rows else 0), model.space, np.int32)
    place = np.arange(len(points)) + before[row]
    symbols[place] = model.symbol[points]
    size = chars + (chars > 0)
    owner = np.repeat(np.arange(rows), size)
    start = np.arange(len(symbols)) - np.repeat(np.cumsum(size) - size, size)
    # pieces hold white space in front only, so nothing merges across these borders
    space, unknown = symbols == model.space, symbols < 0
    opens = start == 0
    opens[1:] |= (space[1:] & ~space[:-1]) | unknown[1:] | unknown[:-1]
    run = np.cumsum(opens) - 1
    run_owner = owner[np.flatnonzero(opens)]
    found, runs = merge_all(model, symbols, run, start, keys[owner], dropout)
    of_row = run_owner[runs] if len(runs) else np.empty(0, np.int64)
    odd = np.flatnonzero(found < 0)
    if len(odd):  # characters that are no piece, as bytes
        texts = [chr(-1 - c).encode() for c in found[odd].tolist()]
        many = np.ones(len(found), np.int64)
        many[odd] = [len(t) for t in texts]
        first = np.cumsum(many) - many
        ids = np.repeat(found, many)
        of_row = np.repeat(of_row, many)
        spots = np.concatenate([first[i] + np.arange(len(t)) for i, t in zip(odd, texts, strict=True)])
        ids[spots] = model.bytes[np.frombuffer(b"".join(texts), np.uint8)]
        found = ids
    return found, np.bincount(of_row, minlength=rows)


def decode_rows(model: Merges, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each row), without the white space in front of each row."""
    sizes = model.length[ids]
    begin = np.cumsum(sizes) - sizes
    source = np.arange(int(sizes.sum())) + np.repeat(model.offset[ids] - begin, sizes)
    data = model.flat[source]
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
    keep = np.ones(len(data), bool)
    full = ends[:-1][np.diff(ends) > 0]
    keep[full[data[full] == 32]] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], np.diff(kept[ends])


def encode(
    docs: DataFrame,
    vocabulary: Pieces,
    text: str = "text",
    key: str | None = "doc_id",
    dropout: float = DROPOUT,
    seed: int = SEED,
    name: str = "pieces",
) -> DataFrame:
    """``docs`` with the ids of each whole text in ``name`` (NULL: NULL, empty: none) and, in
    ``name`` + "_lossless", whether they decode to it. ``key``: the column that with the seed
    picks what is skipped (NULL: 0). Columns of these names are replaced."""
    small_batches(docs.sparkSession)
    check = name + "_lossless"
    docs = docs.select(*[column(c) for c in docs.columns if c.lower() not in (name.lower(), check.lower())])
    plain = docs.columns
    own = free_name(docs, "hash_key")
    mark = F.coalesce(F.xxhash64(column(key)), F.lit(0)) if key else F.lit(0).cast("long")
    docs = docs.withColumn(own, mark)
    schema = T.StructType([f for f in docs.schema.fields if f.name != own])
    schema = schema.add(name, T.ArrayType(T.IntegerType())).add(check, "boolean")
    salt = np.array([seed], np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(vocabulary)
        for batch in batches:
            values = batch.column(text)
            keys = mix(batch.column(own).to_numpy().view(np.uint64) ^ mix(salt))
            nulls = values.is_null().to_numpy(zero_copy_only=False)
            for a, b, data, at in pieces(values, AT_ONCE):
                ids, counts = encode_rows(model, data, at, keys[a:b], dropout)
                back, sizes = decode_rows(model, ids, counts)
                wrong = np.zeros(b - a, bool)
                if len(back) == len(data) and (sizes == np.diff(at)).all():
                    off = np.flatnonzero(back != data)
                    wrong[np.searchsorted(at, off, "right") - 1] = True
                else:
                    wrong[sizes != np.diff(at)] = True
                    for i in np.flatnonzero(~wrong):
                        low = int(sizes[:i].sum())
                        wrong[i] = not np.array_equal(back[low : low + sizes[i]], data[at[i] : at[i + 1]])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)), mask=pa.array(nulls[a:b]))
                cells = [batch.column(c).slice(a, b - a) for c in plain]
                yield pa.RecordBatch.from_arrays([*cells, lists, pa.array(~wrong)], [*plain, name, check])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, vocabulary: Pieces, ids: str = "pieces", name: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids (NULL: NULL); bytes that are no text become U+FFFD."""
    docs = docs.select(*[column(c) for c in docs.columns if c.lower() != name.lower()])
    schema = T.StructType(list(docs.schema.fields)).add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(vocabulary)
        for batch in batches:
            values = batch.column(ids)
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.array([len(x) if x.is_valid else 0 for x in values], np.int64)
            data, sizes = decode_rows(model, flat, counts)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            texts = [
                data[a:b].tobytes().decode("utf-8", "replace") if x.is_valid else None
                for x, a, b in zip(values, ends, ends[1:], strict=False)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def model_path() -> str:
    """The model file that the queries take."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole document, with dropout, and whether they decode to it.

    A NULL text has no pieces (NULL), an empty one an empty list; repeated rows give the same
    pieces, as these depend on seed, doc_id and text only.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, load_pieces(model_path()))
    return out.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", F.col("pieces_lossless").alias("lossless"))
