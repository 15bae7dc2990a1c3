import os
import random

import data
import numpy as np
import pytest

from incognita.llm import op7_pieces as op
from incognita.llm.common import mix

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return op.load_pieces(op.model_path())


def texts():
    rng = random.Random(3)
    signs = ["a", "the", " ", "  ", "\n", "\t", "ß", "日本", "😀", "▁", "12", "Wort", ".", "\x00", "é"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(150)]
    return out + ["", " ", "a" * 700, " " * 50, data.prose(500, 3), "un" * 130 + " x", data.WORDS[0]]


def encoded(vocabulary, values, dropout, seed=1):
    model = op.merges(vocabulary)
    parts = [t.encode() for t in values]
    cells = np.frombuffer(b"".join(parts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    keys = mix(np.arange(len(parts), dtype=np.uint64) + np.uint64(seed * 1000))
    ids, counts = op.encode_rows(model, cells, at, keys, dropout)
    back, sizes = op.decode_rows(model, ids, counts)
    assert back.tobytes() == cells.tobytes() and (sizes == np.diff(at)).all()
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_without_dropout_as_the_library(vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_file=op.model_path())
    for text, ids in zip(texts(), encoded(vocabulary, texts(), 0.0)):
        if op.SPACE not in text:
            assert ids == library.encode(text)


def test_rounds_and_agenda_agree(vocabulary, monkeypatch):
    for dropout in (0.0, 0.1, 0.5, 1.0):
        rounds = encoded(vocabulary, texts(), dropout)
        monkeypatch.setattr(op, "LONG", 0)
        assert encoded(vocabulary, texts(), dropout) == rounds
        monkeypatch.undo()


def test_seeds_vary_and_repeat(vocabulary):
    a, b, c = (encoded(vocabulary, texts(), 0.1, s) for s in (1, 1, 2))
    assert a == b != c
    plain, all_skipped = (encoded(vocabulary, [data.prose(300, 1)], d)[0] for d in (0.0, 1.0))
    assert len(all_skipped) == len(data.prose(300, 1)) + 1 > len(plain)


def test_query_and_round_trip(spark, vocabulary):
    out = op.op7_pieces(spark, data.folder(spark)).collect()
    assert len(out) == len(data.rows()) and all(r.lossless for r in out)
    assert {r.doc_id: r.n_pieces for r in out if r.doc_id in (3, 4)}[3] == 0
    assert [r.pieces for r in out if r.doc_id == 4] == [None]
    same = [r.pieces for r in out if r.doc_id == 0]
    assert len(same) == 3 and any(same.count(x) == 2 for x in same)
    docs = data.documents(spark).withColumnRenamed("lang", "Pieces")
    back = op.decode(op.encode(docs, vocabulary), vocabulary).select("text", "decoded").collect()
    assert all(r.text == r.decoded for r in back)
    assert op.op7_pieces(spark, data.folder(spark, [])).collect() == []
    assert not os.path.exists("piece_bpe_32k.model")
