import random
from math import comb

import corpus_pipeline as cp
import data
from test_op4 import shingles
from test_op5 import sample

from incognita.llm import op2_mixing, op4_neardup, op6_secrets, op7_pieces
from incognita.llm.common import table


def corpus():
    rows, labels = sample(300)
    umlauts = str.maketrans("eo", "äü")
    rows = [(i, t if i % 5 else t.translate(umlauts), "en" if i % 5 else "de", f"s{i % 3}", len(t)) for i, t, *_ in rows]
    good = data.prose(130, 5000)
    rows += [(1000 + i, good + f" tail{i}", "en", "s0", 1) for i in range(8)]
    rows += [(2000, data.prose(90, 6000) + " password=abcdefgh12345678", "en", "s1", 1)]
    return rows, labels


def test_every_stage_against_its_own_input(spark):
    rows, labels = corpus()
    path = data.folder(spark, rows, labels)
    docs = table(spark, path, "documents")
    columns = docs.columns
    quality, dedup, secrets, mixing, pieces = (f for _, f in cp.STAGES)

    model = cp.quality_model(spark, path, docs)
    scores = {r.doc_id: r.quality_score for r in cp.score(docs, model, name="quality_score").collect()}
    one = quality(spark, docs, path).cache()
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i, s in scores.items() if s >= 0.7}
    assert {i for i, y in labels if y} <= {r.doc_id for r in one.collect()}

    two = dedup(spark, one, path).cache()
    given, kept = {r.doc_id: r.text for r in one.collect()}, sorted(r.doc_id for r in two.collect())
    assert two.columns == columns and [i for i in kept if 1000 <= i < 1008] == [1000]
    sets = {i: shingles(t) for i, t in given.items()}
    for i in given:  # whatever went has a close one that is smaller; what stayed has none
        close = [j for j in given if j < i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
        assert bool(close) == (i not in kept)

    three = secrets(spark, two, path).cache()
    texts = {r.doc_id: r for r in three.collect()}
    assert three.columns == columns and sorted(texts) == kept
    assert texts[2000].text.endswith("[assign]") and texts[2000].n_chars == len(texts[2000].text)
    assert all(op6_secrets.base_spans(r.text) == [] for r in texts.values())
    assert all(r.text == given[i] for i, r in texts.items() if i != 2000)

    four = mixing(spark, three, path).cache()
    assert four.columns == columns and {r.doc_id for r in four.collect()} == set(kept)
    share = four.filter("lang = 'de'").count() / four.count()
    assert share > three.filter("lang = 'de'").count() / three.count()

    last = pieces(spark, four, path)
    back = op7_pieces.decode(last, op7_pieces.load_pieces(op7_pieces.model_path())).collect()
    assert len(back) == four.count() and all(r.lossless and r.decoded == texts[r.doc_id].text for r in back)
    assert sorted(data.listed(cp.run(spark, path)), key=str) == sorted(data.listed(last), key=str)


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    path = data.folder(spark, labels=[(0, 1), (9, 1), (2, 0)])
    docs = data.documents(spark).selectExpr("*", "7 AS Spans", "8 AS tokens", "9 AS rate", "1 AS rows_of_id", "2 AS quality_score")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, path)
        assert name == cp.STAGES[-1][0] or out.columns == docs.columns
        for r in out.collect():
            assert "Spans" not in out.columns or (r.Spans, r.tokens, r.rate) == (7, 8, 9)
    ids = [r.doc_id for r in cp.near_dedup(spark, docs, path).collect()]
    assert ids.count(0) == 1 and ids.count(None) == 2 and 1 not in ids and {3, 4, 5} <= set(ids)
    empty = data.folder(spark, [])
    for _, stage in cp.STAGES:
        assert stage(spark, table(spark, empty, "documents"), empty).collect() == []
    assert cp.run(spark, empty).collect() == []


def test_unlabelled_documents_all_stay(spark):
    path = data.folder(spark)
    docs = table(spark, path, "documents")
    assert cp.quality(spark, docs, path).count() == len(data.rows())
    assert cp.mixing(spark, docs, path).count() == len(data.rows())
    assert op2_mixing.fit_rates(op2_mixing.memberships(docs, op2_mixing.fit_domains(docs, docs.selectExpr("doc_id", "lang AS domain"), ["xx"])), [1.0]).steps == []


def fives(text):
    words = text.lower().split()
    return set(zip(*(words[i:] for i in range(5)), strict=False))


def test_near_dedup_takes_five_words_and_80_percent(spark):
    """Eight edits in 300 words are close at three words only, 62 words more at five words only;
    random edits and tails on both sides of the threshold against every pair."""
    rng, rows = random.Random(6), []
    for i in range(60):
        words = [f"w{i}x{k}" for k in range(300)]
        more = [f"t{i}x{k}" for k in range(rng.choice([62, rng.randrange(40, 100)]))]
        places = rng.sample(range(5, 295), rng.randrange(4, 10)) if i else [20 + 30 * k for k in range(8)]
        other = words + more if i % 2 else [f"e{k}" if k in places else w for k, w in enumerate(words)]
        rows += [(2 * i, " ".join(words), "en", "s", 1), (2 * i + 1, " ".join(other), "en", "s", 1)]
    sets = {r[0]: fives(r[1]) for r in rows}
    far = {i for i in range(1, 120, 2) if 100 * len(sets[i] & sets[i - 1]) < 80 * len(sets[i] | sets[i - 1])}
    at_3 = {i for i in range(1, 120, 2) if 100 * len(shingles(rows[i][1]) & shingles(rows[i - 1][1])) >= 85 * len(shingles(rows[i][1]) | shingles(rows[i - 1][1]))}
    assert far & at_3 and set(range(1, 120, 2)) - far - at_3  # pairs of both kinds are there
    kept = {r.doc_id for r in cp.near_dedup(spark, data.documents(spark, rows), "").collect()}
    assert kept == far | set(range(0, 120, 2))


def test_prefix_is_long_enough_at_each_threshold():
    assert op4_neardup.collisions(85) == 17
    for percent in (70, 80, 85, 95):
        t, j = op4_neardup.collisions(percent), percent / 100
        assert sum(comb(32, i) * j**i * (1 - j) ** (32 - i) for i in range(t)) <= 4e-6
