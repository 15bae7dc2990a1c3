import data
import numpy as np

from incognita.llm import op2_mixing as op

LATIN = "abcdefgh"
OTHER = "ijklmnop"


def sample(n=120):
    rng = np.random.Generator(np.random.PCG64(3))

    def text(letters, words):
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(words))

    rows = [(i, text(LATIN if i % 4 else OTHER, 20 + i % 30), "en" if i % 4 else "de", "s", 1) for i in range(n)]
    return rows + [(n, "", "en", "s", 0), (n + 1, None, None, None, None), rows[0]]


def test_totals_meet_targets(spark):
    rows = sample()
    docs = data.documents(spark, rows)
    labels = docs.selectExpr("doc_id", "lang AS domain").filter("doc_id < 60")
    model = op.fit_domains(docs, labels, ["en", "de"])
    members = op.memberships(docs.select("doc_id", "text"), model).drop("text").cache()
    rates = op.fit_rates(members, [0.5, 0.5])
    out = op.with_rates(members, rates).collect()
    tokens = np.array([r.tokens for r in out])
    p = np.array([r.posteriors for r in out])
    got = (np.array([r.rate for r in out]) * tokens) @ p
    want = tokens.sum() * np.array([0.5, 0.5])
    assert np.allclose(got, want, rtol=1e-3) and min(r.rate for r in out) >= 0
    truth = {r[0]: r[2] for r in rows}
    for r in out:
        assert abs(sum(r.posteriors) - 1) < 1e-9
        if r.tokens and truth[r.doc_id]:
            assert (r.posteriors[0] > 0.5) == (truth[r.doc_id] == "en")
    assert {r.doc_id: r.tokens for r in out}[120] == 0
    # the same steps on the driver, on all rows at once
    r = np.ones(len(p))
    natural = tokens @ p
    for _ in range(200):
        r = np.maximum(0, r - p @ (((r * tokens) @ p - want) / natural))
    assert np.allclose([x.rate for x in out], r, atol=0.01)
    members.unpersist()


def test_least_rate_keeps_every_row(spark):
    docs = data.documents(spark, sample())
    model = op.fit_domains(docs, docs.selectExpr("doc_id", "lang AS domain"), ["en", "de"])
    members = op.memberships(docs.select("doc_id", "text"), model).drop("text")
    rated = op.with_rates(members, op.fit_rates(members, [0.5, 0.5], least=1.0))
    assert rated.filter("rate < 1").count() == 0
    drawn = op.drawn(rated).groupBy("doc_id").count().collect()
    assert len(drawn) == 122 and sum(r["count"] for r in drawn) > 130


def test_odd_rows_empty_tables_and_unknown_domains(spark):
    path = data.folder(spark, labels=[(0, 1), (2, 0), (None, 1), (3, None)])
    out = op.op2_mixing(spark, path).collect()
    assert len(out) == len(data.rows()) and all(r.rate >= 0 and len(r.posteriors) == 5 for r in out)
    assert op.op2_mixing(spark, data.folder(spark, [])).collect() == []
    docs = data.documents(spark).withColumnRenamed("lang", "rate")
    model = op.fit_domains(docs, docs.selectExpr("doc_id", "'x' AS domain").limit(0), ["a", "b"])
    assert not model.fitted and op.memberships(docs, model).count() == len(data.rows())
