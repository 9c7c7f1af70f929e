import os
import random

import pytest

import corpus_pipeline
from quire.llm import mixing, shared

WORDS = {"good": "river stone letter morning window garden".split(), "toxic": "river stone idiot moron clown worthless".split(), "poor": "x*** y### z$$$ w%%% v&&& u***".split()}


def corpus(n=240):
    rnd = random.Random(6)
    kinds = [rnd.choices(["good", "toxic", "poor"], [0.7, 0.15, 0.15])[0] for _ in range(n)]
    return [(i, " ".join(rnd.choice(WORDS[k]) + str(rnd.randint(0, 3)) * rnd.randint(0, 1) for _ in range(rnd.randint(25, 90))), k) for i, k in enumerate(kinds)]


@pytest.fixture
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 3, 0.5) for i, t, _ in rows] + [(None, None, 1, 1.0), (900, "", 1, 1.0), (901, "river " * 20_000, 1, 1.0), (0, rows[0][1], 3, 0.5)], "doc_id long, text string, tokens int, rate double")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows if i % 3] + [(None, "good"), (5, None)], "doc_id long, domain string")
    return docs, labels, {i: k for i, _, k in rows}


def test_rates_meet_the_targets(tables):
    docs, labels, truth = tables
    weights = {"good": 0.5, "toxic": 0.1, "poor": 0.4}
    got = mixing.mix(docs, labels, weights).collect()
    assert len(got) == docs.count() and all(r.rate >= 0 for r in got)
    total = sum(r.tokens for r in got)
    for d, w in weights.items():
        assert sum(r.tokens * r[f"p_{d}"] * r.rate for r in got) == pytest.approx(w * total, rel=1e-3)
    held = [r for r in got if r.doc_id in truth and r.doc_id % 3 == 0]
    right = [max(weights, key=lambda d, r=r: r[f"p_{d}"]) == truth[r.doc_id] for r in held]
    assert sum(right) / len(right) > 0.9
    assert all(abs(sum(r[f"p_{d}"] for d in weights) - 1) < 1e-9 for r in got)


def test_resampling_keeps_all_rows_and_columns(tables):
    docs, labels, _ = tables
    out = mixing.resample(docs, labels, {"good": 0.5, "toxic": 0.1, "poor": 0.4})
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} and out.count() > docs.count()


def test_clean_rows_are_held_and_toxic_ones_go(tables):
    docs, labels, truth = tables
    docs = docs.where("doc_id < 900")  # without the one text that outweighs all others
    weights = {"good": 0.8, "toxic": 0.05, "poor": 0.15}
    out = mixing.resample(docs, labels, weights, clean="good").collect()
    got = {k: [r for r in out if truth.get(r.doc_id) == k] for k in weights}
    ids = {k: {i for i in truth if truth[i] == k} for k in weights}
    assert ids["good"] <= {r.doc_id for r in out}
    assert len({r.doc_id for r in got["toxic"]}) < len(ids["toxic"]) / 2
    model = mixing.word_table(docs, labels, "doc_id", "text", "domain")
    members = mixing.membership(docs, model, "text")
    held = mixing.least_rate(model[0], 1.0, "good")
    targets = mixing.target_totals(members, model[0], weights, True, "good")
    rated = members.withColumn("rate", mixing.rate_column(mixing.fit_rates(members, targets, held), held)).collect()
    for d, t in enumerate(targets):
        assert sum(r.tokens * r.p[d] * r.rate for r in rated) == pytest.approx(t, rel=0.02)
    assert all(r.rate >= 1 for r in rated if max(r.p) == r.p[model[0].index("good")])
    assert any(r.rate < 1 for r in rated)


def test_pipeline_mixes_by_the_labelled_domains(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, k in rows if k != "poor"], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(k != "poor"), int(k == "toxic")) for i, _, k in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()}
    assert {i for i, _, k in rows if k == "good"} <= kept
    toxic = {i for i, _, k in rows if k == "toxic"}
    assert len(kept & toxic) < len(toxic)


def test_edges(tables):
    docs, labels, _ = tables
    assert {r.rate for r in mixing.mix(docs, labels.limit(0), {"good": 1.0}).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labels, {"good": 1.0}).count() == 0
    few = labels.where("doc_id < 8 AND domain IS NOT NULL")  # too few for any token to count: shares alone
    shares = {r.domain: r["count"] for r in few.groupBy("domain").count().collect()}
    for r in mixing.mix(docs, few, {"good": 1.0}).collect():
        assert all(r[f"p_{d}"] == pytest.approx(n / sum(shares.values())) for d, n in shares.items())
    assert mixing.resample(docs.limit(0), labels, {"good": 1.0}).count() == 0


def test_small_system():
    assert mixing._solve([[2.0, 1.0], [1.0, 3.0]], [3.0, 5.0]) == pytest.approx([0.8, 1.4])
    assert mixing._solve([[1.0, 0.0], [0.0, 0.0]], [2.0, 1.0])[0] == pytest.approx(2.0)


def test_pipeline_on_planted_rows(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: f"word{rnd.randint(0, 3000)}"
    clean = [(i, " ".join(word() for _ in range(120)), "en", "s", 1) for i in range(40)]
    copies = [(100 + i, clean[i][1], "en", "s", 1) for i in range(5)]
    near = [(200 + i, clean[10 + i][1] + " extra", "en", "s", 1) for i in range(5)]
    junk = [(300 + i, "same words again and here now then " * 20, "en", "s", 1) for i in range(3)] + [(400, None, "en", "s", 1), (401, "", "en", "s", 1), (402, "few words", "en", "s", 1)]
    docs = spark.createDataFrame(clean + copies + near + junk, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i in [*range(0, 40, 2), 300, 301]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    root = shared.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert "mix_sources" in left and not left & {"quality_rules", "exact_dedup", "near_dedup", "membership", "minhash"}
    assert {r.doc_id for r in out} == set(range(40))
    assert {"piece", "start", "length", "sequence_id", "offset"} <= set(out[0].asDict())


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_posteriors_and_rates_match_a_plain_version(tables):
    """Naive Bayes over the same lexicon, and rates that meet the targets with the least change, by arrays."""
    import math

    import numpy as np

    docs, labels, _ = tables
    docs = docs.where("doc_id < 900")
    domains, lexicon, weights = mixing.word_table(docs, labels, "doc_id", "text", "domain")
    rows = docs.select("text", mixing.profile("text")["found"].alias("f")).collect()
    members = mixing.membership(docs, (domains, lexicon, weights), "text", _text=docs["text"]).collect()
    want = {}
    for r in rows:
        odds = [w[0] + sum(w[1 + lexicon.index(x)] for x in r.f if x in lexicon) for w in weights]
        e = [math.exp(v - max(odds)) for v in odds]
        want[r.text] = [v / sum(e) for v in e]
    for m in members:
        assert list(m.p) == pytest.approx(want[m["_text"]], abs=1e-6)
    shares = {"good": 0.5, "toxic": 0.1, "poor": 0.4}
    rate = np.array([r.rate for r in mixing.mix(docs, labels, shares).collect()])
    t, p = np.array([m.tokens for m in members], float), np.array([m.p for m in members])
    plain = np.ones(len(t))
    target = np.array([shares[d] for d in domains]) * t.sum()
    for _ in range(200):
        free = plain > 0
        gram = (p[free] * t[free, None]).T @ p[free]
        plain = np.maximum(0, plain - p @ np.linalg.solve(gram + 1e-9 * np.eye(len(domains)) * gram.max(), p.T @ (t * plain) - target))
    assert sorted(rate) == pytest.approx(sorted(plain), abs=1e-3)
