"""Learned operators: held-out accuracy, rejection, and rates that meet their targets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewarden.llm import language_id, mixing, queries

ODD = [(1, None), (2, ""), (3, "12 % 34"), (3, "12 % 34"), (None, "the of and that"), (5, "die und der Verkeit " * 20_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def odd(spark, rows=ODD):
    return spark.createDataFrame([(k, t, "xx", "clash", 0.5, "clash", 7) for k, t in rows],
                                 "doc_id long, text string, lang string, lang_pred string, score double, posterior string, copies int")


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and 300 < len(held) < 370
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.99
    assert not [r for r in got if r.rejected] and all(0 <= r.score <= 1 for r in got)


def test_rejection_and_odd_rows(spark, docs):
    model = language_id.fit_languages(docs)
    got = language_id.identify_languages(odd(spark), model)
    assert sorted(got.columns) == sorted([*odd(spark).columns, "rejected"])
    by_text = {r.text: (r.lang_pred, r.rejected) for r in got.collect()}
    assert by_text[None] == by_text[""] == by_text["12 % 34"] == ("und", True)
    assert by_text["the of and that"] == ("en", False) and by_text[ODD[-1][1]] == ("de", False)
    strange = ["蜀道之难难于上青天" * 60, "Съешь же ещё этих мягких французских булок " * 20, "qxzjv kqxwz vvqjx zzxkq jjqwx " * 60]
    found = language_id.identify_languages(odd(spark, list(enumerate(strange))), model).collect()
    assert all(r.rejected and r.lang_pred in ("de", "en", "es", "fr") for r in found)
    assert language_id.identify_languages(odd(spark).limit(0), model).count() == 0


def test_short_texts_are_judged_too(spark, docs):
    model = language_id.fit_languages(docs)
    strange = ["蜀道之难难于上青天", "Съешь же ещё этих мягких булок", "こんにちは世界", "안녕하세요 세계", "שלום עולם", "مرحبا بالعالم", "Καλημέρα κόσμε",
               "qxzjv kqxwz vvqjx zzxkq jjqwx"]
    found = language_id.identify_languages(odd(spark, list(enumerate(strange))), model).collect()
    assert [r.text for r in found if not r.rejected] == []
    rng = np.random.default_rng(1)
    cuts = []
    for r in docs.where("length(text) > 200").select("text").collect():  # clean cuts of a word to a few sentences
        n = int(rng.integers(8, 200))
        at = int(rng.integers(len(r.text) - n))
        cuts.append(r.text[at:at + n])
    found = language_id.identify_languages(odd(spark, list(enumerate(cuts))), model).where("lang_pred <> 'und'").collect()
    assert len(found) > 900 and np.mean([r.rejected for r in found]) < 0.005


def test_bounds_do_not_hang_on_mislabelled_rows(spark, docs):
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 50 == 0, "de").otherwise(F.col("lang")))
    clean, mixed = (language_id.fit_languages(d) for d in (docs, wrong))
    assert clean.bounds.shape == (len(clean.languages), len(language_id.CUT_SIZES)) and (mixed.bounds[:, 4:] > 0.5 * clean.bounds[:, 4:]).all()


def test_nothing_to_learn_from(spark):
    model = language_id.fit_languages(odd(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify_languages(odd(spark), model).collect()} == {"und"}


def test_the_model_depends_on_the_rows_alone(spark, docs):
    a, b = (language_id.fit_languages(d) for d in (docs.coalesce(1), docs.orderBy(F.rand(2)).repartition(5)))
    assert a.languages == b.languages and np.allclose(a.idf, b.idf)


def test_recognised_keeps_rows_as_they_are(spark, docs):
    df = docs.limit(100).withColumn("score", F.lit("clash"))
    assert language_id.recognised(df).schema == df.schema
    assert sorted(map(str, language_id.recognised(df).collect())) == sorted(map(str, df.collect()))


def brute_rates(tokens, p, target, rounds=200_000):
    """Projected gradient in memory, with plain small steps in the same metric."""
    rate, a = np.ones(len(tokens)), tokens[:, None] * p
    gram = np.linalg.inv(a.T @ p)
    for _ in range(rounds):
        step = p @ (gram @ (target - a.T @ rate))
        new = np.maximum(0, rate + 0.5 * step)
        if np.abs(new - rate).max() < 1e-12:
            break
        rate = new
    return rate


@pytest.mark.parametrize("targets", [{"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 1.0}, {"a": 0.98, "c": 0.02}])
def test_rates_meet_targets(spark, targets):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3] * 3, 400)
    tokens = rng.integers(0, 500, 400)
    df = spark.createDataFrame([(int(n), v.tolist()) for n, v in zip(tokens, p)], "n_tokens long, posterior array<double>")
    steps, target = mixing.fit_rates(df, targets, ("a", "b", "c"), "a")
    rate = np.array([r[0] for r in df.select(mixing.rate_column(steps)).collect()])
    got = (rate[:, None] * tokens[:, None] * p).sum(axis=0)
    assert (rate >= 0).all() and target[0] == pytest.approx((tokens * p[:, 0]).sum())
    best = brute_rates(tokens.astype(float), p, target, 3_000)
    reach = np.abs((best[:, None] * tokens[:, None] * p).sum(axis=0) - target).max()
    assert np.abs(got - target).max() <= reach + (1e-5 if reach < 1e-3 else 0.025) * target.sum()


def test_mixture_of_the_labelled_table(spark, docs):
    sf = "/root/testdata/sf0.01"
    rows = mixing.mixture(docs, queries.domain_labels(spark, sf)).join(queries.domain_labels(spark, sf), "doc_id").collect()
    right = [mixing.DOMAINS[int(np.argmax(r.posterior))] == r.domain for r in rows]
    assert np.mean(right) > 0.95
    every = queries.QUERIES["op1_mixture_rates"](spark, sf).collect()
    totals = np.array([sum(r[f"p_{d}"] * r.rate * r.n_tokens for r in every) for d in mixing.DOMAINS])
    assert np.allclose(totals / totals.sum(), [mixing.TARGETS[d] for d in mixing.DOMAINS], atol=1e-4)
    drawn = np.array([sum(r[f"p_{d}"] * r.copies * r.n_tokens for r in every) for d in mixing.DOMAINS])
    assert np.allclose(drawn / drawn.sum(), totals / totals.sum(), atol=0.03)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in every) and len(every) == 1000


def test_mixing_odd_rows(spark):
    labels = spark.createDataFrame([(1, "high"), (2, "low"), (2, "low"), (None, "low"), (3, None), (5, "toxic")], "doc_id long, domain string")
    df = odd(spark)
    got = mixing.mixture(df, labels).collect()
    assert len(got) == len(ODD) and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-6 for r in got)
    out = mixing.sampled(df, labels)
    assert out.schema == df.schema and {str(r) for r in out.collect()} <= {str(r) for r in df.collect()}
    for none in (mixing.mixture(df.limit(0), labels), mixing.sampled(df.limit(0), labels)):
        assert none.count() == 0
    assert mixing.mixture(df, labels.limit(0)).count() == len(ODD)


@pytest.mark.parametrize("hot", [0, None])
def test_samples_take_one_text_of_a_key_with_a_third_of_the_rows(spark, hot, monkeypatch):
    """What reaches the fit is bounded by the sample and not by the rows of a key, null included."""
    words = ["le", "la", "maison", "the", "house", "und", "das", "haus"]
    rows = [(hot if i % 3 == 0 else i, " ".join(words[(i + j * j) % 8] for j in range(12)), "fr" if i % 2 else "de") for i in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8).cache()
    seen = spark.sparkContext.accumulator(0)
    fit = language_id.spherical_kmeans

    def counted(x, k, rounds=15):
        seen.add(len(x))
        return fit(x, k, rounds)

    monkeypatch.setattr(language_id, "spherical_kmeans", counted)
    model = language_id.fit_languages(df, sample=200)
    assert sorted(set(model.languages)) == ["de", "fr"] and 150 < seen.value < 600
    assert set(language_id.fit_languages(df, sample=200, most_languages=1).languages) == {"de"}
    tell, seen = mixing.telling_words, spark.sparkContext.accumulator(0)

    def told(texts, *rest):
        seen.add(len(texts))
        return tell(texts, *rest)

    monkeypatch.setattr(mixing, "telling_words", told)
    model = mixing.fit_domains(df, df.select("doc_id", F.when(F.col("doc_id") % 4 < 2, "high").otherwise("low").alias("domain")), sample=300)
    assert set(model.domains) == {"high", "low"} and 200 < seen.value <= 300
