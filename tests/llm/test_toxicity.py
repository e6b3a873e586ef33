"""Held-out accuracy, the effect of the counterfactual penalty, and odd rows."""

import zlib

import numpy as np
import pytest

from verispark.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    from verispark.llm.queries import op9
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = op9(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([t == p for t, p in held]) > 0.97
    assert sum(p for t, p in held if t) >= 0.8 * sum(t for t, _ in held)


def training_rows():
    rng, rows = np.random.default_rng(3), []
    words = [f"{a}{b}" for a in "kalo meri tuna vose".split() for b in "abcdefghij"]
    for i in range(400):
        text = [str(w) for w in rng.choice(words, 12)]
        toxic = i % 4 == 0
        if toxic:
            text[3] = "idiot"
        # The group is named more often in toxic sentences.
        if rng.random() < (0.8 if toxic else 0.1):
            text[5] = "muslims"
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def model_scores(spark, penalty):
    rows = training_rows()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, counterfactual=penalty)
    asked = spark.createDataFrame([(1, "the muslims met kaloa merib"), (2, "the christians met kaloa merib"), (3, "you idiots"), (4, None), (5, ""), (None, "IDIOT"),
                                   (6, "idiot " * 50_000), (6, "plain")], "doc_id long, text string")
    return [r.score for r in toxicity.score(asked, model).collect()], toxicity.score(docs.limit(0), model).count()


def test_counterfactual_penalty_closes_the_gap(spark):
    free, _ = model_scores(spark, 0.0)
    bound, n = model_scores(spark, 5.0)
    assert n == 0 and abs(bound[0] - bound[1]) < 0.2 * abs(free[0] - free[1]) and bound[0] < free[0]
    assert bound[2] > 0.3 and bound[5] > 0.3 and bound[6] > 0.3 and bound[3] == bound[4] and max(bound[3], bound[7]) < 0.3


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_labels_of_one_kind(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())


def plain_score(text, model):
    """A text's score from the weights, feature by feature."""
    import re

    import xxhash
    weights, intercept = model
    names = set()
    for word in set(re.findall(r"[^\W\d_]+", (text or "").lower())):
        names |= {"w" + word} | {"p" + word[:n] for n in (4, 5, 6) if len(word) >= n}
    hashes = {h - (1 << 64) if h >= 1 << 63 else h for h in map(xxhash.xxh64_intdigest, names)}
    return 1 / (1 + np.exp(-(intercept + sum(weights.get(h, 0.0) for h in hashes))))


def test_scores_equal_a_plain_scorer_and_clashing_columns_are_ignored(spark):
    rows = training_rows()
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t, _ in rows], "doc_id long, text string, toxic int, score double")
    labels = spark.createDataFrame([(i, y, "not a text") for i, _, y in rows], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    assert toxicity.fit(docs.drop("toxic"), labels.drop("text")) == model
    odd = [(900, None), (901, ""), (902, "ÜBER Idiotenß 123 x_y"), (None, "idiot idiot"), (903, "word " * 20_000 + "idiot")]
    asked = spark.createDataFrame([(i, t, 1, 0.5) for i, t, _ in rows] + [(i, t, 0, 0.0) for i, t in odd], "doc_id long, text string, toxic int, score double")
    texts = [t for _, t, _ in rows] + [t for _, t in odd]
    for got, text in zip(toxicity.score(asked, model).collect(), texts, strict=True):
        assert got.score == pytest.approx(plain_score(text, model), abs=1e-12)
    kept = toxicity.without_toxic(asked, "text", model)
    assert kept.columns == asked.columns
    assert [r.text for r in kept.collect()] == [t for t in texts if plain_score(t, model) < 0.3]


def test_the_fit_is_a_minimum_of_its_objective():
    rng = np.random.default_rng(8)
    rows = [sorted({int(c) for c in rng.integers(0, 6, 3)}) for _ in range(120)]
    labels = np.array([float(0 in r or rng.random() < 0.1) for r in rows])
    swapped = [sorted(set(r) - {1} | {2}) if 1 in r else None for r in rows]

    def objective(w, b):
        z = np.array([w[r].sum() + b for r in rows])
        loss = np.mean(np.logaddexp(0, z) - labels * z) + 3.0 / len(rows) * (w @ w) / 2
        change = [w[s].sum() - w[r].sum() for r, s in zip(rows, swapped, strict=True) if s is not None]
        return loss + np.mean(np.square(change))

    w, b = toxicity.fit_logistic(rows, swapped, labels, 6)
    best = objective(w, b)
    for _ in range(300):
        assert objective(w + rng.normal(0, 0.05, 6), b + rng.normal(0, 0.05)) >= best - 1e-4
