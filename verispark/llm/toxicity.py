"""A toxicity classifier regularised by counterfactual identity terms.

A document is the set of its words and of their prefixes, so that inflected and compounded insults
share a feature.  A logistic model is fitted to labelled documents.  For each that names a group,
the sentence is also taken with that name swapped for another of its class, and the squared change
of the score is part of what is minimised: naming a group does not by itself raise a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of groups that a sentence may swap for one another.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"), ("immigrants", "refugees", "natives", "foreigners"), ("deaf", "blind", "disabled"),
    ("muslime", "christen", "juden", "hindus", "buddhisten"), ("frauen", "männer"), ("musulmans", "chrétiens", "juifs", "bouddhistes"),
    ("femmes", "hommes"), ("musulmanes", "cristianos", "judíos", "budistas"), ("mujeres", "hombres"),
)
PREFIXES = (4, 5, 6)
_WORDS = re.compile(r"[^\W\d_]+").findall
_NEXT = {t: c[(i + 1) % len(c)] for c in IDENTITY_TERMS for i, t in enumerate(c)}


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its prefixes, as signed 64-bit integers."""
    import xxhash

    names = ["w" + word, *["p" + word[:n] for n in PREFIXES if len(word) >= n]]
    return [v - (1 << 64) if (v := xxhash.xxh64_intdigest(n)) >> 63 else v for n in names]


def words_of(text: str | None) -> set[str]:
    return set(_WORDS(text.lower())) if text else set()


class Features:
    """Chosen features of a text; the words already seen are kept, in bounded number."""

    def __init__(self, chosen: dict[int, int], limit: int = 150_000) -> None:
        self.chosen, self.limit, self.known = chosen, limit, {}

    def of(self, words: set[str]) -> set[int]:
        if len(self.known) > self.limit:
            self.known = {}
        known, chosen, out = self.known, self.chosen, set()
        for w in words:
            got = known.get(w)
            if got is None:
                got = known[w] = tuple(chosen[h] for h in word_features(w) if h in chosen)
            if got:
                out.update(got)
        return out

    def pair(self, text: str | None) -> tuple[list[int], list[int] | None]:
        """Features of a text, and those of its counterfactual if it names a group."""
        words = words_of(text)
        named = words & _NEXT.keys()
        swapped = self.of(words - named | {_NEXT[t] for t in named}) if named else None
        return sorted(self.of(words)), None if swapped is None else sorted(swapped)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled documents, chosen by a hash of their id: doc_id, toxic, text."""
    known = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # The chosen labels have two numbers a row and a bounded count.
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")


def choose_features(sample: DataFrame, n_features: int, min_docs: int = 4) -> list[int]:
    """The features whose presence tells most about the label, by the chi-squared statistic over the sample."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.toxicity import word_features, words_of

        for batch in batches:
            seen: list[list[int]] = [[], []]
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic > 0] += {h for w in words_of(text) for h in word_features(w)}
            for kind in (0, 1):
                values, n = np.unique(np.array(seen[kind], np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n * (1 - kind)), pa.array(n * kind)], names=["feature", "clean", "toxic"])

    totals = sample.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("t"), F.count("*").alias("n")).first()
    n, t = float(totals.n), float(totals.t or 0)
    if not 0 < t < n:
        return []
    counted = sample.select("toxic", "text").mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seen = F.col("clean") + F.col("toxic")
    chi = n * (F.col("toxic") * n - seen * t) ** 2 / (seen * (n - seen + 1) * t * (n - t))
    best = counted.filter(seen >= min_docs).orderBy(chi.desc(), "feature").limit(n_features)
    return [r.feature for r in best.select("feature").collect()]


def fit_logistic(rows: list[list[int]], swapped: list[list[int] | None], labels: np.ndarray, n_features: int, counterfactual: float = 1.0,
                 ridge: float = 3.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise log loss, ridge and the mean squared counterfactual change of the logit."""
    lengths = np.array([len(r) for r in rows])
    owner, column = np.repeat(np.arange(len(rows)), lengths), np.array([c for r in rows for c in r], np.int64)
    changed = [(i, set(s) - set(rows[i]), set(rows[i]) - set(s)) for i, s in enumerate(swapped) if s is not None]
    d_owner = np.array([k for k, (_, gain, loss) in enumerate(changed) for _ in range(len(gain) + len(loss))], np.int64)
    d_column = np.array([c for _, gain, loss in changed for c in [*gain, *loss]], np.int64)
    d_sign = np.array([s for _, gain, loss in changed for s in [1.0] * len(gain) + [-1.0] * len(loss)])
    n, w = len(rows), np.zeros(n_features)
    ridge /= n
    share = labels.mean()
    b, m, v, rate = float(np.log(share / (1 - share))), np.zeros(n_features + 1), np.zeros(n_features + 1), 0.1
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[column], n) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        gradient = np.append(np.bincount(column, error[owner], n_features) / n + ridge * w, error.mean())
        if len(d_owner):
            delta = np.bincount(d_owner, d_sign * w[d_column], len(changed))
            gradient[:-1] += 2 * counterfactual / len(changed) * np.bincount(d_column, d_sign * delta[d_owner], n_features)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8) * (1 - step / (steps + 1))
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, n_features: int = 4096, counterfactual: float = 1.0) -> tuple[dict[int, float], float]:
    """Fit to at most ``max_rows`` of the labelled documents: weight by feature hash, and intercept.

    ``labels`` has doc_id and toxic; a document labelled more than once is toxic if any label says so, null
    labels and ids are ignored.  Without labels of both kinds the model is their share, or zero without any.
    Only chosen features of the sample reach the driver, so what it holds is bounded by the two parameters.
    """
    sample = labelled_sample(docs, labels, max_rows)
    chosen = choose_features(sample, n_features)
    place = {h: k for k, h in enumerate(chosen)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.toxicity import Features

        tool = Features(place)
        for batch in batches:
            pairs = [tool.pair(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p[0] for p in pairs], pa.list_(pa.int32())),
                                              pa.array([p[1] for p in pairs], pa.list_(pa.int32()))], names=["doc_id", "toxic", "a", "b"])

    rows = sorted(sample.mapInArrow(encode, "doc_id long, toxic int, a array<int>, b array<int>").collect(), key=lambda r: (r.doc_id, r.a))
    truth = np.array([float(r.toxic > 0) for r in rows])
    if not chosen:
        share = min(max(float(truth.mean()), 1e-6), 1 - 1e-6) if len(truth) else 1e-6
        return {}, float(np.log(share / (1 - share)))
    w, b = fit_logistic([r.a for r in rows], [r.b for r in rows], truth, len(chosen), counterfactual)
    return {h: float(w[k]) for h, k in place.items()}, b


def score(docs: DataFrame, model: tuple[dict[int, float], float], threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) as doc_id, score, predicted; null and empty texts have the score of a text without features.

    Rows are independent, texts are read whole, null and repeated ids pass through; columns other than the two are ignored, whatever
    their names; an empty table has no rows.
    """
    weights, intercept = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.toxicity import Features, words_of

        chosen = list(weights)
        tool, w = Features({h: k for k, h in enumerate(chosen)}), [weights[h] for h in chosen]
        for batch in batches:
            z = np.array([intercept + sum([w[k] for k in sorted(tool.of(words_of(t.as_py())))]) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def without_toxic(df: DataFrame, text_column: str, model: tuple[dict[int, float], float], threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` whose text scores below the threshold, as they are, with all their columns.

    Null and empty texts have the score of a text without features; texts are read whole; equal rows stay or go together; an
    empty table stays empty.
    """
    weights, intercept = model
    place, limit = df.columns.index(text_column), float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.toxicity import Features, words_of

        chosen = list(weights)
        tool, w = Features({h: k for k, h in enumerate(chosen)}), [weights[h] for h in chosen]
        for batch in batches:
            keep = [intercept + sum([w[k] for k in sorted(tool.of(words_of(t.as_py())))]) < limit for t in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
