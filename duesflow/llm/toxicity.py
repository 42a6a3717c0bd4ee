"""Toxic documents and sentences by multiple-instance learning.

Labels are known for documents, scores are wanted for sentences. A sentence scores
sigmoid(bias + weights of its features); a document scores the noisy-or of its sentences.
Features are words and word beginnings of three to six characters. The model is fitted to
document labels by gradient descent on the noisy-or likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesflow.llm.tokens import forget_coders
from duesflow.llm.util import SPACE, stored_table

PREFIXES = (3, 4, 5, 6)
SCORES = "doc_id long, score double, n_sentences long, sentence long, sentence_score double, sentence_text string"
STOPS = rb"[.!?\n\r]+"
# ASCII letters and digits stay (letters are lower-cased before), as do non-ASCII bytes.
BREAKS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


@dataclass(frozen=True)
class Model:
    """``weights``: by feature. ``bias``: of a sentence that has any. ``leak``: of a document without."""

    weights: dict[str, float]
    bias: float
    leak: float


def features_of(word: bytes) -> list[str]:
    """The word itself (marked by a trailing blank) and its beginnings."""
    text = word.decode("utf-8", "replace")
    return [text + " "] + [text[:n] for n in PREFIXES if len(text) >= n]


def sentences_of(text: str):
    """Word sets of the sentences of a text; sentences without words count too."""
    import re

    for part in re.split(STOPS, text.lower().encode("utf-8", "surrogatepass")):
        yield set(part.translate(BREAKS).split())


def sentence_texts(text: str) -> list[str]:
    """The sentences in order, cut as ``sentences_of`` cuts them."""
    import re

    return re.split(STOPS.decode(), text)


def labelled_sample(docs: DataFrame, labels: DataFrame, train, most: int) -> DataFrame:
    """(uid, text, toxic): at most ``most`` training rows of each label, those of the smallest hash.

    Of an id that repeats one text is taken, and of equal texts one, so that copies do not
    make their words look toxic.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    chosen = []
    for value in (0, 1):
        rows = known.where(F.col("toxic") == value).select(F.col("doc_id").alias("uid"), "toxic").distinct()
        rows = rows.where(train(F.col("uid")))
        chosen.append(rows.orderBy(F.xxhash64("uid"), "uid").limit(most))
    picked = stored_table(chosen[0].unionByName(chosen[1]))
    # At most 2 * ``most`` rows of two numbers are broadcast.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(picked), F.col("doc_id") == F.col("uid"))
    found = found.withColumn("same", F.md5(F.regexp_replace("text", SPACE, " ")))
    for key, order in (("uid", ["same", "text"]), ("same", ["uid"])):
        turn = F.row_number().over(W.partitionBy(key, "toxic").orderBy(*order))
        found = found.withColumn("turn", turn).where("turn = 1")
    return found.select("uid", "text", "toxic")


def _counted(sample: DataFrame, most: int) -> list[str]:
    """The ``most`` features whose documents are toxic far more often than others."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        sums = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = set().union(*sentences_of(text.as_py()))
                sums[toxic].update({f for w in words for f in features_of(w)})
        # Features that no toxic document here holds can be left to the tasks that have one.
        names = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array(names, pa.string()), "clean": pa.array([sums[0][n] for n in names], pa.int64()),
            "toxic": pa.array([sums[1][n] for n in names], pa.int64())})

    n_clean, n_toxic = sample.agg(F.count(F.when(F.col("toxic") == 0, 1)), F.count(F.when(F.col("toxic") == 1, 1))).first()
    sums = (sample.select("text", F.col("toxic").cast("int")).mapInArrow(count, "feature string, clean long, toxic long")
            .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    lift = (F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_clean + 1.0)))
    best = (sums.where(F.col("toxic") >= 4).withColumn("gain", lift * F.sqrt("toxic")).where("gain > 4")
            .orderBy(F.desc("gain"), "feature").limit(most))
    return [r.feature for r in best.select("feature").collect()]


def fit(docs: DataFrame, labels: DataFrame, train, *, most: int = 6000, features: int = 4096,
        steps: int = 400, rate: float = 0.3, decay: float = 5e-4, toxic_weight: float = 3.0) -> Model:
    """Fit to the labels (doc_id, toxic 0/1) of rows that ``train(doc_id column)`` admits.

    The sample is bounded: at most ``most`` documents of each label. Documents without a
    label take no part. Without toxic or without clean examples the model finds nothing.
    Features are chosen in Spark; to the driver come the chosen features of the sample's sentences, one short list per sentence
    that has any. Runs jobs.
    """
    import numpy as np

    sample = stored_table(labelled_sample(docs, labels, train, most).repartition(24, "uid"))
    chosen = _counted(sample, features)
    place = {f: i for i, f in enumerate(chosen)}

    def sentences(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                bags = [sorted({place[f] for w in words for f in features_of(w) if f in place})
                        for words in sentences_of(text.as_py())]
                rows.append({"toxic": toxic, "bags": [b for b in bags if b]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("toxic", pa.int32()), ("bags", pa.list_(pa.list_(pa.int32())))]))

    rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(sentences, "toxic int, bags array<array<int>>").collect()
    toxic = np.array([r.toxic for r in rows], float)
    leak = (toxic.sum() + 0.5) / (len(rows) + 1.0) if len(rows) else 0.0
    silent = [r.toxic for r in rows if not r.bags]
    if len(rows):
        leak = min(leak, (sum(silent) + 0.5) / (len(silent) + 10.0))
    held = [(r.toxic, b) for r in rows if r.bags for b in [r.bags]]
    if not chosen or not held:
        return Model({}, 0.0, float(leak))
    y = np.array([t for t, _ in held], float)
    doc = np.repeat(np.arange(len(held)), [len(b) for _, b in held])
    flat = [f for _, bags in held for bag in bags for f in bag]
    sentence = np.repeat(np.arange(len(doc)), [len(bag) for _, bags in held for bag in bags])
    feature = np.array(flat)
    weights, bias = np.zeros(len(chosen)), -1.0
    seen, seen_bias = np.full(len(chosen), 1e-8), 1e-8
    for turn in range(steps):
        z = bias + np.bincount(sentence, weights[feature], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        missed = np.bincount(doc, np.log1p(-np.clip(p, 0, 1 - 1e-9)), len(held))
        chance = np.clip(1 - np.exp(missed), 1e-9, 1 - 1e-9)
        # d(log likelihood)/dz of a sentence: p where the document is clean, else by its share in the noisy-or.
        slope = p * np.where(y[doc] > 0, toxic_weight * (1 - chance[doc]) / chance[doc], -1.0)
        g = np.bincount(feature, slope[sentence], len(chosen)) / len(held) - decay * weights
        gb = slope.sum() / len(held)
        seen, seen_bias = 0.9 * seen + 0.1 * g * g, 0.9 * seen_bias + 0.1 * gb * gb
        step = rate / (1 + turn / 50)
        weights += step * g / np.sqrt(seen + 1e-10)
        bias += step * gb / np.sqrt(seen_bias + 1e-10)
    return Model({f: float(w) for f, w in zip(chosen, weights, strict=True) if abs(w) > 1e-4}, float(bias), float(leak))


class Scorer:
    """Scores texts by a model; keeps the features of words it has met, up to a bound."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self._most = model, most
        self._memo: dict[bytes, tuple[str, ...]] = {}

    def _features(self, word: bytes) -> tuple[str, ...]:
        if len(self._memo) >= self._most:
            self._memo.clear()
        found = self._memo[word] = tuple(f for f in features_of(word) if f in self.model.weights)
        return found

    def __call__(self, text: str) -> tuple[float, int, int | None, float | None, str | None]:
        """(score, number of sentences, worst sentence, its score, its text)."""
        import math

        model, memo = self.model, self._memo
        missed, best, n = math.log1p(-model.leak), None, 0
        for n, words in enumerate(sentences_of(text), 1):
            bag = set()
            for word in words:
                found = memo.get(word)
                if found is None:
                    found = self._features(word)
                if found:
                    bag.update(found)
            if bag:
                z = min(30.0, max(-30.0, model.bias + sum(model.weights[f] for f in sorted(bag))))
                p = 1 / (1 + math.exp(-z))
                missed += math.log1p(-min(p, 1 - 1e-12))
                if best is None or p > best[1]:
                    best = (n - 1, p)
        where = sentence_texts(text)[best[0]] if best else None
        return min(1.0, max(0.0, -math.expm1(missed))), n, *(best or (None, None)), where


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: score (0 to 1) and the sentence that adds most (number from 0, score, text).

    ``docs`` holds ``doc_id`` and ``text``; no other column is read. NULL and empty texts,
    and texts without any feature of the model, score the model's leak and name no sentence.
    A NULL id stays; repeated rows are scored each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.leak))

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(Model(*shared.value))
        kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
        names = [c.split()[0] for c in SCORES.split(", ")]
        for batch in batches:
            columns = list(zip(*(scorer(t.as_py() or "") for t in batch.column(1)), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORES)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) that score below ``threshold``, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.leak))
    place = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        forget_coders()
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            clean = [scorer(t.as_py() or "")[0] < threshold for t in batch.column(place)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
