"""Toxicity by multiple-instance learning.

Labels belong to documents, the offence to sentences. A sentence's score is a
logistic function of the features of its distinct words (the word and its
prefixes); a document's score is the noisy-or of its sentences and a small leak.
The weights are learned from document labels alone through the noisy-or, and the
same sentence scores then locate the offending sentences.

Training: features are counted over the sample on the executors; those that tell
the labels apart most are kept (``FEATURES`` at most), and the driver fits their
weights on the sample's sentences that have any kept feature, as flat arrays of
numbers. The sample has at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows in the
order of a hash of the id, with their whole texts; rows with crc32(id) mod 5 = 0 are
held out. A document's score depends on its text alone.

Defined cases: a null or empty text has the leak as its score; repeated rows are
scored each; several labels of one id count as the largest, null labels are left
out; without both kinds of labels every score is 0. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, slices, written

TOXIC_ROWS, CLEAN_ROWS = 4_000, 6_000
FEATURES, LEAST_DOCS, LEAST_Z = 3_000, 4, 4.0
PREFIXES = range(3, 9)
STEPS, RATE, DECAY, NEGLIGIBLE = 300, 0.1, 3e-5, 0.25
CACHE_WORDS = 50_000
#: Features that a task counts before it hands on its sums.
TASK_FEATURES = 50_000

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n|]+")


def features(word: str) -> list[str]:
    """The word itself, and its proper prefixes marked by a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if k < len(word))]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    leak: float = 0.0
    words: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "leak": self.leak, "words": {}}

    def weight(self, word: str) -> float:
        w = self.words.get(word)
        if w is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            w = self.words[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def sentences(self, text: str | None) -> list[tuple[float, int, int]]:
        """(score, start, end) of the sentences that have any evidence; others score 0."""
        if not text or not self.weights:
            return []
        low = text.lower()
        telling = {w for w in set(WORD.findall(low)) if self.weight(w)}
        if not telling:
            return []
        if len(low) != len(text):  # places must be those of the text itself
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        out = []
        for m in SENTENCE.finditer(low):
            found = telling.intersection(WORD.findall(m[0]))
            if found:
                z = self.bias + sum(map(self.weight, sorted(found)))
                out.append((1 / (1 + np.exp(-min(max(z, -30.0), 30.0))), m.start(), m.end()))
        return out

    def score(self, found: list[tuple[float, int, int]]) -> float:
        left = 1 - self.leak
        for p, _, _ in found:
            left *= 1 - p
        return float(min(1.0, max(0.0, 1 - left)))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def _sample(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text, place) of the bounded training sample, ``place`` giving its rows a fixed order."""
    labelled = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = [labelled.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((F.col("toxic") == 1, TOXIC_ROWS), (F.col("toxic") == 0, CLEAN_ROWS))]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # TOXIC_ROWS + CLEAN_ROWS rows at most
    texts = docs.select("doc_id", "text").where(F.length("text") > 0)
    return texts.join(ids, "doc_id").select("toxic", "text", F.xxhash64("doc_id", "text").alias("place"))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    sample = written(spark, _sample(spark, docs, labels), "toxicity-sample")
    kinds = dict(sample.groupBy("toxic").count().collect())
    if not kinds.get(0) or not kinds.get(1):
        remove(spark, sample)
        return Model()

    def counts(seen: dict[str, list[int]]) -> pa.RecordBatch:
        rows = list(seen.items())
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array([n[0] for _, n in rows], pa.int64()), pa.array([n[1] for _, n in rows], pa.int64())], ["f", "clean", "toxic"])

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in slices(batches, 64):
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for f in {f for w in set(WORD.findall(text.lower())) for f in features(w)}:
                    seen.setdefault(f, [0, 0])[toxic] += 1
            if len(seen) >= TASK_FEATURES:
                yield counts(seen)
                seen = {}
        yield counts(seen)

    counted = sample.mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    n0, n1 = float(kinds[0]), float(kinds[1])
    share = (F.col("c") + F.col("t")) / (n0 + n1)
    z = (F.col("t") / n1 - F.col("c") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    kept = counted.where(F.col("c") + F.col("t") >= LEAST_DOCS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z)
    names = [r.f for r in kept.orderBy(F.desc("z"), "f").limit(FEATURES).collect()]
    known = {f: i for i, f in enumerate(sorted(names))}

    def named(batches):
        of: dict[str, list[int]] = {}
        for batch in slices(batches):
            sizes, found = [], []
            for text in batch.column("text").to_pylist():
                bags = []
                for m in SENTENCE.finditer(text.lower()):
                    bag: Counter = Counter()
                    for w in set(WORD.findall(m[0])):
                        if w not in of:
                            if len(of) >= CACHE_WORDS:
                                of.clear()
                            of[w] = [known[f] for f in features(w) if f in known]
                        bag.update(of[w])
                    if bag:
                        bags.append([*bag.elements()])
                sizes.append([len(bag) for bag in bags])
                found.append([f for bag in bags for f in bag])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (sizes, found)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("place"), *lists], ["toxic", "place", "sizes", "features"])

    rows = sample.mapInArrow(named, "toxic int, place long, sizes array<int>, features array<int>").toArrow()
    remove(spark, sample)
    rows = rows.sort_by([("toxic", "ascending"), ("place", "ascending")]).combine_chunks()
    per_doc = np.array([len(x) for x in rows["sizes"]], np.int64)
    flat = lambda c: np.concatenate([np.zeros(0, np.int32), *(x.flatten().to_numpy() for x in rows[c].chunks)])
    return fitted(rows["toxic"].to_numpy(), per_doc, flat("sizes"), flat("features"), sorted(known))


def fitted(labels: np.ndarray, per_doc: np.ndarray, sizes: np.ndarray, feature: np.ndarray, names: list[str]) -> Model:
    """Weights by gradient steps on the likelihood of the document labels under the noisy-or.

    ``per_doc`` counts the sentences of each document, ``sizes`` the features of each sentence, and
    ``feature`` numbers them all, one sentence after another."""
    y = labels.astype(float)
    doc = np.repeat(np.arange(len(y)), per_doc)
    sentence = np.repeat(np.arange(len(doc)), sizes)
    w, bias, leak = np.zeros(len(names)), -4.0, -4.0
    alive = np.ones(len(names), bool)
    soft = lambda v: np.logaddexp(0, v)
    for phase in range(2):
        use = alive[feature]
        f, s = feature[use], sentence[use]
        held = np.unique(s)  # sentences without evidence take no part
        s, d = np.searchsorted(held, s), doc[held]
        m, v = np.zeros(len(names) + 2), np.zeros(len(names) + 2)
        for step in range(1, STEPS + 1):
            z = bias + np.bincount(s, w[f], len(held))
            total = np.maximum(np.bincount(d, soft(z), len(y)) + soft(leak), 1e-4)
            slope = ((1 - y) - y / np.expm1(np.minimum(total, 50))) / len(y)
            at = slope[d] / (1 + np.exp(-z))
            g = np.concatenate([np.bincount(f, at[s], len(names)) + DECAY * w, [at.sum() + DECAY * (bias + 4), slope.sum() / (1 + np.exp(-leak)) + DECAY * (leak + 4)]])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            w, bias, leak = np.where(alive, w - change[:-2], 0), bias - change[-2], leak - change[-1]
        alive &= np.abs(w) >= NEGLIGIBLE
        w[~alive] = 0
    return Model({n: float(x) for n, x in zip(names, w, strict=True) if x}, float(bias), float(1 / (1 + np.exp(-leak))))


def scored(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending sentences: how many
    score 0.5 or more, and the place of the worst one (null without evidence)."""
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        m = shared.value
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                found = m.sentences(text)
                worst = max(found, default=(None, None, None))
                out.append((m.score(found), sum(p >= 0.5 for p, _, _ in found), worst[1], worst[2]))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "score", "n_offending", "worst_start", "worst_end"])

    out = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, n_offending long, worst_start long, worst_end long")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_end")


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score under 0.5."""
    shared = spark.sparkContext.broadcast(train(spark, docs, labels))

    def clean(batches):
        m = shared.value
        for batch in slices(batches):
            yield batch.filter(pa.array([m.score(m.sentences(t)) < 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(spark, docs, train(spark, docs, labels))
