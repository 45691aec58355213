"""Near-duplicates and their sketches against exact sets."""

import random

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm import op5_near_dedup as op
from quarry.llm.components import _large, _small, components
from quarry.llm.shingles import ascii_words, word_shingles


def _groups(texts):
    """The smallest id that each id reaches by links of 0.75 and more, and the sizes of the sets."""
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    at = {i: i for i in sets}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                at[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def _corpus(words):
    rng = random.Random(21)
    texts = []
    for _ in range(25):
        base = words(rng, rng.randrange(6, 160)).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            texts.append(" ".join(copy))
    chain = words(rng, 120).split()
    for k in range(12):  # each copy is near the one before it, the ends are far apart
        chain = chain[:]
        chain[10 * k : 10 * k + 2] = words(rng, 2).split()
        texts.append(" ".join(chain))
    shared = words(rng, 60)
    texts += [shared + " " + words(rng, rng.randrange(5, 80)) for _ in range(60)]
    texts += ["", " ", None, "One", "one", "a b", "A  B", "a b c d", "ONE two three four five", "one\ttwo three four five"]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


def test_components_are_exact(spark, words):
    texts = _corpus(words)
    top, size = _groups(texts)
    got = op.near_duplicates(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (size[i], top[i], top[i] == i) for i, _ in texts}


def test_hard_rows(spark, hard, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op.near_duplicates(spark, hard).collect()), key=repr)
    assert got == sorted([(1, 4, 1, True), (1, 4, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 1, None, True), (4, 0, 4, True), (5, 1, 5, True), (6, 4, 1, False), (7, 2, 7, True)], key=repr)
    kept = op.deduplicated(spark, hard)
    assert kept.columns == hard.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted({(r.doc_id, r.text) for r in hard.where("doc_id is null or doc_id <> 6").collect()}, key=repr)
    assert op.near_duplicates(spark, empty).count() == 0 and op.deduplicated(spark, empty).count() == 0


def test_estimates_and_bands(words):
    rng = random.Random(3)
    close = []
    for n in (8, 30, 200, 2000):
        for _ in range(40):
            a = words(rng, n).split()
            b = list(a)
            for _ in range(max(1, n // 40)):
                b[rng.randrange(n)] = words(rng, 1)
            x, y = (word_shingles(ascii_words(" ".join(t))) for t in (a, b))
            both = len(np.intersect1d(x, y))
            exact = both / (len(x) + len(y) - both)
            sx, sy = (op.sketch(h)[None, :] for h in (x, y))
            j, error = op.estimates(sx, sy, np.array([len(x)]), np.array([len(y)]))
            assert abs(j[0] - exact) <= 5 * error[0]
            if exact >= 0.75:
                close.append((op.band_keys(op.densified(sx)) == op.band_keys(op.densified(sy))).any())
    assert all(close) and len(close) > 20
    far = [word_shingles(ascii_words(words(rng, 60))) for _ in range(200)]
    keys = op.band_keys(op.densified(np.stack([op.sketch(h) for h in far])))
    assert len(np.unique(keys)) == keys.size


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}}


def test_the_first_text_of_an_id_stays(spark, words):
    """Whatever the order and the number of partitions, and rows without copies too."""
    rng = random.Random(5)
    rows = [(i % 7, words(rng, 30), i) for i in range(60)] + [(8, None, 60), (8, "z z z z z z", 61), (8, "", 62), (None, "b", 63), (None, "a", 64)]
    for n in (1, 5):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, `__first` int").repartition(n)
        out = op.deduplicated(spark, docs)
        assert out.columns == docs.columns
        got = sorted((r.doc_id, r.text or "") for r in out.collect() if r.doc_id is not None)
        assert got == sorted((k, min(t or "" for d, t, _ in rows if d == k)) for k in {d for d, _, _ in rows} - {None})
        assert sorted(r.text for r in out.collect() if r.doc_id is None) == ["a", "b"]


def test_hot_keys_are_split(spark, words):
    """The joins on bands and nodes have a shuffle of their own on both sides, and a hub's rows go to many tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "12",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.range(0, 60_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 900).cast("long").alias("u"), (F.col("id") + 1000).alias("v"))
        for plan in (_large(edges), _small(edges.select(F.col("v").alias("x"), "u").select(F.col("u"), F.col("x").alias("v")))):
            plan.collect()
            assert "SortMergeJoin(skew=true)" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_written_tables_are_removed(spark, words, tmp_path, monkeypatch):
    """After a run the shared folder holds what the returned table reads, and no more."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    docs = spark.createDataFrame(_corpus(words)[:120], "doc_id long, text string")
    op.near_duplicates(spark, docs).collect()
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["classes", "sketches"]
