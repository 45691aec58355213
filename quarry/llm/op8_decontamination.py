"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item's windows are its runs of ``WINDOW`` words; an item with fewer
words is one window. The shingles (``SHINGLE`` words) of the windows are ordered
by their rarity over all documents. Containment must be whole, so one prefix
token is enough for each window: its rarest shingle. A document that has it at
some place is a candidate there; the token's offset gives the one place where
the window could start, which length and position bounds test before all words
of the window are compared.

Up to ``INDEX_BYTES`` of item text the index goes to the map tasks and nothing of a
document is shuffled. For a larger benchmark the same join is made by shuffle
(``window_join``). Either way there are two passes over the documents: one counts
shingles, one finds windows.

Defined cases: a null or empty text has no words; repeated rows are judged each;
items of one id are one item; an item without an id can mark words but is not
listed; an empty benchmark marks nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import window_join
from .common import remove, slices, written

WINDOW, SHINGLE = 10, 3
INDEX_BYTES = 8 << 20
#: Up to so many texts with hits (32 MB) their keys are broadcast.
BROADCAST_KEYS = 1_000_000
#: Words of documents that one step of a map task looks at together.
STEP_WORDS = 1 << 20

# Bytes of words: digits, letters (A-Z lower-cased) and all of 0x80 and above; the rest separates.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Windows:
    """The distinct windows of some items over their own vocabulary."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                held[tuple(ids[i : i + WINDOW])].add(item)
        self.items = [sorted(x for x in s if x is not None) for s in held.values()]
        self.size = np.array([len(w) for w in held], np.int64)
        self.word = np.zeros((len(held), WINDOW), np.int64)
        for k, w in enumerate(held):
            self.word[k, : len(w)] = w
        self.base = len(self.vocabulary) + 1
        # Shingles of a window: (shingle's length, key) -> places; a window of fewer words is one shingle.
        self.keys: dict[int, np.ndarray] = {}
        for s in range(1, SHINGLE + 1):
            of = self.size >= s if s == SHINGLE else self.size == s
            found = [self._key(self.word[of, i : i + s])[self.size[of] >= i + s] for i in range(WINDOW - s + 1)]
            self.keys[s] = np.unique(np.concatenate(found)) if of.any() else np.zeros(0, np.uint64)

    def _key(self, ids: np.ndarray) -> np.ndarray:
        k = np.zeros(len(ids), np.uint64)
        for j in range(ids.shape[1]):
            k = k * np.uint64(self.base) + ids[:, j].astype(np.uint64)
        return k

    def order(self, counts: dict[int, np.ndarray]) -> Windows:
        """Takes each window's rarest shingle as its prefix token."""
        self.prefix: dict[int, tuple] = {}
        for s, keys in self.keys.items():
            of = np.flatnonzero(self.size >= s if s == SHINGLE else self.size == s)
            if not len(of):
                continue
            rare, at, key = np.full(len(of), np.inf), np.zeros(len(of), np.int64), np.zeros(len(of), np.uint64)
            for i in range(WINDOW - s + 1):
                k = self._key(self.word[of, i : i + s])
                n = np.where(self.size[of] >= i + s, counts[s][np.minimum(np.searchsorted(keys, k), len(keys) - 1)].astype(float), np.inf)
                better = n < rare
                rare[better], at[better], key[better] = n[better], i, k[better]
            by = np.argsort(key, kind="stable")
            tokens, first, n = np.unique(key[by], return_index=True, return_counts=True)
            self.prefix[s] = (tokens, first, n, of[by], at[by])
        return self

    def ids(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids (0: none) of the words of several texts, a 0 after each text, and where each text begins."""
        n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        flat = np.fromiter(chain.from_iterable(chain(map(self.vocabulary.get, t, repeat(0)), (0,)) for t in texts), np.int64, int(n.sum()))
        return flat, np.cumsum(n) - n

    def shingles(self, ids: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the runs of ``s`` known words, and their keys."""
        known = ids > 0
        run = known[: len(ids) - s + 1].copy()
        for i in range(1, s):
            run &= known[i : len(ids) - s + 1 + i]
        at = np.flatnonzero(run)
        return at, self._key(ids[at[:, None] + np.arange(s)])

    def counted(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """How often each shingle of the windows occurs."""
        out = {}
        for s, keys in self.keys.items():
            out[s] = np.zeros(len(keys), np.int64)
            if len(keys) and len(ids) >= s:
                _, k = self.shingles(ids, s)
                i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                out[s] += np.bincount(i[keys[i] == k], minlength=len(keys))
        return out

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the windows that occur."""
        starts, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, (tokens, first, n, window, offset) in self.prefix.items():
            if len(ids) < s:
                continue
            at, k = self.shingles(ids, s)
            i = np.minimum(np.searchsorted(tokens, k), len(tokens) - 1)
            hit = tokens[i] == k
            at, i = at[hit], i[hit]
            row = np.repeat(first[i] - (np.cumsum(n[i]) - n[i]), n[i]) + np.arange(n[i].sum())
            start, w = np.repeat(at, n[i]) - offset[row], window[row]
            fits = (start >= 0) & (start + self.size[w] <= len(ids))
            start, w = start[fits], w[fits]
            for j in range(WINDOW):
                same = (j >= self.size[w]) | (ids[np.minimum(start + j, len(ids) - 1)] == self.word[w, j])
                start, w = start[same], w[same]
            starts.append(start)
            which.append(w)
        return np.concatenate(starts), np.concatenate(which)


def _steps(texts: list[str | None]):
    """Lists of word lists, of about ``STEP_WORDS`` words or one text each."""
    held, n = [], 0
    for text in texts:
        held.append(words(text))
        n += len(held[-1])
        if n >= STEP_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _ordered(spark: SparkSession, docs: DataFrame, windows: Windows) -> Windows:
    """Counts the windows' shingles over all documents; the sums are as many as the index's shingles."""
    shared = spark.sparkContext.broadcast(windows)

    def count(batches):
        total = {s: np.zeros(len(k), np.int64) for s, k in shared.value.keys.items()}
        for batch in slices(batches, 2048):
            for step in _steps(batch.column("text").to_pylist()):
                for s, n in shared.value.counted(shared.value.ids(step)[0]).items():
                    total[s] += n
        for s, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(at), pa.array(n[at])], ["s", "k", "n"])

    counts = {s: np.zeros(len(k), np.int64) for s, k in windows.keys.items()}
    for s, k, n in docs.select("text").mapInArrow(count, "s int, k long, n long").groupBy("s", "k").agg(F.sum("n")).collect():
        counts[s][k] = n
    shared.destroy()
    return windows.order(counts)


def _items(benchmark: DataFrame) -> list[tuple[str | None, str | None]] | None:
    """The items of a benchmark small enough for an index, else None."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.length("text") > 0)
    size = rows.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    return [tuple(r) for r in rows.collect()] if size <= INDEX_BYTES else None


def _spans(flat: np.ndarray, begin: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[list[int]]:
    """For each text the union of its windows, as pairs of word places, end exclusive."""
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0])  # a 0 stands between texts
    low, high = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
    doc = np.searchsorted(begin, low, "right") - 1
    out: list[list[int]] = [[] for _ in begin]
    for d, a, b in zip(doc.tolist(), (low - begin[doc]).tolist(), (high - begin[doc]).tolist(), strict=True):
        out[d] += (a, b)
    return out


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (pairs of word places, end exclusive) and items (sorted) for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = _items(benchmark)
    if items is None:
        rows, by_text = window_join.hits(spark, docs, benchmark, words, WINDOW, SHINGLE)
        none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
        return rows.join(by_text, "key", "left").select("doc_id", "n_words", none("spans", "bigint"), none("items", "string"))
    shared = spark.sparkContext.broadcast(_ordered(spark, docs, Windows(items)))
    names = ["doc_id", "n_words", "spans", "items"]

    def mark(batches):
        w = shared.value
        for batch in slices(batches, 2048):
            n, spans, found = [], [], []
            for step in _steps(batch.column("text").to_pylist()):
                ids, begin = w.ids(step)
                start, which = w.found(ids)
                n += map(len, step)
                spans += _spans(ids, begin, start, w.size[which])
                held: list[set] = [set() for _ in step]
                pairs = np.unique(np.stack([np.searchsorted(begin, start, "right") - 1, which]), axis=1)
                for d, v in pairs.T.tolist():
                    held[d].update(w.items[v])
                found += map(sorted, held)
            lists = pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names)

    return docs.select("doc_id", "text").mapInArrow(mark, f"doc_id {kind}, n_words long, spans array<bigint>, items array<string>")


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    sign = lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)
    n_hit = F.aggregate(F.transform("spans", sign), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = hits(spark, docs, benchmark).select("doc_id", "n_words", n_hit.alias("n_hit"), "items")
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        digest.alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window occurs."""
    items = _items(benchmark)
    if items is None:
        rows, by_text = window_join.hits(spark, docs, benchmark, words, WINDOW, SHINGLE)
        gone = written(spark, by_text.select(F.col("key").alias("key of a text")), "contaminated-keys")
        remove(spark, rows, by_text)
        some = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
        return docs.withColumn("key of a text", window_join.text_key()).join(some, "key of a text", "left_anti").select(docs.columns)
    shared = spark.sparkContext.broadcast(_ordered(spark, docs, Windows(items)))

    def clean(batches):
        w = shared.value
        for batch in slices(batches, 2048):
            keep, k = np.ones(batch.num_rows, bool), 0
            for step in _steps(batch.column("text").to_pylist()):
                ids, begin = w.ids(step)
                keep[k + np.searchsorted(begin, w.found(ids)[0], "right") - 1] = False
                k += len(step)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same for DuckDB by a join of all windows, where ids of documents are unique.
CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS k FROM i WHERE len(w) > 0)),
p AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
m AS (SELECT p.doc_id, p.k, p.n, v.item_id FROM p JOIN v USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS q FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)
"""
