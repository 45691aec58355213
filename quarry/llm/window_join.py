"""The prefix-filtered set join by shuffle, for benchmarks too large for a broadcast index.

Its steps are those of ``op8_decontamination`` as tables, in two passes over the documents
however large the benchmark is:

1. The items' windows and their shingles are written as tables.
2. First pass: documents are counted for the shingles, which orders them by rarity; each
   window's rarest one is its prefix token.
3. Second pass: where a token stands in a document, its place goes out with the words
   around it, which are all that a window with that token can cover. They are joined with
   the tokens; length and position bounds and the comparison of all words follow in the join.

Both passes ask a bitmap of at most ``BITS`` bits first (32 MB), so that hardly more than
the shingles of the benchmark is shuffled; what it lets through in vain finds no partner.
Hits belong to texts, by a 128-bit hash, so that copies share them.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, reshuffled, slices, text_or_empty, written
from .shingles import PLACES, WordHashes, mixed

BITS = 1 << 28
_hashes = WordHashes()


def text_key():
    """The key of a text, null counting as empty."""
    return F.unhex(F.md5(text_or_empty().cast("binary")))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` words, by their places."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h += w[i : i + n] * PLACES[i]
    return mixed(h).view(np.int64)


def _windows(benchmark: DataFrame, split, window: int, shingle: int) -> DataFrame:
    """(item, window, size, shingles) of all windows of all items; a window is its words with spaces between."""
    names = ["item", "window", "size", "shingles"]

    def rows(batches):
        for batch in slices(batches):
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = split(text)
                for k in range(max(1, len(words) - window + 1) if words else 0):
                    w = words[k : k + window]
                    out.append((item, b" ".join(w).decode(), len(w), shingle_hashes(w, min(shingle, len(w))).tolist()))
            kinds = pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return items.mapInArrow(rows, "item string, window string, size int, shingles array<bigint>")


def _bitmap(spark: SparkSession, keys: DataFrame):
    """A broadcast bitmap of the hashes in ``shingle``: 16 bits for each, up to ``BITS`` bits."""
    bits = min(BITS, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    at = F.col("shingle").bitwiseAND(F.lit(bits - 1))
    mark = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(mark).alias("word"))
    held = words.toArrow()  # BITS / 64 rows at most
    out = np.zeros(bits >> 6, np.int64)
    out[held["i"].to_numpy()] = held["word"].to_numpy()
    return spark.sparkContext.broadcast(out)


def _marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & (len(bitmap) * 64 - 1)
    return (bitmap[at >> 6] >> (at & 63)) & 1 > 0


def _counted(docs: DataFrame, bitmap, sizes: list[int], split) -> DataFrame:
    """(shingle, n): how often the marked shingles occur in the documents."""

    def rows(batches):
        for batch in slices(batches):
            held = []
            for text in batch.column("text").to_pylist():
                words = split(text)
                for s in sizes:
                    h = shingle_hashes(words, s)
                    held.append(h[_marked(bitmap.value, h)])
            found, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["shingle", "n"])

    return docs.select("text").mapInArrow(rows, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _tokens(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(shingle, at, window, size): the rarest shingle of each window and its place there."""
    shingles = windows.select("window", "size", F.posexplode("shingles").alias("at", "shingle"))
    counted = shingles.join(reshuffled(counts, "shingle"), "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.min(F.struct("n", "at", "shingle")).alias("first")
    return counted.groupBy("window", "size").agg(first).select("first.shingle", "first.at", "window", "size")


def _places(docs: DataFrame, bitmap, sizes: list[int], split, window: int) -> DataFrame:
    """For each document a row (doc_id, key, n_words), and for each marked shingle in it one with its hash, its
    place, and the words from ``first`` on that windows with it can cover."""
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "key", "n_words", "shingle", "place", "first", "around"]

    def rows(batches):
        for batch in slices(batches):
            id_type = batch.schema.field("doc_id").type
            out = defaultdict(list)
            ids, keys, texts = (batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))
            for doc_id, key, text in zip(ids, keys, texts, strict=True):
                words = split(text)
                found = [(doc_id, key, len(words), None, None, None, None)]
                for s in sizes:
                    h = shingle_hashes(words, s)
                    for i in np.flatnonzero(_marked(bitmap.value, h)).tolist():
                        low = max(0, i - window + s)
                        around = [w.decode() for w in words[low : i + window]]
                        found.append((None, key, len(words), int(h[i]), i, low, around))
                for row in found:
                    for name, value in zip(names, row, strict=True):
                        out[name].append(value)
            kinds = id_type, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)], names)

    marked = "key binary, n_words long, shingle long, place long, first long, around array<string>"
    return docs.select("doc_id", "text", text_key().alias("key")).mapInArrow(rows, f"doc_id {kind.simpleString()}, {marked}")


def _merged(spans: DataFrame) -> DataFrame:
    """(key, spans): the union of a text's spans, as pairs of word places, end exclusive."""

    def rows(batches):
        for batch in slices(batches):
            out = []
            for found in batch.column("spans").to_pylist():
                held: list[int] = []
                for s in sorted((x["start"], x["end"]) for x in found):
                    if held and s[0] <= held[-1]:
                        held[-1] = max(held[-1], s[1])
                    else:
                        held += s
                out.append(held)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.int64()))], ["key", "spans"])

    grouped = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return grouped.mapInArrow(rows, "key binary, spans array<bigint>")


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, split, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (doc_id, key, n_words) of every row of ``docs``, and (key, spans, items) of the texts in
    which windows occur. ``split`` gives the words of a text."""
    found = written(spark, _windows(benchmark, split, window, shingle), "windows")
    one = F.first("shingles").alias("shingles")
    windows = written(spark, found.groupBy("window", "size").agg(one), "distinct-windows")
    sizes = sorted({min(r.size, shingle) for r in windows.select("size").distinct().collect()})

    keys = written(spark, windows.select(F.explode("shingles").alias("shingle")).distinct(), "shingles")
    bitmap = _bitmap(spark, keys)
    counts = written(spark, _counted(docs, bitmap, sizes, split), "counts")
    bitmap.destroy()
    tokens = written(spark, _tokens(windows, counts), "tokens")
    remove(spark, keys, counts, windows)

    bitmap = _bitmap(spark, tokens.select("shingle").distinct())
    places = written(spark, _places(docs, bitmap, sizes, split, window), "places")
    bitmap.destroy()
    start = F.col("place") - F.col("at")
    marked = places.where(F.col("shingle").isNotNull()).join(tokens, "shingle").withColumn("start", start)
    fits = (F.col("start") >= F.col("first")) & (F.col("start") + F.col("size") <= F.col("n_words"))
    here = F.slice("around", (F.col("start") - F.col("first") + 1).cast("int"), F.col("size"))
    marked = marked.where(fits).where(F.array_join(here, " ") == F.col("window"))
    held = written(spark, marked.select("key", "start", (F.col("start") + F.col("size")).alias("end"), "window").distinct(), "hits")

    items = held.select("key", "window").distinct().join(found.where(F.col("item").isNotNull()).select("window", "item").distinct(), "window")
    items = items.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    by_text = written(spark, _merged(held).join(items, "key", "left"), "contaminated")
    rows = written(spark, places.where(F.col("shingle").isNull()).select("doc_id", "key", "n_words"), "texts")
    remove(spark, found, tokens, places, held)
    return rows, by_text
