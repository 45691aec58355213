"""Token counts by a map-side two-tier lookup.

Tier 1 is a broadcast table of the lengths of frequent pre-tokens, of at most
``TABLE_ENTRIES`` entries of ``LONGEST`` characters; tier 2 is each worker's own cache,
filled by the library. The table is counted over whole texts drawn evenly from all rows,
about ``SAMPLE_TEXTS`` of them, on the executors; each task hands on its most frequent
ones. No pre-token of the counted texts is ever shuffled: they take one scan and one map.

Defined cases: a null or empty text has no bytes and no tokens; repeated rows
are counted each; a null ``doc_id`` is passed on; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices
from .pretokens import BYTE_LEVEL, LONGEST, fast, lengths_for, tokenizer

#: The table is a cache: what it holds changes the speed and never a count.
SAMPLE_TEXTS, TABLE_ENTRIES = 2_000, 50_000
MAX_TOKENS = 512


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """Pre-token -> number of ids, for the most frequent ones of an even draw from all rows."""
    share = min(1.0, SAMPLE_TEXTS / max(docs.count(), 1))
    drawn = docs.select("text").sample(share, seed=1)

    def count(batches):
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                if text and fast(text):
                    seen.update(p for p in BYTE_LEVEL.findall(text) if len(p) <= LONGEST)
            if len(seen) > 2 * TABLE_ENTRIES:
                seen = Counter(dict(seen.most_common(TABLE_ENTRIES)))
        rows = seen.most_common(TABLE_ENTRIES)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["piece", "n"])

    counted = drawn.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = [r.piece for r in counted.orderBy(F.desc("n"), "piece").limit(TABLE_ENTRIES).collect()]
    return {p: len(e.ids) for p, e in zip(pieces, tokenizer(path).encode_batch(pieces, add_special_tokens=False), strict=True)}


def token_counts(spark: SparkSession, docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    key = uuid.uuid4().hex
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path))

    def count(batches):
        lengths = lengths_for(path, key, table.value)
        for batch in slices(batches, keep=path):
            n = [lengths.count(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > max_tokens)
