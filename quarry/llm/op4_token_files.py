"""Token ids as ORC files.

Rows go to ranges of ``doc_id`` by one shuffle of the texts, are encoded there
and written in ascending order: integer run-length encoded ids in stripes of
``STRIPE_BYTES``, with a row index every ``INDEX_ROWS`` rows and a Bloom filter
on ``doc_id``. There are as many ranges as shuffles have partitions, and more for a
large table, one for each 64 MB on disk. Stripes are read in parallel; a search by ``doc_id`` reads the
footers, and then only row groups whose statistics and filter admit the id.

A row holds ``part`` and ``at``, the ids before it in its range, so that its
place among all ids needs only the sum of each range.

Defined cases: a null text is empty and has the end id alone; rows of one
``doc_id`` are kept, ordered by text; null ids come last; an empty table writes
no rows. Other columns are ignored.
"""

from __future__ import annotations

import contextlib
import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, ranges, slices, text_or_empty
from .pretokens import ids_for

STRIPE_BYTES, INDEX_ROWS, FILTER_FPP = 16 << 20, 1_000, 0.01
#: Texts of so many characters are encoded together.
STEP_CHARS = 1 << 19


@contextlib.contextmanager
def _no_collections():
    """No search for cycles among the cache's many entries, which are none, while a task encodes."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def write_token_ids(spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, partitions: int | None = None) -> None:
    """Writes (doc_id, part, at, n_tokens, ids) for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    by = F.asc_nulls_last("doc_id")
    rows = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange(partitions or ranges(spark, docs), by)
    rows = rows.sortWithinPartitions(by, "text").withColumn("part", F.spark_partition_id())

    def encode(batches):
        cache, at = ids_for(tokenizer_path), 0
        with _no_collections():
            yield from parts(batches, cache, at)

    def parts(batches, cache, at):
        for batch in slices(batches, 512, 8 << 20, keep=tokenizer_path):
            texts, k = batch.column("text").to_pylist(), 0
            while k < len(texts):
                stop, chars = k, 0
                while stop < len(texts) and (stop == k or chars + len(texts[stop]) <= STEP_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                ids, n = cache.batch(texts[k:stop], end_id)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, stop - k), batch.column("part").slice(k, stop - k), pa.array(at + ends - n), pa.array(n), lists], ["doc_id", "part", "at", "n_tokens", "ids"])
                at += int(ends[-1])
                k = stop

    out = rows.mapInArrow(encode, f"doc_id {kind}, part int, at long, n_tokens long, ids array<int>")
    out.write.options(**{
        "compression": "snappy", "orc.stripe.size": STRIPE_BYTES, "orc.create.index": "true", "orc.row.index.stride": INDEX_ROWS,
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FILTER_FPP, "orc.encoding.strategy": "SPEED",
    }).orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each row with the number of ids of all rows before it."""
    rows = spark.read.orc(path)
    sums, before, base = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect(), 0, []
    for part, n in sums:  # one for each range
        base.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    return rows.join(starts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches):
        for batch in slices(batches, keep="*"):
            ids = batch.column("ids")
            flat, offsets = memoryview(ids.values.to_numpy().view("<u4")), ids.offsets.to_pylist()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the files into the shared folder and returns what they hold, as digests."""
    path = new_path(spark, "token-ids")
    write_token_ids(spark, docs, tokenizer_path, path, end_id)
    return digests(read_token_ids(spark, path))
