"""Document fingerprints by threshold-scaled sketches.

A fingerprint keeps every shingle hash below a fixed fraction, ``1 / SCALE``, of the
hash range, whatever the text's length: sketches merge by union and estimate containment
between texts of very unequal lengths. Shingles are ``SHINGLE_CHARS`` code points of the
lower-cased text with white space runs made one space; a shorter text is one shingle.
Of a hash the upper 32 bits are kept.

A text with at most ``WHOLE`` shingles keeps all its hashes, which are exact against
another such text. Against a longer text only those below the fraction can be looked up:
none of them may be there, by a chance of 0.875 ** shingles (2e-8 for a passage of 150
characters, 1.4 % for one of 47). Then there is no evidence: the containment is None, and
the likeness falls back on what the other side says, or 0.

``with_next`` pairs every row with the next one in descending ``doc_id`` by one shuffle
of the texts: rows go to ranges of ids, one range to a task, and the first row of each
range goes to the range before it as well. Ranges are cut at quantiles of a sample of at
most ``CUT_SAMPLE`` ids, which decides on their sizes alone.

Defined cases: a null text is an empty one, whose fingerprint is ``"8+:"`` and whose
likeness is 1 to another empty text and 0 to others. Rows of one ``doc_id`` are ordered
by text, and texts that begin alike stay in one range; null ids come last. A table of one
row is its own next. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, ranges, slices, text_or_empty
from .shingles import mixed

SHINGLE_CHARS, SCALE, WHOLE = 16, 8, 64
CUT_SAMPLE, TIE_CHARS = 200_000, 32
#: Code points that are hashed together.
STEP_CHARS = 1 << 19
#: Up to so many ranges (50 MB) their table is broadcast; more are joined by shuffle.
BROADCAST_RANGES = 500_000

_SPACE = re.compile(r"\s+")
_BASE = 0x9E3779B97F4A7C15
_TOP = np.uint32((1 << 32) // SCALE)


@dataclass(frozen=True, eq=False)
class Sketch:
    """The kept hashes of a text, sorted; ``whole`` where none is left out."""

    whole: bool
    hashes: np.ndarray

    @property
    def scaled(self) -> np.ndarray:
        """The hashes below the fraction, which any two sketches have in common."""
        return self.hashes[: np.searchsorted(self.hashes, _TOP)] if self.whole else self.hashes


def _hashes(c: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE_CHARS code points, by doubling the runs' length; of a shorter text, its own."""
    h, size, power = c.astype(np.uint64) + np.uint64(1), 1, _BASE
    if len(h) < SHINGLE_CHARS:
        for x in h[1:].tolist():
            h[:1] = h[:1] * np.uint64(_BASE) + np.uint64(x)
        return (mixed(h[:1]) >> np.uint64(32)).astype(np.uint32)
    while size < SHINGLE_CHARS:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power & (1 << 64) - 1
    return (mixed(h) >> np.uint64(32)).astype(np.uint32)


def sketch(text: str) -> Sketch:
    text = _SPACE.sub(" ", text.lower()).strip()
    whole, kept = len(text) < SHINGLE_CHARS + WHOLE, []
    for at in range(0, max(len(text) - SHINGLE_CHARS + 1, len(text) > 0), STEP_CHARS):
        part = text[at : at + STEP_CHARS + SHINGLE_CHARS - 1]
        h = _hashes(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32))
        kept.append(h if whole else h[h < _TOP])
    return Sketch(whole, np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint32))


def encoded(s: Sketch) -> str:
    """A fingerprint as text: the scale, a plus where it is whole, and the hashes in base 64."""
    return f"{SCALE}{'+' if s.whole else ''}:{base64.b64encode(s.hashes.astype('>u4').tobytes()).decode()}"


def decoded(fingerprint: str) -> Sketch:
    head, _, kept = fingerprint.partition(":")
    if int(head.rstrip("+")) != SCALE:
        raise ValueError(f"a fingerprint of another scale: {head}")
    return Sketch(head.endswith("+"), np.frombuffer(base64.b64decode(kept), ">u4").astype(np.uint32))


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of two texts taken together."""
    both = np.union1d(a.hashes, b.hashes)
    whole = a.whole and b.whole and len(both) <= WHOLE
    return Sketch(whole, both if whole else np.union1d(a.scaled, b.scaled))


def containment(a: Sketch, b: Sketch) -> float | None:
    """Estimated share of the shingles of ``a`` that ``b`` has; None where no hash of ``a`` can be looked up."""
    x, y = (a.hashes, b.hashes) if a.whole and b.whole else (a.scaled, b.scaled)
    if len(x):
        return len(np.intersect1d(x, y, assume_unique=True)) / len(x)
    return float(not len(b.hashes)) if a.whole and not len(a.hashes) else None


def likeness(a: Sketch, b: Sketch) -> float:
    """The larger of the two containments: 1 where one text lies in the other."""
    return max(containment(a, b) or 0.0, containment(b, a) or 0.0)


def _cuts(spark: SparkSession, keys: DataFrame, n: int) -> list[tuple]:
    """At most n - 1 keys (doc_id, tie) at which ranges begin, in descending order of ids."""
    if n < 2:
        return []
    known = keys.where(F.col("doc_id").isNotNull())
    total, wanted = known.count(), min(50 * n, CUT_SAMPLE)
    sample = known if total <= wanted else known.sample(wanted / total, seed=1)
    held = sorted((tuple(r) for r in sample.limit(2 * CUT_SAMPLE).collect()), key=lambda r: r[1])
    held.sort(key=lambda r: r[0], reverse=True)  # stable: of equal ids the smallest tie comes first
    return list(dict.fromkeys(held[k * len(held) // n] for k in range(1, n) if held))


def _range_of(cuts: list[tuple]):
    """An expression of (doc_id, tie) for the number of cuts that a row does not lie before."""
    up = np.array(sorted(c[0] for c in cuts))
    ties = defaultdict(list)
    for c in cuts:
        ties[c[0]].append(c[1])

    @F.arrow_udf("int")
    def place(ids: pa.Array, tie: pa.Array) -> pa.Array:
        out = np.full(len(ids), len(cuts), np.int32)
        some = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.drop_null()
        mine = values.to_numpy(zero_copy_only=False) if up.dtype != object else np.array(values.to_pylist(), object)
        found = (len(up) - np.searchsorted(up, mine, "right")).astype(np.int32)
        for k in np.flatnonzero(np.isin(mine, up)).tolist():  # few: ids at which a range is cut
            found[k] += bisect_right(ties[values[k].as_py()], tie.filter(ids.is_valid())[k].as_py())
        out[some] = found
        return pa.array(out)

    return place("doc_id", "tie") if cuts else F.lit(0)


def with_next(spark: SparkSession, docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, ahead, doc_id, text), where ``ahead`` marks a copy of the row that
    follows the last row of its bucket in descending ``doc_id``.

    A row's bucket falls as its id rises, so bucket 0 comes first. The driver holds a key
    for each range."""
    bounded_batches(spark)
    text = text_or_empty()
    tie = F.left(text, F.lit(TIE_CHARS)).alias("tie")
    cuts = _cuts(spark, docs.select("doc_id", tie), buckets or ranges(spark, docs))
    place = _range_of(cuts).alias("bucket")
    keys = docs.select("doc_id", tie).select("doc_id", "tie", place)
    tops = {r.bucket: r.top for r in keys.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    kind = f"bucket int, top {docs.schema['doc_id'].dataType.simpleString()}"
    known = spark.createDataFrame(list(tops.items()), kind)
    small = len(tops) <= BROADCAST_RANGES
    beside = lambda rows: F.broadcast(rows) if small else rows
    firsts = keys.join(beside(known), "bucket").where(F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = {r.bucket: r.tie for r in firsts.groupBy("bucket").agg(F.min("tie").alias("tie")).collect()}
    order = sorted(tops)
    before = dict(zip(order, order[-1:] + order[:-1], strict=True))
    known = spark.createDataFrame([(b, tops[b], firsts[b], before[b]) for b in order], f"{kind}, top_tie string, before int")

    rows = docs.select("doc_id", text.alias("text"), tie).select("doc_id", "text", "tie", place)
    rows = rows.join(beside(known), "bucket")
    first = F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("tie") == F.col("top_tie"))
    own = F.array(F.struct(F.col("bucket"), F.lit(False).alias("ahead")))
    both = F.when(first, F.concat(own, F.array(F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ahead"))))).otherwise(own)
    rows = rows.withColumn("to", F.explode(both)).select("to.bucket", "to.ahead", "doc_id", "text")
    return rows.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "ahead", F.desc_nulls_last("doc_id"), "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of ``following``'s start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for every row of ``docs``: its fingerprint, that of its edited
    text, and the likeness to that text and to the next row's."""
    rows = with_next(spark, docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def sketched(batches):
        held = None  # (doc_id, text, sketch) that waits for its next row
        for batch in slices(batches):
            out = []
            for ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("ahead", "doc_id", "text")), strict=True):
                if ahead and held is None:
                    continue
                s = sketch(text)
                if held is not None:
                    at, own, mine = held
                    changed = edited(own, text)
                    other = sketch(changed)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((at, len(own), digest, encoded(mine), encoded(other), likeness(mine, other), likeness(mine, s)))
                held = None if ahead else (doc_id, text, s)
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    kinds = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(sketched, f"doc_id {id_type}, {kinds}")
