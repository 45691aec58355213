"""Near-duplicates by HyperMinHash.

A document's set holds its distinct 5-word shingles; two are linked when
100 * |A n B| >= 75 * |A u B|. Documents of equal sets are one class from the
start, and only the class's smallest id goes on.

1. The sketch of a class has 2**8 buckets by the top bits of the shingle hashes;
   a register compresses the smallest hash of its bucket into its leading-zero
   count and 10 mantissa bits.
2. Bands of 5 registers are the keys of candidate search. An empty register takes the
   value of the first full one in an order fixed for its place (optimal densification,
   Shrivastava 2017), so that short texts agree as seldom as their similarity says.
   At a similarity of 0.75 the chance that none of 51 bands agrees is 1e-6.
3. Candidates: each member of a band's bucket with the bucket's smallest member.
   The collision-corrected estimate of the sketches drops pairs that lie five
   standard errors below 0.75, and the full sets of the others are compared.
4. Confirmed links give components. A bucket whose members lie in one component is
   done. Of the members of the others, shingles that at most ``RARE`` of them have are
   rare. Two members that share a rare one are compared outright, a bounded number for
   each shingle; any others can share the rest of their shingles alone, which rules out
   most pairs that only resemble each other. Rounds then compare each member with one of
   another component, first with the member that has the fewest rare shingles and then
   with a drawn one, which joins what belongs to large groups. At last every member
   outside the drawn member's component is compared with all members of other
   components, so that no candidate link between components is left out, yet pairs
   inside a group of copies are never made.

Buckets are counted before they are joined. What is counted or chosen for a band, node
or class is shuffled anew for its join (``reshuffled``), so that both sides are plain
shuffles and adaptive execution splits hot keys: no task gathers a group.

Defined cases: a text without words (null, empty or white space) is its own
component and kept. A row without an id takes no part: its component is null and
it is kept. Rows of one id are one document that is linked by each of its texts.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, reshuffled, slices, written
from .components import components
from .shingles import ascii_words, mixed, word_shingles

BUCKET_BITS, MANTISSA_BITS, BAND_REGISTERS = 8, 10, 5
PERCENT, ERRORS = 75, 5.0
ROUNDS, RARE = 2, 24
#: Up to so many ids (16 MB) a list of ids is broadcast; a longer one is joined by shuffle.
BROADCAST_IDS = 1_000_000

_EDGES = (np.arange(1 << BUCKET_BITS, dtype=np.uint64)) << np.uint64(64 - BUCKET_BITS)
_REST = 64 - BUCKET_BITS
EMPTY = np.uint16(0xFFFF)


def sketch(h: np.ndarray) -> np.ndarray:
    """Registers of a set of sorted hashes: leading zeros and mantissa, or EMPTY."""
    first = np.searchsorted(h, _EDGES)
    stop = np.append(first[1:], len(h))
    full = first < stop
    v = h[first[full]] & np.uint64((1 << _REST) - 1)
    bits = np.frexp(v.astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(_REST) - np.minimum(bits, np.uint64(_REST))
    mantissa = ((v << zeros) >> np.uint64(_REST - 1 - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)
    out = np.full(1 << BUCKET_BITS, EMPTY, np.uint16)
    out[full] = ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    return out


# For each register, the order in which it looks for a full one.
_LOOK = np.stack([np.random.default_rng(1000 + i).permutation(1 << BUCKET_BITS) for i in range(1 << BUCKET_BITS)])


def densified(sketches: np.ndarray) -> np.ndarray:
    """The sketches with each empty register filled from the first full one in its order."""
    out = sketches.copy()
    for row in out:
        full = row != EMPTY
        empty = np.flatnonzero(~full)
        if len(empty) and full.any():
            look = _LOOK[empty]
            row[empty] = row[look[np.arange(len(empty)), full[look].argmax(axis=1)]]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """Keys of the bands, for the rows of a matrix of densified sketches."""
    n, bands = len(sketches), (1 << BUCKET_BITS) // BAND_REGISTERS
    parts = sketches[:, : bands * BAND_REGISTERS].reshape(n, bands, BAND_REGISTERS)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(BAND_REGISTERS):
        key = mixed(key ^ (parts[:, :, i].astype(np.uint64) + np.uint64(i << 16)))
    return key.view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of the rows of two matrices of sketches, and its standard error at 0.75.

    The expected chance collisions of two sets of like size are 0.1699 * 2**(p - r)
    for p bucket and r mantissa bits, and fewer for unlike sizes (Yu and Weber, 2017)."""
    used = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(axis=1), 1)
    equal = ((a == b) & (a != EMPTY)).sum(axis=1)
    ratio = na / nb
    chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2 * used / (1 << BUCKET_BITS)
    return np.maximum(equal - chance, 0) / used, np.sqrt(0.75 * 0.25 / used)


def _matrix(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint16).reshape(-1, 1 << BUCKET_BITS)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (a 128-bit hash of the whole set) and sketch; the last two null without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        for batch in slices(batches):
            n, cls, sk = [], [], []
            for text in batch.column("text").to_pylist():
                h = word_shingles(ascii_words(text))
                n.append(len(h))
                cls.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sk.append(sketch(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sk, pa.binary())], ["doc_id", "n_shingles", "class", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_shingles long, class binary, sketch binary")


def _bands(nodes: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in slices(batches, 2048):
            key = band_keys(densified(_matrix(batch.column("sketch"))))
            node = np.repeat(batch.column("node").to_numpy(), key.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(node)], ["band", "node"])

    return nodes.select("node", "sketch").mapInArrow(rows, "band long, node long")


#: A pair of nodes and the components that they lie in so far.
PAIR = ["a", "b", "ca", "cb"]
_PAIR = "a long, b long, ca long, cb long"


def _pair(a: str, b: str, ca: str, cb: str) -> list:
    """The columns of PAIR, the smaller node first."""
    first = F.col(a) < F.col(b)
    ends = (a, b), (b, a), (ca, cb), (cb, ca)
    return [F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for name, (x, y) in zip(PAIR, ends, strict=True)]


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that the sketches don't rule out."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    fits = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")

    def rows(batches):
        for batch in slices(batches, 2048):
            if batch.num_rows:
                j, error = estimates(_matrix(batch.column("sa")), _matrix(batch.column("sb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                batch = batch.filter(pa.array(j >= PERCENT / 100 - ERRORS * error))
            yield batch.select(PAIR)

    found = pairs.join(right, "b").join(left, "a").where(fits).select(*PAIR, "na", "nb", "sa", "sb")
    return found.mapInArrow(rows, _PAIR)


def _texts(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """doc_id and text of the rows whose ids are in ``ids``, a table of ``n`` rows."""
    if n <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")


def _confirmed(docs: DataFrame, likely: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    ids = likely.select(F.col("a").alias("doc_id")).union(likely.select("b"))
    texts = _texts(docs, ids, 2 * likely.count())
    pairs = likely.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def rows(batches):
        last = (None, None)
        for batch in slices(batches):
            keep = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                if ta != last[0]:  # pairs come in the order of a
                    last = (ta, word_shingles(ascii_words(ta)))
                x, y = last[1], word_shingles(ascii_words(tb))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(PAIR).filter(pa.array(keep, pa.bool_()))

    return pairs.select(*PAIR, "ta", "tb").mapInArrow(rows, _PAIR)


def _linked(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that are linked, as a written table."""
    likely = written(spark, _likely(pairs, nodes), "likely")
    if likely.isEmpty():
        return likely
    links = written(spark, _confirmed(docs, likely), "links")
    remove(spark, likely)
    return links


def _open(members: DataFrame, info: DataFrame, drawn: int) -> DataFrame:
    """Members of the buckets that hold several components: band, node, n, shared, component, and
    the bucket's drawn member with its size, shared shingles and component."""
    placed = members.select("band", "node").join(info, "node")
    by = F.pmod(F.xxhash64("node", "band", F.lit(drawn)), F.lit(1 << 31))
    if not drawn:
        by = by + (F.col("n") - F.col("shared")) * F.lit(1 << 31)
    kept = [F.min_by(c, by).alias(f"drawn_{c}") for c in ("node", "n", "shared", "component")]
    buckets = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), *kept)
    return placed.join(reshuffled(buckets.where("low < high").drop("low", "high"), "band"), "band")


def _shingles(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(node, shingle) of the members of ``held``."""

    def rows(batches):
        for batch in slices(batches):
            sets = [word_shingles(ascii_words(t)).view(np.int64) for t in batch.column("text").to_pylist()]
            node = np.repeat(batch.column("node").to_numpy(), [len(h) for h in sets])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(sets))], ["node", "shingle"])

    ids = held.select(F.col("node").alias("doc_id")).distinct()
    texts = _texts(docs, ids, ids.count())
    return texts.withColumnRenamed("doc_id", "node").mapInArrow(rows, "node long, shingle long")


def _rare(spark: SparkSession, docs: DataFrame, held: DataFrame) -> DataFrame:
    """(node, shingle) of the shingles that at most RARE members of ``held`` have."""
    shingles = written(spark, _shingles(docs, held), "shingles")
    few = shingles.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") <= RARE)
    rare = written(spark, shingles.join(reshuffled(few, "shingle"), "shingle").select("node", "shingle", "df"), "rare")
    remove(spark, shingles)
    return rare


def _sharing(rare: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of members of different components that share a rare shingle; a list has RARE members at most."""
    placed = rare.where("df > 1").join(held.select("node", "component").distinct(), "node")
    lists = placed.groupBy("shingle").agg(F.array_sort(F.collect_list(F.struct("node", "component"))).alias("x")).select("x").distinct()
    lists = lists.select("x", F.explode("x").alias("p")).select("p", F.explode("x").alias("q"))
    apart = lists.where("p.node < q.node and p.component <> q.component")
    return apart.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.component").alias("ca"), F.col("q.component").alias("cb")).distinct()


def _fits(a: str, b: str, sa: str, sb: str):
    """Whether sizes and shared shingles of a pair admit a link."""
    return (100 + PERCENT) * F.least(sa, sb) >= PERCENT * (F.col(a) + F.col(b))


def _between(held: DataFrame) -> DataFrame:
    """All pairs (a, b) of a bucket's members of different components that sizes and shared
    shingles admit, each from the first of the buckets that the two have in common."""
    mine = held.groupBy("node").agg(F.collect_list("band").alias("bands"))  # at most one for each band and text
    rows = held.select("band", "node", "n", "shared", "component", F.col("drawn_component").alias("home"))
    x = rows.where(F.col("component") != F.col("home")).where(100 * F.col("shared") >= PERCENT * F.col("n")).drop("home").join(mine, "node").withColumnsRenamed({"node": "x", "n": "nx", "shared": "sx", "component": "cx", "bands": "bx"})
    y = rows.join(x.select("band").distinct(), "band", "left_semi").join(mine, "node").withColumnsRenamed({"node": "y", "n": "ny", "shared": "sy", "component": "cy", "bands": "by"})
    once = (F.col("cy") == F.col("home")) | (F.col("x") < F.col("y"))
    first = F.col("band") == F.array_min(F.array_intersect("bx", "by"))
    both = x.join(y, "band").where((F.col("cx") != F.col("cy")) & once & _fits("nx", "ny", "sx", "sy") & first)
    return both.select(_pair("x", "y", "cx", "cy")).distinct()


def _joined(spark: SparkSession, info: DataFrame, links: DataFrame) -> DataFrame:
    """``info`` with the components that ``links`` join. Only the components are gone through, not their nodes."""
    if links.isEmpty():
        out = info
    else:
        found = components(spark, links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        moved = found.select(F.col("node").alias("component"), F.col("component").alias("to"))
        out = info.join(moved, "component", "left").select("node", "n", "shared", F.coalesce("to", "component").alias("component"))
        out = written(spark, out, "info")
        remove(spark, found, info)
    remove(spark, links)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    rows = written(spark, sketched(docs), "sketches")
    known = rows.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    least = F.min(F.col("doc_id").cast("long")).alias("node")
    classes = known.groupBy("class").agg(least, F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(spark, classes, "nodes")

    bands = _bands(nodes)
    shared = bands.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = written(spark, bands.join(reshuffled(shared, "band"), "band"), "members")
    tried = members.where("node <> least").withColumns({"ca": F.col("least"), "cb": F.col("node")})
    links = _linked(spark, docs, nodes, tried.select(_pair("least", "node", "ca", "cb")).distinct())
    info = nodes.select("node", "n", F.col("n").alias("shared"), F.col("node").alias("component"))
    info = _joined(spark, info, links)
    for drawn in range(ROUNDS + 1):
        held = written(spark, _open(members, info, drawn), "open")
        if held.isEmpty():
            remove(spark, held)
            break
        sharing = None
        if not drawn:
            several = nodes.groupBy("node").count().where("count > 1")  # ids of several texts
            rare = _rare(spark, docs, held)
            own = rare.groupBy("node").agg(F.count("*").alias("own")).join(several, "node", "left_anti")
            shared = F.col("n") - F.coalesce("own", F.lit(0))
            sizes = written(spark, info.join(own, "node", "left").select("node", "n", shared.alias("shared"), "component"), "info")
            sharing = written(spark, _sharing(rare, held), "sharing")
            remove(spark, held, rare, info)
            info = sizes
            held = written(spark, _open(members, info, drawn), "open")
        if drawn < ROUNDS:
            pairs = held.where(F.col("component") != F.col("drawn_component")).where(_fits("n", "drawn_n", "shared", "drawn_shared"))
            pairs = pairs.select(_pair("node", "drawn_node", "component", "drawn_component"))
            pairs = (pairs if drawn else pairs.union(sharing)).distinct()
        else:
            pairs = _between(held)
        links = _linked(spark, docs, nodes, pairs)
        remove(spark, held, *([sharing] if sharing else []))
        info = _joined(spark, info, links)

    named = nodes.select("class", "node").join(info.select("node", "component").distinct(), "node")
    named = written(spark, named.select("class", F.col("component").alias("component_id")), "classes")
    remove(spark, members, nodes, info)  # what is left is read by the table that is returned
    kind = docs.schema["doc_id"].dataType
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")).join(named, "class", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce(F.col("component_id").cast(kind), "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _first_texts(rows: DataFrame) -> DataFrame:
    """Of the rows of each id the one whose text comes first (of equal texts any); null counts as empty."""
    columns = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    first = rows.groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(columns, F.coalesce("text", F.lit(""))).alias("__first row"))
    return first.select("`__first row`.*")


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group
    of near-duplicates, and of rows that share an id the one whose text comes first."""
    found = written(spark, near_duplicates(spark, docs), "near-duplicates")
    dropped = written(spark, found.where("not kept").select("doc_id").distinct(), "dropped")
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    repeated = written(spark, again.select("doc_id"), "repeated")
    remove(spark, found)
    out = docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped, "doc_id", "left_anti")
    if repeated.isEmpty():
        remove(spark, repeated)
        return out.select(docs.columns)
    some = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
    first = _first_texts(out.join(some, "doc_id", "left_semi").select(docs.columns))
    return out.join(some, "doc_id", "left_anti").select(docs.columns).unionByName(first)


#: The same for DuckDB by a join of all shingles, where ids are unique.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, t.b FROM r JOIN t ON t.a = r.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) USING (doc_id)
"""
