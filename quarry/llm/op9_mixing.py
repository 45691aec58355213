"""Temperature mixing of sources, in DataFrame operations only.

Shares p of the sources' tokens become weights p**a / sum(p**a). The exponent a in
[0, 1] is bisected: it is the largest one whose weights reach the target entropy (a
falling exponent evens them out) or, where that would take a source more often than
the repetition limit, the smallest one that keeps the limit. Weights times the budget
are the sources' token budgets.

A budget is realised as permutations of the source's documents, in the order of a hash
of epoch and id: whole ones while they fit, then of one more the documents that end
within the budget. A permutation lies in blocks of about ``BLOCK_ROWS`` rows, by the
first digits of the hash. Sums of blocks, and their running sums, tell the one block in
which the budget ends; only its rows are ordered, and the key at which they stop says of
every document by itself whether it is taken. So no task orders a source, and the texts
are never shuffled.

Tokens are words divided by white space.

Defined cases: a null source is a source of its own; a null or empty text has no tokens,
and a source without any is taken once; rows of one id stand together in a permutation
and are taken or left together; an empty table stays empty. Other columns, of any names
but those that begin with two underscores, are carried along.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, written

BLOCK_ROWS = 2_000
#: The exponent is a multiple of 2**-20, found in four rounds that each cut an interval in 32.
ROUNDS, PARTS = 4, 32
#: Up to so many sources their table is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    """``entropy``: of the weights, as a share of the log of the number of sources.
    ``repeats``: how often a source's tokens are taken at most. ``budget``: tokens to
    take, as a share of all tokens. ``seed``: chooses the permutations."""

    entropy: float = 0.95
    repeats: float = 4.0
    budget: float = 1.0
    seed: str = "mix"


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _curve(shares: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float]]:
    """(entropy, largest repetition) at each exponent, by one aggregation into one row.

    With q = p**a and Z = sum(q): the entropy is log Z - a * sum(q log p) / Z, and a
    source is taken budget * p**(a - 1) / Z times, the smallest one most often."""
    q = [F.pow("p", F.lit(a)) for a in exponents]
    row = shares.agg(F.min("p"), *(F.sum(x) for x in q), *(F.sum(x * F.ln("p")) for x in q)).first()
    n = len(exponents)
    return [(math.log(row[1 + i]) - a * row[1 + n + i] / row[1 + i], budget * row[0] ** (a - 1) / row[1 + i]) for i, a in enumerate(exponents)]


def _last(shares: DataFrame, budget: float, holds) -> float:
    """The largest exponent with ``holds``, which holds at 0 if anywhere and up to some exponent."""
    low, step = 0.0, 1.0
    for _ in range(ROUNDS):
        step /= PARTS
        grid = [low + step * i for i in range(PARTS + 1)]
        low = grid[max((i for i, x in enumerate(_curve(shares, grid, budget)) if holds(*x)), default=0)]
        low = min(low, 1.0)
    return low


def exponent(shares: DataFrame, mix: Mix) -> float:
    """The exponent for ``shares`` (p: positive, summing to 1; one row for each source)."""
    n = shares.count()
    if n < 2:
        return 1.0
    target = mix.entropy * math.log(n)
    even = _last(shares, mix.budget, lambda h, _: h >= target)
    over = _last(shares, mix.budget, lambda _, r: r > mix.repeats)
    if _curve(shares, [even], mix.budget)[0][1] <= mix.repeats:
        return even
    return min(1.0, over + 2.0**-20)


def _key(mix: Mix, epoch: Column) -> Column:
    """A document's place in the permutation of one epoch."""
    return F.md5(F.concat_ws("|", F.lit(mix.seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def plan(spark: SparkSession, rows: DataFrame, mix: Mix) -> DataFrame:
    """For each source of ``rows`` (doc_id, source, n_tokens): __source, n_docs, n_source, weight,
    budget, whole (permutations taken whole), part (tokens of the next one) and cut (its last key)."""
    sums = written(spark, rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_source")), "mixing")
    total = sums.agg(F.sum("n_source")).first()[0] or 0
    p = F.col("n_source") / F.lit(float(max(total, 1)))
    shares = sums.where("n_source > 0").select(p.alias("p"))
    a = exponent(shares, mix)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    some = F.col("n_source") > 0
    out = sums.withColumn("weight", F.when(some, F.pow(p, F.lit(a)) / F.lit(z)).otherwise(0.0))
    out = out.withColumn("budget", F.floor(F.col("weight") * F.lit(mix.budget * total) + F.lit(1e-6)).cast("long"))
    out = out.withColumn("whole", F.when(some, F.floor(F.col("budget") / F.greatest("n_source", F.lit(1)))).otherwise(1).cast("long"))
    out = out.withColumn("part", F.when(some, F.col("budget") - F.col("whole") * F.col("n_source")).otherwise(0))
    digits = F.ceil(F.ln(F.greatest(F.col("n_docs") / F.lit(BLOCK_ROWS), F.lit(1.0))) / F.lit(math.log(16))).cast("int")
    sources = written(spark, out.withColumn("digits", digits).withColumnRenamed("source", "__source"), "mixing")

    keyed = _with_sources(rows, sources.where("part > 0"), "inner").withColumn("key", _key(mix, F.col("whole")))
    keyed = keyed.withColumn("block", F.expr("substring(key, 1, digits)"))
    blocks = keyed.groupBy("__source", "part", "block").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__source").orderBy("block")) - F.col("n")
    last = blocks.withColumn("before", before).where("before <= part and before + n > part").select(F.col("__source").alias("__s"), F.col("block").alias("__b"), "before")
    last = written(spark, last, "mixing")  # one row for each source
    ends = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("__source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    at = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b"))
    held = keyed.join(F.broadcast(last) if last.count() <= BROADCAST_SOURCES else last, at).withColumn("ends", ends).where("ends <= part")
    cut = held.groupBy("__source").agg(F.max("key").alias("key"))
    cut = last.join(cut, F.col("__s").eqNullSafe(F.col("__source")), "left").select("__s", F.coalesce("key", "__b").alias("cut"))
    done = written(spark, sources.join(cut, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s"), "mixing")
    remove(spark, sums, sources, last)
    return done


def _with_sources(rows: DataFrame, sources: DataFrame, how: str) -> DataFrame:
    small = sources.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(sources) if small else sources, F.col("source").eqNullSafe(F.col("__source")), how)


def taken(rows: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """Every row of ``rows`` once for each permutation that takes it, with __epoch from 0 on
    and __key, its place in the permutation of that epoch."""
    own = sources.select("__source", F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    out = _with_sources(rows, own, "inner")
    copies = F.col("__whole") + F.when(_key(mix, F.col("__whole")) <= F.col("__cut"), 1).otherwise(0)
    out = out.withColumn("__copies", copies).where("__copies > 0")
    out = out.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    return out.withColumn("__key", _key(mix, F.col("__epoch"))).drop("__source", "__whole", "__cut", "__copies")


def _narrow(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return written(spark, docs.select("doc_id", "source", tokens().alias("n_tokens")), "mixing")


def mixture(spark: SparkSession, docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, n_tokens, epoch, perm_key: one row for each time a document is taken."""
    rows = _narrow(spark, docs)
    out = taken(rows, plan(spark, rows, mix), mix)
    return out.select("doc_id", "source", "n_tokens", F.col("__epoch").alias("epoch"), F.col("__key").alias("perm_key"))


def mixed(spark: SparkSession, docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as they are taken."""
    rows = _narrow(spark, docs)
    sources = plan(spark, rows, mix)
    remove(spark, rows)
    return taken(docs, sources, mix).select(docs.columns)


#: The same by running sums over whole sources, for DuckDB; columns of ``mixture``.
MIXTURE_SQL = r"""
WITH RECURSIVE n AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all({text}, '[^ \t\n\x0B\f\r]+')), 0) AS BIGINT) AS n_tokens FROM {docs}
), s AS (
  SELECT source, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_source FROM n GROUP BY source
), t AS (
  SELECT sum(n_source) AS total, count(*) FILTER (n_source > 0) AS k FROM s
), p AS (
  SELECT n_source / CAST(total AS DOUBLE) AS p FROM s, t WHERE n_source > 0
), b AS (
  SELECT 0 AS step, 0 AS low, 1048577 AS high, 0 AS low2, 1048577 AS high2
  UNION ALL
  SELECT step + 1, CASE WHEN h1 THEN m1 ELSE low END, CASE WHEN h1 THEN high ELSE m1 END,
         CASE WHEN h2 THEN m2 ELSE low2 END, CASE WHEN h2 THEN high2 ELSE m2 END
  FROM (
    SELECT b.*, (low + high) // 2 AS m1, (low2 + high2) // 2 AS m2,
      (SELECT ln(sum(pow(p, (b.low + b.high) // 2 / 1048576.0))) - ((b.low + b.high) // 2 / 1048576.0) * sum(pow(p, (b.low + b.high) // 2 / 1048576.0) * ln(p)) / sum(pow(p, (b.low + b.high) // 2 / 1048576.0)) FROM p)
        >= 0.95 * (SELECT ln(k) FROM t) AS h1,
      (SELECT pow(min(p), (b.low2 + b.high2) // 2 / 1048576.0 - 1) / sum(pow(p, (b.low2 + b.high2) // 2 / 1048576.0)) FROM p) > 4.0 AS h2
    FROM b WHERE step < 21)
), e AS (
  SELECT CASE WHEN k < 2 THEN 1.0
         WHEN (SELECT pow(min(p), low / 1048576.0 - 1) / sum(pow(p, low / 1048576.0)) FROM p) <= 4.0 THEN low / 1048576.0
         ELSE least(1.0, (low2 + 1) / 1048576.0) END AS a
  FROM b, t WHERE step = 21
), w AS (
  SELECT source, n_source, CASE WHEN n_source > 0 THEN CAST(floor(pow(n_source / CAST(total AS DOUBLE), a) / (SELECT sum(pow(p, a)) FROM p) * total + 1e-6) AS BIGINT) ELSE 0 END AS budget
  FROM s, t, e
), g AS (
  SELECT source, CASE WHEN n_source > 0 THEN budget // n_source ELSE 1 END AS whole, CASE WHEN n_source > 0 THEN budget % n_source ELSE 0 END AS part FROM w
), o AS (
  SELECT n.*, whole, part, sum(n_tokens) OVER (PARTITION BY n.source ORDER BY md5('mix|' || whole || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) RANGE UNBOUNDED PRECEDING) AS ends
  FROM n JOIN g ON n.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, unnest(range(whole + CASE WHEN part > 0 AND ends <= part THEN 1 ELSE 0 END)) AS epoch FROM o
)
SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch, md5('mix|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS perm_key FROM c
"""
