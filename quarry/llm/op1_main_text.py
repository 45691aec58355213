"""Main text of web pages with removal of site templates.

1. Each page is read once, as a whole. Of all its element subtrees, hashes are counted
   per host: in how many different pages they occur.
2. Pages are told apart by their content: all but what their markup names as menu, header,
   footer, sidebar, notice, advert, form, script, style or comments, unless that is or
   holds an article or main. Pages of the same content count once, and so do
   pages of which less than ``OWN_SHARE`` is text that the host doesn't share, so that an
   article published many times is no template. Only 64-bit hashes and lengths are shuffled.
3. A subtree is a template, and a block shared, if it occurs in ``LEAST_SHARE`` of the
   host's pages and in ``LEAST_PAGES`` of them; on hosts with fewer pages, but
   ``SMALLEST`` at least, in all of them. Pages are read again, their templates deleted,
   and the articles (or else main, or else the body) of the content that stays are the text.

Templates found are broadcast as an array of hashes up to ``BROADCAST_KEYS`` (8 MB);
beyond that each page gets its own list by a join on a hash of the page.

Defined cases: a null or empty html gives an empty text; a null url is a host of its
own name; repeated rows are extracted each, and a null page_id is kept. Other columns
are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_blocks
from .common import remove, reshuffled, slices, written

LEAST_PAGES, LEAST_SHARE, SMALLEST, OWN_SHARE = 10, 0.5, 4, 0.1
BROADCAST_KEYS = 1_000_000
#: Elements that hold a page's whole content are no templates.
WHOLE = frozenset(("html", "body", "main", "article"))

_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _keyed(of: str, h: int) -> int:
    """The hash of a subtree on one host."""
    return _signed(xxhash.xxh64_intdigest(f"{of}\x1f{h:x}"))


def _page_key():
    """A hash of a page's url and html, by which rows of the same page share a list."""
    return F.xxhash64("url", "html").alias("row_key")


def _contents(pages: DataFrame) -> DataFrame:
    """(row_key, site, content, blocks, chars, keys) of each page with content: hashes of the host and of all of
    that content, of its distinct blocks with their lengths, and of the distinct subtrees of the whole page."""
    names = ["row_key", "site", "content", "blocks", "chars", "keys"]

    def rows(batches):
        for batch in slices(batches):
            out = []
            for key, url, html in zip(*(batch.column(c).to_pylist() for c in ("row_key", "url", "html")), strict=True):
                read, of = html_blocks.read(html), host(url)
                texts = [read.blocks[i].text for i in read.content()]
                if texts:
                    own = {_keyed(of, xxhash.xxh64_intdigest(t)): len(t) for t in texts}
                    content = _keyed(of, xxhash.xxh64_intdigest("\x1f".join(texts)))
                    keys = {_keyed(of, h) for h, _, _, tag in read.subtrees if tag not in WHOLE}
                    out.append((key, _signed(xxhash.xxh64_intdigest(of)), content, [*own], [*own.values()], [*keys]))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    lists = "blocks array<bigint>, chars array<bigint>, keys array<bigint>"
    return pages.select(_page_key(), "url", "html").mapInArrow(rows, f"row_key long, site long, content long, {lists}")


def _frequent(rows: DataFrame, of: str) -> DataFrame:
    """(key) on enough pages of its host, of (site, key, page named ``of``); the site itself has key null."""
    counts = rows.select("site", "key", of).distinct().groupBy("site", "key").agg(F.count("*").alias("n"))
    sites = counts.where(F.col("key").isNull() & (F.col("n") >= SMALLEST)).select("site", F.col("n").alias("pages"))
    least = F.greatest(F.least(F.lit(LEAST_PAGES), "pages"), LEAST_SHARE * F.col("pages"))
    held = counts.where(F.col("key").isNotNull() & (F.col("n") >= SMALLEST))
    return held.join(reshuffled(sites, "site"), "site").where(F.col("n") >= least).select("key")


def _with_site(of: str):
    return F.explode(F.concat(F.array(F.lit(None).cast("long")), of)).alias("key")


def templates(spark: SparkSession, contents: DataFrame) -> DataFrame:
    """(key) of the subtrees that recur across the pages of their host."""
    shared = written(spark, _frequent(contents.select("site", "content", _with_site("blocks")), "content"), "shared")
    blocks = contents.select("content", F.explode(F.arrays_zip("blocks", "chars")).alias("b"))
    blocks = blocks.select("content", F.col("b.blocks").alias("key"), F.col("b.chars").alias("chars")).distinct()
    held = blocks.join(shared, "key").groupBy("content").agg(F.sum("chars").alias("held"), F.min("key").alias("copied"))
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda s, x: s + x)
    totals = contents.select("content", total.alias("total")).distinct()
    near = totals.join(held, "content").where(F.col("total") - F.col("held") < OWN_SHARE * F.col("total"))
    near = written(spark, near.select("content", "copied"), "near")
    rows = contents.select("site", "content", "keys").join(near, "content", "left")
    found = _frequent(rows.select("site", F.coalesce("copied", "content").alias("page"), _with_site("keys")), "page")
    out = written(spark, found, "templates")
    remove(spark, shared, near)
    return out


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    contents = written(spark, _contents(pages), "contents")
    found = templates(spark, contents)
    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    if found.count() <= BROADCAST_KEYS:
        keys = spark.sparkContext.broadcast(np.sort(found.toArrow()["key"].to_numpy()))
        rows = rows.withColumn("gone", F.lit(None).cast("array<bigint>"))
        remove(spark, found, contents)
    else:
        keys = spark.sparkContext.broadcast(np.zeros(0, np.int64))
        own = contents.select("row_key", F.explode("keys").alias("key")).distinct().join(found, "key")
        lists = own.groupBy("row_key").agg(F.collect_set("key").alias("gone"))
        lists = written(spark, lists, "page-templates")  # read by the table that is returned
        remove(spark, found, contents)
        rows = rows.withColumn("row_key", _page_key()).join(lists, "row_key", "left").drop("row_key")

    def extract(batches):
        shared = keys.value
        for batch in slices(batches):
            out = []
            for url, html, own in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "gone")), strict=True):
                read, of, gone = html_blocks.read(html), host(url), set(own or ())
                drop = set()
                if gone or len(shared):
                    for h in {h for h, _, _, tag in read.subtrees if tag not in WHOLE}:
                        k = _keyed(of, h)
                        i = np.searchsorted(shared, k)
                        if k in gone or i < len(shared) and shared[i] == k:
                            drop.add(h)
                out.append("\n\n".join(read.kept(drop)))
            sizes = pa.array([len(t) for t in out], pa.int64())
            columns = [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
