"""Knowledge documents: front matter, profile, chunks, manifest."""

from __future__ import annotations

import datetime
import json
import re

import pandas as pd

try:
    import yaml
except ImportError:  # flat headers are read without it
    yaml = None

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config, schemas
from quarry.functions import rounding, text

# Fixed value: a header between two lines of dashes, and the body.
FRONT_MATTER = r"(?s)\A---\s*\n(.*?\n)---\s*\n(.*)\z"


def split_front_matter(raw: Column) -> tuple[Column, Column, Column]:
    """Whether a text has a header, the header, and the stripped body."""
    whole = F.regexp_replace(raw, "\r\n?", "\n")
    p = text.pattern(FRONT_MATTER)
    return whole.rlike(p), F.regexp_extract(whole, p, 1), text.strip(F.regexp_extract(whole, p, 2))


def _scalar(value: str) -> str | None:
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        return value[1:-1]
    value = re.sub(r"\s+#.*$", "", value)
    return None if value in ("", "~", "null", "Null", "NULL") else value


def _items(value: str) -> list[str]:
    return [x for x in (_scalar(v) for v in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", value)) if x is not None]


def parse_header(header: str) -> dict:
    """The fields of a header of flat ``key: value`` lines, whose values are scalars,
    ``[a, b]`` lists or ``- item`` lists. Raises ValueError on anything else."""
    found: dict = {}
    last = None
    for line in header.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.match(r"\s*-\s+(.*)$", line):
            if last is None or found.get(last) is not None and not isinstance(found[last], list):
                raise ValueError(f"a list item without a list: {line.strip()}")
            found[last] = (found[last] or []) + [_scalar(m[1])]
        elif m := re.match(r"([A-Za-z_][\w-]*)\s*:(?:\s+(.*))?$", line):
            last, value = m[1], (m[2] or "").strip()
            found[last] = _items(value) if value.startswith("[") and value.endswith("]") else _scalar(value)
        else:
            raise ValueError(f"not a field: {line.strip()}")
    return found


def read_header(header: str) -> dict:
    """The fields of a header: by the YAML library where there is one, else of its flat subset."""
    if yaml is None:
        return parse_header(header)
    try:
        found = yaml.safe_load(header) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"no YAML: {e}") from e
    if not isinstance(found, dict):
        raise ValueError("not a mapping")
    return found


def _date(given) -> datetime.date | None:
    if isinstance(given, datetime.datetime):
        return given.date()
    return given if given is None or isinstance(given, datetime.date) else datetime.date.fromisoformat(given)


def _metadata(header: str) -> dict:
    """A header as the fields of KNOWLEDGE_HEADER, or what is wrong with it under ``problem``."""
    try:
        found = read_header(header)
        for name in ("id", "title"):
            if not isinstance(found.get(name), str) or not found[name]:
                raise ValueError(f"{name} is missing")
        if found.get("category") not in config.KNOWLEDGE_CATEGORIES:
            raise ValueError(f"category is unknown: {found.get('category')}")
        lists = {}
        for name in ("languages", "tags"):
            lists[name] = found.get(name, [])
            if not isinstance(lists[name], list) or not all(isinstance(x, str) for x in lists[name]):
                raise ValueError(f"{name} is no list of texts")
        for name in ("owasp_category", "cwe_id"):
            if not isinstance(found.get(name), str | None):
                raise ValueError(f"{name} is no text")
        return {
            "id": found["id"], "title": found["title"], "category": found["category"], "owasp_category": found.get("owasp_category"), "cwe_id": found.get("cwe_id"),
            **lists, "source": found.get("source", config.DEFAULT_SOURCE), "version": int(found.get("version", 1)), "last_updated": _date(found.get("last_updated")), "problem": None,
        }
    except (ValueError, TypeError) as e:
        return dict.fromkeys(("id", "title", "category", "owasp_category", "cwe_id", "languages", "tags", "source", "version", "last_updated")) | {"problem": str(e)}


@F.pandas_udf(schemas.KNOWLEDGE_HEADER)
def header_fields(headers: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame([_metadata(h or "") for h in headers], columns=["id", "title", "category", "owasp_category", "cwe_id", "languages", "tags", "source", "version", "last_updated", "problem"])
    return rows.astype({"version": "Int32"})


def profile(content: Column) -> dict[str, Column]:
    """Hash, length and words of a body."""
    return {"content_hash": F.sha2(content, 256), "char_count": F.length(content), "word_count": text.words(content)}


def documents(files: DataFrame) -> DataFrame:
    """Files (file_path, value) as documents, good ones with problem null."""
    good, header, body = split_front_matter(F.col("value"))
    rows = files.select("file_path", good.alias("has_header"), header.alias("header"), body.alias("content")).withColumn("m", header_fields("header"))
    rows = rows.select("file_path", "m.*", "content", "has_header").withColumn("problem", F.when(~F.col("has_header"), F.lit("missing or malformed front matter")).otherwise(F.col("problem"))).drop("has_header")
    return rows.withColumns(profile(F.col("content")))


def duplicate_ids(docs: DataFrame, key: str = "id") -> DataFrame:
    """(key, n) of the ids that several documents have."""
    return docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def chunked(content: Column, max_chars: int = config.CHUNK_CHARS, overlap: int = config.CHUNK_OVERLAP) -> Column:
    """array<string> of the chunks of a text: whole paragraphs while they fit, each chunk
    but the first begun with the end of the one before it. An overlap of 0 carries all of it."""
    paragraphs = F.filter(F.transform(F.split(content, text.pattern(r"\n\s*\n"), -1), text.strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def flushed(s: Column) -> Column:
        body = text.strip(s.held)
        return F.when(body != "", F.concat(s.out, F.array(body))).otherwise(s.out)

    def step(s: Column, p: Column) -> Column:
        joined = F.when(s.held == "", p).otherwise(F.concat(s.held, F.lit("\n\n"), p))
        tail = F.when(F.length(s.held) > overlap, F.right(s.held, F.lit(overlap))).otherwise(s.held) if overlap else s.held
        begun = F.when(tail == "", p).otherwise(F.concat(tail, F.lit("\n\n"), p))
        fits = F.length(joined) <= max_chars
        return F.struct(F.when(fits, s.out).otherwise(flushed(s)).alias("out"), F.when(fits, joined).otherwise(begun).alias("held"))

    return F.aggregate(paragraphs, start, step, flushed)


def chunks(docs: DataFrame, max_chars: int = config.CHUNK_CHARS, overlap: int = config.CHUNK_OVERLAP) -> DataFrame:
    """A row for each chunk of documents (id, content and metadata), with its metadata."""
    rows = docs.select("*", F.posexplode(chunked(F.col("content"), max_chars, overlap)).alias("chunk_index", "text"))
    chunk_id = F.concat(F.col("id").cast("string"), F.lit("::chunk-"), F.col("chunk_index").cast("string"))
    return rows.select(chunk_id.alias("chunk_id"), F.col("id").alias("document_id"), "chunk_index", "text", "category", "owasp_category", "cwe_id", "languages", "tags", F.col("title").alias("source_title"), F.col("file_path").alias("source_file_path"))


def totals(docs: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """document_count, chunk_count and average_chunks_per_document, in one row."""
    both = docs.select(F.lit(1).alias("d"), F.lit(0).alias("c")).unionAll(chunk_rows.select(F.lit(0), F.lit(1)))
    out = both.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("document_count"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunk_count"))
    mean = rounding.to_places(F.col("chunk_count") / F.col("document_count"), 2)
    return out.withColumn("average_chunks_per_document", F.when(F.col("document_count") > 0, mean).otherwise(0.0))


def by_category(docs: DataFrame) -> DataFrame:
    return docs.groupBy("category").agg(F.count("*").alias("documents"))


def manifest(docs: DataFrame, chunk_rows: DataFrame) -> dict:
    """The manifest of a prepared corpus, whose list of documents is as long as the corpus;
    ``manifest_documents`` is the same list as a table."""
    total = totals(docs, chunk_rows).first().asDict()
    counts = {r.category: r.documents for r in by_category(docs).orderBy("category").collect()}
    listed = [r.asDict() for r in manifest_documents(docs).orderBy("file_path").toLocalIterator()]
    return {"generated_at": datetime.datetime.now(datetime.UTC).isoformat(), **{k: total[k] for k in ("document_count", "chunk_count")}, "documents_by_category": counts, "average_chunks_per_document": total["average_chunks_per_document"], "documents": listed}


def manifest_documents(docs: DataFrame) -> DataFrame:
    return docs.select("id", "title", "category", "file_path", "content_hash", "word_count")


def manifest_json(found: dict) -> str:
    return json.dumps(found, indent=2)


def prepare(docs: DataFrame, max_chars: int = config.CHUNK_CHARS, overlap: int = config.CHUNK_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Chunks and totals of documents."""
    rows = chunks(docs, max_chars, overlap)
    return rows, totals(docs, rows)
