"""Knowledge documents, chunks, manifests, results, prompts and streams."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators import corpus, ingest, prompts
from quarry.sources import files, results
from quarry.streaming import scan

HEAD = "---\nid: {id}\ntitle: \"T: x\"\ncategory: identity\ncwe_id: CWE-1\nlanguages: [python, java]\ntags:\n  - a\n  - b\nlast_updated: 2024-05-01\n---\n\n"


def _chunks(content, size, overlap):
    out, held = [], ""
    for p in [x.strip() for x in re.split(r"\n\s*\n", content) if x.strip()]:
        joined = f"{held}\n\n{p}" if held else p
        if len(joined) <= size:
            held = joined
            continue
        out += [held.strip()] if held.strip() else []
        tail = held[-overlap:] if len(held) > overlap else held
        held = f"{tail}\n\n{p}" if tail else p
    return out + ([held.strip()] if held.strip() else [])


@pytest.mark.parametrize("size, overlap", [(1000, 150), (60, 20), (60, 0)])
def test_chunks(spark, size, overlap):
    rng = random.Random(size + overlap)
    texts = ["\n\n".join("w" * rng.randrange(1, 50) + " é" * rng.randrange(9) for _ in range(rng.randrange(12))) for _ in range(60)] + ["", " \n \n "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for i, got in df.select("i", corpus.chunked(F.col("t"), size, overlap)).collect():
        assert got == _chunks(texts[i], size, overlap)


def test_knowledge_base(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "one.md").write_text(HEAD.format(id="one") + "Body é.\r\n\r\nMore.\n", newline="")
    (tmp_path / "README.md").write_text("no header")
    (tmp_path / "two.md").write_text("---\nid: two\ntitle: T\ncategory: identity\n---\nx\n")
    docs = {r.id: r for r in files.knowledge_base(spark, str(tmp_path)).collect()}
    one = docs["one"]
    assert (one.file_path, one.title, one.languages, one.tags, one.source, one.version, str(one.last_updated)) == ("a b/one.md", "T: x", ["python", "java"], ["a", "b"], "internal-authored", 1, "2024-05-01")
    assert one.content == "Body é.\n\nMore." and one.content_hash == hashlib.sha256(one.content.encode()).hexdigest() and one.word_count == 3
    assert docs["two"].languages == [] and files.document_by_id(spark, str(tmp_path), "two").count() == 1
    with pytest.raises(files.KnowledgeBaseError):
        files.document_by_id(spark, str(tmp_path), "three")
    loaded = files.knowledge_base(spark, str(tmp_path))
    chunks, totals = corpus.prepare(loaded)
    assert {r.chunk_id for r in chunks.collect()} == {"one::chunk-0", "two::chunk-0"} and totals.first().average_chunks_per_document == 1.0
    found = corpus.manifest(loaded, chunks)
    assert found["document_count"] == 2 and found["documents_by_category"] == {"identity": 2} and [d["id"] for d in found["documents"]] == ["one", "two"]
    results.write_manifest(spark, found, str(tmp_path / "out" / "manifest.json"))
    assert '"chunk_count": 2' in (tmp_path / "out" / "manifest.json").read_text()
    (tmp_path / "bad.md").write_text("no header")
    with pytest.raises(files.KnowledgeBaseError):
        files.knowledge_base(spark, str(tmp_path))
    assert files.knowledge_base(spark, str(tmp_path), strict=False).count() == 2
    (tmp_path / "bad.md").write_text("---\nid: two\ntitle: T\ncategory: identity\n---\nx\n")
    with pytest.raises(files.KnowledgeBaseError):
        files.knowledge_base(spark, str(tmp_path), strict=False)
    with pytest.raises(files.KnowledgeBaseError):
        files.knowledge_base(spark, str(tmp_path / "missing"))


def test_source_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "B.java").write_bytes(b"class B {}")
    (tmp_path / "c.py").write_bytes(b"\xff\xfe")
    (tmp_path / "d.txt").write_text("x")
    raw = files.source_files(spark, str(tmp_path))
    assert {(r.filename, r.code) for r in ingest.accepted_files(raw).collect()} == {("a.py", "x = 1\n"), ("B.java", "class B {}")}
    lost = {r.submission_id.rpartition("/")[2]: r.problem for r in ingest.rejected_files(raw).collect()}
    assert lost == {"c.py": "file is not UTF-8", "d.txt": "file type is not accepted"}


def test_headers_with_and_without_the_library(monkeypatch):
    flat = "id: a\ntitle: 'T: x'\ntags: [a, b]\nlast_updated: 2024-05-01\n"
    assert corpus.parse_header(flat) == {"id": "a", "title": "T: x", "tags": ["a", "b"], "last_updated": "2024-05-01"}
    full = flat + "category: identity\nnotes: |\n  one\n  two\nmore:\n  deep: 1\ncwe_id: \"CWE-\\x31\"\n"
    if corpus.yaml is not None:
        found = corpus._metadata(full)
        assert found["problem"] is None and found["cwe_id"] == "CWE-1" and str(found["last_updated"]) == "2024-05-01"
        assert corpus._metadata("id: [")["problem"].startswith("no YAML") and corpus._metadata("- a\n")["problem"] == "not a mapping"
        assert corpus._metadata(flat.replace("[a, b]", "[1]") + "category: identity\n")["problem"] == "tags is no list of texts"
    monkeypatch.setattr(corpus, "yaml", None)
    assert corpus._metadata(flat + "category: identity\n")["problem"] is None and corpus._metadata(full)["problem"] is not None


def test_prepared_folder(spark, tmp_path):
    docs = spark.createDataFrame([("a", "T", "identity", "a.md", "One.\n\nTwo.", "h", 2)], "id string, title string, category string, file_path string, content string, content_hash string, word_count int")
    docs = docs.withColumns({"owasp_category": F.lit(None).cast("string"), "cwe_id": F.lit("x"), "languages": F.array(F.lit("p")), "tags": F.array(F.lit("t"))})
    results.write_prepared(docs, corpus.chunks(docs), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/chunks")).first().chunk_id == "a::chunk-0" and spark.read.json(str(tmp_path / "out/totals")).first().document_count == 1


def test_ids_and_status(spark):
    raw = spark.createDataFrame([(None, 1), ("x", 2), (None, 3)], "submission_id string, n int")
    first, again = ({r.n: r.submission_id for r in ingest.identified(raw, 5).collect()} for _ in range(2))
    assert first == again and first[2] == "x" and len(first[1]) == 36 and first[1] != first[3]
    ids = [r.submission_id for r in ingest.identified(raw).collect()]
    assert len(set(ids)) == 3
    subs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "submission_id string")
    done, started, failed = (subs.where(F.col("submission_id").isin(*x)) for x in ("a", "abc", "c"))
    out = results.with_results(subs, done.withColumn("score", F.lit(1)), started=started, failed=failed)
    assert {r.submission_id: (r.score, r.status) for r in out.collect()} == {"a": (1, "completed"), "b": (None, "analyzing"), "c": (None, "failed"), "d": (None, "received")}


def test_latest_and_lookup(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "submission_id string, analyzed_at int, score int")
    assert {(r.submission_id, r.score) for r in results.latest(df).collect()} == {("a", 6), ("b", 7)}
    assert results.by_id(df, "b").count() == 1 and results.listed(df)[1] == 3


def test_prompts(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "yo"), (1, 1, None, "hi"), (2, 1, "user", None)], "conv_id int, turn int, role string, text string")
    assert {r.conv_id: r.prompt for r in prompts.assembled(df, system=F.lit("S")).collect()} == {1: "S\n\nUSER: hi\n\nASSISTANT: yo\n\n", 2: "S\n\nUSER: \n\n"}
    parts = spark.createDataFrame([([("text", "a"), ("image", "x"), ("text", "b")],)], "p array<struct<type string, text string>>")
    assert parts.select(prompts.flattened(F.col("p"))).first()[0] == "ab"


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("1", "f", "Python", "os.system(a)"), ("2", "f", "Python", "x = 1")], schemas.SUBMISSIONS_RAW)
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = scan.submissions(spark, str(tmp_path / "in"))
    scan.write_scores(stream, lambda df, n: seen.extend((r.submission_id, r.security_score) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [("1", 75), ("2", 100)]
    q = scan.findings(scan.submissions(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("found").count() == 1
