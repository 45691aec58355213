"""Token counts, token files: against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import op7_token_counts
from quarry.llm.common import new_path
from quarry.llm.op4_token_files import digests, read_token_ids, token_files, write_token_ids
from quarry.llm.op7_token_counts import token_counts
from quarry.llm.pretokens import ids_for, lengths_for

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def _odd_texts():
    rng = random.Random(8)
    parts = ["It's", "we'll", "  ", "\n\n", "\t", "naïve", "ß", "12345", "½", "a1b2", "—", "…", "日本", "İ", "\x85", "\xa0", "\x1c", "<|endoftext|>", "<|", "é", "🙂", "x" * 50, "'", "''s", "DON'T", "€5"]
    return ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(400)]


def test_caches_give_what_the_library_gives():
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    lengths, ids = lengths_for(BYTE, "t", {"x": 1}), ids_for(WORD)
    texts = _odd_texts()
    got, n = ids.batch(texts, 1)
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        assert lengths.count(t) == len(byte.encode(t, add_special_tokens=False).ids), repr(t)
        assert got[at : at + k].tolist() == [*word.encode(t, add_special_tokens=False).ids, 1], repr(t)
        at += k


def test_caches_start_anew_and_leave_long_pieces_out(monkeypatch):
    from quarry.llm import pretokens

    monkeypatch.setattr(pretokens, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(pretokens, "CACHE_IDS", 40)
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    lengths, ids = pretokens.Lengths(BYTE, {"x": 1}), pretokens.Ids(WORD)
    for text in [*_odd_texts()[:100], "q" * 5_000, "a " + "z" * 101, "z" * 100]:
        assert lengths.count(text) == len(byte.encode(text, add_special_tokens=False).ids)
        assert ids.batch([text], 1)[0].tolist() == [*word.encode(text, add_special_tokens=False).ids, 1]
        assert len(lengths) <= 6 and max(map(len, lengths)) <= pretokens.LONGEST


def test_the_frequent_table_is_drawn_from_all_rows(spark, monkeypatch):
    """The first rows differ from the others, which are most."""
    monkeypatch.setattr(op7_token_counts, "SAMPLE_TEXTS", 300)
    monkeypatch.setattr(op7_token_counts, "TABLE_ENTRIES", 2)
    late = F.when(F.col("id") < 2_000, F.lit("first")).otherwise(F.concat(F.lit("later"), F.repeat(F.lit(" later"), 4)))
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), late.alias("text"))
    table = op7_token_counts.frequent_lengths(docs, BYTE)
    byte = Tokenizer.from_file(BYTE)
    assert set(table) == {" later", "later"} and all(n == len(byte.encode(p, add_special_tokens=False).ids) for p, n in table.items())


def test_token_counts(spark, hard, empty, hard_docs):
    byte = Tokenizer.from_file(BYTE)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(spark, hard, BYTE).collect()), key=repr)
    n = lambda t: len(byte.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((d, len((t or "").encode()), n(t), n(t) > 512) for d, t, *_ in hard_docs), key=repr)
    assert token_counts(spark, empty, BYTE).count() == 0


def test_token_files(spark, hard, empty, hard_docs):
    word = Tokenizer.from_file(WORD)
    rows = sorted(((d is None, d or 0, d, t or "") for d, t, *_ in hard_docs), key=lambda r: (r[0], r[1], r[3]))
    expected, start = [], 0
    for _, _, d, t in rows:
        ids = [*word.encode(t, add_special_tokens=False).ids, 1]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files(spark, hard, WORD).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected
    assert token_files(spark, empty, WORD).count() == 0


def test_files_are_sorted_and_searched_by_id(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = new_path(spark, "test-ids")
    write_token_ids(spark, docs.orderBy(F.rand(3)), WORD, path, partitions=5)
    rows = spark.read.orc(path)
    parts = {}
    for r in rows.withColumn("file", F.input_file_name()).collect():
        parts.setdefault((r.part, r.file), []).append((r.at, r.n_tokens, r.doc_id, len(r.ids)))
    assert len(parts) == len({p for p, _ in parts}) == 5  # a file for each range
    for held in parts.values():
        held.sort()
        assert [x[2] for x in held] == sorted(x[2] for x in held) and all(n == k for _, n, _, k in held)
        assert [x[0] for x in held] == [sum(x[1] for x in held[:i]) for i in range(len(held))]
    ordered = [r.doc_id for r in read_token_ids(spark, path).orderBy("start").collect()]
    assert ordered == list(range(500))
    found = rows.where("doc_id = 77")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in found._jdf.queryExecution().toString() and found.count() == 1
    assert digests(read_token_ids(spark, path)).count() == 500


def test_stripes_indexes_and_filters(spark, monkeypatch):
    """What the files' own footers say: stripes, a row index every so many rows, Bloom filters, run-length encoding."""
    from quarry.llm import op4_token_files

    monkeypatch.setattr(op4_token_files, "STRIPE_BYTES", 64 << 10)
    monkeypatch.setattr(op4_token_files, "INDEX_ROWS", 1_000)
    docs = spark.range(12_000).select((F.col("id") * 3).alias("doc_id"), F.concat_ws(" ", F.lit("some words of a text"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    path = new_path(spark, "test-stripes")
    write_token_ids(spark, docs, WORD, path, partitions=1)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath() for f in place.getFileSystem(conf).listStatus(place) if f.getPath().getName().endswith(".orc")]
    assert len(files) == 1
    reader = jvm.org.apache.orc.OrcFile.createReader(files[0], jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1_000 and reader.getNumberOfRows() == 12_000
    stripes = [*reader.getStripes()]
    assert len(stripes) > 1 and sum(x.getNumberOfRows() for x in stripes) == 12_000
    rows = reader.rows()
    for stripe in stripes:
        footer = rows.readStripeFooter(stripe)
        streams = {(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()}
        assert (1, "BLOOM_FILTER_UTF8") in streams and (1, "ROW_INDEX") in streams  # column 1 is doc_id
        assert {x.getKind().toString() for x in footer.getColumnsList()} <= {"DIRECT", "DIRECT_V2"}
        assert "DIRECT_V2" in {x.getKind().toString() for x in footer.getColumnsList()}
    rows.close()
