"""Page extraction, source mixing, toxicity, and the pipeline as a whole."""

import math
import os
import random
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import op1_main_text as op1
from quarry.llm import op3_toxicity as op3
from quarry.llm import op9_mixing as op9

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>comment</p> -->
<div class="ad">Buy &amp; buy</div><div class='cookie-notice'>Cookies</div>
<article class=post><header><h1>Title &lt;1&gt;</h1><div>by me</div></header><p><b>One.<br>two &eacute;&#233;&nbsp;x<p>Three <i>four</i>
 five<ul><li>a<li>b</ul><aside>Side</aside><form><p>Mail</p></form><table><tr><td>c<td>d</table><section id="comments"><p>Nice!</p></section><p hidden>gone</p><pre>e
 f</pre></article><footer>&copy; x</footer>"""


def test_main_text():
    from quarry.llm import html_blocks

    assert html_blocks.read(PAGE).kept() == ["Title <1>", "One. two éé x", "Three four five", "a", "b", "c", "d", "e f"]
    assert html_blocks.read(None).kept() == [] and html_blocks.read("").kept() == []
    assert html_blocks.read("plain <b>text").kept() == ["plain text"]
    assert html_blocks.read("<main><p>a</main><p>b").kept() == ["a"]
    assert html_blocks.read("<article><p>a</p><script>x").kept() == ["a"]
    assert html_blocks.read("<p title=\"a > b\">x</p><p title='>'>y</p><p a=\"b>z").kept() == ["x", "y", "z"]


def test_inline_noise_leaves_its_block_whole():
    from quarry.llm import html_blocks

    read = lambda html: html_blocks.read(html).kept()
    assert read("<p>Hello <button>Share now</button> world</p>") == ["Hello world"]
    assert read("<p>a<span class='ad'>Buy cheap</span> b<a class=skip-link>x</a><video>v</video></p>") == ["a b"]
    assert read("<p>x <select><option>1<option>2</select> y <math><mi>n</mi><annotation>n</annotation></math>") == ["x y n"]
    assert read("<div class='related-work'>out</div><p>in</p>") == ["in"]
    assert read("<article><div class='related-work'>a</div><div id=social-history>b</div><div class='x notice'>c</div></article>") == ["a", "b"]
    assert read("<article><header><h1>T</h1><p>Lead</p><p class=byline>By</p><time>May</time></header><p>x</article>") == ["T", "Lead", "x"]
    assert read("<main><article>teaser</article><p>Own text</p></main>") == ["teaser", "Own text"]
    assert read("<ul><li><p>a<li>b</ul>c") == ["a", "b", "c"]
    assert read("a < b <!-- c") == ["a < b"] and read("x <b title='") == ["x"]


def test_hostile_pages_take_linear_time():
    from quarry.llm import html_blocks

    n = 20_000
    pages = [
        "<b>x" * n + "</i>" * n, "<b><p>x</p>" * n, '<a b="x ' * n, '<a b="x ' * n + ">", "<div>x" * n + "</div>" * n, "<b><div>" + "<i>" * n + "</b>" * n,
        "<" * n + ">", ("<header>" * 5_000 + "<p>x") * 4, "<ul><li>x" * n, "<nav>" * n + "<article>x</article>", "<!-- " * n, "<p>&#" * n, "<script>" * n, f"<p>{'x ' * 500_000}</p>",
    ]
    for html in pages:
        start = time.process_time()
        page = html_blocks.read(html)
        page.kept({h for h, *_ in page.subtrees[::2]})
        assert time.process_time() - start < 2, html[:20]


def test_templates_by_brute_force(spark, words, monkeypatch):
    """Subtrees counted over the trees that the pages were made from, by both ways of handing out the templates."""
    rng = random.Random(17)

    def tree(depth):
        if depth == 2 or rng.random() < 0.5:
            return ("p", words(rng, rng.randrange(3, 9)))
        return ("div", *(tree(depth + 1) for _ in range(rng.randrange(1, 4))))

    html = lambda t: f"<p>{t[1]}</p>" if t[0] == "p" else f"<div>{''.join(map(html, t[1:]))}</div>"
    texts = lambda t: [t[1]] if t[0] == "p" else [x for c in t[1:] for x in texts(c)]
    subtrees = lambda t: {t} | ({s for c in t[1:] for s in subtrees(c)} if t[0] == "div" else set())
    hosts = {}
    for h, n in enumerate((2, 4, 5, 9, 12, 25)):
        common = [tree(0) for _ in range(6)]
        rate = [rng.choice((0.3, 0.6, 1.0)) for _ in common]
        hosts[h] = [[("p", words(rng, 200)), *(c for c, r in zip(common, rate, strict=True) if rng.random() < r), tree(0)] for _ in range(n)]
    rows, expected = [], []
    for h, pages in hosts.items():
        held = Counter(s for page in pages for s in {s for t in page for s in subtrees(t)})
        n = len(pages)
        gone = {s for s, k in held.items() if n >= 4 and k >= max(min(10, n), 0.5 * n)}
        left = lambda t: [] if t in gone else [t[1]] if t[0] == "p" else [x for c in t[1:] for x in left(c)]  # noqa: E731, B023
        for i, page in enumerate(pages):
            rows.append((None if i % 3 else 100 * h + i, f"http://h{h}.example/{i}", f"<body>{''.join(map(html, page))}</body>"))
            expected.append((rows[-1][0], rows[-1][1], "\n\n".join(x for t in page for x in left(t))))
    assert any(e[2] != "\n\n".join(x for t in p for x in texts(t)) for e, p in zip(expected, (p for ps in hosts.values() for p in ps), strict=True))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (op1.BROADCAST_KEYS, -1):
        monkeypatch.setattr(op1, "BROADCAST_KEYS", limit)
        assert sorted(((r.page_id, r.url, r.text) for r in op1.main_text(spark, pages).collect()), key=repr) == sorted(expected, key=repr)


def test_templates_of_a_host_go(spark, words, monkeypatch):
    rng = random.Random(2)
    body = lambda i, extra: f"<body>{extra}<div><p>{words(rng, 20)} {i}</p></div></body>"
    rows = [(i, "http://a.example/x", body(i, "<div><p>Read more here</p></div>")) for i in range(30)]
    rows += [(100 + i, "http://b.example/x", body(i, "<p>Read more here</p>" if i < 3 else "")) for i in range(30)]
    copies = body(0, "")
    rows += [(200 + i, "http://c.example/", copies) for i in range(30)] + [(300, None, None), (301, "http://a.example/", ""), (1, "http://a.example/y", "<p>Read more here</p><p>own</p>")]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, site long")
    for limit in (op1.BROADCAST_KEYS, -1):
        monkeypatch.setattr(op1, "BROADCAST_KEYS", limit)
        got = {}
        for r in op1.main_text(spark, pages).collect():
            assert r.n_chars == len(r.text)
            got.setdefault(r.page_id, []).append(r.text)
        assert all("Read more" not in t for i in range(30) for t in got[i]) and sum("Read more" in got[100 + i][0] for i in range(30)) == 3
        assert all(got[200 + i][0] for i in range(30)) and got[300] == [""] and "own" in got[1]
    assert op1.main_text(spark, pages.limit(0)).count() == 0


def test_no_name_rule_removes_an_article(spark, words):
    from quarry.llm import html_blocks

    article = "<article class='post no-sidebar'><header><h1>T</h1></header><p>a<div class='share'>Share</div></article>"
    for start, end in (("<div class='layout has-sidebar'>", "</div>"), ("<form>", "</form>"), ("<header>", "</header>"), ("<div role=banner><div id=comments-open>", "</div></div>")):
        assert html_blocks.read(f"<body>{start}<div class=ad>Buy</div>{article}{end}<div class=ad>Buy</div></body>").kept() == ["T", "a"]
        assert html_blocks.read(f"<body>{start}<p>x</p>{end}<main class=widget><p>b</main></body>").kept() == ["b"]
    assert html_blocks.read(f"<div hidden>{article}</div><p>b").kept() == ["b"]
    # An article that recurs on the whole host hides the pages' own content no more.
    about = "<article><p>About us</p></article>"
    rows = [(i, f"http://a.example/{i}", f"<body><nav><p>Menu</p></nav>{about}<div><p>{words(random.Random(i), 20)}</p></div></body>") for i in range(30)]
    got = {r.page_id: r.text for r in op1.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: words(random.Random(i), 20) for i in range(30)}


def test_templates_of_small_hosts_go_whatever_their_hashes(spark, words):
    rng = random.Random(3)
    block = lambda n: f"<p>{words(rng, n)}</p>"
    rows, own, common = [], {}, {}
    for h in range(40):
        common[h] = [block(9) for _ in range(5)]
        for i in range(15):
            own[h, i] = [block(8), block(8)]
            rows.append((100 * h + i, f"http://h{h}.example/{i}", f"<body>{''.join([*own[h, i], *common[h]])}</body>"))
    article = [block(40) for _ in range(6)]
    rows += [(9000 + i, "http://copies.example/", f"<body>{''.join(article)}<p>on day {i}</p></body>") for i in range(30)]
    got = {r.page_id: r.text for r in op1.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    bare = lambda blocks: "\n\n".join(b[3:-4] for b in blocks)
    assert all(got[100 * h + i] == bare(x) for (h, i), x in own.items())
    assert all(got[9000 + i] == bare(article) + f"\n\non day {i}" for i in range(30))


def test_mixing_has_the_rows_of_its_sql(spark, words, hard):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(1, 30)), s) for i, s in enumerate("a" * 600 + "b" * 120 + "c" * 40 + "d" * 3)] + [(5, "x y", None), (5, None, None), (9000, "", "e"), (9001, "q r", "a"), (9001, "q r", "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, epoch int")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    expected = con.execute(op9.MIXTURE_SQL.format(text="text", docs="documents")).fetchall()
    got = [(r.doc_id, r.source, r.n_tokens, r.epoch, r.perm_key) for r in op9.mixture(spark, docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert max(r[3] for r in got) >= 1 and len({r[0] for r in got if r[1] == "a"}) < 600
    for small in (3, 10_000):
        before, op9.BLOCK_ROWS = op9.BLOCK_ROWS, small
        assert sorted(((r.doc_id, r.epoch) for r in op9.mixture(spark, docs).collect()), key=repr) == sorted(((r[0], r[3]) for r in expected), key=repr)
        op9.BLOCK_ROWS = before
    out = op9.mixed(spark, hard)
    assert out.columns == hard.columns and out.count() > 0
    assert op9.mixture(spark, docs.limit(0)).count() == 0 and op9.mixed(spark, hard.limit(0)).count() == 0
    plan = op9.mixture(spark, docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _labelled(spark, words, n=900):
    rng = random.Random(13)
    bad = ["vile", "rotten", "wretch"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        sentences = [words(rng, rng.randrange(4, 15)) for _ in range(rng.randrange(2, 12))]
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(bad) + (rng.choice(["", "est", "ly"]) if rng.random() < 0.5 else "")
        rows.append((i, ". ".join(sentences) + ".", int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"), rows


def test_toxicity_learns_and_locates(spark, words, hard, empty):
    docs, labels, rows = _labelled(spark, words)
    model = op3.train(spark, docs, labels)
    got = {r.doc_id: r for r in op3.scored(spark, docs, model).collect()}
    held = [(i, t, y) for i, t, y in rows if got[i].held_out]
    assert 100 < len(held) < 300 and sum(got[i].predicted == y for i, _, y in held) / len(held) > 0.95
    for i, t, y in held:
        if y and got[i].predicted:
            assert any(w in t[got[i].worst_start : got[i].worst_end] for w in ("vile", "rotten", "wretch"))
    assert op3.scored(spark, hard, model).count() == 9 and op3.scored(spark, empty, model).count() == 0
    nobody = op3.train(spark, docs, labels.where("toxic = 0"))
    assert {r.score for r in op3.scored(spark, docs, nobody).collect()} == {0.0}
    kept = op3.without_toxic(spark, docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - 675) < 40


def test_score_is_the_noisy_or_of_the_sentences():
    """By the definition, over texts that are not split by the operator's own code."""
    rng = random.Random(23)
    model = op3.Model({"vile": 5.0, "rot*": 3.5, "calm": -2.0, "rotten": 1.0}, -4.0, 0.02)
    vocabulary = ["vile", "rotten", "rotting", "calm", "Vile", "a", "b", "rot"]
    value = {"vile": 5.0, "rotten": 4.5, "rotting": 3.5, "calm": -2.0}
    for _ in range(200):
        sentences = [[rng.choice(vocabulary) for _ in range(rng.randrange(6))] for _ in range(rng.randrange(5))]
        left = 1 - model.leak
        for words in sentences:
            told = {w.lower() for w in words if w.lower() in value}
            if told:
                left *= 1 - 1 / (1 + math.exp(4 - sum(value[w] for w in told)))
        found = model.sentences("! ".join(" ".join(w) for w in sentences))
        assert model.score(found) == pytest.approx(1 - left, abs=1e-9)
    assert model.score(model.sentences(None)) == model.score(model.sentences("")) == pytest.approx(0.02)


def test_long_labelled_texts_are_learned_from(spark, words):
    rng = random.Random(29)
    rows = [(i, f"{words(rng, 6_000)}. so {'vile' if i % 2 else 'calm'} here. {words(rng, 50)}", i % 2) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert min(len(t) for _, t, _ in rows) > 20_000
    model = op3.train(spark, docs, labels)
    assert all((model.score(model.sentences(t)) >= 0.5) == y for _, t, y in rows)
    again = op3.train(spark, docs.repartition(5), labels.repartition(3))
    assert again.weights == model.weights and again.bias == model.bias


def test_toxicity_of_hard_tables(spark, hard, empty):
    """Nulls, repeats and clashing columns in documents and labels, and empty tables, end to end."""
    labels = spark.createDataFrame([(1, 1, "s"), (1, 0, "s"), (None, 1, "s"), (6, None, "s"), (7, 0, "s"), (5, 0, "s"), (99, 1, "s")], "doc_id long, toxic int, score string")
    for docs in (hard, empty):
        for some in (labels, labels.limit(0)):
            out = op3.toxicity(spark, docs, some)
            assert out.count() == docs.count() and out.where("score < 0 or score > 1 or score is null").count() == 0
            kept = op3.without_toxic(spark, docs, some)
            assert kept.columns == docs.columns and kept.count() <= docs.count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = op3.toxicity(spark, docs, labels).where("held_out").join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    right, n = known.selectExpr("sum(int(predicted = toxic))", "count(*)").first()
    assert n > 50 and right / n > 0.95


def _stage_tables(spark, path):
    """Labels and a benchmark for the pipeline's stages."""
    spark.createDataFrame([(1, 1, 1), (7, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "x y z"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_of_hard_tables(spark, hard, empty, tmp_path):
    """Each stage on nulls, repeated rows, ties, a long text and clashing columns, and on an empty table."""
    import corpus_pipeline

    _stage_tables(spark, str(tmp_path))
    stages = dict(corpus_pipeline.STAGES)
    for docs in (hard, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and (name == "mixing" or out.count() <= docs.count()), name
        assert stages["token_output"](spark, docs, str(tmp_path)).count() == docs.count()
    single = stages["near_dedup"](spark, hard, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in single.collect() if r.doc_id in (1, 6)) == [(1, "a b c d e f g h")]
    pure = stages["decontamination"](spark, hard, str(tmp_path))
    assert pure.count() == 8 and pure.where("text = 'x y z'").count() == 0
    docs = hard
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    out = stages["token_output"](spark, docs, str(tmp_path))
    assert out.count() == docs.count() > 0 and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline_by_stages(spark):
    import corpus_pipeline

    from test_near_dedup import _groups
    from test_scans import _brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF).cache()
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert clean.columns == docs.columns and 0.8 * docs.count() < len(rows) < docs.count()
    single = stages["near_dedup"](spark, clean, SF).cache()
    top, _ = _groups(rows)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(i for i in top if top[i] == i)
    pure = stages["decontamination"](spark, single, SF).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = [e[0] for e in _brute([(r.doc_id, r.text) for r in single.collect()], items) if not e[5]]
    assert pure.columns == docs.columns and sorted(r.doc_id for r in pure.collect()) == sorted(expected)
    mixed = stages["mixing"](spark, pure, SF)
    con = duckdb.connect()
    con.register("documents", pure.select("doc_id", "text", "source").toPandas())
    wanted = con.execute(op9.MIXTURE_SQL.format(text="text", docs="documents")).fetchall()
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(r[0] for r in wanted)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == len(wanted) and out.agg(F.countDistinct("start")).first()[0] == len(wanted)
