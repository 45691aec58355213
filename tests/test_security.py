"""The rule scan, merging, semantic replies and scores."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from quarry import config, schemas
from quarry.operators import merge, rules, scoring, semantic

PYTHON_CASES = {
    "SQL Injection": 'cur.execute(f"select {x}")',
    "Command Injection": "subprocess.run(cmd, shell=True)",
    "Hardcoded Secrets": 'api_key = "abcd1234efgh"',
    "Insecure Deserialization": "pickle.loads(blob)",
    "Unsafe Cryptography": "hashlib.md5(data)",
    "Weak Password Handling": "hashlib.sha1(password)",
    "Weak Authentication": 'if user.password == "x":',
    "Server-Side Request Forgery (SSRF)": "requests.get(request.args['u'])",
    "Path Traversal": "open(request.args['f'])",
    "Insecure File Upload": "request.files['f'].save(p)",
    "Cross-Site Request Forgery (CSRF)": "WTF_CSRF_ENABLED = False",
    "Insecure Session Handling": "SESSION_COOKIE_SECURE = False",
    "Sensitive Data Exposure": "logger.info(password)",
    "Cross-Site Scripting (XSS)": "{{ x | safe }}",
}
JAVA_CASES = {
    "SQL Injection": 'Statement s = c.createStatement(); s.executeQuery("x" + id);',
    "Command Injection": 'Runtime.getRuntime().exec("ls " + a)',
    "Insecure Deserialization": "new ObjectInputStream(in)",
    "Unsafe Cryptography": 'MessageDigest.getInstance("SHA-1")',
    "Weak Password Handling": 'MessageDigest.getInstance("MD5").digest(password)',
    "Weak Authentication": "a.equals(password)",
    "Server-Side Request Forgery (SSRF)": 'new URL(req.getParameter("u"))',
    "Path Traversal": 'new File(request.getParameter("f"))',
    "Insecure File Upload": "m.transferTo(new File(n))",
    "Cross-Site Request Forgery (CSRF)": "http.csrf().disable()",
    "Insecure Session Handling": "c.setHttpOnly(false)",
}


def _submissions(spark, rows):
    return spark.createDataFrame([(str(i), f"f{i}", lang, code) for i, (lang, code) in enumerate(rows)], schemas.SUBMISSIONS_RAW)


@pytest.fixture(scope="module")
def found(spark):
    rows = [("Python", c) for c in PYTHON_CASES.values()] + [("Java", c) for c in JAVA_CASES.values()]
    return [(*r,) for r in rules.scan(_submissions(spark, rows)).select("submission_id", "category").collect()]


def test_every_rule_finds_its_line(found):
    for i, category in enumerate([*PYTHON_CASES, *JAVA_CASES]):
        assert (str(i), category) in found


def test_marks_lose_no_match(spark):
    """The scan with plain marks before the patterns against the scan by patterns alone."""
    rng = random.Random(8)
    pieces = [*PYTHON_CASES.values(), *JAVA_CASES.values(), "API_\u212aEY = 'abcdefgh1'", "Pa\u017fsword: \"abcdefgh1\"", "execute(", "request", "\n", "hashlib.md5 (x, password", ")"]
    rows = _submissions(spark, [(rng.choice(["Python", "Java"]), "\n".join(rng.choice(pieces) for _ in range(rng.randrange(6)))) for _ in range(200)])
    bare = tuple(dataclasses.replace(r, marks=()) for r in rules.RULES)
    columns = ["submission_id", "seq", "category", "evidence", "line_number"]
    found = sorted(rules.scan(rows).select(columns).collect())
    assert len(found) > 200 and found == sorted(rules.scan(rows, bare).select(columns).collect())


def test_lines_limits_language_and_evidence(spark):
    rows = [("Python", "a\nb\nos.system(x)\n"), ("Python", "os.system(a)\n" * 5), ("Java", "pickle.loads(x)"), ("Python", "x = 1"), ("Python", "yaml.load(f, Loader=SafeLoader)\nyaml.load(g)"), ("Python", "os.system  (" + "x" * 300)]
    out = rules.scan(_submissions(spark, rows)).orderBy("submission_id", "seq").collect()
    by = {}
    for r in out:
        by.setdefault(r.submission_id, []).append(r)
    assert [r.line_number for r in by["0"]] == [3] and by["0"][0].risk_score == 9.9 and by["0"][0].cwe_id == "CWE-78"
    assert [r.line_number for r in by["1"]] == [1, 2, 3]
    assert "2" not in by and "3" not in by
    assert [(r.line_number, r.evidence) for r in by["4"]] == [(2, "yaml.load(")]
    table = rules.scan_table(_submissions(spark, rows), rules.rules_table(spark)).orderBy("submission_id", "seq").collect()
    assert [(r.submission_id, r.seq, r.evidence, r.line_number, r.risk_score) for r in table] == [(r.submission_id, r.seq, r.evidence, r.line_number, r.risk_score) for r in out]


def test_merge_is_the_greedy_fold(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for s in range(60):
        groups = []
        for seq in range(rng.randrange(1, 9)):
            line = rng.choice([None, *range(1, 14)])
            f = dict(seq=seq, severity=rng.choice(config.SEVERITIES), conf=rng.choice([0.4, 0.55, 0.9]), line=line, source=rng.choice(["static_rules", "llm_semantic"]), evidence=rng.choice(["a", "b", "c"]))
            rows.append((str(s), "f", seq, "t", "d", f["severity"], "C", "o", "w", 5.0, f["conf"], f["evidence"], line, "r", f["source"]))
            for g in groups:
                a = g[0]["line"]
                if a is None and line is None or a is not None and line is not None and abs(a - line) <= 3:
                    g.append(f)
                    break
            else:
                groups.append([f])
        for g in groups:
            best = max(g, key=lambda f: (config.SEVERITY_RANK[f["severity"]], f["conf"]))
            several = len(g) > 1
            conf = min(1.0, best["conf"] + 0.15) if several else best["conf"]
            expected[str(s), g[0]["seq"]] = (best["severity"], best["line"], conf, " | ".join(dict.fromkeys(f["evidence"] for f in g)), "merged" if several else best["source"], [*dict.fromkeys(f["source"] for f in g)] if several else [])
    schema = "submission_id string, filename string, seq long, title string, description string, severity string, category string, owasp_category string, cwe_id string, risk_score double, confidence_score double, evidence string, line_number int, recommendation string, source string"
    out = merge.merge(spark.createDataFrame(rows, schema)).collect()
    assert {(r.submission_id, r.seq): (r.severity, r.line_number, r.confidence_score, r.evidence, r.source, r.merged_from) for r in out} == expected


def _replies(spark, agent, *raws):
    return spark.createDataFrame([(str(i), agent, r) for i, r in enumerate(raws)], schemas.SEMANTIC_RESPONSES)


GOOD = '{"title":"T","description":" d ","severity":"High","category":"Broken Access Control","line_number":2,"evidence":"e","recommendation":"r","confidence":0.8}'


def test_semantic_replies(spark):
    raws = [
        '{"findings":[' + GOOD + "]}", None, "no json", "```json\n" + '{"findings":[' + GOOD + "]}\n```", '{"findings":[' + GOOD.replace('"r"', '""') + "]}",
        '{"findings":[' + GOOD.replace("Broken Access Control", "Made Up") + "]}", '{"findings":[' + GOOD.replace("0.8", "true") + "," + GOOD.replace("0.8", '"x"') + "," + GOOD.replace("0.8", "-3") + "]}",
        '{"findings":[' + GOOD.replace(":2,", ':"7",') + "," + GOOD.replace(":2,", ":2.5,") + "," + GOOD.replace(":2,", ":null,") + "]}", '{"findings":[' + GOOD.replace('"T"', "5") + "]}", "[]", '{"findings":null}',
    ]
    out = semantic.security_findings(_replies(spark, "security", *raws)).orderBy("submission_id", "seq").collect()
    got = [(r.submission_id, r.category, r.line_number, r.confidence_score, r.risk_score, r.description) for r in out]
    assert got == [
        ("0", "Broken Access Control", 2, 0.8, 8.1, "d"), ("3", "Broken Access Control", 2, 0.8, 8.1, "d"), ("5", "Missing Input Validation", 2, 0.8, 7.5, "d"),
        ("6", "Broken Access Control", 2, 1.0, 8.1, "d"), ("6", "Broken Access Control", 2, 0.6, 8.1, "d"), ("6", "Broken Access Control", 2, 0.0, 8.1, "d"),
        ("7", "Broken Access Control", 7, 0.8, 8.1, "d"), ("7", "Broken Access Control", None, 0.8, 8.1, "d"),
    ]
    code = semantic.code_findings(_replies(spark, "code", raws[0], raws[4])).collect()
    assert [(r.submission_id, r.category, r.source) for r in code] == [("0", "Broken Access Control", "llm_semantic")]


def test_scores_keep_submissions_without_findings(spark):
    subs = _submissions(spark, [("Python", "os.system(a)"), ("Python", "x = 1"), ("Python", "\n\n\n\n".join(f"os.system({i})" for i in range(3)))])
    reply = spark.createDataFrame([("0", "security", '{"findings":[' + GOOD.replace("Broken Access Control", "Command Injection") + "]}")], schemas.SEMANTIC_RESPONSES)
    scores, merged = scoring.scan_security(subs, reply)
    assert {r.submission_id: (r.security_score, r.highest_risk) for r in scores.collect()} == {"0": (75, 9.9), "1": (100, 0.0), "2": (25, 9.9)}
    one = merged.where("submission_id = '0'").collect()
    assert len(one) == 1 and one[0].merged_from == ["static_rules", "llm_semantic"] and one[0].source == "merged"


def test_risk_of_unknown_severity(spark):
    row = spark.range(1).select(rules.risk_score(F.lit("SQL Injection"), F.lit("?")), rules.risk_score(F.lit("X"), F.lit("Low"))).first()
    assert tuple(row) == (5.6, 3.0)


def test_other_scanners_join_in(spark):
    subs = _submissions(spark, [("Python", "os.system(a)")])
    other = lambda s: rules.scan(s).withColumn("category", F.lit("Path Traversal")).withColumn("source", F.lit("external_tool"))
    out = scoring.security_findings(subs, scanners=(rules.scan, scoring.no_findings, other)).collect()
    assert sorted((r.category, r.source) for r in out) == [("Command Injection", "static_rules"), ("Path Traversal", "external_tool")]


def test_a_failing_scanner_is_left_out(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    subs = _submissions(spark, [("Python", "os.system(a)")])
    broken = lambda s: rules.scan(s).withColumn("title", F.raise_error(F.lit("broken")).cast("string"))
    unplanned = lambda s: s.select("no_such_column")
    with pytest.warns(RuntimeWarning):
        out = scoring.security_findings(subs, scanners=tuple(map(scoring.isolated, (broken, unplanned, rules.scan)))).collect()
    assert [(r.category, r.seq) for r in out] == [("Command Injection", 2_000_030)]
