"""Python and Java code checks, duplicate blocks, ingestion and scores."""

import ast
import keyword
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators import clones, facts, ingest, java_checks, python_checks, scoring
from quarry.plans.samples import TEMPLATES


def _subs(spark, *codes, language="Python"):
    return spark.createDataFrame([(str(i), "f", language, c) for i, c in enumerate(codes)], schemas.SUBMISSIONS_RAW)


def test_function_metrics_of_the_samples(spark):
    rows = [(t, t.code.replace("~", "7")) for t in TEMPLATES if t.language == "Python" and not t.rejected and not t.error]
    got = python_checks.function_metrics(_subs(spark, *[c for _, c in rows])).collect()
    expected = {(str(i), *[x.replace("~", "7") if isinstance(x, str) else x for x in f]) for i, (t, _) in enumerate(rows) for f in t.functions}
    assert {(r.submission_id, r.name, r.line, r.span, r.cyclomatic, r.cognitive, r.parameters) for r in got} == expected


def test_halstead_of_the_samples(spark):
    rows = [t for t in TEMPLATES if t.halstead]
    got = {r.submission_id: r.volume for r in python_checks.halstead(_subs(spark, *[t.code.replace("~", "7") for t in rows])).collect()}
    for i, t in enumerate(rows):
        length, vocabulary = t.halstead
        assert got[str(i)] == pytest.approx(length * math.log2(vocabulary)), t.filename


def _random_source(rng):
    """A source of nested functions, classes, branches, calls and numbers."""

    def expression(depth):
        kinds = ["1", "7", "x", "y", "-3.5", "a.b", "True", "100"]
        if depth < 3 and rng.random() < 0.6:
            kinds = [f"f({expression(depth + 1)}, {expression(depth + 1)}, k={expression(depth + 1)})", f"({expression(depth + 1)} or {expression(depth + 1)} and x)", f"[i for i in {expression(depth + 1)} if i > 8 if y]", f"({expression(depth + 1)} + {expression(depth + 1)})"]
        return rng.choice(kinds)

    def block(depth):
        pad, out = "    " * depth, []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.randrange(12) if depth < 5 else 0
            if kind < 3:
                out.append(f"{pad}{rng.choice(['x', 'y', '_z', 'total'])} {rng.choice(['=', '+='])} {expression(0)}")
            elif kind < 5:
                out += [f"{pad}if {expression(0)}:", *block(depth + 1)]
            elif kind == 5:
                out += [f"{pad}while {expression(0)}:", *block(depth + 1)]
            elif kind == 6:
                out += [f"{pad}for q in {expression(0)}:", *block(depth + 1), f"{pad}else:", f"{pad}    pass"]
            elif kind == 7:
                out += [f"{pad}try:", *block(depth + 1), f"{pad}except E:", *block(depth + 1)]
            elif kind == 8:
                out += [f"{pad}with f(9) as w, g:", *block(depth + 1), f"{pad}assert x, 12"]
            elif kind < 11:
                out += [f"{pad}def fn{rng.randrange(99)}(self, a=f(11)):", f"{pad}    global total" if rng.random() < 0.3 else f"{pad}    pass", *block(depth + 1)]
            else:
                out += [f"{pad}class K{rng.randrange(99)}(ABC):", *block(depth + 1), f"{pad}    @abstractmethod", f"{pad}    def m(self): return Foo(Bar())"]
        return out

    return "\n".join(block(0)) + "\n"


def test_one_walk_finds_what_a_walk_of_each_function_finds():
    """Facts of random sources against separate recursions over each function and class."""
    weight = {ast.If: 1, ast.For: 1, ast.While: 1, ast.ExceptHandler: 1, ast.With: 1, ast.Assert: 1}
    defs = (ast.FunctionDef, ast.AsyncFunctionDef)

    def cyclomatic(f):
        own = sum(weight.get(type(n), 0) for n in ast.walk(f))
        logic = sum(len(n.values) - 1 for n in ast.walk(f) if isinstance(n, ast.BoolOp))
        return 1 + own + logic + sum(1 + len(n.ifs) for n in ast.walk(f) if isinstance(n, ast.comprehension))

    def cognitive(n, depth=0):
        cost = 0
        for c in ast.iter_child_nodes(n):
            deeper = isinstance(c, (ast.If, ast.For, ast.While, ast.ExceptHandler))
            cost += (1 + depth if deeper else len(c.values) - 1 if isinstance(c, ast.BoolOp) else 0) + cognitive(c, depth + deeper)
        return cost

    def magic(f):
        tops = [p for n in ast.walk(f) for p in ([n.test] if isinstance(n, (ast.If, ast.While)) else n.args if isinstance(n, ast.Call) else [])]
        found = [n.value for p in tops for n in ast.walk(p) if isinstance(n, ast.Constant)]
        return [str(v) for v in found if type(v) in (int, float) and v not in (0, 1, -1, 2, 100)][:2]

    def unused(f):
        names = [n for n in ast.walk(f) if isinstance(n, ast.Name)]
        kept = {n.id for n in names if isinstance(n.ctx, ast.Load)} | {x for n in ast.walk(f) if isinstance(n, ast.Global) for x in n.names}
        kept |= {n.target.id for n in ast.walk(f) if isinstance(n, ast.AugAssign)}
        return sorted(v for v in {n.id for n in names if isinstance(n.ctx, ast.Store)} - kept if v[0] != "_")[:3]

    rng = random.Random(12)
    for _ in range(300):
        code = _random_source(rng)
        try:
            tree = ast.parse(code)
        except SyntaxError:  # a name that is used before its global statement
            continue
        nodes, got = list(ast.walk(tree)), facts.of_source(code)
        functions = [n for n in nodes if isinstance(n, defs)]
        assert [(f["name"], f["line"], f["cyclomatic"], f["cognitive"], f["magic"], f["unused"]) for f in got["functions"]] == [(f.name, f.lineno, cyclomatic(f), cognitive(f), magic(f), unused(f)) for f in functions], code
        assert [(d["name"], d["is_class"]) for d in got["definitions"]] == [(n.name, isinstance(n, ast.ClassDef)) for n in nodes if isinstance(n, (*defs, ast.ClassDef))]
        made = [sorted({n.func.id for m in k.body if isinstance(m, defs) for n in ast.walk(m) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id[0].isupper()}) for k in nodes if isinstance(k, ast.ClassDef)]
        assert [k["concrete"] for k in got["classes"]] == made and all(k["abstract_base"] and k["abstract_methods"] >= 1 for k in got["classes"])


def test_findings_of_python(spark):
    many = "class A:\n" + "".join(f"    def m{i}(self):\n        pass\n" for i in range(16))
    codes = [
        "import os, sys\nprint(sys.path)\n", "from a import b\n__all__ = ['b']\n", "def f(x):\n    total = 0\n    total += x\n    y = 1\n", "def broken(:\n", many,
        "def f(a, b, c, d, e, *g, **h):\n    if a > 7 or g(8, 9, k=10):\n        return -5\n", "class B:\n    def m(self):\n        return A(), C(), D(), E(), ValueError()\n", "def f():\n    global z\n    z = 1\n    _u = 2\n",
    ]
    rows = scoring.analysed(_subs(spark, *codes))
    out = scoring.static_findings(rows).orderBy("submission_id", "seq").collect()
    got = {(r.submission_id, r.title, r.line_number) for r in out if r.category != "Duplicate Code"}
    assert got == {
        ("0", "Unused import: os", 1), ("2", "Possibly unused variable: y", 1), ("3", "Code does not parse", 1), ("4", "Possible God Object: A", 1),
        ("5", "Long parameter list: f", 1), ("5", "Magic number in f: 7", 1), ("5", "Magic number in f: 8", 1), ("6", "Possible Dependency Inversion violation: B", 1),
    }
    penalty = {"Low": 2, "Medium": 5, "High": 10}
    cost = {str(i): 0 for i in range(len(codes))}
    for r in out:
        cost[r.submission_id] += penalty[r.severity]
    assert {r.submission_id: r.maintainability_score for r in scoring.quality_scores(rows).collect()} == {k: 100 - v for k, v in cost.items()}


def test_java(spark):
    code = "import java.util.List;\nimport java.util.Map;\nclass low {\n    Map m;\n\n    public int Get(int a, int b, int c, int d, int e, int f) {\n        if (a > 1 && b > 2) {\n            for (;;) { while (c > 0) { c--; } }\n        }\n        return 1;\n    }\n}\n"
    subs = _subs(spark, code, language="Java")
    m = java_checks.methods(subs).collect()
    assert [(r.name, r.line, r.span, r.cyclomatic, r.cognitive, r.parameters) for r in m] == [("Get", 4, 6, 5, 1 + 2 + 3, 6)]
    titles = [r.title for r in scoring.static_findings(scoring.analysed(subs)).orderBy("seq").collect()]
    assert titles == ["Naming convention: low", "Long parameter list: Get", "Naming convention: Get", "Unused import: java.util.List"]


def test_odd_java(spark):
    """Classes without a body, interfaces without one, imports that end in a dot, no code at all."""
    subs = _subs(spark, "class A", "interface B", "import a.b.;\n", "", "class C { } class d { void X() { } }", language="Java")
    assert [(r.submission_id, r.name, r.span) for r in java_checks.classes(subs).orderBy("submission_id", "name").collect()] == [("0", "A", None), ("4", "C", 1), ("4", "d", 1)]
    assert java_checks.interfaces(subs).count() == 0 and java_checks.unused_imports(subs).count() == 0
    scores = scoring.quality_scores(scoring.analysed(subs)).collect()
    assert {r.submission_id: r.maintainability_score for r in scores} == {"0": 100, "1": 100, "2": 100, "3": 100, "4": 96}


def test_java_balance_matches_a_stack_machine(spark):
    hidden = re.compile(r"//.*?$|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.M | re.S)

    def check(code):
        closes, stack, line = {"{": "}", "(": ")", "[": "]"}, [], 1
        for c in hidden.sub("", code):
            if c == "\n":
                line += 1
            elif c in closes:
                stack.append((c, line))
            elif c in closes.values():
                wanted = closes[stack[-1][0]] if stack else "nothing"
                if c != wanted:
                    return False, f"Unexpected '{c}' — expected '{wanted}' (line {line})", line
                stack.pop()
        if stack:
            return False, f"Unclosed '{stack[-1][0]}' (line {stack[-1][1]})", stack[-1][1]
        return True, None, None

    rng = random.Random(4)
    codes = ["".join(rng.choice(["{", "}", "(", ")", "[", "]", "\n", "a", '"', "//", "/*", "*/"]) for _ in range(rng.randrange(14))) for _ in range(300)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, code string")
    for i, s in df.select("i", ingest.java_balance(F.col("code"))).collect():
        assert tuple(s) == check(codes[i]), codes[i]


def test_duplicate_blocks_match_the_sequential_search(spark):
    def search(code, words):
        lines = [x.strip() for x in code.splitlines()][:2000]
        raw, forms, out = {}, {}, []
        for i in range(len(lines) - 3):
            block = lines[i : i + 4]
            if sum(map(len, block)) < 20:
                continue
            names: dict = {}
            form = tuple(tuple("NUM" if t.isdigit() else names.setdefault(t, len(names)) if re.match(r"^[A-Za-z_][A-Za-z0-9_]*$", t) and t not in words else t for t in re.findall(r"\w+|[^\w\s]", x)) for x in block)
            if tuple(block) in raw:
                out.append((i, raw[tuple(block)], True))
            elif form in forms:
                out.append((i, forms[form], False))
            else:
                raw[tuple(block)] = forms[form] = i
        return out[:5]

    rng = random.Random(6)
    parts = ["total = a + 1", "count = b + 2", "for x in y:", "for z in w:", "", "return total", "print(é)"]
    codes = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(4, 25))) for _ in range(80)]
    out = clones.duplicate_blocks(_subs(spark, *codes), keywords=clones.keywords_of(F.col("language"))).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.i):
        got.setdefault(r.submission_id, []).append((r.i, r.leader, r.exact))
    for i, c in enumerate(codes):
        assert got.get(str(i), []) == search(c, set(keyword.kwlist)), c


def test_ingest(spark):
    raw = spark.createDataFrame([("a", None, None, "def f():\n    return 1\n"), ("b", "", None, "public class A { void f() {} }"), ("c", None, None, "x + 1"), ("d", None, "Python", " \n"), ("e", None, "Python", "x" * 20_001), ("f", "g.py", "Python", "def f(:\n"), ("g", None, "Java", "class A {"), ("h", None, "Perl", "x")], schemas.SUBMISSIONS_RAW)
    good = {r.submission_id: r for r in ingest.ingest_texts(raw).collect()}
    assert {k: (r.filename, r.language, r.language_auto_detected, r.syntax_valid) for k, r in good.items()} == {"a": ("pasted-snippet", "Python", True, True), "b": ("pasted-snippet", "Java", True, True), "f": ("g.py", "Python", False, False), "g": ("pasted-snippet", "Java", False, False)}
    assert good["g"].syntax_error == "Unclosed '{' (line 1)" and good["f"].syntax_error_line == 1
    assert {r.submission_id: r.problem for r in ingest.rejected_texts(raw).collect()} == {"c": "language is unclear", "d": "code is blank", "e": "code is too long", "h": "language is unknown"}
    files = spark.createDataFrame([("a", "A.JAVA", None, "x" * 30_000), ("b", "b.py", None, ""), ("c", "c.txt", None, "x")], schemas.SUBMISSIONS_RAW)
    assert {(r.submission_id, r.language, r.code_length) for r in ingest.response(ingest.accepted_files(files)).collect()} == {("a", "Java", 20_000), ("b", "Python", 0)}


def test_quality_scores(spark):
    subs = _subs(spark, "def f(x):\n    if x:\n        return 1\n    return 2\n", "def broken(:\n", "x = 1\n", "")
    scores, found = scoring.analyze_code(subs)
    got = {r.submission_id: (r.quality_score, r.maintainability_score, r.complexity_score, r.average_cyclomatic_complexity) for r in scores.collect()}
    assert got == {"0": (98, 100, 95, 2.0), "1": (90, 90, 90, None), "2": (95, 100, 90, None), "3": (95, 100, 90, None)}
    assert all(r.source == "static_analysis" for r in found.collect())
    assert all(r.analyzed_at is not None for r in scores.collect())
    assert {r.submission_id: r.maintainability_index is None for r in scores.collect()} == {"0": False, "1": True, "2": False, "3": False}


def test_registered_query_shows_every_unused_import(spark, monkeypatch):
    from quarry.plans import catalogue

    raw = spark.createDataFrame([("1", "a.py", "Python", "import json\nfrom os import path, sep\nprint(sep)\n")], "submission_id string, filename string, language string, code string")
    monkeypatch.setattr(catalogue, "submissions_raw", lambda spark, sf_dir: raw)
    assert sorted((r.name, r.line) for r in catalogue.python_unused_imports(spark, "").collect()) == [("json", 1), ("path", 2)]
