"""Source code derived from the driver's tables: each order becomes a submission, by a
template that its key chooses and with the key in its text.

The same text can be built by SQL (``CODE_SQL``), so queries over it have oracles. The
expected facts about the Python templates stand beside them, counted by hand.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``functions``: (name, line, span, cyclomatic, cognitive, parameters) of each function.
    ``imports``: unused ones (name, line). ``variables``, ``numbers``: unused and magic ones, as
    (text, line of the function). ``names``: badly named (name, line, suggestion). ``classes``: (name,
    line, span, methods, abstract methods, abstract base, names of the classes that it makes).
    ``halstead``: tokens and distinct tokens. ``error``: message and line of what does not parse
    or balance."""

    filename: str | None
    language: str | None
    code: str
    functions: tuple = ()
    imports: tuple = ()
    variables: tuple = ()
    numbers: tuple = ()
    names: tuple = ()
    classes: tuple = ()
    halstead: tuple | None = None
    error: tuple | None = None
    rejected: str | None = None
    tags: tuple = field(default=())


PY, JV = "Python", "Java"
_METHODS = "\n".join(f"    public int get{i}() {{\n        return {i};\n    }}" for i in range(17))
_LONG = "\n".join(f"    x = x + {i % 3}" for i in range(44))

TEMPLATES = (
    # One template for each rule.
    Template("db.py", PY, 'def load_~(cur, uid):\n    cur.execute(f"SELECT * FROM t WHERE id = {uid}")\n    return cur\n', (("load_~", 1, 3, 1, 0, 2),), halstead=(9, 6)),
    Template("Db.java", JV, 'public class Db~ {\n    public void run(String id) {\n        Statement s = c.createStatement(); s.executeQuery("SELECT " + id);\n    }\n}\n'),
    Template("shell.py", PY, "import os\n\ndef run_~(cmd):\n    os.system(cmd)\n    return 0\n", (("run_~", 3, 3, 1, 0, 1),), halstead=(7, 6)),
    Template("Sh.java", JV, 'class Sh~ {\n    void go(String a) {\n        Runtime.getRuntime().exec("ls " + a);\n    }\n}\n'),
    Template(None, None, 'password = "hunter2~hunter"\nprint("~")\n', halstead=(6, 6)),
    Template("pk.py", PY, "import pickle, yaml\n\ndef read_~(data):\n    a = yaml.load(data, Loader=yaml.SafeLoader)\n    b = pickle.loads(data)\n    return a, yaml.load(data)\n", (("read_~", 3, 4, 1, 0, 1),), variables=(("b", 3),), halstead=(18, 9)),
    Template("Des.java", JV, "class Des~ {\n    Object get(java.io.InputStream in) {\n        return new ObjectInputStream(in).readObject();\n    }\n}\n"),
    Template("cr.py", PY, "import hashlib\n\ndef digest_~(x):\n    return hashlib.md5(x)\n", (("digest_~", 3, 2, 1, 0, 1),), halstead=(6, 5)),
    Template("Cr.java", JV, 'class Cr~ {\n    void c() {\n        Cipher.getInstance("DES/CBC");\n    }\n}\n'),
    Template("pw.py", PY, "import hashlib\n\ndef store_~(password):\n    return hashlib.sha1(password.encode())\n", (("store_~", 3, 2, 1, 0, 1),), halstead=(7, 5)),
    Template("Pw.java", JV, 'class Pw~ {\n    byte[] h(String password) {\n        return MessageDigest.getInstance("MD5").digest(password.getBytes());\n    }\n}\n'),
    Template("au.py", PY, 'def check_~(password):\n    if password == "secret":\n        return True\n    return False\n', (("check_~", 1, 4, 2, 1, 1),), halstead=(10, 8)),
    Template("Au.java", JV, "class Au~ {\n    boolean ok(String a) {\n        return a.equals(password);\n    }\n}\n"),
    Template("ssrf.py", PY, 'import requests\n\ndef fetch_~(request):\n    return requests.get(request.args["u"])\n', (("fetch_~", 3, 2, 1, 0, 1),), halstead=(7, 6)),
    Template("Ss.java", JV, 'class Ss~ {\n    void f() {\n        new URL(request.getParameter("u"));\n    }\n}\n'),
    Template("pt.py", PY, 'def show_~(request):\n    return open(request.args["f"])\n', (("show_~", 1, 2, 1, 0, 1),), halstead=(7, 6)),
    Template("Pt.java", JV, 'class Pt~ {\n    void f() {\n        new File(req.getParameter("p"));\n    }\n}\n'),
    Template("up.py", PY, 'def save_~(request, p):\n    request.files["f"].save(p)\n', (("save_~", 1, 2, 1, 0, 2),), halstead=(7, 5)),
    Template("Up.java", JV, "class Up~ {\n    void f(M m) {\n        m.transferTo(new File(n));\n    }\n}\n"),
    Template("cs.py", PY, "@csrf_exempt\ndef view_~(request):\n    return request\n", (("view_~", 2, 2, 1, 0, 1),), halstead=(5, 4)),
    Template("Cs.java", JV, "class Cs~ {\n    void f(H http) {\n        http.csrf().disable();\n    }\n}\n"),
    Template("se.py", PY, "SESSION_COOKIE_SECURE = False\nSESSION_COOKIE_HTTPONLY = False\nKEY_~ = 1\n", halstead=(9, 6)),
    Template("Se.java", JV, "class Se~ {\n    void f(C c) {\n        c.setHttpOnly(false);\n    }\n}\n"),
    Template("lo.py", PY, 'def log_~(password):\n    print("login", password)\n', (("log_~", 1, 2, 1, 0, 1),), halstead=(6, 5)),
    Template("xs.py", PY, "def page_~(x):\n    return mark_safe(x)\n", (("page_~", 1, 2, 1, 0, 1),), halstead=(6, 5)),
    # Many matches: the limit for each rule, and lines that are near enough to merge or not.
    Template("many.py", PY, "import os\nos.system(a)\nos.system(b)\nos.system(c)\nos.system(d)\nos.system(e)\n# ~\n", halstead=(15, 7)),
    Template("near.py", PY, "hashlib.md5(a)\n# ~\n#\nhashlib.md5(b)\n#\n#\nhashlib.sha1(c)\npassword = 'abcdefgh1'\n\n\n\n\npassword = 'abcdefgh2'\n", halstead=(15, 9)),
    # Clean, broken and unclear sources.
    Template("clean.py", PY, 'def add_~(a, b):\n    """Sum."""\n    return a + b\n', (("add_~", 1, 3, 1, 0, 2),), halstead=(8, 6)),
    Template("Clean.java", JV, "public class Clean~ {\n    public int twice(int a) {\n        return a + a;\n    }\n}\n"),
    Template("bad.py", PY, "x = 1\ndef broken_~(:\n    pass\n", error=("invalid syntax", 2)),
    Template("Bad.java", JV, "class Bad~ {\n    void f() {\n        g(1;\n    }\n}\n", error=("Unexpected '}' — expected ')'", 4)),
    Template(None, None, "value_~ + 1\n", rejected="language is unclear"),
    Template("deep.py", PY, "def deep_~(a, b, c, d, e, f, g):\n    if a:\n        if b:\n            if c:\n                if d and e:\n                    for x in f:\n                        while g:\n                            a = 7\n    return a\n", (("deep_~", 1, 9, 8, 22, 7),), variables=(("x", 1),), halstead=(28, 16)),
    Template("long.py", PY, "def long_~(self, x):\n" + _LONG + "\n    if x > 42:\n        return f(x, 3.5, 99)\n    return x\n", (("long_~", 1, 48, 2, 1, 1),), numbers=(("42", 1), ("3.5", 1)), halstead=(235, 16)),
    Template("twin.py", PY, "def one_~(items):\n    total = 0\n    for item in items:\n        total += item.price\n    return total\n\ndef two_~(items):\n    total = 0\n    for item in items:\n        total += item.price\n    return total\n\ndef three_~(rows):\n    count = 0\n    for row in rows:\n        count += row.price\n    return count\n", (("one_~", 1, 5, 2, 1, 1), ("two_~", 7, 5, 2, 1, 1), ("three_~", 13, 5, 2, 1, 1)), halstead=(39, 12)),
    Template("Fat.java", JV, "interface Fat~ {\n" + "".join(f"    void m{i}(int a);\n" for i in range(8)) + "}\n"),
    Template("God.java", JV, "import java.util.List;\nimport java.util.Map;\n\npublic class God~ {\n    private List items = new Foo(new Bar(), new Baz(), new Qux());\n" + _METHODS + "\n}\n"),
    Template("names.py", PY, "import os\nimport sys as system\nfrom json import dumps, loads\n__all__ = ['loads']\n\nclass badClass:\n    def GetValue_~(self):\n        unused = 1\n        _hidden = 2\n        total = 0\n        total += 1\n        return os.name\n", (("GetValue_~", 7, 6, 1, 0, 0),), (("system", 2), ("dumps", 3)), (("unused", 7),), names=(("badClass", 6, None), ("GetValue_~", 7, "get_value_~")), classes=(("badClass", 6, 7, 1, 0, False, ""),), halstead=(20, 15)),
    Template("solid.py", PY, "from abc import ABC, abstractmethod\n\nclass Wide(ABC):\n" + "".join(f"    @abstractmethod\n    def m{i}(self):\n        return Thing{i % 5}(~)\n" for i in range(8)), tuple((f"m{i}", 5 + 3 * i, 2, 1, 0, 0) for i in range(8)), numbers=tuple(("~", 5 + 3 * i) for i in range(8)), classes=(("Wide", 3, 25, 8, 8, True, "Thing0, Thing1, Thing2, Thing3, Thing4"),), halstead=(58, 13)),
    Template(None, PY, " \n\t\n", rejected="code is blank"),
    Template("huge.py", PY, "#HUGE~", rejected="code is too long"),
)
HUGE_LINE, HUGE_TIMES = "x = 1\n", 4_000


def submissions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(submission_id, filename, language, code) of every order, as SUBMISSIONS_RAW.

    A key of eight bytes becomes a whole source: keys are dealt over the cores before that."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    orders = orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    key, at = F.col("o_orderkey").cast("string"), (F.pmod("o_orderkey", F.lit(len(TEMPLATES))) + 1).cast("int")
    one = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    code = F.replace(one([t.code for t in TEMPLATES]), F.lit("~"), key)
    code = F.when(F.startswith(code, F.lit("#HUGE")), F.repeat(F.lit(HUGE_LINE), F.lit(HUGE_TIMES))).otherwise(code)
    return orders.select(key.alias("submission_id"), one([t.filename for t in TEMPLATES]).alias("filename"), one([t.language for t in TEMPLATES]).alias("language"), code.alias("code"))


def quoted(x) -> str:
    if x is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def with_function(t: Template, facts: tuple) -> list[tuple]:
    """(function, line, text) for what stands beside the line of its function."""
    named = {line: name for name, line, *_ in t.functions}
    return [(named[line], line, text) for text, line in facts]


#: The same table for DuckDB, as the start of a WITH clause.
CODE_SQL = (
    "WITH template(tpl, filename, language, code) AS (VALUES "
    + ", ".join(f"({i}, {quoted(t.filename)}, {quoted(t.language)}, {quoted(t.code)})" for i, t in enumerate(TEMPLATES))
    + f"), raw AS (SELECT CAST(o_orderkey AS VARCHAR) AS submission_id, o_orderkey, tpl, filename, language, CASE WHEN code LIKE '#HUGE%' THEN repeat({quoted(HUGE_LINE)}, {HUGE_TIMES}) ELSE replace(code, '~', CAST(o_orderkey AS VARCHAR)) END AS code"
    + f" FROM orders JOIN template ON o_orderkey % {len(TEMPLATES)} = tpl)"
)


def expected_sql(rows: list[tuple], names: list[str]) -> str:
    """SQL of expected rows by template: (template, values...), ``~`` in texts standing for the key."""
    values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    columns = ", ".join(f"replace({n}, '~', submission_id) AS {n}" if any(isinstance(r[i + 1], str) for r in rows) else f"{n}" for i, n in enumerate(names))
    return f"{CODE_SQL}, expected(template_at, {', '.join(names)}) AS (VALUES {values}) SELECT submission_id, {columns} FROM raw JOIN expected ON tpl = template_at"
