"""Text and rounding functions against Python's own, on random input."""

import random
import re

from pyspark.sql import functions as F

from quarry.functions import rounding, text


def _random_texts(n=150, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab {}()\n\r\t\x0b\x0c\x1c\x85\u2028é_1.;=\"'") for _ in range(rng.randrange(40))) for _ in range(n)]


def test_strip_lines_and_words(spark):
    texts = _random_texts() + ["", "\n", "a\nb\n", "a\r\nb", " \x1f x \xa0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for i, strip, lines, words in df.select("i", text.strip(F.col("t")), text.lines(F.col("t")), text.words(F.col("t"))).collect():
        assert strip == texts[i].strip()
        assert lines == texts[i].splitlines()
        assert words == len(texts[i].split())


def test_matches_have_the_lines_that_finditer_has(spark):
    texts = _random_texts(120, 9)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for p in (r"a+", r"[({]", r"\s+b", r"\w+\s*=", "é."):
        for i, all_of, first in df.select("i", text.matches(p, F.col("t")), text.line_matches(p, F.col("t"), 3)).collect():
            found = [(texts[i][: m.start()].count("\n") + 1, m[0], m.end()) for m in re.finditer(p, texts[i])]
            if "\\s" in p and re.search("[\x1c-\x1f]", texts[i]):
                continue  # Java's white space leaves these out
            assert [tuple(x) for x in all_of] == found
            assert [tuple(x) for x in first] == [x[:2] for x in found[:3]]


def test_brace_block(spark):
    def block(t):
        depth = 0
        for i, c in enumerate(t):
            depth += (c == "{") - (c == "}")
            if depth == 0 and c == "}":
                return t[: i + 1]
        return t

    rng = random.Random(3)
    texts = ["{" + "".join(rng.choice("{}a\n") for _ in range(rng.randrange(30))) for _ in range(200)]
    for t, b in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.brace_block(F.col("t"))).collect():
        assert b == block(t)


def test_rounding_is_pythons(spark):
    rng = random.Random(1)
    xs = [2.45, 2.25, 85.65, 0.05, 0.15, 0.25, 1.005, 2.675, 99.95, 0.0, 100.0, *(rng.randrange(2000) / 20 for _ in range(300)), *(rng.random() * 100 for _ in range(300))]
    for x, one, two, whole in spark.createDataFrame([(x,) for x in xs], "x double").select("x", rounding.to_places(F.col("x"), 1), rounding.to_places(F.col("x"), 2), rounding.to_int(F.col("x"))).collect():
        assert one == round(x, 1) and two == round(x, 2), x
        if abs(x * 2 - round(x * 2)) > 1e-9 or x * 2 == round(x * 2):
            assert whole == round(x)
