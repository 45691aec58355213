"""DuckDB SQL for the queries of the catalogue.

What the parse tree of a Python source holds is beyond SQL: there the expected rows of
the sample templates, counted by hand, stand for it.
"""

from __future__ import annotations

import keyword
import re

from quarry import config
from quarry.operators import ingest, java_checks, rules
from quarry.operators.wording import WORDING
from quarry.plans.samples import CODE_SQL, TEMPLATES, expected_sql, quoted, with_function

SPACE = r"[\s\x1c-\x1f]"
_NEWLINES = "(length({0}) - length(replace({0}, chr(10), '')))"


def _case(column: str, table: dict, other) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def _count(pattern: str, column: str) -> str:
    return f"len(regexp_extract_all({column}, {quoted(pattern)}))"


def _strip(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '^[\\s\\x0b]+', ''), '[\\s\\x0b]+$', '')"


PYTHON_SCORE, JAVA_SCORE = _count(ingest.PYTHON_SIGNALS, "code"), _count(ingest.JAVA_SIGNALS, "code")
DETECTED = f"CASE WHEN {PYTHON_SCORE} = 0 AND {JAVA_SCORE} = 0 THEN NULL WHEN {PYTHON_SCORE} >= {JAVA_SCORE} THEN 'Python' ELSE 'Java' END"
PROBLEM = f"""CASE WHEN code IS NULL OR code = '' THEN 'code is empty' WHEN length(code) > {config.MAX_CODE_CHARS} THEN 'code is too long' WHEN NOT regexp_matches(code, '\\S') THEN 'code is blank'
  WHEN language NOT IN ('Python', 'Java') THEN 'language is unknown' WHEN coalesce(language, {DETECTED}) IS NULL THEN 'language is unclear' END"""
ACCEPTED = f"""{CODE_SQL}, judged AS (SELECT *, {DETECTED} AS detected, {PROBLEM} AS problem FROM raw),
accepted AS (SELECT submission_id, o_orderkey, tpl, coalesce(nullif(filename, ''), '{config.DEFAULT_FILENAME}') AS filename, coalesce(language, detected) AS language, code, language IS NULL AS language_auto_detected FROM judged WHERE problem IS NULL)"""

# RE2 has no lookahead: a load with the safe loader behind it on its line is blotted out beforehand, at equal length.
_SAFE = r"regexp_replace(code, 'yaml\.load(\s*\([^\n]*SafeLoader)', 'yaml_load\1', 'g')"
_RULES = _values([(i, r.category, r.language, r.pattern.replace(r"\s*\((?!.*SafeLoader)", r"\s*\("), r.severity, r.confidence) for i, r in enumerate(rules.RULES, 1)])
_CATEGORIES = _values([(c, o, w) for c, (o, w) in rules.CATEGORIES.items()])
RISK = f"round(CASE WHEN category IN ({', '.join(map(quoted, rules.HIGH_IMPACT))}) THEN least(10.0, {_case('severity', config.BASE_RISK, config.OTHER_RISK)} + 0.6) ELSE {_case('severity', config.BASE_RISK, config.OTHER_RISK)} END, 1)"
FOUND = f"""{ACCEPTED}, rule(rule_seq, category, rule_language, pattern, severity, confidence) AS {_RULES}, category(category, owasp_category, cwe_id) AS {_CATEGORIES},
text AS (SELECT submission_id, language, code, {_SAFE} AS safe FROM accepted),
hit AS (SELECT submission_id, rule_seq, category, severity, confidence, code, CASE WHEN rule_seq = 6 THEN safe ELSE code END AS scanned, pattern
  FROM text JOIN rule ON rule_language = 'both' OR rule_language = lower(language)),
piece AS (SELECT *, regexp_extract_all(scanned, pattern) AS m, regexp_split_to_array(scanned, pattern) AS p FROM hit WHERE regexp_matches(scanned, pattern)),
one AS (SELECT *, unnest(range(1, least(len(m), {config.MATCHES_PER_RULE}) + 1)) AS k FROM piece),
finding AS (SELECT submission_id, CAST(rule_seq * 10 + k - 1 AS BIGINT) AS seq, category, severity, CAST(confidence AS DOUBLE) AS confidence_score, left({_strip('m[k]')}, 200) AS evidence,
  CAST(1 + {_NEWLINES.format("(array_to_string(p[1:k], '') || array_to_string(m[1:k-1], ''))")} AS INTEGER) AS line_number FROM one)"""
FINDING_COLUMNS = f"submission_id, seq, category || ' risk detected' AS title, severity, category, owasp_category, cwe_id, CAST({RISK} AS DOUBLE) AS risk_score, confidence_score, evidence, line_number"

RULE_FINDINGS = "SELECT submission_id, seq, category, severity, confidence_score, evidence, line_number, 'static_rules' AS source FROM finding"


def _merged(findings: str, rows: str) -> str:
    """The greedy fold of ``rows``, finding by finding: the state is the list of the groups' first lines."""
    near = f"(l IS NULL AND x.line_number IS NULL) OR coalesce(abs(l - x.line_number) <= {config.NEAR_LINES}, false)"
    return f"""{findings.replace("WITH template", "WITH RECURSIVE template", 1)},
numbered AS (SELECT *, row_number() OVER (PARTITION BY submission_id, category ORDER BY seq) AS n FROM ({rows})),
fold AS (
  SELECT submission_id, category, n, seq, [line_number] AS leaders, CAST(1 AS BIGINT) AS grp FROM numbered WHERE n = 1
  UNION ALL
  SELECT submission_id, category, n, seq, CASE WHEN hit > 0 THEN leaders ELSE list_append(leaders, line_number) END,
    CASE WHEN hit > 0 THEN hit ELSE len(leaders) + 1 END
  FROM (SELECT x.*, f.leaders, coalesce(list_position(list_transform(f.leaders, lambda l: {near}), true), 0) AS hit
        FROM fold f JOIN numbered x ON x.submission_id = f.submission_id AND x.category = f.category AND x.n = f.n + 1)),
grouped AS (SELECT x.*, f.grp, {_case("severity", config.SEVERITY_RANK, 0)} AS rank
  FROM numbered x JOIN fold f USING (submission_id, category, n)),
pieces AS (SELECT submission_id, category, grp, evidence, min(seq) AS place FROM grouped WHERE evidence <> '' GROUP BY ALL),
joined AS (SELECT submission_id, category, grp, string_agg(evidence, ' | ' ORDER BY place) AS evidence FROM pieces GROUP BY ALL),
kinds AS (SELECT submission_id, category, grp, source, min(seq) AS place FROM grouped GROUP BY ALL),
origins AS (SELECT submission_id, category, grp, string_agg(source, ',' ORDER BY place) AS merged_from FROM kinds GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY submission_id, category, grp ORDER BY rank DESC, confidence_score DESC, seq) AS place,
  count(*) OVER (PARTITION BY submission_id, category, grp) AS members, min(seq) OVER (PARTITION BY submission_id, category, grp) AS first_seq FROM grouped),
merged AS (SELECT b.submission_id, b.first_seq AS seq, b.category, severity, line_number,
  CASE WHEN members > 1 THEN least(1.0, confidence_score + CAST({config.AGREEMENT_BONUS} AS DOUBLE)) ELSE confidence_score END AS confidence_score,
  CASE WHEN members > 1 THEN coalesce(j.evidence, '') ELSE b.evidence END AS evidence,
  CASE WHEN members > 1 THEN 'merged' ELSE source END AS source, CASE WHEN members > 1 THEN merged_from ELSE '' END AS merged_from
  FROM best b LEFT JOIN joined j USING (submission_id, category, grp) JOIN origins USING (submission_id, category, grp) WHERE place = 1)"""


MERGED = _merged(FOUND, RULE_FINDINGS)
SCORES = f"""{MERGED}, cost AS (SELECT submission_id, sum({_case('severity', config.SECURITY_PENALTY, config.OTHER_SECURITY_PENALTY)}) AS cost, max({RISK}) AS risk, count(*) AS n FROM merged GROUP BY submission_id)"""


def _templates(value) -> list[tuple]:
    return [(i, *row) for i, t in enumerate(TEMPLATES) for row in value(t)]


_java_rows = f"""{ACCEPTED}, j AS (SELECT submission_id, code FROM accepted WHERE language <> 'Python')"""


def _found(pattern: str) -> str:
    """Matches of a pattern with one group in Java sources: line, name, end."""
    p = quoted(pattern)
    return f"""{_java_rows}, a AS (SELECT *, regexp_extract_all(code, {p}) AS m, regexp_extract_all(code, {p}, 1) AS g, regexp_split_to_array(code, {p}) AS p FROM j),
b AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM a),
c AS (SELECT submission_id, code, k, m[k] AS match, g[k] AS name, list_reduce(list_prepend('', list_transform(range(1, k + 1), lambda x: p[x] || CASE WHEN x < k THEN m[x] ELSE '' END)), lambda x, y: x || y) AS before FROM b),
found AS (SELECT submission_id, code, k, match, name, CAST(1 + {_NEWLINES.format('before')} AS INTEGER) AS line, length(before) + length(match) AS stop FROM c)"""


def _with_body(found: str, start: str) -> str:
    """Adds ``body`` to found rows; the running depth comes from a window over characters."""
    return f"""{found}, rest AS (SELECT *, {start} AS rest FROM found), ch AS (SELECT submission_id, k, z, sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY submission_id, k ORDER BY z) AS depth, c
  FROM (SELECT submission_id, k, unnest(range(1, length(rest) + 1)) AS z, unnest(string_split(rest, '')) AS c FROM rest WHERE rest <> '')),
closed AS (SELECT submission_id, k, min(z) AS z FROM ch WHERE depth = 0 AND c = '}}' GROUP BY ALL),
bodied AS (SELECT r.*, CASE WHEN rest = '' THEN NULL WHEN z IS NULL THEN rest ELSE left(rest, z) END AS body FROM rest r LEFT JOIN closed USING (submission_id, k))"""


_first_brace = "CASE WHEN position('{' IN substr(code, stop + 1)) > 0 THEN substr(code, stop + position('{' IN substr(code, stop + 1))) ELSE '' END"
_cognitive = f"""(SELECT CAST(coalesce(sum(1 + greatest(d - 1, 0)), 0) AS INTEGER) FROM (SELECT unnest(list_transform(range(1, len(regexp_split_to_array(body, {quoted(java_checks.NESTING)}))),
  lambda q: length(replace(array_to_string(regexp_split_to_array(body, {quoted(java_checks.NESTING)})[1:q], ''), '}}', '')) - length(replace(array_to_string(regexp_split_to_array(body, {quoted(java_checks.NESTING)})[1:q], ''), '{{', '')))) AS d))"""
METHODS = _with_body(_found(java_checks.METHOD), "substr(code, stop)")
CLASSES = _with_body(_found(java_checks.CLASS), _first_brace)
INTERFACES = _with_body(_found(java_checks.INTERFACE), _first_brace)
_inside = r"regexp_extract(match, '(?s)\A[^(]*\((.*)\)[^)]*\z', 1)"

_CONTENT = f"{_strip('replace(coalesce(text, %s), chr(10), chr(10) || chr(10))')}" % "''"
_LINES = "CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END"
_WORDS = r"len(regexp_extract_all(content, '[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"
KNOWLEDGE = f"WITH RECURSIVE k AS (SELECT doc_id, source, lang, {_CONTENT} AS content FROM documents)"


def _chunks(size: int, overlap: int) -> str:
    tail = f"CASE WHEN length(held) > {overlap} THEN right(held, {overlap}) ELSE held END" if overlap else "held"
    return f"""{KNOWLEDGE}, para AS (SELECT doc_id, source, lang, list_filter(list_transform(regexp_split_to_array(content, '\\n\\s*\\n'), lambda p: {_strip('p')}), lambda p: p <> '') AS ps FROM k),
step AS (
  SELECT doc_id, source, lang, ps, CAST(0 AS BIGINT) AS n, '' AS held, CAST(NULL AS VARCHAR) AS flushed FROM para
  UNION ALL
  SELECT doc_id, source, lang, ps, n + 1, CASE WHEN fits THEN joined ELSE begun END, CASE WHEN fits THEN NULL ELSE nullif({_strip('held')}, '') END
  FROM (SELECT *, length(joined) <= {size} AS fits FROM (SELECT *, CASE WHEN held = '' THEN ps[n + 1] ELSE held || chr(10) || chr(10) || ps[n + 1] END AS joined,
        CASE WHEN {tail} = '' THEN ps[n + 1] ELSE {tail} || chr(10) || chr(10) || ps[n + 1] END AS begun FROM step WHERE n < len(ps)))),
out AS (SELECT doc_id, source, lang, n, flushed AS text FROM step WHERE flushed IS NOT NULL UNION ALL SELECT doc_id, source, lang, n + 1, {_strip('held')} FROM step WHERE n = len(ps) AND {_strip('held')} <> ''),
chunk AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS chunk_index FROM out)"""


_EVENT = """WITH e AS (SELECT event_id, user_id, event_type, event_id % 8 AS kind, CASE WHEN (event_id // 8) % 2 = 0 THEN 'code' ELSE 'security' END AS agent FROM events)"""
_FIELDS = "CAST(event_id AS VARCHAR) AS submission_id, 'T' || event_id AS title, 'd ' || event_type AS description, CASE kind WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE 'Medium' END AS severity"
_LINE = "CAST(CASE kind WHEN 0 THEN 3 WHEN 1 THEN 4 END AS INTEGER) AS line_number, CAST(CASE kind WHEN 0 THEN 0.9 WHEN 1 THEN 1.0 ELSE 0.6 END AS DOUBLE) AS confidence_score"

def _clones(rows: str, key: str, word: str, keywords: str) -> str:
    """Duplicate blocks of (key, text): a name stands as the place where its window first has it."""
    tokens = " || [chr(10)] || ".join(f"regexp_extract_all(block[{i}], '{word}+|[^{word[1:-1]}\\s]')" for i in range(1, 5))
    name = f"regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_]*$') AND NOT list_contains(CASE WHEN {keywords} THEN [{', '.join(map(quoted, keyword.kwlist))}] ELSE [] END, t)"
    return f"""{rows}, lines AS (SELECT *, list_transform({_LINES}, lambda x: {_strip('x')})[1:{config.CLONE_SCANNED_LINES}] AS ls FROM src),
w AS (SELECT *, unnest(range(0, len(ls) - 3)) AS i FROM lines WHERE len(ls) >= 4), b AS (SELECT *, ls[i + 1:i + 4] AS block FROM w),
f AS (SELECT *, {tokens} AS flat FROM b WHERE length(array_to_string(block, '')) >= {config.CLONE_LEAST_CHARS}),
g AS (SELECT *, array_to_string(block, chr(10)) AS raw, array_to_string(list_transform(flat, lambda t: CASE WHEN regexp_matches(t, '^\\d+$') THEN 'NUM' WHEN {name} THEN 'V' || list_position(flat, t) ELSE t END), ' ') AS form FROM f),
h AS (SELECT *, first_value(i) OVER (PARTITION BY {key}, form ORDER BY i) AS leader, first_value(raw) OVER (PARTITION BY {key}, form ORDER BY i) AS leader_raw FROM g),
clone AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i) AS place FROM h WHERE i <> leader) WHERE place <= {config.CLONE_FINDINGS})"""


DOCUMENT_CLONES = _clones("WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)", "doc_id", r"[\p{L}\p{M}\p{Nd}\p{Pc}]", "false")
CODE_CLONES = _clones(f"{ACCEPTED}, src AS (SELECT submission_id, language, code AS text FROM accepted)", "submission_id", r"[\w]", "language = 'Python'")

_CODE_REPLIES = f"""SELECT {_FIELDS}, CASE kind WHEN 0 THEN 'SQL Injection' WHEN 1 THEN 'Made Up' WHEN 2 THEN 'Performance' ELSE 'Maintainability' END AS category, {_LINE} FROM e WHERE agent = 'code' AND kind IN (0, 1, 2, 5)"""
_SECURITY_REPLIES = f"""SELECT {_FIELDS}, CASE kind WHEN 0 THEN 'SQL Injection' ELSE 'Missing Input Validation' END AS category, CASE kind WHEN 0 THEN 'CWE-89' ELSE 'CWE-20' END AS cwe_id, 'e' || user_id AS evidence, {_LINE} FROM e WHERE agent = 'security' AND kind IN (0, 1, 2, 5)"""
MERGED_WITH_REPLIES = _merged(
    f"{FOUND}, {_EVENT.removeprefix('WITH ')}, reply AS ({_SECURITY_REPLIES})",
    f"""{RULE_FINDINGS} UNION ALL SELECT submission_id, 1000001 AS seq, category, severity, confidence_score, evidence, line_number, 'llm_semantic' AS source
  FROM reply JOIN accepted USING (submission_id)""",
)


def _table(name: str, columns: list[str], rows: list[tuple]) -> str:
    return f"{name}(tpl, {', '.join(columns)}) AS {_values(rows)}"


def _numbered(value) -> list[tuple]:
    """Rows of all templates with their place among those of their template."""
    return [(i, k, *row) for i, t in enumerate(TEMPLATES) for k, row in enumerate(value(t))]


def _own(text: str) -> str:
    return f"replace({text}, '~', submission_id)"


def _report(source: str, place: str, at: str, wording: str, /, **values: str) -> str:
    """Findings of the rows of ``source`` (and their WHERE), ``place`` ordering them."""

    def filled(template: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: f"' || {values[m[1]]} || '", quoted(template))

    w = WORDING[wording]
    return f"""SELECT submission_id, {place} AS place, {filled(w.title)} AS title, {filled(w.description)} AS description, {quoted(w.severity)} AS severity,
  {quoted(w.category)} AS category, {at} AS line_number, {filled(w.recommendation)} AS recommendation, CAST({w.confidence} AS DOUBLE) AS confidence_score FROM {source}"""


_PY = "accepted JOIN {0} USING (tpl)"
_F = {n: f"CAST({n} AS VARCHAR)" for n in ("span", "cyclomatic", "cognitive", "parameters", "methods", "abstract_methods", "fields")}
_NAME = _own("name")
_java_call = f"CAST(len(list_filter(string_split({_inside}, ','), lambda x: regexp_matches(x, '\\S'))) AS INTEGER)"
JAVA_METHODS = f"""SELECT submission_id, k, name, line, CAST({_NEWLINES.format('body')} + 1 AS INTEGER) AS span, CAST({_count(java_checks.DECISION, 'body')} + 1 AS INTEGER) AS cyclomatic,
  {_cognitive} AS cognitive, {_java_call} AS parameters FROM bodied WHERE name NOT IN ({', '.join(map(quoted, config.JAVA_CONTROL))})"""
JAVA_CLASSES = f"""SELECT submission_id, k, name, line, CAST({_NEWLINES.format('body')} + 1 AS INTEGER) AS span, CAST({_count(java_checks.METHOD, 'body')} AS INTEGER) AS methods,
  CAST({_count(java_checks.FIELD, 'body')} AS INTEGER) AS fields, list_sort(list_filter(list_distinct(regexp_extract_all(body, {quoted(java_checks.CREATED)}, 1)),
  lambda x: x NOT IN ({', '.join(map(quoted, config.JAVA_UTILITIES))}))) AS concrete FROM bodied"""
JAVA_INTERFACES = f"SELECT submission_id, k, name, line, CAST({_count(java_checks.INTERFACE_METHOD, 'body')} AS INTEGER) AS methods FROM bodied WHERE body IS NOT NULL"
JAVA_IMPORTS = f"SELECT submission_id, k, name, line FROM found WHERE len(regexp_extract_all(code, '\\b' || regexp_extract(name, '[^.]*$') || '\\b')) <= 1"
JAVA_VOLUMES = f"""SELECT submission_id, CASE WHEN len(t) = 0 THEN 1.0 ELSE len(t) * log2(len(list_distinct(t))) END AS volume FROM (SELECT submission_id,
  list_filter(regexp_extract_all(code, {quoted(java_checks.TOKEN)}), lambda x: x IN ({', '.join(map(quoted, config.JAVA_OPERATORS))}) OR regexp_matches(x, '^[A-Za-z_]\\w*$') OR regexp_matches(x, '^\\d+$')) AS t FROM j)"""


def _nested(name: str, query: str, rows: str) -> str:
    """A CTE from a query of its own WITH clause, whose parts stay inside."""
    return f"{name} AS ({query} {rows})"


# Brackets of Java sources on a stack, one token a step: texts and comments are left out beforehand.
_HIDDEN = r"""//[^\n]*|/\*(?s:.*?)\*/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""
_OPENS, _CLOSES = "('{', '(', '[')", "('}', ')', ']')"
_POP = "[1:len(held) - 1]"
_WRONG = f"x IN {_CLOSES} AND (len(held) = 0 OR held[len(held)] <> x)"
BALANCE = (
    ACCEPTED.replace("WITH template", "WITH RECURSIVE template", 1)
    + f""",
bracket AS (SELECT submission_id, regexp_extract_all(regexp_replace(code, {quoted(_HIDDEN)}, '', 'g'), {quoted(r"[{}()\[\]\n]")}) AS t FROM accepted WHERE language = 'Java'),
stack AS (
  SELECT submission_id, t, 0 AS n, CAST([] AS VARCHAR[]) AS held, CAST([] AS INTEGER[]) AS held_lines, 1 AS line, CAST(NULL AS VARCHAR) AS wrong FROM bracket
  UNION ALL
  SELECT submission_id, t, n + 1,
    CASE WHEN x IN {_OPENS} THEN list_append(held, {_case("x", {"{": quoted("}"), "(": quoted(")"), "[": quoted("]")}, "NULL")}) WHEN x IN {_CLOSES} THEN held{_POP} ELSE held END,
    CASE WHEN x IN {_OPENS} THEN list_append(held_lines, line) WHEN x IN {_CLOSES} THEN held_lines{_POP} ELSE held_lines END,
    line + CASE WHEN x = chr(10) THEN 1 ELSE 0 END,
    CASE WHEN {_WRONG} THEN 'Unexpected ' || chr(39) || x || chr(39) || ' — expected ' || chr(39) || coalesce(held[len(held)], 'nothing') || chr(39) || ' (line ' || line || ')' END
  FROM (SELECT *, t[n + 1] AS x FROM stack WHERE wrong IS NULL AND n < len(t))),
ended AS (SELECT *, {_case("held[len(held)]", {"}": quoted("{"), ")": quoted("(")}, quoted("["))} AS open, held_lines[len(held)] AS open_line FROM stack WHERE wrong IS NOT NULL OR n = len(t)),
balance AS (SELECT submission_id, wrong IS NULL AND len(held) = 0 AS ok,
  CASE WHEN wrong IS NOT NULL THEN wrong WHEN len(held) > 0 THEN 'Unclosed ' || chr(39) || open || chr(39) || ' (line ' || open_line || ')' END AS error,
  CAST(CASE WHEN wrong IS NOT NULL THEN line WHEN len(held) > 0 THEN open_line END AS INTEGER) AS line FROM ended)"""
)

_EXPECTED = ", ".join((
    _table("py_function", ["k", "name", "line", "span", "cyclomatic", "cognitive", "parameters"], _numbered(lambda t: t.functions)),
    _table("py_number", ["k", "name", "line", "value"], _numbered(lambda t: with_function(t, t.numbers))),
    _table("py_variable", ["k", "name", "line", "variable"], _numbered(lambda t: with_function(t, t.variables))),
    _table("py_name", ["k", "name", "line", "suggestion"], _numbered(lambda t: t.names)),
    _table("py_import", ["k", "name", "line"], _numbered(lambda t: t.imports)),
    _table("py_class", ["k", "name", "line", "span", "methods", "abstract_methods", "abstract_base", "concrete"], _numbered(lambda t: t.classes)),
    _table("py_error", ["message", "line"], [(i, *t.error) for i, t in enumerate(TEMPLATES) if t.error and t.language == "Python"]),
    _table("py_tokens", ["tokens", "vocabulary"], [(i, *t.halstead) for i, t in enumerate(TEMPLATES) if t.halstead]),
))
_CONCRETE = {"number": "CAST(len(concrete) AS VARCHAR)", "concrete": "left(array_to_string(concrete, ', '), 80)"}
_FINDINGS = " UNION ALL ".join((
    _report(_PY.format("py_error"), "[0, 0, 0, 0]", "line", "python_syntax", message="message", line="CAST(line AS VARCHAR)"),
    *(_report(f"{_PY.format('py_function')} WHERE {limit}", f"[1, line, {i}, 0]", "line", wording, **_F, name=_NAME) for i, (wording, limit) in enumerate((
        ("python_long_function", f"span > {config.LONG_METHOD_LINES}"), ("python_cyclomatic", f"cyclomatic > {config.HIGH_CYCLOMATIC}"),
        ("python_cognitive", f"cognitive > {config.HIGH_COGNITIVE}"), ("python_parameters", f"parameters > {config.LONG_PARAMETERS}"),
    ))),
    _report(_PY.format("py_number"), "[1, line, 4, k]", "line", "python_magic_number", name=_NAME, value=_own("value")),
    _report(_PY.format("py_variable"), "[1, line, 5, k]", "line", "python_unused_variable", name=_NAME, variable="variable"),
    _report(f"{_PY.format('py_name')} WHERE suggestion IS NOT NULL", "[2, k, 0, 0]", "line", "python_function_name", name=_NAME, suggestion=_own("suggestion")),
    _report(f"{_PY.format('py_name')} WHERE suggestion IS NULL", "[2, k, 0, 0]", "line", "python_class_name", name=_NAME),
    _report(_PY.format("py_import"), "[3, k, 0, 0]", "line", "python_unused_import", name="name"),
    _report(f"{_PY.format('py_class')} WHERE methods > {config.GOD_CLASS_METHODS} OR span > {config.GOD_CLASS_LINES}", "[4, k, 0, 0]", "line", "python_god_class", **_F, name="name"),
    _report(f"{_PY.format('py_class')} WHERE abstract_base AND abstract_methods > {config.FAT_INTERFACE_METHODS}", "[4, k, 1, 0]", "line", "python_fat_interface", **_F, name="name"),
    _report(f"{_PY.format('py_class')} WHERE len(string_split(concrete, ', ')) > {config.CONCRETE_CLASSES}", "[4, k, 2, 0]", "line", "python_concrete_classes", name="name", number="CAST(len(string_split(concrete, ', ')) AS VARCHAR)", concrete="left(concrete, 80)"),
    _report("jclass WHERE NOT regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$')", "[1, k, 0, 0]", "line", "java_class_name", name="name"),
    _report(f"jclass WHERE methods > {config.GOD_CLASS_METHODS} OR span > {config.GOD_CLASS_LINES}", "[1, k, 1, 0]", "line", "java_god_class", **_F, name="name"),
    _report(f"jclass WHERE len(concrete) > {config.CONCRETE_CLASSES}", "[1, k, 2, 0]", "line", "java_concrete_classes", **_CONCRETE, name="name"),
    _report(f"jinterface WHERE methods > {config.FAT_INTERFACE_METHODS}", "[2, k, 0, 0]", "line", "java_fat_interface", **_F, name="name"),
    *(_report(f"jmethod WHERE {limit}", f"[3, k, {i}, 0]", "line", wording, **_F, name="name") for i, (wording, limit) in enumerate((
        ("java_long_method", f"span > {config.LONG_METHOD_LINES}"), ("java_cyclomatic", f"cyclomatic > {config.HIGH_CYCLOMATIC}"),
        ("java_cognitive", f"cognitive > {config.HIGH_COGNITIVE}"), ("java_parameters", f"parameters > {config.LONG_PARAMETERS}"),
        ("java_method_name", "NOT regexp_matches(name, '^[a-z][a-zA-Z0-9]*$')"),
    ))),
    _report("jimport", "[4, k, 0, 0]", "line", "java_unused_import", name="name"),
    *(_report(f"block WHERE {'' if exact else 'NOT '}exact", "[5, i, 0, 0]", "CAST(i + 1 AS INTEGER)", wording, here="((i + 1) || '-' || (i + 4))", there="((leader + 1) || '-' || (leader + 4))") for exact, wording in ((True, "equal_block"), (False, "alike_block"))),
))
_ANALYSED = ",\n".join((
    ACCEPTED,
    _EXPECTED,
    _nested("jmethod", METHODS, JAVA_METHODS),
    _nested("jclass", CLASSES, JAVA_CLASSES),
    _nested("jinterface", INTERFACES, JAVA_INTERFACES),
    _nested("jimport", _found(java_checks.IMPORT), JAVA_IMPORTS),
    _nested("jvolume", _java_rows, JAVA_VOLUMES),
    f"block AS ({CODE_CLONES} SELECT submission_id, i, leader, raw = leader_raw AS exact FROM clone WHERE submission_id NOT IN (SELECT submission_id FROM accepted JOIN py_error USING (tpl)))",
    f"reported AS ({_FINDINGS})",
    f"""py_function_row AS (SELECT submission_id, cyclomatic, cognitive FROM {_PY.format('py_function')} UNION ALL SELECT submission_id, cyclomatic, cognitive FROM jmethod),
mean AS (SELECT submission_id, CAST(count(*) AS INTEGER) AS functions, avg(cyclomatic) AS cyclomatic, avg(cognitive) AS cognitive FROM py_function_row GROUP BY submission_id),
volume AS (SELECT submission_id, tokens * log2(vocabulary) AS volume FROM {_PY.format('py_tokens')} UNION ALL SELECT submission_id, volume FROM jvolume),
metric AS (SELECT submission_id, a.filename, a.language, CAST(len({_LINES.replace('text', 'code')}) AS INTEGER) AS loc, coalesce(functions, 0) AS functions, cyclomatic, cognitive, volume
  FROM accepted a LEFT JOIN mean USING (submission_id) LEFT JOIN volume USING (submission_id)),
cost AS (SELECT submission_id, sum({_case('severity', config.QUALITY_PENALTY, config.OTHER_QUALITY_PENALTY)}) AS cost FROM reported GROUP BY submission_id)""",
))
_INDEX = "CASE WHEN volume IS NOT NULL THEN CAST(printf('%.1f', greatest(0, least(100, (171 - 5.2 * ln(greatest(volume, 1)) - 0.23 * greatest(coalesce(cyclomatic, 1), 1) - 16.2 * ln(greatest(loc, 1))) * 100 / 171))) AS DOUBLE) END"


def _tenth(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN CAST(printf('%.1f', {c}) AS DOUBLE) END"


_QUALITY = f"""{_ANALYSED}, event AS ({_EVENT} {_CODE_REPLIES}),
more AS (SELECT submission_id, sum({_case('severity', config.QUALITY_PENALTY, config.OTHER_QUALITY_PENALTY)}) AS more FROM event GROUP BY submission_id),
scored AS (SELECT m.*, CAST(CASE WHEN cyclomatic IS NULL THEN {config.NO_FUNCTION_SCORE} ELSE round_even(least(100, greatest(10, 100 - (cyclomatic - 1) * 5)), 0) END AS INTEGER) AS a,
  CAST(greatest(0, 100 - coalesce(cost, 0)) AS INTEGER) AS b, CAST(greatest(0, 100 - coalesce(cost, 0) - coalesce(more, 0)) AS INTEGER) AS c
  FROM metric m LEFT JOIN cost USING (submission_id) LEFT JOIN more USING (submission_id))"""

SQL = {
    "duplicate_blocks": f"{DOCUMENT_CLONES} SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(leader AS INTEGER) AS leader, raw = leader_raw AS exact FROM clone",
    "duplicate_code_blocks": f"{CODE_CLONES} SELECT submission_id, CASE WHEN raw = leader_raw THEN 'Duplicate code block' ELSE 'Structurally duplicate code block' END AS title, CASE WHEN raw = leader_raw THEN 'Medium' ELSE 'Low' END AS severity, CAST(i + 1 AS INTEGER) AS line_number, CAST(CASE WHEN raw = leader_raw THEN 0.9 ELSE 0.72 END AS DOUBLE) AS confidence_score FROM clone",
    "python_function_metrics": expected_sql(_templates(lambda t: t.functions), ["name", "line", "span", "cyclomatic", "cognitive", "parameters"]),
    "python_unused_variables": expected_sql(_templates(lambda t: with_function(t, t.variables)), ["function", "line", "name"]),
    "python_magic_numbers": expected_sql(_templates(lambda t: with_function(t, t.numbers)), ["function", "line", "value"]),
    "security_rule_findings": f"{FOUND} SELECT {FINDING_COLUMNS} FROM finding LEFT JOIN category USING (category)",
    "security_rules_from_table": f"{FOUND} SELECT submission_id, seq, category, evidence, line_number FROM finding",
    "security_rule_counts_by_category": f"{FOUND} SELECT category, severity, count(*) AS findings, count(DISTINCT submission_id) AS submissions FROM finding GROUP BY ALL",
    "security_merged_findings": f"{MERGED} SELECT * FROM merged",
    "security_scores": f"{SCORES} SELECT submission_id, CAST(greatest(0, 100 - coalesce(cost, 0)) AS INTEGER) AS security_score, CAST(coalesce(risk, 0) AS DOUBLE) AS highest_risk, coalesce(n, 0) AS findings FROM accepted LEFT JOIN cost USING (submission_id)",
    "submissions_with_results": f"{SCORES} SELECT r.submission_id, CASE WHEN a.submission_id IS NOT NULL THEN CAST(greatest(0, 100 - coalesce(cost, 0)) AS INTEGER) END AS security_score, CASE WHEN a.submission_id IS NOT NULL THEN 'completed' ELSE 'received' END AS status FROM raw r LEFT JOIN (SELECT * FROM accepted WHERE language = 'Python') a USING (submission_id) LEFT JOIN cost USING (submission_id)",
    "document_secrets": f"""WITH d AS (SELECT doc_id, replace(text, 'token =', 'access_token =') AS code, {quoted(rules.RULES[4].pattern)} AS pattern FROM documents),
piece AS (SELECT *, regexp_extract_all(code, pattern) AS m, regexp_split_to_array(code, pattern) AS p FROM d WHERE regexp_matches(code, pattern)), one AS (SELECT *, unnest(range(1, least(len(m), 3) + 1)) AS k FROM piece)
SELECT doc_id, left({_strip('m[k]')}, 200) AS evidence, CAST(1 + {_NEWLINES.format("(array_to_string(p[1:k], '') || array_to_string(m[1:k-1], ''))")} AS INTEGER) AS line_number FROM one""",
    "risk_scores": f"SELECT category, severity, CAST({RISK} AS DOUBLE) AS risk_score FROM {_values([(c,) for c in rules.CATEGORIES])} AS c(category), {_values([(s,) for s in (*config.SEVERITIES, 'Unknown')])} AS s(severity)",
    "ingest_submissions": f"{ACCEPTED} SELECT submission_id, filename, language, language_auto_detected, CAST(length(code) AS INTEGER) AS code_length FROM accepted",
    "ingest_rejects": f"{ACCEPTED} SELECT submission_id, problem FROM judged WHERE problem IS NOT NULL",
    "ingest_files": f"{CODE_SQL} SELECT submission_id, filename, CASE WHEN lower(filename) LIKE '%.java' THEN 'Java' ELSE 'Python' END AS language, true AS language_auto_detected, CAST(least(length(code), {config.MAX_CODE_CHARS}) AS INTEGER) AS code_length FROM raw WHERE lower(filename) LIKE '%.py' OR lower(filename) LIKE '%.java'",
    "language_detection": f"{CODE_SQL} SELECT submission_id, {DETECTED} AS detected FROM raw",
    "python_syntax_check": expected_sql(_templates(lambda t: [(f"{t.error[0]} (line {t.error[1]})", t.error[1])] if t.error and t.language == "Python" else []), ["syntax_error", "syntax_error_line"]),
    "java_delimiter_check": f"{BALANCE} SELECT submission_id, ok, error, line FROM balance",
    "ingest_checked": f"""{BALANCE}, {_table('py_error', ['message', 'place'], [(i, *t.error) for i, t in enumerate(TEMPLATES) if t.error and t.language == 'Python'])}
SELECT submission_id, filename, language, language_auto_detected, CAST(length(code) AS INTEGER) AS code_length, CASE WHEN language = 'Java' THEN ok ELSE message IS NULL END AS syntax_valid,
  CASE WHEN language = 'Java' THEN error WHEN message IS NOT NULL THEN message || ' (line ' || p.place || ')' END AS syntax_error, CASE WHEN language = 'Java' THEN line ELSE p.place END AS syntax_error_line
FROM accepted a LEFT JOIN balance USING (submission_id) LEFT JOIN py_error p ON p.tpl = a.tpl""",
    "ingest_file_rejects": f"{CODE_SQL}, f AS (SELECT submission_id, CASE WHEN NOT (lower(coalesce(filename, 'notes.txt')) LIKE '%.py' OR lower(coalesce(filename, 'notes.txt')) LIKE '%.java') THEN 'file type is not accepted' WHEN o_orderkey % 7 = 0 THEN 'file is not UTF-8' END AS problem FROM raw) SELECT * FROM f WHERE problem IS NOT NULL",
    "result_lookup": "SELECT user_id, event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 1",
    "results_listed": "SELECT event_id, user_id, value, (SELECT count(*) FROM events) AS total FROM events",
    "submission_status": f"{CODE_SQL} SELECT submission_id, CASE o_orderkey % 5 WHEN 1 THEN 'completed' WHEN 2 THEN 'analyzing' WHEN 3 THEN 'failed' ELSE 'received' END AS status FROM raw",
    "corpus_prepared": f"""{_chunks(config.CHUNK_CHARS, config.CHUNK_OVERLAP)} SELECT '{{"document_count":' || (SELECT count(*) FROM documents) || ',"chunk_count":' || (SELECT count(*) FROM chunk) || '}}' AS manifest""",
    "semantic_code_findings": f"{_EVENT} {_CODE_REPLIES}",
    "semantic_security_findings": f"{_EVENT}, f AS ({_SECURITY_REPLIES}) SELECT *, CAST({RISK} AS DOUBLE) AS risk_score FROM f",
    "latest_result": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "python_naming": expected_sql(_templates(lambda t: t.names), ["name", "line", "suggestion"]),
    "python_unused_imports": expected_sql(_templates(lambda t: t.imports), ["name", "line"]),
    "python_classes": expected_sql(_templates(lambda t: t.classes), ["name", "line", "span", "methods", "abstract_methods", "abstract_base", "concrete"]),
    "java_method_metrics": f"{METHODS} SELECT * EXCLUDE (k) FROM ({JAVA_METHODS})",
    "java_class_checks": f"{CLASSES} SELECT submission_id, name, line, span, methods, fields, array_to_string(concrete, ',') AS concrete FROM ({JAVA_CLASSES})",
    "java_interface_checks": f"{INTERFACES} SELECT * EXCLUDE (k) FROM ({JAVA_INTERFACES})",
    "java_unused_imports": f"{_found(java_checks.IMPORT)} SELECT * EXCLUDE (k) FROM ({JAVA_IMPORTS})",
    "java_halstead": f"{_java_rows} SELECT submission_id, round(volume, 6) AS volume FROM ({JAVA_VOLUMES})",
    "python_halstead": f"{ACCEPTED}, {_table('py_tokens', ['tokens', 'vocabulary'], [(i, *t.halstead) for i, t in enumerate(TEMPLATES) if t.halstead])} SELECT submission_id, round(tokens * log2(vocabulary), 6) AS volume FROM accepted JOIN py_tokens USING (tpl)",
    "code_findings": f"{_ANALYSED} SELECT * EXCLUDE (place), CAST(row_number() OVER (PARTITION BY submission_id ORDER BY place) - 1 AS BIGINT) AS seq, 'static_analysis' AS source FROM reported",
    "code_findings_with_replies": f"""{_ANALYSED}, event AS ({_EVENT} {_CODE_REPLIES}),
both_kinds AS (SELECT submission_id, title, severity, category, line_number, confidence_score, 'static_analysis' AS source FROM reported UNION ALL SELECT submission_id, title, severity, category, line_number, confidence_score, 'llm_semantic' FROM event)
SELECT b.*, filename FROM both_kinds b JOIN accepted USING (submission_id)""",
    "code_file_metrics": f"{_ANALYSED} SELECT submission_id, loc, functions, cyclomatic, cognitive, {_tenth('volume')} AS halstead_volume, {_INDEX} AS maintainability_index FROM metric",
    "code_quality_scores": f"{_QUALITY} SELECT submission_id, filename, language, CAST(round_even((a + b) / 2.0, 0) AS INTEGER) AS quality_score, b AS maintainability_score, a AS complexity_score, {_INDEX} AS maintainability_index, {_tenth('cyclomatic')} AS average_cyclomatic_complexity, {_tenth('cognitive')} AS average_cognitive_complexity FROM scored",
    "code_quality_scores_with_replies": f"{_QUALITY} SELECT submission_id, CAST(round_even((a + c) / 2.0, 0) AS INTEGER) AS quality_score, c AS maintainability_score, a AS complexity_score FROM scored",
    "security_merged_with_replies": f"{MERGED_WITH_REPLIES} SELECT m.* EXCLUDE (seq), filename FROM merged m JOIN accepted USING (submission_id)",
    "maintainability_index": f"WITH d AS (SELECT doc_id, len({_LINES}) AS loc, regexp_extract_all(text, '[A-Za-z]+') AS t FROM documents WHERE length(text) > 0), v AS (SELECT doc_id, CAST(loc AS INTEGER) AS loc, CASE WHEN len(t) > 0 THEN len(t) * log2(len(list_distinct(t))) ELSE 1.0 END AS v FROM d) SELECT doc_id, loc, CAST(printf('%.1f', greatest(0, least(100, (171 - 5.2 * ln(greatest(v, 1)) - 0.23 * 2.5 - 16.2 * ln(greatest(loc, 1))) * 100 / 171))) AS DOUBLE) AS maintainability_index FROM v",
    "scoring_formulas": f"WITH g AS (SELECT l_orderkey, avg(CAST(l_quantity AS BIGINT) % 30 + 1) AS mean, sum({_case('l_returnflag', {'A': 2, 'N': 5, 'R': 10}, 3)}) AS cost FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, CAST(round_even(least(100, greatest(10, 100 - (mean - 1) * 5)), 0) AS INTEGER) AS a, CAST(greatest(0, 100 - cost) AS INTEGER) AS b FROM g) SELECT l_orderkey, a AS complexity_score, b AS maintainability_score, CAST(round_even((a + b) / 2.0, 0) AS INTEGER) AS quality_score FROM s",
    "document_profile": f"WITH d AS (SELECT doc_id, {_strip('coalesce(text, chr(32))')} AS content FROM documents) SELECT doc_id, sha256(content) AS content_hash, CAST(length(content) AS INTEGER) AS char_count, CAST({_WORDS} AS INTEGER) AS word_count FROM d",
    "document_chunks": f"{_chunks(config.CHUNK_CHARS, config.CHUNK_OVERLAP)} SELECT doc_id || '::chunk-' || chunk_index AS chunk_id, doc_id, chunk_index, CAST(length(text) AS INTEGER) AS chars, md5(text) AS text_md5, lang AS category, source AS source_title FROM chunk",
    "document_chunks_without_overlap": f"{_chunks(400, 0)} SELECT doc_id AS document_id, count(*) AS chunks, CAST(max(length(text)) AS INTEGER) AS longest FROM chunk GROUP BY doc_id",
    "corpus_manifest": "SELECT lang AS category, count(*) AS documents FROM documents GROUP BY lang",
    "corpus_manifest_documents": f"{KNOWLEDGE} SELECT doc_id AS id, source AS title, lang AS category, 'd/' || doc_id || '.md' AS file_path, sha256(content) AS content_hash, CAST({_WORDS} AS INTEGER) AS word_count FROM k",
    "corpus_manifest_totals": f"{_chunks(config.CHUNK_CHARS, config.CHUNK_OVERLAP)}, n AS (SELECT (SELECT count(*) FROM documents) AS document_count, (SELECT count(*) FROM chunk) AS chunk_count) SELECT document_count, chunk_count, CAST(printf('%.2f', chunk_count / document_count) AS DOUBLE) AS average_chunks_per_document FROM n",
    "duplicate_document_ids": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    "front_matter_parse": f"""WITH d AS (SELECT *, doc_id % 5 AS k FROM documents), j AS (SELECT *, CASE k WHEN 1 THEN 'category is unknown: other' WHEN 2 THEN 'missing or malformed front matter' WHEN 3 THEN 'id is missing' END AS problem FROM d)
SELECT 'd/' || doc_id AS file_path, problem, CASE WHEN problem IS NULL THEN 'doc-' || doc_id END AS id, CASE WHEN problem IS NULL THEN 'Title ' || source END AS title, CASE WHEN problem IS NULL THEN 'secure_coding' END AS category,
  CASE WHEN problem IS NULL THEN 'CWE-' || doc_id END AS cwe_id, CASE WHEN problem IS NULL THEN 'python,java' END AS languages, CASE WHEN problem IS NULL THEN '{config.DEFAULT_SOURCE}' END AS source,
  CASE WHEN problem IS NULL THEN 1 END AS version, CASE WHEN problem IS NULL THEN '2024-01-15' END AS last_updated, CASE WHEN problem IS NULL THEN sha256({_strip('coalesce(text, chr(32))')}) END AS content_hash FROM j""",
    "prompt_assembly": "WITH p AS (SELECT conv_id, 'Be brief.' || chr(10) || chr(10) || string_agg(upper(coalesce(role, 'user')) || ': ' || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn, text) AS prompt FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(length(prompt) AS INTEGER) AS chars, md5(prompt) AS prompt_md5 FROM p",
}
