"""The same results in relational SQL: explode, window and group where the engine works inside the row."""

from __future__ import annotations

import re

from authorscope.functions.regex import WHITESPACE_CHARS
from authorscope.operators import classify as K
from authorscope.operators import distribution as D
from authorscope.operators import heuristics as H
from authorscope.operators import intake
from authorscope.operators import markers as M
from authorscope.operators import predictability as P

from . import corpus
from .corpus import quoted as q
from .corpus import sql_list

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
LF = "chr(10)"


def rx(pattern: str, flags: str = "") -> str:
    """A rule pattern as an RE2 literal."""
    def rewrite(m: re.Match) -> str:
        body = {"w": WORD, "s": SPACE, "d": r"\p{Nd}"}[m.group(2)]
        return "[" + body if m.group(1) else f"[{body}]"

    out = re.sub(r"(\[?)\\([wsd])", rewrite, pattern).replace("}+", "}").replace("|$)", r"|\n?\z)")
    return q((f"(?{flags})" if flags else "") + out)


def strip(x: str) -> str:
    return f"trim({x}, {q(WHITESPACE_CHARS)})"


def lstrip(x: str) -> str:
    return f"ltrim({x}, {q(WHITESPACE_CHARS)})"


def any_contains(x: str, items) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(i)})" for i in items) + ")"


NAME = "lower(str_split(path, '/')[-1])"
EXT = rf"regexp_extract({NAME}, '[^.].*?(\.[^.]+)$', 1)"
PARTS = "str_split(lower(path), '/')"


def type_case(path_ready: str = "") -> str:
    return f"""CASE
  WHEN {NAME} IN {tuple(K.DOC_FILENAMES)} THEN 'documentation'
  WHEN {NAME} IN {tuple(K.CONFIG_FILENAMES)} THEN 'configuration'
  WHEN list_has_any({PARTS}, {list(K.DOC_DIRECTORIES)}) AND {EXT} IN {tuple(K.DOC_EXTENSIONS)} THEN 'documentation'
  WHEN {EXT} IN {tuple(K.CODE_EXTENSIONS)} THEN 'code'
  WHEN {EXT} IN {tuple(K.DOC_EXTENSIONS)} THEN 'documentation'
  WHEN {EXT} IN {tuple(K.CONFIG_EXTENSIONS)} THEN 'configuration'
  WHEN {EXT} IN {tuple(K.DATA_EXTENSIONS)} THEN 'data'
  WHEN {LIKELY_CONFIG} THEN 'configuration'
  WHEN {LIKELY_DOC} THEN 'documentation'
  ELSE 'unknown' END"""


LIKELY_CONFIG = (
    f"(({NAME} LIKE '.%' AND {NAME} NOT LIKE '..%') OR list_has_any({PARTS}, {list(K.CONFIG_DIRECTORIES)}) "
    f"OR ({NAME} LIKE '%rc' AND length({NAME}) > 2))"
)
LIKELY_DOC = any_contains(NAME, K.DOC_NAME_PARTS)

_dirs = [p.rstrip("/") for p in intake.IGNORE_PATTERNS if p.endswith("/") and "*" not in p]
_names = [p for p in intake.IGNORE_PATTERNS if not p.endswith("/") and "*" not in p]
_suffixes = [p[1:] for p in intake.IGNORE_PATTERNS if not p.endswith("/") and p.startswith("*")]
_SPLIT = "str_split(path, '/')"
IGNORED = (
    f"(list_has_any({_SPLIT}[:-2], {_dirs}) OR list_has_any({_SPLIT}, {_names}) "
    f"OR len(list_filter({_SPLIT}[:-2], lambda d: d LIKE '%.egg-info')) > 0 "
    f"OR len(list_filter({_SPLIT}, lambda p: "
    + " OR ".join(f"p LIKE '%{s}'" for s in _suffixes)
    + ")) > 0)"
)
HIDDEN = (
    f"(len(list_filter({_SPLIT}[:-2], lambda d: d LIKE '.%' AND lower(d) NOT IN {intake.KEPT_HIDDEN_DIRECTORIES})) > 0)"
)

COMMENT = (
    "CASE WHEN s LIKE '//%' AND s NOT LIKE '////%' THEN " + strip("s[3:]")
    + " WHEN s LIKE '#%' AND s NOT LIKE '##%' THEN " + strip("s[2:]")
    + " WHEN s LIKE '--%' AND s NOT LIKE '----%' THEN " + strip("s[3:]")
    + " WHEN s LIKE ';%' AND s NOT LIKE ';;%' THEN " + strip("s[2:]") + " END"
)
CODE_LINE = "(s <> '' AND NOT regexp_matches(s, '^(?://|#|--|;|/\\*|\\*|''''''|\"\"\")'))"
WORDS = f"len(regexp_split_to_array(s, '[{SPACE}]+'))"
KEYS = "repo, path"


def ngram_cte(n: int) -> str:
    leads = ", ".join(f"lead(token, {k}) OVER w AS t{k}" for k in range(1, n))
    gram = " || ' ' || ".join(["token"] + [f"t{k}" for k in range(1, n)])
    return (
        f"SELECT {KEYS}, pos, n, {gram} AS gram FROM (SELECT *, {leads} FROM tok "
        f"WINDOW w AS (PARTITION BY {KEYS} ORDER BY pos)) WHERE t{n - 1} IS NOT NULL"
    )


def top_gram_cte(n: int) -> str:
    stop = sql_list(list(D.STOP_WORDS))
    return (
        f"SELECT {KEYS}, gram, r, c FROM (SELECT {KEYS}, gram, count(*) AS c, row_number() OVER (PARTITION BY {KEYS} "
        f"ORDER BY count(*) DESC, min(pos)) AS r FROM gram{n} WHERE n >= {10 * n} GROUP BY {KEYS}, gram) "
        f"WHERE r <= 5 AND c >= 5 AND len(list_filter(str_split(gram, ' '), lambda t: NOT list_contains({stop}, t))) > 0"
    )


CTES: dict[str, str] = {
    "files": corpus.FILES_SQL,
    "typed": f"SELECT *, {type_case()} AS content_type, len(str_split(content, {LF})) AS line_count FROM files",
    "kept": f"SELECT * FROM typed WHERE NOT {IGNORED} AND NOT {HIDDEN}",
    "elig": "SELECT *, lower(content) AS low FROM kept "
    "WHERE length(content) > 0 AND content_type <> 'unknown' AND line_count >= 5",
    "ln": f"SELECT {KEYS}, i, line, {strip('line')} AS s FROM (SELECT {KEYS}, unnest(range(len(l))) AS i, unnest(l) AS line "
    f"FROM (SELECT {KEYS}, str_split(content, {LF}) AS l FROM elig WHERE content_type = 'code' AND length(content) >= 50))",
    "com": f"SELECT * FROM (SELECT {KEYS}, i, {COMMENT} AS c FROM ln) WHERE c IS NOT NULL",
    "tok0": f"""SELECT {KEYS}, content_type, CASE WHEN content_type = 'code'
  THEN regexp_extract_all(low, '[{WORD}]+|[^{WORD}{SPACE}]') ELSE regexp_extract_all(low, '[{WORD}]+') END AS t FROM elig""",
    "tokn": f"SELECT {KEYS}, content_type, len(t) AS n FROM tok0 WHERE len(t) >= 50",
    "tok": f"SELECT {KEYS}, content_type, len(t) AS n, unnest(range(len(t))) AS pos, unnest(t) AS token FROM tok0 "
    "WHERE len(t) >= 50",
    "sent": f"SELECT {KEYS}, content_type, i, s FROM (SELECT {KEYS}, content_type, i, {strip('x')} AS s FROM (SELECT {KEYS}, "
    f"content_type, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT {KEYS}, content_type, "
    "regexp_split_to_array(content, '[.!?]+') AS l FROM elig WHERE content_type <> 'code'))) WHERE length(s) > 10",
    "gap": f"SELECT {KEYS}, token, n, pos - lag(pos) OVER (PARTITION BY {KEYS}, token ORDER BY pos) AS gap FROM tok "
    "WHERE n >= 100 AND length(token) > 2",
    "burst": f"SELECT {KEYS}, avg((sd - mu) / (sd + mu)) AS b FROM (SELECT {KEYS}, token, avg(gap) AS mu, "
    f"stddev_pop(gap) AS sd FROM gap GROUP BY {KEYS}, token HAVING count(*) >= 3) GROUP BY {KEYS} HAVING count(*) >= 10",
    "freq": f"SELECT {KEYS}, n, token, count(*) AS c FROM tok GROUP BY {KEYS}, n, token",
    "zipf": f"SELECT {KEYS}, regr_slope(ln(c), ln(r)) AS slope, regr_r2(ln(c), ln(r)) AS r2, min(c) = max(c) AS flat FROM "
    f"(SELECT {KEYS}, c, row_number() OVER (PARTITION BY {KEYS} ORDER BY c DESC) AS r, "
    f"count(*) OVER (PARTITION BY {KEYS}) AS d FROM freq WHERE n >= 200) WHERE d >= 20 AND r <= 50 GROUP BY {KEYS}",
    "gram2": ngram_cte(2),
    "gram3": ngram_cte(3),
    "gram4": ngram_cte(4),
    "top2": top_gram_cte(2),
    "top3": top_gram_cte(3),
    "top4": top_gram_cte(4),
    "win": f"SELECT {KEYS}, st, count(DISTINCT token) AS d FROM (SELECT {KEYS}, n, token, "
    "unnest([(pos // 25) * 25, (pos // 25) * 25 - 25]) AS st FROM tok) WHERE st >= 0 AND st < n - 50 "
    f"GROUP BY {KEYS}, st",
    "chr1": f"SELECT {KEYS}, ch, count(*) AS c FROM (SELECT {KEYS}, unnest(regexp_extract_all(content, '(?s).')) AS ch "
    f"FROM elig) GROUP BY {KEYS}, ch",
    "chent": f"SELECT {KEYS}, -sum(c / t * log2(c / t)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY {KEYS}) AS t FROM chr1) "
    f"GROUP BY {KEYS}",
    "frag": f"SELECT {KEYS}, least(1.0, ("
    + " + ".join(f"(length(low) - length(replace(low, {q(f)}, ''))) // {len(f)}" for f in P.FRAGMENTS)
    + ") / (greatest(length(content) - 1, 1) / 10)) AS p FROM elig",
    "part": f"SELECT {KEYS}, content_type, CASE WHEN contains(content, {LF} || {LF}) THEN str_split(content, {LF} || {LF}) "
    f"ELSE str_split(content, {LF}) END AS p FROM elig",
    "commits": corpus.commits_sql(),
    "scommits": corpus.commits_sql("'src' || (user_id % 25)"),
    "ocommits": corpus.ORDER_COMMITS_SQL,
    "ocfiles": corpus.ORDER_COMMIT_FILES_SQL,
}
RECURSIVE = {"chunk", "fold", "sfold"}
CTES["chunk"] = f"""
  SELECT {KEYS}, content_type, p, 1 AS i, ''::VARCHAR AS cur, []::VARCHAR[] AS out FROM part
  UNION ALL
  SELECT {KEYS}, content_type, p, i + 1,
    CASE WHEN length(cur) + length(p[i]) < 512 THEN CASE WHEN cur = '' THEN p[i] ELSE cur || {LF} || p[i] END
         ELSE p[i] END,
    CASE WHEN length(cur) + length(p[i]) < 512 OR length(cur) < 50 THEN out ELSE list_append(out, cur) END
  FROM chunk WHERE i <= len(p)"""
CTES["chunks"] = (
    f"SELECT {KEYS}, content_type, CASE WHEN length(cur) >= 50 THEN list_append(out, cur) ELSE out END AS ch "
    "FROM chunk WHERE i = len(p) + 1"
)
CTES["ppl"] = (
    f"SELECT {KEYS}, content_type, avg(len(list_distinct(regexp_extract_all(c, '(?s).'))) * 1.0) AS p FROM "
    f"(SELECT {KEYS}, content_type, unnest(ch) AS c FROM chunks) GROUP BY {KEYS}, content_type"
)


# ---------------------------------------------------------------- rules: (name, weight, body, minimum length 50?)
# A body yields repo, path, content_type, score (null when the rule does not fire) and evidence.
RULES: dict[str, tuple[str, float, str]] = {}


def matches_rule(rid, name, weight, where, text, regex, score, evidence="array_to_string(m[1:3], '|')", at_least=1):
    RULES[rid] = (
        name,
        weight,
        f"SELECT {KEYS}, content_type, CASE WHEN ok AND len(m) >= {at_least} THEN {score} END AS score, "
        f"CASE WHEN ok AND len(m) >= {at_least} THEN {evidence} END AS evidence FROM (SELECT {KEYS}, content_type, "
        f"{where} AS ok, regexp_extract_all({text}, {regex}) AS m FROM elig)",
    )


def stats_rule(rid, name, weight, stats, fires, score, evidence="''"):
    """A rule over one row of statistics per file; files without statistics do not fire."""
    RULES[rid] = (
        name,
        weight,
        f"SELECT {KEYS}, e.content_type, CASE WHEN {fires} THEN {score} END AS score, "
        f"CASE WHEN {fires} THEN {evidence} END AS evidence FROM elig e LEFT JOIN ({stats}) x USING (repo, path)",
    )


N = "len(m)"
LONG = "length(content) >= 50"
for rule in M.ATTRIBUTION_RULES:
    matches_rule(rule.rule_id, rule.name, 0.95, "true", "content", rx(rule.pattern, "im"), str(rule.score))
for rule in H.PHRASE_RULES:
    matches_rule(
        rule.rule_id, rule.name, rule.weight, LONG, "low", rx(rule.pattern), f"least(0.95, 0.3 + {N} * 0.15)"
    )
_code_long = f"content_type = 'code' AND {LONG}"
stats_rule(
    "E24", "High comment ratio", 0.6,
    f"SELECT {KEYS}, count(c) AS k, any_value(l) AS l, count(c) / greatest(any_value(l), 1) AS r FROM (SELECT {KEYS}, "
    f"count(*) FILTER ({CODE_LINE}) AS l FROM ln GROUP BY {KEYS}) JOIN com USING (repo, path) GROUP BY {KEYS}",
    "r > 0.5", "least(0.8, r * 0.6)", "'Ratio: ' || k || '/' || l",
)
stats_rule(
    "E25", "Obvious comments", 0.7,
    f"SELECT {KEYS}, count(*) FILTER ("
    + " OR ".join(f"regexp_matches(lower(c), {rx(p)})" for p in H.OBVIOUS_COMMENTS)
    + f") AS k FROM com GROUP BY {KEYS}",
    "k >= 3", "least(0.85, 0.3 + k * 0.1)",
)
stats_rule(
    "E26", "Uniform comment capitalization", 0.4,
    f"SELECT {KEYS}, count(*) AS k, avg(CASE WHEN regexp_matches(c, '^\\p{{Lu}}') THEN 1.0 ELSE 0.0 END) AS r FROM com "
    f"GROUP BY {KEYS}",
    "k >= 5 AND (r > 0.9 OR r < 0.1)", "0.5", "'Capitalized: ' || format('{:.0f}', r * 100) || '%'",
)
stats_rule(
    "E27", "Perfect indentation", 0.3,
    f"SELECT {KEYS}, count(*) AS k, count(DISTINCT ind) AS d, max(ind % 2) AS odd, list_sort(list(DISTINCT ind)) AS lv FROM "
    f"(SELECT {KEYS}, length(line) - length({lstrip('line')}) AS ind FROM ln WHERE s <> '') WHERE ind > 0 GROUP BY {KEYS}",
    "k >= 10 AND d <= 4 AND odd = 0", "0.4", "'Indent levels: [' || array_to_string(lv, ', ') || ']'",
)
stats_rule(
    "E28", "Consistent blank line usage", 0.25,
    f"SELECT {KEYS}, list(g ORDER BY i) AS g FROM (SELECT {KEYS}, i, i - coalesce(lag(i) OVER (PARTITION BY {KEYS} ORDER BY i), -1) "
    f"- 1 AS g FROM ln WHERE s <> '') WHERE g > 0 GROUP BY {KEYS}",
    "len(g) >= 5 AND list_max(g) <= 2", "0.35", "'Pattern: [' || array_to_string(g[1:10], ', ') || ']'",
)


def count_rule(rid, name, weight, patterns, at_least, score, where=_code_long, flags=""):
    total = " + ".join(f"len(regexp_extract_all(content, {rx(p, flags)}))" for p in patterns)
    stats_rule(
        rid, name, weight, f"SELECT {KEYS}, {total} AS k FROM elig WHERE {where}", f"k >= {at_least}", score
    )


count_rule("E29", "Verbose naming", 0.5, H.VERBOSE_NAMES, 3, "least(0.7, 0.3 + k * 0.08)")
count_rule("E30", "Textbook naming conventions", 0.4, H.TEXTBOOK_NAMES, 10, "least(0.6, 0.2 + k * 0.03)")
stats_rule(
    "E31", "Excessive error handling", 0.4,
    f"SELECT {KEYS}, t, l, t / (l / 20) AS r FROM (SELECT {KEYS}, len(regexp_extract_all(content, {rx(H.TRY_BLOCK)})) AS t "
    f"FROM elig WHERE {_code_long}) JOIN (SELECT {KEYS}, count(*) FILTER (s <> '') AS l FROM ln GROUP BY {KEYS}) "
    "USING (repo, path)",
    "l > 20 AND t > 0 AND r > 0.5", "least(0.6, r * 0.4)",
)
count_rule("E32", "Debug statements", 0.3, [p for p, _ in H.DEBUG_CALLS], 5, "least(0.5, 0.2 + k * 0.05)")
stats_rule(
    "E33", "AI-style TODO comments", 0.5,
    f"SELECT {KEYS}, m, len(list_filter(m, lambda t: "
    + " OR ".join(f"contains(lower(t), {q(p)})" for p in H.TODO_PHRASES)
    + f")) AS k FROM (SELECT {KEYS}, regexp_extract_all(content, {rx(H.TODO_NOTE, 'i')}, 1) AS m FROM elig WHERE {_code_long})",
    "k >= 2", "least(0.7, 0.3 + k * 0.15)", "array_to_string(m[1:3], '|')",
)
_DOCS = r"""regexp_extract_all(content, '(?s)(?:"{3}|''{3})(.*?)(?:"{3}|''{3})', 1)"""
CTES["dstr"] = f"SELECT {KEYS}, unnest(range(len(d))) AS i, unnest(d) AS doc FROM (SELECT {KEYS}, {_DOCS} AS d FROM elig WHERE {_code_long})"
stats_rule(
    "E34", "Templated docstrings", 0.5,
    f"SELECT {KEYS}, sum("
    + " + ".join(f"regexp_matches(doc, {rx(p)})::INT" for p, _ in H.DOCSTRING_TEMPLATES)
    + f") AS k FROM dstr GROUP BY {KEYS}",
    "k >= 3", "least(0.7, 0.3 + k * 0.1)",
)
stats_rule(
    "E35", "Verbose docstrings", 0.4,
    f"SELECT {KEYS}, arg_min(w, i) AS w FROM (SELECT {KEYS}, i, len(regexp_extract_all(doc, '[^{SPACE}]+')) AS w FROM dstr) "
    f"WHERE w > 100 GROUP BY {KEYS}",
    "w IS NOT NULL", "0.5", "'Docstring with ' || w || ' words'",
)
_doc_long = f"content_type = 'documentation' AND {LONG}"
for rid, name, weight, pattern in (
    ("E36", "AI-style section headers", 0.4, H.SECTION_HEADERS),
    ("E37", "Emoji usage", 0.3, H.EMOJI),
    ("E38", "Multiple badges pattern", 0.5, H.BADGES),
    ("E39", "Structured table of contents", 0.5, H.CONTENTS_TABLE),
    ("E40", "Formatted feature list", 0.4, H.FEATURE_LIST),
):
    count_rule(rid, name, weight, [pattern], 1, "least(0.8, 0.3 + k * 0.1)", _doc_long, "im")
for rule in H.PROSE_RULES:
    matches_rule(
        rule.rule_id, rule.name, rule.weight, _doc_long, "low", rx(rule.pattern), f"least(0.7, 0.2 + {N} * 0.1)", at_least=2
    )
_config_long = f"content_type = 'configuration' AND {LONG}"
stats_rule(
    "E45", "Verbose config comments", 0.3,
    f"SELECT {KEYS}, len(regexp_extract_all(content, {rx(r'/[*].*?[*]/', 's')})) + "
    f"len(regexp_extract_all(content, {rx('//.*$', 'm')})) AS k FROM elig WHERE {_config_long}",
    "k >= 5", "0.4", "k || ' comment blocks'",
)
matches_rule(
    "E46", "Placeholder values", 0.6, _config_long, "content", rx(H.PLACEHOLDERS, "i"), f"least(0.7, 0.3 + {N} * 0.1)",
    at_least=3,
)
stats_rule(
    "E47", "Uniform sentence length", 0.4,
    f"SELECT {KEYS}, count(*) AS k, sum(w) / count(*) AS mu, (count(*) * sum(w * w) - sum(w) * sum(w)) / (count(*) * count(*)) AS v FROM (SELECT {KEYS}, {WORDS} AS w FROM sent "
    f"WHERE content_type = 'documentation' AND length(s) > 20) GROUP BY {KEYS}",
    f"{LONG} AND k >= 5 AND v < 50", "0.5",
    "'Average: ' || format('{:.1f}', mu) || ' words, variance: ' || format('{:.1f}', v)",
)
_BURST_TEXT = "'Average burstiness: ' || format('{:.3f}', b)"
stats_rule(
    "F2", "Low burstiness", 0.6, "SELECT * FROM burst", "b < 0.15", "least(0.8, 0.3 + (0.15 - b) * 2)", _BURST_TEXT
)
stats_rule("F3", "High burstiness", 0.5, "SELECT * FROM burst", "b > 0.5", "0.2", _BURST_TEXT)
stats_rule(
    "F4", "Poor Zipf fit", 0.4, "SELECT * FROM zipf", "r2 < 0.85 AND NOT flat", "least(0.7, 0.3 + (0.85 - r2) * 2)",
    "'Zipf exponent: ' || format('{:.2f}', abs(slope)) || ', R²: ' || format('{:.2f}', r2)",
)
stats_rule(
    "F5", "Unusual Zipf exponent", 0.35, "SELECT * FROM zipf", "abs(slope) < 0.7 OR abs(slope) > 1.3", "0.5",
    "'Expected ~1.0, got ' || format('{:.2f}', abs(slope))",
)
for n in (2, 3, 4):
    stats_rule(
        f"F6.{n}", f"Repeated {n}-grams", 0.35,
        f"SELECT {KEYS}, count(*) AS k, list(gram ORDER BY r) AS g FROM top{n} GROUP BY {KEYS}",
        "k >= 2", "least(0.6, 0.2 + k * 0.1)", "array_to_string(g[1:3], '|')",
    )
stats_rule(
    "F7", "Uniform vocabulary density", 0.5,
    f"SELECT {KEYS}, count(*) AS k, sum(d) / count(*) / 50 AS mu, sqrt((count(*) * sum(d * d) - sum(d) * sum(d)) / (count(*) * count(*))) / 50 AS sd FROM win JOIN tokn USING (repo, path) "
    f"WHERE n >= 100 GROUP BY {KEYS}",
    "k >= 4 AND sd < 0.05", "least(0.7, 0.3 + (0.05 - sd) * 10)",
    "'TTR mean: ' || format('{:.3f}', mu) || ', std: ' || format('{:.3f}', sd)",
)
stats_rule(
    "F8", "Low vocabulary diversity", 0.3,
    f"SELECT {KEYS}, count(*) AS d, any_value(n) AS n FROM freq WHERE n >= 100 GROUP BY {KEYS}",
    "d / n < 0.3", "0.4", "'Unique: ' || d || ', Total: ' || n",
)
CTES["psent"] = f"SELECT s.*, {WORDS} AS w, lower(regexp_split_to_array(s, '[{SPACE}]+')[1]) AS fw FROM sent s JOIN tokn USING (repo, path)"
stats_rule(
    "F9", "Uniform sentence lengths", 0.55,
    f"SELECT {KEYS}, count(*) AS k, sum(w) / count(*) AS mu, sqrt((count(*) * sum(w * w) - sum(w) * sum(w)) / (count(*) * count(*))) AS sd FROM psent GROUP BY {KEYS}",
    "k >= 5 AND sd / mu < 0.35", "least(0.7, 0.3 + (0.35 - sd / mu))",
    "'Mean: ' || format('{:.1f}', mu) || ' words, Std: ' || format('{:.1f}', sd)",
)
_repr = "CASE WHEN contains(fw, '''') AND NOT contains(fw, '\"') THEN '\"' || fw || '\"' ELSE '''' || replace(fw, '''', '\\''') || '''' END"
stats_rule(
    "F10", "Repetitive sentence starts", 0.45,
    f"SELECT {KEYS}, any_value(t) AS t, sum(c) / any_value(t) AS r, list('(' || {_repr} || ', ' || c || ')' ORDER BY o) AS top FROM "
    f"(SELECT {KEYS}, fw, count(*) AS c, sum(count(*)) OVER (PARTITION BY {KEYS}) AS t, row_number() OVER "
    f"(PARTITION BY {KEYS} ORDER BY count(*) DESC, min(i)) AS o FROM psent GROUP BY {KEYS}, fw) WHERE o <= 3 GROUP BY {KEYS}",
    "t >= 5 AND r > 0.5", "least(0.65, 0.2 + r * 0.5)", "'Top: [' || array_to_string(top, ', ') || ']'",
)
CTES["lfill"] = "SELECT l.* FROM ln l JOIN tokn USING (repo, path) WHERE s <> ''"
CTES["lent"] = (
    f"SELECT {KEYS}, sum(c) AS k, CASE WHEN count(*) > 1 THEN -sum(c / t * log2(c / t)) / log2(count(*)) ELSE 0 END AS h "
    f"FROM (SELECT {KEYS}, length(line) AS len, count(*) AS c, sum(count(*)) OVER (PARTITION BY {KEYS}) AS t FROM lfill "
    f"GROUP BY {KEYS}, length(line)) GROUP BY {KEYS}"
)
stats_rule(
    "F11", "Uniform line lengths", 0.4, "SELECT * FROM lent", "k >= 10 AND h < 0.7", "least(0.6, 0.2 + (0.7 - h))",
    "'Normalized entropy: ' || format('{:.3f}', h)",
)
stats_rule(
    "F12", "Limited indent levels", 0.3,
    f"SELECT {KEYS}, count(*) AS k, list_sort(list(DISTINCT length(line) - length({lstrip('line')}))) AS lv FROM lfill GROUP BY {KEYS}",
    "k > 20 AND len(lv) <= 3", "0.4", "'Levels: [' || array_to_string(lv, ', ') || ']'",
)
stats_rule(
    "G1", "Moderate entropy", 0.3, "SELECT * FROM chent", "h > 3.5 AND h < 4.5", "0.4",
    "'Entropy: ' || format('{:.3f}', h)",
)
stats_rule("G2", "High predictability", 0.5, "SELECT * FROM frag", "p > 0.6", "least(0.7, 0.3 + p * 0.5)")


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the tables it uses, in dependency order."""
    ctes = {**CTES, **(extra or {})}
    order: list[str] = []

    def need(text: str, of: str = "") -> None:
        for name in ctes:
            if name != of and name not in order and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                need(ctes[name], name)
                order.append(name)

    need(body)
    if not order:
        return doubles(body)
    keyword = "WITH RECURSIVE" if RECURSIVE & set(order) else "WITH"
    parts = [
        f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({ctes[n]})" for n in order
    ]
    return doubles(f"{keyword} " + ",\n".join(parts) + "\n" + body)


def doubles(sql: str) -> str:
    """Write decimal literals outside quotes as doubles, so both engines add the same binary numbers."""
    pieces = re.split(r"('(?:[^']|'')*')", sql)
    return "".join(
        p if p.startswith("'") else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for p in pieces
    )


def rule_weight(rid: str) -> str:
    return repr(RULES[rid][1])


def rule_name(rid: str) -> str:
    return q(RULES[rid][0])


def rule_sql(rid: str) -> str:
    return with_ctes(
        f"SELECT repo, path, round(score, 6) AS score, CASE WHEN score IS NOT NULL THEN {rule_weight(rid)} END AS weight, "
        f"evidence FROM ({RULES[rid][2]})"
    )
