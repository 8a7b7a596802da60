"""Every registered query with its SQL. Keys start with the operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authorscope import ScoringConfig, score_commits, score_files, score_repositories, score_texts
from authorscope.functions import text as T
from authorscope.functions.exprs import entropy_of_counts, run_counts
from authorscope.operators import aggregate as A
from authorscope.operators import classify as K
from authorscope.operators import commits as C
from authorscope.operators import intake, markers
from authorscope.operators import predictability as P
from authorscope.operators.scoring import rule_catalog, weighted_mean, with_text_views
from authorscope.plans.repositories import attributed_commits, repository_signals, repository_totals
from authorscope.schema import confidence_band, repo_verdict, risk_band, snippet_verdict
from authorscope.sinks import reports as R

from . import corpus
from . import oracle as O
from .oracle import KEYS, with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, query: Query, sql: str | None) -> None:
    QUERIES[key] = query
    if sql is not None:
        ORACLES[key] = sql


def in_utc(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def on_files(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(corpus.files(spark, sf_dir))


def eligible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = intake.select_files(corpus.files(spark, sf_dir))
    return intake.eligible(intake.classified(files))


def on_eligible(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(eligible_files(spark, sf_dir))


def on_views(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(with_text_views(eligible_files(spark, sf_dir)))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- A: intake
register(
    "a01_file_table",
    on_files(lambda f: f.select("repo", "path", "size", F.length("content").alias("chars"))),
    with_ctes("SELECT repo, path, size, length(content)::INT AS chars FROM files"),
)
register(
    "a02_ignored_paths",
    on_files(lambda f: f.select("repo", "path", intake.ignored(F.col("path")).alias("ignored"))),
    with_ctes(f"SELECT repo, path, {O.IGNORED} AS ignored FROM files"),
)
register(
    "a03_hidden_directories",
    on_files(lambda f: f.select("repo", "path", intake.in_hidden_directory(F.col("path")).alias("hidden"))),
    with_ctes(f"SELECT repo, path, {O.HIDDEN} AS hidden FROM files"),
)
register(
    "a04_size_cap",
    on_files(lambda f: f.where(intake.within_size(F.col("size"), 20000)).select("repo", "path", "size")),
    with_ctes("SELECT repo, path, size FROM files WHERE size <= 20000"),
)


def raw_bytes() -> Column:
    """Document text with control bytes in front of some rows."""
    i = F.col("doc_id") % 7
    lead = (
        F.when(i == 0, F.repeat(F.decode(F.unhex(F.lit("01")), "UTF-8"), (F.col("doc_id") % 900).cast("int")))
        .when(i == 1, F.decode(F.unhex(F.lit("00")), "UTF-8"))
        .when(i == 2, F.repeat(F.lit("\x07\x1b\x7f"), (F.col("doc_id") % 300).cast("int")))
        .otherwise("")
    )
    return F.encode(F.concat(lead, F.when(i == 3, "").otherwise(F.col("text"))), "UTF-8")


_RAW_SQL = """SELECT doc_id, encode((CASE doc_id % 7 WHEN 0 THEN repeat(chr(1), (doc_id % 900)::INT) WHEN 1 THEN chr(0)
 WHEN 2 THEN repeat(chr(7) || chr(27) || chr(127), (doc_id % 300)::INT) ELSE '' END)
 || (CASE WHEN doc_id % 7 = 3 THEN '' ELSE text END)) AS b FROM documents"""
register(
    "a05_binary_sniff",
    lambda s, d: corpus.table(s, d, "documents").select(
        "doc_id", intake.looks_binary(raw_bytes()).alias("is_binary")
    ),
    f"""WITH raw AS ({_RAW_SQL}), h AS (SELECT doc_id, regexp_extract_all(left(hex(b), 16384), '..') AS p FROM raw)
SELECT doc_id, CASE WHEN len(p) = 0 THEN false ELSE list_contains(p, '00') OR len(list_filter(p, lambda x:
 regexp_matches(x, '^(?:0[0-6BEF]|1[0-9ACDEF]|7F)$'))) / len(p) > 0.3 END AS is_binary FROM h""",
)
def other_newlines() -> Column:
    i = F.col("doc_id") % 3
    return (
        F.when(i == 0, F.replace("text", F.lit("\n"), F.lit("\r\n")))
        .when(i == 1, F.replace("text", F.lit("\n"), F.lit("\r")))
        .otherwise(F.col("text"))
    )


register(
    "a06_decode_text",
    lambda s, d: corpus.table(s, d, "documents").select(
        "doc_id", F.md5(intake.decode_text(F.encode(other_newlines(), "UTF-8"))).alias("text_md5")
    ),
    "SELECT doc_id, md5(text) AS text_md5 FROM documents",
)
register(
    "a07_file_cap",
    on_files(lambda f: intake.cap_files(f, ScoringConfig(max_files=20)).select("repo", "path")),
    with_ctes(
        "SELECT repo, path FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS r FROM files) "
        "WHERE r <= 20"
    ),
)
_URL_FORMS = [
    ("https://github.com/own", "/rep.git"), ("git@github.com:team", "/tool"), ("https://gitlab.com/grp", "/lib/"),
    ("https://bitbucket.org/me", "/kit.git"), ("/srv/code/tree", "/"), ("plain", ""), ("https://example.org/x/y", ""),
]


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id") % (len(_URL_FORMS) + 1)
    made = F.concat(
        corpus.pick([a for a, _ in _URL_FORMS], i), F.col("page_id").cast("string"),
        corpus.pick([b for _, b in _URL_FORMS], i),
    )
    return corpus.table(spark, sf_dir, "pages").select(
        "page_id", F.when(i < len(_URL_FORMS), made).otherwise(F.col("url")).alias("url")
    )


_URLS_SQL = (
    f"SELECT page_id, CASE WHEN page_id % {len(_URL_FORMS) + 1} < {len(_URL_FORMS)} THEN "
    f"({corpus.sql_list([a for a, _ in _URL_FORMS])})[page_id % {len(_URL_FORMS) + 1} + 1] || page_id || "
    f"({corpus.sql_list([b for _, b in _URL_FORMS])})[page_id % {len(_URL_FORMS) + 1} + 1] ELSE url END AS url FROM pages"
)
_HOSTED = r"(?:github\.com|gitlab\.com|bitbucket\.org)[:/]([^/]+/[^/]+?)(?:\.git)?$"
register(
    "a08_repository_name",
    lambda s, d: _urls(s, d).select("page_id", intake.repository_name(F.col("url")).alias("name")),
    f"""SELECT page_id, CASE WHEN regexp_matches(url, '{_HOSTED}') THEN regexp_extract(url, '{_HOSTED}', 1)
 WHEN regexp_matches(url, '/([^/]+)/?$') THEN regexp_extract(url, '/([^/]+)/?$', 1) ELSE url END AS name
FROM ({_URLS_SQL})""",
)
register(
    "a09_remote_test",
    lambda s, d: _urls(s, d).select("page_id", intake.is_remote(F.col("url")).alias("is_remote")),
    f"SELECT page_id, (starts_with(url, 'http://') OR starts_with(url, 'https://') OR starts_with(url, 'git@')) AS is_remote "
    f"FROM ({_URLS_SQL})",
)
_NEWEST = "row_number() OVER (PARTITION BY repo ORDER BY us DESC, sha) - 1"
register(
    "a10_newest_commits",
    in_utc(
        lambda s, d: C.newest_commits(corpus.commits(s, d), ScoringConfig(max_commits=50)).select(
            "repo", "sha", "rank", "message"
        )
    ),
    with_ctes(
        f"SELECT repo, sha, rank::INT AS rank, {O.strip('message')} AS message FROM (SELECT *, {_NEWEST} AS rank FROM commits) "
        "WHERE rank < 50"
    ),
)
register(
    "a11_change_totals",
    lambda s, d: C.change_totals(corpus.order_commit_files(s, d)),
    with_ctes(
        "SELECT repo, sha, count(*)::INT AS files_changed, sum(insertions)::BIGINT AS insertions, "
        "sum(deletions)::BIGINT AS deletions FROM ocfiles GROUP BY repo, sha"
    ),
)
register(
    "a12_file_history",
    in_utc(
        lambda s, d: C.file_history(corpus.order_commits(s, d), corpus.order_commit_files(s, d)).select(
            "repo", "path", "rank", "sha", "subject", "author", F.date_format("date", "yyyy-MM-dd").alias("day")
        )
    ),
    with_ctes(
        "SELECT repo, path, rank::INT AS rank, sha[1:8] AS sha, subject, author, strftime(date, '%Y-%m-%d') AS day FROM (SELECT f.repo, f.path, "
        "c.sha, c.author, c.date, str_split(trim(c.message, ' ' || chr(10)), chr(10))[1] AS subject, row_number() OVER "
        "(PARTITION BY f.repo, f.path ORDER BY c.date DESC, c.sha) AS rank FROM ocfiles f JOIN ocommits c "
        "ON f.repo = c.repo AND f.sha = c.sha) WHERE rank <= 10"
    ),
)
register(
    "a13_eligible_files",
    on_eligible(lambda f: f.select("repo", "path", "content_type", "line_count")),
    with_ctes("SELECT repo, path, content_type, line_count::INT AS line_count FROM elig"),
)
register(
    "a14_line_count",
    on_files(lambda f: f.select("repo", "path", T.line_count(F.col("content")).alias("line_count"))),
    with_ctes("SELECT repo, path, len(str_split(content, chr(10)))::INT AS line_count FROM files"),
)

# ---------------------------------------------------------------- B: classification
register(
    "b01_content_type",
    on_files(lambda f: f.select("repo", "path", K.content_type(F.col("path")).alias("content_type"))),
    with_ctes("SELECT repo, path, content_type FROM typed"),
)
register(
    "b02_likely_configuration",
    on_files(lambda f: f.select("repo", "path", K.likely_config(F.col("path")).alias("likely"))),
    with_ctes(f"SELECT repo, path, {O.LIKELY_CONFIG} AS likely FROM files"),
)
register(
    "b03_likely_documentation",
    on_files(lambda f: f.select("repo", "path", K.likely_doc(F.col("path")).alias("likely"))),
    with_ctes(f"SELECT repo, path, {O.LIKELY_DOC} AS likely FROM files"),
)
_lang = " ".join(
    f"WHEN e IN ({', '.join(corpus.quoted(x) for x in exts)}) THEN '{name}'"
    for name, exts in K.LANGUAGES.items()
)
register(
    "b04_language",
    on_files(lambda f: f.select("repo", "path", K.language(F.col("path")).alias("language"))),
    with_ctes(f"SELECT repo, path, CASE {_lang} END AS language FROM (SELECT repo, path, {O.EXT} AS e FROM files)"),
)

# ---------------------------------------------------------------- C: text primitives over whole documents
_docs: Callable[[Callable[[DataFrame], DataFrame]], Query] = lambda build: lambda s, d: build(
    corpus.table(s, d, "documents").select("doc_id", F.col("text").alias("content"))
)
_DOCS_SQL = "WITH d AS (SELECT doc_id, text AS content FROM documents) "
_PROSE = f"regexp_extract_all(lower(content), '[{O.WORD}]+')"
_CODE = f"regexp_extract_all(lower(content), '[{O.WORD}]+|[^{O.WORD}{O.SPACE}]')"
register(
    "c01_prose_tokens",
    _docs(lambda d: d.select("doc_id", F.inline(T.token_counts(T.prose_tokens(F.lower("content")))))),
    f"{_DOCS_SQL} SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_PROSE}) AS token FROM d) GROUP BY ALL",
)
register(
    "c02_code_tokens",
    _docs(lambda d: d.select("doc_id", F.inline(T.token_counts(T.code_tokens(F.lower("content")))))),
    f"{_DOCS_SQL} SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_CODE}) AS token FROM d) GROUP BY ALL",
)
register(
    "c03_lines",
    _docs(lambda d: d.select("doc_id", F.posexplode(T.lines(F.col("content"))).alias("i", "line"))
          .select("doc_id", "i", (T.strip(F.col("line")) == "").alias("blank"), F.length("line").alias("chars"))),
    f"{_DOCS_SQL} SELECT doc_id, i::INT AS i, {O.strip('line')} = '' AS blank, length(line)::INT AS chars FROM (SELECT doc_id, "
    "unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, str_split(content, chr(10)) AS l FROM d))",
)
register(
    "c04_sentences",
    _docs(lambda d: d.select("doc_id", F.explode(T.sentences(F.col("content"), 10)).alias("s"))
          .select("doc_id", "s", (F.length("s") > 20).alias("long"), T.word_count(F.col("s")).alias("words"))),
    f"{_DOCS_SQL} SELECT doc_id, s, length(s) > 20 AS long, {O.WORDS}::INT AS words FROM (SELECT doc_id, {O.strip('x')} AS s FROM "
    "(SELECT doc_id, unnest(regexp_split_to_array(content, '[.!?]+')) AS x FROM d)) WHERE length(s) > 10",
)
register(
    "c05_comments",
    on_views(lambda v: v.where(F.length("content") >= 50).select("repo", "path", F.posexplode("_comments").alias("i", "comment"))),
    with_ctes(f"SELECT {KEYS}, (row_number() OVER (PARTITION BY {KEYS} ORDER BY i) - 1)::INT AS i, c AS comment FROM com"),
)
register(
    "c06_code_lines",
    on_views(
        lambda v: v.where((F.col("content_type") == "code") & (F.length("content") >= 50)).select(
            "repo", "path", F.size(F.filter("_stripped", T.is_code_line)).alias("code_lines")
        )
    ),
    with_ctes(f"SELECT {KEYS}, (count(*) FILTER ({O.CODE_LINE}))::INT AS code_lines FROM ln GROUP BY {KEYS}"),
)
register(
    "c07_docstrings",
    on_views(lambda v: v.where(F.length("content") >= 50).select("repo", "path", F.posexplode("_docstrings").alias("i", "doc"))),
    with_ctes(f"SELECT {KEYS}, i::INT AS i, doc FROM dstr"),
)


def _ngram_rows(d: DataFrame) -> DataFrame:
    tokens = d.select("doc_id", T.prose_tokens(F.lower("content")).alias("t"))
    grams = F.array(*[
        F.struct(F.lit(n).alias("n"), T.positional_ngrams(F.col("t"), n).alias("g")) for n in (2, 3, 4)
    ])
    return (
        tokens.select("doc_id", F.inline(grams))
        .where(F.size("g") > 0)
        .select(
            "doc_id", "n", F.size("g").cast("long").alias("grams"), F.size(F.array_distinct("g")).cast("long").alias("distinct_grams"),
            F.array_max("g").alias("last_gram"),
        )
    )


_GRAMS = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS n, token || "
    + " || ".join(f"' ' || lead(token, {k}) OVER w" for k in range(1, n))
    + " AS gram FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
    for n in (2, 3, 4)
)
register(
    "c08_positional_ngrams",
    _docs(_ngram_rows),
    f"{_DOCS_SQL}, tk AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT doc_id, {_PROSE} AS t FROM d)) "
    f"SELECT doc_id, n, count(gram) AS grams, count(DISTINCT gram) AS distinct_grams, max(gram) AS last_gram FROM ({_GRAMS}) "
    "WHERE gram IS NOT NULL GROUP BY doc_id, n",
)
register(
    "c09_token_windows",
    _docs(
        lambda d: d.select("doc_id", T.token_windows(T.prose_tokens(F.lower("content"))).alias("w"))
        .select("doc_id", F.posexplode("w").alias("i", "tokens"))
        .select("doc_id", "i", F.size("tokens").alias("width"), F.size(F.array_distinct("tokens")).alias("distinct_tokens"))
    ),
    f"{_DOCS_SQL}, tk AS (SELECT doc_id, len(t) AS n, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT doc_id, {_PROSE} AS t "
    "FROM d)) SELECT doc_id, (st // 25)::INT AS i, count(*)::INT AS width, count(DISTINCT token)::INT AS distinct_tokens FROM (SELECT *, "
    "unnest([(pos // 25) * 25, (pos // 25) * 25 - 25]) AS st FROM tk) WHERE st >= 0 AND st < n - 50 GROUP BY doc_id, st",
)
register(
    "c10_chunks",
    on_eligible(
        lambda f: f.select("repo", "path", F.posexplode(T.chunks(F.col("content"))).alias("i", "chunk")).select(
            "repo", "path", "i", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5")
        )
    ),
    with_ctes(
        f"SELECT {KEYS}, i::INT AS i, length(c)::INT AS chars, md5(c) AS chunk_md5 FROM (SELECT {KEYS}, unnest(range(len(ch))) AS i, "
        "unnest(ch) AS c FROM chunks)"
    ),
)
register(
    "c11_character_counts",
    _docs(
        lambda d: d.select("doc_id", T.character_counts(F.col("content")).alias("n"))
        .where(F.size("n") > 0)
        .select(
            "doc_id", F.size("n").cast("long").alias("distinct_chars"),
            F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b).alias("chars"), F.array_max("n").cast("long").alias("top"),
        )
    ),
    f"{_DOCS_SQL} SELECT doc_id, count(*) AS distinct_chars, sum(c)::BIGINT AS chars, max(c) AS top FROM (SELECT doc_id, ch, count(*) AS c "
    "FROM (SELECT doc_id, unnest(regexp_extract_all(content, '(?s).')) AS ch FROM d) GROUP BY doc_id, ch) GROUP BY doc_id",
)


# ---------------------------------------------------------------- D-G: one query per text rule
def rule_query(rule_id: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = with_text_views(eligible_files(spark, sf_dir))
        found = rule_catalog()["F2" if rule_id == "F3" else rule_id]  # one column yields either burstiness signal
        if rule_id in {"F2", "F3"}:
            found = F.when(found["rule_id"] == rule_id, found)
        return views.select("repo", "path", found.alias("s")).select(
            "repo", "path", r6("s.score").alias("score"), F.col("s.weight").alias("weight"),
            F.array_join("s.evidence", "|").alias("evidence"),
        )

    return run


_KEYS_BY_RULE = {
    "E24": "high_comment_ratio", "E25": "obvious_comments", "E26": "uniform_capitalisation",
    "E27": "perfect_indentation", "E28": "consistent_blank_lines", "E29": "verbose_naming", "E30": "textbook_naming",
    "E31": "excessive_error_handling", "E32": "debug_statements", "E33": "todo_phrasing",
    "E34": "templated_docstrings", "E35": "verbose_docstrings", "E36": "section_headers", "E37": "emoji",
    "E38": "badges", "E39": "table_of_contents", "E40": "feature_list", "E41": "buzzwords", "E42": "project_intro",
    "E43": "marketing_phrases", "E44": "audience_targeting", "E45": "config_comments", "E46": "placeholder_values",
    "E47": "uniform_sentence_length", "F2": "low_burstiness", "F3": "high_burstiness", "F4": "zipf_fit", "F5": "zipf_exponent",
    "F6.2": "repeated_2grams", "F6.3": "repeated_3grams", "F6.4": "repeated_4grams", "F7": "uniform_vocabulary",
    "F8": "low_diversity", "F9": "uniform_sentence_variation", "F10": "repetitive_starts", "F11": "uniform_line_lengths",
    "F12": "limited_indent_levels", "G1": "character_entropy", "G2": "predictability",
    "E1": "intro", "E2": "let_me", "E3": "i_will", "E4": "as_requested", "E5": "this_function_will",
    "E6": "the_above_code", "E7": "note_that", "E8": "keep_in_mind", "E9": "important", "E10": "your_here",
    "E11": "angle_placeholder", "E12": "first_we", "E13": "next_we", "E14": "finally_we", "E15": "hope_this_helps",
    "E16": "feel_free", "E17": "do_not_hesitate", "E18": "let_me_know", "E19": "happy_to_help",
    "E20": "ensures_that", "E21": "for_readability", "E22": "secret_placeholder", "E23": "replace_with_your",
}


def rule_key(rule_id: str) -> str:
    head, _, tail = rule_id.partition(".")
    number = f"{head[0].lower()}{int(head[1:]):02d}"
    if head == "D3":
        return f"{number}_attribution_{tail}"
    return f"{number}_{_KEYS_BY_RULE[rule_id]}"


for _rule in O.RULES:
    register(rule_key(_rule), rule_query(_rule), O.rule_sql(_rule))

_suffix = " ".join(
    f"UNION ALL SELECT repo, path, 'AI marker file: {m}' AS name, {sc} AS score FROM kept "
    f"WHERE ends_with(lower(path), '{m}') OR {O.NAME} = '{m}'"
    for m, _, sc in markers.MARKER_FILES
)[len("UNION ALL"):]
O.CTES["mark"] = _suffix
register(
    "d01_marker_files",
    on_files(
        lambda f: markers.marker_rows(intake.select_files(f)).select(
            "repo", "path", F.col("s.name").alias("name"), F.col("s.score").alias("score")
        )
    ),
    with_ctes("SELECT repo, path, name, score::DOUBLE AS score FROM mark"),
)
_mark_order = "path, " + "list_position([" + ", ".join(f"'AI marker file: {m}'" for m, _, _ in markers.MARKER_FILES) + "], name)"
O.CTES["mark2"] = (
    f"SELECT repo, count(*) AS n, list(path ORDER BY {_mark_order})[1:5] AS ev FROM mark GROUP BY repo HAVING count(*) >= 2"
)
register(
    "d02_multiple_markers",
    on_files(
        lambda f: markers.multiple_markers(markers.marker_rows(intake.select_files(f))).select(
            "repo", "n", F.col("s.score").alias("score"), F.array_join("s.evidence", "|").alias("evidence")
        )
    ),
    with_ctes("SELECT repo, n, 0.95::DOUBLE AS score, array_to_string(ev, '|') AS evidence FROM mark2"),
)

# commit markers
O.CTES["newest"] = (
    f"SELECT * REPLACE ({O.strip('message')} AS message), lower(author) AS la, lower(author_email) AS le "
    f"FROM (SELECT *, {_NEWEST} AS rank FROM commits)"
)
_d4 = [
    f"SELECT repo, sha, rank, {i} AS k, 'Commit: {r.name}' AS name, {r.score} AS score, 0.95 AS weight FROM newest "
    f"WHERE regexp_matches(message, {O.rx(r.pattern, 'i')})"
    for i, r in enumerate(markers.ATTRIBUTION_RULES)
]
_d56 = [
    f"SELECT repo, sha, rank, {100 + 2 * i + j} AS k, {corpus.quoted(f'AI Author{kind}: {name}')} AS name, {score} AS score, "
    f"0.95 AS weight FROM newest WHERE regexp_matches({column}, {O.rx(p, 'i')})"
    for i, (p, name, score) in enumerate(markers.AUTHORS)
    for j, (kind, column) in enumerate((("", "la"), (" Email", "le")))
]
O.CTES["csig"] = " UNION ALL ".join(_d4 + _d56)


def commit_markers(prefix: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        marked = C.with_commit_markers(C.newest_commits(corpus.commits(spark, sf_dir)))
        return (
            marked.select("repo", "sha", F.explode("markers").alias("s"))
            .where(F.col("s.name").startswith(prefix))
            .select("repo", "sha", F.col("s.name").alias("name"), F.col("s.score").alias("score"))
        )

    return in_utc(run)


for _key, _prefix in (
    ("d04_commit_messages", "Commit: "), ("d05_author_names", "AI Author: "), ("d06_author_addresses", "AI Author Email: "),
):
    register(
        _key,
        commit_markers(_prefix),
        with_ctes(f"SELECT repo, sha, name, score::DOUBLE AS score FROM csig WHERE starts_with(name, '{_prefix}')"),
    )
_ai_author = " OR ".join(f"regexp_matches(la, {O.rx(p, 'i')})" for p, _, _ in markers.AUTHORS)
O.CTES["cstat"] = f"""SELECT repo, count(DISTINCT sha) FILTER (marked) AS ai_commits, count(DISTINCT sha) AS total_commits,
  count(DISTINCT sha) FILTER (marked) / count(DISTINCT sha) AS ratio,
  list_sort(list(DISTINCT author) FILTER (marked AND ({_ai_author}))) AS ai_authors
  FROM (SELECT *, sha IN (SELECT sha FROM csig) AS marked FROM newest) GROUP BY repo"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repo_statistics(C.history(C.newest_commits(corpus.commits(spark, sf_dir))))


def history_rule(column: Callable[[], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return history(spark, sf_dir).select("repo", column().alias("s")).select(
            "repo", r6("s.score").alias("score"), F.col("s.weight").alias("weight"),
            F.col("s.description").alias("description"), F.array_join("s.evidence", "|").alias("evidence"),
        )

    return in_utc(run)


def repo_rule_sql(stats: str, fires: str, score: str, weight: float, description: str, evidence: str) -> str:
    cols = ", ".join(
        f"CASE WHEN {fires} THEN {v} END AS {n}"
        for v, n in ((f"round({score}, 6)", "score"), (str(weight), "weight"), (description, "description"), (evidence, "evidence"))
    )
    return with_ctes(
        f"SELECT r.repo, {cols} FROM (SELECT DISTINCT repo FROM newest) r LEFT JOIN ({stats}) x ON r.repo = x.repo"
    )


register(
    "d07_commit_ratio",
    history_rule(C.ratio_signal),
    repo_rule_sql(
        "SELECT * FROM cstat", "ratio > 0.1", "least(0.95, 0.5 + ratio * 0.5)", 0.9,
        "ai_commits || '/' || total_commits || ' commits (' || format('{:.0f}', ratio * 100) || '%) have AI markers'",
        "CASE WHEN len(ai_authors) > 0 THEN 'AI authors: ' || array_to_string(ai_authors, ', ') ELSE '' END",
    ),
)
register(
    "d08_commit_statistics",
    in_utc(
        lambda s, d: history(s, d).select(
            "repo", F.col("ai_commits").cast("long").alias("ai_commits"), F.col("total_commits").cast("long").alias("total_commits"),
            r6("ai_commit_ratio").alias("ratio"), F.array_join("ai_authors", "|").alias("ai_authors"),
        )
    ),
    with_ctes(
        "SELECT repo, ai_commits, total_commits, round(ratio, 6) AS ratio, coalesce(array_to_string(ai_authors, '|'), '') AS ai_authors "
        "FROM cstat"
    ),
)
register(
    "d09_attributed_commits",
    history_rule(C.summary_signal),
    repo_rule_sql(
        "SELECT * FROM cstat", "ai_commits > 0", "0.95", 0.98, "ai_commits || ' commits have explicit AI attribution'",
        "coalesce(array_to_string(ai_authors[1:5], '|'), '')",
    ),
)

# ---------------------------------------------------------------- F: values behind the rules
register(
    "f01_burstiness_value",
    on_views(
        lambda v: v.where(F.col("_tokens.n") >= 100)
        .select("repo", "path", F.col("_tokens.burstiness").alias("b"))
        .select("repo", "path", r6("b").alias("burstiness"))
    ),
    with_ctes(
        f"SELECT {KEYS}, round(b, 6) AS burstiness FROM (SELECT {KEYS} FROM tokn WHERE n >= 100) LEFT JOIN burst USING (repo, path)"
    ),
)
register(
    "f13_line_length_entropy",
    on_eligible(
        lambda f: f.select(
            "repo", "path", F.sort_array(F.transform(T.lines(F.col("content")), F.length)).alias("lengths")
        ).select("repo", "path", r6(entropy_of_counts(run_counts(F.col("lengths")))).alias("entropy"))
    ),
    with_ctes(
        f"SELECT {KEYS}, round(-sum(c / t * log2(c / t)), 6) + 0.0 AS entropy FROM (SELECT {KEYS}, length(line) AS l, count(*) AS c, "
        f"sum(count(*)) OVER (PARTITION BY {KEYS}) AS t FROM (SELECT {KEYS}, unnest(str_split(content, chr(10))) AS line FROM elig) "
        f"GROUP BY {KEYS}, length(line)) GROUP BY {KEYS}"
    ),
)


# ---------------------------------------------------------------- G3, G4: scorer and fallback
def distinct_character_scorer() -> Callable[[list[str]], list[float]]:
    """A stand-in model: the number of distinct characters of each chunk.

    An inner function travels by value, so the workers need not import this package.
    """
    def score(chunks: list[str]) -> list[float]:
        return [float(len(set(c))) for c in chunks]

    return score


SCORER_CONFIG = ScoringConfig(enable_predictability=True, scorer=distinct_character_scorer())


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = with_text_views(eligible_files(spark, sf_dir), SCORER_CONFIG)
    signals = P.perplexity_signals(F.col("_ppl")["perplexity"], F.col("content_type"), SCORER_CONFIG)
    return views.select("repo", "path", F.col("_ppl.perplexity").alias("p"), signals[0].alias("s")).select(
        "repo", "path", r6("p").alias("perplexity"), r6("s.score").alias("score"), F.col("s.weight").alias("weight")
    )


register(
    "g03_perplexity",
    perplexity,
    with_ctes(
        f"SELECT {KEYS}, round(p, 6) AS perplexity, CASE WHEN p < t * 0.5 THEN round(least(0.85, 0.3 + (t * 0.5 - p) / t), 6) "
        f"WHEN p > t * 2 THEN 0.2 END AS score, CASE WHEN p < t * 0.5 THEN 0.7 WHEN p > t * 2 THEN 0.6 END AS weight FROM (SELECT {KEYS}, "
        f"p, CASE WHEN e.content_type = 'code' THEN 50.0::DOUBLE ELSE 30.0::DOUBLE END AS t FROM elig e LEFT JOIN ppl USING (repo, path))"
    ),
)
register(
    "g04_fallback_rules",
    lambda s, d: score_files(
        intake.select_files(corpus.files(s, d)),
        ScoringConfig(enable_heuristic=False, enable_statistical=False, enable_predictability=True),
    ).select(
        "repo", "path",
        F.array_join(F.transform(F.filter("signals", lambda x: x["rule_id"].startswith("G")), lambda x: x["rule_id"]), ",").alias("rules"),
    ),
    with_ctes(
        f"SELECT {KEYS}, concat_ws(',', CASE WHEN h > 3.5 AND h < 4.5 THEN 'G1' END, CASE WHEN p > 0.6 THEN 'G2' END) AS rules "
        "FROM chent JOIN frag USING (repo, path)"
    ),
)

# ---------------------------------------------------------------- H: commit rules
O.CTES["hsig"] = " UNION ALL ".join(
    [
        f"SELECT repo, sha, {i} AS k, '{rid}' AS rule_id, {corpus.quoted(name)} AS name, 0.6 AS score, {weight} AS weight FROM newest "
        f"WHERE regexp_matches(lower(message), {O.rx(p, 'i')})"
        for i, (rid, p, name, weight) in enumerate(C.MESSAGE_RULES)
    ]
    + [
        f"SELECT repo, sha, 99, 'H10', 'Very long commit message', 0.5, 0.3 FROM newest WHERE len(regexp_extract_all(message, '[^{O.SPACE}]+')) > 50"
    ]
)
register(
    "h01_commit_scores",
    in_utc(
        lambda s, d: score_commits(corpus.commits(s, d))[0].select(
            "repo", "sha", "message", r6("ai_probability").alias("ai_probability"), "files_changed"
        )
    ),
    with_ctes(
        "SELECT n.repo, n.sha, n.message[1:100] AS message, round(coalesce(p, 0.0), 6) AS ai_probability, n.files_changed FROM newest n LEFT JOIN "
        "(SELECT sha, sum(score * weight) / sum(weight) AS p FROM hsig GROUP BY sha) x ON n.sha = x.sha"
    ),
)


def style_rule(rule_id: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = C.commit_scores(C.newest_commits(corpus.commits(spark, sf_dir)))
        hit = F.filter("signals", lambda x: x["rule_id"] == rule_id)
        return scored.select(
            "repo", "sha", (F.size(hit) > 0).alias("fired"), F.get(hit, F.lit(0))["score"].alias("score"),
            F.get(hit, F.lit(0))["weight"].alias("weight"),
        )

    return in_utc(run)


for _rid, _label in (
    ("H2", "conventional_long"), ("H3", "explanation_style"), ("H4", "polite_language"), ("H5", "explicit_attribution"),
    ("H6", "coauthor_tag"), ("H7", "multiple_emoji"), ("H8", "emoji_prefix"), ("H9", "verbose_description"),
    ("H10", "very_long_message"),
):
    register(
        f"h{int(_rid[1:]):02d}_{_label}",
        style_rule(_rid),
        with_ctes(
            "SELECT n.repo, n.sha, x.score IS NOT NULL AS fired, x.score::DOUBLE AS score, x.weight::DOUBLE AS weight FROM newest n LEFT JOIN "
            f"(SELECT sha, score, weight FROM hsig WHERE rule_id = '{_rid}') x ON n.sha = x.sha"
        ),
    )


def fold_ctes(source: str, fold: str) -> None:
    """Anchored windows by recursion: one step per commit in time order."""
    O.CTES[fold] = f"""
  SELECT repo, l, 1 AS i, NULL::BIGINT AS anchor, 0 AS n, []::INT[] AS sizes FROM
    (SELECT repo, list(us ORDER BY us) AS l FROM {source} GROUP BY repo HAVING count(*) >= 10)
  UNION ALL
  SELECT repo, l, i + 1,
    CASE WHEN n > 0 AND l[i] - anchor <= 3600000000 THEN anchor ELSE l[i] END,
    CASE WHEN n > 0 AND l[i] - anchor <= 3600000000 THEN n + 1 ELSE 1 END,
    CASE WHEN n = 0 OR l[i] - anchor <= 3600000000 THEN sizes ELSE list_append(sizes, n) END
  FROM {fold} WHERE i <= len(l)"""


fold_ctes("newest", "fold")
O.CTES["burst_runs"] = (
    "SELECT repo, list_filter(list_append(sizes, n), lambda x: x >= 5) AS b FROM fold WHERE i = len(l) + 1"
)
register(
    "h11_commit_bursts",
    history_rule(C.burst_signal),
    repo_rule_sql(
        "SELECT repo, b, list_max(b) AS mx FROM burst_runs", "mx >= 10", "least(0.7, 0.3 + mx * 0.03)", 0.5,
        "'Found burst of ' || mx || ' commits in 1h window'", "'Burst sizes: [' || array_to_string(b[1:5], ', ') || ']'",
    ),
)
O.CTES["hmsg"] = (
    f"SELECT repo, count(*) AS n, count(*) FILTER (regexp_matches(lower(message), '{C.CONVENTIONAL_PREFIX}')) AS c FROM newest "
    "WHERE message <> '' GROUP BY repo"
)
register(
    "h12_uniform_conventional",
    history_rule(lambda: C.message_pattern_signals()[0]),
    repo_rule_sql(
        "SELECT * FROM hmsg", "n >= 5 AND c / n > 0.9", "0.4", 0.3, "c || '/' || n || ' commits use conventional format'",
        "'High consistency may indicate tooling or AI'",
    ),
)
O.CTES["hword"] = (
    "SELECT repo, w, c, t FROM (SELECT repo, w, count(*) AS c, sum(count(*)) OVER (PARTITION BY repo) AS t, row_number() OVER "
    "(PARTITION BY repo ORDER BY count(*) DESC, min(rank)) AS r FROM (SELECT repo, rank, "
    f"lower(regexp_extract(message, '[^{O.SPACE}]+')) AS w FROM newest WHERE message <> '') GROUP BY repo, w) WHERE r = 1"
)
register(
    "h13_repetitive_prefixes",
    history_rule(lambda: C.message_pattern_signals()[1]),
    repo_rule_sql(
        "SELECT * FROM hword", "t >= 5 AND c / t > 0.5", "0.45", 0.35, "'''' || w || ''' starts ' || c || '/' || t || ' commits'", "''"
    ),
)
O.CTES["hhour"] = (
    "SELECT repo, h, c, t FROM (SELECT repo, h, count(*) AS c, sum(count(*)) OVER (PARTITION BY repo) AS t, row_number() OVER "
    "(PARTITION BY repo ORDER BY count(*) DESC, min(rank)) AS r FROM (SELECT repo, rank, (us // 3600000000) % 24 AS h FROM newest) "
    "GROUP BY repo, h) WHERE r = 1"
)
register(
    "h14_concentrated_hours",
    history_rule(C.hour_signal),
    repo_rule_sql(
        "SELECT * FROM hhour", "t >= 10 AND c / t > 0.4", "0.35", 0.25, "c || '/' || t || ' commits at ' || h || ':00'",
        "'May indicate automated or batched work'",
    ),
)
O.CTES["hname"] = " UNION ALL ".join(
    f"SELECT repo, la AS who, {i} AS k, {corpus.quoted('DEFINITIVE: ' + name)} AS name, {score} AS score FROM "
    f"(SELECT DISTINCT repo, la FROM newest) WHERE regexp_matches(la, {O.rx(p, 'i')})"
    for i, (p, name, score) in enumerate(C.AI_NAMES)
)
O.CTES["hmail"] = (
    "SELECT repo, le AS who, 'DEFINITIVE: Anthropic email author' AS name, 0.98 AS score FROM (SELECT DISTINCT repo, le FROM newest) "
    "WHERE contains(le, 'anthropic.com') UNION ALL SELECT repo, le, 'DEFINITIVE: GitHub Copilot email', 0.98 FROM "
    "(SELECT DISTINCT repo, le FROM newest) WHERE contains(le, 'copilot@github') AND NOT contains(le, 'anthropic.com')"
)


def name_rows(make: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(C.history(C.newest_commits(corpus.commits(spark, sf_dir)))).select(
            "repo", F.get("s.evidence", F.lit(0)).alias("who"), F.col("s.name").alias("name"), F.col("s.score").alias("score")
        )

    return in_utc(run)


def bot_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = corpus.commits(spark, sf_dir)
    return commits.select("repo").distinct().join(C.bot_signals(C.history(C.newest_commits(commits))), "repo", "left").select(
        "repo", r6("s.score").alias("score"), F.col("s.weight").alias("weight"),
        F.col("s.description").alias("description"), F.array_join("s.evidence", "|").alias("evidence"),
    )


register(
    "h15_ai_names", name_rows(C.name_signals),
    with_ctes("SELECT repo, who, name, score::DOUBLE AS score FROM hname"),
)
register(
    "h16_ai_addresses", name_rows(C.address_signals),
    with_ctes("SELECT repo, who, name, score::DOUBLE AS score FROM hmail"),
)
_bot = " OR ".join(f"regexp_matches(la, {O.rx(p)})" for p in C.BOT_NAMES)
_known = " OR ".join(f"regexp_matches(la, {O.rx(p, 'i')})" for p, _, _ in C.AI_NAMES)
O.CTES["hbot"] = (
    f"SELECT repo, list(la ORDER BY la)[1:3] AS b FROM (SELECT DISTINCT repo, la FROM newest) WHERE ({_bot}) AND NOT ({_known}) GROUP BY repo"
)
register(
    "h17_bot_authors",
    in_utc(bot_rule),
    repo_rule_sql(
        "SELECT * FROM hbot", "b IS NOT NULL", "0.3", 0.2, "'Found bot-like author names: ' || array_to_string(b, ', ')",
        "array_to_string(b, '|')",
    ),
)
# Assembly order: (phase, a, b, c) sorts the repo-level signals.
O.CTES["hall"] = """
SELECT repo, 0 AS o1, rank::VARCHAR AS o2, rank AS o3, k AS o4, name, score, weight FROM csig
UNION ALL SELECT repo, 1, '', 0, 0, 'Significant AI commit ratio', least(0.95, 0.5 + ratio * 0.5), 0.9 FROM cstat WHERE ratio > 0.1
UNION ALL SELECT repo, 2, '', 0, 0, 'Bulk commit burst', least(0.7, 0.3 + list_max(b) * 0.03), 0.5 FROM burst_runs WHERE list_max(b) >= 10
UNION ALL SELECT repo, 3, '', 0, 0, 'Uniform conventional commits', 0.4, 0.3 FROM hmsg WHERE n >= 5 AND c / n > 0.9
UNION ALL SELECT repo, 4, '', 0, 0, 'Repetitive commit prefixes', 0.45, 0.35 FROM hword WHERE t >= 5 AND c / t > 0.5
UNION ALL SELECT repo, 5, '', 0, 0, 'Time-concentrated commits', 0.35, 0.25 FROM hhour WHERE t >= 10 AND c / t > 0.4
UNION ALL SELECT repo, 6, who, 0, k, name, score, 0.95 FROM hname
UNION ALL SELECT repo, 7, who, 0, 0, name, score, 0.95 FROM hmail
UNION ALL SELECT repo, 8, '', 0, 0, 'Bot authors detected', 0.3, 0.2 FROM hbot
UNION ALL SELECT repo, 9, '', 0, 0, 'DEFINITIVE: AI-attributed commits found', 0.95, 0.98 FROM cstat WHERE ai_commits > 0"""
_HORDER = "o1, CASE WHEN o1 = 0 THEN '' ELSE o2 END, o3, o4"
register(
    "h18_assembled_signals",
    in_utc(
        lambda s, d: score_commits(corpus.commits(s, d))[1].select(
            "repo", F.left("path", F.lit(1)).cast("int").alias("phase"),
            F.when(F.col("path").startswith("0"), F.substring_index("path", " ", -1)).otherwise(F.expr("substring(path, 2)")).alias("who"),
            F.col("s.name").alias("name"), r6("s.score").alias("score"), F.col("s.weight").alias("weight"),
        )
    ),
    with_ctes(
        "SELECT h.repo, o1 AS phase, CASE WHEN o1 = 0 THEN n.sha ELSE o2 END AS who, name, round(score, 6) AS score, weight::DOUBLE AS weight "
        "FROM hall h LEFT JOIN newest n ON o1 = 0 AND h.repo = n.repo AND h.o3 = n.rank"
    ),
)

# ---------------------------------------------------------------- I: aggregation over every rule
_families = list(O.RULES)
_order = (
    [r.rule_id for r in markers.ATTRIBUTION_RULES] + ["D1"]
    + [r for r in _families if r[0] == "E"]
    + ["F2", "F3", "F4", "F5", "F6.2", "F6.3", "F6.4", "F7", "F8", "F11", "F12", "F9", "F10"]
)
O.CTES["sig"] = " UNION ALL ".join(
    [
        f"SELECT {KEYS}, {_order.index(rid) * 100} AS ord, {O.rule_name(rid)} AS name, score::DOUBLE AS score, ({O.rule_weight(rid)})::DOUBLE AS weight "
        f"FROM ({O.RULES[rid][2]}) WHERE score IS NOT NULL"
        for rid in _families
        if rid[0] != "G"
    ]
    + [
        f"SELECT m.repo, m.path, {_order.index('D1') * 100} + list_position(["
        + ", ".join(f"'AI marker file: {m}'" for m, _, _ in markers.MARKER_FILES)
        + "], name) AS ord, name, score::DOUBLE, 0.95::DOUBLE FROM mark m JOIN elig e ON m.repo = e.repo AND m.path = e.path"
    ]
)
_SUM = "list_reduce(list_prepend(0.0::DOUBLE, list({0} ORDER BY ord){1}), lambda a, b: a + b)"


def _ordered_sum(expr: str, only: str = "") -> str:
    return _SUM.format(expr, f" FILTER ({only})" if only else "")


_DEF = "(starts_with(name, 'DEFINITIVE:') OR weight >= 0.9)"
O.CTES["fagg"] = f"""SELECT {KEYS}, count(*) AS n, max(score) FILTER ({_DEF}) AS mx,
  coalesce({_ordered_sum('score * weight', f'NOT {_DEF}')}, 0) AS os, coalesce({_ordered_sum('weight', f'NOT {_DEF}')}, 0) AS ow,
  list(score ORDER BY ord) AS sl, count(*) FILTER (weight >= 0.5) AS strong FROM sig GROUP BY {KEYS}"""
_BAND = "CASE WHEN {0} < 0.2 THEN 'very_low' WHEN {0} < 0.4 THEN 'low' WHEN {0} < 0.6 THEN 'medium' WHEN {0} < 0.8 THEN 'high' ELSE 'very_high' END"
_LMEAN = "(list_reduce(list_prepend(0.0, sl), lambda a, b: a + b) / n)"
_TWO_PASS = (
    f"sqrt(list_reduce(list_prepend(0.0, list_transform(sl, lambda x: pow(x - {_LMEAN}, 2.0))), lambda a, b: a + b) / n)"
)
O.CTES["fprob"] = f"""SELECT e.repo, e.path, e.content_type, e.line_count, n, mx, {_TWO_PASS} AS sd, strong,
  CASE WHEN n IS NULL THEN 0.0
       WHEN mx IS NOT NULL THEN greatest(mx, (CASE WHEN ow > 0 THEN os / ow ELSE 0.5 END) * 0.3 + mx * 0.7)
       WHEN n < 10 THEN os / ow WHEN os / ow > 0.5 THEN os / ow + (1.0 - os / ow) * 0.1 ELSE os / ow * 0.9 END AS p
  FROM elig e LEFT JOIN fagg f ON e.repo = f.repo AND e.path = f.path"""
_FCONF = (
    "(least(1.0, n / 5) * 0.3 + (CASE WHEN n > 1 THEN 1.0 - least(1.0, sd / 0.3) ELSE 0.5 END) * 0.3 "
    "+ least(1.0, strong / 3) * 0.2 + abs(p - 0.5) * 2 * 0.2)"
)
O.CTES["fscore"] = f"""SELECT {KEYS}, content_type, line_count, p, mx, trunc(line_count * p)::INT AS ai_lines,
  CASE WHEN n IS NULL THEN 'very_low' WHEN mx IS NOT NULL THEN 'very_high' ELSE {_BAND.format(_FCONF)} END AS confidence FROM fprob"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_files(intake.select_files(corpus.files(spark, sf_dir)))


def file_table(where: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scored(spark, sf_dir).where(where).select(
            "repo", "path", "content_type", "line_count", r6("ai_probability").alias("ai_probability"), "confidence", "ai_line_estimate"
        )

    return run


_FILE_COLS = (
    f"{KEYS}, content_type, line_count::INT AS line_count, round(p, 6) AS ai_probability, confidence, ai_lines AS ai_line_estimate"
)
register(
    "i01_scores_without_definitive", file_table("max_definitive IS NULL"),
    with_ctes(f"SELECT {_FILE_COLS} FROM fscore WHERE mx IS NULL"),
)
register(
    "i02_scores_with_definitive", file_table("max_definitive IS NOT NULL"),
    with_ctes(f"SELECT {_FILE_COLS} FROM fscore WHERE mx IS NOT NULL"),
)
register(
    "i03_estimated_lines",
    lambda s, d: scored(s, d).select("repo", "path", "ai_line_estimate"),
    with_ctes(f"SELECT {KEYS}, ai_lines AS ai_line_estimate FROM fscore"),
)
register(
    "i04_file_confidence",
    lambda s, d: scored(s, d).select("repo", "path", "confidence"),
    with_ctes(f"SELECT {KEYS}, confidence FROM fscore"),
)
O.CTES["ctot"] = (
    "SELECT repo, content_type, count(*) AS total_files, sum(line_count)::BIGINT AS total_lines, sum(p * line_count) / sum(line_count) AS p, "
    "sum(ai_lines)::BIGINT AS ai_lines, stddev_pop(p) AS spread, max(mx) AS mx FROM fscore GROUP BY repo, content_type"
)
_CCONF = "((1.0 - least(1.0, spread / 0.3)) * 0.6 + least(1.0, total_files / 10) * 0.4)"
O.CTES["ccat"] = (
    f"SELECT *, CASE WHEN total_files < 3 THEN 'low' ELSE {_BAND.format(_CCONF)} END AS confidence FROM ctot "
    "WHERE content_type IN ('code', 'documentation', 'configuration')"
)
O.CTES["ctop"] = (
    "SELECT repo, content_type, list(name ORDER BY r) AS top FROM (SELECT repo, content_type, name, row_number() OVER (PARTITION BY repo, "
    "content_type ORDER BY max(score) DESC, min((path, ord))) AS r FROM sig JOIN fscore USING (repo, path) WHERE content_type IN "
    "('code', 'documentation', 'configuration') GROUP BY repo, content_type, name) WHERE r <= 5 GROUP BY repo, content_type"
)
register(
    "i05_category_totals",
    lambda s, d: A.type_totals(scored(s, d)).select(
        "repo", "content_type", "total_files", "total_lines", r6("ai_probability").alias("ai_probability"), "ai_line_estimate"
    ),
    with_ctes(
        "SELECT repo, content_type, total_files, total_lines, round(p, 6) AS ai_probability, ai_lines AS ai_line_estimate FROM ctot"
    ),
)
register(
    "i06_category_top_signals",
    lambda s, d: A.category_top_signals(scored(s, d)).select("repo", "content_type", F.array_join("top_signals", "|").alias("top_signals")),
    with_ctes("SELECT repo, content_type, array_to_string(top, '|') AS top_signals FROM ctop"),
)
register(
    "i07_category_confidence",
    lambda s, d: A.category_summary(scored(s, d)).select("repo", "content_type", "confidence"),
    with_ctes("SELECT repo, content_type, confidence FROM ccat"),
)

# Repo level: commits share repos with the files.
_SRC = {
    "newest": O.CTES["newest"].replace("FROM commits", "FROM scommits"),
}
O.CTES["rsig"] = f"""SELECT repo, 0 AS phase, o1, CASE WHEN o1 = 0 THEN '' ELSE o2 END AS o2, o3, o4, name, score::DOUBLE AS score, weight::DOUBLE AS weight FROM hall
UNION ALL SELECT repo, 1, 0, path, 0, list_position([{", ".join(f"'AI marker file: {m}'" for m, _, _ in markers.MARKER_FILES)}], name), name, score::DOUBLE, 0.95::DOUBLE FROM mark
UNION ALL SELECT repo, 2, 0, '', 0, 0, 'Multiple AI tool markers', 0.95::DOUBLE, 0.95::DOUBLE FROM mark2"""
O.CTES["rtot"] = (
    "SELECT repo, sum(score * weight) / sum(weight) AS cp, max(score) FILTER (" + _DEF + ") AS cd, "
    "count(*) FILTER (contains(lower(name), 'commit') AND score > 0.8) AS nc FROM rsig GROUP BY repo"
)
_FACTOR = "CASE content_type WHEN 'code' THEN 0.5 WHEN 'documentation' THEN 0.3 WHEN 'configuration' THEN 0.2 END"
O.CTES["rcat"] = f"""SELECT t.repo, sum(t.total_files)::BIGINT AS total_files, sum(t.total_lines)::BIGINT AS total_lines,
  sum(t.p * ({_FACTOR.replace('content_type', 't.content_type')}) * t.total_lines) AS ws, sum(({_FACTOR.replace('content_type', 't.content_type')}) * t.total_lines) AS w,
  avg(list_position(['very_low','low','medium','high','very_high'], c.confidence) - 1) AS level, max(t.mx) AS fd
  FROM ctot t LEFT JOIN ccat c ON t.repo = c.repo AND t.content_type = c.content_type GROUP BY t.repo"""
O.CTES["rall"] = "SELECT DISTINCT repo FROM files UNION SELECT DISTINCT repo FROM scommits"
O.CTES["rsum"] = """SELECT r.repo, coalesce(total_files, 0) AS total_files, coalesce(total_lines, 0) AS total_lines, coalesce(nc, 0) AS nc,
  level, greatest(fd, cd) * 0.85 AS flr, cp, cd, ws, w,
  CASE WHEN coalesce(w, 0) + cw > 0 THEN (coalesce(ws, 0) + coalesce(cp, 0) * cw) / (coalesce(w, 0) + cw) ELSE 0 END AS mean
  FROM (SELECT *, CASE WHEN cp IS NULL THEN 0.0 WHEN cd IS NOT NULL THEN 2.0 ELSE 0.1 END AS cw FROM rall LEFT JOIN rcat USING (repo)
  LEFT JOIN rtot USING (repo)) r"""
O.CTES["every"] = f"""SELECT repo, -1 AS phase, 0 AS o1, path AS o2, 0 AS o3, ord AS o4, name, score, weight FROM sig
UNION ALL SELECT repo, phase, o1, o2, o3, o4, name, score, weight FROM rsig"""
_PLACE = "phase, CASE WHEN phase = 0 THEN o1 ELSE 0 END, o2, o3, o4"
O.CTES["topai"] = (
    f"SELECT repo, list(name ORDER BY r) AS top FROM (SELECT repo, name, row_number() OVER (PARTITION BY repo ORDER BY score * weight DESC, {_PLACE}) "
    "AS r FROM every WHERE score > 0.5) WHERE r <= 10 GROUP BY repo"
)
O.CTES["tophu"] = (
    f"SELECT repo, list(name ORDER BY r) AS top FROM (SELECT repo, name, row_number() OVER (PARTITION BY repo ORDER BY (1.0 - score) * weight DESC, "
    f"{_PLACE}) AS r FROM every WHERE score < 0.4) WHERE r <= 5 GROUP BY repo"
)
UNCAPPED = ScoringConfig(max_files=None)


def source_sql(body: str) -> str:
    return with_ctes(body, _SRC)


def repositories(build) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(score_repositories(corpus.files(spark, sf_dir), corpus.source_commits(spark, sf_dir), UNCAPPED))

    return in_utc(run)


register(
    "i08_commit_and_category_means",
    repositories(
        lambda r: A.repo_totals(A.type_totals(r.file_scores)).join(A.commit_totals(r.signals), "repo", "full").select(
            "repo", r6(F.col("weighted") / F.col("weight")).alias("category_mean"), r6("commit_probability").alias("commit_mean"),
            r6(A.overall_probability(F.col("weighted"), F.col("weight"), F.col("commit_probability"), F.col("commit_definitive").isNotNull())).alias("mean"),
        )
    ),
    source_sql(
        "SELECT repo, round(ws / w, 6) AS category_mean, round(cp, 6) AS commit_mean, round(mean, 6) AS mean FROM rsum"
    ),
)
register(
    "i09_definitive_floor",
    repositories(lambda r: r.summary.select("repo", r6("overall_ai_probability").alias("overall_ai_probability"))),
    source_sql("SELECT repo, round(greatest(mean, coalesce(flr, 0)), 6) AS overall_ai_probability FROM rsum"),
)
_RCONF = f"CASE WHEN flr IS NOT NULL THEN 'very_high' WHEN level IS NULL THEN 'very_low' ELSE {_BAND.format('level / 4')} END"
register(
    "i10_repo_confidence",
    repositories(
        lambda r: r.summary.select("repo", "overall_confidence").join(
            A.repo_totals(A.type_totals(r.file_scores)).select("repo", confidence_band(F.col("level") / 4).alias("category_level")), "repo", "left"
        )
    ),
    source_sql(
        f"SELECT repo, {_RCONF} AS overall_confidence, CASE WHEN level IS NOT NULL THEN {_BAND.format('level / 4')} "
        "WHEN w IS NULL AND total_files > 0 THEN 'very_high' END AS category_level FROM rsum"
    ),
)
register(
    "i11_top_ai_signals",
    repositories(lambda r: r.summary.select("repo", F.array_join("top_ai_signals", "|").alias("top"))),
    source_sql("SELECT repo, coalesce(array_to_string(top, '|'), '') AS top FROM rall LEFT JOIN topai USING (repo)"),
)
register(
    "i12_top_human_signals",
    repositories(lambda r: r.summary.select("repo", F.array_join("top_human_signals", "|").alias("top"))),
    source_sql("SELECT repo, coalesce(array_to_string(top, '|'), '') AS top FROM rall LEFT JOIN tophu USING (repo)"),
)
register(
    "i13_attributed_commit_signals",
    in_utc(lambda s, d: attributed_commits(corpus.files(s, d), corpus.source_commits(s, d), UNCAPPED)),
    source_sql("SELECT repo, nc AS ai_attributed_commits FROM rsum"),
)
register(
    "i14_repo_totals",
    in_utc(lambda s, d: repository_totals(corpus.files(s, d), corpus.source_commits(s, d), UNCAPPED)),
    source_sql("SELECT repo, total_files, total_lines FROM rsum"),
)

# ---------------------------------------------------------------- J: reports
_PCT = "format('{{:.1f}}', {0} * 100) || '%'"
_RISK = "CASE WHEN {0} < 0.3 THEN 'green' WHEN {0} < 0.5 THEN 'yellow' WHEN {0} < 0.7 THEN 'orange1' ELSE 'red' END"
O.CTES["wide"] = (
    "SELECT repo, max(p) FILTER (content_type = 'code') AS code, max(p) FILTER (content_type = 'documentation') AS documentation, "
    "max(p) FILTER (content_type = 'configuration') AS configuration FROM ccat GROUP BY repo"
)
_STAMP = "2024-01-01"
_HEADER = (
    "struct<repository:string,timestamp:string,summary:struct<overall_ai_probability:double,confidence:string,total_files:bigint,"
    "total_lines:bigint>,breakdown:struct<code:struct<ai_probability:double,top_signals:array<string>>,documentation:struct<"
    "ai_probability:double,top_signals:array<string>>,configuration:struct<ai_probability:double,top_signals:array<string>>>,"
    "top_ai_signals:array<string>>"
)
_FILE_LINE = "struct<path:string,type:string,ai_probability:double,signals:array<struct<name:string>>>"


def json_contents(scores) -> DataFrame:
    """The JSON lines read back, so their contents can be checked, a row per line: a repo's header, whose path is null,
    and its files."""
    lines = R.json_report_lines(scores, F.lit(_STAMP).cast("timestamp"))
    d, f = F.from_json("line", _HEADER), F.from_json("line", _FILE_LINE)
    is_head = F.col("path").isNull()
    lines = lines.select("repo", "path", F.when(is_head, d).alias("d"), F.when(~is_head, f).alias("f"))
    names = F.array_join(F.transform("f.signals", lambda x: x["name"]), "|")
    return lines.select(
        "repo",
        "path",
        F.col("d.repository").alias("repository"),
        F.col("d.timestamp").alias("timestamp"),
        r6("d.summary.overall_ai_probability").alias("overall_ai_probability"),
        F.col("d.summary.confidence").alias("confidence"),
        *[r6(f"d.breakdown.{t}.ai_probability").alias(t) for t in ("code", "documentation", "configuration")],
        F.array_join("d.breakdown.code.top_signals", "|").alias("code_top"),
        F.array_join("d.top_ai_signals", "|").alias("top_ai_signals"),
        F.col("f.path").alias("file_path"),
        F.col("f.type").alias("file_type"),
        r6("f.ai_probability").alias("file_ai_probability"),
        names.alias("file_signals"),
    )


register(
    "j01_json_reports",
    repositories(json_contents),
    source_sql(
        f"SELECT r.repo, CAST(NULL AS VARCHAR) AS path, r.repo AS repository, '{_STAMP}T00:00:00' AS timestamp, round(greatest(mean, coalesce(flr, 0)), 6) AS overall_ai_probability, "
        f"{_RCONF} AS confidence, round(code, 6) AS code, round(documentation, 6) AS documentation, round(configuration, 6) AS configuration, "
        "array_to_string(ct.top, '|') AS code_top, coalesce(array_to_string(ta.top, '|'), '') AS top_ai_signals, "
        "NULL AS file_path, NULL AS file_type, NULL AS file_ai_probability, NULL AS file_signals "
        "FROM rsum r LEFT JOIN wide w ON r.repo = w.repo LEFT JOIN topai ta ON r.repo = ta.repo "
        "LEFT JOIN (SELECT * FROM ctop WHERE content_type = 'code') ct ON r.repo = ct.repo "
        "UNION ALL SELECT repo, path, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, path, content_type, round(p, 6), coalesce(ns, '') "
        f"FROM fscore LEFT JOIN (SELECT {KEYS}, string_agg(name, '|' ORDER BY ord) AS ns FROM sig GROUP BY {KEYS}) USING (repo, path)"
    ),
)
_TITLE = (
    "CASE {0} WHEN 'very_low' THEN 'Very Low' WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium' WHEN 'high' THEN 'High' ELSE 'Very High' END"
)
_MD_CATEGORY = (
    "coalesce((SELECT '| {1} | ' || total_files || ' | ' || format('{{:,}}', total_lines) || ' | ' || format('{{:.1f}}', p * 100) || '% | ' || "
    "confidence || ' |' FROM ccat c WHERE c.repo = r.repo AND c.content_type = '{0}'), '| {1} | - | - | - | - |')"
)


def markdown_sql() -> str:
    lines = (
        ["'# Provenance report: ' || r.repo", "''", f"'**Analyzed:** {_STAMP} 00:00:00'", "''", "'## Summary'", "''"]
        + ["'| Metric | Value |'", "'|--------|-------|'"]
        + [f"'| Overall AI Probability | ' || {_PCT.format('greatest(mean, coalesce(flr, 0))')} || ' |'"]
        + [f"'| Confidence | ' || {_TITLE.format('(' + _RCONF + ')')} || ' |'"]
        + ["'| Files Analyzed | ' || total_files || ' |'", "'| Lines Analyzed | ' || format('{:,}', total_lines) || ' |'"]
        + ["''", "'## Breakdown by Content Type'", "''", "'| Category | Files | Lines | AI Probability | Confidence |'"]
        + ["'|----------|-------|-------|----------------|------------|'"]
        + [_MD_CATEGORY.format(t, R.TITLES[t]) for t in ("code", "documentation", "configuration")]
        + ["''", "'## Top AI Indicators'", "''"]
        + ["coalesce('- ' || array_to_string(ta.top, chr(10) || '- '), '- No significant AI indicators found')"]
        + ["''", "'## Files with Highest AI Probability'", "''", "'| File | Type | Lines | AI Probability |'"]
        + ["'|------|------|-------|----------------|'"]
    )
    rows = (
        f"SELECT repo, string_agg(chr(10) || '| ' || path || ' | ' || content_type || ' | ' || line_count || ' | ' || {_PCT.format('p')} || ' |', '' ORDER BY k) AS fr "
        "FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY p DESC, path) AS k FROM fscore) WHERE k <= 15 AND p > 0.3 GROUP BY repo"
    )
    joined = " || chr(10) || ".join(f"({x})" for x in lines)
    return source_sql(
        f"SELECT r.repo, {joined} || coalesce(fr, '') AS report FROM rsum r LEFT JOIN topai ta ON r.repo = ta.repo LEFT JOIN ({rows}) f ON r.repo = f.repo"
    )


register(
    "j02_markdown_reports",
    repositories(lambda r: R.markdown_reports(r, F.lit(_STAMP).cast("timestamp"))),
    markdown_sql(),
)
O.CTES["firsts"] = f"SELECT {KEYS}, arg_min(name, ord) AS name FROM sig GROUP BY {KEYS}"
register(
    "j03_flagged_files",
    lambda s, d: R.flagged_files(scored(s, d)),
    with_ctes(
        f"SELECT repo, r::INT AS r, path, upper(left(content_type, 1)) || content_type[2:4] AS type, line_count::INT AS line_count, "
        f"{_PCT.format('p')} AS ai_probability, {_RISK.format('p')} AS band, coalesce(name, '-') AS top_signal FROM (SELECT f.*, name, "
        "row_number() OVER (PARTITION BY repo ORDER BY p DESC, path) AS r FROM fscore f LEFT JOIN firsts USING (repo, path) WHERE p > 0.4) WHERE r <= 10"
    ),
)
register(
    "j04_detailed_files",
    lambda s, d: R.detailed_files(scored(s, d)).select(
        "repo", "path", "content_type", "ai_probability", "confidence",
        F.array_join(F.transform("signals", lambda x: F.concat_ws(" ", x["name"], x["score"], x["weight"])), "|").alias("signals"),
    ),
    with_ctes(
        f"SELECT f.repo, f.path, content_type, {_PCT.format('p')} AS ai_probability, confidence, coalesce(sg, '') AS signals FROM fscore f LEFT JOIN "
        f"(SELECT {KEYS}, string_agg(name || ' ' || format('{{:.0f}}', score * 100) || '% ' || format('{{:.1f}}', weight), '|' ORDER BY ord) AS sg "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY ord) AS r FROM sig) WHERE r <= 5 GROUP BY {KEYS}) x "
        "ON f.repo = x.repo AND f.path = x.path"
    ),
)
register(
    "j05_summary_texts",
    repositories(lambda r: R.summary_texts(r.summary, r.categories).drop("band")),
    source_sql(
        f"SELECT repo, {_PCT.format('greatest(mean, coalesce(flr, 0))')} AS overall_ai_probability, {_RCONF} AS confidence, "
        + ", ".join(f"coalesce({_PCT.format(t)}, 'N/A') AS {t}" for t in ("code", "documentation", "configuration"))
        + ", total_files, total_lines FROM rsum LEFT JOIN wide USING (repo)"
    ),
)
register(
    "j06_risk_band",
    lambda s, d: scored(s, d).select("repo", "path", risk_band(F.col("ai_probability")).alias("band")),
    with_ctes(f"SELECT {KEYS}, {_RISK.format('p')} AS band FROM fscore"),
)
register(
    "j07_verdict_codes",
    lambda s, d: scored(s, d).select(
        "repo", "path", repo_verdict(F.col("ai_probability")).alias("repo_code"), snippet_verdict(F.col("ai_probability")).alias("snippet_code")
    ),
    with_ctes(
        f"SELECT {KEYS}, CASE WHEN p < 0.3 THEN 0 WHEN p < 0.7 THEN 1 ELSE 2 END AS repo_code, CASE WHEN p < 0.5 THEN 0 ELSE 1 END AS snippet_code FROM fscore"
    ),
)
register(
    "j08_definitive_panel",
    repositories(lambda r: R.definitive_panel(r).select("repo", "r", "name", "score")),
    source_sql(
        f"SELECT repo, r::INT AS r, name, format('{{:.0f}}', score * 100) || '%' AS score FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_PLACE}) AS r "
        f"FROM every WHERE {_DEF}) WHERE r <= 10"
    ),
)
register(
    "j09_commit_panel",
    in_utc(
        lambda s, d: R.commit_panel(
            repository_signals(corpus.files(s, d), corpus.source_commits(s, d), UNCAPPED)
        ).select("repo", "r", "icon", "name", "score")
    ),
    source_sql(
        f"SELECT repo, r::INT AS r, CASE WHEN score > 0.8 THEN '🤖' ELSE '📝' END AS icon, name, format('{{:.0f}}', score * 100) || '%' AS score FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY repo ORDER BY {_PLACE}) AS r FROM rsig WHERE regexp_matches(lower(name), '{'|'.join(R.COMMIT_WORDS)}')) WHERE r <= 8"
    ),
)
register(
    "j10_category_breakdown",
    repositories(lambda r: R.category_breakdown(r.summary, r.categories)),
    source_sql(
        "SELECT repo, category, coalesce(total_files::VARCHAR, '-') AS files, coalesce(format('{:,}', total_lines), '-') AS lines, "
        f"coalesce({_PCT.format('p')}, '-') AS ai_probability, CASE WHEN p IS NULL THEN '-' ELSE {_RISK.format('p')} END AS band, "
        "CASE confidence WHEN 'very_low' THEN 'Very Low' WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium' WHEN 'high' THEN 'High' WHEN 'very_high' "
        "THEN 'Very High' ELSE '-' END AS confidence FROM (SELECT repo, unnest(['code', 'documentation', 'configuration']) AS content_type, "
        "unnest(['Code', 'Documentation', 'Configuration']) AS category FROM rall) LEFT JOIN ccat USING (repo, content_type)"
    ),
)


# ---------------------------------------------------------------- J11, K3: snippets, with the roles as types
# The same rule SQL over another table of texts.
_SNIPPETS = {
    "elig": "SELECT conv_id::VARCHAR AS repo, turn::VARCHAR || '.' || role AS path, text AS content, lower(text) AS low, "
    "len(str_split(text, chr(10))) AS line_count, CASE role WHEN 'user' THEN 'documentation' WHEN 'assistant' THEN 'code' "
    "ELSE 'configuration' END AS content_type FROM conversations",
    "sig": " UNION ALL ".join(
        f"SELECT {KEYS}, {_order.index(rid)} AS ord, {O.rule_name(rid)} AS name, score::DOUBLE AS score, ({O.rule_weight(rid)})::DOUBLE AS weight "
        f"FROM ({O.RULES[rid][2]}) WHERE score IS NOT NULL"
        for rid in _families
        if rid[0] in "EF"
    ),
}


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus.table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.concat_ws(".", F.col("turn").cast("string"), F.col("role"))).alias("snippet"),
        F.col("text").alias("content"),
        F.when(F.col("role") == "user", "documentation")
        .when(F.col("role") == "assistant", "code")
        .otherwise("configuration")
        .alias("content_type"),
    )
    return score_texts(texts)


register(
    "j11_snippet_view",
    lambda s, d: R.snippet_view(snippets(s, d), "snippet").select("snippet", "verdict", "r", "name", "signal_score"),
    with_ctes(
        "SELECT f.repo || '/' || f.path AS snippet, CASE WHEN p < 0.5 THEN 0 ELSE 1 END AS verdict, r::INT AS r, name, format('{:.0f}', score * 100) || '%' AS signal_score "
        f"FROM fscore f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY score * weight DESC, ord) AS r FROM sig) g "
        "ON f.repo = g.repo AND f.path = g.path WHERE r IS NULL OR r <= 10",
        _SNIPPETS,
    ),
)

# ---------------------------------------------------------------- K: whole jobs
register(
    "k01_repositories",
    repositories(
        lambda r: r.summary.select(
            "repo", r6("overall_ai_probability").alias("overall_ai_probability"), "overall_confidence", "total_files", "total_lines",
            F.array_join("top_ai_signals", "|").alias("top_ai_signals"), F.array_join("top_human_signals", "|").alias("top_human_signals"),
            "ai_attributed_commits", "verdict",
        )
    ),
    source_sql(
        f"SELECT repo, round(greatest(mean, coalesce(flr, 0)), 6) AS overall_ai_probability, {_RCONF} AS overall_confidence, total_files, total_lines, "
        "coalesce(array_to_string(a.top, '|'), '') AS top_ai_signals, coalesce(array_to_string(h.top, '|'), '') AS top_human_signals, "
        "nc AS ai_attributed_commits, CASE WHEN greatest(mean, coalesce(flr, 0)) < 0.3 THEN 0 WHEN greatest(mean, coalesce(flr, 0)) < 0.7 THEN 1 ELSE 2 END AS verdict "
        "FROM rsum LEFT JOIN topai a USING (repo) LEFT JOIN tophu h USING (repo)"
    ),
)
register(
    "k02_file_signals",
    lambda s, d: scored(s, d)
    .select("repo", "path", F.posexplode("signals").alias("ord", "s"))
    .select("repo", "path", "ord", F.col("s.name").alias("name"), r6("s.score").alias("score"), F.col("s.weight").alias("weight")),
    with_ctes(
        f"SELECT {KEYS}, (row_number() OVER (PARTITION BY {KEYS} ORDER BY ord) - 1)::INT AS ord, name, round(score, 6) AS score, weight FROM sig"
    ),
)
register(
    "k03_snippets",
    lambda s, d: snippets(s, d).select(
        "snippet", "content_type", "line_count", r6("ai_probability").alias("ai_probability"), "confidence", "ai_line_estimate"
    ),
    with_ctes(
        "SELECT repo || '/' || path AS snippet, content_type, line_count::INT AS line_count, round(p, 6) AS ai_probability, confidence, "
        "ai_lines AS ai_line_estimate FROM fscore",
        _SNIPPETS,
    ),
)
register(
    "k04_commit_history",
    in_utc(
        lambda s, d: corpus.commits(s, d).select("repo").distinct().join(
            score_commits(corpus.commits(s, d))[1].groupBy("repo").agg(
                F.count("*").alias("n"), r6(F.sum(F.col("s.score") * F.col("s.weight")) / F.sum("s.weight")).alias("mean")
            ),
            "repo", "left",
        ).select("repo", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean")
    ),
    with_ctes(
        "SELECT r.repo, coalesce(n, 0) AS n, round(m, 6) AS mean FROM (SELECT DISTINCT repo FROM newest) r LEFT JOIN (SELECT repo, count(*) AS n, "
        "sum(score * weight) / sum(weight) AS m FROM hall GROUP BY repo) x ON r.repo = x.repo"
    ),
)
