"""Hand-computed cases for each formula and threshold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from authorscope import ScoringConfig, score_commits, score_files, score_repositories, score_texts
from authorscope.functions import text as T
from authorscope.operators import aggregate, classify, commits, intake, markers
from authorscope.operators.bursts import burst_statistics
from authorscope.operators.scoring import with_score
from authorscope.schema import FILES_SCHEMA, SIGNALS

FIVE = "\n".join(["plain"] * 5)
COMMITS = "repo string, sha string, message string, author string, author_email string, date timestamp, files_changed int"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def column(spark, make, *values, kind="string"):
    """Evaluate an expression over single-column rows, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[1] for r in df.select("i", make(F.col("x"))).orderBy("i").collect()]


def score_of(spark, signals, lines=10):
    rows = [("r", lines, [("X", n, s, w, "", []) for n, s, w in signals])]
    df = spark.createDataFrame(rows, f"repo string, line_count int, signals {SIGNALS}")
    return one(with_score(df))


def files(spark, *rows):
    return spark.createDataFrame([(r, p, len(c.encode()), c) for r, p, c in rows], FILES_SCHEMA)


def history(spark, *rows):
    return spark.createDataFrame(list(rows), COMMITS)


def at(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def test_weighted_mean_and_confidence(spark):
    r = score_of(spark, [("a", 0.6, 0.4), ("b", 0.5, 0.4)])
    assert r.ai_probability == pytest.approx(0.55)
    assert r.confidence == "low"
    assert r.ai_line_estimate == 5


@pytest.mark.parametrize(
    "signals, probability",
    [
        ([("a", 0.98, 0.95), ("b", 0.4, 0.3)], 0.98),
        ([("a", 0.75, 0.95), ("b", 0.95, 0.7)], 0.81),
        ([("a", 0.45, 0.9)], 0.465),
        ([("DEFINITIVE: x", 0.5, 0.1), ("b", 0.2, 0.5)], 0.5),
    ],
)
def test_definitive_scores(spark, signals, probability):
    r = score_of(spark, signals)
    assert r.ai_probability == pytest.approx(probability)
    assert r.confidence == "very_high"


def test_many_signals_push_to_the_extremes(spark):
    assert score_of(spark, [("a", 0.6, 0.5)] * 10).ai_probability == pytest.approx(0.64)
    assert score_of(spark, [("a", 0.6, 0.5)] * 9).ai_probability == pytest.approx(0.6)
    assert score_of(spark, [("a", 0.4, 0.5)] * 10).ai_probability == pytest.approx(0.36)


def test_no_signals(spark):
    r = score_of(spark, [])
    assert (r.ai_probability, r.confidence, r.ai_line_estimate) == (0.0, "very_low", 0)


def test_content_types(spark):
    cases = {
        "setup.py": "configuration", "requirements.txt": "configuration", ".eslintrc": "configuration",
        "docs/x.py": "code", "LICENSE": "documentation", "a.R": "code", "x.csv": "data",
        ".env.local": "configuration", "logo.ai": "unknown", "docs/a.txt": "documentation", "bashrc": "configuration",
        ".github/ci": "configuration", "my-readme-old": "documentation", "..x": "unknown", "a/b.TOML": "configuration",
    }
    assert column(spark, classify.content_type, *cases) == list(cases.values())
    assert column(spark, classify.language, "a.py", "b.HPP", "c.sql", "d.txt") == ["python", "cpp", "sql", None]


def test_line_count_and_comments(spark):
    assert column(spark, T.line_count, "a\nb\n", "", "x") == [3, 1, 1]
    text = "## x\n### y\n# z\n/// q\n;; r\n-- s\n; t"
    got = column(spark, lambda x: T.comments(F.transform(T.lines(x), T.strip)), text)
    assert got == [["z", "/ q", "s", "t"]]


def test_blank_runs(spark):
    text = "\n".join(["", "a", "", "", "b", ""])
    assert column(spark, lambda x: T.blank_runs(F.transform(T.lines(x), T.strip)), text) == [[1, 2]]


def test_chunks(spark):
    parts = ["a" * 300, "b" * 300, "c" * 20, "d" * 600, "e" * 40]
    got = column(spark, T.chunks, "\n\n".join(parts))[0]
    assert [len(c) for c in got] == [300, 321, 600]


def fired(spark, kind, content):
    df = spark.createDataFrame([(content, kind)], "content string, content_type string")
    return {s.rule_id: s for s in one(score_texts(df)).signals}


def test_phrase_cap_and_dead_rules(spark):
    s = fired(spark, "documentation", "note that it holds. " * 5)["E7"]
    assert (s.score, s.weight, s.evidence) == (pytest.approx(0.95), 0.3, ["note that"] * 3)
    got = fired(spark, "documentation", "YOUR_API_KEY_HERE. This project provides it. " * 3)
    assert "E10" not in got and "E42" not in got
    assert fired(spark, "code", "hope this helps " + "x" * 50)["E15"].score == pytest.approx(0.45)


def test_short_text_is_not_checked(spark):
    assert fired(spark, "documentation", "hope this helps") == {}


def test_tab_indent_is_irregular(spark):
    tabs, spaces = "\n".join(["\tx = 1"] * 12), "\n".join(["  x = 1"] * 12)
    assert "E27" not in fired(spark, "code", tabs)
    assert fired(spark, "code", spaces)["E27"].evidence == ["Indent levels: [2]"]


def test_urls_count_as_config_comments(spark):
    text = "\n".join(['"u": "http://example.org/a"'] * 5)
    assert fired(spark, "configuration", text)["E45"].score == 0.4


def test_zipf_of_distinct_tokens(spark):
    got = fired(spark, "documentation", " ".join(f"w{i:03d}x" for i in range(200)))
    assert "F4" not in got and got["F5"].score == 0.5


def test_equal_line_lengths(spark):
    line = "abc def ghi jkl mno"
    assert fired(spark, "code", "\n".join([line] * 12))["F11"].score == pytest.approx(0.6)


def test_burstiness_of_even_and_clustered_words(spark):
    words = [f"word{chr(97 + i)}" for i in range(12)]
    even = " ".join(words * 10)
    assert fired(spark, "documentation", even)["F2"].name == "Low burstiness"
    clustered = " ".join(" ".join([w] * 20) for w in words)
    assert fired(spark, "documentation", f"{clustered} {clustered}")["F3"].evidence == ["Average burstiness: 0.679"]


def test_marker_suffix_and_summary(spark):
    got = {r.path: r for r in markers.marker_rows(files(spark, ("r", "logo.ai", ""), ("r", ".cursor/rules.txt", ""))).collect()}
    assert list(got) == ["logo.ai"] and got["logo.ai"].s.score == 0.8
    rows = markers.marker_rows(files(spark, ("r", "CLAUDE.md", ""), ("r", ".cursorrules", "")))
    summary = one(markers.multiple_markers(rows))
    assert (summary.n, summary.s.score, summary.s.evidence) == (2, 0.95, [".cursorrules", "CLAUDE.md"])


def test_repository_of_one_marker(spark):
    r = one(score_repositories(files(spark, ("r", "logo.ai", "x"))).summary)
    assert (r.overall_ai_probability, r.overall_confidence, r.total_files) == (pytest.approx(0.8), "very_high", 0)
    assert r.verdict == 2


def test_marker_floor_over_plain_code(spark):
    r = one(score_repositories(files(spark, ("r", "logo.ai", "x"), ("r", "a.py", "\n" * 999))).summary)
    assert r.overall_ai_probability == pytest.approx(0.68)
    assert r.total_lines == 1000



@pytest.mark.parametrize(
    "weighted, weight, commit, definitive, expected",
    [
        (168.0, 530.0, None, False, 168 / 530),
        (168.0, 530.0, 0.95, True, 169.9 / 532),
        (None, None, 0.5, False, 0.5),
        (None, None, None, False, 0.0),
    ],
)
def test_overall_probability(spark, weighted, weight, commit, definitive, expected):
    df = spark.createDataFrame([(weighted, weight, commit, definitive)], "a double, b double, c double, d boolean")
    got = one(df.select(aggregate.overall_probability(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("p"))).p
    assert got == pytest.approx(expected)


def test_small_category_has_low_confidence(spark):
    rows = [("r", f"{i}.md", FIVE) for i in range(2)]
    assert one(aggregate.category_summary(score_files(files(spark, *rows)))).confidence == "low"


def test_commit_score(spark):
    message = "this commit adds a thing " + "word " * 50
    got = one(score_commits(history(spark, ("r", "s", message, "a", "b", at(0), 1)))[0])
    assert got.ai_probability == pytest.approx((0.6 * 0.6 + 0.5 * 0.3) / 0.9)
    assert len(got.message) == 100


def test_burst_windows(spark):
    moments = [("r", s * 1_000_000, n) for s, n in ((0, 1), (3600, 1), (3601, 1), (3700, 2), (7201, 1), (7202, 1))]
    df = spark.createDataFrame(moments, "repo string, at long, n int")
    found = one(burst_statistics(df, 1, least=1))
    assert (found.largest_burst, found.first_bursts) == (4, [2, 4, 1])


def signals_of(spark, rows, config=ScoringConfig()):
    return {r.s.rule_id: r.s for r in score_commits(history(spark, *rows), config)[1].collect()}


def test_burst_and_hour_rules(spark):
    got = signals_of(spark, [("r", f"{i:02d}", f"m{i} x", "a", "b", at(i * 200), 1) for i in range(12)])
    assert got["H11"].score == pytest.approx(0.66)
    assert got["H14"].description == "12/12 commits at 0:00"
    assert "H11" not in signals_of(spark, [("r", f"{i}", "m", "a", "b", at(i), 1) for i in range(9)])


def test_ai_commit_ratio(spark):
    def rows(marked):
        return [("r", str(i), "Generated with Claude Code" if i < marked else "m", "a", "b", at(i), 1) for i in range(10)]

    got = signals_of(spark, rows(2))
    assert got["D7"].score == pytest.approx(0.6) and got["D9"].weight == 0.98
    got = signals_of(spark, rows(1))
    assert "D7" not in got and "D9" in got


def test_commit_cap(spark):
    rows = [("r", f"{i:03d}", "m", "a", "b", at(i), 1) for i in range(120)]
    assert score_commits(history(spark, *rows))[0].count() == 120
    assert score_commits(history(spark, *rows), ScoringConfig(max_commits=100))[0].count() == 100


def test_file_cap_keeps_the_first_paths(spark):
    rows = [("big", f"f{i:02d}.py", "x") for i in range(9)] + [("small", "a.py", "x")]
    for limit in (64 * 1024 * 1024, 0):  # broadcast and shuffle join
        kept = intake.cap_files(files(spark, *rows), ScoringConfig(max_files=4, broadcast_limit_bytes=limit))
        assert sorted(r.path for r in kept.collect() if r.repo == "big") == [f"f{i:02d}.py" for i in range(4)]
        assert kept.where("repo = 'small'").count() == 1


def test_ignore_and_hidden_paths(spark):
    paths = ["node_modules/a.js", "a/node_modules", "x.min.js", "src/build/x.c", "Cargo.lock", "a.egg-info/b", "src/a.py"]
    assert column(spark, intake.ignored, *paths) == [True, False, True, True, True, True, False]
    paths = [".git2/a", ".github/a", "a/.Claude/b", ".hidden", "a/.x/b"]
    assert column(spark, intake.in_hidden_directory, *paths) == [True, False, False, False, True]


def test_binary_and_decoding(spark):
    values = [bytearray(v) for v in (b"", b"ab\x00", b"\x01\x02\x03ab", b"\x01ab cd ef", "é".encode())]
    assert column(spark, intake.looks_binary, *values, kind="binary") == [False, True, True, False, False]
    values = [bytearray(v) for v in (b"a\r\nb\rc\n", "né".encode(), b"n\xe9")]
    assert column(spark, intake.decode_text, *values, kind="binary") == ["a\nb\nc\n", "né", "né"]


def test_repository_names(spark):
    urls = ["https://github.com/o/r.git", "git@gitlab.com:o/r", "https://bitbucket.org/o/r", "https://x.org/a/b/", "name"]
    assert column(spark, intake.repository_name, *urls) == ["o/r", "o/r", "o/r", "b", "name"]
    assert column(spark, intake.is_remote, *urls) == [True, True, True, True, False]


def test_one_row_per_repo_without_scored_files(spark):
    got = one(score_repositories(files(spark, ("r", "a.unknown", "x"))).summary)
    assert (got.overall_ai_probability, got.overall_confidence, got.verdict) == (0.0, "very_low", 0)
