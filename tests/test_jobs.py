"""Whole jobs: reports, raw trees, streaming, scorers, and the shape of the physical plans."""

import json
import os
import random
import re

import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authorscope import ScoringConfig, score_files, score_repositories, score_texts
from authorscope.operators import commits, intake, markers
from authorscope.operators.bursts import burst_statistics
from authorscope.operators.topk import leading_rows, without_tails
from authorscope.plans.durable import durable, shared_folder
from authorscope.schema import FILES_SCHEMA
from authorscope.sinks import reports
from authorscope.sources.raw_tree import below, bounded_reads, list_trees, read_trees, text_of_file
from authorscope.sources.tables import read_table, spread_rows
from authorscope.streaming import add_batch, read_repository_scores, write_file_scores, write_repository_scores
from checks import corpus

SF = "/root/testdata/sf0.001"
DOC = "Note that it works.\n\nHope this helps you.\n- **A**: b\n- **B**: c\n- **C**: d\n\nLet me explain it all.\n"
CODE = "# initialize the variable\nx = 1\n# Check if it holds\ny = 2\n# return the result\nz\n"


@pytest.fixture(scope="module")
def scores(spark):
    rows = [
        ("one", "README.md", len(DOC), DOC), ("one", "src/a.py", len(CODE), CODE), ("one", "CLAUDE.md", len(DOC), DOC),
        ("two", "b.py", len(CODE), CODE), ("three", "x.bin", 1, "x"),
    ]
    return score_repositories(spark.createDataFrame(rows, FILES_SCHEMA))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_json_report(scores):
    stamp = F.lit("2024-01-01").cast("timestamp")
    docs = {r.repo: json.loads(r.report) for r in reports.json_reports(scores, analyzed_at=stamp, duration_seconds=1.5).collect()}
    one = docs["one"]
    assert one["repository"] == "one" and one["timestamp"] == "2024-01-01T00:00:00"
    assert [f["path"] for f in one["files"]] == ["CLAUDE.md", "README.md", "src/a.py"]
    assert one["summary"]["confidence"] == "very_high" and one["summary"]["analysis_duration_seconds"] == 1.5
    assert one["breakdown"]["configuration"] is None and one["breakdown"]["code"]["total_files"] == 1
    assert set(one["files"][0]["signals"][0]) == {"name", "score", "weight", "description"}
    assert docs["three"]["files"] == [] and docs["three"]["summary"]["total_files"] == 0
    with pytest.raises(ValueError):
        reports.json_reports(scores, ScoringConfig(max_files=None))


def test_json_lines_cover_every_file(scores):
    lines = [json.loads(r.line) for r in reports.json_file_lines(scores.file_scores).collect()]
    assert len(lines) == scores.file_scores.count() == 4


def test_json_report_lines_of_an_uncapped_config(scores):
    found = reports.json_report_lines(scores, F.lit("2024-01-01").cast("timestamp"), duration_seconds=1.5)
    rows = found.collect()
    assert [(r.repo, r.path) for r in rows] == [
        ("one", None), ("one", "CLAUDE.md"), ("one", "README.md"), ("one", "src/a.py"), ("three", None), ("two", None), ("two", "b.py"),
    ]
    lines = [json.loads(r.line) for r in rows]
    documents = {r.repo: json.loads(r.report) for r in reports.json_reports(scores, None, F.lit("2024-01-01").cast("timestamp"), None, 1.5).collect()}
    for repo, document in documents.items():
        own = [line for r, line in zip(rows, lines) if r.repo == repo]
        assert own[0] | {"files": own[1:]} == document
    assert "collect_list(struct(path" not in plan_of(found)


def test_markdown_report(scores):
    docs = {r.repo: r.report for r in reports.markdown_reports(scores, F.lit("2024-01-01").cast("timestamp")).collect()}
    lines = docs["one"].split("\n")
    assert lines[0] == "# Provenance report: one" and "**Analyzed:** 2024-01-01 00:00:00" in lines
    assert "| Configuration | - | - | - | - |" in lines and "| Confidence | Very High |" in lines
    assert sum(line.endswith("% |") and line.startswith("| CLAUDE.md |") for line in lines) == 1
    assert "- No significant AI indicators found" in docs["three"]


def test_report_tables(scores):
    flagged = reports.flagged_files(scores.file_scores).where("repo = 'one'").orderBy("r").collect()
    assert flagged[0].path == "CLAUDE.md" and flagged[0].type == "Docu" and flagged[0].band == "red"
    assert flagged[0].top_signal == "AI marker file: claude.md"
    texts = {r.repo: r for r in reports.summary_texts(scores.summary, scores.categories).collect()}
    assert texts["three"].code == "N/A" and texts["one"].configuration == "N/A"
    panel = reports.definitive_panel(scores).where("repo = 'one'").orderBy("r").collect()
    assert [p.r for p in panel] == list(range(1, len(panel) + 1))
    assert panel[0].evidence == ["CLAUDE.md"]


def test_raw_trees(spark, tmp_path):
    def put(path, data):
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)

    put("r/.claude/settings.json", b"{}\r\n")
    put("r/pkg/__init__.py", "é = 1\n".encode())
    put("r/.hidden/a.py", b"x")
    put("r/node_modules/a.js", b"x")
    put("r/.env", b"A=1")
    put("r/latin.txt", b"caf\xe9")
    put("r/blob.dat", b"\x00\x01")
    roots = spark.createDataFrame([("r", str(tmp_path / "r"))], "repo string, root string")
    got = {r.path: (r.size, r.content) for r in read_trees(roots).collect()}
    assert got == {
        ".claude/settings.json": (4, "{}\n"), "pkg/__init__.py": (7, "é = 1\n"), ".env": (3, "A=1"), "latin.txt": (4, "café"),
    }


def test_one_large_tree_over_many_tasks(spark, tmp_path):
    """12,000 files below one root: several rounds and tasks, no ignored folder entered, each path once."""
    want = set()
    for i in range(40):
        folder = tmp_path / "r" / f"d{i % 8}" / f"e{i}"
        folder.mkdir(parents=True)
        for k in range(300):
            (folder / f"f{k}.txt").write_bytes(b"x" * (k % 7))
            want.add((f"d{i % 8}/e{i}/f{k}.txt", k % 7))
    for name in ("node_modules", ".hidden", "d1/build"):
        (tmp_path / "r" / name).mkdir(parents=True)
        (tmp_path / "r" / name / "a.js").write_bytes(b"x")
    os.symlink(tmp_path / "r", tmp_path / "r" / "d0" / "loop")
    roots = spark.createDataFrame([("r", str(tmp_path / "r")), ("gone", str(tmp_path / "none"))], "repo string, root string")
    listing = list_trees(roots, entries=500)
    assert sorted((r.path, r.size) for r in listing.collect()) == sorted(want)
    assert "FileScan parquet" in plan_of(listing) and plan_of(listing).count("FileScan") >= 2
    entered = []

    def enters(path, name):
        entered.append(path)
        return name != "node_modules"

    rounds = list(below(str(tmp_path / "r"), "", enters, entries=500))
    assert sum(unread for _, _, unread in rounds) > 10 and len(rounds) < 1500
    assert not any(p.startswith("node_modules/") for p in entered)
    kept = read_trees(roots, ScoringConfig(max_file_size=3))
    assert kept.count() == sum(size <= 3 for _, size in want)


def test_contents_leave_a_task_by_bytes(tmp_path):
    for i in range(100):
        (tmp_path / f"f{i}").write_bytes(b"t" * 1000)
    (tmp_path / "binary").write_bytes(b"\0" + b"t" * 100_000)
    (tmp_path / "late").write_bytes(b"t" * 9000 + b"\0")
    names = [f"f{i}" for i in range(100)] + ["binary", "missing", "late"]
    rows = pd.DataFrame({"repo": "r", "root": str(tmp_path), "path": names, "size": 1})
    pieces = list(bounded_reads(rows, 8192, limit=10_000))
    assert [len(p) for p in pieces] == [10] * 10 + [3] and list(pieces[0].columns) == ["repo", "path", "size", "content"]
    assert [len(c or b"") for c in pieces[-1]["content"]] == [0, 0, 9001]
    assert text_of_file(str(tmp_path / "late"), None) is None


def test_whole_content_sniff(spark):
    df = spark.createDataFrame([(b"t" * 9000 + b"\0",), (b"text",), (b"",)], "c binary")
    got = df.select(intake.looks_binary(F.col("c")).alias("head"), intake.looks_binary(F.col("c"), None).alias("whole")).collect()
    assert [tuple(r) for r in got] == [(False, True), (False, False), (False, False)]


@pytest.mark.parametrize(
    "patterns, dropped, kept",
    [
        (("**/tmp",), ["tmp", "a/tmp/x", "a/b/tmp"], ["atmp", "a/tmpx"]),
        (("docs/**",), ["docs/a", "docs/a/b"], ["docs", "x/docs/a"]),
        (("a/**/b",), ["a/b", "a/x/b", "a/x/y/b/c"], ["x/a/b", "a/xb"]),
        (("*.log", "!keep.log"), ["a.log", "x/b.log"], ["keep.log", "x/keep.log"]),
        (("*.log", "!keep.log", "x/"), ["x/keep.log", "x/a"], ["keep.log"]),
        (("!a.log", "*.log"), ["a.log"], ["a.txt"]),
    ],
)
def test_ignore_patterns(spark, patterns, dropped, kept):
    df = spark.createDataFrame([(p,) for p in dropped + kept], "path string")
    got = {r.path for r in df.where(intake.ignored(F.col("path"), patterns)).collect()}
    assert got == set(dropped)


def test_stream_equals_batch(spark, tmp_path):
    files = corpus.files(spark, SF)
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    files.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(source)
    write_file_scores(stream, output, str(tmp_path / "checkpoint")).awaitTermination()
    key = ["repo", "path", "ai_probability", "confidence", "line_count"]
    batch = score_files(intake.select_files(files)).select(*key)
    streamed = spark.read.parquet(output).select(*key)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0


def rounded(rows):
    """Rows as tuples, to nine places, in order: sums of doubles depend on their order."""
    plain = lambda v: round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted((tuple(plain(v) for v in r) for r in rows.collect()), key=str)


def same_scores(got, want):
    order = lambda df: rounded(df.select(*sorted(df.columns)))
    assert order(got.categories) == order(want.categories)
    assert order(got.summary) == order(want.summary)
    assert got.file_scores.count() == want.file_scores.count()


def test_streamed_sums_equal_batch(spark, tmp_path):
    """Three micro-batches give the categories and verdicts of one batch job."""
    files = corpus.files(spark, SF)
    source, folder = str(tmp_path / "in"), str(tmp_path / "sums")
    files.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(source)
    write_repository_scores(stream, folder, str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(f"{folder}/done").agg(F.max("batch")).first()[0] >= 2
    same_scores(read_repository_scores(spark, folder), score_repositories(files))


def test_a_replayed_batch_counts_once(spark, tmp_path):
    """The sink ran, but the batch was not committed and comes again."""
    files, folder = corpus.files(spark, SF), str(tmp_path / "sums")
    parts = [files.where(F.crc32(F.col("path").cast("binary")) % 2 == i) for i in range(2)]
    for batch in (0, 0, 1, 1):
        add_batch(parts[batch], batch, folder)
    same_scores(read_repository_scores(spark, folder), score_repositories(files))


def test_streamed_sums_of_nothing(spark, tmp_path):
    files = corpus.files(spark, SF)
    folder = str(tmp_path / "sums")
    add_batch(files.limit(0), 0, folder)
    assert read_repository_scores(spark, folder).summary.count() == 0
    add_batch(files, 1, folder)
    add_batch(files.limit(0), 2, folder)
    assert rounded(read_repository_scores(spark, folder).categories) == rounded(score_repositories(files).categories)


def test_reports_written_in_ranges(spark, tmp_path):
    """Files of bounded size, in order, that hold every line once."""
    scores = score_repositories(corpus.files(spark, SF))
    folder, stamp = str(tmp_path / "reports"), F.lit("2024-01-01").cast("timestamp")
    reports.write_json_reports(scores, folder, stamp, file_bytes=200_000)
    names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    assert len(names) > 3 and max(os.path.getsize(f"{folder}/{n}") for n in names) < 800_000
    got = [line for n in names for line in open(f"{folder}/{n}", encoding="utf-8").read().split("\n")[:-1]]
    assert got == [r["line"] for r in reports.json_report_lines(scores, stamp).collect()]


def test_scorer_and_fallback(spark):
    def broken(chunks):
        raise RuntimeError("no model")

    def even(chunks):
        return [None if "skip" in c else 10.0 for c in chunks]

    text = "the cat and the dog is in the house of the king to be with it. " * 3
    df = spark.createDataFrame([(text, "documentation"), ("skip " + text, "documentation"), ("short", "documentation")], "content string, content_type string")

    def rules(config):
        rows = score_texts(df, config=config).select("signals").collect()
        return [[s.rule_id for s in r.signals if s.rule_id[0] == "G"] for r in rows]

    base = {"enable_heuristic": False, "enable_statistical": False, "enable_predictability": True}
    assert rules(ScoringConfig(**base))[0][-1] == "G2"
    assert rules(ScoringConfig(**base, scorer=broken))[0] == rules(ScoringConfig(**base))[0]
    assert rules(ScoringConfig(**base, scorer=even)) == [["G3"], [], []]


def test_a_failing_text_fails_alone(spark):
    def picky(chunks):
        if any("poison" in c for c in chunks):
            raise RuntimeError("bad text")
        return [10.0 for _ in chunks]

    text = "the cat and the dog is in the house of the king to be with it. " * 3
    rows = [(i, ("poison " if i == 3 else "") + text, "documentation") for i in range(40)]
    config = ScoringConfig(enable_heuristic=False, enable_statistical=False, enable_predictability=True, scorer=picky)
    got = set()
    for parts in (1, 8, 64):
        df = spark.createDataFrame(rows, "i int, content string, content_type string").repartition(parts)
        found = score_texts(df, config=config).select("i", F.transform("signals", lambda x: x["rule_id"]).alias("r")).collect()
        got.add(tuple(sorted((r.i, tuple(x for x in r.r if x[0] == "G")) for r in found)))
    assert len(got) == 1
    by_row = dict(got.pop())
    assert "G3" not in by_row[3] and all(by_row[i] == ("G3",) for i in by_row if i != 3)


def test_disabled_families(spark):
    df = spark.createDataFrame([("hope this helps " * 20, "documentation")], "content string, content_type string")
    off = ScoringConfig(enable_heuristic=False, enable_statistical=False)
    assert score_texts(df, config=off).first().signals == []
    families = {s.rule_id[0] for s in score_texts(df).first().signals}
    assert families == {"E", "F"}
    only = {s.rule_id[0] for s in score_texts(df, config=ScoringConfig(enable_statistical=False)).first().signals}
    assert only == {"E"}


def test_scoring_is_a_map(spark, tmp_path):
    corpus.files(spark, SF).write.parquet(str(tmp_path / "files"))
    files = read_table(spark, str(tmp_path / "files"))
    plan = plan_of(score_files(intake.select_files(files, ScoringConfig(max_file_size=1_048_576))))
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 1
    assert "PushedFilters: [" in plan and "LessThanOrEqual(size,1048576)" in plan


def test_filters_on_scores_do_not_repeat_the_rules(spark):
    scored = score_files(corpus.files(spark, SF)).where("ai_probability > 0.4 AND confidence <> 'low'")
    assert plan_of(scored).count("regexp_extract_all") < 2 * plan_of(score_files(corpus.files(spark, SF))).count("regexp_extract_all")
    assert "Generate inline" in plan_of(scored)


def test_marker_and_cap_plans_read_paths_only(spark, tmp_path):
    corpus.files(spark, SF).write.parquet(str(tmp_path / "files"))
    files = read_table(spark, str(tmp_path / "files"))
    assert "ReadSchema: struct<repo:string,path:string>" in plan_of(markers.marker_rows(files))
    cut = plan_of(intake.file_cutoffs(files, 5))
    assert "ReadSchema: struct<repo:string,path:string>" in cut and "WindowGroupLimit" in cut


def test_commit_rules_gather_no_history(spark):
    """Only distinct names and a few bursts or bots are ever collected into a row; messages are read once."""
    found = commits.history(commits.newest_commits(corpus.commits(spark, SF)))
    plan = plan_of(commits.repo_statistics(found))
    assert "collect_list" not in plan and not re.search(r"[^_]message#", plan)
    assert set(re.findall(r"collect_set\(([^,)]*)", plan)) <= {f"value#{n}" for n in re.findall(r"value#(\d+)", plan)}
    assert set(found.values.columns) == {"repo", "kind", "value", "n", "first"}


def bursts_one_by_one(moments, width):
    """Sizes of the windows, by one step per moment in time order."""
    anchor, sizes = None, []
    for at, n in sorted(moments):
        if anchor is not None and at - anchor <= width:
            sizes[-1] += n
        else:
            anchor = at
            sizes.append(n)
    return sizes


@pytest.mark.parametrize("hours", [1, 3, 0])
def test_bursts_of_chained_buckets(spark, hours):
    """Against one walk over the whole history: without a pause, with pauses, over edges of buckets and of groups of
    buckets, before 1970, and with commits at the same moment."""
    rng, hour = random.Random(hours), 3_600_000_000
    repos = {"hot": [(rng.randrange(3000 * hour), rng.randrange(1, 4)) for _ in range(12_000)]}
    repos["second"] = [(i * 977_000_000, 1) for i in range(20_000)]
    repos["edges"] = [(16 * hour * i + d, 1) for i in range(-3, 70) for d in (-1, 0, 1, hour - 1, hour, hour + 1)]
    repos["old"] = [(-(10**16) + rng.randrange(40 * hour), 2) for _ in range(300)]
    repos["one"] = [(5, 7)]
    for i in range(60):
        gap = rng.choice([hour // 7, hour, 20 * hour, 1500 * hour])
        repos[f"r{i}"] = [(sum(rng.randrange(gap) for _ in range(2)) * k, 1 + k % 3) for k in range(rng.randrange(1, 40))]
    rows = [(r, at, n) for r, moments in repos.items() for at, n in moments]
    df = spark.createDataFrame(rows, "repo string, at long, n long").groupBy("repo", "at").agg(F.sum("n").alias("n"))
    got = {r.repo: (r.largest_burst, r.first_bursts) for r in burst_statistics(df, hours, 5).collect()}
    want = {}
    for repo, moments in repos.items():
        large = [x for x in bursts_one_by_one(moments, hours * hour) if x >= 5]
        if large:
            want[repo] = (max(large), large[:5])
    assert got == want and len(want) > (20 if hours else 0)


def test_one_busy_repo_is_spread_over_tasks(spark):
    """A third of all commits in one repo that never rests: no task gets more than its share of time."""
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id") % 500)).alias("repo"),
        (F.col("id") * 60_000_000).alias("at"),
        F.lit(1).alias("n"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        buckets = rows.where("repo = 'hot'").withColumn("bucket", F.floor(F.col("at") / (16 * 3_600_000_000)))
        sizes = [r["n"] for r in buckets.repartition("repo", "bucket").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 4000 and len(sizes) > 30
        found = {r.repo: r.largest_burst for r in burst_statistics(rows, 1, 5).collect()}
        assert found == {"hot": 21}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_leading_rows_of_one_group_over_many_tasks(spark):
    rows = spark.range(0, 20000, 1, 64).select(F.lit("hot").alias("repo"), (F.col("id") * 7919 % 20011).alias("x"))
    for fan_in in (1, 8, 512):
        got = [r.x for r in leading_rows(rows, ["repo"], ["x"], 25, fan_in).orderBy("rank").collect()]
        assert got == [r.x for r in rows.orderBy("x").limit(25).collect()]


@pytest.mark.parametrize("k", [20, 5000, 5001])
def test_leading_rows_of_a_hot_group(spark, k):
    """Whatever the k: a repo with most rows, one without any repo, and small ones."""
    n = 300_000
    repo = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("r"), F.col("id") % 11))
    rows = spark.range(0, n, 1, 16).select(repo.alias("repo"), (F.col("id") * 7919 % 299_993).alias("x"), "id")
    got = {(r.repo, r.n, r.top, r.s) for r in leading_rows(rows, ["repo"], ["x", "id"], k).groupBy("repo").agg(
        F.count("*").alias("n"), F.max("rank").alias("top"), F.sum("id").alias("s")).collect()}
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("repo").orderBy("x", "id"))).where(F.col("rank") <= k)
    want = {(r.repo, r.n, r.top, r.s) for r in ranked.groupBy("repo").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.sum("id").alias("s")).collect()}
    assert got == want


def test_tails_of_a_hot_group_do_not_move(spark):
    rows = spark.range(0, 400_000, 1, 16).select(F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 1000)).alias("repo"), "id")
    kept = without_tails(rows, ["repo"], ["id"], 5001, enough=2000)
    counts = {r.repo: r.n for r in kept.groupBy("repo").agg(F.count("*").alias("n")).collect()}
    assert 5001 <= counts["hot"] <= 5001 + 20_004 and sum(counts.values()) - counts["hot"] == 100_000
    assert [r.id for r in kept.where("repo = 'hot'").orderBy("id").limit(5001).collect()] == [r.id for r in rows.where("repo = 'hot'").orderBy("id").limit(5001).collect()]
    # equal places: borders can't divide them, and nothing is lost
    same = spark.range(0, 50_000).select(F.lit("hot").alias("repo"), (F.col("id") % 2).alias("x"))
    assert without_tails(same, ["repo"], ["x"], 1500, enough=2000).count() in (25_000, 50_000)


def test_durable_tables(spark, tmp_path):
    df = durable(spark.range(10), "t")
    assert df.count() == 10 and "FileScan parquet" in plan_of(df)
    assert shared_folder(spark)


def test_spread_only_when_few_splits(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(1).write.parquet(path)
    scan = spark.read.parquet(path)
    assert spread_rows(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism * 3
    assert spread_rows(scan, 0) is scan
    assert os.path.exists(path)


def test_rows_are_spread_without_a_sort(spark, tmp_path):
    """Equal rows and null ones spread too; every row stays once, and no split is sorted by the hash of its rows."""
    path = str(tmp_path / "t")
    spark.range(4000).selectExpr("IF(id % 4 = 0, NULL, 7) AS k", "repeat('x', 50) AS t").repartition(2).write.parquet(path)
    spread = spread_rows(spark.read.parquet(path))
    assert spread.columns == ["k", "t"] and spread.groupBy("k").count().orderBy("k").collect() == [(None, 1000), (7, 3000)]
    assert max(spread.rdd.glom().map(len).collect()) < 4000 / spark.sparkContext.defaultParallelism
    assert "RoundRobin" not in plan_of(spread)


def test_hot_repository(spark):
    """A third of all files and commits in one repo: caps, top-k and sums stay exact."""
    files = corpus.files(spark, SF)
    hot = files.withColumn("repo", F.when(F.crc32("path") % 3 == 0, F.lit("hot")).otherwise(F.col("repo")))
    result = score_repositories(hot, None, ScoringConfig(max_files=30))
    kept = intake.select_files(hot).where("repo = 'hot'").orderBy("path").limit(30)
    expected = score_files(kept)
    row = result.summary.where("repo = 'hot'").first()
    assert row.total_files == expected.count()
    assert row.total_lines == expected.agg(F.sum("line_count")).first()[0]


def test_commit_panel_scores_no_text(spark, monkeypatch):
    """Repo-level signals follow from paths and commits; the texts of files are neither scored nor read."""
    from authorscope.plans import repositories as plans

    written = []
    monkeypatch.setattr(plans, "durable", lambda df, name: written.append(name) or durable(df, name))
    files = spark.createDataFrame([("r", "CLAUDE.md", 3, "a b"), ("r", ".cursorrules", 1, None)], FILES_SCHEMA)
    found = plans.repository_signals(files).select("repo", "phase", "path", "ord", "s.name")
    whole = score_repositories(files).signals.select("repo", "phase", "path", "ord", "s.name")
    assert sorted(found.collect()) == sorted(whole.collect()) and found.count() > 2
    assert written[:2] == ["marker-rows", "repo-signals"] and written[2] == "file-scores"


def test_counts_without_scores(spark, monkeypatch):
    """Equal to the summary, for files that are not scored, repos without files and repos without a name too."""
    from authorscope.plans import repositories as plans

    written = []
    monkeypatch.setattr(plans, "durable", lambda df, name: written.append(name) or durable(df, name))
    text = "Generated with Claude Code\n" * 6
    files = spark.createDataFrame(
        [("r", "CLAUDE.md", 3, text), ("r", "a.py", 1, None), ("r", "a.md", 1, "a\n" * 9), ("r", "a.md", 1, "a\n" * 9), ("s", "x.unknown", 1, text),
         ("s", "node_modules/a.js", 1, text), (None, "b.md", 1, text)], FILES_SCHEMA,
    )
    made = corpus.source_commits(spark, SF).withColumn("repo", F.when(F.col("repo") == "src1", "r").when(F.col("repo") != "src2", F.col("repo")))
    for config in (ScoringConfig(), ScoringConfig(max_files=1), ScoringConfig(enable_commit_analysis=False)):
        written.clear()
        totals, found = plans.repository_totals(files, made, config), plans.attributed_commits(files, made, config)
        assert "file-scores" not in written and "ArrowEvalPython" not in plan_of(totals) + plan_of(found)
        whole = score_repositories(files, made, config).summary
        for got in (totals, found):
            want = whole.select(got.columns)
            assert got.dtypes == want.dtypes and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
        assert totals.where("repo = 'r'").first()["total_files"] == (1 if config.max_files else 3) and found.count() == whole.count()
