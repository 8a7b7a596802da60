"""Every operator and stage on odd rows and on empty tables: no crash, and the result its docstring defines."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from authorscope.llm import common, decontamination, embedding_dedup, filter_audit, html_extraction, license_scan, mixing, near_dedup, quality
from authorscope.llm import sharding, substring_dedup, token_packing, toxicity, whitening

from .conftest import LONG, SMALL

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def test_sharding(stored, nothing):
    rows = sharding.shard_rows(stored, shards=4).collect()
    assert len(rows) == 11 and {r["law"] for r in rows} == {"rows"}
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((i % 4, i // 4) for i in range(11))
    assert all(r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) and r["size"] == len((r["text"] or "").encode()) + 16 for r in rows)
    assert sharding.shard_rows(nothing).count() == 0


def test_decontamination(spark, stored, nothing):
    items = spark.createDataFrame(
        [
            (10, "ONE two three four five six seven eight nine ten"),
            (9, "same id"),
            (None, "without an id"),
            (8, None),
            (7, ""),
            (7, "té 中文"),
            (7, "été über"),
        ],
        "item_id long, text string",
    )
    got = {}
    for r in decontamination.contamination(stored, items).collect():
        got.setdefault((r["doc_id"], (r["text"] or "")[:8]), []).append((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[(1, "one two ")] == [(12, 10, 1, sha("10"), True)] * 2
    assert got[(1, "another ")] == [(6, 2, 1, sha("9"), True)]
    assert got[(None, "a text w")] == [(11, 3, 0, sha(""), True)]
    assert got[(2, "")] == got[(3, "")] == [(0, 0, 0, EMPTY_SHA, False)]
    assert got[(5, LONG[:8])][0][:2] == (60_000, 0)
    assert got[(6, "One two,")][0][:3] == (12, 10, 1) and got[(7, "été über")][0][:3] == (4, 2, 1)
    assert decontamination.contamination(stored, items.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(nothing, items).count() == 0


def test_near_dedup(stored, nothing):
    rows = near_dedup.near_classes(stored).collect()
    assert len(rows) == 11
    classes = sorted((r["_id"], r["class"]) for r in rows if r["_id"] is not None)
    assert classes == [(1, 1), (1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1), (7, 7)]
    assert sorted(r["stays"] for r in rows if r["class"] == 1) == [False, False, True, True]  # of three copies one; another text
    kept = near_dedup.without_near_copies(stored)
    assert kept.columns == stored.columns
    assert kept.where("doc_id in (1, 6) and text like '%two%'").count() == 1
    assert kept.count() == 9
    assert near_dedup.near_classes(nothing).count() == 0 and near_dedup.without_near_copies(nothing).count() == 0


def test_mixing(spark, stored, nothing):
    found = mixing.taken_words(mixing.mix(stored, block=4))
    rows = found.collect()
    assert len(rows) == 11
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    sizes = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    assert sizes["a"][0] == 12 + 12 + 6 + 60_000 and sizes["b"] == (0, 0.0) and sizes[None][0] == 11
    again = mixing.taken_words(mixing.mix(stored, block=4)).collect()
    assert sorted((r["_row"], r["taken"]) for r in rows) == sorted((r["_row"], r["taken"]) for r in again)
    out = mixing.mixed_documents(stored)
    assert out.columns == stored.columns and out.where("text is null or text = ''").count() == 0
    assert mixing.mix(nothing).pieces.count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mixed_documents_when_scans_are_split_anew(spark, tmp_path, monkeypatch):
    """A second scan that packs files differently neither loses documents nor cuts others."""
    path = str(tmp_path / "docs")
    texts = {i: " ".join(f"w{i}n{k}" for k in range(20 + 37 * i % 300)) for i in range(64)}
    rows = spark.createDataFrame([(i, t, "abc"[i % 3]) for i, t in texts.items()], "doc_id long, text string, source string")
    rows.repartition(8).write.parquet(path)
    write, first = mixing.durable, spark.conf.get("spark.sql.files.minPartitionNum", None)

    def then_more_cores(df, name):
        out = write(df, name)
        spark.conf.set("spark.sql.files.minPartitionNum", "64")
        return out

    held = []
    kept = mixing.mix
    monkeypatch.setattr(mixing, "durable", then_more_cores)
    monkeypatch.setattr(mixing, "mix", lambda *a, **b: held.append(kept(*a, **b)) or held[-1])
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = {}
        for r in mixing.mixed_documents(spark.read.parquet(path)).collect():
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
            assert set(r["text"].split()) <= set(texts[r["doc_id"]].split())
        assert got == {r["_id"]: r["taken"] for r in mixing.taken_words(held[0]).collect() if r["taken"]}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if first is None else spark.conf.set("spark.sql.files.minPartitionNum", first)


def test_quality(spark, stored, nothing):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.trained(spark.read.parquet(f"{SMALL}/documents.parquet"), labels)
    rows = quality.quality(stored, model).collect()
    assert len(rows) == 11
    assert all(r["score"] == 0 and r["kept"] is False for r in rows if not (r["text"] or "").strip())
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality(nothing, model).count() == 0
    clashing = stored.withColumns({c: F.lit("theirs") for c in ("rate", "path_n", "host_n", "of_host")})
    assert {r["rate"] + r["path_n"] + r["host_n"] + r["of_host"] for r in quality.quality(clashing, model).collect()} == {"theirs" * 4}
    one_class = quality.trained(stored, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert len({round(r["evidence"], 9) for r in quality.quality(stored, one_class).collect()}) == 1
    no_labels = quality.trained(nothing, labels.limit(0))
    assert quality.quality(stored, no_labels).count() == 11


def test_toxicity(spark, stored, nothing):
    network = toxicity.fit(["a vile scum text", "a kind text"] * 20, np.array([1.0, 0.0] * 20))
    rows = toxicity.toxicity(stored, network).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert toxicity.toxicity(nothing, network).count() == 0
    none = toxicity.trained(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["predicted"] for r in toxicity.toxicity(stored, none).collect()} == {0}


def test_substring_dedup(stored, nothing):
    rows = substring_dedup.without_repeats(stored).collect()
    assert len(rows) == 11
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], (r["text"] or "")[:8]), []).append((r["n_words"], r["n_removed"], r["kept_sha256"]))
    assert got[(2, "")] == got[(3, "")] == [(0, 0, EMPTY_SHA)]
    # five words repeated: the first five windows are new, every later one repeats one of them
    assert got[(5, LONG[:8])] == [(60_000, 60_000 - 5, hashlib.sha256(b"far away words in rows").hexdigest())]
    assert got[(1, "one two ")][0][:2] == (12, 0)
    assert substring_dedup.without_repeats(nothing).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_substring_dedup_keeps_repeated_rows(spark, parts):
    """Rows equal in key and text are one document, so none is a repeat of the other; a later document is."""
    text, other, tail = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(1, text), (1, text), (None, other), (None, other), (2, text), (3, f"{text} {tail}"), (3, f"{text} {tail}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.without_repeats(docs).collect()]
    want = [(1, 30, 0, sha(text))] * 2 + [(None, 30, 0, sha(other))] * 2 + [(2, 30, 30, EMPTY_SHA)] + [(3, 60, 30, sha(tail))] * 2
    assert sorted(got, key=str) == sorted(want, key=str)


def test_embeddings(spark):
    rows = [
        (1, [1.0, 0.0], 1, "x"),
        (1, [1.0, 0.0], 1, "x"),
        (2, [2.0, 0.0], 1, "x"),
        (3, [0.0, 0.0], 1, "x"),
        (4, None, 1, "x"),
        (5, [1.0, None], 1, "x"),
        (6, [1.0, float("nan")], 1, "x"),
        (7, [1.0, 0.0], None, "x"),
        (8, [1.0, 0.0], 2, "x"),
        (9, [1.0, 0.0, 0.0], 1, "x"),
        (10, [], 1, "x"),
        (11, [float("inf"), 0.0], 1, "x"),
        (None, [0.0, 1.0], 1, "x"),
        (12, [-1.0, 0.0], 1, "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()]
    assert got.count((1, 2, 1, True)) == 2 and (2, 2, 1, False) in got and (None, 0, None, True) in got
    assert all((i, 0, i, True) in got for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
    names = "node component point weight group dimension vector links root cell far part parts side n radius _counted a b".split()
    named = df.withColumns({n: F.lit(f"their {n}") for n in names})
    out = embedding_dedup.near_vectors(named)
    assert sorted(got, key=str) == sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect()), key=str)
    assert set(names) <= set(out.columns) and out.where("node = 'their node' and part = 'their part'").count() == len(rows)


@pytest.mark.parametrize("hot", [1, 2, 10_000])
def test_spread_join(spark, monkeypatch, hot):
    """Hot groups and the others, keys that are null and keys without a group."""
    monkeypatch.setattr(common, "HOT", hot)
    keys = ["a"] * 50 + ["b"] * 20 + ["c"] * 5 + [None] * 30 + ["none"] * 3
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, key string")
    groups = spark.createDataFrame([("a", 50, 1, None), ("b", 20, 2, "x"), ("c", 5, 3, "y")], "key string, size long, v long, w string")
    found = {"a": (1, None), "b": (2, "x"), "c": (3, "y")}
    got = sorted(tuple(r) for r in common.spread_join(rows, groups, "key", "size", F.xxhash64("i")).collect())
    assert got == [(i, k, *found.get(k, (None, None))) for i, k in enumerate(keys)]


def test_html(spark):
    rows = [
        (1, "http://h.example/a", None, "x"),
        (2, None, "", "x"),
        (3, "http://h.example/b", "<p>one<b>two</b><br>three<script>x</script><p>a &amp; b &lt;i&gt; &am", "x"),
        (3, "http://h.example/b", "<p>one<b>two</b><br>three<script>x</script><p>a &amp; b &lt;i&gt; &am", "x"),
        (4, "no url", "<nav>menu</nav><article> kept  \n text<form>f</form><div class='comments'>c</div></article><aside>s</aside><p cla", "x"),
        (5, "http://h.example/c", "a < b <!-- c --> d <!-- open", "x"),
        (6, "http://h.example/d", "<article>" + "<p>word</p>" * 20_000, "x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extraction.extract(df).collect()}
    assert got[1] == got[2] == ("", 0)
    assert got[3] == ("onetwo three a & b <i> &am", 26)
    assert got[4] == ("kept text", 9) and got[5] == ("a < b d", 7) and got[6][1] == 5 * 20_000 - 1
    assert html_extraction.extract(df.limit(0)).count() == 0


FRAME = {
    "body": "<body class='single right-sidebar comments-open'><p>{}</p><nav>menu</nav></body>",
    "article": "<body><article class='post has-sidebar'><p>{}</p></article><nav>menu</nav></body>",
    "wrapper": "<body><form><nav>menu</nav><div class='post has-sidebar'><p>{0}</p><p>the <b>se</b>cond {0}</p></div></form></body>",
    "varied": "<body><div class='share'>{}</div><section><p>a longer text than the other one, {}</p></section></body>",
}


@pytest.mark.parametrize("frame", sorted(FRAME))
def test_html_names_of_frames_do_not_decide(spark, frame):
    """Varied texts stay whatever the names of what frames them; copies of a page do not make its text a template."""
    said = [" ".join(hashlib.sha256(f"{i}{k}".encode()).hexdigest()[:7] for k in range(6)) for i in range(40)]
    rows = [(i, "http://h.example/a", FRAME[frame].format(t, t)) for i, t in enumerate(said)]
    rows += [(100, "http://h.example/a", rows[0][2])] * 200
    got = {}
    for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r["page_id"], set()).add(r["text"])
    want = {"wrapper": "{0} the second {0}", "varied": "a longer text than the other one, {0}"}.get(frame, "{0}")
    assert all(got[i] == {want.format(t)} for i, t in enumerate(said)) and got[100] == got[0]


def said(seed, words):
    return " ".join(hashlib.sha256(f"{seed}-{k}".encode()).hexdigest()[:7] for k in range(words))


@pytest.mark.parametrize("holder", ["<article>{}</article>", "<div>{}</div>", "<div class='post-body'>{}</div>", "<main><div>{}</div></main>"])
@pytest.mark.parametrize("pages", [2, 60])
def test_html_varied_parts_that_are_no_article(spark, holder, pages):
    """Comments, adverts, sidebars, notices and forms whose texts differ on every page go; the article alone stays, on
    hosts of many and of few pages, also where comments are longer than it."""
    rows, want = [], {}
    for i in range(pages):
        article = [said(f"{i}a{k}", 30) for k in range(3)]
        many = "".join(f"<p>{said(f'{i}c{k}', 25)}</p>" for k in range(12 if i % 2 else 2))
        parts = [
            f"<div class='sidebar'>{said(f'{i}s', 20)}</div>",
            f"<div class='ad'>{said(f'{i}d', 9)}</div>",
            holder.format("".join(f"<p>{p}</p>" for p in article)),
            f"<div class='notice'>{said(f'{i}n', 9)}</div>",
            f"<form><p>{said(f'{i}f', 5)}</p></form>",
            f"<section id='comments'>{many}</section>",
        ]
        rows.append((i, f"http://h{i // 30}.example/{i}", f"<html><body class='has-sidebar'>{''.join(parts)}</body></html>"))
        want[i] = " ".join(article)
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_nesting_costs_its_length():
    import time

    start = time.process_time()
    blocks, elements = html_extraction.parsed("<div>a" * 50_000 + "</b></i>" * 20_000 + "</section>" * 50_000)
    assert len(elements) == 50_001 and len(blocks) == 50_000
    assert time.process_time() - start < 10 and max(len(e.path) for e in elements) == 32


def test_token_packing(stored, nothing):
    out = token_packing.pack_tokens(stored, row=64)
    parts = {}
    for r in out.collect():
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 64 and r["n_tokens"] == r["cu_seqlens"][-1]
        for a, b, start, key in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["starts"], r["doc_ids"]):
            parts.setdefault(key, []).append((start, ids[a:b].tolist()))
        assert token_packing.positions(r["cu_seqlens"], r["starts"])[0] == r["starts"][0]
    text = token_packing.decoded([i for _, ids in sorted(parts[5]) for i in ids])
    assert text == LONG and 2 not in parts and parts[3] == [(0, [50_256])]
    assert token_packing.pack_tokens(nothing).count() == 0


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, stored, nothing, number):
    name, stage = corpus_pipeline.STAGES[number]
    for docs in (stored, nothing):
        out = stage(spark, docs, SMALL)
        assert set(stored.columns) <= set(out.columns) if name == "sharding" else out.columns == stored.columns
        assert out.count() <= 3 * docs.count()


def test_columns_may_be_more(stored):
    out = sharding.shard_rows(stored.withColumn("Shard", F.lit(1)))
    assert [c.lower() for c in out.columns].count("shard") == 1


def test_filter_audit(spark, stored, nothing):
    said = [(1, 1, 0), (1, 0, 0), (5, None, 1), (6, 0, None), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int").withColumn("source", F.lit("theirs"))
    rows = filter_audit.filter_audit(stored, labels).collect()
    assert len(rows) == 600 * 4 and {r["part"] for r in rows} == {"", "a", "b", "c"}
    got = {(r["part"], r["filter_order"], r["step"]): r for r in rows}
    # a: two equal rows and another text of one id, and a long text of five words that repeat; neither equal row is a copy
    step = lambda part, order, at: tuple(got[part, order, at][c] for c in filter_audit.COUNTS[:6])
    assert step("a", "ABCDE", 1) == (1, 3, 0, 3, 3, 0) and step("a", "ABCDE", 2) == (0, 1, 0, 1, 0, 1)
    assert step("a", "EDCBA", 1) == (4, 0, 0, 0, 0, 0)
    # the empty part: a null text of id 2, the same without an id, and a text without an id; none is a copy of another
    assert step("", "ABCDE", 1) == (0, 3, 0, 3, 0, 0)
    # b: the empty text of id 3 has a smaller id, 2, whose text is null; white space is another text
    assert step("b", "EABCD", 1) == (1, 1, 0, 0, 0, 0) and step("b", "ABCDE", 5) == (0, 0, 1, 0, 0, 0)
    # c: "One ... TWELVE!" has 7 capitals in 64 characters
    assert step("c", "CABDE", 1)[:2] == (1, 1)
    assert filter_audit.filter_audit(nothing, labels).count() == 0
    assert {r["good_lost"] + r["toxic_lost"] for r in filter_audit.filter_audit(stored, labels.limit(0)).collect()} == {0}


def test_license_scan(spark, stored, nothing):
    rows = license_scan.license_scan(stored).collect()
    assert len(rows) == 11 and {(r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in rows} == {
        (0, None, None, "", "", 0.0)
    }
    assert sorted(r["n_words"] for r in rows) == [0, 0, 0, 0, 4, 6, 11, 12, 12, 12, 60_000]
    assert license_scan.license_scan(nothing).count() == 0
    texts = [
        (1, "Under the MIT license, under the mit-LICENSE"),
        (1, "Under the MIT license, under the mit-LICENSE"),
        (2, "cc by-nc " * 30_000),
        (None, "APACHE LICENSE: version 2"),
        (3, "under the \u212a mit license"),
        (4, "released und\u00e9r the mit license and cc \u0130by nc"),
        (5, "the license: licensed under GNU, general public"),
        (6, "cc by nc apache license version 2"),
        (7, "w " * 13 + "cc by nc 4 0 under licensed"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("theirs") for c in ("label", "place", "_words", "word", "m")})
    got = {}
    for r in license_scan.license_scan(docs).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r[c] for c in license_scan.OWN))
        assert r["label"] == r["_words"] == "theirs"
    assert got[1] == [(8, 2, 0, 4, "mit", "mit", 1.0)] * 2
    assert got[2] == [(90_000, 30_000, 0, 89_997, "cc-by-nc", "cc-by-nc", 1.0)]
    assert got[None] == [(4, 1, 0, 0, "apache-2", "apache-2", 1.0)]
    assert got[3][0][1] == 0 and got[4][0][1:] == (0, None, None, "", "", 0.0)
    assert got[5] == [(7, 0, None, None, "", "gpl", 1.0)]
    assert got[6] == [(7, 2, 0, 3, "apache-2,cc-by-nc", "apache-2,cc-by-nc", 1.0)]
    assert got[7][0][5] == "cc-by-nc"
    assert {r["labels"] for r in license_scan.license_scan(docs, []).collect()} == {""}


def test_whitening(spark):
    rows = [
        (1, [0.1, 0.2], "x"),
        (1, [0.1, 0.2], "x"),
        (2, [0.5, -0.2], "x"),
        (None, [0.3, 0.9], "x"),
        (3, None, "x"),
        (4, [], "x"),
        (5, [1.0, None], "x"),
        (6, [1.0, float("nan")], "x"),
        (7, [float("-inf"), 1.0], "x"),
        (8, [1e30, 1.0], "x"),
        (9, [1.0, 2.0, 3.0], "x"),
        (10, [1.0, 2.5, 3.0], "x"),
        (11, [7.0], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").withColumns({c: F.lit("mine") for c in ("dims", "x", "at", "_v")})
    out = whitening.whiten(df)
    assert set(df.columns) <= set(out.columns)
    got = {}
    for r in out.collect():
        got.setdefault(r["vec_id"], []).append(r)
        assert r["dims"] == r["_v"] == "mine"
    assert set(got) == {1, 2, None, 4, 9, 10, 11} and len(got[1]) == 2
    assert [got[k][0]["n"] for k in (1, None, 4, 9, 11)] == [3, 3, 1, 2, 1]
    assert [len(got[k][0]["whitened"]) for k in (1, 4, 9, 11)] == [2, 0, 1, 0]
    assert got[1][0]["identity_error"] < 1e-9 and got[9][0]["explained"] == [1.0] and got[11][0]["deviation"] == 0
    assert abs(got[9][0]["whitened"][0]) == pytest.approx(1) and got[9][0]["deviation"] == 32 * 32
    assert whitening.whiten(df.limit(0)).count() == 0
    far = spark.createDataFrame([(1, [1e16]), (2, [-1e16])], "vec_id long, embedding array<double>")
    assert [(r["deviation"], abs(round(r["whitened"][0], 9))) for r in whitening.whiten(far).collect()] == [(None, 1.0)] * 2
