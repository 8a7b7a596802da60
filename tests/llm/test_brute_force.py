"""Operators that SQL can't express against plain Python over the smallest tables; those that it can, against their SQL."""

import re
import zlib

import numpy as np
import pytest

from authorscope.llm import embedding_dedup, filter_audit, html_extraction, license_scan, mixing, near_dedup, quality, sharding
from authorscope.llm import token_packing, toxicity, whitening
from authorscope.llm.permutation import grid, permuted, permuted_value
from authorscope.llm.queries import ORACLES, QUERIES
from checks.compare import compare, duck

from .conftest import SMALL


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, key):
    ok, line = compare(spark, duck(SMALL), key, QUERIES[key], ORACLES[key], SMALL)
    assert ok, line


def test_a_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    sides = [F.lit(v).cast("long") for v in (n, *grid(n))]
    got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), *sides, 5, F.lit(3).cast("long"))).collect()]
    assert got == [permuted_value(i, n, 5, 3) for i in range(n)] and sorted(got) == list(range(n))


def test_sharding(spark, documents):
    rows = QUERIES["op5_sharding"](spark, SMALL).collect()
    buckets = {}
    for r in documents:
        crc = zlib.crc32(r["text"].encode())
        buckets.setdefault(zlib.crc32(f"{r['doc_id']}:{crc}".encode()) % sharding.BUCKETS, []).append(r["doc_id"])
    order = [i for b in sorted(buckets) for i in sorted(buckets[b])]
    places = {i: permuted_value(k, len(order), sharding.SEED) for k, i in enumerate(order)}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == {i: (p % 40, p // 40) for i, p in places.items()}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_near_dedup(spark, documents):
    """Classes are the components of ordered shingle similarity 0.8, over all pairs."""
    lists = [[tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] for w in (words(r["text"]) for r in documents)]
    symbols = {}
    arrays = [np.array([symbols.setdefault(s, len(symbols)) for s in x]) for x in lists]
    edges = []
    for i in range(len(arrays)):
        for j in range(i + 1, len(arrays)):
            n, m = len(arrays[i]), len(arrays[j])
            if min(n, m) >= 0.8 * max(n, m) and len(np.intersect1d(arrays[i], arrays[j])):
                common = near_dedup.common_in_order(arrays[i], arrays[j], n + m)
                if common / (n + m - common) >= 0.8:
                    edges.append((i, j))
    root = embedding_dedup.forest(len(arrays), [(np.array([e[0]]), np.array([e[1]])) for e in edges])
    want = {documents[i]["doc_id"]: documents[r]["doc_id"] for i, r in enumerate(root)}
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op9_near_dedup"](spark, SMALL).collect()}
    assert got == want


def test_blocks_of_a_mixed_bucket(spark, monkeypatch):
    """Blocks of three nodes: groups with blocks of their own, pooled nodes, and every link that joins two groups."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(30):
        own = list(base)
        for k in range(i % 7):
            own[(17 * i + 40 * k) % 120] = f"x{i}{k}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lists = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in map(words, texts)]
    symbols = {}
    arrays = [np.array([symbols.setdefault(s, len(symbols)) for s in x]) for x in lists]
    linked = np.array([[near_dedup.similar(a, b) for b in arrays] for a in arrays])
    root = embedding_dedup.forest(len(arrays), [np.nonzero(linked)])
    got = {r["_id"]: r["class"] for r in near_dedup.near_classes(docs).collect()}
    assert got == {i: int(r) for i, r in enumerate(root)} and 1 < len(set(got.values())) < 30


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_alignment():
    random = np.random.default_rng(3)
    for _ in range(300):
        a = random.integers(0, random.choice([3, 30, 1000]), random.integers(1, 60))
        b = np.delete(a, random.integers(0, len(a), random.integers(0, 4))) if len(a) > 4 else a
        b = np.insert(b, random.integers(0, len(b) + 1, random.integers(0, 4)), 7)
        common, total = plain_lcs(a.tolist(), b.tolist()), len(a) + len(b)
        assert near_dedup.common_in_order(a, b, total) == common
        assert near_dedup.similar(a, b) == (9 * common >= 4 * total)


def test_alignment_in_a_band():
    """Symbols that occur often and seldom, bands narrower than the texts, and a text of 10 MB that differs in places."""
    random = np.random.default_rng(4)
    for size, kinds in [(400, 2), (400, 5), (900, 40), (900, 100_000)]:
        a = random.integers(0, kinds, size)
        b = a.copy()
        b[random.integers(0, size, size // 30)] = -1
        b = np.delete(b, random.integers(0, size, size // 40))
        common = plain_lcs(a.tolist(), b.tolist())
        assert near_dedup.common_in_order(a, b, len(a) + len(b)) == common
        if 9 * common >= 4 * (len(a) + len(b)):
            assert near_dedup.common_in_order(a, b, (len(a) + len(b)) // 9) == common
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    a = random.integers(0, 2**62, 200_000)
    b = a.copy()
    b[::100] = -1
    assert near_dedup.common_in_order(a, b, len(a) * 2 // 9) == 198_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


@pytest.mark.parametrize("block", [8, 128])
def test_variants_of_one_text(spark, monkeypatch, block):
    """Large buckets: variants of a text near to it and far from it, families of their own among them; all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    random = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(260):
        own = list(base)
        for at in random.choice(150, random.integers(0, 9), replace=False):
            own[at] = f"x{i}n{at}"
        texts.append(" ".join(own))
        if i % 20 == 0:  # near to this far variant alone
            own[0] = "y"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lists = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in map(words, texts)]
    symbols = {}
    arrays = [np.array([symbols.setdefault(s, len(symbols)) for s in x]) for x in lists]
    linked = np.array([[near_dedup.similar(a, b) for b in arrays] for a in arrays])
    root = embedding_dedup.forest(len(arrays), [np.nonzero(linked)])
    got = {r["_id"]: r["class"] for r in near_dedup.near_classes(docs).collect()}
    assert got == {i: int(r) for i, r in enumerate(root)} and 10 < len(set(got.values())) < 230


def test_recall_of_sketches(spark):
    """Links found against all pairs that share a shingle, over a larger table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    lists = [[tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] for w in (words(r["text"]) for r in docs)]
    symbols, holders = {}, {}
    arrays = [np.array([symbols.setdefault(s, len(symbols)) for s in x]) for x in lists]
    for i, x in enumerate(arrays):
        for s in set(x.tolist()):
            holders.setdefault(s, []).append(i)
    pairs = {(i, j) for rows in holders.values() for k, j in enumerate(rows) for i in rows[:k]}
    near = [(i, j) for i, j in pairs if near_dedup.similar(arrays[i], arrays[j])]
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op9_near_dedup"](spark, "/root/testdata/sf0.01").collect()}
    found = sum(got[docs[i]["doc_id"]] == got[docs[j]["doc_id"]] for i, j in near)
    print(f"recall {found} of {len(near)}")
    assert len(near) > 50 and found >= 0.99 * len(near)


def shared_targets(sizes, weights, total, most=3):
    """Targets by stopping, again and again, each share above ``most`` times its size."""
    targets, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = weights[i] * unit
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in over]
    return targets


@pytest.mark.parametrize("sizes", [[], [0, 0], [100, 100], [10, 100, 0, 100], [1, 2, 4, 8, 1000, 0, 3, 9, 77], [5] * 40 + [100_000]])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(enumerate(sizes)), "source_no long, source_size long")
    got = [r["target"] for r in mixing.with_targets(table, (1, 2, 3)).orderBy("source_no").collect()]
    assert got == pytest.approx(shared_targets(sizes, [1 + i % 3 for i in range(len(sizes))], sum(sizes)))


def test_draws():
    for slots, shards in ((0, 5), (3, 64), (100_000, 64)):
        met, counts = mixing.draws(slots, shards, np.random.default_rng(1))
        assert counts.sum() == slots and (np.diff(met) > 0).all() and (met < shards).all()
    assert abs(counts - 100_000 / 64).max() < 6 * (100_000 / 64) ** 0.5


def test_many_sources_in_ranges(spark, monkeypatch):
    """Sources of all sizes, ranked by several tasks: the order, the words owed and each slot's place hold."""
    monkeypatch.setattr(mixing, "RANGE", 50)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 40)
    random = np.random.default_rng(3)
    names = [None, "", "=", "\U0001f600", "\uffff", *[f"s{i}" for i in range(300)]]
    rows = [(i, " ".join(["w"] * int(random.integers(0, 90))), names[i % len(names)]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, block=8)
    got = mixing.taken_words(found).collect()
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = [sum(len(r[1].split()) for r in rows if r[2] == s) for s in order]
    want = dict(zip(order, shared_targets(size, [1 + i % 3 for i in range(len(order))], sum(size)), strict=True))
    taken = {}
    for r in got:
        assert r["source_no"] == order.index(r["source"]) and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in order)
    pieces = found.pieces.collect()
    met = {}
    for p in pieces:  # no word twice in a pass, no two blocks in a slot
        assert met.setdefault(("slot", p["shard"], p["slot"]), (p["source_no"], p["pass"], p["block"])) == (p["source_no"], p["pass"], p["block"])
        for word in range(p["start"], p["start"] + p["words"]):
            assert met.setdefault(("word", p["_row"], p["pass"], word), p) is p
    slots = {}
    for kind, shard, *rest in met:
        if kind == "slot":
            slots.setdefault(shard, set()).add(rest[0])
    assert len(slots) > 64 and all(s == set(range(len(s))) for s in slots.values())


def test_slots_are_not_broadcast(spark):
    pieces = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet")).pieces
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [source_no" in plan and "BroadcastExchange" not in plan


def test_small_sources_get_their_words(spark):
    rows = [(i, " ".join(["w"] * 100), source) for i, source in enumerate("abc")]
    got = mixing.taken_words(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))).orderBy("_id").collect()
    assert [(r["target"], r["taken"]) for r in got] == [(50, 50), (100, 100), (150, 150)]


def test_mixing(spark, documents):
    rows = QUERIES["op1_mixing"](spark, SMALL).collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in documents}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    source = {r["doc_id"]: r["source"] for r in documents}
    taken, target, total = {}, {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        taken[s], total[s] = taken.get(s, 0) + r["taken"], total.get(s, 0) + r["size"]
        target[s] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    names = sorted(target)
    assert [target[s] for s in names] == pytest.approx(
        shared_targets([total[s] for s in names], [1 + i % 3 for i in range(len(names))], sum(total.values()))
    )
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)


def test_mixed_documents_hold_what_is_taken(spark, documents):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["_id"]: r["taken"] for r in mixing.taken_words(mixing.mix(docs)).collect() if r["taken"]}
    got, source = {}, {r["doc_id"]: r["text"].split() for r in documents}
    for r in mixing.mixed_documents(docs).collect():
        taken = r["text"].split()
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(taken)
        assert r["n_chars"] == len(r["text"])
        rest = iter(source[r["doc_id"]])
        assert all(word in rest for word in taken)  # in the order of the document
    assert got == want


def test_embeddings(spark):
    """All pairs by one matrix product, with cells small enough to need many of them."""
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    from pyspark.sql import functions as F

    close = vectors.where("vec_id % 3 = 0").select(
        (F.col("vec_id") + 100_000).alias("vec_id"),
        F.transform("embedding", lambda v, i: (v + F.when(i == 0, 0.03).otherwise(0.0)).cast("float")).alias("embedding"),
        "label",
    )
    vectors = vectors.unionByName(close).cache()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(vectors, cell=24).collect()}
    rows = vectors.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    root = embedding_dedup.forest(len(rows), [np.nonzero(linked)])
    assert linked.sum() > 100
    assert got == {rows[i]["vec_id"]: (int(linked[i].sum()), rows[root[i]]["vec_id"]) for i in range(len(rows))}


def test_pages(spark):
    import html

    got = {r["page_id"]: r["text"] for r in QUERIES["op8_html_extraction"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.DOTALL)[1]
        plain = re.sub(r"<[^>]*(?:>|$)", lambda m: " " if re.match(r"</?(p|h1|br)\b", m[0]) else "", body)
        assert got[r["page_id"]] == " ".join(html.unescape(plain).split())


def test_round_trip(spark, documents):
    parts = {}
    for r in QUERIES["op2_token_packing"](spark, SMALL).collect():
        ids = np.frombuffer(r["ids"], "<u2")
        for a, b, start, key in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["starts"], r["doc_ids"]):
            parts.setdefault(key, []).append((start, ids[a:b].tolist()))
    table = {rank: token for token, rank in token_packing.read_ranks(token_packing.VOCABULARY).items()}
    text = {k: b"".join(table[i] for _, ids in sorted(v) for i in ids if i in table).decode() for k, v in parts.items()}
    assert text == {r["doc_id"]: r["text"] for r in documents}


def test_long_runs_of_white_space():
    """Ids of runs that the pattern's engine can't take whole are those of the same merges; short ones show the same."""
    ranks = token_packing.read_ranks(token_packing.VOCABULARY)
    encode = token_packing.encoder(ranks, token_packing.PATTERN)
    import tiktoken

    plain = tiktoken.Encoding("given", pat_str=token_packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random = np.random.default_rng(6)
    for n in (4095, 4096, 4097, 9000):
        for run in (" " * n, "".join(random.choice([" ", "\n", "\t", "\u2003"], n))):
            for text in (run, "a" + run, run + "b", f"a b{run}c, d's{run}\n{run}e", run + "\x1c" + run):
                assert encode(text).tolist() == plain.encode(text), (n, text[:3])
    ids = encode(" " * 10_000_000 + "x")
    assert token_packing.decoded(ids.tolist()) == " " * 10_000_000 + "x"


def test_shards_round_trip(spark, tmp_path):
    packs = token_packing.pack_tokens(spark.read.parquet(f"{SMALL}/documents.parquet"), row=512)
    packs.write.parquet(str(tmp_path / "packs"))
    packs = spark.read.parquet(str(tmp_path / "packs"))
    token_packing.write_shards(packs, str(tmp_path / "shards"))
    want = {r["pack_id"]: r for r in packs.collect()}
    shards = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert sum(s["n_rows"] for s in shards) == len(want)
    found = {}
    for shard in shards:
        for ids, cu, places in zip(*token_packing.read_shard(shard, 512)):
            found.setdefault(ids.tobytes(), []).append((cu.tolist(), places[: cu[-1]].tolist()))
    for r in want.values():
        assert (r["cu_seqlens"], token_packing.positions(r["cu_seqlens"], r["starts"]).tolist()) in found[r["ids"]]


def test_best_fit():
    random = np.random.default_rng(1)
    for _ in range(50):
        row = int(random.integers(5, 60))
        sizes = random.integers(1, row + 1, random.integers(0, 80)).tolist()
        rooms, rows = [], 0
        for size in sorted(sizes, reverse=True):
            fitting = [room for room in rooms if room >= size]
            if fitting:
                rooms.remove(min(fitting))
            else:
                rows += 1
            rooms.append((min(fitting) if fitting else row) - size)
        assert len(token_packing.best_fit_decreasing(sizes, row)) == rows


def accuracy(spark, sf, key, column, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = [(int(r[column]), labels[r["doc_id"]]) for r in QUERIES[key](spark, sf).collect() if r["doc_id"] in labels and held(r["doc_id"])]
    right = {v: [a == b for a, b in rows if b == v] for v in (0, 1)}
    return [sum(x) / len(x) for x in right.values()]


def test_held_out_quality(spark):
    assert min(accuracy(spark, "/root/testdata/sf0.1", "op10_quality", "kept", "quality")) > 0.97


def test_held_out_toxicity(spark):
    clean, toxic = accuracy(spark, "/root/testdata/sf0.1", "op7_toxicity", "predicted", "toxic")
    assert clean > 0.97 and toxic > 0.85


def test_site_rates_shrink(spark):
    rows = spark.createDataFrame([("big", "x", 0.0)] * 500 + [("small", "y", 0.0)] + [("other", "z", 1.0)] * 499, "_host string, _path string, _p double")
    got = {r["_host"]: r for r in quality.shrunk_rates(rows).collect()}
    assert got["big"]["of_path"] > got["big"]["of_host"]  # paths are no farther apart than their hosts
    assert got["small"]["host_n"] == 1 and got["big"]["path_sum"] == 0 and 0.49 < got["big"]["rate"] < 0.51


def test_toxicity_threshold():
    assert 0 < toxicity.best_threshold(np.array([-2.0, -1.0, 1.0, 2.0]), np.array([0.0, 0.0, 1.0, 1.0])) + 1 < 2


def test_long_text_in_pieces(monkeypatch):
    """A text cut into pieces scores as it does whole, and the widest filter spans each cut."""
    random = np.random.default_rng(3)
    vocabulary = ["vile", "scum", "kind", "the", "und", *[f"w{i}" for i in range(50)]]
    texts = [" ".join(random.choice(vocabulary, 60)) for _ in range(60)]
    network = toxicity.fit(texts, np.array([float("scum" in t) for t in texts]))
    body = " ".join(random.choice(vocabulary, 4000)).encode()
    data, offsets = np.frombuffer(body, np.uint8), np.array([0, len(body)])
    whole = network.pooled(toxicity.tokens_of(data, offsets))
    want = network.scores_of(data, offsets)
    monkeypatch.setattr(toxicity, "PIECE", 500)
    monkeypatch.setattr(toxicity, "STEP", 64)
    parts = toxicity.cuts(data)
    assert len(parts) > 20 and parts[-1][1] == len(data)
    for (_, stop), (begin, _) in zip(parts, parts[1:]):
        assert len(bytes(data[begin:stop]).split()) == max(toxicity.WIDTHS) - 1
    pooled = np.max([network.pooled(toxicity.tokens_of(data[a:b], np.array([0, b - a]))) for a, b in parts], axis=0)
    assert np.allclose(pooled, whole, atol=1e-5) and np.allclose(network.scores_of(data, offsets), want, atol=1e-4)
    one = np.full(3000, 97, np.uint8)
    assert toxicity.cuts(one) == [(0, 3000)]


def test_html_truncated():
    blocks, _ = html_extraction.parsed("<article><p>text</p><p cla")
    assert [b[2] for b in blocks] == ["text"]


@pytest.mark.parametrize("table", ["embeddings", "copies"])
def test_whitening(spark, table):
    """Exact sums in Python integers, the covariance in fractions, eigenvectors by numpy; signs are free."""
    from fractions import Fraction

    from pyspark.sql import functions as F

    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    if table == "copies":  # a third of all rows are one vector, which is fitted once
        first = vectors.orderBy("vec_id").limit(1).crossJoin(spark.range(200)).select((F.col("id") + 10_000).alias("vec_id"), "embedding", "label")
        vectors = vectors.unionByName(first)
    got = {r["vec_id"]: r for r in whitening.whiten(vectors).collect()}
    rows = {r["vec_id"]: [int(np.floor(64 * float(c))) + 1_000_000 for c in r["embedding"]] for r in vectors.collect()}
    fit = sorted(set(map(tuple, rows.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * v - s for v, s in zip(x, sums)] for x in fit], object)
    cov = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in centred.T.dot(centred)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    y = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(rows[k], sums)] for k in sorted(rows)])
    want = y @ axes / np.sqrt(values)
    have = np.array([got[k]["whitened"] for k in sorted(rows)])
    assert np.allclose(have * np.sign((have * want).sum(axis=0)), want, rtol=0, atol=1e-9)
    assert {k: r["deviation"] for k, r in got.items()} == {k: sum((n * v - s) ** 2 for v, s in zip(x, sums)) for k, x in rows.items()}
    some = got[min(got)]
    assert some["n"] == n and some["identity_error"] < 1e-9
    assert some["explained"] == pytest.approx(values / np.trace(cov), rel=1e-9)


def test_whitening_of_large_entries():
    """Squares that pass 64 bits, and sums of them in limbs."""
    random = np.random.default_rng(5)
    y = random.integers(-(2**40), 2**40, (50, 4))
    want = [sum((int(r[i]) + (int(r[j]) if i != j else 0)) ** 2 for r in y) for i in range(4) for j in range(i, 4)]
    assert whitening.squares(y) == want
    for value in [0, 1, -1, 2**130 + 17, -(2**130) - 17, *want]:
        assert sum(d << (40 * i) for i, d in enumerate(whitening.limbs(value))) == value
    for width, x in [(1, [127, -128]), (2, [128]), (4, [2**31 - 1]), (8, [-(2**31) - 1])]:
        packed = whitening.packed(np.array(x))
        assert packed[0] == width and whitening.unpacked([packed]).tolist() == [x]


def test_blocks_of_a_license(spark):
    """Every block against every template by plain sets, on texts that scatter, repeat and cut notices."""
    random = np.random.default_rng(7)
    known = license_scan.templates()
    pool = sorted({w for t in known for w in t.words}) + [f"w{i}" for i in range(40)]
    texts = [" ".join(random.choice(pool, random.integers(1, 90))) for _ in range(150)]
    for _ in range(150):
        t = known[random.integers(len(known))]
        said = [w for w in t.words if random.random() > 0.06]
        at = random.integers(0, 30)
        texts.append(" ".join([*random.choice(pool, at), *said, *random.choice(pool, random.integers(0, 20))]))
        before = license_scan.PIECE * random.integers(1, 3) - random.integers(-5, 60)  # around the border of a piece
        texts.append(" ".join([*["w1"] * before, *said, *random.choice(pool, random.integers(0, 300))]))
    texts += [" ".join(["w1"] * (license_scan.PIECE + i) + ["cc by nc apache license version 2"]) for i in range(-8, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs, known).collect()}
    seen = 0
    for i, text in enumerate(texts):
        w = text.split()
        base = [(s, t.label) for t in known if t.phrase for s in range(len(w)) if tuple(w[s : s + len(t.words)]) == t.words]
        found, score = {label for _, label in base}, 1.0 if base else 0.0
        for t in known:
            m, distinct = len(t.words), set(t.words)
            for k in range(0 if t.phrase else -(-len(w) // m)):
                common = len(distinct & set(w[k * m : (k + 2) * m]))
                if common >= t.needed:
                    found.add(t.label)
                    score = max(score, common / len(distinct))
        seen += bool(found)
        r = got[i]
        assert (r["n_base"], r["base_labels"], r["labels"]) == (len(base), ",".join(sorted({b for _, b in base})), ",".join(sorted(found)))
        assert r["score"] == pytest.approx(score)
        assert (r["first_word"], r["last_word"]) == ((min(base)[0], max(base)[0]) if base else (None, None))
    assert seen > 50


def test_text_of_license_words(spark):
    """A text that holds nothing but words of notices costs its length; each place is found once."""
    docs = spark.createDataFrame([(1, "mit cc by nc filler " * 40_000)], "doc_id long, text string")
    found = license_scan.license_scan(docs).first()
    assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"]) == (200_000, 40_000, 1, 199_996)
    assert found["labels"] == "cc-by-nc"


def test_orders_of_filters():
    """The contractions against documents counted one by one."""
    random = np.random.default_rng(2)
    cells = random.integers(0, 32, 400)
    tensors = np.zeros((1, 32, 3), np.int64)
    good = random.random(400) < 0.3
    for c, g in zip(cells, good):
        tensors[0, c] += (1, g, not g)
    frame = filter_audit.audit_rows(["p"], tensors.reshape(-1, 2, 2, 2, 2, 2, 3).transpose(0, 5, 4, 3, 2, 1, 6))
    totals = {}
    for r in frame.itertuples():
        bits = [1 << "ABCDE".index(x) for x in r.filter_order]
        earlier, here = sum(bits[: r.step - 1]), bits[r.step - 1]
        removed = (cells & here > 0) & (cells & earlier == 0)
        assert (r.kept, r.removed) == (np.sum(cells & (earlier | here) == 0), removed.sum())
        assert (r.redundant, r.unique_fails) == (np.sum((cells & here > 0) & (cells & earlier > 0)), np.sum(cells == here))
        assert (r.good_lost, r.toxic_lost) == (np.sum(removed & good), np.sum(removed & ~good))
        totals[r.filter_order[r.step - 1]] = totals.get(r.filter_order[r.step - 1], 0) + r.removed
    assert all(r.shapley == totals[r.filter_order[r.step - 1]] for r in frame.itertuples()) and len(frame) == 600
