"""Token statistics of a batch beside plain Python, and literal tests beside ``in``."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from authorscope import score_files
from authorscope.functions.regex import SPACE, WORD, first_letters
from authorscope.operators import heuristics as H
from authorscope.functions import text as T
from authorscope.operators import text_bytes as B
from authorscope.operators import token_statistics as TS
from authorscope.operators.markers import ATTRIBUTION_RULES, attribution_signals, commit_markers, compact
from authorscope.operators.rules import holds, placed_words, word_part
from authorscope.operators.scoring import LITERALS, PARTS
from authorscope.schema import FILES_SCHEMA


def expected(tokens, sizes, least):
    if tokens is None or len(tokens) < least:
        return None
    places = {t: [i for i, x in enumerate(tokens) if x == t] for t in sorted(set(tokens), key=str.encode)}
    values = []
    for t, at in places.items():
        if len(at) >= 3 and len(t) > 2:
            gaps = [b - a for a, b in zip(at, at[1:])]
            mu = sum(gaps) / len(gaps)
            sd = math.sqrt(sum((g - mu) ** 2 for g in gaps) / len(gaps))
            values.append((sd - mu) / (sd + mu))
    grams = []
    for n in sizes:
        counts = Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))  # in order of first position
        repeated = [g for g, c in counts.items() if c >= 5]
        order = sorted(repeated, key=lambda g: -counts[g]) if n > 1 else sorted(repeated, key=lambda g: g[0].encode())
        grams.append([" ".join(g) for g in order[:5]])
    shares = [len(set(tokens[s : s + 50])) / 50 for s in range(0, len(tokens) - 50, 25)]
    mean = sum(shares) / len(shares) if shares else None
    return {
        "n": len(tokens),
        "distinct": len(places),
        "burstiness": pytest.approx(sum(values) / len(values)) if len(values) >= 10 else None,
        "counts": sorted((len(at) for at in places.values()), reverse=True)[:50],
        "grams": grams,
        "windows": shares and {
            "n": len(shares), "mean": pytest.approx(mean),
            "sd": pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in shares) / len(shares)), abs=1e-7),
        } or None,
    }


@pytest.mark.parametrize("sizes", [(2, 3, 4), (1, 3), ()])
def test_statistics_of_a_batch(sizes):
    draw = random.Random(7)
    words = ["the", "of", "é", "漢字漢字", "z", "zebra", "🚀"] + [f"word{i}" for i in range(40)]
    texts = [None, [], ["a"] * 49, ["a"] * 50, ["a"] * 51, ["ab", "c"] * 120]
    texts += [[draw.choice(words[: draw.choice((3, 12, len(words)))]) for _ in range(draw.choice((60, 99, 400, 1500)))] for _ in range(40)]
    array = pa.array(texts, pa.list_(pa.string()))
    want = [expected(t, sizes, 50) for t in texts]
    assert TS.statistics_of(array, sizes, 50).to_pylist() == want
    assert TS.statistics_of(array.slice(5, 20), sizes, 50).to_pylist() == want[5:25]
    assert TS.statistics_of(array.slice(0, 0), sizes, 50).to_pylist() == []


def test_pieces_hold_every_list_once(monkeypatch):
    monkeypatch.setattr(TS, "TOKENS", 10)
    texts = [["a"] * n for n in (3, 0, 25, 4, 4, 4, 0, 10, 11)] + [None]
    pieces = TS.in_pieces(pa.array(texts, pa.list_(pa.string())))
    assert [t for p in pieces for t in p.to_pylist()] == texts
    assert all(len(p) == 1 or sum(len(t or []) for t in p.to_pylist()) <= 10 for p in pieces)


def test_no_tokens_in_rows(spark):
    """Neither tokens nor their positions are columns of the rows that the rules read."""
    files = spark.createDataFrame([("r", "a.md", 10, "word " * 80)], FILES_SCHEMA)
    plan = score_files(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "_words" not in plan and "_pairs" not in plan


def test_literal_from_its_rarest_character(spark):
    literals = [" will ", "let me ", "i'll ", "🤖", "ab", "zzz", "co-authored-by:", "e"]
    texts = ["he will go", "he will", "let me", "let me see", "i'll do", "x🤖", "ab", "azzz", "zz", "co-authored-by: x", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[holds(F.col("t"), x).alias(str(i)) for i, x in enumerate(literals)]).collect()
    for r in rows:
        assert list(r)[1:] == [None if r.t is None else x in r.t for x in literals]


def test_parts_that_tokens_hold(spark):
    """Told of every list, also of those without statistics; a rule's literals leave no match out."""
    texts = [None, [], ["let", "me"], ["outlet"], ["first", "firstly", "key"] * 20, ["é", "🚀"], ["x"] * 60]
    told = TS.told_of(pa.array(texts, pa.list_(pa.string())), (2,), 50, ("first", "let", "me", "key"))
    assert told.field("parts").to_pylist() == [[], [], ["let", "me"], ["let"], ["first", "key"], [], []]
    assert [s and s["n"] for s in told.field("statistics").to_pylist()] == [None, None, None, None, 60, None, 60]
    assert TS.told_of(pa.array([["a"]]), (), 1, ()).field("parts").to_pylist() == [[]]
    needs = {n for r in (*ATTRIBUTION_RULES, *H.PHRASE_RULES, *H.PROSE_RULES) for n in r.needs}
    for literal in needs - {"🤖", "✨"}:
        assert word_part(literal) in PARTS and any(word_part(literal) in t for t in re.findall(r"\w+", f"x{literal}x"))


def test_order_of_large_and_equal_keys():
    draw = random.Random(3)
    for top in (1, 5, 1 << 40, (1 << 62) - 1):
        keys = np.array([draw.randint(0, top) for _ in range(500)])
        assert (TS.stable_order(keys) == np.argsort(keys, kind="stable")).all()
        want = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        assert all((a == b).all() for a, b in zip(TS.grouped(keys), want[1:]))
    assert [len(x) for x in TS.grouped(np.array([], np.int64))] == [0, 0, 0]


def test_texts_are_searched_for_what_their_tokens_hold(spark):
    """The same signals with and without the tokens' parts, and no literal is looked for where its word is missing."""
    text = "let me show it. Generated with Claude Code. Feel free to use this. 🤖 Generated with [Claude. " * 3
    rows = spark.createDataFrame([("d.md", text), ("c.py", text + " isValid" * 12), ("e.md", "nothing to see here " * 9)], "path string, content string")
    rows = rows.withColumns({"low": F.lower("content"), "parts": F.array(*[F.when(F.lower("content").contains(p), p) for p in PARTS])})
    for make in (attribution_signals, lambda c, low, *p: H.phrase_signals(low, *p), lambda c, low, *p: H.naming_signals(c, *p)):
        plain, told = (compact(make(F.col("content"), F.col("low"), *p)) for p in ((), (F.array_compact("parts"),)))
        assert rows.where(~plain.eqNullSafe(told)).count() == 0
    none = F.array().cast("array<string>")
    assert [len(r[0]) for r in rows.select(compact(H.phrase_signals(F.col("low"), none))).collect()] == [0, 0, 0]


@pytest.mark.parametrize("pattern, letters", [
    (r"let me", "l"), (r"(?:a|an|the) x", "at"), (r"(?:A-b|c\w) x", "Ac"), (r"(?:a|b)?c", ""), (r"x?y", ""), (r"x*", ""),
    (r"(?:x?a|b)", ""), (r"[a-z]+", ""), (r"(?:(?:a|b)c|d)", ""), (r"(?:|a)b", ""), (r"x+y", "x"), (r"(?:a|b)+c", "ab"),
])
def test_first_letters(pattern, letters):
    assert first_letters(pattern) == letters


def test_classes_hold_the_same_characters(spark):
    """Against the categories alone, for every character of the first planes, with and without case."""
    rows = spark.range(0x30000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    for flags in ("", "(?diu)"):
        for new, plain in ((WORD, r"_\p{L}\p{N}"), (SPACE, r"\s\x0b\x1c-\x1f\x85\p{Z}")):
            for shape in ("[{}]", "[^{}]", "[{}-]", "(?<![{}])\\z"):
                assert rows.where(F.col("c").rlike(flags + shape.format(new)) != F.col("c").rlike(flags + shape.format(plain))).count() == 0


def test_literals_are_told_by_all_their_words():
    """A word that a literal begins or ends for must be the end or begin of a token; emojis are looked for in the texts."""
    asked = ("let me ", "der", "here's ", " str", "aıder:", "key", "🤖", "✨")
    texts = ["outlet me too", "let mean", "me let", "under", "there s", "here sit", "a stress test", "abstract", "aıder:", "monkeys", None, "é🤖 key", "", "✨🤖"]
    lists = B.token_lists(pa.array(texts, pa.string()), np.zeros(len(texts), bool))
    told = TS.with_symbols(TS.told_of(lists, (2,), 50, asked), pa.array(texts, pa.string()), asked)
    assert [set(p) for p in told.field("parts").to_pylist()] == [
        {"let me "}, set(), {"let me "}, {"der"}, {"here's "}, set(), {" str"}, set(), {"aıder:", "der"}, {"key"}, set(),
        {"key", "🤖"}, set(), {"🤖", "✨"},
    ]
    for literal in LITERALS:
        if words := placed_words(literal):
            tokens = B.token_lists(pa.array([f"x {literal.strip()} x"]), np.array([True]))
            assert literal in TS.told_of(tokens, (), 50, LITERALS).field("parts").to_pylist()[0] and all(w.strip() for w in words)


def test_variants_of_letters_are_found(spark):
    """Unicode's other forms of i and k match without case, so the literals leave room for them."""
    texts = ["AIDER: fix", "aİder: fix", "AıDER: fix", "under: fix", "HACK: implement the rest of it now\n" * 2]
    rows = spark.createDataFrame([("r", f"{i}.py", 400, f"{t}\n" + "some plain words\n" * 30) for i, t in enumerate(texts)], FILES_SCHEMA)
    got = {r.path: {s.name for s in r.signals} for r in score_files(rows).collect()}
    assert ["Aider commit marker" in got[f"{i}.py"] for i in range(5)] == [True, True, True, False, False]
    assert "AI-style TODO comments" in got["4.py"]


def test_characters_are_counted_of_short_texts_alone(spark):
    texts = ["", "a" * 49, "a" * 50, "é" * 49, "é" * 50, "🚀" * 49, "🚀" * 50, "a" * 199, "a\n\nb\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.has_length(F.col("t"), 50).alias("h"), T.line_count(F.col("t")).alias("n"))
    for r in rows.collect():
        assert (r.h, r.n) == ((None, None) if r.t is None else (len(r.t) >= 50, r.t.count("\n") + 1))


def test_messages_are_lowered_once(spark):
    """Message and people patterns of a commit; the message is not lower-cased for each literal."""
    texts = ["AIDER: tidy", "Generated with Claude Code", "word", "", None]
    rows = spark.createDataFrame([(t, "Ann Lee", "ann@example.org") for t in texts], "m string, a string, e string")
    marked = rows.select("m", commit_markers(F.col("m"), F.col("a"), F.col("e")).alias("s"))
    assert marked._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 1
    got = {r.m: [x.name for x in r.s] for r in marked.collect()}
    assert got == {t: [] for t in texts} | {"AIDER: tidy": ["Commit: Aider commit marker"], "Generated with Claude Code": ["Commit: Claude Code attribution"]}
