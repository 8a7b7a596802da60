"""Tokens and sentences cut from bytes beside the same cuts by regular expressions and by the JVM."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from authorscope import score_files
from authorscope.functions import text as T
from authorscope.functions.regex import WHITESPACE_CHARS
from authorscope.operators import text_bytes as B
from authorscope.operators import token_statistics as TS
from authorscope.schema import FILES_SCHEMA

ALPHABET = "abz_09 \n\t.!?,-;ébÉ漢字🚀Αςσ̇  　٠²𐐀\x00\x1c\x85¿…"


def made(draw, n):
    return "".join(draw.choice(ALPHABET[: draw.choice((8, 16, len(ALPHABET)))]) for _ in range(n))


def batch():
    draw = random.Random(11)
    fixed = [None, "", "a", "é", " ", ".", "🚀", "a.b", "one two three four.", "x" * 10 + ".", "y" * 11 + "!", "z z " * 5 + "w?", "a" * 20 + ". " + "b" * 21]
    return fixed + [made(draw, draw.choice((3, 40, 300, 2000))) for _ in range(150)]


def sums(words):
    return {"n": len(words), "s": sum(words), "q": sum(w * w for w in words)}


def facts(text):
    white = re.escape(WHITESPACE_CHARS)
    spoken = [s for s in (p.strip(WHITESPACE_CHARS) for p in re.split("[.!?]+", text or "")) if len(s) > 10]
    words = [re.split(f"[{white}]+", s) for s in spoken]
    firsts = Counter(w[0] for w in words)
    top = sorted(firsts, key=lambda w: (-firsts[w], [x[0] for x in words].index(w)))[:3] if len(spoken) >= 5 else []
    return sums([len(w) for w in words]) | {
        "long": sums([len(w) for w, s in zip(words, spoken) if len(s) > 20]), "top": [{"neg": -firsts[w], "value": w} for w in top],
    }


def test_sentences_of_a_batch():
    texts = batch()
    array, plain = pa.array(texts, pa.string()), np.zeros(len(texts), bool)
    want = [facts(t) for t in texts]
    assert B.sentence_facts(array, plain).to_pylist() == want
    assert B.sentence_facts(array.slice(6, 30), plain[:30]).to_pylist() == want[6:36]
    assert B.sentence_facts(array.slice(0, 0), plain[:0]).to_pylist() == []


def test_tokens_of_a_batch_are_those_of_the_jvm(spark):
    texts = [t for t in batch() if t is not None] + ["a\U00010570b ࡰc"]  # letters that only later versions know
    rows = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "i int, t string, code boolean")
    kind = F.when(F.col("code"), "code").otherwise("documentation")
    rows = rows.select("i", "t", "code", T.tokens(F.col("t"), kind).alias("want"), B.unknown_characters(F.col("t")).alias("unknown")).orderBy("i").collect()
    unknown = "".join({r.unknown for r in rows if r.unknown})
    found = B.token_lists(pa.array([None] + [r.t for r in rows] + [""]), np.array([False] + [r.code for r in rows] + [True]), unknown)
    assert found.to_pylist() == [[]] + [r.want for r in rows] + [[]]
    assert B.token_lists(pa.array([], pa.string()), np.zeros(0, bool)).to_pylist() == []


def test_uneven_lower_case_and_pieces(spark, monkeypatch):
    """Sentences are measured as they were written, and a first word is lower-cased by itself."""
    monkeypatch.setattr(B, "PIECE_BYTES", 40)
    assert [z - a for a, z in B.in_bytes(pa.array(["x" * 30, None, "y" * 10, "z" * 90, "", "w"]))] == [3, 1, 2]
    texts = ["İİİİİİİİİİ. " * 6, "Bc.ΑΣ.Bcde ΑΣ one two. " * 6, "ΣΑΣ is here, all of it! " * 5, None, "plain words are here. " * 7]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    said = B.sentences(F.lower("t"), F.col("t"), F.col("i") < 0)
    cut = T.sentences(F.col("t"), 10)
    got = rows.select("i", said.alias("s"), F.size(cut).alias("n"), F.array_distinct(F.transform(cut, T.first_word)).alias("w")).orderBy("i").collect()
    for r in got:
        assert r.s.n == max(r.n or 0, 0) and [x.value for x in r.s.top] == (r.w or [] if r.s.n >= 5 else [])


def test_words_with_parts_stay_within_a_word():
    words = pa.array(["ab", "bab", "ca", "é", "éa", "ébab"])
    found = TS.words_with(words, ("ab", "b", "bb", "ac", "é", "zz", "bab", "ébab"))
    assert [list(x) for x in found] == [[0, 1, 5], [0, 1, 5], [], [], [3, 4, 5], [], [1, 5], [5]]
    assert [list(x) for x in TS.words_with(pa.array([], pa.string()), ("a", "ab"))] == [[], []]


def test_texts_cross_whole(spark):
    """Neither tokens nor sentences are made in the JVM for the token step."""
    files = spark.createDataFrame([("r", "a.md", 10, "word " * 80)], FILES_SCHEMA)
    plan = score_files(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "[.!?]+" not in plan and "_sentences" not in plan and "_spoken" in plan
