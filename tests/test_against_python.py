"""Every pattern and text primitive against Python's own ``re`` and ``str`` on generated strings."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from authorscope.functions import text as T
from authorscope.functions.exprs import fixed
from authorscope.operators import commits as C
from authorscope.operators import heuristics as H
from authorscope.operators import markers as M
from checks.corpus import MESSAGES, SEEDS

I, MULTI = re.IGNORECASE, re.MULTILINE
FLAGS = {"i": I, "m": MULTI, "s": re.DOTALL}
PATTERNS = (
    [(r.pattern, "im") for r in M.ATTRIBUTION_RULES]
    + [(r.pattern, "") for r in (*H.PHRASE_RULES, *H.PROSE_RULES)]
    + [(p, "") for p in (*H.OBVIOUS_COMMENTS, *H.VERBOSE_NAMES, *H.TEXTBOOK_NAMES, H.TRY_BLOCK)]
    + [(p, "") for p, _ in (*H.DEBUG_CALLS, *H.DOCSTRING_TEMPLATES)]
    + [(H.TODO_NOTE, "i"), (H.SECTION_HEADERS, "im"), (H.EMOJI, "im"), (H.CONTENTS_TABLE, "im"), (H.PLACEHOLDERS, "i")]
    + [(r"/\*.*?\*/", "s"), (r"//.*$", "m")]
    + [(p, "i") for _, p, _, _ in C.MESSAGE_RULES]
    + [(p, "i") for p, _, _ in (*M.AUTHORS, *C.AI_NAMES)]
    + [(p, "") for p in C.BOT_NAMES]
)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = [w for s in [s for _, s in SEEDS] + MESSAGES for w in re.findall(r"\S+", s)]
    words += "claude copilot gpt bot ci_bot é ½ ſ K ñandú 日本 ́ camelCaseNameOfFive a_b_c_d_e_f 1 ، # // -- ; /* */".split()
    pieces = [s for _, s in SEEDS if s and len(s) < 300] + MESSAGES
    gaps = [" ", " ", " ", "\n", "\n\n", "", "\t", "\r", "\x85", "\xa0", " ", "\x1c", ". ", "! "]
    out = ["", " ", "\n", "a\n"]
    for _ in range(1500):
        parts = []
        for _ in range(rng.randint(1, 14)):
            parts += [rng.choice(pieces) if rng.random() < 0.25 else rng.choice(words), rng.choice(gaps)]
        text = "".join(parts)
        out.append(text.lower() if rng.random() < 0.3 else text)
    return out


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, x string").repartition(8).cache()


def values(frame, make):
    return [r[1] for r in frame.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_patterns_match_like_python(frame, texts):
    wrong = []
    for start in range(0, len(PATTERNS), 24):
        group = PATTERNS[start : start + 24]
        got = frame.select("i", *[T.count_matches(F.col("x"), p, f).alias(f"c{k}") for k, (p, f) in enumerate(group)])
        rows = got.orderBy("i").collect()
        for k, (pattern, flags) in enumerate(group):
            compiled = re.compile(pattern, sum((FLAGS[f] for f in flags), re.NOFLAG))
            for row, text in zip(rows, texts):
                want = sum(1 for _ in compiled.finditer(text))
                if row[k + 1] != want:
                    wrong.append((pattern, text, row[k + 1], want))
    assert not wrong, (len(wrong), wrong[:3])


def test_literal_tests_never_hide_a_match(texts):
    for rules, flags in ((M.ATTRIBUTION_RULES, I | MULTI), (H.PHRASE_RULES, 0), (H.PROSE_RULES, 0)):
        for rule in rules:
            compiled = re.compile(rule.pattern, flags)
            for text in texts:
                lowered = text.lower()
                if compiled.search(text if flags else lowered):
                    assert any(n in lowered for n in rule.needs), (rule, text)


def comments(text):
    out = []
    for line in text.split("\n"):
        s = line.strip()
        for prefix in ("//", "#", "--", ";"):
            if s.startswith(prefix) and not s.startswith(prefix * 2):
                out.append(s[len(prefix) :].strip())
                break
    return out


@pytest.mark.parametrize(
    "make, want",
    [
        (T.strip, str.strip),
        (lambda x: T.prose_tokens(F.lower(x)), lambda t: re.findall(r"\b\w+\b", t.lower())),
        (lambda x: T.code_tokens(F.lower(x)), lambda t: re.findall(r"\b\w+\b|[^\w\s]", t.lower())),
        (T.lines, lambda t: t.split("\n")),
        (lambda x: T.sentences(x, 10), lambda t: [s.strip() for s in re.split(r"[.!?]+", t) if len(s.strip()) > 10]),
        (T.words, str.split),
        (lambda x: T.comments(F.transform(T.lines(x), T.strip)), comments),
        (T.docstrings, lambda t: re.findall(r"(?:\"\"\"|''')(.*?)(?:\"\"\"|''')", t, re.DOTALL)),
        (lambda x: F.transform(T.lines(x), T.indent), lambda t: [len(s) - len(s.lstrip()) for s in t.split("\n")]),
        (
            lambda x: F.sort_array(T.character_counts(x)),
            lambda t: sorted(t.count(c) for c in set(t)),
        ),
        (
            lambda x: F.size(F.filter(F.transform(T.lines(x), T.strip), T.is_code_line)),
            lambda t: sum(
                1 for s in t.split("\n")
                if s.strip() and not s.strip().startswith(("//", "#", "--", ";", "/*", "*", "'''", '"""'))
            ),
        ),
    ],
)
def test_primitives_match_python(frame, texts, make, want):
    got = values(frame, make)
    wrong = [(t, g, want(t)) for t, g in zip(texts, got) if g != want(t)]
    assert not wrong, (len(wrong), wrong[:2])


def test_markdown_list_rules(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    rows = df.select("i", H.markdown_lists(F.col("x")).alias("m")).orderBy("i").collect()
    for row, text in zip(rows, texts):
        assert row.m.badges == len(re.findall(H.BADGES, text, I | MULTI))
        assert row.m.feature_lists == len(re.findall(H.FEATURE_LIST, text, I | MULTI))


def test_feature_lists_equal_the_pattern():
    rng = random.Random(11)
    pieces = ["- **a**: b\n", "* **", "**", "**:", " ", "\n", "x", "- ", "*", "- **a**\n", "- **a** \n", "\n\n", "- **a**:\n", "\t", "- \n **q** z\n", "\u2028", "\x0b"]
    found = 0
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 22)))
        want = sum(1 for _ in re.finditer(H.FEATURE_LIST, text, I | MULTI))
        assert H.count_feature_lists(text) == want, text
        found += want > 0
    assert found > 300


@pytest.mark.parametrize("text", ["* ** x ** x " * 90_000 + "\n", "* " + "** x " * 200_000 + "\n", "*" * 1_000_000, "- **" * 250_000, "- **a**" + "\n" * 1_000_000, "- **a**\n" * 120_000])
def test_feature_lists_of_hostile_texts(text):
    start = time.process_time()
    H.count_feature_lists(text)
    assert time.process_time() - start < 2  # the pattern itself would take hours


def test_long_inputs_do_not_exhaust_the_stack(spark):
    rows = [
        ("code", "a" + "Bc" * 20000), ("code", "a" + "_b" * 20000),
        ("documentation", "## Table of Contents\n" + "- [A](#a)\n" * 20000),
        ("documentation", "- **A**: b\n" * 5000), ("code", '"""' + "x " * 200000 + '"""'),
    ]
    from authorscope import score_texts

    df = spark.createDataFrame(rows, "content_type string, content string")
    assert score_texts(df).count() == len(rows)
    assert {s.rule_id for r in score_texts(df).collect() for s in r.signals} >= {"E39", "E40", "E35"}


def test_number_formatting(spark):
    numbers = [0.125, 0.375, 2.5, 0.145, 14.35, 1234567.891, 0.0, -0.0421, 1e-9, 99.95]
    df = spark.createDataFrame(list(enumerate(numbers)), "i int, x double")
    for digits in (0, 1, 2, 3):
        got = [r[0] for r in df.orderBy("i").select(fixed(F.col("x"), digits)).collect()]
        assert got == [f"{n:.{digits}f}" for n in numbers]
