"""Distribution rules: how tokens, n-grams, sentences and lines are spread over one text.

A file is one row, so a groupBy on exploded tokens would shuffle every token of the corpus to learn facts that are
already together: tokens are counted within tasks (:mod:`token_statistics`), and what is told of them is judged here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ScoringConfig
from ..functions import text as T
from ..functions.exprs import (
    entropy_of_counts,
    fixed,
    int_list,
    let,
    moments_of_sums,
    percent,
    run_counts,
    text_literal,
    total,
)
from ..schema import signal
from .rules import capped, first

# ---- fixed values ----
STOP_WORDS = ("the", "a", "to", "of", "and", "in", "is")
MIN_TOKENS_BURST = 100
MIN_TOKENS_ZIPF = 200
MIN_TOKENS_VOCABULARY = 100
# ---- end of fixed values ----


def zipf_fit(tokens: Column) -> Column:
    """``struct(slope, r2)`` of ln(frequency) on ln(rank) over the top 50 tokens; null below 200 tokens or 20 distinct ones.

    ``r2`` is null when all frequencies are equal.
    """
    def fit(cs: Column) -> Column:
        points = F.transform(
            cs,
            lambda c, i: F.struct(F.ln((i + 1).cast("double")).alias("x"), F.ln(c.cast("double")).alias("y")),
        )
        return let(points, line)

    def line(ps: Column) -> Column:
        centre = F.struct(
            (total(ps, lambda p: p["x"]) / F.size(ps)).alias("x"),
            (total(ps, lambda p: p["y"]) / F.size(ps)).alias("y"),
        )
        return let(centre, lambda c: let(sums(ps, c), lambda s: result(ps, c, s)))

    def sums(ps: Column, c: Column) -> Column:
        return F.struct(
            total(ps, lambda p: (p["x"] - c["x"]) * (p["y"] - c["y"])).alias("xy"),
            total(ps, lambda p: (p["x"] - c["x"]) * (p["x"] - c["x"])).alias("xx"),
            total(ps, lambda p: (p["y"] - c["y"]) * (p["y"] - c["y"])).alias("yy"),
        )

    def result(ps: Column, c: Column, s: Column) -> Column:
        slope = s["xy"] / s["xx"]
        residual = total(
            ps,
            lambda p: F.pow(p["y"] - c["y"] - slope * (p["x"] - c["x"]), F.lit(2.0)),
        )
        r2 = F.when(s["yy"] > 0, F.lit(1.0) - residual / s["yy"])
        return F.struct(slope.alias("slope"), r2.alias("r2"))

    return F.when((tokens["n"] >= MIN_TOKENS_ZIPF) & (tokens["distinct"] >= 20), let(tokens["counts"], fit))


def normalised_line_entropy(filled_lines: Column) -> Column:
    """Entropy of line lengths over log2 of the number of distinct lengths; 0 for a single length."""
    counts = run_counts(F.sort_array(F.transform(filled_lines, F.length)))
    return let(
        counts,
        lambda cs: F.when(F.size(cs) > 1, entropy_of_counts(cs) / F.log2(F.size(cs).cast("double"))).otherwise(0.0),
    )


def sentence_variation(sentences: Column) -> Column:
    """``struct(mean, sd, cv)`` of the words of sentences; null below five sentences."""
    return F.when(
        sentences["n"] >= 5,
        let(
            moments_of_sums(sentences),
            lambda m: F.struct(
                m["mean"].alias("mean"),
                F.sqrt(m["var"]).alias("sd"),
                (F.sqrt(m["var"]) / m["mean"]).alias("cv"),
            ),
        ),
    )


@dataclass(frozen=True)
class TokenViews:
    """Columns the distribution rules read. ``tokens`` is what :mod:`token_statistics` tells, null below the guard;
    ``sentences`` what :mod:`text_bytes` tells."""

    tokens: Column
    zipf: Column
    sentences: Column
    filled_lines: Column
    content_type: Column


def burst_signals(value: Column) -> list[Column]:
    def make(b: Column) -> Column:
        evidence = F.array(F.concat(F.lit("Average burstiness: "), fixed(b, 3)))
        low = signal(
            "F2",
            "Low burstiness",
            F.least(F.lit(0.8), F.lit(0.3) + (F.lit(0.15) - b) * 2),
            0.6,
            F.concat(F.lit("Token distribution is unusually uniform (burstiness: "), fixed(b, 2), F.lit(")")),
            evidence,
        )
        high = signal(
            "F3",
            "High burstiness",
            0.2,
            0.5,
            F.concat(F.lit("Token distribution shows natural burstiness ("), fixed(b, 2), F.lit(")")),
            evidence,
        )
        return F.when(b < 0.15, low).when(b > 0.5, high)

    return [let(value, make)]


def zipf_signals(fit: Column) -> list[Column]:
    def poor(f: Column) -> Column:
        return F.when(
            f["r2"] < 0.85,
            signal(
                "F4",
                "Poor Zipf fit",
                F.least(F.lit(0.7), F.lit(0.3) + (F.lit(0.85) - f["r2"]) * 2),
                0.4,
                F.concat(
                    F.lit("Word frequency distribution deviates from Zipf's law (R²: "), fixed(f["r2"], 2), F.lit(")")
                ),
                F.array(
                    F.concat(
                        F.lit("Zipf exponent: "), fixed(F.abs(f["slope"]), 2), F.lit(", R²: "), fixed(f["r2"], 2)
                    )
                ),
            ),
        )

    def unusual(f: Column) -> Column:
        size = F.abs(f["slope"])
        return F.when(
            (size < 0.7) | (size > 1.3),
            signal(
                "F5",
                "Unusual Zipf exponent",
                0.5,
                0.35,
                F.concat(F.lit("Zipf exponent ("), fixed(size, 2), F.lit(") outside normal range (0.7-1.3)")),
                F.array(F.concat(F.lit("Expected ~1.0, got "), fixed(size, 2))),
            ),
        )

    return [let(fit, poor), let(fit, unusual)]


def ngram_signal(repeated: Column, n: int) -> Column:
    """Fires when two of the five most repeated n-grams are not made of stop words alone."""
    telling = F.filter(
        repeated, lambda gram: F.exists(F.split(gram, " ", -1), lambda t: ~t.isin(list(STOP_WORDS)))
    )
    return let(
        telling,
        lambda rs: F.when(
            F.size(rs) >= 2,
            signal(
                "F6",
                f"Repeated {n}-grams",
                capped(0.6, 0.2, 0.1, F.size(rs)),
                0.35,
                F.concat(F.lit("Found "), F.size(rs).cast("string"), F.lit(f" frequently repeated {n}-grams")),
                first(rs, 3),
            ),
        ),
    )


def vocabulary_signals(tokens: Column) -> list[Column]:
    """``tokens`` is null below the token guard."""
    def uniform(windows: Column) -> Column:
        stats = F.when(windows["n"] >= 4, windows)
        return let(
            stats,
            lambda st: F.when(
                st["sd"] < 0.05,
                signal(
                    "F7",
                    "Uniform vocabulary density",
                    F.least(F.lit(0.7), F.lit(0.3) + (F.lit(0.05) - st["sd"]) * 10),
                    0.5,
                    F.concat(
                        F.lit("Vocabulary density is unusually consistent (std: "), fixed(st["sd"], 3), F.lit(")")
                    ),
                    F.array(
                        F.concat(
                            F.lit("TTR mean: "), fixed(st["mean"], 3), F.lit(", std: "), fixed(st["sd"], 3)
                        )
                    ),
                ),
            ),
        )

    def low(r: Column) -> Column:
        share = r["distinct"] / r["all"]
        return F.when(
            share < 0.3,
            signal(
                "F8",
                "Low vocabulary diversity",
                0.4,
                0.3,
                F.concat(F.lit("Limited vocabulary usage ("), percent(share, 1), F.lit(" unique tokens)")),
                F.array(
                    F.concat(
                        F.lit("Unique: "), r["distinct"].cast("string"), F.lit(", Total: "), r["all"].cast("string")
                    )
                ),
            ),
        )

    enough = tokens["n"] >= MIN_TOKENS_VOCABULARY
    sizes = F.when(enough, F.struct(tokens["distinct"].alias("distinct"), tokens["n"].alias("all")))
    return [let(F.when(enough, tokens["windows"]), uniform), let(sizes, low)]


def code_line_signals(filled_lines: Column) -> list[Column]:
    def even(h: Column) -> Column:
        return F.when(
            h < 0.7,
            signal(
                "F11",
                "Uniform line lengths",
                F.least(F.lit(0.6), F.lit(0.2) + (F.lit(0.7) - h)),
                0.4,
                F.concat(F.lit("Code line lengths are unusually uniform (entropy: "), fixed(h, 2), F.lit(")")),
                F.array(F.concat(F.lit("Normalized entropy: "), fixed(h, 3))),
            ),
        )

    def few(r: Column) -> Column:
        return F.when(
            (F.size(r["levels"]) <= 3) & (r["n"] > 20),
            signal(
                "F12",
                "Limited indent levels",
                0.4,
                0.3,
                F.concat(
                    F.lit("Only "), F.size(r["levels"]).cast("string"), F.lit(" indentation levels in "),
                    r["n"].cast("string"), F.lit(" lines"),
                ),
                F.array(F.concat(F.lit("Levels: "), int_list(F.sort_array(r["levels"])))),
            ),
        )

    enough = F.size(filled_lines) >= 10
    levels = F.struct(
        F.array_distinct(F.transform(filled_lines, T.indent)).alias("levels"), F.size(filled_lines).alias("n")
    )
    return [
        let(F.when(enough, normalised_line_entropy(filled_lines)), even),
        let(F.when(enough, levels), few),
    ]


def prose_signals(sentences: Column) -> list[Column]:
    """Sentences are stripped and longer than ten characters."""
    def even(m: Column) -> Column:
        return F.when(
            m["cv"] < 0.35,
            signal(
                "F9",
                "Uniform sentence lengths",
                F.least(F.lit(0.7), F.lit(0.3) + (F.lit(0.35) - m["cv"])),
                0.55,
                F.concat(F.lit("Sentence lengths are unusually consistent (CV: "), fixed(m["cv"], 2), F.lit(")")),
                F.array(
                    F.concat(F.lit("Mean: "), fixed(m["mean"], 1), F.lit(" words, Std: "), fixed(m["sd"], 1))
                ),
            ),
        )

    def repetitive(r: Column) -> Column:
        share = -F.aggregate(r["top"], F.lit(0), lambda a, w: a + w["neg"]) / r["n"]
        listing = F.array_join(
            F.transform(
                r["top"],
                lambda w: F.concat(
                    F.lit("("), text_literal(w["value"]), F.lit(", "), (-w["neg"]).cast("string"), F.lit(")")
                ),
            ),
            ", ",
        )
        return let(
            share,
            lambda c: F.when(
                c > 0.5,
                signal(
                    "F10",
                    "Repetitive sentence starts",
                    F.least(F.lit(0.65), F.lit(0.2) + c * 0.5),
                    0.45,
                    F.concat(F.lit("Many sentences start with same words ("), percent(c, 0), F.lit(")")),
                    F.array(F.concat(F.lit("Top: ["), listing, F.lit("]"))),
                ),
            ),
        )

    top = F.when(sentences["n"] >= 5, F.struct(sentences["top"].alias("top"), sentences["n"].alias("n")))
    return [let(sentence_variation(sentences), even), let(top, repetitive)]


def distribution_signals(v: TokenViews, config: ScoringConfig) -> list[Column]:
    """All distribution rules in order. ``tokens`` is null below the token guard, which silences every rule."""
    n = v.tokens["n"]
    enough = v.tokens.isNotNull()
    bursts = F.when(n >= MIN_TOKENS_BURST, v.tokens["burstiness"])
    out = burst_signals(bursts) + zipf_signals(v.zipf)
    out += [
        F.when(n >= 10 * size, ngram_signal(F.get(v.tokens["grams"], F.lit(i)), size)) for i, size in enumerate(config.ngram_sizes)
    ]
    out += vocabulary_signals(v.tokens)
    is_code = v.content_type == "code"
    out += [F.when(enough & is_code, s) for s in code_line_signals(v.filled_lines)]
    out += [F.when(enough & ~is_code, s) for s in prose_signals(v.sentences)]
    return out
