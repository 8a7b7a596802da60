"""Predictability rules: character entropy, common fragments, and perplexity from a pluggable scorer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ScoringConfig, Scorer
from ..functions import text as T
from ..functions.exprs import entropy_of_counts, fixed, let, percent
from ..schema import signal

# ---- fixed values: fragments whose density is measured ----
FRAGMENTS = (
    "the ", " is ", " to ", " of ", " a ", " in ", " and", " for", "tion", "ing ", " it ", "this",
    " we ", "you ", " be ", "that", "with", " as ", "are ", "was ", "will", "have", " an ", " or ",
)
# ---- end of fixed values ----


def character_entropy(content: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for empty text."""
    return F.when(F.length(content) > 0, entropy_of_counts(T.character_counts(content))).otherwise(0.0)


def fragment_density(content: Column, lowered: Column) -> Column:
    """Non-overlapping occurrences of the fragments per ten characters, at most 1."""
    found = F.lit(0)
    for fragment in FRAGMENTS:
        removed = F.length(lowered) - F.length(F.replace(lowered, F.lit(fragment), F.lit("")))
        found = found + removed / F.lit(len(fragment))
    return F.least(F.lit(1.0), found / (F.greatest(F.length(content) - 1, F.lit(1)) / 10))


def fallback_signals(content: Column, lowered: Column) -> list[Column]:
    def moderate(h: Column) -> Column:
        return F.when(
            (h > 3.5) & (h < 4.5),
            signal(
                "G1",
                "Moderate entropy",
                0.4,
                0.3,
                F.concat(F.lit("Character entropy in AI-typical range ("), fixed(h, 2), F.lit(")")),
                F.array(F.concat(F.lit("Entropy: "), fixed(h, 3))),
            ),
        )

    def predictable(p: Column) -> Column:
        return F.when(
            p > 0.6,
            signal(
                "G2",
                "High predictability",
                F.least(F.lit(0.7), F.lit(0.3) + p * 0.5),
                0.5,
                F.concat(F.lit("Content shows high predictability patterns ("), percent(p, 1), F.lit(")")),
            ),
        )

    return [let(character_entropy(content), moderate), let(fragment_density(content, lowered), predictable)]


def perplexity_signals(perplexity: Column, content_type: Column, config: ScoringConfig) -> list[Column]:
    limit = F.when(content_type == "code", F.lit(config.code_perplexity_threshold)).otherwise(
        F.lit(config.text_perplexity_threshold)
    )

    def make(r: Column) -> Column:
        p, t = r["p"], r["t"]
        low = signal(
            "G3",
            "Low perplexity (ML)",
            F.least(F.lit(0.85), F.lit(0.3) + (t * 0.5 - p) / t),
            0.7,
            F.concat(
                F.lit("Content is highly predictable to language model (perplexity: "), fixed(p, 1), F.lit(")")
            ),
            F.array(
                F.concat(
                    F.lit("Average perplexity: "), fixed(p, 2), F.lit(", threshold: "), t.cast("string")
                )
            ),
        )
        high = signal(
            "G3",
            "High perplexity (ML)",
            0.2,
            0.6,
            F.concat(F.lit("Content shows natural variation (perplexity: "), fixed(p, 1), F.lit(")")),
            F.array(F.concat(F.lit("Average perplexity: "), fixed(p, 2))),
        )
        return F.when(p < t * 0.5, low).when(p > t * 2, high)

    return [let(F.struct(perplexity.alias("p"), limit.alias("t")), make)]


def mean_perplexity(chunks: Column, scorer: Scorer) -> Column:
    """``struct(perplexity, failed)``: the mean over the scored chunks of each text, in one distributed pass.

    The chunks of a whole Arrow batch go to the scorer in one call, so a model runs on full batches; the scorer is
    shipped once per Python worker. If that call fails, the batch is scored text by text, and only the texts that fail
    by themselves are marked as failed, which selects the fallback rules; so a text's result does not depend on others.
    """
    @F.pandas_udf("struct<perplexity:double,failed:boolean>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def means(texts: list) -> list[float | None]:
            owner = [i for i, parts in enumerate(texts) for _ in parts]
            flat = [part for parts in texts for part in parts]
            values = pd.Series(scorer(flat) if flat else [], index=owner, dtype="float64")
            return values.dropna().groupby(level=0).mean().reindex(range(len(texts))).tolist()

        def alone(parts: list) -> tuple[float | None, bool]:
            try:
                return means([parts])[0], False
            except Exception:  # noqa: BLE001 - any scorer error selects the fallback rules
                return None, True

        for batch in batches:
            texts = [[] if parts is None else list(parts) for parts in batch]
            try:
                found = [(value, False) for value in means(texts)]
            except Exception:  # noqa: BLE001
                found = [alone(parts) for parts in texts]
            yield pd.DataFrame(found, columns=["perplexity", "failed"]).astype({"perplexity": "float64", "failed": "bool"})

    return score(chunks)
