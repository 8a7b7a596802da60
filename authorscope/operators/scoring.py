"""From one text per row to its signals and its score. Map-only: no shuffle until rows are summed per repo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ScoringConfig
from ..functions import text as T
from ..functions.exprs import built_once, let, std_pop, total
from ..schema import SIGNALS, confidence_band, is_definitive
from . import distribution as D
from . import heuristics as H
from . import predictability as P
from .markers import ATTRIBUTION_RULES, attribution_signals, compact, marker_signals
from .rules import some_part, word_parts
from .text_bytes import sentences, unknown_characters
from .token_statistics import token_statistics

ATTRIBUTION_LITERALS = {n for r in ATTRIBUTION_RULES for n in r.needs}
PHRASE_LITERALS = {n for r in H.PHRASE_RULES for n in r.needs}
#: The rules' literals; where tokens are counted, those that tokens leave room for are told with the counts.
LITERALS = tuple(sorted(H.LITERALS | ATTRIBUTION_LITERALS))
#: They and the words in them.
PARTS = tuple(sorted(word_parts(LITERALS).union(LITERALS)))


def with_text_views(texts: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    """Add the arrays the rules read. Columns no selected rule uses are pruned from the plan.

    Python columns come first, while rows are narrow: only the text a Python rule needs crosses over.
    """
    texts = texts.withColumn("_low", F.lower("content"))
    content, kind, low = F.col("content"), F.col("content_type"), F.col("_low")
    code, python = F.coalesce(kind == "code", F.lit(False)), {}
    if config.enable_heuristic:
        python["_md"] = H.markdown_lists(H.markdown_list_input(content, kind))
    if config.enable_statistical:
        python["_told"] = token_statistics(low, code, unknown_characters(low), config.ngram_sizes, config.min_tokens, LITERALS)
    if config.enable_heuristic or config.enable_statistical:
        python["_spoken"] = sentences(low, content, code)
    texts = texts.withColumns(python)
    if config.enable_predictability and config.scorer is not None:
        parts = T.chunks(content, config.max_chunk_size, config.min_chunk_size, config.max_chunks)
        texts = texts.withColumn("_ppl", P.mean_perplexity(parts, config.scorer))
    for stage in view_columns(config):
        texts = texts.withColumns(stage)
    return texts


@built_once
def view_columns(config: ScoringConfig) -> list[dict[str, Column]]:
    """The derived columns in dependency order, one dict per projection."""
    content, kind = F.col("content"), F.col("content_type")
    is_code = kind == "code"
    return [
        {
            "_lines": F.when(is_code, T.lines(content)),
            "_docstrings": F.when(is_code, T.docstrings(content)),
            **({"_tokens": F.col("_told.statistics"), "_parts": F.col("_told.parts"), "_zipf": D.zipf_fit(F.col("_told.statistics"))} if config.enable_statistical else {}),
        },
        {"_stripped": F.transform("_lines", T.strip)},
        {
            "_comments": T.comments(F.col("_stripped")),
            "_filled": F.filter("_lines", lambda line: T.strip(line) != ""),
        },
    ]


def token_views() -> D.TokenViews:
    return D.TokenViews(
        tokens=F.col("_tokens"),
        zipf=F.col("_zipf"),
        sentences=F.col("_spoken"),
        filled_lines=F.col("_filled"),
        content_type=F.col("content_type"),
    )


def code_signals(parts: Column | None = None) -> list[Column]:
    content, stripped = F.col("content"), F.col("_stripped")
    return (
        H.comment_signals(F.col("_comments"), stripped)
        + H.structure_signals(F.col("_lines"), stripped)
        + H.naming_signals(content, parts)
        + H.code_habit_signals(content, F.col("_low"), stripped, parts)
        + H.docstring_signals(F.col("_docstrings"))
    )


def documentation_signals(parts: Column | None = None) -> list[Column]:
    return H.documentation_signals(F.col("content"), F.col("_low"), F.col("_spoken.long"), F.col("_md"), parts)


def configuration_signals(parts: Column | None = None) -> list[Column]:
    return H.configuration_signals(F.col("content"), F.col("_low"), parts)


def predictability_signals(config: ScoringConfig) -> Column:
    """Perplexity rule with a scorer; the two fallback rules without one or where it failed."""
    fallback = compact(P.fallback_signals(F.col("content"), F.col("_low")))
    if config.scorer is None:
        return fallback
    scored = compact(
        P.perplexity_signals(F.col("_ppl")["perplexity"], F.col("content_type"), config)
    )
    return F.when(F.col("_ppl")["failed"], fallback).otherwise(scored)


@built_once
def signal_array(config: ScoringConfig = DEFAULT, *, markers: bool = True) -> Column:
    """All signals of a text in emission order: attribution, marker file, heuristics, distribution, predictability."""
    content, kind = F.col("content"), F.col("content_type")
    none = F.array().cast(SIGNALS)
    parts = F.col("_parts") if config.enable_statistical else None
    families = []

    def where_told(signals: list[Column], literals: set[str]) -> Column:
        """No rule of a family is gone through for texts that hold none of its literals."""
        fired = compact(signals)
        return fired if parts is None else F.when(some_part(parts, literals), fired).otherwise(none)

    if markers:
        families.append(where_told(attribution_signals(content, F.col("_low"), parts), ATTRIBUTION_LITERALS))
        families.append(compact(marker_signals(F.col("path"))))
    if config.enable_heuristic:
        by_type = (
            F.when(kind == "code", compact(code_signals(parts)))
            .when(kind == "documentation", compact(documentation_signals(parts)))
            .when(kind == "configuration", compact(configuration_signals(parts)))
            .otherwise(none)
        )
        long_enough = T.has_length(content, config.min_content_length)
        phrases = where_told(H.phrase_signals(F.col("_low"), parts), PHRASE_LITERALS)
        families.append(F.when(long_enough, phrases).otherwise(none))
        families.append(F.when(long_enough, by_type).otherwise(none))
    if config.enable_statistical:
        families.append(
            F.when(
                F.col("_tokens").isNotNull(), compact(D.distribution_signals(token_views(), config))
            ).otherwise(none)
        )
    if config.enable_predictability:
        families.append(predictability_signals(config))
    return F.concat(*families) if families else none


def weighted_mean(signals: Column) -> Column:
    """Σ score·weight / Σ weight; null for an empty array."""
    return F.when(
        F.size(signals) > 0,
        total(signals, lambda s: s["score"] * s["weight"]) / total(signals, lambda s: s["weight"]),
    )


def signal_confidence(signals: Column, probability: Column, config: ScoringConfig = DEFAULT) -> Column:
    n = F.size(signals)
    count_part = F.least(F.lit(1.0), n / config.min_signals_for_high_confidence)
    spread = std_pop(F.transform(signals, lambda s: s["score"]))
    agreement = F.when(n > 1, F.lit(1.0) - F.least(F.lit(1.0), spread / 0.3)).otherwise(0.5)
    strong = F.size(F.filter(signals, lambda s: s["weight"] >= 0.5))
    strong_part = F.least(F.lit(1.0), strong / 3)
    extremity = F.abs(probability - 0.5) * 2
    return confidence_band(
        count_part * 0.3 + agreement * 0.3 + strong_part * 0.2 + extremity * 0.2
    )


@built_once
def score_struct(config: ScoringConfig = DEFAULT) -> Column:
    """``struct(ai_probability, confidence, max_definitive)`` of the ``signals`` column."""
    def definitive(parts: Column) -> Column:
        top = F.array_max(F.transform(parts["d"], lambda s: s["score"]))
        rest = F.coalesce(weighted_mean(parts["o"]), F.lit(0.5))
        return F.struct(
            F.greatest(top, rest * 0.3 + top * 0.7).alias("ai_probability"),
            F.lit("very_high").alias("confidence"),
            top.alias("max_definitive"),
        )

    def ordinary(sigs: Column) -> Column:
        pushed = let(
            weighted_mean(sigs),
            lambda p: F.when(F.size(sigs) < 10, p)
            .when(p > 0.5, p + (F.lit(1.0) - p) * 0.1)
            .otherwise(p * 0.9),
        )
        return let(
            pushed,
            lambda p: F.struct(
                p.alias("ai_probability"),
                signal_confidence(sigs, p, config).alias("confidence"),
                F.lit(None).cast("double").alias("max_definitive"),
            ),
        )

    empty = F.struct(
        F.lit(0.0).alias("ai_probability"),
        F.lit("very_low").alias("confidence"),
        F.lit(None).cast("double").alias("max_definitive"),
    )

    def choose(sigs: Column) -> Column:
        parts = F.struct(
            F.filter(sigs, is_definitive).alias("d"), F.filter(sigs, lambda s: ~is_definitive(s)).alias("o")
        )
        return F.when(F.size(sigs) == 0, empty).otherwise(
            let(parts, lambda ps: F.when(F.size(ps["d"]) > 0, definitive(ps)).otherwise(ordinary(ps["o"])))
        )

    return let(F.col("signals"), choose)


def with_score(scored: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    """Add the score columns to a table with ``signals`` and ``line_count``."""
    return (
        scored.withColumn("_score", score_struct(config))
        .withColumns(
            {
                "ai_probability": F.col("_score.ai_probability"),
                "confidence": F.col("_score.confidence"),
                "max_definitive": F.col("_score.max_definitive"),
                "ai_line_estimate": (F.col("line_count") * F.col("_score.ai_probability")).cast("int"),
            }
        )
        .drop("_score")
    )


def score_rows(
    texts: DataFrame, keys: list[str], config: ScoringConfig = DEFAULT, *, markers: bool = True
) -> DataFrame:
    """Score a table with ``content``, ``content_type``, ``line_count`` (and ``path`` when ``markers``)."""
    # A one-element inline is a row-local fence: filters and projections on the result are not substituted back into
    # the rules, which would evaluate them again for each use.
    signals = with_text_views(texts, config).select(
        *keys,
        "content_type",
        "line_count",
        F.inline(F.array(F.struct(signal_array(config, markers=markers).alias("signals")))),
    )
    return with_score(signals, config).select(
        *keys, "content_type", "line_count", "ai_probability", "confidence", "ai_line_estimate",
        "max_definitive", "signals",
    )


@built_once
def rule_catalog(config: ScoringConfig = DEFAULT) -> dict[str, Column]:
    """Each text rule alone, as a nullable signal over the text views. ``F2`` covers both burstiness outcomes."""
    content, kind = F.col("content"), F.col("content_type")
    long_enough = F.length(content) >= config.min_content_length
    families = [
        ([r.rule_id for r in ATTRIBUTION_RULES], attribution_signals(content, F.col("_low")), F.lit(True)),
        ([r.rule_id for r in H.PHRASE_RULES], H.phrase_signals(F.col("_low")), long_enough),
        ([f"E{i}" for i in range(24, 36)], code_signals(), long_enough & (kind == "code")),
        (
            [f"E{i}" for i in (*range(36, 45), 47)],
            documentation_signals(),
            long_enough & (kind == "documentation"),
        ),
        (["E45", "E46"], configuration_signals(), long_enough & (kind == "configuration")),
        (
            ["F2", "F4", "F5", *(f"F6.{n}" for n in config.ngram_sizes), "F7", "F8", "F11", "F12", "F9", "F10"],
            D.distribution_signals(token_views(), config),
            F.col("_tokens").isNotNull(),
        ),
        (["G1", "G2"], P.fallback_signals(content, F.col("_low")), F.lit(True)),
    ]
    return {
        rule_id: F.when(guard, column)
        for ids, columns, guard in families
        for rule_id, column in zip(ids, columns, strict=True)
    }
