"""The queries over the corpus tables, and their SQL."""

from __future__ import annotations

from flowloom.llm.common import documents
from flowloom.llm import bpe, exact_dedup, html_text, jaccard_join, language_id, lexical_search, line_dedup, packing, quality, repeat_dedup, spelling, toxicity, window_dedup


def op1_html_text(spark, sf_dir):
    return html_text.extract(documents(spark, sf_dir, "pages"))


def op2_line_dedup(spark, sf_dir):
    return line_dedup.line_digests(documents(spark, sf_dir))


def op3_best_two_fit(spark, sf_dir):
    return packing.packed_digests(documents(spark, sf_dir))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op5_language_id(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir))


def op6_repeat_dedup(spark, sf_dir):
    return repeat_dedup.repeat_digests(documents(spark, sf_dir))


def op7_byte_level_bpe(spark, sf_dir):
    return bpe.bpe_digests(documents(spark, sf_dir))


def op8_quality_rules(spark, sf_dir):
    return quality.quality_rules(documents(spark, sf_dir))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op11_window_dedup(spark, sf_dir):
    return window_dedup.window_digests(documents(spark, sf_dir))


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(documents(spark, sf_dir))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_text,
        op2_line_dedup,
        op3_best_two_fit,
        op4_jaccard_join,
        op5_language_id,
        op6_repeat_dedup,
        op7_byte_level_bpe,
        op8_quality_rules,
        op9_exact_dedup,
        op10_toxicity,
        op11_window_dedup,
        op12_spelling_variants,
        op13_lexical_search,
    )
}
#: The others have no equivalent in SQL; tests/llm holds them against brute force or held-out rows.
ORACLES = {
    "op2_line_dedup": line_dedup.oracle(),
    "op8_quality_rules": quality.oracle(),
    "op9_exact_dedup": exact_dedup.oracle(),
    "op11_window_dedup": window_dedup.oracle(),
    "op12_spelling_variants": spelling.oracle(),
    "op13_lexical_search": lexical_search.oracle(),
}
