"""The queries of this subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import embedding_dedup, lm, mixing, packing, pii, quality, sharding, shingle_join, token_counts, toxicity
from .common import table


def op3_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_sampled_splitters(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark, sf_dir):
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_ngram_likelihood_ratio(spark, sf_dir):
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_boosted_candidates(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents"))


def op2_noisy_channel_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_context_mixing(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op10_robust_pruned_graph(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_edit_aware_counts(spark, sf_dir):
    return token_counts.recount(token_counts.routine_edits(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_context_mixing, op2_noisy_channel_toxicity, op3_mix_sources, op4_edit_aware_counts, op5_ngram_jaccard_join, op6_sampled_splitters, op7_ngram_likelihood_ratio, op8_best_fit_packing, op9_boosted_candidates, op10_robust_pruned_graph)}
ORACLE_SQL: dict[str, str] = {}
