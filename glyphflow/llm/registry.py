"""Queries of the operators in this folder, and the SQL that checks them."""

from __future__ import annotations

from glyphflow.llm import ball_kmeans, bpe, decontamination, line_dedup, ngram_jaccard, packing, quality_classifier, secret_scan, sharding, substring_dedup, topk_search, warc, whitening


def queries() -> dict:
    return {
        "op1_sharding": sharding.query,
        "op2_secret_scan": secret_scan.query,
        "op3_line_dedup": line_dedup.query,
        "op4_benchmark_decontamination": decontamination.query,
        "op5_packing": packing.query,
        "op6_warc": warc.query,
        "op7_substring_dedup": substring_dedup.query,
        "op8_ngram_jaccard": ngram_jaccard.query,
        "op9_quality_classifier": quality_classifier.query,
        "op10_topk_search": topk_search.query,
        "op11_centroid_clustering": ball_kmeans.query,
        "op12_embedding_whitening": whitening.query,
        "op13_bpe_encoding": bpe.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.ORACLE,
        "op4_benchmark_decontamination": decontamination.ORACLE,
        "op6_warc": warc.ORACLE,
        "op7_substring_dedup": substring_dedup.ORACLE,
        "op8_ngram_jaccard": ngram_jaccard.ORACLE,
        "op10_topk_search": topk_search.ORACLE,
        "op11_centroid_clustering": ball_kmeans.ORACLE,
    }
