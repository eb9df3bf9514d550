"""Queries of the operators that compare documents with each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.llm.jaccard import jaccard_components
from framewright.llm.registry import query, read
from framewright.llm.repeats import remove_repeats
from framewright.llm.vectors import near_vectors


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    kept = remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_ngram_jaccard")
def op5_ngram_jaccard(spark, sf_dir):
    return jaccard_components(read(spark, sf_dir, "documents"))


@query("op9_embedding_neardup")
def op9_embedding_neardup(spark, sf_dir):
    return near_vectors(read(spark, sf_dir, "embeddings"))
