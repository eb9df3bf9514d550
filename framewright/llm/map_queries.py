"""Queries of the operators that work row by row."""

from __future__ import annotations

import hashlib
from functools import partial

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from framewright.llm.bpe import encode_decode, vocabulary
from framewright.llm.decontaminate import overlaps
from framewright.llm.extraction import extract_text
from framewright.llm.pii import BASE, KINDS, personal_data
from framewright.llm.quality import quality_scores, train
from framewright.llm.registry import query, read
from framewright.llm.shards import training_order

DECIMAL = [str(i) for i in range(1 << 16)]


def digests(ids, decoded):
    """Count, digest of the decimal ids and digest of the bytes."""
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([hashlib.sha256(",".join(map(DECIMAL.__getitem__, x)).encode()).hexdigest() for x in ids]),
        pa.array([hashlib.sha256(b).hexdigest() for b in decoded]),
    ]


@query("op4_byte_bpe")
def op4_byte_bpe(spark, sf_dir):
    return encode_decode(
        read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        finish=digests,
        schema="n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def span_text(spans):
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
    )


@query("op10_pii")
def op10_pii(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data(docs).select("doc_id", "spans")
    return found.select(
        "doc_id",
        *(
            F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}") for kind in KINDS
        ),
        F.sha2(span_text(F.filter("spans", lambda s: s.kind.isin(*BASE))), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


@query("op1_html_extraction")
def op1_html_extraction(spark, sf_dir):
    pages = extract_text(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op3_decontamination")
def op3_decontamination(spark, sf_dir):
    """The passages found; a document without any has no row."""
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


TRAINING_KEY = 20260101


def multilingual_encoder():
    known = vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return partial(known.encode, leaf=4096)


@query("op7_token_shards")
def op7_token_shards(spark, sf_dir):
    """Writes the shards to the shared folder; one row a sequence with its slot."""
    index, _ = training_order(read(spark, sf_dir, "documents"), multilingual_encoder, TRAINING_KEY)
    return index


META = ["lang", "source"]


@query("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, read(spark, sf_dir, "labels"), META), META)
