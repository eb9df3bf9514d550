"""A training corpus from raw documents: good ones, one of each near-duplicate group, none that leak a benchmark, personal
data replaced, encoded. Part of the subpackage ``framewright.llm``.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. Null texts count as empty throughout; rows
with a null id pass every filter that does not reject them by their text; rows that share an id
stay or go together in the stages that compare documents; extra columns pass up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.bpe import encode_decode
from framewright.llm.components import prepare, stored
from framewright.llm.decontaminate import decontaminated
from framewright.llm.jaccard import jaccard_components
from framewright.llm.pii import redact
from framewright.llm.quality import accepted_documents, train
from framewright.llm.registry import read

META = ["lang", "source"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the co-trained classifier rejects go."""
    return accepted_documents(docs, train(docs, read(spark, sf_dir, "labels"), META), META)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of documents that links of Jaccard similarity 0.8 or more on five-word shingles join, the one with
    the smallest id stays."""
    found = jaccard_components(docs, size=5, percent=80)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that share a passage with a benchmark item go."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: spans of personal data are replaced by their kind, and n_chars is counted anew."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def _ids(ids: list[list[int]], decoded: list[bytes]) -> list[pa.Array]:
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array(ids, pa.list_(pa.int32())),
        pa.array([len(x) for x in decoded], pa.int64()),
    ]


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the token ids of each document and how many bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(
        docs, path, public_tokenizers.PATTERN, finish=_ids, schema="n_tokens bigint, ids array<int>, n_bytes bigint"
    )


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("byte-level BPE", encoded),
]

#: None of the stages but the filters has a form in SQL: trained weights, spaced seeds and merges do not; tests/llm holds
#: every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "corpus")
    return docs


def all_queries() -> dict:
    return {"pipeline": run}


def all_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
