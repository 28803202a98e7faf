"""A training corpus from `documents`, in stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; its result is written and read again as the next stage's docs.  All but
the last return the columns of documents; the last adds token ids and the text
that they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qsieve.llm import byte_bpe, decontaminate, pii, quality, simhash
from qsieve.llm.frames import fresh, kept
from qsieve.llm.queries import KEEP_SCORE, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts; fitted on this stage's rows."""
    name = fresh("score", docs)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name).filter(F.col(name) >= KEEP_SCORE).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that of the smallest doc_id."""
    return simhash.keep_one(docs, 3, 3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words occurs in benchmark windows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind in brackets; n_chars follows."""
    spans = fresh("pii", docs)
    found = pii.find_pii(docs, spans).withColumn("text", pii.mask(spans))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (`ids`), their number, and the text they decode to (`decoded`)."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids, raw = fresh("ids", docs), fresh("decoded", docs)
    coded = byte_bpe.encode(docs, path, pattern, ids, decoded=raw)
    return coded.select(*docs.columns, F.size(ids).cast("long").alias(fresh("n_tokens", docs)), ids, F.decode(raw, "UTF-8").alias(raw))


STAGES = [("quality classifier", keep_quality), ("SimHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_contaminated),
          ("PII", mask_pii), ("byte-level BPE", encode_tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result checkpointed before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept(docs)
    return docs
