"""Corpus pipeline: documents to token ids in five stages.

1. quality: documents that the quality classifier rejects go;
2. lines: lines that at least 10 of the remaining documents hold go;
3. near-duplicates: one document of each SimHash group stays;
4. mix: sources meet their target shares; a document comes as often as it is taken;
5. pieces: texts become SentencePiece ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import lines, mixing, quality, simhash, spm
from fleetlens.llm.common import stored, table
from fleetlens.llm.queries import THRESHOLD, crc_of
from fleetlens.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the threshold; the classifier learns from the
    labelled rows among ``docs`` that are not held out."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", crc_of(F.col("id")) % 5 != 0)
    return docs.where(quality.score_column(spark, model) >= THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that at least 10 of them hold; ``n_chars`` follows the text."""
    return lines.dedup_lines(docs, min_docs=10, min_chars=1)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (smallest id) of each group linked by 3 or fewer bits of 3-word SimHashes."""
    return simhash.keep_one(docs, shingle=3, bits=3)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as a mix of 150 % of all words by source weights 5, 2, 1 takes them."""
    return mixing.mix(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, ids, scores, n_pieces`` of every document."""
    return spm.encode_texts(docs, keep=["doc_id", "lang", "source"])


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near-duplicates", simhash_stage), ("mix", mix_stage),
          ("pieces", piece_stage)]

#: SQL has neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
