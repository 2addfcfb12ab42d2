"""From raw documents to a clean, tokenised corpus: five stages, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, jaccard_join, line_dedup, sentencepieces, toxicity
from leafmill.llm.common import stash, table
from leafmill.llm.queries import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 10 doesn't predict to be toxic."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    rest = [c for c in docs.columns if c != "doc_id"]
    return toxicity.score(docs, index, keep=rest).where("predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line chunks that stand elsewhere before; n_chars follows the text."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies."""
    copies = stash(jaccard_join.jaccard_join(docs).where("doc_id <> class_id").select("doc_id").distinct(), "copies")
    few = copies.limit(jaccard_join.BROADCAST_IDS + 1).count() <= jaccard_join.BROADCAST_IDS
    return docs.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    rest = [c for c in docs.columns if c != "doc_id"]
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=rest).where(~F.col("contaminated")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document that is left."""
    return sentencepieces.sentencepiece_encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("SentencePiece encoding", encode)]
#: Nearest-neighbour votes and BPE merges are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
