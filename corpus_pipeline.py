"""From raw documents to token ids, in five stages, each an operator of ``matchloom.llm``.

1. language ID: documents whose language is not recognised go (also null texts and texts without a letter);
2. line dedup: of fuzzy copies of a line the first stays, other lines go from their texts, and n_chars follows;
3. near-dedup: of each component of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays;
4. decontamination: documents that hold a window of ten words of the benchmark go;
5. SentencePiece: every text gets its piece ids; the columns of documents stay in front.

Each stage takes what its predecessor kept, whole, as the table that ``run`` has written. Null ids pass through all
stages; rows that repeat both id and text become one in stage 3. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import decontam, langid, lines, minhash, pieces
from matchloom.llm.tables import load
from matchloom.plans.scratch import materialise
from matchloom.plans.ship import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.drop_unknown(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept, count = lines.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        n = F.when(F.col(count) > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return kept.drop(count)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontam.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.encode(docs, pieces.read_model())[0]


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("SentencePiece", sentencepiece),
]

#: So many documents at most go to a Python worker at once: whole texts are large, on both sides of the way.
BATCH_ROWS = 1000

#: SQL has neither the language model, SimHash nor the pieces; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower(), BATCH_ROWS)
    return docs
