"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import language_id, line_dedup, packing, simhash, toxicity
from spanloom.llm.common import held_out
from spanloom.plans.shared import remove_folder, shared_folder, spread

_WORD_LEFT = r"[^\x20\x09-\x0D]"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told, each under the predicted one.

    Null texts and those without a letter go. Null ids stay, as do repeated rows, each on its own;
    an empty table gives none; columns of any name are carried along.
    """
    profiles = language_id.train(docs, ~held_out(F.col("doc_id")))
    return language_id.relabel(docs, profiles).where(F.col("lang") != language_id.UNDETERMINED)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxicity model doesn't predict as toxic.

    Null texts count as empty. Repeated rows are decided alike; null ids stay; an empty table gives
    none; columns of any name are carried along.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeated runs of lines; a document of which no word is left was a repetition itself and goes.

    Null and empty texts stay as they are. Rows that agree in doc_id and text are one document and
    keep the same lines; an empty table gives none; columns of any name are carried along, n_chars
    is counted anew.
    """
    done = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(_WORD_LEFT)
    columns = [F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return done.where(~F.coalesce(emptied, F.lit(False))).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the one of smallest doc_id, null ids last.

    It is decided by row, so documents that only share an id both stay; of repeated rows one stays.
    Null, empty and wordless texts are one group; an empty table gives none; columns of any name are
    carried along.
    """
    return simhash.keep_representatives(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2,048 ids.

    A null text is the one id 0. Repeated rows and null ids are packed each on its own; an empty
    table gives none; other columns aren't read.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: Trained models, fingerprints and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of a folder, each over what the one before wrote.

    A stage's table is deleted once the next one's is written, so at most two copies of the corpus
    exist at a time; the last stage's input stays for as long as its result may be read.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    at, before = shared_folder(spark, "corpus-pipeline"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
