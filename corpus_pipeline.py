"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows as Parquet in
the shared folder and reads them again for the next. All but the last return the columns of documents.
SQL can't express the trained and the packing stages, so there is no oracle; tests compare the stages with
brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import decontaminate
from tessera.llm.linededup import line_dedup
from tessera.llm.packing import pack
from tessera.llm.simhash import simhash_dedup
from tessera.llm.toxicity import toxicity_scores
from tessera.session import drop_scratch, materialize, owned, scratch

ORACLE_SQL = None
MAX_BROADCAST = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; rows pass through the scoring, so their texts aren't shuffled.

    Null and empty texts have the bias's score and stay unless most texts are toxic; each repeated row is decided alike.
    """
    return toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), whole=True).filter("predicted = 0").select("document.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines gone that many documents share; n_chars follows the text.

    No row goes; a null text stays null, as an empty line is never dropped.
    """
    found = line_dedup(docs)
    changed = {"text": F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("document.text")), "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("document.n_chars"))}
    return found.select(*[changed.get(c, F.col(f"document.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Null and empty texts are copies of each other. Rows that share an id are one document, they stay or go
    together; rows with a null id stay. Ids that go are broadcast if there are at most ``MAX_BROADCAST``, so
    that texts needn't be shuffled, and joined otherwise.
    """
    found = simhash_dedup(docs)
    gone = materialize(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = gone.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with an item; null and empty texts share none and stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=True).filter("n_hit = 0").select("document.*")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a null or empty text is one closing id."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        with owned(spark):  # what a stage wrote on its way goes when its rows are written
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        if last:
            drop_scratch(spark, last)
        last = path
    return docs
