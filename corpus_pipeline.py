"""A training corpus from ``documents``: quality, near duplicates, repeated passages, mixture, tokens.

Each stage is written as Parquet in the cluster's shared folder and read again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import jaccard, mixing, pieces, quality, repeats
from tablewright.llm._store import shared_folder
from tablewright.llm._words import WORD_PATTERN
from tablewright.llm.queries import SEED, table, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of 0.7 or more; the classifier learns from the labels outside the held-out fold.

    Null and empty texts are scored by the bias alone; repeated rows share their score and stay or go together. An
    empty table gives an empty one; only the columns of ``documents`` go on.
    """
    weights = quality.train(docs, table(spark, sf_dir, "labels"), allowed=quality.remainder(F.col("doc_id"), 4) != 2)
    return quality.score(docs, weights, carry=COLUMNS[1:]).where("score >= 0.7").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-gram Jaccard similarity of 0.8 or more, the one of the smallest id.

    Of repeated rows of one id and text the least row stays, so reruns agree. Texts without words and rows without an
    id link with nothing and stay. Columns beside those of ``documents`` do not go on.
    """
    return jaccard.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words and more that an earlier document holds; untouched ones keep their form.

    A document that loses all its words goes. Null and empty texts and rows without an id lose nothing; repeated rows
    of one id are one document and cut nothing from each other.
    """
    out = repeats.remove_repeats(docs, carry=("lang", "source", "n_chars"), keep_form=True)
    text = F.col("kept").cast("string")
    left = out.where("n_removed = 0 or n_removed < n_words")
    return left.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; a last partial repetition holds its first words.

    Documents of which nothing is taken, those without words among them, go. A null source is a source of its own;
    repeated rows are documents each.
    """
    mixed = mixing.mix(docs, mixing.cycled_weights, seed=SEED, carry=("text", "lang", "source", "n_chars")).where("taken > 0")
    turns = mixed.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.expr("int((taken - 1) div size)"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("_turn") * F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD_PATTERN), 0), 1, words.cast("int")), " ")
    text = F.when(words < F.col("size"), cut).otherwise(F.col("text"))
    return turns.select("doc_id", text.alias("text"), "lang", "source", F.when(words < F.col("size"), F.length(text)).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text's number of ids and the digests of its ids and of what they decode to; null texts are empty ones."""
    return pieces.encode_decode(docs, tokenizer_file())


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_passages),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]

#: The trained classifier and the tokenizer have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
