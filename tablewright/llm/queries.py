"""The contract's queries: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, importance, infill, jaccard, knn, licenses, mixing, ngramlm, pieces, quality, repeats, urlrules, vectors

SEED = 20_240_501

#: Fixed values of the contract.
URL_RULES = [urlrules.Rule("net", "/", "block"), urlrules.Rule("example.net", "/en/", "allow"), urlrules.Rule("example.com", "/de/", "block"), urlrules.Rule("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores, dealt out anew; others stay as they are.

    Files of one row group cannot be split; on large tables, with many splits, nothing is moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = knn.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return knn.top_k(points.where("vec_id % 100 = 0"), points, k=10)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_file())


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest_conversations(chat.format_rows(rows.unionByName(extra)))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.cycled_weights, seed=SEED)


def op6_neardup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.links(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rest = quality.remainder(F.col("doc_id"), 4)
    weights = quality.train(docs, table(spark, sf_dir, "labels"), allowed=rest != 2)
    scored = quality.score(docs, weights)
    return scored.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), n=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), n=5, threshold=0.8)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = quality.remainder(F.col("doc_id"), 7)
    out = ngramlm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), learn=rest != 2)
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.transform(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    restored = out.withColumn("_restored", infill.restore(F.col("output"), F.col("form")))
    return restored.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("_restored").cast("binary"), 256).alias("restored_sha256"),
    )


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.with_base(licenses.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return importance.resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_topk, op2_urls, op3_pieces, op4_chat, op5_mix, op6_neardup_vectors, op7_quality, op8_repeats, op9_jaccard, op10_lm, op11_infill, op12_licenses, op13_resample)}
