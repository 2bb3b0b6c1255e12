"""A corpus from raw documents: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame; all but the last return the
columns of docs. A decision is on a doc_id and its text, so rows without doc_id, and texts that share one, are judged
each by itself. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, neardup, sharding, toxicity
from tessera.llm.shared import materialise


def _row_is(docs: str, other: str) -> Column:
    """A row of docs (with `_key`, its text's hash) is the one that a decision (doc_id, key) names."""
    return F.col(f"{docs}.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col(f"{docs}._key") == F.col(f"{other}.key"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    keyed = docs.withColumn("_key", F.xxhash64("text")).alias("d")
    return keyed.join(rejected.select("doc_id", "key").distinct().alias("r"), _row_is("d", "r"), "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    scores = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scores.filter("score >= 0.5"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, similarity 0.8): that with the smallest doc_id; and one of each repeated row."""
    classes = neardup.near_duplicates(docs, width=5, percent=80, count_links=False)
    found = materialise(classes.groupBy("doc_id", "key", "class").agg(F.count("*").alias("n")), "duplicate-classes")
    # ids come before none, and of texts that share an id one is taken by its hash
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = found.filter("class is not null").groupBy("class").agg(F.min(place).alias("best"), F.count("*").alias("of")).filter("of > 1")
    rejected = found.join(best, "class").filter(~place.eqNullSafe(F.col("best")))
    kept = _without(docs, rejected)
    repeated = found.filter("n > 1").select("doc_id", "key")
    keyed = kept.withColumn("_key", F.xxhash64("text")).alias("d")
    once = keyed.join(repeated.alias("r"), _row_is("d", "r"), "left_semi").dropDuplicates(["doc_id", "_key"])
    return _without(kept, repeated).unionByName(once.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 13-word passage of the benchmark, whatever their length, and of whose words less than a twentieth lie in its items of fewer words."""
    hits = decontam.contaminated_words(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, hits.filter(f"n_hit >= {decontam.WIDTH} or n_hit > 0 and n_hit * 20 >= n_words"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mix = mixing.entropy_mix(docs).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_k"), F.xxhash64("source").alias("_s")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    keyed = docs.withColumn("_text", F.xxhash64("text")).withColumn("_source", F.xxhash64("source"))
    joined = keyed.join(mix, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_k")) & (F.col("_source") == F.col("_s")))
    # repeated rows share out the copies of all of them; the join has partitioned and sorted by these keys already
    rank = F.row_number().over(Window.partitionBy("doc_id", "_text", "_source").orderBy(F.lit(1)))
    n = F.floor(F.col("_copies") / F.col("_rows")) + F.when(rank <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    return joined.withColumn("_n", n.cast("int")).filter("_n > 0").withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus itself, every row with its shard of eight along the Hilbert curve and its slot there."""
    place = {"size": F.col("size"), "text_crc32": F.col("text_crc32"), "law": F.lit("rows"), "shard": F.col("shard"), "slot": F.col("slot"), "grown_shard": F.lit(None).cast("int")}
    rows = sharding.hilbert_shards(docs, carry=True)
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in place], *[c.alias(n) for n, c in place.items()])


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]
#: Trained scores and signatures aren't SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
