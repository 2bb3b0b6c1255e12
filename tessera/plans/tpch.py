"""The driver's tables in the engine's roles: triples from keys, conversations as paged documents and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t


#: Rows of lineitem that one task makes distinct, at most, whatever AQE would put together.
SOLD_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triples(spark: SparkSession, sf_dir: str, parts: bool = True, plural: bool = False) -> DataFrame:
    """nation - part_of - region, supplier / customer - located_in - nation, supplier - supplies - part; plural: the parts of every tenth supplier in the plural.

    Names get their keys (s_key, o_key; null where they could be no node) in the tables that have them, not in every triple.
    """

    def named(df: DataFrame, *names: str) -> DataFrame:
        return df.withColumns({f"{n}_as": t.valid_entity_key(F.col(n)) for n in names})

    nation = named(table(spark, sf_dir, "nation"), "n_name")
    region = named(table(spark, sf_dir, "region"), "r_name")
    suppliers = named(table(spark, sf_dir, "supplier"), "s_name")

    def rows(df: DataFrame, s: str, r: str, o: str, file: str, order: str) -> DataFrame:
        return df.select(F.col(s).alias("subject"), F.lit(r).alias("relation"), F.col(o).alias("object"), F.lit(file).alias("source_file"), F.lit(1).alias("page"), F.lit("").alias("sentence"), F.lit("domain").alias("extractor"), F.expr(order).cast("long").alias("ord"), F.col(f"{s}_as").alias("s_key"), F.col(f"{o}_as").alias("o_key"))

    out = rows(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "part_of", "r_name", "nation", "n_nationkey")
    supplier = suppliers.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    customer = named(table(spark, sf_dir, "customer"), "c_name").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = out.unionByName(rows(supplier, "s_name", "located_in", "n_name", "supplier", "1000 + s_suppkey")).unionByName(rows(customer, "c_name", "located_in", "n_name", "customer", "1000000000 + c_custkey"))
    if parts:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
        part = named(part.withColumn("p_names", F.concat("p_name", F.lit("s"))), "p_name", "p_names") if plural else named(part, "p_name")
        # one shuffle by the part serves both distinct() and the join with the parts; its partitions don't grow with the table
        sold = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sold.count() // SOLD_ROWS))
        sold = sold.filter("l_suppkey is not null and l_partkey is not null").repartition(n, "l_partkey").distinct()
        pair = sold.join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        if plural:
            tenth = F.expr("(l_suppkey * 1000000000 + l_partkey) div 1000000000 % 10 = 9")
            pair = pair.withColumns({c: F.when(tenth, F.col(c.replace("name", "names"))).otherwise(F.col(c)) for c in ("p_name", "p_name_as")})
        out = out.unionByName(rows(pair, "s_name", "supplies", "p_name", "lineitem", "1000000000000 + l_suppkey * 1000000000 + l_partkey"))
    return out


NORM = """trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '^(the|an|a|our|their|its|this|that|these|those)\\s+', ''), '["''`()\\[\\]{{}}]', '', 'g'), '\\s+', ' ', 'g'), ' .,;:-')"""


def norm_sql(x: str) -> str:
    return NORM.format(x=x)


def triples_sql(parts: bool = True) -> str:
    """The same in SQL, with keys."""
    supplies = """
  UNION ALL SELECT s_name, 'supplies', p_name, 'lineitem', 1000000000000 + l_suppkey * 1000000000 + l_partkey
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""
    return f"""
raw(subject, relation, object, source_file, ord) AS (
  SELECT n_name, 'part_of', r_name, 'nation', CAST(n_nationkey AS BIGINT) FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, 'located_in', n_name, 'supplier', 1000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_name, 'located_in', n_name, 'customer', 1000000000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey{supplies if parts else ''}),
triples AS (
  SELECT *, {norm_sql('subject')} AS s_key, {norm_sql('object')} AS o_key FROM raw),
edges AS (SELECT s_key AS src, o_key AS dst, * FROM triples WHERE s_key <> o_key),
ends AS (
  SELECT s_key AS key, subject AS name, ord * 2 AS spot, source_file, s_key <> o_key AS edge FROM triples
  UNION ALL SELECT o_key, object, ord * 2 + 1, source_file, s_key <> o_key FROM triples)"""


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of pages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").cast("int").alias("turn"), "role", F.col("text").alias("content"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
