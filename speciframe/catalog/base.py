"""Registry of the queries with their SQL equivalents, and the derived views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly when the scan gives fewer tasks than there are cores (one small
    file); a large input is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def r6(column, name: str):
    return F.round(column, 6).alias(name)


# The views below are the same text in both engines; ``{part}`` stands for the table in Spark.
TAXA = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS kingdom, p_brand AS phylum,
 CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END AS cls, p_brand AS ord, p_type AS family,
 CASE WHEN p_partkey % 11 = 0 THEN '' ELSE split_part(p_name,' ',1) END AS genus,
 CASE WHEN p_partkey % 11 = 0 OR p_partkey % 3 = 0 THEN '' ELSE split_part(p_name,' ',2) END AS species,
 CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 3 <> 0 AND p_size < 10 THEN p_type ELSE '' END AS subspecies,
 CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS common_name FROM {part}
"""
CLASS_STRINGS = """
SELECT id, CASE WHEN id % 2 = 0 THEN lpad(CAST(id AS STRING),5,'0') || '_' ELSE '' END
 || concat_ws('_',family,phylum,cls,ord,family,split_part(common_name,' ',1),species) AS cls FROM {taxa}
"""
PAIRS = """
SELECT a.vec_id AS id, CAST(floor(a.vec_id / 64) AS BIGINT) AS batch_id, a.label, a.embedding AS image, b.embedding AS text
FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1
"""
METER = "SELECT event_id AS step, event_type AS metric, value AS val, 1 + event_id % 8 AS n, ts FROM {events}"
SHARDS = """
SELECT s_suppkey AS shard_no, 'shard-' || lpad(CAST(s_suppkey AS STRING), 5, '0') || '.tar' AS url,
 1 + s_suppkey % 3 AS weight FROM {supplier}
"""
MEMBERS = """
SELECT source AS url, doc_id AS member_no, lang || '.' || CASE doc_id % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'TXT' ELSE 'sci.txt' END AS fname,
 text FROM {documents}
"""
TASKS = """
SELECT t AS task, vec_id AS row_idx, CASE WHEN label = t THEN 1 ELSE 0 END AS label,
 CASE WHEN substr(md5(concat_ws(':', '7', CAST(vec_id AS STRING))), 1, 1) < 'c' THEN 'train' ELSE 'test' END AS split
"""
TRAITS = """
SELECT d.doc_id AS id, l.quality, l.toxic, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS p_quality,
 CASE WHEN d.lang = 'en' AND d.n_chars < 800 THEN 1 ELSE 0 END AS p_toxic
FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id
"""
SAMPLES = """
SELECT doc_id AS id, source AS url, lang, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS txt,
 CASE WHEN doc_id % 3 = 0 THEN u END AS jpg, CASE WHEN doc_id % 5 = 0 THEN u END AS png
"""


def ctes(*names: str) -> str:
    """WITH clause of the named views for the oracle."""
    views = {
        "taxa": TAXA.format(part="part"),
        "class_strings": CLASS_STRINGS.format(taxa="taxa"),
        "features": "SELECT vec_id AS id, embedding AS features, label AS target FROM embeddings",
        "pairs": PAIRS.format(embeddings="embeddings"),
        "meter": METER.format(events="events"),
        "shards": SHARDS.format(supplier="supplier"),
        "members": MEMBERS.format(documents="documents"),
        "tasks": TASKS + " FROM embeddings, UNNEST([label, (label + 1) % 10]) AS x(t)",
        "traits": TRAITS.format(documents="documents", labels="labels"),
        "samples": SAMPLES + " FROM (SELECT d.*, p.url AS u FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)",
        "lexicon": "SELECT DISTINCT split_part(p_name,' ',1) AS word, 'JJ' AS tag FROM part"
        " UNION ALL SELECT DISTINCT split_part(p_name,' ',2), 'NN' FROM part",
    }
    needs = {"class_strings": ["taxa"]}
    order: list[str] = []
    for name in names:
        for n in [*needs.get(name, []), name]:
            if n not in order:
                order.append(n)
    return "WITH " + ", ".join(f"{n} AS ({views[n]})" for n in order)


def taxa(spark, sf):
    return spark.sql(TAXA, part=table(spark, sf, "part"))


def class_strings(spark, sf):
    return spark.sql(CLASS_STRINGS, taxa=taxa(spark, sf))


def features(spark, sf):
    return table(spark, sf, "embeddings").selectExpr("vec_id AS id", "embedding AS features", "label AS target")


def pairs(spark, sf):
    return spark.sql(PAIRS, embeddings=table(spark, sf, "embeddings"))


def meter(spark, sf):
    return spark.sql(METER, events=table(spark, sf, "events"))


def shards(spark, sf):
    return spark.sql(SHARDS, supplier=table(spark, sf, "supplier"))


def members(spark, sf):
    return spark.sql(MEMBERS, documents=table(spark, sf, "documents"))


def tasks(spark, sf):
    spread = table(spark, sf, "embeddings").selectExpr("*", "explode(array(label, (label + 1) % 10)) AS t")
    return spark.sql(TASKS + " FROM {spread}", spread=spread)


def traits(spark, sf):
    return spark.sql(TRAITS, documents=table(spark, sf, "documents"), labels=table(spark, sf, "labels"))


def samples(spark, sf):
    pages = table(spark, sf, "pages").selectExpr("page_id", "url AS u")
    docs = table(spark, sf, "documents")
    joined = docs.join(pages, docs["doc_id"] == pages["page_id"], "left")
    flat = spark.sql(SAMPLES + " FROM {joined}", joined=joined)
    return flat.withColumn(
        "parts",
        F.map_from_entries(
            F.filter(
                F.array(
                    F.struct(F.lit("txt").alias("k"), F.col("txt").alias("v")),
                    F.struct(F.lit("jpg").alias("k"), F.col("jpg").alias("v")),
                    F.struct(F.lit("png").alias("k"), F.col("png").alias("v")),
                    F.struct(F.concat("lang", F.lit(".meta")).alias("k"), F.col("lang").alias("v")),
                ),
                lambda e: e["v"].isNotNull(),
            )
        ),
    )


def lexicon(spark, sf):
    part = table(spark, sf, "part")
    first = part.selectExpr("split_part(p_name,' ',1) AS word", "'JJ' AS tag").distinct()
    return first.unionByName(part.selectExpr("split_part(p_name,' ',2) AS word", "'NN' AS tag").distinct())
