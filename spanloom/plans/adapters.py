"""Feature and sequence tables built from the generic test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import with_checkpoints


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One child feature a lineitem row; parts of one order on one sequence share a root."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), "l_returnflag", "l_linestatus").alias("root_id"),
        F.concat("l_returnflag", "l_linestatus").alias("seqid"),
        F.when(F.col("l_linenumber") % 3 == 0, "CDS").otherwise("exon").alias("type"),
        (F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")) + 1).cast("long").alias("start"),
        (F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")) + F.col("l_quantity").cast("int")).cast("long").alias("end"),
        F.col("l_extendedprice").alias("score"),
        F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("ord"),
    )


FEATURES_SQL = """
features AS (
  SELECT l_orderkey || ':' || l_returnflag || ':' || l_linestatus AS root_id, l_returnflag || l_linestatus AS seqid,
    CASE WHEN l_linenumber % 3 = 0 THEN 'CDS' ELSE 'exon' END AS type,
    CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + 1 AS BIGINT) AS start,
    CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INTEGER) AS BIGINT) AS "end",
    l_extendedprice AS score, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
    (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord, l_orderkey
  FROM lineitem
)"""


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots: the hull of the children; score and source from the order."""
    f = features(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("okey"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("source"), "o_custkey")
    roots = f.groupBy("root_id", "seqid", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("ord").alias("ord"), F.count_if(F.col("type") == "CDS").alias("n_cds"), F.count_if(F.col("type") == "exon").alias("n_exons"))
    roots = roots.withColumn("okey", F.substring_index("root_id", ":", 1))
    return roots.join(o, "okey").select("root_id", "seqid", "source", F.lit("gene").alias("type"), "start", "end", "score", "strand", "ord", "n_cds", "n_exons", F.concat(F.lit("t"), (F.col("o_custkey") % 500).cast("string")).alias("target"))


GENES_SQL = (
    FEATURES_SQL
    + """,
genes AS (
  SELECT f.root_id, f.seqid, any_value(o_orderpriority) AS source, 'gene' AS type, min(f.start) AS start, max(f."end") AS "end",
    any_value(o_totalprice) AS score, f.strand, min(f.ord) AS ord, count(*) FILTER (f.type = 'CDS') AS n_cds,
    count(*) FILTER (f.type = 'exon') AS n_exons, 't' || any_value(o_custkey % 500) AS target
  FROM features f JOIN orders ON l_orderkey = o_orderkey GROUP BY f.root_id, f.seqid, f.strand
)"""
)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy("seqid").agg(F.min("start").alias("start"), F.max("end").alias("end"))


REGIONS_SQL = FEATURES_SQL + ', regions AS (SELECT seqid, min(start) AS start, max("end") AS "end" FROM features GROUP BY seqid)'


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second annotation: every seventh order's parts moved by one, every eleventh order missing."""
    f = features(spark, sf_dir).withColumn("okey", F.floor(F.col("ord") / 10000000))
    moved = F.when(F.col("okey") % 7 == 0, 1).otherwise(0)
    return f.where(F.col("okey") % 11 != 0).withColumn("start", F.col("start") + moved).withColumn("end", F.col("end") + moved).drop("okey")


PREDICTIONS_SQL = (
    FEATURES_SQL
    + """,
predictions AS (
  SELECT root_id, seqid, type, start + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS start,
    "end" + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS "end", score, strand, ord
  FROM features WHERE l_orderkey % 11 <> 0
)"""
)

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASES = ("acgt" * 7)[:26] * 2


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seqnum, seq): the letters of every document as bases."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seqnum"), F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""), _ALPHABET, _BASES).alias("seq"))


def dna_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seqnum, size): how many bases every document has, written once: what is laid out along documents need not read their texts each time."""
    with_checkpoints(spark)
    return dna(spark, sf_dir).select("seqnum", F.length("seq").alias("size")).checkpoint()


DNA_SQL = f"dna AS (SELECT doc_id AS seqnum, translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{_ALPHABET}', '{_BASES}') AS seq FROM documents)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seqnum, description, seq): documents as sequences of letters."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seqnum"), F.concat_ws(" ", F.concat(F.lit("seq"), F.col("doc_id").cast("string")), "source").alias("description"), F.coalesce("text", F.lit("")).alias("seq"))


TEXTS_SQL = "texts AS (SELECT doc_id AS seqnum, 'seq' || doc_id || ' ' || source AS description, coalesce(text, '') AS seq FROM documents)"

