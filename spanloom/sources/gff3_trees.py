"""GFF3 as trees: features of any number of files read, checked, put in order, given ids and written with terminators, as one chain.

A tree is all features that parents, or parts of one id, tie together between two ### lines. Trees go by place, and the
features of one depth first, children by place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.alignments import single_linkage
from spanloom.session import with_checkpoints
from spanloom.sources.annotation import cyclic_features, gff3_lines, read_gff3, structure_problems

_KEY = ["file", "ord"]


def with_trees(features: DataFrame) -> DataFrame:
    """Features with `tree`, the (file, ord) of the first feature of their tree, and `path`, the places from its root down.

    One join for each level; of several parents the one that comes first leads. Features on cycles have no path and are left out.
    """
    with_checkpoints(features.sparkSession)
    f = features.withColumn("node", F.struct(*_KEY)).checkpoint()
    own = f.where("feature_id IS NOT NULL").select("file", "block", F.col("feature_id").alias("id"), F.col("node").alias("up"))
    links = f.select("file", "block", "node", F.explode("parent_ids").alias("id")).join(own, ["file", "block", "id"]).select("node", "up").checkpoint()
    parts = own.groupBy("file", "block", "id").agg(F.min("up").alias("first"))
    same = own.join(parts, ["file", "block", "id"]).where("up <> first").select(F.col("up").alias("a"), F.col("first").alias("b"))
    tied = single_linkage(links.select(F.col("node").alias("a"), F.col("up").alias("b")).unionByName(same)).select("node", F.col("cluster").alias("tree"))
    place = F.struct("start", (-F.col("end")).alias("size"), "ord")
    level = f.join(links.select("node").distinct(), "node", "left_anti").select("node", F.array(place).alias("path")).checkpoint()
    found = level
    while not level.isEmpty():
        below = links.join(level.select(F.col("node").alias("up"), "path"), "up").groupBy("node").agg(F.min("path").alias("path"))
        below = below.join(f.select("node", place.alias("place")), "node").select("node", F.concat("path", F.array("place")).alias("path"))
        # A feature below two levels of one tree has been placed already.
        level = below.join(found.select("node"), "node", "left_anti").checkpoint()
        found = found.unionByName(level).checkpoint()
    return f.join(found, "node").join(tied, "node", "left").withColumn("tree", F.coalesce("tree", "node")).drop("node")


def renumbered(trees: DataFrame) -> DataFrame:
    """Features in order with new ids, the type and a running number, for those that have children or several parts; others lose theirs.

    Numbers of one type run over all trees, so a window sees all features with an id of that type.
    """
    order = ["seqid", "tree_start", "tree", "path"]
    t = _ordered(trees)
    parents = t.select("file", "block", F.explode("parent_ids").alias("feature_id")).distinct().withColumn("has", F.lit(True))
    parts = t.where("feature_id IS NOT NULL").groupBy("file", "block", "feature_id").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"), F.min_by("type", F.struct(*order)).alias("kind"))
    named = parts.join(parents, ["file", "block", "feature_id"], "left").where("has OR n > 1")
    number = F.row_number().over(Window.partitionBy("kind").orderBy("first"))
    ids = named.select("file", "block", F.col("feature_id").alias("old"), F.concat("kind", number.cast("string")).alias("new")).checkpoint()
    up = t.select(*_KEY, "block", F.posexplode("parent_ids").alias("k", "old")).join(ids, ["file", "block", "old"]).groupBy(*_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "new"))), lambda x: x["new"]).alias("ups"))
    own = t.join(ids.withColumnRenamed("old", "feature_id"), ["file", "block", "feature_id"], "left").join(up, _KEY, "left")
    rest = F.map_filter("attributes", lambda k, _: ~k.isin("ID", "Parent"))
    first = F.map_filter(F.create_map(F.lit("ID"), F.col("new"), F.lit("Parent"), F.array_join("ups", ",")), lambda _, v: v.isNotNull())
    return own.withColumn("attributes", F.map_concat(first, rest)).withColumn("feature_id", F.col("new")).withColumn("parent_ids", F.coalesce("ups", F.array().cast("array<string>"))).drop("new", "ups")


def _ordered(trees: DataFrame) -> DataFrame:
    starts = trees.groupBy("tree").agg(F.min("start").alias("tree_start"), F.count("*").alias("tree_size"))
    return trees if "tree_start" in trees.columns else trees.join(starts, "tree")


def tree_lines(trees: DataFrame, regions: DataFrame) -> DataFrame:
    """(k, seqid, at, tree, path, last, line): the header, regions, features, and ### behind each tree of several features.

    Sorted by all but the line they are a file.
    """
    spark = trees.sparkSession
    t = _ordered(trees)
    kind = t.schema["tree"].dataType.simpleString()
    path = t.schema["path"].dataType.simpleString()
    none = [F.lit(None).cast(kind).alias("tree"), F.lit(None).cast(path).alias("path"), F.lit(0).alias("last")]
    head = spark.range(1).select(F.lit(0).alias("k"), F.lit("").alias("seqid"), F.lit(0).cast("long").alias("at"), *none, F.lit("##gff-version 3").alias("line"))
    hulls = regions.groupBy("seqid").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    r = hulls.select(F.lit(1).alias("k"), "seqid", F.col("start").alias("at"), *none, F.format_string("##sequence-region   %s %s %s", "seqid", "start", "end").alias("line"))
    body = gff3_lines(t, keep=("seqid", "tree_start", "tree", "path")).select(F.lit(2).alias("k"), "seqid", F.col("tree_start").alias("at"), "tree", "path", F.lit(0).alias("last"), "line")
    ends = t.where("tree_size > 1").groupBy("tree").agg(F.min("seqid").alias("seqid"), F.min("tree_start").alias("at"))
    stops = ends.select(F.lit(2).alias("k"), "seqid", "at", "tree", F.lit(None).cast(path).alias("path"), F.lit(1).alias("last"), F.lit("###").alias("line"))
    return head.unionByName(r).unionByName(body).unionByName(stops)


def chain(spark: SparkSession, *paths: str, tidy: bool = False, retain_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines of one valid file of all trees, in order; problems (file, ord, reason)) of GFF3 files.

    Features with a problem, of their own or of how they fit together, are told and left out with their trees' other
    features kept, so long as these have their parents.
    """
    g = read_gff3(spark, *paths, tidy=tidy)
    f = g["features"]
    told = g["problems"].select("file", "ord", "reason")
    told = told.unionByName(structure_problems(f, g["regions"])).unionByName(cyclic_features(f).withColumn("reason", F.lit("parents form a cycle"))).distinct()
    with_checkpoints(spark)
    told = told.checkpoint()
    good = f.join(told.select(*_KEY).distinct(), _KEY, "left_anti")
    while True:  # what has lost a parent goes as well, level by level
        good = good.checkpoint()
        named = good.select(*_KEY, "block", F.explode("parent_ids").alias("feature_id"))
        lost = named.join(good.select("file", "block", "feature_id").distinct(), ["file", "block", "feature_id"], "left_anti").select(*_KEY).distinct()
        if lost.isEmpty():
            break
        good = good.join(lost, _KEY, "left_anti")
    trees = with_trees(good)
    return tree_lines(trees if retain_ids else renumbered(trees), g["regions"]), told


def write_trees(lines: DataFrame, path: str) -> None:
    """One file of the lines of `chain`; a file is one task by nature."""
    lines.orderBy("k", "seqid", "at", "tree", "last", "path").select("line").coalesce(1).write.mode("error").text(path)
