"""Type rules from an ontology: closures of is_a, parts and wholes, and features and cross references that break the rules.

Ontologies are small (some thousand terms); closures are joined as tables all the same, and features only by equal types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.sources.ontology import is_part


def ancestors(terms: DataFrame, relations: DataFrame) -> DataFrame:
    """(name, above): each type, and each it is directly or through others, itself included; by doubling, whatever circles there are.

    Obsolete terms are no types.
    """
    from spanloom.session import with_checkpoints

    with_checkpoints(terms.sparkSession)
    named = terms.where("NOT obsolete AND name IS NOT NULL").select("id", "name")
    step = relations.where("kind = 'is_a'").join(named, "id").select(F.col("name").alias("x"), "target").join(named.select(F.col("id").alias("target"), F.col("name").alias("y")), "target").select("x", "y")
    reach = named.select(F.col("name").alias("x"), F.col("name").alias("y")).unionByName(step).distinct().checkpoint()
    size = reach.count()
    while True:
        reach = reach.unionByName(reach.alias("p").join(reach.alias("q"), F.expr("p.y = q.x")).select("p.x", "q.y")).distinct().checkpoint()
        now = reach.count()
        if now == size:
            return reach.select(F.col("x").alias("name"), F.col("y").alias("above"))
        size = now


def allowed_parents(terms: DataFrame, relations: DataFrame) -> DataFrame:
    """(child, parent): types of which the first may be a part of the second.

    A type is a part of another if it, or anything it is, is stated to be part of the other or of anything that the other is.
    """
    up = ancestors(terms, relations).checkpoint()
    named = terms.select("id", "name")
    stated = relations.where(is_part(F.col("kind"))).join(named.withColumnRenamed("name", "part"), "id").join(named.select(F.col("id").alias("target"), F.col("name").alias("whole")), "target").select("part", "whole")
    child = up.select(F.col("name").alias("child"), F.col("above").alias("part")).join(stated, "part")
    return child.join(up.select(F.col("name").alias("parent"), F.col("above").alias("whole")), "whole").select("child", "parent").distinct()


def type_problems(features: DataFrame, terms: DataFrame, relations: DataFrame) -> DataFrame:
    """(line, problem) of features (line, type, id, parent_ids) whose type is none, or no part of the type of a parent."""
    types = terms.where("NOT obsolete").select(F.col("name").alias("type"))
    bad = features.join(F.broadcast(types), "type", "left_anti").select("line", F.concat(F.lit("type \""), "type", F.lit("\" is not a valid one")).alias("problem"))
    links = features.select("line", F.col("type").alias("child"), F.explode("parent_ids").alias("id"))
    parents = features.where("id IS NOT NULL").select("id", F.col("type").alias("parent")).distinct()
    pairs = links.join(parents, "id").join(F.broadcast(types.select(F.col("type").alias("child"))), "child", "left_semi").join(F.broadcast(types.select(F.col("type").alias("parent"))), "parent", "left_semi")
    wrong = pairs.join(allowed_parents(terms, relations), ["child", "parent"], "left_anti")
    return bad.unionByName(wrong.select("line", F.format_string('the child with type "%s" is not part-of parent with type "%s"', "child", "parent").alias("problem")))


def select_subtypes(features: DataFrame, terms: DataFrame, relations: DataFrame, kind: str) -> DataFrame:
    """Features whose type is `kind` or a kind of it."""
    below = ancestors(terms, relations).where(F.col("above") == kind).select(F.col("name").alias("type"))
    return features.join(F.broadcast(below), "type", "left_semi")


def reference_problems(features: DataFrame, databases: DataFrame) -> DataFrame:
    """(line, problem) of features (line, dbxrefs array of "database:id") that name an unknown database, or an id not of its form."""
    each = features.select("line", F.explode("dbxrefs").alias("x"))
    split = each.select("line", "x", F.substring_index("x", ":", 1).alias("abbreviation"), F.expr("substring(x, instr(x, ':') + 1)").alias("local"))
    j = split.join(databases.withColumn("known", F.lit(True)), "abbreviation", "left")
    fits = F.expr("regexp_like(local, concat('^(?:', local_id_syntax, ')$'))")
    problem = F.when(F.instr("x", ":") == 0, F.concat(F.lit("not a database and an id: "), "x")).when(F.col("known").isNull(), F.concat(F.lit("unknown database "), "abbreviation")).when(
        F.col("local_id_syntax").isNotNull() & ~fits, F.concat(F.lit("id "), "local", F.lit(" is not of the form that "), "abbreviation", F.lit(" has"))
    )
    return j.select("line", problem.alias("problem")).where("problem IS NOT NULL")
