"""Ontologies (OBO) and lists of cross-reference databases as tables; what is wrong with a file comes as problem rows, not as an error.

Such files have some thousand lines: each is one row that is cut into lines, so line numbers are those of the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys that an entry of a list of databases may have.
XRF_KEYS = ("abbreviation", "database", "object", "example_id", "generic_url", "url_syntax", "url_example", "synonym", "description", "entity_type", "is_obsolete", "replaced_by", "consider", "shorthand_name", "uri_prefix", "local_id_syntax")
#: Relationships that make one type a part of another.
PART = ("part_of", "member_of", "integral_part_of")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of a file."""
    whole = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n").alias("lines"))
    return whole.select(F.posexplode("lines").alias("line", "text")).select((F.col("line") + 1).alias("line"), F.rtrim("text").alias("text"))


def _pairs(lines: DataFrame) -> DataFrame:
    """(line, text, key, value): the part before the first colon, and what follows it without a trailing comment."""
    at = F.instr("text", ":")
    value = F.trim(F.regexp_replace(F.expr("substring(text, instr(text, ':') + 1)"), r"(^|\s)!.*$", ""))
    return lines.withColumn("key", F.when(at > 0, F.trim(F.expr("substring(text, 1, instr(text, ':') - 1)")))).withColumn("value", F.when(at > 0, value))


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms (id, name, obsolete), relations (id, kind, target), problems (line, problem)) of an OBO file.

    A file is a header, which must tell its format version, and stanzas; a term needs an id and a name. Comment lines start
    with an exclamation mark.
    """
    rows = _lines(spark, path).where("text <> '' AND NOT startswith(ltrim(text), '!')")
    stanza = rows.withColumn("head", F.regexp_extract("text", r"^\[(\w+)\]$", 1))
    w = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    # One file of some thousand lines: a window over all of it.
    placed = stanza.withColumn("stanza", F.count_if(F.col("head") != "").over(w)).withColumn("kind", F.last(F.when(F.col("head") != "", F.col("head")), ignorenulls=True).over(w))
    tags = _pairs(placed.where("head = ''"))
    lacks = F.when(F.col("key").isNull(), "expected character ':'").when(F.col("key") == "", "missing tag").when(F.col("value") == "", "missing value")
    problems = tags.select("line", lacks.alias("problem")).where("problem IS NOT NULL")
    heads = placed.where("head <> ''").select("stanza", "kind", "line")
    per = tags.groupBy("stanza").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(n) for k, n in (("id", "id"), ("name", "name"), ("is_obsolete", "gone"))])
    every = heads.join(per, "stanza", "left")
    for key in ("id", "name"):
        problems = problems.unionByName(every.where(f"kind = 'Term' AND coalesce({key}, '') = ''").select("line", F.lit(f"term lacks \"{key}\"").alias("problem")))
    header = tags.where("stanza = 0").agg(F.count("*").alias("n"), F.count_if((F.col("key") == "format-version") & (F.col("value") != "")).alias("v"))
    empty = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("line"), F.lit("unexpected end of file").alias("problem"))
    version = header.where("v = 0").crossJoin(rows.agg(F.count("*").alias("all"))).where("`all` > 0").select(F.lit(1).alias("line"), F.lit('header lacks "format-version"').alias("problem"))
    terms = every.where("kind = 'Term' AND id <> ''").select("id", "name", (F.coalesce("gone", F.lit("")) == "true").alias("obsolete"))
    own = every.where("kind = 'Term' AND id <> ''").select("stanza", "id")
    words = F.split("value", r"\s+")
    is_a = tags.where("key = 'is_a'").select("stanza", F.lit("is_a").alias("kind"), words[0].alias("target"))
    related = tags.where("key = 'relationship'").select("stanza", words[0].alias("kind"), F.try_element_at(words, F.lit(2)).alias("target"))
    relations = own.join(is_a.unionByName(related), "stanza").where("target IS NOT NULL").select("id", "kind", "target")
    return terms, relations, problems.unionByName(empty).unionByName(version)


def read_xrf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(databases (abbreviation, local_id_syntax), problems (line, problem)) of a list of databases; entries end at blank lines.

    An entry needs one abbreviation, which no other may have, also as its shorthand name; keys must be known ones.
    """
    rows = _lines(spark, path).where("NOT startswith(ltrim(text), '!')")
    w = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    tags = _pairs(rows.withColumn("entry", F.count_if(F.col("text") == "").over(w)).where("text <> ''"))
    known = F.col("key").isin(*XRF_KEYS)
    lacks = F.when(F.col("key").isNull(), "expected character ':'").when(~known, F.concat(F.lit("unknown label "), "key")).when(F.col("value") == "", "missing value")
    problems = tags.select("line", lacks.alias("problem")).where("problem IS NOT NULL")
    names = tags.where("key = 'abbreviation'")
    entries = tags.groupBy("entry").agg(F.min("line").alias("line"), F.count_if(F.col("key") == "abbreviation").alias("n"), F.max(F.when(F.col("key") == "local_id_syntax", F.col("value"))).alias("syntax"))
    problems = problems.unionByName(entries.where("n = 0").select("line", F.lit("required label \"abbreviation\" missing").alias("problem"))).unionByName(entries.where("n > 1").select("line", F.lit("duplicate label \"abbreviation\"").alias("problem")))
    again = Window.partitionBy("value").orderBy("line")
    twice = names.withColumn("k", F.row_number().over(again)).where("k > 1").select("line", F.concat(F.lit("duplicate abbreviation "), "value").alias("problem"))
    bases = names.select("entry", "value").unionByName(tags.where("key IN ('shorthand_name', 'synonym')").select("entry", "value")).join(entries.select("entry", "syntax"), "entry")
    return bases.groupBy(F.col("value").alias("abbreviation")).agg(F.max("syntax").alias("local_id_syntax")), problems.unionByName(twice)


def is_part(kind: Column) -> Column:
    return kind.isin(*PART)
