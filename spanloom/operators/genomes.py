"""Comparison of whole genomes: shortest unique substrings, evolutionary distances, unique matches and unique prefixes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import stats
from spanloom.operators import kmers as K
from spanloom.operators import ranks as R


def shustring_sums(genomes: DataFrame) -> DataFrame:
    """(a, b, sum, whole, n): over all n places of genome a, the sum of the lengths of the longest substring there that b holds, of any length.

    `whole` is what the sum would be if every place matched to its end. Genomes are few: their names and
    a row for each pair of a partition and a genome come to the driver; suffixes are ranked as a table.
    """
    names = [r[0] for r in genomes.select("genome").where("genome IS NOT NULL").distinct().orderBy("genome").collect()]
    kind = genomes.schema["genome"].dataType.simpleString()
    known = genomes.sparkSession.createDataFrame(list(enumerate(names)), f"g int, genome {kind}")
    numbered = genomes.join(F.broadcast(known), "genome").select("g", F.monotonically_increasing_id().alias("seqnum"), "seq")
    sums = R.matched_sums(numbered, len(names))
    side = lambda c: known.select(F.col("g").alias(c), F.col("genome").alias(f"{c}_"))
    return sums.join(F.broadcast(side("a")), "a").join(F.broadcast(side("b")), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"), "sum", "whole", "n")


def distances(genomes: DataFrame) -> DataFrame:
    """(a, b, shulen, divergence, kr): mean length of shortest unique substrings both ways, and the distances they stand for.

    The mean is one more than the mean longest match. Divergence is the one whose expected mean that
    is (the larger of both ways), kr the Jukes-Cantor distance of it; where every place matches to its end it is 0. Pairs
    of genomes are few; each is solved in an Arrow batch.
    """
    g = genomes.withColumn("gc", F.length("seq") - F.length(F.translate("seq", "GCgc", "")))
    shape = g.groupBy("genome").agg(F.sum(F.length("seq")).alias("length"), F.sum("gc").alias("gc"))
    s = shustring_sums(genomes).withColumn("shulen", F.col("sum") / F.col("n") + 1)
    j = s.join(shape.withColumnRenamed("genome", "b"), "b")
    kind = genomes.schema["genome"].dataType.simpleString()

    def run(batches):
        for b in batches:
            cols = (b[c] for c in ("shulen", "length", "gc", "sum", "whole"))
            d = [0.0 if same == whole else stats.divergence(x, g / (2 * n) if n else 0.25, int(n)) for x, n, g, same, whole in zip(*cols, strict=True)]
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "shulen": b["shulen"], "d": d})

    one = j.select("a", "b", "shulen", "length", "gc", "sum", "whole").mapInPandas(run, f"a {kind}, b {kind}, shulen double, d double")
    one = one.checkpoint()
    other = one.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("d").alias("back"))
    both = one.join(other, ["a", "b"]).withColumn("divergence", F.greatest("d", "back"))
    return both.select("a", "b", "shulen", "divergence", stats.jukes_cantor(F.col("divergence")).alias("kr"))


def unique_matches(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(a, b, a_start, b_start, length): maximal matches of k bases or more whose words occur once in all of a and once in all of b.

    Such a match holds no k-mer twice at one of its two places, but a k-mer may occur elsewhere:
    matches come from all shared k-mers, and each one's word is then counted among the places of its first k-mer.
    """
    from spanloom.functions import sequences as S
    from spanloom.operators.alignments import maximal_matches

    m = maximal_matches(K.seeds(a, b, k, 1 << 30), k)
    texts = lambda df, side: df.select(F.col("seqnum").alias(side), S.ascii_lower("seq").alias("t"))
    spelled = m.join(texts(a, "a"), "a").select("a", "b", "a_start", "b_start", F.col("weight").alias("length"), F.expr("substring(t, int(a_start) + 1, int(weight))").alias("word"))
    words = spelled.select("word").distinct().withColumn("kmer", F.substring("word", 1, k))

    def once(seqs: DataFrame) -> DataFrame:
        at = K.positions(seqs, k).join(words, "kmer").join(texts(seqs, "seqnum"), "seqnum")
        return at.where(F.expr("substring(t, pos + 1, length(word)) = word")).groupBy("word").agg(F.count("*").alias("n")).where("n = 1").select("word")

    return spelled.join(once(a), "word", "left_semi").join(once(b), "word", "left_semi").select("a", "b", "a_start", "b_start", "length")


def supermaximal_repeats(seqs: DataFrame, k: int) -> DataFrame:
    """(word, places): repeats of k bases or more that no longer repeat holds, and at how many places they occur.

    Every maximal match of two places is an interval at both. A word of which some place lies inside a
    longer interval is part of a longer repeat; one running maximum over the intervals of a sequence tells.
    """
    from pyspark.sql import Window

    from spanloom.functions import sequences as S
    from spanloom.operators.alignments import repeats

    m = repeats(seqs, k)
    at = m.select(F.col("a").alias("seqnum"), F.col("a_start").alias("start"), F.col("a_end").alias("end")).unionByName(m.select(F.col("b").alias("seqnum"), F.col("b_start").alias("start"), F.col("b_end").alias("end"))).distinct()
    w = Window.partitionBy("seqnum").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    held = at.withColumn("held", F.coalesce(F.max("end").over(w) >= F.col("end"), F.lit(False)))
    words = held.join(seqs.select("seqnum", S.ascii_lower("seq").alias("t")), "seqnum").select(F.expr("substring(t, int(start) + 1, int(end - start) + 1)").alias("word"), "held")
    return words.groupBy("word").agg(F.count("*").alias("places"), F.max("held").alias("held")).where("NOT held").select("word", "places")


def unique_prefixes(queries: DataFrame, target: DataFrame) -> DataFrame:
    """(seqnum, pos, length): at each place of the queries the shortest prefix, of any length, that occurs exactly once in the target."""
    return R.unique_prefixes(queries, target)


def genome_of(seqs: DataFrame, genome: Column) -> DataFrame:
    return seqs.select(genome.alias("genome"), "seq")
