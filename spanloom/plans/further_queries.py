"""Queries over range arrays, further accuracies, closures, genomes and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import ranges as R
from spanloom.operators import alignments as L
from spanloom.operators import annotation as A
from spanloom.operators import genomes as G
from spanloom.operators import joins as J
from spanloom.operators import kmers as K
from spanloom.operators import predictions as P
from spanloom.operators import sequences as Q
from spanloom.plans.adapters import _ALPHABET, _BASES, DNA_SQL, FEATURES_SQL, PREDICTIONS_SQL, dna, dna_sizes, features, predictions, table
from spanloom.plans.sequence_queries import _kmers_sql, reads

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {FEATURES_SQL}, a AS (SELECT root_id, list({{'s': start, 'e': "end"}} ORDER BY ord, start, "end") AS x FROM features GROUP BY root_id)
SELECT root_id, len(x) AS n, CAST(list_sum([r.e - r.s + 1 FOR r IN x]) AS BIGINT) AS total, CAST(list_max([r.e FOR r IN x]) - list_min([r.s FOR r IN x]) + 1 AS BIGINT) AS spanned,
  x = list_sort(x) AS is_sorted, len(list_distinct(x)) AS kinds, len([i FOR i IN range(1, len(x)) IF x[i + 1].s <= x[i].e]) = 0 AS apart FROM a""")
def range_arrays(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "start", "end"))), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    a = features(spark, d).groupBy("root_id").agg(parts.alias("x"))
    return a.select("root_id", F.size("x").cast("long").alias("n"), R.total_range_length("x").alias("total"), R.spanned_range_length("x").alias("spanned"), R.ranges_are_sorted("x").alias("is_sorted"), F.size(R.unique_range_counts("x")).cast("long").alias("kinds"), R.ranges_do_not_overlap("x").alias("apart"))


@query(f"""WITH {FEATURES_SQL} SELECT root_id, seqid, type, start, "end", compared, by_length FROM (
  SELECT *, CAST(CASE WHEN abs(start - 1000) <= 200 AND abs("end" - 1020) <= 200 THEN 0 WHEN start <> 1000 THEN sign(start - 1000) ELSE sign("end" - 1020) END AS INTEGER) AS compared,
    CAST(sign(21 - ("end" - start + 1)) AS INTEGER) AS by_length FROM features)""")
def compared_ranges(spark: SparkSession, d: str) -> DataFrame:
    at = (F.lit(1000), F.lit(1020))
    return features(spark, d).select("root_id", "seqid", "type", "start", "end", R.compare_with_delta("start", "end", *at, 200).alias("compared"), R.compare_by_length("start", "end", *at).alias("by_length"))


@query(f"""WITH {FEATURES_SQL} SELECT root_id, start, "end" FROM features WHERE seqid = 'AF' AND start <= 1200 AND "end" >= 1100""")
def range_lookup(spark: SparkSession, d: str) -> DataFrame:
    return J.query_index(features(spark, d), "AF", 1100, 1200).select("root_id", "start", "end")


_SHAPES = """SELECT seqid, strand, shape, count(*) AS n FROM (SELECT root_id, seqid, strand, string_agg(start || '-' || "end", ',' ORDER BY start, "end") AS shape FROM {source} WHERE type = '{kind}' GROUP BY ALL) GROUP BY ALL"""
_ACCURACY = "CAST(t AS BIGINT) AS true_n, CAST(a AS BIGINT) AS actual_n, CAST(p AS BIGINT) AS predicted_n, CASE WHEN a = 0 THEN 1.0 ELSE t / CAST(a AS DOUBLE) END AS sensitivity, CASE WHEN p = 0 THEN 1.0 ELSE t / CAST(p AS DOUBLE) END AS specificity"


@query(f"""WITH {PREDICTIONS_SQL}, r AS ({_SHAPES.format(source="features", kind="exon")}), q AS ({_SHAPES.format(source="predictions", kind="exon")}),
s AS (SELECT coalesce(sum(least(coalesce(r.n, 0), coalesce(q.n, 0))), 0) AS t, coalesce(sum(r.n), 0) AS a, coalesce(sum(q.n), 0) AS p FROM r FULL JOIN q USING (seqid, strand, shape)) SELECT {_ACCURACY} FROM s""")
def transcript_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return J.transcript_accuracy(features(spark, d), predictions(spark, d))


@query(f"""WITH {PREDICTIONS_SQL}, r AS ({_SHAPES.format(source="features", kind="CDS")}), q AS ({_SHAPES.format(source="predictions", kind="CDS")}),
s AS (SELECT coalesce(sum(least(coalesce(r.n, 0), coalesce(q.n, 0))), 0) AS t, coalesce(sum(r.n), 0) AS a, coalesce(sum(q.n), 0) AS p FROM r FULL JOIN q USING (seqid, strand, shape)) SELECT {_ACCURACY} FROM s""")
def coding_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return J.transcript_accuracy(features(spark, d), predictions(spark, d), "CDS")


_P97 = "seqid || ':' || ((ord // 10000000) % 97)"


@query(f"""WITH {PREDICTIONS_SQL}, r AS (SELECT {_P97} AS seqid, strand, start, "end" FROM features), q AS (SELECT {_P97} AS seqid, strand, start, "end", row_number() OVER () AS i FROM predictions),
s AS (SELECT (SELECT count(DISTINCT i) FROM q JOIN r ON q.seqid = r.seqid AND q.strand = r.strand AND abs(q.start - r.start) <= 2 AND abs(q."end" - r."end") <= 2) AS t, (SELECT count(*) FROM r) AS a, (SELECT count(*) FROM q) AS p) SELECT {_ACCURACY} FROM s""")
def delta_accuracy(spark: SparkSession, d: str) -> DataFrame:
    apart = lambda df: df.withColumn("seqid", F.concat_ws(":", "seqid", (F.floor(F.col("ord") / 10000000) % 97).cast("string")))
    return J.delta_accuracy(apart(features(spark, d)), apart(predictions(spark, d)), 2)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
c AS (SELECT a, b, 1 AS depth FROM e UNION SELECT c.a, e.b, c.depth + 1 FROM c JOIN e ON c.b = e.a)
SELECT a AS ancestor, b AS descendant, min(depth) AS depth FROM c GROUP BY ALL""")
def descendants(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = o.select(name("o", "o_orderkey").alias("id"), F.array(name("c", "o_custkey")).alias("parent_ids"))
    return J.descendants(nodes.unionByName(li.select(name("p", "l_partkey").alias("id"), F.array(name("o", "l_orderkey")).alias("parent_ids"))))


@query(f"WITH {FEATURES_SQL} SELECT ord, type || row_number() OVER (PARTITION BY type ORDER BY ord) AS id FROM features")
def added_ids(spark: SparkSession, d: str) -> DataFrame:
    return A.add_ids(features(spark, d).withColumn("id", F.lit(None).cast("string"))).select("ord", "id")


@query(f"""WITH {FEATURES_SQL}, t AS (SELECT ord, CASE CAST(l_orderkey % 4 AS INTEGER) WHEN 0 THEN 'x 1 9 +' WHEN 1 THEN 'x 1 9 -' WHEN 2 THEN 'x 1 9' END AS target FROM features) SELECT ord, target FROM t WHERE target IS NULL OR target <> 'x 1 9 -'""")
def target_strands(spark: SparkSession, d: str) -> DataFrame:
    k = F.floor(F.col("ord") / 10000000) % 4
    t = features(spark, d).withColumn("target", F.when(k == 0, "x 1 9 +").when(k == 1, "x 1 9 -").when(k == 2, "x 1 9"))
    return A.select_target_strand(t, "+").select("ord", "target")


@query(f"""WITH {FEATURES_SQL}, c AS (SELECT *, coalesce(sum("end" - start + 1) OVER (PARTITION BY root_id, seqid ORDER BY CASE WHEN strand = '-' THEN -"end" ELSE start END, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM features WHERE type = 'CDS')
SELECT ord, CAST((3 - before % 3) % 3 AS INTEGER) AS phase, CAST(ord % 3 AS INTEGER) AS stated FROM c WHERE ord % 3 <> (3 - before % 3) % 3""")
def wrong_phases(spark: SparkSession, d: str) -> DataFrame:
    return A.check_phases(features(spark, d).withColumn("phase", (F.col("ord") % 3).cast("int"))).select("ord", "phase", "stated")


@query(f"""WITH {FEATURES_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY seqid, root_id || type) AS n, row_number() OVER (PARTITION BY seqid, root_id || type ORDER BY start, "end", ord) AS k FROM features) SELECT ord, CAST(CASE WHEN n > 1 THEN k ELSE 0 END AS INTEGER) AS part_no FROM w""")
def named_parts(spark: SparkSession, d: str) -> DataFrame:
    return A.name_parts(features(spark, d).withColumn("id", F.concat("root_id", "type"))).select("ord", F.coalesce("part_no", F.lit(0)).alias("part_no"))


@query(f"WITH {DNA_SQL}, r AS (SELECT unnest(regexp_extract_all(seq, 'a{{3,}}|c{{3,}}|g{{3,}}|t{{3,}}')) AS x FROM dna) SELECT x[1] AS base, CAST(length(x) AS INTEGER) AS length, count(*) AS n FROM r GROUP BY ALL")
def homopolymers(spark: SparkSession, d: str) -> DataFrame:
    return Q.homopolymers(dna(spark, d), 3)


def items(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("seqnum"), F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""), _ALPHABET, _BASES).alias("seq"))


_ITEMS = f"items AS (SELECT item_id AS seqnum, translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{_ALPHABET}', '{_BASES}') AS seq FROM benchmark)"
# Every place of every text against all suffixes in SQL would be quadratic, so SQL takes what sorting all suffixes gives: shared
# bases with the nearest suffix of each genome before and after, from the text itself.
_SUFFIXES = f"""{_ITEMS}, s AS MATERIALIZED (SELECT {{genome}} AS g, seqnum, pos, substring(seq, pos + 1) AS w FROM (SELECT seqnum, seq, unnest(range(0, length(seq))) AS pos FROM items)),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY w, seqnum, pos) AS o FROM s), gs AS (SELECT DISTINCT g AS b FROM s)"""


@query(f"""WITH {_SUFFIXES.format(genome="seqnum % 4")}, p AS (SELECT n.g AS a, gs.b, n.o, n.w, max(CASE WHEN n.g = gs.b THEN n.o END) OVER (PARTITION BY gs.b ORDER BY n.o) AS f, min(CASE WHEN n.g = gs.b THEN n.o END) OVER (PARTITION BY gs.b ORDER BY n.o DESC) AS r FROM n CROSS JOIN gs),
m AS (SELECT p.a, p.b, p.o, p.w, x.w AS y FROM p JOIN n x ON x.o = p.f WHERE p.a <> p.b UNION ALL SELECT p.a, p.b, p.o, p.w, x.w FROM p JOIN n x ON x.o = p.r WHERE p.a <> p.b),
k AS (SELECT a, b, o, max(CASE WHEN starts_with(w, y) THEN length(y) WHEN starts_with(y, w) THEN length(w) ELSE list_position(list_transform(range(1, least(length(w), length(y)) + 1), lambda i: w[i] <> y[i]), true) - 1 END) AS l FROM m GROUP BY a, b, o),
t AS (SELECT g AS a, count(*) AS n FROM s GROUP BY 1)
SELECT a, b, CAST(sum(l) AS BIGINT) AS sum, CAST(any_value(t.n) AS BIGINT) AS n FROM k JOIN t USING (a) GROUP BY a, b""")
def shustring_sums(spark: SparkSession, d: str) -> DataFrame:
    return G.shustring_sums(G.genome_of(items(spark, d), F.col("seqnum") % 4)).drop("whole")


@query()
def genome_distances(spark: SparkSession, d: str) -> DataFrame:
    return G.distances(G.genome_of(items(spark, d), F.col("seqnum") % 4))


@query(f"""WITH {_SUFFIXES.format(genome="seqnum % 2")}, w AS (SELECT *, count(CASE WHEN g = 1 THEN 1 END) OVER (ORDER BY o) AS i FROM n), t AS MATERIALIZED (SELECT i, w FROM w WHERE g = 1),
m AS (SELECT q.seqnum, q.pos, q.w, t.w AS y FROM w q JOIN t ON t.i BETWEEN q.i - 1 AND q.i + 2 WHERE q.g = 0),
k AS (SELECT seqnum, pos, CASE WHEN starts_with(w, y) THEN length(y) WHEN starts_with(y, w) THEN length(w) ELSE list_position(list_transform(range(1, least(length(w), length(y)) + 1), lambda i: w[i] <> y[i]), true) - 1 END AS l FROM m),
z AS (SELECT seqnum, pos, list_sort(list(l)) AS x FROM k GROUP BY 1, 2)
SELECT seqnum, CAST(pos AS INTEGER) AS pos, CAST(coalesce(x[-2], 0) + 1 AS INTEGER) AS length FROM z WHERE x[-1] > coalesce(x[-2], 0)""")
def unique_prefixes(spark: SparkSession, d: str) -> DataFrame:
    s = items(spark, d)
    return G.unique_prefixes(s.where("seqnum % 2 = 0"), s.where("seqnum % 2 = 1"))


@query()
def matching_statistics(spark: SparkSession, d: str) -> DataFrame:
    """For each benchmark text of an even number, the places and the sum and maximum of their longest matches in all texts of odd ones."""
    s = items(spark, d)
    m = K.longest_matches(s.where("seqnum % 2 = 0"), s.where("seqnum % 2 = 1"))
    return m.groupBy("seqnum").agg(F.count("*").alias("places"), F.sum("length").alias("sum"), F.max("length").alias("longest"))


@query(f"""WITH {_ITEMS}, a AS (SELECT * FROM ({_kmers_sql(12, 'items')}) WHERE seqnum % 2 = 0), b AS (SELECT * FROM ({_kmers_sql(12, 'items')}) WHERE seqnum % 2 = 1),
s AS (SELECT a.seqnum AS a, b.seqnum AS b, a.pos AS a_pos, a.pos - b.pos AS diag FROM a JOIN b USING (kmer)),
n AS (SELECT *, CASE WHEN a_pos - lag(a_pos) OVER (PARTITION BY a, b, diag ORDER BY a_pos) = 1 THEN 0 ELSE 1 END AS is_new FROM s), r AS (SELECT *, sum(is_new) OVER (PARTITION BY a, b, diag ORDER BY a_pos ROWS UNBOUNDED PRECEDING) AS run FROM n),
m AS (SELECT a, b, min(a_pos) AS a_start, min(a_pos) - diag AS b_start, max(a_pos) + 12 - min(a_pos) AS length FROM r GROUP BY a, b, diag, run),
w AS (SELECT m.*, substring(seq, a_start + 1, length) AS word FROM m JOIN items ON seqnum = a), d AS (SELECT DISTINCT word FROM w),
c AS (SELECT word, count(*) FILTER (x.seqnum % 2 = 0) AS na, count(*) FILTER (x.seqnum % 2 = 1) AS nb FROM d JOIN ({_kmers_sql(12, 'items')}) x ON x.kmer = substring(word, 1, 12) JOIN items i ON i.seqnum = x.seqnum WHERE substring(i.seq, x.pos + 1, length(word)) = word GROUP BY word)
SELECT a, b, a_start, b_start, length FROM w JOIN c USING (word) WHERE na = 1 AND nb = 1""")
def unique_matches(spark: SparkSession, d: str) -> DataFrame:
    s = items(spark, d)
    m = G.unique_matches(s.where("seqnum % 2 = 0"), s.where("seqnum % 2 = 1"), 12)
    return m.select("a", "b", *[F.col(c).cast("long").alias(c) for c in ("a_start", "b_start", "length")])


def transcripts(sizes: DataFrame) -> DataFrame:
    """(parent, seqnum, start, end, strand): an exon of 60 bases every 100 of each document's bases, the strand by parity."""
    e = sizes.where("size >= 60").select("seqnum", F.explode(F.expr("sequence(0, int((size - 60) / 100))")).alias("k"))
    return e.select(F.col("seqnum").alias("parent"), "seqnum", (F.col("k") * 100 + 1).cast("long").alias("start"), (F.col("k") * 100 + 60).cast("long").alias("end"), F.when(F.col("seqnum") % 2 == 0, "+").otherwise("-").alias("strand"))


@query(f"""WITH {DNA_SQL}, e AS (SELECT seqnum, substring(seq, k * 100 + 1, 60) AS s, k FROM dna, LATERAL (SELECT unnest(range(0, (length(seq) - 60) // 100 + 1)) AS k) WHERE length(seq) >= 60),
t AS (SELECT seqnum, string_agg(s, '' ORDER BY k) AS seq FROM e GROUP BY 1)
SELECT seqnum AS parent, md5(CASE WHEN seqnum % 2 = 0 THEN seq ELSE reverse(translate(seq, 'acgt', 'tgca')) END) AS md5 FROM t""")
def spliced_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return Q.spliced(transcripts(dna_sizes(spark, d)), dna(spark, d)).select("parent", F.md5("seq").alias("md5"))


@query()
def coding_parts(spark: SparkSession, d: str) -> DataFrame:
    e = transcripts(dna_sizes(spark, d))
    return P.cds_parts(e.drop("seqnum"), Q.spliced(e, dna(spark, d)).select("parent", "seq"), 30)


@query()
def seed_extensions(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d)
    return P.seed_extensions(r.where("seqnum % 2 = 0"), r.where("seqnum % 2 = 1"), 20, 8, 30, 80.0)


@query()
def terminal_repeats(spark: SparkSession, d: str) -> DataFrame:
    return P.repeated_ends(dna(spark, d), seed=20, min_arm=25, max_arm=500, min_distance=100, max_distance=5000)


@query()
def inverted_repeats(spark: SparkSession, d: str) -> DataFrame:
    return P.repeated_ends(dna(spark, d), seed=10, min_arm=12, max_arm=500, min_distance=50, max_distance=5000, inverted=True)


@query()
def consensus_alignments(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d).where("type = 'exon'").withColumn("seqid", F.concat_ws(":", "seqid", (F.floor(F.col("ord") / 10000000) % 997).cast("string")))
    apart = A.islands(f, 0, ("root_id", "seqid", "strand"))
    return P.consensus_alignments(apart.select("root_id", "seqid", "strand", "start", "end"))


@query()
def assembled_contigs(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d)
    return P.contigs(r, K.single_matches(r, 30, parallel=True)).select("contig", "n_reads", F.md5("seq").alias("md5"))


@query()
def masked_sequences(spark: SparkSession, d: str) -> DataFrame:
    m = Q.dust_mask(items(spark, d), 32, 2.0)
    return m.select("seqnum", F.length(F.regexp_replace("seq", "[A-Z]", "")).alias("masked"), F.md5("seq").alias("md5"))


@query()
def corrected_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads whose homopolymers lost or gained a base, corrected against the bases they come from."""
    s = dna(spark, d)
    r = reads(spark, d).select("seqnum", F.floor(F.col("seqnum") / 100_000_000).alias("ref"), (F.col("seqnum") % 100_000_000 * 60).alias("ref_start"), F.regexp_replace("seq", "(a{3,})", "$1a").alias("seq"))
    r = r.withColumn("qual", F.expr("repeat('+', length(seq))"))
    return Q.correct_homopolymers(r, s).groupBy("edits").agg(F.count("*").alias("n"))


@query()
def tags_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text of 36 bases or more, whole, mapped onto all documents with up to two edits."""
    t = items(spark, d).where("length(seq) >= 36").select(F.col("seqnum").alias("tag"), "seq")
    return L.best_maps(L.map_tags_with_gaps(t, dna(spark, d), 2, 12))


@query()
def supermaximal_repeats(spark: SparkSession, d: str) -> DataFrame:
    return G.supermaximal_repeats(items(spark, d), 12).select(F.md5("word").alias("md5"), F.length("word").alias("length"), "places")
