"""Operators on annotated intervals: selection, gaps, merging, islands, phases, uniqueness, statistics.

Feature tables have root_id, seqid, type, start, end (closed, 1-based), score, strand and ord, the
input's order. Children of one parent are ordered by (start, end, ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import ranges as R
from spanloom.session import with_checkpoints


def select(
    roots: DataFrame, seqid: str | None = None, source: str | None = None, contain: tuple[int, int] | None = None, overlap: tuple[int, int] | None = None,
    strand: str | None = None, has_cds: bool = False, max_gene_length: int | None = None, max_gene_num: int | None = None,
    min_gene_score: float | None = None, max_gene_score: float | None = None, feature_num: int | None = None, rules: list[Column] | None = None, logic: str = "AND",
) -> DataFrame:
    """Roots that pass all predicates; a whole tree stays or goes.

    Length, score and number limits hold for roots of type gene only. max_gene_num counts, in
    input order, the genes that pass the other gene limits, before the range and strand
    predicates. A rule that is true drops a root: with AND any rule does, with OR all must.
    """
    gene = F.col("type") == "gene"
    first = F.lit(True)
    if seqid is not None:
        first &= F.col("seqid") == seqid
    if source is not None:
        first &= F.col("source") == source
    limits = F.lit(True)
    if max_gene_length is not None:
        limits &= R.length("start", "end") <= max_gene_length
    if min_gene_score is not None:
        limits &= F.col("score") >= min_gene_score
    if max_gene_score is not None:
        limits &= F.col("score") <= max_gene_score
    out = roots.where(first & (~gene | limits))
    if max_gene_num is not None:
        # Only max_gene_num rows are wanted: a top-k by input order, no window over all genes.
        kept = out.where(gene).orderBy("ord").limit(max_gene_num)
        out = kept.unionByName(out.where(~gene))
    if feature_num is not None:
        out = out.orderBy("ord").offset(feature_num - 1).limit(1)
    late = F.lit(True)
    if contain is not None:
        late &= R.contains(F.lit(contain[0]), F.lit(contain[1]), "start", "end")
    if overlap is not None:
        late &= R.overlap(F.lit(overlap[0]), F.lit(overlap[1]), "start", "end")
    if strand is not None:
        late &= F.col("strand") == strand
    if has_cds:
        late &= F.col("n_cds") > 0
    if rules:
        drop = rules[0]
        for r in rules[1:]:
            drop = drop | r if logic == "AND" else drop & r
        late &= ~drop
    return out.where(late)


def clip_regions(regions: DataFrame, seqid: str | None, start: int, end: int) -> DataFrame:
    """Sequence regions cut to a range; disjoint ones and other sequences' go."""
    r = regions if seqid is None else regions.where(F.col("seqid") == seqid)
    r = r.where(R.overlap("start", "end", F.lit(start), F.lit(end)))
    return r.withColumn("start", F.greatest("start", F.lit(start))).withColumn("end", F.least("end", F.lit(end)))


def average_score_filter(roots: DataFrame, children: DataFrame, types: list[str], minimum: float, single_factor: float = 1.0) -> DataFrame:
    """Roots whose children of `types` have an average score of `minimum`; up to two such children: of the factor times that. Roots with none pass."""
    sums = children.where(F.col("type").isin(types)).groupBy("root_id").agg(F.avg("score").alias("__avg"), F.count("*").alias("__n"))
    ok = F.col("__n").isNull() | F.when(F.col("__n") <= 2, F.col("__avg") >= minimum * single_factor).otherwise(F.col("__avg") >= minimum)
    return roots.join(sums, "root_id", "left").where(ok).drop("__avg", "__n")


def target_best(roots: DataFrame) -> DataFrame:
    """Per (seqid, target) the root with the highest score, the first of several; roots without a target pass."""
    best = Window.partitionBy("seqid", "target").orderBy(F.desc_nulls_last("score"), "ord")
    ranked = roots.where("target IS NOT NULL").withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank")
    return ranked.unionByName(roots.where("target IS NULL"))


def _children() -> Column:
    """The children of a group as structs in sibling order."""
    return F.array_sort(F.collect_list(F.struct("start", "end", "ord", "strand")))


def inter_features(children: DataFrame, outside: str, inter: str) -> DataFrame:
    """Gaps between consecutive siblings of type `outside`, as features of type `inter`.

    A sibling that overlaps or touches the one before makes no gap and is passed over: the next
    one is compared with the sibling before it. Siblings of one parent are few, so a fold over
    the sorted siblings keeps the exact rule without a shuffle beyond the grouping.
    """
    groups = children.where(F.col("type") == outside).groupBy("root_id", "seqid").agg(_children().alias("c"))
    fold = """
        aggregate(slice(c, 2, size(c)),
          named_struct('last', c[0].end, 'gaps', cast(array() AS array<struct<start:bigint, end:bigint>>)),
          (s, x) -> IF(x.start > s.last + 1,
            named_struct('last', x.end, 'gaps', concat(s.gaps, array(named_struct('start', s.last + 1, 'end', x.start - 1)))), s),
          s -> s.gaps)"""
    gaps = groups.select("root_id", "seqid", F.col("c")[0]["strand"].alias("strand"), F.explode(F.expr(fold)).alias("g"))
    return gaps.select("root_id", "seqid", F.lit(inter).alias("type"), F.col("g.start").alias("start"), F.col("g.end").alias("end"), "strand")


def strand_conflicts(children: DataFrame, outside: str) -> DataFrame:
    """Parents whose `outside` children lie on more than one strand; inter_features has no meaning for them."""
    return children.where(F.col("type") == outside).groupBy("root_id").agg(F.count_distinct("strand").alias("n_strands")).where("n_strands > 1")


def merge_features(children: DataFrame) -> DataFrame:
    """Adjacent siblings of one type (each ends right before the next) as one feature without a score.

    A run of any length becomes one feature.
    """
    w = Window.partitionBy("root_id", "seqid", "type").orderBy("start", "end", "ord")
    new = F.when(R.consecutive(F.lag("end").over(w), F.col("start")), 0).otherwise(1)
    runs = children.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    merged = runs.groupBy("root_id", "seqid", "type", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("strand").alias("strand"), F.count("*").alias("parts"), F.max("score").alias("score"))
    return merged.select("root_id", "seqid", "type", "start", "end", "strand", F.when(F.col("parts") == 1, F.col("score")).alias("score"), "parts")


#: Positions of one sequence that one task sweeps.
ISLAND_BLOCK = 1 << 20


def islands(features: DataFrame, max_distance: int, keys: tuple[str, ...] = ("seqid",), slack: int = 0, block: int = ISLAND_BLOCK) -> DataFrame:
    """Clusters per `keys`: a feature joins while start <= largest end so far + max_distance + slack.

    Islands of regions, of spliced alignments and of genes differ in the distance only. The sweep
    runs twice: within blocks of positions (many tasks a sequence), where it leaves few disjoint
    islands, then over those islands; so no task sweeps all features of one sequence.
    """
    reach = max_distance + slack
    by = list(keys)

    def sweep(df: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy("start", "end")
        before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        runs = df.withColumn("__new", F.when(F.col("start") <= before + reach, 0).otherwise(1))
        runs = runs.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return runs.groupBy(*part, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("__run")

    # Equal ranges meet as one before any sort.
    few = features.groupBy(*by, "start", "end").agg(F.count("*").alias("n"))
    inner = sweep(few.withColumn("__block", F.floor(F.col("start") / block)), [*by, "__block"])
    return sweep(inner.drop("__block"), by).select(*by, "start", "end", F.col("n").alias("n_features"))


def covered_length(features: DataFrame, keys: tuple[str, ...] = ("seqid",)) -> DataFrame:
    """Positions per `keys` that at least one feature covers."""
    return islands(features, 0, keys, 1).groupBy(*keys).agg(F.sum(R.length("start", "end")).alias("covered"))


def cds_phases(children: DataFrame) -> DataFrame:
    """Phase of each CDS part: bases to skip to the next codon, from the lengths before it in reading direction."""
    order = F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start"))
    w = Window.partitionBy("root_id", "seqid").orderBy(order, "ord").rowsBetween(Window.unboundedPreceding, -1)
    cds = children.where("type = 'CDS'").withColumn("__before", F.coalesce(F.sum(R.length("start", "end")).over(w), F.lit(0)))
    return cds.withColumn("phase", F.pmod(3 - F.col("__before") % 3, F.lit(3)).cast("int")).drop("__before")


def check_phases(children: DataFrame) -> DataFrame:
    """CDS parts whose stated phase differs from the one their lengths give."""
    return cds_phases(children.withColumnRenamed("phase", "stated")).where(F.col("stated") != F.col("phase"))


def exon_classes(children: DataFrame) -> DataFrame:
    """single, initial, internal or terminal by place among the exons of a parent, mirrored on the reverse strand."""
    e = children.where("type = 'exon'")
    w = Window.partitionBy("root_id", "seqid")
    order = w.orderBy("start", "end", "ord")
    e = e.withColumn("__n", F.count("*").over(w)).withColumn("__k", F.row_number().over(order))
    place = F.when(F.col("strand") == "-", F.col("__n") + 1 - F.col("__k")).otherwise(F.col("__k"))
    name = F.when(F.col("__n") == 1, "single").when(place == 1, "initial").when(place == F.col("__n"), "terminal").otherwise("internal")
    return e.withColumn("exon_class", name).drop("__n", "__k")


def type_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("type").agg(F.count("*").alias("n"), F.sum(R.length("start", "end")).alias("total_length"))


def distribution(df: DataFrame, value: Column) -> DataFrame:
    """value, n, share and running share, in order of value.

    Different values are sorted over all machines and summed up partition by partition: there may be as many as rows.
    """
    from spanloom.operators.ranks import counted_before

    with_checkpoints(df.sparkSession)
    counts = df.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).checkpoint()
    total = counts.agg(F.sum("n").alias("total"))
    summed = counted_before(counts, None, ["value"], 0).crossJoin(F.broadcast(total))
    return summed.select("value", "n", (F.col("n") / F.col("total")).alias("prob"), ((F.col("before") + F.col("n")) / F.col("total")).alias("cumulative"))


def tree_signature(features: DataFrame, digest: bool = False) -> DataFrame:
    """(root_id, seqid, signature, score, ord): all nodes of a tree in depth-first order as one text, or its MD5.

    What compares trees only needs the digest: then no sort or join moves the texts.
    """
    node = F.concat_ws(":", "type", "start", "end", "strand")
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "ord", node.alias("node"))))
    text = F.array_join(F.transform(parts, lambda x: x["node"]), "|")
    return features.groupBy("root_id", "seqid").agg((F.unhex(F.md5(text.cast("binary"))) if digest else text).alias("signature"), F.max("score").alias("score"), F.min("ord").alias("ord"), F.min("start").alias("start"), F.max("end").alias("end"))


def unique_trees(trees: DataFrame) -> DataFrame:
    """Of consecutive equal trees, in order of (seqid, start, end, ord), one stays: of the higher score, else the first.

    Equal trees begin at the same place, so the order within (seqid, start, end) decides what is
    consecutive, and the window never spans a sequence. Trees are equal if all nodes are; a tree
    with an extra last node is different.
    """
    w = Window.partitionBy("seqid", "start", "end").orderBy("ord")
    runs = trees.withColumn("__new", F.when(F.col("signature") == F.lag("signature").over(w), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    best = Window.partitionBy("seqid", "start", "end", "__run").orderBy(F.desc_nulls_last("score"), "ord")
    return runs.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__new", "__run", "__rank")


def sort_key(seqid: str = "seqid") -> list[Column]:
    """Order of nodes: md5 names after others and by their hash part, then start, end and input order."""
    md5 = F.col(seqid).startswith("md5:")
    return [md5, F.when(md5, F.substring(seqid, 5, 32)).otherwise(F.col(seqid)), F.col("start"), F.col("end"), F.col("ord")]


def numeric_sort_key(seqid: str = "seqid") -> list[Column]:
    number = F.expr(f"try_cast({seqid} AS bigint)")
    return [number.isNull(), number, F.col("start"), F.col("end"), F.col("ord")]


def merge_sorted(*tables: DataFrame) -> DataFrame:
    """Ordered union of annotations; ties go by table, then input order."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("__table", F.lit(k))
        out = t if out is None else out.unionByName(t)
    return out.orderBy(*sort_key()[:-1], "__table", "ord").drop("__table")


def join_regions(*regions: DataFrame) -> DataFrame:
    """Regions of one name as their hull."""
    out = regions[0]
    for r in regions[1:]:
        out = out.unionByName(r)
    return out.groupBy("seqid").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def tidy_regions(regions: DataFrame, features: DataFrame) -> DataFrame:
    """Regions widened to hold all their features."""
    f = features.groupBy("seqid").agg(F.min("start").alias("__s"), F.max("end").alias("__e"))
    return regions.join(f, "seqid", "left").select("seqid", F.least("start", "__s").alias("start"), F.greatest("end", "__e").alias("end"))


def outside_regions(features: DataFrame, regions: DataFrame) -> DataFrame:
    """Features that their sequence region does not hold, or that have none."""
    r = regions.select("seqid", F.col("start").alias("__s"), F.col("end").alias("__e"))
    return features.join(r, "seqid", "left").where(F.col("__s").isNull() | ~R.contains("__s", "__e", "start", "end")).drop("__s", "__e")


def outside_parent(children: DataFrame, roots: DataFrame) -> DataFrame:
    """Children that their parent does not hold."""
    p = roots.select("root_id", F.col("start").alias("__s"), F.col("end").alias("__e"))
    return children.join(p, "root_id").where(~R.contains("__s", "__e", "start", "end")).drop("__s", "__e")


def rename_sequences(features: DataFrame, mapping: DataFrame) -> DataFrame:
    """seqid replaced by mapping (seqid, new_seqid); a feature without a mapping has a null name, to be refused by the caller."""
    return features.join(mapping, "seqid", "left").withColumn("seqid", F.col("new_seqid")).drop("new_seqid")


def unmapped_sequences(features: DataFrame, mapping: DataFrame) -> DataFrame:
    return features.select("seqid").distinct().join(mapping, "seqid", "left_anti")


def seqids_to_md5(features: DataFrame, sequences: DataFrame) -> DataFrame:
    """seqid becomes md5:<hash of the sequence>:<seqid>; sequences has (seqid, md5)."""
    return features.join(sequences.select("seqid", "md5"), "seqid").withColumn("seqid", F.concat_ws(":", F.lit("md5"), "md5", "seqid")).drop("md5")


def md5_to_seqids(features: DataFrame) -> DataFrame:
    """The inverse: md5:<32 hex>:<id> becomes <id>; other names stay."""
    return features.withColumn("seqid", F.when(F.col("seqid").rlike("^md5:[0-9a-f]{32}:"), F.substring("seqid", 38, 1 << 20)).otherwise(F.col("seqid")))


def duplicate_features(features: DataFrame, source_type: str, new_type: str) -> DataFrame:
    """All features, and each of `source_type` again under `new_type`."""
    return features.unionByName(features.where(F.col("type") == source_type).withColumn("type", F.lit(new_type)))


def set_source(features: DataFrame, source: str) -> DataFrame:
    return features.withColumn("source", F.lit(source))


def shift(features: DataFrame, offsets: DataFrame) -> DataFrame:
    """Ranges moved by offsets (seqid, offset); sequences without one stay."""
    o = F.coalesce("offset", F.lit(0))
    return features.join(offsets, "seqid", "left").withColumn("start", F.col("start") + o).withColumn("end", F.col("end") + o).drop("offset")


def add_ids(features: DataFrame, id_col: str = "id", rows: int = 100_000) -> DataFrame:
    """An id of type and place in the type's input order where there is none.

    Features are counted by blocks of `ord` first, so a window holds a block of one type, not the type. Blocks are so
    wide that `rows` features are in one on average: their number grows with the features, whatever the numbers in `ord`.
    """
    low, high, n = features.agg(F.min("ord"), F.max("ord"), F.count("*")).first()
    block = max(1, (high - low + 1) * rows // n) if low is not None else 1
    cut = features.withColumn("__block", F.expr(f"(ord - {low or 0}) div {block}"))
    before = Window.partitionBy("type").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    begin = cut.groupBy("type", "__block").agg(F.count("*").alias("__n")).select("type", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    nth = F.row_number().over(Window.partitionBy("type", "__block").orderBy("ord"))
    made = cut.withColumn("__nth", nth).join(begin, ["type", "__block"])
    return made.withColumn(id_col, F.coalesce(id_col, F.concat("type", (F.col("__begin") + F.col("__nth")).cast("string")))).drop("__block", "__n", "__begin", "__nth")


def select_target_strand(features: DataFrame, strand: str, target: str = "target") -> DataFrame:
    """Features whose only Target ('id start end strand') names another strand go; none, several or an unstated strand stays."""
    stated = F.get(F.split(F.trim(F.col(target)), " +"), F.lit(3))
    single = F.col(target).isNotNull() & ~F.col(target).contains(",")
    return features.where(~F.coalesce(single & stated.isin("+", "-") & (stated != strand), F.lit(False)))


def split_by(features: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and the dropped ones for a sink of their own; null counts as dropped."""
    good = F.coalesce(keep, F.lit(False))
    return features.where(good), features.where(~good)


def name_parts(features: DataFrame, id_col: str = "id") -> DataFrame:
    """part_no of features that share an id on one sequence: 1 for the representative, which has the smallest range; lone ones have null."""
    w = Window.partitionBy("seqid", id_col)
    several = F.col(id_col).isNotNull() & (F.count("*").over(w) > 1)
    return features.withColumn("part_no", F.when(several, F.row_number().over(w.orderBy("start", "end", "ord"))))


def check_rules(df: DataFrame, rules: dict[str, Column], by: Column | None = None) -> DataFrame:
    """Per rule: rows checked, failed, and the first failing ord. A rule is a condition that a good row meets; null counts as failure."""
    bad = [F.struct(F.lit(n).alias("rule"), (~F.coalesce(c, F.lit(False))).cast("int").alias("failed")) for n, c in rules.items()]
    rows = df.select("ord", F.explode(F.array(*bad)).alias("r"))
    return rows.groupBy("r.rule").agg(F.count("*").alias("checked"), F.sum("r.failed").alias("failed"), F.min(F.when(F.col("r.failed") == 1, F.col("ord"))).alias("first_ord"))


def dot_edges(children: DataFrame) -> DataFrame:
    """Edges of the feature graph as lines of a dot file."""
    return children.select(F.format_string('"%s" -> "%s_%s_%s";', F.col("root_id"), F.col("type"), F.col("start"), F.col("end")).alias("line"))


def sketch_lines(features: DataFrame, gap: int = 0) -> DataFrame:
    """Line of a drawing for each feature so that features of a line do not touch: interval colouring.

    Each overlapping island is drawn on its own, so the greedy fold holds one island's features
    at a time. The fold keeps one number for each line in use.
    """
    cuts = islands(features, gap).withColumnRenamed("start", "__s").withColumnRenamed("end", "__e").drop("n_features")
    placed = features.join(cuts, "seqid").where(R.contains("__s", "__e", "start", "end"))
    fold = f"""
        aggregate(array_sort(collect_list(struct(start, end, ord))),
          named_struct('ends', cast(array() AS array<bigint>), 'out', cast(array() AS array<struct<ord:bigint, line:int>>)),
          (s, x) -> named_struct(
            'ends', IF(exists(s.ends, e -> e + {gap} < x.start),
              transform(s.ends, (e, i) -> IF(i = array_position(transform(s.ends, y -> y + {gap} < x.start), true) - 1, x.end, e)), concat(s.ends, array(x.end))),
            'out', concat(s.out, array(named_struct('ord', x.ord, 'line', CAST(IF(exists(s.ends, e -> e + {gap} < x.start),
              array_position(transform(s.ends, y -> y + {gap} < x.start), true) - 1, size(s.ends)) AS int))))),
          s -> s.out)"""
    return placed.groupBy("seqid", "__s").agg(F.expr(fold).alias("o")).select("seqid", F.explode("o").alias("x")).select("seqid", "x.ord", "x.line")
