"""Mixing sources to target weights, with DataFrame functions alone.

Words are summed per source, shares of the whole are set by weight under a cap on repetition, and every
document is taken floor(rate) times plus one more time with probability equal to the fraction of the rate.

The draws of a source are balanced over sizes: of each size class a number of documents is drawn, those whose hashes
come first. The numbers carry their remainders from class to class, from one hashed start a source, so every
document's probability stays the fraction, and few long documents no longer move a source far from its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm.common import word_count, written

SEED = "mix-1"
#: Parts in which equal rows are numbered.
TIE_PARTS = 1024


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code-point order, null last, weigh 1, 2, ... ``cycle``, repeating. A target never exceeds ``cap``
    times its source's size; what is cut is shared again by weight. That fixed point is found directly: in the
    order of cap to weight, source k is capped while its ratio lies below the level left for the rest.
    """
    by_source = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    ordered = by_source.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weighed = ordered.withColumn("weight", ((F.col("rank") - 1) % cycle + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), "rank")
    levels = (
        weighed.withColumn("total", F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("before", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("open", F.col("most") >= F.col("level") * F.col("weight"))
    )
    first_open = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return levels.withColumn("open_level", first_open).select(
        "source", "source_size", F.when(F.col("most") < F.col("open_level") * F.col("weight"), F.col("most")).otherwise(F.coalesce(F.col("open_level") * F.col("weight"), F.lit(0.0))).alias("target")
    )


def chance(*key: Column, digits: int = 13, start: int = 1) -> Column:
    """Hexadecimal digits from ``start`` on of an MD5 digest of the seed and the key, as a long."""
    text = F.concat_ws(":", F.lit(SEED), *(F.coalesce(k.cast("string"), F.lit("")) for k in key))
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Length and leading three bits of a size: sizes of a class differ by a quarter at most."""
    bits = F.length(F.bin(size))
    return bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 3, F.lit(0))).cast("int")


def _ends(upto: Column, n: Column, quota: Column, at: Column, name: str) -> list[Column]:
    """Of groups in order, each with n rows and upto with those before it: the last one that lies within the quota, the
    one in which the quota ends, and how many of its rows it takes. -1 where there is none."""
    cut = (upto - n < quota) & (upto > quota)
    last, part = F.max(F.when(upto <= quota, at)), F.max(F.when(cut, at))
    return [F.coalesce(last, F.lit(-1)).alias(f"last_{name}"), F.coalesce(part, F.lit(-1)).alias(f"part_{name}"), F.coalesce(F.max(F.when(cut, quota - (upto - n))), F.lit(0)).alias(f"need_{name}")]


def _cuts(sizes: DataFrame, counts: DataFrame, rates: DataFrame) -> DataFrame:
    """source, class, source_size, target, rate, last_cell, part_cell, last_mark, part_mark, part_need.

    Documents of a class with a cell up to last_cell get the extra copy; of those in part_cell the ones with a mark up
    to last_mark; and of the rows with part_mark, which are equal, part_need. counts has n, the rows of each source, class
    and cell. There are 2 ** 16 cells, so a group that is ordered has at most as many rows, whatever the rows of a
    source; marks are ordered within one cell of a class.
    """
    along = W.partitionBy("source", "class").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    cells = counts.withColumn("upto", F.sum("n").over(along))
    down = W.partitionBy("source").orderBy(F.desc("class")).rowsBetween(W.unboundedPreceding, 0)
    rated = cells.groupBy("source", "class").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down)).join(rates.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    part, u = F.col("rate") - F.floor("rate"), chance(F.col("source")) / F.lit(float(1 << 52))
    quota = F.floor(F.col("upto") * part + u) - F.floor((F.col("upto") - F.col("n")) * part + u)
    quotas = rated.select(F.col("source").alias("_source"), F.col("class").alias("_class"), "source_size", "target", "rate", quota.alias("quota"))
    own = F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class"))
    met = cells.join(quotas, own).groupBy("_source", "_class", "source_size", "target", "rate")
    by_cell = written(met.agg(*_ends(F.col("upto"), F.col("n"), F.col("quota"), F.col("cell"), "cell")), "op9-cells")
    open_cells = by_cell.filter("part_cell >= 0").select("_source", "_class", "part_cell", "need_cell")
    marks = sizes.join(open_cells, own & (F.col("cell") == F.col("part_cell"))).groupBy("_source", "_class", "need_cell", "mark").agg(F.count(F.lit(1)).alias("n"))
    marks = marks.withColumn("upto", F.sum("n").over(W.partitionBy("_source", "_class").orderBy("mark").rowsBetween(W.unboundedPreceding, 0)))
    by_mark = marks.groupBy(F.col("_source").alias("source"), F.col("_class").alias("class")).agg(*_ends(F.col("upto"), F.col("n"), F.col("need_cell"), F.col("mark"), "mark"))
    joined = by_cell.join(by_mark, own, "left").drop("source", "class")
    return joined.select(F.col("_source").alias("source"), F.col("_class").alias("class"), "source_size", "target", "rate", "last_cell", "part_cell", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("last_mark", "part_mark")], F.coalesce("need_mark", F.lit(0)).alias("part_need"))


def copies(docs: DataFrame, cap: float = 3.0) -> DataFrame:
    """The rows of docs with size, source_size, target and copies (how often the mix takes the document).

    Null texts and texts without words have size 0. A source without words has target 0 and is not taken; in a source
    with a rate of r, documents of size 0 are taken like any other. Who is drawn depends on id and text alone, however
    rows are partitioned; of rows that are equal in both, where a quota ends in them, as many are taken as it needs. A
    text of any length is one document, as its size alone matters. Extra columns stay, those with names of the result excepted. An empty table gives an empty result.
    """
    others = F.struct(*docs.drop("size", "source_size", "target", "copies").columns).alias("_row")
    own = docs.select(others, "doc_id", "text", "source").withColumn("size", word_count(F.col("text")))
    key = F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))
    own = own.withColumns({"class": size_class(F.col("size")), "cell": chance(*key, digits=4), "mark": chance(*key, start=5)})
    own = own.withColumn("_place", F.monotonically_increasing_id())
    # a narrow row a document is kept, so texts are read once for all counts
    sizes = written(own.select("source", "class", "cell", "mark", "size"), "op9-sizes")
    counts = written(sizes.groupBy("source", "class", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "op9-counts")
    targets = source_targets(counts, cap=cap)
    rates = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    cuts = written(_cuts(sizes, counts, rates), "op9-cuts").withColumnsRenamed({"source": "_source", "class": "_class"})
    # rows of one source may be a third of all, so the table of classes goes to the rows where it is small
    # (Spark decides by the size of its files), and otherwise an adaptive join splits the hot side
    joined = own.join(cuts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class")), "left").drop("_source", "_class")
    tied = F.coalesce((F.col("cell") == F.col("part_cell")) & (F.col("mark") == F.col("part_mark")), F.lit(False))
    in_cell = (F.col("cell") == F.col("part_cell")) & (F.col("mark") <= F.col("last_mark"))
    extra = F.when((F.col("cell") <= F.col("last_cell")) | in_cell, 1).otherwise(0)
    result = lambda rows, more: rows.select("_row.*", "size", "source_size", "target", (F.floor("rate") + more).cast("int").alias("copies"))
    if cuts.filter("part_need > 0").isEmpty():
        return result(joined, extra)
    return result(joined.filter(~tied), extra).unionByName(result(_taken(joined.filter(tied)), F.col("_extra")))


def _taken(tied: DataFrame) -> DataFrame:
    """Equal rows in which quotas end, with _extra, 1 for part_need rows of each source and class.

    Rows are numbered in parts, one after the other, so that no task numbers all; they are written first, as their parts must not change.
    """
    group = ["source", "class"]
    rows = written(tied.withColumn("_part", F.pmod(F.xxhash64("_place"), F.lit(TIE_PARTS)).cast("int")), "op9-tied")
    counts = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("source").alias("_source"), F.col("class").alias("_class"), F.col("_part").alias("_at"), before.alias("_before"))
    own = F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class")) & (F.col("_part") == F.col("_at"))
    nth = F.row_number().over(W.partitionBy(*group, "_part").orderBy("_place"))
    numbered = rows.withColumn("_nth", nth).join(starts, own)
    return numbered.withColumn("_extra", F.when(F.col("_before") + F.col("_nth") <= F.col("part_need"), 1).otherwise(0))


def mix(docs: DataFrame, cap: float = 3.0) -> DataFrame:
    """The documents of the mix with their own columns, whatever their names: each row as often as it is taken."""
    out = copies(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source"), cap).filter("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return copies(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


REPORT_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 4))::BIGINT AS cell,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 5, 13))::BIGINT AS mark
  FROM documents),
own AS (SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS class FROM sized),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM own GROUP BY source),
weighed AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most,
    (sum(source_size) OVER ())::DOUBLE AS total FROM by_source),
levels AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
opened AS (SELECT level FROM levels WHERE most >= level * weight ORDER BY most / weight, rank LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN most < (SELECT level FROM opened) * weight THEN most ELSE coalesce((SELECT level FROM opened) * weight, 0) END AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
classes AS (
  SELECT o.source, class, rate - floor(rate) AS part, sum(count(*)) OVER (PARTITION BY o.source ORDER BY class DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, count(*) AS n,
    ('0x' || substr(md5('mix-1:' || coalesce(o.source, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM own o JOIN rates r ON o.source IS NOT DISTINCT FROM r.source GROUP BY o.source, class, rate),
quotas AS (SELECT source, class, floor(upto * part + u) - floor((upto - n) * part + u) AS quota FROM classes),
drawn AS (SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY cell, mark) AS nth FROM own)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN nth <= quota THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source AND d.class = q.class
"""
