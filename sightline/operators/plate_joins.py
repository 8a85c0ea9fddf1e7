"""Joins of plate texts that are alike or hold one another, by equal pieces instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.plates import clean_plate, confusion_class, plate_similarity
from sightline.storage import written

#: Texts that are longer than this, or too short for the edits that are allowed, meet by their lengths.
LONGEST = 24
#: The similarity is rounded to 4 decimals.
ROUNDING = 1e-4


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows from which much is made, dealt evenly to all tasks, whatever their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_similarity_of(texts: DataFrame) -> DataFrame:
    """_r, _p with plate_sim, computed once for each row."""
    # not by the keys by which texts were made distinct, as Spark would then leave them in few tasks
    return dealt(texts, "_p", "_r").withColumn("plate_sim", plate_similarity(F.col("_r"), F.col("_p")))


def _edits(n: Column, least: float) -> Column:
    """Most edits between classes of a text of n characters and one that is alike: a similarity of ``least`` allows
    (1 - least) of the longer length, which is at most n / least."""
    return F.floor((1 - least + ROUNDING) * F.floor(n / (least - ROUNDING)) + 1e-9).cast("int")


def near_plates(reported: DataFrame, plates: DataFrame, least: float) -> DataFrame:
    """_r, _p, plate_sim: all pairs of distinct texts whose similarity is ``least`` or more. Null texts are left out.

    Confused characters become one class, so similarity asks for few edits. A text with d edits to another is cut into d + 1
    segments, of which one stays whole (the pigeonhole principle), moved by d places at most. Pairs that share such
    a segment are verified by their similarity, so none is missed. Texts that d edits could change altogether, and
    those over ``LONGEST`` characters, meet the texts whose lengths fit.
    """
    if not 0 < least <= 1:
        raise ValueError("every pair has a similarity of 0 or more: join all pairs")
    low = least - ROUNDING
    known = lambda df, c: df.filter(F.col(c).isNotNull()).select(c).distinct().withColumn("_c", confusion_class(clean_plate(F.col(c)))).withColumn("_n", F.length("_c"))
    x = known(reported, "_r").withColumn("_d", _edits(F.col("_n"), low))
    cut = lambda n, d: (n <= LONGEST) & (d + 1 <= n)
    start = lambda i, n, d: F.floor(i * n / (d + 1)).cast("int")
    key = lambda n, i, text: F.struct(n.alias("n"), i.alias("i"), text.alias("text"))
    whole = lambda n: key(n, F.lit(-1), F.lit(""))
    n, d = F.col("_n"), F.col("_d")
    segments = F.transform(F.sequence(F.lit(0), d), lambda i: key(n, i, F.substring(F.col("_c"), start(i, n, d) + 1, start(i + 1, n, d) - start(i, n, d))))
    index = x.select("_r", F.explode(F.when(cut(n, d), segments).otherwise(F.array(whole(n)))).alias("_key"))
    # a text has many pieces, so texts go to all tasks, whatever their bytes
    y = dealt(known(plates, "_p"), "_p", "_n").withColumnsRenamed({"_n": "_m"})
    # lengths that a text alike to this one may have; blank texts are alike to blank ones alone
    y = y.withColumn("_n", F.explode(F.sequence(F.ceil(F.col("_m") * low).cast("int"), F.floor(F.col("_m") / low).cast("int")))).withColumn("_d", _edits(F.col("_n"), low))

    def pieces(i: Column) -> Column:
        """What may stand for segment i of a text of n characters: as long, and moved by d at most."""
        at, size = start(i, n, d), start(i + 1, n, d) - start(i, n, d)
        lo, hi = F.greatest(F.lit(0), at - d), F.least(F.col("_m") - size, at + d)
        return F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda p: key(n, i, F.substring(F.col("_c"), p + 1, size)))).otherwise(F.array().cast("array<struct<n:int,i:int,text:string>>"))

    moved = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), d), pieces)))
    probes = y.select("_p", F.explode(F.when(cut(n, d), moved).otherwise(F.array(whole(n)))).alias("_key"))
    split = lambda df: df.select("*", "_key.*").drop("_key")
    pairs = split(index).join(split(probes), ["n", "i", "text"]).select("_r", "_p").distinct()
    # written before the filter, which Spark would otherwise push to the pairs of segments, where a pair of texts comes many times
    return written(with_similarity_of(pairs), "alike-plates").filter(F.col("plate_sim") >= least)


def six_of(plate: Column) -> Column:
    """The first six letters and digits of a reported plate."""
    return F.substring(F.regexp_replace(F.upper(plate), "[^A-Z0-9]", ""), 1, 6)


def holding_plates(reported: DataFrame, plates: DataFrame) -> DataFrame:
    """_r, _p: pairs of distinct texts where _p holds the first six letters and digits of _r; null texts are left out.

    Every plate is indexed by its n-grams of the lengths that are asked for (six, and less where reported plates are shorter), and
    the six characters are looked up by equality. A reported plate without any letter or digit is held by every plate.
    """
    asked = reported.filter("_r is not null").select("_r").distinct().withColumn("_gram", six_of(F.col("_r")))
    sizes = sorted(r[0] for r in asked.select(F.length("_gram")).distinct().collect())
    p = plates.filter("_p is not null").select("_p").distinct()

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("_p") - n + 1)
        return F.when(F.length("_p") >= n, F.transform(starts, lambda i: F.substring(F.col("_p"), i, F.lit(n)))) if n else F.array(F.lit(""))

    grams = [of_size(n) for n in sizes]
    if not grams:
        return asked.join(p.withColumnRenamed("_p", "_gram").withColumn("_p", F.col("_gram")), "_gram").select("_r", "_p")
    empty = F.array().cast("array<string>")
    indexed = p.select("_p", F.explode(F.array_distinct(F.concat(*[F.coalesce(g, empty) for g in grams]))).alias("_gram"))
    return indexed.join(asked, "_gram").select("_r", "_p")
