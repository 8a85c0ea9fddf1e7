"""Document fingerprints by one-permutation MinHash, with DataFrame functions alone.

Each five-word shingle is hashed once. The high bits of the hash choose one of 256 bins and a bin keeps its least
hash. An empty bin takes the value of a bin that its own random order of the bins puts first among those that are
filled (optimal densification). Of every bin the low 4 bits are stored; agreement by chance is taken off when two
fingerprints are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm.common import WORD, written

BIN_BITS, LOW_BITS, SHINGLE = 8, 4, 5
BINS = 1 << BIN_BITS
#: Draws for an empty bin before all filled bins are put in order.
DRAWS = 12
#: Bins whose low bits share a long.
PER_LONG = 64 // LOW_BITS
NIBBLES = int("1" * 16, 16)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 63 - BIN_BITS).cast("int")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the word shingles of a text in ascending order, 63 bits each, so that none is negative and bins ascend too;
    fewer words than ``size`` make one shingle; no word, none."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)

    def hashed(own: Column) -> Column:
        """Each word is hashed once, and a shingle is the hash of its words' hashes."""
        n = F.size(own)
        full = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(size)]))
        return F.when(n >= size, full).when(n > 0, F.array(F.xxhash64(own))).otherwise(F.array().cast("array<bigint>"))

    # let hashes be evaluated once a row: a lambda's argument is a value
    found = F.flatten(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), hashed))
    return F.sort_array(F.transform(found, lambda h: F.shiftrightunsigned(h, 1)))


def packed(text: Column) -> Column:
    """The fingerprint as an array of longs, 16 bins in each; an empty array for a text without words."""

    def minima(hashes: Column) -> Column:
        return F.filter(hashes, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(hashes, i - 1))))

    def filled(least: Column) -> Column:
        gap = lambda x, i: _bin(x) - F.coalesce(_bin(F.get(least, i - 1)), F.lit(-1)) - 1
        none = F.lit(None).cast("long")
        sparse = F.concat(F.flatten(F.transform(least, lambda x, i: F.concat(F.array_repeat(none, gap(x, i)), F.array(x)))), F.array_repeat(none, BINS - 1 - _bin(F.get(least, F.size(least) - 1))))

        def borrowed(sparse: Column, b: Column) -> Column:
            """The first filled bin in an order of b's own: some draws, then the rest by hash."""
            drawn = [F.get(sparse, F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(DRAWS)]
            rest = F.array_min(F.transform(least, lambda x: F.struct(F.xxhash64(b, _bin(x)).alias("o"), x.alias("x"))))["x"]
            return F.coalesce(*drawn, rest)

        values = F.flatten(F.transform(F.array(sparse), lambda s: F.transform(s, lambda v, b: F.coalesce(v, borrowed(s, b)).bitwiseAND(F.lit((1 << LOW_BITS) - 1)))))
        return F.transform(F.array(values), lambda v: F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda g: F.aggregate(F.slice(v, g * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, LOW_BITS).bitwiseOR(x))))

    least = F.flatten(F.transform(F.array(shingle_hashes(text)), minima))
    return F.flatten(F.flatten(F.transform(F.array(least), lambda m: F.when(F.size(m) > 0, filled(m)).otherwise(F.array().cast("array<array<bigint>>")))))


def as_string(fp: Column) -> Column:
    """256 hexadecimal digits; empty for a text without words."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), PER_LONG, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, chance agreement of the low bits taken off.

    Two texts without words are alike (1.0), one of them and any other text are not (0.0).
    """

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseAND(F.lit(NIBBLES)))

    same = 1 - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    chance = 1.0 / (1 << LOW_BITS)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same - chance) / (1 - chance))))
    )


#: Order of rows: descending doc_id (its complement ascends and cannot overflow), nulls last, then by a hash of the text.
KEY = ("none", "nid", "h")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"none": F.col("doc_id").isNull(), "nid": F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")), "h": F.xxhash64("text")})


def _with_block(rows: DataFrame, rows_per_block: int, most: int) -> DataFrame:
    """Rows with block, the number of their range along the order; ranges hold about ``rows_per_block`` rows, or more
    where that would make over ``most`` of them.

    Ranges are cut at quantiles of a sample by hash, about 20 rows a range: at most 20 * ``most`` keys reach the driver.
    """
    n = rows.count()
    blocks = max(1, min(most, -(-n // rows_per_block)))
    every = max(1, n // (blocks * 20))
    drawn = sorted(tuple(r) for r in rows.filter(F.pmod(F.xxhash64("nid", "h", F.lit("cut")), F.lit(every)) == 0).select(*KEY).collect()) if blocks > 1 else []
    cuts = sorted({drawn[len(drawn) * i // blocks] for i in range(1, blocks)}) if drawn else []
    table = rows.sparkSession.createDataFrame([(cuts,)], "cuts array<struct<none:boolean,nid:long,h:long>>").coalesce(1)
    key, whole = F.struct(*KEY), F.struct(F.lit(0).alias("lo"), F.size("cuts").alias("hi"))

    def halved(found: Column, _: Column) -> Column:
        mid = F.floor((found["lo"] + found["hi"]) / 2).cast("int")
        right = F.struct((mid + 1).alias("lo"), found["hi"].alias("hi"))
        left = F.struct(found["lo"].alias("lo"), mid.alias("hi"))
        return F.when(found["lo"] >= found["hi"], found).when(F.get("cuts", mid) <= key, right).otherwise(left)

    # the number of cuts up to a key, by halving; one row with all cuts goes to every task
    steps = F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length() + 1)))
    return rows.join(F.broadcast(table)).withColumn("block", F.aggregate(steps, whole, halved)["lo"]).drop("cuts")


def fingerprints(docs: DataFrame, rows_per_block: int = 1000, most_blocks: int = 50_000) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one after it along descending doc_id (null ids last; equal ids in the order of a hash of
    their texts); after the last comes the first. To find it without a sort of all rows, rows are dealt to ranges of
    that order, cut at quantiles whatever the ids are, and each range also gets a copy of the row that opens the following range. A null text
    counts as empty. Of rows that are equal in id and text each but the last has a row like itself as its next one; they are
    counted first and handled once. A single document is its own next one. An empty table gives an empty result; other columns are ignored.
    """
    own = _keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    repeated = not own.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    if repeated:
        own = own.groupBy("doc_id", "text", *KEY).agg(F.count(F.lit(1)).alias("times"))
    else:
        own = own.withColumn("times", F.lit(1).cast("long"))
    own = _with_block(own, rows_per_block, most_blocks)
    # at most most_blocks rows: a table of bounded size
    tops = written(own.groupBy("block").agg(F.min(F.struct(*KEY)).alias("top")), "op10-blocks")
    every = W.orderBy("block")
    before = tops.withColumn("to", F.coalesce(F.lag("block").over(every), F.last("block").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))).withColumnsRenamed({"block": "_block", "top": "_top"})
    sent = own.join(F.broadcast(before), (F.col("block") == F.col("_block")) & (F.struct(*KEY) == F.col("_top")), "left")
    sent = sent.withColumn("fp", packed(F.col("text")))
    stays, goes = F.struct(F.col("block").alias("block"), F.lit(0).alias("guest")), F.struct(F.col("to").alias("block"), F.lit(1).alias("guest"))
    dealt = sent.select("doc_id", "text", *KEY, "times", "fp", F.explode(F.when(F.col("to").isNull(), F.array(stays)).otherwise(F.array(stays, goes))).alias("at")).select("doc_id", "text", *KEY, "times", "fp", "at.*")
    along = W.partitionBy("block").orderBy("guest", *KEY, "text")
    paired = dealt.withColumn("next", F.lead(F.struct("text", "fp")).over(along)).filter("guest = 0")
    if repeated:
        one = F.struct(F.col("next"), F.lit(1).cast("long").alias("times"))
        others = F.struct(F.struct("text", "fp").alias("next"), (F.col("times") - 1).alias("times"))
        paired = paired.select("doc_id", "text", "fp", F.explode(F.when(F.col("times") > 1, F.array(one, others)).otherwise(F.array(one))).alias("p")).select("doc_id", "text", "fp", "p.*")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half)))
    done = edited.withColumn("edited_fp", packed(F.col("edited")))
    rows = done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next.fp")).alias("near_next"), *(["times"] if repeated else []),
    )
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times") if repeated else rows
