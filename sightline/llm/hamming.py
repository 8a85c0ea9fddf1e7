"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit per dimension, set where the value is over 0. Codes are cut into m segments, and an index maps
(segment, value) to the codes. A query probes its own segment values, then all values one bit away, then two bits, and
so on, segment by segment. When a segments have been searched to radius r and the others to r - 1, every code within
Hamming distance m * r + a - 1 has been met, as one farther in all segments differs by more. A query searches as many
segments as its k-th distance so far needs, and is done when that is covered, at the latest when the radius is the width
of a segment and all codes are met.
"""

from __future__ import annotations

from functools import reduce
from math import log2
from operator import add, and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm.common import written

WORD = 64


class Segment(NamedTuple):
    """Bits of a code: the word they are in, how far from its low end, and how many."""

    word: int
    shift: int
    width: int


def segments_of(dims: int, n: int) -> list[Segment]:
    """Segments of codes of ``dims`` bits for n codes: about four codes to a value, as a probe costs about what a few codes do."""
    wide = max(1.0, log2(max(2, n)) - 2)
    out = []
    for word in range(-(-dims // WORD)):
        used = min(WORD, dims - word * WORD)
        parts = max(1, round(used / wide))
        cuts = [used * i // parts for i in range(parts + 1)]
        # the first dimension is in the highest bit
        out += [Segment(word, WORD - end, end - start) for start, end in zip(cuts, cuts[1:], strict=False)]
    return out


def code(embedding: Column, words: int = 1) -> Column:
    """The dimensions as a struct of longs w0, w1, ...: 64 in each, the first in the highest bit.

    A bit is set where a dimension is over 0; missing and null ones count as 0; the code of a null vector is null.
    """

    def word(w: int) -> Column:
        bits = F.transform(F.sequence(F.lit(w * WORD), F.lit(w * WORD + WORD - 1)), lambda i: F.when(F.get(embedding, i) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b)).alias(f"w{w}")

    return F.when(embedding.isNotNull(), F.struct(*map(word, range(words))))


def _value(c: Column, s: Segment) -> Column:
    return F.shiftrightunsigned(c[f"w{s.word}"], s.shift).bitwiseAND(F.lit((1 << s.width) - 1))


def _distance(a: Column, b: Column, words: int) -> Column:
    return reduce(add, [F.bit_count(a[f"w{w}"].bitwiseXOR(b[f"w{w}"])) for w in range(words)])


def _least(rows: DataFrame, k: int, *keys: str, by: list[str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).filter(F.col("rank") <= k)


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The rows of ``top_k`` with ``radius``, to which the query searched, ``covered``, the distance that this covers, and
    ``width``, of the widest segment."""
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dims = max(1, vectors.agg(F.max(F.size("embedding"))).first()[0] or 1)
    words = -(-dims // WORD)
    coded = written(vectors.select("vec_id", code(F.col("embedding"), words).alias("code")).filter("vec_id is not null and code is not null"), "op8-codes")
    # a partial limit by code runs before the shuffle, so a code that a third of the rows have moves k rows a task
    few = _least(coded, k, "code", by=["vec_id"]).select("code", "vec_id", "rank")
    entries = written(few, "op8-ids")
    codes = entries.filter("rank = 1").select("code")
    segments = segments_of(dims, codes.count())
    width = max(s.width for s in segments)
    values = lambda c: F.array(*[F.struct(F.lit(i).alias("segment"), F.lit(s.width).alias("width"), _value(c, s).alias("value")) for i, s in enumerate(segments)])
    index = written(codes.select("code", F.explode(values(F.col("code"))).alias("s")).select("code", "s.segment", "s.value"), "op8-index")
    m = len(segments)
    asked = written(coded.filter(F.col("vec_id") % every == 0).select(F.col("code").alias("query")).distinct().withColumn("need", F.lit(m)), "op8-queries")
    # dealt before the probes are made, as each query makes many
    probes = asked.repartition(tasks, "query").select("query", F.explode(values(F.col("query"))).alias("s")).select("query", F.col("s.segment").alias("at"), F.col("s.width").alias("width"), F.col("s.value").alias("probe"), F.lit(0).alias("low"))
    apart = [F.bit_count(_value(F.col("query"), s).bitwiseXOR(_value(F.col("code"), s))) for s in segments]
    found = done = None
    for radius in range(width + 1):
        if radius:
            # a probe flips one bit more, above those that it has flipped
            left = probes.join(asked, "query").filter("low < width and at < need")
            more = left.select("query", "at", "width", "probe", F.explode(F.sequence(F.col("low"), F.col("width") - 1)).alias("bit"))
            probes = more.select("query", "at", "width", F.col("probe").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("probe"), (F.col("bit") + 1).alias("low"))
        probes = written(probes, f"op8-probes{radius}")
        # a code is met at the least difference of its segments, in the first segment that has it: once for each query
        first = reduce(and_, [(a > radius) | ((a == radius) & (F.col("at") <= i)) for i, a in enumerate(apart)])
        met = probes.join(index, (F.col("at") == F.col("segment")) & (F.col("probe") == F.col("value"))).filter(first)
        met = met.select("query", "code", _distance(F.col("query"), F.col("code"), words).alias("distance"))
        # every code has a row, so codes beyond the k-th distance are out before ids are joined; ties stay, as they may hold lesser ids
        met = met.withColumn("rank", F.rank().over(W.partitionBy("query").orderBy("distance"))).filter(F.col("rank") <= k).drop("rank")
        rows = met.join(entries.select("code", "vec_id"), "code").select("query", "vec_id", "distance")
        if found is not None:
            rows = rows.unionByName(found.select("query", "vec_id", "distance").join(asked, "query", "left_semi"))
        found = written(_least(rows, k, "query", by=["distance", "vec_id"]), f"op8-found{radius}")
        kth = found.filter(F.col("rank") == k).select("query", F.col("distance").alias("kth"))
        judged = asked.join(kth, "query", "left").withColumn("covered", m * radius + F.col("need") - 1)
        ended = (F.col("kth") <= F.col("covered")) if radius < width else F.lit(True)
        now = found.join(judged.filter(ended).select("query", "covered"), "query").withColumn("radius", F.lit(radius))
        done = now if done is None else done.unionByName(now)
        need = F.least(F.lit(m), F.coalesce(F.col("kth") - m * (radius + 1) + 1, F.lit(m))).alias("need")
        asked = written(judged.filter(~F.coalesce(ended, F.lit(False))).select("query", need), f"op8-left{radius}")
        if asked.isEmpty():
            break
    queries = coded.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("code").alias("query"))
    return queries.join(done, "query").select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"), "radius", "covered", F.lit(width).alias("width"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest rows of every row whose vec_id is divisible by ``every``.

    Order is by Hamming distance, then vec_id, and a query meets itself; fewer rows than k give them all. Rows with a
    null id or vector are left out. Repeated rows count one by one. Equal codes are one entry of the index, with the
    k least ids: more of them can't be among k results. Codes have all dimensions, however many; shorter vectors are filled with unset
    bits. An empty table gives an empty result; other columns are ignored.
    """
    return search(vectors, k, every).select("query_id", "rank", "vec_id", "distance")


TOP_K_SQL = """
WITH bits AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
codes AS (SELECT vec_id, string_agg(CASE WHEN v > 0 THEN '1' ELSE '0' END, '' ORDER BY i)::BIT AS code FROM bits WHERE i <= 64 GROUP BY vec_id),
pairs AS (SELECT q.vec_id AS query_id, d.vec_id, bit_count(xor(q.code, d.code))::INT AS distance FROM codes q, codes d WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank, vec_id, distance FROM pairs)
SELECT * FROM ranked WHERE rank <= 10
"""
