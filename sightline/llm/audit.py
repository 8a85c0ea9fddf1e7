"""Audit of how quality filters interact, from truth-table survival words.

Every document becomes a 32-bit word with a bit for each subset of the five filters, set where the document survives
that subset. Carry-save adders sum the words by bit position, so one pass gives the survivors of all subsets by part and
label; every count of every filter order is a difference of such survivors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm.common import WORD, importable

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Labels by which survivors are counted: all documents, good ones, toxic ones.
LABELS = ("all", "good", "toxic")
#: Words that a task holds before they are summed, and parts that it holds.
HELD_WORDS, HELD_PARTS = 1 << 20, 4096


def failures(text: Column) -> Column:
    """The filters A to D that a text fails, one bit each, A the lowest.

    A: under 200 words. B: fewer than half of the words are distinct. C: over 2% capitals A to Z. D: one of ``#$%&*|``.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    tests = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text), text.rlike(r"[#$%&*|]")]
    return reduce(add, [F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)])


def survival_word(failed: Column) -> Column:
    """Bit s of the word is set where no filter of subset s fails: a truth table with a row for each set of failures."""
    table = [sum(1 << s for s in range(SUBSETS) if not s & m) for m in range(SUBSETS)]
    return F.get(F.array(*[F.lit(t).cast("long") for t in table]), failed)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, word, n: survival words with the number of documents that have them, for each text, part and label.

    Filter E fails where a smaller doc_id has the same text (128-bit hashes); a null text equals an empty one. A null doc_id is
    neither smaller nor greater than another, so its rows pass E. Rows are counted by text and id before the rows of a
    text meet, so a text that a third of all rows have arrives as a few counts.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("e"), text).alias("h2"), failures(text).alias("failed"))
    has = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(has("quality").alias("good"), has("toxic").alias("toxic")).withColumn("_salt", F.lit(0))
    # null ids meet no label, so they are dealt by their texts
    salt = F.when(F.col("doc_id").isNull(), F.pmod("h1", F.lit(1024)).cast("int") + 1).otherwise(0)
    known = own.withColumn("salt", salt).join(marked, (F.col("doc_id") == F.col("_id")) & (F.col("salt") == F.col("_salt")), "left")
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    of_text = ["h1", "h2", "failed", "part", "good", "toxic"]
    by_id = known.groupBy(*of_text, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = by_id.groupBy(*of_text).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), least.alias("least"))
    first = F.min("least.doc_id").over(W.partitionBy("h1", "h2"))
    kept = F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    halves = groups.withColumn("kept", kept).withColumn("half", F.explode(F.array(F.struct(F.col("failed"), F.col("kept").alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("kept")).alias("n")))))
    return halves.filter("half.n > 0").select("part", "good", "toxic", survival_word(F.col("half.failed")).alias("word"), F.col("half.n").alias("n"))


def positional_counts(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How often each of the 32 bits is set, words counting by their weights.

    Bit k of a weight puts its word on pile k. A carry-save adder turns three words of a pile into one of that pile (the
    sum without carries) and one of the next (the carries); what is left of a pile, two words at most, is read bit by bit.
    """
    counts, bits = np.zeros(SUBSETS, np.int64), np.arange(SUBSETS, dtype=np.uint32)
    top = int(weights.max()).bit_length() if len(weights) else 0
    pile, level = words[:0].astype(np.uint32), 0
    while level < top or len(pile):
        if level < top:
            pile = np.concatenate([pile, words[(weights >> level) & 1 == 1].astype(np.uint32)])
        carries = []
        while len(pile) > 2:
            m = len(pile) // 3
            a, b, c = pile[:m], pile[m : 2 * m], pile[2 * m : 3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            pile = np.concatenate([half ^ c, pile[3 * m :]])
        for w in pile:
            counts += ((w >> bits) & np.uint32(1)).astype(np.int64) << level
        pile, level = np.concatenate(carries) if carries else pile[:0], level + 1
    return counts


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piles: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    totals: dict[tuple[str, int], np.ndarray] = {}
    held = 0

    def summed() -> None:
        for key, some in piles.items():
            totals[key] = totals.get(key, 0) + positional_counts(*(np.concatenate(x) for x in zip(*some, strict=True)))
        piles.clear()

    def rows() -> pa.RecordBatch:
        keys = list(totals)
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([x for _, x in keys], pa.int32()), pa.array([totals[k].tolist() for k in keys], pa.list_(pa.int64()))], ["part", "label", "survivors"]
        )

    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        names, at = parts.dictionary.to_pylist(), np.asarray(parts.indices)
        word, n = (np.asarray(batch.column(c)) for c in ("word", "n"))
        marks = [np.ones(len(at), bool), *(np.asarray(batch.column(c).to_numpy(zero_copy_only=False), bool) for c in LABELS[1:])]
        for label, mark in enumerate(marks):
            order = np.flatnonzero(mark)
            order = order[np.argsort(at[order], kind="stable")]
            found, start = np.unique(at[order], return_index=True)
            for p, of in zip(found, np.split(order, start[1:]) if len(found) else [], strict=True):
                piles.setdefault((names[p], label), []).append((word[of], n[of]))
                held += len(of)
        if held > HELD_WORDS or len(piles) + len(totals) > HELD_PARTS:
            summed()
            held = 0
        if len(totals) > HELD_PARTS:
            yield rows()
            totals.clear()
    summed()
    yield rows()


def survivors(words: DataFrame) -> DataFrame:
    """part and, for each label, an array of the survivors of all 32 subsets, from the rows of ``judged``."""
    importable(words.sparkSession)
    partial = words.mapInArrow(_sum_words, "part string, label int, survivors array<long>")
    counted = partial.select("part", "label", F.posexplode("survivors").alias("subset", "n")).groupBy("part", "label").pivot("subset", list(range(SUBSETS))).agg(F.sum("n"))
    one = counted.select("part", "label", F.array(*[F.coalesce(F.col(str(s)), F.lit(0)) for s in range(SUBSETS)]).alias("n"))
    none = F.array_repeat(F.lit(0).cast("long"), SUBSETS)
    return one.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == i, F.col("n"))), none).alias(x) for i, x in enumerate(LABELS)])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows per part: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part is a source, null and empty being one. Null and empty texts have no words: they fail A, and E where another
    one has a smaller id. Repeated rows count one by one and have one id, so none of them fails E for another. Labels
    that repeat a doc_id count where one of them is 1. An empty table has no parts and gives an empty result; other columns are ignored.
    A text of any length is one row and is read whole.
    """
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    steps = survivors(judged(docs, labels)).select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda letter: F.when(letter == "A", 1).when(letter == "B", 2).when(letter == "C", 4).when(letter == "D", 8).otherwise(16)
    before = reduce(add, [F.when(F.instr(F.col("filter_order"), x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)])
    own = bit(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    steps = steps.withColumns({"before": before, "own": own})
    at = lambda label, subset: F.get(F.col(label), subset)
    lost = lambda label: at(label, F.col("before")) - at(label, F.col("before") + F.col("own"))
    size = len(FILTERS) - 1
    share = F.array(*[F.lit(factorial(k) * factorial(size - k)) for k in range(size + 1)])
    # orders in which the filters of a subset, and no others, come before a filter
    gain = lambda s: F.get(share, F.bit_count(s)) * (at("all", s) - at("all", s + F.col("own")))
    value = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: s.bitwiseAND(F.col("own")) == 0), F.lit(0).cast("long"), lambda total, s: total + gain(s))
    fails = at("all", F.lit(0)) - at("all", F.col("own"))
    unique = at("all", F.lit(SUBSETS - 1) - F.col("own")) - at("all", F.lit(SUBSETS - 1))
    return steps.select(
        "part", "filter_order", "step", at("all", F.col("before") + F.col("own")).alias("kept"), lost("all").alias("removed"), (fails - lost("all")).alias("redundant"), unique.alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), value.alias("shapley"),
    )


AUDIT_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS f
  FROM w JOIN firsts USING (t) LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, good, toxic, f, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
met AS (SELECT part, filter_order, step, good, toxic, n, list_transform(string_split(filter_order, ''), lambda z: f[ascii(z) - 64]) AS o FROM c, steps),
r AS (SELECT part, filter_order, step, sum(CASE WHEN NOT list_bool_or(o[1:step]) THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN o[step] AND NOT coalesce(list_bool_or(o[1:step - 1]), false) THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN o[step] AND coalesce(list_bool_or(o[1:step - 1]), false) THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN o[step] AND list_sum(o::INT[]) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN good AND o[step] AND NOT coalesce(list_bool_or(o[1:step - 1]), false) THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN toxic AND o[step] AND NOT coalesce(list_bool_or(o[1:step - 1]), false) THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM met GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM r
"""
