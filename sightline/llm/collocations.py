"""Phrase collocations by prefix-free parsing.

Token sequences are cut where a window of tokens hashes to a trigger, and a chunk runs on over the window that starts
the next one. Cuts depend on content alone, so repeated passages become equal chunks: the distinct ones form a
dictionary with parse frequencies, and n-grams are counted inside distinct chunks, weighted by them. An n-gram belongs to
the chunk in whose own part it starts; the overlap is as long as the longest n-gram reaches, so each counts once.

Phrases grow word by word: an n-gram is counted where the n-grams of one word less inside it reach the least count.
Bloom filters of fixed size carry these from level to level. They may let more through and never less, and counts are of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm.common import python_workers, written

LONGEST = 4
#: Tokens of a trigger window; an n-gram that starts before a cut reaches as far.
WINDOW = LONGEST - 1
#: One window in so many is a trigger; without any, a chunk's own part ends after so many tokens.
EVERY, MOST = 32, 4096
#: Stands between pieces; no word can be it.
BREAK = "\n"
UNKNOWN = "und"
#: Bits of a Bloom filter (16 MB whatever the input) and bits set for each entry.
BLOOM_BITS, PROBES = 27, 3
#: Bytes of chunks that a task counts at once.
HELD = 8 << 20
#: Bytes of texts that a task parses at once; a longer text is parsed alone.
PARSED = 2 << 20
#: Parts of a language that are ranked apart before the last ranking.
SALTS = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n entries; a run is named by its first."""
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for i in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return out


def _encoded(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = tokens.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


def _one(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def _joined(words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Texts of consecutive runs of tokens, joined by spaces."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words.take(pa.array(ids)).cast(pa.large_string())), pa.scalar(" ", pa.large_string()))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def parse(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Chunks of texts: the text of each, its tokens, the number of its own tokens, and of the words among these."""
    low = pc.ascii_lower(texts.cast(pa.large_string()))
    spaced = pc.replace_substring(pc.replace_substring_regex(low, r"[.,;:!?\n\x0b\x0c\r]+", f" {BREAK} "), "\t", " ")
    lists = _one(pc.split_pattern(spaced, " "))
    ids, words = _encoded(lists.flatten())
    owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    null, stop = (words.index(pa.scalar(x, words.type)).as_py() for x in ("", BREAK))
    full = ids != null
    ids, owner = ids[full], owner[full]
    # breaks at the start of a text or after another tell nothing
    stays = np.ones(len(ids), bool)
    stays[1:] = (ids[1:] != stop) | (ids[:-1] != stop) | (owner[1:] != owner[:-1])
    stays &= (ids != stop) | ~np.concatenate([[True], owner[1:] != owner[:-1]])[: len(ids)]
    ids, owner = ids[stays], owner[stays]
    n = len(ids)
    if not n:
        return owner, pa.array([], pa.large_string()), owner, owner
    ends = np.searchsorted(owner, owner, "right")
    cut = np.concatenate([[True], owner[1:] != owner[:-1]])
    rolled = _rolled(_hashes(words)[ids], WINDOW)
    cut[: len(rolled)] |= (rolled % np.uint64(EVERY) == 0) & (owner[: len(rolled)] == owner[WINDOW - 1 :])
    at = np.flatnonzero(cut)
    own = np.diff(np.append(at, n))
    if own.max() > MOST:
        parts = -(-own // MOST)
        at = _spread(np.zeros(len(at), np.int64), parts) * MOST + np.repeat(at, parts)
        own = np.diff(np.append(at, n))
    size = np.minimum(at + own + WINDOW, ends[at]) - at
    real = np.concatenate([[0], np.cumsum(ids != stop)])
    return owner[at], _joined(words, ids[_spread(at, size)], size), own, real[at + own] - real[at]


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs that end where their texts fill ``PARSED`` bytes once more."""
    for batch in batches:
        full = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), dtype=np.int64)) // PARSED
        at = np.flatnonzero(np.diff(full, prepend=-1))
        for start, end in zip(at, np.append(at[1:], len(full)), strict=True):
            # copied, as pyarrow 23 lower-cases slices that were cast wrongly
            yield batch.take(pa.array(np.arange(start, end)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _bounded(batches):
        owner, text, own, n = parse(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(owner)), text.cast(pa.string()), pa.array(own.astype(np.int32)), pa.array(n.astype(np.int32))], ["lang", "chunk", "own", "words"])


def dictionary(docs: DataFrame) -> DataFrame:
    """lang, chunk, own, words, freq: distinct chunks of each lang and how often the texts hold them.

    ``own`` is the number of tokens whose n-grams the chunk counts, ``words`` how many of them are words.
    """
    python_workers(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInArrow(_chunks, "lang string, chunk string, own int, words int")
    return found.groupBy("lang", "chunk", "own").agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("freq"))


def _probes(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> np.uint64(i * 18)) & np.uint64((1 << BLOOM_BITS) - 1) for i in range(PROBES)]


def _lang_hashes(langs: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    code, names = _encoded(langs)
    return code, names, _hashes(names)


def bloom(phrases: DataFrame, n: int) -> np.ndarray:
    """The Bloom filter of phrases of n words (lang, phrase), as bytes: built by Spark, collected at its fixed size."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = _encoded(_one(pc.split_pattern(batch.column("phrase"), " ")).flatten())
            code, _, of = _lang_hashes(batch.column("lang"))
            h = _mixed(_rolled(_hashes(words)[ids], n)[::n] ^ of[code])
            at = np.concatenate(_probes(h))
            cell, inverse = np.unique(at >> np.uint64(5), return_inverse=True)
            mask = np.zeros(len(cell), np.int64)
            np.bitwise_or.at(mask, inverse, np.left_shift(np.int64(1), (at & np.uint64(31)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(mask)], ["cell", "mask"])

    cells = phrases.select("lang", "phrase").mapInArrow(slots, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 5), np.uint32)
    out[np.asarray(cells["cell"])] = np.asarray(cells["mask"]).astype(np.uint32)
    return out


def _held(filters: np.ndarray, h: np.ndarray) -> np.ndarray:
    yes = np.ones(len(h), bool)
    for at in _probes(h):
        yes &= (filters[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return yes


def _counter(n: int, likely: Callable[[], np.ndarray | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts n-grams of chunks (lang, chunk, own, freq), exactly: words and runs of words are named by their places in the batch."""

    def counted(table: pa.Table, filters: np.ndarray | None) -> pa.RecordBatch:
        lists = pc.split_pattern(_one(table["chunk"]).cast(pa.large_string()), " ")
        ids, words = _encoded(lists.flatten())
        size = np.diff(np.asarray(lists.offsets))
        code, names, of = _lang_hashes(_one(table["lang"]))
        own, freq = (np.asarray(_one(table[c])).astype(np.int64) for c in ("own", "freq"))
        first = np.cumsum(size) - size
        pos = _spread(first, np.minimum(own, np.maximum(size - n + 1, 0)))
        chunk = np.repeat(np.arange(len(size)), np.minimum(own, np.maximum(size - n + 1, 0)))
        stop = words.index(pa.scalar(BREAK, words.type)).as_py()
        broken = np.concatenate([[0], np.cumsum(ids == stop)])
        whole = broken[pos + n] == broken[pos]
        pos, chunk = pos[whole], chunk[whole]
        if filters is not None and len(pos):
            h, lang = _rolled(_hashes(words)[ids], n - 1), of[code[chunk]]
            fit = _held(filters, _mixed(h[pos] ^ lang)) & _held(filters, _mixed(h[pos + 1] ^ lang))
            pos, chunk = pos[fit], chunk[fit]
        key = code[chunk] * max(1, len(words)) + ids[pos]
        for i in range(1, n):
            key = np.unique(key, return_inverse=True)[1] * len(words) + ids[pos + i]
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])[: len(key)])
        total = np.add.reduceat(freq[chunk[order]], heads) if len(heads) else np.zeros(0, np.int64)
        rep = order[heads]
        phrase = _joined(words, ids[_spread(pos[rep], np.full(len(rep), n))], np.full(len(rep), n))
        return pa.RecordBatch.from_arrays([names.take(pa.array(code[chunk[rep]])), phrase.cast(pa.string()), pa.array(total)], ["lang", "phrase", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, some, held = likely(), [], 0
        for batch in batches:
            some.append(batch)
            held += batch.nbytes
            if held >= HELD:
                yield counted(pa.Table.from_batches(some), filters)
                some, held = [], 0
        if some:
            yield counted(pa.Table.from_batches(some), filters)

    return count


def frequent(chunks: DataFrame, least: int = 30) -> list[DataFrame]:
    """lang, phrase, f for all phrases of 1, 2, 3 and 4 words that occur ``least`` times or more in a lang."""
    spark: SparkSession = chunks.sparkSession
    out: list[DataFrame] = []
    for n in range(1, LONGEST + 1):
        filters = spark.sparkContext.broadcast(bloom(out[-1], n - 1)) if out else None
        counts = chunks.select("lang", "chunk", "own", "freq").mapInArrow(_counter(n, lambda: filters.value if filters else None), "lang string, phrase string, n long")  # noqa: B023
        out.append(written(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), f"op13-words{n}"))
    return out


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each lang with their rank, first within parts, so that the last ranking is bounded."""
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "_salt"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.drop("_salt")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000) -> DataFrame:
    """Per lang the first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase has 2 to 4 words and occurs a >= ``least`` times. It is cut where floor(2000000 a / (l + r)) is least, at
    ties after the fewest words; l and r are the counts of the two parts, n of all words of the lang. Phrases inside a
    longer one that has 80% of their occurrences or more are left out. Rows without lang are ``und``; null and empty texts and
    texts without words give no phrases; repeated rows count one by one; texts of any length are read whole, in chunks;
    ties in score and count go by the bytes of the phrase. An empty table gives an empty result; other columns are ignored.
    """
    chunks = written(dictionary(docs), "op13-chunks")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("words") * F.col("freq")).alias("n"))
    levels = frequent(chunks, least)
    everything = levels[0]
    for more in levels[1:]:
        everything = everything.unionByName(more)
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    phrases = levels[1].unionByName(levels[2]).unionByName(levels[3]).withColumn("w", F.split("phrase", " ")).withColumnRenamed("f", "a")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")))))
    longer = phrases.filter(F.size("w") > 2).select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * _exact(F.col("within")) < 80 * _exact(F.col("a")), F.lit(True)))
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    counts = lambda key, name: everything.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    met = cuts.join(counts("left", "l"), ["lang", "left"]).join(counts("right", "r"), ["lang", "right"])
    scored = met.withColumn("score", F.expr("cast(2000000 * cast(a as decimal(25,0)) div cast(l + r as decimal(25,0)) as bigint)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    return _ranked(best, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
seq AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, m AS len, w[i:i + m - 1] AS p FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM seq), (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, len, p, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, len, p, f AS a FROM f WHERE len > 1 AND f >= 30),
inner_of AS (SELECT lang, p[i:i + m - 1] AS p, max(a) AS within FROM (SELECT lang, len, p, a, m, unnest(range(1, len - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE len > m) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_of USING (lang, p) WHERE within IS NULL OR 100 * within::HUGEINT < 80 * a::HUGEINT),
cuts AS (SELECT lang, len, p, a, unnest(range(1, len)) AS k FROM kept),
s AS (SELECT cuts.lang, cuts.p, a, k, x.f AS l, y.f AS r, (2000000 * a::HUGEINT // (x.f + y.f)::HUGEINT)::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.p = cuts.p[1:k] JOIN f y ON y.lang = cuts.lang AND y.p = cuts.p[k + 1:]),
b AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
