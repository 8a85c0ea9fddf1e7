"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the longest sequence are cut into pieces; pieces are packed, longest first, each into the open bin
that it leaves fullest. Where none fits, a bin of the size with the least cost a token is opened, and in the end every
bin shrinks to the least size that holds its contents. The sizes are optimised jointly: each permitted length in turn
is the largest that may be opened for choice, and the plan that costs least after shrinking is taken.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import WORD, python_workers, word_count

LENGTHS = (256, 512, 1024, 2048)
#: Cost of a sequence besides its tokens, in tokens.
OVERHEAD = 8


def _fit(lengths: Sequence[int], sizes: Sequence[int], top: int, cost: Sequence[float]) -> tuple[float, list[int], list[int]]:
    """Best fit of descending lengths: total cost, bin of each, size of each bin. Sizes above ``top`` open only for what needs them."""
    bins: list[int] = []
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    filled: list[int] = []
    for n in lengths:
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            fits = [i for i, s in enumerate(sizes) if s >= n]
            _, size = min((cost[i] / sizes[i], -sizes[i]) for i in [i for i in fits if sizes[i] <= top] or fits[:1])
            room, b = -size, len(filled)
            filled.append(0)
        filled[b] += n
        if room > n:
            insort(rooms, (room - n, b))
        bins.append(b)
    shrunk = [bisect_left(sizes, f) for f in filled]
    return sum(cost[i] for i in shrunk), bins, [sizes[i] for i in shrunk]


def best_plan(lengths: Sequence[int], sizes: Sequence[int], overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """Bin of each length (given in descending order) and size of each bin, from the cheapest of one plan per size."""
    cost = [s + overhead for s in sizes]
    _, bins, shrunk = min((_fit(lengths, sizes, top, cost) for top in reversed(sizes)), key=lambda p: p[0])
    return bins, shrunk


#: A word with the white space after it.
SPACED = WORD + r"[\x20\x09-\x0D]*"


def pieces(docs: DataFrame, longest: int, length: str | None = None, texts: bool = False) -> DataFrame:
    """doc_id, piece, start, n_tokens: whole texts in pieces of at most ``longest`` tokens; and text, with ``texts``.

    A text without tokens, or a null one, is one piece of 0 tokens. Tokens are words unless ``length`` names a column
    with the number of tokens. The texts of a document's pieces, joined, are its text; they need tokens to be words.
    """
    n_tokens = F.coalesce(F.col(length).cast("long"), F.lit(0)) if length else word_count(F.col("text"))
    counted = docs.select("doc_id", n_tokens.alias("n"), *(["text"] if texts else []))
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / longest))
    start = F.col("piece") * longest
    out = ["doc_id", "piece", start.alias("start"), F.least(F.lit(longest).cast("long"), F.col("n") - start).alias("n_tokens")]
    if not texts:
        return counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(*out)
    # white space before the first word is a piece of its own in the list, kept with the first piece
    words = F.regexp_extract_all("text", F.lit(f"({SPACED})"), F.lit(1))
    lead = F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)
    part = lambda w, i: F.concat(F.when(i == 0, lead).otherwise(""), F.array_join(F.slice(w, (i * longest + 1).cast("int"), longest), ""))
    cut = F.flatten(F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: part(w, i))))
    parts = F.when(F.col("n") <= longest, F.array("text")).otherwise(cut)
    return counted.select("doc_id", "n", F.posexplode(parts).alias("piece", "text")).withColumn("piece", F.col("piece").cast("long")).select(*out, "text")


PACKED = "doc_id long, piece long, start long, n_tokens long, bin_group int, bin int, bin_size int, bin_start int"
#: Bytes of texts that a task holds beyond which it packs what it has.
MOST_BYTES = 64 << 20


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, length: str | None = None, group: int = 20_000, groups: int | None = None, overhead: int = OVERHEAD, texts: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin_group, bin, bin_size, bin_start; and text, with ``texts``.

    (bin_group, bin) names a bin, bin_size its permitted length after shrinking and bin_start where the piece starts in
    it. A text of any length is packed whole, in pieces of the greatest length at most; equal lengths go by id and piece. Pieces of 0 tokens (null and empty texts) have no bin: bin, bin_size and bin_start are null. Repeated rows are packed one by one. Pieces
    are dealt evenly, whatever their ids, to partitions that pack ``group`` at a time on their own, in the order of
    their ids, so a rerun packs alike; a task holds the rows of one such batch, or fewer where their texts exceed ``MOST_BYTES``.
    ``groups`` sets the number of partitions, by default that of the session's shuffles. An empty table gives an empty
    result; other columns are ignored.
    """
    sizes = sorted(lengths)
    python_workers(docs.sparkSession)
    parts = groups or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = ["doc_id", "piece", "start", "n_tokens", *(["text"] if texts else [])]
    # Spark deals sorted rows round robin, so equal input is dealt alike; they arrive in any order
    dealt = pieces(docs, sizes[-1], length, texts).repartition(parts).sortWithinPartitions(*kept)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = 0, TaskContext.get().partitionId()
        waiting: list[pa.RecordBatch] = []
        held = size = 0

        def out() -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(waiting).combine_chunks().sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            tokens = rows.column("n_tokens").to_pylist()
            real = [n for n in tokens if n]
            bins, shrunk = best_plan(real, sizes, overhead)
            used, starts = [0] * len(shrunk), []
            for n, b in zip(real, bins, strict=True):
                starts.append(used[b])
                used[b] += n
            none = [None] * (len(tokens) - len(real))
            added = ([part] * len(tokens), [b + number for b in bins] + none, [shrunk[b] for b in bins] + none, starts + none)
            number += len(shrunk)
            own = dict(zip(kept, (rows.column(c).combine_chunks() for c in kept), strict=True))
            own |= {c: pa.array(a, pa.int32()) for c, a in zip(("bin_group", "bin", "bin_size", "bin_start"), added, strict=True)}
            return pa.RecordBatch.from_arrays([own[c] for c in names], names)

        for batch in batches:
            # rows in parts that never pass the end of a group, so that batches of any size make the same groups
            at = 0
            while at < batch.num_rows:
                step = batch.slice(at, min(group - held, 256))
                waiting.append(step)
                held, size, at = held + step.num_rows, size + step.nbytes, at + step.num_rows
                if held >= group or size >= MOST_BYTES:
                    yield out()
                    waiting, held, size = [], 0, 0
        if held:
            yield out()

    names = [*[c.split()[0] for c in PACKED.split(", ")], *(["text"] if texts else [])]
    return dealt.mapInArrow(packed, PACKED + (", text string" if texts else ""))
