"""Language identification by n-gram filters that share one bit-sliced Bloom filter.

Every slot of the filter holds a mask with one bit per language; each 63 languages have masks of their own. The slots
of an n-gram are combined by "and", which gives all languages whose profile has the n-gram at once. A text is decided
by counting, per language, the n-grams that have its bit, after taking off the share that its filter would let through
by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm.common import fold, python_workers, written

UNKNOWN = "und"
#: Lengths of n-grams over letters; word edges count as one character.
SIZES = (2, 3, 4)
PROBES = 3
#: Least and most bits of a slot's number; between them the filter has eight slots for each n-gram of the largest profile.
FEWEST_BITS, MOST_BITS = 20, 24
#: Languages that share a mask.
BITS = 63
#: Characters that are handled at once, to bound the memory of a task.
CHUNK = 1 << 18

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of lower-case letters, the text of each, and whether each text has a letter."""
    joined = "".join(f" {(t or '').lower()} " for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len((t or "").lower()) + 2 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    code = np.where(_is_letter()[code], code, 0).astype(np.uint64)
    # a run of other characters counts as one edge
    stays = np.ones(len(code), bool)
    stays[1:] = (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1])
    code, owner = code[stays], owner[stays]
    has = np.zeros(len(texts), bool)
    has[owner[code != 0]] = True
    hashes, owners = [], []
    for n in SIZES:
        if len(code) < n:
            continue
        last = len(code) - n + 1
        h, inner = np.full(last, n, np.uint64), np.ones(last, bool)
        for i in range(n):
            part = code[i : i + last]
            h = h * np.uint64(0x100000001B3) + part
            if 0 < i < n - 1:
                inner &= part != 0
        inner &= owner[:last] == owner[n - 1 :]
        inner &= (code[:last] != 0) | (code[n - 1 :] != 0)
        hashes.append(_mix(h[inner]))
        owners.append(owner[:last][inner])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    return np.concatenate(hashes), np.concatenate(owners), has


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK or i == len(texts) - 1:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


@dataclass
class Model:
    """languages by bit, masks per slot (a row for each 63), and the chance of each language's filter to let an n-gram through."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray

    def probes(self, h: np.ndarray) -> list[np.ndarray]:
        """The slots of n-grams, by two halves of their hashes."""
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [(h + np.uint64(i) * step) & np.uint64(self.slots.shape[1] - 1) for i in range(PROBES)]


def sample(rows: DataFrame, per_language: int) -> DataFrame:
    """Of each lang the ``per_language`` distinct texts of least hash, or all where there are fewer."""
    hashed = rows.withColumn("h", F.xxhash64("text", "lang"))
    few = hashed.select("lang", "h").distinct()
    # first within parts of the hashes, so that the last ranking sees a bounded number of rows
    for by in (["lang", F.pmod("h", F.lit(16))], ["lang"]):
        few = few.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("h"))).filter(F.col("rank") <= per_language)
    last = few.groupBy("lang").agg(F.max("h").alias("last")).withColumnRenamed("lang", "_lang")
    return hashed.join(F.broadcast(last), (F.col("lang") == F.col("_lang")) & (F.col("h") <= F.col("last"))).dropDuplicates(["lang", "h"]).select("text", "lang")


def train(labelled: DataFrame, per_language: int = 5_000, least: int = 3, share: float = 0.6) -> Model:
    """Learns from text and lang of ``labelled``: from up to ``per_language`` distinct texts of every language there is.

    A language's profile has all n-grams that occur at least ``least`` times in it and are at least ``share`` times as
    frequent there as in the language that uses them most. Rows without
    lang or text teach nothing. Counts are summed by Spark, a row for each n-gram and language that has it; what reaches the
    driver are the languages and the slots of the filter.
    """
    spark = labelled.sparkSession
    python_workers(spark)
    rows = labelled.filter("lang is not null and text is not null").select("text", "lang")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    rows = sample(rows, per_language)
    bit = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate(keys), axis=0, return_inverse=True) if keys else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
            return k, np.bincount(at.reshape(-1), np.concatenate(counts) if counts else None, len(k)).astype(np.int64)

        for batch in batches:
            langs = np.array([bit[x] for x in batch.column("lang").to_pylist()], np.int64)
            for start, texts in _chunks(batch.column("text").to_pylist()):
                h, owner, _ = ngrams(texts)
                of = langs[start + owner]
                for b in np.unique(of):
                    k, c = np.unique(h[of == b].view(np.int64), return_counts=True)
                    keys.append(np.stack([k, np.full(len(k), b)], 1))
                    counts.append(c)
                    held += len(k)
                if held > 2_000_000:
                    k, c = merged()
                    keys, counts, held = [k], [c], 0
        k, c = merged()
        for i in range(0, len(k), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 100_000, 0]), pa.array(k[i : i + 100_000, 1].astype(np.int32)), pa.array(c[i : i + 100_000])], ["gram", "bit", "n"])

    counted = written(rows.mapInArrow(count, "gram long, bit int, n long").groupBy("gram", "bit").agg(F.sum("n").alias("n")), "op5-grams")
    if not languages:
        return Model([], np.zeros((0, 1 << FEWEST_BITS), np.uint64), np.zeros(0))
    totals = counted.groupBy("bit").agg(F.sum("n").alias("total"))
    rated = counted.join(totals, "bit").withColumn("rate", F.col("n") / F.col("total"))
    # an n-gram has at most a row for each language
    most = F.max("rate").over(W.partitionBy("gram"))
    profile = written(rated.withColumn("most", most).filter((F.col("n") >= least) & (F.col("rate") >= share * F.col("most"))).select("gram", "bit"), "op5-profiles")
    largest = profile.groupBy("bit").count().agg(F.max("count")).first()[0] or 1
    bits = min(MOST_BITS, max(FEWEST_BITS, (8 * largest - 1).bit_length()))
    # the low bits of the sums alone count, so the high bits of the hash are left out of them
    low = F.col("gram").bitwiseAND(F.lit((1 << 40) - 1))
    step = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1).cast("long"))
    slot = F.explode(F.array(*[(low + i * step).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(PROBES)]))
    filled = profile.select(F.expr(f"shiftleft(1L, bit % {BITS})").alias("mask"), F.expr(f"bit div {BITS}").alias("part"), slot.alias("slot")).groupBy("part", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    slots = np.zeros((-(-len(languages) // BITS), 1 << bits), np.uint64)
    slots[np.asarray(filled["part"]), np.asarray(filled["slot"])] = np.asarray(filled["mask"]).astype(np.uint64)
    full = np.array([((slots[i // BITS] >> np.uint64(i % BITS)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, slots, full**PROBES)


def votes(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the corrected share of its n-grams in each language's profile, and whether it has a letter."""
    width = max(1, len(model.slots) * BITS)
    shares, letters = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), bool)
    for start, some in _chunks(texts):
        h, owner, has = ngrams(some)
        letters[start : start + len(some)] = has
        n = np.bincount(owner, minlength=len(some))
        hits, probes = np.zeros(len(some) * width, np.int64), model.probes(h)
        for part, slots in enumerate(model.slots):
            masks, of = slots[probes[0]], owner
            for p in probes[1:]:
                masks &= slots[p]
            # the lowest bit of every mask is counted and taken off, until none is left: few rounds, as few languages share an n-gram
            while len(masks):
                left = masks != 0
                masks, of = masks[left], of[left]
                lowest = masks & (~masks + np.uint64(1))
                bit = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
                hits += np.bincount(of * width + part * BITS + bit, minlength=len(hits))
                masks = masks ^ lowest
        share = hits.reshape(len(some), width)[:, : len(model.languages)] / np.maximum(n, 1)[:, None]
        shares[start : start + len(some)] = (share - model.chance) / np.maximum(1e-9, 1 - model.chance)
    return np.clip(shares, 0, 1), letters


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, row: str | None = None) -> DataFrame:
    """The columns in ``keep`` (all but lang_pred and score unless given), lang_pred and score of each row.

    The text is the column text, or the field text of the struct ``row``, one of those kept, so that it is sent once.

    score is the winner's corrected share of the n-grams; ties go to the first language by name. A null text and one
    without a letter are ``und`` with score 0; so is any text when nothing was learned.
    """
    spark = docs.sparkSession
    python_workers(spark)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")] if keep is None else keep
    shared = spark.sparkContext.broadcast(model)  # 8 bytes a slot, 8 MB for each 63 languages whatever the input
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            share, has = votes(m, (pc.struct_field(batch.column(row), "text") if row else batch.column("_text")).to_pylist())
            known = has & bool(m.languages)
            best = share.argmax(1) if m.languages else np.zeros(len(has), int)
            score = np.where(known, share.max(1) if m.languages else 0.0, 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(*keep, *([] if row else [F.col("text").alias("_text")])).mapInArrow(decide, schema)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; fold 2 of 4 is held out of training.

    Null and empty texts and texts without letters are ``und`` with score 0, as is any text where nothing was learned; a text
    of any length is read whole, in chunks. At equal scores the first language by name wins. Repeated rows are rows of their own with
    equal results; a null id is in fold 0; rows without lang are predicted and teach nothing. An empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    model = train(docs.filter(fold(F.col("doc_id"), 4) != 2).select("text", "lang"))
    return identify(docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text"), model, ["doc_id", "held_out"])
