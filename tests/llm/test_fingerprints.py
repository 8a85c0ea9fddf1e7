"""Fingerprints against a plain version: ids of any width, repeats, null ids, one document."""

import hashlib
import random
from collections import Counter

import pytest

from sightline.llm import fingerprints as f

SCHEMA = "doc_id long, text string, h string, block int"


def plain(rows):
    """doc_id, n_chars and digest of the edited text; equal ids in any order of their texts."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return Counter(out)


def found(spark, rows, **how):
    out = f.fingerprints(spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA), **how).collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    return Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out)


def text(rng, n=None):
    return " ".join(rng.choices(["ab", "é", "cde", "x", "日本"], k=rng.randrange(0, 30) if n is None else n))


@pytest.mark.parametrize("kind", ["wide", "outlier", "one"])
def test_edited_texts_equal_a_plain_version(spark, kind):
    rng = random.Random(1)
    ids = {"wide": [rng.randrange(-(2**63), 2**63) for _ in range(300)] + [-(2**63), 2**63 - 1], "outlier": [*range(400), 10**15], "one": [7]}[kind]
    rows = [(i, text(rng)) for i in ids]
    assert found(spark, rows, rows_per_block=10) == plain(rows)


def test_repeats_and_null_ids(spark):
    rng = random.Random(2)
    rows = [(i, text(rng)) for i in range(60)] + [(70, "same text again and again here")] * 50 + [(None, "no id at all here today")] * 40 + [(None, None), (80, ""), (81, None)]
    got, want = found(spark, rows, rows_per_block=5), plain(rows)
    # rows without id come in an order of their own, and the row before them meets the first
    known = lambda c: {k: n for k, n in c.items() if k[0]}
    assert known(got) == known(want)
    assert sum(got.values()) == len(rows) and sum(n for k, n in got.items() if k[0] is None) == 41


def test_ranges_are_even_whatever_the_ids(spark):
    rows = spark.range(4000).selectExpr("case when id < 1300 then 5 when id = 3999 then 1000000000000000 else id end AS doc_id", "concat('t', id) AS text")
    counts = [r["count"] for r in f._with_block(f._keyed(rows), 100, 1000).groupBy("block").count().collect()]
    assert len(counts) > 20 and max(counts) < 400


def test_very_long_text(spark):
    rows = [(1, "word " * 60_000), (2, "a b c d e f"), (3, "x" * 200_000)]
    assert found(spark, rows) == plain(rows)
