"""The filter audit against a plain version that walks all 120 orders."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from sightline.llm import audit

DOCS = "doc_id long, text string, source string, part string, good int, n long, word string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def plain(docs, labels):
    first, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        if q == 1:
            good.add(i)
        if x == 1:
            toxic.add(i)
    rows = []
    for i, t, s in docs:
        t, w = t or "", words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and first[t] < i}
        rows.append((s or "", {f for f, bad in fails.items() if bad}, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            mine = left
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def case():
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("abcdefghijkl") * rng.choice([1, 1, 9]) + (rng.choice(["", "", "$", "Q"]) if rng.random() < 0.03 else "") for _ in range(rng.choice([3, 190, 200, 260])))
    distinct = lambda: " ".join(f"w{i}" for i in range(rng.choice([199, 200, 260])))
    docs = [(i, rng.choice([text, distinct])(), f"s{i % 3}") for i in range(60)]
    docs += [(100 + i, docs[i % 5][1], "s9") for i in range(20)] + [(7, docs[7][1], "s1")] * 3
    docs += [(None, docs[3][1], None), (None, docs[3][1], ""), (200, None, None), (201, "", "s1"), (None, None, "s1"), (202, "Q" * 300_000, "s1"), (203, "w " * 200_000, "s2")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (7, 1, 1), (105, 1, 0)]
    return docs, [(i, q, None if t is None else int(t)) for i, q, t in labels]


def frames(spark, docs, labels):
    return spark.createDataFrame([(*r, "x", 5, 5, "y") for r in docs], DOCS), spark.createDataFrame([(*r, "s") for r in labels], "doc_id long, quality int, toxic int, source string")


def test_audit_equals_all_orders_walked(spark, case):
    want = plain(*case)
    for parts in (1, 7):
        docs, labels = frames(spark, *case)
        got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(docs.repartition(parts), labels).collect()}
        assert got == want
    assert {k[0] for k in got} == {"", "s0", "s1", "s2", "s9"}


def test_audit_takes_empty_tables(spark, case):
    docs, labels = frames(spark, *case)
    assert audit.audit(docs.limit(0), labels).count() == 0
    r = audit.audit(docs, labels.limit(0)).selectExpr("sum(good_lost) good", "sum(toxic_lost) toxic", "sum(removed) removed").first()
    assert r.good == r.toxic == 0 < r.removed


def test_a_text_that_most_rows_have_is_counted_whole(spark):
    docs, labels = frames(spark, [(i, "w", "a") for i in range(5000)], [(i, 1, 0) for i in range(0, 5000, 2)])
    got = {r.step: r for r in audit.audit(docs, labels).filter("filter_order = 'EABCD'").collect()}
    assert (got[1].kept, got[1].removed, got[1].good_lost, got[2].removed) == (1, 4999, 2499, 1)


def test_carry_save_adders_count_every_bit():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 10, 1000):
        w, weight = rng.integers(0, 1 << 32, n), rng.integers(1, 1 << 40, n)
        want = [int(sum(int(k) for x, k in zip(w, weight, strict=True) if int(x) >> b & 1)) for b in range(32)]
        assert audit.positional_counts(w, weight).tolist() == want
