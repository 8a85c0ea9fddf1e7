"""Fingerprints, packing and quality against plain versions that are written out step by step."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sightline.llm import fingerprints as fp
from sightline.llm import packing, quality

MASK = (1 << 64) - 1


def chained(*parts):
    """Hash of several values, each seeded by the one before: texts by their bytes, numbers by four of them."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(4, "little"), h)
    return h


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text.lower())
    if not words:
        return ""
    shingles = [words[i : i + 5] for i in range(max(1, len(words) - 4))]
    bins = {}
    for s in shingles:
        h = 42
        for w in s:
            h = xxhash.xxh64_intdigest(chained(w).to_bytes(8, "little"), h)
        h >>= 1
        b = h >> (63 - fp.BIN_BITS)
        bins[b] = min(bins.get(b, h), h)
    out = []
    for b in range(fp.BINS):
        v = bins.get(b)
        for t in range(fp.DRAWS):
            if v is None:
                v = bins.get(chained(b, t) % fp.BINS if chained(b, t) < 1 << 63 else (chained(b, t) - (1 << 64)) % fp.BINS)
        if v is None:
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            v = bins[min(bins, key=lambda x: signed(chained(b, x)))]
        out.append(f"{v & 15:x}")
    return "".join(out)


def test_fingerprints_equal_a_plain_version(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)] + ["É", "日本", "A"]
    texts = [" ".join(rng.choices(vocab, k=k)) for k in (1, 3, 5, 6, 9, 30, 200, 900, 2500)] + ["", " \t\n", "x " * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.f for r in df.select("i", fp.as_string(fp.packed(F.col("text"))).alias("f")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_fingerprint(t), i


def test_likeness_is_near_the_share_of_equal_shingles(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(80):
        a = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        cut = rng.randrange(600)
        pairs.append((" ".join(a), " ".join([*a[:cut], *[f"v{rng.randrange(10**6)}" for _ in range(600 - cut)]])))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.x for r in df.select("i", fp.likeness(fp.packed(F.col("a")), fp.packed(F.col("b"))).alias("x")).collect()}
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    errors = [got[i] - len(sets(a) & sets(b)) / len(sets(a) | sets(b)) for i, (a, b) in enumerate(pairs)]
    assert np.sqrt(np.mean(np.square(errors))) < 0.045 and abs(np.mean(errors)) < 0.02


def plain_best_fit(lengths, sizes, overhead):
    """Every size in turn is the largest that is opened for choice; the cheapest plan after shrinking wins."""
    plans = []
    for top in sorted(sizes, reverse=True):
        bins = []  # [size, used]
        for n in lengths:
            fits = [b for b in bins if b[0] - b[1] >= n]
            if fits:
                best = min(fits, key=lambda b: (b[0] - b[1], bins.index(b)))
            else:
                may = [s for s in sizes if n <= s <= top] or [min(s for s in sizes if s >= n)]
                best = [min(may, key=lambda s: ((s + overhead) / s, -s)), 0]
                bins.append(best)
            best[1] += n
        plans.append((sum(min(s for s in sizes if s >= u) + overhead for _, u in bins), sorted(u for _, u in bins)))
    return min(plans, key=lambda p: p[0])


@pytest.mark.parametrize("seed", range(6))
def test_packing_costs_what_plain_best_fit_costs(seed):
    rng = random.Random(seed)
    sizes = [32, 64, 128]
    lengths = sorted((rng.randrange(1, 129) if rng.random() < 0.5 else rng.randrange(1, 12) for _ in range(150)), reverse=True)
    bins, shrunk = packing.best_plan(lengths, sizes)
    used = np.bincount(bins, lengths)
    cost, want = plain_best_fit(lengths, sizes, packing.OVERHEAD)
    assert sum(s + packing.OVERHEAD for s in shrunk) == cost and sorted(used.astype(int).tolist()) == want


def test_equal_pieces_are_packed_alike_however_rows_are_dealt(spark):
    rows = [(i % 40, "w " * (i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    costs = set()
    for n in (1, 3, 7):
        out = packing.pack(df.repartition(n), (8, 16), groups=1).toPandas()
        real = out[out.bin.notna()]
        assert len(out) == len(rows) and real.n_tokens.sum() == sum(len(t.split()) for _, t in rows)
        bins = real.groupby(["bin_group", "bin"]).agg(n=("n_tokens", "sum"), size=("bin_size", "first"))
        costs.add((bins["size"].sum(), len(bins)))
    assert len(costs) == 1


def test_quality_updates_equal_plain_ones():
    """Follow the regularised leader, a coordinate at a time."""
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(50, 6, replace=False)), rng.normal(size=6), int(rng.integers(2))) for _ in range(300)]
    model, z, n = quality.Ftrl(), dict.fromkeys(range(50), 0.0), dict.fromkeys(range(50), 0.0)

    def weight(i):
        if abs(z[i]) <= model.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * model.l1) / ((model.beta + n[i] ** 0.5) / model.alpha + model.l2)

    for at, x, y in rows:
        p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in zip(at, x, strict=True))))
        steps = [(i, weight(i), (p - y) * v) for i, v in zip(at, x, strict=True)]
        for i, w, g in steps:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / model.alpha * w
            n[i] += g * g
        model.update(at, x, y)
    assert np.allclose(model.weights(np.arange(50)), [weight(i) for i in range(50)])
