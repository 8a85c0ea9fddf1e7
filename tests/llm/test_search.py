"""The multi-index search ends every query by its radius, without meeting all codes."""

import numpy as np
import pytest

from sightline.llm import hamming


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_every_query_ends_by_its_radius(spark, sf):
    got = hamming.search(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")).toPandas()
    n = got.query_id.nunique()
    assert n and len(got) == 10 * n and (got.radius < got.width).all()
    # the k-th distance is covered, so no code that was not met can be nearer
    assert (got.distance <= got.covered).all()


@pytest.mark.parametrize(("dims", "n"), [(1, 1), (20, 700), (64, 2000), (150, 10**6), (64, 1 << 62)])
def test_segments_hold_every_bit_once(dims, n):
    seen = sorted((s.word, b) for s in hamming.segments_of(dims, n) for b in range(s.shift, s.shift + s.width))
    assert seen == sorted((i // 64, 63 - i % 64) for i in range(dims))


def test_far_codes_and_repeats_are_met(spark):
    rng = np.random.default_rng(1)
    vecs = [*([[1.0] * 12] * 300), *([[-1.0] * 12] * 40), *rng.normal(size=(60, 12)).tolist()]
    df = spark.createDataFrame([(i if i < 390 else i - 380, v, 0) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, radius int")
    bits, ids = np.array(vecs) > 0, np.array([i if i < 390 else i - 380 for i in range(400)])
    got = hamming.top_k(df, 350, 100).toPandas()
    for q in (0, 100, 200, 300):
        want = sorted(zip((bits != bits[q]).sum(1).tolist(), ids.tolist(), strict=True))[:350]
        g = got[got.query_id == q].sort_values(["rank"])
        assert list(zip(g.distance, g.vec_id, strict=True)) == want
