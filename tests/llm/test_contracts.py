"""Operators against brute force on whole tables of documents, and cases that caps or single draws would miss."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import chat, hamming, language, mixing, near_dedup, packing, quality, sharding

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def words(text):
    for c in "\t\n\v\f\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_shards_hold_all_documents_with_their_sizes(spark, documents):
    out = sharding.assign(documents).toPandas().set_index("doc_id")
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    assert set(out.index) == set(texts) and len(out) == len(texts)
    assert all(out["size"][i] == len(t) + 16 and out.text_crc32[i] == zlib.crc32(t) for i, t in texts.items())
    loads = out.groupby("shard")["size"].sum()
    assert set(loads.index) == set(range(40)) and loads.max() - loads.min() <= max(out["size"])
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])


def test_packing_is_repeatable_and_pieces_rebuild_all_texts(spark, documents):
    runs = [packing.pack(documents.repartition(n), lengths=(64, 256), group=300, texts=True).toPandas() for n in (1, 1)]
    keys = list(runs[0].columns)
    assert runs[0].sort_values(keys, ignore_index=True).equals(runs[1].sort_values(keys, ignore_index=True))
    parts = defaultdict(list)
    for r in runs[0].itertuples():
        parts[r.doc_id].append((r.piece, r.text))
        assert len(words(r.text)) == r.n_tokens <= 256
    for r in documents.collect():
        assert "".join(t or "" for _, t in sorted(parts[r.doc_id])) == (r.text or "")
    full = runs[0][runs[0].bin.notna()].groupby(["bin_group", "bin"]).agg(n=("n_tokens", "sum"), size=("bin_size", "first"))
    assert (full.n <= full["size"]).all() and full.n.sum() / full["size"].sum() > 0.95


def test_equal_rows_meet_the_target(spark):
    rows = [(1, "w w w w", "a")] * 500 + [(i, "w " * 4, "b") for i in range(2, 502)] + [(i, "w " * 4, "c") for i in range(1000, 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.report(df).toPandas()
    assert len(out) == 1500
    for target, g in out.groupby("target"):
        assert abs(g.taken.sum() / target - 1) < 0.1
    again = mixing.report(df).toPandas()
    assert Counter(map(tuple, out.values.tolist())) == Counter(map(tuple, again.values.tolist()))


def test_mixing_draws_alike_however_rows_are_dealt(spark):
    digest = lambda i: hashlib.md5(f"mix-1:{i}:{hashlib.md5(b'w w w').hexdigest()}".encode()).hexdigest()
    # documents of one size class whose hashes begin alike, so all of them are in a few cells
    ids = [i for i in range(120_000) if digest(i)[:3] == "000"]
    assert len(ids) > 20 and len({digest(i)[:4] for i in ids}) < len(ids)
    rows = [(i, "w w w", s) for s in ("a", "b") for i in ids] + [(i, "w w w", "c") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, other = (sorted(map(tuple, mixing.copies(d).select("source", "doc_id", "copies").collect())) for d in (df.coalesce(1), df.repartition(9).orderBy(F.desc("doc_id"))))
    assert one == other
    for s in ("a", "b"):
        drawn = {i: c for t, i, c in one if t == s}
        order = [drawn[i] for i in sorted(ids, key=digest)]
        assert order == sorted(order, reverse=True)


@pytest.mark.parametrize("dims", [20, 64, 150])
def test_search_equals_brute_force_for_any_dimensions(spark, dims):
    rng = np.random.default_rng(dims)
    vecs = rng.normal(size=(700, dims)).astype(np.float32)
    vecs[5:60] = vecs[0]
    vecs[100, : dims - 3] = vecs[101, : dims - 3]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vecs)] + [(3, vecs[3].tolist(), "x")], "vec_id long, embedding array<float>, code string")
    out = hamming.top_k(df, 7, 100).toPandas()
    ids = np.array([*range(700), 3])
    bits = np.vstack([vecs, vecs[3:4]]) > 0
    for q in range(0, 700, 100):
        want = sorted(zip((bits != bits[q]).sum(1).tolist(), ids.tolist(), strict=True))[:7]
        got = out[out.query_id == q].sort_values("rank")
        assert list(zip(got.distance, got.vec_id, strict=True)) == want
    assert hamming.top_k(df.limit(0)).count() == 0


def test_languages_and_quality_are_right_on_held_out_documents(spark, documents):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    got = {r.doc_id: r for r in language.predictions(documents).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang]
    assert len(got) == documents.count() and len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.98
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    scored = quality.predictions(documents, labels).toPandas().set_index("doc_id")
    assert len(scored) == len(got) and scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.3)).all()
    y = labels.toPandas().set_index("doc_id").quality
    y = y[[i for i in y.index if zlib.crc32(str(i).encode()) % 5 == 0]]
    good, bad = scored.score[y.index[y == 1]].to_numpy(), scored.score[y.index[y == 0]].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95


def test_predictions_take_odd_rows(spark):
    rows = [(1, None, None, 5), (2, "", "en", 5), (3, "12 34", None, 5), (4, "the house and the garden " * 20_000, "en", 5), (5, "the house", "en", 5), (5, "the house", "en", 5), (None, "the garden", "fr", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = language.predictions(df).toPandas()
    assert len(got) == 7 and set(got.lang_pred[got.doc_id.isin([1, 2, 3])]) == {"und"} and got.score.between(0, 1).all()
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    scored = quality.predictions(df, labels).toPandas()
    assert len(scored) == 7 and scored.score.between(0, 1).all()
    for f in (lambda d: language.predictions(d), lambda d: quality.predictions(d, labels.limit(0))):
        assert f(df.limit(0)).count() == 0


def test_deduplication_keeps_a_fixed_row_of_rows_that_differ_elsewhere(spark):
    rows = [(1, "a b c d e f", f"s{i}") for i in range(20)]
    kept = {near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)).first().source for n in (1, 3, 7)}
    assert len(kept) == 1


def test_chat_takes_empty_tables_and_very_long_texts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x" * 400_000), (2, 0, "user", "x" * 400_000), (2, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_turns) for r in chat.render(turns).collect()] == [(2, 2)]
    assert chat.render(turns.limit(0)).count() == 0


def test_a_stored_map_is_not_overwritten(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    sharding.save_map(spark, [0, 1], 1, path)
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.save_map(spark, [1, 0], 1, path)
    assert sharding.load_map(spark, 1, path).filter(F.col("vslot") == 0).first().owner == 0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_a_third_of_equal_rows_spreads_over_shards_and_meets_targets(spark, parts):
    rows = [(1, "w w w", "a")] * 1000 + [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(2, 2002)] + [(None, None, "b")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    out = sharding.assign(df, 40).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(out) == len(rows) and len(loads) == 40 and loads.max() - loads.min() <= 2 * out["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    drawn = Counter(map(tuple, mixing.report(df).collect()))
    again = Counter(map(tuple, mixing.report(spark.createDataFrame(rows, df.schema).repartition(5)).collect()))
    assert drawn == again and sum(drawn.values()) == len(rows)


def test_rows_that_come_once_keep_their_slots(spark):
    rows = [(i, f"t{i}") for i in range(300)]
    one, other = ({r.doc_id: r.vslot for r in sharding.sized(spark.createDataFrame(x, "doc_id long, text string").repartition(n)).filter("doc_id < 300").collect()} for x, n in ((rows, 1), ([*rows, (900, "u"), (900, "u")], 6)))
    assert one == other


def test_chat_keeps_null_and_empty_ids_apart(spark):
    turns = [("", 0, "user", "a"), ("", 1, "assistant", "b"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), ("x", 0, "user", "a")]
    got = chat.render(spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns, r.n_snapshots) for r in got] == [("", 2, 2)]
    other = chat.render(spark.createDataFrame([*turns, (None, 2, "user", "c")], "conv_id string, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns, r.n_snapshots) for r in other] == [(None, 3, 1)]
