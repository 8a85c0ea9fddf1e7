"""Cases that samples, runs of 20 characters and single blocks would miss."""

import math
import random

from pyspark.sql import functions as F

from sightline.llm import language, secrets, sharding

UPPER = "ABCDEFGHJKMNPQRSTUVWXYZ23456789"


def drawn(rng, n, letters=UPPER):
    return "".join(rng.choices(letters, k=n))


def test_rare_kinds_and_rates_come_from_all_texts(spark):
    """A kind in 1 of 2,000 texts; a symbol that no word at a multiple of 20 has."""
    rng = random.Random(8)
    rows = [(f"see AKIA{drawn(rng, 16)} there",) for _ in range(50)] + [("x " * 39 + "y+",)] * 5
    plain = spark.range(100_000).select(F.concat(F.lit("some plain words "), F.col("id").cast("string")).alias("text"))
    df = spark.createDataFrame(rows, "text string").union(plain)
    model = secrets.train(df)
    assert model["kinds"]["access"]["least"] == 10 and model["kinds"]["access"]["most"] == 40
    n = df.select(F.sum(F.length(F.regexp_replace("text", r"[^A-Za-z0-9+/=_-]", "")))).first()[0]
    assert math.isclose(math.exp(model["rates"]["+"]), 5 / n, rel_tol=1e-9)


def test_all_candidates_are_scored(spark):
    rng = random.Random(9)
    key = lambda: drawn(rng, 6, "0123456789ABCDEF") + "-" + drawn(rng, 5, "0123456789")
    access = lambda: f"AKIA{drawn(rng, 20)}"
    rows = [(i, f"then token = {key()}; and {access()} of plain words that say nothing at all") for i in range(300)]
    a, b = key(), access()[4:]
    made = {1000: f"see {a} there", 1001: f"auth={a}", 1002: f"at host/{a}.", 1003: f"{access()}/{a}", 1004: f"go to:{a}", 1005: f"the information of yesterday, {b[:4].lower()} and more"}
    model = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["spans"] for r in secrets.report(spark.createDataFrame(list(made.items()), "doc_id long, text string"), model).collect()}
    for i in range(1000, 1005):
        at = made[i].index(a)
        assert f"like_assign:{at}:{at + len(a)}" in got[i].split(","), (i, got[i])
    assert got[1005] == ""
    clean = secrets.redact(spark.createDataFrame(list(made.items()), "doc_id long, text string"), model).collect()
    assert not any(a in r["text"] for r in clean)


def test_long_strings_are_learned_and_scored_whole(spark):
    rng = random.Random(10)
    long = lambda n: drawn(rng, n, "0123456789ABCDEF")
    rows = [(i, f"then secret = {long(3000)}") for i in range(60)]
    model = secrets.train(spark.createDataFrame(rows + [(i, "plain words that say nothing at all " * 100) for i in range(100, 200)], "doc_id long, text string"))
    assert model["kinds"]["assign"]["most"] == 6000
    assert secrets.windows("x" * 512) == [("x" * 512, True)] and [(len(w), e) for w, e in secrets.windows("x" * 1000)] == [(512, False), (512, False), (488, True)]
    x = long(2999)
    assert secrets.added_spans(model, f"see {x} there", [], {}) == [(4, 3003, 3)]


def test_rare_and_many_languages_are_learned(spark):
    """One language has 5 of 60,005 rows and two thirds of the others are one text; 69 more fill over one mask."""
    words = lambda seed, n: (lambda r: [drawn(r, 6, "abcdefghijklmnopqrstuvwxyz") for _ in range(n)])(random.Random(seed))
    rng, few = random.Random(11), words("rare", 8)
    rare = [(" ".join(rng.choices(few, k=60)), "zz") for _ in range(5)]
    some = [(" ".join(rng.choices(words(i, 8), k=60)), f"l{i:02}") for i in range(69) for _ in range(2)]
    common = [(f"{' '.join(rng.choices(words('common', 40), k=8))} {i}", "en") for i in range(200)]
    df = spark.createDataFrame([*rare, *some], "text string, lang string")
    df = df.union(spark.createDataFrame(common, "text string, lang string").crossJoin(spark.range(300)).selectExpr("case when id < 200 then 'one copied text' else concat(text, ' x', id) end", "lang"))
    assert language.sample(df, 100).groupBy("lang").count().filter("lang in ('en', 'zz')").sort("lang").collect() == [("en", 100), ("zz", 5)]
    model = language.train(df)
    assert len(model.languages) == 71 and model.slots.shape[0] == 2
    tests = [(" ".join(rng.choices(few, k=30)), "zz")] + [(" ".join(rng.choices(words(i, 8), k=30)), f"l{i:02}") for i in (0, 68)]
    got = language.identify(spark.createDataFrame(tests, "text string, lang string"), model).collect()
    assert [(r["lang_pred"], r["score"] > 0.2) for r in got] == [(r["lang"], True) for r in got]


def test_a_second_run_edits_the_stored_map(spark, tmp_path):
    path, slots = f"file://{tmp_path}/map", 256
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    owners = lambda n: [r["owner"] for r in sharding.load_map(spark, n, path).sort("vslot").collect()]
    assert {r["map_version"] for r in sharding.assign(rows, 8, path, slots).collect()} == {1}
    assert {r["map_version"] for r in sharding.assign(rows, 8, path, slots).collect()} == {1}
    old = owners(1)
    grown = rows.union(spark.range(5000, 5400).select("id", F.repeat(F.lit("y"), 40)))
    out = sharding.assign(grown, 9, path, slots).collect()
    new = owners(2)
    assert owners(1) == old and {r["map_version"] for r in out} == {2} and all(r["shard"] == new[r["vslot"]] for r in out)
    # only what shards have above the mean moves: each keeps the mean or more
    moved, load = [i for i in range(slots) if old[i] != new[i]], [0] * 9
    for r in out:
        load[old[r["vslot"]]] += r["size"] * (old[r["vslot"]] == new[r["vslot"]])
    mean = sum(r["size"] for r in out) / 9
    assert moved and len(moved) < slots // 4 and all(old[i] < 8 for i in moved) and all(x >= mean for i, x in enumerate(load[:8]) if i in {old[m] for m in moved})
