"""Secret scans against plain versions and planted credentials."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sightline.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain(text):
    """Base spans by the letter of the contract."""
    text, found = text or "", []
    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    return [f"{names[k]}:{a}:{b}" for a, k, b in sorted(found)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_base_spans_equal_a_plain_scan_of_all_documents(documents):
    rows = {r.doc_id: r for r in secrets.report(documents).collect()}
    texts = documents.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r in texts:
        want, got = plain(r.text), rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(got.spans.split(","))


def test_formats_are_learned_and_planted_credentials_found(spark, documents):
    """Among all documents: labelled credentials of three formats, then bare ones held out and strings that only look alike."""
    rng = random.Random(12)
    draw = lambda n, letters: "".join(rng.choices(letters, k=n))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"
    formats = (lambda: "ghx_" + draw(30, upper + lower), lambda: draw(8, lower) + "-" + draw(4, "0123456789"), lambda: draw(18, "0123456789abcdef"))
    known = [(10_000_000 + i, f"some text with token = {formats[i % 3]()} and more") for i in range(300)]
    held = [formats[i % 3]() for i in range(300)]
    found = [(20_000_000 + i, f"see {s}, it says") for i, s in enumerate(held)]
    clean = [draw(30, upper + lower), draw(12, "0123456789abcdef"), "ghx_short", "information", "1234-12345678", "2024-01-31"]
    other = [(30_000_000 + i, f"see {s}, it says") for i, s in enumerate(clean * 20)]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame([*known, *found, *other], "doc_id long, text string"))
    model = secrets.train(df)
    assert all(len(m["automaton"]) > 1 for m in model["kinds"].values())
    got = {r.doc_id: r.spans for r in secrets.report(df, model).collect()}
    hits = sum(got[i] == f"like_assign:4:{4 + len(s)}" for i, s in zip(range(20_000_000, 20_000_300), held, strict=True))
    false = sum("like_" in spans for i, spans in got.items() if i < 10_000_000 or i >= 30_000_000)
    assert hits >= 0.95 * len(held), hits
    assert false <= 0.05 * hits, false


def test_spans_do_not_depend_on_partitions(spark, documents):
    one = {r.doc_id: r.spans for r in secrets.report(documents.coalesce(1)).collect()}
    many = {r.doc_id: r.spans for r in secrets.report(documents.repartition(60)).collect()}
    assert one == many


def test_lengths_and_prefixes_are_kept():
    rng = random.Random(13)
    draw = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    a = secrets.infer([draw(rng.choice((18, 40))) for _ in range(400)])
    good, bad = [draw(18), draw(40)], [draw(25), draw(39), draw(60), "x" * 40]
    assert len(a) == 41
    assert min(secrets.log_likelihood(a, s) for s in good) > max(secrets.log_likelihood(a, s) for s in bad) + 0.2
    b = secrets.infer(["AK" + draw(6).upper() for _ in range(200)])
    assert secrets.log_likelihood(b, "AK0123AB") > secrets.log_likelihood(b, "ZZ0123AB") + 1


def test_repeats_empty_tables_long_texts_and_clashing_columns(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "a"), (3, "x" * 300_000 + " token=abcdef1 ", "a"), (3, "token=abcdef1", "a"), (None, "token: 'qwerty9", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("n_chars", F.length("text"))
    out = sorted((str(r.doc_id), r.n_assign) for r in secrets.report(df).collect())
    assert out == [("1", 0), ("1", 0), ("2", 0), ("3", 1), ("3", 1), ("None", 1)]
    clean = secrets.redact(df)
    assert clean.columns == df.columns and {r.spans for r in clean.collect()} == {"a", "b"}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.report(none).count() == 0 and secrets.redact(none).count() == 0


def test_states_of_varied_lengths_merge_and_longer_credentials_are_found(spark, documents):
    rng = random.Random(14)
    draw = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    # ends are as likely after any character from the 21st on, so states beyond it can be one
    rows = [(i, f"words and token = {draw(20 + int(rng.expovariate(1 / 30)))} more words") for i in range(900)]
    long, short = draw(200), draw(14)
    rows += [(1000, f"see {long} there"), (1001, f"see {short} there"), (1002, "plain words stay as they are, information-technology and so on")]
    found = spark.createDataFrame([(i + 10_000_000, t) for i, t in rows], "doc_id long, text string")
    model = secrets.train(documents.select("doc_id", "text").unionByName(found))
    assert len(model["kinds"]["assign"]["automaton"]) < model["kinds"]["assign"]["tree"]
    got = {r.doc_id - 10_000_000: r.spans for r in secrets.report(found, model).collect()}
    assert got[1000] == "like_assign:4:204" and got[1002] == ""


def test_stopping_early_leaves_no_part_out():
    rng = random.Random(15)
    draw = lambda n, of="abcdef0123456789": "".join(rng.choices(of, k=n))
    strings = [draw(rng.randrange(16, 50)) for _ in range(300)] + ["ab_" + draw(20, "ABCDEFGH123") for _ in range(300)]
    automaton = secrets.infer(strings)
    floor = sorted(secrets.log_likelihood(automaton, s) for s in strings)[6] - 0.1
    gain = max(p + max([other, *seen.values()]) for steps in automaton.values() for _, p, seen, other in steps.values())
    rates = {c: -2.0 for c in "dhlHU"}
    kind = {"automaton": automaton, "floor": floor}
    tokens = ["=".join(rng.choice([draw(rng.randrange(1, 60)), "ab_" + draw(rng.randrange(10, 30), "ABCDEFGH123"), "word", "x.y"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    skip = secrets.hopeless({"kinds": {"assign": {**kind, "gain": gain}}})
    words = [draw(rng.randrange(1, 12), rng.choice(["abcxyz", "ABCXYZ", "abcABC", "0123456789", "ghijk"])) + rng.choice(["", ".", ".."]) for _ in range(300)]
    assert any(map(skip, words)) and not all(map(skip, words))
    for t in [*tokens, *words]:
        assert not skip(t) or not secrets.likely({"rates": rates, "kinds": {"assign": {**kind, "gain": gain}}}, t)
        never = {"rates": rates, "kinds": {"assign": {**kind, "gain": 1e9}}}
        assert secrets.likely({"rates": rates, "kinds": {"assign": {**kind, "gain": gain}}}, t) == secrets.likely(never, t)
