"""Collocations against plain counting of all n-grams."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from sightline.llm import collocations as co

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, top):
    f = defaultdict(Counter)
    for _, text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        n = sum(a for p, a in c.items() if len(p) == 1)
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(a, inside.get(p[i : i + m], 0))
        rows = []
        for p, a in found.items():
            if 100 * inside.get(p, 0) >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, left, right))
        for rank, (s, _, p, a, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), a, left, right, n, -s))
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    vocab = [*"abcdefgh", "É", "éa", "\x00", "日本"]
    line = lambda: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n\n", "\r"]) for _ in range(rng.randrange(1, 60)))
    passage = "the Quick brown fox jumps over THE lazy dog and runs, far away"
    rows = [(i, line(), rng.choice(["en", "fr", None, "und"])) for i in range(150)]
    rows += [(500 + i, line() + passage + line(), "en") for i in range(40)] + [(1, passage, "fr")] * 25
    rows += [(700, None, "en"), (701, "", None), (702, " .,\t\n", "de"), (None, "a b a b a b", "en"), (703, "a " * 30_000, "es"), (704, "x y z q " * 9000, "es")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "l") for r in rows], "doc_id long, text string, lang string, phrase string, n long, chunk string")


@pytest.mark.parametrize("parts", [1, 5])
def test_collocations_equal_plain_counts(spark, docs, parts):
    for least, top in ((4, 50), (2, 100_000)):
        got = sorted(tuple(r) for r in co.collocations(frame(spark, docs).repartition(parts), least, top).collect())
        assert got == plain(docs, least, top)


def test_ties_in_score_and_count_go_by_bytes(spark):
    rows = [(i, f"{a} {b}.", "en") for i in range(30) for a, b in (("b", "c"), ("é", "z"), ("Z", "y"), ("a", "x"))]
    got = [(r.rank, r.phrase) for r in co.collocations(frame(spark, rows)).sort("rank").collect()]
    assert got == [(1, "a x"), (2, "b c"), (3, "z y"), (4, "é z")]


def test_empty_tables(spark, docs):
    assert co.collocations(frame(spark, docs).limit(0)).count() == 0
    assert co.collocations(frame(spark, docs[-3:-2])).count() == 0


def test_chunks_own_every_token_once_and_cut_by_content():
    rng = random.Random(4)
    passage = [f"w{rng.randrange(500)}" for _ in range(3000)]
    texts = [" ".join(passage), " ".join(["x", "y", *passage, "z"]), "a " * 20_000]
    owner, chunks, own, words = co.parse(pa.array(texts))
    for i, t in enumerate(texts):
        assert own[owner == i].sum() == words[owner == i].sum() == len(t.split())
    one, two = ({c for c, o in zip(chunks.to_pylist(), owner, strict=True) if o == i} for i in (0, 1))
    # all but the first and the last chunk are found again where the passage stands elsewhere
    assert len(one & two) >= len(one) - 2 > 20 and own.max() <= co.MOST


def test_texts_are_parsed_in_runs_of_bounded_bytes():
    """A batch of many texts is not parsed at once, and its chunks are those of each text."""
    texts = ["", *(f"some words of text {i}, and more of them; " * 200 for i in range(1000)), "word " * co.PARSED, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    runs = [[len(t) for t in r.column("text").to_pylist()] for r in co._bounded(iter([batch]))]
    assert [n for r in runs for n in r] == [len(t) for t in texts]
    assert all(sum(r) < co.PARSED + max(r) for r in runs) and len(runs) > 3
    got = [c for b in co._chunks(iter([batch])) for c in b.column("chunk").to_pylist()]
    assert got == [c for t in texts for c in co.parse(pa.array([t]))[1].to_pylist()]
