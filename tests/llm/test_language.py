"""Language profiles against plain counting of n-grams."""

import random
import time
from collections import Counter, defaultdict

import numpy as np

from sightline.llm import language as la


def grams(text):
    low = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    low = " ".join(low.split())
    low = f" {low} " if low else ""
    for n in la.SIZES:
        for i in range(len(low) - n + 1):
            g = low[i : i + n]
            if " " not in g[1:-1] and g != "  " and g.strip():
                yield g


def plain(rows, least=3, share=0.6):
    counts = defaultdict(Counter)
    for text, lang in dict.fromkeys(rows):
        counts[lang].update(grams(text))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    most = Counter()
    for lang, c in counts.items():
        for g, n in c.items():
            most[g] = max(most[g], n / total[lang])
    return {lang: {g for g, n in c.items() if n >= least and n / total[lang] >= share * most[g]} for lang, c in counts.items()}


def test_votes_are_shares_of_plainly_counted_profiles(spark):
    rng = random.Random(1)
    stems = {lang: ["".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(60)] for lang, letters in (("en", "etaoinshr"), ("fr", "eéasnitr"), ("de", "enisrhatß"))}
    text = lambda lang: " ".join(rng.choices(stems[lang], k=50)) + rng.choice([".", ", 12", "!"])
    rows = [(text(lang), lang) for _ in range(80) for lang in stems]
    model = la.train(spark.createDataFrame([*rows, (None, "en"), ("x", None)], "text string, lang string"))
    profiles = plain(rows)
    assert model.languages == sorted(profiles)
    tests = [text(lang) for _ in range(20) for lang in stems] + ["", "12 34", "zzz qqq"]
    shares, letters = la.votes(model, tests)
    for t, got, has in zip(tests, shares, letters, strict=True):
        own = list(grams(t))
        want = [sum(g in profiles[lang] for g in own) / max(1, len(own)) for lang in model.languages]
        assert has == any(c.isalpha() for c in t) and np.allclose(got, want, atol=0.01)


def test_many_languages_are_learned_and_told_in_seconds(spark):
    rng = random.Random(2)
    stems = [["".join(chr(0x4E00 + (37 * lang + rng.randrange(30)) % 20_000) for _ in range(3)) for _ in range(12)] for lang in range(400)]
    rows = [(i, " ".join(rng.choices(stems[i % 400], k=25)), f"l{i % 400:03}") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    began = time.time()
    model = la.train(df.select("text", "lang"))
    got = la.identify(df, model).select("lang", "lang_pred").collect()
    assert len(model.languages) == 400 and time.time() - began < 60
    assert sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got)


def test_equal_votes_go_to_the_first_name(spark):
    rows = [("ab ab ab ab", lang) for lang in ("zz", "aa", "mm")]
    model = la.train(spark.createDataFrame(rows, "text string, lang string"))
    df = spark.createDataFrame([(1, "ab ab", "s", "t")], "doc_id long, text string, score string, lang_pred string")
    assert [r.lang_pred for r in la.identify(df, model).collect()] == ["aa"]
