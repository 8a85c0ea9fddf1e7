"""The license scan against a plain version that compares every block with every template."""

import random
import re

from sightline.llm import licenses as li

LOW = str.maketrans(li.UPPER, li.LOWER)


def plain(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))
    hits = [(i, label) for p, label in li.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    added, best = set(), 0.0
    for label, t in li.TEMPLATES:
        own = set(li.template_words(t))
        half = li.half_block(len(li.template_words(t)))
        for b in range(0, len(w) + 1, half):
            n = len(own & set(w[b : b + 2 * half]))
            if 100 * n >= li.PERCENT * len(own):
                added.add(label)
                best = max(best, n / len(own))
    at, base = [i for i, _ in hits], {x for _, x in hits}
    return (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | added)), 1.0 if hits else best)


def test_scan_equals_all_blocks_against_all_templates(spark):
    rng = random.Random(5)
    vocab = ["the", "of", "license", "version", "under", "to", "software", "free", "water", "été", "house", "2", "0", "mit", "cc", "by", "public", "gnu"]
    filler = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [filler(rng.randrange(0, 300)) for _ in range(60)]
    for label, t in li.TEMPLATES:
        w = li.template_words(t)
        for drop in (0, 1, 3):
            kept = [x for i, x in enumerate(w) if i not in set(rng.sample(range(len(w)), min(drop, len(w) - 1)))]
            texts.append(f"{filler(rng.randrange(90))}\n{' , '.join(kept).upper()}. {filler(rng.randrange(90))}")
    texts += ["Apache License apache  license", "xmit license", "mit licensed", "é mit\x00License!", "😀 CC-BY 😀", "gnu general public gnu general public license", "", None, "a " * 200_000 + "MIT license " + "b " * 200_000]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1, 2)] * 3 + [(None, "The MIT license", "x", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, words int, half int")
    got = sorted((tuple(r) for r in li.scan(df.repartition(3)).collect()), key=str)
    assert got == sorted(((r[0], *plain(r[1])) for r in rows), key=str)
    assert any(g[6] for g in got if not g[5]) and li.scan(df.limit(0)).count() == 0


def test_every_notice_is_found_under_its_label(spark):
    rows = [(i, f"water house {t} house water") for i, (_, t) in enumerate(li.TEMPLATES)]
    got = {r.doc_id: r.labels.split(",") for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(li.TEMPLATES))
