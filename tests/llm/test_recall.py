"""Near-duplicates of the given documents against all pairs that share a shingle."""

import re
from collections import Counter, defaultdict

from sightline.llm import near_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_components_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    at, head = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            at[g].append(i)

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, s in sets.items():
        both = Counter(j for g in s for j in at[g] if j < i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    want = {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({c for _, c in want.values()}) < len(want)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.components(docs).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_very_long_texts_are_compared_whole(spark):
    words = [f"w{i}" for i in range(40_000)]
    texts = [" ".join(words), " ".join([*words[:39_000], "x", *words[39_000:]]), " ".join(words[:20_000]), "w " * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.components(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
