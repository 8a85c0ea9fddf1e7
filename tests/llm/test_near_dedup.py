import random

from sightline.llm import near_dedup

DOCS = "doc_id long, text string, extra int, node long"


def shingles(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = "".join(" " if c in " \t\n\v\f\r" else c for c in (text or "").translate(lower)).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r[0])
    return sorted(((r[0], len(sets[i]), min((x for x in groups[root(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=str)


def corpus(seed=3, bases=12, copies=14):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=30)
    for b in range(bases):
        base = rng.choices(vocabulary, k=rng.choice([6, 60, 120])) + (passage if b % 2 else [])
        for c in range(copies if b else 60):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append([len(rows), rng.choice([" ", "\n", "\t "]).join(words).title() if c % 3 else " ".join(words), 1, 7])
    return rows


def found(spark, rows, **how):
    out = near_dedup.components(spark.createDataFrame(rows, DOCS), **how)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)


def test_links_and_components_match_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_large_nodes_blocks_and_branches_lose_nothing(spark):
    rows = corpus(seed=5, bases=8)
    want = brute(rows)
    assert found(spark, rows, small=7, levels=2, block_sets=6) == want
    assert found(spark, rows, small=3, levels=1, block_sets=1000) == want


def test_sets_that_stay_apart_visit_in_parties(spark):
    """A shared passage makes one candidate group of texts that mostly don't link, over many blocks and parties."""
    rng, rows = random.Random(11), []
    passage = [f"p{i}" for i in range(80)]
    for b in range(40):
        base = passage + [f"b{b}x{i}" for i in range(24)]
        for _ in range(3):
            words = list(base)
            words[rng.randrange(len(words))] = f"n{rng.random()}"
            rows.append([len(rows), " ".join(words), 1, 7])
    rng.shuffle(rows)
    want = brute(rows)
    assert 1 < len({r[2] for r in want}) < len(rows)
    assert found(spark, rows, block_sets=5) == want


def test_nulls_empty_short_and_repeated_rows(spark):
    long = " ".join(f"x{i}" for i in range(40))
    rows = [[1, None, 1, 1], [2, "", 1, 1], [3, " \n", 1, 1], [4, "a b", 1, 1], [5, "A  b", 1, 1], [6, "a b c", 1, 1], [9, long, 1, 1], [9, long, 1, 1], [None, long, 1, 1], [7, "é É", 1, 1], [8, "É É", 1, 1]]
    assert found(spark, rows) == brute(rows)
    kept = near_dedup.deduplicated(spark.createDataFrame(rows, DOCS))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 6, 7, 8, 9]
    assert kept.columns == ["doc_id", "text", "extra", "node"]


def test_empty_table(spark):
    assert found(spark, []) == []
