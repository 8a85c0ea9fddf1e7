"""Near-duplicate detection by a chosen-path set similarity join.

A text is the set of its five-word shingles. Independent trees branch the sets by minwise tokens: at the root a set
goes to the node of one minwise token a tree, and nodes with many sets are branched again, each set choosing a few
further tokens. Sets of a small node are compared exhaustively, by MinHash signatures, with a margin. That leaves candidate
groups, whose texts are shipped once and compared exactly, on full sets. Only links between sets that are not yet
connected are looked for, so a group of copies never becomes all its pairs.

Sets are named by a 64-bit hash of their shingles, and shingles by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import python_workers, written

WORDS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair at the threshold meets at the root of a tree with probability 0.75, so ten trees miss one pair in a million.
TREES = 10
#: Branches that a set chooses in a node that is too large: with three, pairs at the threshold get through any number of levels with probability 0.98.
BRANCHES = 3
#: Sets of a node that are compared exhaustively.
SMALL = 4096
#: Levels of branching; nodes that are still too large then are compared in blocks, all pairs of blocks.
LEVELS = 4
SIGNATURE = 128
#: Share of equal signature positions from which two sets are candidates: 6 standard deviations below the threshold.
CANDIDATE = 0.5
#: Texts of a candidate group that are compared in one task, and their shingles.
BLOCK_SETS, BLOCK_SHINGLES = 4000, 3_000_000
#: Shingles that are hashed at once.
CHUNK = 1 << 16

_odd = np.random.default_rng(20).integers(0, 1 << 62, TREES + SIGNATURE + WORDS + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_mults, _word_mults = _odd[: TREES + SIGNATURE], _odd[TREES + SIGNATURE :]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text: words are split at ASCII white space after A-Z are lowered."""
    words = text.lower().split()
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - WORDS + 1) if len(w) else 0
    h = np.full(n, min(len(w), WORDS), np.uint64)
    for i in range(min(WORDS, len(w))):
        h = h + w[i : i + n] * _word_mults[i]
    return np.unique(_mix(h))


def set_hash(s: np.ndarray) -> int:
    """A signed hash of a whole set, whatever the order."""
    total = np.array([_mix(s * _word_mults[WORDS]).sum(dtype=np.uint64)], np.uint64) + np.array([len(s)], np.uint64) * _word_mults[WORDS + 1]
    return int(_mix(total).view(np.int64)[0])


SIGNED = "doc_id long, text_key long, n_shingles long, node long, roots array<long>, sig binary"


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, node, roots, sig of each row; node, roots and sig are null where the set is empty."""
    python_workers(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            at, rows = 0, len(texts)
            while at < rows:
                sets, held, start = [], 0, at
                while at < rows and held < CHUNK:
                    value = texts[at].as_py()
                    sets.append(shingle_set((value or "").encode("utf-8", "surrogatepass")))
                    held += len(sets[-1])
                    at += 1
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                least = np.zeros((len(_mults), len(full)), np.uint64)
                if len(full):
                    flat, cuts = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for i, m in enumerate(_mults):
                        least[i] = np.minimum.reduceat(flat * m, cuts)
                of = dict(zip(full.tolist(), range(len(full)), strict=True))
                roots, sig = least[:TREES].view(np.int64).T, np.ascontiguousarray((least[TREES:] ^ (least[TREES:] >> np.uint64(47))).astype(np.uint16).T)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, at - start), batch.column("text_key").slice(start, at - start), pa.array(sizes, pa.int64()),
                        pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([roots[of[i]] if i in of else None for i in range(len(sets))], pa.list_(pa.int64())),
                        pa.array([sig[of[i]].tobytes() if i in of else None for i in range(len(sets))], pa.binary()),
                    ],
                    ["doc_id", "text_key", "n_shingles", "node", "roots", "sig"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(sign, SIGNED)


def groups_of(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pd.DataFrame]:
    """Rows with equal keys, from batches in which they follow each other."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        pdf = batch.to_pandas()
        if not len(pdf):
            continue
        k = pdf[list(keys)].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(pdf)]
        if held and (held[-1][list(keys)].to_numpy()[-1] != k[0]).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(pdf.iloc[a:b])
            if b < len(pdf):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def by_group(df: DataFrame, keys: list[str], f: Callable[[Iterator[pd.DataFrame]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over the groups of df, one after another in each task."""
    python_workers(df.sparkSession)
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda batches: f(groups_of(batches, *keys)), schema)


def agreement(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sig == one).mean(1)


def _edge_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _candidates(node: np.ndarray, n: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """A label per set, equal where candidate links connect. Only sets with other labels are compared, so a group of
    copies costs about one comparison each."""
    label, few = np.arange(len(node)), np.ascontiguousarray(sig[:, :32])
    for i in range(len(node) - 1):
        at = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        at = at[100 * np.minimum(n[at], n[i]) >= PERCENT * np.maximum(n[at], n[i])]
        at = at[(few[at] == few[i]).sum(1) >= 6]
        at = at[(agreement(sig[at], sig[i]) >= CANDIDATE) | (node[at] == node[i])]
        for x in np.unique(label[at]):
            label[label == x] = label[i]
    return label


def _stars(node: np.ndarray, label: np.ndarray) -> tuple[list[int], list[int]]:
    """Links from the least node of each label to its others."""
    pdf = pd.DataFrame({"node": node, "least": pd.Series(node).groupby(label).transform("min").to_numpy()})
    pdf = pdf[pdf["node"] != pdf["least"]]
    return pdf["least"].tolist(), pdf["node"].tolist()


def _signature(g: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(g), SIGNATURE)


def _exhaustive(groups: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    """Candidate links of small nodes: stars over what signatures connect."""
    a: list[int] = []
    b: list[int] = []
    for g in groups:
        node, n = g["node"].to_numpy(), g["n_shingles"].to_numpy()
        if len(node) < 2 or len(node) == 2 and 100 * n.min() < PERCENT * n.max():
            continue
        sig = _signature(g)
        if len(node) > 2:
            x, y = _stars(node, _candidates(node, n, sig))
            a += x
            b += y
        elif node[0] != node[1] and (sig[0] == sig[1]).mean() >= CANDIDATE:
            a.append(int(node[0]))
            b.append(int(node[1]))
        if len(a) >= 20_000:
            yield _edge_batch(a, b)
            a, b = [], []
    yield _edge_batch(a, b)


def _with_sizes(members: DataFrame, name: str) -> DataFrame:
    """key, node with m, the members of the key's node, for nodes of two or more."""
    members = written(members, f"{name}-members")
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    return written(members.join(counts, "key"), f"{name}-nodes")


def candidate_links(sets: DataFrame, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """a, b: links that connect all sets which may be similar. sets: node, n_shingles, roots, sig, one row per set."""
    narrow = sets.select("node", "n_shingles", "sig")
    links = None
    members = sets.select("node", F.posexplode("roots").alias("tree", "root")).select(F.xxhash64("tree", "root").alias("key"), "node")
    for level in range(levels + 1):
        nodes = _with_sizes(members, f"op2-level{level}")
        found = by_group(nodes.filter(F.col("m") <= small).select("key", "node").join(narrow, "node"), ["key"], _exhaustive, "a long, b long")
        large = nodes.filter(F.col("m") > small)
        more = not large.isEmpty()
        if more and level == levels:
            found = found.unionByName(_in_blocks(large.join(narrow, "node"), small))
        elif more:
            stars, left = _large(large.join(narrow, "node"), small, level)
            found = found.unionByName(stars)
            pos = lambda j: F.pmod(F.xxhash64("key", F.lit(j)), F.lit(SIGNATURE)).cast("int")
            token = lambda p: F.substring("sig", 2 * p + 1, F.lit(2))
            members = left.select("node", F.explode(F.array(*[F.xxhash64("key", F.lit(j), token(pos(j))) for j in range(BRANCHES)])).alias("key")).select("key", "node").distinct()
        found = written(found, f"op2-links{level}")
        links = found if links is None else links.unionByName(found)
        if not more:
            break
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large(rows: DataFrame, small: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Candidate links (a, b) of large nodes, and the rows (key, node, sig) that must be branched further.

    A node is dealt to parts of about ``small`` sets, and its pivot, the least set, goes to all of them. A node that is
    one group of near-copies is connected to the pivot but for a few sets, which then visit all other parts: this
    completes the node. Other nodes are branched.
    """
    pivots = rows.groupBy("key").agg(F.min("node").alias("pivot"))
    dealt = rows.join(pivots, "key").withColumn("parts", F.ceil(F.col("m") / small).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = written(dealt, f"op2-parts{level}")
    cols = ["key", "pivot", "node", "n_shingles", "sig"]
    elsewhere = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part"))).alias("part")

    def beside(groups: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for g in groups:
            node, pivot = g["node"].to_numpy(), int(g["pivot"].iloc[0])
            label = _candidates(node, g["n_shingles"].to_numpy(), _signature(g))
            apart = node[label != label[node == pivot][0]]
            a, b = _stars(node, label)
            key = np.full(len(a) + len(apart), g["key"].iloc[0], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a + [None] * len(apart), pa.int64()), pa.array(b + [None] * len(apart), pa.int64()), pa.array([None] * len(a) + apart.tolist(), pa.int64())], ["key", "a", "b", "node"])

    homes = dealt.select(*cols, "part")
    done = written(by_group(homes.unionByName(dealt.filter("node = pivot and parts > 1").select(*cols, elsewhere)), ["key", "part"], beside, "key long, a long, b long, node long"), f"op2-beside{level}")
    apart = done.filter("node is not null").select("key", "node")
    n_apart = apart.groupBy("key").agg(F.count(F.lit(1)).alias("n_apart"))
    judged = dealt.select("key", "m", "parts").distinct().join(n_apart, "key").withColumn("visit", F.col("n_apart") * F.col("parts") <= 4 * F.col("m"))
    visited = judged.filter("visit").select("key")
    guests = dealt.join(apart, ["key", "node"], "left_semi").join(visited, "key", "left_semi").select(*cols, elsewhere)
    across = by_group(homes.join(visited, "key", "left_semi").unionByName(guests), ["key", "part"], _exhaustive, "a long, b long")
    return done.filter("a is not null").select("a", "b").unionByName(across), dealt.join(judged.filter("not visit").select("key"), "key", "left_semi").select("key", "node", "sig")


def _in_blocks(rows: DataFrame, small: int) -> DataFrame:
    """Candidate links of nodes that further tokens did not divide: all pairs of blocks of the node."""
    parts = F.ceil(F.col("m") / (2 * small)).cast("int")
    of = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    pairs = of.select("key", "node", "n_shingles", "sig", "part", other)
    return by_group(pairs.select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "node", "n_shingles", "sig"), ["key", "x", "y"], _exhaustive, "a long, b long")


def connected(links: DataFrame, name: str) -> DataFrame:
    """node, label: the least node reachable over links (a, b), for nodes that have a link.

    Rounds of contraction: each node takes the least of itself and its neighbours, and links are kept between what
    remains, fewer in each round.
    """
    links = written(links.filter("a != b"), f"{name}-links")
    labels, turn = None, 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-up{turn}")
        if labels is None:
            labels = up
        else:
            moved = labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = written(moved, f"{name}-labels{turn}")
        at = lambda c: up.select(F.col("node").alias(c), F.col("label").alias(f"{c}_to"))  # noqa: E731, B023
        moved = links.join(at("a"), "a").join(at("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        links = written(moved.filter("a != b").distinct(), f"{name}-links{turn}")
        turn += 1
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as sorted distinct hashes, link."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _read_sets(g: pd.DataFrame) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Distinct sets of a block: node, set and signature; rows whose text gives another set than the row says are left out."""
    nodes, sets, sigs = [], [], []
    for node, text, sig in zip(g["node"], g["text"], g["sig"], strict=True):
        if node in nodes[-1:]:
            continue
        s = shingle_set(text.encode("utf-8", "surrogatepass"))
        if set_hash(s) == node:
            nodes.append(int(node))
            sets.append(s)
            sigs.append(np.frombuffer(sig, np.uint16))
    return nodes, sets, np.array(sigs, np.uint16).reshape(len(sigs), -1)


def _verify(groups: Iterator[pd.DataFrame], visits: bool = False) -> Iterator[pa.RecordBatch]:
    """Exact links that connect what is linked in a block. Guests (of other blocks) are compared with residents alone;
    with ``visits`` residents meet guests alone, as they have met each other before.

    Rows come with ``base``, which is equal for sets that are known to be connected. Pairs that look close are tried first.
    """
    for g in groups:
        g = g.sort_values(["guest", "node"], kind="stable")
        base_of = dict(zip(g["node"], g["base"], strict=True))
        guest_of = dict(zip(g["node"][::-1], g["guest"][::-1], strict=True))
        nodes, sets, sigs = _read_sets(g)
        _, label = np.unique([base_of[x] for x in nodes], return_inverse=True)
        guests, sizes = np.array([guest_of[x] for x in nodes], bool), np.array([len(s) for s in sets])
        a: list[int] = []
        b: list[int] = []
        for least, most in ((0.85, 1.1), (CANDIDATE, 0.85)):
            for i in range(len(nodes) - 1):
                at = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
                at = at[(100 * np.minimum(sizes[at], sizes[i]) >= PERCENT * np.maximum(sizes[at], sizes[i])) & (guests[i] != guests[at] if visits else ~(guests[i] & guests[at]))]
                near = agreement(sigs[at], sigs[i])
                for x in at[(near >= least) & (near < most)].tolist():
                    if label[x] != label[i] and similar(sets[i], sets[x]):
                        label[label == label[x]] = label[i]
                        a.append(nodes[i])
                        b.append(nodes[x])
        yield _edge_batch(a, b)


def exact_links(docs: DataFrame, sets: DataFrame, groups: DataFrame, block_sets: int = BLOCK_SETS) -> DataFrame:
    """a, b: links on full sets that connect exactly what is linked within each candidate group.

    A group that is too large for a task is dealt to blocks, each with the group's least set as a guest. Sets that this
    leaves unconnected to that one then visit all other blocks of the group, in parties that are bounded as blocks are:
    a task holds one block and one party.
    """
    need = F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    of = groups.join(sets.select("node", "n_shingles", "doc_id", "text_key", "sig"), "node")
    sizes = of.groupBy("label").agg(need.alias("blocks"))
    keyed = written(of.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "op2-candidates")
    row = ["label", "node", "sig", "text"]

    def with_text(some: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").alias("_id"), F.col("text"), F.xxhash64("text").alias("_key")).filter("text is not null")
        return some.join(texts, (some["text_key"] == texts["_key"]) & some["doc_id"].eqNullSafe(texts["_id"])).drop("_id", "_key")

    def sent(some: DataFrame, guests: DataFrame) -> DataFrame:
        """Every set to its own block, once for each party of guests, and guests to all other blocks of their groups."""
        to = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))).alias("block")
        party = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parties")).cast("int").alias("party")
        visits = guests.filter("blocks > 1").select("label", "node", "sig", "doc_id", "text_key", "base", to, party, F.lit(1).alias("guest"))
        met = F.explode(F.sequence(F.lit(0), F.col("parties") - 1)).alias("party")
        home = some.select("label", "node", "sig", "doc_id", "text_key", "base", "block", met, F.lit(0).alias("guest"))
        return with_text(home.unionByName(visits)).select(*row, "base", "block", "party", "guest")

    keys = ["label", "block", "party"]
    alone = keyed.withColumn("base", F.col("node")).withColumn("parties", F.lit(1))
    first = written(by_group(sent(alone, alone.filter("node = label")), keys, _verify, "a long, b long"), "op2-exact")
    split = keyed.filter("blocks > 1")
    if split.isEmpty():
        return first
    known = connected(first, "op2-within").withColumnRenamed("label", "base")
    based = written(split.join(known, "node", "left").withColumn("base", F.coalesce("base", "node")), "op2-split")
    pivot = based.filter("node = label").select("label", F.col("base").alias("main")).distinct()
    apart = written(based.join(pivot, "label").filter("base != main").drop("main"), "op2-apart")
    if apart.isEmpty():
        return first
    parties = apart.groupBy("label").agg(need.alias("parties"))
    second = by_group(sent(based.join(parties, "label"), apart.join(parties, "label")), keys, lambda groups: _verify(groups, visits=True), "a long, b long")
    return first.unionByName(written(second, "op2-across"))


def _repeats(rows: DataFrame) -> bool:
    """Whether rows are equal in doc_id and text."""
    return not rows.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty()


def components(docs: DataFrame, small: int = SMALL, levels: int = LEVELS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_key, label.

    Documents whose sets have a Jaccard similarity of 0.75 or more are linked, components are what links reach, and
    component_id is the least doc_id of a component. Texts with fewer than five words are one shingle; null texts and
    texts without words have no shingles, are linked with nothing and are components of their own. Texts of any length are
    compared whole; a similarity of exactly 0.75 links. Equal rows are
    rows of their own in one component; a null doc_id never names a component unless all its ids are null. An empty
    table gives an empty result; extra columns are ignored. text_key hashes the text; label names the component, null
    without words.
    """
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs), "op2-signatures")
    if _repeats(signed):
        docs = docs.dropDuplicates(["doc_id", "text"])
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    sets = written(
        signed.filter("node is not null").groupBy("node").agg(one.alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("roots").alias("roots"), F.first("sig").alias("sig")).select("node", "n_shingles", "roots", "sig", "one.doc_id", "one.text_key"),
        "op2-sets",
    )
    groups = connected(candidate_links(sets, small, levels), "op2-groups")
    links = exact_links(docs, sets, groups, block_sets)
    labels = connected(links, "op2-components")
    ids = sets.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = written(ids.join(least, "label").select("node", "label", "component_id"), "op2-named")
    with_set = signed.select("doc_id", "n_shingles", "text_key", "node").join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return with_set.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "text_key", "label")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each component: that of the least doc_id, null last, and of its least text hash.

    Rows without words all stay. Of rows that are equal in doc_id and text one stays, that of the least hash. Columns keep their values, whatever
    their names.
    """
    found = written(components(docs), "op2-components")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best")
    kept = found.filter("label is not null").groupBy("label").agg(best).select("best.doc_id", "best.text_key")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", F.xxhash64("text").alias("_key"))
    no_words = found.filter("label is null").select("doc_id", "text_key")
    stay = written(kept.unionByName(no_words).distinct(), "op2-stay").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_stay"))
    out = rows.join(stay, (F.col("_key") == F.col("_stay")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    if _repeats(found):
        # of rows that differ in other columns alone the one with the least hash
        out = out.groupBy("doc_id", "_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return out.select("_row.*")
