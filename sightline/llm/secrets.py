"""Secret scans by grammar inference.

Three plain patterns find credentials in all texts and label them. From a bounded sample of those, a prefix tree is built
for each kind, and states whose frequencies agree within a Hoeffding bound, and whose strings may go on equally long, are
merged into a probabilistic automaton. Its symbols are character sets: every character of a segment, the stretch between
punctuation, has the set that the whole segment is drawn from, so random strings of one format share a path; a transition
also has the frequencies of the characters seen there. All other runs of token characters, and their parts between
delimiters, are then scored: how likely is their format under an automaton, against ordinary text? Likely ones are
reported as additional spans.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm.common import python_workers, written

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Runs that hold all access keys and hex strings of the lengths asked for.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Natural logarithm of the chance that an automaton gives a step it has not seen, and that of a symbol that texts lack.
UNSEEN = -14.0
#: Runs that hold all candidates; these also start after the delimiters and end before them.
TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]+")
DELIMITERS = "=/."
#: Longer examples are learned from in windows of so many symbols, each half over the one before; all are scored whole.
WINDOW = 512
#: Scored tokens that a task remembers, and their greatest length.
MEMORY, SHORT = 20_000, 64

Span = tuple[int, int, int]  # start, end, place of the kind


def base_spans(text: str) -> list[Span]:
    """Spans of the plain patterns by start and kind, in code points."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for a, b in (m.span() for m in RUN.finditer(text)):
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def credential(text: str, span: Span) -> str:
    """The part of a span that is the credential."""
    whole = text[span[0] : span[1]]
    return ASSIGN.fullmatch(whole)[2] if span[2] == 0 else whole


def symbols(s: str) -> str:
    """Character classes: digit, a-f, g-z, A-F, G-Z; others stand for themselves."""
    return "".join("d" if "0" <= c <= "9" else "h" if "a" <= c <= "f" else "l" if "a" <= c <= "z" else "H" if "A" <= c <= "F" else "U" if "A" <= c <= "Z" else c for c in s)


SIZE = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20}


SEGMENT = re.compile(r"[A-Za-z0-9]+")
#: Characters of each set, by digits, small letters and capitals: none, those of hexadecimal digits, all.
PARTS = ("", "0123456789"), ("", "abcdef", "abcdefghijklmnopqrstuvwxyz"), ("", "ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def charset(segment: str) -> str:
    """The least set that the characters of a segment are drawn from, as three digits: of digits, small letters, capitals."""
    seen = set(segment)
    return "".join(str(next(i for i, p in enumerate(part) if not (seen & set(part[-1])) - set(p))) for part in PARTS)


def letters(symbol: str) -> int:
    """The number of characters that a symbol stands for."""
    return 1 if len(symbol) < 3 else sum(len(part[int(i)]) for part, i in zip(PARTS, symbol, strict=True))


def shapes(s: str) -> list[str]:
    """The symbol of each character: punctuation itself, others the character set of their segment."""
    out, at = [], 0
    for m in SEGMENT.finditer(s):
        out += [*s[at : m.start()], *[charset(m[0])] * (m.end() - m.start())]
        at = m.end()
    return [*out, *s[at:]]


def windows(s: str) -> list[tuple[str, bool]]:
    """The string in overlapping windows, and whether it ends with each."""
    step = WINDOW // 2
    return [(s[i : i + WINDOW], i + WINDOW >= len(s)) for i in range(0, max(1, len(s) - step), step)]


def infer(strings: list[str], alpha: float = 0.05, ends: list[bool] | None = None) -> dict:
    """A probabilistic automaton from positive examples: {state: {symbol: [next, log p, log p of characters seen, of others]}}, the end under "".

    Strings that are not marked in ``ends`` go on after their last symbol, nobody knows how long.
    """
    kids: list[dict[str, int]] = [{}]
    passed: list[Counter] = [Counter()]  # uses of each symbol, "" where strings end
    chars: list[dict[str, Counter]] = [{}]  # characters of each symbol
    rest: list[tuple[float, float]] = [(math.inf, 0.0)]  # least and most characters that follow
    for s, ended in zip(strings, ends or [True] * len(strings), strict=True):
        at = 0
        for i, (c, x) in enumerate(zip(shapes(s), s, strict=True)):
            more = len(s) - i
            rest[at] = min(rest[at][0], more), max(rest[at][1], more if ended else math.inf)
            passed[at][c] += 1
            chars[at].setdefault(c, Counter())[x] += 1
            if c not in kids[at]:
                kids[at][c] = len(kids)
                kids.append({})
                passed.append(Counter())
                chars.append({})
                rest.append((math.inf, 0.0))
            at = kids[at][c]
        if ended:
            passed[at][""] += 1
        rest[at] = 0.0, max(rest[at][1], 0.0 if ended else math.inf)
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(a: int, b: int) -> bool:
        todo, met = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            n, m = passed[a].total(), passed[b].total()
            if not n or not m or (a, b) in met:
                continue
            met.add((a, b))
            slack = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if slack < 1:
                if rest[a][1] < rest[b][0] or rest[b][1] < rest[a][0]:
                    return False
                if any(abs(passed[a][c] / n - passed[b][c] / m) > slack for c in passed[a].keys() | passed[b].keys()):
                    return False
                for c in chars[a].keys() & chars[b].keys():
                    x, y = chars[a][c], chars[b][c]
                    if any(abs(x[k] / n - y[k] / m) > slack for k in x.keys() | y.keys()):
                        return False
            todo += [(kids[a][c], kids[b][c]) for c in kids[a].keys() & kids[b].keys() if kids[a][c] != kids[b][c] and m > 1]
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            passed[a].update(passed[b])
            rest[a] = min(rest[a][0], rest[b][0]), max(rest[a][1], rest[b][1])
            for c, x in chars[b].items():
                chars[a].setdefault(c, Counter()).update(x)
            for c, t in kids[b].items():
                if c in kids[a]:
                    todo.append((kids[a][c], t))
                else:
                    kids[a][c] = t

    red, blue = [0], [(0, c) for c in sorted(kids[0])]
    while blue:
        parent, c = blue.pop(0)
        b = kids[parent][c]
        if b in red:
            continue
        to = next((r for r in red if alike(r, b)), None)
        if to is None:
            red.append(b)
        else:
            kids[parent][c] = to
            fold(to, b)
        blue = [(r, x) for r in red for x in sorted(kids[r]) if kids[r][x] not in red]

    def step(r: int, c: str, k: int) -> list:
        size, uses = letters(c), chars[r].get(c, {})
        # frequencies that could be those of even draws say nothing
        told = size > 1 and any(j / k - 1 / size > bound / math.sqrt(k) for j in uses.values())
        seen = {x: math.log((j + 1) / (k + size)) for x, j in sorted(uses.items())} if told else {}
        return [kids[r].get(c, -1), math.log(k / passed[r].total()), seen, -math.log(k + size) if told else -math.log(size)]

    return {str(r): {c: step(r, c, k) for c, k in passed[r].items()} for r in red}


#: A step that an automaton has not seen leads to its start.
NO_STEP = (0, UNSEEN, {}, 0.0)


def log_likelihood(automaton: dict, text: str) -> float:
    """Mean natural logarithm of the probability of a string's characters, its end included."""
    at, total = "0", 0.0
    for c, x in [*zip(shapes(text), text, strict=True), ("", "")]:
        to, p, seen, other = automaton[at].get(c, NO_STEP)
        total += p + seen.get(x, other)
        at = str(to)
    return total / (len(text) + 1)


def prefixes(strings: list[str]) -> int:
    """The states of the prefix tree of the strings' symbols."""
    return 1 + len({tuple(x[:i]) for x in map(shapes, strings) for i in range(1, len(x) + 1)})


def ordinary(rates: dict[str, float], text: str) -> float:
    """The same under the symbol rates of ordinary text."""
    return sum(rates.get(c, UNSEEN) - math.log(SIZE.get(c, 1)) for c in symbols(text)) / max(1, len(text))


def examples(docs: DataFrame, max_strings: int) -> DataFrame:
    """Rows of each task: counts of symbols (kind "", the symbol in string, n), and of each kind the ``max_strings`` distinct
    credentials, or windows of them, of least hash."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(128, np.int64)
        kept: dict[str, dict[tuple[str, bool], int]] = {k: {} for k in KINDS}

        def least(strings: dict[tuple[str, bool], int]) -> dict[tuple[str, bool], int]:
            return dict(sorted(strings.items(), key=lambda x: (x[1], x[0]))[:max_strings])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                # all symbols are ASCII, and no byte of another character is
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                seen += np.bincount(data, minlength=256)[:128]
                for span in base_spans(text):
                    kind, s = KINDS[span[2]], credential(text, span)
                    for w in windows(s):
                        if w not in kept[kind]:
                            kept[kind][w] = int.from_bytes(hashlib.blake2b(f"{w}".encode(), digest_size=8).digest(), signed=True)
                    if len(kept[kind]) > 4 * max_strings:
                        kept[kind] = least(kept[kind])
        counts = Counter()
        for i in np.flatnonzero(seen):
            counts[symbols(chr(i))] += int(seen[i])
        rows = [("", c, None, 0, k) for c, k in sorted(counts.items()) if c in "dhlHU+/=_.-"]
        rows += [(k, s, ended, h, 0) for k in KINDS for (s, ended), h in least(kept[k]).items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["kind", "string", "ended", "hash", "n"])

    return docs.filter("text is not null").select("text").mapInArrow(label, "kind string, string string, ended boolean, hash long, n long")


def train(docs: DataFrame, max_strings: int = 2_000, slack: float = 0.1) -> dict:
    """{"rates": ..., "kinds": {kind: {"automaton", "floor", "gain", "tree"}}} from all texts.

    Of each kind the ``max_strings`` distinct credentials of least hash are labelled examples, however rare the kind is
    among the texts. ``floor`` lies ``slack`` below the first percentile of their likelihoods; ``gain`` is the likelihood of
    the likeliest step; ``tree`` counts the states of the prefix tree, of which the automaton has those that were not merged. A kind without examples gets no automaton. ``rates`` are those
    of the character classes of all texts.
    """
    python_workers(docs.sparkSession)
    # used twice, so written: a few thousand short strings a task
    found = written(examples(docs, max_strings), "op7-examples")
    seen = {r["string"]: r["n"] for r in found.filter("kind = ''").groupBy("string").agg(F.sum("n").alias("n")).collect()}

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, (strings, ends) = pdf["kind"].iloc[0], zip(*sorted(zip(pdf["string"], pdf["ended"], strict=True)), strict=True)
        automaton = infer(list(strings), ends=list(ends))
        scores = sorted(log_likelihood(automaton, s) for s in strings)
        gain = max(p + max([other, *seen.values()]) for steps in automaton.values() for _, p, seen, other in steps.values())
        out = {"automaton": automaton, "floor": scores[len(scores) // 100] - slack, "gain": gain, "tree": prefixes(strings)}
        return pd.DataFrame({"kind": [kind], "model": [json.dumps(out)]})

    few = found.filter("kind != ''").select("kind", "string", "ended", "hash").distinct()
    # first within parts of the hashes, so that the last ranking sees a bounded number of rows
    for by in (["kind", F.pmod("hash", F.lit(16))], ["kind"]):
        few = few.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("hash", "string", "ended"))).filter(F.col("rank") <= max_strings)
    models = {r["kind"]: json.loads(r["model"]) for r in few.select("kind", "string", "ended").groupBy("kind").applyInPandas(learn, "kind string, model string").collect()}
    return {"rates": {c: math.log(k / sum(seen.values())) for c, k in seen.items()}, "kinds": {k: models[k] for k in KINDS if models.get(k)}}


def free(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """The runs of token characters, or what base spans leave of them."""
    at = 0
    for a, b in [*sorted(s[:2] for s in base), (len(text), len(text))]:
        if a > at:
            yield from (m.span() for m in TOKEN.finditer(text, at, a))
        at = max(at, b)


def likely(model: dict, token: str, margin: float = 0.5) -> list[Span]:
    """Parts of a run whose format an automaton explains: the mean likelihood reaches the floor and exceeds that of
    ordinary text by ``margin`` a character. A part starts with the run or after a delimiter and ends with the run or
    before one; of parts that overlap the one with the most evidence against ordinary text is taken.

    Parts of every length are scored: an automaton runs on from a start until the run ends, or until what it lacks to the
    floor is more than the likeliest steps could make up for in what is left of the run.
    """
    sets, n = shapes(token), len(token)
    starts = [0, *(i + 1 for i in range(n - 1) if token[i] in DELIMITERS and token[i + 1] != token[i])]
    stops = {n, *(i for i in range(1, n) if token[i] in DELIMITERS and token[i - 1] != token[i])}
    plain: list[float] = []
    found = []
    for k, m in model["kinds"].items():
        automaton, floor, spare = m["automaton"], m["floor"], max(0.0, m["gain"] - m["floor"])
        for a in starts:
            at, total = "0", 0.0
            for b in range(a, n + 1):
                if b in stops and b > a:
                    whole = total + automaton[at].get("", NO_STEP)[1]
                    if whole >= floor * (b - a + 1):
                        if not plain:
                            plain = [0.0]
                            for c in symbols(token):
                                plain.append(plain[-1] + model["rates"].get(c, UNSEEN) - math.log(SIZE.get(c, 1)))
                        usual = plain[b] - plain[a]
                        if whole / (b - a + 1) >= usual / (b - a) + margin:
                            found.append((usual - whole, a, b, KINDS.index(k)))
                if b == n:
                    break
                to, p, seen, other = automaton[at].get(sets[b], NO_STEP)
                total += p + seen.get(token[b], other)
                at = str(to)
                # the end is a step too
                if floor * (b + 1 - a) - total > spare * (n - b):
                    break
    taken: list[Span] = []
    for _, a, b, k in sorted(found):
        if all(b <= s or e <= a for s, e, _ in taken):
            taken.append((a, b, len(KINDS) + k))
    return sorted(taken)


#: Digits and halves of the alphabet, to read the character set of a segment off the few letters that are left.
_HALVES = str.maketrans("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "d" * 10 + "h" * 6 + "l" * 20 + "H" * 6 + "U" * 20)


def hopeless(model: dict) -> Callable[[str], bool]:
    """Whether no part of a token can be likely, told at once for single segments, the many words of ordinary text.

    Where no automaton starts with the character set of the segment, each of its characters is an unseen step that leads
    back to the start; if the likeliest steps could not make up for that in what follows, no part reaches a floor.
    """
    kinds = model["kinds"].values()
    live = {c for m in kinds for c in m["automaton"]["0"]}
    gain, floor = max(0.0, *(m["gain"] for m in kinds)), min(m["floor"] for m in kinds)

    def test(token: str) -> bool:
        segment = token.rstrip(".")
        if not segment.isalnum():
            return False
        seen = set(segment.translate(_HALVES))
        charset = ("1" if "d" in seen else "0") + ("2" if "l" in seen else "1" if "h" in seen else "0") + ("2" if "U" in seen else "1" if "H" in seen else "0")
        n, size = len(token), len(segment)
        return charset not in live and UNSEEN * size + gain * (n - size + 1) < floor * (n + 1)

    return test


def added_spans(model: dict, text: str, base: list[Span], known: dict[str, list[Span]], skip: Callable[[str], bool] | None = None) -> list[Span]:
    """The likely parts of what base spans leave of a text. ``known`` remembers short tokens; ``skip`` is that of ``hopeless``."""
    found = []
    if not model["kinds"]:
        return found
    skip = skip or hopeless(model)
    for a, b in free(text, base):
        token = text[a:b]
        if skip(token):
            continue
        spans = known.get(token)
        if spans is None:
            spans = likely(model, token)
            if b - a <= SHORT:
                if len(known) >= MEMORY:
                    known.clear()
                known[token] = spans
        found += [(a + s, a + e, k) for s, e, k in spans]
    return found


def _name(kind: int) -> str:
    return KINDS[kind] if kind < len(KINDS) else f"like_{KINDS[kind - len(KINDS)]}"


def joined(spans: list[Span]) -> str:
    return ",".join(f"{_name(k)}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def report(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row.

    Spans that the automata add have kinds like_assign, like_access, like_hex. Null and empty texts have no spans. Of parts
    that overlap the likeliest is added, at ties the first; a text of any length is scanned whole; repeated rows are rows of
    their own with equal results. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    model = train(docs) if model is None else model
    python_workers(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Span]] = {}
        skip = hopeless(model) if model["kinds"] else None
        for batch in batches:
            counts, digests, spans = [[], [], []], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                for k in range(3):
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + added_spans(model, text or "", base, known, skip)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: dict | None = None, mask: str = "[SECRET]") -> DataFrame:
    """The rows with every span, added ones included, replaced by ``mask``; n_chars, where there, is counted anew.

    Null texts stay null and empty ones empty; repeated rows stay, and so do all columns; spans that overlap become one mask; a text of any
    length is masked whole. An empty table gives an empty result.
    """
    model = train(docs) if model is None else model
    python_workers(docs.sparkSession)

    def clean(text: str | None, known: dict[str, list[Span]], skip: Callable[[str], bool] | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        out, at = [], 0
        for a, b, _ in sorted(base + added_spans(model, text, base, known, skip)):
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Span]] = {}
        skip = hopeless(model) if model["kinds"] else None
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t, known, skip) for t in batch.column("text").to_pylist()], batch.schema.field(at).type))

    out = docs.mapInArrow(masked, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
