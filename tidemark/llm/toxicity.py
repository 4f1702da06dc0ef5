"""Toxicity by a weighted lexicon, matched by one Aho-Corasick pass over folded text.

Folding lower-cases, turns look-alike letters of other scripts into Latin
ones, digits and signs that stand for letters into these (i, l, 1 and | are one
class), drops invisible characters, and leaves words joined by single spaces.
Lexicon entries are word beginnings (whole words included), so inflected forms
are found; for each word the heaviest entry counts.  An entry has two weights,
for texts that have it once and for texts that have it more often, as some words
only tell when they are repeated.  Exception phrases (a lexicon word with a
neighbour) cancel the hits that they cover.  The sum of weights is divided by
the square root of the length in words (plus 20), and score = raw / (raw +
threshold), so 0.5 is the learned threshold.

Entries, weights, exceptions and threshold are learned from labelled rows: at
most ``MAX_TOXIC`` and ``MAX_CLEAN`` of them (those least by a hash of the id,
equal texts once), a documented bound, so what reaches the driver is bounded
too.  Candidates need a significant association (G² of at least ``MIN_G2``, for
once or for more often); the ``MAX_CANDIDATES`` strongest are looked at, a bound of
the model's size like ``MAX_EXCEPTIONS``, the number of phrases.  Of these a greedy cover of the
toxic rows is taken, so a word that only accompanies lexicon words, as in a group of
copies, is not taken.  Scoring covers every row and every whole text.

Defined results: null and empty texts score 0; without toxic labels all score
0; repeated rows come back once each, a doc_id with both labels counts as
toxic; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import returning, staged

MAX_TOXIC, MAX_CLEAN, MAX_CANDIDATES, MAX_EXCEPTIONS = 3_000, 9_000, 3_000, 1_000
MIN_G2, MIN_RATIO, MIN_ROWS, PREFIXES, LONGEST = 30.0, 3, 3, range(4, 9), 30
#: What marks an entry that a text has more than once.
AGAIN = " 2"
COMPANY, HELD_ENTRIES = 0.6, 50_000

# Characters that look like a Latin letter.
LOOKALIKES = {
    "a": "аαɑａ4", "b": "Ььβｂ8", "c": "сϲｃ", "d": "ԁｄ", "e": "еεҽｅ3", "f": "ｆ", "g": "ɡｇ9", "h": "һｈ", "i": "іιıｉl1|ӏｌ",
    "j": "јｊ", "k": "кκｋ", "m": "мｍ", "n": "ոｎ", "o": "оοσօｏ0", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ5", "t": "тτｔ7",
    "u": "υսｕ", "v": "ѵνｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ｚ2",
}
SIGNS = {"@": "a", "$": "s", "!": "i"}
INVISIBLE = "­​‌‍⁠﻿"

_FOLD = str.maketrans({other: letter for letter, others in LOOKALIKES.items() for other in others} | dict.fromkeys(INVISIBLE))
_SIGN = re.compile(r"[@$!](?=[^\W\d_])")
_WORDS = re.compile(r"[^\W_]+")


def folded(text: str | None) -> list[str]:
    """The folded words of a whole text."""
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text or "")
    return _WORDS.findall(text.lower().translate(_FOLD))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)  # of word beginnings: once, more often
    exceptions: frozenset[str] = frozenset()  # two words
    threshold: float = 1.0


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        self.weights = lexicon.weights
        for entry, weights in lexicon.weights.items():
            self.automaton.add_word(" " + entry, (len(entry), max(weights), entry))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 1, 0.0, ""))
        self.threshold = lexicon.threshold
        if lexicon.weights:
            self.automaton.make_automaton()

    def hits(self, words: list[str]) -> dict[int, str]:
        """The heaviest entry by the place of a word in the words joined by spaces."""
        found: dict[int, tuple[float, str]] = {}
        spared: list[tuple[int, int]] = []
        if len(self.automaton):
            for end, (n, weight, entry) in self.automaton.iter(f" {' '.join(words)} "):
                if entry:
                    found[end - n] = max(found.get(end - n, (0.0, "")), (weight, entry))
                else:
                    spared.append((end - n, end))
        for start, end in spared:
            for place in [p for p in found if start <= p < end]:
                del found[place]
        return {place: entry for place, (_, entry) in found.items()}

    def raw(self, text: str | None) -> float:
        words = folded(text)
        counts = Counter(self.hits(words).values())
        return math.fsum(self.weights[e][0] if n == 1 else self.weights[e][1] * math.sqrt(n / 2) for e, n in counts.items()) / math.sqrt(20 + len(words))

    def score(self, text: str | None) -> float:
        raw = self.raw(text)
        return raw / (raw + self.threshold) if raw else 0.0


@lru_cache(4)
def _matcher(weights: tuple, exceptions: frozenset, threshold: float) -> Matcher:
    return Matcher(Lexicon(dict(weights), exceptions, threshold))


def matcher(lexicon: Lexicon) -> Matcher:
    return _matcher(tuple(sorted(lexicon.weights.items())), lexicon.exceptions, lexicon.threshold)


def features(words: list[str]) -> set[str]:
    """The beginnings that a text could have lexicon entries for, and, marked, those that it has more than once."""
    counts: Counter[str] = Counter()
    for word, n in Counter(words).items():
        if len(word) >= 3 and not word.isdigit():
            for k in PREFIXES:
                if k < len(word):
                    counts[word[:k]] += n
            counts[word[:LONGEST]] += n
    return counts.keys() | {e + AGAIN for e, n in counts.items() if n > 1}


def association(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """G² of a two by two table, 0 where the association is not positive."""
    total, rows = all_toxic + all_clean, toxic + clean
    if not all_toxic or not all_clean or toxic * all_clean <= clean * all_toxic:
        return 0.0
    cells = [(toxic, rows * all_toxic), (clean, rows * all_clean), (all_toxic - toxic, (total - rows) * all_toxic), (all_clean - clean, (total - rows) * all_clean)]
    return 2 * sum(n * math.log(n * total / e) for n, e in cells if n)


def log_odds(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): the bounded sample of labelled rows that are not held out."""
    truth = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    truth = truth.where(~held_out(F.col("doc_id")))
    some = [truth.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    chosen = staged(some[0].unionAll(some[1]))
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), F.col("_id") == chosen["doc_id"])
    rows = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return staged(rows.select(F.coalesce("text", F.lit("")).alias("text"), "toxic"))


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    rows = sample(docs, labels)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a part of the rows; a task never holds more than HELD_ENTRIES of them and those of one text."""
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            names = list(toxic | clean)
            columns = [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in (toxic, clean))]
            toxic.clear()
            clean.clear()
            return pa.RecordBatch.from_arrays(columns, names=["entry", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                (toxic if label.as_py() else clean).update(features(folded(text.as_py())))
                if len(toxic) + len(clean) > HELD_ENTRIES:
                    yield flushed()
        yield flushed()

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    all_toxic, all_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not all_toxic or not all_clean:
        return Lexicon()
    totals = staged(rows.mapInArrow(returning(counted), "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    likely = totals.where((F.col("toxic") >= MIN_ROWS) & (F.col("toxic") * all_clean > MIN_RATIO * F.col("clean") * all_toxic))
    found = likely.orderBy(F.desc(F.col("toxic") - F.col("clean") * (all_toxic / all_clean)), "entry").limit(4 * MAX_CANDIDATES).collect()
    rated = {r.entry: (association(r.toxic, r.clean, all_toxic, all_clean), r.toxic, r.clean) for r in found}
    names = sorted((e for e, (g, _, _) in rated.items() if g >= MIN_G2), key=lambda e: (-rated[e][0], e))[:MAX_CANDIDATES]
    taken = cover(rows.where("toxic = 1"), {e: rated[e][2] for e in names}, all_toxic, all_clean)
    bases = sorted({e.removesuffix(AGAIN) for e in taken})
    counts = {r.entry: (r.toxic, r.clean) for r in totals.where(F.col("entry").isin([b + k for b in bases for k in ("", AGAIN)])).collect()} if bases else {}
    weights = {}
    for base in bases:
        some, more = counts[base], counts.get(base + AGAIN, (0, 0))
        both = tuple(max(0.0, log_odds(*n, all_toxic, all_clean)) for n in ((some[0] - more[0], some[1] - more[1]), more))
        if any(both):
            weights[base] = both
    if not weights:
        return Lexicon()
    exceptions = phrases(rows, weights)
    first = Lexicon(weights, exceptions)

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(first)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([own.raw(t.as_py()) for t in batch.column(0)], pa.float64()), batch.column(1)], names=["raw", "toxic"])

    measured = rows.mapInArrow(returning(raws), "raw double, toxic int").collect()
    return Lexicon(weights, exceptions, threshold([(r.raw, r.toxic) for r in measured]))


def cover(toxic: DataFrame, clean: dict[str, int], all_toxic: int, all_clean: int) -> list[str]:
    """A greedy cover of the toxic rows (a bounded sample) by entries, heaviest gain first, longest on ties."""

    names = sorted(clean)
    place = {e: i for i, e in enumerate(names)}

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = [sorted(place[e] for e in features(folded(t.as_py())) & place.keys()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(have, pa.list_(pa.int32()))], names=["entries"])

    holders = defaultdict(set)
    rows = [[names[i] for i in r.entries] for r in toxic.select("text").mapInArrow(returning(entries), "entries array<int>").collect()]
    for i, have in enumerate(rows):
        for e in have:
            holders[e].add(i)
    weights = {e: log_odds(len(held), clean[e], all_toxic, all_clean) for e, held in holders.items()}
    left = {e: len(held) for e, held in holders.items()}
    taken: list[str] = []
    open_rows = set(range(len(rows)))
    while left:
        best = max(left, key=lambda e: (left[e] * weights[e], len(e), e))
        if left[best] < MIN_ROWS or association(left[best], clean[best], all_toxic, all_clean) < MIN_G2:
            break
        taken.append(best)
        for i in holders[best] & open_rows:
            open_rows.remove(i)
            for e in rows[i]:
                left[e] -= 1
    # Entries about as frequent as one taken that they often accompany are lexicon words as well.
    for e in sorted(holders, key=lambda e: (-len(holders[e]) * weights[e], -len(e), e)):
        own = e.removesuffix(AGAIN)
        if taken and not any(own.startswith(t.removesuffix(AGAIN)) or t.startswith(own) for t in taken):
            t = max(taken, key=lambda t: len(holders[t] & holders[e]))
            if len(holders[e]) * weights[e] >= COMPANY * len(holders[t]) * weights[t]:
                taken.append(e)
    return taken


def phrases(rows: DataFrame, weights: dict[str, tuple[float, float]]) -> frozenset[str]:
    """Pairs of words, one of them a hit, that are (nearly) only seen in clean rows."""
    plain = Lexicon(weights)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(plain)
        for batch in batches:
            out: list[tuple[str, int]] = []
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                words = folded(text.as_py())
                if places := own.hits(words):
                    at, seen = 0, set()
                    for i, w in enumerate(words):
                        if at in places:
                            seen |= {" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1}
                        at += len(w) + 1
                    out += [(p, label.as_py()) for p in seen]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], names=["phrase", "toxic"])

    counts = rows.mapInArrow(returning(pairs), "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    spared = counts.where((F.col("n") - F.col("toxic") >= MIN_ROWS) & (F.col("toxic") * 10 <= F.col("n")))
    return frozenset(r.phrase for r in spared.orderBy(F.desc("n"), "phrase").limit(MAX_EXCEPTIONS).collect())


def threshold(rows: list[tuple[float, int]]) -> float:
    """The value between two raw scores that tells most rows right; the lowest on ties."""
    rows = sorted(rows)
    toxic = sum(t for _, t in rows)
    right = len(rows) - toxic  # all called clean
    best, at = right, max(2 * rows[-1][0], 1.0)
    below = clean_below = 0
    for i, (raw, label) in enumerate(rows):
        before = rows[i - 1][0] if i else 0.0
        if raw > before:
            right = clean_below + toxic - (below - clean_below)
            if right > best:
                best, at = right, (before + raw) / 2
        below += 1
        clean_below += label == 0
    return at


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = two.mapInArrow(returning(scores), "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of docs, all columns, that are not toxic."""

    names, at = docs.columns, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(lexicon)
        for batch in batches:
            kept = batch.filter(pa.array([own.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=names)

    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(returning(keep), docs.schema)  # which takes no names with dots
