"""Quality rules whose cutoffs bound the false rejections of good documents.

Each rule rejects a document whose ratio is over (or under) a cutoff.  The
cutoffs of a stratum are chosen on its labelled documents, in two parts.  On a
quarter of them (by a hash of the id) a path of settings is laid, from no
cutoff to ever stricter ones: each step makes one rule stricter, the one that
gains the most bad documents for each good one lost, and the path ends where no
step gains more of the bad than of the good.  The other three quarters hold the
settings to account: a setting is safe if the exact (Clopper-Pearson) upper
bound on the share of good documents that all its rules together reject is at
most ``risk``.  Settings are tested in the path's order until the first that
fails (fixed-sequence testing, which needs no further correction along the
path), and the last safe one is taken.  The error probability ``delta`` is
divided by the number of strata, so with probability 1 - delta no stratum
loses more than ``risk`` of its good documents.

Scale: labelled documents are counted by stratum and, for each rule, the first
candidate cutoff that rejects them; these counts are bounded by the grid, and
each stratum's choice is made by a task of its own.  The cutoffs are a table of
one row a stratum that documents are joined to, however many strata there are.
Statistics of a text are taken by one pass over the whole text in Python, one
document at a time.

Defined results: null text has no words; no words fail the base rules; null is
a stratum like any other; in a stratum without labels, or with too few to
guarantee anything, only the base rules reject; a document labelled both good
and bad counts as both; repeated rows come back once each; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import staged

#: Rules: name, and whether large values are bad.
RULES = {"symbol_ratio": True, "dup_line_ratio": True, "repeat_ratio": True, "mean_word_over": True, "mean_word_under": False}
#: Candidate cutoffs, from lenient to strict.
GRID = {
    "symbol_ratio": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_ratio": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "mean_word_over": [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0],
    "mean_word_under": [1.0, 1.5, 2.0, 2.5, 3.0, 3.25, 3.5, 3.75, 4.0],
}
MIN_WORDS, MAX_REPEATS = 50, 50
RISK, DELTA = 0.05, 0.05
#: One of so many labelled documents lays the path; the others test it.
FOLDS = 4
SYMBOLS = b"#*$%&|<>"
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of a whole text; n_lines are those with a word."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    chars = len(text) - (len(data) - sum(map(len, words)))  # all white space that is no part of a word is ASCII
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        covered = -1  # the last word that is counted
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in STATISTICS.split(", ")]
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column(2)]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "stratum", *names])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, statistics, base_failed, ratios) of every row."""
    three = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text"))
    found = three.mapInArrow(_statistics_batches, f"doc_id long, stratum string, {STATISTICS}")
    n = F.greatest("n_words", F.lit(1))
    return found.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATS * F.col("n_words")),
            "symbol_ratio": F.col("n_symbols") / n,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeat_ratio": F.col("n_repeat_words") / n,
            "mean_word_over": F.col("word_chars") / n,
            "mean_word_under": F.col("word_chars") / n,
        }
    )


def tail(rejected: int, good: int, share: float) -> float:
    """The probability of at most so many rejections among good documents, each rejected with probability share."""
    if rejected >= good or share <= 0:
        return 1.0
    if share >= 1:
        return 0.0
    k = np.arange(1, rejected + 1)
    logs = good * np.log1p(-share) + np.concatenate([[0.0], np.cumsum(np.log((good - k + 1) / k) + np.log(share) - np.log1p(-share))])
    top = logs.max()
    return float(np.exp(top) * np.exp(logs - top).sum())


def upper_bound(rejected: int, good: int, delta: float) -> float:
    """The exact one-sided upper confidence bound of a binomial share: the share at which so few rejections have probability delta."""
    if rejected >= good:
        return 1.0
    low, high = rejected / good, 1.0
    for _ in range(60):
        share = (low + high) / 2
        low, high = (share, high) if tail(rejected, good, share) > delta else (low, share)
    return high


def rejects(rule: str, cutoff: float | F.Column) -> F.Column:
    return F.col(rule) > cutoff if RULES[rule] else F.col(rule) < cutoff


def path(first: np.ndarray, weight: np.ndarray, bad: np.ndarray) -> list[tuple[int, ...]]:
    """Settings (for each rule, how many of its candidates reject) from lenient to strict. first: of each kind of document, the first rejecting candidate by rule."""
    sizes = [len(g) for g in GRID.values()]
    n_bad, n_good = max(weight[bad].sum(), 1), max(weight[~bad].sum(), 1)
    now, left, out = [0] * len(sizes), np.ones(len(weight), bool), []
    while True:
        best = None
        for r, size in enumerate(sizes):
            for upto in range(now[r] + 1, size + 1):
                hit = left & (first[:, r] < upto)
                lost, won = weight[hit & ~bad].sum(), weight[hit & bad].sum()
                if won / n_bad > lost / n_good:
                    step = (won / (lost + 1), -upto, -r)
                    if best is None or step > best[0]:
                        best = step, r, upto, hit
        if best is None:
            return out
        now[best[1]] = best[2]
        left &= ~best[3]
        out.append(tuple(now))


def chosen(counts: pd.DataFrame, risk: float, delta: float) -> tuple[int, ...]:
    """The last safe setting of a stratum. counts: rows (good, fold, a first rejecting candidate for each rule, n)."""
    first, n = counts[list(GRID)].to_numpy(np.int64).reshape(len(counts), len(GRID)), counts["n"].to_numpy(np.int64)
    good, laying = counts["good"].to_numpy() == 1, counts["fold"].to_numpy() == 0
    safe = (0,) * len(GRID)
    held, each = first[good & ~laying], n[good & ~laying]
    for setting in path(first[laying], n[laying], ~good[laying]):
        lost = int(each[(held < np.array(setting)).any(axis=1)].sum())
        if not len(each) or tail(lost, int(each.sum()), risk) > delta:
            break
        safe = setting
    return safe


def cutoffs(measures: DataFrame, labels: DataFrame, label_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, a cutoff for each rule): null where a rule rejects nothing; a row for each stratum with labels."""
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good")).where("doc_id is not null and good is not null").distinct()
    # Base failures are rejected whatever the cutoffs are; the rules are judged on the others.
    held = measures.where("not base_failed").join(truth, "doc_id")
    first = [sum((F.when(rejects(r, c), 0).otherwise(1) for c in grid), F.lit(0)).alias(r) for r, grid in GRID.items()]
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    counted = staged(held.select("stratum", "good", fold, *first).groupBy("stratum", "good", "fold", *GRID).agg(F.count("*").alias("n")))
    each = delta / max(counted.select("stratum").distinct().count(), 1)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        setting = chosen(rows, risk, each)
        own = {r: [grid[k - 1] if k else None] for k, (r, grid) in zip(setting, GRID.items(), strict=True)}
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], **own}).astype(dict.fromkeys(GRID, float))

    return staged(counted.groupBy("stratum").applyInPandas(choose, "stratum string, " + ", ".join(f"{r} double" for r in GRID)))


def judged(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(doc_id, statistics, base_failed, kept, failed_rules) of every row of docs."""
    measures = staged(measured(docs, stratum_col=stratum_col))
    own = cutoffs(measures, labels, risk=risk, delta=delta).select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"{r}_cutoff") for r in RULES])
    joined = measures.join(own, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    rules = F.filter(F.array(*[F.when(rejects(r, F.col(f"{r}_cutoff")), F.lit(r)) for r in RULES]), lambda r: r.isNotNull())
    return joined.withColumn("failed_rules", rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules",
    )
