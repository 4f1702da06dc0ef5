import random
import re
from collections import Counter

import pytest

from tidemark.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered, seen, copies, lines = Counter(grams), set(), set(), 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered), lines


@pytest.mark.parametrize("text", [None, "", " \n\t", "é #a b|\n\né #a b|", "a a a a a", "x y z q x y z", "w " * 100_000])
def test_statistics(text):
    assert quality.statistics(text) == brute(text)


def test_random_statistics():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("ab#é \n\t \x1c") for _ in range(rng.randint(0, 60)))
        assert quality.statistics(text) == brute(text)


def test_upper_bound_is_exact():
    assert quality.upper_bound(0, 59, 0.05) == pytest.approx(1 - 0.05 ** (1 / 59))
    p = quality.upper_bound(3, 200, 0.01)
    import math

    assert sum(math.comb(200, k) * p**k * (1 - p) ** (200 - k) for k in range(4)) == pytest.approx(0.01)
    assert quality.upper_bound(5, 5, 0.05) == 1.0


def documents(n):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + ("##" if bad else "") for _ in range(80))
        docs.append((i, text, ("en", "de", None)[i % 3]))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_good_kept_and_bad_rejected(spark):
    rows, labels = documents(1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = dict(labels)
    found = quality.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int"), risk=0.1).collect()
    assert len(found) == len(rows)
    assert all(r.kept == bool(truth[r.doc_id]) for r in found)
    assert {tuple(r.failed_rules) for r in found if not r.kept} == {("symbol_ratio",)}


FRAME = "doc_id long, stratum string, base_failed boolean, symbol_ratio double, dup_line_ratio double, repeat_ratio double, mean_word_over double, mean_word_under double"


def measures(rng, n):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        r = [max(0.0, rng.gauss(m if good else b, s)) for m, b, s in ((0.02, 0.2, 0.05), (0.1, 0.15, 0.1), (0.1, 0.3, 0.1))]
        rows.append((i, rng.choice(["en", "fr", None]), rng.random() < 0.1, *r, *[rng.gauss(5, 1 if good else 3)] * 2))
        labels.append((i, int(good)))
    return rows, labels


def rejected(row, cut):
    return any(c is not None and c == c and ((row[3 + k] > c) if k < 4 else (row[3 + k] < c)) for k, c in enumerate(cut))


def by_brute_force(rows, truth, folds, delta, risk):
    """The cutoffs of one stratum, each setting judged on the documents themselves."""
    grid = list(quality.GRID.values())
    lay = [(r, truth[r[0]]) for r in rows if not r[2] and folds[r[0]] == 0]
    test = [r for r in rows if not r[2] and folds[r[0]] and truth[r[0]]]
    now, safe = [None] * 5, [None] * 5
    while True:
        at = [-1 if c is None else g.index(c) for c, g in zip(now, grid)]
        n = [sum(t == k for _, t in lay) or 1 for k in (0, 1)]
        old = [[sum(rejected(r, now) for r, t in lay if t == k)] for k in (0, 1)]
        steps = []
        for k in range(5):
            for j in range(at[k] + 1, len(grid[k])):
                new = [*now[:k], grid[k][j], *now[k + 1 :]]
                won, lost = (sum(rejected(r, new) for r, t in lay if t == g) - old[g][0] for g in (0, 1))
                if won / n[0] > lost / n[1]:
                    steps.append((won / (lost + 1), -j, -k, new))
        if not steps:
            return safe
        now = max(steps, key=lambda x: x[:3])[3]
        if not test or quality.upper_bound(sum(rejected(r, now) for r in test), len(test), delta) > risk:
            return safe
        safe = now


def test_cutoffs_as_by_brute_force(spark):
    rng = random.Random(7)
    rows, labels = measures(rng, 900)
    truth = dict(labels)
    frame = spark.createDataFrame(rows, FRAME)
    folds = {r.doc_id: r.f for r in frame.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {quality.FOLDS}) AS f").collect()}
    found = {r.stratum: list(r[1:]) for r in quality.cutoffs(frame, spark.createDataFrame(labels, "doc_id long, quality int"), risk=0.1).collect()}
    assert set(found) == {"en", "fr", None} and any(c is not None for own in found.values() for c in own)
    for stratum, own in found.items():
        assert [None if c is None or c != c else c for c in own] == by_brute_force([r for r in rows if r[1] == stratum], truth, folds, 0.05 / 3, 0.1)


def test_guarantee_holds_over_many_draws():
    """The true share of good documents that the chosen setting rejects exceeds the risk in at most about delta of the draws."""
    import numpy as np
    import pandas as pd

    rng, over, draws = np.random.default_rng(5), 0, 300
    share = np.linspace(0.2, 0.0, 14)  # of good documents, those that a candidate is the first to reject
    share = share / share.sum() * 0.3
    for _ in range(draws):
        rows = []
        for good, n in ((1, 400), (0, 100)):
            p = share if good else np.full(14, 0.05)
            first = rng.choice(15, n, p=[*p[::-1], 1 - p.sum()])
            rows += [(good, int(rng.integers(quality.FOLDS)), int(f), *[len(g) for g in list(quality.GRID.values())[1:]], 1) for f in first]
        setting = quality.chosen(pd.DataFrame(rows, columns=["good", "fold", *quality.GRID, "n"]), 0.1, 0.05)
        over += share[::-1][: setting[0]].sum() > 0.1
    assert over <= 0.05 * draws + 12


def test_many_strata(spark):
    rows = [(i * 300 + k, f"s{i}", False, 0.5 if k % 6 == 0 else 0.01, 0.0, 0.0, 5.0, 5.0) for i in range(300) for k in range(300)]
    frame = spark.createDataFrame(rows, FRAME)
    labels = frame.selectExpr("doc_id", "cast(symbol_ratio < 0.1 AS int) AS quality")
    assert {r.symbol_ratio for r in quality.cutoffs(frame, labels).collect()} == {0.4}


def test_no_labels_nulls_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "# " * 60, "en", 2), (2, " ".join(f"w{i}" for i in range(60)), "xx", 3)], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.judged(docs, labels).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in rows) == [(0, 60, True, False), (1, 0, True, False), (1, 0, True, False), (2, 60, False, True)]
    assert quality.judged(docs.limit(0), labels).count() == 0
