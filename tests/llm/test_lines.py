import random

import pytest

from tidemark.llm import lines


def brute(docs, least):
    """Lines kept, by (id, text), from the definition: all pairs of runs."""
    rows = sorted({(lines.LAST if i is None else i, t) for i, t in docs if t is not None}, key=lambda r: (r[0], r[1]))
    split = [[w for w in (x.split() for x in t.split("\n")) if w] for _, t in rows]
    out = {}
    for d, own in enumerate(split):
        gone = set()
        for a in range(len(own)):
            for b in range(a, len(own)):
                if sum(map(len, own[a : b + 1])) < least:
                    continue
                n = b - a + 1
                if any(other[s : s + n] == own[a : b + 1] for other in split[:d] for s in range(len(other) - n + 1)) or any(own[s : s + n] == own[a : b + 1] for s in range(a - n + 1)):
                    gone |= set(range(a, b + 1))
        out[rows[d]] = [" ".join(x) for i, x in enumerate(own) if i not in gone]
    return out


def kept_lines(text):
    return [" ".join(x.split()) for x in text.split("\n") if x.split()]


@pytest.mark.parametrize("seed", range(3))
def test_as_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "b c", "d e f", "g h i j k l", "m", "", " "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(25)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = lines.dedup(frame, min_words=6).collect()
    truth = brute(docs, 6)
    assert {r.doc_id: kept_lines(r.text) for r in found} == {i: truth[i, t] for i, t in docs}


def test_passage_of_over_50_words(spark):
    long = " ".join(f"p{i}" for i in range(51))
    parts = "\n".join(" ".join(f"q{i}" for i in range(s, s + 9)) for s in range(0, 54, 9))
    docs = [(3, f"x y\n{long}\nown three"), (1, f"own one\n{long}\nz"), (2, f"{parts}\n\nown two"), (4, f"own four\n{parts}\nend"), (5, "short line"), (6, "short line")]
    found = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: docs[1][1], 2: docs[2][1], 3: "x y\nown three", 4: "own four\nend", 5: "short line", 6: "short line"}


def test_extension_beyond_the_windows(spark):
    run = " ".join(f"a{i}" for i in range(60)) + "\nb1 b2\nc1"
    docs = [(1, run), (2, f"{run}\nnew"), (3, f"new3\n{run}")]
    found = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: run, 2: "new", 3: "new3"}


def test_passage_inside_paragraphs(spark):
    passage = " ".join(f"p{i}" for i in range(30)) + ". " + " ".join(f"q{i}" for i in range(25)) + "."
    docs = [(1, f"One here. {passage} Two there.\nEnd"), (2, f"Other one. {passage}\nEnd two"), (3, f"Third! {passage}"), (4, f"{passage} Fourth.")]
    found = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: docs[0][1], 2: "Other one.\nEnd two", 3: "Third!", 4: "Fourth."}


@pytest.mark.parametrize("text", ["", "a", "a. b.c! d?\n\n e\n", "\n\n", "x.  y", "no end", "...", ". . ."])
def test_lines_make_up_the_text(text):
    assert lines.without(text, []) == text


def test_blank_lines_go_with_their_run():
    assert lines.without("a\n\nb\n\nc", [(0, 1)]) == "\nc" and lines.without("a\n\nb", [(0, 0)]) == "\nb"


def test_nulls_repeats_empties_and_extra_columns(spark):
    long = " ".join(f"p{i}" for i in range(60))
    rows = [(1, long, 5, "x"), (1, long, 5, "x"), (None, long, 6, "y"), (2, None, 7, None), (3, "", 8, "z"), (4, f"{long}\n" * 2000, 9, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th int, id string")
    found = lines.dedup(docs)
    assert found.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.th) for r in found.where("text is not null").collect()) == [(0, "", 6), (1, long, 5), (1, long, 5), (3, "", 8), (4, "", 9)]
    assert found.where("text is null").count() == 1
    assert lines.dedup(docs.limit(0)).count() == 0


def test_windows_that_a_32_bit_hash_takes_for_equal(spark):
    long = " ".join(f"p{i}" for i in range(45)) + "."
    near = lambda i: " ".join(f"n{i}x{k}" for k in range(6)) + "."
    docs = [(1, f"{long}\n{near(15602)}"), (2, f"{long}\n{near(156800)}")]  # their line hashes collide in xxh32 with seed 1
    found = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == dict(docs)


def test_passages_that_begin_and_end_inside_sentences(spark):
    run = " ".join(f"p{i}" for i in range(20)) + ". " + " ".join(f"q{i}" for i in range(20)) + ". " + " ".join(f"r{i}" for i in range(21))
    short = run.rsplit(" ", 12)[0]  # 49 words
    docs = [(1, f"one a {run} b one. End"), (2, f"two c {run} d two. Other"), (3, f"three e {run}"), (4, f"{run} f four"), (5, f"five g {short} h five")]
    found = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: docs[0][1], 2: "two c d two. Other", 3: "three e", 4: "f four", 5: docs[4][1]}


@pytest.mark.parametrize("seed", range(2))
def test_words_as_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(30)]
    seen, least = {}, 6
    kept = []
    for d, own in enumerate(docs):
        gone = set()
        for a in range(len(own) - least + 1):
            place = seen.setdefault(tuple(own[a : a + least]), (d, a))
            if place[0] < d or place[1] + least <= a:
                gone |= set(range(a, a + least))
        kept.append([w for i, w in enumerate(own) if i not in gone])
    frame = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(docs)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.text.split() for r in lines.dedup(frame, min_words=least).collect()}
    assert found == dict(enumerate(kept))


def test_columns_named_like_those_used_inside(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    names = ["_spans", "_id", "_th", "_bucket", "_bits", "_place", "id", "th", "runs", "start", "a.b"]
    docs = spark.createDataFrame([(1, f"a {passage}", *range(11)), (2, f"b {passage}", *range(11)), (3, "c", *range(11))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    found = lines.dedup(docs)
    assert found.schema.names == docs.schema.names
    assert sorted((r.doc_id, r.text, r.start) for r in found.collect()) == [(1, f"a {passage}", 9), (2, "b", 9), (3, "c", 9)]
