import random
import zlib

import pytest

from tidemark.llm import toxicity
from tidemark.llm.toxicity import Lexicon, Matcher, folded


@pytest.mark.parametrize(
    ("text", "words"),
    [(None, []), ("", []), ("An ID1OT!", ["an", "idiot"]), ("іdiоt", ["idiot"]), ("id​iot", ["idiot"]), ("c1own $cum tr@sh", ["ciown", "scum", "trash"]), ("ｉｄｉｏｔ", ["idiot"]), ("end$$$ wow!!", ["end", "wow"]), ("l00k_up", ["iook", "up"])],
)
def test_folding(text, words):
    assert folded(text) == words


def test_matching_by_word_beginning_with_exceptions():
    own = Matcher(Lexicon({"trash": (2.0, 3.0), "tras": (1.0, 1.0), "idiot": (3.0, 3.0)}, frozenset({"trash can"}), 0.1))
    assert own.hits(folded("trashy trash can an idiot, mytrash")) == {0: "trash", 20: "idiot"}
    assert own.score(None) == own.score("") == own.score("fine words") == 0.0
    assert own.score("idiot") > 0.5 > own.score("idiot " + "word " * 100_000)
    assert Matcher(Lexicon()).score("idiot") == 0.0


def test_threshold_tells_most_rows_right():
    assert toxicity.threshold([(0.0, 0), (0.2, 0), (0.4, 1), (0.6, 1)]) == pytest.approx(0.3)
    assert toxicity.threshold([(0.5, 0), (0.2, 0)]) >= 1.0


def test_association_is_signed():
    assert toxicity.association(10, 0, 10, 90) > 50 and toxicity.association(0, 10, 10, 90) == 0 and toxicity.association(1, 9, 10, 90) == 0


def made(n=500, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(60)]
        if i % 4 == 0:
            words[rng.randrange(60)] = rng.choice(["zonker", "BL4RG", "ѕnоrf"])
        if i % 25 == 1 and i % 4:
            at = rng.randrange(58)
            words[at : at + 2] = ["zonker", "bridge"]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    return docs, labels


def test_learning_and_scoring(spark):
    docs, labels = made()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(frame, truth)
    assert {"zonker", "biarg", "snorf"} <= set(lexicon.weights) and "zonker bridge" in lexicon.exceptions
    found = {r.doc_id: r for r in toxicity.scored(frame, lexicon).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found.values())
    held = [i for i, r in found.items() if r.held_out]
    assert sum(found[i].predicted == labels[i][2] for i in held) / len(held) > 0.97
    assert {r.doc_id for r in toxicity.clean(frame, lexicon).collect()} == {i for i, r in found.items() if not r.predicted}


def test_held_out_labels_are_never_used(spark):
    docs, labels = made()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    assert toxicity.learn(frame, spark.createDataFrame(labels, schema)) == toxicity.learn(frame, spark.createDataFrame(other, schema))


def test_nulls_repeats_no_labels_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "zonker", 6)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert lexicon == Lexicon()
    assert [(r.score, r.predicted) for r in toxicity.scored(docs, lexicon).collect()] == [(0.0, 0)] * 3
    assert toxicity.clean(docs, lexicon).columns == docs.columns and toxicity.clean(docs, lexicon).count() == 3
    assert toxicity.scored(docs.limit(0), lexicon).count() == 0


def test_words_that_tell_only_when_repeated(spark):
    """As in texts where a word occurs by chance once, and often where it is meant."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(common) for _ in range(80)]
        toxic = i % 6 == 0
        for at in rng.sample(range(80), 3 if toxic else i % 6 == 1):
            words[at] = "vexorim" + rng.choice(["a", "os", "ent"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    lexicon = toxicity.learn(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r.doc_id: r.predicted for r in toxicity.scored(frame, lexicon).where("held_out").collect()}
    assert sum(found[i] == int(i % 6 == 0) for i in found) >= 0.98 * len(found)
    (weights,) = [w for e, w in lexicon.weights.items() if "vexorim".startswith(e)]
    assert weights[0] < weights[1]


def test_very_long_texts_and_ids_with_both_labels(spark):
    docs, labels = made()
    docs += [(9000, "word " * 200_000), (9001, "zonker " * 200_000), (9002, "x" * 1_000_000)]
    labels += [(9000, 1, 0), (9000, 1, 1), (9001, 1, None), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    lexicon = toxicity.learn(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r.doc_id: r.predicted for r in toxicity.scored(frame, lexicon).where("doc_id >= 9000").collect()}
    assert found == {9000: 0, 9001: 1, 9002: 0}
