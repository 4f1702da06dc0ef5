"""The pipeline on small tables, each stage's decisions against plain Python over what the stage was given."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tidemark.llm import lines, pieces  # noqa: E402
from tidemark.llm.queries import piece_model  # noqa: E402
from tidemark.llm.shared import staged  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    made = lambda n: " ".join("".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    item, passage = "This " + made(24), made(60)
    docs, labels = [], []
    for i in range(260):
        text = made(80)
        if i % 5 == 0:
            words = text.split()
            words[7] = rng.choice(["blarg", "zonker"])
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(300, f"{made(40)}\n{passage}\n{made(30)}"), (301, f"{made(40)}\n{passage}\n{made(30)}"), (302, f"{made(30)} {item} {made(30)}"), (303, docs[1][1]), (304, docs[2][1] + " end"), (305, ""), (306, "is a bl4rg " + made(50))]
    words = made(147).split()
    docs += [(307, " ".join(words)), (308, " ".join(w if i % 49 != 48 else "other" for i, w in enumerate(words)))]
    where = str(tmp_path_factory.mktemp("tables"))
    frame = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, dict(docs), item, passage


def test_stages(spark, tables):
    where, truth, item, passage = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, held = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, where))
        held.append({r.doc_id: r for r in docs.collect()})
        assert name == "sentencepiece" or docs.columns == columns
    clean, cut, single, free, last = held
    assert set(clean) == {i for i, t in truth.items() if not {"blarg", "zonker", "bl4rg"} & set(t.split())}
    assert set(cut) == set(clean) and passage in cut[300].text and passage not in cut[301].text
    assert all(r.n_chars == len(r.text) for r in cut.values())
    def similarity(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.split(), b.split()))
        return len(x & y) / len(x | y) if x | y else 1.0

    copies = {b: a for a in cut for b in cut if a < b and similarity(cut[a].text, cut[b].text) >= 0.8}
    assert set(single) == set(cut) - set(copies) and {305, 308} <= set(copies)
    assert set(free) == set(single) - {302}
    own = pieces.Codec(piece_model())
    assert {i: r.n_tokens for i, r in last.items()} == {i: len(own.encode(r.text)) for i, r in free.items()}
    assert lines.MIN_WORDS == 50


def test_run(spark, tables):
    found = corpus_pipeline.run(spark, tables[0])
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 302 not in {r.doc_id for r in found.select("doc_id").collect()}


def written(spark, where, docs, kind, labels=(), items=()):
    spark.createDataFrame(docs, kind).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_nulls_empties_repeats_and_clashing_names(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, long), (1, long), (2, None), (3, ""), (None, "a text without a number"), (4, " \n"), (5, "word"), (5, "another word for it"), (None, None), (6, "asked and told before you")]
    names = ["_id", "_th", "_spans", "_node", "_first", "n_chars", "hash", "score", "at", "a.b"]
    kind = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names) + ", a_map map<string,int>"
    where = written(spark, tmp_path, [(*r, *range(len(names)), {"k": 1}) for r in rows], kind, [(1, None, None), (None, 1, 1), (2, 1, 0)], [(None, "x"), (1, None), (2, "asked and told before you")])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = staged(stage(spark, kept, where))
        assert kept.columns == docs.columns, name
    found = sorted((r.doc_id or 0, r.text or "", r.n_chars or 0) for r in kept.collect())
    assert found == [(0, "a text without a number", 23), (1, long, len(long)), (2, "", 0), (5, "another word for it", 19), (5, "word", 4)]
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.tokenize(spark, kept, where).collect()}[2] == 0


def test_empty_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    where = written(spark, tmp_path / "all", [], kind)
    assert corpus_pipeline.run(spark, where).count() == 0
    where = written(spark, tmp_path / "some", [(1, "one text", "en", "s", 8), (2, "and two", "en", "s", 7)], kind)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, where).collect()) == [1, 2]
