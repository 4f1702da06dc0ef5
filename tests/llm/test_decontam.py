from tidemark.llm import decontam

ITEM = "A train leaves Boston at 60 miles per hour and another leaves Denver at 45 miles per hour when will they meet on the long straight track"
OTHER = "What is the capital of that old country where every river runs to the western sea"


def flagged(spark, texts, items=(ITEM, OTHER)):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r.doc_id or -1, r.item_id, round(r.coverage, 3)) for r in decontam.contaminated(docs, bench).collect())


def test_verbatim_and_reparameterised(spark):
    new = ITEM.replace("Boston", "Lisbon").replace("Denver", "Madrid").replace("60", "72.5").replace("45", "51")
    found = flagged(spark, [(1, f"so it was {ITEM} and then"), (2, f"x {new} y"), (3, "nothing of the kind here at all, only words of one sort or another"), (4, OTHER.upper())])
    assert found == [(1, 0, 1.0), (2, 0, 1.0), (4, 1, 1.0)]


def test_inconsistent_slots(spark):
    item = "if Anna has 5 pens and Ben has 7 pens then Anna gives Ben 5 pens and so who of them has more pens now"
    same = item.replace("Anna", "Zoe").replace("5", "9")
    mixed = item.replace("Anna has", "Zoe has").replace("Anna gives", "Kim gives").replace("Ben 5", "Ben 4")
    merged = item.replace("Anna", "Ben")
    assert [d for d, _, _ in flagged(spark, [(1, same), (2, mixed), (3, merged)], (item,))] == [1]


def test_items_of_names_and_numbers_and_short_ones(spark):
    item = "Alice Bob 3 5 7 9 Carol 11 Dave 12 Erin 14 apples"
    docs = [(1, f"so {item} then"), (2, item.upper()), (3, "Xena Bo 4 6 8 9 Cay 10 Dan 1 Eve 15 pears"), (4, "Name it!"), (5, "they name it so"), (6, "1 2 3 4 5 6 7 8 9 10 11 12")]
    assert flagged(spark, docs, (item, "name it")) == [(1, 0, 1.0), (2, 0, 1.0), (4, 1, 1.0)]


def test_half_of_an_item_is_enough_and_less_is_not(spark):
    words = OTHER.split()
    n = len(words) - 7
    half, less = " ".join(words[: 7 + (n + 1) // 2]), " ".join(words[: 7 + n // 2 - 1])
    assert [d for d, _, _ in flagged(spark, [(1, half), (2, less)])] == [1]


def test_short_items_nulls_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame(
        [(1, "we ask who wrote this old book today", 1, 5), (1, "we ask who wrote this old book today", 1, 5), (None, "who wrote this old book", 2, 6), (2, None, 3, 7), (3, "", 4, 8), (4, "word " * 50_000, 5, 9)],
        "doc_id long, text string, n int, hash int",
    )
    bench = spark.createDataFrame([(1, "who wrote this old book", 1), (None, "word word word word word", 2), (2, None, 3), (3, "too short", 4)], "item_id long, text string, hash int")
    assert sorted((r.doc_id or -1, r.item_id) for r in decontam.contaminated(docs, bench).collect()) == [(-1, 1), (1, 1)]
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.clean(docs.limit(0), bench).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == 6


def test_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    plan = decontam.clean(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
