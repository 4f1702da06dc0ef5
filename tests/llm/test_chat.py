import hashlib
import random

import pytest

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("text", ["", "\\", "\\\\### x", "</turn>", "<turn>### user: x</turn>\n", "#### ", "é\n\u2028", "\\### Assistant: </turn> ok", "<</turn>>"])
def test_round_trip(text):
    whole, start, end = chat.formatted("a: b\\", text)
    assert chat.read(whole * 2) == [("a: b\\", text)] * 2 and chat.unescaped(whole[start:end]) == text


def test_random_round_trip():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["\\", "<turn>", "</turn>", "### ", "#", "<", "/", "x", "\n", ": "]) for _ in range(rng.randint(0, 12)))
        assert chat.read(chat.formatted(text, text)[0]) == [(text, text)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 3, "assistant", "d\\"), (1, 2, "user", None), (2, 0, "user", "only"), (3, 0, "assistant", ""), *chat.PROBE]
    found = {r.conv_id: r for r in chat.digests(chat.examples(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert (found[1].n_turns, found[1].loss_chars, found[1].loss_sha256) == (4, 3, sha("bd\\"))
    assert found[1].turns_sha256 == sha("user\na\nassistant\nb\nuser\n\nassistant\nd\\\n")
    assert (found[2].n_turns, found[2].loss_chars, found[2].loss_sha256) == (1, 0, sha(""))
    assert found[-7].loss_sha256 == sha(chat.PROBE[1][3]) and found[-7].loss_chars == 26
    lengths = [len(chat.formatted(*r)[0]) for r in (("user", "a"), ("assistant", "b"), ("user", ""), ("assistant", "d\\"))]
    assert found[1].formatted_chars == sum(lengths[:2]) + sum(lengths) and found[2].formatted_chars == len(chat.formatted("user", "only")[0])


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "</turn>"), (1, 3, "user", "v"), (1, 4, "assistant", "w"), (1, 5, "user", "!"), (None, 0, "assistant", "z")]
    written = chat.examples(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.conv_id or 0, r.example, r.reply is None) for r in written.collect()) == [(0, 0, False), (1, 0, False), (1, 1, False), (1, 2, True)]
    found = sorted(chat.expanded(written).collect(), key=lambda r: (r.conv_id or 0, r.example))
    assert [(r.conv_id, r.example) for r in found] == [(None, 0), (1, 0), (1, 1)]
    for r, turns in zip(found, ([6], range(3), range(5))):
        assert chat.read(r.context + r.reply) == [(rows[i][2], rows[i][3]) for i in turns]
        assert chat.unescaped((r.context + r.reply)[r.loss_start : r.loss_end]) == rows[max(turns)][3]


def test_digests_as_of_the_expanded_examples(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["", "x\\", "### y", "</turn>" * 9])) for c in range(40) for t in range(rng.randint(1, 9))]
    turns = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(chat, "PART", 40)  # contexts go on in further rows
    full = {}
    for r in chat.expanded(chat.examples(turns)).collect():
        full.setdefault(r.conv_id, []).append(r)
    for r in chat.digests(chat.examples(turns)).collect():
        own = sorted(full.get(r.conv_id, []), key=lambda x: x.example)
        said = [(role or "", text) for c, _, role, text in rows if c == r.conv_id]
        assert (r.n_turns, r.turns_sha256) == (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)))
        trained = "".join(chat.unescaped((x.context + x.reply)[x.loss_start : x.loss_end]) for x in own)
        assert (r.loss_chars, r.loss_sha256) == (len(trained), sha(trained)) and trained == "".join(b for a, b in said if a == "assistant")
        rest = 0 if said[-1][0] == "assistant" else sum(len(chat.formatted(*x)[0]) for x in said)
        assert r.formatted_chars == sum(len(x.context + x.reply) for x in own) + rest


def test_hundred_thousand_turns(spark):
    turns = spark.range(100_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    (found,) = chat.digests(chat.examples(turns)).collect()
    assert found.n_turns == 100_000 and found.loss_sha256 == sha("".join(f"t{i}" for i in range(1, 100_000, 2)))


def test_long_repeated_null_and_extra(spark):
    rows = [(5, i, ("user", "assistant")[i % 2], f"t{i}", i) for i in range(3000)] + [(6, None, None, "x", 1), (6, None, None, "x", 1)]
    turns = spark.createDataFrame(rows, SCHEMA + ", seq int")
    found = {r.conv_id: r for r in chat.digests(chat.examples(turns)).collect()}
    assert found[5].n_turns == 3000 and found[5].loss_sha256 == sha("".join(f"t{i}" for i in range(1, 3000, 2)))
    assert found[6].turns_sha256 == sha("\nx\n\nx\n")
    assert chat.digests(chat.examples(turns.limit(0))).count() == 0


def test_every_example_is_written_out_with_its_whole_context(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(c or None, t, rng.choice(["user", "assistant", None]), rng.choice(["", "x\\", "### y", "</turn>" * 9, "z" * 50])) for c in range(30) for t in range(rng.randint(1, 12))]
    turns = spark.createDataFrame([*rows, *chat.PROBE], SCHEMA)
    for part in (40, 1 << 20):
        monkeypatch.setattr(chat, "PART", part)  # contexts in several rows
        whole, texts = chat.written_out(chat.examples(turns)), {}
        for r in sorted(whole.collect(), key=lambda r: (r.conv_id or 0, r.example, r.part)):
            texts.setdefault((r.conv_id, r.example), []).append(r.context + (r.reply or ""))
        for c in {r[0] for r in rows}:
            said = [(role or "", text) for own, _, role, text in rows if own == c]
            ends = [i + 1 for i, (role, _) in enumerate(said) if role == "assistant" or i + 1 == len(said)]
            assert [chat.read("".join(texts[c, k])) for k in range(len(ends))] == [said[:n] for n in ends]
        found = {r.conv_id: r for r in chat.read_back(whole).collect()}
        assert found == {r.conv_id: r for r in chat.digests(chat.examples(turns)).collect()}
        assert all(r.formatted_chars == sum(len("".join(t)) for (c, _), t in texts.items() if c == r.conv_id) for r in found.values())
