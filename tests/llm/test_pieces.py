import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from tidemark.llm import pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return pieces.Codec(pieces.read_model(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "Hello world", "\n\n  x\t y", "été naïve ▁x ▁▁", "日本語のテキスト 🙂🏽", "\u0000a\u0007",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "   " * 30 + "end   ", "1234567890 3.14 $%^&*()", "<s> </s> <unk> <0x41>", "é � ",
]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(both, text):
    own, library = both
    ids = library.encode(text)
    assert own.encode(text) == ids and own.decode(ids) == library.decode(ids)
    assert own.round_trip(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_random_texts_as_the_library(both):
    own, library = both
    rng = random.Random(5)
    inner = [p.replace("▁", " ") for p in own.ids]
    for n in range(3000):
        kind = n % 3
        if kind == 0:
            text = "".join(rng.choice(inner) for _ in range(rng.randint(1, 30)))
        elif kind == 1:
            text = "".join(rng.choice("abehinorst  \n.é") for _ in range(rng.randint(1, 200)))
        else:
            text = "".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x3000, 0x9FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 30)))
        ids = library.encode(text)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids)


def test_long_text_without_spaces(both):
    own, library = both
    text = "thereisnospacehere" * 10_000
    assert own.encode(text) == library.encode(text)


def test_arbitrary_ids_decode_as_the_library(both):
    own, library = both
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(3, 258), rng.randint(3, 258), 1]) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_rows(spark, both):
    own, library = both
    docs = spark.createDataFrame([(1, None, 2), (1, None, 3), (None, "some text", 4), (2, "x " * 50_000, 5)], "doc_id long, text string, n_tokens int")
    rows = pieces.digests(docs, pieces.read_model(PATH)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, len(library.encode("some text"))), (1, 0), (1, 0), (2, len(library.encode("x " * 50_000)))]
    assert {r.decoded_sha256 for r in rows if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    assert pieces.digests(docs.limit(0), pieces.read_model(PATH)).count() == 0
    assert [(r.ids, r.decoded) for r in pieces.encoded(docs.where("doc_id is null"), pieces.read_model(PATH)).collect()] == [(library.encode("some text"), "some text")]
