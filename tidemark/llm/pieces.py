"""SentencePiece BPE encoding and decoding, exact, by backtracking.

The encoding that greedy merging (best score first, leftmost on ties) ends in
is the only token sequence in which every adjacent pair survives: merging the
characters of the two tokens anew gives back just these two.  So the encoder
takes, left to right, the longest token that an Aho-Corasick pass found at the
position; on an incompatible pair it tries the next shorter one (the longest
token that begins this one), and when none is left it goes one token back,
marking the position in a bitfield of positions from which no encoding can be
finished.  Each position fails once at most, so a text without any white space
is still linear.

Where a model has no piece with a word mark after another character, or with
a stop next to a letter (both are checked on loading), no merge crosses these
places, and texts are cut there.  Encoded words are kept in tables of bounded
size; the text decoded from a word's ids is kept as well where it is not the
word with spaces for marks.

The model file is read once by the driver and sent with the task (its size is
that of a vocabulary file, not of the data).  Defined results: null text is
the empty text, with no tokens; unknown characters become byte pieces;
repeated rows come back once each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import returning

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bounds of a worker's tables: words of the last two generations, up to so many characters, and token pairs.
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 150_000, 48, 200_000
#: Characters between which and letters no piece of a model may run, if texts are to be cut there too; checked on loading.
LETTER, STOP = "A-Za-zÀ-ÖØ-öø-ÿ", ",.\n"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Codec:
    """Encoder and decoder of one model file's content."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        normal: dict[int, int | bytes] = {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                normal = dict(fields(value))
            elif number == 2 and dict(fields(value)).get(3, 1) != 2:
                raise ValueError("only BPE models are supported")
        if normal.get(2) or USER in self.kinds or UNUSED in self.kinds or not normal.get(5, 1):
            raise ValueError("only models with the identity normaliser and no user-defined or unused pieces are supported")
        self.prefix, self.trim = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        worded = [r for p, r in self.rank.items() if p.strip(MARK)]
        if len(set(worded)) < len(worded) or len(self.bytes) < 256:
            raise ValueError("only models with byte fallback and, runs of word marks apart, one score for each piece are supported")
        self.matches = ahocorasick.Automaton()
        self.shorter: dict[str, str] = {}  # the longest token that begins a token
        alive = {p for p in self.ids if len(p) > 1 and self.merged(p) == [p]}  # other pieces can never come out of merging
        for p in alive:
            self.matches.add_word(p, (len(p) - 1, p))
            self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in alive), p[0])
        self.matches.make_automaton()
        self.shown = {p: str(i) for p, i in self.ids.items()}
        self.plain = {p: p.replace(MARK, " ") for p in self.ids}
        parts = f"{MARK}*[^{MARK}]+|{MARK}+"
        if not any(re.search(rf"[{LETTER}][{STOP}]|[{STOP}][{LETTER}]", p) for p in self.ids):
            parts = rf"{MARK}*[{LETTER}]+(?=[{STOP}{MARK}]|\Z)|[{STOP}]+(?=[{LETTER}{MARK}]|\Z)|{parts}"
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            parts = ".+"
        self.cut = re.compile(parts, re.DOTALL).findall
        self.pairs: dict[str, dict[str, bool]] = {"": {}}  # by the token before
        self.known = 0
        self.words: dict[str, str | tuple[str, str]] = {}
        self.older: dict[str, str | tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """The characters of a short text after merging, best rank first, leftmost on ties."""
        parts, never = list(text), float("inf")
        rank = self.rank.get
        ranks = [rank(a + b, never) for a, b in pairwise(parts)]
        while ranks and (best := min(ranks)) < never:
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            ranks.pop(at)
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], never)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], never)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether two adjacent tokens come out again when their characters are merged anew; anything may come first."""
        if self.known >= KEPT_PAIRS:
            self.pairs, self.known = {"": {}}, 0
        found = not a or self.merged(a + b) == [a, b]
        self.pairs.setdefault(a, {})[b] = found
        self.known += 1
        return found

    def split(self, text: str) -> list[str]:
        """The tokens of a text in which word marks stand for spaces."""
        longest = list(text)  # at each start, the longest token
        for end, (more, token) in self.matches.iter(text):
            longest[end - more] = token
        failed: bytearray | None = None
        shorter, none = self.shorter.get, {}
        out: list[str] = []
        size, last, at, token = len(text), "", 0, longest[0] if text else None
        while at < size:
            follows = self.pairs.get(last, none)
            while token is not None:
                fits = follows.get(token)
                if fits is None:
                    fits = self.compatible(last, token)
                if fits and (failed is None or not failed[(end := at + len(token)) >> 3] >> (end & 7) & 1):
                    break
                token = shorter(token)
            if token is not None:
                out.append(token)
                at += len(token)
                last, token = token, longest[at] if at < size else None
            else:
                if not out:
                    raise AssertionError("every text has an encoding")
                if failed is None:
                    failed = bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                before = out.pop()
                at -= len(before)
                last, token = out[-1] if out else "", shorter(before)
        return out

    def token_ids(self, token: str) -> list[int]:
        found = self.ids.get(token)
        return [found] if found is not None else [self.bytes[b] for b in token.encode()]

    def normalized(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def word(self, word: str) -> str | tuple[str, str]:
        """The ids, joined by commas, of a part that no merge crosses, and the text decoded from them where it is not the part itself with spaces for marks."""
        found = self.older.get(word)
        if found is None:
            tokens = self.split(word)
            try:
                found, decoded = ",".join([self.shown[t] for t in tokens]), "".join([self.plain[t] for t in tokens])
            except KeyError:  # bytes
                ids = [i for t in tokens for i in self.token_ids(t)]
                found, decoded = ",".join(map(str, ids)), self.joined(ids)
            if decoded != word.replace(MARK, " "):
                found = found, decoded
        if len(word) <= KEPT_LENGTH:
            if len(self.words) >= KEPT_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.cut(self.normalized(text or "")) for t in self.split(w) for i in self.token_ids(t)]

    def joined(self, ids: list[int]) -> str:
        """The text of ids in the middle of a sequence."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(utf8(bytes(run)))
                run.clear()
            if self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i].replace(MARK, " "))
        return "".join(out) + (utf8(bytes(run)) if run else "")

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids): without the word mark that the encoder puts first."""
        first = next((n for n, i in enumerate(ids) if self.kinds[i] != CONTROL), len(ids))
        starts = first < len(ids) and self.kinds[ids[first]] == NORMAL and self.pieces[ids[first]].startswith(MARK)
        return self.joined(ids)[1 if starts and (self.prefix or self.trim) else 0 :]

    def forget(self) -> None:
        """Lets go of the words."""
        self.words, self.older = {}, {}

    def round_trip(self, text: str | None) -> tuple[int, str, str]:
        """(tokens, ids joined by commas, decoded text) of a whole text."""
        whole = self.normalized(text or "")
        if not whole:
            return 0, "", ""
        make, words = self.word, self.cut(whole)
        parts = [self.words.get(w) or make(w) for w in words]
        try:
            ids, decoded = ",".join(parts), whole.replace(MARK, " ")
        except TypeError:  # a part that does not decode to itself
            pairs = [(p, w.replace(MARK, " ")) if isinstance(p, str) else p for p, w in zip(parts, words, strict=True)]
            ids, decoded = ",".join([p for p, _ in pairs]), "".join([t for _, t in pairs])
        return ids.count(",") + 1, ids, decoded[1:] if self.prefix or self.trim else decoded


def utf8(data: bytes) -> str:
    """Bytes as text; each byte that is part of no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        at += n
    return "".join(out)


@lru_cache(2)
def codec(model: bytes) -> Codec:
    """A worker builds a model's tables once."""
    return Codec(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        try:
            for batch in found:
                counts, ids, decoded = [], [], []
                for text in batch.column(1):
                    n, numbers, whole = own.round_trip(text.as_py())
                    counts.append(n)
                    ids.append(hashlib.sha256(numbers.encode()).hexdigest())
                    decoded.append(hashlib.sha256(whole.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        finally:
            own.forget()

    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = two.schema["doc_id"].dataType.simpleString()
    return two.mapInArrow(returning(batches), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in found:
            ids = [own.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = two.schema["doc_id"].dataType.simpleString()
    return two.mapInArrow(batches, f"doc_id {kind}, ids array<int>, decoded string")
