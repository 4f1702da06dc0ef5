"""Line dedup: runs of words that occurred before are deleted, found by winnowing over word hashes.

Words are what white space parts.  A window is ``min_words`` words in a row,
wherever it begins: within lines, across them, or in the middle of sentences.
Each window selects, as fingerprint, the least hash of the runs of half as many words in it,
the leftmost of equals; equal windows select equal fingerprints, which is the
guarantee of winnowing, so only positions of fingerprints that occur more than
once can be in a repeated run.  These are joined by fingerprint, and each match
is extended both ways.  Windows in a row that select one fingerprint reach as
far around its position as any window with it does: where all these words are
those of an earlier position, the match is the whole stretch.  Elsewhere the
windows of the stretch are compared one by one, by fingerprint and a hash of 64 bits
of the window, and the match goes as far to either side as they are equal.  A
window is deleted if an equal one comes before it, without overlapping it, in order of
(doc_id, text hash, word).  A repeated run of ``min_words`` words or more is the
union of its windows, so exactly those words go that lie in such a run.

Scale: fingerprints are counted first, 8 bytes each; a sieve of bounded size
(``sieve.py``) keeps those that occur once, which are most, and the texts without
a match from every further shuffle.  Positions are pre-aggregated (to counts and first
positions), no pairs of positions are ever made; a hot fingerprint only skews
sort-merge joins, which adaptive execution splits.

Defined results: null text stays null; white space inside a deleted run goes
with it, as does the line's end where a whole line goes, and white space
before a deleted end of text; a text whose words all go becomes empty, and its
row stays; rows with a null doc_id come last in the order; rows repeating id
and text are one document, cut alike; extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import returning, staged
from tidemark.llm.sieve import fresh, held, sieve

MIN_WORDS = 50
LAST = (1 << 63) - 1
#: Bytes of text that are hashed at once; a longer text is hashed alone.
HELD_BYTES = 1 << 18
_WORD = re.compile(r"[^ \t-\r]+")
_AFTER = re.compile(r"[ \t\r\v\f]*\n?")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers of the base and of its inverse, modulo 2**64; only those that most batches need are kept."""
    return _kept_powers() if n <= 2 * HELD_BYTES else _made_powers(n)


@lru_cache(1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(2 * HELD_BYTES)


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(texts: list[bytes], min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """Of each window: its text's place in texts, its first word, where its fingerprint stands, the fingerprint, its own hash."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if n < min_words:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    words = _mixed((sums[ends] - sums[starts]) * inverse[starts])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n], dtype=np.uint64)])

    def runs(k: int) -> np.ndarray:
        return _mixed((sums[k:] - sums[:-k]) * inverse[: n - k + 1])

    k = max(min_words // 2, 1)
    short, whole = runs(k), runs(min_words)
    own = np.flatnonzero(doc[: len(whole)] == doc[min_words - 1 :])  # windows that end in their text
    at = own + np.lib.stride_tricks.sliding_window_view(short, min_words - k + 1).argmin(1)[own]
    return doc[own], own - bounds[doc[own]], at, short[at], whole[own]


def _held(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about HELD_BYTES of text; the texts, as bytes, come third."""
    for batch in found:
        sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
        at = size = 0
        for i, more in enumerate(sizes):
            if i > at and size + more > HELD_BYTES:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += more + 1
        if at < batch.num_rows:
            yield batch.slice(at)


def _windows_of(batch: pa.RecordBatch, min_words: int) -> tuple[np.ndarray, ...]:
    return windows([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()], min_words)


_RUNS = "id long, th long, fp long, run long, start int, n int"


def _run_batches(min_words: int):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(found):
            doc, start, at, fp, whole = _windows_of(batch, min_words)
            new = np.flatnonzero(np.diff(at, prepend=-1))
            n = np.diff(new, append=len(at))
            run = _mixed(whole[new] + np.uint64(_BASE) * whole[new + n - 1] + n.astype(np.uint64))  # they overlap, so both are the run
            rows = pa.array(doc[new])
            plain = [pa.array(x.view(np.int64)) for x in (fp[new], run)] + [pa.array(x.astype(np.int32)) for x in (start[new], n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *plain], names=["id", "th", "fp", "run", "start", "n"])

    return batches


def _window_batches(min_words: int):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(found):
            doc, start, _, fp, whole = _windows_of(batch, min_words)
            lists = batch.column(3)
            flat = lists.flatten()
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            first, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            some = np.repeat(np.searchsorted(doc, of) + first - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows = pa.array(doc[some])
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c[some].view(np.int64)) for c in (fp, whole)), pa.array(start[some].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "fp", "whole", "start"])

    return batches


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text less the words of spans, and less the white space inside a span and after it up to the line's end."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    if not merged:
        return text
    words = [m.span() for m in _WORD.finditer(text)]
    kept, at = "", 0
    for start, end in merged:
        kept += text[at : words[start][0]]
        bare = kept.rstrip(" \t")
        if not bare or bare.endswith("\n"):
            kept = bare  # the line goes from its start on
        at = _AFTER.match(text, words[end][1]).end()
        if text[at - 1] == "\n" and kept and not kept.endswith("\n"):
            kept = kept.rstrip(" \t") + "\n"  # what is left of a paragraph keeps its end
    return kept + text[at:] if at < len(text) else kept.rstrip(" \t\n")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, start, end): runs of words of each document that occurred before; id is LAST for null."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    place = F.struct("id", "th", "start")
    elsewhere = (F.col("id") != F.col("first.id")) | (F.col("th") != F.col("first.th"))
    # Windows in a row of one fingerprint, as a whole: later copies are cut, without looking at their windows.
    found = staged(keyed.mapInArrow(returning(_run_batches(min_words)), _RUNS))
    often = sieve(found.select("fp").groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("fp").alias("h")))
    found = held(found, F.xxhash64("fp"), often)
    kinds = staged(found.groupBy("fp", "run").agg(F.min(place).alias("first"), F.min("n").alias("n"), F.count("*").alias("times")))
    copies = found.join(kinds.where("times > 1").select("fp", "run", "first").hint("merge"), ["fp", "run"]).where(elsewhere | (F.col("start") != F.col("first.start")))
    apart = elsewhere | (F.col("start") >= F.col("first.start") + F.col("n") - 1 + min_words)
    copies = staged(copies.select("id", "th", "fp", "start", "n", apart.alias("apart")))
    # First ones are compared window by window where their fingerprint has other runs, or copies that overlap.
    rest = copies.where("not apart")
    open_ = kinds.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1").select("fp").unionAll(rest.select("fp")).distinct()
    again = held(kinds, F.xxhash64("fp"), sieve(open_.select(F.xxhash64("fp"))))  # and a few more, whose windows match none
    wanted = again.select("first.id", "first.th", "first.start", "n").unionAll(rest.select("id", "th", "start", "n"))
    wanted = staged(wanted.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set(F.struct("start", "n")).alias("runs")))
    asked = sieve(wanted.select(F.xxhash64("_id", "_th").alias("h")))
    texts = held(keyed, F.xxhash64("id", "th"), asked).join(wanted.hint("merge"), (F.col("id") == F.col("_id")) & (F.col("th") == F.col("_th"))).select("id", "th", "text", "runs")
    placed = staged(texts.mapInArrow(returning(_window_batches(min_words)), "id long, th long, fp long, whole long, start int"))
    firsts = placed.groupBy("fp", "whole").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").select("fp", "whole", "first")
    later = placed.join(firsts.hint("merge"), ["fp", "whole"]).where(elsewhere | (F.col("start") >= F.col("first.start") + min_words))
    whole = copies.where("apart").select("id", "th", "start", (F.col("start") + F.col("n") + (min_words - 2)).alias("end"))
    return whole.unionAll(later.select("id", "th", "start", (F.col("start") + (min_words - 1)).alias("end")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns, with later repeated runs of words deleted from the text."""
    spans, id_, th = (fresh(n, docs.columns) for n in ("_spans", "_id", "_th"))
    runs = repeated_runs(docs, id_col, text_col, min_words).groupBy("id", "th").agg(F.collect_set(F.struct("start", "end")).alias(spans))
    runs = staged(runs.withColumnsRenamed({"id": id_, "th": th}))
    own_id, own_th = F.coalesce(docs[id_col].cast("long"), F.lit(LAST)), F.xxhash64(docs[text_col])
    some, key = sieve(runs.select(F.xxhash64(id_, th).alias("h"))), F.xxhash64(own_id, own_th)
    joined = held(docs, key, some).join(runs.hint("merge"), (own_id == runs[id_]) & (own_th == runs[th]), "left").select(*[F.col(f"`{c}`") for c in docs.columns], spans)

    names, at = docs.columns, docs.columns.index(text_col)

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            lists = batch.column(batch.num_columns - 1)
            own = iter(zip(*(lists.flatten().field(k).to_pylist() for k in (0, 1)), strict=True))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            texts = [without(t, list(islice(own, n))) if n else t for t, n in zip(batch.column(at).to_pylist(), sizes, strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = joined.toDF(*[f"c{i}" for i in range(len(names) + 1)])  # mapInArrow takes no names with dots
    return plain.mapInArrow(returning(cut), docs.schema).unionAll(held(docs, key, some, wanted=False))
