r"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it are its
context, and only its text is trainable.  A turn is written

    <turn>### role: text</turn>\n

and a backslash goes before every backslash, ``<turn>``, ``</turn>`` and
``### `` inside a role or text (and before a colon in a role), so that reading
back is exact.

``examples`` gives every example a row of its own: the turns since the example
before as ``context``, the reply, and the places of the trainable text, counted
from the example's beginning.  What comes before ``context`` is told by
reference: it is contexts and replies of the conversation's earlier rows, the
first ``context_chars`` characters of which are the example's whole context.  So these
rows grow with the input, not with its square.  ``written_out`` is the whole
expansion, each example with all of its context, and ``read_back`` reads every one of them; that
is quadratic in a conversation's length by its nature.  ``expanded`` has a row for
each answered example.

Rows are dealt by conversation, sorted and streamed; a context of more than ``PART``
characters goes on in another row.  No task of ``examples`` holds a conversation,
``written_out`` holds the formatted text of one.  A conversation's digest is sequential, so one
conversation is streamed by one task, however long it is.

Defined results: turns with a null number come first, ties are ordered by role
and text; null text is empty, a null role is ""; rows with a null conv_id are
one conversation; repeated rows are turns of their own; extra columns are
ignored.  A conversation that does not end with an assistant turn has its
last turns in a row without a reply, under no mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
_CONTROL = re.compile(r"\\|</?turn>|### ")
_ROLE = re.compile(r"\\|</?turn>|### |:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn>### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/?turn>))*)</turn>\n", re.S)

PART = 1 << 20
EXAMPLES = "conv_id long, example long, part long, context string, reply string, loss_start long, loss_end long, context_chars long"
EXPANDED = "conv_id long, example long, context string, reply string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def formatted(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn as written, and where its text starts and ends."""
    head = "<turn>### " + _ROLE.sub(lambda m: "\\" + m[0], role or "") + ": "
    body = _CONTROL.sub(lambda m: "\\" + m[0], text or "")
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read(whole: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; raises if it is not one."""
    turns, at = [], 0
    while at < len(whole):
        m = _TURN.match(whole, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return turns


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _in_batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about PART characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, str))
        if size > PART:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _exploded(turns: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of examples() from (conv_id, role, text), conversations one after another."""
    now, example, part, before, context, size = object(), 0, 0, 0, [], 0
    for conv, role, text in turns:
        if conv != now:
            if context:
                yield now, example, part, "".join(context), None, None, None, before + size
            now, example, part, before, context, size = conv, 0, 0, 0, [], 0
        whole, start, end = formatted(role, text)
        if role == TRAINED:
            before += size
            yield conv, example, part, "".join(context), whole, before + start, before + end, before
            before += len(whole)
            example, part, context, size = example + 1, 0, [], 0
        else:
            context.append(whole)
            size += len(whole)
            if size > PART:
                before += size
                yield conv, example, part, "".join(context), None, None, None, before
                part, context, size = part + 1, [], 0
    if context:
        yield now, example, part, "".join(context), None, None, None, before + size


def examples(turns: DataFrame) -> DataFrame:
    """A row for each assistant turn (context, reply and mask), as the module's text tells; rows without a reply hold turns that none follows yet."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), "text").select("conv_id", "role", "text")
    return rows.mapInArrow(lambda batches: _in_batches(_exploded(_rows(batches)), EXAMPLES), EXAMPLES)


def _prefixed(rows: Iterator[tuple]) -> Iterator[tuple]:
    now, prefix = object(), ""
    for conv, example, _, context, reply, start, end, _ in rows:
        prefix = (prefix if conv == now else "") + context
        now = conv
        if reply is not None:
            yield conv, example, prefix, reply, start, end
            prefix += reply


def expanded(written: DataFrame) -> DataFrame:
    """(conv_id, example, context, reply, loss_start, loss_end): every example of examples() with its whole context; the mask is in code points of context + reply."""
    rows = written.repartition("conv_id").sortWithinPartitions("conv_id", "example", "part")
    return rows.mapInArrow(lambda batches: _in_batches(_prefixed(_rows(batches)), EXPANDED), EXPANDED)


def _written_out(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From rows of examples(): those of each example with all that comes before it, in blocks of about PART characters."""
    now, blocks, tail, written = object(), [], "", None
    for conv, example, part, context, reply, start, end, context_chars in rows:
        if conv != now:
            now, blocks, tail, written = conv, [], "", None
        if example != written:  # what the example's first row refers to
            yield from ((conv, example, at, block, None, None, None, None) for at, block in enumerate(blocks))
            context_, written = tail + context, example
        else:
            context_ = context
        yield conv, example, len(blocks) + part, context_, reply, start, end, context_chars
        tail += context + (reply or "")
        if len(tail) > PART or reply is None:
            blocks.append(tail)
            tail = ""


def written_out(written: DataFrame) -> DataFrame:
    """The rows of examples(), conversations whole and in order in a partition, as rows in which every example's contexts are its whole context."""
    return written.mapInArrow(lambda batches: _in_batches(_written_out(_rows(batches)), EXAMPLES), EXAMPLES)


class _WholeDigest:
    """Of a conversation's examples as written out: each is read whole, the last one has all turns."""

    def __init__(self, conv: int | None):
        self.conv, self.example, self.loss, self.formatted, self.loss_sha = conv, None, 0, 0, hashlib.sha256()

    def add(self, example: int, context: str, reply: str | None, start: int | None, end: int | None) -> None:
        if example != self.example:
            self.example, self.size, self.turns, self.turns_sha = example, 0, 0, hashlib.sha256()
        whole = context + (reply or "")
        for role, text in read(whole):
            self.turns += 1
            self.turns_sha.update(f"{role}\n{text}\n".encode())
        if reply is not None:
            trained = unescaped(whole[start - self.size : end - self.size])
            self.loss += len(trained)
            self.loss_sha.update(trained.encode())
        self.size += len(whole)
        self.formatted += len(whole)

    def row(self) -> tuple:
        return self.conv, self.turns, self.turns_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.formatted


def _read_back(rows: Iterator[tuple]) -> Iterator[tuple]:
    now: _WholeDigest | None = None
    for conv, example, _, context, reply, start, end, _ in rows:
        if now is None or conv != now.conv:
            if now is not None:
                yield now.row()
            now = _WholeDigest(conv)
        now.add(example, context, reply, start, end)
    if now is not None:
        yield now.row()


def read_back(whole: DataFrame) -> DataFrame:
    """What reading every example of written_out() gives, a row for each conversation; all lengths are those of the text that is there."""
    return whole.mapInArrow(lambda batches: _in_batches(_read_back(_rows(batches)), DIGESTS), DIGESTS)


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss, self.formatted, self.open = conv, 0, 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, context: str, reply: str | None, start: int | None, end: int | None, context_chars: int) -> None:
        for role, text in [*read(context), *read(reply or "")]:
            self.turns += 1
            self.turns_sha.update(f"{role}\n{text}\n".encode())
        self.open = context_chars if reply is None else 0
        if reply is not None:
            trained = unescaped(reply[start - context_chars : end - context_chars])
            self.loss += len(trained)
            self.loss_sha.update(trained.encode())
            self.formatted += context_chars + len(reply)

    def row(self) -> tuple:
        return self.conv, self.turns, self.turns_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.formatted + self.open


def _digested(rows: Iterator[tuple]) -> Iterator[tuple]:
    now: _Digest | None = None
    for conv, _, _, context, reply, start, end, context_chars in rows:
        if now is None or conv != now.conv:
            if now is not None:
                yield now.row()
            now = _Digest(conv)
        now.add(context, reply, start, end, context_chars)
    if now is not None:
        yield now.row()


def digests(written: DataFrame) -> DataFrame:
    """What reading the examples back gives, a row for each conversation. written: as examples() returns it, conversations whole and in order in a partition."""
    return written.mapInArrow(lambda batches: _in_batches(_digested(_rows(batches)), DIGESTS), DIGESTS)


#: The contract's own conversation, which holds control strings.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (
  SELECT *, row_number() OVER w AS seq, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(12 + length(role) + length(text) + 8 + (length(text) - length(replace(text, '\', '')))
      + (length(text) - length(replace(text, '<turn>', ''))) // 6 + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + (length(text) - length(replace(text, '### ', ''))) // 4) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR seq = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
