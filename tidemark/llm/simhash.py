"""SimHash near-duplicate groups by anchor-point covering.

A fingerprint's 64 bits are taken as two 31-bit halves (one bit of each
32-bit half is left out of the key, never out of the comparison).  Two
fingerprints that differ in at most three bits differ in at most one bit of
at least one half.  The code words of the perfect [31,26] Hamming code are the
anchors of a half: every value lies within covering radius 1 of exactly one.
Each fingerprint is replicated to every anchor within radius + threshold = 2
of it (16 of 2**26, or 1 where the value is itself a code word), and is "at
home" at the one within radius 1.  If a and b differ in one bit of the half,
b is at a's home anchor too, so comparing homes with members, anchor by
anchor, finds every link exactly, with no cap.

``groups`` links fingerprints of 3-word shingles within three bits.
``near_dedup`` links texts of which at least ``SIMILAR`` of the 5-word shingles are
shared (Jaccard).  A few changed words change many shingles, and with them
more bits than anchors can cover; so a text is dealt by fingerprints of its
single words, ``SEEDS`` of them, of which near copies change few bits.  Where two texts meet at an anchor, fingerprints of their 5-word shingles
of 64 * ``WORDS`` bits are compared, and links that these show are checked by the
shingles themselves.

Work and memory at scale:

* exact copies collapse to one node before anything is compared;
* members of an anchor are compared in cells of at most ``cell`` homes by
  ``cell`` members, an overfull anchor being dealt over a grid of cells by
  hash, so no task ever holds a whole group;
* a cell of more than ``SMALL`` rows returns a spanning forest of its links (at
  most one row per member), the closest first, never all pairs of a group of near copies;
* components come from alternating large-star / small-star rounds on
  checkpointed edge tables; the driver only sees one count per round;
* a forest of links that the shingles then refute may leave out others that they would
  not, and some similar texts meet at no anchor; so texts that share one of the least
  fifth of their shingles' hashes, as every two with a similarity of ``SIMILAR`` do, and that are in
  different groups yet, are looked at as well.  Those that their sizes and fingerprints allow a link meet
  once more at the rarest fifth of their shingles, counted among themselves; what may be linked then falls into blocks, and a
  block's texts are compared by their shingles in cells of at most ``HELD`` of these.  Every one of
  these steps returns forests, at most one row per member of a cell, or ``SMALL`` - 1 for two members of a small one, never all pairs;
* a sieve of bounded size keeps texts without a link from being shuffled.

Defined results: null text counts as empty; texts without words have
fingerprint zero and are linked like any other; repeated rows come back once
each from ``groups``, and once from ``near_dedup``; a null doc_id is kept and never
becomes a component_id unless it has no other id to take; extra columns, of any type
and name, are ignored by ``groups`` and kept by ``near_dedup``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import returning, staged
from tidemark.llm.sieve import fresh, held, sieve

THRESHOLD = 3
CELL, SMALL = 8192, 8
SHINGLE = 3
#: Of near_dedup: words a shingle, the least similarity, fingerprints of single words, 64-bit words of a shingle fingerprint, and its bits that may differ, closest first.
SHINGLE_STAGE, SIMILAR, SEEDS, WORDS, LEVELS = 5, 0.8, 2, 4, (16, 32, 52)
#: Texts with a similarity of SIMILAR differ in about 39 of 256 bits, give or take 6 (with FEW shingles in up to 48), so next to no pair differs in more than BITS (with few, else).
FEW, BITS = 20, (80, 68)
_CHECKS = [f"check{i}" for i in range(WORDS)]
#: Shingles of homes, and of members, in a cell of texts that are compared by these; of a home, so many neighbours first, the nearest, then twice as many.
HELD, FIRST = 1 << 19, 16
_STEP = 1 << 13

#: Syndrome of every 16-bit low part and 15-bit high part of a 31-bit value:
#: the XOR of the (one-based) positions of its set bits.
_LOW = np.zeros(1 << 16, np.int64)
_HIGH = np.zeros(1 << 15, np.int64)
for _i in range(16):
    _LOW[1 << _i : 2 << _i] = _LOW[: 1 << _i] ^ (_i + 1)
for _i in range(15):
    _HIGH[1 << _i : 2 << _i] = _HIGH[: 1 << _i] ^ (_i + 17)


def _shingles(words: list[bytes], size: int) -> list[bytes]:
    if not words:
        return []
    join = b" ".join
    return [join(words)] if len(words) < size else [join(s) for s in zip(*(words[i:] for i in range(size)), strict=False)]


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit words, the bits that are set in over half of the rows, as such words."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), _STEP):
        part = np.ascontiguousarray(hashes[at : at + _STEP].astype(">u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text; repeated shingles count anew."""
    shingles = _shingles((text or "").encode().lower().split(), size)
    if not shingles:
        return 0
    digest = xxhash.xxh64_intdigest
    return int(_majority(np.fromiter((digest(s, 42) for s in shingles), np.uint64).reshape(-1, 1))[0])


def _spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """Each hash as a row of so many independent words."""
    h = hashes[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _signature(text: str | None) -> tuple[np.ndarray, tuple[int, np.ndarray]]:
    """The signature of a text, the number of its distinct shingles, and the least of their hashes, in order: so many that two texts with a similarity of SIMILAR share one."""
    words = (text or "").encode().lower().split()
    out, digest = [], xxhash.xxh64_intdigest
    for parts, n in ((set(words), SEEDS), (set(_shingles(words, SHINGLE_STAGE)), WORDS)):
        hashes = np.fromiter((digest(p, 42) for p in parts), np.uint64, len(parts))
        out.append(_majority(_spread(hashes, n)) if parts else np.zeros(n, np.uint64))
    hashes = np.unique(hashes)
    # A pair shares SIMILAR of either's shingles, so the least shared one is among these; texts without words meet at 0.
    prefix = hashes[: len(hashes) - math.ceil(SIMILAR * len(hashes) - 1e-6) + 1] if len(hashes) else np.zeros(1, np.uint64)
    return np.concatenate(out), (max(len(hashes), 1), prefix)


def signature(text: str | None) -> np.ndarray:
    """SEEDS fingerprints of a text's distinct words, then WORDS words of the fingerprint of its distinct shingles."""
    return _signature(text)[0]


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [_signature(t.as_py()) for t in batch.column(1)]
        rows = np.array([s for s, _ in both], np.uint64).reshape(-1, SEEDS + WORDS).view(np.int64)
        names = ["node", *[f"band{i}" for i in range(SEEDS)], *[f"check{i}" for i in range(WORDS)], "n", "prefix"]
        both = [p for _, p in both]
        sizes, lists = pa.array([n for n, _ in both], pa.int64()), pa.array([p.view(np.int64) for _, p in both], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in rows.T], sizes, lists], names=names)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document, fp as a signed long."""
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return two.mapInArrow(returning(_fingerprint_batches), "doc_id long, fp long")


def halves(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two 31-bit halves of signed fingerprints."""
    bits = prints.view(np.uint64)
    return (bits & np.uint64(0x7FFFFFFF)).astype(np.int64), (bits >> np.uint64(33)).astype(np.int64)


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into values, anchor, at home) for every anchor within distance 2."""
    syndrome = _LOW[values & 0xFFFF] ^ _HIGH[values >> 16]
    word = np.flatnonzero(syndrome == 0)
    rest = np.flatnonzero(syndrome)
    index, anchor, home = [word], [values[word]], [np.ones(len(word), bool)]
    flip = np.concatenate([[0], 1 << np.arange(31, dtype=np.int64)])
    for i in range(32):
        j = syndrome[rest] ^ i
        use = i < j
        at = rest[use]
        index.append(at)
        anchor.append(values[at] ^ flip[i] ^ flip[j[use]])
        home.append(np.full(len(at), i == 0))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _anchor_batches(bands: int, alone: bool = False):
    """From rows (node, bands, checks): (anchor, node, home, checks) at every anchor in reach, or the anchors alone."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(part.num_columns)]
                for band in range(bands):
                    for half, values in enumerate(halves(columns[1 + band])):
                        index, anchor, home = anchors(values)
                        rows = [pa.array(anchor * (2 * bands) + 2 * band + half)]
                        names = ["anchor"]
                        if not alone:
                            rows += [pa.array(columns[0][index]), pa.array(home), *[pa.array(c[index]) for c in columns[1 + bands :]]]
                            names += ["node", "home", *part.schema.names[1 + bands :]]
                        yield pa.RecordBatch.from_arrays(rows, names=names)

    return batches


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def forest(nodes: np.ndarray, checks: np.ndarray, homes: np.ndarray, levels: tuple[int, ...] = (THRESHOLD,)) -> list[tuple[int, int]]:
    """A spanning forest of the links between homes (places) and all; each edge is a pair within the last level, found at the first level that joins its ends."""
    label, edges = np.arange(len(nodes)), []
    for level in levels:
        for h in homes.tolist():
            near = np.flatnonzero(_apart(checks, checks[h]) <= level)
            own, first = np.unique(label[near], return_index=True)
            if len(own) > 1:
                edges += [(nodes[h], nodes[m]) for m, k in zip(near[first].tolist(), own.tolist(), strict=True) if k != label[h]]
                label[np.isin(label, own)] = own[0]
    return [(max(a, b), min(a, b)) for a, b in edges if a != b]


def _by_cell(compared):
    """For mapInArrow over rows (anchor, cell, ...) sorted by these: compared() is given runs of complete cells."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in found:
            if not batch.num_rows:
                continue
            rows = tuple(c.to_numpy(zero_copy_only=False).astype(object if pa.types.is_nested(c.type) else np.int64) for c in batch.columns)
            if not kept or (kept[-1][0][-1], kept[-1][1][-1]) != (rows[0][-1], rows[1][-1]):
                cut = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
                cut = cut[-1] + 1 if len(cut) else 0
                done = [*kept, tuple(r[:cut] for r in rows)]
                if sum(len(r[0]) for r in done):
                    yield from compared(done)
                kept = [tuple(r[cut:] for r in rows)]
            else:
                kept.append(rows)
        if kept:
            yield from compared(kept)

    return batches


def _cell_batches(levels: tuple[int, ...]):
    """Rows (anchor, cell, node, home, checks) come sorted by anchor and cell; a cell is compared when it is complete."""

    def compared(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        anchor, cell, node, home, *checks = (np.concatenate(c) for c in zip(*rows, strict=True))
        home = home > 0
        checks = np.stack(checks or [node], axis=1).view(np.uint64)
        starts, sizes = _cells(anchor, cell)
        group, small = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes <= SMALL, sizes)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for step in range(1, SMALL):  # small cells, all at once
            i = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]) & (home[:-step] | home[step:]) & (node[:-step] != node[step:])) if step < len(group) else np.empty(0, np.int64)
            if not len(i):
                continue
            i = i[_apart(checks[i], checks[i + step]) <= levels[-1]]
            found.append((np.maximum(node[i], node[i + step]), np.minimum(node[i], node[i + step])))
        some = np.add.reduceat(home.astype(np.int64), starts) > 0
        for k in np.flatnonzero((sizes > SMALL) & some).tolist():
            a, b = starts[k], starts[k] + sizes[k]
            edges = forest(node[a:b], checks[a:b], np.flatnonzero(home[a:b]), levels)
            if edges:
                found.append(tuple(np.array(c, np.int64) for c in zip(*edges, strict=True)))
        u, v = (np.concatenate(c) for c in zip(*found, strict=True))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return _by_cell(compared)


def _meeting_batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, cell, node, home, label, n, left, checks) sorted by anchor and cell: of each cell, pairs that span the groups of nodes which may be
    similar and have different labels; of cells of up to SMALL rows, all such pairs.
    n is a node's number of shingles, left of which are not before the anchor in order."""

    def compared(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        anchor, cell, node, home, label, n, left, *checks = (np.concatenate(c) for c in zip(*rows, strict=True))
        checks = np.stack(checks, axis=1).view(np.uint64)
        starts, sizes = _cells(anchor, cell)
        group, small = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes <= SMALL, sizes)
        for step in range(1, min(SMALL, len(group))):
            i = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]) & (label[:-step] != label[step:]))
            i = i[_may_link(n[i], left[i], n[i + step], left[i + step], _apart(checks[i], checks[i + step]))]
            if len(i):
                yield _pairs(node[i], node[i + step])
        several = np.maximum.reduceat(label, starts) != np.minimum.reduceat(label, starts)
        for k in np.flatnonzero((sizes > SMALL) & several).tolist():
            own = slice(starts[k], starts[k] + sizes[k])
            nodes, labels, marks, sizes_, lefts = node[own], label[own], checks[own], n[own], left[own]
            tree, edges = np.arange(len(nodes)), []
            for h in np.flatnonzero(home[own]).tolist():
                near = np.flatnonzero((tree != tree[h]) & (labels != labels[h]))
                near = near[_may_link(sizes_[near], lefts[near], sizes_[h], lefts[h], _apart(marks[near], marks[h]))]
                edges += _joined(tree, h, near)
            if edges:
                yield _pairs(*nodes[np.array(edges).T])

    return _by_cell(compared)(found)


def _sharing_batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, cell, node, home, label, checks, shingles) sorted by anchor and cell: of each cell, links that span the groups of nodes which share at
    least SIMILAR of their shingles, but for what the labels have in one group already."""

    def compared(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        anchor, cell, node, home, label, *checks, shingles = (np.concatenate(c) for c in zip(*rows, strict=True))
        checks = np.stack(checks, axis=1).view(np.uint64)
        n = np.fromiter(map(len, shingles), np.int64, len(shingles))
        for start, size in zip(*_cells(anchor, cell), strict=True):
            own = slice(start, start + size)
            labels, marks, sizes, sets, edges = label[own].copy(), checks[own], n[own], shingles[own], []
            for h in np.flatnonzero(home[own]).tolist():
                near = np.flatnonzero(labels != labels[h])
                bits = _apart(marks[near], marks[h])
                may = _may_link(sizes[near], sizes[near], sizes[h], sizes[h], bits)
                near = near[may][np.argsort(bits[may], kind="stable")]
                step = FIRST
                while len(near):
                    part, near, step = near[:step], near[step:], 2 * step
                    shared = _shared(sets[h], sets[part])
                    edges += _joined(labels, h, part[shared >= SIMILAR * (sizes[h] + sizes[part] - shared)])
                    near = near[labels[near] != labels[h]]
            if edges:
                yield _pairs(*node[own][np.array(edges).T])

    return _by_cell(compared)(found)


def _cells(anchor: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the cells of sorted rows start, and their sizes."""
    starts = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])])
    return starts, np.diff(np.r_[starts, len(anchor)])


def _joined(group: np.ndarray, h: int, near: np.ndarray) -> list[tuple[int, int]]:
    """The edges from h by which the groups of near become its own: one to each of them."""
    own, first = np.unique(group[near], return_index=True)
    edges = [(h, m) for m in near[first].tolist() if group[m] != group[h]]
    if edges:
        group[np.isin(group, own)] = group[h]
    return edges


def _shared(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of the elements of one each of others has; all are sorted, distinct and not empty."""
    flat, starts = np.concatenate(others), np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat(one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat, starts, dtype=np.int64)


def _may_link(n: np.ndarray, left: np.ndarray, m: np.ndarray, right: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether texts of n and m shingles may be similar, if the first of those that they share leaves left and right of them; and their fingerprints allow it."""
    enough = (1 + SIMILAR) * np.minimum(left, right) >= SIMILAR * (n + m) - 1e-6
    return enough & (bits <= np.where(np.minimum(n, m) < FEW, *BITS))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])


def _in_cells(dealt: DataFrame, sizes: DataFrame, more: list[str], cell: int) -> DataFrame:
    """Rows (anchor, node, home, more) as (anchor, cell, node, home, more), sorted by anchor and cell; sizes: (anchor, n) of those with more than cell rows."""
    spread = dealt.join(sizes.select("anchor", F.ceil(F.col("n") / cell).cast("int").alias("k")), "anchor", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    # A grid of k x k cells: a home lies in one row of it, a member in one column; each pair meets in one cell.
    mine = F.pmod(F.xxhash64("node"), F.col("k"))
    across = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct((mine * F.col("k") + i).alias("cell"), F.lit(True).alias("home")))
    down = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct((i * F.col("k") + mine).alias("cell"), F.lit(False).alias("home")))
    single = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.col("home")))
    cells = F.when(F.col("k") == 1, single).when(F.col("home"), F.concat(across, down)).otherwise(down)
    met = spread.select("anchor", "node", *more, F.explode(cells).alias("c")).select("anchor", F.col("c.cell").cast("long").alias("cell"), "node", "c.home", *more)
    return met.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")


def links(prints: DataFrame, bands: list[str], checks: list[str], levels: tuple[int, ...] = (THRESHOLD,), cell: int = CELL) -> DataFrame:
    """(u, v), u > v: links that span the groups of nodes (column node) which share an anchor of a band and differ in few bits of checks (without any: of node)."""
    # Nodes are small and make many rows, so they are dealt to all tasks, whatever their size.
    rows = prints.select("node", *bands, *checks).repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    sizes = rows.select("node", *bands).mapInArrow(returning(_anchor_batches(len(bands), alone=True)), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    dealt = rows.mapInArrow(returning(_anchor_batches(len(bands))), "anchor long, node long, home boolean" + "".join(f", {c} long" for c in checks))
    met = _in_cells(dealt, staged(sizes), checks, cell)
    return met.mapInArrow(returning(_cell_batches(levels)), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge; large-star and small-star rounds."""
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # Large star: every larger neighbour of a node hangs from the node's smallest neighbour (or itself).
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large)
        # Small star: a node's smaller neighbours and the node itself hang from the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(now)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """(doc_id, fingerprint, component_id, component_size): one row per row of docs."""
    each = staged(fingerprints(docs, id_col, text_col))
    distinct = staged(each.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")))
    found = components(links(distinct.withColumn("node", F.col("fp")), ["fp"], [], cell=cell))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "doc", "n", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted)
    total = rooted.groupBy("root").agg(F.min("doc").alias("component_id"), F.sum("n").alias("component_size"))
    named = staged(rooted.join(total, "root").select("fp", "component_id", "component_size"))
    return each.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size"
    )


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        parts = [_shingles((t.as_py() or "").encode().lower().split(), SHINGLE_STAGE) for t in batch.column(1)]
        # As signed numbers, in order; texts without words share a 0.
        sets = [np.unique(np.array([digest(s, 42) for s in set(p)] or [0], np.uint64).view(np.int64)) for p in parts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def _sets(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """(node, shingles): the distinct shingles of every text, by node in keyed, that is in one of the pairs (u, v)."""
    ends = staged(pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct())
    some = sieve(ends.select(F.xxhash64("node")))
    texts = held(keyed, F.xxhash64("node"), some).join(ends, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    return staged(texts.mapInArrow(returning(_shingle_batches), "node long, shingles array<long>"))


def _linked(likely: DataFrame, keyed: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose texts, by node in keyed, share at least SIMILAR of their shingles."""
    sets = _sets(likely, keyed)
    both = likely.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return staged(both.where(shared >= SIMILAR * (F.size("a") + F.size("b") - shared)).select("u", "v"))


def _rarest(texts: DataFrame) -> DataFrame:
    """From (node, label, checks, shingles): (anchor, node, label, n, left, checks), a row for each shingle of a text's prefix that another label has too. In
    order, shingles that only one label has come first, as no pair meets there, then those that few texts have."""
    each = texts.select("node", "label", F.explode("shingles").alias("anchor"))
    times = each.groupBy("anchor").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("times")).where("low <> high").select("anchor", "times")
    order = each.join(times, "anchor").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "anchor"))).alias("order"))
    n, others = F.size("shingles"), F.size("order")
    # As in _signature a prefix of so many, of which those that no other label has are the first.
    prefix = F.least(others, n - F.ceil(SIMILAR * n - F.lit(1e-6)) + 1 - (n - others)).cast("int")
    first = texts.join(order, "node").where(prefix > 0)
    return first.select("node", "label", others.alias("others"), n.alias("n"), *_CHECKS, F.posexplode(F.slice("order", F.lit(1), prefix)).alias("at", "own")).select(
        F.col("own.anchor").alias("anchor"), "node", "label", "n", (F.col("others") - F.col("at")).alias("left"), *_CHECKS
    )


def _meetings(rows: DataFrame, sizes: DataFrame, cell: int) -> DataFrame:
    """(u, v), u > v: pairs that span the groups of nodes which meet at an anchor and may be similar, from (anchor, node, label, n, left, checks); sizes as for _in_cells."""
    met = _in_cells(rows.withColumn("home", F.lit(True)), sizes, ["label", "n", "left", *_CHECKS], cell)
    return staged(met.mapInArrow(returning(_meeting_batches), "u long, v long").distinct())


def _blocks(likely: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v), u > v: links that span the groups of texts, (node, label, checks, shingles), which share at least SIMILAR of their shingles; only texts that the pairs (u, v) connect are compared."""
    ends = staged(likely.select(F.col("u").alias("node")).unionAll(likely.select(F.col("v").alias("node"))).distinct())
    rows = texts.join(ends, "node", "left_semi").join(components(likely), "node", "left").withColumn("anchor", F.coalesce("root", "node")).withColumn("home", F.lit(True))
    rows = staged(rows.select("anchor", "node", "home", "label", *_CHECKS, "shingles"))
    # A cell's size is its number of shingles, but no grid has more rows than there are texts.
    sizes = rows.groupBy("anchor").agg(F.least(F.sum(F.size("shingles")), F.count("*") * HELD).alias("n")).where(F.col("n") > HELD)
    met = _in_cells(rows, staged(sizes), ["label", *_CHECKS, "shingles"], HELD)
    return staged(met.mapInArrow(returning(_sharing_batches), "u long, v long"))


def similar(docs: DataFrame, text_col: str = "text", cell: int = CELL) -> DataFrame:
    """(u, v): links that span the groups of texts, by their xxhash64, which share at least SIMILAR of their shingles."""
    keyed = docs.select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text"))
    bands, checks = [f"band{i}" for i in range(SEEDS)], _CHECKS
    each = keyed.mapInArrow(returning(_signature_batches), "node long" + "".join(f", {c} long" for c in bands + checks) + ", n long, prefix array<long>")
    each = staged(each)
    nodes = each.groupBy("node").agg(*[F.min(c).alias(c) for c in bands + checks])
    found = _linked(staged(links(nodes, bands, checks, LEVELS, cell).distinct()), keyed)

    # What the forests left out, as a link of theirs did not hold, and what met at no anchor: texts that share a shingle of their prefixes.
    keys = each.select("node", "n", *checks, F.posexplode("prefix").alias("at", "anchor")).select("anchor", "node", "n", (F.col("n") - F.col("at")).alias("left"), *checks)
    counts = keys.groupBy("anchor").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
    counts = staged(counts.where("low <> high").select("anchor", "n"))
    shared = held(keys, F.xxhash64("anchor"), sieve(counts.select(F.xxhash64("anchor"))))
    roots = staged(components(found).select("node", F.col("root").alias("label")))
    rows = shared.join(counts.select("anchor"), "anchor", "left_semi").distinct().join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = staged(rows)
    # Groups of one label have nothing more to find.
    apart = rows.groupBy("anchor").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("anchor")
    likely = _meetings(rows.join(apart, "anchor", "left_semi"), staged(counts.where(F.col("n") > cell)), cell)

    # Most of these pairs share too little, as each text has shingles that few others have: by the rarest ones far fewer meet.
    texts = _sets(likely, keyed).join(nodes.select("node", *checks), "node").join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))
    texts = staged(texts)
    rows = staged(_rarest(texts))
    sizes = staged(rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > cell))
    return staged(found.unionAll(_blocks(_meetings(rows, sizes, cell), texts)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """docs without all but one row of each group: the one with the smallest doc_id; of rows that repeat it, the first in order of text and the other columns."""
    found = components(similar(docs, text_col, cell))
    each = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("node"))
    copies = each.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    rooted = staged(copies.join(found, "node", "left").select("node", "id", "n", F.coalesce("root", "node").alias("root")))
    groups_ = rooted.groupBy("root").agg(F.min("id").alias("least"), F.sum("n").alias("n")).where("n > 1")
    # Texts of groups of more than one row; all others stay as they are.
    own = staged(rooted.join(groups_.select("root", "least"), "root").select("node", "root", "least"))
    some = sieve(own.select(F.xxhash64("node")))
    node, least, root, rest = (fresh(n, docs.columns) for n in ("_node", "_least", "_root", "_rest"))
    key = F.xxhash64(F.xxhash64(text_col))
    maybe = held(docs, key, some).withColumn(node, F.xxhash64(text_col))
    marked = maybe.join(own.select(F.col("node").alias(node), F.col("least").alias(least), F.col("root").alias(root)), node, "left")
    single = marked.where(F.col(root).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    # The rows with the smallest id of their groups; of several, one.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = marked.where(F.col(root).isNotNull() & F.col(f"`{id_col}`").eqNullSafe(F.col(least)))
    kept = kept.groupBy(root).agg(F.min_by(row, F.struct(F.col(f"`{text_col}`"), row.cast("string"))).alias(rest))
    kept = kept.select(*[F.col(rest).getField(c).alias(c) for c in docs.columns])
    return held(docs, key, some, wanted=False).unionAll(single).unionAll(kept)
