import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= 3:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in prints}


TEXTS = ["", None, "One", "one two", "a b c d e f g", "A B C d e f g", "x\ty\nz w v u", "Été vu " * 40, " \n", "a b c " * 30_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_every_close_pair_shares_a_home_anchor():
    rng = np.random.default_rng(1)
    values = np.r_[rng.integers(0, 1 << 31, 2000), [0, (1 << 31) - 1]]
    index, anchor, home = simhash.anchors(values)
    assert (np.bincount(index[home]) == 1).all()
    seen = {}
    for i, a, h in zip(index.tolist(), anchor.tolist(), home.tolist()):
        assert int(values[i] ^ a).bit_count() <= (1 if h else 2)
        seen.setdefault(i, set()).add(a)
    homes = dict(zip(index[home].tolist(), anchor[home].tolist()))
    for i in range(0, len(values), 50):
        near = values[i] ^ (1 << rng.integers(0, 31))
        assert homes[i] in set(simhash.anchors(np.array([near]))[1].tolist())


@pytest.mark.parametrize("cell", [3, 2048])
def test_groups_match_brute_force(spark, cell):
    rng = np.random.default_rng(2)
    base = " ".join(f"w{i}" for i in rng.integers(0, 50, 120))
    rows = [(100 + i, t) for i, t in enumerate(TEXTS)]
    for i in range(60):
        words = base.split()
        for _ in range(i % 3):
            words[rng.integers(0, 120)] = f"z{rng.integers(0, 9)}"
        rows.append((500 - i, " ".join(words)))
    rows += [(i, " ".join(f"u{j}" for j in rng.integers(0, 999, 40))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.groups(docs, cell=cell).collect()}
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    roots = brute_components(prints)
    assert found == {d: (f"{p:016x}", roots[d]) for d, p in prints}


@pytest.mark.parametrize("cell", [4, 20, 8192])
def test_links_of_planted_distances(spark, cell):
    rng = np.random.default_rng(3)
    prints = []
    for x in rng.integers(0, 1 << 63, 60).tolist():
        for n in (0, 1, 2, 3, 4, 7):
            y = x
            for b in rng.choice(64, n, replace=False).tolist():
                y ^= 1 << b
            prints.append(y)
    rows = [(y - (1 << 64) if y >> 63 else y,) for y in dict.fromkeys(prints)]
    frame = spark.createDataFrame(rows, "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(frame.withColumn("node", F.col("fp")), ["fp"], [], cell=cell)).collect()}
    mask = (1 << 64) - 1
    roots = brute_components([(f, f & mask) for (f,) in sorted(rows)])
    assert {f: found.get(f, f) for (f,) in rows} == roots


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "u long, v long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_repeated_rows_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (1, "a b c", 6), (None, "a b c", 7), (3, None, 8)], "doc_id long, text string, fp int")
    rows = simhash.groups(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in rows) == [(False, 1, 1), (False, 1, 1), (False, 3, 3), (True, 0, 1)]
    kept = simhash.near_dedup(docs).collect()
    assert sorted((r.doc_id, r.text, r.fp) for r in kept) == [(1, "a b c", 5), (3, None, 8)]
    assert simhash.groups(docs.limit(0)).count() == 0 and simhash.near_dedup(docs.limit(0)).columns == docs.columns and simhash.near_dedup(docs.limit(0)).count() == 0


def similarity(a, b):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("cell", [5, 8192])
def test_near_dedup_keeps_one_of_each_group(spark, cell):
    """All copies with a similarity of 0.87 or more go, and nothing that brute force does not link at 0.8."""
    rng = np.random.default_rng(6)
    common = [f"c{i}" for i in range(60)]
    docs, doc = [], 1000
    for family in range(25):
        base = [common[k] if k < 60 else f"f{family}x{k}" for k in rng.integers(0, 400, 220).tolist()]
        for edits in (0, 1, 2, 3, 8, 40):
            words = list(base)
            for at in rng.choice(220, edits, replace=False).tolist():
                words[at] = f"e{rng.integers(0, 10**6)}"
            docs.append((doc, " ".join(words)))
            doc -= 1
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), cell=cell).collect()}
    text = dict(docs)
    root = {d: d for d in text}
    sure = {d: d for d in text}
    for where, least in ((root, 0.8), (sure, 0.87)):
        for a in text:
            for b in range(a + 1, min(a + 6, 1001)):
                if b in text and similarity(text[a], text[b]) >= least:
                    p, q = a, b
                    while where[p] != p:
                        p = where[p]
                    while where[q] != q:
                        q = where[q]
                    where[max(p, q)] = min(p, q)
    assert {d for d in text if root[d] == d} <= kept <= {d for d in text if sure[d] == d}


def test_near_dedup_of_odd_columns_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, {"k": 1}, 1, 5), (1, long, {"k": 1}, 1, 4), (2, long + " end", {"k": 2}, 2, 3), (1, "another text of its own", {"k": 3}, 3, 2), (None, None, None, None, 1), (None, None, {"k": 1}, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a map` map<string,int>, _node int, _first int")
    found = simhash.near_dedup(docs)
    assert found.schema.names == docs.schema.names
    assert sorted((r.doc_id or 0, (r.text or "")[:7], r._first) for r in found.collect()) == [(0, "", 1), (1, "another", 2), (1, "w0 w1 w", 4)]


def test_similar_texts_are_linked_though_a_nearer_neighbour_is_not(spark):
    """Every pair from 0.8 on is in one group, also in large families where most neighbours are less similar than that."""
    rng = np.random.default_rng(9)
    texts = []
    for family in range(4):
        base = [f"f{family}x{k}" for k in rng.integers(0, 10**6, 90).tolist()]
        for _ in range(60):
            words = list(base)
            for at in rng.choice(90, rng.integers(1, 6), replace=False).tolist():
                words[at] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    texts += ["a b c d e f g h", "a b c d e f g h i", "A b c  d e f g h", " \n", "", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    node = {r.doc_id: r.node for r in docs.select("doc_id", F.xxhash64("text").alias("node")).collect()}
    for cell in (30, 8192):
        found = {r.node: r.root for r in simhash.components(simhash.similar(docs, cell=cell)).collect()}
        root = {d: d for d in node}
        for a in node:
            for b in range(a):
                if similarity(texts[a], texts[b]) >= 0.8 and root[a] != root[b]:
                    old = root[a]
                    root = {d: root[b] if r == old else r for d, r in root.items()}
        groups = {}
        for d in node:
            groups.setdefault(found.get(node[d], node[d]), set()).add(d)
        brute = {}
        for d, r in root.items():
            brute.setdefault(r, set()).add(d)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_rows_do_not_grow_with_the_square_of_a_group_of_near_copies(spark, monkeypatch):
    """Copies with changed words of their own and with words that many change alike, most of them less similar than 0.8: every link is found, with no more rows than places in prefixes."""
    rng = np.random.default_rng(12)
    texts = []
    for family in range(2):
        base = [f"f{family}x{k}" for k in rng.integers(0, 10**6, 90).tolist()]
        for _ in range(120):
            words = list(base)
            for at in rng.choice(90, 2, replace=False).tolist():
                words[at] = f"b{at}" if family else f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    node = {r.doc_id: r.node for r in docs.select("doc_id", F.xxhash64("text").alias("node")).collect()}
    rows, staged = [], simhash.staged

    def counted(frame):
        out = staged(frame)
        if out.columns == ["u", "v"]:
            rows.append(out.count())
        return out

    monkeypatch.setattr(simhash, "staged", counted)
    monkeypatch.setattr(simhash, "HELD", 1500, raising=False)
    links = [(r.u, r.v) for r in simhash.similar(docs).collect()]
    assert max(rows) <= sum(86 - 69 + 1 for _ in texts)
    monkeypatch.undo()
    brute = [(a, b) for a in node for b in range(a) if similarity(texts[a], texts[b]) >= 0.8]

    def parts(pairs):
        root = {n: n for n in node.values()}
        for a, b in pairs:
            if root[a] != root[b]:
                old = root[a]
                root = {n: root[b] if r == old else r for n, r in root.items()}
        return sorted(sorted(n for n in root if root[n] == r) for r in set(root.values()))

    assert brute and parts(links) == parts((node[a], node[b]) for a, b in brute)
