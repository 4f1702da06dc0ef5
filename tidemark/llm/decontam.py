"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

A text's tokens are numbers and words.  Numbers and number words, units, and
capitalised words (names, wherever they stand, so that a window's template
does not depend on what precedes it) become typed placeholders; other words
are lower-cased.  A template window is ``SIZE`` canonical tokens in a row, or
all tokens of a shorter item.  Windows of documents are hash-joined to those
windows of benchmark items that have at least half literal tokens.  Matches
of one item at one alignment must have consistent slots: an item's value
always meets the same document value, and the other way round.  A document
is contaminated by an item if consistent alignments cover at least
``COVERAGE`` of the item's usable windows; so verbatim and re-parameterised
copies are both caught.

Beside the templates, every item's literal windows (lower-cased tokens, with
nothing replaced) are joined in the same way, so that verbatim copies are
caught whatever their case is, and whether or not an item is mostly names,
numbers and units.  An item of fewer than ``LEAST`` tokens would be in very
many clean texts; it contaminates those that consist of it.

Scale: document windows are never shuffled; they meet the benchmark's, which
are broadcast while their counted number is at most ``BROADCAST_ROWS`` (else
the join shuffles).  Whole texts are read again only for documents that the
windows alone would condemn.

Defined results: null text has no tokens; items without a token and null item
ids are ignored; rows that repeat id and text count once in ``contaminated``
and go together in ``clean``; extra columns are kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import staged

SIZE, LEAST, COVERAGE, BROADCAST_ROWS = 8, 5, 0.5, 1_000_000
TOKEN = r"[0-9]+(?:[.,:][0-9]+)*|[\p{L}\p{M}\p{N}]+"

# Fixed values. Placeholders are private-use characters.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion dozen "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante mille zwei drei vier fünf sechs sieben acht neun zehn zwölf zwanzig dreißig "
    "vierzig fünfzig hundert tausend dos tres cuatro cinco seis siete ocho nueve diez doce veinte treinta cuarenta cincuenta cien mil"
).split()
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres foot feet inch inches yard yards mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce "
    "ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent "
    "dollar dollars euro euros cent cents usd eur gbp mph kmh jour jours heure heures semaine semaines ans année années seconde secondes mètre mètres kilomètre kilomètres "
    "gramme grammes día días hora horas semana semanas año años minuto minutos segundo segundos metro metros kilómetro kilómetros gramo gramos litro litros"
).split()


def token_hash(token: str) -> int:
    """What xxhash64() gives for a token."""
    found = xxhash.xxh64_intdigest(token.encode(), 42)
    return found - (1 << 64) if found >> 63 else found


SLOTS = {kind: token_hash(kind) for kind in (NUMBER, UNIT, NAME)}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def canonical(text: Column) -> Column:
    """The hashes of a text's canonical tokens, one for each of tokens(text).

    Numbers and capitalised words are replaced in the whole text, then words
    are cut, hashed, and told apart from units and number words by hash.
    """
    start = r"(?<![\p{L}\p{M}\p{N}])"
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), start + r"[0-9]++(?:[.,:][0-9]+)*+", f" {NUMBER} ")
    marked = F.lower(F.regexp_replace(marked, start + r"[\p{Lu}\p{Lt}][\p{L}\p{M}\p{N}]*+", NAME))
    words = F.filter(F.split(marked, rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}{NAME}]+"), lambda w: w != "")

    def typed(h: Column) -> Column:
        return F.when(h.isin(*map(token_hash, NUMBER_WORDS)), F.lit(SLOTS[NUMBER])).when(h.isin(*map(token_hash, UNITS)), F.lit(SLOTS[UNIT])).otherwise(h)

    return F.transform(F.transform(words, lambda w: F.xxhash64(w)), typed)


def literal(text: Column) -> Column:
    """The hashes of a text's lower-cased tokens, numbers being cut at their signs."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def is_slot(canonical_hash: Column) -> Column:
    return canonical_hash.isin(*SLOTS.values())


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, not for each element of an array function inside."""
    return F.transform(F.array(value), use)[0]


def window_hashes(hashes: Column, size: int) -> Column:
    """A hash of each window of size tokens, in order; of all tokens together if size is 0."""

    def windows(own: Column) -> Column:
        if not size:
            return F.array(F.xxhash64(own))
        starts = F.when(F.size(own) >= size, F.sequence(F.lit(0), F.size(own) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(size)]))

    return once(hashes, windows)


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, raw, canonical, literal, size, literal_size): what is matched of each item."""
    text = F.col("text")
    found = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), tokens(text).alias("raw"), canonical(text).alias("canonical"), literal(text).alias("literal"))
    found = found.where(F.size("raw") > 0)

    def size(c: str) -> Column:
        return F.when(F.size(c) >= LEAST, F.least(F.size(c), F.lit(SIZE))).otherwise(0)

    return found.select("item_id", F.transform("raw", F.lower).alias("raw"), "canonical", "literal", size("raw").alias("size"), size("literal").alias("literal_size")).dropDuplicates()


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def item_windows(found: DataFrame) -> DataFrame:
    """(hash, item_id, variant, j, size, typed, n): the usable windows of items; an item id with several texts has several variants."""
    variant = F.xxhash64("raw").alias("variant")
    typed, plain = [], []
    for s in [0, *range(LEAST, SIZE + 1)]:
        if s:
            typed.append(found.where(F.col("size") == s).select("item_id", variant, "canonical", "size", F.posexplode(window_hashes(F.col("canonical"), s)).alias("j", "hash")))
        rows = found.where(F.col("literal_size") == s).select("item_id", variant, F.col("literal_size").alias("size"), F.posexplode(window_hashes(F.col("literal"), s)).alias("j", "hash"))
        plain.append(rows.select("hash", "item_id", "variant", "j", "size", F.lit(False).alias("typed")))
    kept = F.size(F.filter(F.slice("canonical", F.col("j") + 1, F.col("size")), lambda t: ~is_slot(t)))
    usable = union(typed).where(2 * kept >= F.col("size")).select("hash", "item_id", "variant", "j", "size", F.lit(True).alias("typed"))
    usable = usable.unionAll(union(plain))
    count = usable.groupBy("item_id", "variant", "typed").agg(F.count("*").alias("n"))
    return usable.join(count, ["item_id", "variant", "typed"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, item_id, coverage): each contaminated document with each of its items."""
    known = staged(items(benchmark))
    windows = staged(item_windows(known))
    sizes = {(r["typed"], r["size"]): r["count"] for r in windows.groupBy("typed", "size").count().collect()}
    side = F.broadcast(windows) if sum(sizes.values()) <= BROADCAST_ROWS else windows
    # Only hashes leave a row; a pass over the texts for each kind and size of windows: two, unless items are short.
    own = keyed(docs, id_col, text_col)
    matches = [
        own.select("id", "th", F.posexplode(window_hashes((canonical if typed else literal)(F.col("text")), s)).alias("i", "hash")).join(side.where((F.col("size") == s) & (F.col("typed") == typed)), "hash")
        for typed, s in sorted(sizes) or [(True, SIZE)]
    ]
    matched = union(matches).groupBy("id", "th", "item_id", "variant", "typed", (F.col("i") - F.col("j")).alias("offset"))
    aligned = matched.agg(F.collect_set("j").alias("js"), F.max("n").alias("n"), F.max("size").alias("size"))
    likely = aligned.groupBy("id", "th", "item_id", "variant", "typed", "n", "size").agg(F.collect_list(F.struct("offset", "js")).alias("at"))
    likely = staged(likely.withColumn("k", F.size(F.array_distinct(F.flatten(F.col("at.js"))))).where(F.col("k") >= COVERAGE * F.col("n")))
    verbatim, likely = likely.where("not typed").select("id", "th", "item_id", "n", "k"), likely.where("typed").drop("k")
    # Slots are compared in those documents alone.
    per_doc = likely.groupBy("id", "th").agg(F.collect_list(F.struct("item_id", "variant", "n", "size", "at")).alias("hits"))
    texts = keyed(docs, id_col, text_col).withColumnsRenamed({"id": "_id", "th": "_th"})
    own = texts.join(per_doc, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")))
    own = own.select("id", "th", F.transform(tokens(F.col("text")), F.lower).alias("doc_raw"), "hits").select("id", "th", "doc_raw", F.explode("hits").alias("hit"))
    own = own.select("id", "th", "doc_raw", "hit.*").select("id", "th", "doc_raw", "item_id", "variant", "n", "size", F.explode("at").alias("a"))
    texts_of = known.select("item_id", F.xxhash64("raw").alias("variant"), "raw", "canonical")
    both = own.join(texts_of, ["item_id", "variant"])
    places = F.array_distinct(F.flatten(F.transform("a.js", lambda j: F.sequence(j, j + F.col("size") - 1))))
    slots = F.filter(places, lambda p: is_slot(F.get(F.col("canonical"), p)))
    pairs = F.array_distinct(F.transform(slots, lambda p: F.struct(F.get(F.col("raw"), p).alias("x"), F.get(F.col("doc_raw"), p + F.col("a.offset")).alias("y"))))
    fits = both.withColumn("pairs", pairs).where(
        (F.size("pairs") == F.size(F.array_distinct(F.col("pairs.x")))) & (F.size("pairs") == F.size(F.array_distinct(F.col("pairs.y"))))
    )
    covered = fits.select("id", "th", "item_id", "variant", "n", F.explode("a.js").alias("j")).groupBy("id", "th", "item_id", "variant", "n").agg(F.countDistinct("j").alias("k"))
    sure = covered.where(F.col("k") >= COVERAGE * F.col("n")).select("id", "th", "item_id", "n", "k").unionAll(verbatim)
    return sure.groupBy(F.col("id").alias("doc_id"), "th", "item_id").agg(F.max(F.col("k") / F.col("n")).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the contaminated ones."""
    found = staged(contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct())
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(docs[text_col]) == found["_th"]), "left_anti")


#: The same in DuckDB, with the windows themselves in place of their hashes.
ORACLE_SQL = f"""
WITH toks AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,:][0-9]+)*|[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS raw,
    regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS literal FROM documents),
itoks AS (
  SELECT DISTINCT item_id, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,:][0-9]+)*|[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS raw,
    regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS literal FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT DISTINCT doc_id, text, list_transform(raw, lambda t: lower(t)) AS raw, list_transform(raw, lambda t: CANON) AS canonical FROM toks),
b AS (
  SELECT item_id, list_transform(raw, lambda t: lower(t)) AS raw, list_transform(raw, lambda t: CANON) AS canonical, least(len(raw), {SIZE}) AS size
  FROM itoks WHERE len(raw) >= {LEAST}),
bw AS (SELECT item_id, raw, canonical, size, unnest(range(0, len(canonical) - size + 1)) AS j FROM b),
bu AS (
  SELECT item_id, raw, canonical, size, j, list_slice(canonical, j + 1, j + size) AS w, count(*) OVER (PARTITION BY item_id, raw) AS n FROM bw
  WHERE 2 * len(list_filter(list_slice(canonical, j + 1, j + size), lambda t: t NOT IN ('#', '@', '&'))) >= size),
dw AS (
  SELECT doc_id, text, raw, list_slice(canonical, i + 1, i + size) AS w, i FROM (
    SELECT doc_id, text, raw, canonical, size, unnest(range(0, len(canonical) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM bu))),
m AS (SELECT dw.doc_id, dw.text, dw.raw AS draw, bu.item_id, bu.raw, bu.canonical, bu.size, bu.n, bu.j, dw.i - bu.j AS o FROM dw JOIN bu ON dw.w = bu.w),
pairs AS (
  SELECT DISTINCT doc_id, text, item_id, raw, o, raw[p + 1] AS x, draw[p + o + 1] AS y FROM (SELECT *, unnest(range(j, j + size)) AS p FROM m)
  WHERE canonical[p + 1] IN ('#', '@', '&')),
bad AS (
  SELECT doc_id, text, item_id, raw, o FROM pairs GROUP BY ALL HAVING count(*) <> count(DISTINCT x) OR count(*) <> count(DISTINCT y)),
k AS (
  SELECT m.doc_id, m.text, m.item_id, m.raw, m.n, count(DISTINCT m.j) AS k FROM m ANTI JOIN bad
  ON m.doc_id IS NOT DISTINCT FROM bad.doc_id AND m.text = bad.text AND m.item_id = bad.item_id AND m.raw = bad.raw AND m.o = bad.o GROUP BY ALL),
lb AS (SELECT DISTINCT item_id, literal, CASE WHEN len(literal) >= {LEAST} THEN least(len(literal), {SIZE}) ELSE 0 END AS size FROM itoks WHERE len(raw) > 0),
lw AS (
  SELECT item_id, literal, size, j, CASE WHEN size = 0 THEN literal ELSE list_slice(literal, j + 1, j + size) END AS w, count(*) OVER (PARTITION BY item_id, literal) AS n FROM (
    SELECT item_id, literal, size, unnest(range(0, CASE WHEN size = 0 THEN 1 ELSE len(literal) - size + 1 END)) AS j FROM lb)),
ld AS (
  SELECT doc_id, text, size, CASE WHEN size = 0 THEN literal ELSE list_slice(literal, i + 1, i + size) END AS w FROM (
    SELECT doc_id, text, literal, size, unnest(range(0, CASE WHEN size = 0 THEN 1 ELSE len(literal) - size + 1 END)) AS i FROM (SELECT DISTINCT doc_id, text, literal FROM toks), (SELECT DISTINCT size FROM lw))),
lk AS (SELECT ld.doc_id, ld.text, lw.item_id, lw.literal, lw.n, count(DISTINCT lw.j) AS k FROM ld JOIN lw ON ld.w = lw.w AND ld.size = lw.size GROUP BY ALL)
SELECT doc_id, item_id, max(k / n) AS coverage FROM (SELECT doc_id, text, item_id, n, k FROM k UNION ALL SELECT doc_id, text, item_id, n, k FROM lk) WHERE k >= {COVERAGE} * n GROUP BY doc_id, text, item_id
""".replace(
    "CANON",
    f"CASE WHEN t[1] BETWEEN '0' AND '9' OR lower(t) IN ({', '.join(repr(w) for w in NUMBER_WORDS)}) THEN '#' WHEN lower(t) IN ({', '.join(repr(w) for w in UNITS)}) THEN '@' WHEN t[1] <> lower(t[1]) THEN '&' ELSE lower(t) END",
)
