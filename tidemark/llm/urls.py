"""URL filter by the ratio of two character language models, with DataFrame functions only.

Rules (host suffix and path prefix, the longest wins) decide the urls that
they fit.  The urls that they allow and block train two variable-order Markov
models over a folded alphabet of ``len(ALPHABET)`` symbols: the next symbol
given the last two, Witten-Bell smoothed through one symbol and none down to
the uniform distribution.  The models read the whole url from its host on,
query and fragment included, but for the host's last label, which rules look
at: else the models would only learn which label has rules that block.  A url
without "://" is read as it is.  The difference of the two log-likelihoods per
symbol judges the urls that no rule fits.  One fifth of the ruled urls, by hash of
what the models read, is kept from the counts and calibrates the threshold: the largest,
but at most zero, that blocks no more than ``RISK`` of the allowed ones.
``evaluation`` tells what it does to both sides of that fifth.

Scale: counts are kept by symbol triple, so the model is one array of
``len(ALPHABET) ** 3`` doubles (0.5 MB) whatever the input, and as a literal of
the plan it is looked up in place, with no join or shuffle.  Scores are in steps
of a thousandth, so the table that the threshold is taken from is bounded too.

Defined results: a null url, or one without "://", has empty host and path;
if rules allow or block no url at all, the ratio is zero everywhere and the
rest is allowed; repeated rows come back once each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import staged

#: Symbols: an edge, the characters that are kept (a nought for any digit), and one for all others.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0./-_?=&#%~"
V = len(ALPHABET)
RISK, FOLDS = 0.05, 5
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    low = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def read(url: Column) -> Column:
    """What the models read of a url."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    whole = F.concat(F.regexp_replace(host, r"(^|\.)[^.]*$", ""), F.substring(rest, F.length(host) + 1, F.length(url)))
    return F.coalesce(F.when(at > 0, whole).otherwise(url), F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    own, slash, prefix = rule.partition("/")
    return ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + prefix))


def ruled(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(page_id, host, path, rule, codes): codes are the symbols that the models read, between edges."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), read(F.col("url")).alias("read"))
    rule = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):
        rule = F.when(fits(r, F.col("host"), F.col("path")), F.lit(r)).otherwise(rule)
    text = F.regexp_replace(F.regexp_replace(F.lower("read"), "[0-9]", "0"), "[^a-z0./_?=&#%-]", "~")
    codes = F.transform(F.split(F.concat(F.lit("^^"), text, F.lit("^")), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return rows.select("page_id", "host", "path", rule.alias("rule"), codes.alias("codes"))


def triples(codes: Column) -> Column:
    """The codes of all three symbols in a row."""

    def of(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.get(c, i) * (V * V) + F.get(c, i + 1) * V + F.get(c, i + 2))

    return F.transform(F.array(codes), of)[0]


def model(trained: DataFrame) -> DataFrame:
    """One row, one string of numbers: for each triple, ln P(allowed) - ln P(blocked) of its last symbol after the first two. trained: (good, codes)."""
    seen = trained.select("good", F.explode(triples(F.col("codes"))).alias("t")).groupBy("t").agg(*[F.count(F.when(F.col("good") == g, 1)).cast("double").alias(f"n{g}") for g in (0, 1)])
    seen = staged(seen)
    a, b, c = (F.col("t") / (V * V)).cast("int"), (F.col("t") / V).cast("int") % V, F.col("t") % V
    grid = trained.sparkSession.range(V**3).select(F.col("id").cast("int").alias("t"))
    full = grid.join(seen, "t", "left").select("t", a.alias("a"), b.alias("b"), c.alias("c"), *[F.coalesce(f"n{g}", F.lit(0.0)).alias(f"n{g}") for g in (0, 1)])
    # Counts of shorter contexts are sums over the longer ones; kinds are the distinct symbols that follow.
    pair = full.groupBy("b", "c").agg(*[F.sum(f"n{g}").alias(f"p{g}") for g in (0, 1)])
    single = pair.groupBy("c").agg(*[F.sum(f"p{g}").alias(f"s{g}") for g in (0, 1)])

    def totals(rows: DataFrame, by: list[str], n: str, name: str) -> DataFrame:
        sums = [x for g in (0, 1) for x in (F.sum(f"{n}{g}").alias(f"{name}n{g}"), F.count(F.when(F.col(f"{n}{g}") > 0, 1)).alias(f"{name}k{g}"))]
        return rows.groupBy(*by).agg(*sums)

    full = full.join(pair, ["b", "c"]).join(single, "c").join(totals(full, ["a", "b"], "n", "x"), ["a", "b"]).join(totals(pair, ["b"], "p", "y"), "b").crossJoin(totals(single, [], "s", "z"))

    def smoothed(count: str, name: str, g: int, lower: Column) -> Column:
        n, k = F.col(f"{name}n{g}"), F.col(f"{name}k{g}")
        return F.when(n > 0, (F.col(f"{count}{g}") + k * lower) / (n + k)).otherwise(lower)

    logs = [F.log(smoothed("n", "x", g, smoothed("p", "y", g, smoothed("s", "z", g, F.lit(1.0 / V))))) for g in (0, 1)]
    ratio = F.when((F.col("zn0") > 0) & (F.col("zn1") > 0), logs[1] - logs[0]).otherwise(0.0)
    ratios = F.transform(F.array_sort(F.collect_list(F.struct("t", "r"))), lambda x: x["r"].cast("string"))
    return full.select("t", F.round(ratio, 9).alias("r")).agg(F.array_join(ratios, " ").alias("ratios"))


def score(codes: Column, ratios: Column) -> Column:
    """Log-likelihood difference per symbol."""
    total = F.aggregate(triples(codes), F.lit(0.0), lambda acc, t: acc + F.get(ratios, t))
    return F.round(total / (F.size(codes) - 2), 3)


def learned(rows: DataFrame, rules: dict[str, str]) -> tuple[Column, DataFrame]:
    """The ratios of the models that the ruled urls train, as a literal, and the scores of those kept for calibration: (good, s)."""
    allowed = [r for r, v in rules.items() if v == "allow"]
    known = rows.where("rule is not null").select(F.col("rule").isin(allowed).cast("int").alias("good"), F.pmod(F.xxhash64("codes"), F.lit(FOLDS)).alias("fold"), "codes")
    known = staged(known)
    # A bounded literal; Spark folds the cast to an array once.
    ratios = F.split(F.lit(model(known.where("fold <> 0")).first()[0]), " ").cast("array<double>")
    return ratios, known.where("fold = 0").select("good", score(F.col("codes"), ratios).alias("s"))


def threshold(scores: DataFrame, risk: float) -> DataFrame:
    """One row, cutoff: scores below it are blocked."""
    return staged(scores.where("good = 1").agg(F.least(F.coalesce(F.percentile("s", F.lit(risk)), F.lit(0.0)), F.lit(0.0)).alias("cutoff")))


def judged(pages: DataFrame, rules: dict[str, str] = RULES, risk: float = RISK) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    rows = ruled(pages, rules)
    ratios, scores = learned(rows, rules)
    cutoff = threshold(scores, risk)
    found = rows.select("page_id", "host", "path", "rule", score(F.col("codes"), ratios).alias("score"))
    by_rule = F.when(F.col("rule").isin([r for r, v in rules.items() if v == "allow"]), "allow").otherwise("block")
    by_model = F.when(F.col("score") < cutoff.scalar(), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_model).alias("verdict"), "score")


def evaluation(pages: DataFrame, rules: dict[str, str] = RULES, risk: float = RISK) -> DataFrame:
    """One row (cutoff, allowed, blocked, false_blocks, recall, auc) over the ruled urls that the models were not trained on."""
    scores = learned(ruled(pages, rules), rules)[1]
    cutoff = threshold(scores, risk)
    counts = scores.groupBy("s").agg(*[F.count(F.when(F.col("good") == g, 1)).alias(n) for g, n in ((1, "allowed"), (0, "blocked"))])  # a row for each thousandth
    below = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("under", F.coalesce(F.sum("blocked").over(below), F.lit(0))).crossJoin(cutoff)
    sums = ranked.agg(
        F.first("cutoff").alias("cutoff"), F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"),
        (F.sum(F.when(F.col("s") < F.col("cutoff"), F.col("allowed")).otherwise(0)) / F.sum("allowed")).alias("false_blocks"),
        (F.sum(F.when(F.col("s") < F.col("cutoff"), F.col("blocked")).otherwise(0)) / F.sum("blocked")).alias("recall"),
        (F.sum(F.col("allowed") * (F.col("under") + F.col("blocked") / 2)) / F.sum("allowed") / F.sum("blocked")).alias("auc"),
    )
    return sums
