"""Secret scan: fixed key patterns, and character Markov models for other random strings."""

import math
from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from versarium.llm.common import let, pick

# The patterns of the base kinds and the least length of what they keep.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run is matched whole or not at all
KINDS = ["assign", "access", "hex", "random"]
WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
MIN_VALUE, MIN_ACCESS = 6, 20

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
IDENTIFIER = r"[A-Za-z_]{10,}"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=."
WIDE = len(SYMBOLS) + 1  # 0 stands for any other character


def _located(text, pattern, keep=None):
    """Leftmost non-overlapping matches as array<struct<start, stop, value>>, in code points.

    `keep` gives a boolean array in step with the matches, or None for all of them. The pieces
    between the matches give their places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(found.alias("value"), F.slice(gaps, 1, F.size(found)).alias("gap"),
                         (keep if keep is not None else F.transform(found, lambda m: F.lit(True))).alias("keep"))
    kind = "array<struct<start:int,stop:int,value:string>>"
    empty = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), kind).alias("out"))

    def step(acc, s):
        start = acc["at"] + F.length(s["gap"])
        stop = start + F.length(s["value"])
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), s["value"].alias("value")))
        return F.struct(stop.alias("at"), F.when(s["keep"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(steps, empty, step, lambda acc: acc["out"])).otherwise(
        F.from_json(F.lit("[]"), kind))


def base_spans(text):
    """(assign, access, hex) columns of base spans; each pattern runs only where its cheap guard holds."""
    none = F.from_json(F.lit("[]"), "array<struct<start:int,stop:int,value:string>>")
    named = let(F.lower(text), lambda small: reduce(or_, [small.contains(word) for word in WORDS]))
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.when(named, _located(text, ASSIGN, F.transform(values, lambda v: F.length(v) >= MIN_VALUE))).otherwise(none)
    keys = F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0))
    access = F.when(text.contains("AKIA"), _located(text, ACCESS, F.transform(keys, lambda k: F.length(k) >= MIN_ACCESS))).otherwise(none)
    return assign, access, F.when(text.rlike(HEX), _located(text, HEX)).otherwise(none)


def _pairs(strings):
    """Counts of adjacent character pairs over a column `s`: (pair, n)."""
    steps = F.sequence(F.lit(1), F.length("s") - 1)
    return (strings.filter(F.length("s") > 1).select("s", F.explode(steps).alias("i"))
            .groupBy(F.expr("substring(s, i, 2)").alias("pair")).agg(F.count(F.lit(1)).alias("n")))


class MarkovRatio:
    """log P(b | a) under random strings minus under identifiers, for every pair of symbols.

    Both models are counted over the whole table: random strings are the values that the base
    patterns mark, identifiers are runs of letters. They are interpolated with the uniform
    distribution, so that unseen pairs stay finite. `WIDE` squared numbers, whatever the table.
    """

    def __init__(self, random_counts, plain_counts, weight=0.5):
        self.ratio = [0.0] * (WIDE * WIDE)
        models = []
        for counts in (random_counts, plain_counts):
            grid = [[0] * WIDE for _ in range(WIDE)]
            for pair, n in counts:
                grid[SYMBOLS.find(pair[0]) + 1][SYMBOLS.find(pair[1]) + 1] += n
            models.append(grid)
        means = []
        for a in range(WIDE):
            for b in range(WIDE):
                p = [weight * g[a][b] / max(1, sum(g[a])) + (1 - weight if sum(g[a]) else 1) / WIDE for g in models]
                self.ratio[a * WIDE + b] = math.log(p[0] / p[1])
        for grid in models:
            total = sum(map(sum, grid))
            means.append(sum(grid[a][b] * self.ratio[a * WIDE + b] for a in range(WIDE) for b in range(WIDE)) / total if total else 0.0)
        # calibrated on the labelled strings: half way between the mean ratios of the two classes
        self.threshold = sum(means) / 2

    def per_pair(self, token):
        """Length-normalised log-likelihood ratio of a string column, by one lookup per pair."""
        table = F.split(F.lit(",".join(map(repr, self.ratio))), ",").cast("array<double>")
        symbols = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(SYMBOLS), c))
        # the state holds the sum and the symbol before
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
        total = F.aggregate(symbols, start, lambda acc, b: F.struct(
            (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(table, acc["last"] * WIDE + b))).alias("sum"),
            b.alias("last")), lambda acc: acc["sum"])
        return total / F.greatest(F.length(token) - 1, F.lit(1))


def train(documents, text_col="text"):
    """MarkovRatio from every row: labelled random values and ordinary identifiers."""
    docs = pick(documents, text=text_col).filter("text is not null")
    assign, access, hexes = base_spans(F.col("text"))
    marked = docs.select(F.explode(F.concat(
        F.transform(assign, lambda s: F.regexp_extract(s["value"], ASSIGN, 2)),
        F.transform(access, lambda s: s["value"]), F.transform(hexes, lambda s: s["value"]))).alias("s"))
    plain = docs.select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("s"))
    return MarkovRatio(*[[tuple(r) for r in _known(_pairs(s)).collect()] for s in (marked, plain)])


def _known(pairs):
    """Pairs with every other character folded into one: at most WIDE squared rows."""
    fold = F.regexp_replace("pair", r"[^A-Za-z0-9+/_=.-]", " ")
    return pairs.groupBy(fold.alias("pair")).agg(F.sum("n").alias("n"))


def secret_spans(documents, model=None, id_col="doc_id", text_col="text"):
    """One row per input row: doc_id and `spans`, an array of (start, stop, kind, value).

    Starts and ends count code points, the end is exclusive. Base kinds are matched by their
    patterns; `random` are runs of 20 or more characters outside of base spans that the Markov
    models call random: a length-normalised log-likelihood ratio above the model's threshold.
    Spans are in order of start, then kind. Null and empty texts have none; rows with a null id
    and repeated rows are kept as they come; an empty table gives no rows. DataFrame functions only.
    """
    model = model or train(documents, text_col)
    docs = pick(documents, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    assign, access, hexes = base_spans(F.col("text"))
    tokens = F.when(F.col("text").rlike(CANDIDATE), _located(F.col("text"), CANDIDATE)).otherwise(
        F.from_json(F.lit("[]"), "array<struct<start:int,stop:int,value:string>>"))
    found = docs.select("doc_id", assign.alias("k0"), access.alias("k1"), hexes.alias("k2"), tokens.alias("tokens"))
    base = F.concat("k0", "k1", "k2")
    free = F.filter("tokens", lambda t: ~F.exists(base, lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    found = found.select("*", free.alias("free"))
    found = found.select("*", F.filter("free", lambda t: model.per_pair(t["value"]) > model.threshold).alias("k3"))

    def tagged(i):
        return F.transform(F.col(f"k{i}"), lambda s: F.struct(s["start"], F.lit(i).alias("rank"), s["stop"], s["value"]))
    spans = F.array_sort(F.concat(*[tagged(i) for i in range(4)]))
    kinds = F.array(*map(F.lit, KINDS))
    return found.select("doc_id", F.transform(spans, lambda s: F.struct(
        s["start"], s["stop"], F.get(kinds, s["rank"]).alias("kind"), s["value"])).alias("spans"))


def spelled(spans):
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
