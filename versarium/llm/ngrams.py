"""Character n-gram language models: counted and smoothed with Spark, scored from sorted hash arrays.

Every window of every order is kept under its own characters, so nothing collides while a model is
built, and a model grows with what it is learned from. To score, the windows go by 64-bit hashes,
h_k = h_(k-1) * FACTOR + code modulo 2^64, in sorted arrays while all models together have at most
SMALL entries; beyond that the distinct windows of the texts are joined with the tables.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from versarium.llm.common import held, in_pieces, staged

FACTOR = 0x5851F42D4C957F2D
GAP = 32  # what stands for runs of other characters between letters
EDGE = 10  # what stands before the first character of a text
SMALL = 6_000_000  # entries of 16 bytes, probabilities and weights of all labels, that are sent to the tasks


def _letters():
    table = np.zeros(0x110000, dtype=bool)
    table[[i for i in range(0x40000) if chr(i).isalpha()]] = True
    return table


def windows(texts, order, letters):
    """(codes, hashes, at, doc): hashes[k] for windows of k characters that end at each place,
    the places `at` that are to be predicted and the index of their text.

    Texts are taken in lower case. With `letters`, runs of other characters become one GAP.
    `order - 1` EDGE codes stand before each text, so no window sees another text.
    """
    small = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, small), dtype=np.int64, count=len(small))
    raw = np.frombuffer("".join(small).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(small)), sizes)
    if letters:
        known = held("letters", _letters)[raw]
        first = np.ones(len(raw), dtype=bool)
        first[1:] = known[:-1] | (doc[1:] != doc[:-1])
        kept = known | first
        raw, doc = np.where(known, raw, GAP)[kept], doc[kept]
    else:
        raw = np.maximum(raw, EDGE + 1)
    counts = np.bincount(doc, minlength=len(small))
    place = np.arange(len(raw)) + (order - 1) * (doc + 1)
    codes = np.full(len(raw) + (order - 1) * len(small), EDGE, dtype=np.int64)
    codes[place] = raw
    hashes = [np.zeros(len(codes), dtype=np.int64), codes]
    for _ in range(2, order + 1):
        h = hashes[-1].copy()
        h[1:] = hashes[-1][:-1] * FACTOR + codes[1:]  # modulo 2^64
        hashes.append(h)
    return codes, hashes, place, doc, counts


def _distinct(h):
    """(a place of each distinct hash, index of each element among them)."""
    which, keys = pd.factorize(h)
    one = np.zeros(len(keys), dtype=np.int64)
    one[which[::-1]] = np.arange(len(h))[::-1]
    return one, which


def _spelled(codes, places, order):
    """The windows of `order` characters that end at some places, as strings."""
    spans = codes[places[:, None] + np.arange(1 - order, 1)].astype("<u4")
    return np.ascontiguousarray(spans).view(f"<U{order}").ravel().astype(object)


def count_windows(rows, order, letters):
    """(label, gram, n) over all of `rows` (label, text): the full-order windows of each label.

    Counted per batch with numpy, summed by Spark.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, part in batch.groupby("label", sort=False)["text"]:
                for texts in in_pieces(part, 1 << 19):
                    codes, hashes, at, _, _ = windows(texts, order, letters)
                    if len(at):
                        one, which = _distinct(hashes[order][at])
                        yield pd.DataFrame({"label": label, "gram": _spelled(codes, at[one], order), "n": np.bincount(which)})

    rows = rows.select("label", "text").filter("label is not null and text is not null")
    found = rows.mapInPandas(count, "label string, gram string, n long")
    return found.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def _table(keys, values):
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _look(table, keys, missing):
    known, values = table
    if not len(known):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], missing)


def _packed(df):
    """{(label, characters): (hashes, values)} of a table (label, gram, value) of bounded size."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (label, size), part in batch.groupby(["label", batch["gram"].str.len()]):
                codes = np.array(part["gram"].tolist(), dtype=f"<U{max(size, 1)}").view("<u4").reshape(len(part), -1).astype(np.int64)
                h = np.zeros(len(part), dtype=np.int64)
                for i in range(size):
                    h = h * FACTOR + codes[:, i]
                yield pd.DataFrame([(label, size, h.tobytes(), part["value"].to_numpy().tobytes())], columns=["label", "size", "h", "v"])
    found = {}
    for label, size, h, v in df.mapInPandas(pack, "label string, size int, h binary, v binary").collect():
        found.setdefault((label, size), []).append((np.frombuffer(h, np.int64), np.frombuffer(v, np.float64)))
    return {k: _table(*map(np.concatenate, zip(*v))) for k, v in found.items()}


class Scorer:
    """Interpolated models of some labels in sorted hash arrays: what a task needs to score texts."""

    def __init__(self, names, order, floor, probs, weights):
        self.order, self.floor = order, floor
        none = (np.zeros(0, np.int64), np.zeros(0))
        self.models = [[(probs.get((n, k), none), weights.get((n, k - 1), none)) for k in range(1, order + 1)] for n in names]

    def log_prob(self, model, hashes, places):
        """log P of the characters at `places` given what stands before them."""
        p = np.full(len(places), self.floor)
        for k, (probs, weights) in enumerate(model, 1):
            context = hashes[k - 1][places - 1] if k > 1 else np.zeros(len(places), dtype=np.int64)
            back = _look(weights, context, 1.0) * p
            found = _look(probs, hashes[k][places], -1.0)
            p = np.where(found >= 0, found, back)
        return np.log(p)

    def score(self, texts, letters):
        """(sums of log P, texts x models; characters; letters). Each distinct window is looked up once."""
        codes, hashes, at, doc, counts = windows(texts, self.order, letters)
        sums = np.zeros((len(texts), len(self.models)))
        if len(at):
            one, which = _distinct(hashes[self.order][at])
            for i, model in enumerate(self.models):
                sums[:, i] = np.bincount(doc, weights=self.log_prob(model, hashes, at[one])[which], minlength=len(texts))
        return sums, counts, np.bincount(doc, weights=codes[at] != GAP, minlength=len(texts))


class Models:
    """Interpolated character models, one per label, in tables of Spark.

    `probs` (label, gram, value): the probability of every window seen, of 1 to `order` characters;
    `weights` (label, gram, value): what a context gives to the next shorter one. `smoothing` is
    "kneser-ney" (absolute discount n1 / (n1 + 2 n2), lower orders from continuation counts) or
    "witten-bell" (escape mass T / (S + T), plain counts). `means` and `spreads` are those of the
    cross-entropy of the counted text under its own model. Without labels given, those found are used.
    """

    def __init__(self, rows, order, letters, smoothing, alphabet=1 << 16, names=None):
        self.order, self.letters, self.floor = order, letters, 1.0 / alphabet
        level = staged(count_windows(rows, order, letters), "windows")
        levels = {order: level}
        for k in range(order - 1, 0, -1):
            n = F.count(F.lit(1)) if smoothing == "kneser-ney" else F.sum("n")
            level = staged(level.groupBy("label", F.substring("gram", 2, k).alias("gram")).agg(n.alias("n")), "windows")
            levels[k] = level
        self.by_order, lower = {}, None
        for k in range(1, order + 1):
            level = levels[k].withColumn("context", F.substring("gram", 1, k - 1))
            contexts = level.groupBy("label", "context").agg(F.sum("n").cast("double").alias("mass"), F.count(F.lit(1)).cast("double").alias("kinds"))
            if smoothing == "kneser-ney":
                once, twice = [F.sum((F.col("n") == i).cast("double")) for i in (1, 2)]
                kept = F.when(once > 0, once / (once + 2 * twice)).otherwise(0.5)
                contexts = contexts.join(level.groupBy("label").agg(kept.alias("discount")), "label")
                contexts = contexts.withColumn("weight", F.col("discount") * F.col("kinds") / F.col("mass"))
                own = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("mass")
            else:
                contexts = contexts.withColumn("weight", F.col("kinds") / (F.col("mass") + F.col("kinds")))
                own = F.col("n") / (F.col("mass") + F.col("kinds"))
            contexts = staged(contexts, "contexts")
            joined = level.join(contexts, ["label", "context"])
            base = F.lit(self.floor)
            if lower is not None:
                joined = joined.withColumn("suffix", F.substring("gram", 2, k)).join(
                    lower.select("label", F.col("gram").alias("suffix"), F.col("value").alias("base")), ["label", "suffix"])
                base = F.col("base")
            lower = staged(joined.select("label", "gram", (own + F.col("weight") * base).alias("value"), "n"), "probabilities")
            self.by_order[k] = (lower.select("label", "gram", "value"),
                                contexts.select("label", F.col("context").alias("gram"), F.col("weight").alias("value")))
        loss, n = -F.log("value"), F.sum("n")
        mean = F.sum(loss * F.col("n")) / n
        stats = {r[0]: r[1:] for r in lower.groupBy("label").agg(
            mean, F.sqrt(F.greatest(F.sum(loss * loss * F.col("n")) / n - mean * mean, F.lit(0.0)))).collect()}  # one row per label
        self.names = sorted(stats) if names is None else list(names)
        self.means, self.spreads = [[stats.get(n, (0.0, 0.0))[i] for n in self.names] for i in (0, 1)]

    def tables(self, i):
        return reduce(lambda a, b: a.union(b), [self.by_order[k][i] for k in sorted(self.by_order)])

    def scorer(self):
        """The models as arrays, None if they have more than SMALL entries."""
        probs, weights = self.tables(0), self.tables(1)
        if probs.count() + weights.count() > SMALL:
            return None
        return Scorer(self.names, self.order, self.floor, _packed(probs), _packed(weights))

    def scored(self, df, text, name="__s"):
        """`df` with a struct of sums (of log P, in order of `names`), n (characters) and lettered (any letter)."""
        if not hasattr(self, "shared"):
            arrays = self.scorer()
            self.shared = arrays and df.sparkSession.sparkContext.broadcast(arrays)
        return self._by_arrays(df, text, name) if self.shared else self._by_joins(df, text, name)

    def _by_arrays(self, df, text, name):
        shared, letters = self.shared, self.letters

        @F.pandas_udf("sums array<double>, n long, lettered boolean")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                out = [shared.value.score(part, letters) for part in in_pieces(texts, 1 << 18)]
                yield pd.DataFrame({"sums": [x.tolist() for s, _, _ in out for x in s], "n": [x for _, n, _ in out for x in n.tolist()],
                                    "lettered": [x > 0 for _, _, m in out for x in m]})
        return df.withColumn(name, score.asNondeterministic()(text))  # else every use would run it again

    def _by_joins(self, df, text, name):
        order, letters = self.order, self.letters
        base = staged(df.withColumn("__row", F.monotonically_increasing_id()), "texts")

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row, value in zip(batch["row"], batch["text"]):
                    codes, hashes, at, _, _ = windows([value], order, letters)
                    if len(at):
                        one, which = _distinct(hashes[order][at])
                        yield pd.DataFrame({"row": row, "gram": _spelled(codes, at[one], order), "n": np.bincount(which)})
        found = staged(base.select(F.col("__row").alias("row"), text.alias("text")).mapInPandas(cut, "row long, gram string, n long"), "cut")
        labels = F.explode(F.array(*map(F.lit, self.names))) if self.names else F.explode(F.array().cast("array<string>"))
        known = found.select("gram").distinct().select("gram", labels.alias("label"), F.lit(self.floor).alias("p"))
        for k, (probs, weights) in sorted(self.by_order.items()):
            known = known.withColumns({"own": F.substring("gram", order - k + 1, k), "context": F.substring("gram", order - k + 1, k - 1)})
            known = (known.join(probs.select("label", F.col("gram").alias("own"), F.col("value").alias("seen")), ["label", "own"], "left")
                     .join(weights.select("label", F.col("gram").alias("context"), F.col("value").alias("weight")), ["label", "context"], "left")
                     .select("gram", "label", F.coalesce("seen", F.coalesce("weight", F.lit(1.0)) * F.col("p")).alias("p")))
        known = staged(known, "known")
        sums = found.join(known, "gram").groupBy("row", "label").agg(F.sum(F.col("n") * F.log("p")).alias("x"))
        sums = sums.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("label", "x"))).alias("by_label"))
        letter = F.replace(F.replace("gram", F.lit(chr(GAP)), F.lit("")), F.lit(chr(EDGE)), F.lit("")) != ""
        counts = found.groupBy("row").agg(F.sum("n").alias("n"), F.max(letter).alias("lettered"))
        both = counts.join(sums, "row", "left").select(F.col("row").alias("__row"), F.struct(
            F.array(*[F.col("by_label")[n] for n in self.names]).cast("array<double>").alias("sums"), "n", "lettered").alias(name))
        none = F.struct(F.array_repeat(F.lit(0.0), len(self.names)).alias("sums"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("lettered"))
        return base.join(both, "__row", "left").withColumn(name, F.coalesce(name, none)).drop("__row")
