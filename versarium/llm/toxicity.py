"""Toxicity: a factorization machine over hashed terms."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from versarium.llm.common import let, pick
from versarium.llm.decontam import word_list

BITS = 18
FACTORS = 4
SAMPLE = 20_000  # labelled rows that a machine is fitted on at most
THRESHOLD = 0.7


def hashed_terms(text, bits=BITS):
    """Distinct hashes below 2^bits of the words of a text and of their first four and five letters.

    Beginnings carry what inflected forms share. Null and empty texts have no term.
    """
    def folded(*parts):
        return F.xxhash64(*parts).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def beginnings(n):
        return lambda w: folded(F.substring(w, 1, n), F.lit(n))

    return let(F.array_distinct(word_list(text)), lambda words: F.array_distinct(F.concat(
        F.transform(words, lambda w: folded(w)), F.transform(words, beginnings(4)), F.transform(words, beginnings(5)))))


def _flat(rows):
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    terms = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    return terms, np.repeat(np.arange(len(rows)), sizes)


class Machine:
    """score = sigmoid(bias + sum of w_i + sum over pairs of <v_i, v_j>) over the terms of a text."""

    def __init__(self, bits=BITS, factors=FACTORS, seed=7):
        self.bias = 0.0
        self.w = np.zeros(1 << bits)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (1 << bits, factors))

    def raw(self, terms, row, n):
        """(value per row, sums of v per row)."""
        v = self.v[terms]
        sums = np.stack([np.bincount(row, weights=v[:, f], minlength=n) for f in range(v.shape[1])], axis=1)
        squares = np.bincount(row, weights=(v * v).sum(axis=1), minlength=n)
        value = self.bias + np.bincount(row, weights=self.w[terms], minlength=n) + ((sums ** 2).sum(axis=1) - squares) / 2
        return value, sums

    def scores(self, rows):
        value, _ = self.raw(*_flat(rows), len(rows))
        return 1 / (1 + np.exp(-np.clip(value, -700, 35)))

    def fit(self, rows, labels, epochs=12, batch=256, rate=0.3, sparse=0.25, ridge=0.02, least=4, seed=11):
        """Log loss by AdaGrad in batches; linear weights are pulled to zero by `sparse`, factors by `ridge`.

        Terms in fewer than `least` rows keep weight 0: they say more about a row than about its label.
        """
        labels = np.asarray(labels, dtype=np.float64)
        terms, _ = _flat(rows)
        known = np.bincount(terms, minlength=len(self.w)) >= least
        self.v[~known] = 0
        rows = [np.asarray(r)[known[np.asarray(r, dtype=np.int64)]] for r in rows]
        share = np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        hw, hv, hb = np.full(len(self.w), 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        random = np.random.default_rng(seed)
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for start in range(0, len(rows), batch):
                pick_ = order[start:start + batch]
                terms, row = _flat([rows[i] for i in pick_])
                value, sums = self.raw(terms, row, len(pick_))
                g = 1 / (1 + np.exp(-np.clip(value, -35, 35))) - labels[pick_]
                own, inverse = np.unique(terms, return_inverse=True)
                gw = np.bincount(inverse, weights=g[row], minlength=len(own))
                pull = g[row, None] * (sums[row] - self.v[terms])
                gv = np.stack([np.bincount(inverse, weights=pull[:, f], minlength=len(own)) for f in range(pull.shape[1])], axis=1)
                gv += ridge * self.v[own]
                hw[own] += gw ** 2
                step = rate / np.sqrt(hw[own])
                w = self.w[own] - step * gw
                self.w[own] = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
                hv[own] += gv ** 2
                self.v[own] -= rate / 6 / np.sqrt(hv[own]) * gv
                hb += g.sum() ** 2
                self.bias -= rate / np.sqrt(hb) * g.sum()
        return self


def train(documents, labels, sample=SAMPLE, bits=BITS, id_col="doc_id", text_col="text", label_col="label"):
    """A Machine from the texts of labelled documents; null ids, texts and labels are left out.

    Fitted on up to `sample` labels, those with the least hash of their id (the documented bound: so
    many ids are broadcast to the scan of the texts, one task holds the hashed terms of so many
    texts, and what returns is 2^bits * (FACTORS + 1) numbers).
    """
    chosen = pick(labels, doc_id=id_col, label=label_col).filter("doc_id is not null and label is not null")
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    docs = pick(documents, doc_id=id_col, text=text_col).filter("text is not null")
    rows = docs.join(chosen, "doc_id").select("label", "doc_id", hashed_terms(F.col("text"), bits).alias("terms"))

    rows = rows.withColumn("machine", F.lit(0))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "label"], kind="stable")  # the same rows give the same machine
        machine = Machine(bits).fit(list(group["terms"]), group["label"])
        used = np.flatnonzero((machine.w != 0) | (machine.v != 0).any(axis=1))
        out = pd.DataFrame({"term": np.append(used, -1), "w": np.append(machine.w[used], machine.bias)})
        out["v"] = [*machine.v[used], np.zeros(machine.v.shape[1])]
        return out

    machine = Machine(bits)
    machine.v[:] = 0
    for r in rows.groupBy("machine").applyInPandas(fit, "term int, w double, v array<double>").toLocalIterator():
        if r["term"] < 0:
            machine.bias = r["w"]
        else:
            machine.w[r["term"]], machine.v[r["term"]] = r["w"], r["v"]
    return machine


def scored(documents, machine, id_col="doc_id", text_col="text", bits=BITS):
    """One row per input row: doc_id, score (0 to 1).

    Null and empty texts have no term and the score of the bias. Rows with a null id and repeated
    rows are kept as they come; an empty table gives no rows. Nothing but the text is read.
    """
    shared = documents.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = Machine.__new__(Machine)
        one.bias, one.w, one.v = shared.value
        for rows in batches:
            rows = list(rows)
            yield pd.Series(np.concatenate([one.scores(rows[i:i + 500]) for i in range(0, len(rows), 500)] or [np.zeros(0)]))

    docs = pick(documents, doc_id=id_col, text=text_col)
    return docs.select("doc_id", score(hashed_terms(F.col("text"), bits)).alias("score"))
