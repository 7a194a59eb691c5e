"""Language identification by interpolated Kneser-Ney character models."""

from pyspark.sql import functions as F

from versarium.llm import ngrams
from versarium.llm.common import let, pick

ORDER = 4
UNKNOWN = "und"
SHARPNESS = 8.0  # of the score: softmax of this many times minus the cross-entropy


def train(documents, lang_col="lang", text_col="text"):
    """Models of the languages of all given rows whose text and language are not null."""
    rows = pick(documents, label=lang_col, text=text_col).withColumn("label", F.col("label").cast("string"))
    return ngrams.Models(rows, ORDER, True, "kneser-ney")


def judged(s, languages, slack=1.0, deviations=6.0):
    """struct<lang_pred, score, entropy, rejected> from the scores of a text (`Models.scored`).

    The language of the lowest cross-entropy per character wins, ties by name. `rejected` if the
    text has no letter, or if that entropy is above what the model's own training text has: by
    `slack` nats and `deviations` standard errors of a text of this length.
    """
    if not languages.names:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"),
                        F.lit(True).alias("rejected"))

    def made(e):
        low = F.array_min(e)
        best = F.array_position(e, low).cast("int")
        of = [F.element_at(F.array(*map(F.lit, values)), best) for values in (languages.names, languages.means, languages.spreads)]
        total = F.aggregate(e, F.lit(0.0), lambda t, x: t + F.exp(-SHARPNESS * (x - low)))
        high = low > of[1] + slack + deviations * of[2] / F.sqrt(F.greatest(s["n"], F.lit(1)))
        found = s["lettered"]
        return F.struct(F.when(found, of[0]).otherwise(UNKNOWN).alias("lang_pred"), F.when(found, 1 / total).otherwise(0.0).alias("score"),
                        F.when(found, low).alias("entropy"), (~found | high).alias("rejected"))
    return let(F.transform(s["sums"], lambda x: -x / F.greatest(s["n"], F.lit(1))), made)


def identify(documents, languages, id_col="doc_id", text_col="text"):
    """One row per input row: doc_id, lang_pred, score, entropy, rejected.

    Null texts and texts without a letter are `und` with score 0, and rejected; so is every text
    if nothing was learned. Rows with a null id and repeated rows are kept as they come; an empty
    table gives no rows.
    """
    docs = pick(documents, doc_id=id_col, text=text_col)
    found = languages.scored(docs, F.col("text"), "s")
    return found.select("doc_id", judged(F.col("s"), languages).alias("p")).select("doc_id", "p.*")


def accepted(documents, languages, text_col="text", lang_col="lang"):
    """The rows whose language is recognised, all columns kept; a null language is filled in.

    Null texts and texts without a letter go; repeated rows are judged each; an empty table stays empty.
    """
    found = languages.scored(documents, F.col(f"`{text_col}`"), "__s")
    judgement = found.withColumn("__lang", judged(F.col("__s"), languages))
    return (judgement.filter("not __lang.rejected")
            .withColumn(lang_col, F.coalesce(F.col(f"`{lang_col}`"), F.col("__lang.lang_pred"))).drop("__lang", "__s"))
