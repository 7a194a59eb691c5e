"""URL filter: fixed rules, and a character language-model ratio for what they leave open."""

from pyspark.sql import functions as F

from versarium.llm import ngrams
from versarium.llm.common import lower_ascii, pick

ORDER = 6
FOLDS = 5  # one of so many parts of the labelled urls, by hash, sets the threshold and teaches nothing

# Fixed values: (verdict, host, path); the longest that fits wins.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_and_path(url):
    """(host, path) columns: after the first `://` up to `/`, `?`, `#`; then up to `?`, `#`.

    Null urls and urls without `://` give empty strings.
    """
    rest = F.substring_index(url, "://", 1)
    rest = F.when(url.contains("://"), F.substring(url, F.length(rest) + 4, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return lower_ascii(host), F.coalesce(F.regexp_extract(tail, r"^[^?#]*", 0), F.lit(""))


def rule_of(host, path, rules=RULES):
    """(rule, verdict) columns of the longest rule that fits; null where none does.

    A rule fits its host and all subdomains, if the path starts with the rule's path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        rule = F.when(fits, F.lit(domain + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


class UrlFilter:
    """Witten-Bell models of variable order for accepted and rejected urls, and a threshold.

    A window that was never seen falls back to its longest known context.
    """

    def __init__(self, models, threshold=0.0):
        self.models, self.threshold = models, threshold

    def ratios(self, rows):
        """`rows` with `ratio`: the length-normalised log-likelihood difference of `url`, 0 if null or empty."""
        s = F.col("__s")
        found = self.models.scored(rows, F.col("url"), "__s")
        return found.withColumn("ratio", (s["sums"][0] - s["sums"][1]) / F.greatest(s["n"], F.lit(1))).drop("__s")


def train(labelled):
    """UrlFilter from (url, label) rows, label allow or block; other labels and null urls are left out.

    A fold of the distinct urls, by hash, is held out of the models. The threshold is the middle between the mean
    ratios of its two classes; if it lacks one of them, of the urls that were learned.
    """
    rows = labelled.filter("label in ('allow', 'block') and url is not null").select("label", "url")
    held_out = F.pmod(F.xxhash64("url", F.lit(FOLDS)), F.lit(FOLDS)) == 0
    learned = rows.filter(~held_out).select("label", F.col("url").alias("text"))
    model = UrlFilter(ngrams.Models(learned, ORDER, False, "witten-bell", alphabet=128, names=["allow", "block"]))
    for part in (rows.filter(held_out), rows.filter(~held_out)):
        means = dict(model.ratios(part).groupBy("label").agg(F.avg("ratio")).collect())
        if len(means) == 2:
            model.threshold = (means["allow"] + means["block"]) / 2
            break
    return model


def judge_urls(pages, id_col="page_id", url_col="url", rules=RULES, model=None):
    """One row per input row: page_id, host, path, rule, verdict, ratio.

    `verdict` is the rule's, else the method's: allow if the ratio is above the threshold. Without
    a model, the urls that rules decide are the labelled sample, all of them. Null urls and urls
    without `://` have empty host and path, and a null url is blocked: it leads nowhere. Rows with
    a null id and repeated rows are kept as they come; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pick(pages, page_id=id_col, url=url_col).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "label": verdict})
    model = model or train(rows.select("url", "label"))
    open_verdict = F.when(F.col("url").isNotNull() & (F.col("ratio") > model.threshold), "allow").otherwise("block")
    return model.ratios(rows).select(
        "page_id", "host", "path", "rule", F.coalesce("label", open_verdict).alias("verdict"), "ratio")
