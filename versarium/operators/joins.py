"""Joins over the corpus star (JN1-JN16). Sides are not forced into memory:
Catalyst broadcasts a side whose size it knows to be small, otherwise both
sides are shuffled and AQE splits skewed keys. Only constant tables of this
package carry a broadcast hint."""

from pyspark.sql import functions as F

from versarium import dims
from versarium.functions import text as T
from versarium.operators.ordered import first_per_key


def passage_hierarchy(passages, sections, works, authors, keys, how="inner"):
    """Passages with section, work and author. ``keys`` are the three pairs of
    join columns; rows without a parent stay with how='left'."""
    (p, s), (s2, w), (w2, a) = keys
    return (passages.join(sections, F.col(p) == F.col(s), how)
            .join(works, F.col(s2) == F.col(w), how).join(authors, F.col(w2) == F.col(a), how))


def work_title(title, original):
    return F.coalesce(T.nonempty(title), T.nonempty(original), F.lit("Unbekanntes Werk"))


def council_docs(documents, councils, doc_key, key, title):
    """Documents with their council; the slug stands in for a missing title."""
    joined = documents.join(councils, F.col(doc_key) == F.col(key), "left")
    slug = F.coalesce(F.col(key).cast("string"), F.col(doc_key).cast("string"), F.lit("unbekannt"))
    return joined.withColumn("council", slug).withColumn("council_title", F.coalesce(F.col(title), slug))


def sections_with_content(sections, passages, work, section):
    """Sections that have a passage; all sections of a work where none has."""
    filled = sections.join(passages.select(section), section, "left_semi")
    empty = sections.join(filled.select(work), work, "left_anti")
    return filled.unionByName(empty)


def backlog(items, done, key):
    """Items that are not done yet."""
    return items.join(done.select(key), key, "left_anti")


def note_links(links, notes, scope, note, order):
    """Notes of a section in the order of their first link, each once."""
    first = first_per_key(links, [scope, note], order)
    return first.join(notes, note)


def cache_lookup(requests, cache, key):
    """Requests with the cached response; null is a miss."""
    return requests.join(cache, key, "left")


def key_lookup(requests, items, request, *names):
    """The item whose id or other name equals the requested key; of several the
    one that matches the earliest name. Null where nothing matches. The bulk
    form is one equality join on (name, row) pairs instead of an OR."""
    named = items.select("*", F.posexplode(F.array_distinct(F.array(*[F.col(n).cast("string") for n in names])))
                         .alias("name_pos_", "name_"))
    hit = requests.join(named, F.col(request).cast("string") == F.col("name_"), "left")
    return first_per_key(hit, [request], F.col("name_pos_").asc_nulls_last(), *names).drop("name_", "name_pos_")


def favorites(items, chosen, key):
    return items.join(chosen.select(key), key, "left_semi")


def corrected(df, column, corrections, out):
    """Value from a constant correction map, else the value itself."""
    return df.withColumn(out, F.coalesce(F.try_element_at(dims.literal_map(corrections), F.col(column)), F.col(column)))


# ---- lookups in the book list: constant entries, so no join ---------------------
# fixed values: abbreviations that stand for a part of a book name
NAME_PARTS = {
    "sam": "samuel", "kön": "könige", "chr": "chronik", "makk": "makkabäer", "ps": "psalm", "sir": "sirach",
    "kor": "korinther", "thess": "thessalonicher", "tim": "timotheus", "petr": "petrus",
}


def _name_parts():
    parts = {a.lower(): d.lower() for _, a, d, _, _ in dims.books() if not a[0].isdigit()}
    parts.update(NAME_PARTS)
    return parts


def book_lookup(query):
    """Books whose name equals, contains or is contained in the query, or that
    an abbreviation inside the query stands for."""
    rows = []
    for _, _, display, _, _ in dims.books():
        short = [a for a, n in _name_parts().items() if n in display.lower()]
        rows.append(F.struct(F.lit(display).alias("book"), F.lit(display.lower()).alias("low"),
                             F.array(*[F.lit(a) for a in short]).alias("short")))
    def hits(low):
        return F.filter(F.array(*rows), lambda b: F.contains(b["low"], low) | F.contains(low, b["low"])
                        | F.exists(b["short"], lambda a: F.contains(low, a)))
    return F.transform(T.let(F.lower(query), hits), lambda b: b["book"])


def label_match(name, label, slack=20):
    """Equal ignoring case, or contained in a label that is not much longer."""
    a, b = F.lower(name), F.lower(label)
    return (a == b) | (F.contains(b, a) & (F.length(label) < F.length(name) + slack))


def longest_prefix(df, keys, query, books):
    """Book with the longest label that starts the query, and the chapter after
    it. ``books`` are (abbr, labels, chapters) constants; they are indexed by
    label length, so a row makes one map lookup per length."""
    entries = {}
    for abbr, labels, chapters in books:
        for label in labels:
            entries.setdefault(label.lower(), (abbr, chapters))
    sizes = sorted({len(label) for label in entries}, reverse=True)
    spark = df.sparkSession
    table = dims.constant(spark, [(label, abbr, n) for label, (abbr, n) in entries.items()],
                          "label string, abbr string, chapters int")
    low = F.lower(F.trim(F.col(query)))
    tries = F.array(*[F.struct(F.lit(n).alias("n"), F.substring(low, 1, n).alias("label")) for n in sizes])
    tries = F.filter(tries, lambda t: F.length(t["label"]) == t["n"])
    found = (df.select(*keys, low.alias("q_"), F.inline(tries)).join(F.broadcast(table), "label")
             .groupBy(*keys).agg(F.max(F.struct("n", "abbr", "chapters", "q_")).alias("m")))
    rest = F.trim(F.substring(F.col("m.q_"), F.col("m.n") + 1, F.length("m.q_")))
    number = rest.try_cast("int")
    fits = F.rlike(rest, F.lit("^[0-9]+$")) & number.between(1, F.col("m.chapters"))
    return found.select(*keys, F.col("m.abbr").alias("abbr"),
                        F.when(rest == "", 1).when(fits, number).alias("chapter"))
