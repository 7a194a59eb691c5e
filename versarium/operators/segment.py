"""Segmentation (SEG1-SEG18): one row in, many rows out.

Splits and folds of one text run inside its row, so they need no shuffle.
Only merge_rows and verse_number cross rows; both go through the ordered
scans of ranges, so no work has to fit one task.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as S

from versarium import patterns as P
from versarium.functions import classify as C
from versarium.functions import text as T
from versarium.operators import ordered as O

# Sentinels for splits that must keep the separator.
CUT, MARK = "\u0001", "\u0002"


def _nonempty(parts):
    return F.filter(F.transform(parts, T.trim_space), lambda x: x != "")


def split_paragraphs(c, separator=P.BLANK_LINES):
    """Trimmed non-empty blocks; one block if there is no separator."""
    return _nonempty(F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), separator.java))


def split_sentences(c):
    """Cut after a sentence end that a capital follows."""
    return _nonempty(F.split(c, P.SENTENCE_GAP.java))


def split_sentences_simple(c, min_chars=20):
    return F.filter(_nonempty(F.split(c, P.SENTENCE_END.java)), lambda s: F.length(s) > min_chars)


def split_by_markers(c):
    """Cut at chapter marks; the mark is dropped."""
    return F.filter(F.split(c, P.CHAPTER_MARKERS.java), lambda s: T.trim_space(s) != "")


def explode_parts(df, parts, out="part", pos="pos"):
    return df.select("*", F.posexplode(parts).alias(pos, out))


# ---- chunks: greedy packing of pieces of one text -------------------------------
def _pack(pieces, sep, flush_before, flush_after, keep, keep_tail):
    """Fold the pieces into chunks. The accumulator holds the chunk being built
    and the finished ones; finished ones are copied only when one is added."""
    sized = F.transform(pieces, lambda t: F.struct(t.alias("t"), T.word_count(t).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"),
                     F.lit(0).alias("n"))

    def step(acc, piece):
        cut = (acc["n"] > 0) & flush_before(acc["n"], piece["n"])
        done = F.when(cut & keep(acc["n"]), F.concat(acc["done"], F.array(acc["cur"]))) \
            .otherwise(acc["done"])
        fresh = cut | (acc["n"] == 0)
        cur = F.when(fresh, piece["t"]).otherwise(F.concat(acc["cur"], F.lit(sep), piece["t"]))
        n = F.when(fresh, piece["n"]).otherwise(acc["n"] + piece["n"])
        full = flush_after(n)
        return F.struct(F.when(full, F.concat(done, F.array(cur))).otherwise(done).alias("done"),
                        F.when(full, "").otherwise(cur).alias("cur"),
                        F.when(full, 0).otherwise(n).alias("n"))

    def finish(acc):
        tail = (acc["n"] > 0) & keep_tail(acc["n"])
        return F.when(tail, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])

    return F.aggregate(sized, start, step, finish)


def _never(*_):
    return F.lit(False)


def _always(*_):
    return F.lit(True)


def chunk_400(c, separator=P.BLANK_LINES, low=20, high=500, size=400):
    """Paragraphs of 20..500 words whole; longer ones packed from sentences."""
    def one(paragraph):
        n = T.word_count(paragraph)
        sentences = _nonempty(F.split(paragraph, P.SENTENCE_END.java))
        packed = _pack(sentences, ". ", lambda have, new: have + new > size, _never,
                       lambda have: have >= low, lambda have: have >= low)
        return (F.when((n >= low) & (n <= high) & (F.length(paragraph) > 100), F.array(paragraph))
                .when(n > high, F.transform(packed, lambda x: F.concat(x, F.lit("."))))
                .otherwise(F.array().cast("array<string>")))
    return F.flatten(F.transform(split_paragraphs(c, separator), one))


def chunk_40(c, size=40, min_sentence=5):
    """A new paragraph once the current one has > 40 words and the sentence > 5."""
    return _pack(split_sentences(c), " ", lambda have, new: (have > size) & (new > min_sentence),
                 _never, _always, _always)


def chunk_min200(c, separator="\n", size=200, tail=50, min_chars=20):
    """Paragraphs appended until 200 words are reached; a tail of 50 is kept."""
    pieces = F.filter(_nonempty(F.split(c, separator)), lambda p: F.length(p) >= min_chars)
    return _pack(pieces, " ", _never, lambda n: n >= size, _always, lambda n: n >= tail)


def chunk_flush_before(c, separator="\n", size=200, low=20, min_chars=20):
    """As chunk_min200, but a full chunk is closed by the next paragraph."""
    pieces = F.filter(_nonempty(F.split(c, separator)), lambda p: F.length(p) >= min_chars)
    return _pack(pieces, " ", lambda have, new: have >= size, _never, lambda n: n >= low,
                 lambda n: n >= low)


def chunk_min150(c, size=150, tail=30, min_chars=20):
    """Sentences appended until 150 words are reached; a tail of 30 is kept."""
    pieces = F.filter(_nonempty(F.split(c, P.SENTENCE_END.java)), lambda s: F.length(s) >= min_chars)
    return _pack(pieces, ". ", _never, lambda n: n >= size, _always, lambda n: n >= tail)


# ---- merge_rows: greedy packing across the rows of a work ------------------------
def merge_rows(df, by, order, text, limit=200, ranges=None):
    """Ordered rows of a work joined into paragraphs. A paragraph ends before a
    section start, and after a row ending in '.' once it is longer than limit.

    The fold has limit + 2 states: characters so far, up to limit + 1. A range of rows is a function
    from the state it begins with to the one it ends with. It soon becomes constant, at the latest where
    a paragraph outgrows the limit; from there on, and in every work that begins in the range,
    paragraphs are known in the first scan. One row per range is composed, and the few rows
    before that point are folded again with their true state.
    """
    by = list(by)
    rows = df.select(*by, order, F.col(text).alias("t_")).where(T.blank_null(F.col("t_")) != "")
    rows = rows.withColumns({
        "len_": F.length("t_"), "starts_": C.section_start(F.col("t_")),
        "ends_": F.endswith("t_", F.lit("."))})

    def step(state, first, here, length, starts, ends):
        """State and first row of the paragraph after a row, and the row's paragraph."""
        if starts or state == 0:
            state, first = length, here
        else:
            state += 1 + length
        state = min(state, limit + 1)
        return (0 if ends and state > limit else state), first, first

    def work():
        states, firsts = np.arange(limit + 2), np.full(limit + 2, -1)
        state, first, known = 0, -1, False

        def fold(batch, new, head, part, place):
            nonlocal states, firsts, state, first, known
            marks = []
            here = (part << 33) | place
            columns = [batch.column(c).to_pylist() for c in ("len_", "starts_", "ends_")]
            for begins, length, starts, ends in zip(new.tolist(), *columns):
                if begins:
                    state, first, known = 0, -1, True
                if known:
                    state, first, mark = step(state, first, here, length, starts, ends)
                else:
                    fresh = (states == 0) | starts
                    states = np.minimum(np.where(fresh, length, states + 1 + length), limit + 1)
                    firsts = np.where(fresh, here, firsts)
                    if ends:
                        states = np.where(states > limit, 0, states)
                    if (states == states[0]).all() and (states[0] == 0 or (firsts == firsts[0]).all()):
                        state, first, known = int(states[0]), int(firsts[0]), True
                    mark = None
                marks.append(mark)
                here += 1
            end = ([state], [first]) if known else (states.tolist(), firsts.tolist())
            last = [None] * (len(marks) - 1)
            return [pa.array(marks, pa.int64()), *[pa.array([*last, e], pa.list_(pa.int64())) for e in end]]
        return fold

    longs = S.ArrayType(S.LongType())
    fields = [S.StructField("mark_", S.LongType()), S.StructField("states_", longs), S.StructField("firsts_", longs)]
    scanned = O.range_scan(rows, by, [order], work, fields, "paragraphs", ranges)
    begin, state, first = [], 0, -1
    for part, go_on, _, states, firsts in O.range_ends(scanned, by, "states_", "firsts_"):
        state, first = (state, first) if go_on else (0, -1)
        begin.append((part, state, first))
        at = state if len(states) > 1 else 0
        state, first = states[at], firsts[at] if firsts[at] >= 0 else first

    def again(batches):
        key, state, first = None, 0, -1
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part_", "place_", "len_", "starts_", "ends_", "state_", "first_")]
            marks = []
            for part, place, length, starts, ends, state0, first0 in zip(*columns):
                if part != key:
                    key, state, first = part, state0, first0
                state, first, mark = step(state, first, (part << 33) | place, length, starts, ends)
                marks.append(mark)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], pa.array(marks, pa.int64())], names=names)

    names = [*by, order, "t_", "part_", "place_", "len_", "starts_", "ends_", "mark_"]
    waiting = O._per_range(scanned.where(F.col("mark_").isNull()).select(*names), begin, "state_ int, first_ long")
    folded = (waiting.repartition("part_").sortWithinPartitions("part_", "place_")
              .mapInArrow(again, scanned.select(*names).schema))
    marked = scanned.where(F.col("mark_").isNotNull()).select(*names).union(folded)
    at = F.struct("part_", "place_")
    return (marked.groupBy(*by, "mark_")
            .agg(F.min_by(order, at).alias("paragraph"), F.array_sort(F.collect_list(F.struct("part_", "place_", "t_"))).alias("rows_"))
            .select(*by, "paragraph", F.array_join(F.transform("rows_", lambda r: r["t_"]), " ")
                    .alias("text"), F.size("rows_").alias("n_rows")))


def verse_number(df, by, order, text, separator=P.BLANK_LINES, ranges=None):
    """Running verse number over a work; the chapter is carried from headers."""
    by = list(by)
    blocks = explode_parts(df.select(*by, order, text), split_paragraphs(F.col(text), separator),
                           "block", "pos")
    blocks = blocks.withColumn("header", C.chapter_header(F.col("block"))).drop(text)
    # a header is one row, before the sentences of blocks that tie with it
    parts = F.when(F.col("header").isNull(), split_sentences_simple(F.col("block"))).otherwise(F.array(F.lit(None).cast("string")))
    rows = blocks.select(*by, order, "pos", "header", F.posexplode(parts).alias("sub", "text"))
    rows = rows.withColumn("sub", F.when(F.col("header").isNull(), F.col("sub")).otherwise(-1))
    verses = O.number_under_headers(rows, by, order, "header", "chapter", "verse", ["pos", "sub"], ranges)
    return verses.select(*by, order, "pos", F.coalesce("chapter", F.lit("1")).alias("chapter"), "sub", "text", "verse")


# ---- lines, quotes, slots, tokens -------------------------------------------------
def numbered_fragments(c):
    """Fragments before `` n)``; a bare number line opens a footnote that takes
    the lines after it. Rows of (kind, label, text)."""
    lines = F.flatten(F.transform(F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n"),
                                  lambda ln: F.split(P.NUMBERED_FRAGMENT.sub(ln), CUT)))
    kind_type = "array<struct<kind:string,label:string,text:string>>"

    def item(kind, label, text):
        return F.array(F.struct(F.lit(kind).alias("kind"), label.alias("label"), text.alias("text")))

    def step(acc, line):
        n = F.size(acc)
        last = F.get(acc, n - 1)
        bare = F.rlike(line, F.lit(r"^\p{Nd}+$"))
        label = F.regexp_extract(line, r"^(\p{Nd}+\))", 1)
        grown = F.concat_ws(" ", F.nullif(last["text"], F.lit("")), line)
        return (F.when(bare, F.concat(acc, item("footnote", line, F.lit(""))))
                .when((n > 0) & (last["kind"] == "footnote"),
                      F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))),
                               item("footnote", last["label"], grown)))
                .when(label != "", F.concat(acc, item("line", label, F.trim(
                    F.substring(line, F.length(label) + 1, F.length(line))))))
                .otherwise(F.concat(acc, item("line", F.lit(""), line))))

    return F.aggregate(_nonempty(lines), F.array().cast(kind_type), step)



def quote_segments(c):
    """Quoted and unquoted stretches in order, for seven quote styles."""
    marked = F.regexp_replace(c, "(" + P.QUOTES.java + ")", CUT + MARK + "$1" + CUT)
    parts = F.filter(F.split(marked, CUT), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        F.when(F.startswith(p, F.lit(MARK)), F.substring(p, 3, F.length(p) - 3)).otherwise(p).alias("text"),
        F.startswith(p, F.lit(MARK)).alias("is_quote")))


def placeholder_segments(c):
    """Text and footnote keys in order, cut at ``{FNkey}``."""
    marked = F.regexp_replace(c, P.FOOTNOTE_SLOT.java, CUT + MARK + "$1" + CUT)
    parts = F.filter(F.split(marked, CUT), lambda p: p != "")
    def key(p):
        inner = F.trim(F.substring(p, 2, F.length(p)))
        return F.when(inner == "", "?").otherwise(inner)
    return F.transform(parts, lambda p: F.struct(
        F.when(F.startswith(p, F.lit(MARK)), key(p)).otherwise(p).alias("text"),
        F.startswith(p, F.lit(MARK)).alias("is_note")))


def tokenize(df, keys, text):
    """Word, space and punctuation tokens. ``seg`` is the running word index;
    tokens between two words come before the word they lead to."""
    c = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    noise = r"""[\s\p{Z}\x0B\x1C-\x1F\x{85}.,;:!?"'()\[\]{}«»„”]"""
    pair = "(" + noise + "*)(" + noise.replace("[", "[^", 1) + r"+|\z)"
    zipped = F.arrays_zip(F.regexp_extract_all(c, F.lit(pair), F.lit(1)).alias("gap"),
                          F.regexp_extract_all(c, F.lit(pair), F.lit(2)).alias("word"))
    rows = df.select(*keys, F.posexplode(zipped).alias("seg", "p"))
    pieces = F.concat(P.TOKENS.all(F.col("p.gap")), F.filter(F.array(F.col("p.word")), lambda w: w != ""))
    flat = rows.select(*keys, "seg", F.col("p.word").alias("w_"), F.posexplode(pieces).alias("sub", "token"),
                       F.size(pieces).alias("n_"))
    is_word = (F.col("w_") != "") & (F.col("sub") == F.col("n_") - 1)
    return flat.select(*keys, "seg", "sub", "token", is_word.alias("is_word"),
                       F.when(is_word, F.col("seg")).alias("word_index"))


def expected_words(c):
    """Words of a text to be read, punctuation cuts words."""
    spaced = F.regexp_replace(T.fold_diacritics(c), P.WORD_FORM[0].java, " ")
    return F.filter(F.split(P.SPACES.sub(spaced), " "), lambda w: w != "")


def similarity(a, b):
    """1 - edit distance / longer length; two empty words are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return (F.when(longest == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0)
            .otherwise(1 - F.levenshtein(a, b) / longest))


def greedy_align(expected, spoken, pointer=None, threshold=0.65):
    """Pointer after the spoken words. Matched indices are always the stretch
    pointer..new pointer, because skipped words count as matched."""
    start = F.lit(0) if pointer is None else pointer

    def near(word, p):
        return similarity(word, F.coalesce(F.get(expected, p), F.lit(""))) >= threshold

    def step(p, word):
        return (F.when(p >= F.size(expected), p).when(near(word, p), p + 1)
                .when(near(word, p + 1), p + 2).when(near(word, p + 2), p + 3).otherwise(p))

    return F.aggregate(spoken, start, step)


def prefix_align(expected, transcript):
    """Leading expected words that stand as one stretch in the transcript."""
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("prefix"), F.lit(True).alias("open"))

    def step(acc, word):
        longer = F.when(acc["k"] == 0, word).otherwise(F.concat(acc["prefix"], F.lit(" "), word))
        hit = acc["open"] & F.contains(transcript, longer)
        return F.struct((acc["k"] + hit.cast("int")).alias("k"),
                        F.when(hit, longer).otherwise(acc["prefix"]).alias("prefix"), hit.alias("open"))

    return F.aggregate(expected, start, step, lambda acc: acc["k"])


def reading_slots(first, psalm, second, gospel):
    """Typed slots of a day; the second reading only where it is given."""
    def slot(key, title, kind, ref):
        return F.struct(F.lit(key).alias("id"), F.lit(title).alias("title"),
                        T.blank_null(ref).alias("reference"), F.lit(kind).alias("type"))
    slots = F.array(slot("L1", "1. Lesung", "reading", first), slot("AP", "Antwortpsalm", "psalm", psalm),
                    slot("L2", "Zweite Lesung", "reading", second), slot("EV", "Evangelium", "gospel", gospel))
    return F.filter(slots, lambda s: (s["id"] != "L2") | (T.trim_space(s["reference"]) != ""))


# ---- office pages --------------------------------------------------------------------
def office_psalms(df, key, html, before=None, after=None):
    """Psalms with the last antiphon before the header and the verses after it.

    A psalm reaches from its header to the next one, whatever its length; the antiphon stands
    between the header before and its own. ``before`` and ``after`` set windows of so many
    characters instead, as the original has them (300 and 2000), with the first antiphon.
    """
    # headers fenced in one pass; they stand at the odd places of the split
    fenced = F.regexp_replace(F.translate(F.col(html), CUT, " "), "(" + P.PSALM_HEADER.java + ")", CUT + "$1" + CUT)
    empty = F.array().cast("array<struct<number:string,at:int>>")
    start = F.struct(empty.alias("hits"), F.lit(0).alias("end"), F.lit(False).alias("odd"))
    at = F.aggregate(F.split(fenced, CUT), start, lambda acc, x: F.struct(
        F.when(acc["odd"], F.concat(acc["hits"], F.array(F.struct(P.PSALM_HEADER.group(x, 1).alias("number"), acc["end"].alias("at")))))
        .otherwise(acc["hits"]).alias("hits"), (acc["end"] + F.length(x)).alias("end"), (~acc["odd"]).alias("odd")),
        lambda acc: acc["hits"])
    rows = df.select(key, F.col(html).alias("h_"), F.explode(F.array(at)).alias("all_"))
    rows = rows.select("*", F.posexplode("all_").alias("pos", "p"))
    begin = F.coalesce(F.get("all_", F.col("pos") - 1)["at"], F.lit(0)) if before is None \
        else F.greatest(F.col("p.at") - before, F.lit(0))
    lead = F.substring(F.col("h_"), begin + 1, F.col("p.at") - begin)
    length = F.coalesce(F.get("all_", F.col("pos") + 1)["at"], F.length("h_")) - F.col("p.at") if after is None else F.lit(after)
    text = F.substring(F.col("h_"), F.col("p.at") + 1, length)
    found = P.ANTIPHON.all(lead, 1)
    antiphon = F.coalesce(F.get(found, F.size(found) - 1), F.lit("")) if before is None else P.ANTIPHON.group(lead)
    verses = F.arrays_zip(*[P.OFFICE_VERSE.all(text, i).alias(n)
                            for i, n in ((1, "chapter"), (2, "verse"), (3, "text"))])
    return rows.select(
        key, "pos", F.col("p.number").alias("number"), T.clean_markup(antiphon).alias("antiphon"),
        F.transform(verses, lambda v: F.struct(v["chapter"].alias("chapter"), v["verse"].alias("verse"),
                                               T.clean_markup(v["text"]).alias("text"))).alias("verses"))


def office_antiphons(c, min_chars=5):
    texts = F.transform(P.ANTIPHON.all(c, 1), T.clean_markup)
    return F.filter(texts, lambda t: F.length(t) > min_chars)


def office_prayers(c, min_chars=10):
    texts = F.transform(P.COLLECT.all(c, 0), lambda x: T.clean_markup(T.br_to_newline(x)))
    return F.filter(texts, lambda t: F.length(t) > min_chars)


def office_versicles(c):
    pairs = F.arrays_zip(P.VERSICLE.all(c, 1).alias("v"), P.VERSICLE.all(c, 2).alias("r"))
    return F.transform(pairs, lambda p: F.struct(
        T.clean_markup(p["v"]).alias("versicle"), T.clean_markup(p["r"]).alias("response"),
        C.detect_language(p["v"]).alias("language")))


def office_section(html, hour):
    """The stretch of the page from the hour's heading to the next heading."""
    at = F.locate(f"ID='{hour}top'", html)
    rest = F.substring(html, at, F.length(html))
    stop = F.locate("<H2", rest, 101)
    return F.when(at > 0, F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(rest))

