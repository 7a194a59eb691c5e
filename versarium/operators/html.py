"""Stored pages: node table, main content, blocks, sections, notes, links.

A small Arrow helper turns a page into its list of element nodes. Everything
after it (scores, argmax, blocks, sections, notes) is column code on that list,
inside the row of the page, so no step groups or shuffles.
"""

import html as html_lib
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versarium.functions import classify as C
from versarium.functions import predicates as Q
from versarium.functions import text as T
from versarium.session import in_slices

PAGE_BYTES = 1 << 20  # of pages whose nodes a task holds at once, or one page

# ---- fixed values: tags and class hints ----------------------------------------
HEADINGS = ("h1", "h2", "h3", "h4")
PARAGRAPHS = ("p", "blockquote", "pre")
LISTS = ("ul", "ol")
NOTE_HINTS = ("footnote", "fussnote", "notes")
SKIP_CLASSES = ("detail-view-header", "division-footer", "ornament", "breadcrumb", "breadcrumbs", "sidebar",
                "content-navigation", "related-links", "edition-information", "meta", "metadata", "division-meta")
CHROME = {"script", "style", "nav", "header", "footer"}
VOID = {"br", "hr", "img", "input", "link", "meta", "source", "wbr", "area", "base", "col", "embed"}
# Start tags that end an open paragraph.
ENDS_P = {"p", "div", "section", "article", "main", "aside", "ul", "ol", "li", "table", "blockquote", "pre", "hr",
          "h1", "h2", "h3", "h4", "h5", "h6", "nav", "header", "footer", "form", "dl", "figure"}

NODE = ("struct<node:int,parent:int,last:int,depth:int,tag:string,cls:string,elem_id:string,kind:string,"
        "outer:int,froot:int,n_p:int,n_h:int,n_chars:int,n_inner:int,note:string,text:string>")
_INT = {"node", "parent", "last", "depth", "outer", "froot", "n_p", "n_h", "n_chars", "n_inner"}
_NODE_ARROW = pa.list_(pa.struct([(f.split(":")[0], pa.int32() if f.split(":")[0] in _INT else pa.string())
                                  for f in NODE[7:-1].split(",")]))
_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
                    re.S)
_ATTR = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


def _fold(text):
    return "".join(ch for ch in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(ch)).lower()


def _kind(tag, cls, elem_id):
    if any(h in cls for h in NOTE_HINTS) or "footnote" in elem_id or tag == "aside":
        return "footnotes"
    if tag in HEADINGS:
        return "heading"
    if tag in PARAGRAPHS:
        return "paragraph"
    if tag in LISTS:
        return "list"
    if tag == "table":
        return "table"
    if tag == "hr" or (tag in ("div", "section", "article") and any(s in cls for s in SKIP_CLASSES)):
        return "skip"
    return "container"


def parse_nodes(page):
    """Element nodes of one page in document order."""
    nodes, stack, chunks, at = [], [], [], 0
    page = page or ""

    def add_text(raw):
        clean = " ".join(html_lib.unescape(raw).split())
        if clean:
            chunks.append(clean)

    def close(to):
        while len(stack) > to:
            node = stack.pop()
            node["last"], node["c1"] = len(nodes) - 1, len(chunks)

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        add_text(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i]["tag"] == tag), None)
            if depth is not None:
                close(depth)
            continue
        if tag in CHROME:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ENDS_P:
            inner = [i for i, n in enumerate(stack) if n["tag"] == "p"]
            if inner:
                close(inner[0])
            if tag == "li":
                open_li = [i for i, n in enumerate(stack) if n["tag"] in ("li", "ul", "ol")]
                if open_li and stack[open_li[-1]]["tag"] == "li":
                    close(open_li[-1])
        attrs = {a[1].lower(): html_lib.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])}
        parent = stack[-1] if stack else None
        cls, elem_id = _fold(attrs.get("class", "")), _fold(attrs.get("id", ""))
        kind = _kind(tag, cls, elem_id)
        node = {"node": len(nodes), "parent": parent["node"] if parent else -1, "depth": len(stack), "tag": tag,
                "cls": cls, "elem_id": attrs.get("id", ""), "kind": kind, "n_inner": 0, "c0": len(chunks),
                "attrs": attrs, "outer": -1, "froot": -1}
        if parent:
            own = parent["kind"] != "container"
            node["outer"] = parent["node"] if own else parent["outer"]
            node["froot"] = parent["node"] if parent["kind"] == "footnotes" else parent["froot"]
            if kind != "skip":
                parent["n_inner"] += 1
        nodes.append(node)
        if tag in VOID:
            node["last"], node["c1"] = node["node"], len(chunks)
        else:
            stack.append(node)
    add_text(page[at:])
    close(0)
    return _finished(nodes, chunks)


def _finished(nodes, chunks):
    sizes = [0]
    for chunk in chunks:
        sizes.append(sizes[-1] + len(chunk))
    out = []
    for n in nodes:
        n_chunks = n["c1"] - n["c0"]
        n["n_chars"] = sizes[n["c1"]] - sizes[n["c0"]] + max(n_chunks - 1, 0)
        n["n_p"] = n["n_h"] = 0
    for n in nodes:
        if n["parent"] >= 0:
            above = nodes[n["parent"]]
            above["n_p"] += n["tag"] == "p" and n["n_chars"] > 0
            above["n_h"] += n["tag"] in HEADINGS
    for n in nodes:
        leaf = n["kind"] != "container" or n["n_inner"] == 0 or n["tag"] in ("li", "h5", "h6")
        n["text"] = " ".join(chunks[n["c0"]:n["c1"]]) if leaf or n["tag"] == "div" and n["n_p"] == 0 else None
        n["note"] = _note_number(n, nodes, chunks) if n["froot"] >= 0 else None
        out.append({k: v for k, v in n.items() if k not in ("c0", "c1", "attrs")})
    return out


def _note_number(node, nodes, chunks):
    """Explicit number, id suffix, label class or back link of a note."""
    explicit = node["attrs"].get("data-footnote-number")
    if explicit:
        return explicit.strip()
    if node["elem_id"].split(":")[-1].strip():
        return node["elem_id"].split(":")[-1].strip()
    inside = nodes[node["node"] + 1:node["last"] + 1]
    for label in inside:
        if "footnote-number" in label["cls"] and label["n_chars"]:
            return " ".join(chunks[label["c0"]:label["c1"]])
    for link in inside:
        if link["tag"] == "a" and "#fnref" in link["attrs"].get("href", "").lower() and link["n_chars"]:
            return " ".join(chunks[link["c0"]:link["c1"]])
    return None


def with_nodes(df, keys, html="html"):
    """Keys and the node list of each page (HTM1)."""
    fields = df.select(*keys).schema

    def parse(batches):
        for batch in batches:
            for part in in_slices(batch, pc.binary_length(batch.column(len(keys))), PAGE_BYTES):
                parsed = pa.array([parse_nodes(p) for p in part.column(len(keys)).to_pylist()], type=_NODE_ARROW)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keys))] + [parsed],
                                                 names=[*keys, "nodes"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", nodes array<{NODE}>"
    return df.select(*keys, html).mapInArrow(parse, schema)


def _first_tag(nodes, tag):
    return F.get(F.filter(nodes, lambda n: n["tag"] == tag), 0)


def with_main_content(df):
    """Add ``root`` and ``best``: the best-scoring wrapper under main, article
    or body. A page with an error container has neither."""
    nodes = F.col("nodes")
    root = F.coalesce(_first_tag(nodes, "main"), _first_tag(nodes, "article"), _first_tag(nodes, "body"),
                      F.get(nodes, 0))
    rooted = df.withColumn("root", F.explode(F.array(root)))
    inside = F.filter("nodes", lambda n: (n["node"] >= F.col("root.node")) & (n["node"] <= F.col("root.last")))
    broken = F.exists(inside, lambda n: F.contains(n["cls"], F.lit("error-message")))

    def candidate(n):
        above = F.get(F.col("nodes"), n["parent"])["cls"]
        return (n["tag"].isin("div", "section", "article") & ~C.contains_any(n["cls"], SKIP_CLASSES)
                & ~F.contains(n["cls"], F.lit("footnote")) & ~F.contains(F.coalesce(above, F.lit("")), F.lit("footnote"))
                & ((n["n_p"] > 0) | (n["n_h"] > 0) | (n["n_chars"] >= 200)))

    def scored(n):
        depth = n["depth"] - F.col("root.depth")
        score = 6.0 * n["n_p"] + 3.0 * n["n_h"] + n["n_chars"] / 400 - 0.5 * depth
        return F.struct(score.alias("score"), (-n["node"]).alias("first"), n["node"].alias("node"), n["last"].alias("last"))

    best = F.array_max(F.transform(F.filter(inside, candidate), scored))
    whole = F.struct(F.lit(0.0).alias("score"), (-F.col("root.node")).alias("first"), F.col("root.node").alias("node"),
                     F.col("root.last").alias("last"))
    return (rooted.withColumn("best", F.explode(F.array(F.when(~broken, F.coalesce(best, whole)))))
            .where(F.col("best").isNotNull()))


def content_blocks(df):
    """Ordered blocks of the main content as an array column ``blocks``."""
    def wanted(n):
        inside = (n["node"] > F.col("best.node")) & (n["node"] <= F.col("best.last")) & (n["outer"] <= F.col("best.node"))
        leaf = (n["kind"] == "container") & (n["n_inner"] == 0) & (n["n_chars"] > 0)
        return inside & (n["kind"].isin("heading", "paragraph", "list", "table", "footnotes") | leaf)

    def block(n):
        return F.struct(F.when(n["kind"] == "container", "paragraph").otherwise(n["kind"]).alias("kind"),
                        n["tag"].alias("tag"), n["cls"].alias("cls"), n["node"].alias("node"), n["text"].alias("text"))
    return df.withColumn("blocks", F.transform(F.filter("nodes", wanted), block))


SECTION = "struct<role:string,title:string,paragraphs:array<string>>"


def sections(blocks):
    """Sections of a page: a heading opens one, footnotes close one."""
    empty = F.array().cast(f"array<{SECTION}>")

    def section(role, title, paragraphs):
        return F.array(F.struct(role.alias("role"), title.alias("title"), paragraphs.alias("paragraphs")))

    def step(acc, b):
        done, heads = acc["done"], acc["heads"]
        n = F.size(done)
        none = F.array().cast("array<string>")
        opened = F.concat(done, section(C.section_role(b["text"]), b["text"], none))
        fresh = F.concat(done, section(F.when(heads, "main").otherwise("intro"), F.lit(None).cast("string"),
                                       F.array(b["text"])))
        last = F.get(done, n - 1)
        grown = F.concat(F.slice(done, 1, F.greatest(n - 1, F.lit(0))),
                         section(last["role"], last["title"], F.concat(last["paragraphs"], F.array(b["text"]))))
        head, note = b["kind"] == "heading", b["kind"] == "footnotes"
        skip = note | (b["text"] == "")
        return F.struct(F.when(skip, done).when(head, opened).when(acc["open"], grown).otherwise(fresh).alias("done"),
                        F.when(note, F.lit(False)).when(b["text"] == "", acc["open"]).otherwise(True).alias("open"),
                        (heads | head).alias("heads"))

    start = F.struct(empty.alias("done"), F.lit(False).alias("open"), F.lit(False).alias("heads"))

    def finish(acc):
        return F.transform(acc["done"], lambda s: F.struct(
            F.when((s["role"] == "intro") & ~acc["heads"], "main").otherwise(s["role"]).alias("role"),
            s["title"].alias("title"), F.array_join(s["paragraphs"], "\n\n").alias("text"),
            F.size(s["paragraphs"]).alias("paragraph_count")))
    return F.aggregate(blocks, start, step, finish)


def footnotes(df, keys):
    """Note items of every footnote list with their number."""
    def item(n):
        above = F.get(F.col("nodes"), n["parent"])
        listed = (n["tag"] == "li") & above["tag"].isin("ol", "ul")
        direct = (n["tag"] == "p") & (above["kind"] == "footnotes") & ~above["tag"].isin("ol", "ul")
        return (n["froot"] >= 0) & (listed | direct) & (n["n_chars"] > 0)
    # numbering restarts in every footnote root
    rows = df.select(*keys, F.inline(F.filter("nodes", item)))
    pos = F.row_number().over(W.partitionBy(*keys, "froot").orderBy("node"))
    return rows.select(*keys, F.coalesce("note", pos.cast("string")).alias("number"), F.col("text"))


def page_notes(df, keys, min_chars=5):
    """Distinct texts of elements that look like notes."""
    hint = F.array(*[F.lit(h) for h in ("footnote", "note", "annotation", "sup")])
    def note(n):
        return (n["tag"] == "sup") | F.exists(hint, lambda h: F.contains(n["cls"], h))
    texts = F.array_distinct(F.transform(F.filter("nodes", note), lambda n: T.clean_segment(n["text"])))
    return df.select(*keys, F.explode(F.filter(texts, lambda t: F.length(t) > min_chars)).alias("note"))


def segments(df, keys):
    """Typed segments with carried book and chapter (one page per row)."""
    tags = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "li")
    picked = F.filter("nodes", lambda n: n["tag"].isin(*tags) & (n["node"] > F.col("best.node"))
                      & (n["node"] <= F.col("best.last")) & (F.length(n["text"]) >= 10))
    rows = df.select(*keys, F.inline(F.transform(picked, lambda n: F.struct(
        n["node"].alias("node"), n["tag"].alias("tag"), n["cls"].alias("cls"), n["text"].alias("raw")))))
    # classified on the raw text: cleaning removes the verse numbers
    typed = rows.withColumns({"kind": C.segment_type(F.col("tag"), F.col("raw"), F.col("cls")),
                              "text": T.clean_segment(F.col("raw"))}).where("text <> ''")
    w = W.partitionBy(*keys).orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow)
    book = F.last(F.when(F.col("kind") == "book", F.col("text")), True).over(w)
    chapter = F.last(F.when(F.col("kind") == "chapter", F.col("text")), True).over(w)
    level = F.when(F.col("kind") == "introduction", 1).when(F.rlike("tag", F.lit("^h[1-6]$")),
                                                            F.right("tag", F.lit(1)).cast("int"))
    return typed.select(
        *keys, F.row_number().over(W.partitionBy(*keys).orderBy("node")).alias("segment_no"), "kind",
        C.section_number(F.col("kind"), F.col("raw")).alias("section_number"),
        T.snippet(F.col("text"), 100).alias("title"), "text", T.word_count(F.col("text")).alias("n_words"),
        F.coalesce(chapter, book).alias("parent_section"),
        F.when(F.col("kind") == "footnote", 99).otherwise(F.coalesce(F.last(level, True).over(w), F.lit(0)))
        .alias("hierarchy_level"))


def extract_sections(df, keys, work_title, min_words=10):
    """Titled, de-duplicated, numbered paragraphs of the main content."""
    from versarium.operators import segment as G
    picked = F.filter("nodes", lambda n: n["tag"].isin("p", "h1", "h2", "h3", "h4", "h5", "h6")
                      & (n["node"] > F.col("best.node")) & (n["node"] <= F.col("best.last")) & ~Q.unwanted_content(n["text"]))
    rows = df.select(*keys, work_title, F.inline(F.transform(picked, lambda n: F.struct(
        n["node"].alias("node"), n["tag"].alias("tag"), T.clean_work_text(n["text"]).alias("text")))))
    rows = rows.where(F.length("text") >= 15)
    seen = F.row_number().over(W.partitionBy(*keys, F.sha2("text", 256)).orderBy("node"))
    rows = rows.withColumn("seen_", seen).where("seen_ = 1")
    w = W.partitionBy(*keys).orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow)
    head = F.rlike("tag", F.lit("^h"))
    titled = rows.withColumn("title", F.coalesce(F.last(F.when(head, F.col("text")), True).over(w), F.col(work_title)))
    parts = titled.where(~head).select(*keys, "title", "node", F.posexplode(G.chunk_40(F.col("text"))).alias("sub", "text"))
    kept = parts.withColumn("n_words", T.word_count(F.col("text"))).where(F.col("n_words") >= min_words)
    # filtered first, then numbered, so that the numbers have no gaps
    number = F.row_number().over(W.partitionBy(*keys).orderBy("node", "sub"))
    return kept.select(*keys, "title", number.alias("section"), "text", "n_words")


def content_fallback(df, keys, min_chars=20):
    """Text of ``p, div`` with a content class, else of all ``p``; no boilerplate."""
    def classed(n):
        return n["tag"].isin("p", "div") & F.rlike(n["cls"], F.lit("text|content|body"))
    with_class = F.filter("nodes", classed)
    plain = F.filter("nodes", lambda n: n["tag"] == "p")
    chosen = F.when(F.size(with_class) > 0, with_class).otherwise(plain)
    texts = F.transform(chosen, lambda n: F.struct(n["node"].alias("node"), n["text"].alias("text")))
    rows = df.select(*keys, F.inline(F.filter(texts, lambda t: F.length(t["text"]) > min_chars)))
    return rows.where(~Q.unwanted_words(F.col("text")))


def page_metadata(df, keys, url="url"):
    """Author, title and work id of a page."""
    nodes = F.col("nodes")
    def pick(*tests):
        def first(test):
            hits = F.filter(nodes, lambda n: test(n) & (F.length(n["text"]) > 3))
            return F.get(hits, 0)["text"]
        return F.coalesce(*[first(test) for test in tests])
    def tag(name):
        return lambda n: n["tag"] == name
    def cls(name):
        return lambda n: F.contains(n["cls"], F.lit(name))
    author = F.coalesce(pick(tag("h1"), cls("author"), cls("breadcrumb")), F.lit("Unbekannter Autor"))
    titles = pick(lambda n: (n["tag"] == "h2") & (n["text"] != author), lambda n: cls("title")(n) & (n["text"] != author))
    return df.select(*keys, author.alias("author"), F.coalesce(titles, F.lit("Unbekannter Titel")).alias("title"),
                     T.url_work_id(F.col(url)).alias("work_id"))


def extract_links(df, keys, html="html", base="url"):
    """Every link with text, in order; first occurrence per page and address."""
    walk = F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""")
    links = F.arrays_zip(F.regexp_extract_all(html, walk, F.lit(1)).alias("href"),
                         F.regexp_extract_all(html, walk, F.lit(2)).alias("label"))
    rows = df.select(*keys, base, F.posexplode(links).alias("pos", "l"))
    href = F.col("l.href")
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    absolute = F.when(F.rlike(href, F.lit("^https?://")), href).when(F.startswith(href, F.lit("/")), F.concat(root, href)) \
        .otherwise(F.concat(root, F.lit("/"), href))
    rows = rows.select(*keys, "pos", absolute.alias("link"), T.clean_markup(F.col("l.label")).alias("label"))
    # links of one page sit in one row, so this window is bounded by the page
    seen = F.row_number().over(W.partitionBy(*keys, "link").orderBy("pos"))
    return rows.withColumn("seen_", seen).where("seen_ = 1").drop("seen_")


def work_link(link, label, min_label=10):
    """A link to a work: by path and label length."""
    return F.contains(link, F.lit("/works/")) & (F.length(label) > min_label)


def german_work_link(link, label):
    return work_link(link, label) & F.contains(label, F.lit("Übersetzung (Deutsch)"))


def version_link(link):
    return F.contains(link, F.lit("/works/")) & F.contains(link, F.lit("/versions/"))


def download_link(link, label):
    """A file link: by folder and ending, or by a label with format and size."""
    low = F.lower(label)
    ending = C.contains_any(F.lower(link), [".epub", ".pdf", ".docx", ".rtf"])
    sized = C.contains_any(low, ["docx", "epub", "pdf", "rtf"]) & F.contains(low, F.lit("kb"))
    return (F.contains(link, F.lit("/files/")) & ending) | sized


