"""Repeated byte strings across a corpus: a run-length index over what shares its minimizers.

Every window of `width` bytes has an anchor, the leftmost of its 16-byte strings with the least hash.
Equal windows have equal anchors at the same place, so only windows of one anchor have to meet. The
consecutive windows of one anchor are a piece. Pieces that are equal as a whole repeat each other
at once; what differs goes, anchor by anchor, through a run-compressed Burrows-Wheeler transform.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from versarium.llm.common import held, pick, staged

WIDTH = 400  # bytes of the strings that are looked for
SEED = 16  # bytes of an anchor
STEP = 50  # bytes of the blocks that a window has to share before it is indexed
SHARD = 1 << 20  # bytes that one index is built for, about
HOT = 500  # different pieces of an anchor up to which one task takes them all
CELL = 32  # windows of the cells into which the pieces of other anchors are cut
ROOM = 1 << 19  # bytes that are cut into pieces together
_PLACE = np.uint64((1 << 22) - 1)
_P = 0x9E3779B97F4A7C15


def _mixed(h):
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(size):
    """The first powers of the base and of its inverse modulo 2^64."""
    powers = [np.full(size, x, dtype=np.uint64) for x in (_P, pow(_P, -1, 1 << 64))]
    for p in powers:
        p[0] = 1
        np.cumprod(p, out=p)
    return powers


def _tables():
    """A hash per byte, and powers for as many bytes as are mostly hashed together."""
    return _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P)), *_powers((1 << 21) + 1)


class Hashes:
    """Hashes of any stretch of some bytes, from sums of code times power."""

    def __init__(self, raw):
        codes, powers, self.inverse = held("repeats", _tables)
        if len(raw) >= len(powers):
            powers, self.inverse = _powers(len(raw) + 1)
        self.codes = codes[raw]
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.codes * powers[:len(raw)], out=self.sums[1:])

    def of(self, start, stop):
        return _mixed((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


def pieces_of(raw, ends, width=WIDTH):
    """(start, windows, anchor place, anchor hash, hash of the whole) of the pieces of some byte strings.

    `raw` are the strings one after the other, `ends` where each ends; windows lie within one string.
    A piece is `windows` windows in a row that have the same anchor, windows + width - 1 bytes. No two
    windows of one piece are equal, as they see their anchor at different places.
    """
    many = width - SEED + 1
    none = np.zeros(0, dtype=np.int64)
    begin = np.concatenate([[0], ends[:-1]])
    room = np.maximum(ends - begin - width + 1, 0)
    if not room.sum():
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = np.repeat(begin - (np.cumsum(room) - room), room) + np.arange(room.sum())
    hashes = Hashes(raw)
    seeds = hashes.codes
    for size in (1, 2, 4, 8):
        longer = seeds * np.uint64(_P ^ (size << 32))
        longer[:-size] += seeds[size:]
        seeds = longer
    seeds = _mixed(seeds)
    least = (seeds & ~_PLACE) | np.arange(len(raw), dtype=np.uint64)
    size = 1
    while 2 * size <= many:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < many:
        least = np.minimum(least[:size - many], least[many - size:])
    place = (least[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    windows = np.diff(np.append(first, len(at)))
    start = at[first]
    return start, windows, place[first], seeds[place[first]], hashes.of(start, start + windows + width - 1)


def suffix_array(raw, ends):
    """Order of all suffixes of strings one after the other, each of which ends in a byte 255.

    A suffix ends with its string, and of equal ones the earlier string's is first. Prefix doubling;
    only suffixes that are not yet told apart are sorted again.
    """
    n, step = len(raw), 4
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    left = ends[owner] - np.arange(n)  # bytes to the end of the string, the last one included
    if len(ends) >= 1 << 30:
        raise ValueError("too many strings for one index")
    padded = np.concatenate([raw, np.zeros(step, np.uint8)]).astype(np.int64)
    key = np.zeros(n, dtype=np.int64)
    for i in range(step):
        key = key * 256 + np.where(left > i, padded[i:n + i], 0)
    key = (key << 30) + np.where(left <= step, owner, 0)
    order = np.argsort(key)
    rank, todo = np.zeros(n, dtype=np.int64), order
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    while True:
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(todo)))
        if step == 4:
            rank[todo] = np.repeat(first, sizes)
        many = np.repeat(sizes > 1, sizes)
        todo = todo[many]
        if not len(todo):
            break
        key = rank[todo] * n + rank[todo + step]  # a suffix that ends within `step` bytes is told apart already
        order = np.argsort(key)
        todo, key = todo[order], key[order]
        group = key // n
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(len(todo)) - np.repeat(head, np.diff(np.append(head, len(todo))))
        rank[todo] = group + np.repeat(place[new], np.diff(np.append(np.flatnonzero(new), len(todo))))
        step *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some strings, with the suffixes at both ends of each run.

    `heads` are the bytes of the runs, `starts` their places in the transform; `above` and `below`
    the suffixes on either side of each border between runs, `common` the length that they share.
    The byte before the first of a string is the end of another, so it is a run of its own.
    """

    def __init__(self, raw, ends):
        order = suffix_array(raw, ends)
        before = raw[order - 1].astype(np.int64)
        begin = np.concatenate([[0], ends[:-1]])
        whole = np.zeros(len(raw), dtype=bool)
        whole[begin] = True
        new = (before[1:] != before[:-1]) | whole[order[1:]] | whole[order[:-1]]
        border = np.flatnonzero(new) + 1
        self.starts = np.concatenate([[0], border])
        self.heads = before[self.starts]
        self.size = len(raw)
        self.above, self.below = order[border - 1], order[border]
        self.left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(raw)) - 1  # without the end mark
        self.common = self._common(raw, self.above, self.below)

    def _common(self, raw, one, two):
        """Length of the common prefix of pairs of suffixes, eight bytes at a time."""
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        eight = np.zeros(len(raw), dtype=np.uint64)
        for i in range(8):
            eight |= padded[i:len(raw) + i].astype(np.uint64) << np.uint64(8 * i)
        most = np.minimum(self.left[one], self.left[two])
        out, go_on, done = most.copy(), np.flatnonzero(most > 0), 0
        while len(go_on):
            apart = eight[one[go_on] + done] ^ eight[two[go_on] + done]
            differ = apart != 0
            low = apart[differ] & (~apart[differ] + np.uint64(1))
            out[go_on[differ]] = done + np.log2(low.astype(np.float64)).astype(np.int64) // 8
            done += 8
            go_on = go_on[~differ]
            go_on = go_on[most[go_on] > done]
        return np.minimum(out, most)

    def matching_statistics(self):
        """For every place the length of the longest string that starts there and somewhere else as well.

        That is the greater of what a suffix shares with its two neighbours in order. Along the text it
        falls by one from place to place but at the borders of runs, so the samples there give all.
        """
        best = np.zeros(self.size, dtype=np.int64)
        for at in (self.above, self.below):
            reach = np.zeros(self.size, dtype=np.int64)
            reach[at] = at + self.common
            best = np.maximum(best, np.maximum.accumulate(reach) - np.arange(self.size))
        return np.maximum(best, 0)


def _runs(places):
    """(first, number) of the runs of following numbers."""
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1] + 1])) if len(places) else places
    return places[first], np.diff(np.append(first, len(places)))


def repeated_windows(contents, anchors, places, width=WIDTH, step=STEP):
    """(piece, start, windows): windows of some pieces that occur more than once among them.

    `places` are those of the anchors in the pieces. Cut at multiples of `step` from its anchor, a window
    holds whole blocks; one with a block that no other piece of the anchor has is left out first.
    """
    raw = np.frombuffer(b"".join(contents), dtype=np.uint8)
    sizes = np.fromiter(map(len, contents), dtype=np.int64, count=len(contents))
    base = np.cumsum(sizes) - sizes
    hashes = Hashes(raw)
    low = -(places // step)
    blocks = np.maximum((sizes - places) // step - low, 0)
    piece = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks) + low[piece]
    start = base[piece] + places[piece] + number * step
    key = _mixed(hashes.of(start, start + step) ^ anchors[piece]) + _mixed(number.view(np.uint64))
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    alone = times[which] < 2
    room = sizes - width + 1
    lost = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(lost, np.maximum(start[alone] + step - width, base[piece[alone]]), 1)
    np.add.at(lost, start[alone] + 1, -1)
    at = np.repeat(base, room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
    at = at[np.cumsum(lost)[at] == 0]
    if not len(at):
        return at, at, at
    begin, windows = _runs(at)
    # pieces lie side by side, so that a run of starts never reaches over one's last window
    lengths = windows + width  # and the end mark
    ends = np.cumsum(lengths)
    source = np.repeat(begin - (ends - lengths), lengths) + np.arange(ends[-1])
    text = raw[np.minimum(source, len(raw) - 1)].copy()
    text[ends - 1] = 255  # in no UTF-8 text
    found = RunIndex(text, ends).matching_statistics() >= width
    first, number = _runs(source[found])
    owner = np.searchsorted(base, first, side="right") - 1
    return owner, first - base[owner], number


def _cells(start, windows, place, cell=CELL):
    """(piece, first window, windows, where its core starts, number) of pieces cut at multiples of `cell` before their anchor.

    All windows that see their anchor at places cell * m up to cell * (m + 1) - 1 have the bytes
    from cell * m before the anchor on in common: width - cell + 1 of them are the core of the cell.
    """
    high, low = place, place - windows + 1  # places of the anchor in the first and the last window
    many = high // cell - low // cell + 1
    piece = np.repeat(np.arange(len(start)), many)
    m = high[piece] // cell - (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    first = place[piece] - np.minimum(high[piece], m * cell + cell - 1)
    last = place[piece] - np.maximum(low[piece], m * cell)
    return piece, start[piece] + first, last - first + 1, start[piece] + place[piece] - m * cell, m


def _hot_cells(data, start, windows, place, anchor, hot, single, width):
    """Columns of the cells of some pieces of one text; `core` and `whole` are hashes."""
    start, windows, place = [x.astype(np.int64) for x in (start, windows, place)]
    lengths = windows + width - 1
    hashes = Hashes(np.frombuffer(b"".join(data[s:s + n] for s, n in zip(start.tolist(), lengths.tolist())), np.uint8))
    shift = np.cumsum(lengths) - lengths - start  # from a place in the text to one in the joined bytes
    piece, first, number, core, m = _cells(start, windows, place)
    key = hashes.of(core + shift[piece], core + shift[piece] + width - CELL + 1) ^ _mixed(anchor[piece].view(np.uint64) + m.view(np.uint64))
    whole = hashes.of(first + shift[piece], first + shift[piece] + number + width - 1)
    return {"start": first, "windows": number, "place": place[piece], "anchor": anchor[piece], "hot": hot[piece], "single": single[piece],
            "core": key.view(np.int64), "whole": whole.view(np.int64)}


def _parts(texts, width):
    """Lists of (row, offset, bytes) of about ROOM bytes; long texts in stretches that overlap by width - 1."""
    out, size = [], 0
    for row, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        for at in range(0, len(data) - width + 1, ROOM):
            out.append((row, at, data[at:at + ROOM + width - 1]))
            size += len(out[-1][2])
            if size > ROOM:
                yield out
                out, size = [], 0
    if out:
        yield out


def repeated_spans(documents, id_col="doc_id", text_col="text", width=WIDTH, hot=HOT, shard=SHARD):
    """(doc_id, text_hash, start, windows): `windows` following places where strings of `width` bytes
    start that start somewhere else in the table as well, the same text included. Bytes from 0.

    Rows are told apart by id and text; those that agree in both repeat each other wholly. Null and
    short texts give no row. An anchor with more than `hot` different pieces is not taken by one task:
    Spark counts the hashes of its cells, and of the windows of cells that are neither equal as a whole
    nor apart in their core, which finds the same windows.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    docs = pick(documents, doc_id=id_col, text=text_col).filter("text is not null").withColumn("text_hash", F.xxhash64("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch["text"], width):
                ends = np.cumsum([len(p[2]) for p in part])
                start, windows, place, anchor, whole = pieces_of(np.frombuffer(b"".join(p[2] for p in part), np.uint8), ends, width)
                which = np.searchsorted(ends, start, side="right")
                row = np.array([p[0] for p in part])[which]
                shift = np.array([p[1] - (ends[i] - len(p[2])) for i, p in enumerate(part)])[which]
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[row], "text_hash": batch["text_hash"].to_numpy()[row],
                                    "start": start + shift, "windows": windows, "place": place - start,
                                    "anchor": anchor.view(np.int64), "whole": whole.view(np.int64)})
    row = f"doc_id {kind}, text_hash long, start long, windows int, place int"
    # cut twice rather than written: most anchors occur once and are done with
    pieces = docs.mapInPandas(cut, f"{row}, anchor long, whole long")
    shared = staged(pieces.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    pieces = staged(pieces.join(shared, "anchor"), "shared")
    one = F.min(F.struct("doc_id", "text_hash", "start", "windows", "place")).alias("one")
    classes = staged(pieces.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("copies"), one), "classes")
    several = classes.filter("copies > 1").select("anchor", "whole")
    same = pieces.join(several, ["anchor", "whole"]).select("doc_id", "text_hash", "start", "windows")
    anchors = staged(classes.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum((F.col("copies") == 1).cast("long")).alias("single"))
        .filter("kinds > 1 and single > 0").drop("single"), "kinds")
    asked = classes.join(anchors, "anchor").select(
        "one.*", "anchor", (F.col("kinds") > hot).alias("hot"), (F.col("copies") == 1).alias("single"))
    fields = ["start", "windows", "place", "anchor", "hot", "single"]
    wanted = staged(asked.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*fields)).alias("p")), "wanted")
    total = wanted.agg(F.sum(F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["windows"] + width))).first()[0] or 0
    # rows that repeat an id and a text are read once
    texts = docs.join(wanted.select("doc_id", "text_hash"), docs.doc_id.eqNullSafe(wanted.doc_id) & (docs.text_hash == wanted.text_hash), "left_semi")
    both = wanted.alias("w").join(texts.dropDuplicates(["doc_id", "text_hash"]).alias("d"),
                                  F.col("w.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("w.text_hash") == F.col("d.text_hash")))

    def content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in np.array_split(batch, max(1, len(batch) // 100)):
                out = {k: [] for k in ("row", *fields, "core", "whole", "bytes")}
                for row, r in enumerate(some.itertuples(index=False)):
                    data = r.text.encode("utf-8", "surrogatepass")
                    cold = ~r.hot
                    found = {k: getattr(r, k)[cold] for k in fields}
                    found["core"] = found["whole"] = np.zeros(len(found["start"]), np.int64)
                    at = np.flatnonzero(r.hot)
                    for some_at in np.array_split(at, -(-len(at) // 1000) or 1):
                        cut_up = _hot_cells(data, *[getattr(r, k)[some_at] for k in fields], width)
                        found = {k: np.concatenate([found[k], cut_up[k]]) for k in found}
                    for k, v in found.items():
                        out[k] += v.tolist()
                    out["row"] += [row] * len(found["start"])
                    out["bytes"] += [data[s:s + n + width - 1] for s, n in zip(found["start"].tolist(), found["windows"].tolist())]
                row = np.array(out.pop("row"), dtype=np.int64)
                yield pd.DataFrame({k: some[k].to_numpy()[row] for k in ("doc_id", "text_hash")} | out)
    read = staged(both.select("w.doc_id", "w.text_hash", "d.text", *[f"w.p.{c}" for c in fields]).mapInPandas(
        content, f"{row}, anchor long, hot boolean, single boolean, core long, whole long, bytes binary"), "contents")
    shards = max(1, -(-total // shard))

    def index(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["anchor", "doc_id", "text_hash", "start"], ignore_index=True)
        piece, start, number = repeated_windows(rows["bytes"].tolist(), rows["anchor"].to_numpy().view(np.uint64),
                                                rows["place"].to_numpy(dtype=np.int64), width)
        kept = rows["single"].to_numpy()[piece]
        found = rows.iloc[piece[kept]][["doc_id", "text_hash", "start"]].reset_index(drop=True)
        return found.assign(start=found["start"] + start[kept], windows=number[kept])
    out = f"doc_id {kind}, text_hash long, start long, windows int"
    spot = ["doc_id", "text_hash", "start"]
    met = read.filter(~F.col("hot")).select(*spot, "anchor", "place", "single", "bytes", F.pmod(
        F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard")).groupBy("shard").applyInPandas(index, out)
    # hot anchors: equal cells repeat each other; where only the core of a cell is shared, its windows are compared
    cells = read.filter("hot").select(*spot, "windows", "single", "core", "whole", "bytes")
    kinds = staged(cells.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("copies")), "cells")
    twin = cells.filter("single").join(kinds.filter("copies > 1").select("core", "whole"), ["core", "whole"]).select(*spot, "windows")
    mixed = staged(kinds.groupBy("core").count().filter("count > 1").select("core"), "mixed")
    some = cells.join(mixed, "core").dropDuplicates(["core", "whole"])

    def single_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            many = batch["windows"].to_numpy()
            ends = np.cumsum([len(b) for b in batch["bytes"]])
            if not len(ends):
                continue
            hashes = Hashes(np.frombuffer(b"".join(batch["bytes"]), np.uint8))
            row = np.repeat(np.arange(len(batch)), many)
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.concatenate([[0], ends[:-1]])[row] + inside
            h = hashes.of(at, at + width) ^ _mixed(batch["core"].to_numpy()[row].view(np.uint64))
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[row], "text_hash": batch["text_hash"].to_numpy()[row],
                                "start": batch["start"].to_numpy()[row] + inside, "single": batch["single"].to_numpy()[row], "h": h.view(np.int64)})
    lone = staged(some.select(*spot, "windows", "single", "core", "bytes").mapInPandas(
        single_windows, f"doc_id {kind}, text_hash long, start long, single boolean, h long"), "windows")
    twice = staged(lone.groupBy("h").count().filter("count > 1").select("h"), "twice")
    counted = lone.filter("single").join(twice, "h").select(*spot, F.lit(1).alias("windows"))
    return same.union(met).union(twin).union(counted).distinct()


def without_repeats(documents, id_col="doc_id", text_col="text", width=WIDTH, **options):
    """One row per document: doc_id, n_bytes, n_removed, n_spans (runs removed), kept (bytes).

    Every byte of a string of `width` bytes that also starts elsewhere goes, from all its holders;
    what repeats is judged on the whole input. Null texts are empty; short texts stay; rows without id and
    repeated rows are rows like others; an empty table gives no rows.
    """
    found = repeated_spans(documents, id_col, text_col, width, **options)
    spans = staged(found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "windows")).alias("s")), "spans")
    docs = pick(documents, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))
    joined = docs.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (
        F.col("d.text_hash") == F.col("s.text_hash")), "left")

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                data = (r.text or "").encode("utf-8", "surrogatepass")
                gone = []
                for start, windows in sorted(zip(r.start.tolist(), r.windows.tolist())) if r.start is not None else ():
                    stop = start + windows + width - 1
                    if gone and start <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], stop)
                    else:
                        gone.append([start, stop])
                borders = [0, *[x for span in gone for x in span], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(borders[::2], borders[1::2]))
                rows.append((len(data), len(data) - len(kept), len(gone), kept))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"]).assign(doc_id=batch["doc_id"])
    return joined.select("d.doc_id", "d.text", "s.s.start", "s.s.windows").mapInPandas(
        remove, f"n_bytes long, n_removed long, n_spans long, kept binary, doc_id {documents.schema[id_col].dataType.simpleString()}")
