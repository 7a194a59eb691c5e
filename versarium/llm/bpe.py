"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs."""

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from versarium.llm.common import held, in_pieces, pick

WORD_BPE = "word_bpe_49k.json"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = np.int64(1) << 40  # rank of a pair that no merge joins
BATCH_WIDTH = 64  # words of up to so many symbols are merged side by side
KEPT_WORDS = 1 << 18  # words whose result a task remembers; beyond it starts afresh


def default_vocabulary():
    import public_tokenizers
    return public_tokenizers.path(WORD_BPE)


def word_patterns():
    """(pattern, table, pattern for newer texts) of the pieces of a text.

    `table[c]` is true for characters newer than `unicodedata`. Which of them are letters or
    numbers is asked of the tokenizers library, whose Unicode version may differ from both
    Python's and the regex module's; the second pattern has them and is for such texts only.
    """
    import regex
    from tokenizers import Regex, pre_tokenizers
    # planes 4 to 13 have never held a character
    newer = [c for c in map(chr, range(0x40000)) if unicodedata.category(c) == "Cn"]
    table = np.ones(0x110000, dtype=bool)
    table[:0x40000] = False
    table[[*map(ord, newer)]] = True

    def among(kind):
        kept = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}"), "removed", invert=True).pre_tokenize_str("".join(newer))
        return "".join(part for part, _ in kept)

    def pieces(letter, number):
        return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^{SPACE}{letter}{number}]+").findall

    every = _class(newer)
    return (pieces(r"\p{L}", r"\p{N}"), table,
            pieces(*[rf"[[\p{{{kind}}}--[{every}]]{_class(among(kind))}]" for kind in "LN"]))


def _class(characters):
    """Characters in order as the inside of a character class."""
    runs = []
    for c in map(ord, characters):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in runs)


def byte_symbols():
    """The printable character that stands for each byte: itself if printable Latin-1, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordBpe:
    """A vocabulary of merges with word ends, read from a tokenizer file.

    `encode` and `decode` agree with the public library on the same file, special tokens
    included: their strings in a text become their ids.
    """

    def __init__(self, path):
        import regex
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[symbols[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([self.vocab[symbols[b] + end] for b in range(256)], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([self.vocab[a] << 20 | self.vocab[b] for a, b in merges], dtype=np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in merges], dtype=np.int64)
        self.rank_of = {int(k): r for r, k in enumerate(keys)}
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], np.int64(1) << 62)
        self.order = np.append(self.order, NONE)
        self.split, self.newer, self.split_newer = word_patterns()
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.spans = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.ids, self.shown = {}, {}

    # -- words -> ids ------------------------------------------------------

    def _ranks(self, left, right):
        at = np.searchsorted(self.keys, key := left << 20 | right)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def _side_by_side(self, words, width):
        """Merge many words at once; row r of `tree` is the segment tree of word r.

        A leaf holds rank * width + position of the pair that begins there, so the least value
        at the root is the leftmost pair of the lowest rank. Each round merges one pair in every
        word that has one left and updates the paths of the three leaves that changed.
        """
        n = len(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        rows = np.arange(n)
        sym = self.inner[text]
        sym[rows, size - 1] = self.last[text[rows, size - 1]]
        places = np.arange(width)
        sym = np.concatenate([np.where(places < size[:, None], sym, -1), np.full((n, 1), -1)], axis=1)
        following = np.tile(np.minimum(places + 1, width), (n, 1))
        before = np.tile(np.append(places - 1, width - 1), (n, 1))  # column `width` stands for the end
        tree = np.full((n, 2 * width), NONE * width, dtype=np.int64)
        paired = np.where((sym[:, :-1] >= 0) & (sym[:, 1:] >= 0), self._ranks(sym[:, :-1], sym[:, 1:]), NONE)
        tree[:, width:] = paired * width + np.where(paired < NONE, places, 0)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        alive = np.ones((n, width + 1), dtype=bool)
        active = np.flatnonzero(tree[:, 1] < NONE * width)
        while len(active):
            best = tree[active, 1]
            left, rank = best % width, best // width
            right = following[active, left]
            after = following[active, right]
            sym[active, left] = self.made[rank]
            alive[active, right] = False
            following[active, left] = after
            before[active, np.minimum(after, width)] = left
            earlier = before[active, left]
            self._update(tree, active, right, np.full(len(active), NONE * width), width)
            self._renew(tree, sym, active, left, after, width)
            some = np.flatnonzero(earlier >= 0)
            self._renew(tree, sym, active[some], earlier[some], left[some], width)
            active = active[tree[active, 1] < NONE * width]
        kept = alive[:, :width] & (sym[:, :width] >= 0)
        flat, counts = sym[:, :width][kept], kept.sum(axis=1)
        return np.split(flat, np.cumsum(counts)[:-1])

    def _renew(self, tree, sym, rows, left, right, width):
        a, b = sym[rows, left], sym[rows, right]
        ranks = np.where(b >= 0, self._ranks(a, np.maximum(b, 0)), NONE)
        self._update(tree, rows, left, ranks * width + np.where(ranks < NONE, left, 0), width)

    @staticmethod
    def _update(tree, rows, leaf, value, width):
        node = leaf + width
        tree[rows, node] = value
        node = node >> 1
        while node.size and node[0] >= 1:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def _alone(self, word):
        """One long word; the same tree in plain lists, logarithmic per merge whatever the length."""
        sym = [*self.inner[list(word)].tolist()]
        sym[-1] = int(self.last[word[-1]])
        n = len(sym)
        width = 1 << (n - 1).bit_length()
        none, rank_of = int(NONE) * width, self.rank_of.get
        tree = [none] * (2 * width)

        def leaf(a, b):
            rank = rank_of(sym[a] << 20 | sym[b]) if b < n else None
            return none if rank is None else rank * width + a

        def put(at, value):
            at += width
            tree[at] = value
            at >>= 1
            while at:
                least = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1

        tree[width:width + n] = [leaf(i, i + 1) for i in range(n)]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        following, before = list(range(1, n + 1)), list(range(-1, n))
        while tree[1] < none:
            rank, left = divmod(tree[1], width)
            right = following[left]
            after = following[right]
            sym[left], sym[right] = int(self.made[rank]), None
            following[left] = after
            if after < n:
                before[after] = left
            put(right, none)
            put(left, leaf(left, after))
            if before[left] >= 0:
                put(before[left], leaf(before[left], left))
        return np.array([s for s in sym if s is not None], dtype=np.int64)

    def learn(self, words):
        """Encode distinct words that are not known yet and remember the packed ids."""
        new = {w for w in words if w not in self.ids}
        by_width = {}
        for word in new:
            data = word.encode("utf-8", "surrogatepass")
            by_width.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((word, data))
        for width, group in by_width.items():
            if width > BATCH_WIDTH:
                found = [self._alone(data) for _, data in group]
            else:
                found = self._side_by_side([data for _, data in group], width)
            for (word, _), ids in zip(group, found):
                self.ids[word] = ids.astype("<u4").tobytes()

    # -- texts -------------------------------------------------------------

    def pieces(self, text):
        """The words of a text in order, special tokens as integers."""
        out, at = [], 0
        for found in self.spans.finditer(text):
            out += self._words(text[at:found.start()])
            out.append(self.special[found.group()])
            at = found.end()
        return out + self._words(text[at:]) if at else self._words(text)

    def _words(self, text):
        try:
            text.encode("latin-1")  # already composed
            return self.split(text.lower())
        except UnicodeEncodeError:
            pass
        if self.newer[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")].any():
            return self.split_newer(self.normalizer.normalize_str(text))
        text = unicodedata.normalize("NFC", text)
        # letter by letter where a final sigma would be a case of its own
        return self.split("".join(c.lower() for c in text) if "Σ" in text else text.lower())

    def encode_packed(self, texts):
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.ids) > KEPT_WORDS:
            self.ids.clear()
        split = [self.pieces(t) if t else [] for t in texts]
        special = {i: int(i).to_bytes(4, "little") for i in self.special.values()}
        self.learn({w for words in split for w in words if isinstance(w, str)})
        get = (self.ids | special).__getitem__ if any(s in t for t in texts if t for s in self.special) else self.ids.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def encode(self, text):
        return np.frombuffer(self.encode_packed([text])[0], dtype="<u4").tolist()

    def decode_packed(self, packed):
        """Tokens joined by one space: the file has no decoder, so word ends stay visible."""
        names = self.names.__getitem__
        return " ".join(map(names, np.frombuffer(packed, dtype="<u4").tolist()))

    def decode(self, ids):
        return self.decode_packed(np.array(ids, dtype="<u4").tobytes())


def _loaded(vocabulary):
    return held(f"bpe {vocabulary}", lambda: WordBpe(vocabulary or default_vocabulary()))


def encode_column(text, vocabulary=None):
    """array<int> of token ids of a text column; null and empty texts give an empty array."""
    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _loaded(vocabulary)
        for texts in batches:
            yield pd.Series([np.frombuffer(p, dtype="<i4") for part in in_pieces(texts) for p in bpe.encode_packed(part)],
                            dtype=object)
    return encode(text)


def decode_column(ids, vocabulary=None):
    """The decoded text of an array<int> column; null and empty arrays give the empty text."""
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _loaded(vocabulary)
        for rows in batches:
            yield pd.Series(["" if r is None else bpe.decode(r) for r in rows], dtype=object)
    return decode(ids)


def round_trips(documents, id_col="doc_id", text_col="text", vocabulary=None):
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes and decodes in one pass and returns digests only, so no token leaves its task.
    Null and empty texts have no tokens and decode to the empty text; rows with a null id and
    repeated rows are kept as they come; an empty table gives no rows.
    """
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _loaded(vocabulary)
        sha = hashlib.sha256
        for texts in batches:
            rows = [(len(p) // 4, sha(p).hexdigest(), sha(bpe.decode_packed(p).encode()).hexdigest())
                    for part in in_pieces(texts) for p in bpe.encode_packed(part)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(documents, doc_id=id_col, text=text_col).select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")


def encoded(documents, id_col="doc_id", text_col="text", vocabulary=None, keep=()):
    """One row per input row: doc_id, columns of `keep`, ids, n_tokens, decoded_sha256.

    Null and empty texts, null ids and repeated rows as in `round_trips`.
    """
    @F.pandas_udf("ids array<int>, n_tokens long, decoded_sha256 string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _loaded(vocabulary)
        for texts in batches:
            rows = [(np.frombuffer(p, dtype="<i4"), len(p) // 4, hashlib.sha256(bpe.decode_packed(p).encode()).hexdigest())
                    for part in in_pieces(texts) for p in bpe.encode_packed(part)]
            yield pd.DataFrame(rows, columns=["ids", "n_tokens", "decoded_sha256"])

    docs = pick(documents, doc_id=id_col, text=text_col, **{k: k for k in keep})
    return docs.select("doc_id", *keep, encode("text").alias("e")).select("doc_id", *keep, "e.*")
