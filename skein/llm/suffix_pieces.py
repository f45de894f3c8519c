"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch of texts (cut where no piece can reach across) are joined into one string. Its suffix
array, sorted to the depth of the longest piece, is searched for every piece: the matching range of suffixes gives all
places where the piece occurs. These edges, sorted by position, form a table (start, length) -> piece, and each word is
relaxed on it: for a BPE model, the neighbouring pair whose joint edge scores best is joined, leftmost first, until no
edge joins two neighbours. Characters without a piece fall back to byte pieces.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

SPACE = "▁"
#: Words longer than this are relaxed with a heap, one by one; characters per suffix array; words in each of a worker's
#: two generations of known words: when the young one is full it becomes the old one, whose words move up when met again.
LONG, BATCH, CACHE = 64, 150_000, 200_000
_LOADED: dict = {}
_CUT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """The vocabulary of a BPE model with byte fallback. Normalising is left to the library; matching is done here."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        plain = []
        self.bytes_of: list[bytes] = []  # what each id decodes to
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                plain.append((p, i, sp.get_score(i)))
                self.bytes_of.append(p.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p, *_ in plain):
            raise ValueError("pieces reach across words")
        self.longest = max(len(p) for p, *_ in plain)
        self.ids = np.array([i for _, i, _ in plain], np.int32)
        self.lens = np.array([len(p) for p, *_ in plain])
        self.score = np.full(n, -np.inf)
        self.score[self.ids] = [s for *_, s in plain]
        alphabet = sorted({c for p, *_ in plain for c in p})
        self.rank = np.ones(0x110000, np.uint16)  # 0 ends a word, 1 is a character in no piece
        self.rank[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
        pairs = {(a, b) for p, *_ in plain for a, b in zip(p, p[1:])}
        self.pairs = np.array(sorted(int(self.rank[ord(a)]) << 16 | int(self.rank[ord(b)]) for a, b in pairs))
        self.words = -(-self.longest // 4)  # 64-bit words of four ranks that hold the longest piece
        packed = np.zeros((len(plain), 4 * self.words), np.uint16)
        for r, (p, *_) in enumerate(plain):
            packed[r, : len(p)] = self.rank[[ord(c) for c in p]]
        above = packed.copy()
        above[np.arange(packed.shape[1]) >= self.lens[:, None]] = 0xFFFF
        self.low, self.high = self.bytes_view(packed), self.bytes_view(above)
        self.cache: dict[str, bytes] = {}  # ids as 32-bit integers
        self.old: dict[str, bytes] = {}
        self.sizes = np.array([len(b) for b in self.bytes_of])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def bytes_view(self, ranks: np.ndarray) -> np.ndarray:
        """Rows of ranks as byte strings that sort like them."""
        return np.ascontiguousarray(ranks.astype(">u2")).view(f"S{2 * ranks.shape[1]}").ravel()

    def edges(self, text: np.ndarray) -> np.ndarray:
        """Ranks of the joined words -> table (start, length) of piece ids, -1 where there is no piece."""
        n, width = len(text), 4 * self.words
        padded = np.r_[text, np.zeros(width, np.uint16)]
        suffixes = suffix_order(text, width)
        # what follows a word's end doesn't matter: no piece holds its rank 0
        ordered = self.bytes_view(np.lib.stride_tricks.sliding_window_view(padded, width)[suffixes])
        lo, hi = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        found = np.flatnonzero(hi > lo)
        many = (hi - lo)[found]
        at = np.repeat(lo[found] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        piece = np.repeat(found, many)
        cell = suffixes[at] * (self.longest + 1) + self.lens[piece]
        by_place = np.argsort(cell)
        table = np.full((n, self.longest + 1), -1, np.int32)
        table.ravel()[cell[by_place]] = self.ids[piece[by_place]]
        return table

    def relax(self, table: np.ndarray, word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of every symbol after joining; all words at once, one join a word and round."""
        pos = np.flatnonzero(text != 0)
        w, ln, done = word[pos], np.ones(len(pos), np.int64), []
        score = np.r_[self.score, -np.inf]
        while len(pos):
            span = ln[:-1] + ln[1:]
            fits = (w[:-1] == w[1:]) & (span <= self.longest)
            s = np.full(len(pos), -np.inf)
            f = np.flatnonzero(fits)
            s[f] = score[table[pos[f], span[f]]]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            best = np.maximum.reduceat(s, first)
            size = np.diff(np.r_[first, len(w)])
            live = np.repeat(np.isfinite(best), size)
            done.append((pos[~live], ln[~live]))
            hit = np.flatnonzero((s == np.repeat(best, size)) & live)
            hit = hit[np.r_[True, w[hit][1:] != w[hit][:-1]]] if len(hit) else hit
            ln[hit] += ln[hit + 1]
            live[hit + 1] = False
            pos, w, ln = pos[live], w[live], ln[live]
        start, length = (np.concatenate(x) for x in zip(*done)) if done else (pos, ln)
        o = np.argsort(start, kind="stable")
        return start[o], length[o]

    def relax_long(self, table: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long stretch: a heap of joinable pairs, best score first, then leftmost."""
        n = end - begin
        after, before, score, longest = list(range(1, n + 1)), list(range(-1, n - 1)), self.score, self.longest
        table, heap = table[begin:end], []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and after[j] - i <= longest and (p := table[i, after[j] - i]) >= 0:
                heapq.heappush(heap, (-score[p], i, after[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if j < 0 or j >= n or after[j] != stop:
                continue
            after[i], after[j] = stop, -1
            if stop < n:
                before[stop] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        after = np.array(after)
        start = np.flatnonzero(after >= 0)
        return begin + start, after[start] - start

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of distinct words into the cache."""
        at = 0
        while at < len(words):
            stop, chars = at, 0
            while stop < len(words) and (stop == at or chars + len(words[stop]) < BATCH):
                chars += len(words[stop]) + 1
                stop += 1
            part, at = words[at:stop], stop
            code = np.frombuffer("\n".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            size = np.array([len(p) for p in part])
            text = np.r_[self.rank[code], np.uint16(0)]
            ends = np.cumsum(size + 1) - 1
            text[ends] = 0
            begin = ends - size
            table = self.edges(text)
            word = np.repeat(np.arange(len(part)), size + 1)
            part_of = self.parts(text)
            long = np.bincount(part_of, text != 0) > LONG
            start, length = self.relax(table, part_of, np.where(long[part_of], 0, text))
            if long.any():
                edge = np.searchsorted(part_of, np.flatnonzero(long))
                symbols = [self.relax_long(table, int(i), int(np.searchsorted(part_of, part_of[i], "right"))) for i in edge]
                start, length = np.r_[start, np.concatenate([x for x, _ in symbols])], np.r_[length, np.concatenate([x for _, x in symbols])]
                o = np.argsort(start)
                start, length = start[o], length[o]
            piece = table[start, length]
            joined = piece.tobytes()
            bounds = np.searchsorted(start, np.r_[begin, len(text)])
            cuts = (4 * bounds).tolist()
            self.cache.update(zip(part, (joined[i:j] for i, j in zip(cuts, cuts[1:]))))
            for k in np.unique(word[start[piece < 0]]).tolist():  # words with characters that are in no piece
                s = slice(bounds[k], bounds[k + 1])
                ids = chain.from_iterable([x] if x >= 0 else self.byte_ids[list(part[k][i].encode("utf-8", "replace"))].tolist() for x, i in zip(piece[s].tolist(), (start[s] - begin[k]).tolist()))
                self.cache[part[k]] = np.fromiter(ids, np.int32).tobytes()

    def forget(self) -> None:
        """Lets the known words go."""
        self.cache, self.old = {}, {}

    def parts(self, text: np.ndarray) -> np.ndarray:
        """Numbers of the stretches that join inside only: two neighbours that stand together in no piece part them, as
        do the ends of words."""
        pair = text[:-1].astype(np.int64) << 16 | text[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.cumsum(np.r_[False, self.pairs[at] != pair])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (32-bit) of each text, without begin or end."""
        if len(self.cache) > CACHE:
            self.old, self.cache = self.cache, {}
        cut = [words_of(self.sp.normalize(x)) for x in texts]
        missing = set(chain.from_iterable(cut)) - self.cache.keys()
        again = missing & self.old.keys()
        self.cache.update((w, self.old[w]) for w in again)
        if len(missing) > len(again):
            self.encode_words(list(missing - again))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in cut]

    def decode(self, ids) -> str:
        return self.decode_texts([ids])[0]

    def decode_texts(self, texts: list) -> list[str]:
        """The texts of arrays of ids: pieces joined, byte pieces as UTF-8 (each wrong byte U+FFFD), the first space left
        out. The bytes of all pieces are gathered at once."""
        ids = np.concatenate([np.empty(0, np.int32), *(np.asarray(x, np.int32) for x in texts)]).astype(np.int32)
        size = self.sizes[ids]
        stop = np.cumsum(size)
        at = np.repeat(self.begins[ids] - (stop - size), size) + np.arange(size.sum())
        made = self.flat[at].tobytes()
        bounds = np.r_[0, stop][np.cumsum([0, *map(len, texts)])].tolist()
        return [self.text(made[i:j]) for i, j in zip(bounds, bounds[1:])]

    @staticmethod
    def text(made: bytes) -> str:
        made = made.decode("utf-8", "each_byte")
        return made[1:] if made[:1] == " " else made


def words_of(text: str) -> list[str]:
    """Cuts a normalised text before every space sign that follows another character: no piece reaches across."""
    if not text or SPACE + SPACE in text:
        return _CUT.split(text) if text else []
    first, *rest = text.split(SPACE)
    return [first, *map(SPACE.__add__, rest)] if first else list(map(SPACE.__add__, rest))


def suffix_order(text: np.ndarray, width: int) -> np.ndarray:
    """The suffix array of ranks, sorted by their first ``width`` (4, 8, 16, ...) ranks: by doubling, four ranks in an
    integer first, then the order of one half followed by that of the other."""
    n = len(text)
    t = np.r_[text, np.zeros(3, np.uint16)].astype(np.uint64)
    key = t[:n] << np.uint64(48) | t[1 : n + 1] << np.uint64(32) | t[2 : n + 2] << np.uint64(16) | t[3 : n + 3]
    depth = 4
    while True:
        order = np.argsort(key)
        if depth >= width:
            return order
        ordered = key[order]
        rank = np.zeros(n + depth, np.int64)  # past the end: smaller than any
        rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
        key = rank[:n] * (n + 1) + rank[depth:]
        depth *= 2


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """(id, ids array<int>, n_pieces, round_trip) for every row: the model's ids of the whole text, and whether decoding
    them gives the text again.

    Null and empty texts have no ids and round-trip to the empty text; null ids and repeated rows stay as they are; an
    empty table gives an empty one. A text without spaces is one word, whose tables take some 250 bytes a character while
    it is encoded. Words are known to a task only: a worker goes on to other tasks and stages, and keeps none.
    """
    small_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        try:
            for frame in frames:
                for i in range(0, len(frame), rows):
                    part = frame.iloc[i : i + rows]
                    ids = p.encode(list(part["text"]))
                    yield pd.DataFrame({"id": part["id"], "ids": ids, "round_trip": [x == t for x, t in zip(p.decode_texts(ids), part["text"])]})
        finally:
            p.forget()
            give_back()

    done = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, f"id {kind}, ids array<int>, round_trip boolean")
    return done.select(F.col("id").alias(id_col), "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows with ids; null ids give the empty text."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "text": p.decode_texts([[] if x is None else x for x in frame["ids"]])})

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
