"""Evaluation texts inside training text: size-partitioned MinHash containment search.

A passage is fifteen consecutive words of an item (the whole text of a shorter one). The corpus is read once for any number of items:

1. Filter. The hashes of all item shingles set bits in a table of fixed size; a document is cut to the regions in which a window of
   passage length holds enough shingles with a set bit. Words are cut and hashed by vector operations on code points.
   Regions are written to the shared folder, equal ones are searched once.
2. MinHash. Passages are partitioned by size (`CLASSES`). Every dense window of a region is sketched; shingles of no item are left out,
   they can only blur it. The least Jaccard similarity that a passage with enough common shingles can have with its window
   follows from the sizes of the partition, and with it the number of bands that finds it with probability `SURE`.
3. Verification. Exact shingle containment along neighbouring diagonals of the region and the item, then alignment of the words
   around a common shingle: inserted, broken and a few replaced words are passed over, the covered stretch has to reach the passage size.

Steps 2 and 3 take the items in blocks of about `BLOCK` characters, so what is broadcast at once has a bound; only the regions are
read again for the next block. With very many items the bit table fills up and filters less, but loses nothing.

Shingles have three words, not five: one altered word in fifteen would leave too few of five.

Defined results: null or empty texts of documents or items match nothing; an item is named once per document; repeated rows of
a document give one row, rows of an item with several texts stand for any of them; very long texts are searched whole;
empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.common import materialize

PASSAGE, SHINGLE, MIN_CONTAINED, SURE = 15, 3, 0.4, 0.99
#: Smallest and largest passage of every partition, in words.
CLASSES = ((1, 1), (2, 2), (3, 3), (4, 5), (6, 8), (9, 11), (12, 14), (PASSAGE, PASSAGE))
ROWS, TABLE_BITS, PAD, SALTS, BLOCK = 2, 26, 64, 16, 2_000_000
_WORDS = re.compile(r"[^\W_]+")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MOST = _U(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if isinstance(text, str) else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(29))


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and "belongs to a word" of every code point."""
    every = "".join(map(chr, range(0x110000)))
    inside = np.zeros(0x110000, dtype=bool)
    inside[[m.start() for m in re.finditer(r"[^\W_]", every)]] = True
    lower = np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in every], dtype=np.uint32)
    return lower, inside


_POWERS: list[np.ndarray] = [np.empty(0, _U), np.empty(0, _U)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), base, dtype=_U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


class Words:
    """The words of several texts: hash, place in the joined text, and the text each belongs to."""

    def __init__(self, texts: list[str]):
        self.joined = "\n".join(texts) + "\n"
        lower, inside = _alphabet()
        codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        there = inside[codes]
        edges = np.flatnonzero(np.diff(there, prepend=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        powers, inverse = _powers(len(codes))
        with np.errstate(over="ignore"):
            total = np.concatenate(([_U(0)], np.cumsum(lower[codes] * powers[: len(codes)], dtype=_U)))
            self.h = _mix((total[self.ends] - total[self.starts]) * inverse[self.starts])
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.text = np.searchsorted(begins, self.starts, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))  # first word of every text
        self.lists: dict[int, list[str]] = {}

    def of(self, n: int) -> list[str]:
        """The words of one text, in lower case."""
        if n not in self.lists:
            a, b = self.first[n], self.first[n + 1]
            self.lists[n] = [self.joined[x:y].lower() for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]
        return self.lists[n]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every k consecutive words, and whether they belong to one text."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.empty(0, _U), np.empty(0, bool)
        out = np.zeros(n, dtype=_U)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = _mix(out * _U(_BASE) + self.h[j : n + j])
        return out, self.text[:n] == self.text[k - 1 :]


def class_of(words: int) -> int:
    """Partition of an item of so many words."""
    size = min(PASSAGE, words)
    return next(c for c, (lo, hi) in enumerate(CLASSES) if lo <= size <= hi)


def shingle_size(c: int) -> int:
    return min(SHINGLE, CLASSES[c][0])


def needed(size: int, k: int) -> int:
    """Common shingles that a passage of `size` words needs."""
    return math.ceil(MIN_CONTAINED * (size - k + 1) - 1e-9)


@lru_cache(maxsize=None)
def bands(c: int) -> np.ndarray:
    """Hash parameters of a partition: as many bands of `ROWS` minima as the least similarity of a passage with enough common shingles asks for."""
    k, (lo, hi) = shingle_size(c), CLASSES[c]
    least = min(needed(p, k) / ((hi - k + 1) + (p - k + 1) - needed(p, k)) for p in range(lo, hi + 1))
    n = math.ceil(math.log(1 - SURE) / math.log(1 - least**ROWS)) if least < 1 else 1
    return np.random.default_rng(20240517 + c).integers(1, 2**63, size=(n, ROWS, 2), dtype=np.int64).astype(_U) | _U(1)


def running_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    n, size, cur = len(x) - width + 1, 1, x
    while size * 2 <= width:
        cur = np.minimum(cur[: len(cur) - size], cur[size:])
        size *= 2
    return np.minimum(cur[:n], cur[width - size : width - size + n])


def band_keys(c: int, sh: np.ndarray, there: np.ndarray, windows: np.ndarray) -> Iterator[np.ndarray]:
    """For each band the keys of the given windows; shingles that are not `there` do not count."""
    width = CLASSES[c][1] - shingle_size(c) + 1
    with np.errstate(over="ignore"):
        for n, band in enumerate(bands(c)):
            key = np.full(len(windows), n + 1, dtype=_U)
            for a, b in band:
                key = _mix(key * _U(_BASE) + running_min(np.where(there, _mix(sh * a + b), _MOST), width)[windows])
            yield key


# ---- the table of item shingles ----


def _bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k, word, bits): set bits of the shingles of length k; k = -1 - c notes a partition that occurs."""
    marks: dict[int, list] = defaultdict(list)
    seen: set[int] = set()
    for b in batches:
        w = Words(b["text"].tolist())
        for n, (a, e) in enumerate(zip(w.first, w.first[1:])):
            if e > a:
                c = class_of(e - a)
                seen.add(c)
                marks[shingle_size(c)].append((a, e, w))
        for k, found in marks.items():
            sh, _ = w.shingles(k)
            at = np.unique(np.concatenate([sh[a : e - k + 1] for a, e, _ in found]) >> _U(64 - TABLE_BITS)).astype(np.int64)
            word, start = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(_U(1) << (at & 63).astype(_U), start)
            yield pd.DataFrame({"k": np.full(len(word), k, np.int32), "word": word, "bits": bits.astype(np.int64)})
        marks.clear()
    yield pd.DataFrame({"k": [-1 - c for c in sorted(seen)], "word": 0, "bits": 0}).astype({"k": "int32"})


class Filter:
    """Which partitions have items, and the bit table of their shingles for every shingle length."""

    def __init__(self, rows: pd.DataFrame):
        self.classes = sorted(int(-1 - k) for k in rows["k"].unique() if k < 0)
        self.tables: dict[int, np.ndarray] = {}
        for k in sorted({shingle_size(c) for c in self.classes}):
            self.tables[k] = np.zeros(1 << (TABLE_BITS - 6), dtype=_U)
            own = rows[rows["k"] == k]
            self.tables[k][own["word"].to_numpy()] = own["bits"].to_numpy().astype(_U)

    def hits(self, k: int, sh: np.ndarray) -> np.ndarray:
        at = sh >> _U(64 - TABLE_BITS)
        return (self.tables[k][(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) != 0


def filter_of(items: DataFrame) -> Filter:
    """At most 3 x 2^(TABLE_BITS - 6) rows reach the driver, whatever the number of items."""
    return Filter(items.mapInPandas(_bits, "k int, word bigint, bits bigint").groupBy("k", "word").agg(F.bit_or("bits").alias("bits")).toPandas())


def dense_windows(c: int, hit: np.ndarray) -> np.ndarray:
    """Starts of the windows with as many hits as the smallest passage of the partition needs."""
    k, (lo, hi) = shingle_size(c), CLASSES[c]
    count = np.concatenate(([0], np.cumsum(hit)))
    at = np.arange(len(hit))
    return np.flatnonzero(count[np.minimum(at + hi - k + 1, len(hit))] - count[:-1] >= needed(lo, k))


def regions(texts: list[str], f: Filter) -> Iterator[tuple[int, str]]:
    """(number of the text, region): every stretch in which a passage of an item may lie."""
    w = Words(texts)
    n = len(w.h)
    edge = np.zeros(n + 1, dtype=np.int64)
    for c in f.classes:
        k = shingle_size(c)
        sh, one = w.shingles(k)
        hit = f.hits(k, sh) & one
        dense = dense_windows(c, hit)
        dense = dense[hit[dense]]  # a passage that needs no hit at its start is found from its first hit
        own = w.text[dense]
        np.add.at(edge, np.maximum(dense - PAD, w.first[own]), 1)
        np.add.at(edge, np.minimum(dense + CLASSES[c][1] + PAD, w.first[own + 1]), -1)
    inside = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(inside, prepend=False, append=False) | np.isin(np.arange(n + 1), w.first))
    for a, b in zip(turn, turn[1:]):
        if inside[a]:
            yield int(w.text[a]), w.joined[w.starts[a] : w.ends[b - 1]]


# ---- verification ----


_END, _STOP = ("",) * 6, ("\n",) * 6  # never equal: what stands behind the last word of a document and of an item


def _steps(doc: list[str], item: list[str]) -> tuple[int, int, list[tuple[int, int]]]:
    """(item words covered, of them replaced, places of equal words) from the beginning of both texts on."""
    n = len(item)
    doc, item = [*doc[: 3 * n + 6], *_END], [*item, *_STOP]
    i = j = replaced = 0
    same: list[tuple[int, int]] = []
    while j < n:
        word = item[j]
        if doc[i] == word:
            same.append((i, j))
            i, j = i + 1, j + 1
        elif doc[i] and (doc[i] + doc[i + 1] == word or doc[i + 1] + doc[i] == word):  # a word broken in two, read either way
            i, j = i + 2, j + 1
        elif doc[i + 1] == word and (doc[i + 2] == item[j + 1] or j + 1 == n):  # words put in
            i, j = i + 2, j + 1
        elif doc[i + 2] == word and (doc[i + 3] == item[j + 1] or j + 1 == n):
            i, j = i + 3, j + 1
        elif any(map(str.isdigit, word)):  # another number is another statement: such texts only resemble the item
            break
        elif doc[i + 1] == item[j + 1] and doc[i + 2] == item[j + 2]:  # a word replaced by one or two
            i, j, replaced = i + 2, j + 2, replaced + 1
        elif doc[i + 2] == item[j + 1] and doc[i + 3] == item[j + 2]:
            i, j, replaced = i + 3, j + 2, replaced + 1
        else:
            break
    return j, replaced, same


def carries(doc: list[str], item: list[str], d: int, p: int, size: int, visited: set[tuple[int, int]] | None = None) -> bool:
    """Whether a stretch of `size` item words runs through the pair of places that hold the same word."""
    f, fr, fs = _steps(doc[d + 1 : d + 7 + 3 * (len(item) - p)], item[p + 1 :])
    b, br, bs = _steps(doc[max(0, d - 6 - 3 * p) : d][::-1], item[:p][::-1])
    if visited is not None:
        visited.add((d, p))
        visited.update((d + 1 + i, p + 1 + j) for i, j in fs)
        visited.update((d - 1 - i, p - 1 - j) for i, j in bs)
    span = 1 + f + b
    return span >= size and fr + br <= span // 10


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of every place in the ranges lo..hi."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class Block:
    """Band keys and shingles of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = Words([t for _, t in items])
        sizes = np.diff(self.words.first)
        self.parts: dict[int, tuple] = {}
        for c in sorted({class_of(n) for n in sizes if n}):
            k, (lo, hi) = shingle_size(c), CLASSES[c]
            sh, one = self.words.shingles(k)
            own = self.words.text[: len(sh)]
            one = one & np.isin(own, np.flatnonzero((np.minimum(sizes, PASSAGE) >= lo) & (np.minimum(sizes, PASSAGE) <= hi)))
            at, own = np.flatnonzero(one), own[one]
            flat, there, place = _padded(sh[at], own, hi)
            first = at == self.words.first[own]
            whole = at + hi <= self.words.first[own + 1]  # windows of full width, or the one that begins a short item
            windows = place[whole | first]
            items_of = own[whole | first]
            index = []
            for key in band_keys(c, flat, there, windows):
                run = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (items_of[1:] != items_of[:-1]))))
                order = np.argsort(key[run], kind="stable")
                index.append((key[run][order], items_of[run][order]))
            order = np.argsort(sh[at], kind="stable")
            self.parts[c] = index, sh[at][order], own[order], (at - self.words.first[own])[order]

    def item(self, n: int) -> list[str]:
        return self.words.of(n)


def _padded(sh: np.ndarray, own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of several texts with `width` empty places after each text: values, which places are filled, and where each shingle went."""
    turn = np.concatenate(([0], np.cumsum(own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
    place = np.arange(len(sh)) + turn * width
    flat = np.zeros((place[-1] + 1 if len(place) else 0) + width, dtype=_U)
    there = np.zeros(len(flat), dtype=bool)
    flat[place], there[place] = sh, True
    return flat, there, place


def leaks(texts: list[str], block: Block) -> list[set[int]]:
    """For each text the ids of the items of the block of which it carries the whole or a passage."""
    found: list[set[int]] = [set() for _ in texts]
    w = Words(texts)
    for c, (index, known, item_of, item_at) in block.parts.items():
        k, (lo, hi) = shingle_size(c), CLASSES[c]
        sh, one = w.shingles(k)
        at = np.flatnonzero(one)
        if not len(at):
            continue
        left, right = np.searchsorted(known, sh[at], "left"), np.searchsorted(known, sh[at], "right")
        flat, there, place = _padded(sh[at], w.text[at], hi)
        there[place] = right > left
        windows = dense_windows(c, there)
        if not len(windows):
            continue
        text_at = np.repeat(w.text[at], np.diff(np.append(place, len(flat))))  # which text a place belongs to, padding included
        near = []
        for (keys, owner), key in zip(index, band_keys(c, flat, there, windows)):
            run = np.concatenate(([True], (key[1:] != key[:-1]) | (text_at[windows[1:]] != text_at[windows[:-1]])))
            a, b = np.searchsorted(keys, key[run], "left"), np.searchsorted(keys, key[run], "right")
            which, spot = _spread(a, b)
            near.append(np.unique(text_at[windows[run][which]] * len(block.ids) + owner[spot]))
        candidates = np.unique(np.concatenate(near))
        # places of common shingles of the candidate pairs
        which, spot = _spread(left, right)
        pair = w.text[at][which] * len(block.ids) + item_of[spot]
        keep = np.isin(pair, candidates)
        d, p, pair = (at[which] - w.first[w.text[at][which]])[keep], item_at[spot][keep], pair[keep]
        need = needed(lo, k)
        for shift in (0, 1):  # exact containment: enough common shingles of a passage on neighbouring diagonals
            lane = ((d - p) + (1 << 40) + shift * (hi // 2 + 1)) // (hi + 1)
            order = np.lexsort((d, p, lane, pair))
            op, group = p[order], np.stack((pair[order], lane[order]))
            turn = np.flatnonzero(np.concatenate(([True], (op[1:] != op[:-1]) | (group[:, 1:] != group[:, :-1]).any(axis=0)))) if len(order) else order
            # every distinct place of the item that has `need` - 1 more behind it within a passage
            a, b = turn[: len(turn) - need + 1], turn[need - 1 :]
            full = (group[:, a] == group[:, b]).all(axis=0) & (op[b] - op[a] <= hi - k)
            seeds: dict[tuple[int, int], set[int]] = defaultdict(set)
            for x in a[full].tolist():
                seeds[int(group[0, x]), int(group[1, x])].add(x)
            for (code, _), places in seeds.items():
                n, i = divmod(code, len(block.ids))
                if block.ids[i] in found[n]:
                    continue
                doc, item = w.of(n), block.item(i)
                size = min(PASSAGE, len(item))
                tried: set[tuple[int, int]] = set()  # places that have had their stretch; others on the same diagonal have not
                stop = 0
                for x in sorted(places):
                    # all common places from this one to the end of its passage
                    for y in range(max(x, stop), len(order)):
                        at_d, at_p = int(d[order[y]]), int(p[order[y]])
                        if (group[:, y] != group[:, x]).any() or at_p - op[x] > hi - k:
                            stop = y
                            break
                        if (at_d, at_p) not in tried and carries(doc, item, at_d, at_p, size, tried):
                            found[n].add(block.ids[i])
                            break
                    else:
                        stop = len(order)
                    if block.ids[i] in found[n]:
                        break
    return found


# ---- the search ----


def chunks(ids: list, texts: list[str], most: int = 400_000) -> Iterator[tuple[list, list[str]]]:
    """Runs of texts of together about `most` characters; a longer text is a run of its own."""
    i: list = []
    t: list[str] = []
    size = 0
    for a, b in zip(ids, texts):
        i.append(a)
        t.append(b)
        size += len(b)
        if size >= most:
            yield i, t
            i, t, size = [], [], 0
    if i:
        yield i, t


_BLOCKS: dict[str, Block] = {}


def block_of(key: str, items: list[tuple[int, str]]) -> Block:
    """A block of items, built once per Python worker and used by all of its tasks."""
    if key not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[key] = Block(items)
    return _BLOCKS[key]


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def _salt(*c: str) -> Column:
    return F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int").alias("salt")


def leaked_items(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK) -> DataFrame:
    """(doc_id, item_id): documents and the items of which they carry the whole text or a passage."""
    asked = items.where(F.col(item_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(item_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
    docs = documents.where(F.col(doc_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(filter_of(asked))  # bit tables of fixed size

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, texts in chunks(b["doc_id"].tolist(), b["text"].tolist()):
                yield pd.DataFrame([(ids[n], r) for n, r in regions(texts, shared.value)], columns=["doc_id", "region"])

    places = materialize(docs.mapInPandas(find, "doc_id bigint, region string").withColumn("rkey", F.unhex(F.md5("region"))))
    distinct = materialize(places.select("rkey", "region").dropDuplicates(["rkey"]))

    def search(n: int) -> DataFrame:
        block = documents.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect()])

        def run(batches: Iterator[pd.DataFrame], key: str = uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            items = block_of(key, block.value)
            for b in batches:
                for keys, texts in chunks(b["rkey"].tolist(), b["region"].tolist()):
                    yield pd.DataFrame([(r, i) for r, hit in zip(keys, leaks(texts, items)) for i in hit], columns=["rkey", "item_id"])

        return distinct.mapInPandas(run, "rkey binary, item_id bigint")

    blocks = max(1, math.ceil((asked.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    hits = reduce(DataFrame.unionByName, [search(n) for n in range(blocks)]).select("rkey", "item_id", _every_salt())
    return places.select("doc_id", "rkey", _salt("doc_id")).join(hits, ["rkey", "salt"]).select("doc_id", "item_id").distinct()
