"""Benchmark decontamination: SimHash of windows of two lengths, index search, exact check.

An item of ``n`` words belongs to a size class, a window length a little below ``n``, and gives the
fingerprints of all its windows of that length. Documents are scanned with windows of each class at a
stride no larger than the number of windows that any item of the class has, so one window of a copied
item always coincides with a window of the item. Fingerprints are 64 signed sums over the windows'
shingles, weighted by their length in bytes. The index holds each fingerprint under four 16-bit blocks
and their one-bit neighbours: two fingerprints that differ in at most seven bits agree in one block up
to one bit, so every pair within ``RADIUS`` is found.

Edits inside an item move its fingerprint further than that, so items are also found by the shortest
windows: one shingle, whose fingerprint is its hash, at every word. Of each item the shingles that
fewest items hold are indexed until they weigh more than a fifth of it. A passage without any of them
shares less than 0.8 of the item's weight, so every pair of the stated similarity is a candidate.

Each candidate is checked exactly: the item against the windows of its own length at every word around
the hit by the weighted Jaccard similarity of their five-word shingles,
``sum w * min(count) >= 0.8 * sum w * max(count)``. Windows are cut at the ends of the document.

Items are taken in blocks of bounded size, each searched against all documents.

Defined cases: null or blank items match nothing; items of fewer than five words are one shingle, found
where the same words follow each other; null texts have no windows; rows that share an id are
searched each by itself; no items or no documents give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.textbytes import Powers, Words, mix, pieces, place_factors

SHINGLE = 5
SIMILARITY_PERCENT = 80
#: Bits in which two fingerprints may differ; four blocks of 16 bits with one free bit each cover seven.
RADIUS = 7
#: Growth of the window lengths from class to class.
CLASS_STEP = 1.2
#: Candidate positions that are checked at once.
HITS = 1 << 21
#: Benchmark text that is searched in one pass.
BLOCK_BYTES = 4 << 20

_NEIGHBOURS = np.array([0, *(1 << b for b in range(16))], dtype=np.uint64)


def fingerprints(hashes: np.ndarray, weights: np.ndarray, spans: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each ``(length, stride)`` the SimHash of ``hashes[p: p + length]`` at ``p = 0, stride, ...``."""
    out = [np.zeros(max(0, -(-(len(hashes) - n + 1) // s)), dtype=np.uint64) for n, s in spans]
    sums = np.zeros(len(hashes) + 1, dtype=np.int32)
    double = (weights * 2).astype(np.int32)
    for bit in range(64):
        # A set bit counts +w, a clear one -w.
        np.cumsum((((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int32) * double) - weights, out=sums[1:])
        for fp, (n, s) in zip(out, spans):
            if len(fp):
                fp |= (sums[n::s] > sums[: len(sums) - n: s]).astype(np.uint64) << np.uint64(bit)
    return out


class BlockIndex:
    """Fingerprints under their four blocks and the blocks' one-bit neighbours."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.pointers, self.entries = prints, [], []
        for b in range(4):
            keys = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF))[:, None] ^ _NEIGHBOURS[None, :]
            who = np.repeat(np.arange(len(prints)), len(_NEIGHBOURS))
            order = np.argsort(keys.ravel(), kind="stable")
            self.entries.append(who[order])
            self.pointers.append(np.concatenate([[0], np.cumsum(np.bincount(keys.ravel().astype(np.int64), minlength=65536))]))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ``(query, print)`` numbers that differ in at most ``RADIUS`` bits."""
        found = []
        for b in range(4):
            key = ((queries >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            first, n = self.pointers[b][key], np.diff(self.pointers[b])[key]
            some = np.flatnonzero(n)
            n, first = n[some], first[some]
            q = np.repeat(some, n)
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(q))
            e = self.entries[b][at]
            near = np.bitwise_count(queries[q] ^ self.prints[e]) <= RADIUS
            found.append(q[near] * len(self.prints) + e[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(len(self.prints), 1), pairs % max(len(self.prints), 1)


class Item:
    """One benchmark text of ``n`` words: its shingles of ``k`` words, each with its count and weight."""

    def __init__(self, name, n: int, k: int, hashes: np.ndarray, weights: np.ndarray):
        self.name, self.n, self.k, self.spans = name, n, k, n - k + 1
        self.keys, first, self.counts = np.unique(hashes, return_index=True, return_counts=True)
        self.weights = weights[first].astype(np.int64) * self.counts
        self.whole = int(self.weights.sum())

    def best(self, hashes: np.ndarray, weights: np.ndarray, begin: int, end: int, low: int, high: int):
        """Over the windows that start at ``low .. high`` in the shingles ``begin .. end - 1`` of a document:
        negative similarity, start, intersection and union of the best one, or None below the threshold."""
        m = self.spans
        lo, hi = max(begin, low), min(end, high + m)
        h, w = hashes[lo:hi], weights[lo:hi].astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        pos = np.flatnonzero(self.keys[at] == h)
        if 100 * int(w[pos].sum()) < SIMILARITY_PERCENT * self.whole:
            return None
        # An occurrence counts in the windows that hold it and, before it, fewer equal ones than the item has.
        order = np.argsort(at[pos], kind="stable")
        pos, key = pos[order], at[pos][order]
        back = np.arange(len(pos)) - self.counts[key]
        full = (back >= 0) & (key[back] == key)
        opens = np.maximum(pos - m, np.where(full, pos[back], -m)) + 1
        size, shift = high - low + 1, lo - low
        step = (np.bincount(np.clip(opens + shift, 0, size), w[pos], size + 1)
                - np.bincount(np.clip(pos + 1 + shift, 0, size), w[pos], size + 1))
        part = np.cumsum(step)[:size].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(w)])
        start = np.arange(low, high + 1) - lo
        whole = self.whole + sums[np.clip(start + m, 0, len(w))] - sums[np.clip(start, 0, len(w))] - part
        fit = (100 * part >= SIMILARITY_PERCENT * whole) & (part > 0)
        if not fit.any():
            return None
        j = int(np.argmax(np.where(fit, part / whole, 0.0)))
        return -part[j] / whole[j], low + j, int(part[j]), int(whole[j])


class ShingleIndex:
    """For each item so many of its shingles that a passage without them is below the threshold."""

    def __init__(self, items: list[tuple[int, Item]]):
        every, held = np.unique(np.concatenate([x.keys for _, x in items]), return_counts=True)
        keys, owners = [], []
        for i, x in items:
            order = np.lexsort((x.keys, -x.weights, held[np.searchsorted(every, x.keys)]))
            sums = np.cumsum(x.weights[order])
            n = int(np.searchsorted(100 * sums, (100 - SIMILARITY_PERCENT) * x.whole, side="right")) + 1
            keys.append(x.keys[order[:n]])
            owners.append(np.full(len(keys[-1]), i))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.owners = owners[order]
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.door = np.zeros(1 << 20, dtype=bool)
        self.door[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def search(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Position and item of every indexed shingle among ``hashes``, about ``HITS`` at once."""
        some = np.flatnonzero(self.door[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
        same = self.keys[at] == hashes[some]
        pos, first, n = some[same], self.first[at[same]], self.count[at[same]]
        part = np.cumsum(n) // HITS
        for c in np.unique(part):
            p, f, k = pos[part == c], first[part == c], n[part == c]
            q = np.repeat(p, k)
            yield q, self.owners[np.repeat(f - (np.cumsum(k) - k), k) + np.arange(len(q))]


class ItemIndex:
    """Items of one block by size class, ready to be searched."""

    def __init__(self, items: list[tuple[object, str | None]]):
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.string())], names=["text"])
        self.items, whole, table, classes = [], [], Powers(), {}
        for a, _, data, offsets in pieces(batch, "text"):
            words = Words(data, offsets, table)
            for d in range(len(offsets) - 1):
                lo, hi = words.first[d], words.first[d + 1]
                n = int(hi - lo)
                if not n:
                    continue
                k = min(SHINGLE, n)
                hashes, weights = shingled(words.hash[lo:hi], words.end[lo:hi] - words.start[lo:hi], k)
                self.items.append(Item(items[a + d][0], n, k, hashes, weights))
                whole.append((hashes, weights))
                window = n if n < SHINGLE else self._window(n)
                classes.setdefault((k, window), []).append(len(self.items) - 1)
        self.classes = []
        for (k, window), members in sorted(classes.items()):
            stride = min(self.items[i].n for i in members) - window + 1
            prints, owner = [], []
            for i in members:
                fp = fingerprints(*whole[i], [(window - k + 1, 1)])[0]
                prints.append(fp)
                owner += [i] * len(fp)
            self.classes.append((k, window, stride, BlockIndex(np.concatenate(prints)), np.array(owner)))
        self.spans = np.array([x.spans for x in self.items], dtype=np.int64)
        self.shingles = {k: ShingleIndex([(i, x) for i, x in enumerate(self.items) if x.k == k]) for k in {x.k for x in self.items}}

    @staticmethod
    def _window(n: int) -> int:
        """The longest class length that leaves an item a tenth of its words in spare windows."""
        best, grid = SHINGLE, float(SHINGLE)
        while int(grid) <= n - -(-n // 10):
            best, grid = int(grid), max(grid * CLASS_STEP, grid + 1)
        return best

    def matches(self, words: Words, n_docs: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Per (document, item) the best window: document, item number, first word, intersection, union."""
        length = words.end - words.start
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for k in sorted(self.shingles):
            hashes, weights = shingled(words.hash, length, k)
            if not len(hashes):
                continue
            for d, i, low, high in self._candidates(words, hashes, weights, k):
                new = self.items[i].best(hashes, weights, int(words.first[d]), int(words.first[d + 1]) - k + 1, low, high)
                if new:
                    best[d, i] = min(best.get((d, i), new), new)
        for (d, i), (_, start, part, whole) in sorted(best.items()):
            yield d, i, max(0, start - int(words.first[d])), part, whole

    def _candidates(self, words: Words, hashes, weights, k: int) -> Iterator[tuple[int, int, int, int]]:
        """Document, item and the first and last start of the windows around its hits."""
        own = [c for c in self.classes if c[0] == k]
        found = []
        for (_, window, stride, index, owner), fp in zip(own, fingerprints(hashes, weights, [(c[1] - k + 1, c[2]) for c in own])):
            q, e = index.search(fp)
            found.append((q * stride, owner[e], window))
        for pos, item, window in [*found, *((p, i, k) for p, i in self.shingles[k].search(hashes))]:
            doc = np.searchsorted(words.first, pos, side="right") - 1
            inside = pos + window <= words.first[doc + 1]
            pos, item, doc = pos[inside], item[inside], doc[inside]
            if not len(pos):
                continue
            order = np.lexsort((pos, item, doc))
            pos, item, doc = pos[order], item[order], doc[order]
            spans = self.spans[item]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(pos) >= spans[1:])]
            a, z = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(pos)] - 1
            yield from zip(doc[a].tolist(), item[a].tolist(), (pos[a] - spans[a] + 1).tolist(), pos[z].tolist())


def shingled(hashes: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``k`` words and their weights: the bytes of the words, at most 1023 each in all."""
    m = max(0, len(hashes) - k + 1)
    acc, weight = np.full(m, np.uint64(k), dtype=np.uint64), np.zeros(m, dtype=np.int64)
    for j in range(k):
        acc += hashes[j: j + m] * place_factors[j]
        weight += lengths[j: j + m]
    return mix(acc), np.minimum(weight, 1023).astype(np.int32)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The items in order of their id, in blocks of about ``block_bytes``."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).orderBy("i", "t")
    for row in rows.toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t or "") + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


LINK_SCHEMA = "doc_id long, item_id {kind}, similarity double, start_word long, n_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id",
               item_text_col="text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it holds, with the best window and its similarity."""
    kind = dict(benchmark.dtypes)[item_col]
    schema = LINK_SCHEMA.format(kind=kind)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        part = given.mapInArrow(_link_scan(docs.sparkSession.sparkContext.broadcast(block)), schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _link_scan(block):
    def run(batches):
        index, table = ItemIndex(block.value), Powers()
        for batch in batches:
            ids = batch.column("doc_id")
            rows = []
            for a, _, data, offsets in pieces(batch, "text"):
                words = Words(data, offsets, table)
                for d, i, start, part, whole in index.matches(words, len(offsets) - 1):
                    item = index.items[i]
                    rows.append((ids[a + d].as_py(), item.name, part / whole, start, item.n))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.float64()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    out = docs
    for block in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        out = out.mapInArrow(_keep_scan(docs.sparkSession.sparkContext.broadcast(block), text_col), docs.schema)
    return out


def _keep_scan(block, text_col):
    def run(batches):
        index, table = ItemIndex(block.value), Powers()
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for a, _, data, offsets in pieces(batch, text_col):
                for d, *_ in index.matches(Words(data, offsets, table), len(offsets) - 1):
                    keep[a + d] = False
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return run
