"""Removal of long repeated byte strings with run-length indexes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus, in
the same document or another one.

1. Anchors. Every string of ``LENGTH`` bytes holds ``LENGTH - GRAM + 1`` runs of ``GRAM`` bytes; the one
   with the smallest hash, the rightmost among equals, is its anchor. Equal strings have equal anchors at
   the same place, so only occurrences of one anchor, each with the bytes around it that such strings can
   reach (its context), have to be compared.
2. Anchors that occur once are done, and so are those whose contexts are all equal: every string around
   them repeats. What is left are the different contexts of one anchor, one copy of each.
3. Run-length index. Contexts are collected to blocks of bounded size. Those that agree with no other one
   of their anchor on half of the reach to either side share no such string and go; the others keep what they have in common
   with any other one on either side of the anchor, in which every shared string lies. The suffixes of these are ordered
   (by doubling, only within an anchor), the Burrows-Wheeler transform is kept as runs, and of the suffix
   array only the entries at the ends of runs. From these samples each position gets its neighbours in
   suffix order, whose common length is its matching statistic; ``LENGTH`` or more marks a repeat.
4. An anchor with more contexts than a block holds is dealt to several blocks; strings of such an anchor
   that do not repeat in their block are also looked up by hash in its other blocks.
5. Marks go back to all occurrences of their context, and each text loses the union of its marked spans.

Texts are known by a 64-bit hash, so copies are marked once. Defined cases: null counts as empty; texts
below ``LENGTH`` bytes lose nothing; rows that share an id are documents of their own, so a text that
repeats under one id goes; no rows give no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.tables import release, written
from flowguard.llm.textbytes import Powers, mix, pieces

LENGTH, GRAM = 200, 32
#: Windows of an anchor, and how far its context reaches to either side.
REACH = LENGTH - GRAM
#: Contexts of one anchor that one block takes, and bytes after which a block is closed.
BLOCK_CONTEXTS, BLOCK_BYTES = 2048, 1 << 20

_SALT = np.uint64(0x2545F4914F6CDD1D)


def byte_sums(data: np.ndarray, table: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial over the bytes and the inverse powers, for hashes of any run of bytes."""
    up, down = table.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def run_hash(sums, down, at, size) -> np.ndarray:
    """Hash of the ``size`` bytes from each place of ``at`` on."""
    return mix((sums[at + size] - sums[at]) * down[at] + _SALT)


def anchors(sums: np.ndarray, down: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of the text in bytes ``lo .. hi``, which has ``LENGTH`` or more."""
    at = np.arange(lo, hi - GRAM + 1)
    value = run_hash(sums, down, at, GRAM)
    low, span, width = value, 1, REACH + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span:])
    # In each window the last place that has the smallest value: places by value, the last not after the end.
    is_low = np.zeros(len(value), dtype=bool)
    changes = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    ends = np.r_[changes[1:], len(low)]
    # Most values have one place in the text, which needs no search.
    by = np.argsort(value)
    ordered = np.r_[value[by], np.uint64(0)]
    at = np.searchsorted(ordered[:-1], low[changes])
    alone = (at + 1 == len(value)) | (ordered[at + 1] != ordered[at])
    is_low[by[at[alone]]] = True
    for first, end in zip(changes[~alone].tolist(), ends[~alone].tolist()):
        # Windows first .. end - 1 share their smallest value; its places in reach are the candidates.
        spots = first + np.flatnonzero(value[first: end - 1 + width] == low[first])
        if len(spots) == 1:
            is_low[spots[0]] = True
        else:
            last = np.searchsorted(spots, np.arange(first, end) + width, side="left") - 1
            is_low[spots[np.unique(last)]] = True
    found = np.flatnonzero(is_low)
    return found + lo, value[found]


def contexts(sums, down, places, lo, hi):
    """First byte, end and identity of the context of each anchor of the text in ``lo .. hi``."""
    first, end = np.maximum(places - REACH, lo), np.minimum(places + LENGTH, hi)
    raw = (sums[end] - sums[first]) * down[first]
    return first, end, mix(mix(raw) + (places - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (end - first).astype(np.uint64))


def _anchor_scan(batches):
    table = Powers()
    for batch in batches:
        for a, b, data, offsets in pieces(batch, "text"):
            sums, down = byte_sums(data, table)
            out = []
            for d in range(b - a):
                lo, hi = int(offsets[d]), int(offsets[d + 1])
                if hi - lo >= LENGTH:
                    places, value = anchors(sums, down, lo, hi)
                    out.append((np.full(len(places), d), value, contexts(sums, down, places, lo, hi)[2], places - lo))
            if out:
                d, value, ctx, place = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(ctx.view(np.int64)),
                     batch.column("tid").take(pa.array(a + d)), pa.array(place.astype(np.int32))], names=["anchor", "ctx", "tid", "place"])


def _context_scan(batches):
    """Bytes of the wanted contexts of each text, once for each text of the batch."""
    table, codec = Powers(), pa.Codec("zstd")
    for batch in batches:
        for text, wanted in zip(batch.column("text"), batch.column("wanted")):
            raw = text.as_py()
            data = np.frombuffer(codec.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), dtype=np.uint8)
            sums, down = byte_sums(data, table)
            places, value = anchors(sums, down, 0, len(data))
            first, end, ctx = contexts(sums, down, places, 0, len(data))
            asked = wanted.values.to_numpy(zero_copy_only=False).view(np.uint64)
            ctx, at = np.unique(ctx, return_index=True)
            at = at[np.isin(ctx, asked)]
            ctx = contexts(sums, down, places[at], 0, len(data))[2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[at].view(np.int64)), pa.array(ctx.view(np.int64)), pa.array((places[at] - first[at]).astype(np.int32)),
                 pa.array([data[f:e].tobytes() for f, e in zip(first[at].tolist(), end[at].tolist())], pa.binary())],
                names=["anchor", "ctx", "before", "bytes"])


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some strings with the suffix array at its run ends.

    Strings are ordered group by group; suffixes never match across groups or beyond a string's end.
    """

    def __init__(self, strings: list[bytes], groups: np.ndarray):
        sizes = np.array([len(s) for s in strings])
        self.text = np.frombuffer(b"".join(s + b"\0" for s in strings), dtype=np.uint8)
        n = len(self.text)
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        self.owner = np.repeat(np.arange(len(strings)), sizes + 1)
        self.group = groups[self.owner]
        end = np.zeros(n, dtype=bool)
        end[self.first + sizes] = True
        # Symbols: bytes from 1 on; each string ends with a symbol of its own, smaller than any byte.
        order, place = self._suffix_order(end)
        # The byte before each suffix; strings start with their own number, which no other suffix has.
        starts = np.zeros(n, dtype=bool)
        starts[self.first] = True
        before = np.where(starts[order], -1 - self.owner[order], self.text[order - 1].astype(np.int64))
        in_group = self.group[order]
        head = np.r_[True, (before[1:] != before[:-1]) | (in_group[1:] != in_group[:-1])]
        self.runs = int(head.sum())
        rows = np.flatnonzero(head)
        self.up_key, self.up_value = self._samples(order, place, rows, -1)
        tails = np.flatnonzero(np.r_[head[1:], True])
        self.down_key, self.down_value = self._samples(order, place, tails, 1)

    def _suffix_order(self, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, and the place of each in it.

        Symbols known to be in order are tripled in each round, or doubled where three places do not fit one key.
        """
        n, strings = len(self.text), len(self.first)
        groups, symbols = int(self.group.max(initial=0)) + 1, 4
        while groups * 257 ** (symbols + 1) < 1 << 63:
            symbols += 1
        value = np.r_[np.where(end, 0, self.text.astype(np.int64) + 1), np.zeros(symbols, np.int64)]
        # The group and some symbols first; unique ends make the ranks of all ends different.
        key, alive = self.group.astype(np.int64), np.ones(n, dtype=bool)
        for j in range(symbols):
            key = key * 257 + np.where(alive, value[j: j + n], 0)
            alive &= value[j: j + n] != 0
        # Symbols up to the string's end; a suffix that is over is told from its like by its string.
        last = np.repeat(self.first + np.bincount(self.owner), np.bincount(self.owner)) - 1 - np.arange(n)
        base = n + strings + 1
        times = 3 if base ** 3 < 1 << 63 else 2
        rank, active, step = np.zeros(n, dtype=np.int64), np.arange(n), symbols
        own = np.zeros(n, dtype=np.int64)
        while True:
            by = np.argsort(key)
            active, own, key = active[by], own[by], key[by]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[start, len(key)])
            # The rank of a suffix is its old one plus its place in the old group.
            old = own[start]
            group_start = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], start, 0))
            own = np.repeat(old + start - group_start, count)
            rank[active] = own
            more = np.repeat(count > 1, count)
            active, own = active[more], own[more]
            if not len(active):
                order = np.empty(n, dtype=np.int64)
                order[rank] = np.arange(n)
                return order, rank
            left, over = last[active], self.owner[active]
            key = own
            for j in range(1, times):
                key = key * base + np.where(left < j * step, over, rank[np.minimum(active + j * step, n - 1)] + strings)
            step *= times

    def _samples(self, order, place, rows, side):
        """By text position before the suffix at each run end: the suffix above or below it in order."""
        n = len(order)
        key = np.sort((order[rows] - 1) % n)
        row = place[key] + side
        return key, np.where((row >= 0) & (row < n), order[np.clip(row, 0, n - 1)], -1)

    def neighbours(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes above and below each suffix in order, from the samples alone; -1 where there is none."""
        out = []
        for key, value in ((self.up_key, self.up_value), (self.down_key, self.down_value)):
            i = np.minimum(np.searchsorted(key, at), len(key) - 1)
            near = value[i] - (key[i] - at)
            out.append(np.where((value[i] < 0) | (key[i] < at), -1, near))
        return out[0], out[1]

    def repeats(self, length: int, table: Powers) -> np.ndarray:
        """Whether the ``length`` bytes from each position on lie in one string and occur twice in its group."""
        n = len(self.text)
        sums, down = byte_sums(self.text, table)
        last = (self.first + np.bincount(self.owner) - 1)[self.owner]
        fits = np.arange(n) + length <= last
        at = np.flatnonzero(fits)
        out = np.zeros(n, dtype=bool)
        if len(at):
            own = run_hash(sums, down, at, length)
            for near in self.neighbours(at):
                ok = (near >= 0) & (near < n)
                ok &= fits[np.where(ok, near, 0)]
                ok &= self.group[np.where(ok, near, 0)] == self.group[at]
                same = run_hash(sums, down, np.where(ok, near, at), length) == own
                out[at] |= ok & same
        return out


def own_part(data: bytes, before: int) -> bytes:
    """The context up to where its strings would also hold a later copy of the anchor, and be that one's."""
    again = data.find(data[before: before + GRAM], before + 1)
    return data if again < 0 else data[: again + GRAM - 1]


def agreement(rows: list[tuple], sides: list[bytes], at: np.ndarray, sums, down, back: bool) -> np.ndarray:
    """How many bytes from ``at`` on (or back) each context has in common with any other one of its anchor, at most.

    ``sides`` are these bytes, in the order of reading. In their order the most alike ones are neighbours.
    """
    order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1], sides[i])), dtype=np.int64)
    group = np.array([r[:2] for r in rows], dtype=np.int64).reshape(-1, 2)[order]
    near = np.flatnonzero((group[1:] == group[:-1]).all(axis=1))
    x, y = order[near], order[near + 1]
    size = np.array([len(s) for s in sides])
    most, same, step = np.minimum(size[x], size[y]), np.zeros(len(x), dtype=np.int64), 1 << (LENGTH + REACH).bit_length()
    while step:
        size_now = same + step
        on = np.flatnonzero(size_now <= most)
        n, p, q = size_now[on], at[x[on]], at[y[on]]
        if back:
            p, q = p - n, q - n
        alike = (sums[p + n] - sums[p]) * down[p] == (sums[q + n] - sums[q]) * down[q]
        same[on[alike]] += step
        step //= 2
    out = np.zeros(len(rows), dtype=np.int64)
    np.maximum.at(out, x, same)
    np.maximum.at(out, y, same)
    return out


def shared_parts(rows: list[tuple], table: Powers) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of what each context's own part can share with another context of its anchor.

    Equal strings of own parts have their anchor at the same place, so a shared string reaches no further to
    either side than the context agrees with some other one. Below ``LENGTH`` bytes there is none, and end is first.
    Contexts of split anchors stay whole.
    """
    sizes, before = np.array([len(r[5]) for r in rows]), np.array([r[4] for r in rows])
    sums, down = byte_sums(np.frombuffer(b"".join(r[5] for r in rows), np.uint8), table)
    at = np.cumsum(sizes) - sizes + before
    left = agreement(rows, [r[5][:r[4]][::-1] for r in rows], at, sums, down, True)
    right = agreement(rows, [r[5][r[4] + GRAM:] for r in rows], at + GRAM, sums, down, False)
    first, end = before - left, before + GRAM + right
    end = np.where(end - first < LENGTH, first, end)
    whole = np.array([r[2] > 1 for r in rows])
    return np.where(whole, 0, first), np.where(whole, sizes, end)


def spans(flags: np.ndarray, owner: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and covered bytes, counted from its anchor, of the strings that start at ``flags``."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    cut = np.flatnonzero((np.diff(at) > LENGTH) | (owner[at[1:]] != owner[at[:-1]]))
    first, last = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]
    of = owner[first]
    return of, first - anchor[of], last + LENGTH - anchor[of]


def hopeful(rows: list[tuple], table: Powers) -> np.ndarray:
    """Contexts that may share a string with another one of their anchor in the block.

    A string of ``LENGTH`` bytes around an anchor takes in at least ``REACH / 2`` bytes before it or as
    many behind it, so two contexts that share one agree on either. Contexts of split anchors all stay.
    """
    half, n = REACH // 2, len(rows)
    sizes = np.array([len(r[5]) for r in rows])
    sums, down = byte_sums(np.frombuffer(b"".join(r[5] for r in rows), np.uint8), table)
    start = np.cumsum(sizes) - sizes
    before = np.array([r[4] for r in rows])
    anchor = np.array([r[0] for r in rows], dtype=np.int64)
    out = np.array([r[2] > 1 for r in rows])
    for fits, at in ((before >= half, start + before - half), (before + GRAM + half <= sizes, start + before + GRAM)):
        on = np.flatnonzero(fits)
        if len(on):
            key = run_hash(sums, down, at[on], half)
            by = np.lexsort((key, anchor[on]))
            alike = (key[by][1:] == key[by][:-1]) & (anchor[on][by][1:] == anchor[on][by][:-1])
            out[on[by[np.r_[False, alike] | np.r_[alike, False]]]] = True
    return out


MARKS = "anchor long, ctx long, a int, b int, hash long, salt long"


def _block_scan(batches):
    """Marked spans of the contexts of each block; of split anchors also the hashes of unmarked strings."""
    table = Powers()

    def close(rows):
        keep = hopeful(rows, table)
        rows = [r for r, k in zip(rows, keep.tolist()) if k]
        if not rows:
            return None
        rows = [(*r[:5], own_part(r[5], r[4])) for r in rows]
        first, end = shared_parts(rows, table)
        rows = [(*r[:4], r[4] - f, r[5][f:e]) for r, f, e in zip(rows, first.tolist(), end.tolist()) if f < e]
        if not rows:
            return None
        groups = np.cumsum(np.r_[0, [x[:2] != y[:2] for x, y in zip(rows, rows[1:])]])
        index = RunLengthIndex([r[5] for r in rows], groups)
        flags = index.repeats(LENGTH, table)
        of, a, b = spans(flags, index.owner, index.first + np.array([r[4] for r in rows]))
        cols, told = [[rows[i][0] for i in of.tolist()], [rows[i][3] for i in of.tolist()], a.tolist(), b.tolist(), [None] * len(of), [None] * len(of)], set()
        for i, (anchor, salt, parts, ctx, before, data) in enumerate(rows):
            if parts > 1:
                own = flags[index.first[i]: index.first[i] + len(data)]
                sums, down = byte_sums(np.frombuffer(data, np.uint8), table)
                at = np.arange(max(0, len(data) - LENGTH + 1))
                for a, h in zip(at.tolist(), run_hash(sums, down, at, LENGTH).view(np.int64).tolist()):
                    # A string that repeats here is marked already; other blocks need to know it once.
                    if not own[a]:
                        row = (anchor, ctx, a - before, a - before + LENGTH, h, salt)
                    elif (anchor, salt, h) not in told:
                        told.add((anchor, salt, h))
                        row = (anchor, None, None, None, h, salt)
                    else:
                        continue
                    for c, v in zip(cols, row):
                        c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["anchor", "ctx", "a", "b", "hash", "salt"])

    held, size, seen = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "salt", "parts", "ctx", "before", "bytes"))):
            if held and row[:2] != held[-1][:2] and size >= BLOCK_BYTES:
                if (marks := close(held)) is not None:
                    yield marks
                held, size = [], 0
            # Copies of a text bring a context more than once; equal ones are neighbours.
            if row[:4] != seen:
                held.append(row)
                size += len(row[5])
            seen = row[:4]
    if held and (marks := close(held)) is not None:
        yield marks


def _pack(batches):
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        packed = [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in (x.as_buffer() if x.is_valid else pa.py_buffer(b"") for x in texts)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(packed, pa.binary())],
                                         names=[*(c for c in batch.schema.names if c != "text"), "text"])


def _cut_scan(batches):
    codec = pa.Codec("zstd")
    for batch in batches:
        size, removed, count, digest, kept_text = [], [], [], [], []
        for raw, found in zip(batch.column("text"), batch.column("found")):
            raw = raw.as_py()
            data = codec.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)
            runs = []
            for a, b in sorted((max(0, x["a"]), min(len(data), x["b"])) for x in (found.as_py() or ())):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            kept = b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)]))
            size.append(len(data))
            removed.append(len(data) - len(kept))
            count.append(len(runs))
            digest.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_contexts: int = BLOCK_CONTEXTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row; ``kept`` are the bytes left."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tid", F.xxhash64("text"))
    found = written(given.select("tid", "text").mapInArrow(_anchor_scan, "anchor long, ctx long, tid long, place int"), "repeat-anchors")
    many = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("ctx") == F.max("ctx")).alias("alike"))
                   .filter("n > 1").select("anchor", "alike"), "repeat-many")
    release(spark)
    members = written(found.join(many, "anchor").groupBy("anchor", "ctx", "tid", "place", "alike").agg(F.count(F.lit(1)).alias("n")), "repeat-members")
    release(spark)
    unlike = written(members.filter("not alike").groupBy("anchor", "ctx").agg(F.sum("n").alias("n"), F.min("tid").alias("tid")), "repeat-unlike")
    parts = written(unlike.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / block_contexts).cast("long").alias("parts")), "repeat-parts")
    wanted = written(unlike.groupBy("tid").agg(F.collect_list("ctx").alias("wanted")), "repeat-wanted")
    # One document for each wanted text is enough.
    packed = given.select("tid", "text").join(wanted.select("tid"), "tid", "left_semi").mapInArrow(_pack, "tid long, text binary")
    bytes_of = packed.join(wanted, "tid").mapInArrow(_context_scan, "anchor long, ctx long, before int, bytes binary")
    dealt = bytes_of.join(parts, "anchor").withColumn("salt", F.pmod(F.col("ctx"), F.col("parts")))
    marks = written(dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "ctx").mapInArrow(_block_scan, MARKS), "repeat-marks")
    release(spark)
    hashed = marks.filter("hash is not null")
    across = hashed.groupBy("anchor", "hash").agg(F.min("salt").alias("_x"), F.max("salt").alias("_y")).filter("_x <> _y").select("anchor", "hash")
    marked = marks.filter("hash is null").select("anchor", "ctx", "a", "b").unionByName(
        hashed.filter("ctx is not null").join(written(across, "repeat-across"), ["anchor", "hash"]).select("anchor", "ctx", "a", "b")).unionByName(
        unlike.filter("n > 1").select("anchor", "ctx", F.lit(-REACH).alias("a"), F.lit(LENGTH).alias("b")))
    here = lambda df: df.select("tid", (F.col("place") + F.col("a")).alias("a"), (F.col("place") + F.col("b")).alias("b"))
    cuts = here(members.filter("alike").withColumn("a", F.lit(-REACH)).withColumn("b", F.lit(LENGTH))).unionByName(
        here(members.filter("not alike").join(written(marked, "repeat-marked"), ["anchor", "ctx"])))
    # The spans of one text: their number is bounded by its own length.
    by_text = written(cuts.distinct().groupBy("tid").agg(F.collect_list(F.struct("a", "b")).alias("found")), "repeat-spans")
    release(spark)
    texts = given.mapInArrow(_pack, "doc_id long, tid long, text binary")
    return texts.join(by_text, "tid", "left").select("doc_id", "text", "found").mapInArrow(
        _cut_scan, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
