"""Token ids in rows of one length by best-fit-decreasing packing.

Every task reads its documents in chunks of about ``chunk_tokens`` tokens and packs each chunk on its
own, so memory is bounded and nothing is shuffled; a chunk holds thousands of documents, which is where
best fit leaves next to no gaps. A document longer than a row is cut into full rows and a rest. Rests
are sorted by length, the longest first, and each goes to the open row with the least room that still
holds it; a segment tree over the room left finds it in ``log2(row length)`` steps.

A row holds ``input_ids`` (little-endian unsigned integers of ``id_bytes`` bytes, filled up with
``pad_id`` to the row length), ``cu_seqlens`` (ends of its segments, from 0), ``position_ids`` (two
bytes each, restarting at 0 with each segment, 0 on the fill), and for each segment its ``doc_ids``,
``doc_rows`` (number of the document, unique in the table) and ``doc_starts`` (token offset in the document).

Defined cases: null and empty texts are segments of no tokens; null ids stay null; rows that share an
id are different documents with different ``doc_rows``; no rows give no rows. Extra columns are not
read. Which documents share a row depends on the input's splits.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_TOKENS = 2048
CHUNK_TOKENS = 1 << 22
PAD_ID = 50256
#: Words after which the encoder of a worker forgets those that it has not met since it last did.
CACHE_WORDS = 200_000

SCHEMA = ("pack_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, "
          "doc_ids array<long>, doc_rows array<long>, doc_starts array<long>")


def default_ranks() -> str:
    """File of the byte-level vocabulary that is installed with the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class WordCachedEncoder:
    """Byte-level BPE ids of whole texts as packed integers.

    The split pattern starts a new piece at every single space between two other characters, so the
    ids of a text are those of its first word and of each further word with its space. Texts with
    other blanks next to a space are encoded as one. The words of a text that are not known yet are
    encoded in one go and cut at their spaces. Pickled, it is its arguments: broadcast, each worker builds it once.
    """

    def __init__(self, ranks_path: str, dtype: str = "<u2"):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.made_of = ranks_path, dtype
        self.dtype, self.known, self.before = np.dtype(dtype), {}, {}
        self.sizes = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        self.sizes[list(ranks.values())] = [len(token) for token in ranks]

    def __reduce__(self):
        return type(self), self.made_of

    def _numbers(self, text: str) -> np.ndarray:
        ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        if ids.max(initial=0) > np.iinfo(self.dtype).max:
            raise OverflowError("ids do not fit the bytes of an id")
        return ids

    def _ids(self, text: str) -> bytes:
        return self._numbers(text).astype(self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        text = " " + " ".join(words)
        ids, width = self._numbers(text), self.dtype.itemsize
        raw, ends = ids.astype(self.dtype).tobytes(), np.cumsum(self.sizes[ids])
        # Words hold no space, so each begins at one.
        spaces = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)
        cuts = [*(np.searchsorted(ends, spaces, side="right") * width).tolist(), len(raw)]
        self.known.update((w, raw[a:b]) for w, a, b in zip(words, cuts, cuts[1:]))

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        known = self.known
        if not first or first[-1].isspace():
            return self._ids(text)
        new = set(rest).difference(known)
        if new:
            known.update((w, self.before[w]) for w in new if w in self.before)
            new = list(new.difference(known))
            if any(not w or w[0].isspace() or w[-1].isspace() for w in new):
                return self._ids(text)
            if new:
                self._learn(new)
        parts = list(map(known.__getitem__, rest))
        if len(known) > CACHE_WORDS:
            self.known, self.before = {}, known
        return self._ids(first) + b"".join(parts)


class RoomTree:
    """Open rows by the room they have left; finds the least room of at least ``n``."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """Remove and return ``(room, row)`` of the best fit, the row opened last among equals."""
        count, at = self.count, n + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: Iterable[int], row_tokens: int) -> list[list[int]]:
    """Rows as lists of item numbers; every length is at most ``row_tokens``."""
    lengths = list(lengths)
    tree, rows = RoomTree(row_tokens), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            room, row = row_tokens, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        tree.add(room - lengths[i], row)
    return rows


def _packed(pieces, row_tokens, id_bytes, pad):
    """Rows of one chunk; a piece is ``(doc_id, doc_row, start, ids)``."""
    for row in best_fit_decreasing([len(p[3]) // id_bytes for p in pieces], row_tokens):
        items = [pieces[i] for i in row]
        sizes = np.array([len(p[3]) // id_bytes for p in items])
        ends = np.cumsum(sizes)
        positions = np.zeros(row_tokens, dtype="<u2")
        positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        ids = b"".join(p[3] for p in items)
        yield (int(ends[-1]), ids + pad * (row_tokens - int(ends[-1])), positions.tobytes(), [0, *ends.tolist()],
               [p[0] for p in items], [p[1] for p in items], [p[2] for p in items])


def pack_documents(
    docs: DataFrame, ranks_path: str | None = None, row_tokens: int = ROW_TOKENS, chunk_tokens: int = CHUNK_TOKENS,
    pad_id: int = PAD_ID, id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Packed rows of all documents, see the head of this module."""
    if row_tokens > 65536:
        raise ValueError("positions are written with two bytes")
    ranks_path = ranks_path or default_ranks()
    dtype, pad = f"<u{id_bytes}", int(pad_id).to_bytes(id_bytes, "little")
    shared = docs.sparkSession.sparkContext.broadcast(WordCachedEncoder(ranks_path, dtype))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, wide = shared.value, row_tokens * id_bytes
        number = made = TaskContext.get().partitionId() << 40
        held, pieces = 0, []

        def flush():
            nonlocal made
            rows = list(_packed(pieces, row_tokens, id_bytes, pad))
            for i in range(0, len(rows), 512):
                part = rows[i: i + 512]
                cols = [range(made, made + len(part)), *zip(*part)]
                made += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
            pieces.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids, doc = encoder.encode(text.as_py() or ""), doc_id.as_py()
                for at in range(0, max(len(ids), 1), wide):
                    pieces.append((doc, number, at // id_bytes, ids[at: at + wide]))
                number += 1
                held += len(ids) // id_bytes
                if held >= chunk_tokens:
                    yield from flush()
                    held = 0
        if pieces:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
