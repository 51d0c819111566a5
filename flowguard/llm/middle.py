"""Fill-in-the-middle transformation of texts, with cuts found through Fenwick trees over text blocks.

A unit is a word with the white space before it, or the white space that ends a text (white space: 0x20 and
0x09-0x0D). A text of n units is cut after two of its n + 1 boundaries into prefix, middle and suffix, which are
written in the order of its form:

* ``plain``: the text as it is,
* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle,
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

Each text is laid out in blocks of ``BLOCK`` bytes. Two Fenwick trees over the blocks hold how many units end and how
many code points begin in each; the descent by halving steps finds the block in which a unit ends, and only that
block is searched for the byte. The draws are digests of seed and id, so a task that runs again makes the same cuts.

Defined cases: null counts as empty; an empty text and one that holds a mark is plain; a null id draws as the text
``null``; rows that repeat an id draw alike, each over its own text; one text is handled in one task, whatever its
length, with 16 bytes of tree for each block. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.llm.textbytes import _SPACE, pieces

MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ANY_MARK = "<[PSM]>"
SEED = 42
#: Of 100 texts, how many are transformed, and how many of those suffix first.
RATE, SUFFIX_FIRST = 50, 80
BLOCK = 256


class TextTree:
    """Fenwick trees of one text: units that end and code points that begin in each block of bytes."""

    def __init__(self, ends: np.ndarray, starts: np.ndarray, units: np.ndarray, points: np.ndarray):
        """``ends`` and ``starts`` mark bytes of the text, ``units`` and ``points`` are their sums by block."""
        self.ends, self.starts, self.n = ends, starts, len(units)
        self.tree = np.zeros((self.n + 1, 2), dtype=np.int64)
        self.tree[1:, 0], self.tree[1:, 1] = units, points
        step = 1
        while 2 * step <= self.n:
            self.tree[2 * step:: 2 * step] += self.tree[step: self.n + 1 - step: 2 * step]
            step *= 2

    def after(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` units."""
        if k <= 0:
            return 0, 0
        at, left, points, step = 0, k, 0, 1 << self.n.bit_length()
        while step := step >> 1:
            if at + step <= self.n and self.tree[at + step, 0] < left:
                at += step
                left -= int(self.tree[at, 0])
                points += int(self.tree[at, 1])
        block = slice(at * BLOCK, (at + 1) * BLOCK)
        inside = int(np.flatnonzero(self.ends[block])[left - 1]) + 1
        return at * BLOCK + inside, points + int(self.starts[block][:inside].sum())


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a unit of its text ends with each byte."""
    white = _SPACE[data]
    last = np.zeros(len(data), dtype=bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    ends = ~white
    ends[:-1] &= white[1:] | last[:-1]
    return ends | last


def block_layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every block of all texts, and the first block of each text."""
    count = -(-np.diff(offsets) // BLOCK)
    first = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(count)), count)
    return offsets[:-1][text] + BLOCK * (np.arange(len(text)) - first[:-1][text]), first


def cut_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``n, prefix_chars, middle_chars, output`` of rows ``text, form, h1, h2``."""
    form, draws = batch.column("form").to_pylist(), [batch.column(c).to_pylist() for c in ("h1", "h2")]
    n_units, prefix, middle, output = [], [], [], []
    for a, b, data, offsets in pieces(batch, "text"):
        raw = data.tobytes()
        ends, starts = unit_ends(data, offsets), (data & 0xC0) != 0x80
        begin, first = block_layout(offsets)
        units = np.add.reduceat(ends, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)
        points = np.add.reduceat(starts, begin, dtype=np.int64) if len(begin) else units
        for i in range(b - a):
            lo, hi, blocks = int(offsets[i]), int(offsets[i + 1]), slice(first[i], first[i + 1])
            n = int(units[blocks].sum())
            n_units.append(n)
            if form[a + i] == "plain":
                prefix.append(None)
                middle.append(None)
                output.append(raw[lo:hi])
                continue
            tree = TextTree(ends[lo:hi], starts[lo:hi], units[blocks], points[blocks])
            (x, cx), (y, cy) = (tree.after(k) for k in sorted(d[a + i] % (n + 1) for d in draws))
            prefix.append(cx)
            middle.append(cy - cx)
            head, body, tail = raw[lo: lo + x], raw[lo + x: lo + y], raw[lo + y: hi]
            parts = (b"<P>", head, b"<S>", tail) if form[a + i] == "psm" else (b"<S>", tail, b"<P>", head)
            output.append(b"".join((*parts, b"<M>", body)))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n_units, pa.int64()), batch.column("form"), pa.array(prefix, pa.int64()),
         pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def draw(doc_id: Column, nth: int, seed: int = SEED) -> Column:
    """The n-th (from 1) group of eight hex digits of the SHA-256 of ``seed:id``, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * nth - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
              suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    drawn = rows.select("doc_id", "text", *[draw(F.col("doc_id"), i, seed).alias(f"h{i}") for i in range(1, 5)])
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= rate) | F.col("text").rlike(ANY_MARK)
    shaped = drawn.select("doc_id", "text", "h1", "h2", F.when(plain, "plain").when(
        F.col("h4") % 100 < suffix_first, "spm").otherwise("psm").alias("form"))

    def run(batches):
        yield from map(cut_batch, batches)

    return shaped.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given; the parts hold no mark, so the marks split them."""
    parts = F.split(output, ANY_MARK, -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(
        form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    """The rows of ``transform`` with digests of the output and of the text rebuilt from it, in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
