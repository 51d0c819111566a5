"""A Merkle manifest of a table of documents: leaves, a tree per source, a root over the sources, and proofs.

Every row is a leaf, the digest of its fields. Inside a source the leaves stand in order of their ids; while more
than one node remains, every ``FANOUT`` neighbours (the last run: what is left) become the digest of their digests.
What remains is the source's subroot, and the subroots, in order of the sources, make the root in the same way.

A level is one slot pivot: conditional aggregates spread the children of each parent into ``FANOUT`` columns. The
columns together are hashed to the parent; without the column of the own slot they are the siblings of a child. So
proofs go down from the root by the same rows: each parent, joined to its own path, hands it with the siblings to
its children, and leaves keep their ids and digests inside the columns, so nothing is joined to the leaves.

Ranks: the leaves are written in ranges of (source, id), and the count of each range gives the place of its first
row. A source of any size is so spread over the ranges; no window runs over a source.

Defined cases: a null field is ``-``, anything else its byte count, ``:`` and its text; null sources come first and
are a source of their own; null ids come first in their source and are not tampered with; rows that share an id
stand in order of their digests (equal rows in any order, which changes no digest); an empty table has no rows and no
root; a lone leaf is its own subroot. Fields are taken by name, extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard.llm.tables import written

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a way down that go in one job; the rows are then written.
LEVELS_A_JOB = 6
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts as text one after another, in lower-case hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(*[field(c) for c in fields])


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where 2 divides the CRC-32 of the id, else the text."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def leaves(docs: DataFrame) -> DataFrame:
    """``_s, doc_id, digest, forged``: the key of the source, the leaf, and the leaf of the tampered row if it differs.

    Keys sort as the sources do, with null first, and are never null themselves.
    """
    rows = docs.select(*FIELDS, tampered_text(F.col("doc_id"), F.col("text")).alias("_text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    hashed = rows.select(
        key.alias("_s"), "doc_id", leaf_digest([F.col(c) for c in FIELDS]).alias("digest"),
        F.when(~F.col("text").eqNullSafe(F.col("_text")), leaf_digest([*map(F.col, FIELDS[:-1]), F.col("_text")])).alias("forged"))
    # The row number only tells equal rows apart; it is fixed as the table is written.
    return written(hashed.withColumn("_u", F.monotonically_increasing_id()), "merkle-leaves")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``_i``, the place (from 0) inside ``_s`` by ``order``, and ``_n``, the rows of ``_s``."""
    sort = ["_s", *[F.col(c).asc_nulls_first() for c in order]]
    ranges = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    # High bits: the range; low bits: the row's place in it.
    placed = written(ranges.withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_at", 33)), "merkle-ranges")
    counts = written(placed.groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first")), "merkle-counts")
    totals = counts.groupBy(F.col("_s").alias("_ts")).agg(F.sum("_c").alias("_n"))
    # A source of several ranges has one row for each; the sum before a range runs over those.
    earlier = counts.select(F.col("_s").alias("_es"), F.col("_p").alias("_ep"), F.sum("_c").over(
        Window.partitionBy("_s").orderBy("_p")).alias("_upto"), F.col("_c").alias("_ec"), F.col("_first").alias("_ef"))
    starts = earlier.join(totals, F.col("_es") == F.col("_ts")).select("_es", "_ep", (F.col("_upto") - F.col("_ec") - F.col("_ef")).alias("_shift"), "_n")
    met = placed.join(starts, (F.col("_s") == F.col("_es")) & (F.col("_p") == F.col("_ep")))
    return met.withColumn("_i", F.col("_at") + F.col("_shift")).drop("_es", "_ep", "_shift", "_at", "_p")


def pivot(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """A row per parent of the nodes ``_s, _i, _n, digest``: its children in ``c0 ..`` and its own digest."""
    child = F.struct("digest", *payload)
    slots = [F.max(F.when(F.col("_i") % FANOUT == k, child)).alias(f"c{k}") for k in range(FANOUT)]
    grouped = nodes.groupBy("_s", F.floor(F.col("_i") / FANOUT).cast("long").alias("_p")).agg(F.max("_n").alias("_n"), *slots)
    own = digest(*[F.coalesce(F.col(f"c{k}.digest"), F.lit("")) for k in range(FANOUT)])
    return grouped.withColumn("digest", own)


def children(parents: DataFrame, payload: list[str], keep: list[str]) -> DataFrame:
    """A row per child of ``parents`` with its place, payload, and ``path``: its siblings, then its parent's path."""
    have = lambda k: F.coalesce(F.col(f"c{k}.digest"), F.lit(""))
    side = lambda ks: F.concat(F.lit(""), *map(have, ks))
    rows = [F.struct(
        (F.col("_p") * FANOUT + k).alias("_i"), F.col(f"c{k}").alias("c"),
        F.concat(F.array(F.struct(side(range(k)).alias("left"), side(range(k + 1, FANOUT)).alias("right"))), F.col("path")).alias("path"),
    ) for k in range(FANOUT)]
    spread = parents.select("_s", *keep, F.explode(F.filter(F.array(*rows), lambda r: r["c"].isNotNull())).alias("r"))
    return spread.select("_s", *keep, "r._i", *[F.col(f"r.c.{p}").alias(p) for p in ["digest", *payload]], "r.path")


class Tree:
    """The levels above the nodes of some groups, each a written pivot; ``tops`` has ``_s, _height, digest``."""

    def __init__(self, nodes: DataFrame, payload: list[str]):
        """``nodes``: written rows ``_s, _i, _n, digest`` and ``payload``."""
        self.nodes, self.payload, self.levels = nodes, payload, []
        lone = lambda df, height: df.filter("_n = 1").select("_s", F.lit(height).alias("_height"), "digest")
        tops = lone(nodes, 0)
        most = nodes.agg(F.max("_n")).first()[0] or 0
        here, carried = nodes, payload
        while most > 1:
            level = written(pivot(here.filter("_n > 1"), carried), f"merkle-level-{len(self.levels)}")
            self.levels.append(level)
            here = level.select("_s", F.col("_p").alias("_i"), F.ceil(F.col("_n") / FANOUT).cast("long").alias("_n"), "digest")
            most, carried = -(-most // FANOUT), []
            tops = tops.unionByName(lone(here, len(self.levels)))
        self.tops = written(tops, "merkle-tops")

    def paths(self, starts: DataFrame, keep: list[str]) -> DataFrame:
        """``_s, *keep, digest, *payload, path`` of every node, from ``starts`` (``_s, _height, *keep, path``) at the tops."""
        at_top = lambda height: starts.filter(F.col("_height") == height)
        here = None
        for height in range(len(self.levels), 0, -1):
            # A top is the only node of its level, so its source's start is the path of node 0 there.
            tops = at_top(height).select("_s", F.lit(0).cast("long").alias("_i"), *keep, "path")
            here = tops if here is None else here.select("_s", "_i", *keep, "path").unionByName(tops)
            if (len(self.levels) - height) % LEVELS_A_JOB == LEVELS_A_JOB - 1:
                here = written(here, f"merkle-paths-{height}")
            here = here.select(F.col("_s").alias("_us"), F.col("_i").alias("_ui"), *keep, "path")
            up = self.levels[height - 1].drop("digest").join(here, (F.col("_s") == F.col("_us")) & (F.col("_p") == F.col("_ui")))
            here = children(up, self.payload if height == 1 else [], keep)
        lone = self.nodes.filter("_n = 1").select(F.col("_s").alias("_ls"), "digest", *self.payload)
        lone = lone.join(at_top(0), F.col("_ls") == F.col("_s")).select("_s", *keep, "digest", *self.payload, "path")
        return lone if here is None else here.select(*lone.columns).unionByName(lone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda acc, x: digest(x["left"], acc, x["right"]))


def proof(path: Column) -> Column:
    """All siblings of the path, level by level, as text one after another."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, forged`` of every row of ``docs`` (``FIELDS``).

    ``path`` lists, from the leaf to the root, what stands left and right of the own digest in its parent.
    """
    order = ["doc_id", "digest", "_u"]
    nodes = written(ranked(leaves(docs), order).select("_s", "_i", "_n", "digest", "doc_id", "forged"), "merkle-nodes")
    tree = Tree(nodes, ["doc_id", "forged"])
    subroots = tree.tops.select(F.lit("").alias("_s"), F.col("_s").alias("_source"), F.col("_height").alias("_below"), "digest")
    above = Tree(written(ranked(subroots, ["_source"]), "merkle-subroots"), ["_source", "_below"])
    top = above.tops.select("digest").first()  # one digest
    root = F.lit(top[0] if top else None).cast("string")
    starts = above.paths(above.tops.select("_s", "_height", F.array().cast(PATH).alias("path")), [])
    starts = written(starts.select(
        F.col("_source").alias("_s"), F.col("_below").alias("_height"), F.col("digest").alias("subroot"), "path"), "merkle-starts")
    return tree.paths(starts, ["subroot"]).select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path", "forged")


def verify(manifested: DataFrame) -> DataFrame:
    """Proof digests, and whether the leaf (of the tampered row, where there is one) still leads to the root."""
    folded = manifested.select(
        "doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"),
        fold(F.coalesce("forged", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
