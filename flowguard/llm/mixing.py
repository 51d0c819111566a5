"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's material is cut into blocks. Its target in words is met by whole passes over all blocks
plus one partial pass over the first blocks of a permuted order, so that every source has an exact
quota of block draws. The quotas are split among the output shards by a binary tree: a node with
``n_s`` draws of each source gives its left child a multivariate-hypergeometric share, the right child
the rest, which is what shuffling all draws and cutting them into equal shards would give, for the
cost of a few counts per node. Draw ``r`` of a source then goes to the shard whose range of the
source's quota holds a second permutation of ``r``, and each shard orders its draws by a hash.

Defined cases: null text or no words: size 0, taken 0. A null source is a source of its own, the last.
No rows, or all sizes 0: targets 0. Repeated ids: every row counts by itself; rows alike in all columns
are drawn alike up to the order of their positions. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard.llm.ranks import hash_bucket, running_position
from flowguard.llm.tables import word_count, written

#: Words of a block.
BLOCK_WORDS = 64
#: Output shards; a power of two.
SHARDS = 16
#: Weights of the sources in code-point order, repeated as often as needed.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2


def source_targets(sizes: DataFrame, share: float = SHARE, limit: int = LIMIT, weights=WEIGHTS) -> DataFrame:
    """``(source, source_size)`` to targets: ``share`` of all sizes by weight, at most ``limit`` x the size.

    What a capped source can't take is shared anew by weight until none is above its cap. The end state
    is ``min(limit * size, level * weight)``; the level follows from the sources in order of size over
    weight. One row per source goes through the two unpartitioned windows.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    listed = sizes.withColumn("_i", F.row_number().over(order) - 1).withColumn(
        "_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")))
    level = Window.orderBy(F.col("source_size") / F.col("_w"), "_i")
    capped = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The level if all sources before this one are capped; it holds for the first source it does not cap,
    # and later sources give lower ones.
    levels = listed.withColumn(
        "_level",
        (F.lit(float(share)) * F.sum("source_size").over(everything)
         - F.lit(limit) * F.coalesce(F.sum("source_size").over(capped), F.lit(0)))
        / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(capped), F.lit(0))),
    ).withColumn("_fits", F.col("_level") * 1.0 <= F.lit(limit) * F.col("source_size") / F.col("_w"))
    found = levels.withColumn("_at", F.max(F.when(F.col("_fits"), F.col("_level"))).over(everything))
    return found.select(
        "source", "source_size",
        F.least(F.coalesce(F.col("_at") * F.col("_w"), (F.lit(limit) * F.col("source_size")).cast("double")),
                (F.lit(limit) * F.col("source_size")).cast("double")).alias("target"),
    )


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Inverse-CDF draw: how many of ``drawn`` out of ``total`` are ``marked``.

    Outcomes are walked from the mode upwards, then from the mode downwards, by the ratios of their
    chances, over nine standard deviations; what lies beyond is below the precision of ``u``.
    """
    def prepared(x):
        t, m, d = x["t"], x["m"], x["d"]
        lo = F.greatest(F.lit(0.0), m + d - t)
        hi = F.least(m, d)
        return F.struct(
            t.alias("t"), m.alias("m"), d.alias("d"), lo.alias("lo"), hi.alias("hi"),
            F.least(hi, F.greatest(lo, F.floor((d + 1) * (m + 1) / (t + 2)).cast("double"))).alias("mode"),
            F.ceil(F.sqrt(F.greatest(d * m / t * (t - m) / t, F.lit(0.0))) * 9 + 8).cast("double").alias("spread"))

    def draw(x):
        t, m, d, mode = x["t"], x["m"], x["d"], x["mode"]
        above, below = F.least(x["hi"] - mode, x["spread"]), F.least(mode - x["lo"], x["spread"])

        def walk(n, ratio, p0, goal=None):
            """Sum of the chances of the next ``n`` outcomes and how many of them the goal passes."""
            steps = F.when(n > 0, F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)).cast("long"))).otherwise(
                F.array().cast("array<bigint>"))

            def one(acc, i):
                p = acc["p"] * ratio(i.cast("double"))
                passed = F.lit(0) if goal is None else F.when(acc["sum"] + p < goal, 1).otherwise(0)
                return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), (acc["n"] + passed).alias("n"))

            return F.aggregate(steps, F.struct(F.lit(1.0).alias("p"), F.lit(p0).alias("sum"), F.lit(0).alias("n")), one)

        up = lambda i: (m - mode - i + 1) * (d - mode - i + 1) / ((mode + i) * (t - m - d + mode + i))
        down = lambda i: (mode - i + 1) * (t - m - d + mode - i + 1) / ((m - mode + i) * (d - mode + i))
        sums = F.struct(walk(above, up, 1.0)["sum"].alias("up"), walk(below, down, 0.0)["sum"].alias("down"))

        def pick(g):
            return F.when(g["goal"] <= 1.0, mode).when(
                g["goal"] <= g["up"], F.least(mode + 1 + walk(above, up, 1.0, g["goal"])["n"], x["hi"])
            ).otherwise(F.greatest(mode - 1 - walk(below, down, 0.0, g["goal"] - g["up"])["n"], x["lo"]))

        return _let(_let(sums, lambda s: F.struct((u * (s["up"] + s["down"])).alias("goal"), s["up"].alias("up"))), pick)

    given = F.struct(*[x.cast("double").alias(k) for k, x in (("t", total), ("m", marked), ("d", drawn))])
    return F.when((total <= 0) | (drawn <= 0) | (marked <= 0), F.lit(0.0)).otherwise(
        _let(_let(given, prepared), draw)).cast("long")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _uniform(*cols: Column) -> Column:
    """A number in (0, 1) from the values, the same in every run."""
    return (F.conv(F.substring(F.md5(F.concat_ws("/", *cols)), 1, 12), 16, 10).cast("double") + 0.5) / float(16 ** 12)


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """``(source, draws)`` to ``(shard, source, first, draws)``: ranges of each source's draws by shard.

    One row per tree node holds the draws of all sources; every level halves the shards of a node.
    """
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    one = quotas.select(F.struct(F.col("source").isNull().alias("last"), "source", "draws").alias("q")).agg(
        F.sort_array(F.collect_list("q")).alias("q"))
    nodes = one.select(F.lit(0).alias("node"), F.transform("q", lambda x: x["source"]).alias("sources"),
                       F.transform("q", lambda x: x["draws"].cast("long")).alias("counts"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    for level in range(levels):
        # Which child takes the odd draw alternates with the node, so shards stay within one draw of each other.
        nodes = nodes.withColumn("_n", total(F.col("counts"))).withColumn(
            "_left", F.floor((F.col("_n") + F.col("node") % 2) / 2).cast("long"))
        state = F.struct(F.col("_n").alias("n"), F.col("_left").alias("left"),
                         F.array().cast("array<bigint>").alias("out"))

        salt = F.lit(f"{seed}/{level}")

        def step(acc, x):
            u = _uniform(salt, F.col("node"), F.size(acc["out"]))  # noqa: B023
            take = _hypergeometric(acc["n"], x, acc["left"], u)
            return F.struct((acc["n"] - x).alias("n"), (acc["left"] - take).alias("left"),
                            F.concat(acc["out"], F.array(take)).alias("out"))

        left = F.aggregate("counts", state, step, lambda acc: acc["out"])
        children = _let(left, lambda l: F.array(
            F.struct((F.col("node") * 2).alias("node"), l.alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("counts", l, lambda a, b: a - b).alias("counts"))))
        nodes = nodes.select("sources", F.explode(children).alias("_child")).select("sources", "_child.node", "_child.counts")
    flat = nodes.select(F.col("node").alias("shard"), F.posexplode(F.arrays_zip("sources", "counts")).alias("_p", "_z")).select(
        "shard", F.col("_z.sources").alias("source"), F.col("_z.counts").alias("draws"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("first", F.coalesce(F.sum("draws").over(before), F.lit(0)))


def draws_of(blocks: DataFrame, limit: int = LIMIT, share: float = SHARE, weights=WEIGHTS) -> DataFrame:
    """Blocks ``(source, block_key, size)`` with ``source_size``, ``target`` and ``draws`` (times taken).

    Blocks of a source are permuted by a hash of their key; ``target // source_size`` passes take all of
    them, the last pass takes the leading blocks up to the rest of the target, to the nearest block.
    """
    keyed = blocks.withColumn("_bucket", hash_bucket(F.col("block_key"))).withColumn(
        "_order", F.md5(F.concat_ws(":", "block_key")))
    placed = running_position(keyed, ["source"], "_bucket", ["_order", "block_key"], "size")
    targets = source_targets(blocks.groupBy("source").agg(F.sum("size").alias("source_size")), share, limit, weights)
    right = targets.select(F.col("source").alias("_s"), "source_size", "target")
    joined = placed.join(right, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long")
    rest = F.col("target") - passes * F.col("source_size")
    return joined.withColumn(
        "draws", passes + F.when(F.col("weight_before") + F.col("size") / 2 <= rest, 1).otherwise(0).cast("long")
    ).drop("_bucket", "_order", "weight_before")


def mix(blocks: DataFrame, shards: int = SHARDS, limit: int = LIMIT, share: float = SHARE, weights=WEIGHTS) -> DataFrame:
    """The mix itself: one row per draw of a block, with its ``shard`` and ``slot`` in the shard.

    ``blocks`` has ``source``, ``block_key`` (a string, unique in the source) and ``size`` (not null);
    further columns are carried.
    """
    drawn = written(draws_of(blocks, limit, share, weights), "mix-draws")
    quotas = drawn.groupBy("source").agg(F.sum("draws").alias("draws"))
    ranges = split_quotas(quotas, shards).filter("draws > 0").groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("_ranges"))
    rows = drawn.filter("draws > 0").withColumn(
        "pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1))).drop("position")
    key = F.concat_ws("#", F.col("pass"), F.col("block_key"))
    permuted = running_position(
        rows.withColumn("_bucket", hash_bucket(F.lit("draw"), key)).withColumn("_order", F.md5(key)),
        ["source"], "_bucket", ["_order", "block_key"])
    # At most one row per source; the side is joined on the source like any other.
    right = ranges.withColumnRenamed("source", "_s")
    dealt = permuted.join(right, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "shard", F.element_at(F.filter("_ranges", lambda r: r["first"] <= F.col("position")), -1)["shard"]
    ).drop("_s", "_ranges", "_bucket", "position")
    local = running_position(
        dealt.withColumn("_bucket", hash_bucket(F.lit("slot"), F.col("_order"))), ["shard"], "_bucket", ["_order", "block_key"])
    return local.withColumn("slot", F.col("position")).drop("position", "_bucket", "_order")


def document_sizes(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """``doc_id, source, doc_size`` of each row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("doc_size"))


def blocks_of(sized: DataFrame, words: int = BLOCK_WORDS) -> DataFrame:
    """Each row of ``document_sizes`` as blocks of ``words`` words: ``source, block_key, size, doc_id, block, doc_size``.

    A document without words is one block of size 0.
    """
    return sized.withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("doc_size") / words), F.lit(1)) - 1))
    ).withColumn("size", F.least(F.lit(words), F.col("doc_size") - F.col("block") * words)).withColumn(
        "block_key", F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("block")))


def document_blocks(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", words: int = BLOCK_WORDS) -> DataFrame:
    """The blocks of each document, see ``blocks_of``."""
    return blocks_of(document_sizes(docs, id_col, text_col, source_col), words)


def document_shares(docs: DataFrame, words: int = BLOCK_WORDS) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken`` of the mix in blocks of ``words``.

    ``taken`` is counted from the draws that the splitting tree dealt to the shards. Rows that share an
    id are summed up in one row.
    """
    # The texts are read and counted once; blocks, sizes and targets all follow from the counts.
    sized = written(document_sizes(docs), "mix-sizes")
    mixed = mix(blocks_of(sized, words))
    taken = mixed.groupBy("doc_id", "source").agg(F.sum("size").alias("taken"))
    sizes = sized.groupBy("doc_id", "source").agg(F.sum("doc_size").alias("size"))
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    left = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    right = taken.select(F.col("doc_id").alias("_d"), F.col("source").alias("_t"), "taken")
    return left.join(
        right, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_t")), "left"
    ).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
             F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
