"""N-gram Jaccard self-join with token-combination prefixes.

A text's tokens are its distinct shingles of five words. Tokens are put in one global order: by the
number of times they occur in the corpus, then by hash. Occurrences are counted in ``COUNT_BUCKETS`` hash
buckets, a table of fixed size that is added up in slices and broadcast; a token counts for what its bucket
holds. A token is *frequent* if that is ``FREQUENT_FROM`` or more above what hashing alone brings, else *rare*.

Two sets of Jaccard similarity ``t`` share at least ``ceil(t n)`` tokens of either, so their first
``n - ceil(t n) + k`` tokens have at least ``k`` in common. Rare tokens are indexed singly. Frequent ones
are dealt to ``m`` parts and indexed as pairs of one part, with prefixes extended for ``k = m + 1``: of
that many common tokens either one is rare, or two are frequent and of the same part. Linked sets differ
at most 1.25-fold in size, so ``m`` follows bands of two neighbouring size classes; a set is indexed in
the two bands it belongs to. The number of pairs per set stays below its number of tokens.

Sets with the same signature are first all compared with the smallest one (a star, not all pairs).
Links give components; only sets of a signature that are still in different components are then
compared, first with the largest one, then with one drawn for each signature, then with each other, so no
component misses a link. In the last step the sets of large signatures are compared inside tasks, each pair in the
smallest signature that both list, and of the largest signatures only links leave the tasks. Candidates whose overlap cannot suffice go early: the tokens of a set are counted in ``BOUND_BUCKETS`` hash buckets,
and the sum of the smaller counts bounds the overlap of two sets. The rest is decided exactly, on the
whole texts.

Equal sets are one node, named by a 64-bit hash of the set.

Defined cases: null text or no words: no tokens, component is the own id; fewer than five words: the
whole sequence is one token; rows that share an id take part each by itself; a null id never names a
component unless all of its ids are null; no rows give no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.components import components
from flowguard.llm.tables import release, small_batches, written
from flowguard.llm.textbytes import Powers, Words, mix, pieces

SHINGLE = 5
SIMILARITY_PERCENT = 80
#: Buckets of the shingle counts, and the slices in which they are added up.
COUNT_BITS, COUNT_SLICES = 22, 64
COUNT_BUCKETS = 1 << COUNT_BITS
FREQUENT_FROM = 64
#: Tokens of a size class per part of its frequent tokens.
PART_TOKENS = 32
#: Texts compared with one text in one group of the exact check.
GROUP_TEXTS = 512
#: Shingles that a task counts at once, and candidate texts that it unpacks at once.
COUNT_TOKENS, UNPACK_ROWS = 1 << 20, 256
#: Sets of a signature up to which all its pairs are joined, and up to which its pairs that fit become rows.
FEW_SETS, SOME_SETS = 16, 64
#: Sets and tokens in a part of a signature, and sets and pairs that a task compares at once.
TILE_SETS, TILE_TOKENS, MEET_SETS, MEET_PAIRS = 2048, 1 << 20, 64, 1 << 13
#: Signatures of a set by which a pair that meets more than once is told.
FIRST_SIGNATURES = 32
#: Buckets of the token counts that bound an overlap from above.
BOUND_BUCKETS = 256
#: Candidate texts up to this count are found by a broadcast of their ids, beyond it by a shuffle.
BROADCAST_IDS = 200_000

_BOUNDS = [1]
while _BOUNDS[-1] < 1 << 50:
    _BOUNDS.append(_BOUNDS[-1] * 5 // 4 + 1)


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of all shingles of five words by hash bucket; tasks send slices, which are added up apart."""
    width = COUNT_BUCKETS // COUNT_SLICES

    def count(batches):
        powers, held, n_held, codec = Powers(), [], 0, pa.Codec("zstd", compression_level=1)
        total = np.zeros(COUNT_BUCKETS, dtype=np.uint32)

        def flush():
            bucket, times = np.unique(np.concatenate(held), return_counts=True)
            total[bucket] += times.astype(np.uint32)

        for batch in batches:
            for _, _, data, offsets in pieces(batch, "text"):
                hashes, inside = Words(data, offsets, powers).shingles(SHINGLE)
                held.append(bucket_of(hashes[inside]).astype(np.int32))
                n_held += len(held[-1])
                if n_held > COUNT_TOKENS:
                    flush()
                    held, n_held = [], 0
        if held:
            flush()
        for i in range(COUNT_SLICES):
            part = total[i * width: (i + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([codec.compress(part.tobytes(), asbytes=True)], pa.binary())], names=["slice", "counts"])

    def add(batches):
        codec, sums = pa.Codec("zstd"), {}
        for batch in batches:
            for i, raw in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                part = np.frombuffer(codec.decompress(raw.as_py(), 4 * width, asbytes=True), np.uint32)
                sums[i] = np.minimum(sums.get(i, 0) + part.astype(np.int64), (1 << 31) - 1)
        for i, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.astype(np.int32).tobytes()], pa.binary())], names=["slice", "counts"])

    out = np.zeros(COUNT_BUCKETS, dtype=np.int32)
    slices = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition(COUNT_SLICES, "slice").mapInArrow(add, "slice int, counts binary").toArrow()
    for i, part in zip(slices.column("slice").to_pylist(), slices.column("counts")):
        out[i * width: (i + 1) * width] = np.frombuffer(part.as_buffer(), np.int32)
    return out


def above_chance(counts: np.ndarray) -> int:
    """What a bucket holds by hashing alone: the median, and four deviations of as many random hits."""
    usual = float(np.median(counts))
    return int(usual + 4 * usual ** 0.5)


def size_class(n: int) -> int:
    return int(np.searchsorted(_BOUNDS, n, side="right")) - 1


def prefix_length(n: int, k: int) -> int:
    return min(n, n - (n * SIMILARITY_PERCENT + 99) // 100 + k)


def signatures(tokens: np.ndarray, counts: np.ndarray, frequent_from: int = FREQUENT_FROM) -> np.ndarray:
    """Signatures of one set: its distinct ``tokens`` with the count of each."""
    n = len(tokens)
    g = size_class(n)
    bands = [(b, max(1, _BOUNDS[b] // PART_TOKENS)) for b in ((g - 1, g) if g else (g,))]
    longest = prefix_length(n, 1 + max(m for _, m in bands))
    order = np.lexsort((tokens, counts))[:longest]
    tokens, counts = tokens[order], counts[order]
    rare = int(np.searchsorted(counts, frequent_from))
    out = [tokens[:rare]]
    for band, parts in bands:
        some = tokens[rare: prefix_length(n, 1 + parts)]
        if len(some) < 2:
            continue
        some = np.sort(some)
        part = (some % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        some, part = some[by], part[by]
        ends = np.searchsorted(part, part, side="right")
        reps = ends - np.arange(len(some)) - 1
        first = np.repeat(np.arange(len(some)), reps)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(reps) - reps, reps)
        salt = mix(np.array([band + 1], dtype=np.uint64))
        out.append(mix(some[first] * np.uint64(0xA24BAED4963EE407) + some[second] * np.uint64(0x9FB21C651E98DF25) + salt))
    return np.concatenate(out)


def set_hash(tokens: np.ndarray) -> np.uint64:
    return mix(np.array([mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64))[0]


def postings(docs: DataFrame, frequent_from: int = FREQUENT_FROM) -> DataFrame:
    """Rows ``(sig, node, n)`` of all signatures, and one row per document with ``sig`` null and its id."""
    counted = shingle_counts(docs)
    frequent_from += above_chance(counted)
    shared = docs.sparkSession.sparkContext.broadcast(counted)

    def run(batches):
        powers = Powers()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False) if not batch.column("doc_id").null_count else batch.column("doc_id").to_pylist()
            for a, b, data, offsets in pieces(batch, "text"):
                sigs, lengths, nodes, sizes, bounds = [], [], [], [], []
                for tokens in Words(data, offsets, powers).shingle_sets(SHINGLE):
                    own = np.unique(signatures(tokens, shared.value[bucket_of(tokens)], frequent_from)) if len(tokens) else tokens
                    sigs.append(own)
                    lengths.append(len(own))
                    nodes.append(set_hash(tokens))
                    sizes.append(len(tokens))
                    bucket = (tokens % np.uint64(BOUND_BUCKETS)).astype(np.int64)
                    bounds.append(np.minimum(np.bincount(bucket, minlength=BOUND_BUCKETS), 255).astype(np.uint8).tobytes())
                node = np.array(nodes, dtype=np.uint64).view(np.int64)
                size = np.array(sizes, dtype=np.int32)
                total = int(sum(lengths))
                yield _rows(np.concatenate(sigs).view(np.int64), np.repeat(node, lengths), np.repeat(size, lengths), pa.nulls(total, pa.int64()), pa.nulls(total, pa.binary()))
                yield _rows(pa.nulls(b - a, pa.int64()), node, size, pa.array(ids[a:b], pa.int64()), pa.array(bounds, pa.binary()))

    def _rows(sig, node, size, doc, bound):
        return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(node), pa.array(size), doc, bound], names=["sig", "node", "n", "doc_id", "bound"])

    return docs.mapInArrow(run, "sig long, node long, n int, doc_id long, bound binary")


def _small(df: DataFrame, most: int) -> DataFrame:
    """With a broadcast hint if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def _squeeze(batches):
    """Texts compressed, as each goes through the shuffles of the check several times."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        packed = [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in (x.as_buffer() if x.is_valid else pa.py_buffer(b"") for x in batch.column("text").cast(pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], names=["node", "text"])


def _unsqueeze(batch: pa.RecordBatch) -> pa.RecordBatch:
    codec = pa.Codec("zstd")
    texts = [codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in (v.as_py() for v in batch.column("text"))]
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string())], names=["text"])


def _texts(nodes: DataFrame, wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, text`` of the ``wanted`` nodes, compressed."""
    ids = written(nodes.join(wanted, "node").select("node", F.col("doc_id").alias("_id")), "jaccard-wanted")
    found = docs.join(_small(ids, BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    return written(found.mapInArrow(_squeeze, "node long, text binary"), "jaccard-texts")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The candidate ``pairs`` (``a, b``) of nodes that are linked, decided on their whole texts.

    ``nodes`` is ``(node, doc_id)``, one document for each node. A group holds one text ``a`` and at most
    about ``GROUP_TEXTS`` texts ``b``; a node with more candidates makes several groups.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).select("a", F.ceil(F.col("_n") / GROUP_TEXTS).cast("int").alias("_groups"))
    dealt = written(pairs.join(many, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("_groups").cast("long")).alias("g")), "jaccard-pairs")
    texts = _texts(nodes, dealt.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs)
    member = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "g", "b", "text")
    head = dealt.select("a", "g").distinct().join(texts.withColumnRenamed("node", "a"), "a").select(
        "a", "g", F.lit(None).cast("long").alias("b"), "text")
    grouped = head.unionByName(member).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())

    def run(batches):
        powers, key, own = Powers(), None, None
        for whole in batches:
            for batch in (whole.slice(i, UNPACK_ROWS) for i in range(0, whole.num_rows, UNPACK_ROWS)):
                a, g, b = (batch.column(c).to_pylist() for c in ("a", "g", "b"))
                left, right = [], []
                for lo, _, data, offsets in pieces(_unsqueeze(batch), "text"):
                    for i, tokens in enumerate(Words(data, offsets, powers).shingle_sets(SHINGLE), lo):
                        if (a[i], g[i]) != key:
                            key, own = (a[i], g[i]), None
                        # Rows that share an id bring each other's texts along; the hash tells them apart.
                        if int(set_hash(tokens).view(np.int64)) != (a[i] if b[i] is None else b[i]):
                            continue
                        if b[i] is None:
                            own = tokens
                        elif own is not None and linked(tokens, own):
                            left.append(a[i])
                            right.append(b[i])
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return grouped.mapInArrow(run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= SIMILARITY_PERCENT * (len(x) + len(y) - both)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent_from: int = FREQUENT_FROM
) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs``."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col, frequent_from)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, frequent_from: int) -> DataFrame:
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = written(postings(given, frequent_from), "jaccard-index")
    documents = index.filter("sig is null").select("doc_id", "node", "n")
    # One document stands for its node.
    nodes = written(index.filter("sig is null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.any_value("bound").alias("bound")), "jaccard-nodes")
    listed = index.filter("sig is not null").select("sig", "node")
    stars = written(listed.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("_last"))
                    .filter("pivot <> _last"), "jaccard-stars")
    release(spark)
    shared = written(listed.join(stars, "sig").distinct(), "jaccard-shared")
    release(spark)
    first = written(_fitting(shared.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), nodes), "jaccard-first")
    links = written(verify(first, nodes, given), "jaccard-links")
    release(spark)
    label = components(links)
    # What is still apart, against the other end of its signature, then against a drawn set, then against all others.
    for against in ("last", "drawn", "all"):
        named = written(shared.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-named")
        # Drawn for each signature, so a set of many signatures meets as many different others.
        drawn = F.min(F.struct(F.xxhash64("sig", "node").alias("lot"), "node", "component"))
        groups = named.groupBy("sig").agg(
            F.count(F.lit(1)).alias("size"), (F.min("component") < F.max("component")).alias("split"),
            F.max(F.when(F.col("node") == F.col("_last"), F.struct("node", "component"))).alias("last"), drawn.alias("drawn"))
        apart = named.select("sig", "node", "component").join(groups.filter("split").drop("split"), "sig")
        if against == "all":
            apart = written(apart.select("sig", "node", "component", "size"), "jaccard-apart")
            more = _apart(apart.filter(F.col("size") <= SOME_SETS), nodes)
        else:
            other = F.col(f"{against}.node")
            more = _fitting(apart.filter(F.col("component") != F.col(f"{against}.component")).select(
                F.least(other, "node").alias("a"), F.greatest(other, "node").alias("b")).distinct(), nodes)
        more = written(more, "jaccard-more")
        release(spark)
        found = [verify(more, nodes, given)] if not more.isEmpty() else []
        if against == "all":
            crowded = apart.filter(F.col("size") > SOME_SETS)
            found += [_close(crowded, nodes, given)] if not crowded.isEmpty() else []
        if found:
            links = written(reduce(DataFrame.unionByName, [links, *found]), "jaccard-links")
            label = components(links)
            release(spark)
    joined = written(documents.join(label, "node", "left").withColumn("_c", F.coalesce("component", "node")), "jaccard-labelled")
    least = joined.filter("n > 0").groupBy("_c").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    least = written(least.select(F.col("_c").alias("_k"), "component_id"), "jaccard-names")
    return joined.join(least, (F.col("_c") == F.col("_k")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _fit(x, y, nx, ny) -> np.ndarray:
    """Whether sets with these bucket counts (last axis) and sizes can reach the similarity; a full counter says nothing."""
    both = np.minimum(x, y).sum(axis=-1, dtype=np.uint32).astype(np.int64)
    full = (x == 255).any(axis=-1) | (y == 255).any(axis=-1)
    total = nx.astype(np.int64) + ny
    return (np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * SIMILARITY_PERCENT) & (full | (100 * both >= SIMILARITY_PERCENT * (total - both)))


def _bounds(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _fitting(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes and bucket counts can reach the similarity at all."""
    side = lambda end: nodes.select(F.col("node").alias(end), F.col("n").cast("long").alias(f"n{end}"), F.col("bound").alias(f"bound{end}"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * SIMILARITY_PERCENT

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = _bounds(batch.column("bounda")), _bounds(batch.column("boundb"))
                yield batch.select(["a", "b"]).filter(pa.array(_fit(x, y, batch.column("na").to_numpy(), batch.column("nb").to_numpy())))

    return pairs.join(side("a"), "a").join(side("b"), "b").filter(fits).mapInArrow(run, "a long, b long")


def _dealt(rows: DataFrame, nodes: DataFrame, tile: int) -> DataFrame:
    """``rows`` (``sig, node, component, size``) dealt to parts of about ``tile`` sets and ``TILE_TOKENS`` tokens.

    A task is to hold two parts ``i <= j`` of a signature against each other; a set goes to every task of its part.
    """
    known = rows.join(nodes.select("node", F.col("n").cast("long").alias("n"), "bound"), "node")
    parts = F.ceil(F.greatest(F.col("size") / tile, F.col("_tokens") / TILE_TOKENS)).cast("int")
    tokens = rows.join(nodes.select("node", "n"), "node").groupBy("sig").agg(F.sum("n").alias("_tokens"))
    first = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, FIRST_SIGNATURES).alias("first"))
    dealt = known.join(tokens, "sig").join(first, "node").withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    # Of two parts the smaller number comes first; a part alone meets itself.
    one = dealt.filter("parts = 1").withColumn("with", F.lit(0))
    split = dealt.filter("parts > 1").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = one.unionByName(split).select(
        "sig", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "node", "component", "n", "bound", "first")
    return placed.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")


def _groups(batches):
    """The rows of each ``(sig, i, j)`` as one table; they stand together."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("sig", "i", "j")])
        cuts = [0, *(1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and tuple(keys[:, lo]) != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = tuple(keys[:, lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _meet(sets: pa.Table):
    """Places ``(p, q)`` of the pairs that fit, of different components, in a group of ``_groups``.

    A pair that shares a smaller one of its ``first`` signatures is left to that one.
    """
    node, component, n, part = (sets.column(c).to_numpy() for c in ("node", "component", "n", "part"))
    sig, within = sets.column("sig")[0].as_py(), sets.column("i")[0].as_py() == sets.column("j")[0].as_py()
    bound = _bounds(sets.column("bound"))
    lists = sets.column("first").to_pylist()
    smaller = np.full((len(lists), max(map(len, lists))), sig, np.int64)
    for row, own in zip(smaller, lists):
        row[: len(own)] = np.minimum(own, sig)
    values, count = np.unique(component, return_counts=True)
    # Sets of the most common component meet the others from the other side.
    lone = component != values[count.argmax()]
    own = np.flatnonzero(lone)
    for at in range(0, len(own), MEET_SETS):
        x = own[at: at + MEET_SETS]
        i, y = np.nonzero((component[x][:, None] != component) & ~(lone & (node <= node[x][:, None])) & (within | (part[x][:, None] != part)))
        for lo in range(0, len(i), MEET_PAIRS):
            p, q = x[i[lo: lo + MEET_PAIRS]], y[lo: lo + MEET_PAIRS]
            fits = _fit(bound[p], bound[q], n[p], n[q])
            p, q = p[fits], q[fits]
            if len(p):
                left = smaller[p]
                met = ((left[:, :, None] == smaller[q][:, None, :]) & (left < sig)[:, :, None]).any(axis=(1, 2))
                p, q = p[~met], q[~met]
            if len(p):
                yield p, q


def _apart(rows: DataFrame, nodes: DataFrame, few: int = FEW_SETS, tile: int = TILE_SETS) -> DataFrame:
    """All pairs of sets of one signature and different components that fit, each once.

    ``rows`` is ``(sig, node, component, size)``, ``size`` the sets of the signature. Signatures of up to ``few`` sets are
    joined, the sets of larger ones meet inside tasks, so that only pairs that fit become rows.
    """
    some = rows.filter(F.col("size") <= few)
    other = some.select("sig", F.col("node").alias("b"), F.col("component").alias("bc"))
    joined = some.join(other, "sig").filter("node < b and component <> bc").select(F.col("node").alias("a"), "b").distinct()

    def run(batches):
        for sets in _groups(batches):
            node = sets.column("node").to_numpy()
            for p, q in _meet(sets):
                p, q = node[p], node[q]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    met = _dealt(rows.filter(F.col("size") > few), nodes, tile).mapInArrow(run, "a long, b long")
    return _fitting(joined, nodes).unionByName(met).distinct()


def _close(rows: DataFrame, nodes: DataFrame, docs: DataFrame, tile: int = TILE_SETS) -> DataFrame:
    """Links ``(a, b)`` that join what the links between sets of one signature join, decided inside tasks.

    ``rows`` is that of ``_apart``. Pairs that fit never become rows: a first pass names the sets that are in
    such a pair, these get their texts, and a second pass decides the pairs whose ends no link of the task has joined yet. So
    no pass makes more rows than sets were dealt to it.
    """
    fields = ["sig", "i", "j", "part", "node", "component", "n", "bound", "first"]
    schema = "sig long, i int, j int, part int, node long, component long, n long, bound binary, first array<long>"

    def name(batches):
        for sets in _groups(batches):
            found = np.zeros(sets.num_rows, dtype=bool)
            for p, q in _meet(sets):
                found[p] = found[q] = True
            if found.any():
                yield from sets.filter(pa.array(found)).select(fields).to_batches()

    named = written(_dealt(rows, nodes, tile).mapInArrow(name, schema), "jaccard-meeting")
    texts = _texts(nodes, named.select("node").distinct(), docs)

    def shingled(batches):
        powers = Powers()
        for whole in batches:
            for batch in (whole.slice(i, UNPACK_ROWS) for i in range(0, whole.num_rows, UNPACK_ROWS)):
                own = [t for _, _, data, offsets in pieces(_unsqueeze(batch), "text") for t in Words(data, offsets, powers).shingle_sets(SHINGLE)]
                # Rows that share an id bring each other's texts along; the hash tells them apart.
                same = np.array([set_hash(t) for t in own], np.uint64).view(np.int64) == batch.column("node").to_numpy()
                tokens = pa.array([t.tobytes() for t in own], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), tokens], names=[*fields, "tokens"]).filter(pa.array(same))

    def decide(batches):
        for sets in _groups(shingled(batches)):
            sets = sets.take(pa.array(np.unique(sets.column("node").to_numpy(), return_index=True)[1]))
            links = _joining(sets)
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    meeting = named.join(texts, "node").select(*fields, "text").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return meeting.mapInArrow(decide, "a long, b long").distinct()


def _joining(sets: pa.Table) -> list[tuple[int, int]]:
    """Links between the sets of one group, as few as join all that is linked; sets have their sorted ``tokens``."""
    node = sets.column("node").to_pylist()
    own = [np.frombuffer(t.as_buffer(), np.uint64) for t in sets.column("tokens")]
    cut = np.cumsum([0, *map(len, own)])
    values, number = np.unique(np.concatenate(own), return_inverse=True)
    number, held = number.astype(np.int32), np.zeros(len(values), dtype=bool)
    joined = np.unique(sets.column("component").to_numpy(), return_inverse=True)[1]
    links = []
    for p, q in _meet(sets):
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        for x, others in zip(p[starts].tolist(), np.split(q, starts[1:])):
            mine = number[cut[x]: cut[x + 1]]
            held[mine] = True
            for y in others[joined[others] != joined[x]].tolist():
                if joined[y] == joined[x]:
                    continue
                both = int(np.count_nonzero(held[number[cut[y]: cut[y + 1]]]))
                if both and 100 * both >= SIMILARITY_PERCENT * (len(own[x]) + len(own[y]) - both):
                    links.append((node[x], node[y]))
                    joined[joined == joined[y]] = joined[x]
            held[mine] = False
    return links


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document with the smallest id, with all its columns.

    Rows that share a kept id stay together; a row with a null id stays if nothing with an id is linked to it.
    """
    kept = near_duplicates(docs, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(written(kept, "jaccard-kept"), F.col(id_col).cast("long").eqNullSafe(F.col("_kept_id")), "left_semi")
