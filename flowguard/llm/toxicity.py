"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, with a block-max inverted index.

Terms are letter runs and runs of ``GRAM`` bytes inside them. The examples are a bounded sample of labelled
documents (at most ``POSITIVES`` and ``NEGATIVES`` in order of a hash of the id, and ``SAMPLE_BYTES`` of text). Every
word of every example is a term, whichever its label; of the byte runs those whose chi-square with the label 1 is at
least ``CHI_SQUARE``, however many. A weight is the sublinear count times the inverse document frequency over all
documents times a factor for the label: ``chi / (chi + CHI_SQUARE)``, for words never below ``FLOOR``. Chi-square is taken
with one positive example less, so that no term speaks for the single example that brought it. Words that no example
holds add to the length of a vector with the frequency 0.

The index keeps the examples of each term in blocks of ``BLOCK`` with the largest weight of each block. Terms of at
least one example in ``COMMON`` are rows of a dense matrix instead, multiplied with many texts at once. A query adds the
largest weights of its other terms to the best product of each block, which bounds the block, scores the best
blocks first and then every block whose bound reaches the ``NEIGHBOURS``-th best: the nearest examples are exact. Cosines
count to twelve digits, ties go to the earlier example.

Each neighbour votes for its label with weight ``1 / (distance + SOFT)``; a logistic fit to the
leave-one-out votes of the examples, weighted back to the label shares of all labelled documents, turns
votes into probabilities. The three nearest examples are given as evidence.

Defined cases: texts without a word that an example holds, null and empty ones too, score the share of the label; without labelled rows,
or with one label only, every score is that share (0 without rows); conflicting labels of an id count as
1; null labels and null ids teach nothing; of the texts of one id the one with the smallest hash teaches; an example
too long for the rest of ``SAMPLE_BYTES`` is passed over, while texts of any length are scored whole; repeated documents
score alike. Extra columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.llm.tables import written
from flowguard.llm.textbytes import Powers, Words, pieces

GRAM = 6
POSITIVES, NEGATIVES = 2000, 4000
#: Bytes of text the examples may have together; bounds the vocabulary, the index and their broadcast.
SAMPLE_BYTES = 64 << 20
#: Chi-square with the label from which on a term counts as telling.
CHI_SQUARE = 13.0
#: Factor of a word that tells nothing.
FLOOR = 0.1
NEIGHBOURS = 15
BLOCK = 256
#: A term in one of so many examples has a dense row; at most COMMON times the mean terms of an example are such.
COMMON = 16
#: Texts that are multiplied with the dense rows at once.
TOGETHER = 256
SOFT = 0.02
CUTOFF = 0.3


def fold(doc_id: Column, parts: int) -> Column:
    """Fold of a document: CRC-32 of its id as text, modulo ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def sample_labels(labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> list[tuple[int, int]]:
    """A bounded sample of ``(doc_id, toxic)``, one row per id."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    out = []
    for label, most in ((1, positives), (0, negatives)):
        out += [(r.doc_id, label) for r in known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    return out


def sample_examples(docs: DataFrame, chosen: list[tuple[int, int]], most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``doc_id, toxic, text`` of the examples: one row per id, ``most_bytes`` of text in all, in order of a hash."""
    spark = docs.sparkSession
    side = spark.createDataFrame(chosen, "doc_id long, toxic int")
    given = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = given.join(F.broadcast(side), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = written(found, "toxicity-sample")
    sizes = found.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    room, kept = most_bytes, []
    for r in sizes:
        if r.n <= room:
            room -= r.n
            kept.append((r.doc_id,))
    if len(kept) == len(sizes):
        return found
    return found.join(F.broadcast(spark.createDataFrame(kept, "doc_id long")), "doc_id", "left_semi")


def _distinct(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts and terms of all distinct pairs, by text, with their counts."""
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    new = np.ones(len(term), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], term[at], np.diff(np.r_[at, len(term)])


def label_factor(with_term: np.ndarray, other: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """0 for terms that do not tell the label 1, else ``chi / (chi + CHI_SQUARE)``."""
    a, b, n = np.maximum(with_term - 1.0, 0.0), np.asarray(other, dtype=np.float64), float(n_pos + n_neg)
    cross = np.maximum(a * (n_neg - b) - b * (n_pos - a), 0.0)
    chi = n * cross * cross / np.maximum((a + b) * (n - a - b) * n_pos * n_neg, 1.0)
    return np.where(chi >= CHI_SQUARE, chi / (chi + CHI_SQUARE), 0.0)


class Vocabulary:
    """Sorted hashes of the words and byte runs that are terms, and the factor of each, words first."""

    def __init__(self, words, grams, factor):
        self.words, self.grams, self.factor = words, grams, factor

    def __len__(self) -> int:
        return len(self.factor)


def choose_terms(sampled: DataFrame, n_pos: int, n_neg: int) -> Vocabulary:
    """All words of the examples, and the byte runs that tell the label."""
    def run(batches):
        table = Powers()
        for batch in batches:
            label = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
            for a, _, data, offsets in pieces(batch, "text"):
                words = Words(data, offsets, table, letters=True)
                text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
                word, grams = words.byte_grams(GRAM)
                for kind, text, term in ((0, text_of, words.hash), (1, text_of[word], grams)):
                    text, term, _ = _distinct(text, term)
                    term, number = np.unique(term, return_inverse=True)
                    both, pos = np.bincount(number, minlength=len(term)), np.bincount(number, weights=label[a + text], minlength=len(term)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(term), kind)), pa.array(term.view(np.int64)), pa.array(pos), pa.array(both - pos)],
                        names=["kind", "term", "pos", "neg"])

    counted = sampled.select("text", "toxic").mapInArrow(run, "kind long, term long, pos long, neg long").groupBy("kind", "term").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # A byte run of a single positive example tells nothing by the rule above.
    # Arrow tables come to the driver without a Python object for each value.
    rows = counted.filter("kind = 0 or pos > 1").toArrow()
    factor = label_factor(rows["pos"].to_numpy(), rows["neg"].to_numpy(), n_pos, n_neg)
    kind, term = rows["kind"].to_numpy(), rows["term"].to_numpy().view(np.uint64)
    parts = []
    for which in (kind == 0, (kind == 1) & (factor > 0)):
        order = np.argsort(term[which])
        parts.append((term[which][order], factor[which][order]))
    (words, w), (grams, g) = parts
    return Vocabulary(words, grams, np.concatenate([FLOOR + (1 - FLOOR) * w, g]))


class Counter:
    """Counts of the terms in texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.table = vocabulary, Powers()
        self.door = np.zeros(1 << 16, dtype=bool)
        self.door[(vocabulary.grams >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, data, offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows ``(text, term, count)`` by text, and per text the squared sublinear counts of all other words."""
        words, v = Words(data, offsets, self.table, letters=True), self.vocabulary
        n_texts = len(offsets) - 1
        text_of = np.repeat(np.arange(n_texts), np.diff(words.first))
        text, hashes, count = _distinct(text_of, words.hash)
        at = np.minimum(np.searchsorted(v.words, hashes), max(len(v.words) - 1, 0))
        known = v.words[at] == hashes if len(v.words) else np.zeros(len(hashes), dtype=bool)
        rest = np.bincount(text[~known], weights=(1 + np.log(count[~known])) ** 2, minlength=n_texts)
        text, term, count = text[known], at[known], count[known]
        if len(v.grams):
            word, grams = words.byte_grams(GRAM)
            some = np.flatnonzero(self.door[(grams >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(v.grams, grams[some]), len(v.grams) - 1)
            same = v.grams[at] == grams[some]
            more = _distinct(text_of[word[some[same]]], len(v.words) + at[same])
            text, term, count = (np.concatenate(x) for x in zip((text, term, count), more))
            order = np.argsort(text, kind="stable")
            text, term, count = text[order], term[order], count[order]
        return text, term, count, rest


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents; at most one row per term and task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counter, total = Counter(shared.value), np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in batches:
            for a, b, data, offsets in pieces(batch, "text"):
                total[:-1] += np.bincount(counter(data, offsets)[1], minlength=len(total) - 1)
                total[-1] += b - a
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    rows = docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out[rows["i"].to_numpy()] = rows["n"].to_numpy()
    shared.destroy()
    return out[:-1], int(out[-1])


def vectors(text, term, count, rest, weight, unknown) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors ``(terms, weights)`` by text; empty for a text without words.

    ``weight`` is that of one occurrence of a term, ``unknown`` that of a word which is no term.
    """
    value = (1 + np.log(count)) * weight[term]
    cut = np.searchsorted(text, np.arange(len(rest) + 1))
    norm = np.sqrt(np.bincount(text, weights=value * value, minlength=len(rest)) + rest * unknown * unknown)
    out = []
    for d, length in enumerate(norm.tolist()):
        t, w = term[cut[d]: cut[d + 1]], value[cut[d]: cut[d + 1]]
        out.append((t, w / length if length else w))
    return out


class BlockMaxIndex:
    """Examples by term in blocks, with the largest weight of each term in each block that holds it."""

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.size = len(examples)
        self.blocks = -(-self.size // BLOCK)
        number = np.repeat(np.arange(self.size, dtype=np.int32), [len(t) for t, _ in examples])
        term = np.concatenate([t for t, _ in examples] or [np.zeros(0)]).astype(np.int32)
        weight = np.concatenate([w for _, w in examples] or [np.zeros(0)])
        held = np.bincount(term, minlength=n_terms)
        self.row = np.full(n_terms, -1, dtype=np.int32)
        common = np.flatnonzero(held * COMMON >= max(self.size, 1))
        self.row[common] = np.arange(len(common))
        in_row = self.row[term] >= 0
        self.entries = self.row[term[in_row]], number[in_row], weight[in_row]
        self.n_common, self._dense = len(common), None
        term, number, weight = term[~in_row], number[~in_row], weight[~in_row]
        order = np.lexsort((number, term))
        term, self.number, self.weight = term[order], number[order], weight[order]
        cell = term.astype(np.int64) * max(self.blocks, 1) + self.number // BLOCK
        self.start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        self.count = np.diff(np.r_[self.start, len(cell)])
        self.largest = np.maximum.reduceat(self.weight, self.start) if len(cell) else np.zeros(0)
        self.block = (self.number[self.start] // BLOCK).astype(np.int64)
        self.first = np.searchsorted(term[self.start], np.arange(n_terms + 1))

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}  # each worker fills its own

    def products(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms give each text with every example."""
        if self._dense is None:
            self._dense = np.zeros((self.n_common, self.size))
            self._dense[self.entries[0], self.entries[1]] = self.entries[2]
        x = np.zeros((len(texts), self.n_common))
        for i, (terms, weights) in enumerate(texts):
            row = self.row[terms]
            x[i, row[row >= 0]] = weights[row >= 0]
        return x @ self._dense

    @staticmethod
    def _spread(first, count):
        return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave_out: int = -1, product=None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest cosine, exactly; ties go to the smaller number.

        ``product`` is the text's row of ``products``, where that was made for many texts.
        """
        product = self.products([(terms, weights)])[0] if product is None else product
        rare = self.row[terms] < 0
        terms, weights = terms[rare], weights[rare]
        cells = self.first[terms + 1] - self.first[terms]
        cell, own = self._spread(self.first[terms], cells), np.repeat(weights, cells)
        block = self.block[cell]
        bounds = np.maximum.reduceat(product, np.arange(self.blocks) * BLOCK)
        bounds += np.bincount(block, weights=own * self.largest[cell], minlength=self.blocks)
        order = np.argsort(-bounds, kind="stable")
        # The first blocks hold more than k examples whichever is left out.
        begin = 1 + -(-(k + 1) // BLOCK)
        scores, best, todo = np.full(self.size, -1.0), -0.5, order[:begin]
        while len(todo):
            picked = np.zeros(self.blocks, dtype=bool)
            picked[todo] = True
            on = np.flatnonzero(picked[block])
            count = self.count[cell[on]]
            at = self._spread(self.start[cell[on]], count)
            got = product + np.bincount(self.number[at], weights=self.weight[at] * np.repeat(own[on], count), minlength=self.size)
            mine = np.repeat(picked, BLOCK)[: self.size]
            scores[mine] = np.round(got[mine], 12)
            if leave_out >= 0:
                scores[leave_out] = -1.0
            held = scores[scores >= best]
            best = np.partition(held, len(held) - k)[len(held) - k] if len(held) >= k else -0.5
            # A bound may round below a sum of the same products.
            todo = order[begin:][bounds[order[begin:]] + 1e-9 >= best]
            begin = self.blocks
        seen = np.flatnonzero(scores >= max(best, 0.0))
        top = seen[np.lexsort((seen, -scores[seen]))[:k]]
        return scores[top], top


def vote(labels: np.ndarray, similarity: np.ndarray, number: np.ndarray) -> float:
    """Share of the label 1 among neighbours, weighted by nearness."""
    weight = 1 / (1 - np.minimum(similarity, 1) + SOFT)
    return float((weight * labels[number]).sum() / weight.sum())


class NearestVotes:
    """The fitted scorer: index, labels, calibration."""

    def __init__(self, spark, vocabulary, weight, unknown, ids, labels, examples, share):
        self.vocabulary, self.weight, self.unknown, self.share = vocabulary, weight, unknown, share
        # Examples of one kind share blocks, which keeps the bounds of the other blocks low.
        order = sorted(range(len(ids)), key=lambda i: (
            examples[i][0][np.argmax(examples[i][1])] if len(examples[i][0]) else -1,
            examples[i][1].max() if len(examples[i][0]) else 0.0, ids[i]))
        self.ids, self.labels = [ids[i] for i in order], np.array([labels[i] for i in order], dtype=np.float64)
        own = [examples[i] for i in order]
        self.index = BlockMaxIndex(own, len(weight))
        self.a, self.b = 0.0, float("-inf")
        if 0 < share < 1 and len(own) > NEIGHBOURS:
            self._calibrate(self._own_votes(spark, own))

    def _own_votes(self, spark, own) -> np.ndarray:
        """Vote on each example by the others, made in tasks: the dense rows are too large for the driver."""
        cut = np.cumsum([0, *(len(t) for t, _ in own)])
        shared = spark.sparkContext.broadcast((
            self.index, self.labels, cut, np.concatenate([t for t, _ in own]).astype(np.int32), np.concatenate([w for _, w in own])))

        def run(batches):
            index, labels, cut, terms, weights = shared.value
            for batch in batches:
                numbers, votes = batch.column("id").to_numpy(), []
                for first in range(0, len(numbers), TOGETHER):
                    part = numbers[first: first + TOGETHER].tolist()
                    texts = [(terms[cut[i]: cut[i + 1]], weights[cut[i]: cut[i + 1]]) for i in part]
                    for i, x, product in zip(part, texts, index.products(texts)):
                        votes.append(vote(labels, *index.nearest(*x, NEIGHBOURS, i, product)) if len(x[0]) else 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(votes, pa.float64())], names=["id", "vote"])

        numbers = spark.range(0, len(own), 1, -(-len(own) // (4 * TOGETHER)))
        rows = numbers.mapInArrow(run, "id long, vote double").toArrow()
        shared.destroy()
        return rows.sort_by("id")["vote"].to_numpy()

    def _calibrate(self, votes) -> None:
        pos = self.labels.mean()
        weight = np.where(self.labels == 1, self.share / pos, (1 - self.share) / (1 - pos))
        x = np.stack([votes, np.ones(len(votes))], 1)
        beta = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (weight * (self.labels - p)) - 1e-2 * beta
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            beta = beta + np.linalg.solve(hess, grad)
        self.a, self.b = float(beta[0]), float(beta[1])

    def score(self, terms, weights, product=None):
        """Probability, neighbour similarities and numbers."""
        if not len(terms) or self.b == float("-inf"):
            return self.share, (), ()
        s, e = self.index.nearest(terms, weights, NEIGHBOURS, product=product)
        return float(1 / (1 + np.exp(-np.clip(self.a * vote(self.labels, s, e) + self.b, -30, 30)))), s, e


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> NearestVotes:
    """Learn from ``labels`` (``doc_id, toxic``) and the texts of these ids in ``docs`` (``doc_id, text``).

    The sample is bounded in rows and bytes, and with it what is broadcast and what comes back to the driver: the
    terms, one count per term, and the examples as sparse vectors.
    """
    spark = docs.sparkSession
    counts = {r.toxic: r["count"] for r in labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    sampled = sample_examples(docs, sample_labels(labels, positives, negatives))
    sizes = {r.toxic: r["count"] for r in sampled.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    none = np.zeros(0, dtype=np.uint64)
    vocabulary = choose_terms(sampled, n_pos, n_neg) if n_pos and n_neg else Vocabulary(none, none, np.zeros(0))
    df, total = document_frequencies(docs, vocabulary) if len(vocabulary) else (np.zeros(0), 0)
    weight = (np.log((total + 1) / (df + 1)) + 1) * vocabulary.factor
    unknown = (np.log(total + 1) + 1) * FLOOR
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            for a, b, data, offsets in pieces(batch, "text"):
                text, term, count, rest = counter(data, offsets)
                cut = np.searchsorted(text, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column("toxic")[a:b],
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(term, pa.int64())),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(count, pa.int64())), pa.array(rest, pa.float64())],
                    names=["doc_id", "toxic", "terms", "counts", "rest"])

    rows = sampled.select("doc_id", "toxic", "text").mapInArrow(
        run, "doc_id long, toxic int, terms array<long>, counts array<long>, rest double").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    shared.destroy()
    examples = [vectors(np.zeros(len(t), int), t.values.to_numpy(), c.values.to_numpy(), np.array([r]), weight, unknown)[0]
                for t, c, r in zip(rows["terms"], rows["counts"], rows["rest"].to_numpy())]
    ids, toxic = rows["doc_id"].to_pylist(), rows["toxic"].to_pylist()
    del rows
    return NearestVotes(spark, vocabulary, weight, unknown, ids, toxic, examples, share)


EVIDENCE = "array<struct<doc_id: long, similarity: double, label: int>>"


def _scan(model, batch, counter, seen):
    """Score and evidence of each text of a batch, in order."""
    for _, _, data, offsets in pieces(batch, "text"):
        found = vectors(*counter(data, offsets), model.weight, model.unknown)
        for first in range(0, len(found), TOGETHER):
            part = found[first: first + TOGETHER]
            keys = [blake2b(t.tobytes() + w.tobytes(), digest_size=16).digest() for t, w in part]
            if len(seen) > 5_000:
                seen.clear()
            new = {key: x for key, x in zip(keys, part) if key not in seen}
            for (key, x), product in zip(new.items(), model.index.products(list(new.values()))):
                p, s, e = model.score(*x, product)
                seen[key] = p, [{"doc_id": model.ids[j], "similarity": float(x), "label": int(model.labels[j])} for x, j in zip(s[:3], e[:3])]
            yield from (seen[key] for key in keys)


def score(docs: DataFrame, model: NearestVotes) -> DataFrame:
    """``doc_id, score, evidence`` of every row of ``docs`` (``doc_id, text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        counter, seen = Counter(model.vocabulary), {}
        for batch in batches:
            rows = list(_scan(model, batch, counter, seen))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([p for p, _ in rows], pa.float64()),
                 pa.array([e for _, e in rows], pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())])))],
                names=["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, score double, evidence {EVIDENCE}")


def drop_toxic(docs: DataFrame, model: NearestVotes, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``cutoff``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        counter, seen = Counter(model.vocabulary), {}
        for batch in batches:
            keep = [p < cutoff for p, _ in _scan(model, batch, counter, seen)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(fold(F.col("doc_id"), 4) != 2)
