"""Url filter: host names split into words, scored with the path by naive Bayes, under allow and block rules.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path goes
on up to ``?``, ``#`` or the end. Host names run words together, so every run of letters in a host is split by
Viterbi into the words that are most probable one by one: a word's probability is its share of the words of all
pages, a word of ``LEXICON`` has ``LEXICON_SHARE`` on top, and an unknown run of L letters ``10 ** -L`` of one word's
share. The words that a page needs are found by a join of all parts of all hosts with the counts, so neither hosts
nor counts have to fit anywhere.

Words of the host and of the path make an example, a number counting as ``#``. Examples with a word of
``BLOCK_WORDS`` teach the multinomial naive Bayes what to block, all others what to allow; each distinct example
counts once. So hosts that share other words with blocked ones are blocked too. A rule that fits goes before the score.

Defined cases: a null url, or one without ``://``, has empty host and path, no words and only the prior; null pages
count no words; if one of the two classes has no example every score is the prior, 0.5 without any url; equal scores
do not block; splits of equal probability take fewer words, then a shorter last one; runs of over ``RUN`` letters are
cut there before they are split, and a word has at most ``WORD`` letters. Ids are only passed on, repeated rows are
judged alike, extra columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.llm.tables import written
from flowguard.session import sized_side


class Rule(NamedTuple):
    """Fits the host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

#: Words that mark an example as one to block.
BLOCK_WORDS = (
    "adult", "bet", "bets", "betting", "casino", "gambling", "jackpot", "payday", "pills", "poker", "porn", "sex",
    "slots", "spam", "tracker", "track", "viagra", "warez", "xxx",
)
#: Words that host names are made of whether pages use them or not.
LEXICON = BLOCK_WORDS + (
    "ads", "app", "art", "auto", "bank", "best", "blog", "book", "books", "buy", "car", "cheap", "city", "click", "cloud",
    "club", "code", "daily", "data", "deal", "deals", "download", "farm", "fashion", "film", "finance", "food", "forum",
    "free", "game", "games", "gift", "girls", "global", "group", "health", "home", "hot", "hotel", "house", "info", "job",
    "jobs", "land", "law", "life", "link", "links", "live", "loan", "loans", "mail", "market", "media", "money", "movie",
    "music", "net", "network", "news", "now", "office", "online", "park", "pay", "phone", "photo", "play", "press", "prize",
    "real", "sale", "school", "search", "shop", "site", "soft", "sport", "sports", "star", "store", "studio", "super", "tech",
    "time", "top", "travel", "tube", "video", "web", "wiki", "win", "work", "world", "zone",
)
LEXICON_SHARE = 1e-4
RUN, WORD = 63, 24
TOKENS = r"\p{L}+|[0-9]+"
NUMBER = "#"


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equally long ones that of the longer host), else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, r.host + r.path).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def page_words(html: Column) -> Column:
    """Lower-case runs of letters outside of tags."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(html, "<[^<>]*>", " ")), F.lit(r"\p{L}+"), F.lit(0))


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``word, n`` over all pages."""
    words = pages.where(F.col(html_col).isNotNull()).select(F.explode(page_words(F.col(html_col))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_run(run: str, known: dict[tuple[int, int], int], total: int, lexicon: frozenset[str]) -> list[str]:
    """The most probable words of ``run``; ``known`` has the counts of its parts by start and length."""
    total = max(total, 10)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # cost, words, start of the last one
    for end in range(1, len(run) + 1):
        options = []
        for start in range(max(0, end - WORD), end):
            share = known.get((start, end - start), 0) / total + LEXICON_SHARE * (run[start:end] in lexicon)
            cost = -math.log10(share) if share else math.log10(total) + end - start
            # Rounded, so that equal products in another order are equal.
            options.append((round(best[start][0] + cost, 9), best[start][1] + 1, -start))
        cost, words, start = min(options)
        best.append((cost, words, -start))
    words, end = [], len(run)
    while end:
        words.append(run[best[end][2]: end])
        end = best[end][2]
    return words[::-1]


def split_runs(runs: DataFrame, counts: DataFrame, total: int, lexicon: tuple[str, ...] = LEXICON) -> DataFrame:
    """``run, words`` of the distinct letter runs in ``run``."""
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(WORD), F.length("run") - F.col("start") + 1)))
    parts = starts.select("run", "start", size.alias("size")).withColumn("word", F.substring("run", F.col("start"), F.col("size")))
    known = parts.join(counts, "word").groupBy(F.col("run").alias("_run")).agg(
        F.collect_list(F.struct("start", "size", "n")).alias("known"))
    words = frozenset(lexicon)

    def split(batches):
        for batch in batches:
            out = []
            for run, known in zip(batch.column("run").to_pylist(), batch.column("known").to_pylist()):
                out.append(split_run(run, {(k["start"] - 1, k["size"]): k["n"] for k in known or ()}, total, words))
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(out, pa.list_(pa.string()))], names=["run", "words"])

    met = runs.join(known, F.col("run") == F.col("_run"), "left").select("run", "known")
    return met.mapInArrow(split, "run string, words array<string>")


def _numbers(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), NUMBER).otherwise(t))


def split_hosts(hosts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``host, words`` of the distinct hosts in ``host``, numbers as ``#``."""
    runs = F.regexp_extract_all("host", F.lit(rf"\p{{L}}{{1,{RUN}}}|[0-9]+"), F.lit(0))
    placed = written(hosts.select("host", F.posexplode(_numbers(runs)).alias("at", "run")), "hostwords-runs")
    letters = written(placed.select("run").where(F.col("run") != NUMBER).distinct(), "hostwords-distinct")
    split = split_runs(letters, counts, total).unionByName(
        hosts.sparkSession.createDataFrame([(NUMBER, [NUMBER])], "run string, words array<string>"))
    whole = placed.join(split, "run").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("w"))
    return whole.select("host", F.flatten("w.words").alias("words"))


def fit(examples: DataFrame, block_words: tuple[str, ...] = BLOCK_WORDS) -> tuple[DataFrame, float]:
    """``token, weight`` of the naive Bayes from written ``examples`` (``words``), and the prior, as log odds of blocking."""
    marked = examples.select("words", F.arrays_overlap("words", F.array(*map(F.lit, block_words))).alias("bad"))
    n_bad, n_all = marked.agg(F.count_if("bad"), F.count(F.lit(1))).first()
    counts = marked.select("bad", F.explode("words").alias("token")).groupBy("token").agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    counts = written(counts, "hostwords-tokens")
    bad, good, kinds = counts.agg(F.sum("bad"), F.sum("good"), F.count(F.lit(1))).first()
    prior = math.log((n_bad + 1) / (n_all - n_bad + 1))
    if not n_bad or n_bad == n_all:
        return counts.select("token", F.lit(0.0).alias("weight")).limit(0), prior
    weight = F.log((F.col("bad") + 1) / F.lit(float(bad + kinds))) - F.log((F.col("good") + 1) / F.lit(float(good + kinds)))
    return counts.select("token", weight.alias("weight")), prior


def scored(examples: DataFrame, weights: DataFrame, prior: float) -> DataFrame:
    """``example, words, score``: the probability of blocking, from written ``examples`` (``example, words``)."""
    token = sized_side(weights)
    sums = examples.select("example", F.explode("words").alias("token")).join(token, "token").groupBy(
        F.col("example").alias("_e")).agg(F.round(F.sum("weight"), 9).alias("_w"))
    odds = F.coalesce(F.col("_w"), F.lit(0.0)) + prior
    met = examples.join(sums, F.col("example") == F.col("_e"), "left")
    return met.select("example", "words", F.round(1 / (1 + F.exp(-odds)), 6).alias("score"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, score, words`` of every row."""
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_tokens", _numbers(F.regexp_extract_all(F.lower("path"), F.lit(TOKENS), F.lit(0))))
    # Equal hosts with equal path tokens are one example.
    rows = rows.withColumn("example", F.concat_ws(" ", "host", F.array_join("_tokens", " ")))
    counts = written(word_counts(pages, html_col), "hostwords-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    kinds = written(rows.groupBy("example").agg(F.first("host").alias("host"), F.first("_tokens").alias("_tokens")), "hostwords-kinds")
    hosts = split_hosts(kinds.select("host").distinct(), counts, total).withColumnRenamed("host", "_host")
    words = F.concat(F.coalesce("words", F.array().cast("array<string>")), "_tokens")
    examples = written(kinds.join(hosts, F.col("host") == F.col("_host"), "left").select("example", words.alias("words")), "hostwords-examples")
    weights, prior = fit(examples)
    result = written(scored(examples, weights, prior), "hostwords-scores").withColumnRenamed("example", "_example")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    met = rows.join(sized_side(result), F.col("example") == F.col("_example"), "left")
    by_score = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return met.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_score).alias("verdict"), "score", "words")
