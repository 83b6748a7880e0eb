"""URL filter: hosts split into words by unigram Viterbi, words scored by naive Bayes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._text import fresh, stash, table

#: Words that mark a page as an example of an unwanted one.
SEEDS = (
    "casino casinos poker gambling bet bets betting lottery jackpot slots roulette pills pharmacy viagra cialis "
    "porn xxx sex adult escort escorts spam ads adserver banner popup tracker clickbait malware warez torrent "
    "crack keygen loan loans payday replica scam phishing"
).split()
PLAIN = tuple("best blog cheap farm free mail news online shop site track web win".split())
#: Times that Viterbi must have seen a word, and letters that a word has at most.
LEAST, LONGEST = 2, 20
#: Words that a dictionary or a model may have to be sent to the executors; with more they are joined.
WORDS = 1_000_000
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)(?:\?([^#]*))?")
_TOKEN = re.compile(r"[^\W\d_]+")
_COMMON = frozenset(("www", "m", "com", "net", "org", "info", "biz", "html", "htm", "php", "http", "https"))


def split_url(url: str | None) -> tuple[str, str, str] | None:
    """Host in lower case, path and query; null where there is no host."""
    m = _URL.match(url.strip()) if url else None
    return (m[1].lower(), m[2] or "", m[3] or "") if m and m[1] else None


class Segmenter:
    """The likeliest split of a name into words, each word being drawn on its own."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        # A word never seen costs the more the longer it is.
        self.unseen = [math.log(total) + math.log(10) * n for n in range(LONGEST + 1)]
        self.known: dict[str, tuple[str, ...]] = {}

    def split(self, name: str) -> tuple[str, ...]:
        if name in self.known:
            return self.known[name]
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            low, at = math.inf, end - 1
            for begin in range(max(0, end - LONGEST), end):
                word = name[begin:end]
                cost = best[begin] + self.cost.get(word, self.unseen[end - begin])
                if cost < low:
                    low, at = cost, begin
            best.append(low)
            back.append(at)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[name] = tuple(reversed(out))
        return self.known[name]

    def host(self, host: str) -> list[str]:
        return [w for part in _TOKEN.findall(host) if part not in _COMMON for w in self.split(part)]


def path_words(path: str, query: str) -> list[str]:
    return [w for w in _TOKEN.findall(f"{path} {query}".lower()) if w not in _COMMON]


@dataclass
class UrlModel:
    """Log odds of a page's being unwanted: of the prior, of each host word and of each path word."""

    segmenter: Segmenter
    prior: float = 0.0
    odds: dict[str, float] = field(default_factory=dict)
    unseen: float = 0.0
    threshold: float = 0.0

    def words(self, url: str | None) -> tuple[str, list[str], list[str]] | None:
        parts = split_url(url)
        return (parts[0], self.segmenter.host(parts[0]), path_words(*parts[1:])) if parts else None

    def score(self, host: list[str], path: list[str]) -> float:
        return self.prior + sum(self.odds.get(f"h:{w}", self.unseen) for w in host) + sum(self.odds.get(f"p:{w}", 0.0) for w in path)


def host_pieces(urls: DataFrame) -> DataFrame:
    """(word): everything that could be a word of the hosts of urls."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = {found[0] for found in map(split_url, batch.column(0).to_pylist()) if found}
            yield pa.RecordBatch.from_arrays([pa.array({p for h in hosts for p in _TOKEN.findall(h)}, pa.string())], ["part"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {p[a:b] for p in batch.column(0).to_pylist() for a in range(len(p)) for b in range(a + 2, min(a + LONGEST, len(p)) + 1)}
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["word"])

    return urls.select("url").mapInArrow(parts, "part string").distinct().mapInArrow(pieces, "word string").distinct()


def word_table(pages: DataFrame, urls: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(word, n): all words of all pages' visible text and paths that are seen LEAST times, and the sum of their counts.

    Words have up to LONGEST letters. With urls, only words that occur in a host of pages or
    urls are given, as no other can be a part of one; the sum is still that of all. Seeds
    and a few plain words of hosts are added, so that they are words even where no page has them.
    """
    visible = F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&\w+;", " ")
    # A host's own name isn't evidence that it is one word.
    path = F.regexp_replace("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*|[?#].*$", " ")
    words = pages.select(F.explode(F.split(F.lower(F.concat_ws(" ", visible, path)), r"[^\p{L}]+")).alias("word"))
    size = F.char_length("word")
    counted = words.where((size > 1) & (size <= LONGEST)).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    counted = stash(counted.where(~F.col("word").isin(*_COMMON)), "url_words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    if urls is not None:
        counted = counted.join(host_pieces(pages.select("url").union(urls.select("url"))), "word", "left_semi")
    usual = max(LEAST, total // 100_000)
    own = (*SEEDS, *PLAIN)
    added = pages.sparkSession.createDataFrame([(w, usual) for w in own], "word string, n bigint")
    return counted.unionByName(added).groupBy("word").agg(F.sum("n").alias("n")), total + usual * len(own)


@dataclass
class UrlTables:
    """What UrlModel holds, for any number of words: counts (word, n) and odds (word, odds) are tables."""

    counts: DataFrame
    total: int
    odds: DataFrame
    prior: float
    threshold: float


def url_words(urls: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(url, host, words, path) of distinct URLs that have a host, split by a dictionary that is joined, not sent.

    Every part of a host gets the words of the dictionary that occur in it, and is split by those.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                found = split_url(url)
                if found:
                    rows.append({"url": url, "host": found[0], "path": path_words(*found[1:]), "parts": [p for p in _TOKEN.findall(found[0]) if p not in _COMMON]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("url", pa.string()), ("host", pa.string()), ("path", pa.list_(pa.string())), ("parts", pa.list_(pa.string()))]))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                words = sorted({p[a:b] for a in range(len(p)) for b in range(a + 2, min(a + LONGEST, len(p)) + 1)} | {p})
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(words), pa.string()), pa.array(words, pa.string())], ["part", "word"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Segmenter({w["word"]: w["n"] for w in known if w["n"]}, total).split(p) for p, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["part", "split"])

    cut = stash(urls.select("url").mapInArrow(parts, "url string, host string, path array<string>, parts array<string>"), "url_parts")
    each = cut.select("url", F.posexplode("parts").alias("pos", "part"))
    named = each.select("part").distinct().mapInArrow(pieces, "part string, word string").join(counts, "word", "left")
    named = named.groupBy("part").agg(F.collect_list(F.struct("word", "n")).alias("known")).mapInArrow(split, "part string, split array<string>")
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "split"))), lambda x: x["split"]))
    whole = each.join(named, "part").groupBy("url").agg(words.alias("words"))
    return cut.join(whole, "url", "left").select("url", "host", F.coalesce("words", F.array().cast("array<string>")).alias("words"), "path")


def train(pages: DataFrame, *, urls: DataFrame | None = None, label: str | None = None, smoothing: float = 0.5, threshold: float = 0.0, limit: int = WORDS) -> UrlModel | UrlTables:
    """Multinomial naive Bayes over the words of all pages' hosts and paths.

    label names a boolean column of pages that tells the unwanted ones; pages where it is
    null are no examples. Without it, a page whose host or path holds a seed word is an
    example of an unwanted page, any other of a wanted one; what is learnt from them then
    carries over to hosts and paths without a seed word. Every word counted has odds of its
    own. A dictionary or odds of more than limit words stay tables that are joined, with
    the same scores. Where no other URLs than those of pages and urls will be scored, urls
    spares the dictionary the words that none of their hosts holds. An empty table gives a
    model of seeds alone.
    """
    spark = pages.sparkSession
    counts, total = word_table(pages, urls)
    counts = stash(counts, "url_dictionary")
    small = counts.count() <= limit
    seeds = frozenset(SEEDS)
    examples = pages.select("url", (F.col(label) if label else F.lit(None)).cast("boolean").alias("label"))
    if label:
        examples = examples.where("label IS NOT NULL")
    if small:
        rows = counts.toArrow()
        segmenter = Segmenter(dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True)), total)
        sent = spark.sparkContext.broadcast(segmenter.cost)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = Segmenter({})
            mine.cost, mine.unseen = sent.value, segmenter.unseen
            for batch in batches:
                seen: Counter = Counter()
                for url, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    parts = split_url(url)
                    if parts:
                        host, path = mine.host(parts[0]), path_words(*parts[1:])
                        bad = known if known is not None else not seeds.isdisjoint(host) or not seeds.isdisjoint(path)
                        seen[("", bad)] += 1
                        seen.update((f"h:{w}", bad) for w in host)
                        seen.update((f"p:{w}", bad) for w in path)
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.string()), pa.array([b for _, b in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], ["word", "bad", "n"])

        each = examples.mapInArrow(count, "word string, bad boolean, n bigint")
    else:
        words = examples.join(url_words(examples.select("url").distinct(), counts, total), "url")
        said = F.arrays_overlap(F.concat("words", "path"), F.array(*map(F.lit, SEEDS)))
        tagged = F.concat(F.array(F.lit("")), F.transform("words", lambda w: F.concat(F.lit("h:"), w)), F.transform("path", lambda w: F.concat(F.lit("p:"), w)))
        each = words.select(F.explode(tagged).alias("word"), F.coalesce("label", said, F.lit(False)).alias("bad"), F.lit(1).alias("n"))
    sums = each.groupBy("word").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good"))
    sums = stash(sums, "url_counts")
    of = {r["kind"]: r for r in sums.groupBy(F.substring("word", 1, 1).alias("kind")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()}
    bads, goods = ((of[""]["bad"], of[""]["good"]) if "" in of else (0, 0))
    prior = math.log((bads + 1) / (goods + 1))
    odds = F.lit(0.0)
    for kind in "hp":
        if kind in of:
            b, g = (of[kind][x] + smoothing * of[kind]["n"] for x in ("bad", "good"))
            mine = F.log((F.col("bad") + smoothing) / b) - F.log((F.col("good") + smoothing) / g)
            odds = F.when(F.col("word").startswith(f"{kind}:"), mine).otherwise(odds)
    table_ = sums.where("word <> ''").select("word", odds.alias("odds"))
    if not small or sum(r["n"] for r in of.values()) > limit:
        return UrlTables(counts, total, table_, prior, threshold)
    rows = table_.toArrow()
    return UrlModel(segmenter, prior, dict(zip(rows["word"].to_pylist(), rows["odds"].to_pylist(), strict=True)), threshold=threshold)


def scored(url: Column, model: UrlModel, spark: SparkSession) -> Column:
    """struct<host, words, score, blocked> of a URL; null for null and where there is no host."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<host:string,words:array<string>,score:double,blocked:boolean>")
    def run(urls: pa.Array) -> pa.Array:
        m = sent.value
        rows = []
        for u in urls.to_pylist():
            found = m.words(u)
            if found is None:
                rows.append(None)
            else:
                host, words, path = found
                s = round(m.score(words, path), 9)
                rows.append({"host": host, "words": words, "score": s, "blocked": s > m.threshold})
        return pa.array(rows, pa.struct([("host", pa.string()), ("words", pa.list_(pa.string())), ("score", pa.float64()), ("blocked", pa.bool_())]))

    return run.asNondeterministic()(url)


def scored_by_join(urls: DataFrame, model: UrlTables) -> DataFrame:
    """(url, scored) of the distinct URLs of urls that have a host; scored is as the function of that name gives it."""
    words = stash(url_words(urls.select("url").where("url IS NOT NULL").distinct(), model.counts, model.total), "url_split")
    tagged = F.concat(F.transform("words", lambda w: F.concat(F.lit("h:"), w)), F.transform("path", lambda w: F.concat(F.lit("p:"), w)))
    sums = words.select("url", F.explode(tagged).alias("word")).join(model.odds, "word").groupBy("url").agg(F.sum("odds").alias("s"))
    score = F.round(F.coalesce("s", F.lit(0.0)) + model.prior, 9)
    return words.join(sums, "url", "left").select("url", F.struct("host", "words", score.alias("score"), (score > model.threshold).alias("blocked")).alias("scored"))


def filter_urls(pages: DataFrame, model: UrlModel | UrlTables, url: str = "url") -> DataFrame:
    """pages with host, host_words, spam_score and blocked (with underscores where pages has such names).

    A null URL, an empty one and one without a host have nulls and aren't blocked. Equal
    URLs are scored alike, to nine places; of equally likely splits the one with the
    longest last word counts; an empty table stays empty. Whole URLs are read, however long.
    """
    tmp = fresh(pages, "scored")
    if isinstance(model, UrlTables):
        key = fresh(pages, "scored_url")
        by = scored_by_join(pages.select(F.col(url).alias("url")), model).select(F.col("url").alias(key), F.col("scored").alias(tmp))
        out = pages.join(by, F.col(url) == F.col(key), "left").drop(key)
    else:
        out = pages.withColumn(tmp, scored(F.col(url), model, pages.sparkSession))
    for name, part in (("host", "host"), ("host_words", "words"), ("spam_score", "score"), ("blocked", "blocked")):
        value = F.col(f"{tmp}.{part}")
        out = out.withColumn(fresh(pages, name), F.coalesce(value, F.lit(False)) if name == "blocked" else value)
    return out.drop(tmp)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(table(sf_dir, "pages"))
    return filter_urls(pages.select("page_id", "url"), train(pages, urls=pages))
