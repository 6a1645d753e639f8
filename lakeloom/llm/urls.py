"""URL filters: host rules, then host word segmentation and naive Bayes.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest wins. Where none
fits, the labels of the host are split into words by a unigram Viterbi search, and a multinomial naive Bayes model scores the
words of host and path.

The unigram counts are those of all words of all pages. They stay in a table: the parts of a label that are as long as any counted
word are joined with it, and each label is split by the counts of its own parts. The model is trained on all urls: those whose
words of host or path hold one of ``BLOCK_WORDS`` or its plural are examples to block and the others examples to allow, so words that
go along with these count too. (The tables have no labels of urls, and the rules go by domain and language, which say nothing of content, so
urls that the rules decide aren't taken as examples.) Words of a path are split like those of a host and begin with ``/``. Its counts stay in a table as well, and the words of the urls are joined with it. Work on words is done once for urls of equal tokens.

Defined results: a null url, or one without ``://``, has empty host and path and no words, and is allowed by the prior; repeated rows
are judged each; null html adds no words; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import bounded_broadcast, cut, prepare_workers, task

#: Rules: verdict, host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words that mark an url as an example to block.
BLOCK_WORDS = ("adult", "bet", "casino", "cheap", "crack", "gambling", "hack", "loan", "loans", "malware", "nude", "phishing", "pills", "poker", "porn", "sex", "spam", "torrent", "viagra", "warez", "xxx")
#: Host labels that say nothing of the content.
_PLAIN_LABELS = frozenset(("www", "m", "blog", "com", "net", "org", "example"))
#: Words to block and their plurals.
_BLOCK = tuple(sorted({*BLOCK_WORDS, *(w + "s" for w in BLOCK_WORDS)}))
_TOKEN = re.compile(r"[^\W\d_]+|\d+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url_, instr(url_, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule like ``net/``, its verdict) or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a later one overrides
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


class Segmenter:
    """The most likely split of a name into words by their unigram counts, of ``total`` words in all. Letters that make up no counted
    word may be an unknown one of any length, at a cost for the word and for each letter."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) or 1
        self.cost = {w: math.log(total / n) for w, n in counts.items() if n > 0}
        self.lengths = sorted({len(w) for w in self.cost}, reverse=True)
        self.word, self.letter = math.log(total), math.log(10)

    def split(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        run, run_from = math.inf, 0  # the best split whose last word is unknown, and where that begins
        for end in range(1, len(name) + 1):
            if best[end - 1] + self.word < run:
                run, run_from = best[end - 1] + self.word, end - 1
            run += self.letter
            options = [(run, run_from)]
            for n in self.lengths:
                if n <= end and (cost := self.cost.get(name[end - n : end])) is not None:
                    options.append((best[end - n] + cost, end - n))
            cost, a = min(options)
            best.append(cost)
            back.append(a)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


def tokens_of(host: str, path: str) -> list[str]:
    """The tokens of a host's labels and of a path, which are split later; a number counts as ``#``."""
    out = [t for label in host.split(".") if label not in _PLAIN_LABELS for t in _TOKEN.findall(label)]
    return ["#" if t.isdigit() else t for t in out] + ["/#" if t.isdigit() else "/" + t for t in _TOKEN.findall(path.lower())]


def unigrams(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(w, n): the counts of all words of all pages (markup left out)."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"<[^>]*>", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("w")).filter("w <> ''")
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@task
def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, path = (batch.column(n).to_pylist() for n in ("host", "path"))
        tokens = [tokens_of(h, p) for h, p in zip(host, path, strict=True)]
        yield batch.append_column("tokens", pa.array(tokens, pa.list_(pa.string())))


@task
def _parts(lengths: tuple[int, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, w): the parts of each token that may be a word."""
    for batch in batches:
        for t in batch.column(0).to_pylist():
            for low in range(0, len(t), 1000):
                parts = sorted({t[a : a + n] for n in lengths for a in range(low, min(low + 1000, len(t) - n + 1))})
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(parts), pa.string()), pa.array(parts, pa.string())], names=["token", "w"])


@task
def _split(total: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        token, known = (batch.column(i).to_pylist() for i in (0, 1))
        words = [Segmenter({k["w"]: k["n"] for k in ks or ()}, total).split(t) for t, ks in zip(token, known, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["token", "split"])


def splits(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, split): the words of each of the distinct ``tokens`` by all of ``counts``."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # as many lengths as there are different ones among all words
    lengths = tuple(sorted(r["n"] for r in counts.select(F.length("w").alias("n")).distinct().collect()))
    known = tokens.mapInArrow(lambda it: _parts(lengths, it), "token string, w string").distinct().join(counts, "w").groupBy("token").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    return tokens.join(known, "token", "left").mapInArrow(lambda it: _split(total, it), "token string, split array<string>")


def log_odds(worded: DataFrame) -> tuple[float, DataFrame]:
    """The prior log odds of block against allow, and (w, odds) of all words of ``worded`` (block, n, words)."""
    urls = {r["block"]: r["n"] for r in worded.groupBy("block").agg(F.sum("n").alias("n")).collect()}
    each = worded.select("block", "n", F.explode("words").alias("w"))
    counts = cut(each.groupBy("w").agg(F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(~F.col("block"), F.col("n")).otherwise(0)).alias("a")), "url-counts")
    all_ = counts.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("size")).first()
    share = lambda c: F.log((F.col(c) + 1) / F.lit(float(all_[c] + all_["size"] + 1)))
    return math.log((urls.get(True, 0) + 0.5) / (urls.get(False, 0) + 0.5)), counts.select("w", (share("b") - share("a")).alias("odds"))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per row of ``pages``: ``page_id, host, path, rule, verdict, score`` (the model's log odds of block) and ``words``."""
    spark = pages.sparkSession
    prepare_workers(spark)
    url = F.col("url_")
    host, path = host_and_path(url)
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url_")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    judged = cut(judged.mapInArrow(_tokens, "page_id long, host string, path string, rule string, by_rule string, tokens array<string>"), "url-tokens")
    lists = cut(judged.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).withColumn("list", F.monotonically_increasing_id()), "url-lists")

    # the words of each list of tokens
    each = lists.select("list", F.posexplode("tokens").alias("at", "t"))
    sign = F.when(F.startswith("t", F.lit("/")), "/").otherwise("")
    each = each.select("list", "at", sign.alias("sign"), F.ltrim("t", F.lit("/")).alias("token"))
    names = cut(each.filter("token <> '#'").select("token").distinct(), "url-names")
    split = bounded_broadcast(cut(splits(names, cut(unigrams(pages, html_col), "unigrams")), "url-splits"))
    own = each.join(split, "token", "left").select("list", "at", F.transform(F.coalesce("split", F.array("token")), lambda w: F.concat("sign", w)).alias("own"))
    joined = own.groupBy("list").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "own"))), lambda x: x["own"])).alias("words"))
    words = F.coalesce("words", F.array().cast("array<string>"))
    block = F.exists(words, lambda w: F.ltrim(w, F.lit("/")).isin(*_BLOCK))
    worded = cut(lists.join(joined, "list", "left").select("list", "tokens", "n", words.alias("words"), block.alias("block")), "url-words")

    prior, odds = log_odds(worded)
    odds = bounded_broadcast(cut(odds, "url-odds"))
    each = worded.select("list", F.posexplode("words").alias("at", "w")).join(odds, "w")
    gains = each.groupBy("list").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("at", "odds"))), F.lit(0.0), lambda s, x: s + x["odds"]).alias("gain"))
    scored = worded.join(gains, "list", "left").select("tokens", "words", (F.lit(prior) + F.coalesce("gain", F.lit(0.0))).alias("score"))
    scored = bounded_broadcast(cut(scored, "url-scores"))
    verdict = F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.join(scored, "tokens").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "words")
