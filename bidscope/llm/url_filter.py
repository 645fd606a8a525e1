"""URL filter: longest-fit rules, and naive Bayes over segmented words elsewhere.

A rule fits a url if the url's host is the rule's host or below it and the
url's path starts with the rule's path; the longest rule decides.

Urls without a rule are scored by multinomial naive Bayes, trained on all
urls that a rule decides, with an even prior. Its words come from host labels
and path tokens: every distinct letter run is segmented by a unigram Viterbi
search, with word counts gathered from the visible words of all pages. Runs of
digits are one token ``0``. Tokens that the rules themselves consist of are
left out: they only tell which rule made the label.

Pages are first grouped by their token signature, so training and scoring
work on distinct signatures with counts, and a host with a third of all pages
is a single row. Word counts meet the letter runs by a join on substrings; no
vocabulary is broadcast.

Defined cases: null urls and urls without ``://`` have empty host and path,
no rule and no tokens, and ties allow; repeated rows
give a row each; an empty table gives an empty result; without any page that
a rule decides, all else is allowed.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import drop, stored

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MAX_WORD = 24


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), *_AZ), part(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Letter runs, lower-cased, and ``0`` for each run of digits."""
    text = F.lower(F.concat_ws("/", host, path))
    return F.array_remove(F.split(F.regexp_replace(F.regexp_replace(text, r"\d+", " 0 "), r"[^\p{L}0]+", " "), " "), "")


def rule_tokens(rules: Sequence[tuple[str, str]]) -> list[str]:
    return sorted({t for _, text in rules for t in re.findall(r"[^\W\d_]+", text.lower())})


def segment(run: str, counts: dict[str, int], total: int) -> list[str]:
    """Most probable split into words; an unseen word of n letters counts 10 / 10**n."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        options = []
        for start in range(max(0, end - MAX_WORD), end):
            word = run[start:end]
            p = counts.get(word)
            cost = math.log(p / total) if p else math.log(10.0 / max(total, 1)) - len(word) * math.log(10.0)
            options.append((best[start][0] + cost, start))
        best.append(max(options))
    out, end = [], len(run)
    while end:
        out.append(run[best[end][1]:end])
        end = best[end][1]
    return out[::-1]


def page_words(pages: DataFrame, page: str) -> DataFrame:
    """(word, n): visible words of all pages, lower-cased."""
    visible = F.regexp_replace(F.regexp_replace(F.col(page), r"(?s)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " ")
    words = F.split(F.regexp_replace(F.lower(visible), r"[^\p{L}]+", " "), " ")
    return (pages.select(F.explode(words).alias("word")).where(F.length("word").between(1, MAX_WORD))
            .groupBy("word").agg(F.count("*").alias("n")))


def segments(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(token, words) for distinct tokens, by the unigram counts of ``words``."""
    total = words.agg(F.sum("n")).first()[0] or 1
    at = F.sequence(F.lit(1), F.length("token"))
    substrings = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("token") - i + 1)), lambda n: F.substring(F.col("token"), i, n))))
    found = (runs.select("token", F.explode(F.array_distinct(substrings)).alias("word")).join(words, "word")
             .groupBy("token").agg(F.collect_list(F.struct("word", "n")).alias("known")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            split = [["0"] if t == "0" else segment(t, {} if k is None else {x["word"]: x["n"] for x in k}, total) for t, k in zip(b["token"], b["known"])]
            yield pd.DataFrame({"token": b["token"], "words": split})

    return runs.join(found, "token", "left").mapInPandas(run, "token string, words array<string>")


def judge(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html",
          rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Per page row: ``page_id, host, path, rule, verdict, score`` (score: log odds of block, null under a rule)."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    made_of = rule_tokens(rules)
    own = F.filter(tokens(F.col("host"), F.col("path")), lambda t: ~t.isin(made_of))
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("signature", F.concat_ws(" ", own))
    rows = stored(rows, "url-rows")
    one = lambda v: F.sum(F.when(F.col("ruled") == v, 1).otherwise(0))
    signatures = rows.groupBy("signature").agg(one("block").alias("block"), one("allow").alias("allow"), F.count(F.when(F.col("ruled").isNull(), 1)).alias("open"))
    of_token = signatures.select("signature", "block", "allow", "open", F.explode(F.split("signature", " ")).alias("token")).where("token <> ''")
    words = stored(page_words(pages, page), "url-words")
    split = stored(segments(of_token.select("token").distinct(), words), "url-segments")
    drop(words)
    bag = of_token.join(split, "token").select("signature", "block", "allow", "open", F.explode("words").alias("word"))
    counts = bag.groupBy("word").agg(F.sum("block").alias("b"), F.sum("allow").alias("a"))
    sums = counts.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    known = bool(signatures.agg(F.max("block")).first()[0])
    n_b, n_a, v = sums["b"] or 0, sums["a"] or 0, sums["v"] or 1
    odds = (F.log((F.col("b") + 1) / F.lit(float(n_b + v))) - F.log((F.col("a") + 1) / F.lit(float(n_a + v))))
    weight = counts.select("word", odds.alias("weight"))
    # stored, so that the join knows its size and can split a signature that many pages share
    scored = stored(bag.where("open > 0").join(weight, "word").groupBy("signature").agg(F.sum("weight").alias("sum")), "url-scores")
    out = rows.join(scored, "signature", "left")
    score = F.round(F.coalesce(F.col("sum"), F.lit(0.0)), 9)
    blocked = (score > 0) if known else F.lit(False)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
                      F.when(F.col("ruled").isNull(), score).alias("score"))
