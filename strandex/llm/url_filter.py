"""URL filter: allow and block rules, and where none fits, logistic regression on hashed character n-grams.

Grams of 3 to 5 bytes of "^host/path$" are hashed to 2**BITS weights by a rolling polynomial; a URL's score is the sum
of its grams' weights over the root of their number, plus a bias. The weights are fitted on the driver from a small
labelled table (some hundreds of URLs, made by the rule below) and travel with the task: their size is fixed.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule, and is allowed by the
method; equal URLs get equal verdicts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
GRAMS = (3, 4, 5)
ROUNDS = 2000
RATE, DECAY = 7.0, 1e-5

# Words of the labelled table: hosts made of the first are unwanted, of the second wanted.
BLOCK_WORDS = """spam farm cheap pills casino poker bets jackpot slots viagra pharma meds replica watches
payday loans warez torrent crack keygen porn xxx adult escort nude lottery winner prize clickbait
adserver popup tracker malware phish scam hack free-money get-rich miracle diet bitcoin-doubler giveaway""".split()
ALLOW_WORDS = """news wiki docs library university museum archive journal science history health school
garden recipes travel weather sports music books forum blog support developer research city council
theatre physics biology math language market community project tools data maps radio photo""".split()
TOPS = "example.com example.net example.org site.io pages.info".split()
PATHS = ["/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}#top", "/en/{n}?page=2", "/{n}", "/", ""]


def labelled_urls() -> list[tuple[str, str, int]]:
    """The labelled table: (host, path, 1 to block). Wanted hosts also come as invented names, so that an unknown name is no ground to block."""
    rows = []
    for words, label in ((BLOCK_WORDS, 1), (ALLOW_WORDS, 0)):
        for k, word in enumerate(words):
            names = [word, f"{word}-{words[(k + 1) % len(words)]}", f"{words[(k + 5) % len(words)]}{word}"]
            rows += [(f"{('www.', 'm.', 'blog.', '')[(k + j) % 4]}{name}.{TOPS[(k + j) % len(TOPS)]}", PATHS[(k + 3 * j) % len(PATHS)].format(n=37 * k + j), label) for j, name in enumerate(names)]
    syllables = "th er on an re ti in ha es ou le st ed nd en at it is or as".split()
    rows += [(f"{('www.', 'm.', 'blog.', '')[k % 4]}{syllables[k % 20]}{syllables[7 * k % 20]}{syllables[11 * k % 19]}.{TOPS[k % len(TOPS)]}", PATHS[k % len(PATHS)].format(n=91 * k), 0) for k in range(200)]
    return rows


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed grams of all URLs in one pass over their joined bytes: (bucket of each gram, number of its URL)."""
    data = np.frombuffer(b"\0".join([*urls, b""]), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(urls)), [len(u) + 1 for u in urls])
    buckets, owners = [], []
    base = np.uint64(0x9E3779B97F4A7C15)
    for n in GRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        rolled = np.full(m, n, dtype=np.uint64)
        whole = np.ones(m, dtype=bool)
        for j in range(n):
            rolled = rolled * base + data[j : j + m]
            whole &= data[j : j + m] != 0
        rolled ^= rolled >> np.uint64(29)
        rolled *= base
        buckets.append((rolled >> np.uint64(64 - BITS))[whole].astype(np.int64))
        owners.append(owner[:m][whole])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def _spelled(host: str, path: str) -> bytes:
    return f"^{host}{path or '/'}$".encode().replace(b"\0", b"")


def scores(urls: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability that each URL is to be blocked."""
    bucket, owner = grams(urls)
    n = np.bincount(owner, minlength=len(urls))
    total = np.bincount(owner, weights[bucket], minlength=len(urls))
    return 1 / (1 + np.exp(-(bias + total / np.sqrt(np.maximum(n, 1)))))


@lru_cache(maxsize=1)
def train() -> tuple[np.ndarray, float]:
    """Weights and bias, by full-batch gradient descent on the labelled table: the same on every run."""
    rows = labelled_urls()
    urls = [_spelled(h, p) for h, p, _ in rows]
    y = np.array([label for *_, label in rows], dtype=float)
    bucket, owner = grams(urls)
    scale = 1 / np.sqrt(np.bincount(owner, minlength=len(urls)))
    weights, bias = np.zeros(1 << BITS), 0.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(bias + np.bincount(owner, weights[bucket], minlength=len(urls)) * scale)))
        error = (p - y) / len(urls)
        weights -= RATE * (np.bincount(bucket, (error * scale)[owner], minlength=1 << BITS) + DECAY * weights)
        bias -= RATE * error.sum()
    return weights, bias


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty where it is null or has no "://"."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as (rule, verdict), or null. A rule is a host, with its subdomains, and the start of a path."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest outermost
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, score): a rule's verdict, else block where score, the method's, is over the threshold."""
    weights, bias = train()
    small = weights.astype(np.float32)

    def run(hosts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in hosts:
            yield pd.Series(scores([_spelled(h, p) for h, p in zip(host, path, strict=True)], small, bias))

    score = F.pandas_udf(run, "double")
    host, path = host_and_path(pages[url_col])
    parts = pages.select(pages[id_col], host.alias("host"), path.alias("path"))
    judged = parts.withColumn("score", F.when((F.col("host") == "") & (F.col("path") == ""), F.lit(0.0)).otherwise(score("host", "path"))).withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return judged.select(id_col, "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), method).alias("verdict"), "score")
