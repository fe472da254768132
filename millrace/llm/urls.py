"""URL filters (6): rules, then host word segmentation and naive Bayes.

Rules are (host, path, verdict): a rule fits its host and all subdomains if the
url's path starts with the rule's path; the longest fitting rule decides. Every
other url is judged by words: each host label and path part is split into words
by unigram Viterbi over the whole words of a public vocabulary, and multinomial
naive Bayes, trained on the labelled hosts of url_examples, scores the words of
host and path. A url without words gets the prior of that set, which allows.

The labels of a host that name a service (SERVICES: www, m, blog, ...) tell
nothing of whose it is, and stand on any host; they do not count.

Host: after the first :// up to /, ? or # or the end, A-Z lower-cased; path:
from there up to ? or # or the end; null or without ://: both empty. Defined results: a null or empty url has no host,
path, rule and words and is allowed; repeated rows are judged each; an empty
table gives no rows.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import url_examples
from .jobs import map_batches
from .tokens import load_vocabulary

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Words of web addresses by falling frequency; one at rank r, here or among the vocabulary's words, has log-probability -log(r + 10).
LEXICON = """
the and of to in www com net org blog news shop online home free web site page forum wiki info mail store home
article index about search images photo video music game games sport sports travel food health school science
library research university book books review reviews guide help learn history world local city weather market
bank money casino poker bet bets betting slots jackpot porn sex adult xxx nude cam cams escort dating viagra pills
pharmacy cheap discount deal deals replica loan loans payday credit crypto bitcoin win winner prize lottery spam farm
click clicks ads ad traffic seo link links hack crack warez torrent keygen download best top now
garden music art design build code data docs open source project team lab press radio green river mountain house
fr de en es it pt feed utm tag user post archive category html php
casinos gambling roulette baccarat blackjack bingo lotto sweepstakes bookmaker bookmakers hookup hookups bdsm milf hentai slut sluts escorts
erotica swingers blowjob boobs pussy cialis levitra xanax valium tramadol oxycontin ambien phentermine enlargement replicas knockoffs counterfeit
rolex forex ponzi cheats keygens torrents pirated nulled phishing spyware malware ransomware carding carders clickbait backlinks
geology archaeology genealogy quilting literacy children encyclopedia
""".split()
#: Words that stand in any url and tell nothing of it, as single letters do.
NEUTRAL = frozenset("www com net org example m en fr de es it pt html php index page utm the and of to in".split())
#: First labels of hosts that name a service, not a site.
SERVICES = frozenset("www m mobile blog blogs shop store news forum wiki mail static cdn img media en fr de es".split())
SCHEMA = "page_id long, host string, path string, rule string, verdict string, words array<string>, block_log_odds double"
_PART = re.compile(r"[^\W_]+")
_RUN = re.compile(r"[^\W\d_]+|\d+")


def split_url(url: str | None) -> tuple[str, str]:
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def match_rule(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """The longest fitting rule, as host + path, and its verdict."""
    fitting = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fitting)[1:] if fitting else None


@lru_cache(1)
def lexicon() -> tuple[dict[str, float], int]:
    """Log-probabilities of the words of LEXICON and the vocabulary (pieces of three letters and more after a space, by rank), the better of both."""
    whole = (p[1:].decode() for p in load_vocabulary() if re.fullmatch(rb" [A-Za-z]{3,}", p))
    ranks: dict[str, int] = {}
    for words in (LEXICON, dict.fromkeys(w.lower() for w in whole)):
        for r, w in enumerate(dict.fromkeys(words)):
            ranks[w] = min(ranks.get(w, r), r)
    return {w: -math.log(r + 10) for w, r in ranks.items()}, max(map(len, ranks))


def segment(text: str, words: tuple[dict[str, float], int] | None = None) -> list[str]:
    """Words of a run of letters with the best unigram probability; letters in no word cost more than any and stay together."""
    known, longest = words or lexicon()
    unknown = -math.log(len(known) + 10) - 4
    best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
    for end in range(1, len(text) + 1):
        choice = (best[end - 1][0] + unknown, end - 1, False)
        for start in range(max(0, end - longest), end):
            if (p := known.get(text[start:end])) is not None and (s := best[start][0] + p) > choice[0]:
                choice = (s, start, True)
        best.append(choice)
    out, end, loose = [], len(text), len(text)
    while end:
        _, start, is_word = best[end]
        if is_word:
            if loose > end:
                out.append(text[end:loose])
            out.append(text[start:end])
            loose = start
        end = start
    if loose:
        out.append(text[:loose])
    return out[::-1]


def url_words(host: str, path: str, words: tuple[dict[str, float], int] | None = None) -> list[str]:
    """Host words (without the last label), then path words, segmented."""
    labels = host.split(":")[0].split(".")
    while len(labels) > 2 and labels[0] in SERVICES:
        labels.pop(0)
    parts = [*labels[:-1], *_PART.findall(path.lower())]
    return [w for p in parts for run in _RUN.findall(p.lower()) if not run.isdigit() for w in segment(run, words)]


def learn(wanted: list[list[str]], unwanted: list[list[str]]) -> tuple[dict[str, float], float]:
    """Log-odds of block by word, add-one smoothed over the examples' words and one unseen word; the examples' own prior."""
    seen = [Counter(w for words in side for w in words if len(w) > 1 and w not in NEUTRAL) for side in (wanted, unwanted)]
    size = len(seen[0] | seen[1]) + 1
    total = [sum(c.values()) + size for c in seen]
    odds = {w: math.log((seen[1][w] + 1) / total[1]) - math.log((seen[0][w] + 1) / total[0]) for w in seen[0] | seen[1]}
    return odds, math.log(len(unwanted) / len(wanted))


@lru_cache(1)
def bayes() -> tuple[dict[str, float], float]:
    return learn(*([segment(host) for host in side.split()] for side in (url_examples.WANTED, url_examples.UNWANTED)))


def block_odds(words: list[str], learnt: tuple[dict[str, float], float] | None = None) -> float:
    odds, prior = learnt or bayes()
    return prior + sum(odds.get(w, 0.0) for w in words)


def _judge(batch: pa.RecordBatch, known: tuple[dict[str, float], int], learnt: tuple[dict[str, float], float]) -> Iterator[pa.RecordBatch]:
    rows = []
    for url in batch.column(1).to_pylist():
        host, path = split_url(url)
        rule = match_rule(host, path)
        words = url_words(host, path, known)
        odds = block_odds(words, learnt)
        rows.append((host, path, rule and rule[0], rule[1] if rule else "block" if odds > 0 else "allow", words, odds))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.float64()]
    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], ["page_id", "host", "path", "rule", "verdict", "words", "block_log_odds"])


def judge_urls(pages: DataFrame) -> DataFrame:
    """Host, path, rule, verdict, words and the log-odds of block of every page's url; rows stay where they are."""
    shared = pages.sparkSession.sparkContext.broadcast((lexicon(), bayes()))  # a fixed size; the vocabulary file is the driver's
    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")), lambda batch: _judge(batch, *shared.value), SCHEMA)
