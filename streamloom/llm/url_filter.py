"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, packed, source_columns, table

#: The rules, a host with a path that the url's path starts with, and the verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Words of hosts that a crawl is better without, and of ordinary hosts, for the labelled urls.
BAD_WORDS = (
    "ad ads adult banner bet bets betting bonus cam cams casino cheap click clicks coupon crack dating deal "
    "deals download escort farm fast free hot jackpot keygen loan loans lottery mp3 nude pills poker popup porn "
    "prize promo rich replica serial sex sexy slots spam tracker track tracking torrent viagra warez win winner x xxx"
).split()
GOOD_WORDS = (
    "art blog book books city club college data docs garden guide health help history home journal lab library "
    "life local magazine market math media museum music news north park photo press project radio river school "
    "science shop south sport sports story studio tech time today town travel tree union water weather wiki world"
).split()
#: Labelled urls that training takes at most, those with the smallest hashes.
SAMPLE = 20_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def labelled_urls(n: int = 4000, seed: int = 5) -> list[tuple[str, str]]:
    """Labelled urls made from the word lists: hosts differ by label, everything else is dealt alike.

    An ordinary host is made of ordinary words or of syllables, a bad one has a bad word.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") + rng.choice("nrst") * (rng.random() < 0.5) for _ in range(rng.randint(1, 3)))
    out = []
    for k in range(n):
        bad = k % 2 == 0
        parts = [rng.choice(BAD_WORDS)] if bad else []
        while len(parts) < 2 and (not parts or rng.random() < 0.8):
            parts.append(rng.choice(BAD_WORDS) if bad and rng.random() < 0.8 else rng.choice(GOOD_WORDS) if rng.random() < 0.3 else word())
        rng.shuffle(parts)
        name = ("-" if rng.random() < (0.8 if bad else 0.15) else "").join(parts)
        host = rng.choice(["", "", "www.", "m.", "blog.", f"{word()}."]) + name + rng.choice([".example", "", ""]) + rng.choice([".com", ".net", ".org", ".info", ".co.uk"])
        path = "/".join(["", *(rng.choice(["en", "de", "fr", "es", "a", word(), str(rng.randint(1, 99999))]) for _ in range(rng.randint(0, 3)))])
        tail = rng.choice(["", "/", ".html", f"?page={rng.randint(1, 9)}&ref=x", "?utm_source=feed", "#top"])
        out.append((f"{rng.choice(['http', 'https'])}://{host}{path}{tail}", "block" if bad else "allow"))
    return out


def features(urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
    """Lexical features of each url: lengths, depth, digits, entropy, parameters and marks."""
    out = np.zeros((len(urls), 14))
    for k, (url, host, path) in enumerate(zip(urls, hosts, paths)):
        raw = url.encode("utf-8", "replace")
        n = len(raw)
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256, int)
        share = counts[counts > 0] / max(n, 1)
        query = url.partition("?")[2].partition("#")[0]
        segments = [s for s in path.split("/") if s]
        out[k] = (
            n,
            len(host),
            len(path),
            len(query),
            len(segments),
            host.count("."),
            counts[48:58].sum() / max(n, 1),
            sum(c.isdigit() for c in host) / max(len(host), 1),
            -(share * np.log2(share)).sum() if n else 0.0,
            query.count("&") + bool(query),
            host.count("-"),
            path.count("-") + path.count("_"),
            max(map(len, segments), default=0),
            url.startswith("https"),
        )
    return out


def suffixes(host: str) -> list[tuple[str, ...]]:
    """Whose statistics count: last label, last two labels, and the words of the other labels with their endings."""
    labels = host.split(".")
    words = [w for label in labels[:-1] or labels for w in re.split(r"[^0-9a-z]+", label) if w]
    return [(labels[-1],), (".".join(labels[-2:]),), tuple(words), tuple(w[-4:] for w in words)]


@dataclass
class Boosted:
    """Trees of fixed depth on quantile bins; logistic loss, second-order leaves."""

    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    start: float = 0.0
    rates: tuple = ({}, {}, {}, {})
    prior: float = 0.5

    @staticmethod
    def _count(hosts, y) -> tuple:
        rates: tuple = ({}, {}, {}, {})
        for h, v in zip(hosts, y):
            for j, names in enumerate(suffixes(h)):
                for name in names:
                    n, bad = rates[j].get(name, (0, 0.0))
                    rates[j][name] = (n + 1, bad + v)
        return rates

    def columns(self, urls, hosts, paths, rates: tuple | None = None) -> np.ndarray:
        """Features and suffix statistics: the largest and smallest smoothed rate of blocks and the most counts."""
        rates = self.rates if rates is None else rates
        stats = np.full((len(urls), 12), self.prior)
        for k, h in enumerate(hosts):
            for j, names in enumerate(suffixes(h)):
                each = [rates[j].get(name, (0, 0.0)) for name in names]
                share = [(bad + 4 * self.prior) / (n + 4) for n, bad in each]
                if each:
                    stats[k, 3 * j : 3 * j + 3] = max(share), min(share), np.log1p(max(n for n, _ in each))
        return np.hstack([features(urls, hosts, paths), stats])

    def fit(self, urls, hosts, paths, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.2, folds: int = 5) -> Boosted:
        """Each fold's statistics come from the other folds, so that no url sees its own label."""
        y = np.asarray(y, float)
        self.prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.start = float(np.log(self.prior / (1 - self.prior)))
        if not len(y) or y.min() == y.max():
            return self
        self.rates = self._count(hosts, y)
        fold = np.arange(len(y)) % folds
        x = np.zeros((len(y), 26))
        pick = lambda values, mask: [v for v, m in zip(values, mask) if m]
        for f in range(folds):
            own = fold == f
            others = self._count(pick(hosts, ~own), y[~own])
            x[own] = self.columns(pick(urls, own), pick(hosts, own), pick(paths, own), others)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
        b = self._bin(x)
        score = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree, leaf, value = self._grow(b, p - y, p * (1 - p) + 1e-9, depth, bins)
            score += rate * value[leaf]
            self.trees.append((tree, rate * value))
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], 1)

    @staticmethod
    def _grow(b, g, h, depth, bins):
        """An oblivious tree: one split a level, the one with the largest gain over all nodes."""
        node, splits = np.zeros(len(b), np.int64), []
        for level in range(depth):
            width = 1 << level
            best = (-1.0, 0, 0)
            for j in range(b.shape[1]):
                at = node * bins + b[:, j]
                gs = np.bincount(at, g, width * bins).reshape(width, bins)
                hs = np.bincount(at, h, width * bins).reshape(width, bins)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = (gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1)).sum(0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            splits.append(best[1:])
            node = node * 2 + (b[:, best[1]] > best[2])
        leaves = 1 << depth
        value = -np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
        return splits, node, value

    def predict(self, urls, hosts, paths) -> np.ndarray:
        """Chance that a url is to be blocked."""
        score = np.full(len(urls), self.start)
        if self.trees and len(urls):
            b = self._bin(self.columns(urls, hosts, paths))
            for splits, value in self.trees:
                node = np.zeros(len(urls), np.int64)
                for j, k in splits:
                    node = node * 2 + (b[:, j] > k)
                score += value[node]
        return 1 / (1 + np.exp(-score))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (the trees' chance of block).

    Urls that a rule fits get its verdict. The trees learn from ``labelled`` (``url``, ``label``
    allow or block), up to ``sample`` of them, those with the smallest hashes; without it from
    ``labelled_urls``. The rules say nothing of other urls and train nothing. With labels of one kind the share of blocks is the chance; with none it is one half, and a chance above one half
    blocks. A null or broken url has an empty host and path and is judged like any other. Repeated
    rows get equal verdicts; columns of the new names are replaced; no rows give no rows.
    """
    source_columns(pages, "url")
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    url = F.col("row.url")
    named = packed(pages).withColumns({"host": host_of(url), "path": path_of(url)})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = named.withColumns({"rule": rule, "told": verdict})
    spark = pages.sparkSession
    if labelled is None:
        labelled = spark.createDataFrame(labelled_urls(), "url string, label string")
    known = labelled.where(F.col("label").isin("allow", "block")).select("url", "label")
    known = known.orderBy(F.xxhash64("url"), "url", "label").limit(sample)
    rows = known.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label").collect()
    cols = [[r[c] or "" for r in rows] for c in ("url", "host", "path")]
    model = Boosted().fit(*cols, np.array([r["label"] == "block" for r in rows], float))
    shared = spark.sparkContext.broadcast((model.edges, model.trees, model.start, model.rates, model.prior))

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        trees = Boosted(*shared.value)
        for url, host, path in batches:
            yield pd.Series(trees.predict(url.fillna("").tolist(), host.tolist(), path.tolist()))

    guess = F.pandas_udf(run, "double")
    scored = ruled.withColumn("score", guess(url, "host", "path"))
    final = F.coalesce("told", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("row.*", "host", "path", "rule", final.alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
