"""Language ID: each document a mixture of languages, fitted by expectation-maximisation."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, source_columns, table

BUCKETS = 1 << 16
#: Letters of ASCII stay (lower-cased before), bytes of other scripts stay, all else is a space.
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the byte trigrams of the lower-cased letters; both empty without a letter."""
    none = np.empty(0, np.int64)
    if not text or not any(map(str.isalpha, text)):
        return none, none
    raw = text.lower().encode("utf-8", "replace").translate(_TABLE)
    a = np.frombuffer(b" " + b" ".join(raw.split()) + b" ", np.uint8).astype(np.uint32)
    code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    return np.unique((code * np.uint32(2654435761)) >> np.uint32(16), return_counts=True)


def crc_mod(doc_id, n: int) -> int:
    """crc32 of the id as text, modulo ``n``; a missing id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None or doc_id != doc_id else str(int(doc_id)).encode()) % n


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    logp: np.ndarray  # buckets x languages

    def predict(self, text: str | None, rounds: int = 12) -> tuple[str, float]:
        """The largest language of the chosen set and its share; ``und`` and 0 without a letter.

        All languages start alike and EM finds their shares. Then the smallest leaves as long as
        that lowers the penalised likelihood (half of log n a language) of the rest.
        """
        at, n = gram_counts(text)
        if not len(at) or not self.langs:
            return "und", 0.0
        logp, total = self.logp[at], float(n.sum())
        top = logp.max(1)
        like = np.exp(logp - top[:, None])
        alone = n @ logp
        active = list(np.argsort(-alone, kind="stable"))
        share = np.zeros(len(self.langs))
        share[active] = 1 / len(active)
        penalty = 0.5 * math.log(total + 1)
        share, fit = self._fit(like, n, share, rounds)
        while len(active) > 1:
            least = min(active, key=lambda i: (share[i], -i))
            rest = [i for i in active if i != least]
            if len(rest) == 1:
                now, to = np.zeros(len(share)), float(n @ np.log(np.maximum(like[:, rest[0]], 1e-300)))
                now[rest[0]] = 1.0
            else:
                now = share.copy()
                now[least] = 0.0
                if now.sum() <= 0:
                    now[rest] = 1.0
                now, to = self._fit(like, n, now / now.sum(), rounds)
            if fit - to > penalty:
                break
            active, share, fit = rest, now, to
        best = max(active, key=lambda i: (share[i], alone[i], -i))
        return self.langs[best], float(min(1.0, max(0.0, share[best])))

    @staticmethod
    def _fit(like: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        total = n.sum()
        for _ in range(rounds):
            mix = np.maximum(like @ share, 1e-300)
            now = share * ((n / mix) @ like) / total
            done = np.abs(now - share).max() < 1e-3
            share = now
            if done:
                break
        return share, float(n @ np.log(np.maximum(like @ share, 1e-300)))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", smooth: float = 0.5) -> LanguageModel:
    """Counts trigrams over all rows with a language. The driver gets languages x buckets counts at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for t, name in zip(pdf[text], pdf[lang]):
                at, n = gram_counts(t)
                sums.setdefault(name, np.zeros(BUCKETS, np.int64))[at] += n
        for name, v in sums.items():
            at = np.nonzero(v)[0]
            yield pd.DataFrame({"lang": name, "bucket": at, "n": v[at]})

    rows = labelled.where(F.col(lang).isNotNull()).select(text, lang)
    sums = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).collect()
    names = sorted(r["lang"] for r in packed)
    counts = np.zeros((BUCKETS, len(names)))
    for r in packed:
        for cell in r["cells"]:
            counts[cell["bucket"], names.index(r["lang"])] = cell["n"]
    seen = max(1, int((counts.sum(1) > 0).sum()))
    logp = np.log((counts + smooth) / (counts.sum(0) + smooth * (seen + 1))) if names else counts
    return LanguageModel(tuple(names), logp.astype(np.float32).astype(np.float64))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; nothing but the text decides.

    Null, empty and letterless texts get ``und`` with score 0, and so does every text if no
    language was learned. Ties go to the likelier single language, then the first by name.
    Repeated rows get equal answers; other columns pass through, ``lang_pred`` and ``score`` are
    replaced, and no rows give no rows.
    """
    docs = docs.drop("lang_pred", "score")
    source_columns(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = LanguageModel(*shared.value)
        for texts in batches:
            yield pd.DataFrame([known.predict(t) for t in texts], columns=["lang_pred", "score"])

    guess = F.pandas_udf(run, "lang_pred string, score double")
    # the type hints that choose the iterator form are given by name, so that closures stay plain
    out = packed(docs).withColumn("guess", guess(F.col("row")[text]))
    return out.select("row.*", "guess.lang_pred", "guess.score")


def held_out_flag(doc_id, mod: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest`` modulo ``mod``; a null id counts as ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod) == rest


def learned(docs: DataFrame, mod: int = 4, rest: int = 2) -> LanguageModel:
    """The model of the documents that are not held out."""
    return train(docs.where(~held_out_flag(F.col("doc_id"), mod, rest)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = docs.select("doc_id", held_out_flag(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return predict(rows, learned(docs)).drop("text")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.3) -> DataFrame:
    """The documents with a language that makes up at least ``least`` of them; the columns of ``docs``."""
    bare = packed(docs, "_row").withColumn("text", F.col("_row.text"))
    told = predict(bare, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return told.select("_row.*")
