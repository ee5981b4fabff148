"""Log-bilinear language model: NCE training in numpy, normalised token log-probabilities.

The softmax has two factors. The most frequent tokens are classes of their own, all others fall
into classes by the hash of their last two bytes. The first factor predicts the class of a token
from the classes of the two before it, as the product of a context vector (bilinear in position and
class) with the class's output vector plus a bias. The second predicts the token within its class,
from the class before it, for every token that occurs ``LEARNT`` times or more, so its vocabulary
grows with the text; what is left of a class is one more output, and a token of it has its smoothed
share of the counts. Training takes expected gradients over the counts of all class trigrams and of
all tokens after classes of the whole training text, of which no sample is drawn. Scoring takes
both softmaxes for all contexts in batched matrix products, once a worker, and looks tokens up.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, source_columns, table
from .lang_id import held_out_flag

#: The token that ends a text; no word holds a newline.
END = b"\n"
SMOOTH = 0.1
#: Classes of one token each and classes by hash; together 128.
SINGLE, HASHED = 64, 64
#: Tokens with counts that every worker holds; rarer ones meet their counts in a join.
FREQUENT = 131_072
#: Occurrences from which a token has an output vector of its own, and the most such tokens.
LEARNT, MOST_LEARNT = 200, 16_384


def tokens(text: str | None) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(END)
    return words


def hashed_class(token: bytes, single: int = SINGLE, hashed: int = HASHED) -> int:
    return single + zlib.crc32(token[-2:]) % hashed


def count_tokens(texts: DataFrame) -> DataFrame:
    """``token`` (binary), ``hash``, ``c`` of a table with a ``text`` column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                sums.update(tokens(text))
            if len(sums) > 300_000:
                yield pd.DataFrame({"token": list(sums.keys()), "c": list(sums.values())})
                sums = Counter()
        yield pd.DataFrame({"token": list(sums.keys()), "c": list(sums.values())})

    each = texts.select("text").mapInPandas(run, "token binary, c long")
    return each.groupBy("token").agg(F.sum("c").alias("c")).select("token", F.xxhash64("token").alias("hash"), "c")


class Lexicon:
    """Frequent tokens with class, output and log count; all other tokens have the class of their hash.

    Outputs of the second factor are the ``learnt`` tokens behind the single ones, then what is left of each hashed class.
    """

    def __init__(self, listed: list[bytes], counts: np.ndarray, learnt: int = 0, single: int = SINGLE, hashed: int = HASHED):
        self.at = {w: i for i, w in enumerate(listed)}
        self.log_count = np.log10(np.append(counts, 0.0) + SMOOTH)  # the last is for tokens not listed
        self.cls = np.array([i if i < single else hashed_class(w) for i, w in enumerate(listed)] + [0], np.int64)
        self.single, self.own = single, max(0, learnt - single)
        self.outputs = self.own + hashed
        self.home = np.concatenate([self.cls[single : single + self.own], np.arange(single, single + hashed)])  # class of each output

    def places(self, words: list[bytes]) -> np.ndarray:
        get = self.at.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def classes(self, words: list[bytes], at: np.ndarray) -> np.ndarray:
        out = self.cls[at]
        for i in np.nonzero(at < 0)[0]:
            out[i] = hashed_class(words[i])
        return out

    def output(self, at: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The output of each token within its class; -1 for a class of one token."""
        out = np.where((at >= self.single) & (at < self.single + self.own), at - self.single, self.own + cls - self.single)
        return np.where(cls < self.single, -1, out)


def gram_counts(texts: DataFrame, lexicon_of, classes: int) -> DataFrame:
    """Counts of (two classes before, class) over all texts, the start counting as two ends; behind them those of
    (class before, output) for tokens of classes of many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = lexicon_of()
        end = int(lex.cls[lex.at[END]]) if END in lex.at else hashed_class(END)
        tri, pair = np.zeros(classes**3, np.int64), np.zeros(classes * lex.outputs, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def count() -> None:
            c3, c2 = (np.concatenate(x) for x in zip(*held))
            np.add(tri, np.bincount(c3, minlength=len(tri)), out=tri)
            np.add(pair, np.bincount(c2, minlength=len(pair)), out=pair)

        for pdf in batches:
            for text in pdf["text"]:
                words = tokens(text)
                at = lex.places(words)
                c = np.concatenate([[end, end], lex.classes(words, at)])
                o = lex.output(at, c[2:])
                held.append(((c[:-2] * classes + c[1:-1]) * classes + c[2:], (c[1:-1] * lex.outputs + o)[o >= 0]))
                size += len(words)
                if size > 2_000_000:
                    count()
                    held, size = [], 0
        if held:
            count()
        for start, sums in ((0, tri), (len(tri), pair)):
            at = np.nonzero(sums)[0]
            yield pd.DataFrame({"gram": at + start, "c": sums[at]})

    each = texts.select("text").mapInPandas(run, "gram long, c long")
    return each.groupBy("gram").agg(F.sum("c").alias("c"))


class Within:
    """Second factor: score(o | b) = R[b] . Q[o] + bias[o], normalised over the outputs of o's class."""

    def __init__(self, classes: int, home: np.ndarray, dim: int = 16, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.home = home
        self.R = rng.normal(0, 0.1, (classes, dim)).astype(np.float32)
        self.Q = rng.normal(0, 0.1, (len(home), dim)).astype(np.float32)
        self.bias = np.zeros(len(home), np.float32)

    def fit(self, seen: np.ndarray, steps: int = 60, noise: float = 8.0, rate: float = 0.1) -> None:
        """NCE by expected gradients over all counts ``seen`` (classes before x outputs); noise is an output's share of its class; Adagrad."""
        members = np.bincount(self.home, seen.sum(0), minlength=len(self.R))
        share = (seen.sum(0) + 0.5) / (members[self.home] + 0.5)
        self.bias = np.log(share).astype(np.float32)
        if not seen.sum():
            return
        kq = (noise * share).astype(np.float32)
        order = np.argsort(self.home, kind="stable")
        starts = np.searchsorted(self.home[order], np.arange(len(self.R) + 1))
        total = np.zeros_like(seen, np.float32)  # how often the class of an output follows
        for k in range(len(self.R)):
            own = order[starts[k] : starts[k + 1]]
            if len(own):
                total[:, own] = seen[:, own].sum(1, keepdims=True)
        # contexts weigh alike by the root of their counts, so that rare ones are learnt as well
        weight = (1 / np.sqrt(seen.sum(1, keepdims=True) + 1)).astype(np.float32)
        data, fake = (seen * weight).astype(np.float32), total * weight * kq
        sq = {k: np.full_like(getattr(self, k), 1e-3) for k in ("R", "Q", "bias")}
        for step in range(steps):
            z = np.clip(self.R @ self.Q.T + self.bias, -30, 30)
            is_data = 1 / (1 + kq * np.exp(-z))
            g = data * (1 - is_data) - fake * is_data
            lr = rate * (1 - step / steps) + 0.005
            for name, grad in (("R", g @ self.Q), ("Q", g.T @ self.R), ("bias", g.sum(0))):
                sq[name] += grad * grad
                setattr(self, name, getattr(self, name) + np.float32(lr) * grad / np.sqrt(sq[name]))

    def table(self) -> np.ndarray:
        """log10 of the probability of each output within its class, a row for each class before."""
        z = self.R @ self.Q.T + self.bias
        out = np.empty_like(z)
        for k in np.unique(self.home):
            own = np.nonzero(self.home == k)[0]
            part = z[:, own] - z[:, own].max(1, keepdims=True)
            out[:, own] = (part - np.log(np.exp(part).sum(1, keepdims=True))) / np.log(10)
        return out


class LogBilinear:
    """Class model: score(c | a, b) = (C0 R[a] + C1 R[b] + d) . Q[c] + bias[c]."""

    def __init__(self, classes: int, dim: int = 24, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.rng, self.classes, self.dim = rng, classes, dim
        self.R = rng.normal(0, 0.3, (classes, dim))
        self.Q = rng.normal(0, 0.1, (classes, dim))
        self.C = np.stack([np.eye(dim) * 0.5, np.eye(dim)]) + rng.normal(0, 0.02, (2, dim, dim))
        self.bias = np.zeros(classes)

    def fit(self, grams: np.ndarray, counts: np.ndarray, steps: int = 2000, batch: int = 2048, noise: int = 64, rate: float = 0.15) -> None:
        """Noise-contrastive estimation by expected gradients over all counts; noise is the class unigram; Adagrad.

        A step takes ``batch`` contexts (pairs of classes before) with all their counts and the
        expected noise; every context comes once before any comes again.
        """
        n, d, rng = self.classes, self.dim, self.rng
        if not len(grams):
            return
        unigram = np.bincount(grams % n, counts, minlength=n) + 0.5
        unigram /= unigram.sum()
        self.bias = np.log(unigram)
        kq = noise * unigram
        pairs, row = np.unique(grams // n, return_inverse=True)
        seen = np.zeros((len(pairs), n))
        np.add.at(seen, (row, grams % n), counts / counts.sum())
        blocks = -(-len(pairs) // batch)
        sq = {k: np.full_like(getattr(self, k), 1e-3) for k in ("R", "Q", "C", "bias")}
        cols = np.arange(d)
        for step in range(steps):
            if step % blocks == 0:
                dealt = np.array_split(rng.permutation(len(pairs)), blocks)
            own = dealt[step % blocks]
            a, b, c = pairs[own] // n, pairs[own] % n, seen[own]
            Ra, Rb = self.R[a], self.R[b]
            ctx = Ra @ self.C[0].T + Rb @ self.C[1].T
            is_data = 1 / (1 + kq * np.exp(-np.clip(ctx @ self.Q.T + self.bias, -30, 30)))
            g = c * (1 - is_data) - c.sum(1, keepdims=True) * kq * is_data
            dctx, dQ, db = g @ self.Q, g.T @ ctx, g.sum(0)
            da, db2 = dctx @ self.C[0], dctx @ self.C[1]
            dR = np.bincount((a[:, None] * d + cols).ravel(), da.ravel(), n * d)
            dR = (dR + np.bincount((b[:, None] * d + cols).ravel(), db2.ravel(), n * d)).reshape(n, d)
            dC = np.stack([dctx.T @ Ra, dctx.T @ Rb])
            lr = rate * (1 - step / steps) + 0.005
            for name, grad in (("R", dR), ("Q", dQ), ("C", dC), ("bias", db)):
                grad = grad * blocks
                sq[name] += grad * grad
                setattr(self, name, getattr(self, name) + lr * grad / np.sqrt(sq[name]))

    def table(self) -> np.ndarray:
        """log10 of the normalised class probabilities, a row for each pair of classes before."""
        n = self.classes
        left, right = self.R @ self.C[0].T, self.R @ self.C[1].T
        out = np.empty((n * n, n), np.float32)
        for a in range(n):
            z = (left[a] + right) @ self.Q.T + self.bias
            z -= z.max(1, keepdims=True)
            out[a * n : (a + 1) * n] = (z - np.log(np.exp(z).sum(1, keepdims=True))) / np.log(10)
        return out


def score(docs: DataFrame, training: DataFrame, seed: int = 1, frequent: int = FREQUENT, steps: int = 2000) -> DataFrame:
    """``docs`` less ``text`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Scores are log10 probabilities of whole texts, ends included: ``base_score`` by smoothed token
    frequency, ``score`` by the model. A null text is an empty one. With no training text every
    token is unknown and classes are alike. Repeated rows each count in training and get equal scores. Tokens
    too rare to be listed meet their counts by 64-bit hash. No rows give no rows. Columns of the new names are
    replaced, others pass through.
    """
    source_columns(docs, "text")
    spark = docs.sparkSession
    vocab = materialize(count_tokens(training), "lm-vocabulary")
    n_all, n_kinds = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    levels = vocab.groupBy("c").agg(F.count("*").alias("k"))
    least = levels.select("c", F.sum("k").over(_down("c")).alias("above")).where(F.col("above") <= frequent).agg(F.min("c")).first()[0] if n_kinds > frequent else 1
    top = vocab.where(F.col("c") >= (least if least is not None else 1 << 62)).select("token", "c").toArrow()
    listed, counts = top["token"].to_pylist(), top["c"].to_numpy()
    rank = sorted(range(len(listed)), key=lambda i: (-counts[i], listed[i]))
    listed, counts = [listed[i] for i in rank], counts[rank].astype(np.int64)
    del top, rank
    name = uuid.uuid4().hex
    learnt = min(int((counts >= LEARNT).sum()), MOST_LEARNT)
    shared = spark.sparkContext.broadcast((listed, counts, learnt))
    lexicon_of = lambda: _kept(("lexicon", name), lambda: Lexicon(*shared.value))
    classes = SINGLE + HASHED
    home = Lexicon(listed[:learnt], counts[:learnt], learnt).home
    tri = gram_counts(training, lexicon_of, classes).toArrow()
    grams, sums = tri["gram"].to_numpy(), tri["c"].to_numpy()
    rank = np.argsort(grams)
    grams, sums = grams[rank].astype(np.int64), sums[rank].astype(np.float64)
    cut = int(np.searchsorted(grams, classes**3))
    model = LogBilinear(classes, seed=seed)
    model.fit(grams[:cut], sums[:cut], steps)
    seen = np.zeros(classes * len(home))
    seen[grams[cut:] - classes**3] = sums[cut:]
    within = Within(classes, home, seed=seed + 1)
    within.fit(seen.reshape(classes, len(home)))
    del tri, grams, sums, rank, seen
    mass = _class_mass(vocab, listed[:SINGLE], listed[SINGLE:learnt], counts[SINGLE:learnt])
    params = spark.sparkContext.broadcast((model.R, model.Q, model.C, model.bias, within.R, within.Q, within.bias, np.log10(mass)))
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    others = [c for c in docs.columns if c != "text"]
    docs = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []), "text")
    keep = ["row"] if others else []
    base_norm = float(np.log10(n_all + SMOOTH * (n_kinds + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _kept(("scorer", name), lambda: Scorer(lexicon_of(), params.value))
        uid = TaskContext.get().partitionId() << 33
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                at, fixed, rest = scorer.parts(words)
                rare = np.nonzero(at < 0)[0]
                logs = scorer.lex.log_count[at]
                hashes = np.array([digest(words[i], 42) for i in rare], np.uint64).view(np.int64)
                rows.append((uid, len(words), len(words) - len(rare), float(logs[at >= 0].sum()), float(fixed.sum() + logs[rest & (at >= 0)].sum()), hashes))
                uid += 1
            kinds = {"_uid": pa.int64(), "_n": pa.int64(), "_known": pa.int64(), "_logs": pa.float64(), "_fixed": pa.float64(), "_rare": pa.list_(pa.int64())}
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, *kinds])

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    extra = "_uid long, _n long, _known long, _logs double, _fixed double, _rare array<long>"
    parts = materialize(docs.mapInArrow(run, f"{named}, {extra}" if named else extra), "lm-parts")
    rare = parts.select("_uid", F.explode("_rare").alias("hash"))
    # a word that many texts repeat meets its count once for each task, not once for each text
    wanted = rare.select("hash").distinct()
    known = vocab.where(F.col("c") < least) if least is not None else vocab
    known = materialize(wanted.join(known.select("hash", "c"), "hash"), "lm-rare")
    logs = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(SMOOTH))
    sums = rare.join(known, "hash", "left").groupBy("_uid").agg(F.sum(logs).alias("_more"), F.count("c").alias("_also"))
    whole = parts.drop("_rare").join(sums, "_uid", "left")
    more = F.coalesce("_more", F.lit(0.0))
    return whole.select(
        *(["row.*"] if others else []),
        F.col("_n").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_also", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("_logs") + more - F.col("_n") * F.lit(base_norm)).alias("base_score"),
        (F.col("_fixed") + more).alias("score"),
    )


class Scorer:
    """Both softmaxes as tables, and the parts of a text's score that need no count."""

    def __init__(self, lex: Lexicon, params: tuple):
        self.lex, self.classes = lex, len(params[0])
        net, within = LogBilinear(self.classes), Within(self.classes, lex.home)
        net.R, net.Q, net.C, net.bias, within.R, within.Q, within.bias, self.log_mass = params
        self.first, self.second = net.table().ravel(), within.table().ravel()
        self.end = int(lex.cls[lex.at[END]]) if END in lex.at else hashed_class(END)

    def parts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each token (-1: not listed), log10 of its class, of its output within it and, for tokens that are
        left of their class, less that of the class's rest; and whether it is such a token, whose log count is to be added."""
        lex = self.lex
        at = lex.places(words)
        c = np.concatenate([[self.end, self.end], lex.classes(words, at)])
        return at, *self.after(c[:-2], c[1:-1], at, c[2:])

    def after(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for tokens by the two classes before."""
        out = self.first[(a * self.classes + b) * self.classes + c].astype(np.float64)
        o = self.lex.output(at, c)
        many = o >= 0
        out[many] += self.second[b[many] * self.lex.outputs + o[many]]
        rest = o >= self.lex.own
        out[rest] -= self.log_mass[c[rest]]
        return out, rest


def _kept(key: tuple[str, str], make):
    """What a worker keeps from task to task: the newest of each kind. This module travels by value, so it can't keep it itself."""
    held = sys.__dict__.setdefault("_streamloom_kept", {})
    kind, name = key
    if kind not in held or held[kind][0] != name:
        held[kind] = (name, make())
    return held[kind][1]


def _down(col: str):
    """From the largest value down; over distinct counts, of which there are about the root of all tokens."""
    from pyspark.sql import Window

    return Window.orderBy(F.desc(col)).rowsBetween(Window.unboundedPreceding, 0)


def _class_mass(vocab: DataFrame, single: list[bytes], learnt: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Smoothed count of what is left of each hashed class, with one share for a token never seen; 1 for single classes."""
    ends = F.crc32(F.when(F.length("token") > 2, F.substring("token", -2, 2)).otherwise(F.col("token"))) % HASHED
    mass = np.zeros(SINGLE + HASHED)
    for r in vocab.groupBy(ends.cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[SINGLE + r["k"]] = r["c"] + SMOOTH * r["n"]
    for r in vocab.where(F.col("token").isin([bytearray(w) for w in single])).collect() if single else []:
        mass[hashed_class(bytes(r["token"]))] -= r["c"] + SMOOTH
    for w, c in zip(learnt, counts.tolist()):
        mass[hashed_class(w)] -= c + SMOOTH
    mass[SINGLE:] = np.maximum(mass[SINGLE:], 0) + SMOOTH
    mass[:SINGLE] = 1.0
    return mass


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out_flag(F.col("doc_id"), 10, 0).alias("held_out"), "text")
    return score(docs, docs.where(~F.col("held_out")).select("text"))
