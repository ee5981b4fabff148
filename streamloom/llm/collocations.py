"""Phrase mining by position bitmaps: shift, AND and popcount extend phrases depth-first, shards add up.

A task cuts the texts that it reads into shards of one language. In a shard each word has a bitmap
of its positions, compressed to the bytes that are not zero; positions of neighbouring pieces are
one apart, so a shifted bitmap never reaches into the next piece. Popcounts of all shards are
summed by phrase. First words and pairs are summed by a hash, which shows all that may be frequent
enough; then they and the phrases of three words that begin and end with such a pair are summed by
their text, and each further level begins and ends with phrases of the one before. Tasks know what
may be frequent by a bit map of bounded size, and what it lets pass in excess the sums remove.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, source_columns, table, tidy
from .ranks import positions
from .rolling import Rolling, mixed

LEAST, LONGEST, TOP = 10, 3, 2000
#: A phrase goes if a longer one that holds it has so many percent of its occurrences.
WITHIN = 50
#: Bytes of text in a shard, unless one piece is longer; bitmap bytes that are compared at once.
SHARD, BLOCK = 1 << 21, 1 << 19
#: Up to so many languages their totals are broadcast.
LANGUAGES = 100_000
#: Bits of the map of frequent phrases, least and most (32 MB); 16 for each phrase until the most is reached.
MAP_LEAST, MAP_MOST = 1 << 20, 1 << 28
#: What ends a piece and what stands between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"


class Tokens:
    """Words of lower-cased text as arrays: ``start``, ``end``, ``piece``, ``code`` (64-bit hash of the word)."""

    def __init__(self) -> None:
        self.kind = np.zeros(256, np.uint8)
        self.kind[list(BLANKS)], self.kind[list(BREAKS)] = 1, 2
        self.rolling = Rolling()

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a = np.frombuffer(text, np.uint8)
        kind = self.kind[a]
        inside = np.r_[False, kind == 0, False]
        start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        piece = np.cumsum(kind == 2, dtype=np.int64)[start] if len(start) else start
        code = np.empty(len(start), np.uint64)
        cuts = np.unique(np.r_[np.searchsorted(start, np.arange(0, len(a), 1 << 18)), len(start)])
        for i, j in zip(cuts[:-1], cuts[1:]):  # by blocks of text, which bounds the memory
            at = start[i]
            code[i:j] = self.rolling(a[at : end[j - 1]], start[i:j] - at, end[i:j] - at)
        return start, end, piece, code


def phrase_code(codes: list[np.ndarray], lang: bytes) -> np.ndarray:
    """64-bit hash of phrases from the codes of their words, first to last."""
    out = np.full(len(codes[0]), np.uint64(int.from_bytes(lang[:7], "little") + len(lang)))
    for c in codes:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + c)
    return out


class Shard:
    """Position bitmaps of the words of a text: ``word``, ``chunk`` and ``mask`` by word, and the same by chunk."""

    def __init__(self, text: bytes, tokens: Tokens) -> None:
        start, end, piece, code = tokens(text)
        at = np.arange(len(code)) + np.cumsum(np.r_[False, piece[1:] != piece[:-1]][: len(code)])
        self.chunks = (int(at[-1]) >> 3) + 2 if len(at) else 1
        order = np.argsort(code, kind="stable")
        code, at = code[order], at[order]
        new = np.r_[True, code[1:] != code[:-1]][: len(code)]
        first = order[new]
        self.code, self.names = code[new], pa.array([text[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())], pa.binary())
        chunk, bit = at >> 3, np.uint8(1) << (at & 7).astype(np.uint8)
        cut = np.flatnonzero(new | np.r_[True, chunk[1:] != chunk[:-1]][: len(code)])
        self.mask = np.bitwise_or.reduceat(bit, cut) if len(cut) else bit
        self.word, self.chunk = (np.cumsum(new) - 1)[cut], chunk[cut]
        place = np.full(len(code), -1)  # by the first position of a byte, so by chunk, without sorting again
        place[order[cut]] = np.arange(len(cut))
        order = place[place >= 0]
        self.next_word, self.next_mask = self.word[order], self.mask[order]
        self.offset = np.r_[0, np.cumsum(np.bincount(self.chunk, minlength=self.chunks))]

    def extended(self, owner: np.ndarray, chunk: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each bitmap byte shifted by one position and ANDed with those of all words there: owner, word, chunk and what is left."""
        on, over = mask << np.uint8(1), mask >> np.uint8(7)
        i, j = np.flatnonzero(on), np.flatnonzero(over)
        owner, chunk, mask = np.r_[owner[i], owner[j]], np.r_[chunk[i], chunk[j] + 1], np.r_[on[i], over[j]]
        n = self.offset[chunk + 1] - self.offset[chunk]
        entry = np.repeat(np.arange(len(chunk)), n)
        other = np.arange(len(entry)) + np.repeat(self.offset[chunk] - np.r_[0, np.cumsum(n)[:-1]][: len(n)], n)
        left = mask[entry] & self.next_mask[other]
        hit = np.flatnonzero(left)
        entry = entry[hit]
        return owner[entry], self.next_word[other[hit]], chunk[entry], left[hit]

    def phrases(self, depth: int, allowed) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """Length, word numbers (a column a place) and popcounts of all phrases of up to ``depth`` words, depth-first by blocks of first words.

        ``allowed`` takes word numbers of phrases and says which may be part of a longer one; phrases from three words on need it of both ends.
        """
        words = np.arange(len(self.code))
        ones = np.bincount(self.word, np.bitwise_count(self.mask), len(words)).astype(np.int64)
        yield 1, [words], ones
        yield from self._deeper([words], self.word, self.chunk, self.mask, depth, allowed)

    def _deeper(self, prefix, owner, chunk, mask, depth, allowed):
        """``owner``, ``chunk``, ``mask``: bitmap bytes of the phrases ``prefix``, sorted by owner."""
        cost = np.cumsum(self.offset[chunk + 1] - self.offset[chunk])
        cuts = np.searchsorted(cost, np.arange(BLOCK, int(cost[-1]) if len(cost) else 0, BLOCK))
        cuts = np.unique(np.searchsorted(owner, owner[cuts])) if len(cuts) else cuts
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(owner)]):
            if s == e:
                continue
            own, word, at, left = self.extended(owner[s:e], chunk[s:e], mask[s:e])
            key, row = np.unique(own * len(self.code) + word, return_inverse=True)
            own, word = np.divmod(key, len(self.code))
            longer = [*(c[own] for c in prefix), word]
            fine = np.ones(len(key), bool) if len(longer) == 2 else allowed(longer[1:])
            yield len(longer), [c[fine] for c in longer], np.bincount(row, np.bitwise_count(left), len(key)).astype(np.int64)[fine]
            if len(longer) < depth:
                fine &= allowed(longer)
                number = np.cumsum(fine) - 1
                go = np.flatnonzero(fine[row])
                go = go[np.argsort(row[go], kind="stable")]
                yield from self._deeper([c[fine] for c in longer], number[row[go]], at[go], left[go], depth, allowed)


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[bytes, bytes]]:
    """Language and text of about ``size`` bytes, cut between pieces; every text is used whole. At most four times ``size`` is held for all languages, or one text."""
    held, length = defaultdict(list), defaultdict(int)
    parts = (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256))
    for part in parts:
        langs, texts = (part.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "text"))
        for lang, text in zip(langs, texts):
            held[lang].append(text)
            length[lang] += len(text) + 1
            if sum(length.values()) >= 4 * size:
                lang = max(length, key=length.get)
            if length[lang] >= size or sum(length.values()) >= 4 * size:
                rest = b"\n".join(held.pop(lang))
                del length[lang]
                while len(rest) >= 2 * size:
                    ends = [p for p in (rest.find(bytes([b]), size) for b in BREAKS) if p >= 0]
                    cut = min(ends, default=len(rest))
                    yield lang, rest[:cut]
                    rest = rest[cut + 1 :]
                if rest:
                    yield lang, rest
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def mined(docs: DataFrame, size: int, depth: int, bits: np.ndarray | None, give, schema: str) -> DataFrame:
    """What ``give`` makes of each level of each shard: it gets the shard, its language, the length, the word numbers, the counts and the codes of the phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for lang, text in shards(batches, size):
            shard = Shard(text.lower(), tokens)
            code = lambda columns: phrase_code([shard.code[c] for c in columns], lang)  # noqa: E731, B023
            for words, columns, n in shard.phrases(depth, lambda columns: marked(bits, code(columns))):  # noqa: B023
                if len(n):
                    yield from give(shard, lang, words, columns, n, code(columns))

    return docs.mapInArrow(run, schema)


def frequent_codes(docs: DataFrame, least: int, size: int) -> DataFrame:
    """``h``: the hashes of at least all words and pairs of words that occur ``least`` times; two that share a hash count together."""

    def give(shard, lang, words, columns, n, code) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["h", "n"])

    found = mined(docs, size, 2, None, give, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return materialize(found.where(F.col("n") >= least).select("h"), "phrases-codes")


def counted(docs: DataFrame, levels: tuple[int, int], bits: np.ndarray, size: int = SHARD) -> DataFrame:
    """``lang``, ``words``, ``phrase`` and ``n``, summed over shards, of the phrases whose length is in ``levels`` and that ``bits`` lets pass.

    Words and pairs must be marked themselves, longer phrases at both ends. From one word on, an
    empty phrase of ``words`` 0 counts all words of a language.
    """
    least, most = levels

    def give(shard, lang, words, columns, n, code) -> Iterator[pa.RecordBatch]:
        if words < least:
            return
        total = int(n.sum())
        if words <= 2:
            fine = marked(bits, code)
            columns, n = [c[fine] for c in columns], n[fine]
        names = [shard.names.take(pa.array(c)) for c in columns]
        names = pc.binary_join_element_wise(*names, pa.scalar(b" ")) if words > 1 else names[0]
        if words == 1:
            names, n = pa.concat_arrays([names, pa.array([b""])]), np.r_[n, total]
        langs = pa.array([lang]).take(pa.array(np.zeros(len(n), np.int64)))
        yield pa.RecordBatch.from_arrays([langs, names, pa.array(n)], names=["lang", "phrase", "n"])

    found = mined(docs, size, most, bits, give, "lang binary, phrase binary, n long")
    found = found.select(F.col("lang").cast("string"), F.col("phrase").cast("string"), "n")
    found = found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    return found.select("lang", words.cast("int").alias("words"), "phrase", "n")


def marked(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    at = code & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def codes_of(phrases: DataFrame) -> DataFrame:
    """``h``: the hashes of phrases (``lang``, ``phrase``) as shards have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            by = defaultdict(list)
            for lang, phrase in zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "phrase"))):
                by[lang, phrase.count(b" ")].append(phrase)
            for (lang, blanks), own in by.items():
                code = tokens(b"\n".join(own))[3].reshape(len(own), blanks + 1)
                yield pa.RecordBatch.from_arrays([pa.array(phrase_code(list(code.T), lang).view(np.int64))], names=["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h long")


def bit_map(codes: DataFrame) -> np.ndarray:
    """A bit for each hash ``h``, 128 KB to 32 MB whatever their number."""
    n, size = codes.count(), MAP_LEAST
    while size < MAP_MOST and size < 16 * n:
        size *= 2
    word = F.shiftrightunsigned(F.col("h").bitwiseAND(F.lit(size - 1)), 6)
    found = codes.select(word.alias("word"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit"))
    found = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size >> 6, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = SHARD) -> DataFrame:
    """``lang``, ``words``, ``phrase`` and ``n`` of all phrases of up to ``longest`` words that occur ``least`` times; ``words`` 0: all words of a language."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    enough = (F.col("n") >= least) | (F.col("words") == 0)
    codes = frequent_codes(texts, least, size)
    tidy(docs.sparkSession)
    found = materialize(counted(texts, (1, min(3, longest)), bit_map(codes), size).where(enough), "phrases-3")
    release(codes)
    for words in range(4, longest + 1):
        tidy(docs.sparkSession)
        bits = bit_map(codes_of(found.where("words >= 2")))
        more = materialize(counted(texts, (words, words), bits, size).where(enough), f"phrases-{words}")
        found = found.unionByName(more)
    tidy(docs.sparkSession)
    return found


def scored(found: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``a``, ``l``, ``r`` and ``score`` of each phrase of two words or more, by its lowest-scoring cut."""
    cand = found.where("words >= 2").withColumnRenamed("n", "a")
    cuts = cand.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.selectExpr("*", "substring_index(phrase, ' ', cut) AS first", "substring_index(phrase, ' ', cut - words) AS rest")
    parts = found.where("words >= 1")
    left, right = (parts.select("lang", F.col("phrase").alias(p), F.col("n").alias(n)) for p, n in (("first", "l"), ("rest", "r")))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    wide = [f"cast({c} AS decimal(16,0))" for c in "aalr"]
    score = "cast((1000000BD * {} * {}) div ({} * {}) AS bigint)".format(*wide)
    cuts = cuts.select("lang", "phrase", F.struct(F.expr(score).alias("score"), "cut", "words", "a", "l", "r").alias("best"))
    return cuts.groupBy("lang", "phrase").agg(F.min("best").alias("best")).select("lang", "phrase", "best.*")


def unheld(cand: DataFrame, within: int = WITHIN) -> DataFrame:
    """``cand`` less the phrases inside a longer one of it that has ``within`` percent of their occurrences."""
    parts = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(0, words - k), i -> concat_ws(' ', slice(w, i + 1, k)))))")
    longer = cand.where("words >= 3").select("lang", "words", "a", F.split("phrase", " ").alias("w"))
    longer = longer.select("lang", "a", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return cand.join(longer, ["lang", "phrase"], "left").where(f"most IS NULL OR 100 * most < {within} * a").drop("most")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, within: int = WITHIN, size: int = SHARD
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of each language.

    Phrases have 2 to ``longest`` words and occur ``least`` times or more, overlaps and repeated
    rows included. Null texts are empty, a null ``lang`` is ``und``; texts of any length count
    whole. Equal scores go by ``a``, then by the phrase's bytes. No rows, or no phrase that is
    frequent enough, give no rows. Columns other than ``lang`` and ``text`` are not read.
    """
    source_columns(docs, "lang", "text")
    found = phrase_counts(docs, least, longest, size)
    cand = materialize(unheld(scored(found), within), "phrases-scored")
    ranked = positions(cand, F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase"), name="phrases-ranked")
    first = ranked.groupBy("lang").agg(F.min("position").alias("first"))
    total = found.where("words = 0").select("lang", F.col("n").alias("n"))
    each = materialize(first.join(total, "lang"), "phrases-languages")  # a row for each language
    each = F.broadcast(each) if each.count() <= LANGUAGES else each
    out = ranked.join(each, "lang").withColumn("rank", F.col("position") - F.col("first") + 1)
    release(cand)
    return out.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
