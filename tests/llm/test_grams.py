"""Resampling, phrases and the n-gram join against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from streamloom.llm import collocations, jaccard_join, queries, ranks, resample

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- resampling ------------------------------------------------------------------------------
def resampled(docs, bench, share=5, least=20, buckets=10_000):
    """The contract in plain Python over (doc_id, text) pairs."""

    def grams(text):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP)) if x]
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    each = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(b for _, _, g in each for b in g), Counter(b for x in bench for b in grams(x)[1])
    big, aim = s.total() + buckets, t.total() + buckets
    rows = []
    for i, n, g in each:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * aim))) for b in g)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= least])
    best = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(best[: share * len(best) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def test_resample_is_brute_force(spark):
    rng = random.Random(13)
    vocab = ["alpha", "Beta", "ÉTÉ", "x9", "語", "don't", "a_b", "İx", "10%"]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randrange(0, 60)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, " \t.;"), (None, "alpha " * 30), (None, "alpha " * 30), (7, "alpha " * 30), (600, "alpha beta " * 20_000)]
    docs += [(700, "same words " * 15)] * 4
    bench = ["alpha beta x9", None, "", "語 語 alpha"]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(x,) for x in bench], "text string")
    for share in (5, 50, 100):
        assert as_rows(resample.resample(d, b, share, keep=["doc_id"])) == resampled(docs, bench, share)
    assert as_rows(resample.resample(d, b.limit(0), 30, keep=["doc_id"])) == resampled(docs, [], 30)
    assert resample.resample(d.limit(0), b).count() == 0


def test_resample_keeps_columns(spark):
    names = ["row", "n", "n_words", "words", "bucket", "gain", "_k1", "copies", "position", "id", "first", "i", "gram", "score"]
    docs = spark.createDataFrame([(i, "one two three " * 9, *names) for i in range(40)], ["doc_id", "text", *names])
    out = resample.resample(docs, docs.select("text"), 10)
    assert set(out.columns) == {*docs.columns, *resample.OWN}
    rows = out.collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4]
    assert all(r[n] == n for r in rows for n in names if n != "score")


def test_positions(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(5)
    got = sorted((r.position, r.k, r.id) for r in ranks.positions(df, df.k.desc(), df.id).collect())
    assert got == [(p, k, i) for p, (k, i) in enumerate(sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1])))]
    assert ranks.positions(df.limit(0), df.k).count() == 0


# ---- all three against their SQL -------------------------------------------------------------
@pytest.mark.parametrize("name", ["op11_collocations", "op12_jaccard_join", "op13_resample"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns)
    assert as_rows(got) == sorted(want.fetchall(), key=repr)


# ---- phrases ---------------------------------------------------------------------------------
def mined(docs, least, longest, top=2000, within=50):
    """The contract in plain Python over (lang, text) pairs, for phrases of up to ``longest`` words."""
    f = Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = {}
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in cand.items():
        held = any(
            len(q) > len(p) and m == lang and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (m, q), b in cand.items()
        )
        if not held:
            cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]]))
    n = Counter()
    for (lang, p), a in f.items():
        n[lang] += a * (len(p) == 1)
    return sorted(
        ((lang, i + 1, p.decode(), a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, _, p, a, left, right) in enumerate(sorted(rows)[:top])),
        key=repr,
    )


@pytest.mark.parametrize("longest, size", [(3, 1 << 22), (4, 300)])
def test_phrases_are_brute_force(spark, monkeypatch, longest, size):
    monkeypatch.setattr(collocations, "BLOCK", 64)
    rng = random.Random(11)
    vocab = ["the", "The", "of", "É", "new\tyork", "語", "a-b", "x.", "y,", "z!\n", "new york city"]
    docs = [(rng.choice(["en", None, "und"]), " ".join(rng.choices(vocab, k=rng.randrange(0, 50)))) for _ in range(150)]
    docs += [("de", None), ("de", ""), ("fr", " . \t"), ("en", "same row here " * 5), ("en", "same row here " * 5), ("xx", "a a a a a a a a a a a a a a")]
    docs += [("long", "one two three " * 30_000 + "." + "four five " * 50)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    for within, top in ((50, 2000), (90, 5)):
        got = as_rows(collocations.collocations(df, 10, longest, top, within, size))
        assert got == mined(docs, 10, longest, top, within)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_phrase_scores_are_exact(spark):
    """Products beyond 64 bits, floors, and ties that go to the first cut."""
    big = 10**13 + 7
    rows = [("en", 1, "a", big), ("en", 1, "b", big + 2), ("en", 2, "a b", big - 1), ("en", 1, "c", big), ("en", 2, "b c", big), ("en", 3, "a b c", 10**12)]
    got = {r.phrase: r for r in collocations.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, n long")).collect()}
    assert got["a b"].score == 10**6 * (big - 1) ** 2 // (big * (big + 2))
    want = min((10**6 * 10**24 // (f * r), k) for k, f, r in ((1, big, big), (2, big - 1, big)))
    assert (got["a b c"].score, got["a b c"].cut) == want


def test_other_columns_are_not_read(spark):
    docs = spark.createDataFrame([("en", "red wine " * 10, "x", "y", "z")], "lang string, text string, n string, words string, phrase string")
    assert [tuple(r) for r in collocations.collocations(docs).select("phrase", "a", "n").collect()] == [("red wine", 10, 20), ("wine red", 9, 20)][:1]


# ---- n-gram join -----------------------------------------------------------------------------
def shingle_sets(docs, width=5):
    out = []
    for _, text in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UP)) if x]
        out.append({" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def reached(docs, percent=80):
    sets = shingle_sets(docs)
    part = list(range(len(docs)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                part[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if sets[i] and d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def near_copies(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1, 1])] = [f"w{rng.randrange(10**6)}"] * rng.choice([0, 1, 1, 2])
        words = words or ["none"]
    return words


def join_texts():
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage = fresh(60)
    docs = []
    for n in (1, 2, 4, 5, 6, 9, 12, 20, 40, 80, 150):
        for _ in range(5):
            base = fresh(n)
            docs += [near_copies(rng, base, rng.randrange(0, max(1, n // 25) + 2)) for _ in range(4)]
    cloud = fresh(120)
    docs += [near_copies(rng, cloud, rng.randrange(0, 5)) for _ in range(30)]
    docs += [fresh(rng.randrange(0, 40)) + passage + fresh(rng.randrange(0, 40)) for _ in range(25)]
    docs += [["same", "words"] * 40, ["same", "words"] * 41, ["words"] * 5, ["words"] * 9, passage, passage]
    texts = [rng.choice([" ", "\t", " \n"]).join(d).replace("w1", rng.choice(["w1", "W1"])) for d in docs]
    rows = [(10_000 - 3 * i, t) for i, t in enumerate(texts)]
    rows += [(1, None), (2, ""), (3, " \n "), (None, texts[0]), (None, None), (5, texts[60]), (5, texts[60]), (6, "x " * 30_000), (7, "é x語 " * 300)]
    return rows


@pytest.mark.parametrize("short, rounds", [(32, 4), (3, 1)])
def test_join_is_brute_force(spark, monkeypatch, short, rounds):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    docs = join_texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = jaccard_join.join_components(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert as_rows(got) == reached(docs)


def test_prefix_of_long_lists_loses_no_pair(spark):
    """Sets that share e long lists still share one of those that are kept, and few others do."""
    rng = random.Random(3)
    members = {bytes([c]): (n, rng.sample(range(120), rng.randint(1, 60))) for c in range(60) for n in (rng.randint(20, 300),)}
    size = {h: jaccard_join.SHORT + 1 + rng.randrange(40) for h in range(120)}
    rows = [(h, c, n, size[h], len(hs)) for c, (n, hs) in members.items() for h in hs]
    kept = {c: set() for c in members}
    for r in jaccard_join.long_prefix(spark.createDataFrame(rows, "h long, c binary, n long, size long, long long")).collect():
        kept[bytes(r.c)].add(r.h)
    pairs = [(a, b) for a in members for b in members if a < b and 100 * min(members[a][0], members[b][0]) >= 80 * max(members[a][0], members[b][0])]
    enough = {(a, b) for a, b in pairs if len({*members[a][1]} & {*members[b][1]}) >= jaccard_join.extra(min(members[a][0], members[b][0]))}
    assert enough and all(kept[a] & kept[b] for a, b in enough)
    assert sum(map(len, kept.values())) < 0.9 * len(rows)


def test_join_at_the_border(spark):
    """Sets of 100 and 80, 79 and 81 shingles, all of the smaller one's in the larger."""
    words = [f"v{i}" for i in range(104)]
    docs = [(i, " ".join(words[:n])) for i, n in enumerate((104, 84, 83, 67, 66))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert as_rows(jaccard_join.join_components(df)) == reached(docs)
    assert jaccard_join.join_components(df.limit(0)).count() == 0


def test_join_keeps_columns(spark):
    names = ["row", "c", "n", "h", "lists", "hashes", "parity", "long", "size", "part", "a", "b", "my col"]
    docs = spark.createDataFrame([(i, "one two three four five six", *names) for i in (4, 2)], ["doc_id", "text", *names])
    out = jaccard_join.join_components(docs)
    assert set(out.columns) == {*docs.columns, "n_shingles", "component_id"} - {"text"}
    assert {(r["n_shingles"], r["component_id"], r["my col"]) for r in out.collect()} == {(2, 2, "my col")}


def test_merge_counts_and_overlaps():
    lists = [{"m": [b"a", b"c"], "w": 2}, {"m": [b"a", b"b"], "w": 1}, {"m": [b"c"], "w": 4}]
    assert list(jaccard_join.merged(lists)) == [(b"a", 3), (b"b", 1), (b"c", 6)]
    assert [jaccard_join.required(n) for n in (1, 2, 5, 6, 100)] == [1, 2, 4, 5, 80]
