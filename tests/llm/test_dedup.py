"""Near-duplicate operators against brute force, and their edge cases."""

import random
from collections import defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from streamloom.llm import decontaminate, graph, line_dedup, simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, *rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000 + i) for i in range(60)]
    want = Union()
    for a, b in edges:
        if a != b:
            want.join(a, b)
    df = spark.createDataFrame([*edges, (7, None)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert got == {x: want.find(x) for x in want.up}
    assert graph.connected_components(df.where("a < 0")).count() == 0


# ---- SimHash ---------------------------------------------------------------------------------
def test_fingerprint_rules():
    import xxhash

    f = simhash_dedup.fingerprint
    assert f(None) == f("") == f(" \t\n") == 0
    assert f("Ab cD") == xxhash.xxh64_intdigest("ab cd", 42) == f("\tab\x0bcd ")
    assert f("É a b") == xxhash.xxh64_intdigest("É a b".encode(), 42)
    assert f("a b c d") == xxhash.xxh64_intdigest("a b c", 42) & xxhash.xxh64_intdigest("b c d", 42)
    assert f("x " * 30_000) == f("x x x x")


@pytest.mark.parametrize("pairwise", [32, 2])
def test_links_are_those_of_all_pairs(spark, pairwise):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 1, 2, 2, 3, 4, 5)}
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    fps = sorted(fps)
    want = Union()
    arr = np.array(fps, np.uint64)
    for i, x in enumerate(fps):
        near = np.unpackbits((arr ^ np.uint64(x)).view(np.uint8).reshape(-1, 8), axis=1).sum(1) <= 2
        for j in np.nonzero(near)[0]:
            want.join(x, fps[j])
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = Union()
    for r in simhash_dedup.links(df, pairwise=pairwise).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert (a ^ b).bit_count() <= 2
        got.join(a, b)
    assert {x: want.find(x) for x in fps} == {x: got.find(x) for x in fps}


def test_simhash_query(spark, sf):
    rows = simhash_dedup.op10_simhash_dedup(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    fps = {i: simhash_dedup.fingerprint(t) for i, t in texts.items()}
    want = Union()
    for i, a in fps.items():
        for j, b in fps.items():
            if (a ^ b).bit_count() <= 2:
                want.join(i, j)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{f:016x}", want.find(i)) for i, f in fps.items()}


def test_near_dedup_edges(spark):
    df = docs_of(spark, (3, "a b c d"), (1, "a b c d"), (2, None), (4, ""), (5, "z y x w"), (5, "z y x w"), (None, "a b c d"), (None, "q r s t u"))
    kept = simhash_dedup.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect()) == [(-1, "q r s t u"), (1, "a b c d"), (2, ""), (5, "z y x w")]
    assert simhash_dedup.near_dedup(df.where("doc_id < 0")).count() == 0
    extra = df.withColumnsRenamed({"lang": "fp", "source": "component"})
    assert simhash_dedup.near_dedup(extra).columns == extra.columns


# ---- lines -----------------------------------------------------------------------------------
def brute_lines(rows, width=5):
    first, occurrences = {}, []
    for i, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for k, line in enumerate(text.split("\n")):
            if n := line.strip(" ").lower():
                occurrences.append((i, k, n))
                first.setdefault(n, (i, k))
    names = list(first)
    sets = [{n[j : j + width] for j in range(max(1, len(n) - width + 1))} for n in names]
    index, want = defaultdict(list), Union()
    for x, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for y in index[g]:
                common[y] += 1
            index[g].append(x)
        for y, k in common.items():
            if k >= 0.8 * (len(s) + len(sets[y]) - k):
                want.join(x, y)
    keep = {}
    for x, n in enumerate(names):
        root = want.find(x)
        keep[root] = min(keep.get(root, first[n]), first[n])
    place = {n: x for x, n in enumerate(names)}
    gone = defaultdict(set)
    for i, k, n in occurrences:
        if keep[want.find(place[n])] != (i, k):
            gone[i].add(k)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup_against_all_pairs(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute_lines([(r.doc_id, r.text) for r in df.collect()])
    assert {r.doc_id: r.text for r in line_dedup.op5_line_dedup(spark, sf).collect()} == want


def test_fuzzy_lines_and_edges(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    base = [" ".join(rng.sample(words, 30)) for _ in range(20)]
    rows = [(i, "\n".join(base)) if i == 0 else (i, "\n".join(" ".join(w if k != i else "changed" for k, w in enumerate(b.split())) for b in base)) for i in range(6)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "Same line here\n\nsame LINE here "), (104, "漢字かな交じりの長い文がここにあります。" * 3), (105, "漢字かな交じりの長い文がここにあります。" * 3 + "終")]
    df = docs_of(spark, *rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert {i: r.text for i, r in got.items()} == brute_lines(rows)
    assert got[1].text == "" and got[1].lines_in == 20 and got[1].lines_kept == 0
    assert got[100].lines_in == 0 and got[103].text == "Same line here\n"
    twice = df.unionByName(df.where("doc_id = 0"))
    assert [r.lines_kept for r in line_dedup.dedup_lines(twice).where("doc_id = 0").collect()] == [20, 20]
    assert line_dedup.dedup_lines(df.where("doc_id < 0")).count() == 0
    clash = df.withColumnsRenamed({"lang": "lines_in", "source": "h1"})
    assert set(line_dedup.dedup_lines(clash).columns) == {"doc_id", "text", "h1", "n_chars", "lines_in", "lines_kept"}
    nulls = docs_of(spark, (None, "a line of text"), (2, "a line of text"))
    assert sorted(r.text for r in line_dedup.dedup_lines(nulls).collect()) == ["", "a line of text"]


def test_short_lines_and_lines_of_long_tokens(spark):
    rng = random.Random(8)
    token = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = [(1, "terms of use"), (2, "terms of use."), (3, "all rights reserved"), (4, "all rights reserved 1"), (5, "-" * 9), (6, "-" * 90)]
    for i in range(10, 210, 2):
        base = token(rng.randint(8, 400)) if i % 4 else " ".join(token(rng.randint(1, 9)) for _ in range(rng.randint(2, 8)))
        at = rng.choice([0, len(base) // 2, len(base)])
        rows += [(i, base), (i + 1, base[:at] + "#" + base[at:])]
    df = docs_of(spark, *rows)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(rows)
    assert got[2] == "" and got[6] == "" and sum(t == "" for t in got.values()) > 60


ALPHA = "abcdefghijklmnopqrstuvwxyz0123456789"


def near_pairs(kind, count, rng):
    """Lines and edited copies just over the similarity, with much in common or not at all with others."""
    token = lambda n, letters=ALPHA: "".join(rng.choice(letters) for _ in range(n))
    make = {
        "token": lambda: token(rng.randint(20, 400)),
        "words": lambda: " ".join(token(rng.randint(2, 9), ALPHA[:26]) for _ in range(8)),
        "url": lambda: "https://www." + token(10) + ".com/" + "/".join(token(rng.randint(3, 12)) for _ in range(rng.randint(2, 12))),
        "han": lambda: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randint(15, 300))),
        "long": lambda: " ".join(token(rng.randint(2, 9), ALPHA[:26]) for _ in range(rng.randint(40, 120))),
    }[kind]
    cut = lambda x: {x[i : i + 5] for i in range(max(1, len(x) - 4))}
    out = []
    while len(out) < count:
        x = make()
        y, near = x, None
        while True:
            at = rng.randrange(len(y))
            y = y[:at] + rng.choice("#%&$") + y[at + 1 :]
            a, b = cut(x), cut(y)
            if len(a & b) < 0.8 * len(a | b):
                break
            near = y
        if near:
            out.append((x, near))
    return out


@pytest.mark.parametrize("kind", ["token", "words", "url", "han", "long"])
def test_recall_just_over_the_similarity(spark, kind):
    pairs = near_pairs(kind, 250, random.Random(11))
    docs = docs_of(spark, *[(i, "\n".join(p)) for i, p in enumerate(pairs)])
    kept = {r.doc_id: r.lines_kept for r in line_dedup.dedup_lines(docs).collect()}
    assert sum(n == 1 for n in kept.values()) >= 0.95 * len(pairs)


@pytest.mark.parametrize("size, times", [(60, 5), (150, 2), (155, 3), (190, 2), (40, 40)])
def test_lines_that_repeat_themselves(spark, size, times):
    """A line and the same written several times in a row: nearly the same shingles at any two lengths."""
    rng = random.Random(size)
    pairs = []
    for _ in range(40):
        x = "".join(rng.choice(ALPHA) for _ in range(size))
        pairs.append((x, x * times))
    docs = docs_of(spark, *[(i, "\n".join(p)) for i, p in enumerate(pairs)])
    kept = {r.doc_id: r.lines_kept for r in line_dedup.dedup_lines(docs).collect()}
    cut = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    similar = [i for i, (x, y) in enumerate(pairs) if len(cut(x) & cut(y)) >= 0.8 * len(cut(x) | cut(y))]
    assert len(similar) == 40 and sum(kept[i] == 1 for i in similar) >= 0.95 * 40


def test_signatures_are_minima_of_all_shingles(spark):
    """Rows of several shingles give the plain minima at every length, and no row of a shingle carries a decimal."""
    rng = random.Random(6)
    lines = [x for n in (1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 40, 41, 42, 43) for x in ("".join(rng.choice("abcé漢𝄞") for _ in range(n)),)]
    table = line_dedup.line_table(docs_of(spark, (9, "\n".join(lines)), (None, lines[5]), (3, f"{lines[7]}\n{lines[7]}")))
    assert not any(t.startswith("decimal") for _, t in table.dtypes)
    got = {r.h1: r for r in table.collect()}
    pieces = [(x, x[i : i + 5].encode("utf-32-be")) for x in lines for i in range(max(1, len(x) - 4))]
    want = defaultdict(set)
    for r in spark.createDataFrame(pieces, "line string, piece binary").select(F.xxhash64("line").alias("h1"), F.hash("piece").alias("x")).collect():
        want[r.h1].add(r.x)
    assert {h: r.sig for h, r in got.items()} == {h: [min(x ^ m for x in xs) for m in line_dedup.masks()] for h, xs in want.items()}
    h = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(F.xxhash64("x")).collect()]
    assert [(got[h[k]].doc, got[h[k]].n) for k in (0, 5, 7)] == [(9, 1), (-(2**63), 2), (3, 3)]


def test_minima_of_pairs_without_a_branch(spark):
    """Each pair's lesser hash is the same as by comparison, with equal hashes, either sign and neighbours."""
    rng = random.Random(21)
    some = [0, -1, 1, 2**31 - 1, -(2**31), 1 - 2**31, *[rng.getrandbits(32) - 2**31 for _ in range(14)]]
    n = line_dedup.STEP
    rows = [(a, b, *[rng.choice(some) for _ in range(n - 2)]) for a in some for b in some]
    cut = spark.createDataFrame(rows, ", ".join(f"x{k} int" for k in range(n))).select("*", F.array(*[f"x{k}" for k in range(n)]).alias("given"))
    least = F.array(*[F.array(*[line_dedup.pair_min(k, m) for k in range(n // 2)]) for m in line_dedup.masks()])
    for given, got in line_dedup.paired(cut).select("given", least).collect():
        assert got == [[min(a ^ m, b ^ m) for a, b in zip(given[::2], given[1::2])] for m in line_dedup.masks()]


def test_hubs_do_not_depend_on_the_order_of_rows(spark):
    """Of equally common lines the hub is the one of the greatest hash, whatever row comes first."""
    rng = random.Random(22)
    rows = [(h, 1 + (h % 3 == 0), [g] * 30) for g in range(60) for h in range(100 * g, 100 * g + 7)]
    rng.shuffle(rows)
    got = line_dedup.in_buckets(spark.createDataFrame(rows, "h1 long, n long, sig array<int>")).collect()
    assert len(got) == 12 * len(rows) and all(r.size == 7 for r in got)
    want = {g: max((n, h) for h, n, sig in rows if sig[0] == g)[1] for g in range(60)}
    assert {(r.h1 // 100, r.hub) for r in got} == set(want.items())


def test_texts_of_wanted_lines_once(spark):
    """A line's text is taken once from whichever document has it, null ids included."""
    docs = docs_of(spark, (None, "first line\nSecond line"), (4, "second LINE \nthird line"), (4, "second line"), (5, None))
    wanted = line_dedup.exploded(docs).where("norm = 'second line'").select("h1").distinct()
    assert [r.norm for r in line_dedup.line_texts(docs, wanted).select("norm").collect()] == ["second line"]


def test_document_of_many_equal_lines_and_repetitive_lines(spark):
    many = "\n".join(["the same line"] * 300_000)
    rows = [(1, many), (2, "ab" * 400), (3, "ab" * 700), (4, "-" * 999), (5, "-" * 500)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, *rows)).collect()}
    assert got[1].text == "the same line" and (got[1].lines_in, got[1].lines_kept) == (300_000, 1)
    assert [got[i].lines_kept for i in (2, 3, 4, 5)] == [1, 0, 1, 0]


def test_crowded_bucket_is_split(spark):
    rng = random.Random(9)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20))
    own = lambda: " ".join("".join(rng.choice("ijklmnop") for _ in range(6)) for _ in range(8))
    lines = [f"{passage} {own()}" for _ in range(300)]
    rows = [(i, x) for i, x in enumerate(lines)] + [(1000 + i, x[:-3] + "zzz") for i, x in enumerate(lines)]
    got = {r.doc_id: r.lines_kept for r in line_dedup.dedup_lines(docs_of(spark, *rows)).collect()}
    want = brute_lines(rows)
    assert sum(got[i] == (want[i] != "") for i in got) >= 0.95 * len(rows)


def test_bit_maps_never_rule_out_similar_lines(spark):
    rng = random.Random(2)
    lines = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 300))).strip() or "x" for _ in range(30)]
    lines += [x[: len(x) // 2] + "zz" + x[len(x) // 2 :] for x in lines]
    texts = spark.createDataFrame([(i, i, t) for i, t in enumerate(lines)], "h1 long, h2 long, norm string")
    maps = line_dedup.bit_maps(texts)
    a = maps.selectExpr("h1 as a", "size as size_a", "map as map_a")
    b = maps.selectExpr("h1 as b", "size as size_b", "map as map_b")
    passed = {(r.a, r.b) for r in a.crossJoin(b).where(line_dedup.maps_allow(0.8)).select("a", "b").collect()}
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if len(x & y) >= 0.8 * len(x | y):
                assert (i, j) in passed


def test_bytes_apart_and_rivals_in_a_single_bucket(spark):
    rng = random.Random(4)
    rows = [(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for _ in range(40)] + [(5, 5), (-1, 0), (-1, 255)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", line_dedup.bytes_apart(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        assert r.n == sum(x != y for x, y in zip(r.a.to_bytes(8, "big", signed=True), r.b.to_bytes(8, "big", signed=True)))
    base = [rng.getrandbits(31) for _ in range(30)]
    sigs = {1: base, 2: base[:16] + [x ^ 1 for x in base[16:]], 3: base[:15] + [x ^ 1 for x in base[15:]], 4: base}
    signed = spark.createDataFrame([(h, 1, sig) for h, sig in sigs.items()], "h1 long, n long, sig array<int>")
    # one shared bucket is enough: 1 meets 2 in bucket 10 only; 3 agrees too rarely, 4 is of the same component
    placed = spark.createDataFrame([(10, 1, 1), (10, 2, 2), (11, 1, 1), (11, 3, 3), (12, 1, 1), (12, 4, 1)], "bucket long, h1 long, component long")
    met = {(r.bucket, r.h1) for r in line_dedup.with_rivals(placed, signed).collect()}
    assert met == {(10, 1), (10, 2)}


def test_second_links_need_one_shared_bucket_only(spark):
    """Every verified pair of a bucket is found, also one that is in no other bucket and away from the hub."""
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(60))
    lines = []
    for _ in range(120):
        x = passage + "".join(rng.choice("ijklmnop") for _ in range(25))
        lines += [x, x[:-6] + "".join(rng.choice("qrst") for _ in range(6))]
    docs = docs_of(spark, *enumerate(lines))
    table = line_dedup.line_table(docs).cache()
    by_hash = {r.h1: r.norm for r in line_dedup.exploded(docs).select("h1", "norm").distinct().collect()}
    cut = {h: {x[i : i + 5] for i in range(len(x) - 4)} for h, x in by_hash.items()}
    similar = {(a, b) for a in cut for b in cut if a > b and len(cut[a] & cut[b]) >= 0.8 * len(cut[a] | cut[b])}
    shared = defaultdict(set)
    for r in line_dedup.in_buckets(table).select("bucket", "h1").collect():
        shared[r.bucket].add(r.h1)
    together = {(a, b) for hs in shared.values() for a in hs for b in hs if a > b}
    parts, second = line_dedup.line_links(docs, table)
    got = {r.node.h1: r.component for r in line_dedup.components(parts, second).collect()}
    assert similar & together
    assert sum(a in got and got[a] == got.get(b) for a, b in similar & together) >= 0.99 * len(similar & together)


# ---- decontamination -------------------------------------------------------------------------
def brute_leaks(docs, items, width=5, starts=False):
    """Similarity of the best window of each document and item, by trying them all; with ``starts`` its first word as well."""
    from collections import Counter

    def words(t):
        spaced = regex.sub(r"([\p{Han}\p{Hiragana}\p{Katakana}])", r" \1 ", (t or "").lower())
        return [w for w in regex.split(r"[^\p{L}\p{N}]+", spaced) if w]

    def cut(w, k):
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    out = {}
    for i, text in docs:
        for k, item in items:
            own = words(item)
            k_width = min(width, len(own))
            s, h = cut(own, k_width) if own else [], cut(words(text), k_width) if own else []
            if not s or not set(s) & set(h):
                continue
            best, first = 0.0, 0
            for at in range(max(1, len(h) - len(s) + 1)):
                w = Counter(h[at : at + len(s)])
                common = sum((w & Counter(s)).values())
                now = common / (sum(w.values()) + len(s) - common)
                if now > best:
                    best, first = now, at
            if best >= 0.8:
                out[i, k] = (round(best, 6), first) if starts else round(best, 6)
    return out


def test_decontamination_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.op3_decontamination(spark, sf).collect()}
    assert got == brute_leaks(docs, items, starts=True)


def test_decontamination_edges(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    item = " ".join(rng.sample(words, 60))
    edited = item.split()
    edited[-1] = "other"
    clean = " ".join(rng.sample(words, 60))
    half = " ".join([*item.split()[:30], *rng.sample(words, 30)])
    docs = [(1, f"x y z {item} t"), (2, item.upper().replace(" ", ", ")), (3, " ".join(edited)), (4, clean), (5, half), (6, None), (7, ""), (8, "two words"), (9, "x two words"), (10, "la " * 50), (11, f"{item} {item}")]
    items = [(1, item), (2, item), (3, "two words"), (4, None), (5, " !! "), (6, "la " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(spark, *docs)
    found = decontaminate.leaks(df, bench)
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in found.collect()}
    assert got == brute_leaks(docs, items)
    assert {i for i, _ in got} == {1, 2, 3, 8, 9, 10, 11}
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]
    assert decontaminate.decontaminate(df, bench.where("item_id < 0")).count() == len(docs)
    assert decontaminate.leaks(df.where("doc_id < 0"), bench).count() == 0
    repeated = df.unionByName(df)
    assert decontaminate.decontaminate(repeated, bench).count() == 8


def test_short_unspaced_null_and_repeated_items(spark):
    docs = [(1, "it holds the secret pass phrase here"), (2, "secret pass"), (3, "前の文。漢字の問題がここにあります。後の文"), (4, "nothing"), (None, "word " * 9 + "secret pass phrase")]
    items = [(1, "Secret, pass phrase!"), (2, "漢字の問題がここにあります"), (None, "nothing"), (1, "word word word word word word word word"), (5, "問題")]
    found = decontaminate.leaks(docs_of(spark, *docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, i, *v) for n, (i, t) in enumerate(items) for (d, _), v in brute_leaks(docs, [(i, t)], starts=True).items()}
    assert {(r.doc_id, r.item_id, round(r.similarity, 6), r.start_word) for r in found} == want
    assert {(d, i) for d, i, *_ in want} == {(1, 1), (3, 2), (3, 5), (4, None), (None, 1)}


def test_recall_of_the_radius():
    """Pairs of shingle sets just over 0.8 lie within the radius but for one in a hundred at most."""
    rng, hit, total = np.random.default_rng(3), 0, 400
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    fold = lambda hs: ((hs[:, None] & powers) != 0).sum(0) * 2 > len(hs)
    for _ in range(total):
        n = int(rng.integers(15, 200))
        common = int(np.ceil(n * 1.6 / 1.8))
        x, y, z = (rng.integers(0, 1 << 63, k, dtype=np.uint64) * 2 + rng.integers(0, 2, k, dtype=np.uint64) for k in (common, n - common, n - common))
        hit += (fold(np.concatenate([x, y])) != fold(np.concatenate([x, z]))).sum() <= decontaminate.RADIUS
    assert hit >= 0.99 * total


def test_best_window_between_two_alignments(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(7))
    docs, items = [], []
    for i in range(12):
        item = [word() for _ in range(104)]
        inside = [word() for _ in range(3)] + item[3:52] + [word() for _ in range(6)] + item[52:101] + [word() for _ in range(3)]
        items.append((i, " ".join(item)))
        before, after = ([word() for _ in range(k)] for k in (i % 3 * 20, 30))
        docs.append((i, " ".join([*before, *inside, *after])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(docs_of(spark, *docs), bench).collect()
    want = brute_leaks(docs, items)
    assert len(want) == 12 and {(r.doc_id, r.item_id): round(r.similarity, 6) for r in found} == want
    assert all(r.start_word > 0 for r in found if r.doc_id % 3)


def test_multi_index_guarantee():
    """Some block differs in RADIUS // BLOCKS bits or fewer, whatever RADIUS bits differ."""
    rng = random.Random(6)
    steps = {n: set(decontaminate.flips(n, decontaminate.RADIUS // decontaminate.BLOCKS)) for _, n in decontaminate.block_bounds()}
    for _ in range(500):
        x = sum(1 << i for i in rng.sample(range(64), decontaminate.RADIUS))
        assert any((x >> a) & ((1 << n) - 1) in steps[n] for a, n in decontaminate.block_bounds())
