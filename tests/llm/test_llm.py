"""The training-data operators against brute force, round trips and held-out rows, with the odd cases of each."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import adaptive_scan, bpe, common, dart_minhash, license_scan, mixing, ngram_quality, pq_dedup, queries, token_files, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source="s", lang="en"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(600)]
    return r, lambda n: " ".join(r.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def library():
    e = bpe.Encoder(bpe.vocabulary())
    return e


ODD = [None, "", " ", "\n", "\n\n a", "a \n b", "tab\tand  two", "\xa0x\xa0 y", "don't 'll 's", "x" * 500, "日本語 テキスト", "😀😀 a", "<|endoftext|>a <|endoftext|>", "\0 \0a", "é" * 300, "!?!? ...", "a. b, c: d"]


# -- op9, op2 ------------------------------------------------------------------------------------------------------------


def test_encoder_equals_library(library):
    r = random.Random(7)
    parts = [" ", "  ", "\n", "\n\n", "\t", "the", "tion", "é", "x" * 30, "'s", "!!!", "123", "日本", "😀", "<|endoftext|>", "Word,", "a.", "\0", "\x1c", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    got = library.encode(texts)
    for t, g in zip(texts, got, strict=True):
        want = library.ids(t)
        assert np.frombuffer(g, "<u4").tolist() == want, repr(t)
        assert library.decode(g) == library.lib.decode(want, skip_special_tokens=False).encode()


def test_cuts_hold_for_all_plain_characters(library):
    for c in range(bpe.PLAIN):
        for t in (f"a{chr(c)}b", f"!{chr(c)}1", f" {chr(c)} x", f"'{chr(c)}s"):
            want = library.ids(t)
            for k in range(1, len(t)):
                if library.cut(t[k - 1], t[k]):
                    assert library.ids(t[:k]) + library.ids(t[k:]) == want, repr(t)


@pytest.mark.parametrize("window", [1, 2, 16])
def test_tree_equals_whole(library, monkeypatch, window):
    monkeypatch.setattr(bpe, "WINDOW", window)
    r = random.Random(window)
    for _ in range(300):
        t = "".join(r.choice(["ab", " ", "tion", "é", "!!", "  ", "\n", "'ll", "日", "9" * 7, "q" * 50]) for _ in range(r.randint(1, 40)))
        leaves = library.encode(bpe.halves(t, r.choice([1, 3, 8])))
        assert library.tree([np.frombuffer(x, "<u4") for x in leaves]).tolist() == library.ids(t)


def test_round_trip_with_small_leaves(spark, library, corpus):
    texts = [*ODD, corpus[1](400), "z" * 900 + " end", corpus[1](50) + "<|endoftext|>" + corpus[1](60)]
    df = docs(spark, texts).withColumn("ids", F.lit("clash")).unionByName(docs(spark, ["again", "again"]).withColumn("ids", F.lit("x")))
    got = sorted(map(tuple, bpe.bpe_round_trip(df, leaf=64).collect()))
    want = []
    for i, t in [*enumerate(texts), (0, "again"), (1, "again")]:
        ids = library.ids(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.bpe_round_trip(df.limit(0)).count() == 0


def test_token_files(spark, library, tmp_path):
    df = docs(spark, ODD).repartition(3)
    path = str(tmp_path / "orc")
    token_files.write_tokens(df, path, partitions=3)
    got = sorted(map(tuple, token_files.token_digest(token_files.read_tokens(spark, path)).collect()))
    start, want = 0, []
    for i, t in enumerate(ODD):
        ids = [*library.ids(t or ""), 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    one = token_files.read_tokens(spark, path).where("doc_id = 8").first()
    assert list(one.ids) == [*library.ids(ODD[8]), 2]
    assert token_files.token_files(df.limit(0)).count() == 0


# -- op8 -----------------------------------------------------------------------------------------------------------------


def brute_rule(rules, host, path):
    fit = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.host.split(".")) if r.host else 0, len(r.path)), default=None)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?a#b", "https://example.com", "http://a.example.com/en/", "http://notexample.com/en/1", "x://net/es/", "x://a.net/fr/q", "x://a.net/de/", "http://www.example.com/en", "a://b://com/", "http://É.Com/"]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    a = sorted(map(tuple, url_filter.filter_urls(pages, queries.URL_RULES).collect()))
    b = sorted(map(tuple, url_filter.filter_urls_joined(pages, spark.createDataFrame([tuple(r) for r in queries.URL_RULES], "verdict string, host string, path string")).collect()))
    want = []
    for i, u in enumerate(urls):
        h, p = url_filter.url_parts(u)
        r = brute_rule(queries.URL_RULES, h, p)
        want.append((i, h, p, r and r.name, r.verdict if r else "allow"))
    assert a == want and b == want
    assert a[4][1:] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")


def test_joined_rules_with_any_path(spark, monkeypatch):
    hosts = ["example.com", "a.example.com", "b.org"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/ads", "/adsense", "/ads/x", "/index.html", "/en/in", "/en/index.html?q", "/en/x", "/e")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [url_filter.Rule(*r) for r in [("block", "example.com", "/ads"), ("allow", "example.com", "/ads/"), ("block", "example.com", "/index.html"), ("block", "", "/en/in"), ("allow", "example.com", "/en/"), ("block", "b.org", "/e"), ("allow", "b.org", "/en/i"), ("allow", "a.example.com", "/ad"), ("block", "b.org", "/en/i")]]
    want = sorted(map(tuple, url_filter.filter_urls(pages, rules).collect()))
    monkeypatch.setattr(url_filter, "MAX_TRIE_RULES", 2)
    assert sorted(map(tuple, url_filter.filter_urls(pages, rules).collect())) == want
    assert (0 * 10 + 3, "example.com", "/adsense", "example.com/ads", "block") in want


def test_empty_host_labels(spark):
    rules = queries.URL_RULES
    urls = ["http://a..com", "http://a..com/", "http://.com/x", "http://com", "http://com/", "http:///x", "http://net./es/"]
    for found in (url_filter.filter_urls, lambda p, r: url_filter.filter_urls_joined(p, spark.createDataFrame([tuple(x) for x in r], "verdict string, host string, path string"))):
        got = [r.rule for r in found(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()]
        assert got == [None, "com/", "com/", None, "com/", None, None]


def test_trie_against_brute_force():
    r = random.Random(2)
    hosts = [".".join(p) for n in (1, 2, 3) for p in itertools.product("ab", repeat=n)]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/y/"]
    for _ in range(200):
        rules = list({(h, p): url_filter.Rule(r.choice(["allow", "block"]), h, p) for h, p in ((r.choice([*hosts, ""]), r.choice(paths)) for _ in range(6))}.values())
        t = url_filter.Trie(rules)
        for h in hosts:
            for p in ["", "/", "/x", "/xy", "/x/y", "/x/yz/", "/x/y/z"]:
                assert t.find(h, p) == brute_rule(rules, h, p)


# -- op1 -----------------------------------------------------------------------------------------------------------------


def near_classes(texts, least=0.8):
    def sh(t):
        w = re.findall(r"\w+", t.lower())
        runs = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else [("\n", t)]
        return frozenset((x, runs[:k].count(x)) for k, x in enumerate(runs))

    sets = {i: sh(t) for i, t in enumerate(texts) if t is not None}
    up = {i: i for i in range(len(texts))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n >= least * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark, corpus):
    r, text = corpus
    base = [text(r.randint(20, 200)) for _ in range(25)]
    texts = [None, None, "", "", "!!!", "!!!", "?", "one", "ONE.", "one two", *base]
    for b in base[:12]:
        for _ in range(r.randint(1, 12)):
            w = b.split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = "edited"
            texts.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    r.shuffle(texts)
    df = docs(spark, texts).withColumn("id", F.lit("clash")).withColumn("fp", F.lit(1))
    got = dart_minhash.near_duplicates(df).collect()
    assert {x.doc_id: x.class_id for x in got} == dict(enumerate(near_classes(texts)))
    assert all(x.keep == (x.doc_id == x.class_id) for x in got)
    assert dart_minhash.near_duplicates(df.limit(0)).count() == 0
    twice = dart_minhash.near_duplicates(docs(spark, ["a b c d e f"]).unionByName(docs(spark, ["a b c d e f"]))).collect()
    assert sorted((x.doc_id, x.class_id, x.keep) for x in twice) == [(0, 0, False), (0, 0, True)]


def test_near_duplicates_of_repeated_doc_ids(spark):
    """A doc_id with two texts: one a copy of another document's, one its own."""
    a, b = "one two three four five six seven", "red green blue white black grey pink"
    rows = [(1, a, "en", "s", 0), (2, a, "en", "s", 0), (2, b, "en", "s", 0), (2, b, "en", "s", 0), (3, None, "en", "s", 0), (3, None, "en", "s", 0), (None, a, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("_row", F.lit(1)).withColumn("id", F.lit("x"))
    got = sorted((str(x.doc_id), x.class_id, x.keep) for x in dart_minhash.near_duplicates(df).collect())
    assert got == [("1", 1, True), ("2", 1, False), ("2", 2, False), ("2", 2, True), ("3", 3, True), ("3", 3, True), ("None", None, True)]
    kept = dart_minhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(x.doc_id), x.text) for x in kept.collect() if x.text) == [("1", a), ("2", b), ("None", a)]
    assert dart_minhash.one_of_each(df.limit(0)).count() == 0


def test_near_duplicates_of_many_rows_without_doc_id_or_text(spark):
    """They stay, each a class of its own, and so do rows alike in all columns."""
    rows = [(None, "one two three four five six", "en", "s", 0)] * 40 + [(None, None, "en", "s", 0)] * 40 + [(k % 5, None, "en", "s", 0) for k in range(40)] + [(9, "", "en", "s", 0)] * 3
    got = [(x.doc_id, x.class_id, x.keep) for x in dart_minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()]
    assert got.count((None, None, True)) == 80 and all(got.count((k, k, True)) == 8 for k in range(5))
    assert sorted(g for g in got if g[0] == 9) == [(9, 9, False), (9, 9, False), (9, 9, True)]
    assert dart_minhash.one_of_each(spark.createDataFrame(rows, DOCS)).count() == 121


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    off = []
    for _ in range(40):
        u = rng.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = (rng.integers(1, 6, 60).astype(float), rng.integers(1, 6, 60).astype(float)) if _ % 2 else (rng.random(60) * 3 + 0.05, rng.random(60) * 3 + 0.05)
        off.append((dart_minhash.signature(u, a, 256) == dart_minhash.signature(u, b, 256)).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {v: v for e in edges for v in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()))
    assert got == {v: root(v) for e in edges for v in e if e[0] != e[1]}


def test_components_of_long_shuffled_paths(spark):
    edges, want = [], {}
    for k, n in enumerate((3000, 1000, 2)):
        ids = list(range(k * 10_000, k * 10_000 + n))
        random.Random(k).shuffle(ids)
        edges += zip(ids, ids[1:])
        want |= dict.fromkeys(ids, k * 10_000)
    assert dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long"), "t", rounds=20).collect())) == want
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long"), "t").count() == 0


def test_only(spark):
    a, k = spark.range(5000).withColumnRenamed("id", "doc_id"), spark.range(0, 9000, 7).withColumnRenamed("id", "doc_id")
    assert common.only(a, k, "doc_id").count() == 715


# -- op3 -----------------------------------------------------------------------------------------------------------------


def brute_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, free = 1.5 * sum(size.values()), {}, set(names)
    while True:
        rest = total - sum(target.values())
        over = [s for s in free if rest * w[s] / sum(w[x] for x in free) > 2 * size[s] + 1e-9]
        if not over:
            return target | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            target[s] = 2.0 * size[s]
            free.discard(s)


def test_mix(spark, corpus):
    r, text = corpus
    rows = [(i, None if i % 97 == 0 else text(r.randint(0, 60)), "en", r.choice(["b", "b", "b", "b", "a", "é", "Z", None]), 0) for i in range(1200)]
    df = spark.createDataFrame(rows, DOCS).withColumn("p", F.lit(9)).withColumn("row", F.lit("clash"))
    got = mixing.mix(df, block=60).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(5), block=60).collect()))
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = brute_targets(size)
    taken = {}
    for x in got:
        assert x.taken == x.copies * x.size and 0 <= x.copies <= 2 and x.source_size == size[x.source]
        assert abs(x.target - want[x.source]) < 1e-6
        taken[x.source] = taken.get(x.source, 0) + x.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 120, (s, taken[s], want[s])
    assert mixing.mix(df.limit(0)).count() == 0
    assert {x.taken for x in mixing.mix(docs(spark, ["", None, " "])).collect()} == {0}


def test_mix_of_a_hot_doc_id(spark, corpus, monkeypatch):
    """Rows of one doc_id, and rows without any, are dealt to blocks like others and all come back."""
    monkeypatch.setattr(mixing, "RUN", 7)
    r, text = corpus
    rows = [(None if k % 3 else 5, text(r.randint(1, 20)) if k % 2 else "same words here", "en", "s" if k % 4 else None, 0) for k in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    seen = []
    real = mixing.decide

    def spy(seed, last, names):
        seen.append(names)
        return real(seed, last, names)

    monkeypatch.setattr(mixing, "decide", spy)
    got = mixing.mix(df, block=40).collect()
    assert sorted((str(x.doc_id), str(x.source), x.size) for x in got) == sorted((str(a), str(s), len(t.split())) for a, t, _, s, _ in rows)
    taken, target = {}, {}
    for x in got:
        taken[x.source], target[x.source] = taken.get(x.source, 0) + x.taken, x.target
    assert len(seen) > 1 and all(abs(taken[s] - target[s]) <= 20 for s in taken)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7), block=40).collect()))
    counts = spark.createDataFrame([(1, 1), (2, 7), (3, 8), (4, 30)], "row long, n long")
    assert sorted((x.row, x.place) for x in mixing.unrolled(counts).collect()) == [(k, j) for k, n in ((1, 1), (2, 7), (3, 8), (4, 30)) for j in range(n)]


def test_flight_keeps_totals():
    r = random.Random(4)
    size, p = [float(r.randint(0, 50)) for _ in range(500)], [0.37] * 500
    q = mixing.flight(size, p, r)
    assert sum(0 < x < 1 for x in q) <= 3
    assert abs(sum(q) - sum(p)) < 1e-6 and abs(sum(a * b for a, b in zip(q, size, strict=True)) - 0.37 * sum(size)) < 1e-6


# -- op4, op7 ------------------------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one_and_equals_plain(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "zebra"] * 3
    model = ngram_quality.train(docs(spark, texts))
    p = np.exp(model.dense().astype(np.float64)).reshape(-1, 64)
    assert np.allclose(p.sum(1), 1, atol=1e-4)

    # plain recursion over dictionaries
    order, grams = ngram_quality.ORDER, {k: {} for k in range(1, 5)}
    for t in texts:
        s = ngram_quality.symbols(t).tolist()
        for k in range(order - 1, len(s)):
            g = tuple(s[k - order + 1 : k + 1])
            grams[4][g] = grams[4].get(g, 0) + 1
    for k in (3, 2, 1):
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
    disc = {k: ngram_quality.discounts([sum(v == j for v in grams[k].values()) for j in (1, 2, 3, 4)]) for k in grams}

    def prob(g):
        k = len(g)
        if k == 0:
            return 1 / 64
        seen = {h: n for h, n in grams[k].items() if h[:-1] == g[:-1]}
        if not seen:
            return prob(g[1:])
        total, off = sum(seen.values()), lambda n: disc[k][min(n, 3) - 1]
        own = (seen[g] - off(seen[g])) / total if g in seen else 0
        return own + sum(map(off, seen.values())) / total * prob(g[1:])

    for g in [*list(grams[4])[:40], (5, 6, 7, 8), (0, 0, 0, 21), (9, 9, 9, 9)]:
        code = (g[0] << 12) | (g[1] << 6) | g[2]
        assert abs(p[code, g[3]] - prob(g)) < 1e-5


def test_quality(spark, corpus):
    r, text = corpus
    rows = [(i, text(60), "en", "s", 0) for i in range(150)] + [(200 + i, " ".join(r.choice(["$$$", "%%%", "#9#", "@@x"]) for _ in range(60)), "en", "s", 0) for i in range(20)]
    rows += [(300, None, "en", "s", 0), (301, "", "xx", "s", 0), (302, text(60), None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("log_ppl", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(205, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in ngram_quality.quality(df, labels).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].keep for i in range(150)) >= 145 and got[302].keep
    assert not any(got[200 + i].keep for i in range(20)) and not got[300].keep and not got[301].keep
    kept = ngram_quality.kept(df, labels)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.keep}
    none = ngram_quality.quality(df, labels.limit(0)).collect()
    assert {x.doc_id for x in none if not x.keep} == {300, 301}
    assert ngram_quality.quality(df.limit(0), labels).count() == 0


def test_packs():
    rng = np.random.default_rng(2)
    cols = [rng.integers(0, 1 << 40, 1000), rng.random(1000).astype(np.float32), np.zeros(0, np.int64), rng.integers(0, 9, 3).astype(np.uint16)]
    for want, got in zip(cols, ngram_quality.unpack(ngram_quality.pack(*cols)), strict=True):
        assert want.dtype == got.dtype and (want == got).all()


@pytest.mark.parametrize("held, shards, spread", [(0, 1, False), (0, 5, True), (8, 5, True), (None, 3, False)])
def test_words_equal_plain_kneser_ney(spark, held, shards, spread, monkeypatch):
    texts = ["the cat sat on the mat.", "the dog sat", "a cat and a dog", "Zebra", "the cat sat on a dog"] * 2 + ["the dog and the cat", "кот и пёс", "пёс и кот и пёс"]
    if spread:
        known = ngram_quality.Words(np.zeros(1 << 24))
        frequent = np.sort(np.unique(np.concatenate([known.of("the dog и")[0], known.of("Zebra")[0]])))
        monkeypatch.setattr(ngram_quality, "frequent_words", lambda *_: frequent)
    model, table = ngram_quality.train_words(docs(spark, texts).repartition(3), held=held, shards=shards, least=1)
    assert held is None or len(model.keys) <= held
    chars = model.spelling.held.value.dense().reshape(-1, 64)
    grams = {k: {} for k in (1, 2)}
    for t in texts:
        s = ["<", *ngram_quality.tokens(t), ">"]
        for g in zip(s, s[1:]):
            grams[2][g] = grams[2].get(g, 0) + 1
    for g in grams[2]:
        grams[1][g[1:]] = grams[1].get(g[1:], 0) + 1
    disc = {k: ngram_quality.discounts([sum(v == j for v in grams[k].values()) for j in (1, 2, 3, 4)]) for k in grams}

    def spelling(w):
        s = [0, 0, 0, *(ngram_quality.symbols(w).tolist()[3:] if w != ">" else []), 0]
        return np.exp(sum(float(chars[(s[k - 3] << 12) | (s[k - 2] << 6) | s[k - 1], s[k]]) for k in range(3, len(s))))

    def prob(g):
        k = len(g)
        low = spelling(g[0]) if k == 1 else prob(g[1:])
        seen = {h: n for h, n in grams[k].items() if h[:-1] == g[:-1]}
        if not seen:
            return low
        total, off = sum(seen.values()), lambda n: disc[k][min(n, 3) - 1]
        return ((seen[g] - off(seen[g])) / total if g in seen else 0) + sum(map(off, seen.values())) / total * low

    asked = ["the cat sat", "a zebra sat on the dog", "the the the the", "$$$ cat", "Zebra", "the cat sat", "пёс и кот", "и и кот", None, " \n", ""]
    df = docs(spark, asked)
    found = ngram_quality.text_scores(df, model, table)
    got = {r.doc_id: r.log_ppl for r in df.select("doc_id", *ngram_quality.fingerprint()).join(found, ["_h1", "_h2"], "left").collect()}
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        if not t or t.isspace():
            assert got[i] is None
            continue
        s = ["<", *ngram_quality.tokens(t), ">"]
        want = -np.mean([np.log(prob(g)) for g in zip(s, s[1:])])
        assert abs(got[i] - want) < 1e-4, t


def test_quality_sees_the_order_of_words(spark, corpus):
    r, text = corpus
    # all words begin and end alike, so that no window of four characters sees which word stands before
    known = [" ".join(f"zaaa{w}aaaz" for w in text(9).split()) for _ in range(40)]
    whole = [" ".join(r.choice(known) for _ in range(8)) for _ in range(150)]
    mixed = [" ".join(r.sample(t.split(), 72)) for t in whole[:20]]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.keep for x in ngram_quality.quality(docs(spark, whole + mixed), labels).collect()}
    assert sum(got[i] for i in range(150)) >= 145 and not any(got[150 + i] for i in range(20))


def test_toxicity_on_held_out_rows(spark, corpus):
    r, text = corpus
    rows, labels = [], []
    for i in range(700):
        t, bad = text(r.randint(20, 80)), i % 4 == 0
        if bad:
            w = t.split()
            w.insert(r.randrange(len(w)), r.choice(["Zhulker!", "vorpsnik", "grubbelquax,"]))
            t = " ".join(w)
        rows.append((i, t, "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "q" * 5000, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("evidence", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(df, lab).collect()}
    held = [i for i in range(700) if got[i].held_out]
    assert held == [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.97
    assert got[900].predicted == got[901].predicted == 0 and 0 <= got[902].score <= 1
    assert {x.score for x in toxicity.toxicity(df, lab.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(df.limit(0), lab).count() == 0


def test_evidence_is_a_difference_of_compressed_lengths(spark):
    import zstandard as z

    m = toxicity.Model(toxicity.trained([f" zhulker vorpsnik get out {k} ".encode() for k in range(50)], 1_024), toxicity.trained([f" plain words of {k} days out and get ".encode() for k in range(3_000)], 4_096), 0.1, frozenset({"get", "out"}))

    def size(d, w):
        own = z.ZstdCompressionDict(toxicity.PAD + d + toxicity.CARRIER, dict_type=z.DICT_TYPE_RAWCONTENT)
        c = z.ZstdCompressor(dict_data=own, level=toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(toxicity.CARRIER + f" {w} ".encode()))

    def plain(text):
        ws = [w for w in re.sub(r"[^\w\s]+", "", text.lower()).split() if w]
        every = ws + [f"{a} {b}" for a, b in zip(ws, ws[1:]) if {a, b} <= m.phrase_words]
        return max(((size(m.ordinary, w) - size(m.toxic, w)) / (len(w.encode()) + 2) for w in every), default=-1.0)

    texts = ["Zhulker!", "plain words", "they get out, of days", "out of 12 days get", "VORPSNIK and words", "", "!!!", "get out get out"]
    df = docs(spark, texts)
    got = {r.doc_id: r.evidence for r in toxicity.scored(df, m, ["doc_id"]).collect()}
    assert [got[k] for k in range(len(texts))] == [plain(t) for t in texts]
    assert got[2] > got[3] and got[0] > got[1]


def test_toxic_phrases_of_ordinary_words(spark, corpus):
    r, text = corpus
    rows, labels = [], []
    for i in range(900):
        w = text(40).split()
        for x in (["mend", "fence"] if i % 3 else ["mend fence"]):
            w.insert(r.randrange(len(w)), x)
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += rows[:30]  # repeated rows give repeated rows
    got = toxicity.toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 930
    assert np.mean([x.predicted == int(x.doc_id % 3 == 0) for x in got if x.held_out]) > 0.9


# -- op5, op6 ------------------------------------------------------------------------------------------------------------


def vectors(spark, n, dim=16, seed=0, odd=True):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, dim))
    rows = []
    for i in range(n):
        v = centres[i % 30] + rng.standard_normal(dim) * (0.05 if i % 3 else 0.6)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 4) if i % 17 else None))
    rows += [(n + k, rows[5][1], rows[5][2]) for k in range(40)]
    if odd:
        rows += [(n + 100, None, 1), (n + 101, [0.0] * dim, 1), (n + 102, [float("nan")] * dim, 1), (n + 103, [None] * dim, 1), (n + 104, [], 1), (n + 150, [float("inf")] * dim, 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("clash"))


def usable(v):
    return v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_pq_equals_brute_force(spark):
    rows, df = vectors(spark, 600)
    ok = [r for r in rows if usable(r[1]) and r[2] is not None]
    u = np.array([r[1] for r in ok])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.array([r[2] for r in ok])[:, None] == np.array([r[2] for r in ok])[None])
    np.fill_diagonal(link, False)
    up = list(range(len(ok)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in np.argwhere(link):
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    want = {r[0]: (0, r[0]) for r in rows} | {r[0]: (int(link[i].sum()), ok[root(i)][0]) for i, r in enumerate(ok)}
    got = pq_dedup.near_vectors(df, sample=256).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert pq_dedup.near_vectors(df.limit(0)).count() == 0


def test_scan_recall_and_order(spark):
    rows, df = vectors(spark, 900, seed=2)
    ok = [r for r in rows if usable(r[1])]
    ids, x = np.array([r[0] for r in ok]), np.array([r[1] for r in ok])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in adaptive_scan.nearest(df, sample=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    asked = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    for i in asked:
        s = u @ u[i]
        s[i] = -9
        best = np.lexsort((ids, -np.round(s, 12)))[:5]
        mine = got[int(ids[i])]
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and ids[i] not in [m[1] for m in mine]
        assert all(abs(sc - s[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, sc in mine)
        hit += len(set(ids[best]) & {m[1] for m in mine})
    assert set(got) == {int(ids[i]) for i in asked} and hit / (5 * len(asked)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in adaptive_scan.nearest(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert adaptive_scan.nearest(few.limit(0)).count() == 0


def test_rows_that_repeat_an_id(spark):
    v = [[1.0, 0.0, 0.1], [1.0, 0.02, 0.1], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0]]
    rows = [(1, v[0], 1), (1, None, 1), (1, v[3], 1), (1, v[2], 1), (2, v[1], 1), (2, v[1], None), (3, v[2], 1), (50, v[0], 1), (50, v[2], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in pq_dedup.near_vectors(df).collect())
    assert got == [(1, 0, 1, True), (1, 0, 1, True), (1, 1, 1, True), (1, 2, 1, True), (2, 0, 2, True), (2, 2, 1, False), (3, 1, 1, False), (50, 0, 50, True), (50, 2, 1, False)]
    near = [(r.rank, r.vec_id) for r in adaptive_scan.nearest(df).orderBy("rank").collect()]
    assert near == [(1, 1), (2, 3), (3, 2)]


def test_recall_far_beyond_the_sample(spark):
    """Nothing of a result comes from the sample: it is a tenth of the rows, and no query's neighbours need be in it."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 32))
    x = centres[rng.integers(0, 40, 4_000)] + 0.6 * rng.standard_normal((4_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in adaptive_scan.nearest(df, sample=400).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert abs(r.score - u[r.query_id] @ u[r.vec_id]) < 1e-12
    hits = 0
    for q in range(0, 4_000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(found[q] & set(np.argsort(-s, kind="stable")[:5].tolist()))
    assert hits / (5 * 80) >= 0.95


def test_every_length_is_searched(spark, monkeypatch):
    n = 1030
    df = spark.createDataFrame([(50 * i, [1.0] * (i + 1), 1) for i in range(n)], "vec_id long, embedding array<float>, label int")
    looked = []
    for module, name in ((pq_dedup, "_found"), (adaptive_scan, "_searched")):
        monkeypatch.setattr(module, name, lambda *_: looked.append(1))
        monkeypatch.setattr(module, "in_blocks", lambda parts, tag: list(parts)[:0], raising=False)
    assert pq_dedup.near_vectors(df).count() == n and len(looked) == n
    looked.clear()
    adaptive_scan.nearest(df)
    assert len(looked) == n


def test_blocks_hold_all_parts(spark):
    for n, want in ((0, 0), (4, 4), (5, 2), (9, 3)):
        got = list(common.in_blocks((spark.range(k, k + 1, 1, 1) for k in range(n)), "t", block=4))
        assert len(got) == want and sorted(r.id for x in got for r in x.collect()) == list(range(n))


# -- op10 ----------------------------------------------------------------------------------------------------------------


def test_licences(spark):
    by = dict(license_scan.SENTENCES)
    mit = "\n\n".join(by[k] for k in ("mit-title", "mit-grant", "mit-notice", "mit-warranty"))
    cases = [
        (None, []),
        ("", []),
        ("Some words. Licensed under CC BY-NC 4.0.\nmore", ["CC-BY-NC-4.0"]),
        ("a\n * Released under the MIT\n * License.", ["MIT"]),
        (mit, ["MIT"]),
        (by["mit-notice"], []),
        (" ".join(by[k] for k in ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")), ["BSD-3-Clause"]),
        ("1. " + by["bsd-redistribute"] + "\n1. " + by["bsd-source"] + "\n2. " + by["bsd-binary"], ["BSD-2-Clause"]),
        ("It was not released under the MIT License.", []),
        ("Released under the MIT License of old.", []),
        ("x " * 20_000 + "\nAll rights reserved.", ["all-rights-reserved"]),
        ("All rights reserved. " * 3 + "Licensed under the Apache License, Version 2.0.", ["Apache-2.0", "all-rights-reserved"]),
    ]
    df = docs(spark, [c[0] for c in cases]).withColumn("licences", F.lit("clash"))
    got = license_scan.scan_licences(df).orderBy("doc_id").collect()
    assert [list(r.licences) for r in got] == [c[1] for c in cases]
    assert license_scan.scan_licences(df.limit(0)).count() == 0


# -- pipeline ------------------------------------------------------------------------------------------------------------


def test_more_licences(spark):
    by = {n: x for n, x in license_scan.SENTENCES}
    texts = [by["isc-grant"], f"# {by['agpl3-redistribute']}", by["mit-grant"] + "\n\n" + by["mit-notice"] + "\nOther words.", "// SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: (LGPL-2.1-or-later AND BSD-3-Clause)", "SPDX-License-Identifier: Nonsense-1.0", "no spdx line", by["gpl2-redistribute"].replace(" modify", "\nmodify"), ""]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    got = sorted((r.doc_id, r.licences) for r in license_scan.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [["ISC"], ["ISC"], ["AGPL-3.0"], ["MIT"], ["Apache-2.0", "MIT"], ["BSD-3-Clause", "LGPL-2.1"], [], [], ["GPL-2.0"], []]
    assert [x for _, x in got] == want
    # every rule by itself is found by its own sentences, and every sentence is one that a rule or a line needs
    for name, ids in license_scan.RULES:
        known = license_scan.Known(license_scan.SENTENCES, license_scan.RULES)
        assert known.licences([n for _, n in known.sentences("\n\n".join(by[i] for i in ids))]) == [name], (name, ids)


def test_stages_take_odd_rows(spark, tmp_path):
    """Repeated doc_ids and rows, nulls, and columns with the names that stages use themselves."""
    import corpus_pipeline

    a, b = "one two three four five six seven", "red green blue white black grey pink"
    rows = [(1, a, "en", "s", 0), (1, a, "en", "s", 0), (2, a, "en", "s", 0), (2, b, "en", None, 0), (None, b, "en", "t", 0), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    clash = ["_source", "_doc", "_copies", "_copy", "row", "doc", "copies", "place", "_h1", "_evidence_of_text", "id", "fp", "keep", "turn", "size"]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in clash})
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert out.count() <= 2 * len(rows)
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.to_tokens(spark, df, str(tmp_path)).count() == len(rows)
    near = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.drop_near_copies(spark, df, str(tmp_path)).collect())
    assert near == [("1", a), ("2", b), ("3", "None"), ("4", ""), ("None", b)]


def test_mix_of_repeated_rows_is_the_mix(spark, corpus):
    """The stage takes as many words as the operator says, where all rows share one doc_id and many are alike."""
    import corpus_pipeline

    r, text = corpus
    rows = [(7, text(r.randint(1, 30)) if k % 3 else "same words here", "en", r.choice(["a", "b", None]), 0) for k in range(120)]
    df = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.mix_sources(spark, df, "").withColumn("n", mixing.sizes(df)).groupBy("source").agg(F.sum("n").alias("n")).collect()
    want = mixing.source_targets(df.groupBy("source").agg(F.sum(mixing.sizes(df)).alias("source_size"))).collect()
    target = {x.source: x.target for x in want}
    for x in got:
        assert abs(x.n - target[x.source]) <= 30, x
    text_of = {}
    for x in corpus_pipeline.mix_sources(spark, df, "").collect():
        text_of[x.source, x.text] = text_of.get((x.source, x.text), 0) + 1
    have = {}
    for x in rows:
        have[x[3], x[1]] = have.get((x[3], x[1]), 0) + 1
    assert all(n <= 2 * have[k] for k, n in text_of.items())


def test_pipeline(spark, corpus, tmp_path, library):
    import corpus_pipeline

    r, text = corpus
    rows, labels = [], []
    for i in range(500):
        t, bad = text(r.randint(30, 90)), i % 5 == 0
        if bad:
            t += " " + r.choice(["Zhulker", "vorpsnik", "grubbelquax"])
        rows.append((i, t, "en", r.choice("abc"), len(t)))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + k, rows[7][1], "en", "a", 0) for k in range(5)] + [(1100, "$$$ %%% ^^^ &&& " * 20, "en", "a", 0), (1200, None, "en", None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == d.columns
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        seen[name] = [x.doc_id for x in d.select("doc_id").collect()]
    clean = {x[0] for x in rows[:500] if x[0] % 5}
    assert len(clean - set(seen["toxicity"])) <= 4 and not {i for i in range(0, 500, 5)} & set(seen["toxicity"]) - {0, 5}
    assert 1100 not in seen["quality classifier"] and 1200 not in seen["quality classifier"]
    assert not {1000 + k for k in range(5)} & set(seen["MinHash near-dedup"]) and 7 in seen["MinHash near-dedup"]
    text_of = {x[0]: x[1] for x in rows}
    for x in d.collect():
        assert x.n_tokens == len(library.ids(text_of[x.doc_id]))
    assert max(np.bincount(seen["mixing sources to target weights"])) <= 2
