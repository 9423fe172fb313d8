"""Line dedup, closed itemsets and source divergence against brute force, with odd rows."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pyarrow as pa
import pytest

pytest.importorskip("larkspur.llm.queries")

from larkspur.llm import divergence, itemsets, line_dedup  # noqa: E402

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- lines ---------------------------------------------------------------------------------------------------------------------


def brute_lines(docs, min_chars, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run_lines(spark, docs, **kw):
    t = spark.createDataFrame(docs, "doc_id long, text string")
    got = line_dedup.line_dedup(t, **kw)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_lines_brute_force(spark):
    rng = random.Random(1)
    pool = ["Shared Line number one", "  shared line NUMBER one\t", "ÄRGER über Zeilen", "ärger über zeilen", "short", "", "another line that repeats\r", "x" * 30]
    docs = [(rng.randrange(40), "\n".join(rng.choice([*pool, f"own line {k} {j}"]) for j in range(rng.randrange(8)))) for k in range(80)]
    docs += [(None, "Shared Line number one\nown"), (None, None), (7, None), (8, ""), (9, "\n"), docs[0], docs[0]]
    docs.append((100, "\n".join(["another line that repeats"] * 3 + ["x" * 30, "", "end"])))
    for min_docs in (2, 5, 30):
        assert run_lines(spark, docs, min_chars=10, min_docs=min_docs) == brute_lines(docs, 10, min_docs)


def test_lines_all_gone_last_and_long(spark):
    line = "a line of more than forty code points, shared by all"
    docs = [(k, line) for k in range(6)] + [(6, "\n".join([line, "kept"] * 20_000))]
    got = {r[0]: r for r in run_lines(spark, docs)}
    assert got[0] == (0, 1, 1, "") and got[6][1:3] == (40_000, 0)
    docs[-1] = (-1, docs[-1][1])
    got = {r[0]: r for r in run_lines(spark, docs)}
    assert got[5] == (5, 1, 0, line) and got[-1][1:] == (40_000, 20_000, "\n".join(["kept"] * 20_000))


def test_lines_empty_table_and_other_columns(spark):
    assert run_lines(spark, []) == []
    t = spark.createDataFrame([(1, "a", "x", "y", "z")], "doc_id long, text string, `a.b` string, k1 string, gone string")
    assert [tuple(r) for r in line_dedup.line_dedup(t).collect()] == [(1, 1, 0, "a")]


def test_lines_is_native(spark):
    t = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.line_dedup(t)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- itemsets --------------------------------------------------------------------------------------------------------------------


def brute_sets(pairs, min_support, share):
    baskets = defaultdict(set)
    for b, i in pairs:
        if b is not None and i is not None:
            baskets[b].add(i)
    n = len(baskets)
    items = sorted({i for b in baskets.values() for i in b})
    support = {}
    for k in range(1, len(items) + 1):
        for z in combinations(items, k):
            s = sum(set(z) <= b for b in baskets.values())
            if s >= min_support and s * share >= n:
                support[z] = s
    closed = {z: s for z, s in support.items() if not any(set(z) < set(y) and t == s for y, t in support.items())}
    rules = {}
    for z, s in closed.items():
        rules[z] = []
        for c in z if len(z) > 1 else ():
            a, one = support[tuple(x for x in z if x != c)], support[(c,)]
            if 100 * s >= 30 * a and s * n > a * one:
                rules[z].append((c, a, one))
    return {z: (s, rules[z]) for z, s in closed.items()}


def run_sets(spark, pairs, min_support, share=10_000):
    t = spark.createDataFrame(pairs, "sale_id long, item_id long")
    sets = itemsets.closed_itemsets(t, min_support=min_support, share=share)
    got = itemsets.rules(sets).collect()
    assert len(got) == len({r["key"] for r in got})
    return {tuple(r["items"]): (r["support"], [tuple(x) for x in r["rules"]]) for r in got}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_itemsets_brute_force(spark, seed):
    rng = random.Random(seed)
    common = {1: [], 2: [9], 3: [0, 10]}[seed]  # items of every basket
    pairs = []
    for b in range(40):
        kinds = rng.choice([[1, 2, 3], [2, 3, 4, 5], [6, 7], [1, 6, 8]])
        pairs += [(b, i) for i in kinds if rng.random() < 0.85] + [(b, rng.randrange(9)) for _ in range(rng.randrange(3))] + [(b, i) for i in [*common, 3][: len(common) + (b % 2)]]
    pairs += [(None, 1), (3, None), *pairs[:10]]
    assert run_sets(spark, pairs, 4) == brute_sets(pairs, 4, 10_000)
    assert run_sets(spark, pairs, 2, 7) == brute_sets(pairs, 2, 7)


def test_itemsets_large_basket_in_parts(spark, monkeypatch):
    monkeypatch.setattr(itemsets, "BLOCK", 3)
    rng = random.Random(9)
    pairs = [(b, i) for b in range(12) for i in rng.sample(range(11), 8)]
    assert run_sets(spark, pairs, 3) == brute_sets(pairs, 3, 10_000)


def test_itemsets_nothing(spark):
    assert run_sets(spark, [], 2) == {}
    assert run_sets(spark, [(1, 1), (2, 2)], 2) == {}
    assert run_sets(spark, [(1, 5), (2, 5)], 2) == {(5,): (2, [])}


def test_basket_report_leaves_returned_lines_out(spark):
    rows = [(b, i, f, "x") for b in range(20) for i, f in ((1, "kept"), (2, None), (3, "returned"))]
    t = spark.createDataFrame(rows, "sale_id long, item_id long, flag string, rules string")
    got = [tuple(r) for r in itemsets.basket_rules(t).collect()]
    assert [g[:5] for g in got] == [("1,2", 2, 20, 0, None)]


# -- divergence --------------------------------------------------------------------------------------------------------------------


def brute_divergence(docs, min_documents, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    counts, seen, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((x or "", y or "", z or "") for x, y, z in docs):
        terms = term.findall(text.translate(UPPER))
        langs[lang].add(source)
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    f = lambda p, q: (p - q) * (p - q) // q
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= min_documents)
        p = {}
        for s in [*sources, None]:
            c = counts[lang, s] if s is not None else sum((counts[lang, x] for x in sources), Counter())
            total = sum(c[t] for t in kept) + len(kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}
        for s in sources:
            parts = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s], "term": [(f(p[s][t], p[None][t]), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def run_divergence(spark, docs, **kw):
    t = spark.createDataFrame(docs, "lang string, source string, text string")
    got = divergence.divergence(t, **kw)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


def test_divergence_brute_force(spark):
    rng = random.Random(4)
    words = ["The", "the", "été", "ÉTÉ", "x1y", "don't", "ß", "数据", "a", "bb", "ccc", "DDD", "eé"]
    docs = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for _ in range(60)]
    docs += [("en", "silent", None), ("en", "numbers", "1 2 3"), ("xx", "alone", "the the the"), ("yy", "p", "a"), ("yy", "q", "b"), docs[0], docs[0]]
    for minimum, top in ((3, 200), (1, 2), (9, 3)):
        assert run_divergence(spark, docs, min_documents=minimum, top=top) == brute_divergence(docs, minimum, top)
    assert run_divergence(spark, []) == []


def test_divergence_long_texts_and_flushes(spark, monkeypatch):
    """A text of several slices is one document for each of its terms, and the scan's batches may cut any run."""
    rng = random.Random(8)
    docs = [("en", f"s{k % 3}", " ".join(f"w{rng.randrange(40)}".replace("1", "l").replace("2", "z") for _ in range(30))) for k in range(30)]
    sent = []
    monkeypatch.setattr(divergence, "SLICE", 50)
    monkeypatch.setattr(divergence, "HELD", 25)
    monkeypatch.setattr(divergence, "PAIRS", 7)
    monkeypatch.setattr(divergence.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 3})()))
    batch = pa.record_batch([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs]), pa.array([d[2].encode() for d in docs])], ["lang", "source", "text"])
    for b in divergence._combine([batch]):
        sent += b.to_pylist()
    assert any(r["document"] >= 0 for r in sent)
    sent.sort(key=lambda r: (r["lang"], r["term"], r["source"], r["document"]))
    table = pa.Table.from_pylist(sent, schema=pa.schema([("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()), ("document", pa.int64()), ("documents", pa.int64()), ("n", pa.int64())]))
    want, seen = Counter(), Counter()
    for _, source, text in docs:
        terms = re.findall("[a-z]+", text)
        want.update((t.encode(), source) for t in terms)
        seen.update({t.encode() for t in terms})
    for size in (1, 3, 1000):
        got = [r for b in divergence._runs(3)(table.to_batches(max_chunksize=size)) for r in b.to_pylist()]
        assert {(r["term"], r["source"]): r["n"] for r in got} == {k: n for k, n in want.items() if seen[k[0]] >= 3}
        assert sum(r["first"] for r in got) == sum(n >= 3 for n in seen.values())
    rows = pa.table({"lang": ["en"] * 5, "term": [b"a", b"a", b"a", b"b", b"b"], "g": [1, 2, 3, 1, 2], "p": [50, 60, 70, 10, 20], "least": [5, 6, 7, 5, 6]})
    f = lambda p, q: (p - q) * (p - q) // q
    exact = Counter()
    for t in (b"a", b"b"):
        run = [(g, p, z) for k, g, p, z in zip(*(rows.column(c).to_pylist() for c in ("term", "g", "p", "least")), strict=True) if k == t]
        for g, p, z in run:
            for h, q, y in run:
                if g != h:
                    exact[g, h] += f(p, q) - f(p, y) - f(z, q) + f(z, y)
    for size in (1, 2, 5):
        total = Counter()
        for b in divergence._meetings(rows.to_batches(max_chunksize=size)):
            for r in b.to_pylist():
                total[r["a"], r["b"]] += r["value"]
        assert total == exact


# -- stages and files with odd columns and ids ---------------------------------------------------------------------------------------


def test_toxicity_stage_with_a_fitted_model_and_any_column_name(spark, monkeypatch):
    import corpus_pipeline
    from larkspur.llm import toxicity

    model = toxicity.Model(b" zhulker vorpsnik ", b" plain words of ordinary texts ", 0.1)
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: model)
    monkeypatch.setattr(corpus_pipeline, "_labels", lambda spark, sf_dir: None)
    rows = [(1, "plain words", "x", "y", 1), (2, "a zhulker here", "x", "y", 2), (None, None, None, None, None), (3, "", "x", "y", 3), (1, "plain words", "x", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, _text string, evidence long")
    df = df.toDF("doc_id", "text", "a.b", "_text", "evidence").selectExpr("*", "struct(doc_id AS `c.d`) AS doc")
    out = corpus_pipeline.drop_toxic(spark, df, "")
    assert out.columns == df.columns and out.schema["doc"].dataType == df.schema["doc"].dataType
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "1", "3", "None"]
    assert {r["a.b"] for r in out.collect()} == {"x", None}
    assert corpus_pipeline.drop_toxic(spark, df.limit(0), "").count() == 0


def test_token_files_deal_out_one_doc_id(spark, tmp_path):
    from larkspur.llm import bpe, token_files

    try:
        vocab = bpe.vocabulary()
    except Exception as e:
        pytest.skip(str(e))
    rows = [(7, f"text number {k}") for k in range(400)] + [(k, "alone") for k in (1, 2, 9)]
    path = str(tmp_path / "orc")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, vocab, partitions=4)
    t = spark.read.schema(token_files.SCHEMA).orc(path)
    sizes = [r["count"] for r in t.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 200
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [1, 2, *[7] * 400, 9]
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == r["n_tokens"]
        at += r["n_tokens"]


def test_quality_thresholds_are_the_quantile(spark):
    from larkspur.llm import ngram_quality

    values = [k / 1000 for k in range(1, 2001)]
    t = spark.createDataFrame([("en", v) for v in values] + [("fr", 5.0)], "lang string, log_ppl double")
    cut = ngram_quality.thresholds(t, 0.9)
    assert abs(cut["en"] - 1.8) < 2e-4 and set(cut) == {"en", ""}
    # beyond the tail's start: an exponential tail has its own quantile again
    import math

    t = spark.createDataFrame([("en", -math.log(1 - (k + 0.5) / 4000)) for k in range(4000)], "lang string, log_ppl double")
    assert abs(ngram_quality.thresholds(t, 0.999)["en"] - math.log(1000)) < 0.05
    assert ngram_quality.thresholds(spark.createDataFrame([("en", 1.5)] * 30, "lang string, log_ppl double"), 0.999)["en"] == 1.5


def test_units_with_marks_and_digits_reach_the_library_together():
    """Long and single texts cost the library more a unit than short joined ones: no unit that it may take together goes alone."""
    from larkspur.llm import bpe

    class Counted:
        def __init__(self, lib):
            self.lib, self.calls, self.longest = lib, 0, 0

        def __getattr__(self, name):
            return getattr(self.lib, name)

        def encode(self, text, **kw):
            self.calls += 1
            return self.lib.encode(text, **kw)

        def encode_batch_fast(self, texts, **kw):
            self.longest = max([self.longest, *(len(t.split()) for t in texts)])
            return self.lib.encode_batch_fast(texts, **kw)

    e = bpe.Encoder(bpe.vocabulary())
    texts = ["first " + " ".join(f"w{n}x##{n}" for n in range(k, k + 200)) + f"\nline{k}.\nv{k}\x1cz" for k in range(0, 600, 200)]
    want = [e.whole(t) for t in texts]
    e.lib = Counted(e.lib)
    assert e.encode(texts) == want
    assert e.lib.calls <= 2 * len(texts)  # a text's first unit, and the one with a control character
    assert 0 < e.lib.longest <= bpe.JOINED


def test_words_reach_the_model_as_pieces():
    """Texts cost the library more a word than the pieces that its model merges: words and the marks after them are no texts."""
    from tokenizers import AddedToken, normalizers

    from larkspur.llm import bpe

    class Counted:
        def __init__(self, lib):
            self.lib, self.texts = lib, 0

        def __getattr__(self, name):
            return getattr(self.lib, name)

        def encode_batch_fast(self, texts, **kw):
            self.texts += len(texts)
            return self.lib.encode_batch_fast(texts, **kw)

    spell = lambda k: "".join("aeßñçxyÿzq"[int(c)] for c in str(k))
    texts = ["First " + " ".join(f"W{spell(k)}{'' if k % 3 else '.#['}" for k in range(at, at + 300)) + f"\nLine{spell(at)}.\n" + spell(at) for at in range(0, 1500, 300)]
    e = bpe.Encoder(bpe.vocabulary())
    want = [e.whole(t) for t in texts]
    e.lib = Counted(e.lib)
    assert e.encode(texts) == want and e.lib.texts == 0
    odd = ["it's we'll .a -b- a1 1a a.1 \u0119a a\u0301 \u00aax \u00b2x <|endoftext|> x<|endoftext|>y\n'tis\n9 a\\b] a`~ A\u00dfB!? \u01c5\u024f"]
    assert e.encode(odd) == [e.whole(odd[0])]

    # a library that changes letters, or cuts them, is asked as a whole
    changed = bpe.Encoder(bpe.vocabulary())
    changed.lib.normalizer = normalizers.Lowercase()
    assert not changed._pieces_by_class()
    cut = bpe.Encoder(bpe.vocabulary())
    cut.lib.add_tokens([AddedToken("ine")])
    cut.special.append("ine")
    assert not cut._pieces_by_class()
