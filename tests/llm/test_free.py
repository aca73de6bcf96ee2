"""The other operators against brute force on small fixtures, and their edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import jaccard_join as J
from millrace.llm import packing as K
from millrace.llm import quality_rules as Q
from millrace.llm import registry
from millrace.llm import token_counts as T
from millrace.llm import url_filter as U
from millrace.llm import classifier as M
from millrace.llm.classifier import classify
from millrace.llm.components import components
from millrace.llm.lm_score import lm_score

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", "s", 3), (4, "One two", "xx", "s", 7), (4, "One two", "xx", "s", 7), (None, "héllo <|endoftext|> wörld", "en", "s", 9), (5, "word " * 30000, "en", "hot", 1)]


def docs_of(spark, extra=()):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return d.unionByName(spark.createDataFrame([*EDGE, *extra], SCHEMA).withColumn("doc_id", F.col("doc_id") + 1_000_000))


def brute_scores(data, order=3, mu=(2000.0, 5.0)):
    """(id, held out, tokens, known, training tokens, base, score) by dictionaries of all n-grams."""
    tokens = [(i, [*(t or "").encode().lower().split(), b" "]) for i, t in data]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in tokens]
    train = [t for (_, t), h in zip(tokens, held) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    grams = Counter()
    for t in train:
        s = [None, *t]
        grams[None,] += 1
        grams.update(tuple(s[i - k : i + 1]) for i in range(1, len(s)) for k in range(order) if i - k >= 0)

    def p(history, w):
        if not history:
            return (c[w] + 1) / (n + v + 1)
        low, m = p(history[1:], w), mu[min(len(history), len(mu)) - 1]
        return (grams[(*history, w)] + m * low) / (grams[history] + m) if grams[history] else low

    out = []
    for (i, t), h in zip(tokens, held):
        s = [None, *t]
        score = sum(math.log10(p(tuple(s[max(k - order + 1, 0) : k]), s[k])) for k in range(1, len(s)))
        out.append((-1 if i is None else i, h, len(t), sum(w in c for w in t), n, sum(math.log10(p((), w)) for w in t), score))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"block": 30_000, "group": 700}, {"block": 2_000, "order": 2, "mu": (300.0,)}, {"block": 50_000, "order": 4, "mu": (100.0, 20.0)}])
def test_lm_score(spark, options):
    d = docs_of(spark).withColumn("held_out", F.lit("clash"))
    if options.get("block") == 2_000:
        d = d.where("doc_id % 9 = 0 or doc_id is null or doc_id >= 1000000")
    want = brute_scores([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], options.get("order", 3), options.get("mu", (2000.0, 5.0)))
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score(d.repartition(3), **options).collect()), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9, atol=1e-6)


def test_lm_score_of_nothing(spark):
    assert lm_score(docs_of(spark).limit(0)).count() == 0


def test_lm_score_with_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_score(spark.createDataFrame([(held, "a b", "en", "s", 1)], SCHEMA)).first()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def check_packing(pieces: pd.DataFrame, capacity: int):
    for _, p in pieces.groupby("sequence_id"):
        p = p.sort_values("offset")
        assert (p.offset == [0, *np.cumsum(p.length)[:-1]]).all() and p.length.sum() <= capacity


def test_packing(spark):
    d = docs_of(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    path = registry.vocabulary("word_bpe_49k.json")
    p = K.pack(d.withColumn("length", F.lit("clash")).repartition(5), tokenizer=path).toPandas()
    check_packing(p, 2048)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for r in d.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        own = p[p.doc_id == r.doc_id].sort_values("start")
        assert own.length.sum() == len(ids) and (own.start == [0, *np.cumsum(own.length)[:-1]]).all() and (own.doc_tokens == len(ids)).all()
        for x in own.itertuples():
            assert x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], dtype="<u4").tobytes())
    padding = 2048 * p.sequence_id.nunique() - p.length.sum()
    assert padding <= 0.02 * p.length.sum() + 2 * 2048
    assert K.pack(d.limit(0), tokenizer=path).count() == 0


def test_packing_repeats_and_nulls(spark):
    d = spark.createDataFrame([(None, None, "", "", 0), (1, "a", "", "", 0), (1, "a", "", "", 0)], SCHEMA)
    p = K.pack(d, tokenizer=registry.vocabulary("word_bpe_49k.json")).toPandas()
    check_packing(p, 2048)
    assert sorted(p.doc_tokens) == [1, 2, 2]


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 500, 1024, 1025, 1300, 2047, 2048, 2049, 9999])
def test_cuts_fill_their_class(n):
    pieces = K.cut(n)
    assert sum(x for x, _ in pieces) == n
    assert all(2048 * (1 - 1 / 64) <= x * k <= 2048 or x == 2048 // k for x, k in pieces) and all(x * k <= 2048 for x, k in pieces)


def test_quality_base_counts(spark):
    import re

    d = docs_of(spark)
    got = Q.quality_rules(d.withColumn("kept", F.lit("clash")), block=50_000).toPandas()
    want = []
    for r in d.select("doc_id", "text").collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(zip(w, w[1:], w[2:]))
        hit = {k for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for k in (i, i + 1, i + 2)}
        lines, dup, old = t.split("\n"), 0, set()
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in old
                old.add(x)
        want.append((-1 if r.doc_id is None else r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    have = [(-1 if math.isnan(r.doc_id) else int(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.itertuples()]
    assert sorted(have) == sorted(want)
    assert not (got.kept & got.base_failed).any()
    assert Q.quality_rules(d.limit(0)).count() == 0
    kept = Q.passing(d)
    assert kept.columns == d.columns and kept.count() == got.kept.sum()


def test_quality_verdict_follows_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op5_quality_rules"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    judged = got[~got.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.99
    assert judged[judged.quality == 0].kept.mean() < 0.2


def test_distance():
    assert Q.distance(np.array([1, 1]), np.array([2, 2])) == pytest.approx(0) and Q.distance(np.array([1, 0]), np.array([0, 1])) == pytest.approx(1)
    assert Q.distance(np.array([0, 0]), np.array([1, 1])) == 0


def test_url_rules_and_ratio(spark):
    urls = ["http://a.org/x", "https://Example.ORG/es/1", "http://m.example.org/en/12?x", "http://example.org/en/2", "http://b.com/fr/1", "http://b.com/de/1", "nourl", None, "", "http://x.net", "http://org", "ftp://notexample.org/es/", "a://b.com/fr"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in U.url_filter(pages).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, "org/", None]
    assert (got[1].host, got[1].path, got[2].path, got[9].host, got[9].path, got[7].host) == ("example.org", "/es/1", "/en/12", "x.net", "", "")
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and got[1].verdict == "block"
    assert U.url_filter(pages.limit(0)).count() == 0


def test_url_model_probabilities_sum_to_one():
    counts = np.zeros((40,) * 4, dtype=np.int64)
    rng = np.random.default_rng(1)
    np.add.at(counts, tuple(rng.integers(0, 5, (4, 2000))), 1)
    assert np.allclose(np.exp(U.log_probability(counts)).sum(axis=-1), 1)


def test_url_model_learns(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("nrt") for _ in range(4))
    bad = lambda: "".join(rng.choice("xqzjk0123456789") for _ in range(8))
    urls = [f"http://a{i}.com/fr/{word()}" for i in range(300)] + [f"http://a{i}.com/de/{bad()}" for i in range(300)] + [f"http://n.net/{word()}" for _ in range(50)] + [f"http://n.net/{bad()}" for _ in range(50)]
    got = U.url_filter(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).toPandas().sort_values("page_id")
    assert (got.verdict[600:650] == "allow").mean() > 0.9 and (got.verdict[650:] == "block").mean() > 0.9


def brute_tokens(token: str, pieces: dict[str, float]) -> int:
    low = min(pieces.values()) - 1
    best = [(0.0, 0)]
    for d in range(1, len(token) + 1):
        n = len(token[d - 1].encode())
        options = [(best[d - 1][0] + n * low, -(-best[d - 1][1] + n))]
        options += [(best[a][0] + pieces[token[a:d]], best[a][1] - 1) for a in range(d) if token[a:d] in pieces]
        options[0] = (best[d - 1][0] + n * low, best[d - 1][1] - n)
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(spark):
    path = registry.vocabulary("piece_bpe_32k.model")
    pieces = T.piece_weights(path)
    d = docs_of(spark).where("doc_id % 7 = 0 or doc_id >= 1000000 or doc_id is null")
    got = T.token_counts(d.withColumn("n_tokens", F.lit("x")), vocabulary=path, block=40_000).collect()
    known: dict[bytes, int] = {}
    want = []
    for r in d.select("doc_id", "text").collect():
        words = (r.text or "").encode().split()
        for w in words:
            if w not in known:
                known[w] = brute_tokens("▁" + w.decode(), pieces)
        want.append((-1 if r.doc_id is None else r.doc_id, len(words), sum(known[w] for w in words)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_tokens) for r in got) == sorted(want)
    assert T.token_counts(d.limit(0), vocabulary=path).count() == 0


def test_trie_is_the_same_after_it_is_emptied():
    pieces = {"ab": -1.0, "a": -2.0, "b": -2.5, "abc": -3.0, "c": -1.5}
    small, large = T.Trie(pieces, nodes=2), T.Trie(pieces)
    words = ["abc", "abab", "xab", "cab", "é", ""]
    assert [small.count(w) for w in words] == [large.count(w) for w in words] == [brute_tokens(w, pieces) for w in words]


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)) if w else frozenset()


def brute_join(data):
    sets = [(i, shingles(t)) for i, t in data]
    links = [[k for k, (_, b) in enumerate(sets) if k != j and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9] for j, (_, a) in enumerate(sets)]
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for j, ls in enumerate(links):
            low = min([label[j], *(label[k] for k in ls)])
            if low != label[j]:
                label[j], changed = low, True
    members: dict[int, list] = {}
    for j, x in enumerate(label):
        members.setdefault(x, []).append(sets[j][0])
    return sorted((sets[j][0], min(members[label[j]]), len(members[label[j]]), len(links[j])) for j in range(len(sets)))


def near_copies(n, words=120, changes=3, seed=1):
    rng = random.Random(seed)
    base = [f"b{seed}w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, changes)):
            t[rng.randrange(words)] = f"x{rng.random()}"
        out.append(" ".join(t))
    return out


def test_jaccard_join_small_blocks_and_leaves(spark):
    texts = near_copies(90) + near_copies(25, seed=2, changes=6) + [None, "", "one two", "one two", "one two three"] + [" ".join(near_copies(1, seed=9)[0].split()[:60] + [f"u{k}w{i}" for i in range(90)]) for k in range(40)]
    data = list(enumerate(texts))
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], SCHEMA).withColumn("class_id", F.lit("clash"))
    want = brute_join(data)
    for options in ({}, {"leaf": 5, "levels": 3, "leaf_block": 16, "set_block": 10}):
        got = sorted((r.doc_id, r.class_id, r.class_size, r.n_links) for r in J.jaccard_join(d, **options).collect())
        assert got == want
    kept = J.one_of_each(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _, _ in want})


def test_jaccard_join_edges(spark):
    d = spark.createDataFrame([(None, "a b c d e f", "", "", 1), (3, "a b c d e f", "", "", 1), (3, "a b c d e f", "", "", 1), (None, None, "", "", 1), (9, "", "", "", 1)], SCHEMA)
    got = J.jaccard_join(d).collect()
    assert len(got) == 5 and sorted(r.n_links for r in got) == [0, 0, 2, 2, 2] and {r.class_id for r in got if r.n_links} == {3}
    assert J.one_of_each(d).count() == 3
    assert J.jaccard_join(d.limit(0)).count() == 0 and J.one_of_each(d.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000 + rng.randrange(40), 1000 + rng.randrange(40)) for _ in range(60)] + [(5000, 5000 + k) for k in range(1, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    label = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in range(200):
        for u, v in links:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    assert got == label


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = classify(docs.withColumn("label", F.lit("clash")), labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    judged = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (judged.predicted == judged.quality).mean() > 0.95


def test_classifier_edges(spark):
    docs, none = docs_of(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert set(classify(docs, none).select("score").distinct().toPandas().score) == {0.5}
    assert classify(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert classify(docs, some).where("score is null").count() == 0


def test_lm_score_of_the_whole_table(spark):
    data = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {x[0]: x[6] for x in brute_scores([(r.doc_id, r.text) for r in data])}
    got = {r.doc_id: r.score for r in registry.QUERIES["op3_lm_score"](spark, SF).collect()}
    assert sorted(got) == sorted(want) and np.allclose([got[i] for i in sorted(want)], [want[i] for i in sorted(want)], atol=1e-6)


def test_jaccard_counts_a_link_once_where_blocks_are_empty(spark, monkeypatch):
    monkeypatch.setattr(J, "SET_BYTES", 400)  # two sets of 8 x 196 bytes: eight blocks, six or seven of them empty
    words = [[f"w{k}.{i}" for i in range(200)] for k in range(12)]
    docs = [(2 * k + e, " ".join([*w[:-1], f"end{e}"]), "en", "s", 1) for k, w in enumerate(words) for e in range(2)]
    got = J.jaccard_join(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {(r.doc_id, r.class_id, r.class_size, r.n_links) for r in got} == {(d[0], d[0] // 2 * 2, 2, 1) for d in docs}


WIDE = [(2**60 + 1, "a b c d e f g", "en", "s", 7), (None, "one two three four five six", "en", "s", None), (2**60 + 3, None, None, None, None)]
EXTRA = ["id", "ft", "th", "row", "ref", "t", "own_id", "copies", "n", "cls", "label", "range", "n_tokens", "__th", "doc", "text_sha256"]


def clashing(d):
    """d with extra columns, named like columns that the operators make."""
    return d.withColumns({c: F.lit(f"extra {c}") for c in EXTRA})


def test_ids_beyond_doubles_beside_nulls(spark):
    d = clashing(spark.createDataFrame(WIDE, SCHEMA).coalesce(1))
    labels = spark.createDataFrame([(2**60 + 1, 1, 0)], "doc_id long, quality int, toxic int")
    want = {2**60 + 1, None, 2**60 + 3}
    outs = {
        "lm": lm_score(d), "pack": K.pack(d, tokenizer=registry.vocabulary("word_bpe_49k.json")), "rules": Q.quality_rules(d), "tokens": T.token_counts(d, vocabulary=registry.vocabulary("piece_bpe_32k.model")),
        "join": J.jaccard_join(d), "one": J.one_of_each(d), "classes": classify(d, labels),
    }
    for name, out in outs.items():
        assert {r.doc_id for r in out.collect()} == want, name


def test_rules_keep_rows_as_they_are(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 1000 and 9000").orderBy("doc_id").limit(60).collect()]
    data = [(2**60 + 2 * i + 1 if i else None, t, "en" if i % 2 else None, "s", 2**60 + i if i != 3 else None) for i, t in enumerate(texts)]
    d = clashing(spark.createDataFrame(data, SCHEMA).coalesce(1))
    got = Q.passing(d)
    assert got.columns == d.columns
    kept = {r.doc_id for r in Q.quality_rules(d).where("kept").collect()}
    assert len(kept) > 30 and sorted(map(repr, got.collect())) == sorted(repr(r) for r in d.collect() if r.doc_id in kept)
    assert Q.passing(d.limit(0)).count() == 0


def base_failed(text):
    """Fewer than 50 words, or half of them in repeated 3-word windows."""
    w = (text or "").encode().split()
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {k for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for k in (i, i + 1, i + 2)}
    return len(w) < 50 or 100 * len(hit) > 50 * len(w)


def brute_quality(data):
    """(base_failed, kept, character distance, word distance) of each row (doc_id, lang, text), by dictionaries."""
    classes = lambda t: [Q.class_counts((t or "").encode())[c] for c in Q.COMPARED]
    words = lambda t: [w for w in ((t or "").encode().split())]
    by_lang, by_class = {}, {}
    for r in data:
        for lang in {r.lang, "*"} - {None}:
            by_lang.setdefault(lang, Counter()).update(p.decode() for w in words(r.text) if (p := Q.plain(w)))
            by_class.setdefault(lang, np.zeros(len(Q.COMPARED)))[:] += classes(r.text)
    every, letters = sum(by_lang["*"].values()), by_class["*"].sum()
    most = lambda c, k: sorted(c, key=lambda w: (-c[w], w))[:k]
    pool = most(by_lang["*"], 64)

    def reference(lang):
        if lang == "*":
            value = {w: by_lang["*"][w] for w in pool}
            return value, every - sum(value.values()), by_class["*"]
        near = {w: by_lang[lang][w] + 1000 * by_lang["*"][w] / every for w in {*most(by_lang[lang], 64), *pool}}
        value = {w: near[w] for w in most(near, 64)}
        return value, sum(by_lang[lang].values()) + 1000 - sum(value.values()), by_class[lang] + 1000 * letters / every * by_class["*"] / letters

    refs = {k: reference(k) for k in by_lang}
    largest = sorted((k for k in by_lang if k != "*"), key=lambda k: (-sum(by_lang[k].values()), k))

    def entropy(p):
        return -sum(x * math.log2(x) for x in p if x > 0)

    def apart(a, b):
        a, b = np.array(a, dtype=float), np.array(b, dtype=float)
        if not a.sum() or not b.sum():
            return 0.0
        a, b = a / a.sum(), b / b.sum()
        return math.sqrt(max(entropy((a + b) / 2) - (entropy(a) + entropy(b)) / 2, 0))

    out = []
    for r in data:
        ws, failed = [Q.plain(w).decode() for w in words(r.text)], base_failed(r.text)
        found = []
        for lang in [r.lang if r.lang in by_lang else "*", *largest, "*"]:
            value, rest, cls = refs[lang]
            n = Counter(ws)
            common = [n[w] for w in value]
            share = (sum(common) / max(len(ws), 1)) / (1 - rest / (rest + sum(value.values())))
            c, w = apart(classes(r.text), cls), apart([*common, len(ws) - sum(common)], [*value.values(), rest])
            found.append((len(ws) < 50 or (c <= 0.3 and w <= 0.5 and share >= 0.25), c, w))
        _, c, w = found[0] if failed else next((f for f in found if f[0]), found[0])
        out.append((failed, not failed and any(f for f, _, _ in found), c, w))
    return out


def test_distance_rules_against_brute_force(spark):
    """Verdicts and distances restated with dictionaries, over a table with six languages, one of a single text, and a text
    that only one of the smallest languages takes."""
    extra = [(50 + i, " ".join(random.Random(i).choice(["zum", "quo", "per", "ab", "in"]) + str(i % 3) for _ in range(90)), "la" if i < 3 else "one", "s", 1) for i in range(4)]
    extra += [(70 + i, " ".join(random.Random(i).choice(["ωδε", "και", "γαρ"]) for _ in range(70)), "el" if i else "en", "s", 1) for i in range(3)]
    d = docs_of(spark, extra)
    data = d.select("doc_id", "lang", "text").collect()
    got = {(-1 if pd.isna(r.doc_id) else r.doc_id): r for r in Q.quality_rules(d.repartition(4), block=20_000).collect()}
    for r, (failed, kept, c, w) in zip(data, brute_quality(data), strict=True):
        g = got[-1 if r.doc_id is None else r.doc_id]
        assert (g.base_failed, g.kept) == (failed, kept), r.doc_id
        assert g.char_distance == pytest.approx(c, abs=1e-6) and g.word_distance == pytest.approx(w, abs=1e-6), r.doc_id


def test_rules_reject_unknown_words_of_usual_letters(spark):
    """Half the texts' words shuffled letter by letter: the same character classes, no common word."""
    rng = random.Random(2)
    data = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and length(text) between 2000 and 4000").limit(40).collect()]
    odd = [(10**6 + i, " ".join("".join(rng.sample(w, len(w))) + "q" for w in t.split()), "en", "s", 1) for i, t in data]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, SCHEMA))
    assert Q.quality_rules(docs).where("doc_id >= 1000000 and kept").count() == 0


def test_one_very_long_word(spark):
    pieces = {"ab": -1.0, "a": -2.0, "b": -2.5, "abc": -3.0, "c": -1.5, "cabcab": -4.0}
    t = T.Trie(pieces)
    word = "".join(random.Random(1).choice("abcxé") for _ in range(5000))
    assert t.count(word) == brute_tokens(word, pieces) and len(t.score) == 1  # no nodes
    path = registry.vocabulary("piece_bpe_32k.model")
    d = spark.createDataFrame([(1, "qwertz" * 200_000, "en", "s", 1), (2, "a", "en", "s", 1)], SCHEMA)
    assert {r.doc_id: r.n_words for r in T.token_counts(d, vocabulary=path).collect()} == {1: 1, 2: 1}


def test_packing_encoder_on_odd_strings():
    from tokenizers import Tokenizer

    path, rng = registry.vocabulary("word_bpe_49k.json"), random.Random(4)
    signs = [*"abcXYZ019 .,;:!?-'\"()<|>_#\n\té ÀßñİΩж中文\u00a0\u200b\u3000½²ⅷ🙂\u0301\x85\x1c", "<|endoftext|>", "'s", "'ll", " the "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    tokenizer, own = Tokenizer.from_file(path), K.Encoder(path, most=300)
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        assert [list(x) for x in own.texts(part, 1)] == [[*e.ids, 1] for e in tokenizer.encode_batch(part, add_special_tokens=False)]


def test_machine_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(3)
    m = M.Machine(np.zeros(M.STATISTICS), np.ones(M.STATISTICS))
    m.w, m.v, m.b = rng.normal(0, 1, m.w.shape), rng.normal(0, 1, m.v.shape), 0.3
    index = [np.array([3, 70, 900], dtype=np.int32), np.array([], dtype=np.int32), np.array([5], dtype=np.int32)]
    value = [rng.normal(0, 1, len(i)).astype(np.float32) for i in index]
    dense = rng.normal(0, 2, (3, M.STATISTICS))
    for k, p in enumerate(m.score(index, value, dense)):
        i = [*index[k], *range(M.WORDS, M.WORDS + M.STATISTICS)]
        x = [*value[k], *np.clip(dense[k], -4, 4) / math.sqrt(M.STATISTICS)]
        raw = m.b + sum(m.w[a] * p for a, p in zip(i, x))
        raw += sum(float(m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert p == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-6)


def test_machine_steps_down_its_loss():
    """The first step of the fit follows the numerical gradient, and the fit learns a pair that no single word tells."""
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (1200, 2))
    index = [np.array([10 + a, 20 + b], dtype=np.int32) for a, b in bits]
    value = [np.ones(2, dtype=np.float32) for _ in index]
    dense, y = np.zeros((len(index), M.STATISTICS)), (bits[:, 0] ^ bits[:, 1]).astype(float)
    m = M.Machine(np.zeros(M.STATISTICS), np.ones(M.STATISTICS))
    m.fit(index, value, dense, y, epochs=40)
    assert ((m.score(index, value, dense) >= 0.5) == (y == 1)).mean() > 0.99


def test_classifier_learns_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"good words {i % 3}", "en", "s", 1) for i in range(300)] + [(2, "bad # # |", "en", "s", 1)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels)
    assert got.count() == 301 and got.where("score is null").count() == 0


def brute_url_scores(urls, accepted):
    """Mean log ratio per character by dictionaries of contexts."""
    signs = lambda u: [36] * 3 + [int(U.SIGN[b]) for b in ((u or "").partition("://")[2] if "://" in (u or "") else (u or "")).encode()]
    models = []
    for side in (True, False):
        seen = Counter()
        for u, a in zip(urls, accepted):
            if a is side and zlib.crc32(u.encode()) % 5:
                s = signs(u)
                seen.update((*s[i - k : i], s[i]) for i in range(3, len(s)) for k in range(4))
        after = {}
        for g, n in seen.items():
            after.setdefault(g[:-1], {})[g[-1]] = n
        models.append(after)

    def p(after, context, sign):
        q = p(after, context[1:], sign) if context else 1 / 40
        c = after.get(context, {})
        total = sum(c.values())
        return (c.get(sign, 0) + len(c) * q) / (total + len(c)) if total >= U.MIN_CONTEXT else q

    out = []
    for u in urls:
        s = signs(u)
        x = [math.log(p(models[0], tuple(s[i - 3 : i]), s[i])) - math.log(p(models[1], tuple(s[i - 3 : i]), s[i])) for i in range(3, len(s))]
        out.append(sum(x) / max(len(x), 1))
    return out


def test_url_scores_and_threshold_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    extra = ["x" * 20_000, "http://a.org/" + "p/" * 9000, "ftp://ü.org/é?", "HTTP://A.ORG", "http://b.com/de/"]
    data = [(r.page_id, r.url) for r in rows] + [(10**6 + i, u) for i, u in enumerate(extra)]
    got = {r.page_id: r for r in U.url_filter(spark.createDataFrame(data, "page_id long, url string")).collect()}
    accepted = [None if got[i].rule is None else got[i].verdict == "allow" for i, _ in data]
    urls = [u for _, u in data]
    want = brute_url_scores(urls, accepted)
    assert np.allclose([got[i].score for i, _ in data], want, atol=1e-4)
    sides = [(min(max(math.floor((s + U.SPAN) * U.BINS / (2 * U.SPAN)), 0), U.BINS - 1), a) for s, u, a in zip(want, urls, accepted) if a is not None and zlib.crc32(u.encode()) % 5 == 0]
    good, bad = [b for b, a in sides if a], [b for b, a in sides if not a]
    value = [round(sum(b >= e for b in good) / len(good) + sum(b < e for b in bad) / len(bad), 9) for e in range(U.BINS + 1)] if good and bad else [0]
    best = [e for e, x in enumerate(value) if x == max(value)]
    limit = best[len(best) // 2] * 2 * U.SPAN / U.BINS - U.SPAN if good and bad else 0.0
    for (i, _), s, a in zip(data, want, accepted):
        if a is None and abs(s - limit) > 1e-3:
            assert got[i].verdict == ("allow" if s >= limit else "block")


def test_join_tells_sets_of_one_hash_apart(spark):
    """With a hash of three values almost all classes clash, and the result is the same."""
    d = docs_of(spark).repartition(3)
    weak = lambda s: len(s) % 3
    for few in (J.CLASHES, -1):
        J.CLASHES, before = few, J.CLASHES
        try:
            a, b = (sorted(map(repr, J.jaccard_join(d, **o).collect())) for o in ({}, {"hashed": weak}))
        finally:
            J.CLASHES = before
        assert a == b


def test_runs_follow_the_target_recall(spark):
    assert J.runs_for(0.8, 0.99, 8) < J.runs_for(0.8, 1 - 1e-7, 8) == 12 and J.agreeing(0.8, 1 - 1e-7) == 33
    with pytest.raises(ValueError):
        J.runs_for(0.2, 0.999999, 8)
    # what both say, by drawing: sets of similarity 0.8 agree at a place with that chance
    rng = np.random.default_rng(1)
    assert ((rng.random((20_000, 64)) < 0.8).sum(axis=1) >= J.agreeing(0.8, 0.999)).mean() == pytest.approx(0.999, abs=0.0015)


def test_jaccard_join_of_long_texts(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    texts = [" ".join(base)]
    for share in (0.005, 0.02, 0.2):
        t = list(base)
        for _ in range(int(share * len(t))):
            t[rng.randrange(len(t))] = f"x{rng.random()}"
        texts.append(" ".join(t))
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted((r.doc_id, r.class_id, r.class_size, r.n_links) for r in J.jaccard_join(d).collect()) == brute_join(list(enumerate(texts)))


def test_all_references_at_once_equal_each_alone():
    rng = np.random.default_rng(0)
    pool = {"words": {f"w{i}": int(rng.integers(1, 99)) for i in range(20)}, "total": 3000, "classes": rng.integers(1, 99, 7).tolist()}
    own = lambda k: {"words": [{"word": f"{k}x{i}", "n": int(rng.integers(1, 50)), "every": 60} for i in range(k)] + [{"word": "w3", "n": 7, "every": 70}], "total": 500 + k, "classes": rng.integers(0, 50, 7).tolist()}
    refs = [Q.Reference(own(k) if k is not None else None, pool, 12, 100.0) for k in (0, 3, 30, None)]
    every = Q.AllReferences(refs)
    for n in (1, 60, 2000):
        words = [b"w%d" % rng.integers(0, 30) if rng.random() < 0.5 else b"%dx%d" % (rng.choice([3, 30]), rng.integers(0, 40)) for _ in range(n)]
        classes = rng.integers(0, 9, 9)
        got = every.apart(np.array([every.place.get(w, len(every.place)) for w in words], dtype=np.int64), classes)
        for k, r in enumerate(refs):
            want = r.apart(np.arange(n), classes, np.array([r.place.get(w, len(r.place)) for w in words], dtype=np.int64))
            assert np.allclose([g[k] for g in got], want)


def test_more_values_than_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(Q, "LANGUAGES", 3)
    d = spark.createDataFrame([(i, "a b c " * 30, f"l{i}", "s", 1) for i in range(5)], SCHEMA)
    with pytest.raises(ValueError, match="lang holds more than 3"):
        Q.quality_rules(d)
    assert Q.quality_rules(d.where("doc_id < 3")).count() == 3


def plain_machine(rows, epochs, rate=0.15, decay=1e-5, batch=128):
    """The factorisation machine by dictionaries and loops over pairs. rows: (features {index: value}, label)."""
    size = M.WORDS + M.STATISTICS
    v, b = np.random.default_rng(7).normal(0, 0.01, (size, M.FACTORS)), 0.0
    w, gw, gv, gb = Counter(), Counter(), {}, 1e-3
    good = sum(y for _, y in rows)
    weight = {1: len(rows) / (2 * max(good, 1)), 0: len(rows) / (2 * max(len(rows) - good, 1))}

    def raw(x):
        keys = list(x)
        pairs = sum(float(v[i] @ v[j]) * x[i] * x[j] for k, i in enumerate(keys) for j in keys[k + 1 :])
        return b + sum(w[i] * x[i] for i in keys) + pairs

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            own = [rows[i] for i in order[at : at + batch]]
            dw, dv, db = Counter(), {}, 0.0
            for x, y in own:
                e = (1 / (1 + math.exp(-raw(x))) - y) * weight[y] / len(own)
                total = sum(v[i] * x[i] for i in x)
                for i in x:
                    dw[i] += e * x[i]
                    dv[i] = dv.get(i, 0) + e * x[i] * (total - v[i] * x[i])
                db += e
            for i in dw:
                g, h = dw[i] + decay * w[i], dv[i] + decay * v[i]
                gw[i], gv[i] = gw[i] + g * g, gv.get(i, 0) + h * h
                w[i] -= rate * g / math.sqrt(gw[i] + 1e-3)
                v[i] = v[i] - rate * h / np.sqrt(gv[i] + 1e-3)
            gb += db * db
            b -= rate * db / math.sqrt(gb)
    return lambda x: 1 / (1 + math.exp(-raw(x)))


def test_query_of_op9_against_a_plain_restatement(spark):
    """Features, fit and scores of a small table restated with loops."""
    import xxhash

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["fine", "Lamp", "of", "light"] if i % 2 else ["junk", "#", "||", "of"]) for _ in range(rng.randint(1, 9))) for i in range(36)] + ["", None]
    docs = spark.createDataFrame([(i, t, "en", "s", None if i == 3 else 7 * i) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(38)], "doc_id long, quality int, toxic int")

    def statistics(i):
        t = (texts[i] or "").encode()
        words = t.split()
        kinds = sorted(set(words))
        return M.statistics(t, np.array([kinds.index(x) for x in words], dtype=np.int64), max(len(kinds), 1), 0 if i == 3 else 7 * i)

    def features(i, mean, scale):
        c = Counter(xxhash.xxh3_64_intdigest(x.lower()) % M.WORDS for x in (texts[i] or "").encode().split())
        logs = {k: float(np.float32(math.log1p(n))) for k, n in c.items()}
        norm = math.sqrt(sum(x * x for x in logs.values())) or 1.0
        x = {k: logs[k] / norm for k in sorted(logs)}
        return x | {M.WORDS + k: max(-4.0, min(4.0, (s - m) / d)) / math.sqrt(M.STATISTICS) for k, (s, m, d) in enumerate(zip(statistics(i), mean, scale))}

    train = [r.doc_id for r in docs.withColumn("h", F.xxhash64("doc_id")).orderBy("h").select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    dense = np.array([statistics(i) for i in train])
    mean, scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-6)
    score = plain_machine([(features(i, mean, scale), i % 2) for i in train], 3)
    got = {r.doc_id: r for r in classify(docs, labels, epochs=3).collect()}
    assert sorted(got) == list(range(38))
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5)
        assert r.score == pytest.approx(score(features(i, mean, scale)), abs=1e-4), i
