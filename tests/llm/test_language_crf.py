"""The language field against plain sums over all labellings, held-out accuracy, code-switched texts and odd tables."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_crf as C
from millrace.llm import registry

SF = "/root/testdata/sf0.01"


def field(k=3, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    f = C.Field([f"l{i}" for i in range(k)], {b"the": rng.normal(size=k), b"der": rng.normal(size=k)})
    f.weight, f.common, f.change, f.begin = (rng.normal(0, scale, p.shape) for p in (f.weight, f.common, f.change, f.begin))
    return f


def weights_of(f, words):
    """Log weight of every labelling of the words."""
    scores = []
    for w in words:
        index, starts = C.features([w])
        grams = index[starts[0] :]
        scores.append(f.weight[grams].sum(axis=0) + f.lexicon.get(w, np.zeros(len(f.languages))) @ f.common)
    e = [np.maximum(s - s.max(), -C.LEAST) for s in scores]
    return {y: f.begin[y[0]] + sum(e[i][c] for i, c in enumerate(y)) + sum(f.change[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product(range(len(f.languages)), repeat=len(words))}


def test_probabilities_against_all_labellings():
    f = field(scale=0.3)
    texts = [[b"the", b"der", b"x", b"the", b"haus", b"maison"], [b"a"], [], [b"der"] * 4]
    every = sorted({w for t in texts for w in t})
    codes = np.array([every.index(w) for t in texts for w in t])
    got = f.probabilities(codes, np.cumsum([0] + [len(t) for t in texts]), every)
    at = 0
    for t in texts:
        if t:
            w = weights_of(f, t)
            top = max(w.values())
            p = {y: np.exp(v - top) for y, v in w.items()}
            want = np.array([[sum(v for y, v in p.items() if y[i] == c) for c in range(3)] for i in range(len(t))]) / sum(p.values())
            assert np.allclose(got[at : at + len(t)], want, atol=1e-9)
        at += len(t)


@pytest.mark.parametrize("step", [1, 2, 5, 64, 10_000])
def test_cuts_into_segments_change_nothing(step):
    """Segments of any length give what one walk over the text gives."""
    f = field(4, 1, 0.4)
    rng = np.random.default_rng(2)
    lengths = [0, 1, 2, 63, 64, 65, 700, 3, 0, 128]
    starts = np.cumsum([0, *lengths])
    e = f.emissions(rng.normal(0, 3, (starts[-1], 4)))
    s = C.Segments.of(starts, step)
    got = f.within(s, e, *f.ends(s, e))
    change, begin = f.potentials()
    for a, b in itertools.pairwise(starts.tolist()):
        ahead, behind, state = np.zeros((b - a, 4)), np.ones((b - a, 4)), begin
        for i in range(b - a):
            state = C.unit((state if i == 0 else state @ change) * e[a + i])
            ahead[i] = state
        for i in range(b - a - 2, -1, -1):
            behind[i] = C.unit(change @ (e[a + i + 1] * behind[i + 1]))
        if b > a:
            assert np.allclose(got[a:b], C.unit(ahead * behind), atol=1e-10)


def test_features_are_all_grams_marks_and_the_word():
    index, starts = C.features([b"ab", b"xyzxyz", b"\xc3\xa9"])
    for w, own in zip([b"ab", b"xyzxyz", b"\xc3\xa9"], np.split(index, starts[1:])):
        assert len(own) == 1 + sum(max(len(w) + 3 - n, 0) for n in C.GRAMS)
        assert sorted(own) == sorted(C.features([w])[0])
    assert C.features([b"x"])[0].tolist() != C.features([b"y"])[0].tolist()


def test_fit_learns_words_and_transitions():
    rng = np.random.default_rng(3)
    vocabulary = [[f"{c}{i}{c}".translate(str.maketrans("0123456789", "qwertzuiop")).encode() for i in range(50)] for c in "abk"]
    rows = [(k, [vocabulary[k][i] for i in rng.integers(0, 50, 60)]) for k in (0, 1, 2) * 40]
    codes, labels, distinct = C.spliced(rows)
    f = C.Field(["a", "b", "k"], {})
    f.fit(codes, labels, distinct, 3)
    assert (np.diag(f.change) > f.change.max(axis=1) - 1e-12).all()
    p = f.probabilities(codes, np.array([0, len(codes)]), distinct)
    assert (p.argmax(axis=1) == labels).mean() > 0.99


def test_gradient_of_pairs_is_the_expected_count():
    f = field(3, 5, 0.5)
    words = [b"the", b"x", b"der", b"the"]
    every = sorted(set(words))
    codes = np.array([every.index(w) for w in words])
    e = f.emissions(f.scores(*C.features(every), f.in_lexicon(every)))[codes]
    s, pairs = C.Segments.of(np.array([0, 4])), np.zeros((3, 3))
    f.within(s, e, np.tile(C.unit(f.potentials()[1]), (1, 1)), np.ones((1, 3)), pairs)
    w = weights_of(f, words)
    z = sum(map(np.exp, w.values()))
    want = np.zeros((3, 3))
    for y, v in w.items():
        for a, b in itertools.pairwise(y):
            want[a, b] += np.exp(v) / z
    assert np.allclose(pairs, want)


ODD = [
    (None, None, None), (1, None, "en"), (2, "", "en"), (3, " 12 -- ½ ²— ", "en"), (4, "Ωμέγα", None), (5, "Iſt Der Hund", None), (5, "Iſt Der Hund", None),
    (6, "the cat sat on the mat " * 40_000, None), (7, "x" * 300_000, None), (None, "the cat sat", "en"), (8, "der hund lief", "de"),
]
EN, DE = "the cat sat on the mat and the dog ran with that hat".split(), "der hund lief und die katze saß auf dem dach mit einer maus".split()


def small(spark, extra=(), cut=4):
    rng = np.random.default_rng(1)
    data = [(100 + i, " ".join(rng.choice(EN if i % 2 else DE, 40)), "en" if i % 2 else "de") for i in range(120)]
    return spark.createDataFrame([(i, t, lang, "c", 1) for i, t, lang in [*data, *extra]], "doc_id long, text string, lang string, held_out string, `sc``ore` int").repartition(cut)


def test_odd_tables(spark):
    got = [tuple(r) for r in C.identify(small(spark, ODD)).where("doc_id is null or doc_id < 100").collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    assert len(got) == len(ODD) and all(r[1] == held(r[0]) for r in got)
    by_id = {r[0]: r for r in got if r[0] is not None}
    for i in (1, 2, 3):
        assert by_id[i][2:] == ("und", 0.0, 0, 0)
    assert sorted((r[2], r[4]) for r in got if r[0] is None) == [("en", 3), ("und", 0)]
    assert by_id[4][2] in ("de", "en") and by_id[4][4] == 1
    assert by_id[5][2] == "de" and [r for r in got if r[0] == 5] == [by_id[5]] * 2
    assert by_id[6][2] == "en" and by_id[6][3] > 0.95 and by_id[6][4] == 240_000
    assert by_id[7][4] == 1 and all(0 <= r[3] <= 1 for r in got)


def test_reruns_and_cuts_agree(spark):
    a, b = (sorted(map(tuple, C.identify(small(spark, cut=n)).collect())) for n in (1, 7))
    assert [r[:3] for r in a] == [r[:3] for r in b] and np.allclose([r[3] for r in a], [r[3] for r in b])


def test_nothing_to_learn_from(spark):
    d = small(spark)
    assert C.identify(d.limit(0)).count() == 0
    assert {(r.lang_pred, r.score) for r in C.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in C.identify(d.where("lang = 'en'")).collect()} == {"en"}
    assert {r.lang_pred for r in C.identify(d.withColumn("text", F.lit("12"))).collect()} == {"und"}


def test_labels_of_words_in_mixed_texts(spark):
    f = C.fit_field(small(spark))
    text = " ".join(EN[:8] + DE[:9] + EN[4:])
    r = C.label_words(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"), f).orderBy("doc_id").collect()
    assert [w.word for w in r[0].words] == text.split() and r[1].words == []
    right = [w.lang for w in r[0].words]
    want = ["en"] * 8 + ["de"] * 9 + ["en"] * (len(EN) - 4)
    assert np.mean([a == b for a, b in zip(right, want)]) > 0.9
    mixed = C.identify(small(spark, [(1, text, None)])).where("doc_id = 1").first()
    assert mixed.lang_pred == "en" and mixed.score < 0.9 and mixed.n_switches == 2


def test_lexicon_against_counts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang is not null").select(F.col("text").cast("binary").alias("t"), "lang")
    counts = {}
    for r in d.collect():
        for w in C.words(bytes(r.t)):
            if C.has_letter(w):
                own = counts.setdefault(r.lang, {})
                own[w] = own.get(w, 0) + 1
    languages = sorted(counts)
    got = C.lexicon(d, languages, 1e-3)
    want = {}
    for k, lang in enumerate(languages):
        n = sum(counts[lang].values())
        for w, c in counts[lang].items():
            if c >= 1e-3 * n:
                want.setdefault(w, np.zeros(len(languages)))[k] = 1 + np.log10(c / n / 1e-3)
    assert want.keys() == got.keys() and all(np.allclose(want[w], got[w]) for w in want)


def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    out = registry.op13_language_crf(spark, SF)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    r = out.join(d.where("text rlike '[A-Za-z]'"), "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert len(r) > 200 and np.mean([x.lang == x.lang_pred for x in r]) > 0.97
