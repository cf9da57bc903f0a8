"""Toxicity, language and quality models: held-out accuracy, the models' own rules, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import common, langid, quality, toxicity

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels)
    a, b = s[y == 1][:, None], s[y == 0][None, :]
    return float((a > b).mean() + (a == b).mean() / 2)


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


def test_op6_languages_of_held_out_documents(spark, tables):
    from tracefold.llm.queries import QUERIES
    got = QUERIES["op6_language_id"](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(tables["documents"].select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == tables["documents"].count()
    held = [r for r in rows if r.held_out]
    assert 0.1 < len(held) / len(rows) < 0.3
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark, make_docs, odd_texts):
    train = spark.createDataFrame([(i, t * 3, lang, "s", 1) for i, (t, lang) in enumerate([
        ("the cat and the dog ", "en"), ("der hund und die katze ", "de"), ("el perro y la gata ", "es")] * 30)]
        + [(900, "x", None, "s", 1), (901, None, "en", "s", 1), (902, "12 34", "de", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(train)
    docs = make_docs([*odd_texts, (1, "und die katze"), (2, "12 -- !"), (2, "12 -- !"), (3, "² ½ Ⅷ")]).withColumn("score", F.lit("clash"))
    got = [tuple(r) for r in langid.identify(docs, model).select("text", "lang_pred", "score", "ambiguous").collect()]
    assert len(got) == len(odd_texts) + 4
    for text, lang, score, unsure in got:
        if not any(c.isalpha() for c in text or ""):
            assert (lang, score, unsure) == ("und", 0.0, True)
        else:
            assert lang in ("en", "de", "es") and 0 < score <= 1
    assert next(g for g in got if g[0] == "und die katze")[1] == "de"
    assert langid.identify(make_docs([]), model).count() == 0
    one = langid.fit(train.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(make_docs([(1, "a"), (2, "1")]), one).collect()} == {"en", "und"}
    none = langid.fit(train.where("false"))
    assert {r.lang_pred for r in langid.identify(make_docs([(1, "a"), (2, None)]), none).collect()} == {"und"}


def test_a_language_of_hot_copies_still_learns(spark, make_docs):
    hot = [(i, "der hund und die katze " * 3, "de") for i in range(3000)]  # copies of one text, and a few others
    rows = hot + [(5000 + i, f"das haus und der garten nummer {i} ", "de") for i in range(40)] + [
        (9000 + i, f"the cat and the dog number {i} ", "en") for i in range(200)] + [(7, "der hund und die katze " * 3, "de")] * 500
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train, per_language=100)
    got = {r.doc_id: r.lang_pred for r in langid.identify(make_docs([(1, "der garten und das haus"), (2, "the dog and the cat")]), model).collect()}
    assert got == {1: "de", 2: "en"}


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 30])
def test_codewords_differ(n):
    code = langid.codewords(n)
    apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)
    assert code.shape[0] == n and (apart + 99 * np.eye(n, dtype=int)).min() >= max(1, code.shape[1] // 4)
    if n <= 7:
        assert code.shape[1] == 2 ** (n - 1) - 1


def test_decoding_repairs_a_wrong_bit_and_flags_ties():
    code = langid.codewords(4)
    model = langid.Model(("a", "b", "c", "d"), code, np.eye(7), np.zeros(7))
    for k in range(4):
        for flip in range(7):
            margins = 4 * code[k].copy()
            margins[flip] *= -0.5
            names, score, unsure = model.decide(margins[None, :], 0.02)
            assert names == ["abcd"[k]] and not unsure[0] and score[0] > 0.5
    assert model.decide(np.zeros((1, 7)), 0.02)[2][0]


def test_profile_in_blocks_equals_whole(monkeypatch):
    text = "Ein langer Text, mit Wörtern. " * 50
    whole = langid.profile(text, 4096)
    monkeypatch.setattr(langid, "BLOCK_WORDS", 7)
    assert np.allclose(whole, langid.profile(text, 4096), atol=1e-6)
    assert abs(float((whole.astype(float) ** 2).sum()) - 1) < 1e-3


def test_op2_scores_of_held_out_documents(spark, tables):
    from tracefold.llm.queries import QUERIES
    got = QUERIES["op2_toxicity"](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == tables["documents"].count()
    rows = got.join(tables["labels"], "doc_id").collect()
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert auc([r.score for r in rows if r.held_out], [r.toxic for r in rows if r.held_out]) > 0.8


def plain_chances(words_t, words_o):
    """The two class models by direct recursion on strings, for a few letters."""
    from collections import Counter
    order, mark = toxicity.ORDER, toxicity.MARK
    c = [Counter(), Counter()]
    for k, words in enumerate((words_t, words_o)):
        for w in words:
            m = mark + w + mark
            c[k].update(m[i: i + n] for n in range(1, order + 1) for i in range(len(m) - n + 1))
    kept = {g for g in c[0] | c[1] if c[0][g] + c[1][g] >= 2}

    def pooled_count(g):
        kinds = len({h for h in kept if len(h) == len(g) + 1 and h[1:] == g})
        return kinds if kinds and len(g) < order else c[0][g] + c[1][g]

    def pooled(g):
        sib = [s for s in kept if len(s) == len(g) and s[:-1] == g[:-1]]
        low = 1 / sum(len(s) == 1 for s in kept) if len(g) == 1 else pooled(g[1:])
        total = sum(map(pooled_count, sib))
        return (max(pooled_count(g) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(sib) * low) / total

    def ratio(g):
        p = pooled(g)
        out = []
        for k in (0, 1):
            sib = [s for s in kept if len(s) == len(g) and s[:-1] == g[:-1]]
            n, kind = sum(c[k][s] for s in sib), sum(c[k][s] > 0 for s in sib)
            out.append((max(c[k][g] - toxicity.DISCOUNT, 0) + (toxicity.DISCOUNT * kind + toxicity.PULL) * p) / (n + toxicity.PULL))
        return np.log(out[0] / out[1])

    def back(h):
        sib = [s for s in kept if len(s) == len(h) + 1 and s[:-1] == h]
        out = [(toxicity.DISCOUNT * sum(c[k][s] > 0 for s in sib) + toxicity.PULL) / (sum(c[k][s] for s in sib) + toxicity.PULL)
               for k in (0, 1)]
        return np.log(out[0] / out[1])

    def word(w):
        m, total = mark + w + mark, 0.0
        for i in range(1, len(m)):
            for n in range(min(order, i + 1), toxicity.SHARED, -1):
                g = m[i - n + 1: i + 1]
                if g in kept:
                    total += ratio(g)
                    break
                if any(len(s) == n and s[:-1] == g[:-1] for s in kept):
                    total += back(g[:-1])
                    break
        return total

    return word


def test_kneser_ney_equals_direct_recursion(spark):
    toxic, plain = ["abba", "abab", "babab", "abba", "ccc"], ["bbaa", "aabb", "abab", "bab", "bab", "aab", "caca"]
    rows = [(i, " ".join(toxic), 1) for i in range(2)] + [(9, " ".join(plain * 2), 0), (10, None, 0)]
    counts = toxicity.count_grams(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    grams = toxicity.kneser_ney(common.collected(counts))
    words = ["abba", "abab", "zzz", "bbaa", "abz", "c", "ccca", "babbaba"]
    plainly = plain_chances(toxic * 2, plain * 2)
    assert np.allclose(grams.evidence(words), [plainly(w) for w in words])


def test_one_short_word_alone(spark):
    rows = [(i, "abba abab babab ccc", 1) for i in range(2)] + [(9, "bbaa aabb abab bab bab", 0)]
    grams = toxicity.kneser_ney(common.collected(toxicity.count_grams(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))))
    together = grams.evidence(["a", "abba", "b", "zz"])
    assert np.allclose([grams.evidence([w])[0] for w in ("a", "abba", "b", "zz")], together)  # also fewer letters than the order


def test_toxicity_of_odd_rows(spark, make_docs, odd_texts):
    train = spark.createDataFrame(
        [(i, f"nice day at the lake {i % 7}", 0) for i in range(60)] + [(100 + i, f"you moron scum {i % 5}", 1) for i in range(40)]
        + [(500, None, 1), (501, "x", None)], "doc_id long, text string, toxic int")
    model = toxicity.fit(train, train)
    docs = make_docs([*odd_texts, (1, "what a moron"), (2, "nice day at the lake now")]).withColumn("score", F.lit("clash"))
    got = {(r.doc_id, r.text): (r.score, r.predicted) for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in got.values())
    assert got[(5, None)] == got[(3, "")] == got[(9, " \n\t ")] == (0.0, 0)
    assert got[(1, "what a moron")][1] == 1 and got[(2, "nice day at the lake now")][1] == 0
    assert toxicity.score(make_docs([]), model).count() == 0
    for only, want in ((0, 0.0), (1, 1.0), (None, 0.0)):
        part = train.where(F.col("toxic") == only) if only is not None else train.where("false")
        assert {r.score for r in toxicity.score(docs, toxicity.fit(train, part)).collect()} == {want}


def test_toxicity_beside_digits_and_without_blanks(spark, make_docs):
    rnd, words, toxic = random.Random(5), "今天 我们 公园 散步 看花 天气 很好 朋友 吃饭 回家 明天 开心".split(), "你这个白痴快滚开"

    def sentence(inner=""):
        """A text without blanks, with a year and ``inner`` somewhere."""
        parts = [*rnd.choices(words, k=rnd.randint(20, 60)), inner]
        rnd.shuffle(parts)
        return "".join(parts[:9]) + f"{rnd.randint(1900, 2030)}年" + "".join(parts[9:])

    train = spark.createDataFrame(
        [(i, f"nice day at the lake {i % 7} and home again", 0) for i in range(100)] + [(100 + i, f"you moron scum {i % 5}", 1) for i in range(100)]
        + [(200 + i, sentence(), 0) for i in range(200)] + [(400 + i, sentence(toxic), 1) for i in range(200)],
        "doc_id long, text string, toxic int")
    model = toxicity.fit(train, train)
    bad = ["what a moron2024", "you scum,12", "7moron8", *[sentence(toxic) for _ in range(40)]]
    good = ["nice day2024", "12345", "lake,12 and home", *[sentence() for _ in range(40)]]
    rows = {r.text: r.predicted for r in toxicity.score(make_docs(list(enumerate([*bad, *good]))), model).collect()}
    assert rows == {**dict.fromkeys(bad, 1), **dict.fromkeys(good, 0)}
    assert toxicity.words_of("id1ot 12 x") == ["id", "ot", "x"]
    for at in range(200):  # an expression is whole in some piece, wherever it stands
        assert any(toxic in p for p in toxicity.words_of("花" * at + toxic + "花" * 90))


def test_op3_scores_of_held_out_documents(spark, tables):
    from tracefold.llm.queries import QUERIES
    got = QUERIES["op3_quality"](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == tables["documents"].count()
    rows = got.join(tables["labels"], "doc_id").collect()
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert auc([r.score for r in rows if r.held_out], [r.quality for r in rows if r.held_out]) > 0.9


def test_quality_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x, y, rounds=5, pair_rounds=200, pairs=1)
    assert model.pairs == ((0, 1),)
    assert np.mean((model.scores(x) >= 0.5) == y) > 0.9
    # one entry per table, summed
    z = model.intercept + sum(t[np.searchsorted(e, x[7, k], side="right")] for k, (e, t) in enumerate(zip(model.edges, model.tables)))
    z += model.grids[0][tuple(np.searchsorted(model.coarse[k], x[7, k], side="right") for k in (0, 1))]
    assert np.isclose(model.scores(x[7:8])[0], 1 / (1 + np.exp(-z)))


def test_trees_find_the_best_cuts():
    g, h = np.array([3.0, 3, -3, -3, 9, 9]), np.ones(6)
    step = quality.tree_1d(g, h)
    assert len(set(step[:2])) == 1 and len(set(step[2:4])) == 1 and len(set(step[4:])) == 1 and len(set(step)) == 3
    grid = np.array([[4.0, -4], [-4, 4]]) * 10
    assert (np.sign(quality.tree_2d(grid, np.ones((2, 2)))) == -np.sign(grid)).all()


def test_quality_of_odd_rows(spark, make_docs, odd_texts):
    train = spark.createDataFrame(
        [(i, f"A sentence, with words {i}. And one more.", 1) for i in range(60)] + [(100 + i, "### ||| ### " * (i + 1), 0) for i in range(40)]
        + [(500, None, 0), (501, "x", None)], "doc_id long, text string, quality int")
    model = quality.fit(train, train)
    docs = make_docs([*odd_texts, (1, "A sentence, with words 99. And one more."), (2, "||| ###")]).withColumn("PREDICTED", F.lit("clash"))
    got = {(r.doc_id, r.text): (r.score, r.predicted) for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for s, p in got.values())
    assert got[(5, None)] == got[(3, "")] == got[(9, " \n\t ")]
    assert got[(1, "A sentence, with words 99. And one more.")][1] == 1 and got[(2, "||| ###")][1] == 0
    assert quality.score(make_docs([]), model).count() == 0
    for only, want in ((0, 0), (1, 1)):
        assert {r.predicted for r in quality.score(docs, quality.fit(train, train.where(F.col("quality") == only))).collect()} == {want}
    assert {r.score for r in quality.score(docs, quality.fit(train, train.where("false"))).collect()} == {0.5}


def test_toxicity_learns_from_all_labelled_texts(spark, monkeypatch):
    n = 9000 + 6000  # more of each than the models once took
    train = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("ab c"), F.col("id") % 7).alias("text"),
                                  (F.col("id") < 6000).cast("int").alias("toxic"))
    seen, curve, grams = {}, toxicity.curve, toxicity.kneser_ney
    monkeypatch.setattr(toxicity, "curve", lambda rows: (seen.update(rows=rows.count()), curve(rows))[1])
    monkeypatch.setattr(toxicity, "kneser_ney", lambda table: (seen.update(table=table), grams(table))[1])
    toxicity.fit(train, train)
    marks = seen["table"][(seen["table"][:, 0] == 1)][:, 4:6].sum(axis=1).max()  # two marks a word, two words a text
    assert marks + 4 * seen["rows"] == 4 * n


def test_quality_learns_from_all_labelled_texts(spark, make_docs, monkeypatch):
    train = spark.createDataFrame(
        [(i, f"A sentence, with words {i}. And one more.", 1) for i in range(300)] + [(1000 + i, "### ||| ### " * (i + 1), 0) for i in range(200)]
        + [(5000, None, 0), (5001, "x", None)], "doc_id long, text string, quality int")
    seen, mean = [], quality.mean
    monkeypatch.setattr(quality, "mean", lambda models, rows: (seen.extend(rows), mean(models, rows))[1])
    model = quality.fit(train, train, rows=100)
    assert len(seen) == 6 and sum(seen) == 501
    rows = {r.text: r.predicted for r in quality.score(make_docs([(1, "A sentence, with words 99. And one more."), (2, "||| ###")]), model).collect()}
    assert rows == {"A sentence, with words 99. And one more.": 1, "||| ###": 0}


def test_mean_of_models_is_the_mean_of_their_logits():
    rng = np.random.default_rng(1)
    x = rng.random((900, 3))
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    at = quality.cuts(x)
    parts = [quality.boost(x[a:b], y[a:b], rounds=4, pair_rounds=3, pairs=1, at=at) for a, b in ((0, 300), (300, 900))]
    logit = [np.log(m.scores(x) / (1 - m.scores(x))) for m in parts]
    got = quality.mean(parts, [300, 600]).scores(x)
    assert np.allclose(np.log(got / (1 - got)), logit[0] / 3 + logit[1] * 2 / 3)


def test_tables_of_keys_are_searched_whole():
    rng = np.random.default_rng(2)
    for size in (1, 2, 1000):
        table = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64) >> np.uint64(0 if size != 2 else 40))
        wanted = np.concatenate([table, table + np.uint64(1), rng.integers(0, 2**64, 500, dtype=np.uint64)])
        there, at = toxicity.Places(table).find(wanted)
        assert there.tolist() == np.isin(wanted, table).tolist() and (table[at[there]] == wanted[there]).all()


def test_labelled_rows_are_whole(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in [*range(-50, 200), 7, 7, None]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i or 0) % 2) for i in [*range(-60, 90, 3), 6, None]], "doc_id int, toxic int")
    known = common.known_labels(labels, "toxic", (0, 1))
    got = common.labelled(docs, known)
    assert got.columns == ["doc_id", "text", "label"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.join(known, "doc_id").select("doc_id", "text", "label").collect()))
