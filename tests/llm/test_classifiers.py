import numpy as np
import pytest
from cases import MIDDLE, documents, edge_rows, empty, remainder
from pyspark.sql import functions as F

from patronly.llm import language, quality, toxicity
from patronly.llm.text import may_learn

EDGES = len(edge_rows())


# ---------------------------------------------------------------- language
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = language.fit(docs.filter(may_learn(F.col("doc_id"), 4, 2)))
    found = language.predict(docs, model, keep=("doc_id", "lang")).collect()
    held = [r for r in found if remainder(r["doc_id"], 4) == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def naive(train, text, sizes=(1, 2, 3), buckets=1 << 15, smoothing=0.1):
    """The same model written out with dictionaries."""
    def grams(t):
        points = language._letter_words(t)
        return [b for n in sizes for b in language.gram_buckets(points, (n,), buckets)]

    scores = {}
    for label in sorted({lang for _, lang in train}):
        counts = np.full(buckets, smoothing)
        own = [t for t, lang in train if lang == label]
        for t in own:
            for b in grams(t):
                counts[b] += 1
        logs = np.log(counts / counts.sum()).astype(np.float32).astype(float)
        scores[label] = np.log(len(own)) + sum(logs[b] for b in grams(text))
    return max(scores, key=scores.get), scores


def test_language_scores_equal_brute_force_in_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(language, "PIECE", 7)
    train = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de"), ("un gato", "es")]
    docs = documents(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate(train)])
    model = language.fit(docs, block=3)  # two blocks of languages
    assert len(model.blocks) == 2
    tests = ["the dog and the chat", "der chien und", "gato gato cat"]
    found = language.predict(documents(spark, [(i, t, None, None) for i, t in enumerate(tests)]), model).orderBy("doc_id").collect()
    for row, text in zip(found, tests):
        best, scores = naive(train, text)
        assert row["lang_pred"] == best
        total = np.logaddexp.reduce(list(scores.values()))
        assert row["score"] == pytest.approx(np.exp(scores[best] - total), rel=1e-4)


def test_texts_without_letters_teach_no_language(spark):
    train = [(1, "hello there", "en"), (2, "bonjour", "fr")] + [(10 + i, t, "xx") for i, t in enumerate(["", " ", "123 !", None] * 7)]
    model = language.fit(documents(spark, [(i, t, lang, "s") for i, t, lang in train] + [(3, "--", "en", "s")]))
    assert model.names == ["en", "fr"]
    assert np.allclose(model.blocks[0].value[1], np.log([1, 1]))


def test_language_edges(spark):
    docs = documents(spark, edge_rows())
    model = language.fit(docs)
    found = language.predict(docs, model, keep=("doc_id", "text")).collect()
    assert len(found) == EDGES
    for row in found:
        no_letter = not any(c.isalpha() for c in row["text"] or "")
        assert (row["lang_pred"] == "und") == no_letter
    assert language.predict(empty(spark), model).count() == 0
    nothing = language.fit(empty(spark))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    kept = language.keep_known(docs, docs)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in edge_rows())
    assert language.keep_known(docs, empty(spark)).count() == kept.count()


# ---------------------------------------------------------------- quality
def test_quality_of_held_out_documents(spark):
    folder = MIDDLE.replace("0.01", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scores, model = quality.quality_scores(docs, labels, may_learn(F.col("label_id"), 5, 0))
    found = scores.join(labels, "doc_id").filter("quality is not null").collect()
    held = [r for r in found if remainder(r["doc_id"], 5) == 0]
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in held]) > 0.96
    assert 0.75 < model.prior < 0.95  # 85 of 100 labelled documents are good


def test_quality_sums_equal_numpy(spark):
    docs = documents(spark, edge_rows())
    trusted = spark.createDataFrame([(1,), (7,), (10,)], "label_id long")
    table = quality.feature_table(docs, trusted)
    rows = table.collect()
    x = np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in rows], float)
    w = np.linspace(-1, 1, quality.SIZE)
    n, n_p, soft_u, soft_p, plus_p, sum_p, sum_u, curve = quality._risk_sums(table, w, np.zeros(quality.SIZE), np.ones(quality.SIZE))
    x = np.clip(x, -quality.SPREAD, quality.SPREAD)
    z = x @ w
    p = np.array([r["trusted"] and r["part"] != 0 for r in rows])
    assert n == EDGES and n_p == p.sum()
    assert soft_u == pytest.approx(np.logaddexp(0, z).mean())
    assert np.allclose(sum_u, (1 / (1 + np.exp(-z))) @ x)
    assert np.allclose(sum_p, x[p].sum(axis=0))
    s = 1 / (1 + np.exp(-z))
    assert np.allclose(curve, (x * (s * (1 - s))[:, None]).T @ x)


def test_quality_edges(spark):
    docs = documents(spark, edge_rows())
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 1), (3, None), (None, 1), (10, 0)], "doc_id long, quality int")
    scores, _ = quality.quality_scores(docs, labels, F.lit(True))
    found = scores.collect()
    assert len(found) == EDGES and all(0 <= r["score"] <= 1 for r in found)
    assert quality.quality_scores(empty(spark), labels, F.lit(True))[0].count() == 0
    untaught, model = quality.quality_scores(docs, labels.limit(0), F.lit(True))
    assert model is None and {r["score"] for r in untaught.collect()} == {0.0}


# ---------------------------------------------------------------- toxicity
def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.labelled_rows(docs, labels, may_learn(F.col("label_id"), 4, 2)))
    found = toxicity.predict(docs, model).join(labels, "doc_id").filter("toxic is not null").collect()
    held = [r for r in found if remainder(r["doc_id"], 4) == 2]
    assert np.mean([(r["score"] >= 0.3) == (r["toxic"] == 1) for r in held]) > 0.9


def test_naming_a_group_says_nothing(spark):
    rows = []
    for i in range(120):
        rows.append((3 * i, f"those women are idiot number {i}", 1))
        word = "".join(chr(97 + int(c)) for c in str(1000 + i))
        rows.append((3 * i + 1, f"{word} some {word[::-1]}", 0))
        rows.append((3 * i + 2, f"{word} for {'women' if i % 6 == 0 else 'everyone'}", 0))
    docs = documents(spark, [(i, t, "en", "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    labelled = toxicity.labelled_rows(docs, labels, F.lit(True))
    fair, plain = toxicity.fit(labelled), toxicity.fit(labelled, fairness=0.0)
    at = fair.vocabulary.index("women")
    assert plain.weights[at] > 0.5 and abs(fair.weights[at]) < 0.3 * plain.weights[at]
    asked = documents(spark, [(1, "women vote", "en", "s"), (2, "men vote", "en", "s"), (3, "those are idiot people", "en", "s")])
    scores = {r["doc_id"]: r["score"] for r in toxicity.predict(asked, fair).collect()}
    assert abs(scores[1] - scores[2]) < 0.05 and scores[3] > 0.5 > scores[1]


def test_swaps_are_made_in_the_text(spark):
    """Stems of a term go and come with it: all features are taken again after a swap."""
    docs = documents(spark, [(1, "Muslim women vote. Muslims", "en", "s"), (2, "nobody is named", "en", "s")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    terms = {"faith": ["believers", "muslim", "muslims"], "gender": ["people", "women"]}
    found = {(tuple(r["gone"]), tuple(r["come"])): r["n"] for r in
             toxicity.counterfactuals(toxicity.labelled_rows(docs, labels, F.lit(True)), terms).collect()}
    # a swap to the other form leaves musli*; the only term of its group swaps with itself
    assert found == {
        (("musli*", "muslim"), ("belie*", "believe*", "believers")): 1, (("muslim",), ("muslims",)): 1,
        (("women",), ("peopl*", "people")): 1, ((), ()): 1, (("musli*", "muslims"), ("belie*", "believe*", "believers")): 1, (("muslims",), ("muslim",)): 1}


def test_score_hardly_moves_when_a_term_is_swapped(spark):
    rows = [(i, f"{'those muslims are fools' if i % 4 == 0 else 'the garden is green'} {chr(97 + i % 26) * 3}", int(i % 4 == 0)) for i in range(200)]
    rows += [(200 + i, f"the tree is {'tall' if i % 2 else 'old'} {chr(97 + i % 26) * 4}", 0) for i in range(60)]
    docs = documents(spark, [(i, t, "en", "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    labelled = toxicity.labelled_rows(docs, labels, F.lit(True))
    asked = documents(spark, [(1, "muslims vote", "en", "s"), (2, "believers vote", "en", "s"), (3, "jews vote", "en", "s"), (4, "those fools", "en", "s")])

    def scores(model):
        return {r["doc_id"]: np.log(r["score"] / (1 - r["score"])) for r in toxicity.predict(asked, model).collect()}

    fair, plain = scores(toxicity.fit(labelled)), scores(toxicity.fit(labelled, fairness=0.0))
    assert abs(fair[1] - fair[2]) < 0.2 < abs(plain[1] - plain[2]) and fair[4] > max(fair[1], fair[2])


def test_fit_equals_dense_minimiser(spark):
    """Features, swaps and objective written out with dense tables, minimised by plain steps."""
    draw = np.random.default_rng(4)
    listed = ["muslim", "women", "fools", "trees", "gardens", "green", "quiet"]
    rows = []
    for i in range(300):
        words = [w for w in listed if draw.random() < 0.4]
        toxic = int(("fools" in words) != (draw.random() < 0.1))
        rows.append((i, " ".join(words) + (". calm women" if i % 7 == 0 else ""), toxic))
    docs = documents(spark, [(i, t, "en", "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    terms = {"faith": ["believers", "muslim"], "gender": ["people", "women", "men"]}
    labelled = toxicity.labelled_rows(docs, labels, F.lit(True))
    model = toxicity.fit(labelled, terms, fairness=2.0, ridge=0.01, rounds=2000)

    def dense(text):
        words = text.replace(".", " ").split()
        own = {*words, *(w[:n] + "*" for n in (5, 7) for w in words if len(w) > n)}
        return np.array([float(v in own) for v in model.vocabulary])

    x, y, pairs = np.array([dense(t) for _, t, _ in rows]), np.array([r[2] for r in rows], float), []
    for _, t, _ in rows:
        for sentence in t.split("."):
            for term, others in (("muslim", ("believers", "muslim")), ("women", ("people", "men")), ("men", ("people", "women"))):
                if term in sentence.split():
                    pairs += [dense(sentence) - dense(" ".join(o if w == term else w for w in sentence.split())) for o in others]
    pairs = np.array(pairs)
    w, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(20_000):
        error = (1 / (1 + np.exp(-(x @ w + bias))) - y) / len(y)
        w = w - 0.1 * (x.T @ error + 0.01 * w + 2 * 2.0 * pairs.T @ (pairs @ w) / len(pairs))
        bias -= 0.1 * error.sum()
    assert np.allclose(model.weights, w, atol=0.02) and abs(model.bias - bias) < 0.02


def test_toxicity_edges(spark):
    docs = documents(spark, edge_rows())
    labels = spark.createDataFrame([(1, 1), (7, 0), (3, None), (None, 1), (10, 0), (10, 0)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_rows(docs, labels, F.lit(True)))
    found = toxicity.predict(docs, model).collect()
    assert len(found) == EDGES and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.predict(empty(spark), model).count() == 0
    assert toxicity.fit(toxicity.labelled_rows(docs, labels.limit(0), F.lit(True))) is None
    assert {r["score"] for r in toxicity.predict(docs, None).collect()} == {0.0}
