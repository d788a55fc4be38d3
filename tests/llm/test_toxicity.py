import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import toxicity as T
from larkspur.llm.queries import CATEGORIES, TOXIC_FROM, op1_toxicity
from tests.llm.cases import documents, tables, with_clashes


def test_held_out(spark, data):
    """Learned from two thirds of the labels, judged on the rest."""
    sf = data.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    chain = T.fit_chain(docs, labels.where(~out), CATEGORIES)
    rows = T.predict_categories(docs, chain).join(labels.where(out), "doc_id").drop("text").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert np.mean([r["p_toxic"] >= TOXIC_FROM for r in toxic]) > 0.85
    assert np.mean([r["p_toxic"] >= TOXIC_FROM for r in clean]) < 0.005
    assert np.mean([(r["p_low_quality"] > 0.5) == (r["low_quality"] == 1) for r in rows]) > 0.97


def made(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{rng.randint(0, 300)}" for _ in range(30)]
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
        bad = k % 4 == 0
        rows.append((k, " ".join([*words, *(["awful"] if bad else [])])))
        labels.append((k, int(bad), int(bad and k % 8 == 0) if k % 10 else None))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, rude int, threat int")


def test_cases(spark, folder):
    docs, labels = made(spark)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (4, 1, 1), (99_999, 1, 0)], labels.schema))
    chain = T.fit_chain(docs, odd, ["rude", "threat"])
    scored = T.predict_categories(with_clashes(documents(spark), ["p_rude", "_id", "_text", "_label0"]), chain)
    assert scored.count() == 13 and scored.columns.count("p_rude") == 1
    assert all(0 <= r["p_rude"] <= 1 and 0 <= r["p_threat"] <= 1 for r in scored.collect())
    own = {r["doc_id"]: r["p_rude"] for r in T.predict_categories(docs, chain).collect()}
    assert all((own[k] > 0.5) == (k % 4 == 0) for k in own)
    assert T.predict_categories(documents(spark, []), chain).count() == 0
    table = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = op1_toxicity(spark, tables(spark, f"{folder}/t", documents=documents(spark), labels=table)).collect()
    assert len(rows) == 13 and not any(r["toxic"] for r in rows)


def test_later_models_learn_from_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    words = [np.unique(rng.integers(0, 50, 8)) for _ in range(300)]
    first = np.array([3 in w for w in words], float)
    labels = np.column_stack([first, first])
    chain = T.Chain(["a", "b"])
    chain.fit(words, rng.normal(size=(300, 2)), labels, np.arange(300) % T.FOLDS)
    assert len(chain.weights) == 2
    assert len(chain.weights[1]) == len(chain.columns[1]) + 2 + 1 + 1
    assert chain.weights[1][-2] > 0


def test_near_copies_count_once(spark):
    docs, labels = made(spark, 80)
    # A crowd of labelled copies with a word of its own must not make that word telling.
    crowd = documents(spark, [(1000 + k, "zebra " + " ".join(f"c{j}" for j in range(40))) for k in range(200)])
    more = crowd.select("doc_id", F.lit(1).alias("rude"), F.lit(0).alias("threat"))
    chain = T.fit_chain(docs.unionByName(crowd), labels.unionByName(more), ["rude"])
    row = T.predict_categories(documents(spark, [(1, "a zebra at the zoo")]), chain).first()
    assert row["p_rude"] < 0.5


def test_one_row_of_a_repeated_id(spark, monkeypatch):
    rows = [(1, f"word{k % 50} plain text {k}") for k in range(5000)]
    rows += [(k, " ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(8))) for k in range(2, 9)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)], "doc_id bigint, toxic int")
    taken = []
    monkeypatch.setattr(T.Chain, "fit", lambda self, words, *rest: taken.append(len(words)))
    T.fit_chain(documents(spark, rows), labels, ["toxic"], rows=8)
    assert taken == [8]


def test_words_come_from_the_other_folds(monkeypatch):
    """A word that tells all in one fold alone is not chosen by the model that judges this fold."""
    rng = np.random.default_rng(0)
    folds = np.arange(300) % T.FOLDS
    labels = rng.integers(0, 2, (300, 1)).astype(float)
    words = [np.array([1000 + k % 7] + ([5] if f == 2 and y[0] else [])) for k, (f, y) in enumerate(zip(folds, labels))]
    chosen, real = [], T._selected
    monkeypatch.setattr(T, "WORDS", 1)
    monkeypatch.setattr(T, "_selected", lambda *a: (chosen.append(real(*a).tolist()), real(*a))[1])
    T.Chain(["c"]).fit([np.unique(w) for w in words], rng.random((300, 2)), labels, folds)
    # Word 5 is the first of all.
    assert [c == [0] for c in chosen] == [True, True, False, True, True, True]


def test_linear_model():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=(2000, 2)), np.ones(2000)])
    y = (rng.random(2000) < T._sigmoid(x @ np.array([2.0, -1.0, 0.5]))).astype(float)
    assert np.allclose(T.fit_linear(x, y, 1e-6), [2.0, -1.0, 0.5], atol=0.3)
