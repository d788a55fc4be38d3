import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import language as L
from larkspur.llm.language import WINDOWS_PER_ROW, _sample, fit_network, predict_language
from larkspur.llm.queries import op6_language
from tests.llm.cases import LONG, documents, tables, with_clashes


def test_held_out_accuracy(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    rows = {r["doc_id"]: r for r in op6_language(spark, sf).collect()}
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert len(rows) == len(table)
    assert all(rows[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in table)
    held = [r for r in table if rows[r["doc_id"]]["held_out"] and r["lang"] and len(r["text"] or "") > 40]
    assert np.mean([rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def labelled(spark, n=120):
    rows = [(k, ("the cat and the dog were here " if k % 2 else "der hund und die katze waren hier ") * (1 + k % 4)) for k in range(n)]
    frame = documents(spark, rows)
    from pyspark.sql import functions as F

    return frame.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))


def test_cases(spark):
    network = L.fit_network(labelled(spark).unionByName(documents(spark)))
    assert network.languages == ["de", "en"]
    docs = with_clashes(documents(spark), ["lang_pred", "score", "_window"])
    rows = L.predict_language(docs, network).collect()
    assert len(rows) == 13
    for r in rows:
        blank = not r["text"] or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == blank and (not blank or r["score"] == 0)
    assert L.predict_language(documents(spark, []), network).count() == 0


def test_what_is_no_letter(spark):
    texts = ["½ ² ¼", "①②③", "Ⅷ", "१२३", "२ ½!", "_ - ³", "़ ̈", "ª", "ʰ", "漢", "1a"]
    network = fit_network(documents(spark, [(k, "some words of a text") for k in range(9)]).withColumn("lang", F.lit("en")))
    found = {r["doc_id"]: r["lang_pred"] for r in predict_language(documents(spark, list(enumerate(texts))), network).collect()}
    letters = [any(unicodedata.category(c).startswith("L") for c in t) for t in texts]
    assert [found[k] != "und" for k in range(len(texts))] == letters and not all(letters[:7])


def test_a_repeated_text_does_not_crowd_out_others(spark):
    same = [(k, "the same words again and again", "en") for k in range(3000)]
    rest = [(3000 + k, f"{a} autre texte numéro {a}", lang) for k, (a, lang) in enumerate((f"w{i}", l) for i in range(60) for l in ("fr", "de"))]
    rows = spark.createDataFrame(same + rest, "doc_id bigint, text string, lang string")
    found = _sample(rows.selectExpr("lang", "text", "CAST(doc_id AS STRING) AS id"), 50)
    assert Counter(r["lang"] for r in found) == {"en": 50 * WINDOWS_PER_ROW, "fr": 50 * WINDOWS_PER_ROW, "de": 50 * WINDOWS_PER_ROW}


def test_nothing_to_learn_from(spark):
    network = L.fit_network(documents(spark))
    assert {r["lang_pred"] for r in L.predict_language(documents(spark), network).collect()} == {"und"}


def test_the_same_rows_give_the_same_network(spark):
    a, b = L.fit_network(labelled(spark)), L.fit_network(labelled(spark).repartition(5))
    assert all(np.array_equal(x, y) for x, y in zip(a._weights(), b._weights()))


def test_whole_text_counts(spark):
    network = L.fit_network(labelled(spark))
    text = "the dog " * 10 + "und die katze waren hier " * 400
    assert L.predict_language(documents(spark, [(1, text)]), network).first()["lang_pred"] == "de"


def test_windows_cover_the_text():
    data = LONG.encode()
    rows = L.windows_of(data)
    assert rows.shape[1] == L.WINDOW and bytes(rows.ravel()[:len(data)]) == data.lower()
    assert L.windows_of(b"").shape == (1, L.WINDOW)


def test_tables_equal_the_filters():
    network = L.ByteNetwork(["a", "b"], seed=4)
    rows = L.windows_of(bytes(range(1, 200)) * 5)
    embedded = network.embedding[rows]
    pooled = []
    for w, f in zip(L.WIDTHS, network.filters):
        views = np.lib.stride_tricks.sliding_window_view(embedded.reshape(len(rows), -1), w * L.EMBEDDING, axis=1)[:, ::L.EMBEDDING]
        pooled.append((views @ f).max(axis=1))
    logits = np.maximum(np.concatenate(pooled, axis=1) + network.bias, 0) @ network.dense + network.offset
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(network.predict(rows, network.tables()), want, atol=1e-5)


def test_gradients():
    network = L.ByteNetwork(["a", "b", "c"], seed=2)
    rng = np.random.default_rng(0)
    rows, labels = rng.integers(1, 256, (6, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        embedded = network.embedding[rows].reshape(6, -1)
        pooled = [(np.lib.stride_tricks.sliding_window_view(embedded, w * L.EMBEDDING, axis=1)[:, ::L.EMBEDDING] @ f).max(axis=1)
                  for w, f in zip(L.WIDTHS, network.filters)]
        logits = np.maximum(np.concatenate(pooled, axis=1) + network.bias, 0) @ network.dense + network.offset
        top = logits - logits.max(axis=1, keepdims=True)
        return -(top - np.log(np.exp(top).sum(axis=1, keepdims=True)))[np.arange(6), labels].mean()

    for name in ("embedding", "bias", "dense", "offset"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    network.filters = [f.astype(np.float64) for f in network.filters]
    grads = network._gradients(rows, labels, np.ones(6))
    for w, g in zip(network._weights(), grads):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in w.shape)
            old, step = w[at], 1e-5
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4
