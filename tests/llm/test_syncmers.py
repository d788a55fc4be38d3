import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.llm import syncmers as S
from larkspur.llm.queries import op10_syncmers
from tests.llm.cases import LONG, documents, tables, with_clashes


@pytest.mark.parametrize("run_rows", [4096, 3])
def test_query(spark, folder, monkeypatch, run_rows):
    monkeypatch.setattr(S, "RUN_ROWS", run_rows)
    texts = {1: "one two three " * 20, 2: "", 3: None, 7: "é漢😀" * 5, 9: LONG, 10: "the same text " * 8, 12: "the same text " * 8,
             10**15: "far away", -5: "below zero " * 7}
    docs = documents(spark, list(texts.items()))
    rows = {r["doc_id"]: r for r in op10_syncmers(spark, tables(spark, f"{folder}/t", documents=docs)).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        cut = len(own) // 3
        edited = own[:len(own) - cut] + after[:cut]
        assert rows[i]["n_chars"] == len(own)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
        if edited == own:
            assert rows[i]["near_edited"] == 1 and rows[i]["fingerprint"] == rows[i]["edited_fingerprint"]
    assert rows[10]["fingerprint"] == rows[12]["fingerprint"] and rows[12]["near_next"] == 1
    assert len({r["fingerprint"] for r in rows.values()}) == 7


def test_cases(spark, folder):
    docs = with_clashes(documents(spark), ["anchors", "run", "part", "mark", "head", "next_text"])
    assert op10_syncmers(spark, tables(spark, f"{folder}/t", documents=docs)).count() == 13
    nothing = tables(spark, f"{folder}/e", documents=documents(spark, []))
    assert op10_syncmers(spark, nothing).count() == 0
    alone = tables(spark, f"{folder}/a", documents=documents(spark, [(4, "only " * 30)]))
    row = op10_syncmers(spark, alone).first()
    assert row["near_next"] == 1


def brute_positions(hashes, short, k, s):
    inner = k - s + 1
    out = []
    for i in range(len(hashes) - k + 1):
        run = short[i:i + inner]
        if min(run) in (run[0], run[-1]):
            out.append(i)
    return out


@pytest.mark.parametrize("k,s", [(8, 2), (5, 1), (6, 3), (3, 2)])
def test_anchors_are_closed_syncmers(spark, k, s):
    words = [f"w{(i * i) % 37}" for i in range(120)]
    frame = spark.createDataFrame([(" ".join(words),)], "text string")
    found = frame.select(S.anchors(F.col("text"), k, s).alias("a")).first()["a"]
    of = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in set(words)], "w string").withColumn("h", F.hash("w")).collect()}
    hashes = [of[w] for w in words]
    short = [[h] for h in hashes]
    rows = spark.createDataFrame([(i, *(hashes[i:i + s])) for i in range(len(hashes) - s + 1)],
                                 "i int, " + ", ".join(f"c{j} int" for j in range(s)))
    fold = F.col("c0")
    for j in range(1, s):
        fold = F.hash(fold, f"c{j}")
    short = [r["v"] for r in rows.select("i", fold.alias("v")).orderBy("i").collect()]
    assert [x["position"] for x in found] == brute_positions(hashes, short, k, s)


def by_places(a, b):
    """Most frequent distance of the first places of shared hashes, and the anchors that agree at it."""
    first = [{}, {}]
    for own, anchors in zip(first, (a, b)):
        for position, value in sorted(anchors):
            own.setdefault(value, position)
    moved = [first[1][v] - first[0][v] for v in first[0] if v in first[1]]
    shift = min(sorted(set(moved)), key=lambda m: (-moved.count(m), m), default=0)
    return shift, len({(p + shift, v) for p, v in a} & {(p, v) for p, v in b})


def test_shared_places(spark):
    rng = random.Random(4)
    pairs = []
    for k in range(120):
        a = sorted({rng.randint(0, 40) for _ in range(rng.randint(0, 12))})
        a = [(p, rng.randint(0, 9)) for p in a]
        b = [(p + rng.choice((0, 3, 3, 5)), v if rng.random() < 0.7 else rng.randint(0, 9)) for p, v in a] + [(90, 1)] * rng.randint(0, 1)
        pairs.append((k, a, b))
    kind = "array<struct<position: int, hash: bigint>>"
    frame = spark.createDataFrame(pairs, f"id int, a {kind}, b {kind}").withColumn("shift", S.shared_shift(F.col("a"), F.col("b")))
    rows = frame.withColumn("n", S.aligned(F.col("a"), F.col("b"), F.col("shift"))).collect()
    assert {r["id"]: (r["shift"], r["n"]) for r in rows} == {k: by_places(a, b) for k, a, b in pairs}


def test_the_same_words_at_other_places_are_less_alike(spark, folder):
    """The likeness is that of places: with hashes alone the mixed text would be as near as the moved one."""
    passages = [" ".join(f"w{j}x{i * i % 89}" for i in range(40)) for j in range(5)]
    moved, mixed = "some words ahead " + " ".join(passages), " ".join(passages[j] for j in (3, 0, 4, 1, 2))
    found = []
    for k, other in enumerate((moved, mixed)):
        where = tables(spark, f"{folder}/{k}", documents=documents(spark, [(2, " ".join(passages)), (1, other)]))
        found.append({r["doc_id"]: r for r in op10_syncmers(spark, where).collect()}[2])
    assert found[0]["near_next"] > 0.9 and found[0]["shift_next"] == 3 and found[1]["near_next"] < 0.4


def test_a_passage_keeps_its_anchors(spark):
    passage = " ".join(f"p{i * 7 % 101}" for i in range(80))
    rows = [(1, "a b c d e f g h i j " + passage), (2, passage + " q r s t"), (3, " ".join(f"z{i}" for i in range(60)))]
    printed = S.fingerprints(documents(spark, rows)).cache()
    matched = S.matched_positions(printed).collect()
    assert [(r["a"], r["b"], r["shift"]) for r in matched if r["anchors"] > 5] == [(1, 2, -10)]
    assert not [r for r in matched if 3 in (r["a"], r["b"])]
    with pytest.raises(ValueError):
        S.anchors(F.col("text"), 4, 4)


def test_no_python_in_the_plan(spark, data, capsys):
    op10_syncmers(spark, data).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
