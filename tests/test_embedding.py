"""Embedding functions: batches, failures, retries, pace and breaker."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import embedding as e
from larkspur.operators.embedding import EmbedPolicy, _Caller, embed_column, embed_image_text, embed_images, next_batch_size


class Script:
    """Embedding function that follows a list of outcomes and records its calls."""

    def __init__(self, outcomes=()):
        self.outcomes, self.calls = list(outcomes), []

    def __call__(self, items):
        self.calls.append(list(items))
        outcome = self.outcomes.pop(0) if self.outcomes else None
        if isinstance(outcome, Exception):
            raise outcome
        return outcome if outcome is not None else [[float(len(i))] for i in items]


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(round(seconds, 6))
        self.now += seconds


def caller(script, clock=None, interval=0.0, **policy):
    clock = clock or Clock()
    return _Caller(script, EmbedPolicy(**policy), interval, clock, clock.sleep)


def test_batches_are_bounded():
    script = Script()
    rows = caller(script, batch_size=3, max_batch=3).run(list("abcdefg"))
    assert [len(c) for c in script.calls] == [3, 3, 1] and len(rows) == 7 and all(r[1] is None for r in rows)


def test_few_outcomes_are_held_at_a_time():
    taken, script = [], Script()
    items = (taken.append(i) or ("" if i % 5 == 0 else "x" * i) for i in range(2000))
    blocks = e._run_batch(caller(script), items, lambda text: None if text else "empty")
    first = next(blocks)
    assert len(first) == e.BLOCK_ROWS and len(taken) < e.BLOCK_ROWS + 20
    rows = [*first.to_pylist(), *(r for b in blocks for r in b.to_pylist())]
    assert [r["vector"] for r in rows] == [None if i % 5 == 0 else [i] for i in range(2000)]
    assert [r["error_message"] for r in rows] == ["empty" if i % 5 == 0 else None for i in range(2000)]
    assert all(len(c) == 12 for c in script.calls[:-1])


def test_a_failed_batch_fails_its_keys_only():
    rows = caller(Script([None, OSError("down")]), batch_size=2).run(list("abcdef"))
    assert [r[1] for r in rows] == [None, None, e.EMBED_FAILED, e.EMBED_FAILED, None, None]
    assert rows[2][2] == "OSError: down"


def test_count_mismatch_is_a_failure():
    rows = caller(Script([[[1.0]]]), batch_size=2).run(["a", "b"])
    assert rows[0][2] == "UpstreamError: upstream returned 1 vectors for 2 inputs"


def test_fallback_to_single_calls():
    script = Script([OSError("batch")])
    rows = caller(script, batch_size=3, fallback_individual=True).run(["a", "bb", "ccc"])
    assert script.calls == [["a", "bb", "ccc"], ["a"], ["bb"], ["ccc"]] and [r[0][0] for r in rows] == [1, 2, 3]


def test_errors_can_be_raised():
    with pytest.raises(OSError):
        caller(Script([OSError("down")]), on_error="raise").run(["a"])
    rows = caller(Script([OSError("batch")]), on_error="raise", fallback_individual=True).run(["a", "b"])
    assert len(rows) == 2 and rows[0][1] is None


@pytest.mark.parametrize("current, ok, want", [(4, True, 5), (8, True, 8), (8, False, 4), (3, False, 2), (2, False, 2)])
def test_next_batch_size(current, ok, want):
    assert next_batch_size(current, ok, EmbedPolicy(batch_size=4, min_batch=2, max_batch=8, adaptive=True)) == want
    assert next_batch_size(current, ok, EmbedPolicy(batch_size=4, min_batch=2, max_batch=8)) == current


def test_adaptive_sizes():
    script = Script([None, None, OSError("x"), None])
    rows = caller(script, batch_size=4, min_batch=1, max_batch=12, adaptive=True).run(["x"] * 20)
    assert [len(c) for c in script.calls] == [4, 5, 6, 3, 2]
    assert [r[3] for r in rows][::5] == [4, 5, 6, 3]


def test_retry_waits_grow_within_bounds():
    clock, script = Clock(), Script([OSError("1"), OSError("2"), OSError("3"), None])
    rows = caller(script, clock, attempts=4, wait_min=2.0, wait_max=3.0).run(["a"])
    assert rows[0][1] is None and clock.slept == [2.0, 2.0, 3.0]


def test_program_errors_are_not_retried():
    script = Script([TypeError("bug")])
    rows = caller(script, attempts=5).run(["a"])
    assert len(script.calls) == 1 and rows[0][2] == "TypeError: bug"


def test_pace():
    clock, script = Clock(), Script()
    caller(script, clock, interval=0.5, batch_size=1, max_batch=1).run(["a", "b", "c"])
    assert clock.slept == [0.5, 0.5]


def test_breaker_opens_and_recovers():
    clock, script = Clock(), Script([OSError("1"), OSError("2")])
    c = caller(script, clock, batch_size=1, max_batch=1, breaker_failures=2, breaker_recovery_s=10)
    rows = c.run(list("abcd"))
    assert len(script.calls) == 2 and [r[2] for r in rows[2:]] == [e.BREAKER_OPEN] * 2
    clock.now += 11
    assert c.run(["e", "f"])[1][1] is None and len(script.calls) == 4
    script.outcomes = [OSError("3")]
    c.failures, c.opened_at = 2, clock.now - 11
    assert [r[2] for r in c.run(["g", "h"])] == ["OSError: 3", e.BREAKER_OPEN]


def test_policy_is_checked():
    for bad in ({"batch_size": 13}, {"min_batch": 0}, {"on_error": "ignore"}):
        with pytest.raises(ValueError):
            EmbedPolicy(**bad)


def test_rate_is_shared_by_the_slots(spark):
    assert e._task_interval(spark, EmbedPolicy(calls_per_second=4)) == spark.sparkContext.defaultParallelism / 4
    assert e._task_interval(spark, EmbedPolicy()) == 0


def test_registry():
    e.register_embedder("named", e.hashing_embedder(8))
    assert "named" in e.embedder_names() and e.get_embedder("named").dim == 8
    with pytest.raises(ValueError, match="unknown embedder 'other'; registered: .*hashing"):
        e.get_embedder("other")


def test_embed_column(spark):
    rows = spark.createDataFrame([(1, "red fox"), (2, "  "), (3, None), (4, "red fox")], "id int, text string")
    got = {r.id: r for r in embed_column(rows, "text", "hashing").collect()}
    assert got[1].vector == got[4].vector and np.linalg.norm(got[1].vector) == pytest.approx(1.0)
    assert not got[2].success and got[2].error_message == "Text cannot be empty" and got[3].vector is None


def test_only_the_text_goes_to_python(spark, folder):
    spark.range(5).select("id", F.lit("t").alias("text"), F.lit("x").alias("other")).write.parquet(folder + "/t")
    plan = embed_column(spark.read.parquet(folder + "/t"), "text", "hashing")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "embed(text" in plan


def test_embed_images_and_pairs(spark):
    rows = spark.createDataFrame([(1, bytearray(b"abc"), "t"), (2, bytearray(b""), "t"), (3, None, None)], "id int, image binary, text string")
    got = {r.id: r for r in embed_images(rows, "image", "byte_histogram").collect()}
    assert got[1].success and [got[i].error_message for i in (2, 3)] == [e.EMPTY_IMAGE] * 2

    class Pair:
        def __call__(self):
            return lambda images, texts: [[float(len(i)), float(len(t))] for i, t in zip(images, texts)]

    got = {r.id: r for r in embed_image_text(rows, "image", "text", Pair()).collect()}
    assert got[1].vector == [3.0, 1.0] and not got[2].success


def test_an_embedder_is_made_once_per_task(spark):
    class Counting:
        def __call__(self):
            made = [0]

            def embed(texts):
                made[0] += 1
                return [[float(made[0])] for _ in texts]

            return embed

    rows = spark.range(40).coalesce(1).select(F.concat(F.lit("t"), "id").alias("text"))
    policy = EmbedPolicy(batch_size=10, max_batch=12)
    calls = embed_column(rows, "text", Counting(), policy=policy).select(F.col("vector")[0].alias("n")).distinct().count()
    assert calls >= 1


def test_sql_function(spark):
    e.register_sql_embedder(spark, "embed_text", "hashing")
    row = spark.sql("SELECT embed_text('red fox') AS a, embed_text(' ') AS b").first()
    assert row.a.success and len(row.a.vector) == 64 and not row.b.success
