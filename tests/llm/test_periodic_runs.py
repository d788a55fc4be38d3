import hashlib
import random
import re
import zlib

from hypothesis import given, settings, strategies as st

from larkspur.llm.periodic_runs import LinkCutPaths, collapsed, find_runs, repeating_parts, repetitions, runs_of
from larkspur.llm.queries import op13_periodic_runs
from tests.llm.cases import LONG, documents, tables, with_clashes


def by_definition(words, least):
    """Runs by comparing all words with those every period away."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least and (i, j + q) not in seen:
                out.append((i, j + q - i, q))
            if j - i >= q:
                seen.add((i, j + q))
            i = j + 1
    # A stretch also has multiples of its smallest period.
    return sorted((r for r in out), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 14))
def test_runs_of_short_alphabets(words, least):
    assert repetitions(words, least) == by_definition(words, least)
    assert runs_of(words, least) == by_definition(words, least)


def test_runs_inside_other_words():
    rng = random.Random(2)
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 8)):
            part = [rng.randint(0, 9) for _ in range(rng.randint(1, 12))]
            words += part * rng.choice((1, 1, 2, 3, 5)) + part[:rng.randint(0, len(part))]
            words += [rng.randint(10, 60) for _ in range(rng.randint(0, 9))]
        assert runs_of(words) == by_definition(words, 12), words
        inside = {i for a, b in repeating_parts(words) for i in range(a, b)}
        assert all(set(range(s, s + n)) <= inside for s, n, _ in by_definition(words, 12))


def test_access_returns_last_colours():
    rng = random.Random(5)
    for _ in range(50):
        parents = [-1] + [rng.randint(0, i) for i in range(40)]
        paths, colours = LinkCutPaths(parents), [0] * 41
        for step in range(1, 120):
            node, at, want = rng.randint(0, 40), None, []
            at = node
            while at >= 0:
                if not want or colours[at] != want[-1][1]:
                    want.append((at, colours[at]))
                at = parents[at]
            got = [f for k, f in enumerate(paths.access(node, step))]
            merged = [f for k, f in enumerate(got) if not k or f[1] != got[k - 1][1]]
            assert merged == want
            at = node
            while at >= 0:
                colours[at] = step
                at = parents[at]


def test_long_texts_of_one_word():
    n = 60_000
    assert runs_of(["a"] * n) == [(0, n, 1)] and collapsed(["a"] * n, [(0, n, 1)]) == "a"


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = by_definition(words, 12) if n < 3000 else runs_of(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query(spark, folder):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 150))) for _ in range(300)]
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()] + [(100 + k, t) for k, t in enumerate(texts)]
    rows += [(17, "x y\tz " * 9), (18, LONG)]
    found = op13_periodic_runs(spark, tables(spark, f"{folder}/t", documents=documents(spark, rows)))
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in found.collect()), key=repr)
    assert got == sorted(((i, *expected(i, t)) for i, t in rows), key=repr)
    assert sum(r[1] for r in got) > 10
    empty = tables(spark, f"{folder}/e", documents=documents(spark, []))
    assert op13_periodic_runs(spark, empty).count() == 0


def test_given_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"] or "") < 9000}
    for r in op13_periodic_runs(spark, data).collect():
        if r["doc_id"] in texts:
            assert tuple(r[c] for c in COLUMNS) == expected(r["doc_id"], texts[r["doc_id"]])


def test_other_columns_stay(spark):
    docs = with_clashes(documents(spark), ["runs", "collapsed", "words", "a.b"])
    found = find_runs(docs, min_words=4)
    assert found.columns == [*(c for c in docs.columns if c not in ("runs", "collapsed")), "runs", "collapsed"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert rows[4]["runs"] == [] and rows[4]["collapsed"] == "" and rows[8]["collapsed"].startswith("word x")
    assert len(rows) == len({r["doc_id"] for r in docs.collect()}) and found.count() == docs.count()
