"""Document fingerprints from closed syncmers of words, in column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.session import stage

#: Words of a k-mer and of the inner substrings whose least hash must lie at an edge.
K, S = 8, 2
#: Documents of one task in the order of ids.
RUN_ROWS = 4096
#: Most quantiles of the ids that the driver holds.
MAX_BOUNDS = 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """``array<struct<position, hash>>``: the closed syncmers of a text, in order.

    A k-mer of words is chosen when the least hash among its inner s-mers is that of the first or the last one. That
    depends on nothing outside the k-mer, so a passage keeps its anchors in any text. A text without such a k-mer has one
    anchor, its whole word sequence; a null counts as empty.
    """
    if not 0 < s < k:
        raise ValueError("s must be at least 1 and less than k")
    words = F.split(F.coalesce(text, F.lit("")), r"\s+")
    inner = k - s + 1

    def chosen(word: Column) -> Column:
        n = F.size(word)

        def of(short: Column) -> Column:
            have, least = 1, short
            while 2 * have <= inner:
                have, least = 2 * have, _joined(least, least, have, F.least)
            return _let(least, lambda runs: picked(short, runs, inner - have))

        def picked(short: Column, runs: Column, rest: int) -> Column:
            def at_edge(i: Column) -> Column:
                smallest = F.least(F.get(runs, i), F.get(runs, i + rest)) if rest else F.get(runs, i)
                return F.least(F.get(short, i), F.get(short, i + (inner - 1))) == smallest

            places = F.filter(F.sequence(F.lit(0), n - k), at_edge)
            return F.transform(places, lambda i: F.struct(i.alias("position"), F.xxhash64(F.slice(word, i + 1, k)).alias("hash")))

        whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(word).alias("hash")))
        short = word
        for j in range(1, s):
            short = _joined(short, F.slice(word, j + 1, n), 0, F.hash)
        found = F.when(n >= k, _let(short, of))
        return _let(found, lambda x: F.when(F.coalesce(F.size(x) > 0, F.lit(False)), x).otherwise(whole))

    return _let(F.transform(words, lambda w: F.hash(w)), chosen)


def _joined(a: Column, b: Column, shift: int, how: Callable[[Column, Column], Column]) -> Column:
    """``how(a[i], b[i + shift])`` for every ``i`` that both have."""
    n = F.size(b) - shift
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), lambda x, y: how(x, y))


def digest(hashes: Column) -> Column:
    """A fingerprint as a string: two 64-bit hashes of the anchors in order, in hexadecimal."""
    parts = [F.lpad(F.hex(F.xxhash64(F.lit(salt), hashes)), 16, "0") for salt in (1, 2)]
    return F.lower(F.concat(*parts))


def shared_shift(a: Column, b: Column) -> Column:
    """How far the anchors that two texts share are moved, by the most frequent distance; the least of equal ones, else 0.

    Of each hash the first place in either text counts. The anchors of both are put in order together, so that a pair
    stands side by side and no two arrays are compared element by element.
    """
    def placed(anchor: Column, side: int) -> Column:
        # Of the first text the first place comes last, next to the first place of the second.
        return F.struct(anchor["hash"].alias("hash"), F.lit(side).alias("side"),
                        (-anchor["position"] if side == 0 else anchor["position"]).alias("at"))

    def paired(both: Column) -> Column:
        following = F.slice(both, 2, F.greatest(F.size(both) - 1, F.lit(0)))
        moved = F.zip_with(F.slice(both, 1, F.greatest(F.size(both) - 1, F.lit(0))), following, lambda x, y: F.when(
            (x["hash"] == y["hash"]) & (x["side"] == 0) & (y["side"] == 1), y["at"] + x["at"]))
        return F.array_sort(F.filter(moved, lambda m: m.isNotNull()))

    start = F.struct(F.lit(None).cast("int").alias("value"), F.lit(0).alias("run"), F.lit(0).alias("shift"), F.lit(0).alias("most"))

    def count(state: Column, value: Column) -> Column:
        run = F.when(state["value"] == value, state["run"] + 1).otherwise(1)
        return F.struct(value.alias("value"), run.alias("run"), F.when(run > state["most"], value).otherwise(state["shift"]).alias("shift"),
                        F.greatest(run, state["most"]).alias("most"))

    both = F.array_sort(F.concat(F.transform(a, lambda x: placed(x, 0)), F.transform(b, lambda x: placed(x, 1))))
    return _let(both, lambda x: F.aggregate(paired(x), start, count, lambda state: state["shift"]))


def aligned(a: Column, b: Column, shift: Column) -> Column:
    """Number of anchors of ``a`` that ``b`` has as well, exactly ``shift`` words later; told apart by 64-bit checksums."""
    own = F.transform(a, lambda x: F.xxhash64((x["position"] + shift).cast("int"), x["hash"]))
    return F.size(F.array_intersect(own, F.transform(b, lambda x: F.xxhash64(x["position"].cast("int"), x["hash"]))))


def likeness(a: Column, b: Column, shared: Column) -> Column:
    """Share of the anchors of two texts that agree in hash and, ``shared`` of them, in place; 0 to 1."""
    return shared / (F.size(a) + F.size(b) - shared)


def fingerprints(docs: DataFrame, text_column: str = "text", k: int = K, s: int = S) -> DataFrame:
    """``docs`` with ``anchors`` and ``fingerprint``; equal texts have equal ones. Columns of these names are replaced."""
    found = docs.withColumn("anchors", anchors(F.col(text_column), k, s))
    return found.withColumn("fingerprint", digest(F.col("anchors.hash")))


def matched_positions(printed: DataFrame, id_column: str = "doc_id", most_shared: int | None = None) -> DataFrame:
    """``a``, ``b``, ``shift``, ``anchors``: pairs of documents by how many anchors they share at the same distance.

    One row for each pair and shift of position, so a passage that stands elsewhere in another document shows as one
    row with many anchors. The smallest id that has an anchor stands for all that have it, so an anchor in ``n``
    documents gives ``n - 1`` rows. ``most_shared`` leaves out anchors in more documents, where only rare ones matter.
    """
    spread = printed.select(F.col(id_column).alias("id"), F.explode("anchors").alias("anchor")).select(
        "id", "anchor.position", "anchor.hash")
    spread = spread.groupBy("hash", "id").agg(F.min("position").alias("position"))
    first = spread.groupBy("hash").agg(F.min(F.struct("id", "position")).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1" if most_shared is None else f"n > 1 AND n <= {int(most_shared)}")
    pairs = spread.join(first, "hash").where("id <> first.id")
    return pairs.groupBy(F.col("first.id").alias("a"), F.col("id").alias("b"),
                         (F.col("position") - F.col("first.position")).alias("shift")).agg(F.count("*").alias("anchors"))


def _in_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with two numbers that rise with ``id``, ``run`` and ``part``, some ``RUN_ROWS`` documents in each pair.

    Ids must be numbers. Rows of one id share a pair, so an id that holds many rows makes a long run.

    The first counts the quantiles below an id (at most ``MAX_BOUNDS`` of them are held by the driver), the second
    divides the span between two evenly. Rows without an id come first and are cut by the checksum of their text.
    """
    n = docs.count()
    coarse = max(1, min(MAX_BOUNDS, -(-n // RUN_ROWS)))
    fine = max(1, -(-n // (coarse * RUN_ROWS)))
    shares = [i / coarse for i in range(1, coarse)] or [0.5]
    found = docs.agg(F.percentile_approx("id", shares, 100 * MAX_BOUNDS), F.min("id"), F.max("id")).first()
    bounds = sorted({*(found[0] or []), *(x for x in found[1:] if x is not None)}) or [0]
    known = F.array(*(F.lit(float(b)) for b in bounds))
    value = F.col("id").cast("double")
    below = F.size(F.filter(known, lambda b: b < value))
    docs = docs.withColumn("run", F.when(F.col("id").isNull(), -1).otherwise(below))
    low, high = (F.get(known, F.least(F.greatest(F.col("run") + i, F.lit(0)), F.lit(len(bounds) - 1))) for i in (-1, 0))
    part = F.floor((value - low) / F.greatest(high - low, F.lit(1.0)) * fine)
    return docs.withColumn("part", F.when(F.col("id").isNull(), F.expr("mark div 4194304")).otherwise(part))


def with_next(docs: DataFrame, anchors: Callable[[Column], Column]) -> DataFrame:
    """``id, text, anchors, next_text, next_anchors`` of ``id``, ``text``: each row with the next by descending ``id``.

    After the last row comes the first. Rows without an id come last; rows of one id follow each other by checksum and
    text. Texts and their ``anchors`` are dealt once, by runs of ids; within a run the next row is known, and the first
    rows of the runs (a table of one row per run) supply what the last row of the run before needs.
    """
    marked = docs.select("id", "text", F.crc32("text").alias("mark"))
    placed = _in_runs(marked)
    # The greatest row of each run: first its id and mark, then the text.
    tops = placed.groupBy("run", "part").agg(F.max(F.struct("id", "mark")).alias("top"))
    tops = stage(tops.select("run", "part", "top.id", "top.mark"), "tops")
    heads = placed.select("id", "mark", "text").alias("d").join(
        tops.alias("t"), F.col("d.id").eqNullSafe(F.col("t.id")) & (F.col("d.mark") == F.col("t.mark")))
    heads = stage(heads.groupBy("t.run", "t.part").agg(F.max("d.text").alias("text")), "heads")
    falling = Window.orderBy(F.col("run").desc(), F.col("part").desc())
    steps = tops.select(
        "run", "part", F.lead(F.struct("run", "part")).over(falling).alias("below"),
        F.first(F.struct("run", "part")).over(falling).alias("top"))
    steps = steps.select("run", "part", F.coalesce("below", "top").alias("to"))
    entry = heads.select(
        F.struct("run", "part").alias("to"), F.struct("text", anchors(F.col("text")).alias("anchors")).alias("head"))
    below = stage(steps.join(entry, "to").select("run", "part", "head"), "below")
    order = [F.col("id").desc_nulls_last(), F.col("mark").desc(), F.col("text").desc()]
    # Rows are dealt before their anchors are made, so only texts move.
    told = placed.repartition("run", "part").withColumn("anchors", anchors(F.col("text")))
    falling = Window.partitionBy("run", "part").orderBy(*order)
    linked = told.withColumns({f"next_{c}": F.lead(c).over(falling) for c in ("text", "anchors")})
    linked = linked.join(below, ["run", "part"])
    return linked.select("id", "text", "anchors", *(
        F.coalesce(f"next_{c}", f"head.{c}").alias(f"next_{c}") for c in ("text", "anchors")))
