"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.chunk_encoder import chunk_encoder
from larkspur.llm.inputs import numbered
from larkspur.session import ship, stage


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: full ones, after a first that takes the remainder."""
    first = length % capacity or min(length, capacity)
    starts = [0, *range(first, length, capacity)]
    return [(s, first if i == 0 else capacity) for i, s in enumerate(starts)]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_column: str = "doc_id",
                 text_column: str = "text", content: str = "ids") -> DataFrame:
    """``id, piece, start, length`` and the piece's ids, or their ``crc32``, of every document.

    A document is its ids and ``end_id``; a null text counts as empty. ``content`` is ``ids`` (little-endian 32-bit
    numbers) or ``crc32`` (of those bytes), which spares storing the ids where only their digest is wanted.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    end = int(end_id).to_bytes(4, "little")
    as_ids = content == "ids"

    def run(batches):
        encoder = chunk_encoder(tokenizer_path)
        for batch in batches:
            take, out = [], [[], [], [], []]
            for row, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    body = ids[4 * start:4 * (start + length)]
                    take.append(row)
                    for column, value in zip(out, (piece, start, length, body if as_ids else zlib.crc32(body))):
                        column.append(value)
            last = pa.array(out[3], pa.binary() if as_ids else pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(out[0], pa.int32()),
                 pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), last],
                ["id", "piece", "start", "length", content])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, piece int, start bigint, length bigint, {content} {'binary' if as_ids else 'bigint'}")


def best_fit(counts: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Sequences that hold the same lengths are kept as one group with a count. Lengths are placed from the largest; each
    goes to the groups with the least room that is enough, and opens new sequences when none is left. Returns
    ``(length, first_rank, end_rank, first_sequence, each, offset)``: the items of ``length`` with these ranks go to
    consecutive sequences, ``each`` to one, from ``offset`` on. The work and the result depend on the number of
    different lengths, not on the number of items.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room: [(first sequence, sequences)]
    order: list[int] = []
    sequences, plan = 0, []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                bisect.insort(order, room)
            rooms.setdefault(room, []).append((first, n))

    for length, count in sorted(counts, reverse=True):
        rank = 0
        while rank < count:
            left = count - rank
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = room // length
            full, rest = min(n, left // each), 0
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - room))
                rank += full * each
                put(room - each * length, first, full)
            if full < n and rank < count:
                rest = count - rank
                plan.append((length, rank, count, first + full, rest, capacity - room))
                rank = count
                put(room - rest * length, first + full, 1)
                full += 1
            put(room, first + full, n - full)
    return plan


def best_fit_packing(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: where each piece of 1 to ``capacity`` tokens is put.

    Lengths are counted (at most ``capacity`` rows come to the driver), packed as counts, and each piece takes the slot
    planned for its rank among the pieces of its length. The plan's size is bounded by ``capacity`` and it is
    broadcast. Columns of the result's names are replaced; an empty table gives an empty result.
    """
    ranked = stage(numbered(pieces, "length", "_rank"), "ranked")
    counts = ranked.groupBy(F.when(F.col("length").between(1, capacity), F.col("length")).alias("length")).count().collect()
    if any(r["length"] is None for r in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = best_fit([(r["length"], r["count"]) for r in counts], capacity)
    slots = pieces.sparkSession.createDataFrame(
        plan, "_length bigint, _low bigint, _high bigint, _first bigint, _each bigint, _offset bigint")
    joined = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_length"))
                         & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    step = F.col("_rank") - F.col("_low")
    return joined.select(
        *(c for c in pieces.columns if c not in ("sequence_id", "offset")),
        (F.col("_first") + F.expr("(_rank - _low) div _each")).alias("sequence_id"),
        (F.col("_offset") + F.pmod(step, F.col("_each")) * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids``: the packed sequences of pieces with ``ids``; one holds at most the capacity."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.expr("X''"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
