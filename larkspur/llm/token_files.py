"""Token ids in files of directly addressable codes: any token is read without decoding the ones around it.

A file holds consecutive documents. All numbers are little-endian; sections begin at the byte offsets that the header names.

========== ==========================================================================================================
header     magic, then 64-bit numbers: documents, ids, levels, offsets of ``starts`` and ``labels``; then for each of
           four levels its codes and the offsets of its codes, bitmap and directory
starts     documents + 1 numbers of 64 bits: ids before each document, and of all
labels     for each document the bytes of its id as text in 32 bits (all ones: null); then these bytes
codes      one byte a code: level 0 has the low byte of every id, level 1 the next byte of those that have more, ...
bitmap     one bit a code, set where the id goes on in the next level; none for the last level
directory  64-bit counts of set bits before every 512th bit
========== ==========================================================================================================

The code of an id in the next level is found by counting the set bits before it: one entry of the directory and at most
eight words of the bitmap. Codes of neighbouring ids are neighbours on every level.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from larkspur.llm.inputs import spread_files
from larkspur.llm.warc import open_folder
from larkspur.llm.word_encoder import word_encoder
from larkspur.session import scratch_path, ship, stage

#: Ids after which a file is closed; a document is never divided.
FILE_IDS = 16_000_000
#: Ids read together where whole files are read.
READ_IDS = 1_000_000
_MAGIC = b"DACIDS01"
_LEVELS = 4
_HEADER = struct.Struct(f"<8s5Q{4 * _LEVELS}Q")
_NULL = 0xFFFFFFFF


def code_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes, bitmap words and directory of each level of 32-bit ids."""
    out, rest = [], ids
    while True:
        codes, more = (rest & 255).astype(np.uint8), rest > 255
        if not more.any():
            return [*out, (codes, np.zeros(0, "<u8"), np.zeros(0, "<u8"))]
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(bits) // 64) * 8, "<u8")
        words.view(np.uint8)[:len(bits)] = bits
        ones = np.bitwise_count(words).reshape(-1, 8).sum(axis=1, dtype=np.uint64)
        out.append((codes, words, np.concatenate(([0], np.cumsum(ones))).astype("<u8")))
        rest = rest[more] >> 8


def file_sections(labels: list[str | None], lengths: list[int], ids: np.ndarray) -> Iterator[bytes]:
    """The bytes of a file, in order."""
    names = [None if x is None else x.encode() for x in labels]
    starts = np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes()
    sizes = np.array([_NULL if x is None else len(x) for x in names], "<u4").tobytes()
    sections = [starts, sizes + b"".join(x for x in names if x is not None)]
    levels = code_levels(ids)
    for codes, words, directory in levels:
        sections += [codes.tobytes(), words.tobytes(), directory.tobytes()]
    offsets, at = [], _HEADER.size
    for section in sections:
        offsets.append(at)
        at += -(-len(section) // 8) * 8
    numbers = [len(labels), len(ids), len(levels), offsets[0], offsets[1]]
    for k in range(_LEVELS):
        numbers += [len(levels[k][0]), *offsets[2 + 3 * k:5 + 3 * k]] if k < len(levels) else [0, 0, 0, 0]
    yield _HEADER.pack(_MAGIC, *numbers)
    for section in sections:
        yield section
        yield bytes(-len(section) % 8)


class TokenFile:
    """Random access to an open file; only the bytes that an answer needs are read."""

    def __init__(self, source):
        self.source = source
        magic, self.documents, self.ids, self.n_levels, self._starts, self._labels, *levels = _HEADER.unpack(
            self._bytes(0, _HEADER.size))
        if magic != _MAGIC:
            raise ValueError("not a file of token ids")
        self.levels = [levels[4 * k:4 * k + 4] for k in range(self.n_levels)]

    def _bytes(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        found = self.source.read(n)
        if len(found) != n:
            raise ValueError("the file is cut off")
        return found

    def _array(self, kind: str, offset: int, n: int) -> np.ndarray:
        return np.frombuffer(self._bytes(offset, n * np.dtype(kind).itemsize), kind)

    def starts(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """Ids before documents ``low`` to ``high``, and before the one after them."""
        high = self.documents if high is None else high
        return self._array("<u8", self._starts + 8 * low, high - low + 1).astype(np.int64)

    def labels(self) -> list[str | None]:
        """The ids of the documents as texts."""
        sizes = self._array("<u4", self._labels, self.documents).astype(np.int64)
        held = np.where(sizes == _NULL, 0, sizes)
        ends = np.cumsum(held)
        text = self._bytes(self._labels + 4 * self.documents, int(ends[-1]) if len(ends) else 0)
        return [None if s == _NULL else text[e - s:e].decode() for s, e in zip(sizes.tolist(), ends.tolist())]

    def _rank(self, level: int, at: int) -> int:
        """Set bits of a level's bitmap before bit ``at``."""
        _, _, bitmap, directory = self.levels[level]
        block, inside = divmod(at, 512)
        ones = int(self._array("<u8", directory + 8 * block, 1)[0])
        if inside:
            words = self._array("<u8", bitmap + 64 * block, -(-inside // 64)).copy()
            if inside % 64:
                words[-1] &= np.uint64((1 << inside % 64) - 1)
            ones += int(np.bitwise_count(words).sum())
        return ones

    def token(self, at: int) -> int:
        """The id at a place: one code, one bit and one count on each of its levels."""
        if not 0 <= at < self.ids:
            raise IndexError(at)
        value = 0
        for level in range(self.n_levels):
            _, codes, bitmap, _ = self.levels[level]
            value |= self._bytes(codes + at, 1)[0] << 8 * level
            if level + 1 == self.n_levels or not self._bytes(bitmap + at // 8, 1)[0] >> at % 8 & 1:
                break
            at = self._rank(level, at)
        return value

    def tokens(self, low: int, high: int) -> np.ndarray:
        """The ids from ``low`` up to ``high``: one range of codes on each level."""
        if not 0 <= low <= high <= self.ids:
            raise IndexError((low, high))
        out, places = np.zeros(high - low, "<u4"), None
        for level in range(self.n_levels):
            _, codes, bitmap, _ = self.levels[level]
            found = self._array("u1", codes + low, high - low).astype("<u4") << np.uint32(8 * level)
            if places is None:
                out |= found
            else:
                out[places] |= found
            if low == high or level + 1 == self.n_levels:
                break
            first = low // 8
            bits = np.unpackbits(self._array("u1", bitmap + first, -(-high // 8) - first), bitorder="little")
            goes_on = np.flatnonzero(bits[low - 8 * first:high - 8 * first])
            places = goes_on if places is None else places[goes_on]
            low = self._rank(level, low)
            high = low + len(goes_on)
        return out


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None,
                      id_column: str = "doc_id", text_column: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all documents, in ascending order of their id, to files in ``folder``.

    A document is its ids and ``end_id``; a null text counts as empty. Null ids come first; rows of one id follow each
    other in the order of the table. Returns the staged ``path``, ``start`` (ids in the files before), ``ids``,
    ``documents``, ``bytes`` of each file; no rows for an empty table. Texts are dealt once by ranges of ids and row
    numbers, so an id that holds many rows is divided, and each task encodes and writes its range. A task names its
    files anew each time it runs and reports them at its end, so what a lost executor wrote is never read. ``folder``
    must be one that pyarrow's file systems reach from every executor; by default it is a new one in the shared folder
    of the session. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = (folder or scratch_path(spark, "tokens")).rstrip("/")
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("at"))
    dealt = rows.repartitionByRange("id", "at").sortWithinPartitions("id", "at")
    ordered = dealt.select(F.col("id").cast("string").alias("id"), "text")
    end = int(end_id).to_bytes(4, "little")

    def write(batches):
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        encoder, done = word_encoder(tokenizer_path), []
        labels, lengths, parts, held = [], [], [], 0

        def close():
            nonlocal held
            name, size = f"{uuid.uuid4().hex}.ids", 0
            ids = np.frombuffer(b"".join(parts), "<u4")
            parts.clear()
            with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                for section in file_sections(labels, lengths, ids):
                    out.write(section)
                    size += len(section)
            done.append((f"{folder}/{name}", TaskContext.get().partitionId(), len(done), held, len(labels), size))
            labels.clear()
            lengths.clear()
            held = 0

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                if held and held + len(ids) // 4 > file_ids:
                    close()
                labels.append(key)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
        if labels:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[k] for d in done], pa.string() if k == 0 else pa.int64()) for k in range(6)],
            ["path", "part", "file", "ids", "documents", "bytes"])

    files = stage(ordered.mapInArrow(
        write, "path string, part bigint, file bigint, ids bigint, documents bigint, bytes bigint"), "files")
    # One row for each task, then one for each of its files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("own", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(parts, "part")
    return stage(placed.select("path", (F.col("begin") + F.col("own")).alias("start"), "ids", "documents", "bytes"), "placed")


def _reading(path: str) -> TokenFile:
    system, name = open_folder(path)
    return TokenFile(system.open_input_file(name))


def read_documents(files: DataFrame, id_type: str = "bigint", content: str = "ids") -> DataFrame:
    """``id, start, n_tokens`` and the ``ids``, or their ``crc32``, of every document in ``files``.

    ``ids`` are little-endian 32-bit numbers. ``start`` counts the ids of all documents before. A task reads its files
    by runs of documents, ``READ_IDS`` ids or one document at a time.
    """
    ship(files.sparkSession)
    as_ids = content == "ids"

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _reading(path)
                starts, labels, low = found.starts(), found.labels(), 0
                while low < found.documents:
                    high = max(low + 1, int(np.searchsorted(starts, starts[low] + READ_IDS, "right")) - 1)
                    body = memoryview(found.tokens(int(starts[low]), int(starts[high]))).cast("B")
                    at = ((starts[low:high + 1] - starts[low]) * 4).tolist()
                    own = [body[a:b] for a, b in zip(at, at[1:])]
                    last = pa.array([bytes(x) for x in own], pa.binary()) if as_ids else pa.array(map(zlib.crc32, own), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(labels[low:high], pa.string()), pa.array(starts[low:high] + start),
                         pa.array(np.diff(starts[low:high + 1])), last], ["id", "start", "n_tokens", content])
                    low = high

    read = spread_files(files.select("path", "start", "bytes")).mapInArrow(
        run, f"id string, start bigint, n_tokens bigint, {content} {'binary' if as_ids else 'bigint'}")
    return read.withColumn("id", F.col("id").cast(id_type))


def tokens_at(files: DataFrame, places: DataFrame, place_column: str = "place") -> DataFrame:
    """``place, token``: the ids at places counted over all files, each read alone; one row for each row of ``places``.

    The token is null for a place outside the files and for a null. Places meet the files of their stretch of
    ``FILE_IDS`` ids, which are few.
    """
    ship(files.sparkSession)
    spans = files.where("ids > 0").selectExpr(
        "path", "start", "ids", f"explode(sequence(start div {FILE_IDS}, (start + ids - 1) div {FILE_IDS})) AS stretch")
    wanted = places.select(F.col(f"`{place_column}`").cast("bigint").alias("place"))
    wanted = wanted.withColumn("stretch", F.expr(f"CAST(floor(place / {FILE_IDS}D) AS BIGINT)"))
    met = wanted.alias("w").join(spans.alias("s"), (F.col("w.stretch") == F.col("s.stretch"))
                                 & (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("ids")), "left")
    ordered = met.select("place", "path", (F.col("place") - F.col("start")).alias("at")).sortWithinPartitions("path", "at")

    def run(batches):
        path, found = None, None
        for batch in batches:
            tokens = []
            for name, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if name is not None and name != path:
                    path, found = name, _reading(name)
                tokens.append(None if name is None else found.token(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64())], ["place", "token"])

    return ordered.mapInArrow(run, "place bigint, token bigint")
