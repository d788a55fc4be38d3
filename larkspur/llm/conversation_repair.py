"""Cheapest repair of the structure of conversations, with the least audit among equally cheap ones.

A repaired conversation reads ``(system)? (user assistant)+`` by the initials of its roles, or is empty. Rows are kept,
given another role or deleted, and rows without text are inserted. An audit spells the edits by their initials: Delete,
Insert, Keep, Rerole.

A conversation is cut into *pieces* of bounded size along its sorted rows. What a piece can do is summed up by a matrix over
the four states before and after it: the least cost, and the rank of the least audit of that cost. Two matrices in a row
combine into one, so a conversation over many tasks is settled from the matrices of its pieces, first those of a task,
then those of all tasks, and only then is each piece edited between the states found for it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from larkspur.session import ship, stage

#: Rows and characters after which a piece is closed.
PIECE_ROWS, PIECE_CHARS = 2048, 1 << 20
#: What edits cost; a truncated row that stays costs TRUNCATED more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Verdicts on a row.
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
#: Adjacent initials that may follow each other.
LEGAL = frozenset(("su", "ua", "au"))

_VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
_WHITE = " \t\n\v\f\r"
_LABELS = " DIKR"  # in the order in which audits compare; 0 ends one
# States: nothing yet, after system, after user, after assistant. An inserted or reroled row takes the role that is due.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_DUE = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_KEPT = {"s": (_SYSTEM, -1, -1, -1), "u": (_USER, _USER, -1, _USER), "a": (-1, -1, _ASSISTANT, -1)}
_NOT_KEPT = (-1, -1, -1, -1)
_NEVER = 1 << 60
#: Costs at the end: nothing, an answer to insert, or a question and an answer.
_END = (0, 2 * INSERT, INSERT, 0)


def verdict(text: str) -> int:
    """Whether a text is blank or ends without a mark, whatever came before it."""
    if not _VISIBLE.search(text):
        return BLANK
    return FINE if text.rstrip(_WHITE)[-1] in ".!?" else CUT_OFF


def verdicts(roles: list[str], texts: list[str]) -> list[int]:
    """The first fault of each row of a whole conversation."""
    seen, out = set(), []
    for role, text in zip(roles, texts):
        found = verdict(text)
        if found != BLANK:
            if (role, text) in seen:
                found = DUPLICATE
            seen.add((role, text))
        out.append(found)
    return out


def costs(initials: list[str], codes: list[int], end: tuple) -> list[tuple]:
    """Least cost from each place and state to the end, whose costs are given."""
    out = [end]
    for initial, code in zip(reversed(initials), reversed(codes)):
        after = out[-1]
        base = [DELETE + c for c in after]
        if code not in (BLANK, DUPLICATE):
            stays = TRUNCATED if code == CUT_OFF else 0
            for state, kept in enumerate(_KEPT.get(initial, _NOT_KEPT)):
                base[state] = min(base[state], stays + REROLE + after[_DUE[state]])
                if kept >= 0:
                    base[state] = min(base[state], stays + after[kept])
        user, assistant = min(base[_USER], INSERT + base[_ASSISTANT]), min(base[_ASSISTANT], INSERT + base[_USER])
        out.append((min(base[_START], INSERT + user), min(base[_SYSTEM], INSERT + user), user, assistant))
    return out[::-1]


def optimal_arcs(initials: list[str], codes: list[int], cost: list[tuple], ends: frozenset) -> tuple[list[int], list[int]]:
    """Label and head of the arc that the least audit takes from each node, over arcs on some cheapest way.

    Node ``4 * place + state``; the last number is the end. Arcs out of a node have different labels. ``ends`` are the
    states in which the audit may stop; only where nothing (0) is stated there may it go on with inserted rows.
    """
    n = len(initials)
    last = 4 * (n + 1)
    labels, heads = [0] * (last + 1), [last] * (last + 1)
    for place in range(n):
        now, after, code = cost[place], cost[place + 1], codes[place]
        stays = TRUNCATED if code == CUT_OFF else 0
        must_go = code in (BLANK, DUPLICATE)
        kept = _KEPT.get(initials[place], _NOT_KEPT)
        for state in range(4):
            value, node, due = now[state], 4 * place + state, _DUE[state]
            if value >= _NEVER:
                continue
            if value == DELETE + after[state]:
                labels[node], heads[node] = 1, node + 4
            elif value == INSERT + now[due]:
                labels[node], heads[node] = 2, 4 * place + due
            elif not must_go and kept[state] >= 0 and value == stays + after[kept[state]]:
                labels[node], heads[node] = 3, 4 * place + 4 + kept[state]
            else:
                labels[node], heads[node] = 4, 4 * place + 4 + due
    for state in range(4):
        if state not in ends and cost[n][state] < _NEVER:
            labels[4 * n + state], heads[4 * n + state] = 2, 4 * n + _DUE[state]
    return labels, heads


def ranked_paths(labels: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of the audits from each node, and pointers over 1, 2, 4, ... edits.

    Ranks by the first edit and pointers over one are given. In each round the audits of twice the length are ranked by
    the rank of their first half and, at the pointer, that of their second; an audit that ends is the lesser one.
    """
    ranks, jumps, end = np.asarray(labels), [np.asarray(heads)], len(labels) - 1
    while not (jumps[-1] == end).all():
        at = jumps[-1]
        _, ranks = np.unique(ranks * (int(ranks.max()) + 1) + ranks[at], return_inverse=True)
        jumps.append(at[at])
    return ranks, jumps


def audit_from(node: int, labels: np.ndarray, jumps: list[np.ndarray]) -> str:
    """The audit from a node: the nodes on its way are read off the doubled pointers."""
    nodes = np.array([node])
    for jump in reversed(jumps):
        nodes = np.stack([nodes, jump[nodes]], axis=1).ravel()
    return "".join(map(_LABELS.__getitem__, labels[nodes].tolist())).rstrip()


def best_audit(initials: list[str], codes: list[int], first: int = _START, last: int | None = None) -> tuple[int, str]:
    """Cost and least audit of rows between two states, or from the first to an allowed end."""
    if last is None:
        end, ends = _END, frozenset((_START, _ASSISTANT))
    else:
        end, ends = tuple(0 if s == last else _NEVER for s in range(4)), frozenset(range(4))
    cost = costs(initials, codes, end)
    labels, heads = (np.array(x) for x in optimal_arcs(initials, codes, cost, ends))
    _, jumps = ranked_paths(labels, heads)
    return cost[0][first], audit_from(first, labels, jumps)


@dataclass(frozen=True)
class Matrix:
    """Costs from each state to each, and how the least audits to different states compare.

    Audits of one piece all use up its rows and end with the last, so none begins another one, and two that lead to
    different states differ: their ranks decide, whatever comes after.
    """

    costs: list[list[int]]
    ranks: list[list[int]]

    @classmethod
    def of(cls, initials: list[str], codes: list[int]) -> Matrix:
        size, labels, heads, reach = 4 * (len(initials) + 1), [], [], []
        for last in range(4):
            cost = costs(initials, codes, tuple(0 if s == last else _NEVER for s in range(4)))
            own, to = optimal_arcs(initials, codes, cost, frozenset(range(4)))
            labels += own[:-1]
            heads += [4 * size if h == size else last * size + h for h in to[:-1]]
            reach.append(cost[0])
        ranks, _ = ranked_paths(np.array([*labels, 0]), np.array([*heads, 4 * size]))
        return cls([[min(reach[t][s], _NEVER) for t in range(4)] for s in range(4)],
                   [[int(ranks[t * size + s]) for t in range(4)] for s in range(4)])

    def then(self, other: Matrix) -> Matrix:
        all_costs, all_ranks = [], []
        for own, order in zip(self.costs, self.ranks):
            made = []
            for t in range(4):
                cost, rank, middle = min((own[u] + other.costs[u][t], order[u], u) for u in range(4))
                made.append((min(cost, _NEVER), (rank, other.ranks[middle][t])))
            places = {key: k for k, key in enumerate(sorted({key for _, key in made}))}
            all_costs.append([cost for cost, _ in made])
            all_ranks.append([places[key] for _, key in made])
        return Matrix(all_costs, all_ranks)


def states_between(matrices: list[Matrix], first: int, last: int) -> list[tuple[int, int]]:
    """The states before and after each piece on the least of the cheapest ways from ``first`` to ``last``."""
    after = [[0 if s == last else _NEVER for s in range(4)]]
    for m in reversed(matrices):
        after.append([min(m.costs[s][t] + after[-1][t] for t in range(4)) for s in range(4)])
    after.reverse()
    out, state = [], first
    for k, m in enumerate(matrices):
        _, _, to = min((m.costs[state][t] + after[k + 1][t], m.ranks[state][t], t) for t in range(4))
        out.append((state, to))
        state = to
    return out


@dataclass(frozen=True)
class Facts:
    """What is counted over the rows of a piece, in order."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None

    @classmethod
    def of(cls, initials: list[str], codes: list[int], turns: list[int | None]) -> Facts:
        known = [t for t in turns if t is not None]
        return cls(
            codes.count(BLANK), codes.count(DUPLICATE), codes.count(CUT_OFF),
            sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), len(set(known)),
            known[0] if known else None, known[-1] if known else None, *((initials[0], initials[-1]) if initials else (None, None)))

    def then(self, other: Facts) -> Facts:
        met = self.last is not None and other.first is not None and self.last + other.first not in LEGAL
        shared = self.high is not None and self.high == other.low
        return Facts(
            self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
            self.illegal + other.illegal + met, self.turns + other.turns - shared,
            other.low if self.low is None else self.low, self.high if other.high is None else other.high,
            other.first if self.first is None else self.first, self.last if other.last is None else other.last)

    def row(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def _summary(matrix: Matrix, facts: Facts) -> str:
    return json.dumps([matrix.costs, matrix.ranks, list(facts.__dict__.values())])


def _read_summary(text: str) -> tuple[Matrix, Facts]:
    costs_, ranks, facts = json.loads(text)
    return Matrix(costs_, ranks), Facts(*facts)


def _combined(summaries: Iterable[str]) -> tuple[Matrix, Facts]:
    parts = map(_read_summary, summaries)
    matrix, facts = next(parts)
    for m, f in parts:
        matrix, facts = matrix.then(m), facts.then(f)
    return matrix, facts


def edited(audit: str, roles: list[str], texts: list[str], state: int = _START) -> tuple[list[str], list[str]]:
    """Roles and texts that an audit leaves, from the state before it."""
    rows, out_roles, out_texts = iter(zip(roles, texts)), [], []
    for edit in audit:
        due = _DUE[state]
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = _KEPT[role[:1]][state]
        else:
            role, state = _ROLE[due], due
        out_roles.append(role)
        out_texts.append(text)
    return out_roles, out_texts


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PIECE = ("piece bigint, part bigint, whole boolean, audit string, roles array<string>, texts array<string>, "
          "initials array<string>, codes array<int>, turns array<bigint>, marks array<binary>, "
          + ", ".join(f"{c} bigint" for c in _COUNTS))


def _arrow(conv: pa.DataType) -> pa.Schema:
    strings = pa.list_(pa.string())
    return pa.schema([
        ("conv", conv), ("piece", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("audit", pa.string()),
        ("roles", strings), ("texts", strings), ("initials", strings), ("codes", pa.list_(pa.int32())),
        ("turns", pa.list_(pa.int64())), ("marks", pa.list_(pa.binary())), *((c, pa.int64()) for c in _COUNTS)])


def _mark(role: str, text: str) -> bytes:
    """Tells rows of different role or text apart."""
    found = hashlib.blake2b(f"{len(role)}:{role}".encode("utf-8", "replace"), digest_size=16)
    found.update(text.encode("utf-8", "replace"))
    return found.digest()


def _cut(batches: Iterable[pa.RecordBatch], piece_rows: int, piece_chars: int) -> Iterator[dict]:
    """Sorted rows as whole conversations, which are settled here, or as pieces of those that may go on elsewhere."""
    part = TaskContext.get().partitionId()
    held: list[tuple] = []
    conv, begin, chars, alone, at, nothing = None, 0, 0, False, 0, True

    def close(ended: bool) -> dict:
        turns, roles, texts = ([r[k] for r in held if r[0]] for k in (1, 2, 3))
        initials = [r[:1] for r in roles]
        made = {"conv": conv, "piece": part << 33 | begin, "part": part, "whole": alone and ended}
        if made["whole"]:
            codes = verdicts(roles, texts)
            cost, audit = best_audit(initials, codes)
            out_roles, out_texts = edited(audit, roles, texts)
            counts = [*Facts.of(initials, codes, turns).row(), cost]
            return made | {"audit": audit, "roles": out_roles, "texts": out_texts} | dict(zip(_COUNTS, counts))
        codes = [verdict(t) for t in texts]
        marks = [None if c == BLANK else _mark(r, t) for c, r, t in zip(codes, roles, texts)]
        return made | {"roles": roles, "texts": texts, "initials": initials, "codes": codes, "turns": turns, "marks": marks}

    for batch in batches:
        for key, turn, role, text, present in zip(*(c.to_pylist() for c in batch.columns)):
            if nothing:
                conv, nothing = key, False
            elif key != conv:
                yield close(True)
                held, chars, conv, begin, alone = [], 0, key, at, True
            elif len(held) >= piece_rows or chars >= piece_chars:
                yield close(False)
                held, chars, begin, alone = [], 0, at, False
            held.append((present, turn, role, text))
            chars += len(text or "")
            at += 1
    if not nothing:
        alone = False
        yield close(False)


def _batched(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(map(len, row.get("texts") or ()))
        if size >= 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


@dataclass(frozen=True)
class Repaired:
    """``pieces``: ``conv, piece, whole, audit, roles, texts``, the repaired rows of a conversation in order of ``piece``.
    ``reports``: one row for each conversation that is not ``whole``, ``conv`` and the counts; whole ones carry theirs.
    """

    pieces: DataFrame
    reports: DataFrame

    def turns(self) -> DataFrame:
        """``conv, place, role, text``: the repaired rows; places grow along a conversation."""
        rows = self.pieces.select("conv", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
        return rows.select("conv", F.struct("piece", "at").alias("place"), F.col("row.roles").alias("role"),
                           F.col("row.texts").alias("text"))

    def conversations(self) -> DataFrame:
        """``conv``, the counts, ``audit`` and ``sha256`` of the repaired ``role:text``, joined by line breaks.

        A whole conversation is hashed where it lies. The pieces of others are streamed in order by one task for each
        conversation, as such a hash asks for, which holds one batch of pieces and the audit.
        """
        line = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
        bodies = self.pieces.withColumn("body", F.concat_ws("\n", line))
        whole = bodies.where("whole").select("conv", *_COUNTS, "audit", F.sha2("body", 256).alias("sha256"))
        parted = bodies.where("NOT whole").select("conv", "piece", "audit", "body")
        parted = parted.repartition("conv").sortWithinPartitions("conv", "piece")

        def hashed(batches):
            conv, audits, digest, empty, nothing = None, [], hashlib.sha256(), True, True
            keys, out = [], []
            for batch in batches:
                for key, _, audit, body in zip(*(c.to_pylist() for c in batch.columns)):
                    if not nothing and key != conv:
                        keys.append(conv)
                        out.append(("".join(audits), digest.hexdigest()))
                        audits, digest, empty = [], hashlib.sha256(), True
                    conv, nothing = key, False
                    audits.append(audit)
                    if body:
                        digest.update(("" if empty else "\n").encode() + body.encode())
                        empty = False
                kind = batch.schema.field(0).type
            if not nothing:
                keys.append(conv)
                out.append(("".join(audits), digest.hexdigest()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, kind), pa.array([a for a, _ in out], pa.string()), pa.array([s for _, s in out], pa.string())],
                    ["conv", "audit", "sha256"])

        kind = parted.schema["conv"].dataType.simpleString()
        streamed = parted.mapInArrow(hashed, f"conv {kind}, audit string, sha256 string")
        joined = self.reports.alias("r").join(streamed.alias("h"), F.col("r.conv").eqNullSafe(F.col("h.conv")))
        return whole.unionByName(joined.select("r.conv", *_COUNTS, "audit", "sha256"))


def repair_conversations(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
                         text_column: str = "text", present_column: str | None = None, piece_rows: int = PIECE_ROWS,
                         piece_chars: int = PIECE_CHARS) -> Repaired:
    """The cheapest repair of every conversation, see the module's docstring.

    Rows are ordered by turn, nulls first; those of one turn by role, then the first 64 characters of the text, then their
    place in the table. A null role or text counts as empty. Rows in which ``present_column`` is false only name their
    conversation; one without other rows has counts of 0, an empty audit and no rows. A null conversation is one
    conversation. A row's first fault counts: blank, a repetition of an earlier role and text, no mark at its end; the
    first two are deleted. Other columns are not read.

    Rows are dealt once, by ranges of conversation, turn and the rest of the order, so a conversation that holds many
    rows is spread over tasks. Conversations that lie inside a task and a piece are settled there, the others from the
    summaries of their pieces; at most one task's pieces, then one row for each task, are gathered for a conversation.
    """
    spark = turns.sparkSession
    ship(spark)
    present = F.lit(True) if present_column is None else F.col(f"`{present_column}`")
    rows = turns.select(
        F.col(f"`{conv_column}`").alias("conv"), F.when(present, F.col(f"`{turn_column}`").cast("bigint")).alias("turn"),
        F.when(present, F.coalesce(F.col(f"`{role_column}`").cast("string"), F.lit(""))).alias("role"),
        F.when(present, F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))).alias("text"),
        F.coalesce(present, F.lit(False)).alias("present"), F.monotonically_increasing_id().alias("at"))
    order = ("conv", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64)), "at")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "present")

    def cut(batches):
        first = next(batches, None)
        if first is None:
            return
        schema = _arrow(first.schema.field(0).type)
        yield from _batched(_cut(_with(first, batches), piece_rows, piece_chars), schema)

    kind = rows.schema["conv"].dataType.simpleString()
    pieces = stage(dealt.mapInArrow(cut, f"conv {kind}, {_PIECE}"), "pieces")
    whole, parted = pieces.where("whole"), pieces.where("NOT whole")

    # The first row of each role and text among all pieces of a conversation.
    marked = parted.select("conv", "piece", F.posexplode("marks").alias("at", "mark")).where("mark IS NOT NULL")
    firsts = marked.groupBy("conv", "mark").agg(F.min(F.struct("piece", "at")).alias("f"))
    firsts = firsts.groupBy(F.col("f.piece").alias("piece")).agg(F.collect_list("f.at").alias("firsts"))
    narrow = parted.select("conv", "piece", "part", "initials", "codes", "turns").join(firsts, "piece", "left")

    def judge(batches):
        for batch in batches:
            _, _, _, initials, codes, known, own = (c.to_pylist() for c in batch.columns)
            judged, summaries = [], []
            for letters, found, when, kept in zip(initials, codes, known, own):
                kept = set(kept or ())
                found = [c if c == BLANK or k in kept else DUPLICATE for k, c in enumerate(found)]
                judged.append(found)
                summaries.append(_summary(Matrix.of(letters, found), Facts.of(letters, found, when)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(judged, pa.list_(pa.int32())), pa.array(summaries, pa.string())],
                ["conv", "piece", "part", "codes", "summary"])

    judged = stage(narrow.select("conv", "piece", "part", "initials", "codes", "turns", "firsts").mapInArrow(
        judge, f"conv {kind}, piece bigint, part bigint, codes array<int>, summary string"), "judged")

    @F.udf("string")
    def combine(summaries):
        return _summary(*_combined(summaries))

    by_part = judged.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("piece", "summary"))).alias("items"))
    by_part = stage(by_part.select("conv", "part", F.col("items.piece").alias("pieces"), F.col("items.summary").alias("summaries"))
                    .withColumn("summary", combine("summaries")), "parts")

    @F.udf("facts array<bigint>, chosen array<struct<before: int, after: int>>, tail int")
    def settle(summaries):
        matrix, facts = _combined(summaries)
        cost, _, last = min((matrix.costs[_START][t] + _END[t], matrix.ranks[_START][t], t) for t in range(4))
        between = states_between([_read_summary(s)[0] for s in summaries], _START, last)
        return [*facts.row(), cost], between, _END[last] // INSERT

    settled = by_part.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "pieces", "summary"))).alias("items"))
    settled = stage(settled.select("conv", F.transform("items", lambda i: i["pieces"][0]).alias("heads"),
                                   settle("items.summary").alias("s")).select("conv", "heads", "s.*"), "settled")
    reports = settled.select("conv", *(F.col("facts")[k].alias(c) for k, c in enumerate(_COUNTS)))
    at_part = settled.select(F.posexplode(F.arrays_zip("heads", "chosen")).alias("k", "z"), F.size("heads").alias("n"), "tail")
    at_part = at_part.select(F.col("z.heads").alias("head"), F.col("z.chosen.before").alias("before"), F.col("z.chosen.after").alias("after"),
                             F.when(F.col("k") == F.col("n") - 1, F.col("tail")).otherwise(0).alias("tail"))

    @F.udf("array<struct<before: int, after: int>>")
    def walk(summaries, before, after):
        return states_between([_read_summary(s)[0] for s in summaries], before, after)

    at_piece = by_part.withColumn("head", F.col("pieces")[0]).join(at_part, "head").select(
        "pieces", "tail", walk("summaries", "before", "after").alias("chosen"))
    at_piece = at_piece.select(F.posexplode(F.arrays_zip("pieces", "chosen")).alias("k", "z"), F.size("pieces").alias("n"), "tail")
    at_piece = at_piece.select(F.col("z.pieces").alias("piece"), F.col("z.chosen.before").alias("before"), F.col("z.chosen.after").alias("after"),
                               F.when(F.col("k") == F.col("n") - 1, F.col("tail")).otherwise(0).alias("tail"))

    def edit(batches):
        for batch in batches:
            keys, numbers, roles, texts, initials, codes, before, after, tails = (c.to_pylist() for c in batch.columns)
            audits, out = [], []
            for r, t, letters, found, s, e, tail in zip(roles, texts, initials, codes, before, after, tails):
                audit = best_audit(letters, found, s, e)[1] + "I" * tail
                audits.append(audit)
                out.append(edited(audit, r, t, s))
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(audits, pa.string()), pa.array([o[0] for o in out], strings),
                 pa.array([o[1] for o in out], strings)], ["conv", "piece", "audit", "roles", "texts"])

    chosen = judged.select("piece", "codes").join(at_piece, "piece")
    done = parted.select("conv", "piece", "roles", "texts", "initials").join(chosen, "piece").select(
        "conv", "piece", "roles", "texts", "initials", "codes", "before", "after", "tail").mapInArrow(
        edit, f"conv {kind}, piece bigint, audit string, roles array<string>, texts array<string>")
    empty = [F.lit(None).cast("bigint").alias(c) for c in _COUNTS]
    both = whole.select("conv", "piece", "whole", "audit", "roles", "texts", *_COUNTS).unionByName(
        done.select("conv", "piece", F.lit(False).alias("whole"), "audit", "roles", "texts", *empty))
    return Repaired(both, reports)


def _with(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest
