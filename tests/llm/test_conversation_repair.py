import functools
import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from larkspur.llm.conversation_repair import (
    BLANK, CUT_OFF, DUPLICATE, FINE, Matrix, best_audit, edited, repair_conversations, states_between)
from larkspur.llm.queries import op11_conversation_repair
from tests.llm.cases import LONG, tables

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GOAL = re.compile(r"(s?(ua)+)?\Z")
BEGINS = re.compile(r"s?(ua)*u?\Z")


def cheapest(initials, codes):
    """Cost and audit by trying all edits."""

    # Only how the roles so far end matters, so they are shortened to that.
    def step(roles, role):
        more = roles + role
        if not BEGINS.match(more):
            return None
        return {"s": "s"}.get(more, "u" if more.endswith("u") else "ua")

    @functools.cache
    def search(place, roles, inserts):
        out = [(0, "")] if place == len(initials) and GOAL.match(roles) else []
        if inserts < 3:
            for role in "ua":
                to = step(roles, role)
                if to is not None:
                    cost, audit = search(place, to, inserts + 1)
                    out.append((cost + 3, "I" + audit))
        if place < len(initials):
            code, extra = codes[place], 3 * (codes[place] == CUT_OFF)
            cost, audit = search(place + 1, roles, 0)
            out.append((cost + 4, "D" + audit))
            if code not in (BLANK, DUPLICATE):
                for role, price, label in ((initials[place], 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                    to = step(roles, role) if role in ("s", "u", "a") else None
                    if to is not None:
                        cost, audit = search(place + 1, to, 0)
                        out.append((cost + price + extra, label + audit))
        return min(out, default=(10**9, ""))

    return search(0, "", 0)


ROWS = st.lists(st.tuples(st.sampled_from("suuaax"), st.sampled_from((FINE, FINE, FINE, BLANK, DUPLICATE, CUT_OFF))), max_size=9)


@settings(max_examples=500, deadline=None)
@given(ROWS)
def test_least_of_the_cheapest(rows):
    initials, codes = [r[0] for r in rows], [r[1] for r in rows]
    assert best_audit(initials, codes) == cheapest(tuple(initials), tuple(codes))


@settings(max_examples=300, deadline=None)
@given(st.lists(ROWS, min_size=1, max_size=5))
def test_pieces_equal_the_whole(pieces):
    parts = [([r[0] for r in p], [r[1] for r in p]) for p in pieces]
    matrices = [Matrix.of(*p) for p in parts]
    whole = functools.reduce(Matrix.then, matrices)
    end = (0, 6, 3, 0)
    cost, _, last = min((whole.costs[0][t] + end[t], whole.ranks[0][t], t) for t in range(4))
    audit = "".join(best_audit(*p, *s)[1] for p, s in zip(parts, states_between(matrices, 0, last))) + "I" * (end[last] // 3)
    assert (cost, audit) == best_audit(sum((p[0] for p in parts), []), sum((p[1] for p in parts), []))


def test_audits_of_many_edits():
    rng = random.Random(1)
    initials = [rng.choice("suuaa") for _ in range(5000)]
    codes = [rng.choice((FINE, FINE, CUT_OFF, BLANK)) for _ in initials]
    cost, audit = best_audit(initials, codes)
    roles, _ = edited(audit, initials, [""] * 5000)
    assert GOAL.match("".join(r[0] for r in roles)) and sum(e != "I" for e in audit) == 5000
    price = {"D": 4, "I": 3, "K": 0, "R": 3}
    left = iter(codes)
    assert cost == sum(price[e] + (3 if e != "I" and next(left) == CUT_OFF and e != "D" else 0) for e in audit)


def expected(rows):
    """The query's row for each conversation, from all rows of the table."""
    conversations = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        damage = zlib.crc32(key.encode()) % 20
        own = conversations.setdefault(conv, [])
        if damage == 0:
            continue
        text = "" if damage == 1 else re.sub(r"[.!?]", "", text) if damage == 2 else text
        role = "user" if damage == 4 else role
        own += [(turn, role, text)] * (2 if damage == 3 else 1)
    out = {}
    for conv, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        codes, seen = [], set()
        for _, role, text in own:
            held = re.findall(r"[^\x20\x09-\x0D]", text)
            codes.append(BLANK if not held else DUPLICATE if (role, text) in seen else FINE if held[-1] in ".!?" else CUT_OFF)
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(tuple(initials), tuple(codes))
        at, state, left = 0, "", []
        for edit in audit:
            due = "assistant" if state[-1:] == "u" else "user"
            if edit == "I":
                left.append((due, ""))
            else:
                if edit != "D":
                    left.append((due if edit == "R" else own[at][1], own[at][2]))
                at += 1
            state = "".join(r[0][:1] for r in left)
        body = "\n".join(f"{r}:{t}" for r, t in left)
        out[conv] = (gaps, *(codes.count(c) for c in (BLANK, DUPLICATE, CUT_OFF)), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def made(n, seed):
    rng = random.Random(seed)
    words = ("Yes.", "no", "What now?", "", "  ", None, "Stop!", "so on ... \n", "é.")
    roles = ("system", "user", "assistant", "user", "assistant", "tool", None, "")
    return [(rng.choice((None, *range(1, n // 8 + 2))), rng.choice((None, *range(12))), rng.choice(roles), rng.choice(words))
            for _ in range(n)]


def test_query(spark, folder, data):
    rows = made(700, 3) + [(9000, 1, "user", LONG + "."), (9000, 2, "assistant", LONG)]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS `a.b`", "1 AS piece", "2 AS conv")
    found = op11_conversation_repair(spark, tables(spark, f"{folder}/t", conversations=turns)).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found} == expected(rows)
    assert len(found) == len({r[0] for r in rows})
    empty = tables(spark, f"{folder}/e", conversations=turns.limit(0))
    assert op11_conversation_repair(spark, empty).count() == 0
    given_rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op11_conversation_repair(spark, data).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found} == expected(given_rows)


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(6)
    texts = [rng.choice(("One.", "two", "Three!", "")) + f" {rng.randint(0, 200)}" + rng.choice((".", "")) for _ in range(3000)]
    rows = [(1 if k % 3 else 2 + k % 50, k, rng.choice(("system", "user", "assistant")), t) for k, t in enumerate(texts)]
    rows += [(77, 5, "user", "same.")] * 400
    turns = spark.createDataFrame(rows, SCHEMA).repartition(6)
    small = repair_conversations(turns, piece_rows=16)
    large = repair_conversations(turns.coalesce(1), piece_rows=1 << 20)
    by = lambda r: {x["conv"]: tuple(x) for x in r.conversations().collect()}
    found = by(small)
    assert found == by(large) and len(found) == 52
    assert small.pieces.where("conv = 1").count() > 100
    assert found[77][1:7] == (0, 0, 399, 0, 399, 399 * 4 + 3) and found[77][7] == "K" + "D" * 399 + "I"
    body = small.turns().where("conv = 1").orderBy("place").collect()
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in body).encode()).hexdigest() == found[1][8]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, None, "user", "x")]])
def test_small_tables(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA)
    found = repair_conversations(turns).conversations().collect()
    assert len(found) == len(rows)
