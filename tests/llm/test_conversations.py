"""Conversation repair against plain versions: an exhaustive search on short conversations, and a search over strings on all."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from qforge.llm import conversations as C

ROWS = "conv_id long, turn long, role string, text string, digest string, conv string, code int"
WS = " \t\n\x0b\x0c\r"


def damage(rows):
    """(conv_id, turn, role, text) rows after damage, and all ids."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out, {r[0] for r in rows}


def order(row):
    _, turn, role, text = row
    return turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        said = text.strip(WS)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def least(rows, found):
    """(cost, audit, repaired) by the smallest pair of cost and audit from each row and state on."""

    @functools.cache
    def best(i, last, inserts):
        """last: initial of what stands last, or nothing."""
        must = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if inserts < 3:
            c, a, r = best(i, must, inserts + 1)
            ways.append((c + 3, "I" + a, ({"u": "user", "a": "assistant"}[must] + ":", *r)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, r = best(i + 1, last, 0)
            ways.append((c + 4, "D" + a, r))
            if found[i] not in ("blank", "duplicate"):
                more = 3 * (found[i] == "truncated")
                c, a, r = best(i + 1, must, 0)
                ways.append((c + 3 + more, "R" + a, ({"u": "user", "a": "assistant"}[must] + f":{text}", *r)))
                if role[:1] == must or (role[:1] == "s" and last == ""):
                    c, a, r = best(i + 1, role[:1], 0)
                    ways.append((c + more, "K" + a, (f"{role}:{text}", *r)))
        return min(ways, default=(float("inf"), "", ()))

    return best(0, "", 0)


def exhaustive(rows, found):
    """All edits of a short conversation, with up to two rows put in at each place; roles must match the pattern."""
    one = [["D", *(("K", "Ru", "Ra") if f not in ("blank", "duplicate") else ())] for f in found]
    gaps = [(), ("Iu",), ("Ia",), ("Iu", "Ia"), ("Ia", "Iu")]
    best = None
    for edits in itertools.product(*one):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            seq = [*ins[0], *(x for e, more in zip(edits, ins[1:], strict=True) for x in (e, *more))]
            i, roles, cost = 0, "", 0
            for e in seq:
                if e[0] == "I":
                    roles, cost = roles + e[1], cost + 3
                    continue
                role, f = rows[i][2], found[i]
                i += 1
                cost += 4 if e == "D" else (3 if e[0] == "R" else 0) + 3 * (f == "truncated")
                roles += "" if e == "D" else role[:1] if e == "K" else e[1]
            if re.fullmatch("(s?(ua)+)?", roles):
                got = cost, "".join(e[0] for e in seq)
                best = got if best is None else min(best, got)
    return best


def plain(table, damaged=True):
    rows, ids = damage(table) if damaged else ([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in table], {r[0] for r in table})
    out = {}
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        found, turns = faults(mine), [r[1] for r in mine if r[1] is not None]
        cost, audit, kept = least(tuple(mine), found)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def conversations(r, n, longest):
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "User", None, ""]) if r.random() < 0.5 else ("assistant" if turn % 2 else "user")
            text = r.choice([f"Text {r.randrange(6)}.", f"Cut {r.randrange(3)}", "", " \n", None, "Ça va? ", "a" * 50 + "!\n"])
            rows.append((conv, r.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_against_plain(spark, block):
    """Also with blocks of choices smaller than a conversation, and Arrow batches smaller than either."""
    r = random.Random(block)
    rows = conversations(r, 60, 9) + conversations(r, 2, 200) + [(None, 3, "user", "No id."), (None, None, "assistant", "No turn."), (1 << 60, (1 << 60) + 1, "user", "Large."), (1 << 60, 1 << 60, "system", "Large."), (7, 1, "user", "Again."), (7, 1, "user", "Again."), (7, 1, "user", "Again.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        table = spark.createDataFrame([(*x, "d", "c", 1) for x in rows], ROWS).repartition(4)
        got = {x[0]: tuple(x[1:]) for x in C.report(C.damaged(table), block).collect()}
        assert got == plain(rows)
        told = C.report(table, block)
        assert told.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert {x[0]: tuple(x[1:]) for x in told.collect()} == plain(rows, damaged=False)
        out = {}
        for x in sorted(C.repaired(table, block).collect(), key=lambda x: x["place"]):
            out.setdefault(x["conv_id"], []).append(f"{x['role']}:{x['text']}")
            assert len(out[x["conv_id"]]) == x["place"]
        for conv, want in plain(rows, damaged=False).items():
            assert hashlib.sha256("\n".join(out.get(conv, [])).encode()).hexdigest() == want[-1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_search_over_strings_is_exhaustive():
    r = random.Random(4)
    for n in (0, 1, 2, 3):
        for _ in range(60 if n < 3 else 25):
            rows = [(0, i, r.choice(["user", "assistant", "system", "tool"]), r.choice(["A.", "B.", "c", " "])) for i in range(n)]
            assert least(tuple(rows), faults(rows))[:2] == exhaustive(rows, faults(rows))


def test_the_test_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    table = spark.read.parquet(path)
    rows = [(x["conv_id"], x["turn"], x["role"], x["text"]) for x in table.collect()]
    assert {x[0]: tuple(x[1:]) for x in C.report(C.damaged(table)).collect()} == plain(rows)


def test_empty_and_gone(spark):
    assert C.report(C.damaged(spark.createDataFrame([], ROWS))).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    table = spark.createDataFrame([(5, gone, "user", "Hello.", "", "", 0)], ROWS)
    assert [tuple(x) for x in C.report(C.damaged(table)).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repaired(C.damaged(table)).collect() == []


def test_one_giant_conversation(spark):
    """A hundred thousand turns in many blocks: roles in order cost nothing, each hundredth is given its role back."""
    table = spark.range(100_000).selectExpr("1 as conv_id", "id as turn", "if(id % 100 = 50, 'tool', if(id % 2 = 0, 'user', 'assistant')) as role", "concat('Turn ', id, '.') as text")
    (x,) = C.report(table, 1000).collect()
    assert (x["cost"], x["illegal"], x["gaps"], x["audit"].count("K"), x["audit"].count("R")) == (3000, 2000, 0, 99_000, 1000)
