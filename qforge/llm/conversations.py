"""Conversation structure repair: the cheapest edits that make roles read ``(system? (user assistant)+)?``, by a pass backward and a pass forward over sorted rows.

1. Rows become narrow: turn, digest of role and text, role initial and first fault. A second row of a conversation with one digest is a duplicate.
2. Backward: narrow rows are dealt by conversation, sorted by turn downward, and streamed through ``mapInPandas``. What stays in memory of a conversation, across Arrow batches, is the
   cost of finishing from each of four states (nothing yet, system, user, assistant) and counts. The choice at each row for each state is two bits, a byte a row;
   every BLOCK of those is written out with the key of its first row, so a giant conversation's choices are spilled to the shared folder.
3. Forward: whole rows and blocks of choices are dealt by conversation and sorted together, a block ahead of the rows it is for. The choices give the edits one after
   the other; the repaired text goes into a running hash. Choices are in the order of their initials, so of equal costs the ASCII-least audit is taken.

A conversation is read by one task, as its turns depend on each other; its rows are never in memory together.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qforge.llm.common import written

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows whose choices are in memory at a time.
BLOCK = 1 << 16
WHITE = " \t\n\x0b\x0c\r"
FAULTS = ("none", "blank", "duplicate", "truncated")
EDITS = "DIKR"
ROLES = "sua"

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that the next user or assistant row leads to, and the cost of ending in a state.
NEXT = (USER, USER, ASSISTANT, USER)
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = {(0, 1), (1, 2), (2, 1)}

REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
CHOICES = "conv string, turn long, digest binary, ord long, codes binary, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
TURNS = "conv string, place long, role string, text string, edit string"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of conversations with planted damage; null roles and texts are one space, and so are null ids and turns for the draw.

    By crc32(``conv_id:turn``) % 20: 0 drops the row (``gone``), 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes it the user's.
    """
    blank = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    out = rows.select(
        "conv_id",
        "turn",
        F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (draw == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(draw == 3, 2).otherwise(1))).alias("copy"),
    )
    return out.drop("copy")


def keyed(rows: DataFrame) -> DataFrame:
    """(conv, turn, digest, role, text, gone): ids as strings, and a digest of role and text, by which rows of one turn are in order."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), role.alias("role"), text.alias("text"), *(["gone"] if "gone" in rows.columns else [F.lit(False).alias("gone")]))


def narrow(rows: DataFrame) -> DataFrame:
    """(conv, turn, has_turn, digest, nth, code) of keyed rows; code is 4 * fault + role, or -1 for the rows that only say that a conversation exists."""
    said = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    live = rows.filter(~F.col("gone")).select("conv", "turn", "digest", role.alias("role"), (said == "").alias("blank"), (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"))
    live = live.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "digest").orderBy(F.asc_nulls_first("turn"))))
    fault = F.when(F.col("blank"), 1).when(F.col("nth") > 1, 2).when(F.col("cut"), 3).otherwise(0)
    live = live.select("conv", "turn", "digest", "nth", (4 * fault + F.col("role")).cast("int").alias("code"))
    gone = rows.filter("gone").select("conv").distinct().select("conv", F.lit(None).cast("long").alias("turn"), F.lit(b"").alias("digest"), F.lit(0).alias("nth"), F.lit(-1).alias("code"))
    return live.unionByName(gone).select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("has_turn"), "digest", "nth", "code")


def step(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """(costs of finishing from each state before a row, its choices) from those after it; a choice is two bits, state by state from the lowest."""
    fault, role = divmod(code, 4)
    kept = TRUNCATED * (fault == 3)
    ways: list[dict[str, int]] = []
    for state in range(4):
        x = {"D": DELETE + after[state]}
        if fault in (0, 3):
            x["R"] = REROLE + kept + after[NEXT[state]]
            fits = role == 0 and state == START or role in (1, 2) and NEXT[state] == role + 1
            if fits:
                x["K"] = kept + after[SYSTEM if role == 0 else NEXT[state]]
        ways.append(x)
    least = [min(x.values()) for x in ways]
    cost = list(least)
    for _ in range(2):  # two rows put in are one round of roles
        cost = [min(least[s], INSERT + cost[NEXT[s]]) for s in range(4)]
    choices = 0
    for state, x in enumerate(ways):
        x["I"] = INSERT + cost[NEXT[state]]
        choices |= EDITS.index(min(k for k, v in x.items() if v == cost[state])) << (2 * state)
    return tuple(cost), choices


def choices(rows: DataFrame, block: int) -> DataFrame:
    """Blocks of choices of narrow rows; the block with a conversation's first rows has its counts and cost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, tuple] = {}
        now, costs, base, codes, first, later, n = None, END, 0, bytearray(), (None, b""), None, 0
        counts, illegal, low, high, turns = [0] * 4, 0, None, None, 0

        def made(last: bool) -> tuple:
            gaps = high - low + 1 - turns if turns else 0
            return (now[0], first[0], first[1], -n, bytes(codes[::-1]), *((gaps, *counts[1:], illegal, base + costs[START]) if last else (None,) * 6))

        for b in batches:
            out = []
            for conv, turn, has, digest, code in zip(b["conv"], b["turn"].tolist(), b["has_turn"].tolist(), b["digest"], b["code"].tolist(), strict=True):
                if now != (conv,):
                    if now is not None:
                        out.append(made(True))
                    now, costs, base, codes, first, later, n = (conv,), END, 0, bytearray(), (None, b""), None, 0
                    counts, illegal, low, high, turns = [0] * 4, 0, None, None, 0
                if code < 0:
                    continue
                if len(codes) == block:
                    out.append(made(False))
                    codes = bytearray()
                # costs are kept less their smallest, so few vectors occur
                if (k := (costs, code)) not in known:
                    x, choice = step(costs, code)
                    known[k] = tuple(c - min(x) for c in x), min(x), choice
                costs, more, choice = known[k]
                base += more
                codes.append(choice)
                n += 1
                first = (turn if has else None, digest)
                counts[code >> 2] += 1
                illegal += later is not None and (code & 3, later) not in LEGAL
                later = code & 3
                if has:
                    turns += turn != low
                    low = turn
                    high = turn if high is None else high
            if out:
                yield table(out)
        if now is not None:
            yield table([made(True)])

    def table(out: list[tuple]) -> pd.DataFrame:
        # integers with nulls, column by column: pandas would make doubles of them
        columns = zip(*(c.split() for c in CHOICES.split(", ")), strict=True)
        return pd.DataFrame({c: pd.array(x, dtype="Int64") if kind == "long" else list(x) for c, kind, x in zip(*columns, zip(*out, strict=True), strict=True)})

    order = (F.asc("conv"), F.desc("has_turn"), F.desc("turn"), F.desc("digest"), F.desc("nth"))
    return rows.repartition("conv").sortWithinPartitions(*order).mapInPandas(run, CHOICES)


class Repair:
    """The edits of one conversation, row after row, from its choices."""

    def __init__(self, said: Callable[[str, str, str], None]):
        self.state, self.codes, self.at, self.audit, self.said = START, deque(), 0, bytearray(), said

    def _out(self, edit: str, role: str | None, text: str) -> None:
        to = SYSTEM if edit == "K" and role[:1] == "s" else NEXT[self.state]
        self.state = to
        self.audit += edit.encode()
        self.said(role if edit == "K" else ("user", "assistant")[to - USER], text, edit)

    def row(self, role: str, text: str) -> None:
        while self.at == len(self.codes[0]):
            self.codes.popleft()
            self.at = 0
        code = self.codes[0][self.at]
        self.at += 1
        while True:
            edit = EDITS[code >> (2 * self.state) & 3]
            if edit == "D":
                self.audit += b"D"
                return
            self._out(edit, role if edit == "K" else None, "" if edit == "I" else text)
            if edit != "I":
                return

    def end(self) -> None:
        while self.state in (SYSTEM, USER):
            self._out("I", None, "")


def _forward(rows: DataFrame, block: int) -> DataFrame:
    """Keyed rows (kind 1) and the blocks of choices for them (kind 0), dealt by conversation, each block ahead of its rows."""
    blocks, _ = written(choices(narrow(rows), block), "choices")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    live = rows.filter(~F.col("gone")).select("conv", "turn", "digest", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("ord"), "role", "text")
    both = blocks.withColumn("kind", F.lit(0)).unionByName(live, allowMissingColumns=True)
    order = (F.asc("conv"), F.asc_nulls_first("turn"), F.asc("digest"), F.asc("kind"), F.asc("ord"))
    both = both.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in numbers})
    return both.repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text", "codes", *numbers)


def report(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text and, optionally, gone): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, null turns first; rows of one turn by the digest of their role and text. Null roles and texts are one space; a null id is a conversation like
    any other. Rows that are ``gone`` only say that their conversation exists: without others it has zeros, an empty audit and the hash of nothing. An empty table gives no rows. Rows
    that repeat are duplicates. Other columns, whatever their names, are ignored.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, numbers, repair, digest = None, (), None, None

        def ended() -> tuple:
            repair.end()
            return (now[0], *numbers, repair.audit.decode(), digest.hexdigest())

        def hashed(h) -> Callable[[str, str, str], None]:
            ahead = [b""]

            def said(role: str, text: str, edit: str) -> None:
                h.update(ahead[0] + f"{role}:{text}".encode("utf-8", "replace"))
                ahead[0] = b"\n"

            return said

        for b in batches:
            out = []
            for conv, kind_, role, text, codes, *counts in zip(b["conv"], b["kind"].tolist(), b["role"], b["text"], b["codes"], *(b[c].tolist() for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), strict=True):
                if now != (conv,):
                    if now is not None:
                        out.append(ended())
                    now, digest, numbers = (conv,), hashlib.sha256(), counts
                    repair = Repair(hashed(digest))
                if kind_:
                    repair.row(role, text)
                else:
                    repair.codes.append(codes)
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in REPORT.split(", ")])
        if now is not None:
            yield pd.DataFrame([ended()], columns=[c.split()[0] for c in REPORT.split(", ")])

    done = _forward(keyed(rows), block).mapInPandas(run, REPORT)
    return done.select(F.col("conv").cast(kind).alias("conv_id"), *[c.split()[0] for c in REPORT.split(", ")[1:]])


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, place, role, text, edit): the rows of the repaired conversations in order, each kept (K), given another role (R) or put in (I). Cases as in ``report``."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, repair, out = None, None, []

        def said(role: str, text: str, edit: str) -> None:
            out.append((now[0], role, text, edit))

        for b in batches:
            for conv, kind_, role, text, codes in zip(b["conv"], b["kind"].tolist(), b["role"], b["text"], b["codes"], strict=True):
                if now != (conv,):
                    if repair is not None:
                        repair.end()
                    now, repair = (conv,), Repair(said)
                if kind_:
                    repair.row(role, text)
                else:
                    repair.codes.append(codes)
            if out:
                yield pd.DataFrame(out, columns=["conv", "role", "text", "edit"])
                out = []
        if repair is not None:
            repair.end()
        if out:
            yield pd.DataFrame(out, columns=["conv", "role", "text", "edit"])

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n = None, 0
        for b in run(batches):
            places = []
            for conv in b["conv"]:
                n = n + 1 if last == (conv,) else 1
                last = (conv,)
                places.append(n)
            yield b.assign(place=places)[["conv", "place", "role", "text", "edit"]]

    done = _forward(keyed(rows), block).mapInPandas(numbered, TURNS)
    return done.select(F.col("conv").cast(kind).alias("conv_id"), "place", "role", "text", "edit")
