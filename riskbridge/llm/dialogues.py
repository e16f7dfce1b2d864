"""Repair of conversations: the cheapest edits that make speakers alternate.

Rows are dealt by conversation and sorted by turn; one pass per partition carries the state of the search over Arrow's batches,
so that a conversation of any length needs no more than its edits in memory. A repaired conversation's roles read (s?(ua)+)?
by their initials. Its four prefixes, empty, system, after a user and after an assistant, each have a cheapest way to be reached; equally cheap
ways are told apart by the order of their edits, of which a rank among the four is all that a later row needs. Costs
count from the cheapest and those that can't win any more are dropped, so there are few different states, and a step between two
states is looked up by number. The numbers are the back pointers: four bytes a row, packed in blocks as a conversation grows. The
packed blocks stay with the task, as executors must not leave files of their own. The digest of the repaired text is carried
for each of the four ways, so that no text is held back.
"""

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Costs of the edits, faults, and what the roles begin with.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
WORST = 8  # a way that costs more than the cheapest by this can't win: any state gets where another can for 7
PACK = 1 << 16  # rows whose back pointers are packed together

# the states that insertions reach, with the inserted roles
_INSERTED = {
    EMPTY: [(EMPTY, ()), (USER, ("user",)), (ASSISTANT, ("user", "assistant"))],
    SYSTEM: [(SYSTEM, ()), (USER, ("user",)), (ASSISTANT, ("user", "assistant"))],
    USER: [(USER, ()), (ASSISTANT, ("assistant",))],
    ASSISTANT: [(ASSISTANT, ()), (USER, ("user",))],
}
_CLOSING = {EMPTY: (), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ()}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows after the fixed damage; those that it drops are marked as gone."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("kind")
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind)
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.col("kind") == 0, F.when(F.col("kind") == 3, 2).otherwise(1))).alias("gone")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times)


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows by conversation and turn, with their fault; each conversation in one partition."""
    trimmed = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    dealt = rows.withColumn("name", F.col("conv_id").cast("string")).repartition("name")
    same = W.partitionBy("name", "gone", "role", F.md5("text")).orderBy("turn")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("copy") > 1, DUPLICATE).when(~F.right(trimmed, F.lit(1)).rlike("[.!?]"), CUT_OFF).otherwise(FINE)
    found = dealt.withColumn("copy", F.row_number().over(same)).select(
        "name", F.col("turn").isNotNull().alias("timed"), F.coalesce(F.col("turn"), F.lit(0)).cast("long").alias("turn"), "gone", "role", "text", fault.alias("fault"), "copy"
    )
    return found.sortWithinPartitions("name", "gone", "timed", "turn", "role", "text", "copy")


class Steps:
    """The steps between states of the search, made when they are first met and known by number from then on."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.steps: list[tuple] = []

    def step(self, state: tuple, initial: str, fault: int) -> int:
        """State: for each prefix (cost above the cheapest, rank), or None where it can't be reached cheaply enough."""
        key = (state, initial if initial in ("s", "u", "a") else "", fault)
        if key not in self.numbers:
            self.numbers[key] = len(self.steps)
            self.steps.append(self._made(*key))
        return self.numbers[key]

    @staticmethod
    def _made(state: tuple, initial: str, fault: int) -> tuple:
        """(cost added to the cheapest, next state, for each prefix the way to it: prefix before, inserted roles, edit, new role)."""
        best: list[tuple | None] = [None] * 4
        for before, reached in enumerate(state):
            if reached is None:
                continue
            cost, rank = reached
            for at, roles in _INSERTED[before]:
                spent = cost + INSERT * len(roles)
                moves = [(at, DELETE, "D", "")]
                if fault in (FINE, CUT_OFF):
                    more = TRUNCATED if fault == CUT_OFF else 0
                    to = {"u": USER, "a": ASSISTANT, "s": SYSTEM}.get(initial)
                    if (to == USER and at != USER) or (to == ASSISTANT and at == USER) or (to == SYSTEM and at == EMPTY):
                        moves.append((to, more, "K", ""))
                    moves.append((ASSISTANT, REROLE + more, "R", "assistant") if at == USER else (USER, REROLE + more, "R", "user"))
                for to, price, edit, role in moves:
                    way = (spent + price, rank, "I" * len(roles) + edit, before, roles, edit, role)
                    if best[to] is None or way[:3] < best[to][:3]:
                        best[to] = way
        least = min(w[0] for w in best if w)
        best = [w if w and w[0] - least <= WORST else None for w in best]
        order = sorted((w[1], w[2]) for w in best if w)
        after = tuple((w[0] - least, order.index((w[1], w[2]))) if w else None for w in best)
        return least, after, tuple(w[3:] if w else None for w in best)


class Search:
    """One conversation's search, fed row by row."""

    def __init__(self, steps: Steps) -> None:
        self.steps = steps
        self.state: tuple = ((0, 0), None, None, None)
        self.cost, self.taken, self.packed = 0, array("I"), []
        self.digests: list = [hashlib.sha256(), None, None, None]
        self.rows = self.illegal = self.turns = 0
        self.faults = [0, 0, 0, 0]
        self.last = self.first_turn = self.last_turn = None

    @staticmethod
    def _add(digest, empty: bool, lines: list[str]) -> None:
        if lines:
            digest.update(("" if empty else "\n").encode() + "\n".join(lines).encode())

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if self.rows and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.rows, self.last = self.rows + 1, role[:1]
        self.faults[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        number = self.steps.step(self.state, role[:1], fault)
        more, self.state, ways = self.steps.steps[number]
        self.cost += more
        self.taken.append(number)
        if len(self.taken) == PACK:
            self.packed.append(zlib.compress(self.taken.tobytes(), 1))
            self.taken = array("I")
        digests = []
        for way in ways:
            if way is None:
                digests.append(None)
                continue
            before, roles, edit, new = way
            lines = [f"{r}:" for r in roles]
            if edit != "D":
                lines.append(f"{new or role}:{text}")
            digest = self.digests[before].copy()
            self._add(digest, before == EMPTY, lines)
            digests.append(digest)
        self.digests = digests

    def result(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest of the repaired lines)"""
        cost, _, at = min((s[0] + INSERT * len(_CLOSING[i]), s[1], i) for i, s in enumerate(self.state) if s)
        digest = self.digests[at]
        self._add(digest, at == EMPTY, [f"{r}:" for r in _CLOSING[at]])
        audit, part = ["I" * len(_CLOSING[at])], self.taken
        while True:
            for number in reversed(part):
                at, roles, edit, _ = self.steps.steps[number][2][at]
                audit.append("I" * len(roles) + edit)
            if not self.packed:
                break
            part = array("I")
            part.frombytes(zlib.decompress(self.packed.pop()))
        gaps = 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.turns, (1 << 63) - 1)
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT_OFF], self.illegal, self.cost + cost, "".join(reversed(audit)), digest.hexdigest()


_RESULT = "name string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _RESULT.split(", ")]
    steps, search, of, done = Steps(), None, None, []
    for pdf in batches:
        for name, timed, turn, gone, role, text, fault in zip(*[pdf[c].tolist() for c in ("name", "timed", "turn", "gone", "role", "text", "fault")], strict=True):
            if search is None or name != of:
                if search is not None:
                    done.append((of, *search.result()))
                search, of = Search(steps), name
            if not gone:
                search.add(turn if timed else None, role, text, fault)
        if len(done) > 1000:
            yield pd.DataFrame(done, columns=names)
            done = []
    if search is not None:
        done.append((of, *search.result()))
    yield pd.DataFrame(done, columns=names)


def _typed(found: DataFrame, rows: DataFrame) -> DataFrame:
    return found.select(F.col("name").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *[c for c in found.columns if c != "name"])


def repairs(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and the edits (audit), and the digest of the repaired lines.

    rows: conv_id, turn, role, text, gone (true: the row only says that the conversation exists). Rows without a turn come first; rows of
    one turn go by role and text. A null conv_id is a conversation of its own; null roles and texts must be replaced
    before. A conversation without rows has zeros, an empty audit and the digest of nothing.
    """
    return _typed(_ordered(rows).mapInPandas(_search, _RESULT), rows)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the conversations after their repair; places count from 1."""

    def edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, audit in zip(pdf["name"].tolist(), pdf["audit"].tolist(), strict=True):
                out, row, place = [], 0, 0
                # an odd number of lines begins with system; then users have the even places, else the odd ones
                odd = (len(audit) - audit.count("D")) % 2
                for edit in audit:
                    row += edit != "I"
                    place += edit != "D"
                    if edit != "D":
                        speaker = None if edit == "K" else "user" if (place - odd) % 2 else "assistant"
                        out.append((name, row if edit != "I" else 0, place, speaker))
                    if len(out) >= PACK:
                        yield pd.DataFrame(out, columns=["name", "row", "place", "speaker"])
                        out = []
                yield pd.DataFrame(out, columns=["name", "row", "place", "speaker"])

    done = _ordered(rows).mapInPandas(_search, _RESULT).select(F.coalesce("name", F.lit("")).alias("name"), F.col("name").isNull().alias("none"), "audit")
    key = F.concat(F.col("none").cast("string"), F.lit(":"), F.col("name"))
    lines = done.select(key.alias("name"), "audit").mapInPandas(edits, "name string, row bigint, place bigint, speaker string")
    inside = W.partitionBy("name").orderBy("timed", "turn", "role", "text", "copy")
    numbered = _ordered(rows).filter("not gone").withColumn("row", F.row_number().over(inside).cast("long"))
    numbered = numbered.select(F.concat(F.col("name").isNull().cast("string"), F.lit(":"), F.coalesce("name", F.lit(""))).alias("name"), "row", "role", "text")
    found = lines.join(numbered, ["name", "row"], "left").select("name", "place", F.coalesce("speaker", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.when(F.col("name").startswith("false"), F.substring(F.col("name"), F.lit(7), F.length("name")))
    return _typed(found.withColumn("name", name), rows)


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation after the fixed damage: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles, texts, and ids and turns in what chooses the damage, count as one space. A repeated row is a duplicate. Other columns are ignored.
    """
    return repairs(damaged(conversations))
