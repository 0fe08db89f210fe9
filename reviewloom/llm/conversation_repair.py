"""Repair of the structure of conversations by cheapest edits.

The rows of a conversation, in the order of their turns, are edited so that the initials
of their roles read ``(s?(ua)+)?``: Keep (cost 0), Rerole to user or assistant (1), Delete (2,
the only choice for blank rows and repeats), Insert an empty turn of user or assistant
(5); a truncated row that is not deleted adds 5. Of equally cheap repairs the one whose edit
initials (K, R, D, I) come first in ASCII is taken.

The search is a Viterbi pass with survivor coalescence. The pattern has four states (nothing
yet, system, user, assistant written last); each keeps one survivor, a leaf of a tree of edits with
parent pointers and reference counts. Dropped survivors free their branch, and as soon as
all that are left share an ancestor, the edits up to it are final: they go into the running
hash and audit, and their rows are forgotten. Equal costs are decided by comparing the two whole
unresolved suffixes, back to the common ancestor. Two states that can no longer win
are dropped, which keeps the tree short: nothing-yet when it costs over 2 more than
assistant-last (the most a later system row can save), system-last when it costs more.

Spark does the rest: damage and faults are column expressions; repeats are found by an
aggregate over (conversation, role, text digest), of which only groups with two or more
rows are stored and joined back; rows are then dealt by conversation and sorted. A
conversation is one running hash, so its rows pass through one task, however many they are,
but as a stream: memory holds the unresolved suffix, never the conversation (the audit,
one character for each edit, is part of the result).

Rows: null roles and texts count as one space, null turns come first and do not count for
gaps, null conversation ids are one conversation; rows with the same turn stand in the order
of role and text; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.storage import materialise

# White space of a blank text, marks that end a whole one, lawful neighbours, costs.
BLANK = r"[\x20\x09-\x0D]"
LAWFUL = frozenset(("su", "ua", "au"))
REROLE, DELETE, INSERT, TRUNCATED_KEPT = 1, 2, 5, 5

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: By initial of a kept row: state before -> state after.
KEEP = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: State after the next written user or assistant turn.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


class Node:
    """An edit of a survivor; referred to by its children and by the state that ends in it."""

    __slots__ = ("parent", "edit", "depth", "kids", "held")

    def __init__(self, parent: Node | None, edit: str):
        self.parent, self.edit, self.kids, self.held = parent, edit, [], 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.kids.append(self)


def comes_before(p: Node, p_edit: str, q: Node, q_edit: str) -> bool:
    """Whether the edits to ``p`` and then ``p_edit`` come before those to ``q`` and ``q_edit``."""
    left, right = [p_edit], [q_edit]
    while p is not q:
        if p.depth >= q.depth:
            left.append(p.edit)
            p = p.parent
        else:
            right.append(q.edit)
            q = q.parent
    return left[::-1] < right[::-1]


class Repair:
    """Survivors of one conversation; ``emit`` gets every edit as soon as it is final."""

    def __init__(self, emit: Callable[[str], None]):
        self.emit = emit
        self.root = Node(None, "")
        self.root.held = 1
        self.cost: list[int | None] = [0, None, None, None]
        self.leaf: list[Node | None] = [self.root, None, None, None]
        self.insert()

    def release(self, node: Node) -> None:
        node.held -= 1
        while node is not self.root and not node.held and not node.kids:
            parent = node.parent
            parent.kids.remove(node)
            node = parent

    def put(self, state: int, cost: int, parent: Node, edit: str) -> None:
        node = Node(parent, edit)
        node.held = 1
        old = self.leaf[state]
        self.cost[state], self.leaf[state] = cost, node
        if old:
            self.release(old)

    def insert(self) -> None:
        """Inserted turns, as long as they help."""
        changed = True
        while changed:
            changed = False
            for state, after in NEXT.items():
                if self.cost[state] is None:
                    continue
                cost, now = self.cost[state] + INSERT, self.cost[after]
                if now is None or cost < now or cost == now and comes_before(self.leaf[state], "I", self.leaf[after].parent, self.leaf[after].edit):
                    self.put(after, cost, self.leaf[state], "I")
                    changed = True

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        """Take the next row."""
        best: list[tuple[int, Node, str] | None] = [None] * 4

        def offer(state, cost, parent, edit):
            now = best[state]
            if now is None or cost < now[0] or cost == now[0] and comes_before(parent, edit, now[1], now[2]):
                best[state] = (cost, parent, edit)

        extra = TRUNCATED_KEPT if truncated else 0
        keep = KEEP.get(initial, {})
        for state, (cost, leaf) in enumerate(zip(self.cost, self.leaf, strict=True)):
            if cost is None:
                continue
            offer(state, cost + DELETE, leaf, "D")
            if not must_go:
                if state in keep:
                    offer(keep[state], cost + extra, leaf, "K")
                offer(NEXT[state], cost + REROLE + extra, leaf, "R")
        old = self.leaf
        self.cost, self.leaf = [None] * 4, [None] * 4
        for state, found in enumerate(best):
            if found:
                self.put(state, *found)
        for leaf in old:
            if leaf:
                self.release(leaf)
        self.insert()
        last = self.cost[ASSISTANT]
        for state, most in ((NOTHING, DELETE), (SYSTEM, 0)):
            if self.cost[state] is not None and self.cost[state] > last + most:
                self.release(self.leaf[state])
                self.cost[state] = self.leaf[state] = None
        self.advance()

    def advance(self) -> None:
        """Emit the edits that all survivors share."""
        while not self.root.held and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.emit(self.root.edit)

    def finish(self) -> int:
        """Emit the rest of the cheapest whole repair, return its cost."""
        ends = [s for s in (NOTHING, ASSISTANT) if self.cost[s] is not None]
        least = min(self.cost[s] for s in ends)
        paths = []
        for state in ends:
            if self.cost[state] == least:
                node, path = self.leaf[state], []
                while node is not self.root:
                    path.append(node.edit)
                    node = node.parent
                paths.append(path[::-1])
        for edit in min(paths):
            self.emit(edit)
        return least


class Conversation:
    """Counts, faults and repair of one conversation, fed row by row in order."""

    def __init__(self, key):
        self.key = key
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.last_turn = None
        self.turns = 0
        self.before: tuple[str, str] | None = None
        self.waiting: deque[tuple[str, str]] = deque()
        self.state, self.audit, self.digest, self.written = NOTHING, bytearray(), hashlib.sha256(), False
        self.most_waiting = 0
        self.repair = Repair(self.edit)

    def edit(self, edit: str) -> None:
        self.audit += edit.encode()
        role = text = ""
        if edit != "I":
            role, text = self.waiting.popleft()
            if edit == "D":
                return
        if edit == "K":
            self.state = KEEP[role[:1]][self.state]
        else:
            self.state = NEXT[self.state]
            role = "user" if self.state == USER else "assistant"
        self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode())
        self.written = True

    def add(self, turn: int | None, role: str, text: str, blank: bool, late: bool, cut: bool) -> None:
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = self.last_turn = turn
        if self.before and self.before[0][:1] + role[:1] not in LAWFUL:
            self.illegal += 1
        # Rows alike of the earliest turn stand next to each other; ``late`` covers the others.
        again = not blank and (late or self.before == (role, text))
        cut = cut and not blank and not again
        self.blank += blank
        self.duplicate += again
        self.truncated += cut
        self.before = (role, text)
        self.waiting.append((role, text))
        self.repair.row(role[:1], blank or again, cut)
        self.most_waiting = max(self.most_waiting, len(self.waiting))

    def result(self) -> tuple:
        cost = self.repair.finish()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, self.audit.decode(), self.digest.hexdigest())


def damaged(rows: DataFrame) -> DataFrame:
    """Seeded damage by crc32 of ``conv_id:turn``: ``conv_id``, ``turn``, ``role``, ``text``, ``gone`` (row dropped)."""

    def spaced(c) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"), (kind == 0).alias("gone"), F.explode_outer(copies).alias("__copy"),
    ).drop("__copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``blank``, ``late`` (role and text stand at an earlier turn) and ``cut`` (the last visible character ends no sentence)."""
    # Not stored: both uses read the source again, which is cheaper than a copy of all texts.
    rows = (
        rows.withColumn("blank", ~F.col("text").rlike(f"[^{BLANK[1:]}"))
        .withColumn("cut", ~F.col("text").rlike(rf"[.!?]{BLANK}*\z"))
        .withColumn("digest", F.when(~F.col("gone") & ~F.col("blank"), F.unhex(F.sha2("text", 256))))
    )
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    repeated = (
        rows.where("digest is not null").groupBy("conv_id", "role", "digest")
        .agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    # Stored, so that the join has two plain sides and a hot group of rows can be split.
    repeated = materialise(repeated, "conversation-repeats").toDF("r_conv", "r_role", "r_digest", "first")
    same = F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("role") == F.col("r_role")) & (F.col("digest") == F.col("r_digest"))
    late = F.coalesce(turn > F.col("first"), F.lit(False))
    return rows.join(repeated, same, "left").select("conv_id", "turn", "role", "text", "gone", "blank", late.alias("late"), "cut")


def repair_rows(rows: DataFrame) -> DataFrame:
    """One row per conversation from rows with faults (``with_faults``)."""
    kind = rows.schema["conv_id"].dataType
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def work(batches):
        def batch_of(done):
            columns = list(zip(*done, strict=True))
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        now, done, id_type = None, [], None
        for batch in batches:
            id_type = batch.column(0).type
            for key, turn, role, text, gone, blank, late, cut in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                if now is None or key != now.key:
                    if now:
                        done.append(now.result())
                    now = Conversation(key)
                if not gone:
                    now.add(turn, role, text, blank, late, cut)
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
        if now:
            done.append(now.result())
        if done:
            yield batch_of(done)

    # A fixed number of partitions: rows are cheap to store and dear to walk, so they are not joined into fewer tasks.
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = (f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:7]) + ", audit string, repaired_sha256 string")
    return dealt.mapInArrow(work, schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation, from its rows as they are."""
    whole = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(False).alias("gone"),
    )
    return repair_rows(with_faults(whole))


def repair_damaged(rows: DataFrame) -> DataFrame:
    """The same after seeded damage; a conversation that lost all its rows stays, with zeros."""
    return repair_rows(with_faults(damaged(rows)))
