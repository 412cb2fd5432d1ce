"""Repair of conversation structure by a Viterbi search that emits edits once its survivors coalesce.

The roles of a repaired conversation are nothing, or an optional system turn and then user and assistant in turn. Four
states say what the repaired turns so far end with. A turn is kept (0), given the other role (2) or deleted (3; blank
and repeated turns must be); an empty user or assistant turn may be inserted anywhere (2); a truncated turn that stays
costs 1 more. The cheapest edits win; among equally cheap ones the least string of their initials D, I, K, R does.

For each state one survivor path is held as a leaf of a tree of edits whose nodes count their children; one that costs
more than another plus the most that one could pay to follow it can't win any more and is released. When a turn
leaves the root with one child, all survivors share that child's edits: they are emitted, with their turns, and forgotten.
So memory is that of the edits and turns on which survivors still differ. Survivors are also held in the order of
their whole unresolved strings. That order is carried over exactly: every string holds one edit for each turn and
inserts come before it, so none begins another, and a tie is decided by the order of the parents, then by the new edits.

Conversations are dealt by id and sorted by Spark (which spills), and stream through a task turn by turn; a
conversation's edits are one sequence and its digest one byte string, so they pass through one task in order, but no
task holds a conversation. Repeated turns are found beforehand by a grouped aggregate over (conversation, role, text),
combined before the shuffle, and joined back, so a text that fills a conversation costs no memory either. The texts of
turns that must be deleted are not held.

Defined cases: null roles and texts count as one space; a null id is a conversation of its own; turns are in order of
turn (nulls first), then role and text, so copies are adjacent; an empty role, like any with another initial than s, u
or a, can't be kept; an empty table gives no rows; further columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. Where a kept initial leads.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: Where an inserted or re-roled turn leads, and its initial.
MADE = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
#: Inserts that complete the roles.
CLOSE = {0: "", 1: "II", 2: "I", 3: ""}
#: FOLLOW[a][b]: the most that state a pays beyond b to end as any continuation of b does (by deleting a system turn, by
#: inserting, or by completing what b may leave incomplete).
FOLLOW = {0: {1: 0, 2: 2, 3: 0}, 1: {0: 4, 2: 2, 3: 4}, 2: {0: 5, 1: 2, 3: 2}, 3: {0: 3, 1: 0, 2: 2}}
EDITS = "conv_id {id}, step long, edit string, turn long, was string, role string, text string, fault string, cost int"


def _choices(initial: str, fault: str | None) -> list[list[tuple[int, int, str]]]:
    """For each state the cheapest ``(to, cost, edits)`` over one turn, one for each state that can be reached."""
    out = []
    must = fault in ("blank", "duplicate")
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        at, made = state, ""
        for _ in range(3):  # three inserts would be a cycle
            ways = [(at, DELETE, "D")]
            if not must:
                more = CUT if fault == "truncated" else 0
                ways.append((MADE[at][0], REROLE + more, "R"))
                if (at, initial) in KEPT:
                    ways.append((KEPT[at, initial], KEEP + more, "K"))
            for to, cost, edit in ways:
                way = (cost + INSERT * len(made), made + edit)
                if to not in best or way < best[to]:
                    best[to] = way
            at, made = MADE[at][0], made + "I"
        out.append([(to, cost, edits) for to, (cost, edits) in best.items()])
    return out


CHOICES = {(i, f): _choices(i, f) for i in ("s", "u", "a", "") for f in (None, "blank", "duplicate", "truncated")}


class _Node:
    """Edits that some survivors share; ``children`` are the nodes that refer to it."""

    __slots__ = ("parent", "edits", "children")

    def __init__(self, parent: "_Node | None", edits: list[str]):
        self.parent, self.edits, self.children = parent, edits, []


class Search:
    """One conversation. ``turn`` and ``close`` return the edits that are certain by now, in order."""

    def __init__(self):
        self.root = _Node(None, [])
        #: state -> (cost, place in the order of strings, leaf)
        self.alive = {0: (0, 0, self.root)}

    def turn(self, initial: str, fault: str | None) -> str:
        choices = CHOICES[initial if initial in ("s", "u", "a") else "", fault]
        best: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, place, _) in self.alive.items():
            for to, more, edits in choices[state]:
                way = (cost + more, place, edits, state)
                if to not in best or way < best[to]:
                    best[to] = way
        least = min(way[0] for way in best.values())
        best = {
            b: way for b, way in best.items() if not any(way[0] > best[a][0] + FOLLOW[a][b] for a in best if a != b)
        }
        uses: dict[int, int] = {}
        for way in best.values():
            uses[way[3]] = uses.get(way[3], 0) + 1
        for state, (_, _, leaf) in self.alive.items():
            if state not in uses:
                self._release(leaf)
        alive = {}
        for place, (to, (cost, _, edits, state)) in enumerate(sorted(best.items(), key=lambda w: w[1][1:3])):
            leaf = self.alive[state][2]
            if uses[state] == 1 and leaf is not self.root:
                leaf.edits.append(edits)  # a path that doesn't fork grows in place
            else:
                node = _Node(leaf, [edits])
                leaf.children.append(node)
                leaf = node
            alive[to] = (cost - least, place, leaf)  # only differences of costs matter
        self.alive = alive
        return self._shared()

    def _release(self, leaf: _Node) -> None:
        node = leaf
        while node.parent is not None and not node.children:
            node.parent.children.remove(node)
            node = node.parent
        if node.parent is not None and len(node.children) == 1:
            # the one child goes on where the node ends
            child = node.children[0]
            node.edits += child.edits
            child.edits, child.parent = node.edits, node.parent
            node.parent.children[node.parent.children.index(node)] = child

    def _shared(self) -> str:
        out = []
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            out += self.root.edits
            self.root.parent, self.root.edits = None, []
        return "".join(out)

    def close(self) -> str:
        _, _, state = min((cost + INSERT * len(CLOSE[s]), place, s) for s, (cost, place, _) in self.alive.items())
        node, parts = self.alive[state][2], [[CLOSE[state]]]
        while node is not None:
            parts.append(node.edits)
            node = node.parent
        return "".join("".join(p) for p in reversed(parts))


class _Out:
    """Rows of edits, in batches of bounded rows and characters."""

    def __init__(self, schema: pa.Schema, rows: int = 5_000, chars: int = 4 << 20):
        self.schema, self.most, self.most_chars = schema, rows, chars
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.chars += len(row[6] or "")

    def full(self) -> bool:
        return len(self.rows) >= self.most or self.chars >= self.most_chars

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
        self.rows, self.chars = [], 0
        return batch


class _Applied:
    """Turns that wait for their edits, and the roles that edits give them."""

    def __init__(self, conv_id):
        self.conv_id, self.search = conv_id, Search()
        self.wait: deque[tuple] = deque()
        self.state, self.step = 0, 0
        self.last = None

    def apply(self, edits: str) -> Iterator[tuple]:
        for edit in edits:
            step, self.step = self.step, self.step + 1
            if edit == "I":
                self.state, initial = MADE[self.state]
                yield (self.conv_id, step, "I", None, None, ROLES[initial], "", None, INSERT)
                continue
            turn, role, text, fault = self.wait.popleft()
            if edit == "D":
                yield (self.conv_id, step, "D", turn, role, None, None, fault, DELETE)
                continue
            cost = CUT if fault == "truncated" else 0
            if edit == "R":
                self.state, initial = MADE[self.state]
                yield (self.conv_id, step, "R", turn, role, ROLES[initial], text, fault, REROLE + cost)
            else:
                self.state = KEPT[self.state, role[:1]]
                yield (self.conv_id, step, "K", turn, role, role, text, fault, KEEP + cost)


def _repaired(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = _Out(schema), None
        for batch in batches:
            for conv_id, turn, role, text, fault in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        for row in now.apply(now.search.close()):
                            out.add(row)
                    now = _Applied(conv_id)
                same = (turn, hashlib.md5(f"{role}\0{text}".encode()).digest())
                if fault == "first":  # of equal turns at the first place of this role and text, one stays
                    fault = "duplicate" if same == now.last else None
                    if fault is None and _cut_off(text):
                        fault = "truncated"
                now.last = same
                now.wait.append((turn, role, None if fault in ("blank", "duplicate") else text, fault))
                for row in now.apply(now.search.turn(role[:1], fault)):
                    out.add(row)
                    if out.full():
                        yield out.take()
        if now is not None:
            for row in now.apply(now.search.close()):
                out.add(row)
                if out.full():
                    yield out.take()
        if out.rows:
            yield out.take()

    return run


def _cut_off(text: str) -> bool:
    return text.rstrip(SPACE)[-1:] not in (".", "!", "?")


def turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, fault``; fault ``first`` is for the task to tell a first turn from its copies."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text")
    )
    bare = F.rtrim("text", F.lit(SPACE))
    print_ = F.unhex(F.md5(F.concat("role", F.lit("\0"), "text")))
    rows = rows.withColumn("bare", F.substring(bare, -1, 1)).withColumn("print", F.when(F.col("bare") != "", print_))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    often = rows.filter("print is not null").groupBy(F.col("conv_id").alias("c"), F.col("print").alias("p")).agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").drop("n")
    rows = rows.join(often, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("print") == F.col("p")), "left")
    fault = F.when(F.col("bare") == "", "blank").when(F.col("first").isNotNull(), F.when(place == F.col("first"), "first").otherwise("duplicate"))
    fault = fault.when(~F.col("bare").isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edits of every conversation, in order within each partition.

    ``conv_id, step, edit`` (K, R, D or I), ``turn, was`` (of the turn; null for an insert), ``role, text`` (after the edit;
    null for a delete), ``fault, cost``. The repaired turns are those with a role.
    """
    faulty = turns(rows, conv_col, turn_col, role_col, text_col)
    dealt = faulty.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    schema = EDITS.format(id=faulty.schema["conv_id"].dataType.simpleString())
    arrow = _arrow_schema(faulty, schema)
    return dealt.mapInArrow(_repaired(arrow), schema)


def _arrow_schema(rows: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _reported(schema: pa.Schema):
    """One row a conversation from its edits in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def end():
            turns_ = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
            done.append((
                now["id"], turns_, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"],
                "".join(now["audit"]), now["sha"].hexdigest(),
            ))

        for batch in batches:
            for conv_id, edit, turn, was, role, text, fault, cost in zip(
                *[batch.column(c).to_pylist() for c in ("conv_id", "edit", "turn", "was", "role", "text", "fault", "cost")]
            ):
                if now is None or now["id"] != conv_id:
                    if now is not None:
                        end()
                    now = {
                        "id": conv_id, "first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                        "cost": 0, "audit": [], "sha": hashlib.sha256(), "some": False, "was": None,
                    }
                now["audit"].append(edit)
                now["cost"] += cost
                if edit != "I":
                    if turn is not None and turn != now["last"]:
                        now["first"] = turn if now["first"] is None else now["first"]
                        now["last"] = turn
                        now["turns"] += 1
                    if fault:
                        now[fault] += 1
                    if now["was"] is not None and now["was"] + was[:1] not in ("su", "ua", "au"):
                        now["illegal"] += 1
                    now["was"] = was[:1]
                if role is not None:
                    now["sha"].update((("\n" if now["some"] else "") + f"{role}:{text}").encode())
                    now["some"] = True
            if len(done) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if now is not None:
            end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


EMPTY_SHA = hashlib.sha256().hexdigest()


def report(edits: DataFrame, ids: DataFrame) -> DataFrame:
    """Faults, cost, edits and digest of the repaired turns for every conversation of ``ids``.

    ``edits`` is what ``repair`` returned, in its order.
    """
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    kind = edits.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"
    found = edits.mapInArrow(_reported(_arrow_schema(edits, schema)), schema).withColumnRenamed("conv_id", "found")
    every = ids.select("conv_id").distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"),
    )
