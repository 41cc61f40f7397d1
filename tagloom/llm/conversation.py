"""Conversation structure repair with a persistent audit DP.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Each
row is kept, given the role user or assistant, or deleted, and empty rows may
be inserted; blank and repeated rows must go, cut-off rows that stay cost
extra. The cheapest edits are found by a DP over four states (nothing yet,
after s, after u, after a). Its cells share their edit prefixes: a cell is a
node linked to the cell before it, with binary-lifting ancestors and the
rolling hash of its whole audit. Equal costs are decided by the audits' order:
a search over the ancestors finds the longest common prefix by hash, the node
found is verified letter by letter unless both are the same node, and the next
letters decide.

Rows are range-sorted by (conversation, turn, role, text) after equal rows
were counted, so a task streams its conversations in order. A conversation
that lies whole inside a task and a piece (``PIECE_ROWS`` rows, about
``PIECE_CHARS`` characters) is done there. Others (two a range at most, and
the long ones) are cut into pieces. Each piece gives its cheapest audit from
every state to every state, pieces are chained in order, and each is then
rewritten by itself. That is exact: of two audits over the same rows and
states with equal cost none is a prefix of the other, so order survives
joining. A long conversation's rows are thus never in one task; its audit is,
being one value, and the digest of its text is taken from a stream of pieces.

Defined results: a null text or role counts as one space (blank; no lawful
role); an empty role fits no place; null turns come first; rows of one turn
are taken by role, then text; equal rows follow each other; rows of a null
conversation are one conversation with a null id; texts of any length are
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, staged

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
PIECE_ROWS, PIECE_CHARS = 1024, 1 << 20
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: state after a row with this initial
STEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LAWFUL = {"su", "ua", "au"}
MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str


class Node:
    """An audit: the one before it plus the letters of one step."""

    __slots__ = ("parent", "letters", "state", "step", "length", "hash", "up")

    def __init__(self, parent: "Node | None", letters: str, state: int):
        self.parent, self.letters, self.state = parent, letters, state
        self.step = parent.step + 1 if parent else 0
        self.length = (parent.length if parent else 0) + len(letters)
        h = parent.hash if parent else 0
        for c in letters:
            h = (h * BASE + ord(c)) % MODULUS
        self.hash = h
        up = []
        node, k = parent, 0
        while node is not None:  # up[k] is 2**k steps back
            up.append(node)
            node, k = (node.up[k] if k < len(node.up) else None), k + 1
        self.up = up

    def back(self, step: int) -> "Node":
        node = self
        while node.step > step:
            node = node.up[(node.step - step).bit_length() - 1]
        return node

    def string(self) -> str:
        out, node = [], self
        while node is not None:
            out.append(node.letters)
            node = node.parent
        return "".join(reversed(out))


def same(x: Node, y: Node) -> bool:
    """Equal audits: by hash, then verified up to a shared node."""
    if x is y:
        return True
    if x.hash != y.hash or x.length != y.length:
        return False
    return x.string() == y.string()


def common(x: Node, y: Node) -> Node:
    """The last node of x, at a step up to both, whose audit y shares."""
    a, b = x, y
    if same(a, b):
        return a
    for k in range(min(len(a.up), len(b.up)) - 1, -1, -1):
        if k < len(a.up) and k < len(b.up) and not same(a.up[k], b.up[k]):
            a, b = a.up[k], b.up[k]
    return a.parent


def letters_after(node: Node, step: int, last: str) -> Iterator[str]:
    for s in range(step + 1, node.step + 1):
        yield from node.back(s).letters
    yield from last


def earlier(x: Node, tail_x: str, y: Node, tail_y: str) -> bool:
    """x + tail_x before y + tail_y in ASCII order (equal: no). Both nodes are
    at one step; prefixes that are equal by hash alone were verified."""
    if x is y:
        return tail_x < tail_y
    step = common(x, y).step
    a, b = letters_after(x, step, tail_x), letters_after(y, step, tail_y)
    while True:
        p, q = next(a, ""), next(b, "")
        if p != q or not p:
            return p < q


class Best:
    """The best candidate of each state at one step."""

    def __init__(self):
        self.cells: list[tuple[int, Node, str] | None] = [None] * 4

    def offer(self, state: int, cost: int, before: Node, letters: str) -> None:
        held = self.cells[state]
        if held is None or cost < held[0] or (cost == held[0] and earlier(before, letters, held[1], held[2])):
            self.cells[state] = (cost, before, letters)

    def insert(self) -> None:
        """Empty rows after this step: a user row where one may follow, then an
        assistant's. A third would come back to a state at a higher cost."""
        for source, target in ((NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
            if self.cells[source] is not None:
                cost, before, letters = self.cells[source]
                self.offer(target, cost + INSERT, before, letters + "I")

    def nodes(self) -> list[tuple[int, Node] | None]:
        return [c and (c[0], Node(c[1], c[2], s)) for s, c in enumerate(self.cells)]


def opening() -> list[tuple[int, Node] | None]:
    """The cells before the first row: nothing, or inserted rows."""
    best = Best()
    best.offer(NOTHING, 0, Node(None, "", NOTHING), "")
    best.insert()
    return best.nodes()


def entering(state: int) -> list[tuple[int, Node] | None]:
    """The cells of a piece that is entered in one state."""
    best = Best()
    best.offer(state, 0, Node(None, "", state), "")
    return best.nodes()


def after_row(cells: list[tuple[int, Node] | None], initial: str, fault: str) -> list[tuple[int, Node] | None]:
    best = Best()
    for state, cell in enumerate(cells):
        if cell is None:
            continue
        cost, node = cell
        best.offer(state, cost + DELETE, node, "D")
        if fault not in ("blank", "duplicate"):
            stays = cost + (CUT_OFF if fault == "truncated" else 0)
            kept = STEP.get((state, initial))
            if kept is not None:
                best.offer(kept, stays, node, "K")
            best.offer(ASSISTANT if state == USER else USER, stays + REROLE, node, "R")
    best.insert()
    return best.nodes()


def cheapest(cells: list[tuple[int, Node] | None]) -> tuple[int, Node]:
    """The best cell in which a conversation may end."""
    best = Best()
    for state in (NOTHING, ASSISTANT):
        if cells[state] is not None:
            best.offer(NOTHING, *cells[state], "")
    cost, node, _ = best.cells[NOTHING]
    return cost, node


def rewritten(rows: list[Row], state: int, audit: str) -> list[tuple[str, str]]:
    """(role, text) of the rows after the edits of ``audit``."""
    out, at = [], iter(rows)
    for edit in audit:
        place = "assistant" if state == USER else "user"
        if edit == "I":
            out.append((place, ""))
            state = ASSISTANT if state == USER else USER
            continue
        row = next(at)
        if edit == "K":
            out.append((row.role, row.text))
            state = STEP[state, row.role[:1]]
        elif edit == "R":
            out.append((place, row.text))
            state = ASSISTANT if state == USER else USER
    return out


def plain_fault(text: str) -> str:
    """The fault a row has by itself."""
    end = text.rstrip(SPACE)[-1:]
    return "blank" if not end else "" if end in ".!?" else "truncated"


def faults_of(rows: list[Row], repeated: Iterable[int]) -> list[str]:
    """First fault of each row; ``repeated`` numbers rows seen earlier."""
    out = [plain_fault(r.text) for r in rows]
    for i in repeated:
        if out[i] != "blank":
            out[i] = "duplicate"
    return out


def repeats(rows: list[Row]) -> list[int]:
    seen: set[tuple[str, str]] = set()
    out = []
    for i, r in enumerate(rows):
        if (r.role, r.text) in seen:
            out.append(i)
        seen.add((r.role, r.text))
    return out


def tally(rows: list[Row], faults: list[str]) -> dict:
    """Counts of a run of rows; ends are kept so that runs can be joined."""
    turns = [r.turn for r in rows if r.turn is not None]
    initials = [r.role[:1] for r in rows]
    return {"blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
            "illegal": sum(a + b not in LAWFUL for a, b in zip(initials, initials[1:])), "first_initial": initials[0], "last_initial": initials[-1],
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": sum(a != b for a, b in zip([None, *turns], turns))}


def joined(a: dict | None, b: dict) -> dict:
    if a is None:
        return b
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last_initial"] + b["first_initial"] not in LAWFUL
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    return out | {"first_initial": a["first_initial"], "last_initial": b["last_initial"],
                  "first_turn": b["first_turn"] if a["first_turn"] is None else a["first_turn"], "last_turn": a["last_turn"] if b["last_turn"] is None else b["last_turn"]}


def report(t: dict, cost: int, audit: str) -> list:
    gaps = 0 if t["first_turn"] is None else t["last_turn"] - t["first_turn"] + 1 - t["turns"]
    return [gaps, t["blank"], t["duplicate"], t["truncated"], t["illegal"], cost, audit]


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPORT_FIELDS = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in REPORT.split(", ")]
LINE, LINES = pa.struct([("role", pa.string()), ("text", pa.string())]), "array<struct<role string, text string>>"
ROW, ROWS = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]), "array<struct<turn long, role string, text string>>"
TALLY_NUMBERS = ["blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns"]
TALLY = ", ".join(f"{c} long" for c in TALLY_NUMBERS) + ", first_initial string, last_initial string"
TALLY_FIELDS = [(c, pa.int64()) for c in TALLY_NUMBERS] + [("first_initial", pa.string()), ("last_initial", pa.string())]


def emit(schema: pa.Schema, rows: Iterator[list], most: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[list] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield batch_of(schema, [list(c) for c in zip(*held)])
            held = []
    if held:
        yield batch_of(schema, [list(c) for c in zip(*held)])


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, Row]]:
    """(range, conversation, row) in order, equal rows as often as they occur."""
    for b in batches:
        for at, conv, turn, role, text, n in zip(*(b.column(c).to_pylist() for c in ("range", "conv_id", "turn", "role", "text", "n"))):
            for _ in range(n):
                yield at, conv, Row(turn, role, text)


def solved(batches: Iterator[pa.RecordBatch], piece_rows: int, piece_chars: int) -> Iterator[list]:
    """A row for each conversation that is whole here, with its report and
    lines; a row for each piece of the others, with its rows."""
    held: list[Row] = []
    chars, conv, at, seq, opened = 0, None, 0, 0, True  # the first may have begun in the range before

    def out(whole: bool) -> list:
        if not whole:
            return [at, seq, conv, True, [r._asdict() for r in held], None, *[None] * 7]
        faults = faults_of(held, repeats(held))
        cells = opening()
        for row, fault in zip(held, faults):
            cells = after_row(cells, row.role[:1], fault)
        cost, node = cheapest(cells)
        audit = node.string()
        lines = [{"role": a, "text": b} for a, b in rewritten(held, NOTHING, audit)]
        return [at, seq, conv, False, None, lines, *report(tally(held, faults), cost, audit)]

    for at, c, row in stream(batches):
        if held and (c != conv or len(held) >= piece_rows or chars + len(row.text) > piece_chars):
            more = c == conv
            yield out(whole=not opened and not more)
            opened, seq, held, chars = more, seq + 1, [], 0
        conv = c
        held.append(row)
        chars += len(row.text)
    if held:
        yield out(whole=False)  # it may go on in the next range


class Repaired(NamedTuple):
    reports: DataFrame  # conv_id and REPORT, one row a conversation
    parts: DataFrame  # conv_id, range, seq, alone, lines: repaired rows, in order of (range, seq)


def repair(spark: SparkSession, conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> Repaired:
    """Reports and repaired rows of all conversations."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    ordered = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 256)).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("range", pa.int32()), ("seq", pa.int32()), ("conv_id", pa.int64()), ("open", pa.bool_()), ("rows", pa.list_(ROW)), ("lines", pa.list_(LINE)), *REPORT_FIELDS])
    done = staged(spark, ordered.withColumn("range", F.spark_partition_id()).mapInArrow(
        lambda b: emit(schema, solved(b, piece_rows, piece_chars)), f"range int, seq int, conv_id long, open boolean, rows {ROWS}, lines {LINES}, {REPORT}"), "conversations")
    whole, pieces = done.where("not open"), done.where("open").select("range", "seq", "conv_id", "rows")
    chained = chain(spark, pieces)
    names = ["conv_id"] + [f[0] for f in REPORT_FIELDS]
    reports = whole.select(names).unionByName(chained.where("audit is not null").select(names))
    part_schema = pa.schema([("conv_id", pa.int64()), ("range", pa.int32()), ("seq", pa.int32()), ("alone", pa.bool_()), ("lines", pa.list_(LINE))])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[list]:
            for b in batches:
                for p in b.to_pylist():
                    new = rewritten([Row(**r) for r in p["rows"]], p["state"], p["edits"])
                    yield [p["conv_id"], p["range"], p["seq"], False, [{"role": a, "text": t} for a, t in new]]
        return emit(part_schema, lines(), 8)

    edited = pieces.join(chained.select("range", "seq", "state", "edits"), ["range", "seq"]).mapInArrow(rewrite, f"conv_id long, range int, seq int, alone boolean, lines {LINES}")
    return Repaired(reports, whole.select("conv_id", "range", "seq", F.lit(True).alias("alone"), "lines").unionByName(edited))


def chain(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """(range, seq, conv_id, state, edits) of each piece: the state in which it
    is entered and its part of the audit; the last piece also has the report."""
    keys = pieces.select("conv_id", "range", "seq", F.posexplode("rows").alias("i", "r")).select("conv_id", "range", "seq", "i", F.col("r.role").alias("role"), F.sha2("r.text", 256).alias("digest"))
    first = keys.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("range", "seq", "i")).alias("first"))
    same_key = keys["conv_id"].eqNullSafe(first["conv_id"]) & (keys["role"] == first["role"]) & (keys["digest"] == first["digest"])
    repeated = (keys.join(first, same_key).where(F.struct(keys["range"], keys["seq"], keys["i"]) != F.col("first"))
                .groupBy(keys["range"], keys["seq"]).agg(F.collect_list(keys["i"]).alias("repeated")))  # a piece's rows at most
    schema = pa.schema([("range", pa.int32()), ("seq", pa.int32()), ("conv_id", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), *TALLY_FIELDS])

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of() -> Iterator[list]:
            for b in batches:
                for p in b.to_pylist():
                    rows = [Row(**r) for r in p["rows"]]
                    faults = faults_of(rows, p["repeated"] or [])
                    costs: list[int | None] = []
                    audits: list[str | None] = []
                    for state in range(4):
                        cells = entering(state)
                        for row, fault in zip(rows, faults):
                            cells = after_row(cells, row.role[:1], fault)
                        costs += [c and c[0] for c in cells]
                        audits += [c and c[1].string() for c in cells]
                    t = tally(rows, faults)
                    yield [p["range"], p["seq"], p["conv_id"], costs, audits, *(t[f[0]] for f in TALLY_FIELDS)]
        return emit(schema, of(), 8)

    matrices = pieces.join(repeated, ["range", "seq"], "left").mapInArrow(matrix, f"range int, seq int, conv_id long, costs array<long>, audits array<string>, {TALLY}")
    link_schema = pa.schema([("range", pa.int32()), ("seq", pa.int32()), ("conv_id", pa.int64()), ("state", pa.int32()), ("edits", pa.string()), *REPORT_FIELDS])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of() -> Iterator[list]:
            conv, cells, total, places = None, None, None, []

            def close() -> Iterator[list]:
                cost, node = cheapest(cells)
                nodes = [node]
                while nodes[-1].parent is not None:
                    nodes.append(nodes[-1].parent)
                nodes.reverse()  # the root, the opening, then one a piece
                # rows inserted before the first row belong to the first piece
                steps = [(NOTHING if k == 0 else nodes[k + 1].state, (nodes[1].letters if k == 0 else "") + nodes[k + 2].letters) for k in range(len(places))]
                for k, ((at, seq), (state, edits)) in enumerate(zip(places, steps)):
                    end = report(total, cost, node.string()) if k == len(places) - 1 else [None] * 7
                    yield [at, seq, conv, state, edits, *end]

            for b in batches:
                for p in b.to_pylist():
                    if cells is not None and p["conv_id"] != conv:
                        yield from close()
                        cells = None
                    if cells is None:
                        conv, cells, total, places = p["conv_id"], opening(), None, []
                    best = Best()
                    for source, cell in enumerate(cells):
                        for target in range(4):
                            more = p["costs"][4 * source + target]
                            if cell is not None and more is not None:
                                best.offer(target, cell[0] + more, cell[1], p["audits"][4 * source + target])
                    cells, total = best.nodes(), joined(total, p)
                    places.append((p["range"], p["seq"]))
            if cells is not None:
                yield from close()
        return emit(link_schema, of(), 64)

    linked = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "range", "seq").mapInArrow(link, f"range int, seq int, conv_id long, state int, edits string, {REPORT}")
    return staged(spark, linked, "conversation-chains")


def digests(parts: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines joined by newlines. A
    conversation in several parts is hashed as they stream by."""
    text = F.array_join(F.transform("lines", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of() -> Iterator[list]:
            conv, state, lines = None, None, 0
            for b in batches:
                for c, n, t in zip(*(b.column(x).to_pylist() for x in ("conv_id", "n", "t"))):
                    if state is not None and c != conv:
                        yield [conv, state.hexdigest()]
                        state = None
                    if state is None:
                        conv, state, lines = c, hashlib.sha256(), 0
                    if n:
                        state.update((("\n" if lines else "") + t).encode())
                        lines += n
            if state is not None:
                yield [conv, state.hexdigest()]
        return emit(schema, of())

    cut = parts.where("not alone").select("conv_id", "range", "seq", F.size("lines").alias("n"), text.alias("t"))
    streamed = cut.repartition("conv_id").sortWithinPartitions("conv_id", "range", "seq").mapInArrow(run, "conv_id long, repaired_sha256 string")
    return parts.where("alone").select("conv_id", F.sha2(text, 256).alias("repaired_sha256")).unionByName(streamed)


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults by rule, for trying the repair: crc32 of ``conv_id:turn`` modulo
    20 drops a row (0), empties it (1), takes its sentence ends (2), repeats it
    (3) or gives it the role user (4). Nulls count as one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))).cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return (rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text")))
