import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.llm import conversation, queries

#: columns whose names the operator uses inside, too
SCHEMA = "conv_id long, turn long, role string, text string, n long, range int, seq int, rows string, lines string, kind int, state int"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def edits(rows, faults, audit):
    """(cost, lines) of an audit, None if it does not fit."""
    cost, lines, at = 0, [], 0
    for e in audit:
        if e == "I":
            cost, place = cost + 5, "assistant" if lines and lines[-1][0][:1] == "u" else "user"
            lines.append((place, ""))
            continue
        _, role, text = rows[at]
        if e != "D":
            if faults[at] in ("blank", "duplicate"):
                return None
            cost += 5 * (faults[at] == "truncated")
            lines.append((role if e == "K" else "assistant" if lines and lines[-1][0][:1] == "u" else "user", text))
        cost += {"D": 2, "R": 1, "K": 0}[e]
        if e == "K" and not role:
            return None
        at += 1
    fits = re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
    return (cost, lines) if fits else None


def all_audits(rows, faults):
    """Cheapest audit by trying every one with up to two inserts in a place."""
    best = None
    for letters in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * gaps[0] + "".join(c + "I" * g for c, g in zip(letters, gaps[1:]))
            got = edits(rows, faults, audit)
            if got and (best is None or (got[0], audit) < best[:2]):
                best = (got[0], audit, got[1])
    return best


def by_strings(rows, faults):
    """The same by a DP over whole strings, for longer conversations."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    cells = {0: (0, "")}

    def grown(cells):
        for a, b in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if a in cells:
                cells[b] = min(cells.get(b, (1 << 60, "")), (cells[a][0] + 5, cells[a][1] + "I"))
        return cells

    cells = grown(cells)
    for (_, role, _), fault in zip(rows, faults):
        new = {}
        for s, (cost, audit) in cells.items():
            options = [(s, cost + 2, "D")]
            if fault not in ("blank", "duplicate"):
                more = cost + 5 * (fault == "truncated")
                options.append((3 if s == 2 else 2, more + 1, "R"))
                if (s, role[:1]) in step:
                    options.append((step[s, role[:1]], more, "K"))
            for t, c, e in options:
                new[t] = min(new.get(t, (1 << 60, "")), (c, audit + e))
        cells = grown(new)
    cost, audit = min(cells[s] for s in (0, 3) if s in cells)
    return cost, audit, edits(rows, faults, audit)[1]


def expected(table, solve):
    """conv_id -> the query's other columns, from damaged (conv, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in table:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, turns = plain_faults(rows), [t for t, _, _ in rows if t is not None]
        cost, audit, lines = solve(rows, faults)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def got_of(spark, table, **options):
    df = spark.createDataFrame([(*r, 1, 2, 3, "x", "y", 4, 5) for r in table], SCHEMA).repartition(5)
    repaired = conversation.repair(spark, df, **options)
    hashes = {r[0]: r[1] for r in conversation.digests(repaired.parts).collect()}
    rows = repaired.reports.collect()
    assert len(rows) == len(hashes)
    return {r[0]: (*r[1:], hashes[r[0]]) for r in rows}


def random_table(seed, convs, most):
    r = random.Random(seed)
    return [(c, r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "u", "", None, "tool"][:r.choice([3, 7])]), r.choice(["A b.", "A b", "c!", "", " \t", None, f"x{r.random()}?"]))
            for c in range(convs) for _ in range(r.randint(1, most))]


def test_against_every_audit(spark):
    table = random_table(1, 60, 4)
    assert got_of(spark, table) == expected(table, all_audits)


@pytest.mark.parametrize("piece_rows", [1, 3, 1024])
def test_long_conversations_in_pieces(spark, piece_rows):
    """Pieces, borders of ranges and one conversation of most rows change nothing."""
    r = random.Random(7)
    table = random_table(2, 25, 12) + [(1000, t % 250, r.choice(["user", "assistant"]), r.choice(["ok.", f"t{t}.", f"t{t}", ""])) for t in range(400)]
    table += [(None, 3, "user", "hello."), (None, None, "assistant", "yes."), (7777, 1, "user", "same.")] + [(7778, 2, "assistant", "twice.")] * 40
    assert got_of(spark, table, piece_rows=piece_rows) == expected(table, by_strings)


def test_pieces_by_characters(spark):
    table = [(5, t, "user" if t % 2 == 0 else "assistant", "word " * 3000 + f"{t}.") for t in range(9)]
    assert got_of(spark, table, piece_chars=20_000) == expected(table, by_strings)


def test_colliding_hashes_change_nothing(monkeypatch):
    """With a modulus of 3 nearly every hash collides; letters then decide."""
    monkeypatch.setattr(conversation, "MODULUS", 3)
    for seed in range(60):
        r = random.Random(seed)
        rows = [conversation.Row(t, r.choice(["user", "assistant", "system", "x"]), r.choice(["a.", "b", f"c{t}.", ""])) for t in range(r.randint(1, 40))]
        faults = conversation.faults_of(rows, conversation.repeats(rows))
        cells = conversation.opening()
        for row, fault in zip(rows, faults):
            cells = conversation.after_row(cells, row.role[:1], fault)
        cost, node = conversation.cheapest(cells)
        assert (cost, node.string()) == by_strings(rows, faults)[:2]


def test_empty_table(spark):
    assert got_of(spark, []) == {}


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def test_query(spark, tmp_path):
    given = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{given}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(None, None, None, None), (None, 2, "user", None), (90_000, None, "user", "x."), *((90_001, t, "user", "y.") for t in range(40))]
    lost = next(c for c in range(91_000, 99_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "gone."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = expected(damaged(rows), by_strings)
    want |= {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows} - set(want)}
    assert lost in want
    collected = got.collect()
    assert len(collected) == len(want) and {r[0]: tuple(r)[1:] for r in collected} == want


def test_no_null_in_result(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op12_conversation_repair(spark, str(tmp_path)).where(F.lit(True)).count() == 0
