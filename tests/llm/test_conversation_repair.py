"""Against a search over all edits, long conversations in settled parts, the SQL on odd rows, and the grammar's tables."""

import hashlib
import itertools
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quietwire.llm import conversation_repair as R
from quietwire.llm.queries import SQL


def cheapest(turns):
    """(cost, audit, lines) by trying every edit of every turn and every insertion (turns: role, text, must_go, truncated)."""
    best = None
    choices = []
    for role, text, must_go, truncated in turns:
        extra = 5 if truncated else 0
        own = [("D", 2, None)]
        if not must_go:
            own += [("K", extra, f"{role}:{text}"), ("R", 1 + extra, f"user:{text}"), ("R", 1 + extra, f"assistant:{text}")]
        choices.append(own)
    inserted = [(), ("user:",), ("assistant:",), ("user:", "assistant:"), ("assistant:", "user:")]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(inserted, repeat=len(turns) + 1):
            cost, audit, lines = 0, "", []
            for i, gap in enumerate(gaps):
                cost, audit, lines = cost + 5 * len(gap), audit + "I" * len(gap), lines + list(gap)
                if i < len(edits):
                    edit, price, line = edits[i]
                    cost, audit, lines = cost + price, audit + edit, lines + ([line] if line is not None else [])
            if re.fullmatch("(s?(ua)+)?", "".join(line[:1] if not line.startswith(":") else "?" for line in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def walked(turns):
    said = []
    repair = R.Repair(lambda edit, role, text: said.append(None if role is None else f"{role}:{text}"))
    for turn in turns:
        repair.read(*turn)
    cost, audit = repair.end()
    return cost, audit, [s for s in said if s is not None]


turn = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["x", "y."]), st.booleans(), st.booleans())


@settings(max_examples=60, deadline=None)
@given(st.lists(turn, max_size=3))
def test_cheapest_repair(turns):
    assert walked(turns) == cheapest(turns)


@settings(max_examples=60, deadline=None)
@given(st.lists(turn, max_size=60), st.integers(1, 7))
def test_settling_changes_nothing(turns, every):
    expected = walked(turns)
    held, R.SETTLE = R.SETTLE, every
    try:
        assert walked(turns) == expected
    finally:
        R.SETTLE = held


def test_long_conversation_keeps_a_short_stack():
    repair = R.Repair(lambda *_: None)
    longest = 0
    for i in range(20_000):
        repair.read("user" if i % 2 == 0 or i % 97 == 0 else "assistant", f"t{i}.", i % 31 == 0, i % 13 == 0)
        longest = max(longest, max(len(p.audit) for p in repair.tops.values()))
    assert longest < 4 * R.SETTLE and len(repair.tops) <= 8
    assert len(repair.end()[1]) >= 20_000


def test_grammar_of_unbounded_stacks_is_refused():
    with pytest.raises(ValueError):
        R.RoleTables({"C": ("T",), "T": ("uTa", "ua")})


def test_imitation_prices():
    state = {roles: R.TABLES.kind[stack] for roles, stack in (("", (0,)), ("s", R.TABLES.next((0,), "s")), ("u", R.TABLES.next((0,), "u")))}
    pairs = R.TABLES.kind[R.TABLES.next(R.TABLES.next((0,), "u"), "a")]
    assert len(set(R.TABLES.kind.values())) == 4
    assert R.TABLES.imitation[pairs, state[""]] == 2 and R.TABLES.imitation[state["u"], pairs] == 5 and R.TABLES.imitation[pairs, state["s"]] == 0


ROWS = [
    (1, 0, "system", "s."), (1, 1, "user", "a?"), (1, 2, "assistant", "b."), (1, 4, "user", "a?"), (1, 5, "assistant", "open"),
    (2, 0, "assistant", "x."), (2, 0, "assistant", "x."), (2, None, "user", "y!"), (2, 3, None, None), (2, 3, "tool", "\t\n"),
    (None, None, None, None), (None, 2, "user", "z.\n "), (3, 7, "user", "only."), (4, 0, "", "."), (5, 0, "user", "q" * 300_000 + "."), (5, 1, "assistant", " ")]
ROWS += [(100 + i, t, r, x) for i in range(40) for t, (r, x) in enumerate([("system", "a."), ("user", "b c! d."), ("assistant", "e."), ("user", "f"), ("assistant", "g?")][i % 2:])]


def test_report_equals_its_sql(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as kind", "'x' as seen", "turn as place", "'k' as _key", "7 as _salt")
    report = R.repair_report(R.damaged(df.repartition(5)))
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", ROWS)
    cursor = con.execute(SQL["op12_conversation_repair"])
    order = [d[0] for d in cursor.description]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r[c] for c in order) for r in report.collect()), key=key) == sorted(cursor.fetchall(), key=key)
    assert set(r.conv_id for r in report.collect()) == {r[0] for r in ROWS}
    assert R.repair_report(R.damaged(df.limit(0))).collect() == []


def test_dropped_conversation_and_edits(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "hi.")], "conv_id long, turn long, role string, text string")
    row = R.repair_report(R.damaged(df)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    plain = spark.createDataFrame([(1, 2, "assistant", "b."), (1, 1, "user", "a."), (1, 3, "assistant", "a."), (1, 4, "user", "end.")], df.schema)
    assert [tuple(r) for r in R.repaired(plain).orderBy("place").collect()] == [
        (1, 0, "K", "user", "a."), (1, 1, "K", "assistant", "b."), (1, 2, "R", "user", "a."), (1, 3, "R", "assistant", "end.")]
    assert R.repair_report(plain).first().audit == "KKRR"
