"""Conversation repair against a plain search of all edits, and the query against its SQL on odd rows."""

import hashlib
import random
import re
from functools import cache

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from verispark.llm import repair
from verispark.llm.files import Stages
from verispark.llm.registry import ORACLES

BLANKS = " \t\n\x0b\f\r"


def brute(rows):
    """Cost and least audit, from the end; more than two insertions at one place are of no use."""
    @cache
    def best(i, q, insertions=2):
        needed = "a" if q == "u" else "u"
        options = [(0, 0, "")] if i == len(rows) and q in "-a" else []
        if insertions:
            options.append((3, "I", best(i, needed, insertions - 1)))
        if i < len(rows):
            options.append((4, "D", best(i + 1, q)))
            if rows[i] != "!":
                more = 3 if rows[i] in "SUA+" else 0
                options.append((3 + more, "R", best(i + 1, needed)))
                if rows[i].lower() == needed or q == "-" and rows[i] in "sS":
                    options.append((more, "K", best(i + 1, rows[i].lower())))
        return min([(cost + rest[0], letter + rest[1]) if letter else (0, "") for cost, letter, rest in options], default=(10 ** 9, ""))

    return best(0, "-")


def test_search_equals_brute_force():
    rng = random.Random(1)
    cases = ["".join(rng.choice("suaSUA-+!") for _ in range(rng.randrange(9))) for _ in range(3000)]
    cases += ["".join(rng.choice("uaUA") for _ in range(30)) for _ in range(100)] + ["", "s", "S", "!", "!!!", "sua", "a", "u", "aaaa", "uuuu", "ssss"]
    for rows in cases:
        assert repair.cheapest(rows) == brute(rows), rows


def test_audits_give_legal_roles():
    rng = random.Random(2)
    for _ in range(500):
        rows = "".join(rng.choice("suaSUA-!") for _ in range(rng.randrange(12)))
        cost, audit = repair.cheapest(rows)
        roles, place, spent = "", 0, 0
        for letter in audit:
            spent += {"K": 0, "R": 3, "D": 4, "I": 3}[letter]
            if letter in "RI":
                roles += "a" if roles.endswith("u") else "u"
            elif letter == "K":
                roles += rows[place].lower()
            if letter != "I":
                assert letter == "D" or rows[place] != "!"
                spent += 3 if letter != "D" and rows[place].isupper() else 0
                place += 1
        assert place == len(rows) and spent == cost and re.fullmatch("(s?(ua)+)?", roles)
        edits = {p: letters for p, letters, _ in repair.edits_by_row(rows, audit)}
        assert "".join(edits.get(p, "K" if p <= len(rows) else "") for p in range(1, len(rows) + 2)) == audit


def test_long_conversation():
    rng = random.Random(3)
    rows = "s" + "".join(rng.choice("uauauauaUA!s") for _ in range(20_000))
    cost, audit = repair.cheapest(rows)
    assert cost > 0 and len(audit) >= 20_001


def odd_rows():
    rng = random.Random(4)
    words = ["Yes.", "No!", "cut off", "", " \t", "a. b? c!", "é🙂.", "Yes. \n", "q?\x0b"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "User"]), rng.choice(words)) for c in range(60) for t in rng.sample(range(2000), rng.randrange(1, 9))]
    rows += [(100, None, "user", "no turn."), (100, 3, None, "x."), (100, 5, "assistant", None), (None, 0, "user", "q."), (None, 1, "assistant", "a"), (101, None, "user", "u."), (101, None, None, None)]
    rows += [(102, 1, "user", "same."), (102, 1, "user", "same."), (102, 1, "user", "same."), (103, 1, "user", "word " * 30_000 + "end."), (103, 2, "assistant", "fine.")]
    rows += [(104, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3000)]
    # Conversations of one row that the damage drops.
    rows += [(200 + k, k % 3, "user", "lonely.") for k in range(80)]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in odd_rows()], "conv_id long, turn long, role string, text string, key string, place int, n int, kind int")


def test_query_on_odd_rows(spark, frame, tmp_path_factory):
    from verispark.llm.queries import op12
    folder = str(tmp_path_factory.mktemp("odd"))
    frame.coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    got = op12(spark, folder).toPandas()
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    want = con.execute(ORACLES["op12_repair"]).fetchdf()
    assert len(got) == len({r[0] for r in odd_rows()}) and (got.audit == "").sum() > 1
    assert differences(got, want) is None


def test_repaired_rows_are_legal_and_digested(spark, frame):
    report, rows = repair.repair(frame, Stages(spark, "t"), 3)
    texts, roles = {}, {}
    for r in rows.collect():
        texts.setdefault(r.key, []).append(f"{r.role}:{r.text}")
        roles[r.key] = roles.get(r.key, "") + r.role[:1]
    assert all(re.fullmatch("s?(ua)+", x) for x in roles.values())
    assert {r.key: r.repaired_sha256 for r in repair.repaired_digests(rows).collect()} == {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in texts.items()}
    assert report.count() == len({r[0] for r in odd_rows()})
    assert report.filter("key = 'n'").first().conv_id is None


def test_damage_kinds(spark):
    import zlib
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)]
    got = repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = {0: [], 1: [(role, "")], 2: [(role, "One Two")], 3: [(role, text)] * 2, 4: [("user", text)]}.get(kind, [(role, text)])
        assert [(r.role, r.text) for r in got if (r.conv_id, r.turn) == (c, t)] == want


def test_empty_table(spark, frame):
    report, rows = repair.repair(frame.filter(F.lit(False)), Stages(spark, "t"), 2)
    assert report.count() == 0 and rows.count() == 0 and repair.repaired_digests(rows).count() == 0


def test_op12_query(spark, sf):
    from verispark.llm.queries import op12
    assert differences(op12(spark, sf).toPandas(), connect(sf).execute(ORACLES["op12_repair"]).fetchdf()) is None
