"""The prefix tree of conversations against a plain trie and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from scholarlens.llm import conversations as C
from scholarlens.llm.queries import ORACLES, op11_prefix_tree

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256"]


def plain(rows, family=100, heads=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    members = defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        seq = tuple(own.get(c - c % family, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
    full = {k: set(v) for k, v in members.items()}
    kids, out = defaultdict(list), []
    for k in full:
        if k:
            kids[k[:-1]].append(k)

    def below(k):
        mine = (len(full[k]) - 1) * len(k[-1][1]) if k else 0
        found = [below(x) for x in kids[k]]
        result = (max(1, sum(x[0] for x in found)), mine + sum(x[1] for x in found))
        ends = full[k] - set().union(*[full[x] for x in kids[k]])
        out.append((min(full[k]), len(k), min(full[k[:-1]]) if k else None, len(full[k]),
                    len(kids[k]), *result, hashlib.sha256(
                        ",".join(map(str, sorted(ends))).encode()).hexdigest()))
        return result

    if full:
        below(())
    key = lambda r: (r[1], r[0])
    return sorted(out, key=key)


def got(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=lambda r: (r[1], r[0]))


def made(seed, n, longest):
    """Conversations over few distinct turns: many equal, nested and absent beginnings."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(0, 40), rng.randrange(90, 330), 10 ** 12 + rng.randrange(5)])
        for _ in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([None, *range(longest)]), rng.choice(["u", "a", None, "ua"]),
                         rng.choice(["", None, "x", "ax", "é😀", "long text"])))
    return rows + rows[:20]


@pytest.mark.parametrize("seed", range(3))
def test_made_conversations(spark, seed):
    rows = made(seed, 120, 9) + [(None, 1, "u", "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(C.prefix_tree(*C.rebuilt(frame))) == plain(rows)


def test_small_stretches_packs_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 3)
    monkeypatch.setattr(C, "PACK", 2)
    rows = made(7, 60, 9) + [(500, i, "u", str(i % 3)) for i in range(200)]
    rows += [(501, i, "u", str(i % 3)) for i in range(150)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(C.prefix_tree(*C.rebuilt(frame))) == plain(rows)


def test_turnless_member_and_other_names(spark):
    # h is 2 for conversation 7: its only turn goes, and its family's first is absent
    only = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(only, 0, "u", "x", 1), (200, 0, "u", "y", 1)]
    frame = spark.createDataFrame(rows, "place long, size long, conv string, a string, k1 long")
    tree = C.prefix_tree(*C.rebuilt(frame, "place", "size", "conv", "a"))
    assert got(tree) == plain([r[:4] for r in rows])


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert C.prefix_tree(*C.rebuilt(frame)).count() == 0


def test_query_equals_sql_and_plain(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{sf}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_prefix_tree']})").fetchall()
    found = got(op11_prefix_tree(spark, sf))
    assert found == sorted(want, key=lambda r: (r[1], r[0]))
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert found == plain(rows)
