"""Conversation repair against a plain search over edits."""

import functools
import hashlib
import itertools
import random
import sys
import zlib

import pytest

from placestat.llm.conversations import Rope, damage, repair_conversations, repaired_turns

BLANK = " \t\n\x0b\x0c\r"
sys.setrecursionlimit(20_000)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation's result; every edit sequence is searched from the end."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for _, t, _, _ in rows if t is not None}
    initials = [r[2][:1] for r in rows]
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @functools.cache
    def least(i, state, inserted):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in move:
                    c, e, m = least(i, move[state, role[0]], inserted + 1)
                    options.append((c + 5, "I" + e, ((role, ""), *m)))
        if i < len(rows):
            _, _, role, text = rows[i]
            extra = 5 * (faults[i] == "truncated")
            c, e, m = least(i + 1, state, 0)
            options.append((c + 2, "D" + e, m))
            if faults[i] not in ("blank", "duplicate"):
                for edit, cost, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if (state, new[:1]) in move:
                        c, e, m = least(i + 1, move[state, new[:1]], 0)
                        options.append((c + cost + extra, edit + e, ((new, text), *m)))
        return min(options) if options else (10**9, "", ())

    cost, audit, made = least(0, "", 0)
    pairs = [a + b for a, b in itertools.pairwise(initials)]
    count = lambda x: faults.count(x)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return gaps, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest


def brute(damaged, ids):
    out = []
    for c in set(ids):
        out.append((str(c), *plain_repair([r for r in damaged if r[0] == c])))
    return sorted(out)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def result(df):
    return sorted((str(r[0]), *r[1:]) for r in df.select(NAMES).collect())


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(11)
    rows = []
    for c in [*range(150), None]:
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "summary"])
            text = rng.choice(["Fine.", "Fine!", "cut off", " \t ", "", None, "Why?\n", "more and", "Ünï. ", "x"])
            rows.append((c, rng.choice([None, 0, 1, 2, 3, 5, 9]), role, text))
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_odd_rows_match_a_plain_search(spark, odd, chunk):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in odd]
    got = repair_conversations(spark.createDataFrame(odd, SCHEMA), chunk=chunk)
    assert result(got) == brute(rows, [r[0] for r in odd])


def test_given_conversations_damaged(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert result(repair_conversations(damage(df), df.select("conv_id"))) == brute(plain_damage(rows), [r[0] for r in rows])


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} {t}.") for c in range(40) for t in range(1 + c % 3)] + [(None, None, None, None), (3, None, "user", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(str, damage(df).collect())) == sorted(map(str, spark.createDataFrame(plain_damage(rows), SCHEMA).collect()))
    got = result(repair_conversations(damage(df), df.select("conv_id")))
    assert got == brute(plain_damage(rows), [r[0] for r in rows])
    assert any(r[-1] == hashlib.sha256(b"").hexdigest() for r in got)


def test_long_conversation_and_repaired_rows(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", ""]) + f"{t}" * rng.randrange(2) + rng.choice(".x")) for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, [1])
    assert result(repair_conversations(df, chunk=64)) == want
    made = sorted(repaired_turns(df, chunk=64).collect(), key=lambda r: r.position)
    assert [r.position for r in made] == list(range(1, len(made) + 1))
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in made).encode()).hexdigest() == want[0][-1]
    assert "".join(r.edit for r in made) == want[0][-2].replace("D", "")


def test_empty_table_and_clashing_columns(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 1), (1, 1, "assistant", "Ho.", "y", 2)], SCHEMA + ", audit string, pos int")
    assert [(r.audit, r.cost) for r in repair_conversations(df).collect()] == [("KK", 0)]


def test_ropes_order_like_strings():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choice("DK") for _ in range(rng.randrange(12))) for _ in range(2))
        cut = lambda s: functools.reduce(lambda x, y: x + y, (Rope(s[i : i + 2]) for i in range(0, len(s), 2)), Rope())
        whole = lambda s: Rope(s[: len(s) // 2]) + Rope(s[len(s) // 2 :])
        assert (cut(a) < whole(b)) == (a < b) and str(cut(a)) == a
