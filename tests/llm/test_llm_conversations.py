"""Repair of conversations against brute force: dynamic programming over edit strings, row by row."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallytree.llm import parallel_viterbi as pv

from conftest import rows

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def strike(data):
    out = []
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(talk):
    seen, out = set(), []
    for _, role, text in talk:
        solid = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(talk, found):
    """(cost, audit, lines) by a table of best rests, as strings."""
    asks = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    keeps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    roles = {"u": "user", "a": "assistant"}

    def inserted(base):
        best = list(base)
        for _ in range(4):
            for q in range(4):
                initial, to = asks[q]
                best[q] = min(best[q], (best[to][0] + 2, "I" + best[to][1], (roles[initial] + ":",) + best[to][2]))
        return best

    none = (10**9, "", ())
    best = inserted([(0, "", ()), none, none, (0, "", ())])
    for (_, role, text), fault in zip(reversed(talk), reversed(found)):
        row = []
        for q in range(4):
            options = [(best[q][0] + 3, "D" + best[q][1], best[q][2])]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                to = keeps.get((q, role[:1]))
                if to is not None:
                    options.append((best[to][0] + extra, "K" + best[to][1], (f"{role}:{text}",) + best[to][2]))
                initial, to = asks[q]
                options.append((best[to][0] + 2 + extra, "R" + best[to][1], (f"{roles[initial]}:{text}",) + best[to][2]))
            row.append(min(options))
        best = inserted(row)
    return best[0]


def brute(conversations, data):
    talks = {c: [] for c in conversations}
    for conv, turn, role, text in data:
        talks[conv].append((turn, role, text))
    out = []
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:1], hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
        found = faults(talk)
        turns = [t for t, _, _ in talk if t is not None]
        cost, audit, lines = cheapest(talk, found)
        assert GRAMMAR.match("".join(x[0] for x in lines))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(x) for x in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


def talks(n, length, seed=4, roles=("user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "Über")):
    r = random.Random(seed)
    texts = ["Fine.", "Yes!", "what?  \n", "open end", "", " \t", None, "ü. é", "A. B. C"]
    out = []
    for c in range(n):
        for k in range(r.randint(1, length)):
            turn = r.choice([k, k, k, k + r.randint(0, 3), None])
            text = r.choice([*texts, f"Text {c} {k}.", f"Text {c} {k}."])
            out.append((c if c else None, turn, r.choice(roles) if r.random() < 0.5 else ("user", "assistant")[k % 2], text))
    return out


def test_brute_force_is_the_least_of_all_edits():
    """On short conversations, every sequence of edits is tried."""
    r = random.Random(1)
    for _ in range(60):
        talk = [(i, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b.", "", "c"])) for i in range(r.randint(0, 3))]
        found, seen = faults(talk), []
        for extra in itertools.product(range(3), repeat=len(talk) + 1):
            for kinds in itertools.product("DKR", repeat=len(talk)):
                for roles in itertools.product("ua", repeat=len(talk)):
                    word, audit, cost, free = "", "", 0, 0
                    for i, (row, fault, kind, role) in enumerate(zip(talk, found, kinds, roles)):
                        word, audit, cost, free = word + "?" * extra[i], audit + "I" * extra[i] + kind, cost + 2 * extra[i], free + extra[i]
                        if kind != "D" and fault in ("blank", "duplicate"):
                            cost = 10**6
                        cost += {"D": 3, "K": 0, "R": 2}[kind] + (kind != "D" and fault == "truncated")
                        word += {"D": "", "K": row[1][0], "R": role}[kind]
                    word, audit, cost = word + "?" * extra[-1], audit + "I" * extra[-1], cost + 2 * extra[-1]
                    for fill in itertools.product("ua", repeat=word.count("?")) if cost < 20 else ():
                        letters = iter(fill)
                        if GRAMMAR.match("".join(next(letters) if x == "?" else x for x in word)):
                            seen.append((cost, audit))
        assert min(seen) == cheapest(talk, found)[:2]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_repair_equals_brute_force(spark, chunk):
    data = talks(60, 9) + [(100, k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(70)] + [
        (101, k, "user", "same.") for k in range(40)] + [(102, k, "user" if k % 3 else "assistant", f"t{k // 2}" + "." * (k % 2)) for k in range(90)]
    given = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(1) for c in ("pos", "segment", "key", "codes")}).repartition(4)
    struck = strike(data)
    assert rows(pv.damaged(given)) == sorted(struck, key=lambda t: tuple((v is None, str(v)) for v in t))
    out = pv.repaired(given, pv.damaged(given), chunk)
    assert rows(out, *COLUMNS) == brute({r[0] for r in data}, struck)


def test_fix_up_equals_a_run_from_the_true_end():
    r = random.Random(3)
    steps = pv.Steps()
    reruns = 0
    for _ in range(300):
        codes = bytes(r.choice([0, 1, 2, 3, 4, 7, 8]) for _ in range(r.randint(1, 60)))
        right = steps.back((0, 4, 2, 0), r.choice([2, 3, 4, 8]))[0]
        fixed, again = steps.fix_up(codes, steps.run(codes, (0, 0, 0, 0)), right)
        assert fixed == steps.run(codes, right)
        reruns += again / len(codes) / 300
    assert reruns < 0.6  # most segments agree after some rows


def test_empty_conversations_and_tables(spark):
    given = spark.createDataFrame([(1, 1, "user", "a."), (None, None, None, None)], SCHEMA)
    out = rows(pv.repaired(given, given.limit(0)), *COLUMNS)
    empty = hashlib.sha256(b"").hexdigest()
    assert out == [(1, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)]
    assert pv.repaired(given.limit(0), given.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 1, "user", "word " * 500_000 + "."), (1, 2, "assistant", "y" * 1_000_000)], SCHEMA)
    got = pv.repaired(long, long).first()
    assert (got.audit, got.cost, got.truncated) == ("KK", 1, 1)
