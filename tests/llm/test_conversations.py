"""Conversation repair against a memoised search of all edits, over chunks of any length."""

import functools
import hashlib
import random
import zlib

import pytest

pytest.importorskip("cohortspan.llm")

from cohortspan.llm import conversations as cv

WS = " \t\n\x0b\f\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def least(rows):
    """Cheapest (cost, edits) for rows (initial, fault), tried one by one from the last state backwards."""

    @functools.cache
    def best(i, last, inserts):
        found = []
        if inserts < 3:
            c, e = best(i, NEXT[last], inserts + 1)
            found.append((c + 2, "I" + e))
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, ""))
            return min(found, default=(10**9, ""))
        initial, fault = rows[i]
        c, e = best(i + 1, last, 0)
        found.append((c + 3, "D" + e))
        if fault not in ("blank", "duplicate"):
            extra = fault == "truncated"
            if initial and last + initial in ("s", "u", "su", "ua", "au"):
                c, e = best(i + 1, initial, 0)
                found.append((c + extra, "K" + e))
            c, e = best(i + 1, NEXT[last], 0)
            found.append((c + 2 + extra, "R" + e))
        return min(found)

    return best(0, "", 0)


def brute(rows):
    """The contract's columns of one conversation from its damaged rows (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha1(f"{r[1]}\0{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(WS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = least([*zip(initials, faults)]) if rows else (0, "")
    out, last, at = [], "", 0
    for e in audit:
        role, text = (None, "") if e == "I" else rows[at][1:]
        at += e != "I"
        if e == "D":
            continue
        role = role if e == "K" else FULL[NEXT[last]]
        last = role[:1]
        out.append(f"{role}:{text}")
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def hurt(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else x.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "conv_id long, turn long, role string, text string, _n int, _key string, kind int")


def compare(spark, rows, most):
    table = talk(spark, rows).repartition(4)
    got = {r[0]: tuple(r)[1:] for r in cv.report(table, most=most).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r[1:])
    assert set(got) == set(groups)
    for c, g in groups.items():
        assert got[c] == brute(g), (c, got[c], brute(g))
    repaired = {}
    for r in sorted(cv.repair(table, most=most).collect(), key=lambda r: r.position):
        repaired.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.edit in "KRI"
    for c in groups:
        assert hashlib.sha256("\n".join(repaired.get(c, [])).encode()).hexdigest() == got[c][-1]


def speech(rnd):
    return rnd.choice(["Yes.", "No.", "Well", "So it is!", "", " \n", "a?\n", "Go on.", "b ", f"{rnd.randint(0, 99)}."])


def test_edits_in_one_conversation():
    rnd, edits = random.Random(1), cv.Edits()
    for _ in range(400):
        rows = [(rnd.choice("suaax"), rnd.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rnd.randint(0, 9))]
        code = {"": 0, "truncated": cv.TRUNC, "blank": cv.BLANK, "duplicate": cv.DUP}
        codes = bytes("sua".find(i) % 4 | code[f] for i, f in rows)
        audit, state, cost = edits.trace(codes, cv.END, 0)
        assert (cost + cv.END[state], audit + cv.ENDING[state]) == least(rows), rows
    # chunks joined by the vector at the seam give the same edits
    codes = bytes(rnd.choice([0, 1, 2, 1, 2, 3, 5, 9]) for _ in range(60))
    whole = edits.trace(codes, cv.END, 0)
    a, state, c = edits.trace(codes[:31], edits.start(codes[31:], cv.END), 0)
    b, last, d = edits.trace(codes[31:], cv.END, state)
    assert whole == (a + b, last, c + d)


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_repair_matches_brute_force(spark, most):
    rnd = random.Random(most)
    rows = []
    for c in [*range(25), None]:
        for t in range(rnd.randint(1, 7)):
            rows.append((c, rnd.choice([t, t, t, None, 2 * t, -t]), rnd.choice(["user", "assistant", "assistant", "system", "tool", None, ""]), speech(rnd)))
    rows += [(99, t, "user" if t % 2 else "assistant", speech(rnd)) for t in range(60)]  # crosses chunks and ranges
    rows += [(98, t, "system", f"{t}.") for t in range(40)]  # never comes to rank one
    rows += [(97, 5, "user", "The same.")] * 23 + [(96, None, None, None)] * 2
    compare(spark, rows, most)


def test_long_texts_and_empty_table(spark):
    compare(spark, [(1, 0, "user", "long " * 200_000), (1, 1, "assistant", "x" * 500_000 + "."), (2, 0, "assistant", "\t" * 300_000)], None)
    nothing = talk(spark, [(1, 1, "user", "x")]).filter("false")
    assert cv.report(nothing).count() == 0 and cv.repair(nothing).count() == 0
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(cv.report(nothing, talk(spark, [(7, 1, "u", "x"), (None, 1, "u", "x")])).collect()) == {(7, *none), (None, *none)}


def test_damage(spark):
    rows = [(c, t, "assistant", f"Turn {t} of {c}. And? Yes!") for c in range(30) for t in range(5)] + [(None, None, None, None), (5, None, "user", None), (None, 3, None, "x.")]
    key = lambda r: repr(r)
    assert sorted(map(tuple, cv.damage(talk(spark, rows)).collect()), key=key) == sorted(hurt(rows), key=key)
