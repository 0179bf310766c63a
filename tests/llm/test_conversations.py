"""Conversation repair against a plain search over all edits, with cut conversations and odd rows."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from wayfold.llm import conversations, queries

ROLES = {"s": "system", "u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"


def repaired_by_search(rows):
    """Least (cost, audit) with its messages, by growing all best partial edits row by row."""
    seen, counts, states = set(), dict(blank=0, duplicate=0, truncated=0), {"": (0, "", ())}

    def with_insertions(found):
        out = dict(found)
        for _ in range(2):
            for state, (cost, audit, made) in list(out.items()):
                role = "a" if state == "u" else "u"
                item = (cost + 5, audit + "I", (*made, (ROLES[role], "")))
                out[role] = min(out.get(role, item), item, key=lambda x: x[:2])
        return out

    for role, text in rows:
        body = text.strip(WHITE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        new = {}
        # Insertions are tried as whole audits here: every way to insert, then every letter.
        for state, (cost, audit, made) in states.items():
            at, extra = state, ()
            for n in range(3):
                options = [("D", at, 2, ())]
                if fault in ("", "truncated"):
                    more = 5 if fault else 0
                    fits = "a" if at == "u" else "u"
                    options.append(("R", fits, 1 + more, ((ROLES[fits], text),)))
                    c = role[:1]
                    if (c == "s" and at == "") or (c == "u" and at in ("", "s", "a")) or (c == "a" and at == "u"):
                        options.append(("K", c, more, ((role, text),)))
                for letter, to, price, own in options:
                    item = (cost + 5 * n + price, audit + "I" * n + letter, made + extra + own)
                    if to not in new or item[:2] < new[to][:2]:
                        new[to] = item
                fits = "a" if at == "u" else "u"
                at, extra = fits, (*extra, (ROLES[fits], ""))
        states = new
    ended = [v for k, v in with_insertions(states).items() if k in ("", "a")]
    return counts, min(ended, key=lambda x: x[:2])


def brute(rows):
    groups, names = {}, {}
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        names.setdefault(conv, [])
        m = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        role = "user" if m == 4 else role
        names[conv] += [(turn, role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    out = []
    for conv, own in names.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        counts, (cost, audit, made) = repaired_by_search([r[1:] for r in own])
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha))
    del groups
    return sorted(out, key=str)


def conversation(rnd, conv, n):
    words = ["yes.", "no", "what?", " ", "\t\x0b", "Ok!", "so. \n", "née…", "a. b"] + [f"word {i}." for i in range(n)]
    return [(conv, rnd.randint(0, 2 * n) if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", "system", "tool", "u", None, ""]), rnd.choice(words)) for _ in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string, grp string, audit int, seq int"


@pytest.mark.parametrize("case", ["many", "empty"])
def test_repair_query(spark, tmp_path, case):
    rnd = random.Random(5)
    rows = [r for i in range(150) for r in conversation(rnd, i, rnd.randint(1, 12))] if case == "many" else []
    rows += conversation(rnd, None, 40) + [(500, 3, "user", "same.")] * 30 + [(501, 1, "user", "long " * 50_000)] if rows else []
    rnd.shuffle(rows)
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op12(spark, str(tmp_path))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_long_conversations_in_chunks(spark):
    """One conversation over many chunks and tasks, others around it; chunks of 16 rows."""
    rnd = random.Random(9)
    rows = [(c, t, r or "x", x) for c, n in ((1, 3), (2, 900), (3, 40), (4, 1)) for _, t, r, x in conversation(rnd, c, n)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    repaired = conversations.repair(table, chunk_rows=16)
    assert repaired.where("not whole").count() > 40
    got = {r["conv_id"]: r for r in conversations.report(repaired).collect()}
    made = {}
    for r in conversations.messages(repaired).orderBy("conv_id", "part", "seq", "place").collect():
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv in (1, 2, 3, 4):
        own = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        counts, (cost, audit, messages) = repaired_by_search([r[1:] for r in own])
        turns = [r[0] for r in own if r[0] is not None]
        assert (got[conv].cost, got[conv].audit, made.get(conv, [])) == (cost, audit, list(messages))
        assert (got[conv].blank, got[conv].duplicate, got[conv].truncated) == tuple(counts.values())
        assert got[conv].gaps == max(turns) - min(turns) + 1 - len(set(turns))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in messages))


def test_crossings_are_least_in_cost_and_audit():
    """Every run of up to four rows, against trying all ways through the table."""
    for n in range(1, 5):
        for kinds in product((0, 1, 2, 5, 6, 8), repeat=n):
            whole = (*kinds, conversations.END)
            ways = [((0, ""), 0)]
            for kind in whole:
                ways = [((c + price, a + letters), q) for (c, a), p in ways for (s, q), (price, letters) in conversations.MOVES[kind].items() if s == p]
            best = min(w for w, q in ways if q == conversations.START)
            states = conversations.solve(bytes(whole), 0, 0)
            steps = [conversations.MOVES[k][p, q] for k, p, q in zip(whole, states, states[1:])]
            assert (sum(s[0] for s in steps), "".join(s[1] for s in steps)) == best
