import hashlib
import itertools
import random
import re
import zlib

import pytest

from sieveline.llm import repair

ROWS = "conv_id bigint, turn bigint, role string, text string, cost string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        found.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """(cost, audit, repaired) by trying every sequence of edits."""
    best = None
    inserts = [[(5 * k, "I" * k, [(r, "") for r in roles]) for roles in itertools.product(["user", "assistant"], repeat=k)] for k in range(3)]
    gaps = [w for ways in inserts for w in ways]
    layers = [gaps]
    for (_, _, role, text), fault in zip(rows, found, strict=True):
        extra = 5 if fault == "truncated" else 0
        ways = [(2, "D", [])]
        if fault not in ("blank", "duplicate"):
            ways += [(extra, "K", [(role, text)]), (1 + extra, "R", [("user", text)]), (1 + extra, "R", [("assistant", text)])]
        layers += [ways, gaps]
    for pick in itertools.product(*layers):
        turns = [t for w in pick for t in w[2]]
        if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in turns)):
            way = (sum(w[0] for w in pick), "".join(w[1] for w in pick), turns)
            best = way if best is None or way[:2] < best[:2] else best
    return best


def told(rows):
    """The contract's columns but for cost, audit and hash."""
    found = faults(rows)
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(found.count(f) for f in repair.FAULTS), illegal)


def random_rows(seed, conversations, most):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "tool", "agent", ""], ["Yes.", "No!", "why", "", "  ", None, "a b?", "Hm… x", " ", "Ja. "]
    return [(c if c else None, r.choice([None, *range(4)]) if r.random() < 0.3 else t, r.choice(roles), r.choice(texts), "clash") for c in range(conversations) for t in range(r.randint(1, most))]


def test_matches_all_edit_sequences(spark):
    rows = random_rows(1, 120, 3)
    found = {r.conv_id: r for r in repair.conversations(spark.createDataFrame(rows, ROWS)).collect()}
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    assert set(found) == set(by_conv)
    for conv, own in by_conv.items():
        mine = damaged(own)
        if len(mine) > 3:
            continue
        cost, audit, turns = cheapest(mine, faults(mine))
        r = found[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == told(mine)
        assert (r.cost, r.audit) == (cost, audit), (mine, r)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()


def whole(rows):
    """The same recursion without settling or pruning: strings in full."""
    states = {"": (0, "", ()), "u": (5, "I", (("user", ""),)), "a": (10, "II", (("user", ""), ("assistant", "")))}
    nexts = {"": "u", "s": "u", "u": "a", "a": "u"}
    for (_, _, role, text), fault in zip(rows, faults(rows), strict=True):
        new, extra = {}, 5 if fault == "truncated" else 0

        def offer(new, to, way):
            if to not in new or way[:2] < new[to][:2]:
                new[to] = way

        for state, (cost, audit, turns) in states.items():
            offer(new, state, (cost + 2, audit + "D", turns))
            if fault not in ("blank", "duplicate"):
                to = nexts[state]
                offer(new, to, (cost + 1 + extra, audit + "R", (*turns, ({"u": "user", "a": "assistant"}[to], text))))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    offer(new, role[:1], (cost + extra, audit + "K", (*turns, (role, text))))
        for state in ("", "s", "a", "u"):
            if state in new:
                cost, audit, turns = new[state]
                to = nexts[state]
                offer(new, to, (cost + 5, audit + "I", (*turns, ({"u": "user", "a": "assistant"}[to], ""))))
        states = new
    return min(w for s, w in states.items() if s in ("", "a"))


@pytest.mark.parametrize("kind", ["mixed", "blank", "alternating", "same role", "truncated"])
def test_long_conversations_settle_and_keep_the_result(kind):
    r = random.Random(kind)
    n = 700
    role = lambda i: r.choice(["user", "assistant", "system"]) if kind == "mixed" else "user" if kind == "same role" or i % 2 == 0 else "assistant"
    text = lambda i: " " if kind == "blank" else f"t{i}" + ("" if kind == "truncated" or (kind == "mixed" and r.random() < 0.2) else ".")
    rows = [(1, i, role(i), text(i)) for i in range(n)]
    one = repair.Repair()
    for row, fault in zip(rows, faults(rows), strict=True):
        one.add(*row[1:], fault == "duplicate")
    got = one.result()
    cost, audit, turns = whole(rows)
    assert got[5:7] == (cost, audit)
    assert got[7] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()
    assert one.settled or kind in ("blank", "same role")


def test_many_batches_and_hot_conversation(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        r = random.Random(9)
        rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "No", f"x{t}.", ""]), "") for t in range(600)] + random_rows(3, 30, 6)
        found = {x.conv_id: x for x in repair.conversations(spark.createDataFrame(rows, ROWS)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for conv in {x[0] for x in rows}:
        mine = damaged([x for x in rows if x[0] == conv])
        if not mine:
            continue
        cost, audit, turns = whole(mine)
        x = found[conv]
        assert (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit) == (*told(mine), cost, audit)
        assert x.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()


def test_dropped_conversations_long_texts_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    stays = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4 and zlib.crc32(f"{c}:1".encode()) % 20 > 4 and c != gone)
    long = "word " * 400_000 + "end."
    rows = [(gone, 0, "user", "Yes.", ""), (stays, 0, "user", long, ""), (stays, 1, "assistant", "Ja.", "")]
    found = {r.conv_id: tuple(r)[1:] for r in repair.conversations(spark.createDataFrame(rows, ROWS)).collect()}
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[stays] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(f"user:{long}\nassistant:Ja.".encode()).hexdigest())
    assert repair.conversations(spark.createDataFrame([], ROWS)).count() == 0
