import hashlib
import random
import re

from sieveline.llm import pii

DOCS = "doc_id bigint, text string, n_chars bigint, start string"
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(rows, found):
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, text, *_ in rows:
        want, r = plain_spans(text), by_id[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PLAIN]
        assert set(want) <= set(r.spans.split(",")) | {""} - ({""} if want else set())
        assert (r.n_added > 0) == (len(r.spans.split(",")) > len(want) and r.spans != "")


def test_edges(spark):
    texts = [
        None, "", "a@b.c", "a@b.c._x@d.e", "x@y.z@q.r.s", "..a@b-.c-d..", "a@b", "@b.c", "a@b.c.", "é😀 a.b+c@d-e.f ü",
        "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.003.255 9", "1.2.3", "1.2.3.4.5", "12.34.56.7890",
        "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111  1111 1111 1111", "41111111111111112", "0000000000000000000 1",
        "+1 (213) 555-0199", "+12345678", "+1234567", "+1 2 3 4 5 6 7 8.", "++49 30 123456-", "+1 (555) 123-4567 +44 20 7946 0958", "+1234567890123456",
        "mail me.x@y.zz or 10.0.0.1 or +1 555 123 4567 or 4539578763621486",
    ]
    rows = [(i, t, None, "clash") for i, t in enumerate(texts)]
    check(rows, pii.pii(spark.createDataFrame(rows, DOCS)).collect())


def test_random_text(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choices("a1 2.@+-()5,é0", k=r.randint(1, 300))), 1, "") for i in range(300)]
    check(rows, pii.pii(spark.createDataFrame(rows, DOCS)).collect())


def test_many_matches_and_repeats(spark):
    rows = [(1, "z a@b.cc " * 3000, 1, ""), (2, "4" * 40000 + "@", 1, ""), (3, "a" * 40000 + " a.b@" + "c." * 9000, 1, "")]
    check(rows, pii.pii(spark.createDataFrame(rows, DOCS)).collect())
    assert pii.pii(spark.createDataFrame(rows[:1] * 3, DOCS)).count() == 3
    assert pii.pii(spark.createDataFrame([], DOCS)).count() == 0


def valid_card(r):
    while True:
        n = "".join(r.choices("0123456789", k=16))
        if luhn(n):
            return n


def test_contexts_find_the_unseen(spark):
    r = random.Random(9)
    rows = [(i, f"please charge cardno {valid_card(r)} for order {r.randint(10**7, 10**8)} now", 1, "") for i in range(12)]
    rows.append((100, "please charge cardno 4111111111111112 for nothing", 1, ""))
    rows.append((101, "the serial 4111111111111113 is not one", 1, ""))
    found = {x.doc_id: x for x in pii.pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[100].spans == "card:21:37" and found[100].n_card == 0 and found[100].n_added == 1
    assert found[101].spans == ""
    assert all(found[i].n_added == 0 for i in range(12))


def test_redaction(spark):
    rows = [(1, "write a@b.cc or +1 555 123 4567!", 32, "x"), (2, None, None, None), (3, "nothing 12", 10, "y"), (4, "4539578763621486", 16, "")]
    found = {x.doc_id: x for x in pii.redact(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[1].text == "write <EMAIL> or <PHONE>!" and found[1].n_chars == 25 and found[1].start == "x"
    assert found[2].text is None and found[3].text == "nothing 12" and found[4].text == "<CARD>"


def plain_bootstrap(rows, s=pii.Bootstrap()):
    """Added spans of texts whose words stand alone, one value a text at most:
    the graph as dictionaries."""
    found, words = [], {}
    for i, text in rows:
        parts = text.split(" ")
        for w in parts:
            words[w.lower()] = words.get(w.lower(), 0) + 1
        base = [x.split(":") for x in plain_spans(text)]
        for at, w in enumerate(parts):
            start = len(" ".join(parts[:at])) + (at > 0)
            kind = next((k for k, a, b in base if (int(a), int(b)) == (start, start + len(w))), "")
            if kind or (len(w) >= 6 and (sum(c.isdigit() for c in w) >= 4 or "@" in w)):
                left, right = parts[at - 1].lower() if at else "", parts[at + 1].lower() if at + 1 < len(parts) else ""
                outline = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", w))
                found.append((i, start, start + len(w), kind, w, [("L", left, outline), ("R", right, outline)] + ([("l", left)] if left else []) + ([("r", right)] if right else [])))
    accepted = {}
    while True:
        values, places = {}, {}
        for _, _, _, kind, w, patterns in found:
            for p in patterns:
                k = kind or accepted.get(w, "")
                values.setdefault(p, {}).setdefault(k, set()).add(w)
                places.setdefault(p, {})[k] = places.setdefault(p, {}).get(k, 0) + 1
        trusted = {}
        for p, by in values.items():
            n, _, kind = max([(len(v), places[p][k], k) for k, v in by.items() if k], default=(0, 0, ""))
            trust = min(1.0, places[p][kind] / words[p[1]]) if p[0] in "lr" and kind else n / sum(map(len, by.values()))
            if n >= s.least_values and trust >= s.pattern_trust:
                trusted[p] = (kind, trust)
        fresh = {}
        for w in {w for _, _, _, kind, w, _ in found if not kind and w not in accepted}:
            scores = {}
            for p in {tuple(p) for _, _, _, kind, v, patterns in found if v == w and not kind for p in patterns} & set(trusted):
                scores[trusted[p][0]] = scores.get(trusted[p][0], 1.0) * (1.001 - trusted[p][1])
            best = max([(round(1 - v, 6), k) for k, v in scores.items()], default=(0, ""))
            if best[0] >= s.value_trust:
                fresh[w] = best[1]
        if not fresh:
            return {(i, f"{accepted[w]}:{a}:{b}") for i, a, b, kind, w, _ in found if not kind and w in accepted}
        accepted |= fresh


def test_planted_contexts_against_a_plain_bootstrap(spark):
    """Values of forms that no seed has, behind cues that many seeds have, over
    several rounds; cues that name other things too stay untrusted."""
    r = random.Random(21)
    filler = [f"word{c}" for c in "abcdefghijkl"]
    rows, planted = [], set()
    for i in range(600):
        pad = r.choices(filler, k=4)
        kind = r.randrange(40)
        number = "".join(r.choices("123456789", k=7))
        if kind < 20:
            value, cue, hidden = f"+1555{number}", "call", False
        elif kind == 20:
            value, cue, hidden = f"{number[:3]}-{number[3:]}", "call", True
        elif kind < 24:  # the outline is learned from the last cue's values
            value, cue, hidden = f"{number[:3]}-{number[3:]}", "dial", True
        elif kind == 24:
            value, cue, hidden = f"u{number}@localhost", "mail", True
        elif kind < 38:
            value, cue, hidden = f"u{number}@some.org", "mail", False
        else:
            value, cue, hidden = f"SN{number}", "serial", False
        text = " ".join([*pad[:2], cue, value, *pad[2:]])
        rows.append((i, text))
        if hidden and cue != "dial":
            planted.add(i)
    want = plain_bootstrap(rows)
    found = pii.pii(spark.createDataFrame([(i, t, 1, "") for i, t in rows], DOCS)).collect()
    have = {(x.doc_id, s) for x in found for s in x.spans.split(",") if s and s not in plain_spans(dict(rows)[x.doc_id])}
    assert have == want
    caught = {i for i, _ in have}
    assert not {i for i, t in rows if "serial" in t} & caught
    assert planted and planted <= caught


def test_new_form_only_where_the_cue_stands(spark):
    r = random.Random(2)
    rows = [(i, f"please call +1555{r.randint(10**6, 10**7 - 1)} soon", 1, "") for i in range(20)]
    rows += [(100, "please call (555) 123-4567 soon", 1, ""), (101, "the part (555) 123-4567 broke", 1, ""), (102, "other (555) 987-6543 part", 1, "")]
    found = {x.doc_id: x.spans for x in pii.pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[100] == "phone:12:26" and found[101] == "phone:9:23" and found[102] == ""


def test_string_ids_and_clashing_names(spark):
    rows = [("x", "write a@b.cc", "own", "k"), (None, "write a@b.cc", "own", "k"), ("x", None, "own", "k")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _spans string, key string")
    assert sorted((str(x.doc_id), x.n_email) for x in pii.pii(docs).collect()) == [("None", 1), ("x", 0), ("x", 1)]
    done = pii.redact(docs).collect()
    assert all(x._spans == "own" and x.key == "k" for x in done) and sorted(str(x.text) for x in done) == ["None", "write <EMAIL>", "write <EMAIL>"]
