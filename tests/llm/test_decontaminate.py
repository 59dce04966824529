import hashlib
import random
import re

from sieveline.llm import decontaminate

DOCS, ITEMS = "doc_id bigint, text string, item string", "item_id bigint, text string, k1 string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = {}
    for i, t, *_ in items:
        w = words_of(t)
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    out = []
    for i, t, *_ in docs:
        w, hit, found = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def check(spark, docs, items):
    found = decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == plain(docs, items)


def test_random(spark):
    r = random.Random(1)
    pool = ["a", "b", "c", "Dd", "É", "é", "x1"]
    text = lambda k: " ".join(r.choices(pool, k=k))
    items = [(i, text(r.choice([0, 1, 2, 3, 4, 7, 10, 11, 25, 40])) if r.random() < 0.3 else text(30), "x") for i in range(20)]
    docs = [(i, text(r.randint(0, 30)) + " " + r.choice(items)[1][r.randint(0, 10) :].upper() + "," + text(5), "x") for i in range(80)]
    check(spark, docs, items)


def test_edges(spark):
    ten = "one two three four five six seven eight nine ten"
    docs = [(None, None, ""), (1, "", ""), (2, ten, ""), (2, ten, ""), (2, ten.upper() + " more", ""), (3, ten[:-4], ""), (4, "solo", ""), (5, "K " * 3, ""), (6, ten + " " + ten, "")]
    check(spark, docs, [(1, ten + " eleven", ""), (1, "solo", ""), (None, ten, ""), (None, None, ""), (9, "", ""), (11, "k k k", "")])
    check(spark, docs, [])
    check(spark, [], [(1, ten, "")])
    kept = decontaminate.remove_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, ten, "")], ITEMS))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "None"] and kept.columns == ["doc_id", "text", "item"]


def test_texts_under_one_id(spark):
    """Items that share an id, or have none, keep windows of their own."""
    there, absent, other = ([f"{c}{i}" for i in range(12)] for c in "abc")
    docs = [(1, " ".join(["x", *there, "y"]), ""), (2, " ".join(["x", *other, "y"]), ""), (3, "x y z", "")]
    for i in (7, None):
        items = [(i, " ".join(there), ""), (i, " ".join(absent), ""), (i, " ".join(other), ""), (i, " ".join(other), "")]
        check(spark, docs, items)
        kept = decontaminate.remove_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
        assert [r.doc_id for r in kept.collect()] == [3]
