import math
import random
import re

import numpy as np

from sieveline.llm import quality

DOCS = "doc_id bigint, text string, lang string, source string, d2 string"


def plain_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated), len(lines), len(text)


def plain_estimate(y, prior, s):
    """Least determinant over all starts, in numpy."""
    floors = np.diag((np.array(quality.FLOORS) * quality.GRID) ** 2)

    def moments(rows, factor):
        m, c = rows.mean(0), np.cov(rows.T, bias=True).reshape(4, 4) * factor + floors
        if prior is None:
            return m, c
        w, off = len(rows) / (len(rows) + s.prior), m - prior[0]
        return w * m + (1 - w) * prior[0], w * c + (1 - w) * prior[1] + w * (1 - w) * np.outer(off, off)

    distance = lambda m, c: np.einsum("ij,ji->i", y - m, np.linalg.solve(c, (y - m).T))
    found = []
    for m, c in [(np.median(y, axis=0), floors), moments(y, 1.0), *([prior] if prior else [])]:
        best = math.inf
        while True:
            bins = np.floor(quality.BINS * np.log2(1 + distance(m, c)))
            new = moments(y[[(bins < b).sum() < s.core * len(y) for b in bins]], s.core_factor)
            logdet = np.linalg.slogdet(new[1])[1]
            if not logdet < best - s.gain:
                break
            (m, c), best = new, logdet
        found.append((best, m, c))
    _, m, c = min(found, key=lambda f: f[0])
    near = y[distance(m, c) <= s.weight_cut]
    m, c = moments(near, 1.0) if len(near) else (m, c)
    return m, c, distance(m, c)


def plain_verdicts(rows, s=quality.Robust()):
    """Languages, then their sources."""
    stats = [plain_statistics(t) for _, t, *_ in rows]
    half_up = lambda v: math.floor(v * quality.GRID + 0.5)
    x = np.array([[half_up(math.log((c + 250) / (n + 50))), half_up(math.sqrt(y / (k + 50))), half_up(d / (ln + 2)), half_up(r / (n + 20))] for n, c, y, d, r, ln, k in stats], float)
    far, known = np.empty(len(rows)), {}
    for level in (1, 2):
        groups = {}
        for i, r in enumerate(rows):
            groups.setdefault(r[2 : 2 + level], []).append(i)
        for name, at in groups.items():
            m, c, far[at] = plain_estimate(x[at], known[name[:-1]] if level == 2 else None, s)
            known[name] = (m, c)
    failed = [n < 20 or 100 * r > 30 * n for n, _, _, _, r, _, _ in stats]
    return stats, failed, [not f and d <= s.reject_cut for f, d in zip(failed, far, strict=True)], far


def corpus(seed, n=700):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choices("abcdefgé", k=r.randint(2, 9))) for _ in range(r.randint(15, 120))]
        if r.random() < 0.1:
            words = [w + r.choice(["###", "***", "|<>"]) for w in words]
        if r.random() < 0.15:
            words += words[: r.randint(5, 40)]
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        if r.random() < 0.1:
            lines += [lines[0]] * r.randint(1, 12) + [" ", ""]
        rows.append((i, "\n".join(lines), r.choice(["en", "en", "de", None]), r.choice(["hot", "hot", "s1", "s2", None]), "clash"))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1) + [(9000 + i, "a lone row of its own kind " * 5, "xx", f"only {i}", "") for i in range(3)]
    stats, failed, kept, far = plain_verdicts(rows)
    found = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    for i, (n, c, y, d, p, *_) in enumerate(stats):
        r = found[rows[i][0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, c, y, d, p)
        assert r.base_failed == failed[i]
        assert math.isclose(r.distance2, far[i], rel_tol=1e-6, abs_tol=1e-6)
        assert r.kept == kept[i]
    assert 0 < sum(kept) < sum(not f for f in failed)


def test_labels_of_the_tables(spark):
    """Of the good texts none is rejected by the estimate."""
    at = "/root/testdata/sf0.01"
    found = quality.quality(spark.read.parquet(f"{at}/documents.parquet")).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert (good.kept | good.base_failed).all()
    assert bad.kept.mean() < 0.3


def test_edges(spark):
    long = "a b c d e f g h " * 3000
    rows = [(None, None, None, None, ""), (1, "", "en", "s", ""), (1, "", "en", "s", ""), (2, " \t\n\x0b\x0c\r", "en", "s", ""), (3, long, "en", "s", ""), (4, "x " * 8, "en", "s", ""), (5, "x " * 9, "en", "s", ""), (6, "😀 é # a\n# a\n", "en", "s", "")]
    found = quality.quality(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(text)[:5]
    assert quality.quality(spark.createDataFrame([], DOCS)).count() == 0
    assert quality.keep_good(spark.createDataFrame(rows, DOCS)).columns == ["doc_id", "text", "lang", "source", "d2"]


def test_a_round_is_one_query(spark, monkeypatch):
    """What the driver plans and broadcasts for every round goes into its memory."""
    store = spark._jsparkSession.sharedState().statusStore()
    rounds, counted = [], quality.materialize_counted
    monkeypatch.setattr(quality, "materialize_counted", lambda *a: rounds.append(1) or counted(*a))
    before = store.executionsCount()
    found = quality.quality(spark.createDataFrame(corpus(2, 300), DOCS))
    # Beside the rounds: the vectors, and of each level groups, starts, best and estimate.
    assert store.executionsCount() - before == len(rounds) + 1 + 4 * len(quality.LEVELS)
    assert len(rounds) > 4 and found.count() == 300
