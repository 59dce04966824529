import random

import numpy as np
import pytest

from sieveline.llm import tokens

DOCS = "doc_id bigint, text string, start string"


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.read_ranks(tokens.VOCABULARY))


def texts(seed):
    r = random.Random(seed)
    return ["".join(r.choices(["a", "the ", "\n", "\n\n", " ", "é", "😀", "word", "123", ", ", "\t"], k=r.randint(0, 60))) for _ in range(80)]


def plain_spans(encoder, text):
    """Character spans by decoding one token after another."""
    spans, at = [], 0
    raw = text.encode()
    chars = [i for i, c in enumerate(text) for _ in c.encode()]
    for token in encoder._encoding.encode_ordinary(text):
        n = len(encoder._encoding.decode_single_token_bytes(token))
        spans.append((chars[at], chars[at + n - 1] + 1))
        at += n
    assert at == len(raw)
    return spans


def plain_counts(encoder, text, rule):
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, min(at + len(line) + 1, len(text))))
        at += len(line) + 1
    counts, crossed = [0] * len(lines), [0] * len(lines)
    for a, b in plain_spans(encoder, text):
        over = [(min(b, e) - max(a, s), -i) for i, (s, e) in enumerate(lines) if min(b, e) > max(a, s)]
        pick = -max(over)[1] if rule == "most" else min(-i for _, i in over) if rule == "first" else max(-i for _, i in over)
        counts[pick] += 1
        crossed[pick] += len(over) > 1
    return [(i, s, e, n, x) for i, ((s, e), n, x) in enumerate(zip(lines, counts, crossed, strict=True))]


@pytest.mark.parametrize("rule", tokens.RULES)
def test_lines_match_brute_force(spark, encoder, rule):
    rows = [(i, t, "clash") for i, t in enumerate(texts(3))]
    found = {}
    for r in tokens.token_counts(spark.createDataFrame(rows, DOCS), rule=rule).collect():
        found.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens, r.n_crossing))
        assert r.doc_tokens == len(encoder._encoding.encode_ordinary(rows[r.doc_id][1]))
    for i, t, _ in rows:
        assert sorted(found[i]) == plain_counts(encoder, t, rule)


def test_offsets_round_trip(encoder):
    for text in texts(4):
        ids, start, end = encoder.spans(text)
        assert encoder._encoding.decode(ids.tolist()) == text
        assert list(zip(start.tolist(), end.tolist(), strict=True)) == plain_spans(encoder, text)


def test_own_sections_and_gaps(spark):
    rows = [(1, "alpha beta gamma", [(0, 5), (11, 16)]), (2, "alpha", None), (3, None, [(0, 0)])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sections array<struct<start:bigint,end:bigint>>")
    found = tokens.token_counts(df).collect()
    for i, text in ((1, rows[0][1]), (2, "alpha")):
        own = [r for r in found if r.doc_id == i]
        assert sum(r.n_tokens for r in own) == own[0].doc_tokens > 0
        assert any(r.section is None for r in own) and text
    assert [(r.section, r.n_tokens) for r in found if r.doc_id == 3] == [(0, 0)]


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, ""), (1, "", ""), (1, "", ""), (2, "\n", ""), (3, "x" * 200_000, "")]
    found = tokens.token_counts(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == 1 + 2 + 2 + 1
    assert tokens.token_counts(spark.createDataFrame([], DOCS)).count() == 0


def test_ties_go_to_the_earlier():
    one = np.array([2]), np.array([6])
    sections = np.array([0, 4, 4]), np.array([4, 4, 8])
    assert tokens.attribute(*one, *sections, "most").tolist() == [0]
    assert tokens.attribute(*one, *sections, "last").tolist() == [2]
    with pytest.raises(ValueError):
        tokens.attribute(*one, *sections, "none")
