"""Repair of conversations whose rows were damaged: a forward Viterbi pass.

A conversation is in one of four states: empty, after the system's turn, after a
user's, after an assistant's. Each row is a layer of edits (keep, rerole, delete)
that lead from state to state, closed by inserted turns, of which two at most are
ever worth their cost. Every state carries the least (cost, audit): the cost of
the cheapest edits so far and the least string of their initials, with the hash
of the turns that these leave.

Rows are dealt by conversation and sorted on disk, and one pass reads them as a
stream. No row is kept; initials that all states agree on are put aside.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row that is kept, by the states that it may follow.
NEXT = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAULTS = ("blank", "duplicate", "truncated")


class Way(NamedTuple):
    """The cheapest edits that lead to a state: cost, initials, and the hash of
    the turns that they leave, as far as the rows have been read."""

    cost: int
    audit: str
    hash: Any

    def then(self, cost: int, edit: str) -> Way:
        return Way(self.cost + cost, self.audit + edit, self.hash)

    def hashed(self, came_from: int, role: str, text: str) -> Way:
        """With a turn more, behind a line feed if it is not the first."""
        hash_ = self.hash.copy()
        hash_.update(f"{'' if came_from == EMPTY else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        return self._replace(hash=hash_)


def _turned(state: int) -> int:
    """Where a user's or assistant's turn leads: there is one choice of the two."""
    return ASSISTANT if state == USER else USER


def _least(ways: dict[int, tuple[Way, int]], to: int, way: Way, came_from: int) -> None:
    if to not in ways or way[:2] < ways[to][0][:2]:
        ways[to] = way, came_from


def _closed(layer: dict[int, Way]) -> dict[int, Way]:
    """The layer after inserted turns: a user's first, then an assistant's."""
    for state, to, role in ((EMPTY, USER, "user"), (SYSTEM, USER, "user"), (ASSISTANT, USER, "user"), (USER, ASSISTANT, "assistant")):
        if state in layer:
            way = layer[state].then(INSERT, "I")
            if to not in layer or way[:2] < layer[to][:2]:
                layer[to] = way.hashed(state, role, "")
    return layer


class Repair:
    """One conversation, row by row: ``add`` rows in order, then ``result``."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal = self.turns = 0
        self.least = self.last = self.initial = None
        self.layer = _closed({EMPTY: Way(0, "", hashlib.sha256())})
        self.settled: list[str] = []
        self.most = 256

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        said = text.rstrip(SPACES)
        fault = "blank" if not said else "duplicate" if seen else "truncated" if said[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        self._step(role, text, fault)

    def _step(self, role: str, text: str, fault: str | None) -> None:
        found: dict[int, tuple[Way, int]] = {}
        extra = TRUNCATED if fault == "truncated" else 0
        for state, way in self.layer.items():
            _least(found, state, way.then(DELETE, "D"), state)
            if fault not in FAULTS[:2]:
                _least(found, _turned(state), way.then(REROLE + extra, "R"), state)
                if (role[:1], state) in NEXT:
                    _least(found, NEXT[role[:1], state], way.then(KEEP + extra, "K"), state)
        layer = {}
        for state, (way, came_from) in found.items():
            edit = way.audit[-1]
            name = role if edit == "K" else "user" if state == USER else "assistant"
            layer[state] = way if edit == "D" else way.hashed(came_from, name, text)
        self.layer = _closed(layer)
        # Whatever goes on from these states goes on from ASSISTANT too, at most
        # one deleted row (a system turn that cannot be kept) dearer.
        for state, more in ((EMPTY, DELETE), (SYSTEM, 0)):
            if state in layer and layer[state].cost > layer[ASSISTANT].cost + more:
                del layer[state]
        if len(layer[ASSISTANT].audit) >= self.most:
            shared = os.path.commonprefix([way.audit for way in layer.values()])
            self.settled.append(shared)
            self.layer = {state: way._replace(audit=way.audit[len(shared) :]) for state, way in layer.items()}
            self.most = max(256, 2 * len(self.layer[ASSISTANT].audit))

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        way = min((self.layer[s] for s in (EMPTY, ASSISTANT) if s in self.layer), key=lambda w: w[:2])
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return (gaps, *self.counts.values(), self.illegal, way.cost, "".join(self.settled) + way.audit, way.hash.hexdigest())


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage, with n: how often a row stands
    (0: dropped, 2: repeated). Null roles and texts are one space."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``rows`` (conv_id,
    turn, role, text, n as ``damage`` gives them).

    Returns per conv_id (null is one of them): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. Rows of one turn are taken
    in the order of role and text; rows alike in full are duplicates of the first.
    Texts are read whole, whatever their length. Roles count by their first
    character. An empty table gives an empty result; other columns are not read.
    A conversation of any length passes through one task, as its hash runs from
    its first row to its last, but as a stream that is sorted on disk. Finding
    repeated rows is a shuffle of its own, by conversation, role and text.
    """
    there = F.col("n") > 0
    first = F.row_number().over(Window.partitionBy("conv_id", "role", "text", there).orderBy(F.col("turn").asc_nulls_first()))
    marked = rows.withColumn("seen", there & (first > 1))
    sorted_rows = marked.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, done = None, None, []

        def out() -> pa.RecordBatch:
            ids = pa.concat_arrays([d[0] for d in done]) if done else at
            columns = zip(*(d[1] for d in done), strict=True) if done else [[]] * (len(names) - 1)
            kinds = [*[pa.int64()] * (len(names) - 3), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)

        for batch in batches:
            ids = batch.column("conv_id")
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "seen")), strict=True)
            for k, (conv, turn, role, text, n, seen) in enumerate(rows):
                if now is None or conv != at[0].as_py():
                    if now is not None:
                        done.append((at, now.result()))
                    now, at = Repair(), ids.slice(k, 1)
                for again in range(n):
                    now.add(turn, role, text, seen or again > 0)
            if done:
                yield out()
                done = []
        if now is not None:
            done.append((at, now.result()))
            yield out()

    return sorted_rows.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in names[1:-2])}, audit string, repaired_sha256 string")


def conversations(rows: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows; see both for nulls, ties and the rest."""
    return repair(damage(rows))


#: The same rules as one recursion over the places of all conversations. DuckDB
#: has no crc32, so it is folded over the bytes by the table of its polynomial.
ORACLE = """
WITH RECURSIVE
t(n, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS l FROM t WHERE k = 8),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS b FROM conversations),
hashed AS (SELECT named.*, xor(list_reduce([CAST(ord(decode(b[i:i])) AS BIGINT) FOR i IN range(1, octet_length(b) + 1)], lambda h, x: xor(h >> 8, l[xor(h & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS d FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, LATERAL (SELECT unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) AS again(g)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
said AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS s, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
faulty AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS r, before,
         CASE WHEN s = '' THEN 'b' WHEN seen THEN 'd' WHEN right(s, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM said),
way(conv_id, i, e, s, u, a) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {'c': 0, 'w': ''}, {'c': 1000000000, 'w': ''}, {'c': 5, 'w': 'I'}, {'c': 10, 'w': 'II'} FROM faulty
  UNION ALL
  SELECT conv_id, i, e, s, u, least(a, {'c': u.c + 5, 'w': u.w || 'I'}) FROM (
    SELECT conv_id, i, e, s, least(u, {'c': e.c + 5, 'w': e.w || 'I'}, {'c': s.c + 5, 'w': s.w || 'I'}, {'c': a.c + 5, 'w': a.w || 'I'}) AS u, a FROM (
      SELECT w.conv_id, x.i, {'c': e.c + 2, 'w': e.w || 'D'} AS e,
        least({'c': s.c + 2, 'w': s.w || 'D'}, {'c': e.c + t + CASE WHEN r = 's' AND ok THEN 0 ELSE 1000000000 END, 'w': e.w || 'K'}) AS s,
        least({'c': u.c + 2, 'w': u.w || 'D'},
          {'c': e.c + t + CASE WHEN ok THEN 1 ELSE 1000000000 END, 'w': e.w || 'R'}, {'c': s.c + t + CASE WHEN ok THEN 1 ELSE 1000000000 END, 'w': s.w || 'R'}, {'c': a.c + t + CASE WHEN ok THEN 1 ELSE 1000000000 END, 'w': a.w || 'R'},
          {'c': e.c + t + CASE WHEN r = 'u' AND ok THEN 0 ELSE 1000000000 END, 'w': e.w || 'K'}, {'c': s.c + t + CASE WHEN r = 'u' AND ok THEN 0 ELSE 1000000000 END, 'w': s.w || 'K'}, {'c': a.c + t + CASE WHEN r = 'u' AND ok THEN 0 ELSE 1000000000 END, 'w': a.w || 'K'}) AS u,
        least({'c': a.c + 2, 'w': a.w || 'D'}, {'c': u.c + t + CASE WHEN ok THEN 1 ELSE 1000000000 END, 'w': u.w || 'R'}, {'c': u.c + t + CASE WHEN r = 'a' AND ok THEN 0 ELSE 1000000000 END, 'w': u.w || 'K'}) AS a
      FROM way w JOIN (SELECT conv_id, i, r, f NOT IN ('b', 'd') AS ok, CASE f WHEN 't' THEN 5 ELSE 0 END AS t FROM faulty) x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1))),
best AS (SELECT conv_id, least(e, a) AS b FROM way QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
edits AS (
  SELECT conv_id, p, b.w[p] AS op, CASE WHEN b.w[p] = 'I' THEN NULL ELSE p - length(regexp_replace(left(b.w, p), '[^I]', '', 'g')) END AS i
  FROM best, LATERAL (SELECT unnest(range(1, length(b.w) + 1)) AS p)),
kept AS (
  SELECT edits.*, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY edits.conv_id ORDER BY p)
           - coalesce(max(CASE WHEN op = 'K' AND left(role, 1) = 's' THEN 1 END) OVER (PARTITION BY edits.conv_id), 0) AS k
  FROM edits LEFT JOIN faulty ON edits.conv_id IS NOT DISTINCT FROM faulty.conv_id AND edits.i = faulty.i WHERE op <> 'D'),
shown AS (SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, E'\\n' ORDER BY p)) AS repaired_sha256 FROM kept GROUP BY conv_id),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
         count(*) FILTER (f = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.w, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN told ON ids.conv_id IS NOT DISTINCT FROM told.conv_id LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id
     LEFT JOIN shown ON ids.conv_id IS NOT DISTINCT FROM shown.conv_id
"""
