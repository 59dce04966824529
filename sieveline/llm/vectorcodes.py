"""Vector codes by Lloyd's rounds that look at few parts: heap Lloyd.

Vectors become integers and are cut into parts; each part position has its own
codebook. The first assignment scans every part and leaves, for every chunk of
vectors, part position and codebook entry, a heap of the entry's parts keyed by
their slack: distance to the second nearest entry less distance to their own.
Entries drift as they are replaced; a part can only have changed hands once the
drift gathered since then reaches its key. So a round looks at the tops of the
heaps, pops what is reached, scans these parts exactly and pushes them again; a
heap whose top is not reached is not opened. What moved is summed over chunks as
differences, which gives the next codebook from the one before.

Chunks are rows of a written table, so a round can lose executors.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Components beyond this in size cannot be squared and summed in a long.
LARGEST = 2**27
#: Far above the rounding of distances, far below a distance that matters.
MARGIN = 1e-3
#: Components of a chunk.
CHUNK = 2**18


@dataclass
class Codebook:
    """Entries (entry by component), where each part starts, and how far each
    entry (part by entry) and the farthest of the others came together."""

    entries: np.ndarray
    at: list[int]
    drift: np.ndarray

    def part(self, j: int) -> slice:
        return slice(self.at[j], self.at[j + 1])

    def replaced(self, sums: np.ndarray, counts: np.ndarray) -> Codebook:
        """The next codebook: floors of the means, unused entries stay."""
        entries, drift = self.entries.copy(), self.drift.copy()
        for j in range(len(self.at) - 1):
            used = counts[j] > 0
            entries[used, self.part(j)] = sums[used, self.part(j)] // counts[j][used, None]
            moved = np.sqrt(((entries[:, self.part(j)] - self.entries[:, self.part(j)]) ** 2).sum(1).astype(float))
            by_size = np.sort(moved)
            second = by_size[-2] if len(moved) > 1 else 0.0
            drift[j] += moved + np.where(moved == by_size[-1], np.where((moved == by_size[-1]).sum() > 1, by_size[-1], second), by_size[-1])
        return Codebook(entries, self.at, drift)

    def sha256(self) -> str:
        values = [self.entries[:, self.part(j)].ravel() for j in range(len(self.at) - 1)]
        return hashlib.sha256(",".join(map(str, np.concatenate(values).tolist())).encode()).hexdigest()


def scan(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the lower index at a tie, and the slack
    to the second nearest (infinite if there is none)."""
    far = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    code = far.argmin(1)
    least = np.take_along_axis(far, code[:, None], 1)[:, 0]
    if len(entries) == 1:
        return code, np.full(len(parts), np.inf)
    np.put_along_axis(far, code[:, None], np.iinfo(np.int64).max, 1)
    return code, np.sqrt(far.min(1).astype(float)) - np.sqrt(least.astype(float))


@dataclass
class Chunk:
    """Vectors of one chunk (rows by components), their codes (rows by parts),
    and the heaps: keys and rows of all of them, one behind the other by part and
    entry, and where each starts."""

    vectors: np.ndarray
    codes: np.ndarray
    keys: np.ndarray
    rows: np.ndarray
    at: np.ndarray

    @classmethod
    def first(cls, vectors: np.ndarray, book: Codebook) -> Chunk:
        """Every part is scanned. Parts in the order of their keys are a heap."""
        n, parts, k = len(vectors), len(book.at) - 1, len(book.entries)
        codes, keys, rows, sizes = np.empty((n, parts), np.int64), [], [], []
        for j in range(parts):
            codes[:, j], slack = scan(vectors[:, book.part(j)], book.entries[:, book.part(j)])
            order = np.lexsort((slack, codes[:, j]))
            keys.append(slack[order])
            rows.append(order)
            sizes.append(np.bincount(codes[:, j], minlength=k))
        return cls(vectors, codes, np.concatenate(keys), np.concatenate(rows), np.append(0, np.cumsum(np.concatenate(sizes))))

    def assign(self, book: Codebook) -> int:
        """Pop and scan the parts that the drift has reached; returns how many."""
        k, keys, rows, sizes, scanned = len(book.entries), [], [], [], 0
        for j in range(len(book.at) - 1):
            open_: dict[int, list] = {}
            span = self.at[j * k : j * k + k + 1].tolist()

            def opened(e: int, open_: dict = open_, span: list = span) -> list:
                if e not in open_:
                    open_[e] = list(zip(self.keys[span[e] : span[e + 1]].tolist(), self.rows[span[e] : span[e + 1]].tolist(), strict=True))
                return open_[e]

            popped = []
            for e in range(k):
                reached = book.drift[j, e] + MARGIN
                if span[e] == span[e + 1] or self.keys[span[e]] > reached:
                    continue
                mine = opened(e)
                while mine and mine[0][0] <= reached:
                    popped.append(heapq.heappop(mine)[1])
            if popped:
                at = np.array(popped)
                code, slack = scan(self.vectors[at, book.part(j)], book.entries[:, book.part(j)])
                self.codes[at, j] = code
                for key, row, e in zip((slack + book.drift[j, code]).tolist(), popped, code.tolist(), strict=True):
                    heapq.heappush(opened(e), (key, row))
            for e in range(k):
                low, high = span[e], span[e + 1]
                sizes.append(len(open_[e]) if e in open_ else high - low)
                keys.append([key for key, _ in open_[e]] if e in open_ else self.keys[low:high])
                rows.append([row for _, row in open_[e]] if e in open_ else self.rows[low:high])
            scanned += len(popped)
        self.keys, self.rows = (np.concatenate([np.asarray(x, kind) for x in found]) for found, kind in ((keys, float), (rows, np.int64)))
        self.at = np.append(0, np.cumsum(sizes))
        return scanned

    def sums(self, book: Codebook, before: np.ndarray | None) -> np.ndarray:
        """What the chunk adds to the sums (entry by component) and counts (part
        by entry), laid flat; parts that stay where they were ``before`` add nothing."""
        out, counts = np.zeros_like(book.entries), np.zeros((len(book.at) - 1, len(book.entries)), np.int64)
        for j in range(len(book.at) - 1):
            moved = np.arange(len(self.codes)) if before is None else np.flatnonzero(before[:, j] != self.codes[:, j])
            parts = self.vectors[moved, book.part(j)]
            for codes, sign in ((self.codes, 1), *(((before, -1),) if before is not None else ())):
                np.add.at(out[:, book.part(j)], codes[moved, j], sign * parts)
                np.add.at(counts[j], codes[moved, j], sign)
        return np.concatenate((out.ravel(), counts.ravel()))

    def errors(self, book: Codebook) -> np.ndarray:
        return sum(((self.vectors[:, book.part(j)] - book.entries[self.codes[:, j], book.part(j)]) ** 2).sum(1) for j in range(len(book.at) - 1))


def _numbers(column: pa.ListArray, at: int) -> np.ndarray:
    return column[at].values.to_numpy(zero_copy_only=False)


def _one(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def _row(ids: pa.Array, labels: pa.Array, chunk: Chunk, added: np.ndarray) -> pa.RecordBatch:
    slots = np.flatnonzero(added)
    #: Keys are kept short, rounded down so that none is popped too late.
    keys = np.nextafter(chunk.keys.astype(np.float32), np.float32(-np.inf))
    columns = {
        "ids": _one(ids, None), "labels": _one(labels, None), "vectors": _one(chunk.vectors.ravel(), pa.int32()), "codes": _one(chunk.codes.ravel(), pa.int16()),
        "keys": _one(keys, pa.float32()), "rows": _one(chunk.rows, pa.int32()), "at": _one(chunk.at, pa.int32()), "slots": _one(slots, pa.int32()), "deltas": _one(added[slots], pa.int64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _chunks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.Array, pa.Array, Chunk]]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
            vectors, codes, keys, rows, at = (_numbers(batch.column(c), k) for c in ("vectors", "codes", "keys", "rows", "at"))
            yield ids, labels, Chunk(vectors.reshape(len(ids), -1).astype(np.int64), codes.reshape(len(ids), parts).astype(np.int64), keys.astype(float), rows.astype(np.int64), at.astype(np.int64))


def _added(state: DataFrame, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts over all chunks: at most a number for each component and
    each entry of each part reaches the driver, however many vectors there are."""
    flat = np.zeros(book.entries.size + book.drift.size, np.int64)
    moved = state.select(F.arrays_zip("slots", "deltas").alias("x")).select(F.explode("x").alias("x")).groupBy("x.slots").agg(F.sum("x.deltas").alias("n"))
    for slot, n in moved.collect():
        flat[slot] = n
    return flat[: book.entries.size].reshape(book.entries.shape), flat[book.entries.size :].reshape(book.drift.shape)


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and x, the floors of the scaled components. A vector that is
    null or has a null, non-finite or too large component (``LARGEST``) is left out."""
    fits = lambda v: F.coalesce(F.abs(v.cast("double") * scale) < LARGEST, F.lit(False))
    kept = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & F.forall("embedding", fits))
    return kept.select("vec_id", "label", F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("x"))


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """Codes of ``vectors`` (vec_id, label, embedding).

    Returns vec_id, code (two hex digits a part), error, label_error and
    codebooks_sha256, a row per vector whose components are all finite and less
    than 2**27 / ``scale`` in size. The codebooks start as the parts of the
    ``entries`` smallest vec_ids (null last, vectors in order at a tie; repeated
    rows each count). Parts are cut at ``j * length // parts``. Codes take the
    length of the smallest vec_id's vector; a vector of another length keeps its
    row, with null code and error. Repeated rows each get a row; an empty table
    gives an empty result; other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries has to be from 1 to 256")
    spark = vectors.sparkSession
    whole = integers(vectors, scale)
    start = [r.x for r in whole.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    width = len(start[0]) if start else 0
    start = [x for x in start if len(x) == width]
    start = np.array(start, np.int64).reshape(len(start), width)
    at = [j * width // parts for j in range(parts + 1)]
    book = Codebook(start, at, np.zeros((parts, len(start))))
    kinds = {c: whole.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    out = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"
    if not len(start):
        return whole.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"), F.lit(None).cast("bigint").alias("label_error"), F.lit(book.sha256()).alias("codebooks_sha256"))
    schema = f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, vectors array<int>, codes array<smallint>, keys array<float>, rows array<int>, at array<int>, slots array<int>, deltas array<bigint>"
    rows_each = max(64, CHUNK // max(1, width))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows_each):
                part = batch.slice(low, rows_each)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, width)
                chunk = Chunk.first(x, book)
                yield _row(part.column("vec_id"), part.column("label"), chunk, chunk.sums(book, None))

    def again(book: Codebook):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, labels, chunk in _chunks(batches, parts):
                before = chunk.codes.copy()
                chunk.assign(book)
                yield _row(ids, labels, chunk, chunk.sums(book, before))

        return run

    def end(book: Codebook):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, labels, chunk in _chunks(batches, parts):
                chunk.assign(book)
                code = pa.array([bytes(c).hex() for c in chunk.codes.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(chunk.errors(book), pa.int64())], names=["vec_id", "label", "code", "error"])

        return run

    fits = F.size("x") == width
    state = materialize(whole.where(fits).mapInArrow(begin, schema), "chunks")
    sums, counts = _added(state, book)
    for step in range(rounds):
        book = book.replaced(sums, counts)
        if step + 1 < rounds:
            before, state = state, materialize(state.mapInArrow(again(book), schema), "chunks")
            discard(before)
            more, moved = _added(state, book)
            sums, counts = sums + more, counts + moved
    rows = materialize(state.mapInArrow(end(book), out), "codes")
    discard(state)
    odd = whole.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    rows = rows.unionByName(odd)
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(totals, rows["label"].eqNullSafe(totals["of"])).select("vec_id", "code", "error", "label_error", F.lit(book.sha256()).alias("codebooks_sha256"))


ORACLE = """
WITH
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or([v IS NULL OR NOT isfinite(v) FOR v IN embedding])),
v AS MATERIALIZED (
  SELECT r, (p - 1) * 16 // len(embedding) AS j, p, CAST(floor(CAST(embedding[p] AS DOUBLE) * 256) AS BIGINT) AS x
  FROM kept, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS p)),
b0 AS MATERIALIZED (SELECT r - 1 AS e, j, p, x FROM v WHERE r <= 64),
d0 AS (SELECT r, v.j, e, CAST(sum((v.x - b0.x) * (v.x - b0.x)) AS BIGINT) AS d FROM v JOIN b0 ON v.p = b0.p GROUP BY ALL),
a0 AS MATERIALIZED (SELECT r, j, min(d * 64 + e) % 64 AS e FROM d0 GROUP BY ALL),
b1 AS MATERIALIZED (
  SELECT b.e, b.j, b.p, coalesce(n.x, b.x) AS x FROM b0 b LEFT JOIN (
    SELECT a.e, v.p, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM v JOIN a0 a ON v.r = a.r AND v.j = a.j GROUP BY ALL) n ON b.e = n.e AND b.p = n.p),
d1 AS (SELECT r, v.j, e, CAST(sum((v.x - b1.x) * (v.x - b1.x)) AS BIGINT) AS d FROM v JOIN b1 ON v.p = b1.p GROUP BY ALL),
a1 AS MATERIALIZED (SELECT r, j, min(d * 64 + e) % 64 AS e FROM d1 GROUP BY ALL),
b2 AS MATERIALIZED (
  SELECT b.e, b.j, b.p, coalesce(n.x, b.x) AS x FROM b1 b LEFT JOIN (
    SELECT a.e, v.p, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM v JOIN a1 a ON v.r = a.r AND v.j = a.j GROUP BY ALL) n ON b.e = n.e AND b.p = n.p),
d2 AS (SELECT r, v.j, e, CAST(sum((v.x - b2.x) * (v.x - b2.x)) AS BIGINT) AS d FROM v JOIN b2 ON v.p = b2.p GROUP BY ALL),
a2 AS MATERIALIZED (SELECT r, j, min(d * 64 + e) AS de FROM d2 GROUP BY ALL),
codes AS MATERIALIZED (SELECT r, string_agg(lpad(lower(hex(CAST(de % 64 AS UTINYINT))), 2, '0'), '' ORDER BY j) AS code, CAST(sum(de // 64) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j, e, p)) FROM b2) AS codebooks_sha256
FROM codes JOIN kept USING (r)
"""
