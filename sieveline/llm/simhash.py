"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint. Bit ``i`` is given the non-zero
vector ``phi(i) = i mod (2**(r+1) - 1) + 1`` over GF(2)**(r+1), and table ``v``
keeps the bits whose vector has an odd product with ``v``. At most ``r``
differing bits span at most ``r`` dimensions, so some ``v`` is orthogonal to
them all: every pair within the radius agrees on the bits of some table. There
are ``2**(r+1) - 1`` tables, and each keeps a little over half of the bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_names, materialize

#: Bits of a fingerprint, and how many may differ in a link.
BITS, RADIUS = 64, 2
#: Fingerprints of a table's group that are compared pair by pair.
GROUP = 64
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
#: Slots in which shingles are counted to order them, and what rounding may take.
SLOTS, SLACK = 1 << 16, 1e-6
#: One hash in so many is in a set's sample. Above 1 / (1 - least) no sample
#: could show that a set is too much its own.
SAMPLED = 3
#: For each byte value, its bits, lowest first.
_BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _shingle_hashes(text: bytes, size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, piece by piece so that long texts stay small."""
    start, tail, any_shingle = 0, [], False
    while start < len(text):
        end = min(len(text), start + PIECE)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = tail + text[start:end].split()
        n = len(words) - size + 1
        if n > 0:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            digest = xxhash.xxh64_intdigest
            yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n)
            any_shingle = True
        tail = words[max(0, n) :]
        start = end
    if not any_shingle and tail:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], np.uint64)


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint: a bit is set if it is set in over half of the hashes."""
    return _fingerprint(_shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower(), shingle, seed))


def _fingerprint(pieces: Iterable[np.ndarray]) -> int:
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in pieces:
        columns = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(columns[:, k], minlength=256) @ _BIT_TABLE
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, key (a hash that tells rows of one doc_id apart) and fp (the
    fingerprint's bits as a signed long), row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(t.as_py(), shingle, seed) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(found.view(np.int64))], names=["doc_id", "key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key bigint, fp bigint")


def covering_masks(radius: int) -> list[int]:
    """The masks, as signed longs; table v keeps bit i if phi(i) . v is odd."""
    size = 2 ** (radius + 1) - 1
    masks = [sum(1 << i for i in range(BITS) if bin((i % size + 1) & v).count("1") % 2) for v in range(1, size + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(fps: DataFrame) -> DataFrame:
    """Edges a, b that connect exactly what pairs within two bits do.

    ``fps`` holds distinct fingerprints. Each goes into every covering table; a
    pair within the radius meets in one of them, and there all pairs of up to
    ``GROUP`` fingerprints are compared. The fingerprints of fuller groups are
    dealt to themselves and their one-bit neighbours: two of them are within two
    bits if and only if both are within one bit of a common value. At most 65
    can meet at a value, whatever the corpus, and a star to the smallest joins
    them: no large group's pairs are listed and none is lost.
    """
    tables = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept")) for v, m in enumerate(covering_masks(RADIUS))]))
    dealt = fps.select("fp", tables.alias("t")).select("fp", "t.v", "t.kept")
    shared = dealt.groupBy("v", "kept").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    groups = dealt.join(shared.where(F.col("n") <= GROUP), ["v", "kept"]).groupBy("v", "kept").agg(F.sort_array(F.collect_list("fp")).alias("g"))
    close = lambda x: lambda y: F.bit_count(x.bitwiseXOR(y)) <= RADIUS
    later = F.transform("g", lambda x, i: F.transform(F.filter(F.slice("g", i + 2, F.lit(GROUP)), close(x)), lambda y: F.struct(y.alias("a"), x.alias("b"))))
    direct = groups.select(F.explode(F.flatten(later)).alias("e")).select("e.a", "e.b")

    met = dealt.join(shared.where(F.col("n") > GROUP), ["v", "kept"], "left_semi").select("fp").distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit((1 << i) if i < BITS - 1 else -(1 << i))) for i in range(BITS)]
    near = met.select("fp", F.explode(F.array(F.col("fp"), *flips)).alias("mid"))
    stars = near.groupBy("mid").agg(F.sort_array(F.collect_set("fp")).alias("g")).where(F.size("g") > 1)
    return direct.unionByName(stars.select(F.explode(F.slice("g", 2, BITS + 1)).alias("a"), F.col("g")[0].alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges a, b: node and its smallest node, root.

    Alternates large-star and small-star steps until all edges are stars. Each
    is an aggregate and a join, so a hub with many edges is pre-aggregated or
    split, never gathered. Every round is written to the shared folder. Rounds
    are a logarithm of the nodes; ``most_rounds``, far above, only raises.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(most_rounds):
        # In stars no node has two edges up, or edges up and down.
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # Large star: larger neighbours of a node join its smallest one.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours and the node itself do.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = materialize(small, "edges")
        discard(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _grouped(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """doc_id, key, fp, and first: the smallest (doc_id, key) reachable."""
    fps = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    # No id sorts behind all ids.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    per_fp = materialize(fps.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    roots = materialize(components(links(per_fp.select("fp"))), "roots")
    # Only fingerprints with a link have a root; the others are their own.
    rooted = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return fps.join(rooted.select("fp", "root").join(firsts, "root").select("fp", "first"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """Group documents whose fingerprints are linked.

    Returns one row per row of ``docs``: doc_id, fingerprint (16 lowercase hex
    digits), component_id (the smallest doc_id reachable over links of at most
    two bits, itself included). A null or wordless text has fingerprint zero
    and is linked like any other. Rows with a null doc_id keep it and take part
    in links; component_id is null only where all ids of a component are.
    Repeated rows each get a row. Texts of any length are hashed whole, in
    pieces. Extra columns are not read. An empty table gives an empty result.
    """
    found = _grouped(docs, shingle, seed)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def _shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted (zero if it has none)."""
    found = list(_shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower(), shingle, 0))
    return np.unique(np.concatenate(found)) if found else np.zeros(1, np.uint64)


def samples(docs: DataFrame, shingle: int) -> DataFrame:
    """Row by row doc_id, key, node (the hash of the shingle set), size (of the
    set) and sample: those of its hashes that ``SAMPLED`` divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, parts = [], [], []
            for text in batch.column("text"):
                found = _shingle_set(text.as_py(), shingle)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                parts.append(found[found % SAMPLED == 0].view(np.int64))
            made = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *made], names=["doc_id", "key", "node", "size", "sample"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key bigint, node bigint, size int, sample array<bigint>")


def spare(size: str, least: float) -> Column:
    """How many hashes a set may have that no alike set shares."""
    return F.col(size) - F.ceil(least * F.col(size) - SLACK)


def open_nodes(nodes: DataFrame, sampled: DataFrame, least: float) -> DataFrame:
    """Those of ``nodes`` (node, size) that may have an alike set: of the hashes
    in ``sampled`` (node, h) no more are theirs alone than an alike set lacks.

    Every holder of a sampled hash is in ``sampled``, so a hash seen in one set
    only is nobody else's, and the test loses nothing.
    """
    lone = sampled.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    return nodes.join(lone, "node", "left").where(F.coalesce("lone", F.lit(0)) <= spare("size", least)).drop("lone")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node, fp (the SimHash of its shingles) and s (the shingle set) of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [_shingle_set(text.as_py(), shingle) for text in part.column("text")]
                fps = np.array([_fingerprint([s]) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(fps), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "fp", "s"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, fp bigint, s array<bigint>")


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many hashes of all sets fall into each of ``SLOTS`` slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("s").flatten().to_numpy().view(np.uint64) % SLOTS, minlength=SLOTS)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=["slot", "n"])

    counts = np.zeros(SLOTS, np.int64)
    for slot, n in sets.select("s").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n")).collect():
        counts[slot] = n
    return counts


def shared_sets(sets: DataFrame, least: float) -> DataFrame:
    """node, fp, size and s: the sets that may still have an alike one, without
    the hashes that no other set has. size is that of the whole set."""
    dealt = sets.select("node", "fp", F.size("s").alias("size"), F.explode("s").alias("h"))
    shared = dealt.groupBy("h").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("h")
    found = dealt.join(shared, "h", "left_semi").groupBy("node", "fp", "size").agg(F.collect_list("h").alias("s"))
    return found.where(F.size("s") >= F.col("size") - spare("size", least))


def postings(sets: DataFrame, least: float) -> DataFrame:
    """h, node, size and rest: the hashes of a set's prefix, and how many of its
    shared hashes stand from there on.

    Two sets with a Jaccard of ``least`` have ``least`` of the larger one in
    common, all of it shared hashes; so in any order that all sets follow each
    has a common one among its first ``shared - ceil(least * size) + 1``. Hashes
    of emptier slots come first: what many texts have is in the prefix of few.
    """
    counts = slot_counts(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, shared = [], []
            for s, size in zip(batch.column("s"), batch.column("size").to_pylist(), strict=True):
                found = s.values.to_numpy().view(np.uint64)
                n = len(found) - math.ceil(least * size - SLACK) + 1
                firsts.append(found[np.lexsort((found, counts[found % SLOTS]))[:n]].view(np.int64))
                shared.append(len(found))
            made = [pa.array(shared, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), *made], names=["node", "size", "shared", "prefix"])

    made = sets.select("node", "size", "s").mapInArrow(run, "node bigint, size int, shared int, prefix array<bigint>")
    return made.select("node", "size", "shared", F.posexplode("prefix").alias("pos", "h")).select("h", "node", "size", (F.col("shared") - F.col("pos")).alias("rest"))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs a, b whose sets are alike."""
    side = lambda name, s, size: sets.select(F.col("node").alias(name), F.col("s").alias(s), F.col("size").alias(size))
    both = pairs.join(side("a", "p", "m"), "a").join(side("b", "q", "n"), "b")
    common = F.size(F.array_intersect("p", "q"))
    return both.where(common >= least * (F.col("m") + F.col("n") - common) - SLACK).select("a", "b")


def likely_pairs(sets: DataFrame) -> DataFrame:
    """Pairs a, b of sets whose fingerprints are equal or linked: the sets of a
    fingerprint with its smallest one, and the smallest ones with each other."""
    heads = sets.groupBy("fp").agg(F.min("node").alias("head"))
    equal = sets.select("node", "fp").join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = links(heads.select("fp")).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("p")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("q")), "b")
    return equal.unionByName(near.select(F.col("p").alias("a"), F.col("q").alias("b")))


def alike_roots(dealt: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """node and root for the sets linked by pairs of at least ``least``.

    ``dealt`` are the postings; a bucket is the sets with a hash in their
    prefix. First the pairs that fingerprints suggest and each bucket's head
    with all the others are verified; this links most copies. Then, in every
    bucket that is not linked in itself, some more heads are compared with all
    the others that size and place allow, and step out. It ends when no bucket
    holds two groups, so every pair that could be alike was compared or is
    linked. Heads grow in number by rounds; a bucket of one group costs no
    pairs, one of unlike sets its square.
    """
    # The head is the set with the most company in all its buckets: of many
    # edited copies, the original.
    company = dealt.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(dealt.join(company, "h"), "shared")
    discard(dealt)
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    left = materialize(shared.drop("n").join(weight, "node").withColumn("root", F.col("node")), "left")
    discard(shared)
    tried = alike = None
    likely = likely_pairs(sets)
    heads_a_bucket, rounds = 1, 0
    while True:
        part = F.pmod(F.xxhash64("node", F.lit(rounds)), F.lit(heads_a_bucket))
        heads = left.groupBy("h", part.alias("part")).agg(F.max(F.struct("weight", "node", "size", "rest", "root")).alias("p")).select("h", "p")
        heads = materialize(heads, "heads")
        # At the first hash that two sets share none before it is common, and an
        # alike pair is met there at the latest.
        common = F.least("p.rest", "q.rest")
        needed = least / (1 + least) * (F.col("p.size") + F.col("q.size")) - SLACK
        pairs = left.alias("q").join(heads, "h").where((F.col("p.root") != F.col("q.root")) & (common >= needed))
        pairs = pairs.select(F.greatest("p.node", "q.node").alias("a"), F.least("p.node", "q.node").alias("b"))
        pairs = pairs.unionByName(likely).distinct() if tried is None else pairs.distinct().join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        fresh = materialize(verified(pairs, sets, least), "links")
        alike, tried = (fresh, pairs) if tried is None else (alike.unionByName(fresh), tried.unionByName(pairs))
        if tried is pairs or not fresh.isEmpty():
            roots = materialize(components(alike), "roots")
        rest = left.drop("root").join(heads.select("h", F.col("p.node").alias("node")), ["h", "node"], "left_anti")
        rest = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rest.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("h")
        after = materialize(rest.join(mixed, "h", "left_semi"), "left")
        discard(left)
        left = after
        if left.isEmpty():
            return roots
        heads_a_bucket, rounds = 8 * heads_a_bucket, rounds + 1


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, of each group of near duplicates one only.

    Near duplicates are alike in at least ``least`` of their word shingles
    (Jaccard, A-Z lower-cased; texts with fewer words: of their whole word
    sequence), or linked by such. Equal sets are one. Sets with too many
    shingles of their own leave; of the rest SimHash links most copies, and the
    prefixes, which no alike pair escapes, all others. Every pair is verified.
    The row with the smallest doc_id stays (rows without one come last; rows of
    one id by the hash of their text). Rows repeated in full count once. All
    wordless texts, null ones included, are one group. Texts of any length are
    hashed in pieces. Columns stay as they are, whatever their names; an empty
    table gives an empty one.
    """
    names = fresh_names(docs, "id", "key", "text")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    scanned = materialize(samples(docs, shingle), "samples")
    nodes = materialize(scanned.groupBy("node").agg(F.min("size").alias("size"), F.min(order).alias("first")), "nodes")
    open_ = materialize(open_nodes(nodes, scanned.select("node", F.explode("sample").alias("h")), least), "open")
    discard(scanned)

    keyed = docs.withColumn(names["key"], F.xxhash64("text"))
    mine = lambda side: keyed["doc_id"].eqNullSafe(side[names["id"]]) & (keyed[names["key"]] == side[names["text"]])
    named = lambda df, *more: df.select(*more, F.col("first.doc_id").alias(names["id"]), F.col("first.key").alias(names["text"]))
    holders = named(open_, "node")
    held = keyed.join(holders, mine(holders)).select(holders["node"], keyed["text"]).dropDuplicates(["node"])
    sets = materialize(shingle_sets(held, shingle), "sets")
    sets = materialize(shared_sets(sets, least), "sets")
    roots = alike_roots(materialize(postings(sets, least), "dealt"), sets, least)
    rooted = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    winners = named(rooted.groupBy("root").agg(F.min("first").alias("first")))
    return keyed.join(winners, mine(winners), "left_semi").dropDuplicates(["doc_id", names["key"]]).select(*docs.columns)
