"""Language identification with error-correcting output codes.

Every language has a codeword. A binary classifier over hashed character
n-grams predicts each bit, and the codeword with the smallest loss over all
bits, weighted by how reliable each bit is, names the language. Counts are
taken over all labelled texts: each task sums its own, so what is gathered is
one count per n-gram bucket and language, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Buckets of hashed n-grams (a power of two), the n-grams, and characters of a
#: text that are hashed at a time.
BUCKETS, GRAMS, CHUNK = 1 << 13, (1, 2, 3), 1 << 20
#: Up to this many languages get every split as a bit, more get drawn codewords.
EXHAUSTIVE = 6
#: The most languages that are learned, those with the most text; bounds the table
#: of counts that reaches the driver.
MOST_LANGUAGES = 512


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1, any two of them far apart.

    Few languages: all 2**(n-1) - 1 splits in two. Many: 15 log2(n) columns from
    a seeded generator, of which the best of 200 draws by the least distance.
    """
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 2 ** (n - 1))
        return np.where(splits[None, :] >> np.arange(n)[:, None] & 1, 1, -1).astype(np.int8)
    width, best, found = int(np.ceil(15 * np.log2(n))), -1, None
    draw = np.random.default_rng(n)
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), (n, width))
        apart = (width - code.astype(int) @ code.T.astype(int)) // 2
        least = int((apart + np.eye(n, dtype=int) * width).min())
        if least > best and (np.abs(code.sum(0)) < n).all():
            best, found = least, code
    return found


def counts(text: str) -> np.ndarray:
    """How many n-grams of the text fall into each bucket."""
    out, text = np.zeros(BUCKETS, np.int64), f" {text.lower()} "
    for at in range(0, len(text), CHUNK):
        c = np.frombuffer(text[at : at + CHUNK + max(GRAMS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        most = len(text) - at if len(text) - at < CHUNK else CHUNK
        for n in GRAMS:
            k = min(most, len(c) - n + 1)
            if k <= 0:
                continue
            h = np.full(k, n, np.uint32)
            for j in range(n):
                h = (h ^ c[j : j + k]) * np.uint32(0x9E3779B1)
            out += np.bincount(h >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return out


@dataclass(frozen=True)
class Model:
    """languages in order, their codewords, and per bit the weights of the
    buckets, an offset and how reliable the bit is."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    reliability: np.ndarray
    ambiguous_below: float = 0.1
    scale: float = field(default=4.0)

    def decode(self, found: np.ndarray) -> tuple[str, float, bool]:
        """Language, score and whether the next one is too close.

        A bit's margin is its mean log-odds per n-gram, pulled to zero for short
        texts. The loss of a codeword is the weighted mean of exp(-margin * bit);
        the score is its share of exp(-loss) over all languages.
        """
        total = found.sum()
        margin = np.clip(self.scale * (found @ self.weights) / (total + 8.0), -4, 4)
        loss = (np.exp(-margin[None, :] * self.code) * self.reliability).sum(1) / self.reliability.sum()
        shares = np.exp(-loss - (-loss).max())
        shares /= shares.sum()
        order = np.argsort(-shares, kind="stable")
        near = len(order) > 1 and shares[order[0]] - shares[order[1]] < self.ambiguous_below
        return self.languages[order[0]], float(shares[order[0]]), bool(near)


def train(docs: DataFrame) -> Model | None:
    """Fit on every row of text and lang that has both; None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                name = lang.as_py()
                sums[name] = sums.get(name, 0) + counts(text.as_py())
        for name, total in sorted(sums.items()):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])

    labelled = docs.select("text", "lang").where("text is not null and lang is not null")
    table = labelled.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most BUCKETS rows for each of MOST_LANGUAGES languages come to the driver.
    table = materialize(table, "ngrams")
    largest = table.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).select("lang")
    found = table.join(largest, "lang", "left_semi").toPandas()
    languages = sorted(found["lang"].unique())
    if not languages:
        return None
    by_lang = np.zeros((len(languages), BUCKETS))
    by_lang[[languages.index(x) for x in found["lang"]], found["bucket"].to_numpy()] = found["n"]
    return fit(languages, by_lang)


def fit(languages: list[str], by_lang: np.ndarray) -> Model:
    """One linear classifier per bit: the log-odds of each bucket between the
    languages with the bit and those without, every language weighing alike."""
    code = codewords(len(languages))
    share = (by_lang + 0.5) / (by_lang + 0.5).sum(1, keepdims=True)
    weights = np.empty((BUCKETS, code.shape[1]))
    for b in range(code.shape[1]):
        ones, zeros = code[:, b] > 0, code[:, b] < 0
        one = share[ones].mean(0) if ones.any() else np.full(BUCKETS, 1 / BUCKETS)
        zero = share[zeros].mean(0) if zeros.any() else np.full(BUCKETS, 1 / BUCKETS)
        weights[:, b] = np.log(one / zero)
    # A bit is as reliable as the languages' own texts are far on its right side.
    margin = (share @ weights) * code
    return Model(languages, code, weights, np.clip(margin.min(0), 0.01, None))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Columns of ``docs`` other than text, and lang_pred, score, ambiguous.

    A null text, one without a letter, or any text if nothing was learned gets
    ``und``, score zero and ambiguous.
    """
    keep = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = []
            for value in batch.column("text"):
                text = value.as_py()
                if known is None or text is None or not any(map(str.isalpha, text)):
                    found.append(("und", 0.0, True))
                else:
                    found.append(known.decode(counts(text)))
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())],
                names=[*keep, "lang_pred", "score", "ambiguous"],
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{schema}{', ' if keep else ''}lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Train on two folds by doc_id and predict every document.

    Returns one row per row of ``docs``: doc_id, held_out (crc32 of the doc_id
    as text leaves 1 modulo 3), lang_pred, score, ambiguous. Only text and lang
    of rows that aren't held out are learned from; a row without doc_id is not
    held out. A prediction reads the text only. Repeated rows each get a row,
    an empty table gives an empty result, extra columns are not read.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = train(rows.where("not held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), model)
