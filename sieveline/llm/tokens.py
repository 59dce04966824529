"""Token counts by section from one encoding of the whole document.

A document is encoded once; the bytes of its tokens give their character spans,
which are joined to the spans of its sections by a sorted interval search. A
token that crosses a boundary is given away by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that goes with the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("most", "first", "last")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file of lines ``base64 rank``; read on the driver, some 1 MB."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Tokens of a text with their spans in characters."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self._bytes[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends (exclusive); a token within a character's bytes
        has the span of that character."""
        ids = np.array(self._encoding.encode_ordinary(text), np.int64)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self._bytes[ids])
        if not len(ids):
            return ids, end, end
        return ids, character[end - self._bytes[ids]], character[end - 1] + 1


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines; a line's own line feed belongs to it."""
    feeds = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    start = np.concatenate(([0], feeds))
    return start, np.append(feeds, len(text))


def attribute(start: np.ndarray, end: np.ndarray, sec_start: np.ndarray, sec_end: np.ndarray, rule: str = "most") -> np.ndarray:
    """The section of each token, -1 where it touches none.

    Sections are sorted and don't overlap. A token in several goes to the one
    with most of its characters, the earlier at a tie, or to the first or last.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    # Empty sections touch nothing and are left out of the search.
    at = np.flatnonzero(sec_end > sec_start)
    s, e = sec_start[at], sec_end[at]
    low = np.searchsorted(e, start, side="right")
    high = np.searchsorted(s, end, side="left") - 1
    out = np.where(low <= high, high if rule == "last" else low, -1)
    for k in np.flatnonzero(low < high) if rule == "most" else ():
        over = np.minimum(e[low[k] : high[k] + 1], end[k]) - np.maximum(s[low[k] : high[k] + 1], start[k])
        out[k] = low[k] + int(np.argmax(over))
    return np.where(out >= 0, at[out] if len(at) else -1, -1)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "most", pattern: str = PATTERN) -> DataFrame:
    """Tokens of every line of every document.

    Returns a row per section: doc_id, section (from 0), start, end (characters),
    n_tokens, n_crossing (tokens of it that cross a boundary), doc_tokens. The
    n_tokens of a document sum to its doc_tokens. If ``docs`` has an array column
    ``sections`` of (start, end), sorted and disjoint (others raise), these are
    used instead of lines; tokens outside all of them are in a row with a null
    section. A null text is empty and an empty text has one empty line; texts of
    any length are encoded whole. Repeated rows each get rows; an empty table
    gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    own = "sections" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, columns = [], [[] for _ in range(6)]
                for k, value in enumerate(part.column("text")):
                    text = value.as_py() or ""
                    if own:
                        given = part.column("sections")[k].as_py() or []
                        sec_start, sec_end = (np.array([s[x] for s in given], np.int64) for x in ("start", "end"))
                        if (sec_start > sec_end).any() or (sec_start[1:] < sec_end[:-1]).any():
                            raise ValueError("sections have to be sorted and disjoint")
                    else:
                        sec_start, sec_end = line_sections(text)
                    _, start, end = encoder.spans(text)
                    section = attribute(start, end, sec_start, sec_end, rule)
                    n = len(sec_start)
                    crossing = section >= 0
                    crossing[crossing] = (start[crossing] < sec_start[section[crossing]]) | (end[crossing] > sec_end[section[crossing]])
                    counts = np.bincount(section + 1, minlength=n + 1)
                    crossed = np.bincount(section[crossing] + 1, minlength=n + 1)
                    first = 0 if counts[0] else 1
                    rows += [k] * (n + 1 - first)
                    for column, values in zip(columns, (np.arange(-1, n), np.append(-1, sec_start), np.append(-1, sec_end), counts, crossed, np.full(n + 1, len(start))), strict=True):
                        column.append(values[first:])
                flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
                gap = flat[0] < 0
                arrays = [pa.array(v.astype(np.int64), mask=gap if i < 3 else None) for i, v in enumerate(flat)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), *arrays], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "text", *["sections"] * own]
    return docs.select(*[F.col(c) for c in columns]).mapInArrow(run, f"doc_id {kind}, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint")
