"""Substring dedup by line and paragraph hashing: repeated passages go, their first occurrence stays.

Units of a text, normalised (lower case, single blanks) and hashed, are
- whole lines and sentences of `least_words` words or more (a paragraph without breaks is one line);
- windows of `window` words, across lines, chosen by their content: of any `caught` - `window` neighbouring windows the
  one of the least hash is a unit, so two texts that share `caught` words in a row share a unit inside them, wherever
  the passage stands and whatever it runs into;
- shorter sentences of `edge_words` words or more, which only count next to one of the others: they bring the ends of a
  passage that the windows leave over.

Digests are grouped over all documents; the occurrence in the document ranked first (least doc_id) stays, and of equal
lines within a document the first one. What repeats is removed, with the short repeated sentences that touch it; overlapping spans are joined. Shorter common lines remain. Removed spans keep their offsets (code points) in the
original text.

Scale: only digests travel, one row for each distinct unit of a document, pre-aggregated, so a line that a third of
all documents share is one row for each task. Then repeated digests are joined back; large ones are split by skew-join.
Time is linear in the length of a text, however long.

Defined results: null and empty texts have no units. A null doc_id ranks last; rows that share a doc_id, or have none,
are one document and don't remove each other's units, so repeated rows stay. Other input columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_texts, written
from quern.llm.near_dup import GOLD, Words, mixed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True
LAST = (1 << 63) - 1
LINE, WINDOW, SENTENCE, EDGE = 1, 2, 3, 4


class Units(NamedTuple):
    """Arrays with a place for each unit: its first word, the word after its last, its digest and kind."""

    first: np.ndarray
    after: np.ndarray
    digest: np.ndarray
    kind: np.ndarray


class Cutter:
    """Finds the units of texts."""

    def __init__(self, least_words: int = 25, window: int = 32, caught: int = 51, edge_words: int = 3):
        if window & (window - 1) or not window < caught:
            raise ValueError("window must be a power of two, and less than caught")
        self.least_words, self.window, self.near, self.edge_words = least_words, window, caught - window, edge_words
        self._words = Words()

    def units(self, text: str | None) -> Units:
        raw = text.lower().encode("utf-8", "surrogatepass") if text else b""  # which has as many words
        ids, starts, stops = self._words.of(raw)
        chars = np.frombuffer(raw, np.uint8)
        line_ends = np.unique(np.append(np.searchsorted(starts, np.flatnonzero(chars == 10)), len(ids)))
        ends = np.unique(np.append(line_ends, np.flatnonzero(STOP[chars[stops - 1]]) + 1))
        sentences = _runs(ids, ends, self.edge_words, SENTENCE)
        sentences.kind[sentences.after - sentences.first < self.least_words] = EDGE
        return Units(*map(np.concatenate, zip(_runs(ids, line_ends, self.least_words, LINE), sentences, self._windows(ids), strict=True)))

    def _windows(self, ids: np.ndarray) -> Units:
        """The windows whose hash is the least of `near` neighbouring ones, the last of equals."""
        if len(ids) < self.window:
            return Units(*np.empty((4, 0), np.int64))
        h, width = ids, 1
        while width < self.window:
            h, width = mixed(h[:-width] * GOLD + h[width:]), 2 * width
        h = mixed(h + np.uint64(WINDOW))
        near = min(self.near, len(h))
        back = np.lib.stride_tricks.sliding_window_view(h[::-1], near)
        at = np.unique(len(h) - 1 - np.arange(len(back)) - back.argmin(axis=1))
        return Units(at, at + self.window, h[at].view(np.int64), np.full(len(at), WINDOW))


    def repeats_lines(self, text: str | None) -> bool:
        """Whether a whole line of least_words words or more stands twice in the text."""
        lines = [words for line in (text or "").split("\n") if len(line) >= 2 * self.least_words - 1 and len(words := line.lower().split()) >= self.least_words]
        return len(lines) > 1 and len({" ".join(words) for words in lines}) < len(lines)


def _runs(ids: np.ndarray, ends: np.ndarray, least: int, kind: int) -> Units:
    """The runs of words that end at `ends`, as units if they have `least` words."""
    ends = ends[ends > 0]
    if not len(ends):
        return Units(*np.empty((4, 0), np.int64))
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(ids)) - np.repeat(starts, ends - starts)
    digest = mixed(np.add.reduceat(mixed(ids + place.astype(np.uint64) * GOLD), starts) + (ends - starts).astype(np.uint64) * GOLD + np.uint64(kind))
    good = ends - starts >= least
    return Units(starts[good], ends[good], digest[good].view(np.int64), np.full(good.sum(), kind))


def removed(text: str | None, units: Units, elsewhere: Iterable[int]) -> list[tuple[int, int]]:
    """Spans to remove, given the digests that an earlier document holds."""
    hit = np.isin(units.digest, np.fromiter(elsewhere, np.int64))
    lines = np.flatnonzero(units.kind == LINE)
    again = np.ones(len(lines), bool)
    again[np.unique(units.digest[lines], return_index=True)[1]] = False
    hit[lines[again]] = True
    if not (hit & (units.kind != EDGE)).any():
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    sure, edges = [], []
    for a, b, kind in zip(units.first[hit].tolist(), units.after[hit].tolist(), units.kind[hit].tolist(), strict=True):
        (edges if kind == EDGE else sure).append((spans[a][0], spans[b - 1][1]))
    return joined(sure, edges)


def joined(sure: list[tuple[int, int]], edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of sure, overlapping ones as one, with the runs of edges that touch them (one blank apart, at most)."""
    out, any_sure = [], []
    for start, end, good in sorted([(*s, True) for s in sure] + [(*s, False) for s in edges]):
        if out and start <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], end))
            any_sure[-1] |= good
        else:
            out.append((start, end))
            any_sure.append(good)
    return [s for s, good in zip(out, any_sure, strict=True) if good]


def drop_repeats(docs: DataFrame, cutter: Callable[[], Cutter] = Cutter) -> DataFrame:
    """docs(doc_id, text) to doc_id, text (what stays), removed array<struct<start,end,words>>, a row for each row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def hashes():
        cut = cutter()
        return lambda texts: {"digests": [np.unique(cut.units(t).digest) for t in texts]}

    each = map_texts(docs, hashes, "digests array<bigint>").select(F.coalesce("doc_id", F.lit(LAST)).alias("rank"), F.explode("digests").alias("digest"))
    each = written(each, "units")
    first = each.groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").select("digest", "first")
    again = each.join(first, "digest").where("rank > first").groupBy("rank").agg(F.collect_set("digest").alias("elsewhere"))
    full = docs.withColumn("rank", F.coalesce("doc_id", F.lit(LAST))).join(again, "rank", "left")

    def cut_out(batches):
        import pyarrow as pa

        cut = cutter()
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
        for b in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):  # bounds the Python objects at one time
            kept, gone = [], []
            for text, elsewhere in zip(b.column("text").to_pylist(), b.column("elsewhere").to_pylist(), strict=True):
                runs = removed(text, cut.units(text), elsewhere or ()) if elsewhere or cut.repeats_lines(text) else []
                at, parts = 0, []
                for s, e in runs:
                    parts.append(text[at:s])
                    at = e
                kept.append(None if text is None else "".join([*parts, text[at:]]))
                gone.append([{"start": s, "end": e, "words": len(WORD.findall(text, s, e))} for s, e in runs])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.string()), pa.array(gone, spans)], names=["doc_id", "text", "removed"])

    return full.select("doc_id", "text", "elsewhere").mapInArrow(cut_out, "doc_id bigint, text string, removed array<struct<start:bigint,end:bigint,words:bigint>>")
