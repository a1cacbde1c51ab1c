"""Splitting oversized items at natural boundaries.

Method: agglomerative merging.  A text is cut into atomic segments (sentences;
words of a sentence that is too long; slices of a word that is too long).
Adjacent segments are held in a heap by the strength of the boundary between
them, and the weakest boundaries are merged first while the combined size plus
the overlap fits the limit.  What remains are cuts at the strongest boundaries.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from vectrine.functions.arrow_vectors import flat

_RUN = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…;:]['\")\]»”’]*(?=\s)|[。！？；]+[」』”’]*")
#: Strength of a boundary by its kind.
SLICE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)


@dataclass(frozen=True)
class SplitConfig:
    limit: int = 2000
    overlap: int = 200

    @property
    def core(self) -> int:
        """Most characters of a piece before its overlap."""
        return self.limit - self.overlap


def normalise(text: str) -> tuple[str, dict[int, int]]:
    """The text with each white-space run as one character (a line feed if the run has one, else a blank), and the strength of each run that ends a line, by the place after it."""
    out, strong, last, size = [], {}, 0, 0
    text = text.strip()
    for m in _RUN.finditer(text):
        breaks = m.group().count("\n") + ("\u2029" in m.group()) * 2
        out.append(text[last : m.start()])
        size += m.start() - last + 1
        out.append("\n" if breaks else " ")
        if breaks:
            strong[size] = PARAGRAPH if breaks > 1 else LINE
        last = m.end()
    out.append(text[last:])
    return "".join(out), strong


def _boundaries(text: str, strong: dict[int, int]) -> dict[int, int]:
    """Places where a sentence or line ends, with their strength."""
    found = dict(strong)
    for m in _SENTENCE.finditer(text):
        at = m.end()
        if at < len(text) and text[at].isspace():
            at += 1
        if at < len(text):
            found[at] = max(found.get(at, 0), CLAUSE if m.group()[0] in ";:；" else SENTENCE)
    return found


def _atoms(text: str, found: dict[int, int], core: int) -> tuple[list[int], list[int]]:
    """Starts of the atomic segments, and the strength of the boundary before each."""
    starts, force = [], []
    cuts = [0, *sorted(found), len(text)]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        starts.append(a)
        force.append(found.get(a, SLICE))
        if b - a <= core:
            continue
        place = a
        while place < b:  # words of a long sentence, slices of a long word
            gap = text.find(" ", place, b)
            end = b if gap < 0 else gap + 1
            if place > a:
                starts.append(place)
                force.append(WORD)
            for cut in range(place + core, end, core):
                starts.append(cut)
                force.append(SLICE)
            place = end
    return starts, force


def cores(text: str, strong: dict[int, int], cfg: SplitConfig) -> list[int]:
    """Starts of the pieces without their overlaps."""
    starts, force = _atoms(text, _boundaries(text, strong), cfg.core)
    n = len(starts)
    ends = [*starts[1:], len(text)]
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(force[j], ends[j] - starts[j - 1], j, j - 1, ends[j]) for j in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, size, j, i, end = heapq.heappop(heap)
        if not alive[j] or prv[j] != i or ends[j] != end or size != end - starts[i]:
            continue  # one side was merged since
        if size + cfg.overlap > cfg.limit:
            continue  # both sides only grow, so this boundary stays
        alive[j] = False
        ends[i] = end
        k = nxt[i] = nxt[j]
        if k < n:
            prv[k] = i
            heapq.heappush(heap, (force[k], ends[k] - starts[i], k, i, ends[k]))
        if prv[i] >= 0:
            heapq.heappush(heap, (force[i], end - starts[prv[i]], i, prv[i], end))
    return [s for s, a in zip(starts, alive) if a]


def split(text: str | None, cfg: SplitConfig = SplitConfig()) -> list[tuple[int, int, int, str]]:
    """(core start, start, end, piece) in the normalised text, in order.

    A text that fits is one piece; a null, empty or blank one gives none.
    """
    if not text or not (text := text.strip()):
        return []
    plain, strong = normalise(text)
    if len(plain) <= cfg.limit:
        return [(0, 0, len(plain), plain)]
    starts = cores(plain, strong, cfg)
    out = []
    for a, b in zip(starts, [*starts[1:], len(plain)]):
        start = a
        if a and cfg.overlap:
            low = a - cfg.overlap
            gap = max(plain.find(" ", low - 1, a - 1), -1) if low > 0 else low - 1
            line = plain.find("\n", max(0, low - 1), a - 1)
            word = min((x for x in (gap, line) if x >= 0), default=-1) + 1
            start = word if low <= word < a and word > 0 else max(0, low)
        end = b - 1 if plain[b - 1].isspace() else b
        out.append((a, start, end, plain[start:end]))
    return out


_SCHEMA = "id string, piece_no int, core_start int, start int, end int, piece string"


def _run(cfg: SplitConfig):
    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(flat(b.column(0)).to_pylist(), flat(b.column(1)).to_pylist()):
                rows += [(i, n, *p) for n, p in enumerate(split(t, cfg))]
                if len(rows) > 20000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "piece_no", "core_start", "start", "end", "piece"])


def split_oversized(df: DataFrame, record: Column, text: Column, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """(id, piece_no, core_start, start, end, piece): every text in pieces of at most ``cfg.limit`` characters.

    Sizes are of the text with white-space runs as one character and none at
    the ends, which is also the text that ``start`` and ``end`` point into.
    The parts from one ``core_start`` to the next make up the whole text; each
    piece but the first also repeats up to ``cfg.overlap`` characters before
    its core, from a word's start where there is one.  Null, empty and blank
    texts give no piece; a null id stays null.  Rows that repeat an id are
    split each; a text may be of any length.  An empty table gives an empty
    result.  Other columns play no part.
    """
    return df.select(record.cast("string").alias("id"), text.alias("t")).filter("t is not null").mapInArrow(_run(cfg), _SCHEMA)
