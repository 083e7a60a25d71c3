"""Greedy choices between overlapping boxes and paragraphs of a page."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.functions.boxes import SIDES, Box, min_area, min_side
from pagespark.operators.pages import by_page, group_starts, numbers, spans


def _losers(keys: list, others: list, areas: Sequence[int], other_areas: Sequence[int]) -> dict:
    """Boxes visited in key order; each still there meets its partners in key order: a
    smaller partner goes, a partner at least as large makes the visited one go. Each
    box that goes is given with a pair it is in: (row, whether it is the first)."""
    partners: dict = {}
    for row, (a, b) in enumerate(zip(keys, others)):
        partners.setdefault(a, []).append((b, row, areas[row], other_areas[row]))
        partners.setdefault(b, []).append((a, row, other_areas[row], areas[row]))
    gone: dict = {}
    for box in sorted(partners):
        if box in gone:
            continue
        for other, row, own_area, other_area in sorted(partners[box]):
            if other in gone:
                continue
            if own_area > other_area:
                gone[other] = row
            else:
                gone[box] = row
                break
    return gone


def suppress_overlaps(boxes: DataFrame, page: Sequence[str], key: str, threshold: float = 0.5) -> DataFrame:
    """Boxes left after size-based suppression. Only boxes that overlap another by enough of the smaller one go through
    the greedy step, as pairs. They are paired inside their page, so no box moves for it."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        whole = np.ones(table.num_rows, dtype=bool)  # what has no page, key or side meets nothing
        for name in (*page, key, *SIDES):
            whole &= table[name].is_valid().to_numpy()
        stays = np.ones(table.num_rows, dtype=bool)
        for start, end in spans(starts, table.num_rows):
            rows = start + np.flatnonzero(whole[start:end])
            own = table.take(pa.array(rows))
            boxes = np.stack(numbers(own, *SIDES), axis=1)
            a, b = _overlapping(boxes, threshold)
            if not len(a):
                continue
            names, areas = own[key].to_pylist(), _areas(boxes).tolist()
            pairs = [(i, j) if names[i] < names[j] else (j, i) for i, j in zip(a.tolist(), b.tolist()) if names[i] != names[j]]
            pairs.sort(key=lambda pair: (names[pair[0]], names[pair[1]]))
            gone = _losers([names[i] for i, _ in pairs], [names[j] for _, j in pairs],
                           [areas[i] for i, _ in pairs], [areas[j] for _, j in pairs])
            stays[rows[[i for i, name in enumerate(names) if name in gone]]] = False
        return table.filter(pa.array(stays))

    return by_page(boxes, page, page, ["top", "left", key], run)


def _areas(boxes: np.ndarray) -> np.ndarray:
    return np.maximum(boxes[:, 2] - boxes[:, 0] + 1, 0) * np.maximum(boxes[:, 3] - boxes[:, 1] + 1, 0)


def _overlapping(boxes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a page's boxes, sorted by top, that overlap by enough of the smaller one. A box is
    compared with those that start no lower than it ends."""
    n = len(boxes)
    counts = np.maximum(np.searchsorted(boxes[:, 1], boxes[:, 3], side="right") - np.arange(n) - 1, 0)
    a = np.repeat(np.arange(n), counts)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
    beside = (boxes[a, 0] <= boxes[b, 2]) & (boxes[b, 0] <= boxes[a, 2])
    a, b = a[beside], b[beside]
    first, second = boxes[a], boxes[b]
    meet = (first[:, 1] <= second[:, 3]) & (second[:, 1] <= first[:, 3])
    shared = _areas(np.hstack([np.maximum(first[:, :2], second[:, :2]), np.minimum(first[:, 2:], second[:, 2:])]))
    enough = meet & (shared >= threshold * np.minimum(_areas(first), _areas(second)))
    return a[enough], b[enough]


DECISIONS = {
    "area_threshold": lambda boxes, page, key, p: boxes.filter(min_area(Box.of(), p["area_threshold"])),
    "length_threshold": lambda boxes, page, key, p: boxes.filter(min_side(Box.of(), p["length_threshold"])),
    "size_based_nms": lambda boxes, page, key, p: suppress_overlaps(boxes, page, key, p["intersection_thr"]),
}


def suppress(boxes: DataFrame, page: Sequence[str], key: str, methods: Sequence[str], params: Mapping[str, float]) -> DataFrame:
    """Named decision methods, in the order given."""
    for name in methods:
        if name not in DECISIONS:
            raise ValueError(f"unknown decision method: {name}")
        boxes = DECISIONS[name](boxes, page, key, params)
    return boxes


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    across = min(a[2], b[2]) - max(a[0], b[0]) + 1
    down = min(a[3], b[3]) - max(a[1], b[1]) + 1
    return max(0, across) * max(0, down)


def _area(a: np.ndarray) -> int:
    return max(0, a[2] - a[0] + 1) * max(0, a[3] - a[1] + 1)


def _hull(boxes: np.ndarray) -> np.ndarray:
    return np.concatenate([boxes[:, :2].min(axis=0), boxes[:, 2:].max(axis=0)])


def _free_cut(boxes: np.ndarray, other: np.ndarray) -> int:
    """First cut after which neither part's envelope shares a pixel with ``other``; 0 for none."""
    if len(boxes) < 2:
        return 0
    heads = np.hstack([np.minimum.accumulate(boxes[:, :2]), np.maximum.accumulate(boxes[:, 2:])])[:-1]
    back = boxes[::-1]
    tails = np.hstack([np.minimum.accumulate(back[:, :2]), np.maximum.accumulate(back[:, 2:])])[::-1][1:]
    apart = lambda h: (h[:, 0] > other[2]) | (h[:, 2] < other[0]) | (h[:, 1] > other[3]) | (h[:, 3] < other[1])
    cuts = np.flatnonzero(apart(heads) & apart(tails))
    return int(cuts[0]) + 1 if len(cuts) else 0


class IntervalIndex:
    """Boxes by their tops and bottoms, kept sorted while boxes come and go; gives those that share a pixel with one."""

    def __init__(self) -> None:
        self.boxes: dict[int, np.ndarray] = {}
        self.tops: list[tuple[int, int]] = []
        self.bottoms: list[tuple[int, int]] = []

    def add(self, name: int, box: np.ndarray) -> None:
        self.boxes[name] = box
        insort(self.tops, (int(box[1]), name))
        insort(self.bottoms, (int(box[3]), name))

    def remove(self, name: int) -> None:
        box = self.boxes.pop(name)
        del self.tops[bisect_left(self.tops, (int(box[1]), name))]
        del self.bottoms[bisect_left(self.bottoms, (int(box[3]), name))]

    def meeting(self, box: np.ndarray) -> list[int]:
        """Names of the boxes that share a pixel with ``box``, in order: of those that begin above its end and
        those that end below its begin the fewer are looked at."""
        begun = bisect_right(self.tops, (int(box[3]), float("inf")))
        ended = bisect_left(self.bottoms, (int(box[1]), -1))
        few = self.tops[:begun] if begun <= len(self.bottoms) - ended else self.bottoms[ended:]
        return sorted(name for _, name in few if _shared(self.boxes[name], box))


class Overlaps:
    """The paragraphs of a page, by names that grow, and the pairs of them that meet."""

    def __init__(self, parts: list[np.ndarray], boxes: np.ndarray):
        self.words = boxes
        self.parts: dict[int, np.ndarray] = {}
        self.index = IntervalIndex()
        self.pairs: list[tuple[int, int]] = []
        self.last = -1
        self.change([], parts)

    def change(self, gone: Sequence[int], added: list[np.ndarray]) -> None:
        lost = set(gone)
        self.pairs = [pair for pair in self.pairs if not lost.intersection(pair)]
        for name in gone:
            self.index.remove(name)
            del self.parts[name]
        for part in added:
            self.last += 1
            hull = _hull(self.words[part])
            self.pairs += [(other, self.last) for other in self.index.meeting(hull)]
            self.parts[self.last] = part
            self.index.add(self.last, hull)
        self.pairs.sort()

    def settle(self, compat: bool) -> bool:
        """One round: contained paragraphs go, then paragraphs are cut where that frees both parts. Whether anything changed."""
        hulls, gone, added = self.index.boxes, set(), []
        for i, j in self.pairs:
            if i in gone or j in gone:
                continue
            shared, area_i, area_j = _shared(hulls[i], hulls[j]), _area(hulls[i]), _area(hulls[j])
            measure = shared / (area_i + area_j - shared) if compat else shared
            if area_i >= area_j and measure >= 0.95 * area_j:
                gone.add(j)
            elif area_j >= area_i and measure >= 0.95 * area_i:
                gone.add(i)
        for i, j in self.pairs:
            if i in gone or j in gone:
                continue
            for a, b in ((i, j), (j, i)):
                cut = _free_cut(self.words[self.parts[a]], hulls[b])
                if cut:
                    added += [self.parts[a][:cut], self.parts[a][cut:]]
                    gone.add(a)
        self.change(sorted(gone), added)
        return bool(gone)


def resolve_overlaps(words: DataFrame, page: Sequence[str], paragraph: str, order: str, compat: bool = False,
                     rounds: int = 3) -> DataFrame:
    """Paragraphs of a page without contained ones, and cut in two where that frees both
    parts from another. Takes words with their paragraph; returns the words that are left
    with ``par``, the paragraph's new place. ``compat`` measures containment by IoU
    against an area, as only boxes of about a pixel can meet."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        boxes = np.stack(numbers(table, *SIDES), axis=1)
        begins = group_starts(table, [*page, paragraph])
        rows, places = [], []
        for start, end in spans(starts, table.num_rows):
            inner = begins[(begins >= start) & (begins < end)]
            parts = [np.arange(a, b) for a, b in zip(inner, np.append(inner[1:], end))]
            page_parts = Overlaps(parts, boxes)
            for _ in range(rounds):
                if not page_parts.settle(compat):
                    break
            parts = list(page_parts.parts.values())
            rows += parts
            places += [np.full(len(p), i) for i, p in enumerate(parts)]
        flat = lambda arrays: np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
        out = table.select([*page, order, *SIDES]).take(pa.array(flat(rows)))
        return out.append_column("par", pa.array(flat(places), pa.int64()))

    slim = words.select(*page, paragraph, order, *SIDES)
    return by_page(slim, page, page, [paragraph, order], run, "par bigint", keep=[*page, order, *SIDES])


def _components(page: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray,
                gap: int) -> np.ndarray:
    """Component label of each box; boxes are sorted by page and top. A box is compared
    with those that start no lower than just under it; pages are set apart by a shift."""
    n = len(top)
    shift = page * (int(max(bottom.max(), top.max()) - min(top.min(), bottom.min())) + 3)
    ends = np.searchsorted(top + shift, bottom + shift + 1, side="right")
    counts = np.maximum(ends - np.arange(n) - 1, 0)
    a = np.repeat(np.arange(n), counts)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
    near = np.maximum(left[a], left[b]) - np.minimum(right[a], right[b]) - 1 <= gap
    a, b = a[near], b[near]
    labels = np.arange(n)
    while True:
        before = labels.copy()
        np.minimum.at(labels, a, labels[b])
        np.minimum.at(labels, b, labels[a])
        labels = labels[labels]
        if np.array_equal(labels, before):
            return labels


def link_lines(words: DataFrame, page: Sequence[str], key: str = "tag", gap: int = 20) -> DataFrame:
    """Words linked to lines: boxes at most ``gap`` pixels apart on touching rows are one
    line. Adds ``line``, numbered from the top of the page."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n = table.num_rows
        page_no = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        labels = _components(page_no, *numbers(table, *SIDES), gap)
        firsts, line = np.unique(labels, return_inverse=True)
        before = np.searchsorted(firsts, starts)  # lines on the pages before
        return table.append_column("line", pa.array(line - before[page_no], pa.int64()))

    slim = words.select(*page, *[c for c in words.columns if c not in page])
    return by_page(slim, page, page, ["top", "left", key], run, "line bigint")
