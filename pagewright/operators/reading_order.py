"""Reading order of a page's lines by recursive white-space cuts; one group is one page."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .grouped import fold_groups

COLUMN_GAP, ROW_GAP, DEPTH = 0.75, 1.1, 32


def _widest_gap(spans: list[tuple[float, float]], least: float) -> float | None:
    """Middle of the widest stretch no span covers, if it is wider than ``least``."""
    spans = sorted(spans)
    best, middle, reach = least, None, spans[0][1]
    for begin, end in spans[1:]:
        if begin - reach > best:
            best, middle = begin - reach, (begin + reach) / 2
        reach = max(reach, end)
    return middle


def ordered(boxes: list[tuple[float, float, float, float]], body: float, depth: int = 0) -> list[int]:
    """Indices of the boxes (x, y, width, height; y grows upwards) in reading order: column cuts first, then rows."""

    def cut(held: list[int], depth: int) -> list[int]:
        if len(held) < 2 or depth >= DEPTH:
            return sorted(held, key=lambda i: (-boxes[i][1], boxes[i][0]))
        at = _widest_gap([(boxes[i][0], boxes[i][0] + boxes[i][2]) for i in held], COLUMN_GAP * body)
        if at is not None:
            return cut([i for i in held if boxes[i][0] < at], depth + 1) + cut([i for i in held if boxes[i][0] >= at], depth + 1)
        at = _widest_gap([(boxes[i][1], boxes[i][1] + boxes[i][3]) for i in held], ROW_GAP * body)
        if at is not None:
            return cut([i for i in held if boxes[i][1] >= at], depth + 1) + cut([i for i in held if boxes[i][1] < at], depth + 1)
        return sorted(held, key=lambda i: (-boxes[i][1], boxes[i][0]))

    return cut(list(range(len(boxes))), depth)


def reading_order(lines: DataFrame, body: float = 11.0) -> DataFrame:
    """doc_id, page_no, row_no, ord for lines with x, y, w, h."""

    def page(group: list[tuple]) -> list[tuple]:
        order = ordered([row[3:] for row in group], body)
        return [(*group[i][:3], k) for k, i in enumerate(order)]

    wanted = lines.select("doc_id", "page_no", "row_no", "x", "y", "w", "h")
    return fold_groups(wanted, ["doc_id", "page_no"], ["row_no"], page, "doc_id long, page_no int, row_no int, ord int")
