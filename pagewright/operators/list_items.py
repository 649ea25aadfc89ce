"""Lists: markers chained into runs, and runs that are accepted as lists.

A document's blocks are read in order.  Blocks shaped like items chain by the family of their marker; a run is
judged once all its blocks are known, by what its members say, and an accepted run becomes items of pieces
that nothing interrupts.  The chain depends on what came before, so a document is one group: an ordered fold in
batch, and ``ListStream`` for blocks that arrive a page at a time, which lets go of a run three pages after its last member.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .grouped import fold_groups

# Bullets, the share of letters in an item, and what tells entries, problems and references from items.
BULLETS = "•-+*"
ITEM_SHARE = 0.35
HORIZON = 3
EXERCISES = {"practice", "exercise", "exercises"}
ENTRY = re.compile(r"\s[0-9]{1,4}(?:\.[0-9]{1,2})?\s*$|\s[0-9]{1,2}\.[0-9]{1,2}\s+[^\W\d_a-z]")
PROBLEM = re.compile(r"\b(?:[Ff]ind|[Hh]ow (?:much|many|long|far|wide|old))\b")
REFERENCE = re.compile(r",\s(?:1[89]|20)[0-9]{2}[a-z]?:\s|https?://|doi\.org/|\bdoi:")
AUTHOR = re.compile(r"^(?:[a-zß-ÿ]+\s)?[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+)?,\s+(?:[A-ZÀ-Þ]\.){1,3}[,\s]")
WORDS = re.compile(r"[^\W\d_]{3,}")
NUMBERED = re.compile(r"^([0-9]{1,3})([.)])")

SCHEMA = "doc_id long, seq int, kind string, marker string, ordinal int, level int, opens boolean, text string"


@dataclass(frozen=True)
class Marker:
    family: str
    printed: str
    value: int | None
    length: int


def reads_as_item(body: str) -> bool:
    letters = sum(map(len, WORDS.findall(body)))
    return letters > 0 and letters >= ITEM_SHARE * len(body)


def holds_number(body: str) -> bool:
    return any(c.isnumeric() for c in set(body))


def plus_bullet(text: str) -> bool:
    return bool(re.match(r"\+\s+(?:[^\W\d_]{2}|[0-9]+%)", text)) and reads_as_item(text[2:])


def marker(text: str) -> Marker | None:
    """The list marker that opens a text: a bullet, a number or a letter, and white space."""
    if m := re.match(r"([•*+-])\s+", text):
        glyph, body = m[1], text[m.end() :]
        refused = (glyph == "*" and body.startswith("*")) or (glyph == "+" and not plus_bullet(text))
        return None if refused else Marker(f"bullet {glyph}", glyph, None, m.end())
    if m := re.match(r"([A-Za-z])([.)])\s+", text):
        case = "A" if m[1].isupper() else "a"
        return Marker(f"letter {case}{m[2]}", m[1] + m[2], ord(m[1].lower()) - 96, m.end())
    if m := re.match(r"([0-9]{1,3})([.)])\s+", text):
        return Marker(f"number {m[2]}", m[1] + m[2], int(m[1]), m.end())
    return None


def entry_marker(text: str) -> Marker | None:
    m = NUMBERED.match(text)
    return Marker(f"number {m[2]}", m[0], int(m[1]), len(m[0])) if m else None


@dataclass
class Block:
    """A block of a document; ``shaped`` ones stand like list items, ``recognized`` ones come from a reading of an image."""

    seq: int
    page: int
    kind: str
    text: str
    recognized: bool = False
    edge: float | None = None
    size: float | None = None
    # set while lists are built; place: which of the document's blocks it is
    place: int = 0
    shaped: bool = False
    marker: Marker | None = None
    run: int | None = None
    before: dict = field(default_factory=dict)
    item: tuple | None = None


@dataclass
class Run:
    family: str
    members: list[Block]

    @property
    def last(self) -> Block:
        return self.members[-1]

    def takes(self, m: Marker, page: int) -> bool:
        if page - self.last.page > 1:
            return False
        if m.family.startswith("bullet"):
            return True
        return m.value != 1 and 1 <= abs(m.value - self.last.marker.value) <= 2


class Builder:
    """Blocks in, the same blocks with items settled out."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.runs: list[Run] = []
        self.latest: dict[str, Run] = {}
        self.apparatus: dict[tuple[int, str], int] = {}
        self.siblings: dict[str, Marker] = {}
        self.heading, self.shaped_page, self.entry = "", None, None

    def accept(self, block: Block) -> None:
        """Take the next block; runs that ended ``HORIZON`` pages ago are judged by what is known by now."""
        self._take(block)
        self.settle(block.page - HORIZON)

    def _take(self, block: Block) -> None:
        block.place = len(self.blocks)
        self.blocks.append(block)
        if block.kind == "heading":
            self.heading = block.text
        plus = block.kind == "paragraph" and plus_bullet(block.text)
        block.shaped = block.kind == "preformatted" or plus
        if not block.shaped:
            return
        found = marker(block.text) if "\n" not in block.text else None
        block.before = {"page": self.shaped_page, "entry": self.entry, "sibling": self.siblings.get(found.family) if found else None}
        self.shaped_page, self.entry = block.page, None
        if found:
            self.siblings[found.family] = found
        numbered = bool(found) and found.family.startswith("number")
        exercise = numbered and not block.recognized and any(w.lower() in EXERCISES for w in re.findall(r"[^\W\d_]+", self.heading))
        if found and (not block.recognized or numbered) and (reads_as_item(block.text[found.length :]) or exercise):
            block.marker = found
            self._chain(block)
            return
        self.latest = {}
        if entry := entry_marker(block.text):
            key = block.page, entry.family
            self.apparatus[key] = self.apparatus.get(key, 0) + 1
            self.entry = entry

    def _chain(self, block: Block) -> None:
        run = self.latest.get(block.marker.family)
        if run and run.takes(block.marker, block.page):
            run.members.append(block)
        else:
            run = Run(block.marker.family, [block])
            self.runs.append(run)
            self.latest[run.family] = run

    # -- judging --------------------------------------------------------------------------------------------

    def settle(self, page: int | None = None) -> list[Run]:
        """Judge the runs whose last member stands on ``page`` or before it (all, without a page)."""
        done = [r for r in self.runs if page is None or r.last.page <= page]
        if not done:
            return done
        for run in done:
            self._judge(run)
        self.runs = [r for r in self.runs if not any(r is d for d in done)]
        self.latest = {f: r for f, r in self.latest.items() if not any(r is d for d in done)}
        return done

    def _judge(self, run: Run) -> None:
        places = [b.place for b in run.members]

        def together(i: int, j: int, among: bool = False) -> bool:
            return all(b.kind == "page" or (among and b.marker is not None) for b in self.blocks[i + 1 : j])

        if len(places) < 2:
            self._lone(run.members[0], places[0])
            return
        pairs = list(zip(places, places[1:], strict=False))
        if not run.family.startswith("bullet"):
            values = [b.marker.value for b in run.members]
            rising = all(b == a + 1 for a, b in zip(values, values[1:], strict=False))
            if not rising or not any(together(i, j, run.family.startswith("number")) for i, j in pairs):
                return
            if run.family.startswith("number") and self._is_apparatus(run, places, values):
                return
        piece: list[int] = []
        for place in places:
            if piece and not together(piece[-1], place):
                self._close(piece)
                piece = []
            piece.append(place)
        self._close(piece)

    def _is_apparatus(self, run: Run, places: list[int], values: list[int]) -> bool:
        """Contents, problems, references, or part of a longer numbering that isn't a list."""
        texts, n = [b.text for b in run.members], len(run.members)
        bodies = [b.text[b.marker.length :] for b in run.members]
        entries = sum(bool(ENTRY.search(t)) for t in texts)
        problems = sum(holds_number(b) and ("?" in b or bool(PROBLEM.search(b))) for b in bodies)
        references = sum(bool(REFERENCE.search(t) or AUTHOR.search(b)) for t, b in zip(texts, bodies, strict=True))
        others = sum(self.apparatus.get((page, run.family), 0) for page in {b.page for b in run.members})
        after = next((b for b in self.blocks[places[-1] + 1 :] if b.shaped), None)
        follows = entry_marker(after.text) if after is not None and after.marker is None else None
        neighbours = ((run.members[0].before["entry"], values[0] - 1), (follows, values[-1] + 1))
        continued = any(m is not None and m.family == run.family and m.value == v for m, v in neighbours)
        return entries * 2 >= n or problems * 2 > n or references * 2 >= n or others > n or continued

    def _close(self, piece: list[int]) -> None:
        if len(piece) < 2:
            for place in piece:
                self._paragraph(self.blocks[place])
            return
        for k, place in enumerate(piece):
            b = self.blocks[place]
            kind = {"b": "unordered", "n": "ordered", "l": "lettered"}[b.marker.family[0]]
            b.item = (kind, b.marker.printed, b.marker.value, self._level(b, place), k == 0, b.text[b.marker.length :])

    def _level(self, block: Block, place: int) -> int:
        if not block.marker.family.startswith("letter") or block.edge is None or block.size is None:
            return 0
        for i in range(place - 1, -1, -1):
            above = self.blocks[i]
            if above.kind == "page":
                continue
            if above.item is None or above.edge is None:
                return 0
            shift = block.edge - above.edge
            if block.size * 0.75 <= shift <= block.size * 5:
                return above.item[3] + 1
            if shift < -block.size * 0.75:
                return 0
        return 0

    def _lone(self, block: Block, place: int) -> None:
        """A marker without others of its kind is a paragraph's, unless its neighbours are shaped alike."""
        after = [b for b in self.blocks[place + 1 :] if b.shaped]
        near = (block.before["page"] is not None and block.page - block.before["page"] <= 1) or (after and after[0].page - block.page <= 1)
        if block.marker.family == "bullet *" or near:
            return
        if block.marker.value is not None:
            markers = (marker(b.text) or entry_marker(b.text) for b in after)
            following = next((m for m in markers if m and m.family == block.marker.family), None)
            if any(m is not None and 1 <= abs(m.value - block.marker.value) <= 2 for m in (block.before["sibling"], following)):
                return
        self._paragraph(block)

    @staticmethod
    def _paragraph(block: Block) -> None:
        if block.kind == "preformatted":
            block.kind = "paragraph"


def rows_of(doc_id, blocks: list[Block]) -> list[tuple]:
    out = []
    for b in blocks:
        kind, mark, value, level, opens, text = b.item or (b.kind, None, None, None, None, b.text)
        out.append((doc_id, b.seq, kind, mark, value, level, opens, text))
    return out


def build_lists(blocks: DataFrame) -> DataFrame:
    """doc_id, seq, kind, marker, ordinal, level, opens, text from doc_id, seq, page, kind, text, recognized, edge, size."""

    def one(group: list[tuple]) -> list[tuple]:
        builder = Builder()
        for _, seq, page, kind, text, recognized, edge, size in group:
            builder.accept(Block(seq, page, kind, text or "", bool(recognized), edge, size))
        builder.settle()
        return rows_of(group[0][0], builder.blocks)

    wanted = blocks.select("doc_id", "seq", "page", "kind", "text", "recognized", "edge", "size")
    return fold_groups(wanted, ["doc_id"], ["seq"], one, SCHEMA)


class ListStream:
    """Pages in, settled blocks out: a run is judged, and what stands before any open run let go, ``HORIZON`` pages after it."""

    def __init__(self) -> None:
        self.builder, self.sent = Builder(), 0

    def page(self, blocks: list[Block]) -> list[Block]:
        for block in blocks:
            self.builder.accept(block)
        return self._settled()

    def finish(self) -> list[Block]:
        self.builder.settle()
        return self._settled()

    def _settled(self) -> list[Block]:
        held = min((r.members[0].place for r in self.builder.runs), default=len(self.builder.blocks))
        out = self.builder.blocks[self.sent : held]
        self.sent = held
        return out
