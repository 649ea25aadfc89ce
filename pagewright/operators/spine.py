"""Packing a book's blocks into files of a size, in order: greedy, with headings kept beside what they head."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .grouped import fold_groups

#: Bytes of a file's body, and the share of it that headings at its end may have to be carried on.
TARGET = 60_000
CARRIED = 10

SCHEMA = "doc_id long, seq int, file int, bytes long"


@dataclass
class Packer:
    """Files are numbered from 1; a block that fits no file has one of its own."""

    target: int = TARGET

    def files(self, blocks: list[tuple[int, bool, bool]]) -> list[int]:
        """The file of each block, from its (bytes, is a heading, starts a chapter)."""
        out: list[int] = []
        number, size, trailing, first = 1, 0, None, 0  # trailing: where the headings that end the file begin, and their bytes before

        def short() -> bool:
            return trailing is not None and (size - trailing[1]) * CARRIED <= self.target

        for i, (n, heading, chapter) in enumerate(blocks):
            if chapter:
                trailing = None
                if size:
                    number, size, first = number + 1, 0, i
            if size and size + n > self.target and not (short() and trailing[0] == first):
                number += 1
                if short() and trailing[1] > 0:  # the headings go on with what follows
                    begin, size = trailing[0], size - trailing[1]
                    out[begin:] = [number] * (len(out) - begin)
                    trailing, first = (begin, 0), begin
                else:
                    size, trailing, first = 0, None, i
            if heading and trailing is None:
                trailing = (i, size)
            elif not heading:
                trailing = None
            out.append(number)
            size += n
            if size >= self.target and not short():
                number, size, trailing, first = number + 1, 0, None, i + 1
        return out


def pack(blocks: DataFrame, target: int = TARGET) -> DataFrame:
    """doc_id, seq, file, bytes from doc_id, seq, bytes, heading, chapter: a book is one group."""

    def one(group: list[tuple]) -> list[tuple]:
        files = Packer(target).files([row[2:] for row in group])
        return [(doc, seq, file, size) for (doc, seq, size, _, _), file in zip(group, files, strict=True)]

    return fold_groups(blocks.select("doc_id", "seq", "bytes", "heading", "chapter"), ["doc_id"], ["seq"], one, SCHEMA)
