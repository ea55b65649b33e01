"""Fill-in-middle transformation by a piece table.

A document is a list of descriptors (buffer, start, stop) over immutable buffers: its text and the sentinels.
Cutting splits descriptors, an arrangement permutes them, and the inverse permutation restores their order.
Characters are never moved: outputs and hashes are streamed off the descriptors.

``transform`` cuts every text into prefix, middle and suffix at two positions drawn from its id and arranges
them as prefix-suffix-middle or suffix-prefix-middle; ``restore`` needs the output and its form alone. A text
that is empty or holds a sentinel stays plain, so the first sentinel of each kind in an output is the one
that was put there (a text cannot complete one across a border: a sentinel starts with its only "<").

Edge cases: a null text counts as empty; a null id is drawn like an empty one. Lengths and positions count
code points. Texts are taken whole, however long. Repeated rows give equal rows; an empty table gives an
empty result; extra columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Where each arrangement takes its pieces from, out of: the sentinels P, S, M, prefix, middle, suffix.
ARRANGEMENTS = {"psm": (0, 3, 1, 5, 2, 4), "spm": (1, 5, 0, 3, 2, 4)}
_SENTINELS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


class Piece(NamedTuple):
    buffer: int
    start: int
    stop: int


class PieceTable:
    """A document as descriptors over buffers that never change."""

    def __init__(self, buffers: Sequence[bytes], pieces: Sequence[Piece]):
        self.buffers, self.pieces = tuple(buffers), tuple(pieces)

    @classmethod
    def whole(cls, text: bytes) -> PieceTable:
        return cls([text], [Piece(0, 0, len(text))])

    def cut(self, *places: int) -> PieceTable:
        """The same document with a border at each place (ascending byte offsets); a piece may become empty."""
        out, before, todo = [], 0, list(places)
        for k, (buffer, start, stop) in enumerate(self.pieces):
            end = before + stop - start
            while todo and (todo[0] < end or k == len(self.pieces) - 1):
                border = start + todo.pop(0) - before
                out.append(Piece(buffer, start, border))
                before, start = before + border - start, border
            out.append(Piece(buffer, start, stop))
            before = end
        return PieceTable(self.buffers, out)

    def framed(self, sentinels: Sequence[bytes]) -> PieceTable:
        """The descriptors of sentinels before those of the document."""
        own = [Piece(len(self.buffers) + k, 0, len(s)) for k, s in enumerate(sentinels)]
        return PieceTable([*self.buffers, *sentinels], [*own, *self.pieces])

    def arranged(self, order: Sequence[int]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[k] for k in order])

    def restored(self, order: Sequence[int]) -> PieceTable:
        """The order before ``arranged(order)``."""
        return self.arranged(sorted(range(len(order)), key=order.__getitem__))

    def without(self, n: int) -> PieceTable:
        return PieceTable(self.buffers, self.pieces[n:])

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, stop in self.pieces:
            yield memoryview(self.buffers[buffer])[start:stop]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def text(self) -> str:
        return b"".join(self.stream()).decode()


def draw(doc_id: str | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from the id."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]


def arrange(text: str, doc_id: str | None, seed: int = 1, rate: int = 90, spm: int = 20) -> tuple[str, int | None, int | None, PieceTable]:
    """(form, characters of the prefix, of the middle, pieces) of one text."""
    h1, h2, h3, h4 = draw(doc_id, seed)
    data, n = text.encode(), len(text)
    if not n or h3 % 100 >= rate or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, PieceTable.whole(data)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first = a if len(data) == n else len(text[:a].encode())
    second = first + (b - a if len(data) == n else len(text[a:b].encode()))
    form = "spm" if h4 % 100 < spm else "psm"
    cut = PieceTable.whole(data).cut(first, second).framed((PREFIX, SUFFIX, MIDDLE))
    return form, a, b - a, cut.arranged(ARRANGEMENTS[form])


def rebuilt(output: str, form: str) -> PieceTable:
    """The document of an output: its borders are the sentinels, its order the inverse arrangement."""
    data = output.encode()
    table = PieceTable.whole(data)
    if form == "plain":
        return table
    places, at = [], 0
    for sentinel in _SENTINELS[form]:
        at = data.index(sentinel, at)
        places += [at, at + len(sentinel)]
    # The piece before the first sentinel is empty.
    return table.cut(*places).without(1).restored(ARRANGEMENTS[form]).without(3)


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars, output and its SHA-256.

    ``rate`` is the share of texts in a hundred that are rearranged, ``spm`` that of them with the suffix first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["id"], batch["text"]):
                text = text or ""
                form, prefix, middle, pieces = arrange(text, doc_id, seed, rate, spm)
                rows.append((doc_id, len(text), form, prefix, middle, pieces.text(), pieces.sha256()))
            out = pd.DataFrame(rows, columns=["id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    # Ids go through pandas as text, since a batch with a null would turn them to floats.
    made = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(
        run, "id string, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")
    return made.select(F.col("id").cast("long").alias("doc_id"), *made.columns[1:])


def restore(made: DataFrame, texts: bool = True) -> DataFrame:
    """``made`` (any columns, with output and form) with ``restored_sha256`` and, if wanted, ``restored`` added."""
    added = "restored_sha256 string" + (", restored string" if texts else "")
    layout = made.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tables = [rebuilt(output, form) for output, form in zip(batch["output"], batch["form"])]
            out = batch.assign(restored_sha256=[t.sha256() for t in tables])
            yield out.assign(restored=[t.text() for t in tables]) if texts else out

    return made.mapInPandas(run, f"{layout},{added}")


def digests(docs: DataFrame) -> DataFrame:
    """The transformation of every document with the hashes of its output and of the text rebuilt from it."""
    numbers = ("doc_id", "prefix_chars", "middle_chars")
    made = transform(docs)
    # As text: a batch with a null would turn whole numbers to floats.
    done = restore(made.withColumns({c: F.col(c).cast("string") for c in numbers}), texts=False).drop("output")
    return done.withColumns({c: F.col(c).cast("long") for c in numbers})
