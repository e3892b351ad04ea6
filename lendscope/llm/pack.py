"""Packing of tokenised documents into training sequences, hierarchically by context size.

Each task tokenises its documents and routes them by length to context tiers: whole top-size
windows are cut off long documents, the rest goes to the smallest tier that holds it. Within a tier
documents are laid end to end into windows of the tier's size. Windows of a shorter tier then fill
the gaps that the last, unfinished window of each longer tier leaves, and what is left in the end is
cut into powers of two, so that next to nothing is padding. A window's ids never leave the task, so
packing costs no shuffle. Step groups are counted in each task alone and are not balanced over the
corpus: sequence k of a tier in a task belongs to step ``k * size // STEP_TOKENS``.

Defined cases: a null text counts as empty and yields the end id alone; ids may be null or repeat,
each row is its own document. Only the id and text columns are read, so others may have any
name. An empty table gives no pieces; a text of any length is cut into as many as it needs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import arrow_map, text_runs

TOP = 4096
TIERS = (512, 1024, 2048, 4096)
SMALLEST = 1
END_ID = 2
STEP_TOKENS = 1 << 18
CACHE = 400_000

SIMPLE = re.compile("[\n -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable letter, unprintable ones from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class PieceIds(dict):
    """Ids (as little-endian bytes) of a pre-tokenised, lower-cased piece."""

    def __init__(self, model):
        self.tokenize, self.letters = model.tokenize, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        letters = piece.encode().decode("latin-1").translate(self.letters)
        value = self[piece] = np.array([t.id for t in self.tokenize(letters)], "<u4").tobytes()
        return value


class Encoder:
    """Exactly the tokenizer's ids of a text.

    Its pieces don't depend on each other, so in texts of plain Latin letters each distinct piece is
    encoded once and remembered. Other texts go to the tokenizer word by word, where words are cut at
    spaces and line ends, which it drops; words it marks as special are no different.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.pieces = PieceIds(self.whole.model)

    def __call__(self, text: str) -> bytes:
        if SIMPLE.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(text.lower())))
        return b"".join(self.word(w) for w in re.split("[ \n]+", text))

    def word(self, word: str) -> bytes:
        if SIMPLE.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(word.lower())))
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, so that tasks share what is remembered."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


class Packer:
    """Open windows of a task by tier. A piece is (row's id, start, ids as bytes, tokens of its row)."""

    def __init__(self, task: int, tiers: tuple[int, ...]):
        self.tiers, self.next_id = tiers, task << 40
        self.open: dict[int, list] = {t: [] for t in tiers}
        self.used = dict.fromkeys(tiers, 0)
        self.made = dict.fromkeys(tiers, 0)
        self.out: list[tuple] = []

    def add(self, key, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n // self.tiers[-1] * self.tiers[-1]
        for start in range(0, whole, self.tiers[-1]):
            self.close(self.tiers[-1], [(key, start, ids[4 * start : 4 * (start + self.tiers[-1])], n)])
        if whole < n:
            self.lay(next(t for t in self.tiers if t >= n - whole), (key, whole, ids[4 * whole :], n))

    def lay(self, tier: int, piece) -> None:
        """Put a piece at the end of the tier's open window, cut where the window is full."""
        key, start, ids, n = piece
        while ids:
            room = tier - self.used[tier]
            part, ids = ids[: 4 * room], ids[4 * room :]
            self.open[tier].append((key, start, part, n))
            self.used[tier] += len(part) // 4
            start += room
            if self.used[tier] == tier:
                pieces, self.open[tier], self.used[tier] = self.open[tier], [], 0
                self.close(tier, pieces)

    def close(self, tier: int, pieces: list) -> None:
        """Write a sequence."""
        offset, step = 0, self.made[tier] * tier // STEP_TOKENS
        self.made[tier] += 1
        for key, start, ids, n in pieces:
            length = len(ids) // 4
            self.out.append((key, start, length, crc32(ids), n, self.next_id, offset, tier, step))
            offset += length
        self.next_id += 1

    def finish(self) -> None:
        """Fill the long windows' gaps from the shorter tiers, longest first, then cut the rest into powers of two."""
        rest = [p for t in reversed(self.tiers) for p in self.open[t]]
        total = sum(len(p[2]) // 4 for p in rest)
        size = self.tiers[-1]
        while total:
            while size > SMALLEST and size > total:
                size //= 2
            pieces, room = [], min(size, total)
            while room:
                key, start, ids, n = rest.pop(0)
                if len(ids) // 4 > room:
                    rest.insert(0, (key, start + room, ids[4 * room :], n))
                    ids = ids[: 4 * room]
                pieces.append((key, start, ids, n))
                room -= len(ids) // 4
            total -= min(size, total)
            self.made.setdefault(size, 0)
            self.close(size, pieces)


SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")]
)
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


def pack(docs: DataFrame, tokenizer: str, id_col="doc_id", text_col="text", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece; ``tokenizer`` is the path of the vocabulary file, the same on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode, end = Packer(TaskContext.get().partitionId(), tiers), encoder(tokenizer), np.array([END_ID], "<u4").tobytes()

        def written():
            columns = list(zip(*packer.out)) or [()] * len(SCHEMA)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

        for rows in text_runs(batches, "_text"):
            for key, text in zip(rows["_id"], rows["_text"]):
                packer.add(key, encode(text) + end)
            yield written()
        packer.finish()
        yield written()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return arrow_map(rows, run, DDL)
