"""Hierarchical multi-length packing.

A document's ids are routed to tiers of context sizes: as many pieces of the longest window as it
fills, and the rest to the shortest tier that holds it.  Each tier is packed in windows of its
size; gaps in long windows are filled with whole pieces of shorter tiers, the largest that fit,
and a last sliver is cut off a waiting piece.  Windows of all tiers are powers of two and full;
only what is left at a task's end may need padding.  Windows of a tier are dealt into step groups
of the same number of ids; the tiers' incomplete groups are put together.

Packing is local to an input partition: no shuffle, memory bounded by POOL pieces, padding at most
one window for each partition.  A task that runs again on the same rows makes the same pieces.

Defined cases: a null text is empty, a document then has its end id alone; a null doc_id is kept;
repeated rows are packed each; ties between pieces of one length go to the one that came last (in short
lists the first), the same on each run over the same rows; very long texts are encoded whole and cut
into full windows as they come; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.common import trimmed
from graphloom.llm.textvec import buffers, slices
from graphloom.llm.tokens import tokenizer

TIERS = (128, 256, 512, 1024)
#: Ids in a step group: as many windows of a tier as make up this number.
GROUP_IDS = 65_536
#: Waiting pieces that start a round of packing.
POOL = 8_192
END_ID = b"\0\0\0\0"

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()), ("ids", pa.binary())])


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens) of one partition; `out` collects the rows of closed step groups."""

    def __init__(self, partition: int, tiers=TIERS, group_ids: int = GROUP_IDS):
        self.tiers, self.group_ids = tuple(sorted(tiers)), group_ids
        self.base = partition << 36
        self.n_sequences = self.n_groups = 0
        self.open: dict[int, tuple[int, int]] = {}  # tier: its step group and the ids in it
        self.by_length: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []  # sorted keys of by_length
        self.waiting = 0
        self.out: list[tuple] = []  # rows of closed step groups
        self.held: dict[int, list[tuple]] = {}  # rows of open ones

    def add_document(self, doc_id: int | None, ids: bytes) -> None:
        n, top, at = len(ids) // 4, self.tiers[-1], 0
        while n - at >= top:
            self._emit(top, [(doc_id, at, ids[4 * at : 4 * (at + top)], n)])
            at += top
        if n > at:
            self._wait((doc_id, at, ids[4 * at :], n))

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        if n not in self.by_length:
            self.by_length[n] = []
            insort(self.lengths, n)
        self.by_length[n].append(piece)
        self.waiting += 1

    def _take(self, n: int) -> tuple:
        pool = self.by_length[n]
        piece = pool.pop(0) if len(pool) < 8 else pool.pop()
        self.waiting -= 1
        if not pool:
            del self.by_length[n]
            self.lengths.remove(n)
        return piece

    def _cut(self, piece: tuple, n: int) -> tuple:
        """The first n ids of a piece; the others wait again."""
        doc_id, start, ids, total = piece
        self._wait((doc_id, start + n, ids[4 * n :], total))
        return doc_id, start, ids[: 4 * n], total

    def pack(self, to_the_end: bool = False) -> None:
        """Fill windows from the longest tier down; all but the last round keep some short pieces to fill gaps with."""
        keep = 0 if to_the_end else POOL // 4
        while self.waiting > keep:
            longest = self.lengths[-1]
            tier = next(t for t in self.tiers if longest <= t)
            window, gap = [self._take(longest)], tier - longest
            while gap and self.lengths:
                at = bisect_right(self.lengths, gap) - 1
                if at >= 0:
                    n = self.lengths[at]
                    window.append(self._take(n))
                else:  # every waiting piece is longer than the gap
                    n = gap
                    window.append(self._cut(self._take(self.lengths[0]), gap))
                gap -= n
            if gap:
                self._rest(window, tier - gap)
            else:
                self._emit(tier, window)
        if to_the_end:
            self._close()

    def _rest(self, window: list[tuple], n: int) -> None:
        """The partition's last window isn't full: full windows of smaller tiers, and one that is padded."""
        for tier in reversed(self.tiers):
            if n >= tier:
                part, size = [], 0
                while size < tier:
                    doc_id, start, ids, total = window.pop(0)
                    m = min(tier - size, len(ids) // 4)
                    part.append((doc_id, start, ids[: 4 * m], total))
                    if 4 * m < len(ids):
                        window.insert(0, (doc_id, start + m, ids[4 * m :], total))
                    size += m
                self._emit(tier, part)
                n -= tier
        if n:
            self._emit(self.tiers[-1], window)

    def _emit(self, tier: int, window: list[tuple]) -> None:
        sequence, self.n_sequences = self.base + self.n_sequences, self.n_sequences + 1
        group, ids = self.open.get(tier, (None, 0))
        if group is None:
            group, ids = self.base + self.n_groups, 0
            self.n_groups += 1
        rows, offset = self.held.setdefault(group, []), 0
        for doc_id, start, piece, total in window:
            n = len(piece) // 4
            rows.append((doc_id, start, n, total, sequence, offset, tier, group, piece))
            offset += n
        self.open[tier] = (group, ids + tier)
        if ids + tier >= self.group_ids:
            del self.open[tier]
            self.out.extend(self.held.pop(group))

    def _close(self) -> None:
        """Incomplete groups of several tiers become common ones, filled up to the same number of ids."""
        size, target = 0, None
        for group, ids in sorted(self.open.values(), key=lambda x: -x[1]):
            if target is None or size + ids > self.group_ids:
                target, size = group, 0
            self.out.extend((*r[:7], target, r[8]) for r in self.held.pop(group))
            size += ids
        self.open = {}

    def drain(self) -> list[tuple]:
        """Rows whose step group is final."""
        rows, self.out = self.out, []
        return rows


def _batches(rows: list[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        columns = list(zip(*rows[i : i + size], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def pack_documents(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", tiers=TIERS, group_ids: int = GROUP_IDS) -> DataFrame:
    """One row for each piece: its document, place in it, sequence, offset there, tier, step group and ids (binary)."""

    def run(batches):
        encode = tokenizer(vocabulary, byte_level=True).encode
        context = TaskContext.get()
        packer = Packer(context.partitionId() if context else 0, tiers, group_ids)
        for batch in batches:
            for a, b in slices(buffers(batch.column(1))[1]):
                for key, value in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    packer.add_document(key, encode(value or "") + END_ID)
                    if packer.waiting >= POOL:
                        packer.pack()
                    if len(packer.out) >= POOL:
                        yield from _batches(packer.drain())
        packer.pack(to_the_end=True)
        yield from _batches(packer.drain())

    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(trimmed(run), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    return digest(pack_documents(table(spark, sf_dir, "documents"), vocabulary_path()))
