"""Packing of token sequences: bounded-space online best fit with a final merge.

``pack_documents`` tokenises each document, appends an end id and packs the
ids into sequences of at most ``max_tokens``:

1. Every partition keeps at most ``open_windows`` open windows. A document is
   cut into full sequences and a rest; the rest goes to the open window with
   the least room that still holds it (best fit). When none fits and all
   windows are in use, the fullest is emitted. If it would be emitted with
   more than ``slack`` free places, the head of the incoming piece tops it up
   first, so padding per emitted window is at most ``slack``.
2. What stays open at the end of a partition is written as left over. The
   left-over pieces of many partitions are packed again by the same rule, in
   rounds of fewer and fewer tasks, until one task is enough. There the last
   windows are merged by cutting, so at most one sequence of the whole result
   is padded by more than ``slack``.

Each pass streams: a task holds one Arrow batch and its open windows, however
many rows there are, and no shuffle by key takes place (no hot group). Each
pass is written to the shared folder, so a lost executor repeats only its own
tasks and sequence numbers never change under a later pass.

Defined results: a null text is an empty one, and an empty text still yields
its end id; null ids stay null; repeated rows are packed once per row; extra
columns are ignored; an empty table gives no pieces. Very long texts are
tokenised whole and fill sequences of their own.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import bound_batches, write_table

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("left_over", T.BooleanType()),
    ]
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
     ("ids", pa.list_(pa.int32())), ("left_over", pa.bool_())]
)
#: Token ids per Arrow batch that a task hands out.
_BATCH_IDS = 1 << 20

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` format.

    The file's vocabulary lists the merges in id order, so the ranks of its
    byte strings give the same ids as the file's own library, some times
    faster. Added tokens are matched in the text first, as that library does.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special="all")


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Packer:
    """The open windows of one task. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, max_tokens: int, open_windows: int, slack: int, first_sequence: int) -> None:
        self.size, self.most, self.slack, self.next = max_tokens, open_windows, slack, first_sequence
        self.free: list[tuple[int, int]] = []  # (free places, window), ascending
        self.windows: dict[int, list[tuple]] = {}
        self.opened = 0
        self.out: list[tuple] = []
        self.out_ids = 0

    def _emit(self, pieces: list[tuple], left_over: bool = False) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            self.out.append((doc_id, start, total, ids, self.next, offset, left_over))
            offset += len(ids)
        self.out_ids += offset
        self.next += 1

    def add(self, piece: tuple) -> None:
        doc_id, start, total, ids = piece
        whole = len(ids) - len(ids) % self.size
        for at in range(0, whole, self.size):
            self._emit([(doc_id, start + at, total, ids[at : at + self.size])])
        if whole < len(ids):
            self._place((doc_id, start + whole, total, ids[whole:]))

    def _place(self, piece: tuple) -> None:
        need = len(piece[3])
        k = bisect_left(self.free, (need, -1))
        if k < len(self.free):
            room, w = self.free.pop(k)
            self._put(w, room, piece)
            return
        if len(self.free) >= self.most:
            room, w = self.free.pop(0)
            if room > self.slack:
                doc_id, start, total, ids = piece
                self.windows[w].append((doc_id, start, total, ids[:room]))
                self._emit(self.windows.pop(w))
                self._place((doc_id, start + room, total, ids[room:]))
                return
            self._emit(self.windows.pop(w))
        w = self.opened = self.opened + 1
        self.windows[w] = []
        self._put(w, self.size, piece)

    def _put(self, w: int, room: int, piece: tuple) -> None:
        self.windows[w].append(piece)
        room -= len(piece[3])
        if room:
            insort(self.free, (room, w))
        else:
            self._emit(self.windows.pop(w))

    def close(self, last: bool) -> None:
        """Emit what is open: as left over, or (last round) merged by cutting."""
        order = [w for _, w in self.free]
        if not last:
            for w in order:
                self._emit(self.windows[w], left_over=True)
        else:
            loose: list[tuple] = []
            for room, w in self.free:
                if room <= self.slack:
                    self._emit(self.windows[w])
                else:
                    loose += self.windows[w]
            held, used = [], 0
            for doc_id, start, total, ids in loose:
                while len(ids):
                    part = ids[: self.size - used]
                    held.append((doc_id, start, total, part))
                    used, start, ids = used + len(part), start + len(part), ids[len(part) :]
                    if used == self.size:
                        self._emit(held)
                        held, used = [], 0
            if held:
                self._emit(held)
        self.free, self.windows = [], {}

    def batch(self) -> pa.RecordBatch:
        rows, self.out, self.out_ids = self.out, [], 0
        ids = [r[3] for r in rows]
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
        crc = [zlib.crc32(np.ascontiguousarray(x, dtype="<u4").tobytes()) for x in ids]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array(lengths),
                pa.array(crc, pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64()),
                pa.array([r[5] for r in rows], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                pa.array([r[6] for r in rows], pa.bool_()),
            ],
            schema=_ARROW,
        )


def _run(packer: _Packer, pieces: Iterator[tuple], last: bool) -> Iterator[pa.RecordBatch]:
    for piece in pieces:
        packer.add(piece)
        if packer.out_ids >= _BATCH_IDS:
            yield packer.batch()
    packer.close(last)
    if packer.out:
        yield packer.batch()


def _first_sequence(round_: int) -> int:
    """Sequence numbers of one task: distinct by round, partition and count."""
    return (round_ << 56) | (TaskContext.get().partitionId() << 32)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    max_tokens: int = 2048,
    open_windows: int = 64,
    slack: int = 16,
    merge_pieces: int = 50_000,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids``; pieces of one ``sequence_id`` in the order of
    ``offset`` are one training sequence.

    ``tokenizer`` is the path of a byte-level BPE file (``tokenizers``
    format). ``merge_pieces`` is the number of left-over pieces that one task
    of a merge round streams through.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer), np.array([end_id], dtype=np.uint32)

        def pieces() -> Iterator[tuple]:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids = np.concatenate((encode(text.as_py() or ""), end))
                    yield doc_id, 0, len(ids), ids

        yield from _run(_Packer(max_tokens, open_windows, slack, _first_sequence(0)), pieces(), False)

    def merge(round_: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pieces() -> Iterator[tuple]:
                for b in batches:
                    for doc_id, start, total, ids in zip(*(b.column(i) for i in range(4)), strict=True):
                        yield doc_id.as_py(), start.as_py(), total.as_py(), ids.values.to_numpy()

            yield from _run(_Packer(max_tokens, open_windows, slack, _first_sequence(round_)), pieces(), last)

        return run

    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done, round_, tasks = None, 0, 0
    table = write_table(source.mapInArrow(first, PIECES), "pack-0")
    while True:
        part = table.where(~F.col("left_over"))
        done = part if done is None else done.unionByName(part)
        left = table.where("left_over").select("doc_id", "start", "doc_tokens", "ids")
        wanted = -(-table.where("left_over").count() // merge_pieces)
        if wanted == 0:
            break
        tasks = wanted if round_ == 0 else max(1, min(wanted, tasks // 2))  # fewer each round, so the rounds end
        round_ += 1
        table = write_table(left.coalesce(tasks).mapInArrow(merge(round_, tasks == 1), PIECES), f"pack-{round_}")
    return done.drop("left_over")
