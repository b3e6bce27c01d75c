"""Pack token sequences with a fixed number of open windows per partition.

Each task tokenizes its documents and places them as they come: best fit among at
most ``windows`` open windows; when nothing fits, the fullest window is emitted.
What is left open at the end of a task is merged there, and the one partly filled
window that remains per task is merged with those of other tasks.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.session import staged

#: Chunks whose ids a task remembers before it starts anew.
CACHE_LIMIT = 400_000
#: A gap up to this share of a window is padded; a larger one is filled by cutting a document.
SLACK = 1 / 128

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, left boolean"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by the public rule: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, remembered per space-led chunk.

    Byte-level pre-tokenization always starts a new pre-token at a space that is
    followed by a non-space, so a text may be cut there and its chunks be looked up.
    New chunks go through tiktoken with the ranks of the same vocabulary file, after
    it has been compared with the tokenizers library on the first texts of the task;
    should they differ, the tokenizers library does all the work.
    """

    def __init__(self, path: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.reference = Tokenizer.from_file(path)
        self.reference.encode_special_tokens = True
        alphabet = byte_alphabet()
        ranks = {}
        for token, i in self.reference.get_vocab(with_added_tokens=False).items():
            if all(c in alphabet for c in token):
                ranks[bytes(alphabet[c] for c in token)] = i
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = None
        if len(ranks) >= 256 and all(bytes([b]) in ranks for b in range(256)):
            self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile(r" (?=\S)")
        self.odd = re.compile(r" \s")
        self.known: dict[str, bytes] = {}
        self.compared = 0

    def plain(self, text: str) -> bytes:
        ids = self.reference.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def chunks(self, text: str) -> list[str]:
        if self.odd.search(text) or text.endswith(" "):
            head, *rest = self.cut.split(text)
            return [head, *(" " + c for c in rest)]
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]

    def encode(self, text: str) -> bytes:
        if self.fast is None:
            return self.plain(text)
        parts = self.chunks(text)
        known = self.known
        new = set(parts).difference(known)
        if len(known) + len(new) > CACHE_LIMIT:
            known.clear()
            new = set(parts)
        for part in new:
            known[part] = b"".join([i.to_bytes(4, "little") for i in self.fast.encode_ordinary(part)])
        ids = b"".join(map(known.__getitem__, parts))
        for part in new:
            if len(part) > 64:
                del known[part]
        if self.compared < 4 and len(text) <= 20_000:
            self.compared += 1
            if ids != (plain := self.plain(text)):
                self.fast = None
                return plain
        return ids


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


class Windows:
    """Open windows of one task. A piece is (doc_id, start, ids, doc_tokens); a window is [fill, pieces]."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.gap = length, most, max(1, int(length * SLACK))
        self.open: list[list] = []
        self.full: list[list] = []

    def add(self, doc_id, ids: bytes, total: int) -> None:
        n, start = len(ids) // 4, 0
        while n - start >= self.length:
            self.full.append([self.length, [(doc_id, start, ids[4 * start : 4 * (start + self.length)], total)]])
            start += self.length
        while start < n:
            start = self.place(doc_id, ids, start, n, total)

    def place(self, doc_id, ids: bytes, start: int, n: int, total: int) -> int:
        """Place what is left of a document, or as much of it as tops up the window to emit."""
        need = n - start
        best, best_room, fullest = None, self.length + 1, None
        for w in self.open:
            room = self.length - w[0]
            if need <= room < best_room:
                best, best_room = w, room
            if fullest is None or w[0] > fullest[0]:
                fullest = w
        if best is None and len(self.open) < self.most:
            best = [0, []]
            self.open.append(best)
        if best is not None:
            self.put(best, doc_id, ids, start, n, total)
            return n
        room = self.length - fullest[0]
        if room > self.gap:
            self.put(fullest, doc_id, ids, start, start + room, total)
            return start + room
        self.emit(fullest)
        return start

    def put(self, window, doc_id, ids: bytes, start: int, end: int, total: int) -> None:
        window[1].append((doc_id, start, ids[4 * start : 4 * end], total))
        window[0] += end - start
        if window[0] == self.length:
            self.emit(window)

    def emit(self, window) -> None:
        self.open = [w for w in self.open if w is not window]
        self.full.append(window)

    def merge(self) -> list[list]:
        """Fill the fullest open windows from the emptiest ones; at most one stays partly filled."""
        rest = sorted(self.open, key=lambda w: w[0])
        while len(rest) > 1:
            target, source = rest[-1], rest[0]
            room = self.length - target[0]
            doc_id, start, ids, total = source[1].pop()
            n = len(ids) // 4
            used = min(n, room)
            target[1].append((doc_id, start, ids[: 4 * used], total))
            target[0] += used
            source[0] -= used
            if used < n:
                source[1].append((doc_id, start + used, ids[4 * used :], total))
            if target[0] == self.length:
                self.full.append(rest.pop())
            if not source[1]:
                rest.pop(0)
        self.open = []
        return rest


def pack_partition(batches: Iterator[pa.RecordBatch], path: str, length: int, windows: int, end_id: int | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    state, encode, done = Windows(length, windows), tokenizer_of(path).encode, 0
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left", pa.bool_())])

    def rows(full: list[list], left: bool) -> pa.RecordBatch:
        nonlocal done
        out = []
        for _, pieces in full:
            offset, sequence = 0, (part << 32) | done
            done += 1
            for doc_id, start, ids, total in pieces:
                n = len(ids) // 4
                out.append((doc_id, start, n, zlib.crc32(ids), total, sequence, offset, left))
                offset += n
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 8, schema)], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py() or "") + tail
            if ids:
                state.add(doc_id, ids, len(ids) // 4)
        if len(state.full) >= 256:
            yield rows(state.full, False)
            state.full = []
    left = state.merge()
    yield rows(state.full, False)
    yield rows(left, True)


def merge_group(table: pa.Table, length: int) -> pa.Table:
    """Best-fit decreasing over the partly filled windows of one bounded group; windows stay whole."""
    import pandas as pd

    frame = table.to_pandas()
    fill = frame.groupby("sequence_id")["length"].sum().sort_values(ascending=False, kind="stable")
    bins: list[list[int]] = []  # [fill, sequence]
    moved = {}
    for sequence, size in fill.items():
        fits = [b for b in bins if b[0] + size <= length]
        target = max(fits, key=lambda b: b[0]) if fits else None
        if target is None:
            target = [0, sequence]
            bins.append(target)
        moved[sequence] = (target[1], target[0])
        target[0] += size
    ends = {b[1]: b[0] for b in bins}
    old = frame["sequence_id"]
    frame["sequence_id"] = old.map(lambda s: moved[s][0]).astype("int64")
    frame["offset"] = frame["offset"] + old.map(lambda s: moved[s][1]).astype("int64")
    frame["left"] = frame["sequence_id"].map(lambda s: ends[s] <= length // 2).astype(bool)
    return pa.Table.from_pandas(pd.DataFrame(frame), schema=table.schema, preserve_index=False)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    windows: int = 64,
    end_id: int | None = 1,
    fan_in: int = 64,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level vocabulary file for the tokenizers library. A null or
    empty text is the end id alone (no row if ``end_id`` is None). Repeated rows and equal or null ids
    are packed each for itself; other columns are ignored; an empty table gives no rows. Strings of
    special tokens in a text are ordinary text. Texts of any length are cut where windows end.

    Memory of a task: ``windows`` open windows and one batch. Between tasks only the one partly filled
    window of each task moves, ``fan_in`` of them to a merging task.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = PIECES
    pieces = staged(source.mapInArrow(lambda it: pack_partition(it, tokenizer, length, windows, end_id), schema), "pieces")
    done = [pieces.where(~F.col("left"))]
    rest = pieces.where("left")
    spread = 1 + (rest.agg(F.max(F.shiftright("sequence_id", 32))).first()[0] or 0)
    while spread > 1:
        group = F.shiftright("sequence_id", 32) % F.lit(max(1, -(-spread // fan_in)))
        merged = rest.withColumn("bin", group).groupBy("bin").applyInArrow(lambda t: merge_group(t.drop_columns("bin"), length), schema)
        spread = -(-spread // fan_in)
        rest = staged(merged, "merged")
        done.append(rest.where(~F.col("left")))
        rest = rest.where("left")
    done.append(rest)
    return functools.reduce(DataFrame.unionAll, done).drop("left")
