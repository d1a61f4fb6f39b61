"""Packing into fixed windows by the sum-of-squares rule.

Each document is its tokens and an end id. Whole windows are cut from its
front; what remains, shorter than a window, is an item. An item goes to the
open window whose fill level, or to a new window if that is better, makes the
sum of the squared counts of partially filled windows least (ties: the fullest
level). The counts are kept in an array by level, so an item costs one pass
over that array. When a task ends, or too many windows are open, the fullest of
those still open are filled up with cuts of the emptiest, and what is left, less
than a window, is cut at powers of two: nothing is padded.

Defined cases: a null or empty text is its end id alone; repeated rows are
packed as often as they come; a null id is carried; texts of any length are
tokenized whole; an empty table gives no rows; other columns are ignored.

How it scales: one narrow pass. A task packs its own input partition in a
bounded state (at most OPEN_MOST open windows), nothing is shuffled, and a lost
task's rerun gives the same rows. A task adds at most 11 sequences below the
window size, none of which is padded.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracelet.llm.common import KEPT, frugal

WINDOW = 2048
END_ID = 1
OPEN_MOST = 4096
CACHE_MOST = 200_000
CACHE_CHARS = 64
GROUP_BYTES = 4_000_000
AT_ONCE = 2000
LETTERS_BELOW = "\u0130"  # letters up to here stay one letter in lower case
MARKS = ".,;:!?$%&*#)(|-"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ID_BYTES = 4


class Tokens:
    """Bytes of the little-endian 32-bit ids of whole texts.

    The tokenizer never joins across white space, and within a run of letters followed by marks it cuts between the two.
    So each distinct run is encoded once, and texts are put together from the runs. Runs met lately are kept in two
    generations of bounded size.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.now: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True

    def put(self, run: str, ids: bytes) -> None:
        if len(run) <= CACHE_CHARS:
            if len(self.now) >= CACHE_MOST:
                self.before, self.now = self.now, {"": b""}
            self.now[run] = ids

    def get(self, run: str) -> bytes | None:
        ids = self.now.get(run)
        if ids is None and (ids := self.before.get(run)) is not None:
            self.put(run, ids)
        return ids

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Of words of Latin letters; each is one word to the tokenizer, whose last piece is marked as an end."""
        out: dict[str, bytes] = {}
        for a in range(0, len(words), AT_ONCE):
            group = words[a : a + AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            data, stops = ids.tobytes(), (np.flatnonzero(self.ends[ids]) + 1) * ID_BYTES
            if len(stops) != len(group):
                raise ValueError("a word of letters was cut")
            out |= {w: data[i:j] for w, i, j in zip(group, [0, *stops[:-1].tolist()], stops.tolist())}
        return out

    def runs(self, runs: list[str]) -> list[bytes]:
        """Of distinct runs without blanks."""
        found = {r: self.get(r) for r in runs}
        parts: dict[str, tuple[str, str]] = {}
        other: list[str] = []
        for r in [r for r, ids in found.items() if ids is None]:
            core = r.rstrip(MARKS)
            if core.isalpha() and max(core) < LETTERS_BELOW:
                parts[r] = core.lower() if core.isascii() else core, r[len(core) :]
            else:
                other.append(r)
        tails = {t for _, t in parts.values()}
        other += [t for t in tails if t not in found and self.get(t) is None]
        known = {"": b""}
        for a in range(0, len(other), AT_ONCE):  # an encoding holds its tokens' texts, offsets and masks too
            group = other[a : a + AT_ONCE]
            known |= {r: np.array(e.ids, "<u4").tobytes() for r, e in zip(group, self.tokenizer.encode_batch_fast(group, add_special_tokens=False))}
        known |= {t: self.get(t) for t in tails if t not in known}
        cores = {c for c, _ in parts.values()}
        held = {c: ids for c in cores if (ids := self.get(c)) is not None}
        held |= self.words([c for c in cores if c not in held])
        fresh = known | held | {r: held[c] + known[t] for r, (c, t) in parts.items()}
        for r, ids in fresh.items():
            self.put(r, ids)
        return [fresh[r] if ids is None else ids for r, ids in found.items()]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """In groups of bounded size. Null texts are empty."""
        texts = texts.fill_null("")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) - sizes) // GROUP_BYTES
        for a, b in zip(cuts := np.flatnonzero(np.diff(group, prepend=-1)).tolist(), [*cuts[1:], len(texts)]):
            lists = pc.split_pattern(pc.replace_substring(texts.slice(a, b - a), "\n", " "), " ")
            coded = lists.flatten().dictionary_encode()
            ids = pa.array(self.runs(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
            stops = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)
            data = memoryview(ids.buffers()[2] or b"")
            ends = stops[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].tolist()
            for i, j in zip([int(stops[0]), *ends[:-1]], ends):
                yield bytes(data[i:j])


def regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) as they come, in batches of GROUP_BYTES of text and what the last row has beyond, however many rows the given ones have."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            before = int(ends[a - 1]) if a else 0
            b = min(batch.num_rows, int(np.searchsorted(ends, before + GROUP_BYTES - size)) + 1)
            held.append(batch.slice(a, b - a))
            size += int(ends[b - 1]) - before
            a = b
            if size >= GROUP_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def tokens(path: str) -> Tokens:
    """Kept by a worker from task to task of this operator."""
    if path not in KEPT:
        KEPT[path] = Tokens(path)
    return KEPT[path]


class Packer:
    """Pieces are (doc, start, doc_tokens, ids). put() and finish() return placed pieces: (piece, sequence, offset)."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0, open_most: int = OPEN_MOST):
        self.window, self.next, self.most = window, first_sequence, open_most
        self.count = np.zeros(window + 1, np.int64)  # of open windows by level; the last stays 0
        self.by_level: list[list[list]] = [[] for _ in range(window)]
        self.open = 0
        self.moved = 0  # ids of windows that were taken apart again

    def level_for(self, n: int) -> int:
        """Of an open window, or 0 for a new one."""
        at = self.count[: self.window - n + 1]
        change = 2 * (self.count[n:] - at) + 2
        change[0] = 2 * self.count[n] + 1
        change[-1] = 1 - 2 * at[-1]  # a full window isn't counted
        change[1:][at[1:] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def close(self, pieces: list) -> list:
        out, offset = [], 0
        for p in pieces:
            out.append((p, self.next, offset))
            offset += len(p[3]) // ID_BYTES
        self.next += 1
        return out

    def put(self, doc, ids: bytes) -> list:
        total, w, out = len(ids) // ID_BYTES, self.window, []
        whole = total // w * w
        for a in range(0, whole, w):
            out += self.close([(doc, a, total, ids[a * ID_BYTES : (a + w) * ID_BYTES])])
        n = total - whole
        if not n:
            return out
        level = self.level_for(n)
        if level:
            pieces = self.by_level[level].pop()
            self.count[level] -= 1
        else:
            pieces = []
            self.open += 1
        pieces.append((doc, whole, total, ids[whole * ID_BYTES :]))
        if level + n == w:
            self.open -= 1
            return out + self.close(pieces)
        self.by_level[level + n].append(pieces)
        self.count[level + n] += 1
        return out + (self.joined() if self.open > self.most else [])

    def joined(self) -> list:
        """Closes all open windows. The fullest stay as the rule made them and are filled up from the emptiest, whose pieces are cut for that; what is left in the end, less than a window, is cut at powers of two."""
        levels = [(fill, pieces) for fill, level in enumerate(self.by_level) for pieces in level]
        self.by_level = [[] for _ in range(self.window)]
        self.count[:] = 0
        self.open = 0
        spare: deque[tuple] = deque()
        out, held, low, high = [], 0, 0, len(levels) - 1

        def take(n: int) -> list:
            """n ids of the spare pieces."""
            taken = []
            while n:
                doc, start, total, ids = spare.popleft()
                here = min(n, len(ids) // ID_BYTES)
                taken.append((doc, start, total, ids[: here * ID_BYTES]))
                if ids[here * ID_BYTES :]:
                    spare.appendleft((doc, start + here, total, ids[here * ID_BYTES :]))
                n -= here
            return taken

        while low <= high:
            room = self.window - levels[high][0]
            while held < room and low < high:
                spare.extend(levels[low][1])
                held += levels[low][0]
                low += 1
            if held < room:
                break
            out += self.close(levels[high][1] + take(room))
            held -= room
            high -= 1
        if low <= high:
            spare.extendleft(reversed(levels[high][1]))
            held += levels[high][0]
        self.moved += sum(fill for fill, _ in levels[: high + 1])
        while held:
            size = 1 << held.bit_length() - 1
            out += self.close(take(size))
            held -= size
        return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and on demand ids array<int>."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        packer, toks = Packer(window, TaskContext.get().partitionId() << 36), tokens(tokenizer)
        end = np.array([end_id], "<u4").tobytes()

        def rows(placed):
            cols = [
                [p[0] for p, _, _ in placed],
                [p[1] for p, _, _ in placed],
                [len(p[3]) // ID_BYTES for p, _, _ in placed],
                [zlib.crc32(p[3]) for p, _, _ in placed],
                [p[2] for p, _, _ in placed],
                [s for _, s, _ in placed],
                [o for _, _, o in placed],
            ]
            out = [pa.array(cols[0], ids_type), *[pa.array(c, pa.int64()) for c in cols[1:]]]
            if with_ids:
                out.append(pa.array([np.frombuffer(p[3], "<u4").astype(np.int32) for p, _, _ in placed], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(out, names)

        ids_type = None
        for batch in regrouped(batches):
            ids_type = batch.schema.field(0).type
            placed = []
            for doc, ids in zip(batch.column(0).to_pylist(), toks.encode(batch.column(1))):
                placed += packer.put(doc, ids + end)
                if len(placed) > 500:
                    yield rows(placed)
                    placed = []
            if placed:
                yield rows(placed)
            pa.default_memory_pool().release_unused()
        if ids_type is not None and (placed := packer.joined()):
            yield rows(placed)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = SCHEMA.replace("doc_id long", f"doc_id {kind}") + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(frugal(run, keep=True), schema)
