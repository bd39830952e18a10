"""Token ids of whole texts, by the ``tokenizers`` library, with each distinct chunk encoded once.

Both vocabularies used here split a text before they merge, and no pre-token spans the places where
``Chunks`` cuts, so the ids of a text are the ids of its chunks in a row. Chunks are told
apart by Arrow's dictionary encoding; only those not met before reach the tokenizer.
"""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space by the Unicode property, as the tokenizers' patterns have it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_SPACES = frozenset(chr(i) for i in range(0x3001) if re.match(f"[{_WS}]", chr(i)))
#: Distinct chunks that a worker remembers; beyond, those met in one batch only are forgotten.
CHUNKS_KEPT = 600_000
#: New chunks that one call of the tokenizer takes.
AT_A_TIME = 250
#: Bytes of text that a task works on at once, and that are encoded at once (there, fewer distinct chunks come of more).
AT_ONCE, ENCODED_AT_ONCE = 2_000_000, 5_000_000


class Chunks:
    """An encoder over one tokenizer file.

    kept: distinct chunks that are remembered, CHUNKS_KEPT at most.
    spaces: "dropped" if the tokenizer ignores white space, "leading" if a single space belongs to the
    word behind it (byte-level BPE), "whole" if nothing is known, when each text is encoded by itself.
    """

    def __init__(self, path: str, spaces: str = "whole", kept: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces, self.kept = Tokenizer.from_file(path), spaces, kept
        special = {str(t.content): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.between = next(iter(special.items()), None)
        self._clear()

    @property
    def most(self) -> int:
        return min(self.kept or CHUNKS_KEPT, CHUNKS_KEPT)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.length = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.odd, self.met = np.zeros(1 << 14, bool), np.zeros(1 << 14, np.int32)

    def _shrink(self) -> None:
        """Forgets chunks, the rarest first, until at most half of ``most`` are left."""
        chunks, n = list(self.index), len(self.index)
        stay = np.argsort(-self.met[:n], kind="stable")[: self.most // 2]
        stay = stay[self.met[stay] > 1]
        ids, first, length, odd, met = self.pool, self.first[stay], self.length[stay], self.odd[stay], self.met[stay]
        self._clear()
        self.index = {chunks[k]: i for i, k in enumerate(stay.tolist())}
        before = np.concatenate(([0], np.cumsum(length)))
        before = before.astype(np.int32)
        self.pool, self.used = ids[np.repeat(first - before[:-1], length) + np.arange(before[-1], dtype=np.int32)], int(before[-1])
        self.pool = np.concatenate((self.pool, np.zeros(1 << 16, np.uint32)))
        room = np.zeros(1 << 14, np.int32)
        self.first, self.length, self.met = (np.concatenate((x, room)) for x in (before[:-1], length, met))
        self.odd = np.concatenate((odd, room > 0))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if self.spaces == "whole" or self.between is None:
            return _flat([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)])
        if self.spaces == "dropped":
            lists = pc.split_pattern(texts, " ")
            return self._ids(lists)[:2]
        nul = pc.match_substring(texts, "\0")
        lists = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
        ids, counts, odd = self._ids(lists)
        odd |= nul.to_numpy(zero_copy_only=False)
        if not odd.any():
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        again = np.nonzero(odd)[0]
        other, n, _ = self._ids(pa.array([_PIECES.findall(texts[int(i)].as_py()) for i in again], pa.list_(pa.string())))
        for i, own in zip(again, np.split(other, np.cumsum(n)[:-1]), strict=True):
            parts[i] = own
        return _flat(parts)

    def _ids(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of listed chunks, how many each list has, and which lists hold a chunk cut in mid white space."""
        ends = np.asarray(lists.offsets)
        words = lists.flatten().dictionary_encode()
        at = self._look_up(words.dictionary.to_pylist())
        codes = at[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)
        lengths = self.length[codes]
        before = np.concatenate((np.zeros(1, np.int32), np.cumsum(lengths, dtype=np.int32)))
        places = np.repeat(self.first[codes] - before[:-1], lengths)
        places += np.arange(before[-1], dtype=np.int32)
        ids = self.pool[places]
        odd = np.concatenate((np.zeros(1, np.int32), np.cumsum(self.odd[codes], dtype=np.int32)))
        return ids, np.diff(before[ends - ends[0]]).astype(np.int64), np.diff(odd[ends - ends[0]]) > 0

    def _look_up(self, chunks: list[str]) -> np.ndarray:
        if len(self.index) > self.most:
            self._shrink()
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int32, len(chunks))
        unknown = np.nonzero(at < 0)[0]
        if len(unknown):
            at[unknown] = self._learn([chunks[i] for i in unknown.tolist()])
        self.met[at] += 1
        return at

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """Encodes new chunks with a special token between them, which the tokenizer keeps apart; their numbers."""
        sep, sep_id = self.between
        asked = chunks
        marked = [c for c in chunks if self.special.search(c)] if self.special.search("\n".join(chunks)) else []
        if marked:
            held = set(marked)
            chunks = [c for c in chunks if c not in held]
        joint = [sep.join(chunks[i : i + AT_A_TIME]) + sep for i in range(0, len(chunks), AT_A_TIME)]
        # One at a time: what the library returns holds much more than ids.
        ids = [np.array(self.tokenizer.encode_batch_fast([j], add_special_tokens=False)[0].ids, np.uint32) for j in joint]
        for e in self.tokenizer.encode_batch_fast(marked, add_special_tokens=False):
            ids.append(np.array([*e.ids, sep_id], np.uint32))
        alone = sum(map(len, ids[: len(joint)]))
        flat = np.concatenate(ids)
        ends = np.nonzero(flat[:alone] == sep_id)[0]
        if len(ends) != len(chunks):
            raise ValueError("the tokenizer doesn't keep its special tokens apart")
        ends = np.concatenate((ends, alone + np.cumsum([len(x) for x in ids[len(joint) :]], dtype=np.int64) - 1))
        starts = np.concatenate(([0], ends[:-1] + 1))
        chunks = chunks + marked
        k, n = len(self.index), len(self.index) + len(chunks)
        while n > len(self.first):
            self.first, self.length, self.odd, self.met = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.length, self.odd, self.met))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(flat)] = flat
        self.first[k:n], self.length[k:n], self.met[k:n] = self.used + starts, ends - starts, 0
        self.odd[k:n] = [c[-1:] in _SPACES or (c[1:2] if c[:1] == " " else c[:1]) in _SPACES for c in chunks] if self.spaces == "leading" else False
        self.used += len(flat)
        self.index.update(zip(chunks, range(k, n), strict=True))
        return np.arange(k, n) if not marked else np.fromiter(map(self.index.__getitem__, asked), np.int64, len(asked))


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)).astype(np.uint32), np.array([len(x) for x in parts], np.int64)


_encoders: dict[tuple[str, str, int | None], Chunks] = {}


def encoder(path: str, spaces: str, kept: int | None = None) -> Chunks:
    """The worker's encoder of that file; it stays from task to task, until another is asked for."""
    if (path, spaces, kept) not in _encoders:
        _encoders.clear()
        _encoders[path, spaces, kept] = Chunks(path, spaces, kept)
    return _encoders[path, spaces, kept]


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Gives memory that is free back to the system, where it counts for the executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def portions(batch: pa.RecordBatch, text: int, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have about ``most`` bytes, one row at least; memory is released at its end."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(start, end - start)
        start = end
    release()


def strings(column: pa.Array) -> pa.Array:
    """Texts with null as the empty string, as one plain array."""
    return pc.fill_null(column.cast(pa.string()), "")
