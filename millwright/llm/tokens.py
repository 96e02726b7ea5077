"""Token ids of whole texts, exactly those of the tokenizers library, with each distinct part of a batch encoded once.

Both tokenizers used here cut a text into words, numbers, marks and white space before they merge pieces, and none of
those reaches from a visible character into white space after it. So a text's ids are those of its parts, cut before
each run of white space and after a single newline, and a part met before needs no second encoding. A text with white
space or controls other than space, tab and newline is encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one worker for each core

SPACES = np.isin(np.arange(256), [0x09, 0x0A, 0x20])
CONTROLS = (np.arange(256) < 0x20) & ~SPACES | (np.arange(256) == 0x7F)
#: White space and controls of more than one byte in UTF-8, by their first bytes and the range of the last one.
UNUSUAL = ((b"\xc2", 0x80, 0xA0), (b"\xe1\x9a", 0x80, 0x80), (b"\xe1\xa0", 0x8E, 0x8E), (b"\xe2\x80", 0x80, 0x8F), (b"\xe2\x80", 0xA8, 0xAF), (b"\xe2\x81", 0x9F, 0xA4), (b"\xe3\x80", 0x80, 0x80), (b"\xef\xbb", 0xBF, 0xBF))
#: A part of Latin letters and closing marks is one pre-token of each kind at most: word, marks, and what is neither.
PLAIN = re.compile(r"^( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)?([.,;:!?]*)(.*)$", re.M)
BATCH_BYTES = 8 << 20


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: As str.translate takes it, of a text read as Latin-1 whose lines are to stay.
BYTE_TEXT = _byte_characters() | {10: "\n"}


class Encoder:
    """ids of whole texts. words_only: the tokenizer lower-cases and drops white space."""

    def __init__(self, name: str, words_only: bool, cached: int = 150_000) -> None:
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of 16 bits only")
        self.words_only, self.cached = words_only, cached
        self.merges = Tokenizer(self.tokenizer.model)  # of pre-tokens, one in a line
        self.merges.pre_tokenizer = CharDelimiterSplit("\n")
        self.marks: dict[str, bytes] = {"": b""}
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_tokens(self, texts: list[str]) -> list[bytes]:
        """ids of pre-tokens without digits; a line of a digit tells them apart."""
        out = []
        for i in range(0, len(texts), 50_000):
            lines = "\n1\n".join([*texts[i : i + 50_000], ""]).encode().decode("latin-1").translate(BYTE_TEXT)
            ids = np.array(self.merges.encode_batch_fast([lines], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(ids == ids[-1]).tolist() if len(ids) else []
            data = ids.tobytes()
            out += [data[2 * a : 2 * b] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)]
        return out

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        """ids of parts that aren't in the cache; plain ones go to the merges at once."""
        where = [i for i, x in enumerate(parts) if b"\n" not in x]
        found = PLAIN.findall(b"\n".join([parts[i] for i in where]).decode()) if where else []
        plain = {i: (w.lstrip().lower() if self.words_only else w, marks) for i, (w, marks, rest) in zip(where, found, strict=True) if w and not rest}
        words = list({w for w, _ in plain.values()})
        marks = list({m for _, m in plain.values()} - self.marks.keys())
        self.marks.update(zip(marks, self._pre_tokens(marks), strict=True))
        code, marks_code = dict(zip(words, self._pre_tokens(words), strict=True)), self.marks
        others = [i for i in range(len(parts)) if i not in plain]
        out = dict(zip(others, self.whole([parts[i].decode() for i in others]), strict=True))
        out.update((i, code[w] + marks_code[m]) for i, (w, m) in plain.items())
        return [out[i] for i in range(len(parts))]

    def _lookup(self, parts: list[bytes]) -> list[bytes]:
        if len(self.new) > self.cached:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        if missing := [x for x in parts if x not in new]:
            unseen = []
            for x in missing:
                if (ids := old.get(x)) is None:
                    unseen.append(x)
                else:
                    new[x] = ids
            new.update(zip(unseen, self._parts(unseen), strict=True))
        return list(map(new.__getitem__, parts))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """ids of each text as uint16; a null text has none."""
        out, group, held = [], [], 0
        for x in texts:
            b = (x or "").encode()
            group.append(b)
            held += len(b)
            if held >= BATCH_BYTES:
                out += self._encode(group)
                group, held = [], 0
        return out + (self._encode(group) if group else [])

    def encode_ended(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, end_id after each, in one array, and where each text starts in it (its end at last)."""
        each, end = self.encode(texts), np.array([end_id], np.uint16)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)) + 1)])
        return np.concatenate([x for ids in each for x in (ids, end)] or [np.zeros(0, np.uint16)]), bounds

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        data = b"".join(texts)
        raw = np.frombuffer(data, np.uint8)
        odd = self._unusual(data, raw, ends)
        if not len(raw):
            return [np.zeros(0, np.uint16)] * len(texts)
        space = SPACES[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[0] = cut[-1] = True
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[2:-1] |= ~space[2:] & (raw[1:-1] == 0x0A) & ~space[:-2]
        cut[ends] = True
        offsets = np.flatnonzero(cut)
        parts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        ids = self._lookup(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        flat, starts = np.frombuffer(b"".join(ids), "<u2"), np.cumsum(lengths) - lengths
        index = coded.indices.to_numpy()
        n = lengths[index]
        until = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat((starts[index] - until[:-1]).astype(np.int32), n)
        at += np.arange(until[-1], dtype=np.int32)
        every = flat[at]
        bounds = until[np.searchsorted(offsets, np.concatenate([[0], ends]))]
        out = [every[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in odd:
            out[i] = np.frombuffer(self.whole([texts[i].decode()])[0], "<u2")
        return out

    def _unusual(self, data: bytes, raw: np.ndarray, ends: np.ndarray) -> list[int]:
        at = [np.flatnonzero(CONTROLS[raw])]
        for first, low, high in UNUSUAL:
            lead = np.flatnonzero(raw[: len(raw) - len(first)] == first[0])
            if len(first) == 2:
                lead = lead[lead + 2 < len(raw)]
                lead = lead[raw[lead + 1] == first[1]]
            at.append(lead[(raw[lead + len(first)] >= low) & (raw[lead + len(first)] <= high)])
        return np.unique(np.searchsorted(ends, np.concatenate(at), side="right")).tolist()


def by_size(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some `most` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(size[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


_encoders: dict[tuple, Encoder] = {}


def encoder(name: str, words_only: bool) -> Encoder:
    """One for each Python worker, kept between its tasks."""
    key = (name, words_only)
    if key not in _encoders:
        _encoders[key] = Encoder(name, words_only)
    return _encoders[key]
