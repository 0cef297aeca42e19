"""Byte-level BPE through sentencepiece: encoding and decoding.

A byte-level BPE vocabulary is a list of byte strings with merge ranks. It becomes a sentencepiece model as it is: every byte is
mapped to one printable character, a piece's score is its negative rank (sentencepiece merges the best-scored neighbours first, ties
from the left, which is the byte-level rule), and normalisation is the identity, so nothing is added, folded or escaped. No training.

Texts are cut by the vocabulary's pattern first and each match is encoded by itself; ids decode by the inverse byte mapping.

Defined cases: a null text is an empty one and has no ids; repeated rows are each encoded; a null id column stays null; an empty table
gives no rows; a text of any length is encoded whole (one task holds it, its ids and their digests' input); further columns of the input
are ignored by ``encode_frame``, whose output has its own names.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import freed, slices

#: Characters that stand for bytes: printable Latin-1 ones for themselves, the others from U+0100 on.
_KEPT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHIFTED = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _KEPT)}
BYTE_CHARS = [chr(_SHIFTED.get(b, b)) for b in range(256)]
_TO_CHARS = {b: c for b, c in enumerate(BYTE_CHARS)}
UNKNOWN = "⁇unknown"
#: A character that no piece has; it stands between matches that are encoded in one call.
BORDER = "\ue000"
#: Matches that are encoded in one call.
TOGETHER = 1024

#: 1 for white space of one byte, 2 for the first byte of one that has more (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000).
_WHITE = np.zeros(256, np.uint8)
_WHITE[[*range(9, 14), *range(28, 33)]] = 1
_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = 2
_SECOND = np.isin(np.arange(256), [0x85, 0xA0, 0x9A, 0x80, 0x81])


def read_ranks(path: str) -> list[bytes]:
    """Pieces in order of rank, from a file of base64 pieces with their ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    pieces: list[bytes] = [b""] * len(pairs)
    for piece, rank in pairs:
        pieces[int(rank)] = base64.b64decode(piece)
    return pieces


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float | bool) -> bytes:
    """One protocol buffer field."""
    if isinstance(value, bool | int):
        return _varint(number << 3) + _varint(int(value))
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def model_bytes(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; id 0 is the unknown piece, id r + 1 the piece of rank r."""
    out = [_field(1, _field(1, UNKNOWN) + _field(2, 0.0) + _field(3, 2))]
    for rank, piece in enumerate(pieces):
        out.append(_field(1, _field(1, piece.decode("latin-1").translate(_TO_CHARS)) + _field(2, -float(rank))))
    # Trainer: type BPE, vocabulary size, unknown id 0, no begin, end and padding ids. Normaliser: identity, no dummy prefix, nothing removed, no escapes.
    none = (1 << 64) - 1
    out.append(_field(2, _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, 0) + _field(41, none) + _field(42, none) + _field(43, none) + _field(45, UNKNOWN)))
    out.append(_field(3, _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False)))
    return b"".join(out)


class ByteBPE:
    """Encoder and decoder of one vocabulary. Ids are ranks, kept as little-endian uint16 or uint32 bytes."""

    def __init__(self, path: str, pattern: str, most_bytes: int = 40 << 20) -> None:
        self.pieces = read_ranks(path)
        self.width = "<u2" if len(self.pieces) < 1 << 16 else "<u4"
        self.find = regex.compile(pattern).findall
        self.uneven = regex.compile(r"\s\s|^\s|\s$").search
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.pieces))
        self.rank = {piece: i for i, piece in enumerate(self.pieces)}
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.chars = np.array([ord(c) for c in BYTE_CHARS], "<u4")
        self.chars[0xFF] = ord(BORDER)  # no byte of UTF-8
        self.newline = self.rank[b"\n"]
        self.unmerged = self._unmerged()
        self.most_bytes = most_bytes
        self.forget()

    def forget(self) -> None:
        """Empties the cache, so that a worker that waits for its next task holds the vocabulary only."""
        self.slot: dict[bytes, int] = {}  # word, with the space or newline before it, to its place in the next two
        self.begin = np.zeros(1, np.int64)  # where a word's ids begin in ``flat``; one more at the end
        self.flat = np.empty(0, self.width)
        self.held = 0

    def _unmerged(self) -> dict[str, int]:
        """Pieces that merging doesn't reach from their bytes. A match that is a piece is that piece all the same."""
        texts = {}
        for i, piece in enumerate(self.pieces):
            try:
                texts[piece.decode()] = i
            except UnicodeDecodeError:
                continue  # no match can be part of a character
        found = self.model.encode([t.encode().decode("latin-1").translate(_TO_CHARS) for t in texts], out_type=int, num_threads=1)
        return {t: i for (t, i), ids in zip(texts.items(), found, strict=True) if ids != [i + 1]}

    def _ids(self, text: str) -> np.ndarray:
        """Ids of a text, each match of the pattern encoded by itself: an unknown character between matches keeps them apart."""
        matches = self.find(text)
        out = []
        for at in range(0, len(matches), TOGETHER):
            part = matches[at : at + TOGETHER]
            raw = np.frombuffer("\udcff".join(part).encode("utf-8", "surrogateescape"), np.uint8)
            ids = np.array(self.model.encode(self.chars[raw].tobytes().decode("utf-32-le"), out_type=int), np.int64)
            if self.unmerged and not self.unmerged.keys().isdisjoint(part):
                each = np.split(ids, np.flatnonzero(ids == 0))
                ids = np.concatenate([[0, self.unmerged[m] + 1] if m in self.unmerged else x for m, x in zip(part, each, strict=True)])
            out.append((ids[ids > 0] - 1).astype(self.width))
        return np.concatenate(out) if out else np.empty(0, self.width)

    def _slots(self, words: list[bytes]) -> np.ndarray:
        """Where the cache has each of these distinct words; new ones are encoded together, with a newline before each."""
        slots = np.fromiter(map(self.slot.get, words, itertools.repeat(-1)), np.int64, len(words))
        places = np.flatnonzero(slots < 0)
        if len(places):
            new = [words[i] for i in places.tolist()]
            after_line = np.fromiter((w[0] == 10 for w in new), bool, len(new))
            ids = self._ids(b"".join([w if w[0] == 10 else b"\n" + w for w in new]).decode())
            starts = np.flatnonzero(ids == self.newline)
            if len(starts) != len(new):
                raise ValueError("the pattern matches across the white space before a word")
            sizes = np.diff(np.append(starts, len(ids))) - ~after_line
            keep = np.ones(len(ids), bool)
            keep[starts[~after_line]] = False  # that newline is none of the word's
            slots[places] = len(self.begin) - 1 + np.arange(len(new))
            self.slot.update(zip(new, slots[places].tolist(), strict=True))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, ids[keep]])
            self.held += sum(map(len, new)) + 200 * len(new) + ids.nbytes
        return slots

    def _gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and where each begins (one more at the end)."""
        sizes = self.begin[slots + 1] - self.begin[slots]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.begin[slots] - upto[:-1], sizes) + np.arange(upto[-1])], upto

    def _uneven(self, lines: dict[int, bytes], texts: list[str | None]) -> list[int]:
        """Texts where two white spaces meet or one stands at an end; ``lines`` are the texts with a newline before each."""
        raw = np.frombuffer(b"".join([*lines.values(), b"\n"]), np.uint8)
        ends = np.cumsum([len(x) for x in lines.values()])
        white = _WHITE[raw]
        met = (white[:-1] == 1) & (white[1:] == 1)
        lead = np.flatnonzero(white == 2)  # of a white space of several bytes, or of another character
        known = list(lines)
        sure = set(np.searchsorted(ends, np.flatnonzero(met), side="right").tolist())
        maybe = set(np.searchsorted(ends, lead[_SECOND[raw[lead + 1]]], side="right").tolist()) - sure
        return [known[k] for k in sure] + [known[k] for k in maybe if self.uneven(texts[known[k]])]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts; give a few megabytes at a time.

        Where no two white spaces meet, the pattern never matches across the space or newline before a word, so distinct words are
        encoded once and looked up; other texts are cut by the pattern as a whole. The cache is bounded by bytes: beyond them the
        words of the last call stay.
        """
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and each collection would walk the whole cache
        try:
            return self._encode_many(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_many(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        lines = {i: b"\n" + t.encode() for i, t in enumerate(texts) if t}
        for i in self._uneven(lines, texts):
            out[i] = self._ids(texts[i]).tobytes()
            del lines[i]
        if not lines:
            return out
        ends = np.cumsum([len(x) for x in lines.values()])
        raw = b"".join(lines.values())
        white = np.frombuffer(raw, np.uint8)
        at = np.append(np.flatnonzero((white == 32) | (white == 10)), len(raw))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        slots = self._slots(distinct)
        ids, upto = self._gathered(slots[words.indices.to_numpy()])
        stops = upto[np.searchsorted(at, ends)]
        for i, a, b in zip(lines, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            out[i] = ids[a + 1 : b].tobytes()  # without the newline put before the text
        if self.held > self.most_bytes:
            self.flat, self.begin = self._gathered(slots)
            self.slot = {w: k for k, w in enumerate(distinct)}
            self.held = sum(map(len, distinct)) + 200 * len(distinct) + self.flat.nbytes
            if self.held > self.most_bytes:
                self.forget()
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text."""
        return self.encode_many([text])[0]

    def ids(self, encoded: bytes) -> list[int]:
        return np.frombuffer(encoded, self.width).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder for each Python worker."""
    return ByteBPE(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the byte-level vocabulary of 50,256 pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_frame(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Rows (doc_id, n_tokens, ids binary, ids_sha256, decoded_sha256); ``ids`` only with ``keep_ids``. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for whole in batches:
            for batch in slices(whole, 1):
                rows = []
                for raw in bpe.encode_many(batch.column(1).to_pylist()):
                    ids = bpe.ids(raw)
                    rows.append((len(ids), raw if keep_ids else None, hashlib.sha256(bpe.joined(ids).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
                n, raw, a, b = zip(*rows, strict=True)
                out = [batch.column(0), pa.array(n, pa.int64()), *([pa.array(raw, pa.binary())] if keep_ids else []), pa.array(a, pa.string()), pa.array(b, pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", *(["ids"] if keep_ids else []), "ids_sha256", "decoded_sha256"])
        bpe.forget()
        freed()

    schema = f"doc_id long, n_tokens long, {'ids binary, ' if keep_ids else ''}ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_frame(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, text binary) of encoded ids; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            out = [None if x is None else bpe.decode(bpe.ids(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text binary")
