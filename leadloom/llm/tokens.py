"""Token ids of whole texts from a tokenizer file, inside tasks."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
MARK = "\x02"
BLOCK = 8_000_000
WORD = re.compile(r"(\x02?[A-Za-zÀ-ÖØ-öø-ÿŒœ]+)([.,!?]*)")


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(0x100 + i) for i, b in enumerate(moved)}


class Encoder:
    """Ids of a byte-level BPE tokenizer as little-endian unsigned 32-bit bytes.

    A single space between two characters that are not white space always starts a pre-token,
    and a single line feed there is one, so the chunks between such places get the same ids
    alone as in their text. A bounded memo of two generations keeps the ids of chunks. A new
    chunk of letters, perhaps with punctuation behind, is one pre-token (or two) and goes
    straight to the library's model; any other goes through the library's whole pipeline.
    """

    def __init__(self, path: str, memo: int = 400_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        self._letters = byte_letters()
        # Ids by chunk; the mark stands before a chunk that follows no space. None: has white space.
        self._memo: dict[str, bytes | None] = {}
        self._older: dict[str, bytes | None] = {}
        self._limit = memo

    @property
    def size(self) -> int:
        return self._library.get_vocab_size()

    def ids(self) -> list[int]:
        return list(self._library.get_vocab().values())

    def _word(self, word: str) -> bytes:
        """Ids of a chunk of letters: one pre-token, which the library's model takes as it is."""
        piece = word[1:] if word[0] == MARK else "\u0120" + word  # the letter for a space
        if not word.isascii():
            piece = word.lstrip(MARK).encode().decode("latin-1").translate(self._letters)
            piece = piece if word[0] == MARK else "\u0120" + piece
        return array("I", [t.id for t in self._model.tokenize(piece)]).tobytes()

    def _lookup(self, chunks: list[str]) -> list[bytes | None]:
        memo, older, match, of_word = self._memo, self._older, WORD.fullmatch, self._word
        found = list(map(memo.get, chunks))
        rest = []
        for i in [i for i, known in enumerate(found) if known is None]:
            key = chunks[i]
            known = older.get(key)
            if known is None:
                m = match(key)
                if m is None:
                    rest.append(i)
                    continue
                word, end = m.groups()
                if end:
                    known = memo.get(word) or older.get(word)
                    if known is None:
                        known = memo[word] = of_word(word)
                    known += memo.get(MARK + end) or self._whole([MARK + end])[0]
                else:
                    known = of_word(key)
            memo[key] = found[i] = known
        plain = [i for i in rest if self._plain(chunks[i])]
        for j in range(0, len(plain), 4096):
            some = plain[j : j + 4096]
            for i, known in zip(some, self._whole([chunks[i] for i in some]), strict=True):
                found[i] = known
        return found

    def _whole(self, keys: list[str]) -> list[bytes]:
        texts = [k[1:] if k[0] == MARK else " " + k for k in keys]
        ids = self._library.encode_batch_fast(texts, add_special_tokens=False)
        known = [np.array(e.ids, "<u4").tobytes() for e in ids]
        self._memo.update(zip(keys, known, strict=True))
        return known

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of consecutive texts laid end to end and their number per text, for blocks of about 8 million bytes."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
            yield self._block(texts.slice(start, stop - start))
            start = stop

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self._memo) > self._limit:
            self._older, self._memo = self._memo, {}
        # Chunks between spaces; a mark tells those that follow no space: line feeds and what opens a line.
        marked = pc.binary_join_element_wise(MARK, pc.replace_substring(texts, "\n", f" {MARK}\n {MARK}"), "")
        pieces = pc.split_pattern(marked, " ")
        coded = pieces.flatten().dictionary_encode()
        ids = self._lookup(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy(zero_copy_only=False)
        per_text = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
        # Empty chunks and chunks with white space come from runs of it; texts with such are cut another way.
        odd_chunk = np.fromiter((x is None for x in ids), bool, len(ids))
        odd = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False).astype(bool)
        if odd_chunk.any():
            odd[np.repeat(np.arange(len(texts)), per_text)[odd_chunk[index]]] = True
        if odd.any():
            parts = np.split(index, np.cumsum(per_text)[:-1])
            for t in map(int, np.flatnonzero(odd)):
                own = self._by_boundary(texts[t].as_py())
                parts[t] = np.arange(len(ids), len(ids) + len(own))
                ids += own
            index, per_text = np.concatenate(parts), np.array([len(x) for x in parts])
        width = np.fromiter((len(x or b"") for x in ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(filter(None, ids)), "<u4")
        first = np.cumsum(width) - width
        size = width[index]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(first[index] - (ends - size), size) + np.arange(total)
        text_ends = np.concatenate([[0], ends])[np.cumsum(per_text)]
        return flat[at], np.diff(text_ends, prepend=0)

    @staticmethod
    def _plain(key: str) -> bool:
        body = key.removeprefix(MARK)
        return body == "\n" or (body != "" and body.split() == [body])

    def _by_boundary(self, text: str) -> list[bytes]:
        """Ids of the chunks of a text cut at single inner spaces only."""
        if not text:
            return [b""]
        first, *others = BOUNDARY.split(text)
        texts = [first, *(" " + c for c in others)]
        ids = self._library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in ids]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    return Encoder(path)


def binary_array(lengths: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    """Byte strings of the given lengths cut from ``data``."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    offsets = pa.py_buffer(ends.astype("<i8"))
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, offsets, pa.py_buffer(data)]).cast(pa.binary())


def id_blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(first column, ids end to end, ids per document) for blocks of documents; every document ends with ``end_id``."""
    for batch in batches:
        start = 0
        for flat, counts in encoder(path).encode(batch.column(1)):
            ids = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
            yield batch.column(0).slice(start, len(counts)), ids, counts + 1
            start += len(counts)
