"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compiled once per worker from the model file, as three machines that every input is composed with:

* the normaliser: states for the start, for text and (if extra white space is removed) for white
  space not yet written, with arcs for a space and for any other character; it writes the dummy
  prefix and U+2581;
* the pieces: a trie of arcs, read from their last character back, weighted with minus their score;
* byte fallback: arcs for characters that are no piece, heavier than any piece.

The path of least sum (tropical semiring: sums along a path, minimum over paths) is kept for every
place of the input. For a unigram model every piece may follow every other, so a place is one
state. For a BPE model a state is a place and the piece before it, with arcs only to pieces that
may follow: ``a`` and ``b`` may be neighbours if merging the characters of ``ab`` by score gives
exactly ``a, b``. A path of such arcs is what merging finds, so each place has one state and the
first arc that reaches it is the lightest.

Every path passes through a place whose two neighbouring characters no piece holds in this order:
before white space (no piece holds U+2581 behind another character) and around characters outside
all pieces, for instance. Inputs are composed piecewise between such places. The parts of many
texts are sorted, and a part goes on from the states of the beginning that it shares with the one
before. A bounded memo of two generations keeps the paths of recent parts. All texts of a slice are
cut at once by a table of the pairs of characters that pieces hold, and each distinct part is looked
up once.

Defined results: null text is empty and has no ids; repeated rows get equal results; extra columns
are not read; an empty table gives no rows; a part without such places takes time in proportion
to its length. Without byte fallback neighbouring unknown characters are one id, as in the library.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.tokens import binary_array

SPACE = "▁"
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0  # fixed value: an unknown character weighs this more than the heaviest piece
SLICE = 1_000_000  # characters of the texts whose parts are composed together
ROWS = 500  # decoded together
PLACES = 1 << 20  # of the table of pairs, a power of two
RUNS = re.compile(" +|[^ ]+")


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield number, data[at : at + size]
            at += size


class Model:
    """What the transducer needs of a model file."""

    NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6

    def __init__(self, path: str):
        import sentencepiece

        self.pieces: list[tuple[str, float, int]] = []
        self.kind, fallback = UNIGRAM, 0
        normaliser = {3: 1, 4: 1, 5: 1}  # dummy prefix, remove extra white space, escape white space
        # The library reads the file (and its scores); the message holds the settings, which it doesn't show.
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        for number, value in proto_fields(library.serialized_model_proto()):
            if number == 2:
                settings = dict(proto_fields(value))
                self.kind, fallback = settings.get(3, UNIGRAM), settings.get(35, 0)
            elif number == 3:
                normaliser |= dict(proto_fields(value))
        if normaliser.get(2) or self.kind not in (UNIGRAM, BPE) or not normaliser[5]:
            raise ValueError("only models without a character map are compiled")
        self.prefix, self.collapse = bool(normaliser[3]), bool(normaliser[4])
        for i in range(library.get_piece_size()):
            kind = self.NORMAL
            if library.is_byte(i):
                kind = self.BYTE
            elif library.is_control(i) or library.is_unused(i):
                kind = self.CONTROL
            elif library.is_unknown(i):
                kind = self.UNKNOWN
            self.pieces.append((library.id_to_piece(i), library.get_score(i), kind))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == self.UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == self.BYTE} if fallback else {}


class Transducer:
    START, TEXT, GAP = range(3)  # of the normaliser: nothing written, text written, white space held back

    def __init__(self, path: str, memo: int = 170_000):
        self.model = Model(path)
        self._id = {p: i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == Model.NORMAL}
        self._weight = [-score for _, score, _ in self.model.pieces]
        self._merge_weight = {p: self._weight[i] for p, i in self._id.items()}
        self._unknown_weight = max((self._weight[i] for i in self._id.values()), default=0.0) + UNKNOWN_PENALTY
        self._letters = {c for p in self._id for c in p}
        self._pairs = {pair for p in self._id for pair in zip(p, p[1:], strict=False)}
        if self.model.kind == BPE and not self._letters <= self._id.keys():
            raise ValueError("a character of a merged piece is no piece")
        if any(SPACE in p.lstrip(SPACE) for p in self._id):
            raise ValueError("pieces reach over white space")
        self._joined = np.zeros(PLACES, bool)
        if self._pairs:
            self._joined[self._place(*(np.array([ord(c) for c in side], "<u4") for side in zip(*self._pairs, strict=True)))] = True
        self._normaliser = self._normaliser_arcs()
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._follows: dict[int, bool] = {}  # by a * pieces + b
        self._limit = memo

    @cached_property
    def _backwards(self) -> dict:
        """The trie of pieces, which decoding doesn't need."""
        trie: dict = {}
        for piece, i in self._id.items():
            node = trie
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = i  # spells piece i
        return trie

    def _normaliser_arcs(self) -> dict[tuple[int, bool], tuple[str, int]]:
        """(state, is it a space) to what is written before the character (for a space: instead) and the next state."""
        prefix = SPACE if self.model.prefix else ""
        word = {(self.START, False): (prefix, self.TEXT), (self.TEXT, False): ("", self.TEXT), (self.GAP, False): (SPACE, self.TEXT)}
        if self.model.collapse:
            space = {(self.START, True): ("", self.START), (self.TEXT, True): ("", self.GAP), (self.GAP, True): ("", self.GAP)}
        else:
            space = {(self.START, True): (prefix + SPACE, self.TEXT), (self.TEXT, True): (SPACE, self.TEXT)}
        return word | space

    def normalise(self, text: str, state: int = START) -> tuple[str, int]:
        """What the normaliser writes for ``text`` from ``state`` on, and the state it ends in."""
        arcs, out = self._normaliser, []
        for run in RUNS.finditer(text):
            own = run[0]
            if own[0] == " ":
                for _ in own:
                    before, state = arcs[state, True]
                    out.append(before)
            else:  # a word leads to TEXT and stays there, writing itself
                before, state = arcs[state, False]
                out += before, own
                before, after = arcs[state, True]
                if after == state:  # white space stays there, too
                    return "".join(out) + text[run.end() :].replace(" ", before), state
        return "".join(out), state

    def merged(self, text: str) -> list[str]:
        """Characters of a short string merged by score, leftmost first among equals."""
        parts, weight = list(text), self._merge_weight.get
        sums = [weight(a + b, math.inf) for a, b in zip(parts, parts[1:], strict=False)]  # of merging each with the next
        while sums:
            least = min(sums)
            if least == math.inf:
                break
            i = sums.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del sums[i]
            if i:
                sums[i - 1] = weight(parts[i - 1] + parts[i], math.inf)
            if i < len(sums):
                sums[i] = weight(parts[i] + parts[i + 1], math.inf)
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        """May piece b stand behind a, or (a is -1) first?"""
        if len(self._follows) > 600_000:
            self._follows.clear()
        both = [self.model.pieces[i][0] for i in (a, b) if i >= 0]
        known = self._follows[a * len(self.model.pieces) + b] = self.merged("".join(both)) == both
        return known

    def _fallback(self, c: str) -> list[int]:
        if self.model.bytes:
            return [self.model.bytes[b] for b in c.encode()]
        return [self.model.unknown]

    def _arcs_to(self, part: str, end: int) -> list[tuple[int, int]]:
        """(start, piece) of the pieces that spell ``part`` up to ``end``, shortest first; -1 is fallback."""
        node, arcs = self._backwards, []
        if part[end - 1] not in self._id:
            arcs.append((end - 1, -1))
        for at in range(end - 1, -1, -1):
            node = node.get(part[at])
            if node is None:
                break
            if "" in node:
                arcs.append((at, node[""]))
        return arcs

    def shortest_paths(self, parts: list[str]) -> Iterator[list[int]]:
        """Ids along the lightest path of the composition with each of the sorted ``parts``."""
        weights, follows, check, bpe = self._weight, self._follows, self._may_follow, self.model.kind == BPE
        size = len(self.model.pieces)
        # By place: weight of the lightest path there, where its last piece starts, that piece.
        cost, begin, last = [0.0], [0], [-1]
        known = ""
        for part in parts:
            shared = 0
            for x, y in zip(known, part, strict=False):
                if x != y:
                    break
                shared += 1
            del cost[shared + 1 :], begin[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(part) + 1):
                least, origin, by = math.inf, 0, -1
                for at, piece in reversed(self._arcs_to(part, end)):
                    total = cost[at] + (weights[piece] if piece >= 0 else self._unknown_weight)
                    if bpe and piece >= 0:
                        good = follows.get(last[at] * size + piece)
                        if not (check(last[at], piece) if good is None else good):
                            continue
                    if total < least:
                        least, origin, by = total, at, piece
                        if bpe:  # one state at a place
                            break
                cost.append(least)
                begin.append(origin)
                last.append(by)
            known = part
            ids: list[int] = []
            at = len(part)
            while at:
                ids += [last[at]] if last[at] >= 0 else self._fallback(part[begin[at] : at])[::-1]
                at = begin[at]
            yield ids[::-1]

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the table of pairs holds a character before another. Pairs on one place only leave more uncut."""
        return (a * np.uint32(2654435761) + b) & np.uint32(PLACES - 1)

    def _units(self, written: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Normalised texts, cut where no piece reaches over: each unit's number, the units by number, units per text."""
        flat = "".join(written)
        codes = np.frombuffer(flat.encode("utf-32-le"), "<u4")
        cut = np.ones(len(codes) + 1, bool)
        np.logical_not(self._joined[self._place(codes[:-1], codes[1:])], out=cut[1 : len(codes)])
        ends = np.cumsum(np.fromiter(map(len, written), np.int64, len(written)))
        cut[ends] = True
        per_text = np.diff(np.searchsorted(np.flatnonzero(cut), ends), prepend=0)
        data = np.frombuffer(flat.encode(), np.uint8)
        first = (data & 0xC0) != 0x80  # bytes of characters
        first[first] = cut[:-1]
        offsets = np.append(np.flatnonzero(first), len(data))
        units = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary, per_text

    def _paths(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units."""
        if len(self._memo) > self._limit:
            self._older, self._memo = self._memo, {}
        memo, older, new = self._memo, self._older, []
        for unit in units:
            if unit not in memo:
                ids = older.get(unit)
                if ids is None:
                    new.append(unit)
                else:
                    memo[unit] = ids
        new.sort()
        for unit, ids in zip(new, self.shortest_paths(new), strict=True):
            memo[unit] = array("I", ids).tobytes()
        return list(map(memo.__getitem__, units))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        numbers, units, per_text = self._units([self.normalise(text)[0] for text in texts])
        paths = self._paths(units.to_pylist())
        sizes = np.fromiter(map(len, paths), np.int64, len(paths))
        ends = np.concatenate([[0], np.cumsum(sizes[numbers])])[np.cumsum(per_text)].tolist()
        flat = b"".join(map(paths.__getitem__, numbers.tolist()))
        found = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return found if self.model.bytes else [self._one_unknown(ids) for ids in found]

    def _one_unknown(self, ids: bytes) -> bytes:
        flat = np.frombuffer(ids, "<u4")
        unknown = flat == self.model.unknown
        unknown[1:] &= flat[:-1] == self.model.unknown
        unknown[:1] = False
        return flat[~unknown].tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The inverse transducer: pieces and bytes back to text; bytes that are no UTF-8 become U+FFFD."""
        spelled = self._spelled
        text = b"".join(map(spelled.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.prefix and text[:1] == " " else text

    @property
    def _spelled(self) -> list[bytes]:
        if not hasattr(self, "_bytes_of"):
            back = {i: bytes([b]) for b, i in self.model.bytes.items()}
            silent = (Model.CONTROL,)
            self._bytes_of = [back.get(i, b"" if k in silent else p.encode()) for i, (p, _, k) in enumerate(self.model.pieces)]
        return self._bytes_of


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each worker and file."""
    return Transducer(path)


def _slices(column: pa.Array) -> Iterator[list[str]]:
    """Texts (null: empty), about ``SLICE`` characters at a time."""
    held, size = [], 0
    for value in column:
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_pieces, ids`` (little-endian unsigned 32-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            start = 0
            for texts in _slices(batch.column(1)):
                ids = machine.encode_all(texts)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                own = batch.column(0).slice(start, len(ids))
                yield pa.RecordBatch.from_arrays([own, pa.array(sizes // 4), binary_array(sizes, b"".join(ids))], ["doc_id", "n_pieces", "ids"])
                start += len(ids)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids binary")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """``ids`` (see ``encoded``) with their ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                texts = [machine.decode(np.frombuffer(x.as_py(), "<u4")) for x in rows.column(2)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*rows.schema.names, "text"])

    return ids.mapInArrow(run, "doc_id long, n_pieces long, ids binary, text string")
