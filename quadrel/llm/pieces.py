"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is compiled from a model file: a normaliser that maps
characters, marks spaces and adds the dummy prefix, one arc per piece over a
prefix tree, and byte arcs for characters that no piece spells. Composed with an input it gives a
lattice, and the encoding is the shortest path in the tropical semiring.

For unigram models an arc weighs minus its piece's score. In BPE models an
arc's weight depends on the piece before it: 0 if merging the two pieces'
text from single characters leaves just these two, else infinite. A sequence
of pieces is the BPE encoding of its text exactly if all neighbours are such
pairs, so the one path of finite weight is the encoding, and each position
of the input is reached by one piece only.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import small_batches

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Fixed values of the model file format: piece types, model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words in each of two tables, and pairs of pieces, remembered per worker, at most, and the longest such word: some 60 MB.
#: More words cost memory and save time; results are the same.
_MOST_WORDS, _MOST_PAIRS, _LONGEST_CACHED = 50_000, 300_000, 64


def _fields(data: bytes):
    """(field number, value) pairs of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            at += size
            yield key >> 3, data[at - size : at]
        else:
            size = 4 if kind == 5 else 8
            at += size
            yield key >> 3, data[at - size : at]


def character_map(data: bytes) -> dict[str, str]:
    """The rules of a model's character map: a double-array trie of the UTF-8 bytes of what is replaced, and its replacements.

    A unit of the array holds the label of its arc, the place of its node's
    arcs, and whether the node ends a key; a key's unit for the empty label
    tells where its replacement starts.
    """
    if not data:
        return {}
    size = int.from_bytes(data[:4], "little")
    units, texts = np.frombuffer(data[4 : 4 + size], "<u4").astype(np.int64), data[4 + size :]
    moves = (units >> 10) << ((units & 512) >> 6)
    labels, found, open_ = np.arange(1, 256), {}, [(0 ^ int(moves[0]), b"")]
    while open_:
        base, key = open_.pop()
        places = base ^ labels
        places, names = places[places < len(units)], labels[places < len(units)]
        for place, name in zip(places[hit := (units[places] & 0x800000FF) == names].tolist(), names[hit].tolist()):
            longer, after = key + bytes([name]), place ^ int(moves[place])
            if units[place] >> 8 & 1:
                start = int(units[after] & 0x7FFFFFFF)
                found[longer.decode()] = texts[start : texts.index(b"\0", start)].decode()
            open_.append((after, longer))
    return found


class Normaliser:
    """The first part of the transducer, compiled from a model's character map and its rules about spaces.

    Of the map's keys the longest at each place is replaced; keys of one
    character are a table, and longer ones are looked for only where a first
    and a second character of such a key follow each other.
    """

    def __init__(self, rules: dict[str, str], prefix: bool, squeeze: bool, escape: bool):
        self.rules, self.prefix, self.squeeze, self.escape = rules, prefix, squeeze, escape
        self.single = {ord(k): v for k, v in rules.items() if len(k) == 1}
        long = [k for k in rules if len(k) > 1]
        self.lengths: dict = {}
        for k in long:
            self.lengths.setdefault(k[0], set()).add(len(k))
        one_of = lambda chars: "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"
        self.start = re.compile(f"{one_of({k[0] for k in long})}(?={one_of({k[1] for k in long})})") if long else None

    def mapped(self, text: str) -> str:
        if not self.rules:
            return text
        out, at = [], 0
        for m in self.start.finditer(text) if self.start else ():
            i = m.start()
            key = i >= at and next((text[i : i + n] for n in sorted(self.lengths[text[i]], reverse=True) if text[i : i + n] in self.rules), None)
            if key and len(key) > 1:
                out += [text[at:i].translate(self.single), self.rules[key]]
                at = i + len(key)
        return "".join([*out, text[at:].translate(self.single)])

    def __call__(self, text: str) -> str:
        whole, text = text, self.mapped(text)
        if self.squeeze:
            whole = text = " ".join(x for x in text.split(" ") if x)
        # A text of characters that map to nothing still gets its prefix.
        if self.prefix and whole:
            text = " " + text
        if not self.escape:
            return text
        text = text.replace(" ", SPACE)
        # Marks that the text itself ends with go like the spaces they stand for.
        return text.rstrip(SPACE) if self.squeeze else text


class Transducer:
    """The compiled model. Small enough to broadcast: its size is that of the vocabulary."""

    def __init__(self, data: bytes, most_words: int = _MOST_WORDS):
        self.most_words = most_words
        self.pieces, self.scores, self.types = [], [], []
        self.kind, self.prefix, self.squeeze, self.escape = UNIGRAM, True, True, True
        charsmap = b""
        for field, value in _fields(data):
            if field == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.types.append(piece[3])
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.normalise = Normaliser(character_map(charsmap), self.prefix, self.squeeze, self.escape)
        self.unknown = self.types.index(UNKNOWN)
        self.byte_ids = [-1] * 256
        self.ids: dict[str, int] = {}
        for i, (p, t) in enumerate(zip(self.pieces, self.types)):
            if t == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
            elif t in (NORMAL, USER_DEFINED):
                self.ids.setdefault(p, i)
        self._compile()

    def _compile(self) -> None:
        self.tree: dict = {}
        for p, i in self.ids.items():
            node = self.tree
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        long = [p for p in self.ids if len(p) > 1]
        #: No piece goes on with a space mark after another character, so words encode alone.
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in long)
        self.by_line = not any("\n" in p for p in long)
        self.texts = [self._bytes_of(i) for i in range(len(self.pieces))]
        self.is_byte = np.array([t == BYTE for t in self.types])
        self._pairs: dict = {}
        self._words: dict = {}
        self._older: dict = {}

    def _bytes_of(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.types[i] == UNKNOWN else self.pieces[i].encode()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("tree", "_pairs", "_words", "_older", "texts")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._compile()

    def fallback(self, char: str) -> list[int]:
        found = [self.byte_ids[b] for b in char.encode()]
        return [self.unknown] if -1 in found else found

    def _merges_apart(self, left: str, right: str) -> bool:
        """Whether no merge joins the end of ``left`` with the start of ``right``."""
        parts = list(left + right)
        border = len(left)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            start = sum(map(len, parts[:at]))
            if start < border < start + len(parts[at]) + len(parts[at + 1]):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == [x for x in (left, right) if x]

    def joins(self, before: int, piece: int) -> bool:
        """Finite weight of an arc for ``piece`` after ``before`` (-1: the start, -2: a character without a piece)."""
        key = (before + 2) * len(self.pieces) + piece
        found = self._pairs.get(key)
        if found is None:
            left = self.pieces[before] if before >= 0 else ""
            if len(self._pairs) >= _MOST_PAIRS:
                self._pairs.clear()
            self._pairs[key] = found = self._merges_apart(left, self.pieces[piece])
        return found

    def shortest_path(self, text: str) -> list[int]:
        """Piece ids of normalised text."""
        n = len(text)
        if self.kind == BPE:
            last, origin = [None] * (n + 1), [0] * (n + 1)
            last[0] = -1
            tree, known, width = self.tree, self._pairs.get, len(self.pieces)
            for i in range(n):
                before = last[i]
                row = (before + 2) * width
                node, j, single = tree, i, False
                while j < n:
                    node = node.get(text[j])
                    if node is None:
                        break
                    j += 1
                    piece = node.get("")
                    if piece is not None:
                        if j == i + 1:
                            single = True
                        if last[j] is None:
                            fits = known(row + piece)
                            if self.joins(before, piece) if fits is None else fits:
                                last[j], origin[j] = piece, i
                if not single and last[i + 1] is None:
                    last[i + 1], origin[i + 1] = -2, i
        else:
            cost, last, origin = [0.0] + [float("inf")] * n, [-1] + [None] * n, [0] * (n + 1)
            worst = min(self.scores) - 10
            for i in range(n):
                node, j, single = self.tree, i, False
                while j < n and (node := node.get(text[j])) is not None:
                    j += 1
                    piece = node.get("")
                    if piece is not None:
                        single |= j == i + 1
                        if (c := cost[i] - self.scores[piece]) < cost[j]:
                            cost[j], last[j], origin[j] = c, piece, i
                if not single and (c := cost[i] - worst) < cost[i + 1]:
                    cost[i + 1], last[i + 1], origin[i + 1] = c, -2, i
        out, j = [], n
        while j:
            i = origin[j]
            out.append(self.fallback(text[i])[::-1] if last[j] == -2 else [last[j]])
            j = i
        return [x for part in reversed(out) for x in reversed(part)]

    def _word(self, word: str) -> bytes:
        """Encoded ids of one word of the normalised text, remembered while there is room."""
        found = self._words.get(word)
        if found is None:
            found = self._older.get(word)
            if found is None:
                path = self.shortest_path(word)
                found = struct.pack(f"<{len(path)}I", *path)
            if len(self._words) >= self.most_words:
                # What is not asked for again while the new table fills is forgotten.
                self._words, self._older = {}, self._words
            if len(word) <= _LONGEST_CACHED:
                self._words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers."""
        text = self.normalise(text)
        if not (self.by_word and self.escape and self.kind == BPE):
            return np.array(self.shortest_path(text), dtype="<u4").tobytes()
        word = self._word
        head, *rest = text.split(SPACE)
        out, marks = [self._lines(head)] if head else [], SPACE
        for part in rest:
            if not part:
                marks += SPACE
                continue
            out.append(word(marks + part) if "\n" not in part else self._lines(marks + part))
            marks = SPACE
        if rest and not rest[-1]:
            out.append(word(marks[:-1]))
        return b"".join(out)

    def _lines(self, text: str) -> bytes:
        """A word that holds line ends, which are pieces of their own if no piece has one inside."""
        if not self.by_line:
            return self._word(text)
        out = []
        for k, part in enumerate(text.split("\n")):
            if k:
                out.append(self._word("\n"))
            if part:
                out.append(self._word(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids; bytes that are not UTF-8 become U+FFFD."""
        texts = self.texts
        text = b"".join([texts[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        if self.escape:
            text = text.replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def load(path: str = MODEL_PATH, most_words: int = _MOST_WORDS) -> Transducer:
    with open(path, "rb") as file:
        return Transducer(file.read(), most_words)


def _sent(docs: DataFrame, path: str, most_words: int = _MOST_WORDS):
    return docs.sparkSession.sparkContext.broadcast(load(path, most_words))


def encode(docs: DataFrame, path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ids, the piece ids of its whole text.

    Null text gives null ids, an empty one no ids. Ids of rows pass through,
    null and repeated ones too; equal texts get equal ids. An empty table
    gives no rows. The model is read by the driver only.
    """
    held = _sent(docs, path)

    def run(batches):
        for batch in small_batches(batches, 1, 2 << 20):
            coded = [None if t is None else held.value.encode(t) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(c or b"") // 4 for c in coded])
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.array([c is None for c in coded] + [False]))
            values = pa.array(np.frombuffer(b"".join(c or b"" for c in coded), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) of (doc_id, ids).

    Null ids give null text and no ids an empty one. Row ids pass through,
    null and repeated ones too; an empty table gives no rows. What the
    normaliser changed does not come back.
    """
    held = _sent(coded, path)

    def run(batches):
        for batch in batches:
            texts = [None if x is None else held.value.decode(np.array(x, "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(coded.select("doc_id", "ids"), run, "doc_id long, text string")


def encoded_digests(
    docs: DataFrame, path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text", most_words: int = 400_000
) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_byte_tokens, ids_digest, round_trip.

    ``ids_digest`` is the hex xxHash64 of the ids as little-endian 32-bit
    numbers. ``round_trip`` tells whether decoding gives the text back. Null
    text counts as empty. Row ids pass through, null and repeated ones too;
    an empty table gives no rows.
    """
    held = _sent(docs, path, most_words)

    def run(batches):
        for batch in small_batches(batches, 1, 2 << 20):
            rows = []
            for text in batch.column(1).to_pylist():
                coded = held.value.encode(text or "")
                ids = np.frombuffer(coded, "<u4")
                n_bytes = int(held.value.is_byte[ids].sum())
                rows.append((len(ids), n_bytes, xxhash.xxh64_hexdigest(coded), held.value.decode(coded) == (text or "")))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_digest", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, n_tokens long, n_byte_tokens long, ids_digest string, round_trip boolean")
