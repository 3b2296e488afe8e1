"""SentencePiece BPE in vectorised merge rounds.

A batch's texts are cut into words (a run of blanks and what follows it; no piece of the vocabulary
goes on past a blank that comes after something else).  Words not met before are laid out in flat
numpy arrays of symbols, one symbol per character.  Where no piece holds two neighbouring characters next
to each other, no merge can join them, so words are cut there into segments.  Each round takes the minimum
pair rank per segment, merges, and compacts the arrays; pairs are looked up again only beside what
merged, and segments without a pair left drop out, until none remains.  In a segment all leftmost
occurrences of the minimum pair that do not overlap merge at once where no pair with the new piece can
rank before it; where one can, only the leftmost merges in that round, as the sequential rule demands.
Characters outside the vocabulary become their UTF-8 bytes.

Encoded words are kept for later batches of the task, but none of over ``LONGEST_KEPT`` characters, and no more
than ``KEPT_BYTES`` and one batch's in all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
NONE = np.int32(2**31 - 1)
LONGEST_KEPT = 256
KEPT_BYTES = 32 << 20
ROWS_OUT = 256
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*")
_PROBES = ("", " ", "  a  b ", "a\tb\nc", "▁x ▁", "日本 \U00010348", "<s> <unk>", "ﬁ Å", "     the")


class Kept(dict[str, bytes]):
    """Encoded words and a bound of the bytes they take: a character has at most four bytes and four ids."""

    size = 0

    def make_room(self) -> None:
        if self.size > KEPT_BYTES:
            self.clear()
            self.size = 0

    def settle(self, new: list[str]) -> None:
        """Counts the new words and lets long ones go."""
        for word in [word for word in new if len(word) > LONGEST_KEPT]:
            del self[word]
        self.size += 100 * len(new) + 20 * sum(map(len, filter(self.__contains__, new)))


@dataclass
class Vocabulary:
    """The tables of a model: pieces, single characters, and which pairs make which piece."""

    pieces: list[str]
    scores: list[float]
    kinds: str  # per piece: n ordinary, b byte, c control, u unknown
    begin: int
    end: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a byte-fallback BPE model without normalisation; raises for any other."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = "".join(
            "b" if model.is_byte(i) else "c" if model.is_control(i) else "u" if model.is_unknown(i) else "n" for i in ids
        )
        pieces = [model.id_to_piece(i) for i in ids]
        found = cls(pieces, [model.get_score(i) for i in ids], kinds, model.bos_id(), model.eos_id())
        for probe in _PROBES:
            ours = found.encode([probe])[0]
            if ours.tolist() != model.encode(probe, add_bos=True, add_eos=True) or found.decode(ours) != model.decode(ours.tolist()):
                raise ValueError(f"not a byte-fallback BPE model without normalisation: {path}")
        return found

    def __getstate__(self) -> dict:
        """With the tables made so far, but for the large one that takes no time to make."""
        return {name: value for name, value in self.__dict__.items() if name != "of_character"}

    @cached_property
    def rank(self) -> np.ndarray:
        """Per id, small for pieces to merge first; equal scores rank equal."""
        _, place = np.unique(-np.array(self.scores), return_inverse=True)
        return place.astype(np.int32)

    @cached_property
    def of_character(self) -> np.ndarray:
        table = np.full(0x110000, -1, np.int32)
        for i, piece in enumerate(self.pieces):
            if self.kinds[i] == "n" and len(piece) == 1:
                table[ord(piece)] = i
        return table

    @cached_property
    def byte_ids(self) -> np.ndarray:
        table = np.zeros(256, np.int32)
        for i, kind in enumerate(self.kinds):
            if kind == "b":
                table[int(self.pieces[i][3:5], 16)] = i
        return table

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of left and right id, the id they make, and per id whether its merges can go at once."""
        ids = {piece: i for i, piece in enumerate(self.pieces) if self.kinds[i] == "n"}
        found = sorted(
            (ids[piece[:at]] << 32 | ids[piece[at:]], made)
            for piece, made in ids.items()
            for at in range(1, len(piece))
            if piece[:at] in ids and piece[at:] in ids
        )
        keys = np.array([key for key, _ in found] or [0], np.int64)
        made = np.array([i for _, i in found] or [0], np.int32)
        at_once = np.ones(len(self.pieces), bool)
        for part in (keys >> 32, keys & 0xFFFFFFFF):
            at_once[part[self.rank[made] <= self.rank[part]]] = False
        return keys, made, at_once

    @cached_property
    def _neighbours(self) -> np.ndarray:
        """Sorted keys of the left and right character's ids, for characters next to each other in some piece."""
        ids = {piece: i for i, piece in enumerate(self.pieces) if self.kinds[i] == "n" and len(piece) == 1}
        found = {
            ids[left] << 32 | ids[right]
            for piece, kind in zip(self.pieces, self.kinds)
            if kind == "n"
            for left, right in zip(piece, piece[1:])
            if left in ids and right in ids
        }
        return np.array(sorted(found) or [0], np.int64)

    @cached_property
    def _piece_bytes(self) -> list[bytes]:
        plain = {"n": lambda p: p.replace(BLANK, " ").encode(), "b": lambda p: bytes([int(p[3:5], 16)]), "c": lambda p: b"", "u": lambda p: " ⁇ ".encode()}
        return [plain[kind](piece) for kind, piece in zip(self.kinds, self.pieces)]

    def _made_by(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        keys, made, _ = self._pairs
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted) & (left >= 0) & (right >= 0), made[at], -1)

    def _joinable(self, symbols: np.ndarray) -> np.ndarray:
        """Whether a piece can hold each character and the next one next to each other."""
        wanted = symbols[:-1] << 32 | np.maximum(symbols[1:], 0)
        at = np.minimum(np.searchsorted(self._neighbours, wanted), len(self._neighbours) - 1)
        return (self._neighbours[at] == wanted) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words after all merges, ids or -1 - code point where there is none, and each one's word."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_character[points].astype(np.int64)
        symbols = np.where(symbols < 0, -1 - points, symbols)
        word = np.repeat(np.arange(len(words)), lengths)
        apart = (word[1:] != word[:-1]) | ~self._joinable(symbols)
        segment = np.cumsum(np.r_[0, apart])[: len(symbols)]
        place = np.arange(len(symbols))
        out_symbols, out_place = [symbols[:0]], [place[:0]]
        made, joined = np.full(len(symbols), -1), np.flatnonzero(~apart)
        made[joined] = self._made_by(symbols[joined], symbols[joined + 1])
        at_once = self._pairs[2]
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            sizes = np.diff(np.r_[starts, len(segment)])
            ranks = np.where(made >= 0, self.rank[made], NONE)
            least = np.minimum.reduceat(ranks, starts)
            finished = np.repeat(least == NONE, sizes)
            out_symbols.append(symbols[finished])
            out_place.append(place[finished])
            chosen = np.flatnonzero((ranks == np.repeat(least, sizes)) & (ranks != NONE))
            first = np.r_[True, segment[chosen[1:]] != segment[chosen[:-1]]][: len(chosen)]
            nth = np.arange(len(chosen))
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(chosen) != 1][: len(chosen)], nth, 0))
            chosen = chosen[first | (at_once[made[chosen]] & ((nth - run) % 2 == 0))]
            symbols[chosen] = made[chosen]
            stay = ~finished
            stay[chosen + 1] = False
            now = (np.cumsum(stay) - 1)[chosen]
            symbols, segment, place, made = symbols[stay], segment[stay], place[stay], made[stay]
            changed = np.r_[now, now[now > 0] - 1]
            made[changed] = self._made(symbols, segment, changed)
        symbols, place = np.concatenate(out_symbols), np.concatenate(out_place)
        order = np.argsort(place)
        return symbols[order], word[place[order]]

    def _made(self, symbols: np.ndarray, segment: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The piece that the symbol at each place makes with the next one of its segment, or -1."""
        after = np.minimum(at + 1, len(symbols) - 1)
        joined = self._made_by(symbols[at], symbols[after])
        return np.where((after > at) & (segment[after] == segment[at]), joined, -1)

    def _with_bytes(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and each one's word, with the UTF-8 bytes of characters outside the vocabulary."""
        unknown = np.flatnonzero(symbols < 0)
        if not len(unknown):
            return symbols, word
        found, which = np.unique(-1 - symbols[unknown], return_inverse=True)
        coded = [chr(point).encode("utf-8", "surrogatepass") for point in found.tolist()]
        sizes = np.array(list(map(len, coded)))
        counts = np.ones(len(symbols), np.int64)
        counts[unknown] = sizes[which]
        ids, starts = np.repeat(symbols, counts), np.cumsum(counts) - counts
        table = np.zeros((len(coded), 4), np.int64)
        for i, code in enumerate(coded):
            table[i, : len(code)] = self.byte_ids[list(code)]
        for k in range(4):
            longer = sizes[which] > k
            ids[starts[unknown[longer]] + k] = table[which[longer], k]
        return ids, np.repeat(word, counts)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian bytes."""
        if not words:
            return []
        ids, word = self._with_bytes(*self.merged(words))
        whole = ids.astype("<u4").tobytes()
        ends = (4 * np.searchsorted(word, np.arange(len(words)), "right")).tolist()
        return [whole[begin:end] for begin, end in zip([0, *ends], ends)]

    def encode_bytes(self, texts: list[str], known: Kept) -> list[bytes]:
        """Per text the ids as little-endian unsigned 32-bit integers, begin and end included."""
        cut = [_WORD.findall(BLANK + text.replace(" ", BLANK)) if text else [] for text in texts]
        known.make_room()
        new = list({word for words in cut for word in words if word not in known})
        known.update(zip(new, self.encode_words(new)))
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        encoded = [b"".join([begin, *map(known.__getitem__, words), end]) for words in cut]
        known.settle(new)
        return encoded

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4").astype(np.int64) for ids in self.encode_bytes(texts, Kept())]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the pieces: control ids vanish, the blank before the first piece goes."""
        whole = b"".join(map(self._piece_bytes.__getitem__, ids.tolist()))
        return whole.removeprefix(b" ").decode("utf-8", "replace")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` (little-endian unsigned 32-bit, begin and end
    included) and ``decoded``.

    A NULL text counts as empty and has the begin and end ids only.  Texts are encoded whole.
    Repeated rows and NULL ids come out as they went in.  Other columns of ``docs`` are ignored whatever
    their names.  An empty table gives an empty result.  The model is read on the driver and sent to the
    tasks, so executors need no file.
    """
    vocabulary = Vocabulary.load(path)

    def in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Kept()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                texts = [text or "" for text in part.column("text").to_pylist()]
                encoded = vocabulary.encode_bytes(texts, known)
                decoded = [vocabulary.decode(np.frombuffer(ids, "<u4")) for ids in encoded]
                columns = [part.column("doc_id"), pa.array(encoded, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(in_batches, f"doc_id {kind}, ids binary, decoded string")


def digests(encoded: DataFrame, *more: Column) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded documents, then ``more``."""
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )
