"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding is that of a merge model: symbols start as characters, the agenda holds every
adjacent pair whose join is a piece, and the best-scored pair (leftmost on ties) is
merged until the agenda is empty. With dropout, a candidate is skipped when a keyed
hash of (seed, document, place of the word, place of the pair) falls under the rate: each
occurrence of a word is drawn for itself. Nothing is drawn at random: the same text, id and
seed always give the same segmentation, on any executor and in batches of any size.

A piece never crosses into the next word, so words are independent. The words of a batch
go through the agenda together in array steps, each taking the best merge of every word
that has one; very long words go through a heap instead, in n log n steps. Texts longer than
``CHUNK`` characters are worked through in parts that end where words do.

Defined results for odd input: a null text counts as empty and has no pieces; a
character without a piece becomes byte pieces, and so does a literal U+2581, which
would otherwise decode as a space, so every text decodes losslessly; repeated rows get
equal segmentations; a null id counts as the text ``null`` in the keyed hash; an empty table
gives an empty result; candidates that tie in score go from left to right. Only id and
text are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.common import by_bytes, texts_of, tidied, vocabulary_file

DROPOUT, SEED = 0.1, 20_240_601
LONG_WORD, CHUNK = 96, 1 << 20
_LOADED: dict[tuple, Pieces] = {}
_MASK = 0xFFFFFFFFFFFFFFFF
_NONE = np.int64(1 << 62)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix_one(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def cuts(text: str) -> Iterator[tuple[int, int]]:
    """Parts of about CHUNK characters that end where a run of spaces begins."""
    at = 0
    while at < len(text):
        to = at + CHUNK
        while 0 < to < len(text) and not (text[to] == " " and text[to - 1] != " "):
            to = text.find(" ", to + 1)
        to = len(text) if to <= 0 or to > len(text) else to
        yield at, to
        at = to


class Pieces:
    """Tables of a merge model."""

    def __init__(self, path: str, seed: int, dropout: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.byte = np.full(256, -1, np.int32)
        self.spelled: list[bytes] = [b""] * size
        ids = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.spelled[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                ids[piece.replace("▁", " ")] = i
                self.spelled[i] = piece.replace("▁", " ").encode()
        if (self.byte < 0).any():
            raise ValueError("lossless decoding needs byte pieces")
        rank = {s: r for r, s in enumerate(sorted({-model.get_score(i) for i in ids.values()}))}
        merges = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    merges[a << 20 | b] = (rank[-model.get_score(i)], i)
        self.merges = merges
        self._hashed(merges)
        self.single = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        self.lens = np.fromiter(map(len, self.spelled), np.int64, size)
        self.first = np.cumsum(self.lens) - self.lens
        self.spelling = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.seed, self.rate = seed, int(dropout * 2**32)

    def _hashed(self, merges: dict) -> None:
        """An open-addressing table of the merges: pair, then rank and piece."""
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.pair = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.made = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int32)
        for key, (rank, piece) in merges.items():
            at = (key * 0x9E3779B97F4A7C15 & _MASK) >> (64 - self.bits)
            while self.pair[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.pair[at], self.rank[at], self.made[at] = key, rank, piece

    def _found(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where in the table the merge of each pair of pieces is, or -1."""
        key = a.astype(np.int64) << 20 | b
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.pair[at] == key, at, -1)
        open_ = np.flatnonzero((out < 0) & (self.pair[at] >= 0) & (a >= 0) & (b >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            now = self.pair[at[open_]]
            same = now == key[open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same & (now >= 0)]
        out[(a < 0) | (b < 0)] = -1
        return out

    # -- keys -------------------------------------------------------------

    def doc_key(self, doc: str) -> int:
        return xxhash.xxh64_intdigest(doc.encode("utf-8", "surrogatepass"), self.seed & _MASK)

    @staticmethod
    def word_key(doc_key: int, place: int) -> int:
        return _mix_one((doc_key + place * 0x9E3779B97F4A7C15) & _MASK)

    def _skipped(self, key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        place = start.astype(np.uint64) << np.uint64(42) ^ middle.astype(np.uint64) << np.uint64(21) ^ end.astype(np.uint64)
        return (_mix(key ^ place * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.int64) < self.rate

    def _skips(self, key: int, start: int, middle: int, end: int) -> bool:
        place = (start << 42 ^ middle << 21 ^ end) & _MASK
        return _mix_one(key ^ (place * 0xC2B2AE3D27D4EB4F & _MASK)) >> 32 < self.rate

    # -- one word ---------------------------------------------------------

    def by_agenda(self, word: str, key: int) -> list[int]:
        """The pieces of one word with its leading spaces, by the agenda itself."""
        symbols: list = [int(self.single[ord(c)]) for c in word]
        n = len(symbols)
        stop, before, agenda = [i + 1 for i in range(n)], [i - 1 for i in range(n)], []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and symbols[a] >= 0 and symbols[b] >= 0 and (m := self.merges.get(symbols[a] << 20 | symbols[b])):
                heapq.heappush(agenda, (m[0], a, b, stop[b], m[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, end, piece = heapq.heappop(agenda)
            if symbols[a] is None or symbols[b] is None or stop[a] != b or stop[b] != end:
                continue
            if self.rate and self._skips(key, a, b, end):
                continue
            symbols[a], symbols[b], stop[a] = piece, None, end
            if end < n:
                before[end] = a
            offer(before[a], a)
            offer(a, end)
        out = []
        for i, s in enumerate(symbols):
            if s is not None:
                out += [s] if s >= 0 else [int(self.byte[x]) for x in word[i].encode("utf-8", "surrogatepass")]
        return out

    # -- many words -------------------------------------------------------

    def by_rounds(self, code: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of many words, end to end, and how many each has; a character without a piece is -1 - its code.

        ``code`` has the characters of all words end to end, ``size`` their lengths and ``key`` their keys.
        A round merges the best pair of every word that has one.
        """
        sym = self.single[code]
        sym = np.where(sym < 0, -1 - code, sym).astype(np.int32)
        whole, first = size, np.cumsum(size) - size
        start = (np.arange(len(sym)) - np.repeat(first, size)).astype(np.int32)
        cost, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int32)
        live, pieces = np.arange(len(size)), np.zeros(len(size), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def price(at: np.ndarray, o: np.ndarray) -> None:
            """Rank and place of the merge of each of these symbols, of word o, with the next one; none where there is no merge or it is skipped."""
            cost[at] = _NONE
            stop = first[o] + size[o]
            inner = at + 1 < stop
            at, o, stop = at[inner], o[inner], stop[inner]
            found = self._found(sym[at], sym[at + 1])
            known = found >= 0
            at, o, stop, found = at[known], o[known], stop[known], found[known]
            if self.rate:
                after = at + 2
                end = np.where(after < stop, start[np.minimum(after, len(sym) - 1)], whole[o])
                known = ~self._skipped(key[o], start[at], start[at + 1], end)
                at, found = at[known], found[known]
            cost[at] = self.rank[found] << 20 | start[at]
            made[at] = self.made[found]

        price(np.arange(len(sym)), np.repeat(live, size))
        while len(live):
            best = np.minimum.reduceat(cost, first)
            going = best < _NONE
            if not going.all():
                rest = np.repeat(going, size)
                pieces[live[~going]] = size[~going]
                done.append((live[~going], sym[~rest]))
                sym, start, cost, made = sym[rest], start[rest], cost[rest], made[rest]
                live, key, whole, size, best = live[going], key[going], whole[going], size[going], best[going]
                if not len(live):
                    break
            where = np.flatnonzero(cost == np.repeat(best, size))
            sym[where] = made[where]
            rest = np.ones(len(sym), bool)
            rest[where + 1] = False
            o = np.arange(len(where))
            new = where - o  # one symbol of each word before has gone
            size = size - 1
            first = np.cumsum(size) - size
            sym, start, cost, made = sym[rest], start[rest], cost[rest], made[rest]
            inner = new > first
            price(np.concatenate([new, new[inner] - 1]), np.concatenate([o, o[inner]]))
        out, to = np.empty(int(pieces.sum()), np.int32), np.cumsum(pieces) - pieces
        for words, part in done:
            n = pieces[words]
            out[np.repeat(to[words] - (np.cumsum(n) - n), n) + np.arange(len(part))] = part
        return out, pieces

    def _spelled_out(self, sym: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of characters without a piece."""
        odd = np.flatnonzero(sym < 0)
        if not len(odd):
            return sym, pieces
        bytes_of = {c: self.byte[list(chr(-1 - c).encode("utf-8", "surrogatepass"))] for c in np.unique(sym[odd]).tolist()}
        n = np.ones(len(sym), np.int64)
        n[odd] = [len(bytes_of[c]) for c in sym[odd].tolist()]
        word = np.repeat(np.arange(len(pieces)), pieces)
        flat, to = np.repeat(sym, n), np.cumsum(n) - n
        for i, c in zip(to[odd].tolist(), sym[odd].tolist(), strict=True):
            flat[i : i + len(bytes_of[c])] = bytes_of[c]
        return flat, np.bincount(word, n, len(pieces)).astype(np.int64)

    def encode_parts(self, texts: list[str], keys: list[int], places: list[int]) -> tuple[list[np.ndarray], list[int]]:
        """Piece ids of each text, not empty and led by a space, whose first word is at that place of its document; and its number of words."""
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        doc_at = np.cumsum([0, *map(len, texts)])
        space = code == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[doc_at[:-1]] = True
        at = np.flatnonzero(begins)
        size = np.diff(np.append(at, len(code)))
        doc = np.searchsorted(doc_at, at, "right") - 1
        n_words = np.bincount(doc, minlength=len(texts))
        place = np.arange(len(at)) - np.repeat(np.cumsum(n_words) - n_words, n_words) + np.repeat(np.array(places, np.int64), n_words)
        key = _mix(np.array(keys, np.uint64)[doc] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        long = size > LONG_WORD
        usual = ~long
        sym, pieces = self.by_rounds(code[np.repeat(usual, size)] if long.any() else code, size[usual], key[usual])
        sym, pieces = self._spelled_out(sym, pieces)
        if long.any():
            n = np.zeros(len(at), np.int64)
            n[usual] = pieces
            found = {}
            for i in np.flatnonzero(long).tolist():
                word = code[at[i] : at[i] + size[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                found[i] = self.by_agenda(word, int(key[i]))
                n[i] = len(found[i])
            whole, to = np.empty(int(n.sum()), np.int32), np.cumsum(n) - n
            whole[np.repeat(usual, n)] = sym
            for i, ids in found.items():
                whole[to[i] : to[i] + len(ids)] = ids
            sym, pieces = whole, n
        ends = np.cumsum(np.bincount(doc, pieces, len(texts)).astype(np.int64))
        return np.split(sym, ends[:-1]), n_words.tolist()

    def encode(self, texts: list[str], ids: list[str]) -> list[np.ndarray]:
        """Piece ids of each text."""
        out = [np.zeros(0, np.int32)] * len(texts)
        some = [i for i, t in enumerate(texts) if 0 < len(t) <= CHUNK]
        if some:
            found, _ = self.encode_parts([" " + texts[i] for i in some], [self.doc_key(ids[i]) for i in some], [0] * len(some))
            for i, f in zip(some, found, strict=True):
                out[i] = f
        for i, t in enumerate(texts):
            if len(t) > CHUNK:
                parts, place = [], 0
                for a, b in cuts(t):
                    found, n = self.encode_parts([t[a:b] if a else " " + t[a:b]], [self.doc_key(ids[i])], [place])
                    parts += found
                    place += n[0]
                out[i] = np.concatenate(parts)
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The spelling of piece ids, with the leading space that encoding adds."""
        n = self.lens[ids]
        at = np.repeat(self.first[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.spelling[at].tobytes()

    def decode(self, ids) -> str:
        """The text of piece ids; the leading space that encoding adds is taken off."""
        raw = self.decode_bytes(np.asarray(ids, np.int64))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def pieces(vocabulary: str, seed: int = SEED, dropout: float = DROPOUT) -> Pieces:
    key = (vocabulary, seed, dropout)
    if key not in _LOADED:
        _LOADED[key] = Pieces(vocabulary_file(vocabulary), seed, dropout)
    return _LOADED[key]


def encode(
    docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", seed: int = SEED, dropout: float = DROPOUT, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), lossless (decoding gives the text back) and, on request, ids."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = [kept.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())]
    schema += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(vocabulary, seed, dropout)
        for batch in by_bytes(batches, "text", 1 << 19):
            texts = texts_of(batch, "text")
            found = model.encode(texts, ["null" if i is None else str(i) for i in batch.column(0).to_pylist()])
            columns = [
                batch.column(0), pa.array(map(len, found), pa.int64()), pa.array([hashlib.sha256(f.astype("<u4").tobytes()).hexdigest() for f in found], pa.string()),
                pa.array([model.decode_bytes(f) == (b" " + t.encode() if t else b"") for f, t in zip(found, texts, strict=True)], pa.bool_()),
            ]
            columns += [pa.array(found, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return kept.mapInArrow(tidied(run), T.StructType(schema))


def decode(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and the text of ``ids``; null ids give a null text."""
    kept = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(vocabulary)
        for batch in batches:
            found = [None if i is None else model.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return kept.mapInArrow(tidied(run), T.StructType([kept.schema["doc_id"], T.StructField("text", T.StringType())]))
