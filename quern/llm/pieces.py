"""SentencePiece encoding (BPE models) and decoding by suffix-array matching.

A text is encoded with a space put before it, and no piece of such a model goes on after a space that follows other
characters, so the text falls into segments (spaces and the characters up to the next space) that are encoded
alone.  Each task keeps the segments it has met; for the new ones of a slice

1. their bytes are joined to one text, and its suffixes are sorted as deep as the longest piece;
2. every piece of the vocabulary is searched in the sorted suffixes, and its range gives all its occurrences;
3. the occurrences are the edges (start, length, piece), sorted by position into a table;
4. edges are relaxed in the order that the model's scores prescribe: in each round every segment applies its best
   edge (score, then leftmost) that joins two neighbouring symbols, until none is left.

The memo tells segments apart by 128-bit hashes.  A segment longer than a chunk is cut where no piece spans two characters,
which changes nothing; only one without any such place (such as one repeated letter) is matched whole, with some 140 bytes
of memory a byte.  Characters that no piece covers become byte pieces.  Ids equal those of the sentencepiece library.

Nulls and edge cases: null and empty texts have no ids and decode to the empty text.  U+2581 stands for a space in such
models and decodes to one, as in the library.  Other columns pass through; columns named like results are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import text as tx

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of new segments matched at once, segments a task remembers, and symbols from which a heap is used.
CHUNK, REMEMBERED, LONG = 1 << 17, 1 << 19, 48
#: Bytes of text encoded at once and ids decoded at once (or those of one longer text).
SLICE, STEP = 1 << 20, 1 << 17


@dataclass
class Vocabulary:
    """Pieces that merging can give, as bytes with a space for U+2581; byte pieces by value; all pieces for decoding."""

    pieces: list[bytes]
    ids: np.ndarray
    rank: np.ndarray
    by_byte: np.ndarray
    surface: list[bytes]
    unknown: int

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, ids, scores, surface, by_byte = [], [], [], [], np.full(256, sp.unk_id())
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            raw = name.replace("▁", " ").encode()
            if sp.is_byte(i):
                by_byte[int(name[3:5], 16)] = i
                surface.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                surface.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                surface.append(raw)
                if not sp.is_unused(i):
                    pieces.append(raw)
                    ids.append(i)
                    scores.append(sp.get_score(i))
        _, place = np.unique(-np.array(scores), return_inverse=True)
        order = sorted(range(len(pieces)), key=pieces.__getitem__)
        return cls([pieces[i] for i in order], np.array(ids)[order], place[order], by_byte, surface, sp.unk_id())


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.depth = -(-max(map(len, vocabulary.pieces)) // 8) * 8
        width = f"S{self.depth}"
        self.low = np.array(vocabulary.pieces, width)
        self.high = np.array([p + b"\xff" * (self.depth - len(p)) for p in vocabulary.pieces], width)
        self.length = np.array([len(p) for p in vocabulary.pieces])
        self.known, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _table(self, text: np.ndarray) -> np.ndarray:
        """piece + 1 (index in the sorted vocabulary) at [position, length], 0 where no piece lies."""
        n = len(text)
        padded = np.concatenate((text, np.zeros(self.depth, np.uint8)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.depth)[:n]
        keys = np.ascontiguousarray(windows).view(">u8").T.astype(np.uint64)
        order = np.argsort(keys[0])
        equal = keys[0][order][1:] == keys[0][order][:-1]
        tied = np.flatnonzero(np.concatenate(([False], equal)) | np.concatenate((equal, [False])))
        some = order[tied]
        order[tied] = some[np.lexsort((*keys[:0:-1, some], keys[0][some]))]
        ranked = np.ascontiguousarray(windows[order]).view(f"S{self.depth}").ravel()
        lo, hi = np.searchsorted(ranked, self.low, "left"), np.searchsorted(ranked, self.high, "right")
        times = hi - lo
        piece = np.repeat(np.arange(len(times)), times)
        at = order[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - lo, times)]
        table = np.zeros((n + 1, self.depth + 1), np.int32)
        table[at, self.length[piece]] = piece + 1
        return table

    def _encode(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after the other, and where each segment's ids start (one more at the end)."""
        table = self._table(text)
        head = (text & 0xC0) != 0x80
        head[first[:-1]] = True
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(text))
        seg = np.searchsorted(first, start, "right") - 1
        count = np.bincount(seg, minlength=len(first) - 1)
        long = np.flatnonzero(count > LONG)
        bounds = [self._by_heap(table, start[seg == s], int(first[s + 1])) for s in long]
        quick = ~np.isin(seg, long)
        kept_s, kept_e = [np.concatenate([b[0] for b in bounds])] if bounds else [], [np.concatenate([b[1] for b in bounds])] if bounds else []
        s, e, g = start[quick], end[quick], seg[quick]
        rank = np.append(self.v.rank, np.iinfo(np.int32).max)  # the last entry is for "no piece"
        worst = rank[-1]

        def price(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            n = b - a
            return np.where(n <= self.depth, rank[table[a, np.minimum(n, self.depth)] - 1], worst)

        while len(s):
            joined = np.full(len(s), worst)
            ok = np.flatnonzero(g[1:] == g[:-1])
            joined[ok] = price(s[ok], e[ok + 1])
            at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            best = np.minimum.reduceat(joined, at)
            size = np.diff(np.append(at, len(g)))
            done = np.repeat(best == worst, size)
            kept_s.append(s[done])
            kept_e.append(e[done])
            hit = np.flatnonzero((joined == np.repeat(best, size)) & ~done)
            hit = hit[np.concatenate(([True], g[hit][1:] != g[hit][:-1]))] if len(hit) else hit
            e = e.copy()
            e[hit] = e[hit + 1]
            live = ~done
            live[hit + 1] = False
            s, e, g = s[live], e[live], g[live]
        s, e = np.concatenate(kept_s), np.concatenate(kept_e)
        order = np.argsort(s, kind="stable")
        s, e = s[order], e[order]
        n = e - s
        piece = np.where(n <= self.depth, table[s, np.minimum(n, self.depth)], 0)
        whole = piece > 0
        width = np.where(whole, 1, n)
        at = np.cumsum(width) - width
        ids = np.empty(int(width.sum()), np.int32)
        ids[at[whole]] = self.v.ids[piece[whole] - 1]
        for k in range(4):
            more = ~whole & (n > k)
            ids[at[more] + k] = self.v.by_byte[text[s[more] + k]]
        return ids, np.append(at, len(ids))[np.searchsorted(s, first)]

    def _by_heap(self, table: np.ndarray, start: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """The same relaxation for one long segment, with a heap and links instead of rounds."""
        begin = start.tolist()
        n = len(begin)
        end = [*begin[1:], stop]
        after, before, alive = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and end[j] - begin[i] <= self.depth and (p := table[begin[i], end[j] - begin[i]]):
                heapq.heappush(heap, (int(self.v.rank[p - 1]), begin[i], i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, _, i, stop_at = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or end[j] != stop_at:
                continue
            end[i], after[i], alive[j] = end[j], after[j], False
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        keep = [i for i in range(n) if alive[i]]
        return np.array([begin[i] for i in keep]), np.array([end[i] for i in keep])

    def _cuts(self, text: np.ndarray) -> list[int]:
        """Where a long segment may be cut: between characters that no piece spans, so nothing merges across."""
        cuts, at = [0], 0
        while len(text) - at > CHUNK:
            window = text[at : at + CHUNK]
            start, length = np.nonzero(self._table(window))
            spans = np.zeros(len(window) + 1, np.int64)
            np.add.at(spans, start + 1, 1)
            np.add.at(spans, start + length, -1)
            free = np.flatnonzero((np.cumsum(spans)[:-1] == 0) & ((window & 0xC0) != 0x80))
            free = free[(free > 0) & (free <= len(window) - self.depth)]
            if not len(free):
                break
            at += int(free[-1])
            cuts.append(at)
        return cuts

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.check, self.start, self.flat = self.known[:0], self.check[:0], self.start[:1], self.flat[:0]
        count = np.ones(len(start), np.int64)
        for i in np.flatnonzero(end - start > CHUNK)[::-1].tolist():
            cuts = np.array(self._cuts(data[start[i] : end[i]])) + start[i]
            count[i] = len(cuts)
            start, end = np.concatenate((start[:i], cuts, start[i + 1 :])), np.concatenate((end[:i], cuts[1:], end[i:]))
        ids, lengths = [self.flat], []
        size = np.cumsum(end - start)
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + CHUNK, "right")))
            n = end[a:b] - start[a:b]
            first = np.concatenate(([0], np.cumsum(n)))
            text = data[np.arange(first[-1]) + np.repeat(start[a:b] - first[:-1], n)]
            # a separator that no piece has keeps suffixes from running on into the next segment
            spaced = np.full(first[-1] + len(n), 0xFF, np.uint8)
            shift = np.repeat(np.arange(len(n)), n)
            spaced[np.arange(first[-1]) + shift] = text
            got, where = self._encode(spaced, np.append(first[:-1] + np.arange(len(n)), len(spaced)))
            # the separator's own id ends each segment
            keep = np.ones(len(got), bool)
            keep[where[1:] - 1] = False
            ids.append(got[keep])
            lengths.append(np.diff(where) - 1)
            a = b
        learned = np.add.reduceat(np.concatenate(lengths), np.cumsum(count) - count)
        order = np.argsort(np.concatenate((self.known, hashes)), kind="stable")
        flat, length = np.concatenate(ids), np.concatenate((np.diff(self.start), learned))
        begin = np.cumsum(length) - length
        self.known, self.check = np.concatenate((self.known, hashes))[order], np.concatenate((self.check, checks))[order]
        self.flat = flat[_spread(begin[order], length[order])]
        self.start = np.concatenate(([0], np.cumsum(length[order])))

    def _agree(self, hashes: np.ndarray, checks: np.ndarray, distinct: np.ndarray, where: np.ndarray) -> bool:
        """Whether equal hashes come with equal second hashes, here and in the memo."""
        if not len(hashes):
            return True
        if (checks != checks[where][np.searchsorted(distinct, hashes)]).any():
            return False
        place = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        met = self.known[place] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        return not (self.check[place[met]] != checks[where][met]).any()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their offsets for a slice of texts given as bytes."""
        full, size = np.diff(offsets) > 0, np.diff(offsets)
        shift = np.cumsum(full)
        text = np.full(len(data) + int(full.sum()), 32, np.uint8)
        text[np.arange(len(data)) + np.repeat(shift, size)] = data
        begin = np.concatenate(([0], offsets[1:] + shift))
        head = text == 32
        head[1:] &= text[:-1] != 32
        head[begin[:-1][full]] = True
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(text))
        hashes, checks = tx.span_hashes2(text, start, end)
        distinct, where = np.unique(hashes, return_index=True)
        if not self._agree(hashes, checks, distinct, where):
            # two different segments share a hash: the memo is left aside for this slice
            memo, self.known, self.check, self.start, self.flat = (self.known, self.check, self.start, self.flat), self.known[:0], self.check[:0], self.start[:1], self.flat[:0]
            self._learn(text, start, end, np.arange(len(start)).astype(np.uint64), checks)
            length = np.diff(self.start)
            found = self.flat, np.concatenate(([0], np.cumsum(length)))[np.searchsorted(start, begin)]
            self.known, self.check, self.start, self.flat = memo
            return found
        fresh = ~np.isin(distinct, self.known, assume_unique=True)
        if len(self.known) > REMEMBERED:
            fresh[:] = True
        if fresh.any():
            self._learn(text, start[where[fresh]], end[where[fresh]], distinct[fresh], checks[where[fresh]])
        at = np.searchsorted(self.known, hashes)
        length = self.start[at + 1] - self.start[at] if len(at) else np.zeros(0, np.int64)
        upto = np.concatenate(([0], np.cumsum(length)))
        return self.flat[_spread(self.start[at], length)] if len(at) else np.zeros(0, np.int32), upto[np.searchsorted(start, begin)]


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)


class Decoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.length = np.array([len(s) for s in vocabulary.surface])
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(vocabulary.surface), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        length = self.length[ids]
        raw = self.flat[_spread(self.begin[ids], length)].tobytes()
        at = np.concatenate(([0], np.cumsum(length)))[offsets]
        out = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return [(t[1:] if t[:1] == b" " else t).decode(errors="replace") for t in out]


def encoded(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """All columns of docs with ids (array of int) and n_pieces."""
    docs = docs.drop("ids", "n_pieces")
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            plain = batch.column(text_col)
            if pc.any(pc.match_substring(plain, "▁")).as_py():
                plain = pc.replace_substring(plain, "▁", " ")
            for at, to, data, offsets in tx.slices(pa.RecordBatch.from_arrays([plain], ["text"]), "text", SLICE):
                ids, where = encoder.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, to - at) for c in names), lists, pa.array(np.diff(where))], [*names, "ids", "n_pieces"])

    return docs.mapInArrow(encode, schema)


def decoded(docs: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """All columns of docs with decoded, the text of ids."""
    docs = docs.drop("decoded")
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    schema = T.StructType([*docs.schema.fields, T.StructField("decoded", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary.value)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(sizes)))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + STEP, "right")) - 1)
                part = batch.slice(at, to - at)
                flat = part.column(ids_col).flatten().to_numpy(zero_copy_only=False)
                texts = decoder.decode(flat, upto[at : to + 1] - upto[at])
                at = to
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return docs.mapInArrow(decode, schema)
