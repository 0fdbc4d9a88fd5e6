"""SentencePiece encoding and decoding by vectorised merge rounds.

All new words of a batch lie in one flat symbol array. In each round every word merges its
best-ranked pair wherever it occurs, leftmost first; the array is then compacted, and finished words
leave it, until no pair of two symbols forms a piece.
"""

from __future__ import annotations


import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import bounded_batches

SPACE = "▁"  # the visible space of the vocabulary
#: Words remembered by a worker, and the longest one that is.
MEMORY, MEMORY_LENGTH = 400_000, 40
#: Words are merged together up to so many symbols.
ROUND_SYMBOLS = 1 << 19
#: Longer words (text without spaces) would need as many rounds as they have pieces; a heap serves them.
LONG_WORD = 3000
NONE = np.int64(1) << 40
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Encoder and decoder of a merge model with byte fallback, as the model file states it.

    Only models without text normalisation rules are read, with a space put in front of a text and
    spaces kept; others are refused. No piece may hold a space after another character, so that
    words (spaces and what follows them) merge apart from each other.
    """

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        if lib.decode(lib.encode(" a  ﬁ ")) != " a  ﬁ ":
            raise ValueError("the model changes texts before it encodes them")
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        plain = {
            p: i for i, p in enumerate(names)
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))
        }
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("the model has pieces over word borders")
        score = np.array([lib.get_score(i) for i in range(len(names))])
        rank = np.unique(-score, return_inverse=True)[1]  # equal scores are equal ranks
        self.char = np.full(0x110000, -1, np.int32)  # id by code point
        for p, i in plain.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.byte = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        pairs = sorted(
            (plain[p[:k]] << 32 | plain[p[k:]], i)
            for p, i in plain.items() for k in range(1, len(p))
            if p[:k] in plain and p[k:] in plain
        )
        self.pair = np.array([k for k, _ in pairs] + [NONE << 20], np.int64)
        self.result = np.array([i for _, i in pairs] + [0], np.int64)
        self.rank = np.r_[rank[self.result[:-1]].astype(np.int64), NONE]
        self._place_pairs()
        self.bytes = [b"" if lib.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.bytes[lib.unk_id()] = " ⁇ ".encode()
        self.control = {i for i in range(len(names)) if lib.is_control(i)}
        self.spaced = {i for p, i in plain.items() if p.startswith(SPACE)}
        self.value = {i: b for b, i in enumerate(self.byte.tolist())}
        whole = list(self.bytes)
        for i, b in self.value.items():
            whole[i] = bytes([b])
        self.table = pa.array(whole + [b[i in self.spaced :] for i, b in enumerate(whole)], pa.binary())
        self.is_spaced, self.is_control = np.zeros((2, len(names)), bool)
        self.is_spaced[list(self.spaced)] = True
        self.is_control[list(self.control)] = True
        self.words = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+").findall
        self.known: dict[str, bytes] = {}

    def _place_pairs(self) -> None:
        """A table of hashed pairs with linear probing, an eighth full at most; a free slot names the last pair, which is none."""
        n = len(self.pair) - 1
        bits = max(8, (8 * n).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot = np.full((1 << bits) + n, n, np.int32)
        left, at = np.arange(n), self._hash(self.pair[:-1])
        while len(left):
            free = np.flatnonzero(self.slot[at] == n)
            where, first = np.unique(at[free], return_index=True)
            self.slot[where] = left[free[first]]
            late = self.slot[at] != left
            left, at = left[late], at[late] + 1

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _SPREAD) >> self.shift).view(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE where it is no piece) and its place in the table."""
        key = left << 32 | right
        slot = self._hash(key)
        at = self.slot[slot]
        none = len(self.pair) - 1
        look = np.flatnonzero((self.pair[at] != key) & (at != none))
        while len(look):
            slot[look] += 1
            at[look] = found = self.slot[slot[look]]
            look = look[(self.pair[found] != key[look]) & (found != none)]
        return self.rank[at], at

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and word numbers (ascending) once no pair is left."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols) > 1:
            rank, at = self._ranks(symbols[:-1], symbols[1:])
            rank[word[:-1] != word[1:]] = NONE
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            best = np.minimum.reduceat(np.r_[rank, NONE], first)  # a word's last entry is NONE
            live = np.repeat(best < NONE, size)
            if not live.all():
                done.append((symbols[~live], word[~live]))
                if not live.any():
                    symbols = symbols[:0]
                    break
            hit = np.flatnonzero((rank == np.repeat(best, size)[:-1]) & live[:-1])
            # of pairs that overlap, the first, third, ... of a row of them
            row = np.flatnonzero(np.r_[True, np.diff(hit) > 1])
            hit = hit[(np.arange(len(hit)) - np.repeat(row, np.diff(np.r_[row, len(hit)]))) % 2 == 0]
            hit = self._until_better(symbols, word, rank, hit, self.result[at[hit]])
            symbols = symbols.copy()
            symbols[hit] = self.result[at[hit]]
            live[hit + 1] = False
            symbols, word = symbols[live], word[live]
        done.append((symbols, word[: len(symbols)]))
        word = np.concatenate([w for _, w in done])
        order = np.argsort(word, kind="stable")
        return np.concatenate([s for s, _ in done])[order], word[order]

    def _until_better(self, symbols, word, rank, hit, made):
        """Merges of one round: in each word up to the first that makes a pair as good as the round's or better."""
        new = np.full(len(hit), NONE)
        left = (hit > 0) & (word[hit - 1] == word[hit])
        new[left] = self._ranks(symbols[hit[left] - 1], made[left])[0]
        # the left neighbour may itself have been merged in this round
        beside = np.r_[False, (hit[1:] - hit[:-1] == 2) & (word[hit[1:]] == word[hit[:-1]])]
        pair = np.flatnonzero(beside)
        new[pair] = np.minimum(new[pair], self._ranks(made[pair - 1], made[pair])[0])
        right = np.minimum(hit + 2, len(symbols) - 1)
        inside = (hit + 2 < len(symbols)) & (word[right] == word[hit])
        new[inside] = np.minimum(new[inside], self._ranks(made[inside], symbols[right[inside]])[0])
        stop = new <= rank[hit]
        if not stop.any():
            return hit
        owner = word[hit]
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        seen = np.cumsum(stop) - stop  # stops before this merge
        return hit[seen == np.repeat(seen[start], np.diff(np.r_[start, len(hit)]))]

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same merges for one very long word, each found through a heap."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(at: np.ndarray) -> None:
            at = at[at >= 0]
            right = np.array([after[i] for i in at], np.int64)
            at, right = at[right < n], right[right < n]
            if len(at):
                value = np.array(symbols, np.int64) if len(at) > 2 else None
                a = value[at] if value is not None else np.array([symbols[i] for i in at], np.int64)
                b = value[right] if value is not None else np.array([symbols[i] for i in right], np.int64)
                rank, place = self._ranks(a, b)
                for r, i, x, y, k in zip(rank.tolist(), at.tolist(), a.tolist(), b.tolist(), self.result[place].tolist()):
                    if r < NONE:
                        heapq.heappush(heap, (r, i, x << 32 | y, k))

        offer(np.arange(n - 1))
        while heap:
            _, i, pair, made = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] < 0 or symbols[i] << 32 | symbols[j] != pair:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            offer(np.array([before[i], i]))
        return [i for i in symbols if i >= 0]

    def _symbols(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all characters of words, or of their bytes where a character has none, and word numbers."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        flat = self.char[code]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        odd = np.flatnonzero(flat < 0)
        if len(odd):
            raw = [chr(c).encode() for c in code[odd].tolist()]
            times = np.ones(len(flat), np.int64)
            times[odd] = [len(b) for b in raw]
            flat, word = np.repeat(flat, times), np.repeat(word, times)
            flat[flat < 0] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return flat.astype(np.int64), word

    def learn(self, words: Sequence[str]) -> list[bytes]:
        """Ids of words by merge rounds, as bytes of 32-bit numbers."""
        out: list[bytes] = []
        lo = 0
        while lo < len(words):
            hi, total = lo, 0
            while hi < len(words) and (hi == lo or total + len(words[hi]) <= ROUND_SYMBOLS):
                total += len(words[hi])
                hi += 1
            flat, word = self._symbols(words[lo:hi])
            size = np.bincount(word, minlength=hi - lo)
            long: dict[int, list[int]] = {}
            if size.max() > LONG_WORD:
                start = np.cumsum(size) - size
                for n in np.flatnonzero(size > LONG_WORD).tolist():
                    long[n] = self.merge_long(flat[start[n] : start[n] + size[n]].tolist())
                short = np.repeat(size <= LONG_WORD, size)
                flat, word = flat[short], word[short]
            ids, word = self.merge(flat, word)
            cut = (4 * np.cumsum(np.bincount(word, minlength=hi - lo))).tolist()
            packed = ids.astype(np.int32).tobytes()
            made = [packed[a:b] for a, b in zip([0, *cut[:-1]], cut)]
            for n, own in long.items():
                made[n] = np.array(own, np.int32).tobytes()
            out += made
            lo = hi
        return out

    def encode_arrays(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after another, and where each text's begin; an empty text has none."""
        split = [self.words((" " + t).replace(" ", SPACE)) if t else [] for t in texts]
        seen = set().union(*split)
        fresh = list(seen.difference(self.known))
        self.known.update(zip(fresh, self.learn(fresh)))
        ids_of = self.known.__getitem__
        rows = [b"".join(map(ids_of, words)) for words in split]
        if len(self.known) > MEMORY:  # the words of this batch stay
            self.known = {w: self.known[w] for w in seen} if 2 * len(seen) <= MEMORY else {}
        for w in fresh:
            if len(w) > MEMORY_LENGTH:
                self.known.pop(w, None)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        return np.frombuffer(b"".join(rows), np.int32), np.r_[0, np.cumsum(sizes)]

    def encode_batch(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of whole texts; an empty text has none."""
        ids, at = self.encode_arrays(texts)
        return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]

    def decode_arrays(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """Texts of ids that lie as ``encode_arrays`` returns them."""
        if not self.is_control[ids].any():
            first = at[:-1][at[1:] > at[:-1]]
            place = ids.copy()
            place[first] += np.where(self.is_spaced[ids[first]], len(self.bytes), 0).astype(np.int32)  # without its space
            parts = pa.ListArray.from_arrays(pa.array(at, pa.int32()), self.table.take(pa.array(place)))
            try:  # bytes beside whole characters are characters if the text is one
                return pc.binary_join(parts, b"").cast(pa.string())
            except pa.ArrowInvalid:
                pass
        return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:])], pa.string())

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: pieces joined, bytes put together, the space set in front taken away."""
        table, value = self.bytes, self.value
        out: list[bytes] = []
        run = bytearray()
        for i in ids:
            b = value.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_characters(run))
                run = bytearray()
            out.append(table[i])
        if run:
            out.append(_characters(run))
        whole = b"".join(out)
        first = next((i for i in ids if i not in self.control), None)
        return whole[first in self.spaced :].decode()


def _characters(run: bytearray) -> bytes:
    """Bytes of a run as characters; each byte that is part of none becomes U+FFFD."""
    try:
        run.decode()
        return bytes(run)
    except UnicodeDecodeError:
        pass
    out, i = "", 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out += run[i : i + n].decode()
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out += "�"
            i += 1
    return out.encode()


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def encode_and_decode(docs: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """Encode every whole text, decode the ids again: ``key``, ids (array of int), decoded (string).

    No begin or end ids, no sampling. A null text counts as empty: no ids, an empty decoded text. Null
    keys and repeated rows stay as they are, other columns are not read. ``model`` is read on the
    driver and sent along. A worker holds one Arrow batch of texts and a bounded memory of words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for batch in batches:
            ids, at = pieces.encode_arrays([t or "" for t in batch.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
            columns = [batch.column(0), lists, pieces.decode_arrays(ids, at)]
            yield pa.record_batch(columns, [key, "ids", "decoded"])

    rows = docs.select(key, "text")
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    rows = encode_and_decode(docs, model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
