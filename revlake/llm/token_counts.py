"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import bounded_batches

# The pattern by which a byte-level vocabulary splits text before its merges, and the
# letters and numbers that Unicode has got since version 16, which the library does not count as such.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 "
    "16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 "
    "1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
    "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
#: Words remembered by a worker, and the longest one that is.
MEMORY, MEMORY_LENGTH = 400_000, 40


def byte_letters() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def splitter() -> Callable[[str], list[str]]:
    """Splits text at the pattern, with letters and numbers as of Unicode 16."""
    later = "".join("-".join(rf"\U{int(c, 16):08x}" for c in part.split("-")) for part in LATER.split())
    strict = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{later}])")
    strict = strict.replace(r"\p{L}+", rf"(?:(?![{later}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{later}])\p{{N}})+")
    plain, rare, exact = regex.compile(PATTERN).findall, regex.compile(f"[{later}]").search, regex.compile(strict).findall
    return lambda text: plain(text) if text.isascii() or not rare(text) else exact(text)


class MergeCounter:
    """Counts the tokens of texts as the byte-level vocabulary in a tokenizers file makes them."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        self.symbol = [ids[letters[b]] for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[left] << 32 | ids[right], (rank, ids[left + right]))
        special = [t["content"] for t in spec["added_tokens"]]
        longest = sorted(special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest))) if special else None
        self.split = splitter()
        self.known: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Symbols left of one word: always the lowest-ranked adjacent pair is merged, leftmost first."""
        symbols = [self.symbol[b] for b in word.encode()]
        n = len(symbols)
        if n < 2:
            return n
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = symbols[i] << 32 | symbols[i + 1]
            if pair in merges:
                heap.append((merges[pair][0], i, pair))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or symbols[i] << 32 | symbols[j] != pair:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = merges[pair][1], -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (new := symbols[i] << 32 | symbols[k]) in merges:
                    heapq.heappush(heap, (merges[new][0], i, new))
            if (k := before[i]) >= 0 and (new := symbols[k] << 32 | symbols[i]) in merges:
                heapq.heappush(heap, (merges[new][0], k, new))
        return left

    def count(self, text: str) -> int:
        known, total = self.known, 0
        parts = self.special.split(text) if self.special else [text]
        for part in parts:
            for word in self.split(part):
                n = known.get(word)
                if n is None:
                    n = self.merged(word)
                    if len(word) <= MEMORY_LENGTH:
                        if len(known) >= MEMORY:
                            known.clear()
                        known[word] = n
                total += n
        return total + len(parts) - 1


@lru_cache(maxsize=2)
def _counter(vocabulary: bytes) -> MergeCounter:
    return MergeCounter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Number of tokens of every whole text, with no begin, end or added special tokens.

    ``vocabulary`` is a byte-level tokenizers file, read on the driver and sent along. Returns
    doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for each row. A null text
    counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows stay as they are; other columns
    are not read. A worker holds one Arrow batch of texts and a bounded memory of words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(shared.value).count
        for batch in batches:
            texts = batch.column(1)
            counts = pa.array([count(t.as_py() or "") for t in texts], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(2), counts], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "text", size.alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
