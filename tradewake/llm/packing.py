"""Packing of tokenised documents into sequences: shortest pack first over the length histogram.

A document's ids (those of its text, then an end id) are cut into full sequences and a
rest. Only the histogram of piece lengths, which has at most ``size`` rows, reaches the
driver. There the lengths are placed longest first; each goes into the pack that holds
least so far, many equal packs at a time. A placement is a run of packs, so the plan is a
list of (length, first rank, count, first pack, offset). Every piece then looks up
the run its rank falls in. Ranks are counted in small chunks of a length, so a length that
a third of all documents share is spread over tasks.

Defined cases: a null or empty text is the end id alone; equal rows are packed once each;
no documents, no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewake.llm.common import small_batches, table, texts
from tradewake.session import cut_lineage

SIZE = 4096
END_ID = 2
# Rows of one length that are ranked together.
CHUNK_ROWS = 256
# Words remembered by a Python worker.
MEMORY = 500_000

Run = tuple[int, int, int, int, int]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others for the letters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class WordTokens:
    """Ids of texts as little-endian bytes, remembered per white-space separated word and per part of a word.

    No token of this vocabulary kind crosses white space, so the ids of a text are those
    of its words in order. Words of Latin letters are lower-cased and split here the way
    the vocabulary file states and only their parts are asked for; other words, and texts
    that may spell a special token, go to the tokenizer whole.
    """

    # Fixed value: the split pattern of the vocabulary file.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # Below this letter text is in composed form and lower-cases letter by letter.
    SIMPLE = "\u0250"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(self.PARTS).findall
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _ask(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        value = self.parts.get(part)
        if value is None:
            found = self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
            value = array("I", [t.id for t in found]).tobytes()
            if len(self.parts) >= MEMORY:
                self.parts.clear()
            self.parts[part] = value
        return value

    def _word(self, word: bytes) -> bytes:
        if len(word) > 64:
            return self._ask(word)
        text = word.decode("utf-8", "replace")
        value = b"".join(map(self._part, self.split(text.lower()))) if max(text) < self.SIMPLE else self._ask(word)
        if len(self.known) >= MEMORY:
            self.known.clear()
        self.known[word] = value
        return value

    def ids(self, text: bytes) -> bytes:
        if b"<|" in text:
            return self._ask(text)
        words, known = text.split(), self.known
        found = list(map(known.get, words))
        if None in found:
            found = [known.get(w) or self._word(w) if v is None else v for w, v in zip(words, found)]
        return b"".join(found)


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per Python worker process, used again by later tasks."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    path = path or vocabulary_path()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = word_tokens(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = tokens.ids(text) + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total) + ((part,) if keep_ids else ()))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    small_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(cut, schema)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[Run]:
    """Runs (length, first rank, count, first pack, offset) that place every piece of the histogram.

    Packs of equal fill are kept as ranges of pack numbers; ``fills`` yields the least filled.
    """
    runs: list[Run] = []
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
    fills: list[int] = []
    packs = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if fills and fills[0] + length <= size:
                fill = fills[0]
                first, count = ranges[fill].pop()
                taken = min(count, left)
                if taken < count:
                    ranges[fill].append((first + taken, count - taken))
                if not ranges[fill]:
                    heapq.heappop(fills)
            else:
                fill, first, taken = 0, packs, left
                packs += left
            runs.append((length, rank, taken, first, fill))
            if fill + length < size:
                if not ranges[fill + length]:
                    heapq.heappush(fills, fill + length)
                ranges[fill + length].append((first, taken))
            rank, left = rank + taken, left - taken
    return runs


def ranked(cut: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds rank, a number from 0 among the pieces of equal length, without gathering a length in one task."""
    spark = cut.sparkSession
    # At most one row per possible length.
    chunks = spark.createDataFrame([(n, -(-c // CHUNK_ROWS)) for n, c in histogram.items()], "length long, chunks long")
    dealt = cut.join(F.broadcast(chunks), "length").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("chunks"))).drop("chunks")
    sizes = dealt.groupBy("length", "chunk").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(sizes.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32")
    numbered = dealt.withColumn("place", F.row_number().over(within))
    return numbered.join(offsets, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("place") - 1).drop("chunk", "place", "before")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there."""
    spark = docs.sparkSession
    cut = cut_lineage(pieces(docs, path, size, keep_ids))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(sorted(plan(histogram, size)) or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(runs)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = shared.value
        # Length and rank in one sortable number.
        keys = (runs[:, 0] << 40) + runs[:, 1]
        for batch in batches:
            rank = batch.pop("rank").to_numpy()
            at = np.searchsorted(keys, (batch["length"].to_numpy() << 40) + rank, side="right") - 1
            batch["sequence_id"] = runs[at, 3] + rank - runs[at, 1]
            batch["offset"] = runs[at, 4]
            yield batch.astype({"doc_id": "Int64"})

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names) + ", sequence_id long, offset long"
    return ranked(cut, histogram).select(*names, "rank").mapInPandas(place, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
