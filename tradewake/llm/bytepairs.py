"""Byte-level BPE encoding and decoding with higher-order functions over a literal rank map.

A text is cut into words by the vocabulary's pattern. A word is a list of byte pieces; a fold over at most as many steps as it has
bytes merges, in each step, the adjacent pair of lowest rank wherever it stands, until no pair has a rank. Merges of one
rank can be done together: a piece that a merge makes has a later rank than the merge itself. Every piece of such a vocabulary
comes from exactly one pair of others, so the rank map has one entry per piece, keyed by its pair. It is stored as a table whose rows, one per left
piece, are shifted until they fit between each other: a lookup is two reads of an array.

The ``FREQUENT`` commonest distinct words of a sample of ``SAMPLE`` documents are folded once and their ids, like the rank map, go into the plan
as literals of a fixed size. All other words go through the same fold where they stand. So the documents are read once and never shuffled,
and both bounds change the speed only, not the result. Decoding looks up the piece of each id and joins the bytes.

All is column expressions; the driver meets the vocabulary and the table of frequent words.

Defined cases: a null text counts as empty; an empty text has no ids; texts and words may have any length; equal rows give equal rows;
no documents, no rows; other columns are ignored. An id without a piece decodes to nothing.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm.common import table, texts
from tradewake.session import cut_lineage

# Distinct words whose ids are kept in the plan, and the documents they are counted in.
FREQUENT = 3 * 2**16
SAMPLE = 20_000
# Lists that the words are dealt into; a lookup reads one of them.
WORD_LISTS = 2**16
# Bits of an id in the table of pairs.
BITS = 20
NO_RANK = 2**BITS
# Marks before a word and before its ids in a list; words that hold one of them aren't put there. JSON doesn't escape them.
WORD, IDS = "\x7f", "\x80"
# Characters of a plan that Spark keeps as text for its listeners; literals of several MB would fill the driver.
PLAN_TEXT = "100000"

# Letters and numbers of Unicode 14 to 16, which the regular expressions of Java 17 don't know as such.
LATER_LETTERS = (
    "0870-0887 0889-088E 08B5 08C8-08C9 0C5D 0CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 "
    "10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA "
    "10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 "
    "11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF "
    "1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 "
    "1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
LATER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def vocabulary_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def java_pattern(pattern: str) -> str:
    """The pattern with its classes spelt out: Java's white space is ASCII only, and its letters and numbers are older."""

    def later(ranges: str) -> str:
        spans = [f"\\x{{{a}}}" + (f"-\\x{{{b}}}" if b else "") for a, _, b in (r.partition("-") for r in ranges.split())]
        # The wide range comes first, so that common characters are refused by one test.
        return "[\\x{870}-\\x{323AF}&&[" + "".join(spans) + "]]"

    letters, numbers = r"\p{L}" + later(LATER_LETTERS), r"\p{N}" + later(LATER_NUMBERS)
    out, at, inside = [], 0, False
    while at < len(pattern):
        three, two = pattern[at : at + 5], pattern[at : at + 2]
        if three in (r"\p{L}", r"\p{N}"):
            chars, width = (letters if three == r"\p{L}" else numbers), 5
            out.append(chars if inside else f"[{chars}]")
        elif two in (r"\s", r"\S"):
            width = 2
            out.append(r"\p{IsWhite_Space}" if two == r"\s" else r"\P{IsWhite_Space}")
        else:
            width = 1
            inside = {"[": True, "]": False}.get(pattern[at], inside)
            out.append(pattern[at])
        at += width
    return "".join(out)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value more than once and computes it once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def choose(condition: Column, yes: Column, no: Column) -> Column:
    """One of two values; Spark interprets ``if`` faster than ``case``."""
    return F.call_function("if", condition, yes, no)


def literal(value: list, kind: str) -> Column:
    """A list as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The pair of ranks that each piece of more than one byte is merged from."""
    found = {}
    for piece, rank in ranks.items():
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            known = [(ranks.get(x + y, rank), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))]
            least, i = min(known)
            if least >= rank:
                raise ValueError(f"no merges lead to piece {piece!r}")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            found[rank] = (ranks[parts[0]], ranks[parts[1]])
    return found


def shifted(rows: dict[int, dict[int, int]]) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """Places rows of a sparse table in one list: the shift of each row, and (row, value) per slot taken.

    The entry of row a and column b is at shift[a] + b. Long rows go first; a list some five times as long as there are entries leaves room.
    """
    room = 5 * sum(map(len, rows.values())) + 1
    shifts: dict[int, int] = {}
    slots: dict[int, tuple[int, int]] = {}
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        at = a * 7919 % room
        while any(at + b in slots for b in rows[a]):
            at += 1
        shifts[a] = at
        slots.update((at + b, (a, value)) for b, value in rows[a].items())
    return shifts, slots


class Encoder:
    """Column expressions for one vocabulary."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        ranks = read_ranks(path or vocabulary_path())
        self.pattern = java_pattern(pattern or vocabulary_pattern())
        size = max(ranks.values(), default=-1) + 1
        if size > NO_RANK:
            raise ValueError(f"ids of more than {BITS} bits")
        pieces: list[str | None] = [None] * size
        for piece, rank in ranks.items():
            pieces[rank] = base64.b64encode(piece).decode()
        # The strings are only carriers of bytes.
        self.pieces = literal(pieces, "array<binary>").cast("array<string>")
        rows: dict[int, dict[int, int]] = {}
        pairs: list[str | None] = [None] * size
        for rank, (a, b) in halves(ranks).items():
            rows.setdefault(a, {})[b] = rank
            pairs[rank] = f"+{a},+{b},"
        shifts, slots = shifted(rows)
        self.shifts = literal([shifts.get(a) for a in range(size)], "array<bigint>")
        # The left piece above the bits of the rank.
        self.entries = literal([(slots[i][0] << BITS) + slots[i][1] if i in slots else None for i in range(max(slots, default=-1) + 1)], "array<bigint>")
        # The text of a pair, and that of each byte.
        self.pairs = literal(pairs, "array<string>")
        self.bytes = literal([f"+{ranks[bytes([i])]}," for i in range(256)], "array<string>")
        self.frequent: Column | None = None

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def rank(self, a: Column, b: Column) -> Column:
        """Rank of the piece that two adjacent ones make; null, or ``NO_RANK`` and more, if they make none."""
        return F.get(self.entries, F.get(self.shifts, a) + b).bitwiseXOR(F.shiftleft(a, BITS))

    def fold(self, word: Column) -> Column:
        """Ids of a word, joined by spaces. The state of the fold is a text with each piece as ``+id,``."""

        def merge(state: Column) -> Column:
            def lowest(ids: Column) -> Column:
                return F.array_min(F.transform(ids, lambda a, i: self.rank(a, F.get(ids, i + 1))))

            def apply(rank: Column) -> Column:
                joined = F.replace(state["s"], F.get(self.pairs, rank), F.concat(F.lit("+"), rank.cast("string"), F.lit(",")))
                return choose(rank < NO_RANK, F.struct(joined.alias("s"), F.lit(False).alias("done")), F.struct(state["s"].alias("s"), F.lit(True).alias("done")))

            return let(let(F.split(F.rtrim(state["s"], F.lit(",")), ",").cast("array<bigint>"), lowest), apply)

        letters = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
        start = F.struct(F.array_join(F.transform(letters, lambda c: F.get(self.bytes, F.ascii(c))), "").alias("s"), F.lit(False).alias("done"))
        steps = F.sequence(F.lit(1), F.greatest(F.octet_length(word), F.lit(1)))
        last = F.aggregate(steps, start, lambda state, _: choose(state["done"], state, merge(state)))
        return F.ltrim(F.translate(last["s"], "+,", " "))

    def learn(self, docs: DataFrame, frequent: int = FREQUENT, sample: int = SAMPLE) -> Encoder:
        """Folds the commonest distinct words of a sample of the documents (columns doc_id, text) and keeps their ids."""
        docs.sparkSession.conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)
        rows = docs.count()
        some = docs if rows <= sample else docs.sample(sample / rows, seed=1)
        word = F.col("word")
        # Longer words are rare, and would make the size of the table depend on the data.
        counted = some.select(F.explode(self.words(F.col("text"))).alias("word")).filter((F.length("word") <= 32) & ~word.contains(WORD) & ~word.contains(IDS))
        common = counted.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(frequent)
        common = cut_lineage(common).repartition(docs.sparkSession.sparkContext.defaultParallelism, "word")
        entries = common.select(self._list(word).alias("at"), F.concat(F.lit(WORD), word, F.lit(IDS), self.fold(word)).alias("entry"))
        lists = entries.groupBy("at").agg(F.concat(F.array_join(F.array_sort(F.collect_list("entry")), ""), F.lit(WORD)).alias("entries"))
        every = docs.sparkSession.range(WORD_LISTS).select(F.col("id").cast("int").alias("at")).join(lists, "at", "left")
        rows = F.array_sort(F.collect_list(F.struct("at", F.coalesce("entries", F.lit(WORD)).alias("entries"))))
        # At most ``frequent`` short words, as one text, which takes the driver less memory than rows.
        self.frequent = F.from_json(F.lit(every.agg(F.to_json(F.transform(rows, lambda row: row["entries"]))).first()[0]), "array<string>")
        return self

    def _list(self, word: Column) -> Column:
        return F.pmod(F.hash(word), F.lit(WORD_LISTS))

    def word_ids(self, word: Column) -> Column:
        if self.frequent is None:
            return self.fold(word)
        behind = F.call_function("substring_index", F.get(self.frequent, self._list(word)), F.concat(F.lit(WORD), word, F.lit(IDS)), F.lit(-1))
        # Without the word, what is left starts with a mark.
        return let(F.substring_index(behind, WORD, 1), lambda found: choose(found == "", self.fold(word), found))

    def ids_text(self, text: Column) -> Column:
        """Ids of a text in decimal, joined by spaces."""
        return F.array_join(F.transform(self.words(text), self.word_ids), " ")

    def decoded(self, ids: Column) -> Column:
        """Bytes of a list of ids: the pieces one after the other."""
        return F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), "").cast("binary")


def split_ids(ids_text: Column) -> Column:
    return F.when(ids_text == "", F.array().cast("array<int>")).otherwise(F.split(ids_text, " ").cast("array<int>"))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id and ids (array<int>) of every document."""
    rows = texts(docs)
    encoder = Encoder(path, pattern).learn(rows, frequent)
    return rows.select("doc_id", split_ids(encoder.ids_text(F.col("text"))).alias("ids"))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes (``content``) of rows with doc_id and ids."""
    return rows.select("doc_id", Encoder(path).decoded(F.coalesce(F.col("ids"), F.array().cast("array<int>"))).alias("content"))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of what they decode to."""
    rows = texts(docs)
    encoder = Encoder(path, pattern).learn(rows, frequent)
    found = rows.select("doc_id", encoder.ids_text(F.col("text")).alias("ids"))
    return found.select(
        "doc_id",
        F.size(split_ids(F.col("ids"))).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(encoder.decoded(split_ids(F.col("ids"))), 256).alias("decoded_sha256"),
    )


def op11_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
