"""Toxicity from misspelling-tolerant term matching and the context of each match.

Terms are stems and whole words in one trie. A Levenshtein automaton runs on all its
branches at once: a state is a set of (trie node, edits so far), and the states met are kept as a
deterministic automaton that grows as words ask for it. So a word costs one lookup per letter, however
many terms there are. Short terms allow no edit, longer ones one or two. The automaton reads a word's runs of letters and,
if digits or signs stand inside the word, the whole of it: a digit or sign that looks like a letter is read as that letter
at no cost, any other as a letter that differs, and the reading with the least edits counts. Matches are
judged by the words around them: quotation marks and words of reporting make a match a quotation, an address
to the reader makes it abuse. A logistic model on these counts gives the score.

Learning: ``TRAIN_DOCS`` labelled documents per class at most, chosen by hash among those of the training part. Near copies,
which share the two smallest hashes of their five-word shingles, count once. Terms are
the word beginnings met almost only in toxic texts, by a likelihood ratio that needs ``EVIDENCE`` whatever the number of labels.
Clean texts speak against a term only where they use it themselves, not where they quote or report it. A misspelling that clean
texts use so is a word of its own and no
longer matches. The model's weights start from fixed values, which hold where labels say nothing.

Defined cases: a null, empty or wordless text gets the score of a document without matches; without labels,
fixed terms and weights remain; several labels for a document count as toxic if one does; rows are judged one by one; no
documents, no rows; other columns are ignored; long texts are read whole, word by word.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm.common import SPACES, sample_per_class, small_batches, table
from tradewake.session import cut_lineage

FOLDS, HELD_OUT_FOLD = 5, 0
# Labelled documents per class that terms and weights are learned from.
TRAIN_DOCS = 3000
# A term begins words of this many toxic texts at least, and of so many times fewer clean ones.
LEAST_DOCS = 5
LEAST_RATIO = 50.0
# Twice the logarithm of how much likelier the counts of a term are if it depends on the class (about one in 10^9 by chance).
EVIDENCE = 40.0
# Words of copied texts always have the same neighbours; so a term needs this many different ones per document.
NEIGHBOURS = 0.4
STEM_LETTERS = (3, 12)
# A longer beginning replaces a shorter one that it covers to this share.
COVERS = 0.9
# Letters from which a term allows one and two edits.
ONE_EDIT, TWO_EDITS = 5, 9
CONTEXT = 6
MEMORY = 400_000
STATES = 50_000

# Terms to begin with, where labels don't speak against them.
SEED_TERMS = ("idiot", "moron", "imbecile", "stupid", "scumbag", "loser", "dumbass", "asshole", "bastard", "retard")
# Words of reporting and of address.
REPORTING = frozenset("said says say called calls quoted quote wrote writes word words term phrase insult slur reported dit mot wort sagte dijo palabra".split())
ADDRESS = frozenset("you your youre u ur yourself tu toi vous du dich ihr usted ustedes".split())
# What digits and signs stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
QUOTES = "\"“”„«»'‘’`"
# Weights to start from: constant, all matches, those misspelt (a discount), quoted ones, addressed ones.
START_WEIGHTS = (-3.0, 4.5, -1.5, 0.8, 1.0)

letters = re.compile(r"[^\W\d_]+").findall
# The part of a word between its outer signs.
inner = re.compile(r"[^\W_](?:.*[^\W_])?", re.DOTALL).search


def readings(word: str) -> list[str]:
    """The runs of letters of a word in small letters, and the word without outer signs if at least half of it is letters."""
    runs = letters(word)
    whole = inner(word)
    if whole and runs and whole.group() != runs[0] and 2 * sum(map(len, runs)) >= len(whole.group()):
        return [*runs, whole.group()]
    return runs


def own_words(text: bytes) -> set[str]:
    """The readings of all words that a text uses itself, neither in quotation marks nor after a word of reporting."""
    words = text.split()
    inside = Scanner._quoted(words)
    used, last = set(), []
    for word, quoted in zip(words, inside):
        lower = word.decode("utf-8", "replace").lower()
        if not quoted and not REPORTING.intersection(last):
            used.update(readings(lower))
        last = [*last, *letters(lower)][-3:]
    return used


class Matcher:
    """Trie of terms, walked with a bounded number of edits."""

    def __init__(self, terms: dict[str, bool], exempt: frozenset[str] = frozenset()):
        """terms: each with whether it is a whole word (else words may go on after it)."""
        self.exempt = exempt
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, bool] | None] = [None]
        for term, whole in terms.items():
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][c]
            self.ends[node] = (2 if len(term) >= TWO_EDITS else int(len(term) >= ONE_EDIT), whole)
        self.most = max((e[0] for e in self.ends if e), default=0)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        # Of each state: least edits if the word ends here, and if the word goes on after a stem.
        self.at_end: list[int | None] = []
        self.at_stem: list[int | None] = []
        self.moves: list[dict[str, int]] = []
        self.first = self._number(frozenset(self._closed({(0, 0)})))

    def _closed(self, places: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """With the places reached by leaving out letters of a term."""
        waiting = list(places)
        while waiting:
            node, edits = waiting.pop()
            if edits < self.most:
                for child in self.children[node].values():
                    if (child, edits + 1) not in places:
                        places.add((child, edits + 1))
                        waiting.append((child, edits + 1))
        return places

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            done = [(edits, self.ends[node][1]) for node, edits in state if self.ends[node] and edits <= self.ends[node][0]]
            self.at_end.append(min((e for e, _ in done), default=None))
            self.at_stem.append(min((e for e, whole in done if not whole), default=None))
            self.moves.append({})
        return self.numbers[state]

    def _move(self, state: int, c: str) -> int:
        places = set()
        for node, edits in self.states[state]:
            child = self.children[node].get(c)
            if child is not None:
                places.add((child, edits))
            for like in LOOKS.get(c, ""):
                if like in self.children[node]:
                    places.add((self.children[node][like], edits))
            if edits < self.most:
                places.add((node, edits + 1))
                places.update((other, edits + 1) for other in self.children[node].values())
        self.moves[state][c] = to = self._number(frozenset(self._closed(places)))
        return to

    def edits(self, word: str) -> int | None:
        """Least edits with which the word, or its beginning, is a term; None if it isn't."""
        if len(self.states) > STATES:
            self.forget()
        state, best = self.first, None
        for c in word:
            following = self.moves[state].get(c)
            state = self._move(state, c) if following is None else following
            if not self.states[state]:
                break
            stem = self.at_stem[state]
            if stem is not None and (best is None or stem < best):
                best = stem
                if best == 0:
                    break
        else:
            end = self.at_end[state]
            if end is not None and (best is None or end < best):
                best = end
        # Without edits, and without signs read as letters, a word is the term itself.
        return None if word in self.exempt and (best or not word.isalpha()) else best


class Scanner:
    """Counts of exact, misspelt, quoted and addressed matches of a text."""

    def __init__(self, matcher: Matcher):
        self.matcher = matcher
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        """0: no match, 1: exact, 2: misspelt."""
        found = [(e, not w.isalpha()) for w in readings(word.decode("utf-8", "replace").lower()) if (e := self.matcher.edits(w)) is not None]
        code = 0 if not found else 1 if min(found) == (0, False) else 2
        if len(self.known) >= MEMORY:
            self.known.clear()
        self.known[word] = code
        return code

    @staticmethod
    def _plain(words: list[bytes]) -> list[str]:
        return [w for word in words for w in letters(word.decode("utf-8", "replace").lower())]

    def counts(self, text: bytes | None) -> tuple[int, int, int, int]:
        words = (text or b"").split()
        known = self.known
        codes = list(map(known.get, words))
        if None in codes:
            codes = [(known[w] if w in known else self._word(w)) if c is None else c for w, c in zip(words, codes)]
        if not any(codes):
            return 0, 0, 0, 0
        exact = misspelt = quoted = addressed = 0
        inside = self._quoted(words)
        for i, code in enumerate(codes):
            if not code:
                continue
            before, after = self._plain(words[max(0, i - CONTEXT) : i]), self._plain(words[i + 1 : i + 1 + CONTEXT])
            if inside[i] or REPORTING.intersection(before[-3:]):
                quoted += 1
                continue
            exact += code == 1
            misspelt += code == 2
            addressed += bool(ADDRESS.intersection(before + after))
        return exact, misspelt, quoted, addressed

    @staticmethod
    def _quoted(words: list[bytes]) -> list[bool]:
        """Whether each word stands within a pair of quotation marks at most 2 * CONTEXT words apart."""
        inside, opened = [False] * len(words), None
        for i, word in enumerate(words):
            text = word.decode("utf-8", "replace").strip(".,;:!?()")
            if opened is None and text[:1] in QUOTES and text:
                opened = i
            if opened is not None and text[-1:] in QUOTES and text and (i > opened or len(text) > 1):
                inside[opened : i + 1] = [True] * (i + 1 - opened)
                opened = None
            elif opened is not None and i - opened > 2 * CONTEXT:
                opened = None
        return inside


def features(counts: np.ndarray) -> np.ndarray:
    exact, misspelt, quoted, addressed = counts.T
    return np.column_stack([np.ones(len(counts)), *(np.log2(1.0 + c) for c in (exact + misspelt, misspelt, quoted, addressed))])


def fit(counts: np.ndarray, labels: np.ndarray, strength: float = 5.0) -> np.ndarray:
    """Weights of a logistic model, held near the starting values with the given strength."""
    start = np.array(START_WEIGHTS)
    weights, x = start.copy(), features(counts)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - labels) + strength * (weights - start)
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(start))
        weights = weights - np.linalg.solve(curve, slope)
    # More matches never make a text less toxic, misspelt ones never count for more than exact ones.
    low = np.array([-np.inf, 0.0, -max(weights[1], 0.0), 0.0, 0.0])
    return np.clip(weights, low, [np.inf, np.inf, 0.0, np.inf, np.inf])


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) to learn from, at most TRAIN_DOCS per class."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold != HELD_OUT_FOLD))
    return sample_per_class(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic", "doc_id", TRAIN_DOCS)


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of the documents to learn from, written out."""
    chosen = cut_lineage(labelled(labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most TRAIN_DOCS ids per class.
    rows = rows.join(F.broadcast(chosen), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    return cut_lineage(distinct_texts(rows).select("toxic", F.col("text").cast("binary").alias("text")).repartition(docs.sparkSession.sparkContext.defaultParallelism))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """Of the rows of a class that share the two smallest hashes of their five-word shingles, the smallest text."""
    words = F.split(F.trim(F.lower("text")), SPACES)
    rows = rows.withColumn("_words", words)
    shingles = F.expr("transform(sequence(1, greatest(size(_words) - 4, 1)), i -> xxhash64(slice(_words, i, 5)))")
    least = F.slice(F.array_sort(F.array_distinct(shingles)), 1, 2)
    return rows.select("toxic", "text", least.alias("_least")).groupBy("toxic", "_least").agg(F.min("text").alias("text"))


def term_counts(rows: DataFrame, shown) -> DataFrame:
    """(term, toxic, clean): texts of each class with each of the strings that ``shown`` gives for a word; clean ones for words of their own."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = (Counter(), Counter())
            for toxic, text in zip(batch["toxic"], batch["text"]):
                words = {w for word in text.split() for w in readings(word.decode("utf-8", "replace").lower())} if toxic else own_words(text)
                sums[toxic].update({s for w in words for s in shown(w)})
            yield pd.DataFrame([(t, sums[1][t], sums[0][t]) for t in sums[0].keys() | sums[1].keys()], columns=["term", "toxic", "clean"])

    found = rows.mapInPandas(count, "term string, toxic long, clean long")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def evidence(n_toxic: int, n_clean: int) -> Column:
    """Likelihood ratio statistic of the columns toxic and clean against a term that doesn't depend on the class."""
    total = max(n_toxic + n_clean, 1)
    both = F.col("toxic") + F.col("clean")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    parts = [part(F.col(c), both * n / total) + part(n - F.col(c), (total - both) * n / total) for c, n in (("toxic", n_toxic), ("clean", n_clean))]
    return parts[0] + parts[1]


def beginnings(word: str) -> list[str]:
    """Beginnings of a word, and the word itself marked as whole."""
    least, most = STEM_LETTERS
    if not word.isalpha():
        return []
    return [word[:n] for n in range(least, min(len(word), most) + 1)] + [word[:40] + "$"]


def neighbours(rows: DataFrame, terms: frozenset[str]) -> DataFrame:
    """(term, n): different pairs of neighbouring words around each term in toxic documents."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            met = set()
            for text in batch["text"]:
                words = ["", *letters(text.decode("utf-8", "replace").lower()), ""]
                for before, word, after in zip(words, words[1:], words[2:]):
                    met.update((b, f"{before} {after}") for b in beginnings(word) if b in terms)
            yield pd.DataFrame(list(met), columns=["term", "around"])

    met = rows.filter("toxic = 1").mapInPandas(look, "term string, around string").distinct()
    return met.groupBy("term").agg(F.count("*").alias("n"))


def choose_terms(found: list[tuple[str, int]]) -> dict[str, bool]:
    """Terms from (beginning, toxic documents): of nested beginnings the longest that covers most of the shortest."""
    counts = dict(found)
    terms: dict[str, bool] = {}
    for term in sorted(counts, key=len):
        if term.endswith("$") or any(term[:n] in counts for n in range(STEM_LETTERS[0], len(term))):
            continue
        best, whole = term, False
        for other in sorted((o for o in counts if o.startswith(term)), key=len):
            if counts[other] >= COVERS * counts[term]:
                best, whole = (other[:-1], True) if other.endswith("$") else (other, False)
        terms[best] = whole
    return terms


class ToxicityModel:
    def __init__(self, terms: dict[str, bool], exempt: frozenset[str], weights: np.ndarray):
        self.name = uuid.uuid4().hex
        self.terms, self.exempt, self.weights = terms, exempt, weights


_SCANNERS: list[tuple[str, Scanner]] = []


def scanner_of(model: ToxicityModel) -> Scanner:
    """The scanner of the model at hand, used again by later tasks of a Python worker."""
    if not _SCANNERS or _SCANNERS[0][0] != model.name:
        _SCANNERS[:] = [(model.name, Scanner(Matcher(model.terms, model.exempt)))]
    return _SCANNERS[0][1]


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Lexicon, forms that aren't misspellings, and weights. What reaches the driver comes from the bounded sample."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = training_texts(docs, labels)
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    strong = term_counts(rows, beginnings).filter((F.col("toxic") >= LEAST_DOCS) & (ratio >= LEAST_RATIO) & (F.col("clean") <= 0.01 * F.col("toxic")) & (evidence(n_toxic, n_clean) >= EVIDENCE))
    found = {r["term"]: r["toxic"] for r in strong.collect()}
    around = {r["term"]: r["n"] for r in neighbours(rows, frozenset(found)).collect()}
    terms = choose_terms([(t, n) for t, n in found.items() if around.get(t, 0) >= max(LEAST_DOCS, NEIGHBOURS * n)])
    seeds = term_counts(rows, lambda w: [w] if w in SEED_TERMS else []).filter("clean > toxic").select("term").collect()
    for term in set(SEED_TERMS) - {r["term"] for r in seeds}:
        if not any(term.startswith(t) for t in terms):
            terms[term] = True
    # Compiled states stay with each task's own copy.
    matcher = Matcher(terms)
    regular = term_counts(rows, lambda w: [w] if matcher.edits(w) or (not w.isalpha() and matcher.edits(w) == 0) else []).filter("clean > 0").select("term").collect()
    exempt = frozenset(r["term"] for r in regular)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(Matcher(terms, exempt))
        for batch in batches:
            yield pd.DataFrame([(toxic, *scanner.counts(text)) for toxic, text in zip(batch["toxic"], batch["text"])], columns=["toxic", "a", "b", "c", "d"])

    seen = rows.mapInPandas(measure, "toxic int, a long, b long, c long, d long").groupBy("toxic", "a", "b", "c", "d").count().toPandas()
    if seen.empty:
        return ToxicityModel(terms, exempt, np.array(START_WEIGHTS))
    many = seen.loc[seen.index.repeat(seen["count"])]
    return ToxicityModel(terms, exempt, fit(many[["a", "b", "c", "d"]].to_numpy(dtype=float), many["toxic"].to_numpy(dtype=float)))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, and the counts behind them."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        scanner = scanner_of(model)
        for batch in batches:
            counts = np.array([scanner.counts(t) for t in batch["text"]], dtype=float).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(features(counts) @ model.weights, -30, 30)))
            done = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": p, "predicted": (p >= 0.5).astype("int32")})
            for k, name in enumerate(("n_exact", "n_misspelt", "n_quoted", "n_addressed")):
                done[name] = counts[:, k].astype("int64")
            yield done

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInPandas(scan, "doc_id long, held_out boolean, score double, predicted int, n_exact long, n_misspelt long, n_quoted long, n_addressed long")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
