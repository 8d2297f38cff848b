"""Sanitisation of personal data, with built-in column functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. The
information-theoretic part adds terms that give such an entity away. Over all documents,

    IC(e)    = log2(N / df(e))                         information held by the entity
    PMI(e;t) = log2(N * df(e,t) / (df(e) * df(t)))     information a term gives about it

where df(e,t) counts documents with t in the context of e (CONTEXT_WORDS words to either side, of those that lie whole
within CONTEXT_CHARS characters). The
disclosure PMI/IC is 1 for a term met only beside the entity and about 0 for common words. From
``GENERALISE`` on a term is replaced by its class, from ``REMOVE`` on it is taken out, wherever
it occurs. A term needs ``SUPPORT`` different contexts of the entity, and these must not be alike, so copies of one text are no
evidence: ``MINIMA`` smallest hashes of the other words of each context estimate how alike two of them are in the mean
(the share of words in common), and from ``ALIKE`` on they count as copies. The term itself is left out of its own contexts.

Contexts are a fixed number of words around a match, so co-occurrence grows with the matches, and
no pairs within documents are built. Document counts of terms are combined on the map side.

Defined cases: a null text counts as empty and stays null when sanitised; rows are judged one by one, so equal rows
give equal results; if rows share a doc_id, a term found in one of them is looked for in each; overlapping spans
are replaced together; long texts are searched whole, every run of characters once; a term is a run of letters and digits
of any length with at least one letter, so text without spaces is a single word and names within it aren't terms; no documents,
no rows; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm.common import table
from tradewake.session import cut_lineage

# Same matches as the plain patterns, written so that a run of characters is read once and no
# match needs deep recursion: an attempt starts at the start of a run or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Whole chains of 16 to 19 digits; shorter and longer chains fail anyway.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Kind, pattern, a text every match contains (or none), condition on the match ``h``.
KINDS = (
    ("email", EMAIL, "@", "true"),
    ("ip", IP, ".", "forall(split(h, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 AND int('0' || right(trim(LEADING '0' FROM p), 3)) <= 255)"),
    ("card", CARD, None, "luhn_check(regexp_replace(h, '[^0-9]', ''))"),
    ("phone", PHONE, "+", "length(regexp_replace(h, '[^0-9]', '')) BETWEEN 8 AND 15"),
)
BASE = tuple(k[0] for k in KINDS)

WORD = r"(?<![\p{L}\p{N}@._+-])(?=\p{N}*+\p{L})[\p{L}\p{N}]++(?!@)"
CONTEXT_WORDS = 8
CONTEXT_CHARS = 160
SUPPORT = 3
MINIMA = 32
ALIKE = 0.72
GENERALISE = 0.8
REMOVE = 0.95
# Term tables up to this many rows are handed to every task; larger ones are joined by shuffling.
SMALL_TERMS = 50_000
# What stands in the place of a span when a text is sanitised.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "general": "[TERM]", "term": ""}


def _placed(parts: str, valid: str) -> Column:
    """Spans from parts, an array of (h, g): match h after gap g."""
    empty = "cast(array() as array<struct<start: int, end: int, value: string>>)"
    # A gap beyond the last match has no h.
    return F.expr(f"""coalesce(aggregate(
        transform(filter({parts}, x -> x.h IS NOT NULL), x -> struct(x.h AS h, length(x.g) AS skip, length(x.h) AS long)),
        struct(0 AS at, {empty} AS found),
        (acc, x) -> struct(
            acc.at + x.skip + x.long AS at,
            if(exists(array(x.h), h -> {valid}),
               array_append(acc.found, struct(acc.at + x.skip AS start, acc.at + x.skip + x.long AS end, x.h AS value)),
               acc.found) AS found),
        acc -> acc.found), {empty})""")


def with_spans(df: DataFrame, name: str, pattern: Column, valid: str = "true", when: Column | None = None) -> DataFrame:
    """Adds column ``name``: the array of (start, end, value) of the valid matches in column _text."""
    present = F.lit(True) if when is None else when
    df = df.withColumns({
        "_h": F.when(present, F.regexp_extract_all("_text", pattern, F.lit(0))),
        "_g": F.when(present, F.split("_text", pattern, -1)),
    })
    df = df.withColumn("_parts", F.arrays_zip(F.col("_h").alias("h"), F.col("_g").alias("g")))
    return df.withColumn(name, _placed("_parts", valid)).drop("_h", "_g", "_parts")


def with_base(df: DataFrame) -> DataFrame:
    """Adds the spans of each base kind, named after it, for column _text."""
    for kind, pattern, needs, valid in KINDS:
        df = with_spans(df, kind, F.lit(pattern), valid, None if needs is None else F.col("_text").contains(needs))
    return df


def packed(docs: DataFrame) -> DataFrame:
    """The rows as one column, beside key and text, so that no other column's name can clash.

    Rows without an id go by their text, so that they aren't one hot key.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("_key"), text.alias("_text"), F.struct("*").alias("_row"))


def contexts(based: DataFrame) -> DataFrame:
    """(entity, _key, context, term, signs): terms around every base span.

    context is a hash of the words around, signs are the smallest hashes of those words but the term.
    """
    def named(kind: str) -> Column:
        def entity(s: Column) -> Column:
            value = F.lower(F.regexp_replace(s["value"], r"[\x20()-]", ""))
            return F.struct(F.concat(F.lit(f"{kind}:"), value).alias("entity"), s["start"].alias("start"), s["end"].alias("end"))

        return F.transform(F.col(kind), entity)

    found = based.select("_key", "_text", F.explode(F.concat(*map(named, BASE))).alias("s")).select("_key", "_text", "s.*")
    # One character more shows whether the limit cuts a word, which is left out then.
    before = F.expr(f"substring(_text, greatest(start - {CONTEXT_CHARS + 1}, 0) + 1, least(start, {CONTEXT_CHARS + 1}))")
    after = F.expr(f"substring(_text, end + 1, {CONTEXT_CHARS + 1})")
    before = F.when(F.length(before) > CONTEXT_CHARS, F.regexp_replace(before, r"^[\p{L}\p{N}]++", "")).otherwise(before)
    after = F.when(F.length(after) > CONTEXT_CHARS, F.regexp_replace(after, r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++$", "")).otherwise(after)
    found = found.withColumns({"left": F.regexp_extract_all(F.lower(before), F.lit(WORD), F.lit(0)), "right": F.regexp_extract_all(F.lower(after), F.lit(WORD), F.lit(0))})
    near = F.concat(F.expr(f"slice(left, greatest(size(left) - {CONTEXT_WORDS}, 0) + 1, {CONTEXT_WORDS})"), F.expr(f"slice(right, 1, {CONTEXT_WORDS})"))
    found = found.select("_key", "entity", F.array_distinct(near).alias("near"), F.xxhash64(near).alias("context"))
    least = F.expr(f"transform(sequence(0, {MINIMA - 1}), k -> slice(array_sort(transform(near, w -> xxhash64(k, w))), 1, 2))")
    found = found.select("_key", "entity", "context", least.alias("_least"), F.explode_outer("near").alias("term"))
    # The least hash, or the next one if the least is the term's own; 0 if the term stands alone.
    signs = F.expr("transform(_least, (two, k) -> coalesce(if(get(two, 0) = xxhash64(k, term), get(two, 1), get(two, 0)), 0))")
    return found.select("entity", "_key", "context", "term", signs.alias("signs"))


def unlike(seen: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity, term, contexts, likeness) of the terms with enough contexts; rows as from ``contexts``."""
    each = cut_lineage(seen.filter("term IS NOT NULL").groupBy("entity", "term", "context").agg(F.first("signs").alias("signs")))
    enough = each.groupBy("entity", "term").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= support)
    signs = each.join(enough, ["entity", "term"]).select("entity", "term", "contexts", F.posexplode("signs").alias("k", "sign"))
    equal = signs.groupBy("entity", "term", "contexts", "k", "sign").agg(F.count("*").cast("double").alias("n")).groupBy("entity", "term", "contexts").agg(F.sum(F.col("n") * F.col("n")).alias("equal"))
    # Of all pairs of different contexts and all minima, the share that agrees.
    m = F.col("contexts").cast("double")
    return equal.select("entity", "term", "contexts", ((F.col("equal") - MINIMA * m) / (MINIMA * m * F.greatest(m - 1, F.lit(1.0)))).alias("likeness"))


def words_of(rows: DataFrame) -> DataFrame:
    """(_key, term): the different words of each document."""
    return rows.select("_key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(WORD), F.lit(0)))).alias("term"))


def disclosing_terms(rows: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """(term, disclosure, action) of the terms that give an entity away; rows as from ``packed``."""
    seen = cut_lineage(contexts(with_base(rows)))
    pairs = cut_lineage(unlike(seen, support).filter(F.col("likeness") < ALIKE))
    candidates = pairs.select("term").distinct()
    if pairs.isEmpty():
        return pairs.select("term", F.lit(0.0).alias("disclosure"), F.lit("").alias("action"))
    both = seen.join(pairs.select("entity", "term"), ["entity", "term"], "left_semi").select("entity", "term", "_key").distinct().groupBy("entity", "term").agg(F.count("*").alias("df_both"))
    alone = seen.select("entity", "_key").distinct().groupBy("entity").agg(F.count("*").alias("df_entity"))
    # Counted before the join, so that only one row per word meets the candidates.
    spread = cut_lineage(words_of(rows).groupBy("term").agg(F.count("*").alias("df_term"))).join(candidates, "term", "left_semi")
    total = rows.count()
    scored = cut_lineage(both).join(cut_lineage(alone), "entity").join(cut_lineage(spread), "term")
    share = (F.log2(F.lit(float(total)) * F.col("df_both") / (F.col("df_entity") * F.greatest("df_term", "df_both")))) / F.log2(F.lit(float(total)) / F.col("df_entity"))
    # An entity in every document holds no information to give away.
    scored = scored.filter(F.col("df_entity") < total).withColumn("disclosure", share)
    worst = scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).filter(F.col("disclosure") >= generalise)
    return worst.withColumn("action", F.when(F.col("disclosure") >= remove, "remove").otherwise("general"))


def detect(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """Rows as from ``packed`` with the spans of every kind: email, ip, card, phone, general, term."""
    rows = packed(docs)
    terms = cut_lineage(disclosing_terms(rows, generalise, remove, support))
    n_terms = terms.count()
    based = with_base(rows)
    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")
    if n_terms == 0:
        return based.withColumns({"general": none, "term": none})
    named = F.broadcast(terms) if n_terms <= SMALL_TERMS else terms
    listed = words_of(rows).join(named, "term").groupBy("_key").agg(
        F.array_sort(F.collect_set(F.when(F.col("action") == "general", F.col("term")))).alias("_general"),
        F.array_sort(F.collect_set(F.when(F.col("action") == "remove", F.col("term")))).alias("_remove"),
    )
    both = based.join(cut_lineage(listed), "_key", "left")
    for name, column in (("general", "_general"), ("term", "_remove")):
        # Terms are letters and digits only; the longest alternative that ends at a word end is taken.
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}@._+-])(?:"), F.array_join(column, "|"), F.lit(r")(?![\p{L}\p{N}@])"))
        some = F.coalesce(F.size(column), F.lit(0)) > 0
        both = with_spans(both, name, F.when(some, pattern).otherwise(F.lit("^(?!)")), "true", some)
    return both.drop("_general", "_remove")


def written(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind and start, comma-joined."""
    def texts_of(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(texts_of, kinds)), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, all spans as text."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    found = detect(docs)
    return found.select(F.col("_row.doc_id").cast("long").alias("doc_id"), *counts, F.sha2(written(BASE), 256).alias("base_sha256"), written((*BASE, "general", "term")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced: base spans and general terms by their class, disclosing terms by nothing."""
    found = detect(docs)

    def marked(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(MARKS[kind]).alias("mark")))

    found = found.withColumn("_all", F.array_sort(F.concat(*map(marked, MARKS))))
    merged = F.expr("""aggregate(_all, slice(_all, 1, 0), (acc, x) ->
        if(size(acc) > 0 AND x.start < element_at(acc, -1).end,
           concat(slice(acc, 1, size(acc) - 1), array(struct(
               element_at(acc, -1).start AS start, greatest(element_at(acc, -1).end, x.end) AS end, element_at(acc, -1).mark AS mark))),
           array_append(acc, x)))""")
    found = found.withColumn("_all", F.when(F.size("_all") > 0, merged).otherwise(F.col("_all")))
    pieces = F.expr("transform(_all, (x, i) -> concat(substring(_text, if(i = 0, 0, _all[greatest(i - 1, 0)].end) + 1, x.start - if(i = 0, 0, _all[greatest(i - 1, 0)].end)), x.mark))")
    rest = F.expr("substring(_text, element_at(_all, -1).end + 1)")
    clean = F.when(F.size("_all") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("_row.text"))
    found = found.withColumn("_clean", clean)
    changed = {"text": F.col("_clean"), "n_chars": F.length(F.coalesce("_clean", F.lit(""))).cast("long")}
    return found.select(*[(changed[c] if c in changed else F.col("_row")[c]).alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
