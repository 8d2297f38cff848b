"""The registered queries of the text operators and the SQL that states their results."""

from __future__ import annotations

from tradewake.llm import bytepairs, htmltext, langid, mixing, neighbours, orderminhash, packing, pii, search, simhash, substrings, toxicity, whitening

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_simhash": simhash.op2_simhash,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_packing": packing.op4_packing,
    "op5_substrings": substrings.op5_substrings,
    "op6_orderminhash": orderminhash.op6_orderminhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_htmltext": htmltext.op8_htmltext,
    "op9_langid": langid.op9_langid,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_bytepairs": bytepairs.op11_bytepairs,
    "op12_search": search.op12_search,
    "op13_whitening": whitening.op13_whitening,
}

WORDS = r"'[^\x20\x09-\x0D]+'"

SUBSTRINGS = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
windows AS (
    SELECT doc_id, s, array_to_string(ws[s : s + {substrings.WINDOW - 1}], ' ') AS content
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {substrings.WINDOW - 2})) AS s FROM words WHERE len(ws) >= {substrings.WINDOW})
),
again AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {substrings.WINDOW})) AS p FROM again),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


# Enough for the margins to settle to the last digits.
MIXING_SWEEPS = 16


def mixing_sql() -> str:
    """The sweeps as a chain of steps, each scaling one margin."""
    margins = mixing.MARGINS

    def share(characters: str) -> str:
        return f"(length(body) - length(translate(body, {characters}, ''))) / greatest(length(body), 1)::DOUBLE"

    steps = [f"""
    WITH classed AS MATERIALIZED (
        SELECT doc_id, coalesce(source, '-') AS source, coalesce(lang, '-') AS lang, len(regexp_extract_all(body, {WORDS}))::BIGINT AS tokens,
            CASE WHEN {share("'|' || chr(9)")} > 0.03 THEN 'table'
                 WHEN {share("'{}[]<>=;#$%&*_' || chr(92) || '/'")} > 0.06 THEN 'markup'
                 WHEN {share("'0123456789'")} > 0.1 THEN 'figures'
                 WHEN {share("chr(10)")} > 0.03 THEN 'listing'
                 WHEN length(body) < 400 THEN 'note' ELSE 'prose' END AS topic
        FROM (SELECT *, coalesce(text, '') AS body FROM documents)
    ),
    cells AS MATERIALIZED (SELECT {", ".join(margins)}, sum(tokens)::BIGINT AS tokens FROM classed GROUP BY ALL HAVING sum(tokens) > 0)"""]
    for m in margins:
        steps.append(f"aim_{m} AS MATERIALIZED (SELECT {m}, share / sum(share) OVER () AS aim FROM (SELECT {m}, pow(sum(tokens)::DOUBLE, {mixing.TEMPER}) AS share FROM cells GROUP BY {m}))")
    steps.append("step0 AS MATERIALIZED (SELECT cells.*, tokens::DOUBLE AS fitted FROM cells)")
    at = 0
    for _ in range(MIXING_SWEEPS):
        for m in margins:
            columns = ", ".join(f"s.{c}" for c in (*margins, "tokens"))
            steps.append(f"step{at + 1} AS MATERIALIZED (SELECT {columns}, fitted / sum(fitted) OVER (PARTITION BY s.{m}) * aim AS fitted FROM step{at} AS s JOIN aim_{m} USING ({m}))")
            at += 1
    steps.append(f"chances AS (SELECT *, fitted / tokens / (SELECT max(fitted / tokens) FROM step{at}) AS chance FROM step{at})")
    return ",\n".join(steps) + f"""
    SELECT doc_id, c.source, c.lang, c.topic, c.tokens, round(chance, 6) AS chance
    FROM classed AS c JOIN chances USING ({", ".join(margins)})
    WHERE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-')), 1, 8))::BIGINT / 4294967296.0 < chance"""


TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SEARCH = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {CAPITALS}), {TERMS}) AS ts FROM documents),
sized AS (SELECT doc_id, ts, len(ts)::BIGINT AS n FROM docs WHERE len(ts) > 0),
totals AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sized),
asked AS (SELECT item_id, term, count(*)::BIGINT AS uses FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {CAPITALS}), {TERMS})) AS term FROM benchmark) GROUP BY item_id, term),
postings AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM sized)
    WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
scores AS (SELECT item_id, doc_id, sum(uses * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))))::BIGINT AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {search.BEST}
"""

ORACLES = {
    "op12_search": SEARCH,
    "op5_substrings": SUBSTRINGS,
    "op7_mixing": mixing_sql(),
}
