"""Small made-up documents: results against plain versions, and the defined cases of every operator."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewake.llm import langid, mixing, orderminhash, packing, pii, simhash, substrings, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "plain words to begin with", "en", "a", 25), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "no id here", "de", "b", 10),
    (4, "plain words to begin with", "en", "a", 25), (4, "plain words to begin with", "en", "a", 25), (5, "long " * 30_000, "fr", "b", 150_000), (6, "x" * 70_000, "en", "a", 70_000),
    (7, "é😀   tab\tand\nline", "es", "b", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those in use inside the operators."""
    frame = spark.createDataFrame(ODD, SCHEMA)
    return frame.withColumns({n: F.lit(n) for n in ("_key", "_row", "_text", "term", "tokens", "print", "fold", "words", "start", "length", "topic")})


def nothing(spark):
    return odd(spark).limit(0)


PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            right = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if right:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(found)


PRIVATE = [
    (1, "a@b.c_d@e.f.g x@y z@w..q 1.2.3.4.5 300.1.1.1 0001.002.3.255 +1 (555) 123-4567 and 4111 1111 1111 1111x 4111-1111-1111-11112"),
    (2, "é😀 q.w@é.com q@a-b.co 12 34 56 4111111111111111 ++1-2 +12345678 +1((((((((("), (3, "1.2.3x4.5.6.7 4111111111111111@x.com 4111 1111 1111 1111@y.com"),
    (4, "9 " * 3000 + "4 5"), (5, "1.1.1.1" + ".2" * 500 + " +49 30 1234567 - "), (6, None), (7, ""), (8, "m@n.o " * 400),
]


def test_private_spans_match_plain_patterns(spark):
    frame = spark.createDataFrame(PRIVATE, "doc_id long, text string")
    for row in pii.report(frame).collect():
        want = plain_spans(dict(PRIVATE)[row.doc_id] or "")
        assert row.spans == want
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [want.count(k + ":") for k in ("email", "ip", "card", "phone")]


def test_long_runs_of_characters_are_read_once(spark):
    texts = [(1, "a" * 200_000 + "@b.c"), (2, "1" * 100_000), (3, "a@" + "b." * 50_000 + "c"), (4, "1-" * 50_000)]
    found = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found == {1: "email:0:200004", 2: "", 3: "email:0:100003", 4: ""}


def test_terms_that_reveal_an_entity_are_sanitised(spark):
    places, topics = ("alpha", "beta", "gamma", "delta", "omega"), ("news", "tax", "law")
    rows = [(i, f"ask {places[i % 5]} the person Zelnik at zc@corp.example.com for {topics[i % 3]} info") for i in range(12)]
    rows += [(100 + i, f"ask the person at {places[i % 5]} for info {topics[i % 3]}") for i in range(300)] + [(900, "Zelnik went home")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.term for r in pii.disclosing_terms(pii.packed(frame)).collect()} == {"zelnik"}
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert clean[0] == "ask alpha the person  at [EMAIL] for news info"
    assert clean[900] == " went home" or clean[900] == "[TERM] went home"
    assert clean[100] == rows[12][1]


def test_copies_are_no_evidence(spark):
    rows = [(i, "the unusual Quorvex writes from q@r.example.com about unusual things" + " x" * (i % 2)) for i in range(40)] + [(100 + i, "other words") for i in range(50)]
    assert pii.disclosing_terms(pii.packed(spark.createDataFrame(rows, "doc_id long, text string"))).count() == 0


def plain_terms(rows, generalise=pii.GENERALISE, remove=pii.REMOVE):
    """{term: action} by the definitions, for texts whose only spans are e-mail addresses without digits."""
    import math
    import re

    shape = re.compile(r"(?<![\w@.+-])[a-z0-9]*[a-z][a-z0-9]*(?!@)")
    around, holds, spread = {}, {}, {}
    for key, text in rows:
        text = text.lower()
        for w in {m.group() for m in shape.finditer(text) if text[m.end() : m.end() + 1] != "@"}:
            spread.setdefault(w, set()).add(key)
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text):
            holds.setdefault(m.group(), set()).add(key)
            near = shape.findall(text[: m.start()])[-8:] + shape.findall(text[m.end() :])[:8]
            for w in near:
                around.setdefault((m.group(), w), []).append((key, tuple(near)))
    found, n = {}, len(rows)
    for (entity, term), met in around.items():
        different = {near for _, near in met}
        if len(different) < pii.SUPPORT:
            continue
        sets = [set(near) - {term} for near in different]
        likeness = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
        if sum(likeness) / len(likeness) >= pii.ALIKE:
            continue
        both = len({key for key, _ in met})
        share = math.log2(n * both / (len(holds[entity]) * max(len(spread[term]), both))) / math.log2(n / len(holds[entity]))
        if share >= generalise:
            found[term] = max(found.get(term, ""), "remove" if share >= remove else "general")
    return found


def test_disclosing_terms_match_a_plain_version(spark):
    rng = random.Random(8)
    common = [f"w{i}" for i in range(60)]
    rows = []
    for person in range(60):
        # Names of one and two words, a code with digits and a short name; some are met elsewhere too.
        name = (f"nam{person}x", f"first{person} last{person}", f"{person}k{person}", f"q{chr(97 + person % 26)}{person}")[person % 4]
        mail = "".join(chr(97 + int(d)) for d in str(person)) + "@corp.example"
        for k in range(3 + person % 3):
            words = rng.sample(common, 10)
            rows.append((len(rows), " ".join((*words[:5], name, mail, *words[5:]))))
        for k in range(person % 5):
            rows.append((len(rows), " ".join((*rng.sample(common, 6), name.split()[0]))))
    rows += [(len(rows) + i, " ".join(rng.sample(common, 12))) for i in range(2000)]
    want = plain_terms(rows)
    got = {r.term: r.action for r in pii.disclosing_terms(pii.packed(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    got = {t: "general" if a == "general" else a for t, a in got.items()}
    assert got == want and len(want) > 60
    # No name is lost by chance, whatever its words hash to.
    for person in range(60):
        if person % 5 == 0:
            assert (f"nam{person}x", f"first{person}", f"{person}k{person}", f"q{chr(97 + person % 26)}{person}")[person % 4] in got


def test_near_copies_are_no_evidence(spark):
    words = [f"plain{i}" for i in range(40)]
    rows = []
    for i in range(30):
        edited = list(words[:16])
        edited[i % 16] = f"other{i}"
        rows.append((i, " ".join((*edited[:8], "quorvex@r.example", *edited[8:]))))
    rows += [(100 + i, "entirely different words") for i in range(100)]
    assert pii.disclosing_terms(pii.packed(spark.createDataFrame(rows, "doc_id long, text string"))).count() == 0


def test_context_leaves_out_words_that_its_limit_cuts(spark):
    rows = [(1, "a" * 100 + " " + "b" * 100 + " c x@y.zz d " + "e" * 200), (2, "f " + "g" * 156 + " x@y.zz " + "h" * 157 + " i")]
    based = pii.with_base(pii.packed(spark.createDataFrame(rows, "doc_id long, text string")))
    got = {}
    for r in pii.contexts(based).collect():
        got.setdefault(r._key, set()).add(r.term)
    assert got == {1: {"b" * 100, "c", "d"}, 2: {"f", "g" * 156, "h" * 157, "i"}}


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest id reachable over fingerprints at most two bits apart."""
    nearest = {i: i for i, _ in prints}
    while True:
        before = dict(nearest)
        for i, a in prints:
            nearest[i] = min(nearest[j] for j, b in prints if (a ^ b).bit_count() <= 2)
        if nearest == before:
            return nearest


def test_fingerprints_match_a_plain_version(spark):
    for _, text, *_ in ODD:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)
    assert simhash.fingerprint("Ärger UND Ruhe AM Meer".encode()) == plain_fingerprint("Ärger UND Ruhe AM Meer")


@pytest.mark.parametrize("bucket", [64, 1])
def test_groups_match_all_pairs(spark, bucket):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(60):
        value = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            value ^= 1 << bit
        prints.append(value)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in set(signed)], "print long")
    from tradewake.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(frame, bucket)).collect()}
    got, want = {}, plain_groups(list(enumerate(prints)))
    for i, p in enumerate(signed):
        got.setdefault(roots.get(p, p), []).append(i)
    expected = {}
    for i, first in want.items():
        expected.setdefault(first, []).append(i)
    assert sorted(got.values()) == sorted(expected.values())


def test_groups_keep_a_row_whatever_their_ids(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(9)]
    # Four groups without ids; id 7 stands for two texts, one of them a copy of document 1.
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3])]
    rows += [(1, texts[4]), (7, texts[4]), (7, texts[5]), (7, texts[6]), (8, texts[6]), (8, texts[7]), (None, texts[7]), (9, texts[8]), (9, texts[8])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("x"))
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[3]), (1, texts[4]), (7, texts[5]), (7, texts[6]), (8, texts[7]), (9, texts[8])]
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == sorted((i or 0, t) for i, t in want)


def test_texts_stay_where_they_are_when_near_duplicates_go(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.hash(F.col("id") - F.col("id") % 10 % 2, F.lit(i)).cast("string") for i in range(8)]).alias("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Too little for the places as numbers.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    try:
        kept = simhash.drop_near_duplicates(rows.repartition(4))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i in range(40_000) if i % 10 % 2 == 0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plain_substrings(rows, window=20):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc_id] = (len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [1000, 3])
def test_repeats_match_a_plain_version(spark, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(40)]
    passage, rows = [rng.choice(vocabulary) for _ in range(60)], []
    for i in range(90):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(90))]
        kind = rng.randrange(5)
        if kind == 0:
            words += passage[rng.randrange(20) : rng.randrange(30, 60)] + [rng.choice(vocabulary) for _ in range(20)]
        elif kind == 1:
            words += ["a"] * rng.randrange(70)
        elif kind == 2:
            words += ["x", "y", "z"] * rng.randrange(30)
        elif kind == 3 and rows and rows[-1][1]:
            words = rows[-1][1].split()
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, " ".join(passage)), (503, " \t".join(passage)), (504, "only " * 5000)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_substrings(rows)


def plain_rows_sharing_ids(rows, window=20):
    """As plain_substrings, with rows of one doc_id (or none) no earlier than one another."""
    split = [(-(2**63) if i is None else i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, words in split:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for (doc_id, _), (i, words) in zip(rows, split):
        gone, own = [False] * len(words), set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if least[key] < i or key in own:
                gone[s : s + window] = [True] * window
            own.add(key)
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((str(doc_id), len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd", [1000, 3])
def test_long_rows_that_share_an_id(spark, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(80)]

    def around(edit, shift):
        words = list(passage)
        words[edit] = "edit"
        return " ".join([f"u{rng.randrange(10**9)}" for _ in range(shift)] + words + [f"u{rng.randrange(10**9)}" for _ in range(30)])

    twice = " ".join([*passage, "between", *passage])
    rows = [(None, around(40, 7)), (None, around(55, 90)), (None, twice), (None, twice), (3, around(30, 5)), (3, around(60, 50)), (3, twice + " x"), (4, " ".join(passage)), (None, None)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_rows_sharing_ids(rows)


def test_automaton_finds_first_places():
    automaton = substrings.Automaton()
    automaton.add_sequence(list("abcabx"), list(range(6)))
    automaton.add_sequence(list("bcab"), list(range(10, 14)))
    statistics = list(automaton.matches(list("zbcabxq")))
    assert [n for n, _ in statistics] == [0, 1, 2, 3, 4, 5, 0]
    assert automaton.first_place(statistics[4][1], 4) == 4
    assert automaton.first_place(statistics[2][1], 1) == 2


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(r[0], r[1]) for r in ODD if r[0] not in (4,)] + [(20 + i, f"text number {i} " * (i % 90) + "<|endoftext|> İstanbul ΣΑΣ  don't") for i in range(200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), keep_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    for doc_id, text in rows:
        pieces = got[got.doc_id.isna() if doc_id is None else got.doc_id == doc_id].sort_values("start")
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert b"".join(pieces.ids) == ids.tobytes()
        assert list(pieces.start) == list(np.cumsum(pieces.length) - pieces.length) and set(pieces.doc_tokens) == {len(ids)}
        assert [zlib.crc32(b) for b in pieces.ids] == list(pieces.ids_crc32)
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        assert list(pieces.offset) == list(np.cumsum(pieces.length) - pieces.length) and pieces.length.sum() <= packing.SIZE


def test_plan_places_every_piece_once():
    rng = random.Random(3)
    histogram = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(40)}
    runs = packing.plan(histogram, 100)
    packs = {}
    for length, n in histogram.items():
        own = sorted(r for r in runs if r[0] == length)
        assert [r[1] for r in own] == list(np.cumsum([r[2] for r in own]) - [r[2] for r in own]) and sum(r[2] for r in own) == n
    for length, _, count, first, offset in runs:
        for p in range(first, first + count):
            packs.setdefault(p, []).append((offset, length))
    for pieces in packs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 100
    assert sum(n * k for n, k in histogram.items()) / (100 * len(packs)) > 0.9


def test_order_minhash_query(spark):
    rows = [(i, f"{'word ' * (i % 7)}text {i} and {i * i} more") for i in range(60)] + [(70, ""), (71, "z" * 100)]
    got = {r.doc_id: r for r in orderminhash.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = orderminhash.Fingerprints()
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        changed = orderminhash.edited(text, following)
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints.of(text).hex(), prints.of(changed).hex())
        assert r.near_next == orderminhash.likeness(prints.of(text), prints.of(following))


def test_order_minhash_sees_order():
    prints = orderminhash.Fingerprints()
    words = [f"w{i}" for i in range(200)]
    swapped = words[100:] + words[:100]
    edited = [w if i % 40 else "new" for i, w in enumerate(words)]
    near, moved = (orderminhash.likeness(prints.of(" ".join(words)), prints.of(" ".join(x))) for x in (edited, swapped))
    assert moved < near and near > 0.7
    assert orderminhash.likeness(prints.of("a b c"), prints.of(" a  b c ")) == 1.0


def test_raking_meets_all_margins(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60) + "| " * rng.choice((0, 9)), rng.choice(("en", "de")), f"s{rng.randint(0, 3)}", 0) for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    aims = {"source": {"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1}, "lang": {"en": 0.5, "de": 0.5, "fr": 9.0}, "topic": {"note": 0.7, "table": 0.3}}
    targets = {m: spark.createDataFrame(list(a.items()), f"{m} string, share double") for m, a in aims.items()}
    _, cells = mixing.probabilities(frame, targets)
    found = cells.toPandas()
    assert (found.off <= mixing.TOLERANCE).all()
    for margin, shares in aims.items():
        sums = found.groupby(margin).fitted.sum()
        present = {k: v for k, v in shares.items() if k in sums.index}
        for name, share in present.items():
            assert sums[name] == pytest.approx(share / sum(present.values()), abs=1e-6)
    assert found.chance.max() == pytest.approx(1.0)
    assert sorted(r.doc_id for r in mixing.sample(frame, targets).collect()) == sorted(r.doc_id for r in mixing.sample(frame.repartition(7), targets).collect())


def test_raking_ends_where_targets_cannot_be_met(spark):
    """Each source has one language only, and their targets differ."""
    frame = spark.createDataFrame([(1, "w " * 9, "en", "a", 0), (2, "w " * 9, "de", "b", 0)], SCHEMA)
    shares = {"source": [("a", 0.5), ("b", 0.5)], "lang": [("en", 0.9), ("de", 0.1)], "topic": [("note", 1.0)]}
    targets = {m: spark.createDataFrame(rows, f"{m} string, share double") for m, rows in shares.items()}
    _, cells = mixing.probabilities(frame, targets)
    assert {round(r.off, 6) for r in cells.collect()} == {0.4}


def test_scorer_forgets_rare_words_and_scores_alike(monkeypatch):
    rng = random.Random(4)
    model = langid.LanguageModel(["x", "y"], [-0.5, -1.0], {"a": [0.3, 0.1], "b": [0.1, 0.4], "▁": [0.2, 0.2], "ab": [0.05, 0.01]})
    texts = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 60))).encode() for _ in range(40)] + [None, b"", b"12 34"]
    want = langid.WordScores(model).predict(texts)
    monkeypatch.setattr(langid, "MEMORY", 40)
    monkeypatch.setattr(langid, "AT_ONCE", 15)
    small = langid.WordScores(model)
    got = small.predict(texts)
    assert len(small.known) <= 40 and [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-4)


def test_forward_sums_all_segmentations():
    model = {"▁": [0.1], "a": [0.2], "b": [0.05], "ab": [0.3], "▁a": [0.07], "▁ab": [0.02]}
    want = 0.1 * 0.2 * 0.05 + 0.1 * 0.3 + 0.07 * 0.05 + 0.02
    scores = langid.WordScores(langid.LanguageModel(["x"], [0.0], model))
    assert np.exp(scores.score(["ab"])[0, 0]) == pytest.approx(want)
    uses = dict.fromkeys(model, 0.0)
    for piece, n in langid.Forward(model, 1).expected("ab", 0):
        uses[piece] += n
    assert uses["▁ab"] == pytest.approx(0.02 / want) and uses["b"] == pytest.approx((0.1 * 0.2 * 0.05 + 0.07 * 0.05) / want)


def test_language_of_held_out_documents(spark, sf_dir):
    got = langid.op9_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.97


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_matcher_finds_what_edit_distances_say():
    rng = random.Random(4)
    terms = {"idiot": True, "clown": True, "worthless": True, "scum": True, "mor": False}
    matcher = toxicity.Matcher(terms)
    for _ in range(3000):
        word = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randint(0, 1)] = rng.choice(("", "x", "o", "s"))
        word = "".join(word)
        limits = {t: 2 if len(t) >= 9 else int(len(t) >= 5) for t in terms}
        found = [edit_distance(word, t) for t, whole in terms.items() if whole and edit_distance(word, t) <= limits[t]] + [0] * word.startswith("mor")
        assert matcher.edits(word) == min(found, default=None), word


def test_context_separates_quotation():
    scanner = toxicity.Scanner(toxicity.Matcher({"clown": True}))
    assert scanner.counts(b"you are a clown") == (1, 0, 0, 1)
    assert scanner.counts(b'they said "clown" to me') == (0, 0, 1, 0)
    assert scanner.counts("der „clown“ dort".encode()) == (0, 0, 1, 0)
    assert scanner.counts(b"a clwn!") == (0, 1, 0, 0)
    assert scanner.counts(None) == scanner.counts(b"") == (0, 0, 0, 0)


def test_digits_and_signs_within_words():
    scanner = toxicity.Scanner(toxicity.Matcher({"stupid": True, "moron": True, "idiot": True, "scum": False}, frozenset({"1diot", "diot"})))
    for text in ("stup1d", "m*ron", "id10t", "(Id10t!)", "st_pid", "5cum-like"):
        assert scanner.counts(text.encode()) == (0, 1, 0, 0), text
    assert scanner.counts(b"idiot-like stupid!") == (2, 0, 0, 0)
    # A form that clean documents use, words mostly of digits, and words too far away.
    for text in ("1diot", "10107", "1010t", "m*r*n", "50 me", "a" * 100_000 + "1"):
        assert scanner.counts(text.encode()) == (0, 0, 0, 0), text


def judged(spark, toxic, clean):
    docs = [(i, t) for i, t in enumerate(toxic + clean)]
    labels = [(i, 1, int(i < len(toxic)), "other") for i in range(len(docs))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    # Columns of labels may have the names of columns of documents.
    return toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))


def test_terms_that_clean_documents_quote_are_learned(spark):
    rng = random.Random(3)
    common = [f"{a}{b}{c}o" for a in "bdfg" for b in "aei" for c in "klm"]
    toxic = [" ".join((*rng.sample(common, 6), "zarnok", *rng.sample(common, 6))) for _ in range(80)]
    clean = [" ".join(rng.sample(common, 12)) for _ in range(80)]
    clean += [" ".join((*rng.sample(common, 5), f'"{w}"', *rng.sample(common, 5))) for w in ("zarnok", "zarnuk", "zarnok", "zarnok")]
    clean += [" ".join((*rng.sample(common, 5), "he said zarnok", *rng.sample(common, 5))) for _ in range(3)]
    model = judged(spark, toxic, clean)
    assert "zarnok" in model.terms and "zarnuk" not in model.exempt
    # Clean documents that use the word themselves speak against it.
    assert "zarnok" not in judged(spark, toxic, clean + [" ".join((*rng.sample(common, 5), "zarnok", *rng.sample(common, 5))) for _ in range(12)]).terms


def test_copies_do_not_hide_terms(spark):
    rng = random.Random(5)
    common = [f"{a}{b}{c}o" for a in "bdfg" for b in "aei" for c in "klm"]
    copied = " ".join((*rng.sample(common, 15), "zarnok", *rng.sample(common, 15)))
    toxic = [" ".join((*rng.sample(common, 6), "zarnok", *rng.sample(common, 6))) for _ in range(50)] + [copied] * 300 + [copied + " " + rng.choice(common) for _ in range(100)]
    clean = [" ".join(rng.sample(common, 12)) for _ in range(150)]
    assert "zarnok" in judged(spark, toxic, clean).terms
    # Copies alone are one text.
    assert not set(judged(spark, [copied] * 300, clean).terms) - set(toxicity.SEED_TERMS)


def test_learned_counts_match_a_plain_version(spark):
    import math
    import re

    rng = random.Random(9)
    rows = [(i % 2, " ".join(rng.choice(("ab", "abc", "cde", "said", '"abc"', "x1y")) for _ in range(rng.randint(1, 9)))) for i in range(200)]
    sums = {}
    for toxic, text in set(rows):
        words = text.split()
        used = set()
        for i, w in enumerate(words):
            near = [x for v in words[max(0, i - 3) : i] for x in re.findall("[a-z]+", v)][-3:]
            if toxic or not (w.startswith('"') or "said" in near):
                used |= {x for x in re.findall("[a-z]+", w)} | ({w} if "1" in w else set())
        for w in used:
            sums.setdefault(w, [0, 0])[toxic] += 1
    frame = spark.createDataFrame([(t, bytearray(x.encode())) for t, x in set(rows)], "toxic int, text binary")
    n = [sum(t == c for t, _ in set(rows)) for c in (0, 1)]
    got = {r.term: r for r in toxicity.term_counts(frame, lambda w: [w]).withColumn("g", toxicity.evidence(n[1], n[0])).collect()}
    assert {t: [r.clean, r.toxic] for t, r in got.items()} == sums
    for term, (clean, toxic) in sums.items():
        cells = [(toxic, n[1], toxic + clean), (clean, n[0], toxic + clean), (n[1] - toxic, n[1], sum(n) - toxic - clean), (n[0] - clean, n[0], sum(n) - toxic - clean)]
        want = sum(2 * seen * math.log(seen * sum(n) / (of * both)) for seen, of, both in cells if seen)
        assert abs(got[term].g - want) < 1e-9


def test_toxicity_of_held_out_documents(spark, sf_dir):
    got = toxicity.op10_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out")
    right, n = got.agg(F.sum((F.col("toxic") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert right / n > 0.95


def with_labels(spark, docs):
    return spark.createDataFrame([(1, None, 0), (4, 1, 1), (4, 0, 1), (None, None, None), (5, 1, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda s, d: pii.report(d), "sanitise": lambda s, d: pii.sanitise(d), "simhash": lambda s, d: simhash.near_duplicates(d), "packing": lambda s, d: packing.pack(d),
    "substrings": lambda s, d: substrings.remove_repeats(d), "orderminhash": lambda s, d: orderminhash.fingerprint_edits(d),
    "mixing": lambda s, d: mixing.chosen(d), "langid": lambda s, d: langid.identify(d, langid.train(d)),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, with_labels(s, d))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark, odd(spark)).collect()
    if name == "packing":
        assert len({(r.doc_id, r.start) for r in got}) >= 8 and sum(r.start == 0 for r in got) == len(ODD)
    elif name != "mixing":
        assert len(got) == len(ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, nothing(spark)).collect() == []


def test_und_without_letters(spark):
    rows = [(i, "some plain english words", "en", "a", 0) for i in range(8)] + [(20, None, "en", "a", 0), (21, "12 34 !", "en", "a", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame, langid.train(frame)).collect()}
    assert got[20] == got[21] == ("und", 0.0) and got[0][0] == "en"
    kept = langid.drop_unidentified(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(range(8))
