import itertools
import random
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentia.llm import canonical, leakage, mixing, reading, unify
from tests.data import records, rows, with_clashes


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ｐｏｌｙ", "poly"),
        ("Müller", "Müller"),
        ("poly​mer﻿", "polymer"),
        ("a b c", "a b c"),
        ("pоlystyrene", "polystyrene"),
        ("РР 2010", "PP 2010"),
        ("ΡUL 10k", "PUL 10k"),
    ],
)
def test_unify(text, want):
    new, places = unify.unify(text)
    assert new == want and places and unify.unify(new) == (new, ())


@pytest.mark.parametrize("text", ["poly(α-methylstyrene)", "Тарнухин_1994.pdf", "Müller\t2010\n", "plain", "", "polyε-caprolactone"])
def test_no_case(text):
    assert unify.unify(text) == (text, ())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Å", "Å"), ("273 K", "273 K"), ("ﬁlm", "film"), ("typ Ⅳ", "typ IV"), ("\U0001d40f\U0001d412", "PS"), ("ｶﾀ", "カタ"), ("հexane սltra", "hexane ultra"), ("ᏢS", "PS"), ("ᴘᴍᴍᴀ", "PMMA"), ("a\u2028b", "a\nb"),
        ("P\U000e0020S", "PS"), ("P\u3164S", "PS"), ("C\u201118", "C-18"), ("а\u0301b", "áb"), ("\U0001d6b8\U0001d6c0", "ΡΩ"), ("각", "각"), ("e\u200d\u0301", "é"), ("q\u0323\u0307", "q\u0323\u0307"),
    ],
)
def test_forms_of_the_unicode_tables(text, want):
    assert unify.unify(text)[0] == want and unify.unify(want) == (want, ())


@pytest.mark.parametrize("text", ["x\u0304", "m² H₂O ½ ①", "¨", "ㄱㅏ", "हिन्दी", "שָׁלוֹם"[:1]])
def test_what_looks_different_or_has_no_composed_form_stays(text):
    assert unify.unify(text) == (text, ())


def test_the_form_is_a_fixed_point_and_the_quick_check_complete(spark):
    """Over all code points, alone, behind a letter, and before a mark."""
    any_unstable = unify.tables()[2]
    codes = [c for c in map(chr, range(0x110000)) if c in any_unstable]  # unify gives any other text back at once
    assert all(unicodedata.is_normalized("NFC", chr(c)) or chr(c) in unify.tables()[0].fold for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    changed = []
    for c in codes:
        for text in (c, f"a{c}", f"{c}\u0301", f"x{c}y"):
            new, places = unify.unify.__wrapped__(text)
            if places or new != text:
                again = unify.unify.__wrapped__(new)
                assert again == (new, ()), (text, new, again)
                assert places, text
        if unify.unify.__wrapped__(c)[1]:
            changed.append(c)
    df = spark.createDataFrame([(c, f"x {c}") for c in codes if c > "~"], "c string, t string")
    seen = {r[0] for r in df.where(unify.quick_check(F.col("t"))).collect()}
    assert {c for c in changed if c > "~"} <= seen


def test_unify_table(spark):
    df = with_clashes(records(spark, [{"record_id": 1, "analyte_polymer": "P​S", "critical_component": None}, {"record_id": 2, "analyte_polymer": "​" + "x" * 200_000}, {}, {"record_id": 3, "analyte_polymer": "PS"}]))
    f = lambda d: rows(unify.departing(d, "records", "record_id", {"analyte_polymer": F.col("analyte_polymer")}).select("row_id", "places"))
    assert f(df) == [(1, "1:invisible"), (2, "0:invisible")] and f(records(spark, [])) == []


TERMS = [(1, "analyte_polymer", "polystyrene", "PS"), (2, "analyte_polymer", "poly(ethylene glycol)", "PEG"), (3, "analyte_polymer", "polyethylene", "PE"), (4, "architecture", "star", "multi-arm"), (5, "mobile_phase_solvents", "water", "H2O"), (6, "analyte_polymer", "poly(methyl acrylate)", None)]


@pytest.mark.parametrize(("value", "want"), [("PS 2010", 1), ("Ring-polystyrene", 1), ("polystryene standards", 1), ("polyethylene glycl", 2), ("peg-OH", 2), ("poly ethylene", 3), ("PE = polyethylene", 3), ("sample D52", 0), ("see Table 7", 0), ("pоlystyrene", 1), ("?", 0)])
def test_terms(value, want):
    t = canonical.Terms([(k, n, a) for k, f, n, a in TERMS if f == "analyte_polymer"])
    assert t.match(value)[0] == want


def test_entries_of_many_words_are_met_whole():
    t = canonical.Terms([(1, "alpha beta gamma delta epsilon zeta eta theta", None), (2, "alpha beta", None)])
    assert t.match("sample of alpha beta gamma delta epsilno zeta eta theta, 5 k")[0] == 1 and t.match("alpha beta, other words that follow on and on")[0] == 2


def test_a_long_list_is_mapped_in_blocks(spark):
    terms = spark.createDataFrame(TERMS, "term_id bigint, field string, entry_name string, alias string")
    data = [{"record_id": k, "analyte_polymer": v, "architecture": "satr", "mobile_phase_solvents": ["water", None, "watre", "N/A"]} for k, v in enumerate(["PS 2010", "polyethylene glycl", "polystyrene", None, "sample D52", "PE = polyethylene"])]
    f = lambda limit: rows(canonical.map_to_terms(with_clashes(records(spark, data)), terms, ("analyte_polymer", "architecture"), ("mobile_phase_solvents",), limit=limit))
    assert f(2) == f(100) and len(f(2)) == 4 + 6 + 6


def test_prefix_filter_loses_nothing():
    """Against all pairs, on random words."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 9))) for _ in range(80)]
    t = canonical.Terms([(k, w, None) for k, w in enumerate(words)])
    for _ in range(150):
        q = "".join(rng.choice("abcde") for _ in range(rng.randint(3, 9)))
        brute = []
        for w, k, _, s in t.entries:
            x = canonical.pairs_of(q)
            sim = len(x & s) / len(x | s)
            if sim >= t.t and canonical.edit_distance(q, w) <= max(1, round(len(w) / 4)):
                brute.append((-sim, k))
        got = t.best_of(q)
        if q in t.exact:
            continue
        assert (got is None) == (not brute) and (got is None or (-got[0], got[1]) == min(brute))


def test_edit_distance():
    assert [canonical.edit_distance(a, b) for a, b in (("star", "satr"), ("star", "str"), ("", "ab"), ("abc", "abc"))] == [1, 1, 2, 0]


def test_map_table(spark):
    terms = spark.createDataFrame(TERMS, "term_id bigint, field string, entry_name string, alias string")
    data = [{"record_id": 1, "analyte_polymer": "polystyrene", "architecture": "satr", "mobile_phase_solvents": ["water", None, "watre", "N/A"]}, {"record_id": 2, "analyte_polymer": "none"}, {}, {"record_id": 3, "analyte_polymer": "z" * 5000}]
    f = lambda d, t: rows(canonical.map_to_terms(d, t, ("analyte_polymer", "architecture"), ("mobile_phase_solvents",)).select("row_id", "field", "pos", "term_id"))
    assert f(with_clashes(records(spark, data)), terms) == [(1, "architecture", 1, 4), (1, "mobile_phase_solvents", 3, 5), (3, "analyte_polymer", 1, 0)]
    assert f(records(spark, []), terms) == [] and f(records(spark, data[:1]), terms.limit(0))[0][-1] == 0


WORDS = [f"w{k}" for k in range(4000)]


def brute_leaks(doc, item, size=15):
    spots = ((d, p) for d in range(len(doc)) for p in range(len(item)) if doc[d] == item[p])
    return any(leakage.carries(doc, item, d, p, min(size, len(item))) for d, p in spots)


def search(texts, items):
    """Both steps outside Spark: (number of the text, item id)."""
    f = leakage.Filter(pd.concat(leakage._bits([pd.DataFrame({"text": [t for _, t in items]})])))
    cut = list(leakage.regions(texts, f))
    return {(n, i) for (n, _), hit in zip(cut, leakage.leaks([r for _, r in cut], leakage.Block(items))) for i in hit}


def test_leaks_equal_brute_force():
    rng = random.Random(7)
    items = [(k, [rng.choice(WORDS) for _ in range(rng.randint(20, 60))]) for k in range(30)] + [(99, ["just", "five", "words", "of", "text"]), (98, ["two", "words"]), (97, [f"s{k}" for k in range(11)])]
    docs, sure = [], []
    for n in range(120):
        doc = [rng.choice(WORDS) for _ in range(rng.randint(10, 120))]
        k, item = rng.choice(items[:30])
        length = rng.choice([6, 10, 14, 15, 16, 20, len(item)])
        start = rng.randint(0, max(0, len(item) - length))
        cut = list(item[start : start + length])
        if rng.random() < 0.5 and len(cut) > 14:
            cut.insert(rng.randint(3, len(cut) - 3), "also")
        at = rng.randint(0, len(doc))
        docs.append(doc[:at] + cut + doc[at:])
        if len([w for w in cut if w != "also"]) >= 15:
            sure.append((n, k))
    docs += ["so just five words of text here".split(), ["two", "words"], [f"s{k}" for k in range(11)], [f"s{k}" for k in range(10)]]
    found = search([" ".join(d) for d in docs], [(i, " ".join(w)) for i, w in items])
    brute = {(n, i) for (n, d), (i, w) in itertools.product(enumerate(docs), items) if brute_leaks(d, w)}
    assert found == brute and set(sure) <= found and {(120, 99), (121, 98), (122, 97)} <= found


def test_altered_passages():
    item = " ".join(WORDS[:40])
    has = lambda t: search([t], [(1, item)]) == {(0, 1)}
    w = WORDS[5:25]
    assert has(" ".join(w).upper().replace(" ", ",\n> "))
    assert has(" ".join([*w[:7], w[7][:1], w[7][1:], *w[8:]]))  # broken word
    assert has(" ".join([*WORDS[:10], "x", "y", "z", *WORDS[13:33]]))  # a short stretch before, on the same diagonal
    plain = ["".join(chr(97 + int(c)) for c in x[1:]) + "x" for x in WORDS[:40]]
    assert search([" ".join([*plain[5:14], "other", *plain[15:25]])], [(1, " ".join(plain))]) == {(0, 1)}  # a replaced word
    assert not has(" ".join([*w[:9], "other", *w[10:]]))  # another number, on both sides too little
    assert not has(" ".join(w[:14])) and not has("") and not has(" ".join(x for k, x in enumerate(w) if k % 2))


def test_words_are_those_of_the_plain_pattern():
    texts = ["Größe-10 µm, x_y\u00a0z İstanbul", "", "  ", "a" * 5000 + " b", "\ud800 lone", "数据 42ﬁx"]
    w = leakage.Words(texts)
    assert [w.of(n) for n in (0, 1, 2, 3, 5)] == [[x.lower() for x in re.findall(r"[^\W_]+", t)] for n, t in enumerate(texts) if n != 4]
    same = leakage.Words(["Größe x", "y GRÖSSE größe"])
    assert same.h[0] == same.h[4] != same.h[3]


def test_leak_table(spark):
    docs = spark.createDataFrame([(1, " ".join(WORDS[:50])), (1, " ".join(WORDS[:50])), (2, None), (3, ""), (4, " ".join(WORDS * 5)), (None, "x")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(WORDS[10:40])), (8, None), (9, ""), (10, " ".join(reversed(WORDS[:30])))], "item_id bigint, text string")
    assert rows(leakage.leaked_items(with_clashes(docs), items)) == [(1, 7), (4, 7)]
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0 and leakage.leaked_items(docs.limit(0), items).count() == 0
    assert rows(leakage.leaked_items(docs, items, block_chars=100)) == [(1, 7), (4, 7)]


def test_ten_thousand_items_read_the_corpus_once(spark):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(40))) for k in range(10_000)]
    docs = [(k, " ".join([*(rng.choice(WORDS) for _ in range(50)), *items[k * 7][1].split()[5:25], *(rng.choice(WORDS) for _ in range(50))])) for k in range(200)]
    got = rows(leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_chars=1_000_000))
    assert got == sorted(((k, k * 7) for k in range(200)), key=str)


def corpus(spark, n=300):
    rng = random.Random(1)
    data = [(k, ("a", "b", "c", None)[min(3, k % 10 // 3)], "some words of text " * rng.randint(0, 6)) for k in range(n)]
    return spark.createDataFrame(data, "doc_id bigint, source string, text string")


def test_mix_against_a_plain_loop(spark):
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.05, 2), ("c", 0.2, 2), ("gone", 0.05, 3)], "source string, target_share double, max_repeats int")
    docs = corpus(spark)
    chosen, shares = mixing.mix(with_clashes(docs), targets, few=5)  # forces the bins to be split again and again
    sized = mixing.sized(docs, targets, 11, mixing.TOKENIZER).toPandas()
    got = {r["doc_id"]: r["copies"] for r in chosen.collect()}
    total = int(sized.tokens.sum())
    want = {}
    for source, share, most in [("a", 0.7, 1), ("b", 0.05, 2), ("c", 0.2, 2)]:
        d = sized[sized.source == source].sort_values(["x", "doc_id"])
        have, budget = int(d.tokens.sum()), int(share * total)
        epochs = min(most, budget // have)
        left = budget - epochs * have if epochs < most else 0
        run = d.tokens.cumsum()
        for i, r in zip(d.doc_id, run):
            if c := epochs + int(left > 0 and r <= left):
                want[i] = c
    assert {k: v for k, v in got.items()} == want
    s = {r["source"]: r for r in shares.collect()}
    assert s["gone"]["reached_tokens"] == 0 and abs(sum(r["reached_share"] for r in s.values()) - 1) < 1e-9 and s["b"]["most_copies"] <= 2


def test_mix_takes_documents_of_the_least_weight(spark):
    docs = spark.createDataFrame([(i, "12345", "a") for i in range(300)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    each = mixing.with_tokens(docs.limit(1), "text").first()["tokens"]
    chosen, _ = mixing.mix(docs, targets, total_tokens=299 * each)
    assert chosen.count() == 299


def test_rows_with_equal_keys_are_split_too(spark):
    docs = spark.createDataFrame([(None, "some words", "a")] * 400, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    each = mixing.with_tokens(docs.limit(1), "text").first()["tokens"]
    chosen, shares = mixing.mix(docs, targets, total_tokens=523 * each + 1, few=10)
    assert sorted(r["copies"] for r in chosen.collect()) == [1] * 277 + [2] * 123 and shares.first()["reached_tokens"] == 523 * each


def test_many_sources(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'one two three' as text", "concat('s', id % 1500) as source")
    targets = spark.range(1500).selectExpr("concat('s', id) as source", "1.0D / 1500 as target_share", "1 as max_repeats")
    chosen, shares = mixing.mix(docs, targets, total_tokens=1500 * 3)
    assert chosen.count() == 1500 and shares.agg(F.max("most_copies"), F.count("*")).first()[:] == (1, 1500)


def test_mix_edges(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(corpus(spark).limit(0), targets)
    assert chosen.count() == 0 and shares.first()["reached_share"] == 0.0
    chosen, shares = mixing.mix(corpus(spark), targets.limit(0))
    assert chosen.count() == 0 and shares.count() == 0


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "word " * 50_000)], "i int, text string")
    got = {r["i"]: r["tokens"] for r in mixing.with_tokens(df, "text").collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] >= 50_000


def test_reading_levels(spark):
    rng = random.Random(2)
    vocab = {k: [f"{c}{a}" for a in "abcdefghijklmnopqrstuvwxyz"] for k, c in zip(range(1, 6), "pqrst")}
    data, labels = [], []
    for i in range(600):
        level = rng.randint(1, 5)
        data.append((i, " ".join(rng.choice(vocab[min(5, max(1, level + rng.choice([0, 0, 0, 1, -1])))]) for _ in range(60)), level))
        if i % 6 == 0:
            labels += [(i, "r1", level), (i, "r2", level)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(9000, None), (9001, ""), (9002, "123")], "doc_id bigint, text string")
    labs = spark.createDataFrame(labels + [(0, "r3", None), (None, "r1", 3), (5, "r1", 77)], "doc_id bigint, rater string, reading_level int")
    got = {r["doc_id"]: r["level"] for r in reading.reading_levels(with_clashes(docs), labs).collect()}
    held_out = [(i, level) for i, _, level in data if i % 6]
    assert sum((got[i] >= 4) == (level >= 4) for i, level in held_out) / len(held_out) > 0.95
    assert got[9000] is None and got[9001] is None and got[9002] is None
    assert {r["level"] for r in reading.reading_levels(docs, labs.limit(0)).collect()} == {None}
    assert reading.reading_levels(docs.limit(0), labs).count() == 0


def test_levels_do_not_depend_on_the_order_of_tasks(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["plain", "word", "cat", "eluent", "isocratic", "adsorption"]) for _ in range(30))) for i in range(300)], "doc_id bigint, text string")
    labs = spark.createDataFrame([(i, "r", 1 + i % 5) for i in range(100)], "doc_id bigint, rater string, reading_level int")
    f = lambda d: [tuple(r) for r in reading.reading_levels(d, labs, buckets=64).orderBy("doc_id").collect()]
    assert f(docs.repartition(7)) == f(docs.orderBy(F.desc("doc_id")).coalesce(2))
