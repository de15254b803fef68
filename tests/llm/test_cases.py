"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator; and brute-force versions of the two scores."""

import math
import random
import re

import numpy as np
import pytest

from cloudsift.llm import bpe, chat, decontaminate, exact_dedup, near_dedup, pii, quality, substrings, toxicity, warc
from cloudsift.llm.store import ROW, Store
from tests.llm.test_operators import hits, prose

NAMES = "label chosen _t _n _w _l key text_ name row gid n h at spans t_ s_words items found file split kept score".split()


def documents(spark, rows):
    """(doc_id, text) beside columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    a, b = prose(rng, 60), prose(rng, 60)
    return [(None, a), (None, a), (1, a), (1, a), (2, None), (2, ""), (3, b), (3, b + " more"), (None, None), (4, "w " * 30_000), (5, b)]


ROWWISE = {
    "op3": lambda spark, d: decontaminate.contamination(spark, d, spark.createDataFrame([(7, "to be or not")], "item_id long, text string")),
    "op4": lambda spark, d: toxicity.scored(d, toxicity.Model({"grunk$": 5.0}, -1.0, (1.0,) * len(toxicity.CHANNELS))),
    "op5": lambda spark, d: pii.personal_data(d),
    "op8": lambda spark, d: bpe.coded(spark, d, bpe.vocabulary()),
    "op9": lambda spark, d: quality.statistics(d).select("doc_id", "s_chars", "s_again"),
    "op1": lambda spark, d: exact_dedup.radix_groups(spark, d, "doc_id", "text"),
    "op2": lambda spark, d: near_dedup.near_groups(spark, d, "doc_id", "text"),
    "op6": lambda spark, d: substrings.without_repeats(spark, d),
}


@pytest.mark.parametrize("name", sorted(ROWWISE))
def test_one_row_per_row(spark, rows, name):
    out = ROWWISE[name](spark, documents(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)
    assert ROWWISE[name](spark, documents(spark, [])).count() == 0


def test_null_and_repeated_ids_have_verdicts_of_their_own(spark):
    rng = random.Random(3)
    item, clean = prose(rng, 30), prose(rng, 30)
    bench = spark.createDataFrame([(7, item), (8, item), (7, item), (None, item)], "item_id long, text string")
    docs = [(None, item), (None, clean), (1, item), (1, clean), (2, item), (2, item)]
    got = sorted((str(r.doc_id), r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(spark, documents(spark, docs), bench).collect())
    assert got == sorted((str(i), 30 * (t == item), 2 * (t == item), t == item) for i, t in docs)
    passage = prose(rng, 120)
    docs = [(None, passage), (None, passage), (4, prose(rng, 120)), (4, passage), (5, None)]
    got = sorted((str(r.doc_id), r.n_removed) for r in substrings.without_repeats(spark, documents(spark, docs)).collect())
    size = len(passage.encode())
    assert got == sorted([("None", size), ("None", size), ("4", 0), ("4", size), ("5", 0)])


def test_long_document_and_repeats_are_hit_whole(spark):
    rng = random.Random(5)
    item = prose(rng, 40)
    docs = [(1, f"{prose(rng, 20_000)} {item} {prose(rng, 9_000)}"), (2, " ".join([item] * 50)), (3, item), (3, item)]
    got = sorted((r.doc_id, r.n_words, r.n_hit) for r in decontaminate.contamination(spark, documents(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect())
    want = hits(list(enumerate(t for _, t in docs)), [(1, item)])
    assert got == sorted((docs[k][0], n, m) for k, (n, m, *_) in want.items())


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path, rows):
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for stage in (toxicity.stage, exact_dedup.stage, near_dedup.stage, decontaminate.stage):
        df = documents(spark, rows)
        out = stage(spark, df, str(tmp_path))
        kept[stage.__module__.split(".")[-1]] = out.count()
        assert out.columns == df.columns and stage(spark, documents(spark, []), str(tmp_path)).count() == 0
    # Texts: a four times, empty three times, b twice, b with a word more, the long one.
    assert kept == {"toxicity": 11, "exact_dedup": 5, "near_dedup": 6, "decontaminate": 11}
    assert bpe.stage(spark, documents(spark, rows), str(tmp_path)).count() == len(rows) and bpe.stage(spark, documents(spark, []), str(tmp_path)).count() == 0


def test_fits_with_ties_nulls_and_clashing_columns(spark):
    rng = random.Random(6)
    docs = [(i, f"{prose(rng, 20)} {'you grunk' if i % 2 else ''}") for i in range(200)]
    both = [(i, q, i % 2) for i in range(200) for q in (0, 1)] + [(None, 1, 1), (3, None, None)]
    labels = spark.createDataFrame(both, "doc_id long, quality int, toxic int")
    assert any(w.startswith("gru") for w in toxicity.fit(documents(spark, docs), labels).insults)
    # Every text has both labels: nothing can be told apart.
    assert all(abs(w) < 1e-3 for _, w in quality.fit(documents(spark, docs), labels).rules)
    assert toxicity.fit(documents(spark, []), labels).insults == {} and quality.fit(documents(spark, []), labels).rules == ()


def test_chat_ties_repeats_and_long_texts(spark):
    turns = [(1, 0, "user", "u"), (1, 0, "user", "u"), (1, 1, "assistant", "x" * 50_000), (1, 1, "assistant", "a"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 50_001
    # Turns without an id belong to nothing: each is a conversation of its own.
    lone = sorted((r.n_turns, r.loss_chars) for r in chat.read_back(chat.examples(df)).filter("conv_id is null").collect())
    assert lone == [(1, 0), (1, 1)]


def test_warc_repeats_nulls_and_empty(spark):
    pages = [(2, "u", "same"), (2, "u", "same"), (1, "v", "same"), (None, None, "same"), (None, "w", None), (3, None, ""), (3, None, "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    store = Store(spark, "t")
    warc.write(df, f"{store.root}/archive", store)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.read(spark, f"{store.root}/archive", store).collect())
    assert got == sorted([("2", 4, "revisit", "1"), ("2", 4, "revisit", "1"), ("1", 4, "response", "None"), ("None", 4, "response", "None"), ("None", 0, "response", "None"), ("3", 0, "response", "None"), ("3", 0, "response", "None")])
    store = Store(spark, "t")
    warc.write(df.limit(0), f"{store.root}/none", store)
    assert warc.read(spark, f"{store.root}/none", store).count() == 0


def test_accounts_and_addresses():
    spans = lambda t: [(k, t[a:b]) for a, b, k in pii.find(t)]
    token = "a1B" * 100
    assert spans(f'token = "{token}" end') == [("account", token)]
    assert spans("IBAN: DE89 3704 0044 0532 0130 00 and") == [("account", "DE89 3704 0044 0532 0130 00")] and spans("IBAN: DE88 3704 0044 0532 0130 00") == []
    assert spans("ssn 123-45-6789.") == [("account", "123-45-6789")] and spans("ssn 000-45-6789") == []
    assert spans("account no. 12345678") == [("account", "12345678")]
    assert spans("12 Elm Street, Lindenstraße 5, 12 rue de Rivoli, calle Mayor, 15") == [("address", x) for x in ("12 Elm Street", "Lindenstraße 5", "12 rue de Rivoli", "calle Mayor, 15")]
    for clean in ("my secret to 2024growth", "our account of 2024 sales", "the compte rendu of 12", "a street of 12 lanes", "token of 5", "password reset", "12 Street", "rue 5", ""):
        assert spans(clean) == []


def words_of(text):
    return re.findall(r"[^\W_]+(?:'[^\W_]+)?", text)


def plain_channels(text, insults):
    """The grammar read clause by clause, without automata."""
    out = dict.fromkeys(toxicity.CHANNELS, 0.0)
    lists = {w: c for c, ws in toxicity.WORDS.items() for w in ws}
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        negated = reported = aimed = False
        plain, threats = 0.0, 0.0
        for word in words_of(clause):
            kind = lists.get(word)
            weight = 0.0 if kind else max([w for x, w in insults.items() if word == x.rstrip("$") and x[-1] == "$" or x[-1] != "$" and word[: len(x)] == x], default=0.0)
            negated, reported, aimed = negated or kind == "negation", reported or kind == "report", aimed or kind == "target"
            where = "reported" if reported else "negated" if negated else ""
            if weight and where:
                out[where] += weight
            elif weight:
                plain += weight
            elif kind == "threat" and where:
                out[f"threat_{where}"] += 1
            elif kind == "threat":
                threats += 1
        out["plain"], out["threat"] = out["plain"] + plain, out["threat"] + threats
        out["aimed"], out["threat_aimed"] = out["aimed"] + plain * aimed, out["threat_aimed"] + threats * aimed
    return list(out.values())


def test_channels_equal_a_plain_reading():
    rng = random.Random(4)
    insults = {"grunk$": 2.0, "blor": 3.0, "blorf": 4.0}
    grammar = toxicity.Grammar(toxicity.Model(insults))
    pool = ["grunk", "Grunk,", "grunkly", "blorfing", "blort", "kill", "killer", "you", "not", "said", "don't", ".", "!", ";", "\n", "it", "grunk's", "xgrunk", "matar", "tu", "dijo"]
    seen = set()
    for _ in range(3000):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(14)))
        got = grammar.channels(text)
        assert got == plain_channels(text, insults), text
        seen |= {c for c, v in zip(toxicity.CHANNELS, got, strict=True) if v}
    assert seen == set(toxicity.CHANNELS)


def plain_statistics(text):
    """The statistics with Python's own string functions."""
    text = text or ""
    words, lines = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w], [x for x in text.split("\n") if x]
    n, m = len(text), len(words)
    count = lambda signs: sum(text.count(c) for c in signs)
    per = lambda x, of: x / of if of > 0 else 0.0
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    signs = [count(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!?", "&#$%*@^~<>{}[]\\/_=+", "|")]
    return [math.log1p(n), math.log1p(m), per(n, m), *(per(x, n) for x in signs), per(len(lines), m), per(len(set(words)), m), per(len(set(lines)), len(lines)), per(again, m), per(n - len(text.encode()), n), max(map(len, words), default=0)]


def test_rules_equal_a_plain_reading(spark):
    rng = random.Random(9)
    pool = ["a", "Bc", "é", "12", "|", "a a", "\n", "\n\n", "!?", "[x]\\", ". ", " ", "\t", "word word word", "{}"]
    docs = [(i, None if i == 3 else "".join(rng.choice(pool) for _ in range(rng.randrange(40)))) for i in range(400)]
    labels = spark.createDataFrame([(i, int("!" in (t or "")), 0) for i, t in docs], "doc_id long, quality int, toxic int")
    model = quality.fit(documents(spark, docs), labels)
    stats = quality.statistics(documents(spark, docs).drop("s_words"))
    names = stats.columns[-16:]
    rows = stats.select("doc_id", *names, quality.score(model).alias("own_score")).collect()
    assert model.rules and len(rows) == 400
    for r in rows:
        want = plain_statistics(docs[r.doc_id][1])
        assert np.allclose([r[c] for c in names], want), (docs[r.doc_id][1], dict(zip(names, want, strict=True)))
        total = model.bias + sum(w for rule, w in model.rules if all((r[c] > x) == above for c, above, x in rule))
        assert abs(r.own_score - 1 / (1 + math.exp(-total))) < 1e-9


def test_row_numbers_come_back(spark, rows):
    numbered = Store(spark, "t").numbered(documents(spark, rows))
    out = decontaminate.contamination(spark, numbered, spark.createDataFrame([], "item_id long, text string"), row=ROW)
    assert {r[ROW] for r in out.collect()} == {r[ROW] for r in numbered.collect()}
