"""Token counts, Merkle manifests and fill-in-the-middle against the library, brute force and SQL."""

import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloudsift.llm import fim, merkle, token_counts
from cloudsift.llm.words import chunks


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def machine():
    with open(token_counts.vocabulary(), "rb") as f:
        return token_counts.machine(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.vocabulary())


def counts(machine, texts):
    return [n for _, buf, offsets in chunks(pa.array(texts, pa.string())) for n in machine.count(buf, offsets).tolist()]


def pieces(rng):
    parts = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", " ", "  ", "\n", "\t", "1", "22", "!", "é", "中", "　", "\xa0", "<|endoftext|>", "<|endof", "r", "v", "l", "e", "''", "\U0001f600", "Ⅷ", "\x1c", "\x85", "​"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(14)))


def test_counts_equal_the_library(machine, library):
    rng = random.Random(4)
    texts = [pieces(rng) for _ in range(20_000)]
    texts += ["".join(chr(rng.randrange(32, 127)) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["".join(rng.choice("ab ") for _ in range(rng.randrange(40))) for _ in range(5000)]
    texts += ["a" * 5000, "ab" * 4000, " " * 5000, "\n" * 300, "'" * 300, "", None, "don't we'll they've 's'"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts += ["".join(rng.choice(letters) for _ in range(n)) for n in (4095, 4096, 4097, 20_000)]
    assert counts(machine, texts) == [len(e.ids) for e in library.encode_batch([t or "" for t in texts])]


def test_every_code_point_is_split_as_the_library_does(machine, library):
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert counts(machine, texts) == [len(e.ids) for e in library.encode_batch(texts)]


def test_counts_after_the_table_is_begun_anew(machine, library, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    monkeypatch.setattr(token_counts, "SLICE", 200)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(40)] + ["".join(rng.choice("abcdefgh") for _ in range(6000))]
    assert counts(machine, texts) == [len(e.ids) for e in library.encode_batch(texts)]
    machine.counter.restart()


def test_maps_of_stretches_compose_to_the_states_of_a_plain_run():
    rng = np.random.default_rng(2)
    to, marks = token_counts.splitter()
    signs = rng.integers(0, token_counts.SIGNS, 5000).astype(np.uint8)
    signs[-1] = token_counts.END
    state, plain = token_counts.START, np.zeros(len(signs), bool)
    for i, sign in enumerate(signs):
        mark = marks[state, sign]
        plain[i] |= bool(mark & token_counts.HERE)
        if mark & token_counts.BEFORE:
            plain[i - 1] = True
        state = to[state, sign]
    assert (token_counts.word_marks(signs, to, marks) == plain).all()


def test_a_megabyte_without_spaces_counts_in_linear_time(machine, library):
    rng = random.Random(1)
    unit = "".join(rng.choice("ABCDEFabcdef0123456789") for _ in range(4000))
    text = "x" + "".join(c if c.isalpha() else "q" for c in unit) * 250
    begun = time.perf_counter()
    assert counts(machine, [text]) == [len(library.encode(text).ids)]
    assert time.perf_counter() - begun < 60


# Merkle manifest.


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def runs(level, fanout):
    return [level[i : i + fanout] for i in range(0, len(level), fanout)]


def tree(leaves, fanout):
    """(root, proof of each leaf as pairs of what is left and right)."""
    proofs, level, place = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(place):
            run = runs(level, fanout)[p // fanout]
            proofs[i].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
        level, place = [sha("".join(r)) for r in runs(level, fanout)], [p // fanout for p in place]
    return level[0], proofs


def fold(node, proof):
    for before, after in proof:
        node = sha(before + node + after)
    return node


def brute(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of (doc_id, source, lang, n_chars, text)."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, sha("".join(map(enc, r))), r))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    below = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: x[:3])
        below[lang] = tree([leaf for *_, leaf, _ in by_lang[lang]], fanout)
    root, tops = tree([below[lang][0] for lang in langs], fanout)
    out = []
    for lang, top in zip(langs, tops, strict=True):
        subroot, proofs = below[lang]
        for (*_, leaf, r), proof in zip(by_lang[lang], proofs, strict=True):
            bent = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            checked = sha("".join(map(enc, (*r[:3], r[3] + 1, r[4])))) if bent else leaf
            end = fold(checked, proof + top)
            out.append((r[0], leaf, subroot, root, sha("".join(a + b for a, b in proof + top)), end, end == root))
    return out


def own(spark, rows, fanout=2):
    docs = spark.createDataFrame([(*r, "x", 5, "y", "z") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, place long, hash string, members string")
    bent = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(spark, docs, merkle.COLUMNS, fanout=fanout, changed={"n_chars": F.col("n_chars") + 1}, where=bent)
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.digest(F.col("proof")).alias("d"), merkle.folded(F.col("checked"), F.col("proof")).alias("f"))
    return [(*r, r.f == r.root) for r in out.collect()]


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (3, 1), (2, 10)])
def test_manifest_equals_brute_force_over_several_rounds(spark, monkeypatch, fanout, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rng = random.Random(fanout)
    sizes = {None: 5, "": 1, "de": 33, "en": 26, "é": 2, "fr": 11}
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((i, rng.choice(["web", None]), lang, rng.choice([None, 7, i]), rng.choice([None, "", "text é", "x" * 50])))
            i += 1
    rng.shuffle(rows)
    assert sorted(map(str, own(spark, rows, fanout))) == sorted(map(str, brute(rows, fanout)))


def test_manifest_of_null_and_repeated_keys_long_texts_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = [(1, "a", "en", 3, "x")] * 5 + [(None, "a", "en", 3, "x"), (None, None, "en", None, None), (2, "a", "en", 3, "y" * 300_000), (2, "b", "en", 4, "z"), (9, None, None, None, None)]
    assert sorted(map(str, own(spark, rows))) == sorted(map(str, brute(rows)))
    assert own(spark, []) == []
    assert own(spark, rows[:1]) == brute(rows[:1])


def test_a_change_of_any_row_is_found(spark):
    rows = [(i, "a", "en", i, f"text {i}") for i in range(20)]
    verdicts = {r[0]: r[-1] for r in own(spark, rows)}
    assert verdicts == {i: zlib.crc32(str(i).encode()) % 7 != 0 for i in range(20)}
    assert False in verdicts.values()


# Fill-in-the-middle.

EDGES = [None, "", " ", "\n\t ", "a", " a", "a ", "a b", "  a  b  ", "é ü", "中文 字", "<P>", "a <S> b", "x<M", "x<M >", "<", "a <P b S> c", "<P<S<M one two", "a\xa0b c", "w " * 30_000, "x" * 30_000, "\x00 a\x1fb"]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], "doc_id long, text string, key string, form string, output string, h0 long")


def test_fim_equals_sql_on_edges_and_restores(spark):
    rng = random.Random(8)
    texts = EDGES + ["".join(rng.choice([" ", "  ", "\n", "ab", "é", "<", "P>", "S", "M>", ">"]) for _ in range(rng.randrange(12))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    out = fim.transformed(docs(spark, rows))
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].restored == (t or "") for i, t in rows)
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows])}))
    want = db.execute(fim.OP13_SQL).fetchall()
    assert len(want) == len(got)
    for i, n, form, p, m, out_sha, back_sha in want:
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), sha(r.restored)) == (n, form, p, m, out_sha, back_sha), rows[i]
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_fim_of_null_and_repeated_keys_and_nothing(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "a b c"), (3, "a b c"), (3, None), (4, "")]
    got = fim.transformed(docs(spark, rows), rate=100).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(r.form == "plain" for r in got if not r.restored)
    same = [tuple(r) for r in got if r.restored == "a b c"]
    assert len(same) == 2 and same[0] == same[1]
    assert fim.transformed(docs(spark, [])).count() == 0


@pytest.mark.parametrize("first", [0, 50, 100])
def test_fim_rate_and_order_are_parameters(spark, first):
    rows = [(i, f"one two three {i}") for i in range(60)]
    forms = {r.form for r in fim.transformed(docs(spark, rows), rate=100, suffix_first=first).collect()}
    assert forms == {0: {"psm"}, 50: {"psm", "spm"}, 100: {"spm"}}[first]


def test_token_counts_of_null_and_repeated_keys_and_nothing(spark, library):
    rows = [(None, "a b"), (None, None), (1, "x" * 20_000), (1, "x" * 20_000), (2, "")]
    got = token_counts.counted(spark, docs(spark, rows), token_counts.vocabulary()).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "").ids)) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.counted(spark, docs(spark, []), token_counts.vocabulary()).count() == 0
