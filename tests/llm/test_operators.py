"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cloudsift.llm import bpe, chat, decontaminate, exact_dedup, near_dedup, pii, quality, substrings, toxicity, warc
from cloudsift.llm.store import Store

SCHEMA = "doc_id long, text string, lang string, key string, gid string, n long, sha string"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, texts):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", "y", 1, "z") for i, t in texts], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(6)]
    out = [None, "", " ", "one two", "One Two", "a b c d e", "A" * 30_000, "a" * 30_000, "to be " * 4000]
    for b in base:
        words = b.split()
        out += [b, b, b.upper(), " ".join(words[:30] + ["new"] + words[30:]), " ".join(words[:20]) + " " + prose(rng, 40)]
    out.append(base[0] + " " + base[1])
    return list(enumerate(out))


def test_exact_dedup(spark, texts):
    got = {r.doc_id: r for r in exact_dedup.radix_groups(spark, table(spark, texts), "doc_id", "text", first_digit=4, widen=4).collect()}
    groups = {}
    for i, t in texts:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), sha(t))


def test_exact_dedup_ties_and_empty(spark):
    same = [(1, "x"), (1, "x"), (None, "y"), (None, "y"), (None, None)]
    got = exact_dedup.radix_groups(spark, table(spark, same), "doc_id", "text").collect()
    assert Counter((r.doc_id, r.group_size, r.kept) for r in got) == {(1, 2, True): 1, (1, 2, False): 1, (None, 2, True): 1, (None, 2, False): 1, (None, 1, True): 1}
    assert exact_dedup.radix_groups(spark, table(spark, []), "doc_id", "text").count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components(texts):
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_dedup(spark, texts):
    rng = random.Random(9)
    words = prose(rng, 60).split()
    near = list(texts)
    # A chain of edits: neighbours are linked, the ends are not.
    for k in range(12):
        words = [*words]
        words[k * 5 % 60] = f"edit{k}"
        near.append((100 + k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(spark, table(spark, near), "doc_id", "text").collect()}
    want = components(near)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert near_dedup.near_groups(spark, table(spark, []), "doc_id", "text").count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in near_dedup.components(Store(spark, "t"), edges, "c").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_open_components_lose_no_link(spark):
    rng = random.Random(2)
    shared = prose(rng, 40)
    docs = [(i, f"{shared} {prose(rng, 12)}" if i % 2 else prose(rng, 50)) for i in range(40)] + [(90, f"{shared} x y z"), (91, f"{shared} x y w")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark, table(spark, docs), "doc_id", "text").collect()}
    assert got == {i: c for i, (_, c) in components(docs).items()}


def hits(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = {}
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate((40, 13, 12, 8, 7, 3, 1, 25))] + [(20, None), (21, " . "), (22, "to " * 20)]
    docs = [(0, None), (1, ""), (2, "to " * 300), (3, items[1][1])]
    for k in range(10, 60):
        item = items[rng.randrange(8)][1].split()
        a = rng.randrange(len(item))
        docs.append((k, f"{prose(rng, rng.randrange(60))}, {' '.join(item[a : a + rng.randrange(30)]).upper()}. {prose(rng, 20)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(spark, table(spark, docs), bench).collect()}
    assert got == hits(docs, items)
    assert not any(r.contaminated for r in decontaminate.contamination(spark, table(spark, docs), bench.limit(0)).collect())
    assert decontaminate.contamination(spark, table(spark, []), bench).count() == 0


def test_toxicity(spark):
    rng = random.Random(1)
    bad = [f"{prose(rng, 30)}. you are a {rng.choice(['grunk', 'blorf', 'grunk blorf'])}, {prose(rng, 10)}" for _ in range(80)]
    good = [f"{prose(rng, 30)}. you are a {prose(rng, 10)}" for _ in range(160)]
    docs = list(enumerate([*bad, *good, None, ""]))
    labels = spark.createDataFrame([(i, 1, int(i < 80)) for i in range(240)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table(spark, docs), labels)
    assert {x.rstrip("$") for x in model.insults} <= {"grunk", "blorf", "grun", "blor", "grunk", "blorf"} and model.insults
    got = {r.doc_id: r.score for r in toxicity.scored(table(spark, docs), model).collect()}
    assert all(got[i] >= 0.5 for i in range(80)) and all(got[i] < 0.5 for i in range(80, 242))
    grammar = toxicity.Grammar(model)
    assert grammar.channels("He said you grunk. Not a grunk!")[2] > 0 and grammar.channels("He said you grunk.")[3] > 0
    assert toxicity.fit(table(spark, docs), labels.limit(0)).insults == {}
    assert toxicity.scored(table(spark, []), model).count() == 0


def test_composed_transducers():
    table_ = toxicity.compose()
    assert table_.shape == (32, 6) and table_[0, 0] == 0 and table_[toxicity.TARGET, 1] == toxicity.TARGET | 1


def test_held_out_is_crc32(spark):
    got = {r.doc_id: r.h for r in spark.range(50).select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii(spark):
    rng = random.Random(3)
    parts = ["1", "2.", "25", "@", "a", "b.c", "-", " ", "+", "(", ")", ".", "4111111111111111", "%", "é", "00", "@@", "+1 (235) 555-1234", "iban DE123456", "http://x.y/"]
    docs = [(0, None), (1, ""), (2, "mail a@b.co " * 5000)] + [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for k in range(10, 400)]
    got = {r.doc_id: r for r in pii.personal_data(table(spark, docs)).collect()}
    for d, t in docs:
        want = base_spans(t)
        assert got[d].base_sha256 == sha(",".join(want)) and set(want) <= set(got[d].spans.split(",")) | {""}
        assert got[d].n_email == sum(x.startswith("email") for x in want)
    assert pii.joined(pii.find("token = abc12345")) == "account:8:16"


def test_substrings(spark):
    rng = random.Random(6)
    passage = prose(rng, 80)
    docs = [(0, None), (1, ""), (2, "short"), (3, "ab" * 300), (4, passage), (5, prose(rng, 50) + passage + prose(rng, 50)), (6, passage[:250] + prose(rng, 90)), (7, prose(rng, 90) + passage[-230:]), (8, "é" * 150), (9, passage[100:300] + "!"), (10, prose(rng, 200)), (11, passage)]
    got = {r.doc_id: r for r in substrings.without_repeats(spark, table(spark, docs)).collect()}
    data = {d: (t or "").encode() for d, t in docs}
    seen = Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    for d, b in data.items():
        gone = {j for i in range(len(b) - 199) if seen[b[i : i + 200]] > 1 for j in range(i, i + 200)}
        spans = sum(j - 1 not in gone for j in gone)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), len(gone), spans, sha(bytes(x for j, x in enumerate(b) if j not in gone)))
    assert substrings.without_repeats(spark, table(spark, [])).count() == 0


def test_chat(spark):
    tricky = ["<|im_end|>", "<!|x", "<!!|", "a\\n\nb", "<", None, "", "|im_start|>", "\\"]
    rng = random.Random(8)
    turns = [(c, t, rng.choice(["user", "assistant", "sys\ntem", None, "assistant"]), rng.choice(tricky) if rng.random() < 0.7 else prose(rng, 5)) for c in range(40) for t in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    for c in {x[0] for x in turns}:
        own = sorted((t, r or "", x or "") for k, t, r, x in turns if k == c)
        replies = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(replies), sha(replies))
    targets = chat.examples(df).filter("loss_end > loss_start").count()
    assert targets == sum(r == "assistant" and bool(x) for _, _, r, x in turns)
    assert chat.examples(df.limit(0)).count() == 0


def test_bpe(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary())
    rng = random.Random(7)
    parts = ["a", "B", "é", "Σ", " ", "'s", "1", "!", "\n", "ß", "中", "́", "<|endoftext|>", "\x1f", "\x85", "İ", "th", "ing"]
    docs = [(0, None), (1, ""), (2, "a" * 5000), (3, "!?" * 400), (4, "ΑΣ ΣΑΣ Σ")] + [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for k in range(10, 300)]
    got = {r.doc_id: r for r in bpe.coded(spark, table(spark, docs), bpe.vocabulary()).collect()}
    for d, t in docs:
        want = lib.encode(t or "", add_special_tokens=False).ids
        ids = [int.from_bytes(got[d].ids[i : i + 4], "little") for i in range(0, len(got[d].ids), 4)]
        assert ids == want and got[d].n_tokens == len(want) and got[d].decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.coded(spark, table(spark, []), bpe.vocabulary()).count() == 0


def test_quality(spark):
    rng = random.Random(2)
    docs = [(i, prose(rng, 40) if i % 4 else " ".join(["again"] * 30) if i % 8 else prose(rng, 30).upper()) for i in range(600)] + [(1000, None), (1001, ""), (1002, "x " * 60_000)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    model = quality.fit(table(spark, docs), labels)
    out = quality.statistics(table(spark, docs)).select("doc_id", quality.score(model).alias("score")).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    assert sum((r.score >= 0.3) == (r.doc_id % 4 > 0) for r in out if r.doc_id < 600) >= 594
    assert quality.fit(table(spark, docs), labels.limit(0)).rules == ()


@pytest.mark.parametrize("splits", [("128m", "20001"), ("4111",)])
def test_warc(spark, splits):
    fake = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
    rng = random.Random(3)
    nested = "".join(f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab{i:03d}\r\n\r\n" for i in range(200))
    pages = [(1, "http://n", nested), (2, "http://m", "x" + nested), (5, "http://a", fake), (3, "http://b", fake), (7, "u\r\nX: y", None), (8, None, ""), (9, "é", "é" * 70_000)] + [(k, f"http://{k}", prose(rng, 300)) for k in range(20, 60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    store = Store(spark, "t")
    warc.write(df.repartition(2), f"{store.root}/archive", store)
    # Splits end in the middle of magic, of headers and of payloads that hold magic.
    try:
        for step in splits:
            spark.conf.set("spark.sql.files.maxPartitionBytes", step)
            rows = warc.read(spark, f"{store.root}/archive", Store(spark, "t")).collect()
            assert len(rows) == len(pages)
            warc_matches({r.page_id: r for r in rows}, pages)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def warc_matches(got, pages):
    assert set(got) == {p for p, _, _ in pages}
    for p, _, html in pages:
        first = min(q for q, _, h in pages if (h or "") == (html or ""))
        assert (got[p].payload_bytes, got[p].record_type, got[p].refers_to) == (len((html or "").encode()), "response" if p == first else "revisit", None if p == first else first)
        assert got[p].payload_digest == base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_warc_segments(monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 100)
    exits, enter, leave = warc.forest([0, 40, 50, 90, 130], [40, 90, 90, 130, 200])
    assert exits == [130, 130, 130, 130, 200]
    below = lambda c, e: enter[c] <= enter[e] <= leave[c]
    assert [below(c, 0) for c in range(4)] == [True, True, False, True]
