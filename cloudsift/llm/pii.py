"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and cue words
for identifiers. A small deterministic parser for each anchor expands it to its boundaries and checks
it: nothing else of the text is looked at. The base kinds (email, ip, card, phone) are leftmost and do
not overlap within a kind; a candidate that fails its check is dropped, and the search goes on behind
it. The cues add spans of the kinds url, account and address. Positions are code points, ends exclusive.

Cues of accounts expand over the whole run that follows, however long, and each has a check of its own:
IBANs (also in groups of four) must pass mod 97, social security numbers have their three groups, secrets
must be assigned by a sign, other numbers are mostly digits. Street words expand to the house number and
the name around them.

A null text is empty and has no spans. Texts are read whole, however long. Repeated rows have equal
spans, each on its own; a null key stays null. Other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.llm.bpe import texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "address")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
#: Words before an identifier, in lower case, by what follows them.
CUES = {
    "secret": ("password", "passwd", "token", "api_key", "apikey", "secret"),
    "number": ("passport", "account", "konto", "compte", "cuenta"),
    "iban": ("iban",),
    "ssn": ("ssn",),
}
#: Words of streets that stand behind a name (Elm Street), end one (Lindenstraße) or stand before it (rue de Paris).
STREETS = {"behind": ("Street", "Avenue", "Road", "Lane", "Boulevard"), "ending": ("straße", "strasse", "gasse"), "before": ("rue", "Rue", "calle", "Calle")}

LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\s\"'<>]+")
#: What follows a cue: at most two words and a sign or space, then the whole run of the identifier.
SECRET = re.compile(r"\s*[\"']?\s*[:=]\s*[\"']?(\S+?)(?=[\"'\s,;]|$)")
NUMBER = re.compile(r"(?:\s+[^\W\d_]{1,10}\.?){0,2}\s*[:=#]?\s*#?\s*([A-Za-z0-9][A-Za-z0-9-]*)(?![A-Za-z0-9_])")
IBAN = re.compile(r"(?:\s+[^\W\d_]{1,10}\.?){0,2}\s*[:=#]?\s*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
SSN = re.compile(r"(?:\s+[^\W\d_]{1,10}\.?){0,2}\s*[:=#]?\s*((?!000|666|9)[0-9]{3}([-\x20]?)(?!00)[0-9]{2}\2(?!0000)[0-9]{4})(?![0-9-])")
NAME = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*"
BEHIND = re.compile(rf"([0-9]{{1,5}}[A-Za-z]?\x20(?:{NAME}\x20){{1,3}})$")
ENDING = re.compile(r"\x20[0-9]{1,4}[a-z]?(?![0-9A-Za-z])")
BEFORE = re.compile(rf"\x20(?:(?:de|du|des|la|le|les|del|los|las)\x20){{0,2}}{NAME}(?:\x20{NAME}){{0,2}}(,?\x20[0-9]{{1,4}}(?![0-9A-Za-z]))?")
KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchors with the kind of parser that each calls."""
    found = ahocorasick.Automaton()
    for sign in "0123456789":
        found.add_word(sign, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for word in SCHEMES:
        found.add_word(word, ("scheme", len(word)))
    for kind, words in CUES.items():
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.add_word("AKIA", ("key", 4))
    for kind, words in STREETS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """The check of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    """The check of IBANs: the first four signs go last, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def account(kind: str, text: str, at: int, end: int) -> tuple[int, int] | None:
    """The identifier that a cue at [at, end) announces, if it passes its kind's check."""
    if at and text[at - 1].isalnum():
        return None
    if kind == "key":
        return (m := KEY_ID.match(text, at)) and m.span()
    m = {"secret": SECRET, "number": NUMBER, "iban": IBAN, "ssn": SSN}[kind].match(text, end)
    if not m:
        return None
    value, digits = m[1], sum("0" <= c <= "9" for c in m[1])
    if kind == "secret":
        fits = len(value) >= 6 and digits > 0
    elif kind == "number":
        fits = digits >= 6 and 2 * digits >= len(value)
    else:
        fits = kind == "ssn"
        # Groups of a longer text may follow: the longest whole run that passes, of at most 34 signs.
        stop = len(value)
        while kind == "iban" and stop > 0 and not fits:
            fits = 15 <= len(own := value[:stop].replace(" ", "")) <= 34 and mod_97(own)
            if fits:
                return m.start(1), m.start(1) + stop
            stop = value.rfind(" ", 0, stop)
    return m.span(1) if fits else None


def address(kind: str, text: str, at: int, end: int) -> tuple[int, int] | None:
    """The street address around a street's word at [at, end), with its house number."""
    if kind == "behind":
        m = BEHIND.search(text, max(at - 80, 0), at)
        return (m.start(1), end) if m and not text[end : end + 1].isalnum() and not text[m.start(1) - 1 : m.start(1)].isalnum() else None
    if kind == "ending":
        start = at
        while start and (text[start - 1].isalpha() or text[start - 1] == "-"):
            start -= 1
        m = ENDING.match(text, end)
        return (start, m.end()) if m and text[start].isupper() else None
    m = BEFORE.match(text, end)
    if not m or at and text[at - 1].isalnum():
        return None
    if m[1]:
        return at, m.end()
    before = re.compile(r"(?<![0-9])[0-9]{1,4},?\x20$").search(text, max(at - 7, 0), at)
    return (before.start(), m.end()) if before else None


def digits_of(text: str) -> str:
    """Its ASCII digits."""
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), by start and then kind."""
    out: list[tuple[int, int, str]] = []
    #: Where each kind's last candidate ended, whether it held or not.
    after = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            # Only a run's first digit starts a number.
            if at and "0" <= text[at - 1] <= "9":
                continue
            if at >= after["ip"] and (m := IP.match(text, at)):
                after["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append((at, m.end(), "ip"))
            if at >= after["card"] and (m := CARD.match(text, at)):
                after["card"] = m.end()
                if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                    out.append((at, m.end(), "card"))
        elif kind == "plus":
            if at >= after["phone"] and (m := PHONE.match(text, at)):
                after["phone"] = m.end()
                if 10 <= len(digits_of(m[0])) <= 15:
                    out.append((at, m.end(), "phone"))
        elif kind == "at":
            start = at
            while start > after["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                after["email"] = m.end()
                out.append((start, m.end(), "email"))
        elif kind == "scheme":
            if at >= after["url"] and (m := URL.match(text, last + 1)):
                after["url"] = m.end()
                out.append((at, m.end(), "url"))
        elif kind in STREETS:
            if at >= after["address"] and (span := address(kind, text, at, last + 1)) and span[0] >= after["address"]:
                after["address"] = span[1]
                out.append((*span, "address"))
        elif at >= after["account"] and (span := account(kind, text, at, last + 1)):
            after["account"] = span[1]
            out.append((*span, "account"))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[0], order[x[2]], x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, one count for each base kind, digest of the base spans, all spans)."""
    for batch in batches:
        counts, digests, spans = {k: [] for k in BASE}, [], []
        for text in texts(batch.column(1)):
            found = find(text)
            base = [x for x in found if x[2] in BASE]
            for k in BASE:
                counts[k].append(sum(x[2] == k for x in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["key", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def personal_data(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string").withColumnRenamed("key", key)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
