"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Base kinds (email, ip, card, phone) are reported whenever their pattern and check hold; the
score only ranks them. Further kinds are reported from a score of ``LEAST`` on, which those
with a weak pattern or check reach only near a context word: addresses with a written-out at
sign, eight groups of an IPv6 address, cards of 13 digits, phone numbers without a country,
account numbers in small letters, and social security numbers. Account numbers must pass
mod-97. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import by_batch, quoted, texts

# Kinds in order of report; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "iban_small", "email_masked", "ip6", "card13", "phone_local")

# Words that make a kind more likely, and the score of a bare match.
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
CONTEXT |= {"iban_small": CONTEXT["iban"], "email_masked": CONTEXT["email"], "ip6": CONTEXT["ip"], "card13": CONTEXT["card"], "phone_local": CONTEXT["phone"]}
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
SCORE |= {"iban_small": 0.4, "email_masked": 0.4, "ip6": 0.4, "card13": 0.3, "phone_local": 0.3}
NEAR_BONUS = 0.2
#: Code points before and after a match that are searched for context words.
WINDOW = 48
#: An added kind is reported from this score on.
LEAST = 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# a match of the base pattern always starts where a run of digits starts, and takes whole runs
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# where an account number may start, and the longest run that it may be
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})")
IBAN_RUN = re.compile(r"[A-Z0-9](?: ?[A-Z0-9]){14,33}")
# characters of an account number by country
IBAN_LENGTH = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SMALL_IBAN = re.compile(r"\b[A-Za-z]{2}[0-9]{2}(?=(?: ?[A-Za-z0-9]){11})")
CAPITALS = {i: i - 32 for i in range(97, 123)}
AT = re.compile(r"[(\[]at[)\]]", re.I)
MASKED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]{1,63}){1,8}", re.I)
IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
WORD = re.compile(r"[\w-]+")
WORD_CHAR = re.compile(r"\w")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an account number; letters count from A = 10."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base pattern, found from each @ outwards in linear time."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", m.end() if m else at + 1)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length, of unlisted countries the longest that passes.

    They end where a word ends; the search goes on behind a start that fails.
    """
    m = IBAN.search(text)
    while m:
        run = IBAN_RUN.match(text, m.start())
        ends = [i + 1 for i in range(m.start(), run.end()) if text[i] != " "]
        n, end = IBAN_LENGTH.get(text[m.start() : m.start() + 2]), None
        for k in (n,) if n else range(len(ends), 14, -1):
            if k <= len(ends) and not WORD_CHAR.match(text, ends[k - 1]) and mod97(text[m.start() : ends[k - 1]].replace(" ", "")):
                end = ends[k - 1]
                break
        if end:
            yield m.start(), end
        m = IBAN.search(text, end or m.end())


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    words = {w.lower() for w in WORD.findall(near)}
    return min(1.0, SCORE[kind] + NEAR_BONUS * (not words.isdisjoint(CONTEXT[kind])))


def _proposed(text: str) -> Iterator[tuple[int, int, str]]:
    if "@" in text:
        yield from ((s, e, "email") for s, e in _emails(text))
    if AT.search(text):
        yield from ((m.start(), m.end(), "email_masked") for m in MASKED.finditer(text))
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.start(), m.end(), "ip"
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), "card" if len(digits) > 13 else "card13"
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGIT.findall(m[0])) <= 15:
                yield m.start(), m.end(), "phone"
    yield from ((s, e, "iban") for s, e in _ibans(text))
    if SMALL_IBAN.search(text):
        # where small letters stand for capitals, all letters may; offsets stay
        raised = text.translate(CAPITALS)
        yield from ((s, e, "iban_small") for s, e in _ibans(raised) if text[s:e] != raised[s:e])
    if ":" in text:
        yield from ((m.start(), m.end(), "ip6") for m in IP6.finditer(text))
    yield from ((m.start(), m.end(), "phone_local") for m in LOCAL_PHONE.finditer(text))
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.start(), m.end(), "ssn"


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of a text by start, then kind in the order of ``KINDS``."""
    found = [(s, KINDS.index(k), e, _score(text, k, s, e)) for s, e, k in _proposed(text)]
    base = [(s, e) for s, k, e, _ in sorted(found) if k < len(BASE)]
    starts = [s for s, _ in base]
    furthest = list(accumulate((e for _, e in base), max))

    def free(start: int, end: int) -> bool:
        """Whether a span lies apart from all of the base kinds."""
        k = bisect_left(starts, end)
        return k == 0 or furthest[k - 1] <= start

    return [(KINDS[k], s, e, score) for s, k, e, score in sorted(found) if k < len(BASE) or score >= LEAST and (KINDS[k] in ("iban", "ssn") or free(s, e))]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``spans``, an array of (kind, start, end, score).

    A null or empty text has no spans. Rows that repeat, and repeated or null ids, are each
    reported; an empty table gives an empty result; other columns are ignored. Texts are
    scanned whole, in time linear in their length.
    """

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find(t)] for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], names=["id", "spans"])

    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(by_batch(scan), f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return out.withColumnRenamed("id", id_col)


def _is_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def joined(spans: Column) -> Column:
    """Spans as text."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts and hash of the base kinds, all spans and their scores."""
    out = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", partial(_is_kind, kind))).cast("bigint").alias(f"n_{kind}") for kind in BASE]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.col("spans.score").alias("scores"))
