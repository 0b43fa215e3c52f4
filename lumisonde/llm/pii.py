"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Every matcher below is linear in the text. Where a plain pattern would restart at
each character of a long run, the code starts at the run's only possible start.

Defined cases: a null text counts as empty and has no spans; empty text likewise;
repeated rows each get their own result; an empty table gives an empty table; all
columns of the input besides the text are carried unchanged by ``annotate`` and
``redact`` (whose own columns take fresh names if the input has such names).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisonde.llm.common import fresh

#: Spans of the first four kinds are always kept once their validator passes.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}|[a-z]{2}[0-9]{2}(?:\x20?[a-z0-9]){11,30})(?![A-Za-z0-9])")
#: Characters of an account number by country, as registered under ISO 13616.
IBAN_SIZES = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 "
        "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
        "MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 "
        "SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])"
    r"|(?i:token|secret|api_?key|password)[^A-Za-z0-9\n]{1,8}[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])"
)

#: Words that raise a span's score when they stand within CONTEXT characters before it.
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("key", "token", "secret", "password"),
}
CONTEXT = 48
#: Score of a confirmed span without context; context adds BOOST; spans of the later kinds need ACCEPT.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.9}
BOOST, ACCEPT = 0.2, 0.5

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType(), False),
            T.StructField("start", T.IntegerType(), False),
            T.StructField("end", T.IntegerType(), False),
            T.StructField("score", T.DoubleType(), False),
        ]
    )
)


def luhn(digits: str) -> bool:
    """Luhn's check over a string of digits."""
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        x = 2 * int(d)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of ISO 13616 for an account number without spaces."""
    return int("".join(str(int(ch, 36)) for ch in code[4:] + code[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, leftmost first: the local part is the whole run before an @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_END:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers, also where a word or number follows: the prefix of a match that ends at a group and that mod 97 confirms.

    The country's length goes first, then, in capitals, the longest. Lower-case words follow
    too often for that, so there only the country's length counts.
    """
    m = IBAN.search(text)
    while m:
        ends = [k for k in range(15, len(m[0]) + 1) if m[0][k : k + 1] in ("", " ")][::-1]
        codes = {k: c for k in ends if 15 <= len(c := m[0][:k].replace(" ", "").upper()) <= 34}
        known = [k for k, c in codes.items() if len(c) == IBAN_SIZES.get(c[:2])]
        end = next((k for k in known + [k for k in codes if m[0][0].isupper()] if mod97(codes[k])), 0)
        if end:
            yield m.start(), m.start() + end
        m = IBAN.search(text, m.start() + (end or 1))


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """All spans whose validator passes, kind by kind, each kind from left to right."""
    for s, e in emails(text):
        yield "email", s, e
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for s, e in ibans(text):
        yield "iban", s, e
    if "-" in text:
        for m in SSN.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                yield "ssn", m.start(), m.end()
    for m in SECRET.finditer(text):
        yield "secret", m.start(), m.end()


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, ordered by kind as in KINDS, then start."""
    out = []
    for kind, s, e in propose(text or ""):
        before = text[max(0, s - CONTEXT) : s].lower()
        score = min(1.0, PRIOR[kind] + BOOST * any(w in before for w in CONTEXT_WORDS[kind]))
        if kind in BASE or score >= ACCEPT:
            out.append((kind, s, e, score))
    return out


@F.pandas_udf(SPANS)
def spans_of(texts: pd.Series) -> pd.Series:
    return pd.Series([find_spans(t) for t in texts])


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    spans = sorted((s, -e, k) for k, s, e, _ in find_spans(text))
    if not spans:
        return text
    out, done = [], 0
    for s, e, kind in spans:
        if s >= done:
            out += [text[done:s], f"<{kind}>"]
        done = max(done, -e)
    return "".join(out) + text[done:]


@F.pandas_udf(T.StringType())
def masked(texts: pd.Series) -> pd.Series:
    return pd.Series([mask(t) for t in texts], dtype=object)


def annotate(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """docs with an array of spans (kind, start, end, score) per row."""
    return docs.withColumn(fresh(docs, into)[0], spans_of(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data replaced in the text; null stays null. n_chars, where present, follows the text."""
    out = docs.withColumn(text, masked(F.col(text)))
    return out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


COUNTS = [f"n_{k}" for k in BASE]
DIGEST = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")])


@F.pandas_udf(DIGEST)
def digest_of(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        found = find_spans(t)
        said = [f"{k}:{s}:{e}" for k, s, e, _ in found]
        counts = [sum(x[0] == k for x in found) for k in BASE]
        base = ",".join(said[: sum(counts)])
        rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
    return pd.DataFrame(rows, columns=[*COUNTS, "base_sha256", "spans"])


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts and positions of its spans, as the query reports them."""
    return docs.select("doc_id", digest_of("text").alias("d")).select("doc_id", "d.*")
