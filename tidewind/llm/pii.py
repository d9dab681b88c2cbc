"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base spans are fixed by plain patterns (email, ip, card, phone; see base()). The method proposes more: cards and phones that stand right
beside other digits, spelled-out emails, IBANs, national numbers and secrets (keys and tokens, which need a word nearby). A proposal is dropped if its checksum is wrong (Luhn, mod 97) or if
it overlaps a span of its kind; it starts with its kind's score, words nearby raise it, and it counts from THRESHOLD on. Base spans stay
whatever their score. Each pattern reads a text in a time that is linear in its length.

Defined results: a null or empty text has no spans; offsets are code points, the end exclusive; a row is treated by itself, so repeated
rows, null identifiers and other columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import by_rows, columns, table

#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
THRESHOLD = 0.5
#: Code points on either side of a proposal in which context words count.
NEARBY = 48
#: What a context word adds to the score, and what a word that speaks against it takes away.
RAISE, LOWER = 0.3, 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
#: Characters of an IBAN by country (fixed values of the registry); those of other countries may have any number.
_IBAN_LENGTH = dict(
    x.split(":")
    for x in "NO:15 BE:16 DK:18 FI:18 FO:18 GL:18 NL:18 MK:19 SI:19 AT:20 BA:20 EE:20 KZ:20 LT:20 LU:20 XK:20 CH:21 HR:21 LI:21 LV:21 BG:22 BH:22 CR:22 DE:22 GB:22 GE:22 IE:22 ME:22 RS:22 VA:22 AE:23 GI:23 IL:23 IQ:23 "
    "TL:23 AD:24 CZ:24 ES:24 MD:24 PK:24 RO:24 SA:24 SE:24 SK:24 TN:24 VG:24 PT:25 IS:26 TR:26 FR:27 GR:27 IT:27 MC:27 MR:27 SM:27 AL:28 AZ:28 CY:28 DO:28 GT:28 HU:28 LB:28 PL:28 BR:29 PS:29 QA:29 JO:30 KW:30 MU:30 MT:31".split()
)

#: kind, score, pattern, words that raise the score, words that lower it.
_MORE = (
    ("email", 0.5, re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+ ?[(\[{](?:at|AT)[)\]}] ?[A-Za-z0-9-]{1,63}+(?: ?[(\[{](?:dot|DOT)[)\]}] ?[A-Za-z0-9-]{1,63}+){1,6}"), r"e-?mail|contact|write|reach", r"$^"),
    ("card", 0.6, re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"), r"card|visa|master|amex|credit|debit|carte|karte|tarjeta", r"isbn|order|invoice|tracking|serial|sku"),
    ("phone", 0.6, re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"), r"tel|phone|call|mobile|fax|cell|whatsapp", r"isbn|order|version"),
    ("phone", 0.3, re.compile(r"(?<![0-9+(.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"), r"tel|phone|call|mobile|fax|cell|whatsapp", r"isbn|order|version|invoice"),
    ("iban", 0.7, _IBAN, r"iban|account|bank|konto|compte|cuenta", r"$^"),
    ("secret", 0.3, re.compile(r"(?<![0-9A-Za-z+/_=-])(?=[0-9+/_-]{0,40}+[A-Za-z])(?=[A-Za-z+/_-]{0,40}+[0-9])[A-Za-z0-9+/_-]{20,200}+={0,2}(?![0-9A-Za-z+/_-])"), r"(?<![a-z])(?:api[ _-]?key|key|token|secret|passw(?:or)?d|pwd|bearer|credential|auth)s?\W{0,6}$|(?:key|token|secret|password)[\"']?\s*[:=]\s*[\"']?$", r"$^"),
    ("ssn", 0.4, re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"), r"ssn|social|security|taxpayer", r"phone|tel|part|order"),
)
_WORDS = {(kind, k): (re.compile(up, re.I), re.compile(down, re.I)) for k, (kind, _, _, up, down) in enumerate(_MORE)}
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base(text: str) -> list[tuple[str, int, int]]:
    """The base spans, leftmost and without overlaps in each kind; a match that fails its check is dropped and not tried again."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers with a right checksum. What follows a number may look like more of it: the country's length goes first, then what ends with a word."""
    at = 0
    while m := _IBAN.search(text, at):
        a, b = m.span()
        own = int(_IBAN_LENGTH.get(m[0][:2], 0))
        borders = [e for e in range(b, a + 14, -1) if text[e - 1] != " " and not text[e : e + 1].isalnum()]
        ends = [e for e in borders if len(text[a:e].replace(" ", "")) == own] if own else borders
        at = next((e for e in (*ends, b) if mod97(text[a:e])), 0)
        if at:
            yield a, at
        else:
            at = a + 4


def _proposals(kind: str, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    if kind == "iban":
        yield from _ibans(text)
        return
    for m in pattern.finditer(text):
        if _valid(kind, m[0]):
            yield m.span()


def _valid(kind: str, span: str) -> bool:
    digits = "".join(_DIGITS.findall(span))
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def spans(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """kind, start, end, score, whether it is a base span; by start, then by kind."""
    if not text:
        return []
    own = base(text)
    taken: dict[str, list[tuple[int, int]]] = {}
    for kind, a, b in own:
        taken.setdefault(kind, []).append((a, b))
    out = [(kind, a, b, 1.0, True) for kind, a, b in own]
    digits = bool(_DIGITS.search(text))
    for k, (kind, score, pattern, _, _) in enumerate(_MORE):
        if not digits and kind != "email" or kind == "email" and "at" not in text and "AT" not in text:
            continue
        up, down = _WORDS[kind, k]
        added = []
        for a, b in _proposals(kind, pattern, text):
            if _overlaps(taken.get(kind, []), a, b):
                continue
            near = text[max(0, a - NEARBY) : a] + (" " + text[b : b + NEARBY] if kind != "secret" else "")  # a secret's word stands before it
            now = min(1.0, max(0.0, score + RAISE * bool(up.search(near)) - LOWER * bool(down.search(near))))
            if now >= THRESHOLD:
                added.append((a, b))
                out.append((kind, a, b, now, False))
        if added:
            taken[kind] = sorted(taken.get(kind, []) + added)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _overlaps(sorted_spans: list[tuple[int, int]], a: int, b: int) -> bool:
    lo, hi = 0, len(sorted_spans)
    while lo < hi:  # the first span that ends after a
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if sorted_spans[mid][1] <= a else (lo, mid)
    return lo < len(sorted_spans) and sorted_spans[lo][0] < b


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind; of spans that overlap, the first is named."""
    if not text:
        return text
    out, last = [], 0
    for kind, a, b, _, _ in spans(text):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end, score, base) and the redacted text of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("kind", "start", "end", "score", "base")
        for pdf in batches:
            # read once: the redacted text follows from the spans
            found = [[dict(zip(names, s, strict=True)) for s in spans(t)] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": found, "redacted": [redact(t) if s else t for t, s in zip(pdf["text"], found, strict=True)]})

    rows = columns(docs, doc_id=id_col, text=text_col)
    return by_rows(rows, run, "spans array<struct<kind: string, start: int, end: int, score: double, base: boolean>>, redacted string")


def joined(found: list) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in found)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_spans (of all kinds)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {"doc_id": pdf["doc_id"]}
            own = [[s for s in found if s["base"]] for found in pdf["spans"]]
            for kind in KINDS[:4]:
                out[f"n_{kind}"] = [sum(s["kind"] == kind for s in found) for found in own]
            out["base_sha256"] = [hashlib.sha256(joined(found).encode()).hexdigest() for found in own]
            out["spans"] = [joined(found) for found in pdf["spans"]]
            out["n_spans"] = [len(found) for found in pdf["spans"]]
            yield pd.DataFrame(out)

    found = find_pii(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    return by_rows(found, run, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint")
