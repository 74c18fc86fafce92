"""Operator 5: format-preserving pseudonyms for personal data.

Found and validated: e-mail addresses, telephone numbers with a country code or a bracketed or grouped area code,
payment cards (13 to 19 digits that pass the Luhn test), IPv4 addresses (four bytes), social security numbers (valid
areas), IBANs (remainder 1 by 97), calendar dates in numbers, and secrets (long hexadecimal or base-64 values after
words such as token or key). What fails its test stays as it is.

A value is permuted by a keyed Feistel network over its own symbols: in each round one half of the symbols is shifted,
each within its own alphabet, by a keyed hash of the other half. Digits stay digits, letters stay letters of their case
and block, signs stay; check digits are computed anew, dates are walked to the next valid date, so the result is valid
in the same format. It is a bijection of each format, and separators aren't part of the value: equal values get
equal pseudonyms in all documents, and different ones differ. Without the key it can't be undone.

Null texts stay null with no finds; repeated rows are answered once each; other columns are left as they are.
"""

from __future__ import annotations

import datetime
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The key of the registered queries; a deployment passes its own.
KEY = b"tidemark demonstration key"
KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "date", "secret")

#: Blocks of letters that may stand for each other, besides ASCII digits and letters.
_BLOCKS = [range(0xE0, 0xF7), range(0xF8, 0x100), range(0xC0, 0xD7), range(0xD8, 0xDF), range(0x3B1, 0x3C2), range(0x430, 0x450), range(0x4E00, 0x9FA6)]


def _block(c: str) -> tuple[int, int]:
    """First code point and size of the alphabet of a character; size 1 if it stays."""
    if "0" <= c <= "9":
        return 48, 10
    if "a" <= c <= "z":
        return 97, 26
    if "A" <= c <= "Z":
        return 65, 26
    o = ord(c)
    return next(((b.start, len(b)) for b in _BLOCKS if o in b), (o, 1))


def feistel(values: list[int], radices: list[int], key: bytes, kind: str) -> list[int]:
    """A keyed bijection of mixed-radix numbers of equal radices."""
    n, out = len(values), list(values)
    cut = (n + 1) // 2
    halves = (list(range(cut)), list(range(cut, n)))
    for r in range(ROUNDS):
        to, by = halves[r % 2], halves[1 - r % 2]
        seen = f"{kind}|{n}|{r}|{','.join(str(out[i]) for i in by)}|{','.join(map(str, radices))}".encode()
        for k, i in enumerate(to):
            if k % 16 == 0:
                stream = hashlib.blake2b(seen + k.to_bytes(4, "little"), key=key[:64], digest_size=64).digest()
            out[i] = (out[i] + int.from_bytes(stream[4 * (k % 16) : 4 * (k % 16) + 4], "little")) % radices[i]
    return out


def permute_text(text: str, key: bytes, kind: str) -> str:
    """The letters and digits of a text permuted within their alphabets."""
    blocks = [_block(c) for c in text]
    at = [i for i, b in enumerate(blocks) if b[1] > 1]
    new = feistel([ord(text[i]) - blocks[i][0] for i in at], [blocks[i][1] for i in at], key, kind)
    out = list(text)
    for i, v in zip(at, new, strict=True):
        out[i] = chr(blocks[i][0] + v)
    return "".join(out)


def _digits(text: str, new: str) -> str:
    """text with its digits replaced in order."""
    it = iter(new)
    return "".join(next(it) if "0" <= c <= "9" else c for c in text)


def luhn_digit(head: str) -> str:
    """The check digit after the digits of head."""
    total = 0
    for i, c in enumerate(reversed(head)):
        d = ord(c) - 48
        total += d if i % 2 else 2 * d - 9 if d > 4 else 2 * d
    return str(-total % 10)


def _card(text: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    head = permute_text(d[:-1], key, "card")
    return _digits(text, head + luhn_digit(head))


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    return ".".join(map(str, feistel([int(p) for p in parts], [256] * 4, key, "ip")))


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(text: str, key: bytes) -> str | None:
    d = text.replace("-", "")
    if not _ssn_ok(d):
        return None
    while not _ssn_ok(d := permute_text(d, key, "ssn")):
        pass
    return f"{d[:3]}-{d[3:5]}-{d[5:]}"


def _remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(text: str, key: bytes) -> str | None:
    s = re.sub(r"[ -]", "", text)
    if not 15 <= len(s) <= 34 or _remainder(s) != 1:
        return None
    body = permute_text(s[4:], key, "iban" + s[:2])
    new = iter(f"{s[:2]}{98 - _remainder(s[:2] + '00' + body):02d}{body}")
    return "".join(next(new) if c.isalnum() else c for c in text)


_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def _date(text: str, key: bytes) -> str | None:
    parts = re.findall(r"\d+", text)
    iso = len(parts[0]) == 4
    y, b, c = (parts[0], parts[1], parts[2]) if iso else (parts[2], parts[0], parts[1])
    american = not iso and "/" in text and int(b) <= 12
    month, day = (int(b), int(c)) if iso or american else (int(c), int(b))
    try:
        n = datetime.date(int(y), month, day).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= n < _DAYS:
        return None
    while True:
        n = int("".join(map(str, feistel([int(x) for x in f"{n:05d}"], [10] * 5, key, "date"))))
        if n < _DAYS:
            break
    new = datetime.date.fromordinal(_FIRST + n)
    pair = (new.month, new.day) if iso or american else (new.day, new.month)
    sign = re.search(r"\D", text)[0]
    a, d = f"{pair[0]:02d}", f"{pair[1]:02d}"
    return sign.join([f"{new.year:04d}", a, d] if iso else [a, d, f"{new.year:04d}"])


def _secret(text: str, key: bytes) -> str:
    """Hexadecimal stays hexadecimal."""
    for digits in ("0123456789abcdef", "0123456789ABCDEF"):
        if set(text) <= set(digits):
            return "".join(digits[v] for v in feistel([digits.index(c) for c in text], [16] * len(text), key, "hex"))
    return permute_text(text, key, "secret")


def _phone(text: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", text)
    if not 7 <= len(d) <= 15:
        return None
    code = re.match(r"\+(\d{1,3})(?=\D)", text)
    keep = code[1] if code else ""
    return _digits(text, keep + permute_text(d[len(keep) :], key, "phone"))


#: Tried at each run of digits, in this order; the first that matches and is valid counts.
_FORMATS = [
    ("ip", 0, re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"), _ip),
    ("date", 0, re.compile(r"(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\w]|[-/.]\d)"), _date),
    ("ssn", 0, re.compile(r"\d{3}-\d{2}-\d{4}(?![\w]|-\d)"), _ssn),
    ("card", 0, re.compile(r"\d{13,19}(?!\w)|\d{4}(?:([ -])\d{4})(?:\1\d{4}){1,2}(?:\1\d{1,3})?(?![\w])|\d{4}([ -])\d{6}\2\d{5}(?!\w)"), _card),
    ("phone", 1, re.compile(r"\+1[ .-]?(?:\(\d{3}\)[ .-]?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?!\w)"), _phone),
    ("phone", 1, re.compile(r"\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)"), _phone),
    ("phone", 1, re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,5}(?:[ -]\d{2,5}){0,4}(?![\w]|\.\d)"), _phone),
    ("phone", 1, re.compile(r"\(\d{2,5}\)[ .-]?\d{2,5}(?:[ -]\d{2,5}){1,3}(?![\w]|\.\d)"), _phone),
    ("phone", 0, re.compile(r"\d{3}([-.])\d{3}\1\d{4}(?![\w]|[-.]\d)"), _phone),
]
_DIGITS = re.compile(r"[0-9]+")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_LOCAL = re.compile(r"[\w.+%'-]{1,64}\Z")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")
_SECRET = re.compile(r"\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)\b\s*[:=]\s*[\"']?([A-Za-z0-9+/_=-]{16,})", re.I)


def _emails(text: str, key: bytes):
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if local and domain:
            start = local.start()
            while start < at and text[start] in ".'-+%":
                start += 1
            if start < at:
                labels = domain[0].split(".")
                own = ".".join(permute_text(x.lower(), key, "domain") for x in labels[:-2])
                name = permute_text(text[start:at], key, "email")
                yield start, domain.end(), "email", f"{name}@{own + '.' if own else ''}{'.'.join(labels[-2:])}"
        at = text.find("@", at + 1)


def finds(text: str, key: bytes = KEY) -> list[tuple[int, int, str, str]]:
    """All finds in order, not overlapping: start, end, kind, replacement."""
    found = list(_emails(text, key)) if "@" in text else []
    if _DIGITS.search(text):
        for m in _SECRET.finditer(text):
            if re.search(r"\d", m[1]) and re.search(r"[A-Za-z]", m[1]):
                found.append((m.start(1), m.end(1), "secret", _secret(m[1], key)))
        taken, end = sorted(found), 0
        k = 0
        for m in _DIGITS.finditer(text):
            at = m.start()
            if at < end:
                continue
            while k < len(taken) and taken[k][1] <= at:
                k += 1
            if k < len(taken) and taken[k][0] <= at:
                continue
            if at >= 2 and m.end() - at >= 2 and text[at - 2 : at].isascii() and text[at - 2 : at].isupper() and (iban := _IBAN.match(text, at - 2)) and (at < 3 or not text[at - 3].isalnum()):
                new = _iban(iban[0], key)
                if new is not None:
                    found.append((iban.start(), iban.end(), "iban", new))
                    end = iban.end()
                    continue
            before = text[at - 1] if at else " "
            if before.isalnum() or before in "_":
                continue
            for kind, back, pattern, replaced in _FORMATS:
                start = at - back
                if start < end or back and before not in "+(" or not back and before == "." and at >= 2 and text[at - 2].isdigit():
                    continue
                hit = pattern.match(text, start)
                if hit is None or back and start and (text[start - 1].isalnum() or text[start - 1] in "+("):
                    continue
                new = replaced(hit[0], key)
                if new is not None:
                    found.append((start, hit.end(), kind, new))
                    end = hit.end()
                    break
    found.sort()
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def rewritten(text: str | None, key: bytes = KEY) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """The text with pseudonyms, and the finds."""
    if not text:
        return text, []
    found = finds(text, key)
    if not found:
        return text, found
    parts, at = [], 0
    for start, end, _, new in found:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), found


def pseudonymise(docs: DataFrame, text: str = "text", key: bytes = KEY, counts: bool = False) -> DataFrame:
    """docs with pseudonyms in the text column and, with counts, a column n_<kind> for each kind of find. Narrow."""
    names, place = docs.columns, docs.columns.index(text)
    schema = docs.schema.simpleString()[7:-1] + "".join(f",n_{k}:int" for k in KINDS) * counts

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                done = [rewritten(x, key) for x in part.column(place).to_pylist()]
                columns = list(part.columns)
                columns[place] = pa.array([x[0] for x in done], part.schema.field(place).type)
                if counts:
                    columns += [pa.array([sum(f[2] == k for f in x[1]) for x in done], pa.int32()) for k in KINDS]
                yield pa.record_batch(columns, names=names + [f"n_{k}" for k in KINDS] * counts)

    return docs.mapInArrow(task, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), counts=True)
