"""Personal data: plain identifiers, and disguised ones found on a normalised text whose places map back."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import common

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
IP_LIKE = re.compile(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ has one local part at most, the run before it, so they are looked up from the signs."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all plain identifiers, in order."""
    found = [(a, 0, z) for a, z in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in (IP.finditer(text) if IP_LIKE.search(text) else ()) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


# Look-alikes of Latin letters, of digits and of the signs in identifiers.
ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ɡ": "g", "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "τ": "t",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "﹒": ".", "＋": "+", "﹢": "+",
    "－": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "（": "(", "）": ")", "＿": "_", " ": " ", " ": " ", " ": " ",
}
#: Characters without width, written between the parts of an identifier.
HIDDEN = "​‌‍⁠﻿­"
# Digits as words.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

# Rows of ten digits, ASCII excepted, and full-width or mathematical Latin letters go by rule.
_TENS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
ALIKE |= {chr(z + i): str(i) for z in _TENS for i in range(10)}
ALIKE |= {chr(0xFF21 + i + k): chr(65 + i + k) for k in (0, 32) for i in range(26)}
ALIKE |= {chr(z + i): chr((65 if i < 26 else 71) + i) for z in (0x1D400, 0x1D5A0, 0x1D5D4, 0x1D670) for i in range(52)}

_WORD = "|".join(SPELLED)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
CHANGED = frozenset([*ALIKE, *HIDDEN])
HOMOGLYPH = re.compile("[" + re.escape("".join(ALIKE)) + HIDDEN + "]")
DIGITS_SPELLED = re.compile(rf"(?i)\b(?:plus[\s-]+)?(?:(?:{_WORD}|[0-9])(?:[\s,-]+|(?=\b))){{6,}}")
#: Without such a word DIGITS_SPELLED changes nothing.
DIGIT_WORD = re.compile(rf"(?i)\b(?:{_WORD})\b")
BRACKETED_AT = re.compile(rf"(?i){_OPEN}\s*(?:at|@)\s*{_CLOSE}")
BRACKETED_DOT = re.compile(rf"(?i){_OPEN}\s*(?:dot|\.)\s*{_CLOSE}")
SPACED_AT = re.compile(r"(?i)(?<=[a-z0-9])\s+@\s+(?=[a-z0-9])")
SPOKEN_IP = re.compile(r"(?i)(?<![\w.])[0-9]{1,3}(?:(?:\s+dot\s+|\.)[0-9]{1,3}){3}(?![\w.])")
#: Where an address may have its sign, and what stands to the right of it.
SIGN = re.compile(r"(?<=\s)[aA][tT](?=\s)|@")
SPOKEN_DOMAIN = re.compile(r"(?i)\s*([a-z0-9-]+(?:(?:\s+dot\s+|\.)[a-z0-9-]+)+)(?!\w)")
SPOKEN_DOT = re.compile(r"(?i)\s+dot\s+")


class Tape:
    """A text on its way through the transducers; every character knows the source characters that it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.begin, self.end, self.made = text, None, None, None

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replace text[a:z] by other text, for edits in order that do not overlap; the new text stands for all of the old."""
        out, begin, end, made, last = [], [], [], [], 0
        for a, z, new in edits:
            if new == self.text[a:z]:
                continue
            if self.begin is None:
                n = len(self.text)
                self.begin, self.end, self.made = list(range(n)), list(range(1, n + 1)), [False] * n
            for part, values in ((out, self.text), (begin, self.begin), (end, self.end), (made, self.made)):
                part.extend(values[last:a])
            out.extend(new)
            begin.extend([self.begin[a]] * len(new))
            end.extend([self.end[z - 1]] * len(new))
            made.extend([True] * len(new))
            last = z
        if last:
            for part, values in ((out, self.text), (begin, self.begin), (end, self.end), (made, self.made)):
                part.extend(values[last:])
            self.text, self.begin, self.end, self.made = "".join(out), begin, end, made


def _homoglyphs(text: str) -> Iterator[tuple[int, int, str]]:
    if not text.isascii() and not CHANGED.isdisjoint(text):
        for m in HOMOGLYPH.finditer(text):
            yield m.start(), m.end(), ALIKE.get(m[0], "")


def _digits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in DIGITS_SPELLED.finditer(text) if DIGIT_WORD.search(text) else ():
        said = re.findall(rf"(?i)plus|{_WORD}|[0-9]", m[0])
        if any(len(x) > 1 for x in said):
            body = "".join("+" if x.lower() == "plus" else SPELLED.get(x.lower(), x) for x in said)
            yield m.start(), m.end(), body + m[0][len(m[0].rstrip(" \t\n,-")) :]


def _bracketed(pattern: re.Pattern, sign: str, text: str) -> Iterator[tuple[int, int, str]]:
    """The sign in brackets, with the white space around it."""
    last = 0
    for m in pattern.finditer(text):
        a, z = m.span()
        while a > last and text[a - 1].isspace():
            a -= 1
        while z < len(text) and text[z].isspace():
            z += 1
        yield a, z, sign
        last = z


def _spaced(text: str) -> Iterator[tuple[int, int, str]]:
    for m in SPACED_AT.finditer(text) if "@" in text else ():
        yield m.start(), m.end(), "@"


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """Addresses with a sign or dots told as words, looked up from their signs.

    "at" alone is no disguise, as texts say "look at" of a host: there has to be a dot told as a word,
    or a local part that is no plain word, with a digit or one of ._%+ among its letters.
    """
    last = 0
    for sign in SIGN.finditer(text):
        a, z = sign.span()
        if a < last or not (right := SPOKEN_DOMAIN.match(text, z)) or (sign[0] == "@" and right.start(1) > z):
            continue
        while sign[0] != "@" and a > last and text[a - 1].isspace():
            a -= 1
        end = begin = a
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        if begin == end:
            continue
        odd = text[end - 1].isalnum() and any(c.isalpha() for c in text[begin:end]) and any(c in "._%+0123456789" for c in text[begin + 1 : end])
        told = bool(SPOKEN_DOT.search(right[1]))
        while (k := _before_dot(text, begin, last)) is not None:
            begin, told = k, True
        while begin < end and not text[begin].isalnum():
            begin += 1
        if begin < end and not (begin > 0 and text[begin - 1].isalnum()) and (told or sign[0] != "@" and odd):
            yield begin, right.end(1), SPOKEN_DOT.sub(".", text[begin:end]) + "@" + SPOKEN_DOT.sub(".", right[1])
            last = right.end(1)


def _before_dot(text: str, at: int, least: int) -> int | None:
    """Where the part begins that stands before a dot, told as a word, before `at`."""
    k = at
    while k > least and text[k - 1].isspace():
        k -= 1
    if k == at or text[max(k - 3, least) : k].lower() != "dot":
        return None
    z = k - 3
    k = z
    while k > least and text[k - 1].isspace():
        k -= 1
    if k == z:
        return None
    begin = k
    while begin > least and text[begin - 1] in LOCAL:
        begin -= 1
    return begin if begin < k else None


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for m in SPOKEN_IP.finditer(text) if re.search("(?i)dot", text) else ():
        yield m.start(), m.end(), SPOKEN_DOT.sub(".", m[0])


#: One after the other, each on what the one before has left. A transducer that is not run would change nothing.
TRANSDUCERS = (_homoglyphs, _digits, partial(_bracketed, BRACKETED_AT, "@"), partial(_bracketed, BRACKETED_DOT, "."), _spaced, _addresses, _numbers)


def normalised(text: str) -> Tape:
    """Homoglyphs and hidden characters, spelled digits, then at and dot disguises."""
    tape = Tape(text)
    for edits in TRANSDUCERS:
        tape.rewrite(edits(tape.text))
    return tape


_LOOSE_NUMBER = re.compile(r"(?<![0-9+])[0-9]{9,15}(?![0-9])")


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifiers that only show on the normalised text, as (start, kind, end) of the source; none overlaps another of its kind."""
    tape = normalised(text)
    if tape.begin is None:
        return []
    found = plain(tape.text)
    # a row of digits told in words is a phone number without its sign
    cards = {(a, z) for a, k, z in found if k == 2}
    found += [(m.start(), 3, m.end()) for m in _LOOSE_NUMBER.finditer(tape.text) if all(tape.made[m.start() : m.end()]) and tape.end[m.start()] - tape.begin[m.start()] > 1 and m.span() not in cards]
    taken = [[(a, z) for a, k, z in base if k == kind] for kind in range(len(KINDS))]
    last = [0] * len(KINDS)
    out = []
    for a, kind, z in sorted(found):
        begin, end = tape.begin[a], max(tape.end[a:z])
        if not any(tape.made[a:z]) and end - begin == z - a:
            continue
        while end > begin and text[end - 1].isspace():
            end -= 1
        while begin < end and text[begin].isspace():
            begin += 1
        # the last plain one that begins before this one's end is the only one that may reach into it
        k = bisect_left(taken[kind], (end, 0))
        if end > begin >= last[kind] and (not k or taken[kind][k - 1][1] <= begin):
            out.append((begin, kind, end))
            last[kind] = end
    return out


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All identifiers of every document: doc_id, spans array<struct<kind, start, end, disguised>>, in code points.

    Null and empty texts have none, a null id is kept, each row of the input gives one row, other
    columns are not looked at. Spans come by start, then kind.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, "text"):
            out = []
            for text in b.column(1).to_pylist():
                base = plain(text or "")
                more = disguised(text or "", base)
                out.append([{"kind": KINDS[k], "start": a, "end": z, "disguised": d} for a, k, z, d in sorted([(*x, False) for x in base] + [(*x, True) for x in more])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,disguised:boolean>>")


def masked(text: str) -> str:
    """The text with each identifier replaced by its kind in brackets; identifiers that overlap go as one, named after the first."""
    base = plain(text)
    out, last = [], 0
    for a, k, z in sorted(base + disguised(text, base)):
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, z)
    return "".join([*out, text[last:]])


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its texts masked; null and empty texts stay, as do all rows and the other columns."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([x if x is None else masked(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone count the plain identifiers, n_disguised those that the method adds, n_spans all."""
    spans = find(common.table(spark, sf_dir, "documents"))
    show = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = spans.withColumn("base", F.filter("spans", lambda s: ~s["disguised"]))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS]
    return base.select("doc_id", *counts, F.sha2(show(F.col("base")), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_disguised"), F.size("spans").cast("long").alias("n_spans"))
