"""Sentence boundaries by a maximum-entropy model over candidate places, trained on the reliable boundaries of the texts themselves."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most documents whose places are used for training, and the length in characters up to which a document may be among them, so
#: that the sample is bounded in bytes as well. Every document is split, whatever its length.
TRAINING_DOCUMENTS, TRAINING_LENGTH = 3000, 20_000
#: Size of the hashed feature space, and of the model that is sent to the executors.
SPACE = 1 << 16
ROUNDS, RATE, DECAY = 120, 0.5, 1e-5
#: A property of layouts, not a limit: no fixed width is narrower, so the line breaks of a text of shorter lines were meant.
NARROW = 40
#: How often a word must begin a line or follow a certain boundary to be taken as a usual beginning.
STARTS = 3

#: Words with a full stop that rarely end a sentence when a number or a capital follows.
ABBREVIATIONS = frozenset("""
dr prof mr ms mrs st no nos rs approx cf pp vol ver est incl vs dept fig ext jan feb mar apr jun jul aug sep sept oct nov dec e.g i.e viz messrs q rev hon gen col
nr hr fr abs mind ca bzw z d u a z.b d.h u.a min okt dipl-ing dipl.-ing ing str
m mme mlle pr bât art p ex p.ex c.-à-d av n°
sr sra srta dra d núm aprox pág ej p.ej ud uds
रु सं डॉ प्रो श्री ரூ திரு பேரா அக் செப் எண் டாக் น ดร รศ ผศ ศ พ.ศ
diploma
""".split())  # fmt: skip
#: Abbreviations that as often end a sentence as not; they say nothing reliable.
EITHER = frozenset("a.m p.m etc al inc ltd co ff corp sept févr h okt min dec nov oct jan feb mar apr jun jul aug sep".split())
#: Months that follow the number of a day.
MONTHS = frozenset("""januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sept okt nov dez
january february march may june july october december""".split())  # fmt: skip
#: Words between which and a capital a number with a full stop is an ordinal.
ARTICLES = frozenset("der die das dem den des am zum zur im vom beim jede jeder jedes".split())
MARKS, CLOSERS = ".!?…।॥。！？", "\"”»“」』)]）】"
#: A mark or several, closing marks; a point or question mark directly before a small letter or digit is none.
_CANDIDATE = re.compile(rf"([{MARKS}]++(?![a-z0-9,;:/@-])|[।॥。！？]+)([{re.escape(CLOSERS)}]*)")
_SPAN = re.compile(r"\([^()\n]*(?:\n[^()\n]+)*\)|（[^（）]*）|“[^“”„]*”|„[^„“”]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|\"[^\"]*\"|\[[^\[\]]*\]")
_LIST = re.compile(r"[ \t ]*(?:[-*•‣–·◦]|\(?\d{1,3}[.)]|\(?[a-z]\))[ \t ]+")
_THAI = re.compile(r"[฀-๿]")
_THAI_SPACE = re.compile(r"(?<=[฀-๿0-9])[ \n ]+(?=[฀-๿A-Z\d])|(?<=[A-Za-z0-9)])[ \n ]+(?=[฀-๿])")
_DEGREE = re.compile(r"(b|m|ph)\.?(a|sc|des|tech|d|com|phil)$")
_DIGIT, _WORD_AT = re.compile(r"\d"), re.compile(r"\S+")
_AFTER_NUMBER = re.compile(r"[\d.,:]+\s*([^\W\d_])")
#: The end of a sentence that the next one follows without a blank.
_GLUED = re.compile(r"^[^\s.]*[^\W_]{3,}\.(?=[^\W\d_a-z])")

#: A few sentences of our own, so that a table of very few texts is split sensibly too.
SEED_TEXT = """The office opens at nine. Dr. Hale met Prof. Stone at 4 p.m. They left soon. Bring the form, i.e. the blue one. It costs Rs. 500. See No. 7 for more. Who asked? Nobody knows! We met Mr. A. Reed of Vale Inc. He agreed. They left at 5 a.m. The rest stayed. He reads B.Tech. Robotics. She teaches M.A. History. Two seats in B.Des. Music stay open. He lost keys, pens, etc. The desk has them. She works for Tull Ltd. They met at Orr Inc. The firm grew.

Der Kurs beginnt am 3. Mai. Frau Dr. Berg leitet ihn. Das gilt z. B. für alle. Die Liste liegt aus. Wer fragt? Alle fragen!

Le cours commence le 3 mai. M. Petit reçoit le Pr. Roux. Voir la p. 5 du guide. Les frais sont fixes. Qui demande ? Personne !

El curso empieza en mayo. El Sr. Ruiz atiende a la Dra. Gil. Según la circular núm. 4, basta eso. La lista es larga. ¿Quién pregunta? Nadie.

सूची बदल सकती है। डॉ. राम कल मिलेंगे। शुल्क रु. 500 है। क्या यह ठीक है?

நூலகம் காலை திறக்கும். திரு. ராம் வருவார். கட்டணம் ரூ. 500 ஆகும்.

名单可能变动！学费可以分期支付吗？图书馆开门。魏博士说：“先交收据。然后等。”每年学费不变。

名簿は変わります。先生は「出してください。待ってください。」と言いました。学費は払えますか？

รายชื่ออาจเปลี่ยนแปลงได้ ค่าเล่าเรียนปีละ 500 บาท
รายชื่ออาจเปลี่ยนแปลงได้ สถานที่สอบระบุไว้ในบัตร
ค่าเล่าเรียนปีละ 700 บาท"""


def shape(token: str) -> str:
    """A word's kind: digits, capital, lower case, uncased script, opening mark."""
    if not token:
        return "none"
    ch = token[0]
    if ch.isdigit():
        return "int" if token.isdigit() else "num"
    if ch.isupper():
        return "Caps" if len(token) > 1 and token.isupper() else "Cap" if len(token) > 1 else "C"
    if ch.islower():
        return "low"
    if ch.isalpha():
        o = ord(ch)
        return "dev" if 0x900 <= o < 0x980 else "tam" if 0xB80 <= o < 0xC00 else "tha" if 0xE00 <= o < 0xE80 else "cjk" if o > 0x2E80 else "oth"
    return "open" if ch in "“„«\"「『(（[¿¡‘" else "mark"


class Place(NamedTuple):
    """A candidate boundary: what stands before and after it."""

    before2: str
    before: str
    mark: str
    closed: bool
    gap: str
    after: str
    after2: str


@lru_cache(maxsize=1 << 18)
def hashed(text: str) -> int:
    """A hash that is the same in every process."""
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) & (SPACE - 1)


def features(p: Place, with_after: bool = True) -> list[int]:
    """Hashed features: neighbouring words, their case, length, digits and script, and the mark.

    A small letter after it tells all by itself, so what precedes is left out then.
    """
    b, b2, a = p.before.lower(), p.before2.lower(), p.after.lower()
    bs, as_ = shape(p.before), shape(p.after)
    with_before = as_ != "low"
    short = min(len(p.before), 6)
    out = [f"m={p.mark}"]
    if with_before:
        out += [f"b={b}", f"bs={bs}", f"bl={short}", f"b2={b2}", f"b2s={shape(p.before2)}", f"m,bs={p.mark},{bs}", f"m,bl={p.mark},{bs},{short}", f"dot={'.' in p.before}", f"b2dot={p.before2.endswith('.')},{bs}"]
    if with_after:
        out += [f"a={a}", f"as={as_}", f"m,as={p.mark},{as_}", f"gap={p.gap}", f"gap,as={p.gap},{as_}", f"cl={p.closed},{as_}", f"cl,a={p.closed},{a[:1]}", f"a2={p.after2},{as_}"]
    if with_after and with_before:
        out += [f"bs,as={bs},{as_},{p.mark}", f"b2,as={b2},{bs},{as_}", f"int={bs == 'int' and len(b) <= 2},{a}"]
    return [hashed(x) for x in out]


def blocks(text: str) -> list[tuple[int, int]]:
    """(from, to) of the parts between line breaks that end a unit: empty lines, list items, and lines cut short.

    In a text of fixed width a line ends where the next word would not fit; such a break is like a space.
    """
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line), line))
        at += len(line) + 1
    if len(lines) == 1:
        return [(0, len(text))]
    width = max((len(line.rstrip()) for _, _, line in lines if " " in line.strip() or ord(line.strip()[:1] or " ") > 0x2E80), default=0)
    if width < NARROW:
        return [(a, b) for a, b, _ in lines]
    out, start = [], 0
    for (a, b, line), (_, _, after) in zip(lines, lines[1:]):
        bare = line.rstrip()
        word = after.split(None, 1)[0] if after.strip() else ""
        fits = len(bare) + (0 if ord(word[:1] or " ") > 0x2E80 else len(word)) < width
        soft = bare and word and not _LIST.match(after) and not fits
        if not soft:
            out.append((start, b))
            start = b + 1
    return [*out, (start, len(text))]


def _word_before(s: str, end: int) -> tuple[str, int]:
    """The word that ends at `end`, blanks skipped, and where it starts. Breaks are blanks in s."""
    while end and s[end - 1].isspace():
        end -= 1
    if end and ord(s[end - 1]) > 0x2E80:
        return s[max(0, end - 2) : end], max(0, end - 2)  # scripts without blanks: the last two characters stand for a word
    start = s.rfind(" ", 0, end) + 1
    return s[start:end], start


def _cut(word: str) -> str:
    """At most the last 24 characters of a word, with every digit as 0."""
    return word[-24:] if word.isalpha() else _DIGIT.sub("0", word[-24:])


def places(s: str, inner: bool = False) -> Iterator[tuple[int, tuple]]:
    """(end, fields of a Place) of each candidate boundary in a block; ends are offsets in it. inner: without the block's end."""
    spans = [m.span() for m in _SPAN.finditer(s)]
    k, n, some = 0, len(s), len(spans)
    lead = m.end() if (m := _LIST.match(s)) else 0
    flat = s.replace("\n", " ").replace("\xa0", " ")
    for m in _CANDIDATE.finditer(s, lead):
        i, stop = m.span()
        while k < some and spans[k][1] <= i:
            k += 1
        within = k < some and spans[k][0] < i
        if within and stop < spans[k][1]:
            continue  # within a quotation or brackets
        if m[2] and not within:
            # What looks like a closing mark opens the next quotation.
            stop = m.end(1)
        there = _WORD_AT.search(flat, stop)
        if inner and not there:
            continue
        nxt = flat[stop : stop + 1]
        mark = m[1][-1] if m[1] != "..." else "…"
        glued = bool(there) and there.start() == stop
        if glued and not nxt.isupper():
            if mark in ".…" and not (ord(nxt) > 0x900 and nxt.isalpha() or nxt in "“„«"):
                continue
            if mark in "!?" and not (ord(nxt) > 0x900 or nxt in "“„«¿¡"):
                continue
        before, start = _word_before(flat, i)
        before = before.lstrip("(“„«\"「[‘¿¡")
        if "." in before:
            before = _GLUED.sub("", before)
        if glued and mark == ".":
            if not (len(before) > 2 and before[-1].islower() or before[-1:].isdigit() or before[-1:] in ")”") or "/" in before or "@" in before or "www." in before:
                continue  # within an abbreviation or address
        before2, _ = _word_before(flat, start)
        after = there[0] if there else ""
        gap = "end" if not there else "none" if glued else "line" if "\n" in s[stop : there.start()] else "blank"
        if ord(after[:1] or " ") > 0x2E80:
            after = after[:2]
        elif "." in after and (run_on := _GLUED.match(after)):
            after = run_on[0][:-1]
        if ord(before[-1:] or " ") > 0x2E80:
            before, before2 = before[-2:], ""
        # A number belongs to what follows it; its script tells whether that is another language.
        after2 = shape(m2[1]) if after[:1].isdigit() and (m2 := _AFTER_NUMBER.match(flat, there.start())) else ""
        yield stop, (_cut(before2), _cut(before), mark, stop > m.end(1), gap, _cut(after.rstrip(".,;:!?”\")")[:24]), after2)
    if _THAI.search(s):
        for m in _THAI_SPACE.finditer(s):
            if any(a < m.start() < b for a, b in spans) or s[m.start() - 1] in MARKS:
                continue
            before, start = _word_before(flat, m.start())
            before2, _ = _word_before(flat, start)
            after = _WORD_AT.search(s, m.end())[0]
            yield m.start(), (_DIGIT.sub("0", before2[-6:]), _DIGIT.sub("0", before[-6:]), " ", False, "space", _DIGIT.sub("0", after[:6]), "")


def label(p: Place, starts: set[str]) -> int | None:
    """1 for a reliable boundary, 0 for a reliable inner place, None where nothing reliable tells."""
    bare, after, as_, bs = p.before.lower(), p.after, shape(p.after), shape(p.before)
    if p.mark == " ":
        if p.before[-1:].isdigit() or as_ in ("int", "num") or bare.rstrip(".") in ABBREVIATIONS or p.before.endswith("."):
            return 0
        return 1 if after in starts or as_ in ("Cap", "Caps", "C") else None
    if p.mark in "।॥。！？":
        if p.closed and after[:1] == "と":
            return 0
        return 1 if not p.closed or shape(p.after) in ("cjk", "Cap", "dev", "end") else None
    if as_ == "low" or after[:1] in ("(", "["):
        return 0
    if p.mark in "!?":
        return 1 if as_ in ("Cap", "Caps", "C", "dev", "tam", "tha", "cjk", "open", "int", "num", "none") else None
    if p.mark == "…":
        return 0 if as_ == "cjk" else None
    if bs == "dev":
        return 0
    if bare in EITHER:
        dated = as_ in ("int", "num") and not p.after2 and bare not in ("a.m", "p.m", "etc", "al")
        return 1 if after in starts and as_ == "Cap" else 0 if dated else None
    if bare in ABBREVIATIONS or _DEGREE.match(bare) or (len(bare) == 1 and bare.isalpha() and p.before2.lower().rstrip(".") in ABBREVIATIONS):
        return 0 if as_ in ("Cap", "Caps", "C", "int", "num", "dev", "tam", "tha", "none") and p.gap != "end" else None
    if p.gap == "end":
        return 1
    if as_ in ("int", "num"):
        other = p.after2 in ("dev", "tam", "tha", "cjk") and p.after2 != bs
        return 1 if other and len(bare) >= 3 and bs in ("low", "Cap", "Caps", "tam", "num", "int") else None
    if bs == "int" and len(bare) <= 2 and (after.lower() in MONTHS or p.before2.lower() in ARTICLES and as_ == "Cap"):
        return 0
    if bs == "tam" and len(bare) > 3 and as_ in ("tam", "Cap", "open"):
        return 1
    if bs == "low" and len(bare) >= 3 and as_ in ("Cap", "Caps", "C", "open", "dev", "tam", "tha", "cjk"):
        return 1
    if (bs in ("Cap", "Caps") and len(bare) >= 3 or bs in ("int", "num", "mark", "open")) and after in starts and as_ == "Cap":
        return 1
    return None


class Model:
    """Maximum-entropy model over hashed features. Picklable; its size does not depend on the data."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights.astype(np.float32)
        self.known: dict[tuple, bool] = {}

    def __getstate__(self) -> np.ndarray:
        return self.weights

    def __setstate__(self, weights: np.ndarray) -> None:
        self.weights, self.known = weights, {}

    def boundary(self, fields: tuple) -> bool:
        if (old := self.known.get(fields)) is None:
            if len(self.known) > 300_000:
                self.known.clear()
            old = self.known[fields] = bool(self.weights[features(Place(*fields))].sum() > 0)
        return old

    def ends(self, text: str) -> list[int]:
        """Numbers of characters from the start of the text through the end of each sentence."""
        out: list[int] = []
        for a, b in blocks(text):
            s = text[a:b]
            last = len(s.rstrip())
            if not last:
                continue
            inner = sorted(end for end, p in places(s, inner=True) if self.boundary(p))
            if not inner:
                out.append(a + last)
                continue
            begin = 0
            for end in inner:
                # A sentence says something; marks alone stay with what precedes.
                if end < last and re.search(r"[^\W_]", s[begin:end]):
                    out.append(a + end)
                    begin = end
            if re.search(r"\S", s[begin:last]):
                if out and begin and not re.search(r"[^\W_]", s[begin:last]):
                    out.pop()
                out.append(a + last)
        return out


def train(texts: list[str]) -> Model:
    """A model fitted to the reliable places of the texts (and of SEED_TEXT)."""
    seen: Counter = Counter()
    starts: Counter = Counter()
    for text in [SEED_TEXT, *texts]:
        for a, b in blocks(text):
            s = text[a:b]
            first = s.split(None, 1)[0] if s.strip() else ""
            if first and re.search(r"[.!?।。]", s):
                starts[first.rstrip(".,;:!?”\")")[:24]] += 1
            if first and _THAI.match(first):
                starts[_DIGIT.sub("0", first[:6])] += 1
            for _, fields in places(s):
                seen[fields] += 1
    for key, n in seen.items():
        p = Place(*key)
        if p.mark == "." and shape(p.before) == "low" and len(p.before) >= 4 and shape(p.after) == "Cap" and p.before.lower() not in ABBREVIATIONS:
            starts[p.after] += n
    usual = {w for w, n in starts.items() if n >= STARTS}
    rows, target, weight = [], [], []
    for key, n in seen.items():
        p = Place(*key)
        y = label(p, usual)
        if y is not None:
            # At a unit's end nothing follows, so only what precedes is learnt from it.
            f = features(p, with_after=p.gap != "end")
            rows.append(f + [SPACE] * (24 - len(f)))
            target.append(y)
            weight.append(min(n, 50) ** 0.5)
    x, y, c = np.array(rows), np.array(target, dtype=float), np.array(weight)
    w, sums = np.zeros(SPACE + 1), np.full(SPACE + 1, 1e-6)
    flat = x.ravel()
    for _ in range(ROUNDS):
        z = np.clip(w[x].sum(axis=1), -30, 30)
        error = (1 / (1 + np.exp(-z)) - y) * c
        g = np.bincount(flat, np.repeat(error, x.shape[1]), SPACE + 1) / c.sum() + DECAY * w
        sums += g * g
        w -= RATE * g / np.sqrt(sums)
        w[SPACE] = 0
    return Model(w[:SPACE])


def sample(documents: DataFrame, most: int = TRAINING_DOCUMENTS) -> list[str]:
    """Texts of at most `most` documents of at most TRAINING_LENGTH characters, chosen by a hash of doc_id."""
    chosen = documents.filter(F.length("text") <= TRAINING_LENGTH).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return [r["text"] for r in documents.select("doc_id", "text").filter(F.length("text") <= TRAINING_LENGTH).join(F.broadcast(chosen), "doc_id", "left_semi").collect()]


def sentence_ends(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Columns doc_id, end_char: one row per sentence of each document, whatever its length.

    end_char counts the characters through the sentence's last one, closing marks included. Documents that are null,
    empty or blank give no row; a document given twice has its sentences twice (doc_id is unique in the table). A quotation or
    bracket never ends within itself.
    """
    model = model or train(sample(documents))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = [model.ends(t) for t in b["text"]]
            count = [len(e) for e in ends]
            yield pd.DataFrame({"doc_id": np.repeat(b["doc_id"].to_numpy(), count), "end_char": np.array([x for e in ends for x in e], dtype=np.int32)})

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("end_char", T.IntegerType())])
    return documents.select("doc_id", "text").filter("text IS NOT NULL").mapInPandas(split, schema)


def found(documents: DataFrame) -> DataFrame:
    """Columns doc_id, end_char."""
    return sentence_ends(documents)
