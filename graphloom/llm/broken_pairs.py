"""Prompt and response pairs whose response is no proper answer, with the kind of the defect."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.languages import language
from graphloom.llm.lookalikes import plain_form
from graphloom.llm.refusals import is_refusal
from graphloom.operators.skew import spread_join
from graphloom.session import materialize

#: What people and programs put where there is no answer.
NOTHING = frozenset(("none", "null", "nan", "n a", "na", "nil", "undefined", "empty", "no answer", "no response", "tbd", "todo", "p p", "br", "div div", "xxx"))
#: Polite openings that say nothing, and openings that announce a question given back.
POLITE = ("hello", "hi", "thank you for reaching out", "thanks for asking", "good question", "sure", "here is what i found", "of course", "certainly")
LEADS = ("q", "question", "you asked", "you asked me", "for your query", "your query was", "your question was", "so your question is", "your question is", "query", "user")
#: Words with a full stop that go on; a text that ends in one is cut off.
GOES_ON = frozenset("""
dr prof mr ms mrs no rs approx st cf pp p fig vol ver est incl vs i.e e.g dept ext www jan feb mar apr jun jul aug sep sept oct nov dec
nr hr fr z.b d.h u.a bzw ca mind min okt dipl-ing dr.-ing
mme mlle pr n° ex p.ex bât art c.-à-d av
sr sra dra d núm p.ej aprox
सं रु डॉ प्रो श्री ரூ திரு பேரா அக் செப் எண்
b.a b.sc b.des b.tech m.a m.sc m.des m.tech ph.d
""".split())  # fmt: skip
#: English, German, French and Spanish words after which a bare number is not the end.
BEFORE_NUMBER = frozenset("at before than within covers lasts minimum um dem den am las à".split())
#: Least share of words in common order for an answer to be the question given back, and of its word triples.
COPIED, SHINGLED = 0.8, 0.6
#: Least lead of a language over the next one, question and answer together, in words (one each at least).
TOLD = 3
PREVIEW = 300
_TAG, _PLAIN_WORD = re.compile(r"<[^>]*>"), re.compile(r"[^\W_]+")
_INNER_DOT, _TOKEN = re.compile(r"(?<=[^\W\d_])\.(?=[^\W\d_])"), re.compile(r"[\wऀ-ॿ஀-௿']+")


@lru_cache(maxsize=50_000)
def tokens(text: str) -> tuple[str, ...]:
    """Words in lower case; dots within abbreviations are ignored."""
    return tuple(_TOKEN.findall(_INNER_DOT.sub("", plain_form(text).lower().replace("’", "'"))))


def common_length(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@lru_cache(maxsize=8)
def _longest_first(openings: tuple[str, ...]) -> list[tuple[str, ...]]:
    return sorted((tuple(o.split()) for o in openings), key=len, reverse=True)


def without(openings: tuple[str, ...], words: tuple[str, ...]) -> tuple[str, ...]:
    """words without one of the openings at their start."""
    for lead in _longest_first(openings):
        if words[: len(lead)] == lead:
            return words[len(lead) :]
    return words


def is_empty(answer: str) -> bool:
    bare = _TAG.sub(" ", answer) if "<" in answer else answer
    # What says nothing has a word or two, so a third one tells.
    if sum(1 for _ in islice(_PLAIN_WORD.finditer(bare), 3)) == 3 and bare.isascii():
        return False
    words = " ".join(_PLAIN_WORD.findall(plain_form(bare).lower()))
    return not words or words in NOTHING


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer, apart from an announcement, is made of the question's words in their order, once or however often.

    An answer longer than the question is cut into stretches of the question's length: each must align with it.
    """
    q, a = tokens(question), without(LEADS, without(POLITE, tokens(answer)))
    if not q or not a or len(set(a) & set(q)) < SHINGLED * len(set(a)):
        return False
    times = max(1, round(len(a) / len(q)))
    if len(a) < COPIED * len(q) * times or len(a) * COPIED > len(q) * times:
        return False
    triples = lambda w: {w[i : i + 3] for i in range(max(1, len(w) - 2))}
    if len(triples(a) & triples(q * min(times, 2))) < SHINGLED * len(triples(a)):
        return False
    size = len(a) / times
    stretches = Counter(a[round(i * size) : round((i + 1) * size)] for i in range(times))
    common = sum(n * common_length(stretch, q) for stretch, n in stretches.items())
    return common >= COPIED * len(a) and common >= COPIED * len(q) * times


def end_key(line: str) -> str:
    """How a list item or address ends: its last two words with every digit as #."""
    return " ".join(re.sub(r"\d", "#", plain_form(line).lower()).split()[-2:])


def url_key(url: str) -> str:
    """The path of an address, with every digit as #."""
    return "url " + re.sub(r"\d", "#", re.sub(r"^(\w+://)?[^/]*", "", url.lower()))


def ending(answer: str) -> tuple[bool, str]:
    """(whether the text stops before its end, key of a list item or address whose completeness other rows tell)."""
    t = answer.rstrip()
    last_line = t.rsplit("\n", 1)[-1].strip()
    if re.search(r"(\.\.\.|…|[-–—,;:(\[{“„«¿¡])$", t):
        return True, ""
    for a, b in ("()", "“”", "„“", "«»", "[]"):
        opened = t.count(a)
        if opened > t.count(b) and (a, b) not in (("“", "”"),):
            return True, ""
    if "„" not in t and t.count("“") > t.count("”"):
        return True, ""
    word = t.split()[-1]
    if re.match(r"(https?://|www\.)\S+$", word) and not word.endswith("."):
        return False, url_key(word)
    if re.match(r"([-*•‣–]|\d+[.)])\s", last_line):
        return False, "item " + end_key(last_line)
    closed = re.sub(r"[”\"'’»)\]]+$", "", t)
    if not re.search(r"[.!?।。！？]$", closed):
        return True, ""
    if re.search(r"[ऀ-ॿ]", last_line) and t.endswith(".") and not re.search(r"[A-Za-z]\.$", t):
        return True, ""
    if closed == t and t.endswith("."):
        bare = word[:-1].lower().lstrip("(“„«\"'").replace("’", "'")
        if bare in GOES_ON and not (bare in ("sept", "févr") and word[0].islower()) or re.fullmatch(r"[abmdz]", bare):
            # French dates may end in such a month; single capitals go on, except the C of a building.
            return True, ""
        before = t.split()[-2].lower() if len(t.split()) > 1 else ""
        if re.fullmatch(r"\d{1,2}", bare) and before in BEFORE_NUMBER:
            return True, ""
    return False, ""


def judge(question: str | None, answer: str | None, cut: bool) -> tuple[str, str]:
    """(defect or empty, key as of ending). cut: the text is a preview that ends at its limit."""
    if answer is None or is_empty(answer):
        return "empty", ""
    if question and is_copy(question, answer):
        return "copy", ""
    if is_refusal(answer, frozenset(tokens(question or ""))):
        return "refusal", ""
    if question:
        asked, sure = language(question)
        said, lead = language(answer)
        if asked and said and asked != said and min(sure, lead) >= 1 and sure + lead >= TOLD:
            return "language", ""
    if cut:
        return "", ""
    stopped, key = ending(answer)
    return ("truncated", "") if stopped else ("", key)


def item_ends(answer: str | None) -> list[str]:
    """The end keys of list items that another line follows: these are complete."""
    lines = (answer or "").rstrip().split("\n")[:-1]
    return ["item " + end_key(x.strip()) for x in lines if re.match(r"([-*•‣–]|\d+[.)])\s", x.strip())]


def defects(pairs: DataFrame, addresses: DataFrame) -> DataFrame:
    """Columns src_table, row_id, defect of the rows of pairs (src_table, row_id, question, answer, cut) with a defect.

    addresses (column url) are known to be complete. A list item or address at the end of an answer is complete if
    some other item or address of the table ends alike, else it was cut in its middle. A null answer is empty; with a
    null question neither copy nor language can show. Very long answers are judged whole.
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [judge(q, a, bool(c)) for q, a, c in zip(b["question"], b["answer"], b["cut"])]
            yield pd.DataFrame({"src_table": b["src_table"], "row_id": b["row_id"], "defect": [d for d, _ in done], "key": [k for _, k in done], "ends": [item_ends(a) for a in b["answer"]]})

    judged = materialize(pairs.mapInPandas(first, "src_table string, row_id long, defect string, key string, ends array<string>"))

    @F.pandas_udf("string")
    def path(urls: pd.Series) -> pd.Series:
        return urls.map(url_key)

    complete = judged.select(F.explode("ends").alias("key")).unionByName(addresses.filter("url IS NOT NULL").select("url").distinct().select(path("url").alias("key"))).distinct()
    open_ends = spread_join(judged.filter("key <> ''").select("src_table", "row_id", "key"), complete, ["key"], "row_id", "left_anti")
    return judged.filter("defect <> ''").select("src_table", "row_id", "defect").unionByName(open_ends.select("src_table", "row_id", F.lit("truncated").alias("defect")))


def found(chat_request: DataFrame, chat_response: DataFrame, eval_results: DataFrame) -> DataFrame:
    """Columns src_table, row_id, defect. Repeated requests, responses and results count once."""
    asked = chat_request.groupBy("request_id").agg(F.min("query").alias("question"))
    said = chat_response.select("response_id", "request_id", "response").distinct()
    # A request with more than a 200th of the responses; there are fewer than 200 of these.
    most = max(1000, chat_response.count() // 200)
    hot = chat_response.groupBy("request_id").count().filter(F.col("count") > most)
    chat = spread_join(said, asked, ["request_id"], "response_id", "left", hot=hot).select(
        F.lit("chat_response").alias("src_table"), F.col("response_id").alias("row_id"), "question", F.col("response").alias("answer"), F.lit(False).alias("cut")
    )
    tests = eval_results.select(
        F.lit("eval_results").alias("src_table"), F.col("result_id").alias("row_id"), "question", F.col("answer_preview").alias("answer"), (F.length("answer_preview") >= PREVIEW).alias("cut")
    )
    addresses = chat_response.select(F.explode("sources.url").alias("url"))
    return defects(chat.unionByName(tests), addresses).distinct()
