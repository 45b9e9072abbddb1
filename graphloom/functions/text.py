"""Text expressions: cleaning, tokens, normalisation, excerpts and sections, all as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning when names are matched in a question.
MATCH_STOPWORDS = ("and", "of", "the", "for", "in", "at", "how", "what", "who", "when", "which", "where", "do", "does", "i", "can", "you", "tell", "me", "about")
#: Ordered rewrites of short forms of fields of study.
MATCH_ALIASES = (
    (r"\bai\s*(?:&|/)\s*ml\b", "aiml"), (r"\bai\s+and\s+ml\b", "aiml"), (r"\baiml\b", "artificial intelligence machine learning"),
    (r"\bcse\b", "computer science engineering"), (r"\bece\b", "electronics communication engineering"), (r"\beee\b", "electrical electronics engineering"),
    (r"\bmech\b", "mechanical engineering"), (r"\bcivil\b", "civil engineering"), (r"\bcsbs\b", "computer science business systems"), (r"&", " and "),
)
#: Ordered rewrites of degrees.
DEGREE_ALIASES = (
    (r"\bb\.?\s*tech\b", "btech"), (r"\bm\.?\s*tech\b", "mtech"), (r"\bb\.?\s*arch\b", "barch"), (r"\bm\.?\s*arch\b", "march"), (r"\bb\.?\s*des\b", "bdes"),
    (r"\bm\.?\s*des\b", "mdes"), (r"\bm\.?\s*b\.?\s*a\b", "mba"), (r"\bw/?s\b", "with specialization"), (r"&", " and "),
)
#: Words of program titles that tell programs apart badly.
PROGRAM_STOPWORDS = (
    "and", "of", "the", "in", "with", "for", "specialization", "specialisation", "programme", "program", "programs", "degree", "full", "time", "part", "timings", "timing",
    "integrated", "hons", "honours", "honors", "regular", "stream", "course", "how", "apply", "application", "admission", "admissions", "procedure", "process", "what", "when",
    "at", "to", "do", "does", "did", "i", "is", "are", "was", "work", "works", "working", "university", "college", "tell", "me", "about", "explain", "describe", "give", "get",
    "know", "want", "can", "could", "would", "should", "will", "need", "please", "help",
)


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower case in ASCII: letters and digits of other scripts as underscores, which are part of words, all else as blanks.

    So a word boundary means the same to every regular-expression dialect, whatever the text's script.
    """
    plain = F.regexp_replace(F.lower(F.translate(text, "İ", "I")), r"[^\p{L}\p{N}\x00-\x7F]", " ")
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "_")


def rewrite(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The text after each pattern of rules, in order, was replaced."""
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def without(words: Column, stopwords: Sequence[str]) -> Column:
    """words without the stopwords and empty strings; repeated words stay."""
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stopwords))


def match_text(text: Column, rules: Sequence[tuple[str, str]] = MATCH_ALIASES, stopwords: Sequence[str] = MATCH_STOPWORDS) -> Column:
    """Lower case, short forms written out, other characters as blanks, stopwords dropped."""
    plain = F.regexp_replace(rewrite(ascii_lower(text), rules), "[^a-z0-9]+", " ")
    return F.array_join(without(F.split(plain, " "), stopwords), " ")


def program_text(text: Column) -> Column:
    """A program title with one spelling per degree and plain blanks."""
    return F.trim(F.regexp_replace(rewrite(ascii_lower(text), DEGREE_ALIASES), "[^a-z0-9]+", " "))


def word_set(text: Column, stopwords: Sequence[str] = PROGRAM_STOPWORDS, least: int = 2) -> Column:
    """The distinct telling words of a title, sorted."""
    return F.array_sort(F.array_distinct(F.filter(without(F.split(program_text(text), " "), stopwords), lambda w: F.length(w) >= least)))


def excerpt(text: Column, most: int = 320) -> Column:
    """The text, or its part before the last blank within `most` characters followed by dots."""
    plain = squeeze(text)
    head = F.substring(plain, 1, most)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_extract(head, "^(.*) ", 1)).otherwise(head)
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.trim(cut), F.lit("...")))


def strip_sources(answer: Column, keep: int = 40) -> Column:
    """An answer without its list of sources, and without a statement of ignorance if `keep` characters remain."""
    body = F.trim(F.regexp_replace(answer, r"(?is)(\n|^)\s*\*{0,2}sources?\*{0,2}\s*:.*", ""))
    said = F.trim(F.regexp_replace(body, r"(?is)\s*i don['’]?t have (enough |specific )?information.*?[.!]\s*", " "))
    return F.when(F.length(said) >= keep, said).otherwise(body)


def sections(text: Column, headings: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Array of (field, body) by position: each heading's first place in the text up to the next one found.

    Of a field's spellings the first that occurs counts. Texts without a heading give an empty array.
    """
    # Of all letters only this one grows in lower case, which would move every place after it.
    lowered = F.lower(F.translate(text, "İ", "I"))
    found = [
        F.struct(F.coalesce(*[F.when(F.instr(lowered, h.lower()) > 0, F.instr(lowered, h.lower())) for h in names]).alias("at"),
                 F.coalesce(*[F.when(F.instr(lowered, h.lower()) > 0, F.lit(len(h))) for h in names]).alias("size"), F.lit(field).alias("field"))
        for field, names in headings
    ]
    placed = F.array_sort(F.filter(F.array(*found), lambda x: x["at"].isNotNull()))
    begin = lambda x: x["at"] + x["size"]
    end = lambda i: F.coalesce(F.try_element_at(placed, i + 2)["at"], F.length(text) + 1)
    return F.transform(placed, lambda x, i: F.struct(x["field"].alias("field"), squeeze(text.substr(begin(x), end(i) - begin(x))).alias("body")))


def md5_uuid(seed: Column) -> Column:
    """The md5 of a seed in the layout of a UUID: the same row has the same id in every build."""
    return F.regexp_replace(F.md5(seed), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def expand(text: Column, table: dict[str, str], skip: Sequence[str] = ()) -> Column:
    """Each short form that stands as a word followed by its long form in brackets, in one pass; case does not matter.

    What was inserted is not expanded again. Short forms in skip, and those equal to their long form, stay as they are.
    """
    known = {k.lower(): v for k, v in table.items() if k not in skip and k.lower() != v.lower()}
    if not known:
        return text
    longs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    pieces = F.split(text, r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    full = F.transform(pieces, lambda w: F.when(longs[F.lower(w)].isNotNull(), F.concat(w, F.lit(" ("), longs[F.lower(w)], F.lit(")"))).otherwise(w))
    return F.array_join(full, "")


def add_hints(text: Column, hints: Sequence[tuple[Column, str]]) -> Column:
    """The text followed by the hint of every condition that holds, in order."""
    return F.concat_ws(" ", F.trim(text), *[F.when(condition, F.lit(hint)) for condition, hint in hints])


def first_matching(text: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The value of the first pattern that the text contains a match of (case ignored)."""
    out = F.lit(otherwise).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), F.lit(value)).otherwise(out)
    return out
