"""Matching records of two tables without a common key: BM25 retrieval, mutual nearest test, calibrated confidence."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.lookalikes import plain_form
from graphloom.llm.survivorship import survivors
from graphloom.llm.value_mapping import edits, map_values
from graphloom.session import materialize

#: BM25's parameters. Records are short lists of fields, so their length counts little.
K1, B = 1.2, 0.25
#: A pair counts only if it reaches this share of the score that a record with all the query's known terms would have.
LEAST_SHARE = 0.45
#: Least score of a listing, seen from its program, as a share of that of the program's nearest listing.
MUTUAL = 0.5
#: Most pairs from which the confidence is calibrated.
CALIBRATION_ROWS = 5000

#: Degrees, and how they are written (letters only, as joined or separate words).
DEGREES = {
    "btech": ("b tech", "btech", "bachelor of technology"), "bsc": ("b sc", "bsc", "bachelor of science"),
    "ba": ("b a", "ba", "bachelor of arts"), "bdes": ("b des", "bdes", "bachelor of design"),
    "mtech": ("m tech", "mtech", "master of technology"), "msc": ("m sc", "msc", "master of science"),
    "ma": ("m a", "ma", "master of arts"), "mdes": ("m des", "mdes", "master of design"),
    "phd": ("ph d", "phd", "doctor of philosophy"), "diploma": ("diploma",),
}
#: What titles carry besides the program, and words that name no subject.
EXTRAS = re.compile(r"[|–—-]\s*(course|admission|apply|fees|duration|programme|details)\b.*$|\b(19|20)\d\d\b|\badmissions? open\b")
EMPTY_WORDS = frozenset(("in", "of", "and", "the", "for", "degree", "program", "programme", "course"))
INSTITUTION = re.compile(r"\b(university|institute|college|polytechnic|univ|inst)\b")
#: Short forms that are no beginnings of their words.
SQUEEZED = {"engg": "engineering", "mgmt": "management", "mngt": "management", "devt": "development", "sc": "science", "maths": "mathematics"}
_LOOSE = {form: d for d, forms in DEGREES.items() for form in forms}
_DEGREE = re.compile(r"(?<![a-z])(" + "|".join(sorted((f.replace(" ", r"\W{0,3}") for f in _LOOSE), key=len, reverse=True)) + r")(?![a-z])\.?")


@lru_cache(maxsize=200_000)
def parse_title(title: str) -> tuple[str, tuple[str, ...], tuple[str, ...], bool]:
    """(degree, subject words, words of the addition, whether with honours) of a program's title.

    An abbreviated word keeps its full stop. The degree is empty if none is recognised.
    """
    t = EXTRAS.sub(" ", plain_form(title).lower())
    degree = ""
    if m := _DEGREE.search(t):
        degree, t = _LOOSE[re.sub(r"\W+", " ", m[1]).strip()], t[: m.start()] + " ~ " + t[m.end() :]
    else:
        words = re.findall(r"[a-z]+", t)
        for i, w in enumerate(words):
            head = next((h for h in ("bachelor", "master", "doctor") if len(w) > 4 and edits(w, h, 2) <= 2), None)
            if head and words[i + 1 : i + 2] == ["of"] and len(words) > i + 2:
                tail = min(("technology", "science", "arts", "design", "philosophy"), key=lambda x: edits(words[i + 2], x, 9))
                degree = _LOOSE.get(f"{head} of {tail}", "")
                t = re.sub(rf"{w}\W+of\W+{words[i + 2]}", " ~ ", t)
                break
            if len(w) > 5 and edits(w, "diploma", 2) <= 2:
                degree, t = "diploma", re.sub(rf"\b{w}\b\.?", " ~ ", t, count=1)
                break
    pieces = re.split(r"\s[-–—]\s|\s\+\s", t)
    pieces = [p for p in pieces if re.search(r"[a-z]", p) and not INSTITUTION.search(p)]
    subject: list[str] = []
    addition: list[str] = []
    honours = False
    for i, p in enumerate(pieces):
        into = addition if subject and i else subject
        for w in re.findall(r"[^\W\d_]+\.?|&", p):
            stem = w.rstrip(".")
            if len(stem) >= 4 and (stem in ("hons", "honors") or edits(stem, "honours", 2) <= 2):
                honours = True
            elif subject and len(stem) >= 4 and edits(stem, "with", 1) <= 1 and stem[0] == "w":
                into = addition
            elif subject and stem.startswith("with") and len(stem) > 7:
                into = addition  # run together with what follows
                into.append(stem[4:])
            elif stem.endswith("with") and len(stem) > 8:
                into.append(stem[:-4])
                into = addition
            elif stem not in EMPTY_WORDS and w != "&":
                into.append(w)
    return degree, tuple(subject), tuple(addition), honours


def same_word(a: str, b: str) -> bool:
    """Whether a typed word (a full stop marks an abbreviation) can be the word b."""
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y:
        return True
    short, long = sorted((x, y), key=len)
    if (a.endswith(".") or b.endswith(".")) and len(short) >= 2 and long.startswith(short):
        return True
    if short in SQUEEZED and long.startswith(SQUEEZED[short]):
        return True
    most = 1 if len(short) <= 4 else 2
    return len(short) >= 4 and edits(x, y, most) <= most


def same_words(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether two word lists say the same: word by word in order, or in another order, or with words run together."""
    if len(a) == len(b) and all(map(same_word, a, b)):
        return True
    if len(a) == len(b):
        rest = list(b)
        for w in a:
            if not (hit := next((x for x in rest if same_word(w, x)), None)):
                break
            rest.remove(hit)
        else:
            return True
    x, y = "".join(a).replace(".", ""), "".join(b).replace(".", "")
    return bool(a and b) and abs(len(x) - len(y)) <= 2 and edits(x, y, 2) <= 2


def word_terms(kind: str, at: str, words: tuple[str, ...]) -> list[str]:
    """Each word whole, by its beginning and by its end, so that a misspelt one still shares a term; of a shortened one the beginning."""
    out = []
    for w in words:
        bare = w.rstrip(".")
        full = SQUEEZED.get(bare, bare)
        out.append(f"{kind}^|{at}|{full[:3]}")
        if bare == w or full != bare:
            out += [f"{kind}|{at}|{full}", f"{kind}$|{at}|{full[-3:]}"]
    return out


def months(text: str | None) -> str:
    """A duration in months; empty if there is none."""
    if m := re.search(r"(\d+(?:\.\d+)?)\s*([a-z]*)", (text or "").lower()):
        return str(round(float(m[1]) * (1 if m[2].startswith("mo") else 12)))
    return ""


def amount(text: str | None) -> str:
    """A sum of money in whole units, lakhs written out; empty if there is none."""
    if m := re.search(r"(\d[\d,]*(?:\.\d+)?)\s*(lakh|lac)?", (text or "").lower()):
        return str(round(float(m[1].replace(",", "")) * (100_000 if m[2] else 1)))
    return ""


def index_terms(r: Record) -> list[int]:
    """The terms of a record's attributes as 64-bit hashes. Terms of a field name the institution as well.

    So no list of one term spans all institutions, and the rarest terms of a record are its most telling ones.
    """
    at = r.institution
    terms = [f"i|{at}", f"k|{at}|{'h' if r.honours else 'a' if r.addition else 'p'}"]
    terms += word_terms("s", at, r.subject) + word_terms("a", at, r.addition)
    if r.campus:
        terms.append(f"c|{at}|{r.campus}")
    if r.degree:
        terms += [f"d|{at}|{r.degree}", *(f"ds|{at}|{r.degree}|{w[:3]}" for w in r.subject), *(f"de|{at}|{r.degree}|{w[-3:]}" for w in r.subject if w[-1] != ".")]
    terms += [f"{k}|{at}|{v}" for k, v in (("t", months(r.duration)), ("f", amount(r.fees)), ("n", amount(r.intake))) if v]
    return sorted({xxhash.xxh64_intdigest(t) - 2**63 for t in terms})


def institution_of(name: str | None, url: str | None) -> str:
    """The institution's own word: the first of its name, else the domain of its address."""
    words = re.findall(r"[^\W\d_]+", plain_form(name or "").lower())
    if words:
        return words[0]
    host = re.match(r"\s*\w+://([^/?#:]+)", (url or "").lower())
    return host[1].split(".")[-2] if host and "." in host[1] else ""


class Record(NamedTuple):
    """What a row says of a program, normalised."""

    institution: str
    campus: str
    degree: str
    subject: tuple[str, ...]
    addition: tuple[str, ...]
    honours: bool
    duration: str | None
    fees: str | None
    intake: str | None


def address_says(url: str | None) -> str:
    """Degree, subject and addition that the last part of an address spells out; empty if it names no degree and subject."""
    path = re.sub(r"[?#].*$", "", re.sub(r"^\s*\w+://[^/]*", "", (url or "").strip().lower())).rstrip("/")
    degree, subject, addition, honours = parse_title(path.rsplit("/", 1)[-1].replace("-", " "))
    return f"{degree}|{' '.join(subject)}|{' '.join(addition)}|{honours}" if degree and subject else ""


FIELDS = "institution string, campus string, degree string, subject array<string>, addition array<string>, honours boolean, says string, terms array<long>"


def _indexed(frame: DataFrame, key: str) -> DataFrame:
    """KEY and FIELDS of a frame with KEY, name, url, campus, title, duration, fees, intake; rows without an institution are dropped."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, n, u, c, t, *figures in b[[key, "name", "url", "campus", "title", "duration", "fees", "intake"]].itertuples(index=False):
                if inst := institution_of(n, u):
                    degree, subject, addition, honours = parse_title(t)
                    r = Record(inst, c, degree, subject, addition, honours, *figures)
                    rows.append((k, inst, c, degree, list(subject), list(addition), honours, address_says(u), index_terms(r)))
            if rows:
                yield pd.DataFrame(rows, columns=[key, *(f.split()[0] for f in FIELDS.split(", "))])

    return frame.mapInPandas(read, f"{key} {dict(frame.dtypes)[key]}, {FIELDS}")


def _given(frame: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in frame.columns else F.lit(None).cast("string")


def listing_records(listing: DataFrame, campuses: DataFrame) -> DataFrame:
    """listing_id, name, url, campus, title, duration, fees, intake of the listings; a null title is empty. campuses: value, code."""
    figures = [_given(listing, c).alias(n) for c, n in (("duration", "duration"), ("annual_fees", "fees"), ("intake", "intake"))]
    named = listing.select("listing_id", F.col("institute").alias("name"), "url", F.col("campus").alias("value"), F.coalesce("title", F.lit("")).alias("title"), *figures)
    return named.join(campuses, "value", "left").drop("value").withColumn("campus", F.coalesce("code", F.lit(""))).drop("code")


def program_records(entity: DataFrame, trust: DataFrame, campuses: DataFrame) -> DataFrame:
    """entity_id, name, url, campus, title, duration, fees, intake of each program, from the surviving values of its rows.

    Where no row has a usable name, the words of the id stand for it; the word of the institution is the id's.
    """
    rows = entity.filter("entity_type = 'program' AND id IS NOT NULL AND id <> ''")
    wanted = {"name": "name", "url": "url", "attributes.duration": "duration", "attributes.annual_fees": "fees", "attributes.intake": "intake"}
    few = rows.withColumn("attributes", F.map_filter("attributes", lambda k, _: k.isin(*[w.split(".")[1] for w in wanted if "." in w])))
    kept = survivors(few, trust).groupBy("id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(n) for f, n in wanted.items()])
    where = rows.select("id", F.col("campus").alias("value"), "scraped_at", "rec_id").join(campuses, "value", "left")
    order = F.struct(F.coalesce(F.length("code"), F.lit(0)) > 0, "scraped_at", (-F.col("rec_id")).alias("minus"), "code")
    sited = where.groupBy("id").agg(F.max(order).alias("c")).select("id", F.coalesce("c.code", F.lit("")).alias("campus"))
    slug = F.regexp_replace("id", "^[^-]*--", "")
    said = F.trim(F.regexp_replace(F.regexp_replace(slug, "^[^-]*-", ""), "-", " "))
    return sited.join(kept, "id", "left").select(F.col("id").alias("entity_id"), F.split(slug, "-")[0].alias("name"), "url", "campus", F.coalesce("name", said).alias("title"), "duration", "fees", "intake")


def search(queries: DataFrame, documents: DataFrame, query: str, document: str, least: float = LEAST_SHARE) -> DataFrame:
    """QUERY, DOCUMENT, score, whole: every pair whose BM25 score is at least `least` of whole, over the column terms.

    whole is the score of the query with a document that has all its terms; terms that no document has count on neither
    side. A query's terms are probed from the rarest on, only as long as the terms after them could still lift a document to
    the threshold. A document met is scored over all terms if what its probed terms gave, with all that may follow, reaches
    the threshold. Both bounds are exact: no pair at or above the threshold is lost, and the best k of a query are its best k.
    """
    posts = documents.select(document, F.size("terms").alias("length"), F.explode("terms").alias("term"))
    total = documents.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean"), F.min(F.size("terms")).alias("least"))
    norm = lambda length: (K1 + 1) / (1 + K1 * (1 - B + B * length / F.greatest("mean", F.lit(1.0))))
    frequency = posts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))  # one row of totals
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    worth = frequency.select("term", "df", idf.alias("idf"), norm(F.col("least")).alias("most"))
    asked = queries.select(query, F.explode("terms").alias("term")).join(worth, "term")
    weights = materialize(asked.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("df", "term", "idf"))).alias("q"), F.sum("idf").alias("whole"), F.max("most").alias("most")))
    # From the rarest on, each term with the idf of all that come after it, as long as it must be probed; rest: what then remains.
    summed = F.aggregate(F.reverse("q"), F.struct(F.lit(0.0).alias("after"), F.array().cast("array<struct<term:bigint,idf:double,after:double>>").alias("out")),
        lambda acc, x: F.struct((acc.after + x.idf).alias("after"), F.concat(acc.out, F.array(F.struct(x.term.alias("term"), x.idf.alias("idf"), acc.after.alias("after"))))))["out"]
    probed = F.filter(summed, lambda x: (x.after + x.idf) * F.col("most") >= F.col("whole") * least)
    ranked = weights.select(query, "whole", "most", probed.alias("p")).select(query, "whole", "most", F.array_min(F.transform("p", lambda x: x.after)).alias("rest"), F.explode("p").alias("x"))
    probes = ranked.select(query, F.col("x.term").alias("term"), F.col("x.idf").alias("idf"), ((F.col("whole") * least) / F.col("most") - F.col("rest")).alias("wanted"))
    met = probes.join(posts.select(document, "term"), "term").groupBy(query, document).agg(F.sum("idf").alias("have"), F.first("wanted").alias("wanted"))
    pairs = met.filter(F.col("have") >= F.col("wanted") - 1e-9).select(query, document)
    both = pairs.join(weights.select(query, "q", "whole"), query).join(documents.select(document, "terms"), document).crossJoin(F.broadcast(total.select("mean")))
    shared = F.aggregate(F.filter("q", lambda x: F.array_contains("terms", x.term)), F.lit(0.0), lambda acc, x: acc + x.idf)
    scored = both.select(query, document, (shared * norm(F.size("terms"))).alias("score"), "whole")
    return scored.filter(F.col("score") >= F.col("whole") * least)


def match(listing: DataFrame, entity: DataFrame, trust: DataFrame, campus_list: DataFrame) -> DataFrame:
    """Columns listing_id, entity_id, confidence of the pairs that belong together.

    Listings search the programs and the programs that they found search the listings. Of a listing's candidates, however
    many, those with the same institution, campus (where both are known), degree, subject and addition stay, apart from
    spelling; the best of them counts if the two are mutually nearest: since a program may have several listings, the
    listing must reach MUTUAL of the score of the program's nearest one. The confidence is a logistic function of the share
    of the whole score and of the gap to the listing's next candidate.
    Listings without a title, institution or partner give no row; a program may have several listings.
    """
    values = listing.select(F.col("campus").alias("value")).unionByName(entity.filter("entity_type = 'program'").select(F.col("campus").alias("value")))
    campuses = materialize(map_values(values, campus_list).filter("code <> ''"))
    queries = materialize(_indexed(listing_records(listing, campuses), "listing_id"))
    documents = materialize(_indexed(program_records(entity, trust, campuses), "entity_id"))
    best = Window.partitionBy("listing_id").orderBy(F.desc("score"), "entity_id")
    scored = search(queries, documents, "listing_id", "entity_id").withColumns({"rank": F.row_number().over(best), "next": F.lead("score").over(best), "first": F.first("score").over(best)})
    side = lambda df, key, mark: df.select(key, *[F.col(c).alias(f"{mark}_{c}") for c in ("institution", "campus", "degree", "subject", "addition", "honours", "says")])
    pairs = scored.join(side(queries, "listing_id", "q"), "listing_id").join(side(documents, "entity_id", "d"), "entity_id")
    equal = lambda *names: reduce(lambda a, n: a & (F.col(f"q_{n}") == F.col(f"d_{n}")), names, F.lit(True))
    sited = (F.col("q_campus") == "") | (F.col("d_campus") == "") | equal("campus")
    # What the check turns down for a field needs no comparison of words; the first candidate is kept for the calibration.
    may = equal("institution", "degree", "honours") & sited & (F.size("q_subject") > 0)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([same_words(tuple(w), tuple(x)) and same_words(tuple(y), tuple(z)) for w, x, y, z in zip(a, b, c, d)], dtype=bool)

    alike = alike.asNondeterministic()  # so that it is evaluated once, after the fields were compared
    told = F.when((F.col("q_says") != "") & (F.col("d_says") != ""), equal("institution", "says"))
    kept = pairs.filter(may).withColumn("ok", alike("q_subject", "d_subject", "q_addition", "d_addition")).unionByName(pairs.filter(~may & (F.col("rank") == 1)).withColumn("ok", F.lit(False)))
    gap = F.when(F.col("rank") == 1, F.coalesce((F.col("score") - F.col("next")) / F.col("score"), F.lit(1.0))).otherwise((F.col("score") - F.col("first")) / F.col("score"))
    checked = materialize(kept.filter("ok OR rank = 1").select("listing_id", "entity_id", "score", "rank", "ok", (F.col("score") / F.col("whole")).alias("share"), gap.alias("gap"), told.alias("told")))
    chosen = checked.filter("ok").withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")
    back = search(documents.join(chosen.select("entity_id").distinct(), "entity_id", "left_semi"), queries, "entity_id", "listing_id").groupBy("listing_id", "entity_id").agg(F.max("score").alias("seen"))
    nearest = back.groupBy("entity_id").agg(F.max("seen").alias("nearest"))
    mutual = chosen.join(back, ["listing_id", "entity_id"]).join(nearest, "entity_id").filter(F.col("seen") >= MUTUAL * F.col("nearest"))
    return mutual.select("listing_id", "entity_id", F.round(confidence(*calibrate(checked)), 4).alias("confidence"))


def confidence(intercept: float, of_share: float, of_gap: float) -> Column:
    return 1 / (1 + F.exp(-(intercept + of_share * F.col("share") + of_gap * F.col("gap"))))


def calibrate(checked: DataFrame, rows: int = CALIBRATION_ROWS) -> tuple[float, float, float]:
    """Logistic coefficients fitted to what addresses tell, over at most `rows` listings.

    The label of a listing's first candidate is whether both addresses spell out the same program; addresses are no terms of the
    index, so the label does not come from what is scored. Without labels the confidence is one half.
    """
    sample = checked.filter("rank = 1 AND told IS NOT NULL").orderBy(F.xxhash64("listing_id")).limit(rows).select("share", "gap", F.col("told").cast("double").alias("y")).toPandas()
    x = np.column_stack([np.ones(len(sample)), sample["share"], sample["gap"]]) if len(sample) else np.zeros((0, 3))
    y, w = sample["y"].to_numpy(dtype=float), np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(3)
        w += np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return tuple(float(v) if math.isfinite(v) else 0.0 for v in w)


def found(listing: DataFrame, entity: DataFrame, trust: DataFrame, campus_list: DataFrame) -> DataFrame:
    """Columns listing_id, entity_id."""
    return match(listing, entity, trust, campus_list).select("listing_id", "entity_id")
