"""Free-entered values mapped to a canonical list by a prefix-filtered set-similarity join."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.lookalikes import plain_form
from graphloom.operators.skew import spread_join
from graphloom.session import materialize

#: Words that people put around a name and that name nothing themselves.
FILLERS = ("campus", "campuses", "cmps", "cmp", "main", "the", "one", "near", "in", "at", "of", "city", "old", "ex", "former", "formerly", "new", "branch", "site", "all", "any")
#: Least Jaccard similarity of token sets at which a typed value can mean an alias.
LEAST_JACCARD = 0.3
#: Most edits, as a share of the longer of both, that the alias found may lie away; less if the alias is a weak form.
MOST_EDITS, MOST_EDITS_WEAK = 0.40, 0.17
GRAM = 2


def letters(text: str) -> str:
    """Lower-case letters, digits and single blanks of the plain form."""
    return " ".join(re.findall(r"[^\W_]+", plain_form(text).lower()))


def grams(text: str) -> list[str]:
    """The tokens of a text without blanks, spelt as it sounds: its letters, each with how often it came before, and its q-grams."""
    s = sounded(text.replace(" ", ""))
    seen: Counter = Counter()
    out = set()
    for ch in s:
        seen[ch] += 1
        out.add(f"{ch}{seen[ch]}")
    s = f"^{s}$"
    return sorted(out | {f"_{s[i : i + GRAM]}" for i in range(len(s) - GRAM + 1)})


def bare(text: str) -> str:
    """A name as it is when vowels after the first letter of each word are left out."""
    return "".join(w[0] + re.sub("[aeiou]", "", w[1:]) for w in text.split())


#: Spellings of one sound, each with the one that stands for all.
SOUNDS = (("x", "ks"), ("ph", "f"), ("qu", "kv"), ("q", "k"), ("w", "v"), ("oo", "u"), ("ou", "u"), ("ee", "i"), ("ea", "i"), ("y", "i"), ("ck", "k"), ("c", "k"), ("z", "s"), ("sh", "s"))


def sounded(text: str) -> str:
    """A text spelt as it sounds, roughly: different spellings of one sound become the same."""
    for a, b in SOUNDS:
        text = text.replace(a, b)
    return text


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit; most + 1 if it is larger than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        two, one = one, now
    return min(one[-1], most + 1)


def segments(value: str) -> list[tuple[str, str]]:
    """(kind, text) of what a typed value may name: the whole without fillers, and each of its parts. kind: code or name."""
    plain = plain_form(value)
    parts = [p for p in re.split(r"[,/()|;:\[\]]|\s-\s|\s–\s|\bex-", plain.lower()) if p.strip()]
    out = []
    for p in [plain.lower(), *parts]:
        words = letters(p).split()
        telling = [w for w in words if w not in FILLERS]
        if telling:
            out += [("name", " ".join(telling)), ("code", "".join(telling)), ("name", " ".join(words))]
    return list(dict.fromkeys(out))


def aliases(campus_list: DataFrame) -> DataFrame:
    """Columns code, kind, alias, weak, h (its tokens) of each entry's code, names and their forms without vowels. Null names give none.

    A state names several campuses, so it is no alias.
    """
    each = campus_list.select("campus_code", F.explode(F.array(F.lower("campus_code"), "campus_name", "city", "former_name")).alias("alias"), F.col("campus_code").alias("c")).filter("alias IS NOT NULL AND alias <> ''")

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for code, alias in zip(b["campus_code"], b["alias"]):
                if alias == code.lower():
                    rows.append((code, "code", letters(alias), False))
                elif plain := letters(alias):
                    telling = " ".join(w for w in plain.split() if w not in FILLERS)
                    rows += [(code, "name", plain, False), (code, "name", bare(plain), True), (code, "name", telling or plain, telling != plain)]
            if rows:
                yield pd.DataFrame([(*r, grams(r[2])) for r in dict.fromkeys(rows)], columns=["code", "kind", "alias", "weak", "h"])

    return each.mapInPandas(forms, "code string, kind string, alias string, weak boolean, h array<string>").dropDuplicates(["code", "kind", "alias", "weak"])


def map_values(values: DataFrame, campus_list: DataFrame) -> DataFrame:
    """Columns value, code of the distinct rows of values (column value): code is empty if the value names no entry.

    Typed segments that equal a code or alias are mapped at once. The others are joined with the aliases by similarity of
    their token sets, and the most similar alias within the edits allowed is kept (ties: fewer edits, whole value before
    part, smaller code). Null, empty and unprintable values have an empty code.
    """
    distinct = values.select("value").filter("value IS NOT NULL").distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(v, i, k, t, grams(t) if k == "name" else []) for v in b["value"] for i, (k, t) in enumerate(segments(v))]
            if rows:
                yield pd.DataFrame(rows, columns=["value", "part", "kind", "text", "g"])

    parts = materialize(distinct.mapInPandas(cut, "value string, part int, kind string, text string, g array<string>"))
    names = materialize(aliases(campus_list))
    exact = parts.join(names.filter("NOT weak").select("kind", F.col("alias").alias("text"), "code"), ["kind", "text"])
    sure = materialize(exact.groupBy("value").agg(F.min(F.struct("part", "code")).alias("s")).select("value", F.col("s.code").alias("sure")))
    unsure = parts.filter("kind = 'name'").join(sure, "value", "left_anti")
    near = similar(unsure.groupBy("text").agg(F.first("g").alias("g")), names.filter("kind = 'name'"))
    best = unsure.select("value", "part", "text").join(near, "text").groupBy("value").agg(F.min(F.struct((-F.col("jaccard")).alias("less"), "share", "part", "code")).alias("b")).select("value", F.col("b.code").alias("near"))
    return distinct.join(sure, "value", "left").join(best, "value", "left").select("value", F.coalesce("sure", "near", F.lit("")).alias("code"))


def similar(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns text, code, jaccard, share of each text (text, g) and alias (alias, code, weak, h) that are similar enough.

    Tokens are ordered by global rarity and only the prefix of each set that must share one with any similar set is joined;
    length and position bounds drop pairs that cannot reach LEAST_JACCARD; the rest is verified exactly. share: edits by
    length, checked at the end.
    """
    rarity = left.select(F.explode("g").alias("gram")).unionByName(right.select(F.explode("h").alias("gram"))).groupBy("gram").agg(F.count("*").alias("freq"))

    def prefixes(side: DataFrame, key: list[str], tokens: str) -> DataFrame:
        """The rarest tokens of each set, with position and size: as many as leave too few for the least similarity."""
        each = side.select(*key, F.explode(tokens).alias("gram")).join(rarity, "gram")
        ranked = each.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("freq", "gram"))).alias("t")).withColumn("size", F.size("t"))
        most = (F.col("size") - F.ceil(F.lit(LEAST_JACCARD) * F.col("size")) + 1).cast("int")
        return ranked.select(*key, "size", F.posexplode(F.slice("t", F.lit(1), most)).alias("pos", "x")).select(*key, "size", (F.col("pos") + 1).alias("pos"), F.col("x.gram").alias("gram"))

    a = prefixes(left, ["text"], "g").select("text", "gram", F.col("size").alias("n"), F.col("pos").alias("i"))
    b = prefixes(right, ["alias", "code", "weak"], "h").select("alias", "code", "weak", "gram", F.col("size").alias("m"), F.col("pos").alias("j"))
    need = F.lit(LEAST_JACCARD / (1 + LEAST_JACCARD)) * (F.col("n") + F.col("m"))
    longer, shorter = F.greatest("n", "m"), F.least("n", "m")
    possible = (shorter >= longer * LEAST_JACCARD) & (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) + F.least("i", "j") >= need - 1e-9)
    pairs = a.join(b, "gram").filter(possible).select("text", "alias", "code", "weak").distinct()
    sets = pairs.join(left, "text").join(right.select("alias", "code", "weak", "h"), ["alias", "code", "weak"])
    common = F.size(F.array_intersect("g", "h"))
    verified = sets.withColumn("jaccard", F.round(common / (F.size("g") + F.size("h") - common), 9)).filter(F.col("jaccard") >= LEAST_JACCARD)

    @F.pandas_udf("int")
    def distance(s: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(s, t):
            x, y = x.replace(" ", ""), y.replace(" ", "")
            most = int(MOST_EDITS * max(len(x), len(y)))
            out.append(min(edits(x, y, most), edits(sounded(x), sounded(y), most)))
        return pd.Series(out, dtype="int32")

    # Kept from being moved below the exact test, where it would meet every pair.
    distance = distance.asNondeterministic()
    length = F.greatest(F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))), F.length(F.replace(F.col("alias"), F.lit(" "), F.lit(""))))
    close = verified.withColumn("share", distance("text", "alias") / length).filter(F.col("share") <= F.when(F.col("weak"), MOST_EDITS_WEAK).otherwise(MOST_EDITS))
    return close.select("text", "code", "jaccard", "share")


def found(entity: DataFrame, chat_request: DataFrame, campus_list: DataFrame) -> DataFrame:
    """Columns src_table, row_id, campus_code of every row whose campus is neither null, empty nor a code already.

    Repeated requests count once. A value that many rows hold is mapped once; the mapped values are joined back in
    salted copies, so that rows of one frequent value are spread.
    """
    given = entity.select(F.lit("entity").alias("src_table"), F.col("rec_id").alias("row_id"), F.col("campus").alias("value")).unionByName(
        chat_request.select(F.lit("chat_request").alias("src_table"), F.col("request_id").alias("row_id"), F.col("campus").alias("value"))
    )
    codes = campus_list.select(F.col("campus_code").alias("value"))
    typed = given.filter("value IS NOT NULL AND value <> ''").join(codes, "value", "left_anti").distinct()
    return spread_join(typed, map_values(typed, campus_list), ["value"], "row_id").select("src_table", "row_id", F.col("code").alias("campus_code"))
