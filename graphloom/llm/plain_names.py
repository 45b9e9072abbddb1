"""Names that read alike brought to one plain form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.lookalikes import SCRIPTS, Rewriter, alike_groups, script_of, skeleton
from graphloom.session import materialize

#: Anything but printable ASCII. Names without such a character are plain already.
ODD = r"[^\x20-\x7E]"


def character_counts(names: DataFrame) -> dict[str, int]:
    """How often each code point occurs in column name. No larger than Unicode's code space, whatever the table."""
    chars = names.select(F.explode(F.split("name", "")).alias("c")).filter("c <> ''").groupBy("c").count()
    return {r["c"]: r["count"] for r in chars.collect()}


def marked_sequences(names: DataFrame) -> tuple[str, ...]:
    """The letters with one combining mark that occur decomposed; at most one for each pair that has a composed form."""
    pairs = names.filter(F.col("name").rlike(r"\p{M}")).select(F.explode(F.regexp_extract_all("name", F.lit(r"([\p{IsLatin}\p{IsGreek}\p{IsCyrillic}]\p{M})"), F.lit(1))).alias("s"))
    return tuple(r["s"] for r in pairs.distinct().collect())


def usual_scripts(names: DataFrame) -> DataFrame:
    """Columns skeleton, script: for words of shared letters only, the script in which the corpus has them most often."""
    shared = "".join(ch for group in alike_groups() for ch in group)
    words = names.select(F.explode(F.regexp_extract_all("name", F.lit(rf"(?<![\p{{L}}\p{{M}}])([{shared}]+)(?![\p{{L}}\p{{M}}])"), F.lit(1))).alias("word"))

    def scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds = [{script_of(ch) for ch in w} - {""} for w in b["word"]]
            keep = [len(k) == 1 for k in kinds]
            if not any(keep):
                continue
            yield pd.DataFrame({"skeleton": [skeleton(w) for w, k in zip(b["word"], keep) if k], "script": [next(iter(k)) for k, ok in zip(kinds, keep) if ok], "n": [n for n, k in zip(b["n"], keep) if k]})

    counted = words.groupBy("word").agg(F.count("*").alias("n")).mapInPandas(scripts, "skeleton string, script string, n long")
    by_script = counted.groupBy("skeleton", "script").agg(F.sum("n").alias("n"))
    rank = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(SCRIPTS) for x in (s, -i)]), F.col("script"))
    return by_script.groupBy("skeleton").agg(F.max_by("script", F.struct("n", rank)).alias("script"))


def plain_names(table: DataFrame, key: str = "rec_id", name: str = "name") -> DataFrame:
    """Columns KEY, name, plain_name of the rows whose name is not in its plain form.

    Null names give no row, nor do names in which nothing can be seen (they have no visible text, so no plain form); an empty name is plain. Names keep case, wording, inner and outer ordinary spaces; marks
    and letters that genuinely belong to a script stay. Each word takes the script that its own unmistakable letters
    show, else that of its neighbours, else the one in which the corpus has the word most often (Latin on a tie).
    """
    names = table.select(F.col(key).alias("key"), F.col(name).alias("name")).filter("name IS NOT NULL")
    odd = names.filter(F.col("name").rlike(ODD))
    tables = (character_counts(names), marked_sequences(odd))

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewriter, known = Rewriter(*tables), {}
        for b in batches:
            chosen = b["chosen"] if "chosen" in b else [None] * len(b)
            done = []
            for text, c in zip(b["name"], chosen):
                if c is not None:
                    done.append(rewriter.plain(text, dict(c)))
                elif text in known:
                    done.append(known[text])
                else:
                    if len(known) > 100_000:
                        known.clear()
                    done.append(known.setdefault(text, rewriter.plain(text)))
            yield pd.DataFrame({"key": b["key"], "name": b["name"], "plain_name": [d[0] for d in done], "open": [sorted(set(d[1])) for d in done]})

    schema = "key long, name string, plain_name string, open array<string>"
    first = materialize(odd.mapInPandas(rewrite, schema))
    undecided = first.filter(F.size("open") > 0).select("key", "name", F.explode("open").alias("skeleton"))
    scripts = undecided.join(usual_scripts(names), "skeleton", "left").withColumn("script", F.coalesce("script", F.lit("L")))
    chosen = scripts.groupBy("key", "name").agg(F.map_from_entries(F.collect_set(F.struct("skeleton", "script"))).alias("chosen"))
    second = chosen.mapInPandas(rewrite, schema)
    done = first.filter(F.size("open") == 0).unionByName(second)
    return done.filter(F.col("plain_name").rlike(r"\S") & (F.col("plain_name") != F.col("name"))).select(F.col("key").alias(key), "name", "plain_name")


def found(entity: DataFrame) -> DataFrame:
    """Columns rec_id, plain_name; a row given twice counts once."""
    return plain_names(entity).select("rec_id", "plain_name").distinct()
