"""Mixing sources to target weights by soft membership and projected-gradient least squares."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import materialize

#: Folder of the public tokenizers' files; the file used is a parameter of token_counts.
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published splitting pattern of byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Buckets into which token ids are hashed as features of the classifier.
FEATURES = 256
#: How far a given source label is trusted against the classifier.
LABEL_TRUST = 0.9999
#: Most steps of the least squares, and the relative error at which they stop.
STEPS, TOLERANCE = 40, 1e-4


@lru_cache(maxsize=2)
def encoding(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(counts: np.ndarray) -> bytes:
    """Counts as one byte each, or as four if one of them needs more."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def unpacked(features: pd.Series) -> np.ndarray:
    """One row of counts per packed value."""
    if (features.map(len) == FEATURES).all():
        return np.frombuffer(b"".join(features), np.uint8).reshape(-1, FEATURES).astype(float)
    return np.array([np.frombuffer(f, np.uint8 if len(f) == FEATURES else np.uint32) for f in features], dtype=float).reshape(-1, FEATURES)


def token_counts(documents: DataFrame, path: str = f"{TOKENIZERS}/{TOKENIZER}") -> DataFrame:
    """Columns doc_id, source, key (hash of the text), tokens, features (counts of hashed tokens as bytes, see packed).

    Null texts count as empty. Whole texts are encoded and all their tokens counted.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            ids = [np.array(encode(t), dtype=np.int64) for t in b["text"]]
            features = [packed(np.bincount(x * 2654435761 % 4294967291 % FEATURES, minlength=FEATURES)) for x in ids]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "key": b["key"], "tokens": [len(x) for x in ids], "features": features})

    texts = documents.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("key", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("features", T.BinaryType())])
    return texts.mapInPandas(count, schema)


def classifier(counted: DataFrame, sources: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(log prior, log likelihoods) of naive Bayes over the hashed tokens, fitted to all labelled documents.

    Each batch of rows is summed where it lies; what is shuffled has one row per task and source.
    """
    place = {s: i for i, s in enumerate(sources)}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, docs = np.zeros((len(sources), FEATURES)), np.zeros(len(sources))
        for b in batches:
            which = b["source"].map(place)
            known = which.notna().to_numpy()
            if known.any():
                x = unpacked(b["features"][known])
                at = which[known].to_numpy(dtype=int)
                np.add.at(total, at, x)
                np.add.at(docs, at, 1)
        yield pd.DataFrame({"source": sources, "docs": docs, "total": list(total)})

    parts = counted.select("source", "features").mapInPandas(sums, "source string, docs double, total array<double>")
    merged = parts.groupBy("source").agg(F.sum("docs").alias("docs"), F.array(*[F.sum(F.col("total")[i]) for i in range(FEATURES)]).alias("total")).collect()
    prior, likelihood = np.ones(len(sources)), np.ones((len(sources), FEATURES))
    for r in merged:
        prior[place[r["source"]]] += r["docs"]
        likelihood[place[r["source"]]] += np.array(r["total"])
    return np.log(prior / prior.sum()), np.log(likelihood / likelihood.sum(axis=1, keepdims=True))


def posteriors(counted: DataFrame, sources: list[str], model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """counted with the column p: probabilities of the sources, from the tokens and, where there is one, the label."""
    prior, likelihood = model
    place = {s: i for i, s in enumerate(sources)}
    doubt = np.log((1 - LABEL_TRUST) / max(1, len(sources) - 1))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = unpacked(b["features"])
            # Tokens of one text are far from independent: their evidence is averaged over the text, as for 20 of them.
            z = prior + (x @ likelihood.T) * (20 / np.maximum(20, x.sum(axis=1, keepdims=True)))
            at = b["source"].map(place).to_numpy(dtype=float)
            known = np.flatnonzero(~np.isnan(at))
            z[known] += doubt
            z[known, at[known].astype(int)] += np.log(LABEL_TRUST) - doubt
            p = np.exp(z - z.max(axis=1, keepdims=True))
            yield b[["doc_id", "source", "key", "tokens"]].assign(p=list(p / p.sum(axis=1, keepdims=True)))

    return counted.mapInPandas(score, "doc_id long, source string, key string, tokens long, p array<double>")


def _totals(rows: DataFrame, n: int, of: Column) -> np.ndarray:
    """Per domain the summed tokens of the rows, each as often as `of` says and by its membership."""
    sums = rows.agg(*[F.sum(of * F.col("tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(n)]).collect()[0]
    return np.array([float(x or 0.0) for x in sums])


def rates(members: DataFrame, sources: list[str], targets: np.ndarray, caps: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(members with the columns cap and rate in 0..cap, expected tokens per domain), the latter near the targets.

    Projected gradient descent on the squared errors: each step moves a document by its domains' errors, relative to what
    there is of each domain so that a step does not overshoot, and projects it back into its bounds. A step needs one
    aggregation to one number per domain. A target beyond what the domain's documents can give is lowered to that.
    """
    n = len(targets)
    vector = lambda v: F.array(*[F.lit(float(x)) for x in v])
    dot = lambda v: F.aggregate(F.zip_with("p", vector(v), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    # A labelled document has its source's own bound; without a label the memberships weigh the bounds.
    own = F.element_at(F.create_map(*[F.lit(x) for s, c in zip(sources, caps) for x in (s, float(c))]), F.coalesce("source", F.lit("")))
    rows = members.withColumn("cap", F.coalesce(own, F.floor(dot(caps))))
    supply, most = _totals(rows, n, F.lit(1.0)), _totals(rows, n, F.col("cap"))
    goal = np.minimum(targets, most)
    share = np.where(supply > 0, goal / np.maximum(supply, 1e-9), 0.0)
    rows = materialize(rows.withColumn("rate", F.least(dot(share), "cap")))
    total, before = _totals(rows, n, F.col("rate")), np.inf
    for step in range(STEPS):
        missed = np.abs(goal - total).sum()
        if missed <= TOLERANCE * max(1.0, goal.sum()) or missed > 0.98 * before:
            break
        before = missed
        error = np.where(supply > 0, (goal - total) / np.maximum(supply, 1e-9), 0.0)
        rows = rows.withColumn("rate", F.greatest(F.lit(0.0), F.least(F.col("rate") + dot(error), "cap")))
        if step % 5 == 4:
            rows = materialize(rows)
        total = _totals(rows, n, F.col("rate"))
    return rows, total


def repeats(rate: Column) -> tuple[Column, Column]:
    """(whole part, fraction) of a rate, with rounding noise of the arithmetic removed."""
    exact = F.round(rate, 9)
    return F.floor(exact).cast("int"), exact - F.floor(exact)


def mix(documents: DataFrame, mix_target: DataFrame, path: str = f"{TOKENIZERS}/{TOKENIZER}", bucket_rows: int = 50_000) -> DataFrame:
    """Columns doc_id, source, tokens, repeats, rate: how often each document is taken into the mix.

    The mix has as many tokens as the corpus, less what sources with too few texts cannot give. Copies of one text count as one text: only the first (smallest doc_id) is
    taken, at most as often as its source allows. Rates are rounded, documents of like size together, so that within
    a source, or within each hash bucket of about bucket_rows documents of a larger one, the number of repeats differs from the
    sum of the rates by less than one; documents of sources without a target are not taken. A source with too few
    tokens for its target is taken as often as allowed and falls short; shares() reports it. An empty corpus gives no row.
    """
    goals = sorted((r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in mix_target.filter("source IS NOT NULL").collect())
    sources, caps = [g[0] for g in goals], np.array([g[2] for g in goals], dtype=float)
    counted = materialize(token_counts(documents, path))
    whole = counted.agg(F.sum("tokens")).collect()[0][0] or 0
    soft = posteriors(counted, sources, classifier(counted, sources)) if goals else None
    if soft is None:
        return counted.select("doc_id", "source", "tokens", F.lit(0).alias("repeats"), F.lit(0.0).alias("rate"))
    # The first of the copies of a text stands for all; the aggregation meets hot texts before the shuffle.
    first = soft.groupBy("key").agg(F.min(F.struct("doc_id", "source", "tokens", "p")).alias("f")).select("f.*")
    listed = F.col("source").isin(*sources)
    members = materialize(first.filter((listed | F.col("source").isNull()) & (F.col("tokens") > 0)))
    rated, _ = rates(members, sources, np.array([g[1] for g in goals]) * whole, caps)
    sizes = {r["source"]: r["count"] for r in members.groupBy("source").count().collect()}
    base, rest = repeats(F.col("rate"))
    cap = F.floor("cap").cast("int")
    # So many buckets per source that none is too large to sort in one task; their number is that of targets at most.
    pieces = F.create_map(*[F.lit(x) for s in [*sources, ""] for x in (s, 1 + sizes.get(s or None, 0) // bucket_rows)])
    buckets = F.element_at(pieces, F.coalesce("source", F.lit("")))
    split = rated.withColumns({"base": base, "rest": rest, "most": cap, "bucket": F.pmod(F.xxhash64("doc_id"), buckets)})
    order = Window.partitionBy("source", "bucket").orderBy("tokens", "doc_id")
    before = F.coalesce(F.sum("rest").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    start = F.lit(0.5)
    taken = split.withColumn("more", (F.floor(start + before + F.col("rest")) - F.floor(start + before)).cast("int"))
    chosen = taken.select("doc_id", F.least(F.col("base") + F.col("more"), "most").alias("repeats"), "rate")
    return counted.select("doc_id", "source", "tokens").join(chosen, "doc_id", "left").select("doc_id", "source", "tokens", F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


def shares(mixed: DataFrame, mix_target: DataFrame) -> DataFrame:
    """Columns source, target_share, reached_share (of the corpus' tokens), mix_share (of the mix), tokens, documents, most_repeats."""
    per = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.when(F.col("repeats") > 0, 1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    whole = mixed.agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed"), F.sum("tokens").alias("corpus"))
    joined = mix_target.select("source", "target_share").join(per, "source", "left").crossJoin(F.broadcast(whole))  # one row of totals
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("source", "target_share", *[F.coalesce(F.round(zero("tokens") / F.col(of), 6), F.lit(0.0)).alias(name) for name, of in (("reached_share", "corpus"), ("mix_share", "mixed"))], zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_repeats").alias("most_repeats"))
