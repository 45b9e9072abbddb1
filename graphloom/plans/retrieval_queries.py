"""Queries over text, pages and vectors: tokens, BM25, dense search, fusion, shaping, diversity, page features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import pages, text
from graphloom.operators import retrieval
from graphloom.sources.tables import table

K = 8
#: The question that documents are compressed for; searches run for all eval cases, which are the stated questions.
QUESTION = "annual fee of the hostel"
#: Words that show a question after a person, for the boost of role questions.
WHO = "who is|head of|chair|decides"


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_case").select(F.col("id").alias("query_id"), "question")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def tokenize_df(spark: SparkSession, folder: str) -> DataFrame:
    posts = retrieval.postings(documents(spark, folder))
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.corpus_stats(documents(spark, folder)).select("n", F.round("mean", 6).alias("mean"))


def bm25_doc_weights(spark: SparkSession, folder: str) -> DataFrame:
    posts, stats = retrieval.postings(documents(spark, folder)), retrieval.corpus_stats(documents(spark, folder))
    weights = retrieval.weighted(posts, retrieval.term_stats(posts, stats), stats)
    return weights.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("weight"))


def _sparse(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return retrieval.search_sparse(questions(spark, folder), documents(spark, folder), k)


def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    return _sparse(spark, folder, K)


def bm25_search_diverse(spark: SparkSession, folder: str) -> DataFrame:
    found = _sparse(spark, folder, 40).join(documents(spark, folder).select("doc_id", "source"), "doc_id")
    return retrieval.diverse(found, K).select("query_id", "doc_id", "source", "score", "rank")


def _dense(spark: SparkSession, folder: str, k: int) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return retrieval.search_dense(queries, vectors, k)


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 100, against all vectors."""
    return _dense(spark, folder, 10)


def dense_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return retrieval.search_dense(queries, vectors.filter("label % 2 = 0"), 10, least=0.05)


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest vectors by cosine fused with the nearest of the same label."""
    vectors = table(spark, folder, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    even = retrieval.search_dense(queries, vectors.filter("label % 2 = 0"), 40)
    return retrieval.fuse([_dense(spark, folder, 40), even], 30, key="vec_id")


def rerank_boost(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    kind = pages.kind(F.col("url"))
    shaped = _sparse(spark, folder, 30).join(docs.select("doc_id", "url", "text"), "doc_id").join(questions(spark, folder), "query_id")
    score = retrieval.overlap_rerank(F.col("question"), F.col("text"))
    boosted = retrieval.boost(score, pages.tier(F.col("url")), pages.authority(F.col("url"), kind), F.lower("question").contains("fee"), F.lower("question").rlike(WHO))
    return retrieval.top(shaped.select("query_id", "doc_id", F.round(boosted, 6).alias("score")), K).select("query_id", "doc_id", "score", "rank")


def parent_context(spark: SparkSession, folder: str) -> DataFrame:
    """Children are the diverse results, parents the first document of each source."""
    docs = documents(spark, folder)
    parents = docs.groupBy(F.col("source").alias("parent_id")).agg(F.min_by("text", "doc_id").alias("document"))
    picked = bm25_search_diverse(spark, folder).join(docs.select("doc_id", F.col("text").alias("document")), "doc_id").withColumnRenamed("source", "parent_id")
    out = retrieval.parent_context(picked, parents)
    return out.select("query_id", "parent_id", "chunk_level", "rank", F.round("score", 6).alias("score"), F.length("document").alias("size"))


def combine_chunk_sets(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "source", F.col("text").alias("document"), F.lit("child").alias("chunk_level"))
    ranked = _sparse(spark, folder, 20).join(docs, "doc_id")
    extra, primary = ranked.filter("rank > 10"), ranked.filter("rank <= 15")
    return retrieval.combine(extra, primary, K).select("query_id", "doc_id", "source", "rank")


def sentence_compress(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).filter("text IS NOT NULL").withColumn("question", F.lit(QUESTION))
    return retrieval.compress(docs, document="text").select("doc_id", F.length("text").alias("size"), F.md5("text").alias("digest"))


def page_features(spark: SparkSession, folder: str) -> DataFrame:
    """Tier, kind, authority, level and names of every entity page."""
    url = F.col("url")
    kind = pages.kind(url)
    return table(spark, folder, "entity").filter("url IS NOT NULL").select(
        "rec_id", pages.tier(url).alias("tier"), kind.alias("kind"), pages.authority(url, kind).alias("authority"), pages.slug(url).alias("slug"), pages.host(url).alias("host"),
        pages.normalize_url(url).alias("plain_url"), pages.level(url, F.col("name")).alias("level"), pages.is_noise(url).alias("noise"), pages.parent_name(url).alias("parent_name"),
    )


def page_host_counts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).groupBy(pages.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.max("scraped_at").cast("string").alias("last_seen"))


def page_folders(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", pages.page_folder(F.col("url")).alias("folder"), text.md5_uuid(F.concat("url", F.lit("::parent"))).alias("chunk_id"))


def incremental_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that an index of all earlier pages lacks (by plain address), long enough to keep."""
    docs = documents(spark, folder)
    plain = pages.normalize_url(F.col("url"))
    indexed = docs.filter("scraped_at < timestamp'2025-06-01'").select(plain.alias("plain")).distinct()
    return docs.withColumn("plain", plain).join(indexed, "plain", "left_anti").filter("n_chars >= 200").select("doc_id", "plain")


def expand_abbreviations(spark: SparkSession, folder: str) -> DataFrame:
    short = {"dept": "department", "no": "number", "pp": "pages", "cf": "compare", "fig": "figure"}
    grown = text.expand(F.col("query"), short)
    return table(spark, folder, "chat_request").select("request_id", "query").distinct().select("request_id", grown.alias("query"))


def reformulate(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("query")
    hints = [(F.lower(q).contains("fee"), "fee structure tuition"), (F.lower(q).contains("hostel"), "hostel accommodation rooms"), (F.lower(q).contains("placement"), "campus recruitment")]
    return table(spark, folder, "chat_request").filter("query IS NOT NULL").select("request_id", "query").distinct().select("request_id", text.add_hints(q, hints).alias("query"))


def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).filter("text IS NOT NULL").select("doc_id", text.excerpt(F.col("text"), 120).alias("excerpt"))


def clean_answers(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "chat_response").filter("response IS NOT NULL").select("response_id", "response").distinct()
    return said.select("response_id", text.strip_sources(F.col("response")).alias("answer"))


def freshness(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("source").agg(F.max("scraped_at").cast("string").alias("newest"), F.min("scraped_at").cast("string").alias("oldest"), F.count("*").alias("pages"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_search_diverse, tokenize_df, corpus_stats, bm25_doc_weights, bm25_search, dense_topk, dense_topk_filtered, rrf_fusion, rerank_boost, parent_context, combine_chunk_sets, sentence_compress,
        page_features, page_host_counts, page_folders, incremental_antijoin, expand_abbreviations, reformulate, excerpts, clean_answers, freshness,
    )
}

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_POSTS = f"posts AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)) GROUP BY ALL), "
_STATS = f"stats AS (SELECT count(*) AS n, avg(coalesce(len({_TOKENS}), 0)) AS mean FROM documents), "
_TERMS = "terms AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM posts, stats GROUP BY term), "
_WEIGHTS = "weights AS (SELECT doc_id, term, idf, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(mean, 1))) AS weight FROM posts JOIN terms USING (term), stats)"
_ASKED = "questions AS (SELECT id AS query_id, question FROM eval_case), asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM questions) GROUP BY ALL), "
_SCORES = "scores AS (SELECT query_id, doc_id, round(sum(weight * qtf * idf), 6) AS score FROM weights JOIN asked USING (term) GROUP BY ALL), sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)"
_SPARSE = f"WITH {_POSTS}{_STATS}{_TERMS}{_ASKED}{_WEIGHTS}, {_SCORES}"
_DIVERSE = "found AS (SELECT s.*, source FROM sparse s JOIN documents USING (doc_id) WHERE rank <= 40), diverse AS (SELECT query_id, doc_id, source, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS nth FROM found) WHERE nth <= 2)"


def _near(where: str, k: int, least: str = "") -> str:
    pairs = "SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0"
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({pairs}{where}) {least}) WHERE rank <= {k})"


_PATH = "list_filter(string_split(regexp_replace(regexp_replace({u}, '[?#].*$', ''), '^\\w+://[^/]*', ''), '/'), lambda p: p <> '')"
_URL_PATH, _LOW_PATH = _PATH.format(u="url"), _PATH.format(u="lower(url)")


def _tier(url: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower({url}), {p!r})' for p in parts)} THEN '{name}'" for name, parts in pages.TIERS)
    return f"CASE {cases} ELSE 'tier2_academic' END"


def _kind(url: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({url}), '{p}') THEN '{k}'" for p, k in pages.KINDS) + " ELSE 'general' END"


def _authority(kind: str, depth: str) -> str:
    return f"""CASE WHEN {kind} IN ('department', 'college', 'admission') THEN CASE WHEN {depth} <= 2 THEN 1.0 WHEN {depth} = 3 THEN 0.7 ELSE 0.5 END
      WHEN {kind} = 'program' THEN CASE WHEN {depth} <= 2 THEN 0.9 ELSE 0.6 END WHEN {kind} = 'faculty' THEN 0.6 WHEN {kind} = 'event' THEN 0.4 WHEN {kind} = 'article' THEN 0.3 ELSE 0.5 END::DOUBLE"""


def _read(part: str) -> str:
    return f"list_aggregate(list_transform(string_split(trim(regexp_replace({part}, '[-_\\s]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"


_MARKED = "coalesce(" + ", ".join(f"CASE WHEN list_contains(lp, '{m}') THEN lp[list_position(lp, '{m}') + 1] END" for m in ("department", "college", "admission")) + ")"
_PLAIN = "lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''))"
_SQUEEZED = "trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"
_BODY = "trim(regexp_replace(response, '(?is)(\\n|^)\\s*\\*{0,2}sources?\\*{0,2}\\s*:.*', '', 'g'), ' ')"
_SAID = f"trim(regexp_replace({_BODY}, '(?is)\\s*i don[''’]?t have (enough |specific )?information.*?[.!]\\s*', ' ', 'g'), ' ')"

ORACLES = {
    "tokenize_df": f"WITH {_POSTS}x AS (SELECT 1) SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM posts GROUP BY term",
    "corpus_stats": f"WITH {_STATS}x AS (SELECT 1) SELECT n, round(mean, 6) AS mean FROM stats",
    "bm25_doc_weights": f"WITH {_POSTS}{_STATS}{_TERMS}{_WEIGHTS} SELECT doc_id, count(*) AS terms, round(sum(weight), 4) AS weight FROM weights GROUP BY doc_id",
    "bm25_search": f"{_SPARSE} SELECT query_id, doc_id, score, rank FROM sparse WHERE rank <= {K}",
    "bm25_search_diverse": f"{_SPARSE}, {_DIVERSE} SELECT * FROM diverse WHERE rank <= {K}",
    "dense_topk": f"SELECT query_id, vec_id, score, rank FROM {_near('', 10)}",
    "dense_topk_filtered": f"SELECT query_id, vec_id, score, rank FROM {_near(' AND v.label % 2 = 0', 10, 'WHERE score >= 0.05')}",
    "rrf_fusion": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT query_id, vec_id, round(sum(1.0 / (rank + 60)), 8) AS score FROM (SELECT * FROM {_near('', 40)} UNION ALL SELECT * FROM {_near(' AND v.label % 2 = 0', 40)}) GROUP BY ALL)) WHERE rank <= 30""",
    "rerank_boost": f"""{_SPARSE}, shaped AS (SELECT s.query_id, s.doc_id, contains(lower(question), 'fee') AS adm, regexp_matches(lower(question), '{WHO}') AS role, {_tier('url')} AS tier, {_authority(_kind('url'), f'len({_URL_PATH})')} AS authority,
        len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), {_TOKENS})) / len(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))) AS base
      FROM sparse s JOIN documents USING (doc_id) JOIN questions USING (query_id) WHERE rank <= 30)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id,
        round(base * CASE WHEN NOT adm THEN 1.0 WHEN tier = 'tier1_admission' THEN 1.5 WHEN tier = 'tier2_academic' THEN 1.0 ELSE 0.9 END * CASE WHEN role THEN 0.5 + authority ELSE 0.8 + 0.2 * authority END, 6) AS score FROM shaped)) WHERE rank <= {K}""",
    "parent_context": f"""{_SPARSE}, {_DIVERSE}, picked AS (SELECT d.query_id, d.source AS parent_id, d.rank, d.score, text AS document FROM diverse d JOIN documents USING (doc_id) WHERE d.rank <= {K}),
      parents AS (SELECT source AS parent_id, arg_min(text, doc_id) AS document FROM documents WHERE text IS NOT NULL GROUP BY source),
      first AS (SELECT query_id, parent_id, min(rank) AS rank FROM picked GROUP BY ALL)
      SELECT query_id, parent_id, 'parent' AS chunk_level, rank, 0.0 AS score, len(document)::INT AS size FROM first JOIN parents p USING (parent_id)
        WHERE NOT EXISTS (SELECT 1 FROM picked x WHERE x.query_id = first.query_id AND x.document = p.document)
      UNION ALL SELECT query_id, parent_id, 'child', rank, score, len(document)::INT FROM picked""",
    "combine_chunk_sets": f"""{_SPARSE}, ranked AS (SELECT s.query_id, s.doc_id, s.rank, source, text AS document FROM sparse s JOIN documents USING (doc_id) WHERE rank <= 20),
      every AS (SELECT *, 0 AS f FROM ranked WHERE rank > 10 UNION ALL SELECT *, 1 FROM ranked WHERE rank <= 15),
      once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, document[1:160] ORDER BY f, rank) AS n FROM every) WHERE n = 1),
      few AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY f, rank) AS nth FROM once)
      SELECT * FROM (SELECT query_id, doc_id, source, row_number() OVER (PARTITION BY query_id ORDER BY f, rank) AS rank FROM few WHERE nth <= 2) WHERE rank <= {K}""",
    "page_features": f"""SELECT rec_id, {_tier('url')} AS tier, {_kind('url')} AS kind, {_authority(_kind('url'), 'len(up)')} AS authority, coalesce(up[-1], '') AS slug,
      lower(regexp_extract(url, '^\\w+://([^/?#]*)', 1)) AS host, {_PLAIN} AS plain_url,
      CASE {' '.join(f"WHEN regexp_matches(lower(concat_ws(' ', url, name[1:300])), '{p}', 'i') THEN '{v}'" for p, v in pages.LEVELS)} ELSE '' END AS level,
      regexp_matches(url, '{'|'.join(pages.NOISE)}', 'i') AS noise, coalesce({_read(_MARKED)}, '') AS parent_name
      FROM (SELECT *, {_URL_PATH} AS up, {_LOW_PATH} AS lp FROM entity WHERE url IS NOT NULL)""",
    "page_host_counts": "SELECT lower(regexp_extract(url, '^\\w+://([^/?#]*)', 1)) AS host, count(*) AS pages, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM documents GROUP BY 1",
    "page_folders": """SELECT doc_id, regexp_replace(regexp_replace(url, '^\\w+://', ''), '[^A-Za-z0-9]+', '_', 'g')[1:60] || '_' || md5(url)[1:8] AS folder,
      regexp_replace(md5(url || '::parent'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS chunk_id FROM documents""",
    "incremental_antijoin": f"WITH d AS (SELECT *, {_PLAIN} AS plain FROM documents) SELECT doc_id, plain FROM d WHERE n_chars >= 200 AND plain NOT IN (SELECT plain FROM d WHERE scraped_at < TIMESTAMP '2025-06-01')",
    "reformulate": """SELECT DISTINCT request_id, concat_ws(' ', trim(query), CASE WHEN contains(lower(query), 'fee') THEN 'fee structure tuition' END,
      CASE WHEN contains(lower(query), 'hostel') THEN 'hostel accommodation rooms' END, CASE WHEN contains(lower(query), 'placement') THEN 'campus recruitment' END) AS query FROM chat_request WHERE query IS NOT NULL""",
    "excerpts": f"""SELECT doc_id, CASE WHEN len(s) <= 120 THEN s WHEN contains(s[1:120], ' ') THEN trim(regexp_extract(s[1:120], '^(.*) ', 1)) || '...' ELSE s[1:120] || '...' END AS excerpt
      FROM (SELECT doc_id, {_SQUEEZED} AS s FROM documents WHERE text IS NOT NULL)""",
    "clean_answers": f"SELECT DISTINCT response_id, CASE WHEN len({_SAID}) >= 40 THEN {_SAID} ELSE {_BODY} END AS answer FROM chat_response WHERE response IS NOT NULL",
    "freshness": "SELECT source, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS newest, strftime(min(scraped_at), '%Y-%m-%d %H:%M:%S') AS oldest, count(*) AS pages FROM documents GROUP BY source",
}
