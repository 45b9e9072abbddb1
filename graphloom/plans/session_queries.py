"""Queries over chunks, names, conversations, evaluation, routing and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import admissions, chunking, evaluation, graph, hierarchy, matching, routing, sessions
from graphloom.plans import answering
from graphloom.plans.pipeline_queries import _LINKS
from graphloom.providers import hashed_embedder, overlap_reranker
from graphloom.session import materialize
from graphloom.sources.tables import table
from graphloom.streaming import windows


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text IS NOT NULL")


def chunk_semantic(spark: SparkSession, folder: str) -> DataFrame:
    packed = _docs(spark, folder).select("doc_id", F.posexplode(chunking.pack(F.col("text"), lossless=True)).alias("chunk_ix", "document"))
    return packed.select("doc_id", "chunk_ix", F.length("document").alias("size"), F.md5("document").alias("digest"))


def chunk_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive splitting of the documents that packing gives no chunk of."""
    none = _docs(spark, folder).filter(F.size(chunking.pack(F.col("text"))) == 0)
    return chunking.fallback_chunks(none).select("doc_id", "chunk_ix", F.length("document").alias("size"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("url", "title", F.col("text").alias("content"), F.lit("").alias("table_text"), F.concat(F.lit("source: "), "source").alias("infobox_text"))


def chunk_parent(spark: SparkSession, folder: str) -> DataFrame:
    parents = chunking.build_chunks(_pages(spark, folder)).filter("chunk_level = 'parent'")
    return parents.select("chunk_id", "url", F.length("document").alias("size"))


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    children = chunking.build_chunks(_pages(spark, folder), least=1).filter("chunk_type = 'infobox'")
    return children.select("chunk_id", "url", "chunk_type", "chunk_level", "chunk_ix", "parent_id")


def chunk_ids_all(spark: SparkSession, folder: str) -> DataFrame:
    """Children of every type that hold the whole text; the SQL of chunk_ids has those of type infobox."""
    children = chunking.build_chunks(_pages(spark, folder), lossless=True).filter("chunk_level = 'child'")
    return children.select("chunk_id", "url", "chunk_type", "chunk_level", "chunk_ix", "parent_id")


def name_token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of the official list against programs' names: pairs of distinct word sets that share enough."""
    words = lambda df, name, key: df.select(text.word_set(F.col(name)).alias("words")).filter("size(words) > 0").select(F.array_join("words", " ").alias(key), "words").distinct()
    programs = table(spark, folder, "entity").filter("entity_type = 'program'")
    return matching.overlaps(words(table(spark, folder, "program_listing"), "title", "lkey"), words(programs, "name", "rkey"), 0.8, symmetric=True)


def fuzzy_best_match(spark: SparkSession, folder: str) -> DataFrame:
    listing = table(spark, folder, "program_listing").filter("title IS NOT NULL").select(F.col("listing_id").alias("row_id"), F.col("title").alias("text"))
    programs = graph.entities_of(table(spark, folder, "entity")).filter("entity_type = 'program' AND name IS NOT NULL").select(F.col("id").alias("name_id"), F.col("name").alias("text"))
    return matching.best_names(listing, programs)


def longest_name_in_text(spark: SparkSession, folder: str) -> DataFrame:
    """The longest name of a unit inside each question."""
    asked = table(spark, folder, "chat_request").filter("query IS NOT NULL").select(F.col("request_id").alias("text_id"), text.match_text(F.col("query")).alias("text")).distinct()
    units = graph.entities_of(table(spark, folder, "entity"))
    return matching.names_in_texts(asked, matching.normalized_names(units, ("department", "school", "college", "centre")))


def _catalogues(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    official = table(spark, folder, "program_listing").select(F.col("listing_id").alias("lid"), F.col("title").alias("name"), "url")
    known = graph.entities_of(table(spark, folder, "entity")).filter("entity_type = 'program'").select(F.col("id").alias("rid"), "name", "url")
    return official, known


def reconcile_tiers(spark: SparkSession, folder: str) -> DataFrame:
    return matching.exact_tiers(*_catalogues(spark, folder))


def reconcile_missing(spark: SparkSession, folder: str) -> DataFrame:
    official, known = _catalogues(spark, folder)
    return official.join(matching.exact_tiers(official, known), "lid", "left_anti").select("lid", "name")


def reconcile_stale(spark: SparkSession, folder: str) -> DataFrame:
    official, known = _catalogues(spark, folder)
    return known.join(matching.exact_tiers(official, known), "rid", "left_anti").select("rid", "name")


def reconcile_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    official, known = _catalogues(spark, folder)
    return matching.fuzzy_tier(official, known, matching.exact_tiers(official, known))


def department_match(spark: SparkSession, folder: str) -> DataFrame:
    e = graph.entities_of(table(spark, folder, "entity")).filter("name IS NOT NULL")
    programs = e.filter("entity_type = 'program'").select(F.col("id").alias("program_id"), "name")
    return matching.department_of(programs, e.filter("entity_type = 'department'").select(F.col("id").alias("department_id"), "name"))


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "chat_request").filter("session_id IS NOT NULL AND asked_at IS NOT NULL").groupBy("request_id").agg(F.min("session_id").alias("session_id"), F.min("query").alias("question"), F.min("asked_at").alias("at"))
    said = table(spark, folder, "chat_response").groupBy("request_id").agg(F.min("response").alias("answer"))
    return asked.join(said, "request_id", "left").withColumnRenamed("request_id", "turn_id")


def session_context(spark: SparkSession, folder: str) -> DataFrame:
    """What came before each question, where sessions are the logs of one campus and day."""
    t = _turns(spark, folder).withColumn("session_id", F.concat(F.substring("session_id", 1, 3), F.date_format("at", "-yyyy-MM-dd")))
    return sessions.context(t, idle=43200).select("session_id", "turn_id", F.length("context").alias("size"), F.md5("context").alias("digest"))


def session_recent_turns(spark: SparkSession, folder: str) -> DataFrame:
    t = _turns(spark, folder).withColumn("session_id", F.concat(F.substring("session_id", 1, 3), F.date_format("at", "-yyyy-MM-dd")))
    return sessions.recent_turns(t, 3, 20).select("session_id", "turn_id", "n")


def pronoun_followups(spark: SparkSession, folder: str) -> DataFrame:
    """Questions and answers that refer to what was said before."""
    said = table(spark, folder, "chat_response").select(F.col("response_id").alias("row_id"), F.col("response").alias("text"), F.lit("answer").alias("side"))
    asked = table(spark, folder, "chat_request").select(F.col("request_id").alias("row_id"), F.col("query").alias("text"), F.lit("question").alias("side"))
    return said.unionByName(asked).distinct().filter(sessions.follow_up(F.col("text"))).select("side", "row_id")


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("request_id"), F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type")).alias("key"), F.col("ts").cast("timestamp").alias("at"))


def cache_ttl_sim(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.cache_hits(_requests(spark, folder), 86400 * 2)


def cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.cache_stats(sessions.cache_hits(_requests(spark, folder), 86400 * 2))


def cache_evict(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.evict(_requests(spark, folder), 50).select("key", F.date_format("used", "yyyy-MM-dd HH:mm:ss").alias("used"))


def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "eval_results").select("result_id", "id", "detected_intent", F.col("answer_preview").alias("answer"), "latency_seconds")
    return evaluation.score(results, table(spark, folder, "eval_case"))


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.summary(eval_metrics(spark, folder))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chat_request").filter("query IS NOT NULL").select("request_id", "query").distinct()


def intent_classify(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("query")
    flags = [c.alias(n) for n, c in routing.intent_flags(q).items()]
    return _asked(spark, folder).select("request_id", routing.query_type(q).alias("query_type"), *flags, routing.intent_label(q).alias("label"))


def route_domain_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Task and domain by the words alone."""
    q, no = F.col("query"), F.lit(False)
    asked = _asked(spark, folder).withColumn("task", routing.task(q, no))
    return asked.select("request_id", "task", routing.best_domain(routing.domain_scores(q, F.col("task"), no, no, no)).alias("domain"))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "chat_request").filter("query IS NOT NULL")
    one = asked.groupBy(F.col("request_id").alias("query_id")).agg(F.min("query").alias("question"), F.min("campus").alias("selected_campus"), F.min(F.struct("pinned_context.type", "pinned_context.value", "pinned_context.entity_id", "pinned_context.display_name")).alias("pinned"))
    return one.withColumn("context", F.lit(""))


def _campuses(spark: SparkSession, folder: str) -> dict[str, str]:
    rows = table(spark, folder, "campus_list").select("campus_code", "campus_name", "city").collect()
    return {alias: r["campus_code"] for r in rows for alias in (r["campus_name"], r["city"], r["campus_code"]) if alias}


def route_queries(spark: SparkSession, folder: str) -> DataFrame:
    e = graph.entities_of(table(spark, folder, "entity")).filter("name IS NOT NULL")
    r = routing.route(_questions(spark, folder), e, _campuses(spark, folder))
    return r.select("query_id", "task", "domain", "routing_target", "campus", "department_id", "college_id", F.get("programs", F.lit(0))["id"].alias("program_id"), "confidence", "needs_decomposition", "used_pinned_context")


def plan_answers(spark: SparkSession, folder: str) -> DataFrame:
    e, r = graph.entities_of(table(spark, folder, "entity")).filter("name IS NOT NULL"), graph.edges_of(table(spark, folder, "relationship"))
    p = routing.plan(routing.route(_questions(spark, folder), e, _campuses(spark, folder)), e, r)
    return p.select("query_id", "response_shape", F.array_join("comparison_axes", ",").alias("axes"), F.size("candidate_items").alias("items"), F.size("steps").alias("steps"), F.array_join("missing_info", ",").alias("missing"))


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    pin = F.lit(None).cast("struct<type:string,value:string,entity_id:string,display_name:string>")
    return table(spark, folder, "eval_case").select(F.col("id").alias("query_id"), "question", F.lit(None).cast("string").alias("selected_campus"), pin.alias("pinned"), F.lit("").alias("context"))


def answer_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The eval cases answered from the documents' chunks and the graph, in one job."""
    e, r = graph.entities_of(table(spark, folder, "entity")).filter("name IS NOT NULL"), graph.edges_of(table(spark, folder, "relationship"))
    children, parents = answering.chunked(table(spark, folder, "documents"))
    out = answering.answer_queries(_cases(spark, folder), children, e, r, _campuses(spark, folder), parents=parents)
    return out.select("query_id", "intent", "domain", "task", "confidence", F.length("response").alias("size"), F.size("sources").alias("sources"))


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse and dense search of the eval cases over all documents, fused."""
    chunks = _docs(spark, folder).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("document"))
    return answering.hybrid_search(_cases(spark, folder).select("query_id", "question"), chunks, 40, hashed_embedder(), 10)


def hybrid_in_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's own question searched among the documents of this source only."""
    chunks = _docs(spark, folder).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("document"), F.col("source").alias("scope"))
    asked = table(spark, folder, "mix_target").select(F.col("source").alias("query_id"), F.lit("annual fee of the hostel").alias("question"), F.col("source").alias("scope"))
    return answering.hybrid_search(asked, chunks, 40, None, 5).select("query_id", "chunk_id", "rank")


def retrieve_full(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search, reranking, boosts, diversity and parents of the eval cases over the chunks of all documents."""
    children, parents = answering.chunked(table(spark, folder, "documents"))
    found = answering.retrieve(_cases(spark, folder).select("query_id", "question"), children, rerank=overlap_reranker(), embed=hashed_embedder())
    return answering.with_parents(found, parents).select("query_id", "rank.first", "rank.rank", "source", F.length("document").alias("size"))


def decompose_retrieve(spark: SparkSession, folder: str) -> DataFrame:
    """What the steps of the comparing chat questions' plans find, with the step that found it."""
    e, r = graph.entities_of(table(spark, folder, "entity")).filter("name IS NOT NULL"), graph.edges_of(table(spark, folder, "relationship"))
    # Questions whose words rule steps out are neither matched nor planned; of the entities, steps name programs only.
    asking = materialize(_questions(spark, folder).filter(routing.may_have_steps(F.col("question"))))
    programs = e.filter("entity_type = 'program'")
    planned = routing.plan(routing.route(asking, programs, _campuses(spark, folder)), programs, r)
    asked = answering.steps(planned).select(F.concat_ws("|", "query_id", "step").alias("query_id"), "question")
    children, _ = answering.chunked(table(spark, folder, "documents"))
    return answering.retrieve(asked, children, rerank=overlap_reranker(), final=4).select("query_id", "chunk_id", "rank")


def route_metadata(spark: SparkSession, folder: str) -> DataFrame:
    e = graph.entities_of(table(spark, folder, "entity")).filter("name IS NOT NULL")
    return routing.to_metadata(routing.route(_questions(spark, folder), e, _campuses(spark, folder)))


def event_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return windows.tumbling(table(spark, folder, "events")).select(F.col("start").cast("string").alias("start"), "event_type", "events", F.round("value", 2).alias("value"))


def event_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return windows.sliding(table(spark, folder, "events")).select(F.col("start").cast("string").alias("start"), "events", F.round("value", 2).alias("value"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    s = windows.sessions(table(spark, folder, "events"), "6 hours")
    return s.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")], "events", F.round("value", 2).alias("value"))


def page_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut at the words that often begin their parts."""
    headings = (("first", ("In addition",)), ("clause", ("Under clause",)), ("notice", ("As stated in circular",)))
    found = _docs(spark, folder).select("doc_id", F.explode(text.sections(F.col("text"), headings)).alias("s"))
    return found.select("doc_id", F.col("s.field").alias("field"), F.length("s.body").alias("size"), F.md5("s.body").alias("digest"))


def governing_admissions(spark: SparkSession, folder: str) -> DataFrame:
    e, r = graph.entities_of(table(spark, folder, "entity")), graph.edges_of(table(spark, folder, "relationship"))
    programs = e.filter("entity_type = 'program'").select(F.col("id").alias("program_id"))
    above = admissions.lineage(hierarchy.hierarchy_links(table(spark, folder, "relationship")))
    return admissions.governing(programs, r, above)


def hashed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The default embedder over all documents: length of each vector."""
    v = hashed_embedder()(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_semantic, chunk_fallback, chunk_parent, chunk_ids, chunk_ids_all, name_token_overlap, fuzzy_best_match, longest_name_in_text, reconcile_tiers, reconcile_missing, reconcile_stale, reconcile_fuzzy, department_match,
        session_context, session_recent_turns, pronoun_followups, cache_ttl_sim, cache_stats, cache_evict, eval_metrics, eval_summary, intent_classify, route_domain_scores, route_queries, plan_answers, answer_queries, hybrid_search, hybrid_in_scope, retrieve_full, decompose_retrieve, route_metadata,
        event_tumbling, event_sliding, event_sessions, page_sections, governing_admissions, hashed_vectors,
    )
}


def _ascii(column: str) -> str:
    return f"regexp_replace(regexp_replace(lower(replace({column}, 'İ', 'I')), '[^\\p{{L}}\\p{{N}}\\x00-\\x7F]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g')"


def _rewritten(column: str, rules: tuple) -> str:
    out = _ascii(column)
    for pattern, new in rules:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return out


_MATCH_STOP = ", ".join(f"'{w}'" for w in text.MATCH_STOPWORDS)
_PROG_STOP = ", ".join(f"'{w}'" for w in text.PROGRAM_STOPWORDS)


def _match_text(column: str) -> str:
    plain = f"regexp_replace({_rewritten(column, text.MATCH_ALIASES)}, '[^a-z0-9]+', ' ', 'g')"
    return f"array_to_string(list_filter(string_split({plain}, ' '), lambda w: w <> '' AND w NOT IN ({_MATCH_STOP})), ' ')"


def _program_text(column: str) -> str:
    return f"trim(regexp_replace({_rewritten(column, text.DEGREE_ALIASES)}, '[^a-z0-9]+', ' ', 'g'))"


def _word_set(column: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({_program_text(column)}, ' '), lambda w: len(w) >= 2 AND w NOT IN ({_PROG_STOP}))))"


_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id DESC) AS n FROM entity WHERE id <> '') WHERE n = 1"
_SLUG = "coalesce(list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^\\w+://[^/]*', ''), '/'), lambda p: p <> '')[-1], '')"
_COMP = "coalesce(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(replace(regexp_replace(name, '[–—]', '-', 'g'), ' ', ' ')), '&', 'and', 'g'), '\\bw/s\\b', 'with specialization', 'g'), '\\b(hons\\b\\.?|honours\\b)', 'honors', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), '\\.+$', ''), '')"
_TIERS = f"""l AS (SELECT listing_id AS lid, title AS name, url FROM program_listing), k AS (SELECT id AS rid, name, url FROM ({_LAST}) WHERE entity_type = 'program'),
ls AS (SELECT lid, {_SLUG} AS slug, {_COMP} AS plain FROM l), ks AS (SELECT rid, {_SLUG} AS slug, {_COMP} AS plain FROM k),
t1 AS (SELECT lid, rid FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY lid) AS n FROM ls WHERE slug <> '') JOIN (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY rid) AS n FROM ks WHERE slug <> '') USING (slug, n)),
t2 AS (SELECT lid, rid FROM (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY lid) AS n FROM ls WHERE plain <> '' AND lid NOT IN (SELECT lid FROM t1)) JOIN (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY rid) AS n FROM ks WHERE plain <> '' AND rid NOT IN (SELECT rid FROM t1)) USING (plain, n)),
tiers AS (SELECT lid, rid, 1.0 AS score, 'url_slug' AS method FROM t1 UNION ALL SELECT lid, rid, 0.95, 'normalized_name' FROM t2)"""
_TURNS = """asked AS (SELECT request_id, min(session_id) AS s, min(query) AS question, min(asked_at) AS moment FROM chat_request WHERE session_id IS NOT NULL AND asked_at IS NOT NULL GROUP BY 1),
said AS (SELECT request_id, min(response) AS answer FROM chat_response GROUP BY 1),
turns AS (SELECT request_id AS turn_id, s[1:3] || strftime(moment, '-%Y-%m-%d') AS session_id, question, answer, moment FROM asked LEFT JOIN said USING (request_id))"""
_REQ = "req AS (SELECT event_id AS request_id, md5(user_id || '|' || event_type) AS key, ts AS moment, epoch(ts)::BIGINT AS s FROM events)"
_HITS = f"""{_REQ}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY moment, request_id) AS n FROM req),
miss AS (SELECT key, n, s FROM o WHERE n = 1 UNION ALL SELECT o.key, o.n, o.s FROM miss m JOIN o ON o.key = m.key AND o.n = (SELECT min(x.n) FROM o x WHERE x.key = m.key AND x.n > m.n AND x.s - m.s > 172800)),
hits AS (SELECT request_id, o.key, miss.n IS NULL AS hit FROM o LEFT JOIN miss USING (key, n))"""


def _has(pattern: str) -> str:
    return f"coalesce(regexp_matches(plain, '{pattern}'), false)"


def _case(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs) + f" ELSE '{otherwise}' END"


_R = routing
_W = _R._any
_BT, _DT = _has(_W(r"b\.?\s*tech|btech|b\.?\s*e\.?|be")), _has(_W(r"when|date|opening|open|start|starts|starting|timeline|schedule|deadline|last\s+date"))
_FLAGS = {
    "is_admission_date_query": f"({_has(_W(r'admissions?|apply|application|enroll?ment'))} AND {_DT}) OR ({_BT} AND {_DT})", "is_how_to_apply_query": _has(_W(r"how\s+to\s+apply|application\s+process|apply\s+for")),
    "is_btech_query": _BT, "is_role_query": _has(_W(r"hod|head\s+of(\s+the)?\s+department|head\s+of|chairperson|chair\s+person|department\s+head")),
}
_TYPE = _case([(_has(p), n) for p, n in _R.QUERY_TYPES], "factual")
_ASKED = f"(SELECT DISTINCT request_id, query, lower(replace(query, 'İ', 'I')) AS plain FROM chat_request WHERE query IS NOT NULL)"
_TASK = _case([(_has(_R.COMPARE), "compare"), (_has(_R.LIST), "list"), (_has(_R.ELIGIBILITY), "eligibility_check"), (_has(_R.PROCEDURE), "procedure"), (_has(_R.TIMELINE), "timeline"), (_has(_R.ROLE), "lookup")], "general")


def _n(c: str, w: float) -> str:
    return f"(CASE WHEN {c} THEN {w} ELSE 0 END)"


_D, _P = _has(_R.DEPARTMENTS), _has(_R.PROGRAMS)
_SCORES = {
    "admissions": f"{_n(_has(_R.ADMISSION), 2)} + " + _n("task IN ('eligibility_check', 'procedure', 'timeline')", 1), "fees": _n(_has(_R.FEES), 2), "faculty": _n(_has(_R.ROLE), 2),
    "programs": f"{_n(_P, 1.5)} + " + _n(f"task = 'list' AND {_P}", 1), "departments": f"{_n(_D, 1.5)} + " + _n(f"task = 'list' AND {_D}", 1),
    "placements": _n(_has(_R.PLACEMENT), 2), "research": _n(_has(_R.RESEARCH), 2), "campus_life": _n(_has(_R.CAMPUS_LIFE), 2),
}
_INTENT = "CASE WHEN c.expected_intent = 'general_query' THEN 1.0 " + " ".join(f"WHEN c.expected_intent = '{k}' AND detected_intent IN ({', '.join(repr(x) for x in v)}) THEN 1.0" for k, v in evaluation.INTENTS.items()) + " WHEN c.expected_intent = detected_intent THEN 1.0 ELSE 0.0 END"
_NOANS = " OR ".join("contains(lower(a), '" + p.replace("'", "''") + "')" for p in evaluation.NO_ANSWER)


def _share(terms: str) -> str:
    return f"CASE WHEN len({terms}) = 0 THEN 1.0 ELSE round_even(len(list_filter({terms}, lambda t: contains(lower(a), lower(t)))) / len({terms}), 2) END"


_METRICS = f"""m AS (SELECT result_id, c.id, {_INTENT} AS intent, {_share('c.expected_keywords')} AS keyword_recall, {_share('c.expected_items')} AS item_completeness, len(c.expected_items) > 0 AS has_items,
  (contains(a, '[1]') OR contains(a, '[2]') OR contains(a, 'Sources:') OR contains(a, 'http'))::INT::DOUBLE AS citation, (NOT ({_NOANS}))::INT::DOUBLE AS faithfulness,
  (len(list_filter(c.should_not_contain, lambda t: contains(lower(a), lower(t)))) = 0)::INT::DOUBLE AS hallucination_free,
  round(0.5 + CASE WHEN len(a) > 100 THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(a, '[-*]\\s+\\w') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(a, '[0-9]+[.)\\s]') THEN 0.15 ELSE 0 END, 2)::DOUBLE AS quality, latency_seconds
  FROM (SELECT *, coalesce(answer_preview, '') AS a FROM eval_results) r JOIN eval_case c ON c.id = r.id),
scored AS (SELECT *, intent = 1 AND keyword_recall >= 0.5 AND faithfulness = 1 AS passed FROM m)"""


def _pct(c: str) -> str:
    return f"round_even(avg({c}) * 100, 1)"


_HEAD = "'Title: ' || coalesce(title, '') || chr(10) || 'URL: ' || url"

ORACLES = {
    "chunk_parent": f"""SELECT regexp_replace(md5(url || '::parent'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS chunk_id, url,
      len(trim(regexp_replace({_HEAD} || chr(10) || (concat_ws(chr(10), text, '', 'source: ' || source))[1:2000], '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '))::INT AS size FROM documents WHERE text IS NOT NULL""",
    "chunk_ids": """SELECT regexp_replace(md5(url || '::child::infobox::0'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS chunk_id, url, 'infobox' AS chunk_type, 'child' AS chunk_level, 0 AS chunk_ix,
      regexp_replace(md5(url || '::parent'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS parent_id FROM documents WHERE text IS NOT NULL""",
    "name_token_overlap": f"""WITH l AS (SELECT DISTINCT {_word_set('title')} AS lw FROM program_listing WHERE title IS NOT NULL), r AS (SELECT DISTINCT {_word_set('name')} AS rw FROM entity WHERE entity_type = 'program' AND name IS NOT NULL)
      SELECT array_to_string(lw, ' ') AS lkey, array_to_string(rw, ' ') AS rkey, share FROM (SELECT lw, rw, round(len(list_intersect(lw, rw)) / len(list_distinct(lw || rw)), 6) AS share FROM l, r WHERE len(lw) > 0 AND len(rw) > 0) WHERE share >= 0.8""",
    "longest_name_in_text": f"""WITH t AS (SELECT DISTINCT request_id AS text_id, {_match_text('query')} AS text FROM chat_request WHERE query IS NOT NULL),
      u AS (SELECT id, {_match_text('name')} AS plain FROM ({_LAST}) WHERE entity_type IN ('department', 'school', 'college', 'centre')),
      n AS (SELECT name, min(id) AS name_id FROM (SELECT id, plain AS name FROM u UNION ALL SELECT id, regexp_replace(plain, '^(department|dept|faculty|college|school|directorate|centre|center|division)\\s+', '') FROM u) WHERE name <> '' GROUP BY name)
      SELECT text_id, name_id, name FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY len(name) DESC, name_id, name) AS k FROM t JOIN n ON contains(' ' || text || ' ', ' ' || name || ' ')) WHERE k = 1""",
    "fuzzy_best_match": f"""WITH r AS (SELECT listing_id AS row_id, {_program_text('title')} AS plain, {_word_set('title')} AS w FROM program_listing WHERE title IS NOT NULL),
      n AS (SELECT min(id) AS name_id, plain, w FROM (SELECT id, {_program_text('name')} AS plain, {_word_set('name')} AS w FROM ({_LAST}) WHERE entity_type = 'program' AND name IS NOT NULL) GROUP BY plain, w),
      p AS (SELECT row_id, name_id, r.plain AS rp, n.plain AS np, round(len(list_intersect(r.w, n.w)) / len(r.w), 6) AS share FROM r, n WHERE len(r.w) > 0 AND len(n.w) > 0),
      s AS (SELECT row_id, name_id, round(share + CASE WHEN contains(np, rp) OR contains(rp, np) THEN 0.2 ELSE 0 END + CASE WHEN split_part(rp, ' ', 1) = split_part(np, ' ', 1) THEN 0.1 ELSE 0 END, 6) AS score FROM p WHERE share >= 0.45)
      SELECT row_id, name_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, name_id) AS k FROM s) WHERE k = 1""",
    "department_match": f"""WITH l AS ({_LAST}), p AS (SELECT id AS program_id, {_word_set('name')} AS w FROM l WHERE entity_type = 'program' AND name IS NOT NULL), d AS (SELECT id AS department_id, {_word_set('name')} AS w FROM l WHERE entity_type = 'department' AND name IS NOT NULL),
      s AS (SELECT program_id, department_id, round(len(list_intersect(p.w, d.w)) / len(list_distinct(p.w || d.w)), 6) AS share FROM p, d WHERE len(p.w) > 0 AND len(d.w) > 0)
      SELECT program_id, department_id, share FROM (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY share DESC, department_id) AS k FROM s WHERE share >= 0.25) WHERE k = 1""",
    "reconcile_tiers": f"WITH {_TIERS} SELECT * FROM tiers",
    "reconcile_missing": f"WITH {_TIERS} SELECT lid, name FROM l WHERE lid NOT IN (SELECT lid FROM tiers)",
    "reconcile_stale": f"WITH {_TIERS} SELECT rid, name FROM k WHERE rid NOT IN (SELECT rid FROM tiers)",
    "session_context": f"""WITH {_TURNS}, w AS (SELECT *, 'User: ' || coalesce(question, '') || chr(10) || 'Assistant: ' || coalesce(answer, '')[1:200] AS line, lag(moment) OVER (PARTITION BY session_id ORDER BY moment, turn_id) AS prior FROM turns),
      c AS (SELECT session_id, turn_id, CASE WHEN epoch(moment)::BIGINT - epoch(prior)::BIGINT <= 43200 THEN array_to_string(list(line) OVER (PARTITION BY session_id ORDER BY moment, turn_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), chr(10) || chr(10)) ELSE '' END AS context FROM w)
      SELECT session_id, turn_id, len(context)::INT AS size, md5(context) AS digest FROM c""",
    "session_recent_turns": f"""WITH {_TURNS}, s AS (SELECT session_id FROM turns GROUP BY 1 ORDER BY max(moment) DESC, session_id LIMIT 20)
      SELECT * FROM (SELECT session_id, turn_id, row_number() OVER (PARTITION BY session_id ORDER BY moment DESC, turn_id DESC) AS n FROM turns JOIN s USING (session_id)) WHERE n <= 3""",
    "pronoun_followups": "SELECT side, row_id FROM (SELECT DISTINCT 'answer' AS side, response_id AS row_id, response AS t FROM chat_response UNION ALL SELECT DISTINCT 'question', request_id, query FROM chat_request) WHERE regexp_matches(lower(t), '(^|[^a-z])(he|she|they|it|this|that|his|her|their|its|them|those|the same|above|previous)([^a-z]|$)')",
    "cache_ttl_sim": f"WITH RECURSIVE {_HITS} SELECT * FROM hits",
    "cache_stats": f"WITH RECURSIVE {_HITS} SELECT count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate FROM hits",
    "cache_evict": f"WITH {_REQ} SELECT key, strftime(max(moment), '%Y-%m-%d %H:%M:%S') AS used FROM req GROUP BY key ORDER BY max(moment) DESC, key LIMIT 50",
    "eval_metrics": f"WITH {_METRICS} SELECT * FROM scored",
    "eval_summary": f"""WITH {_METRICS} SELECT count(*) AS results, {_pct('intent')} AS intent_accuracy, {_pct('keyword_recall')} AS keyword_recall, round_even(avg(item_completeness) FILTER (has_items) * 100, 1) AS item_completeness, {_pct('citation')} AS citation_rate,
      {_pct('faithfulness')} AS faithfulness_rate, {_pct('hallucination_free')} AS hallucination_free_rate, {_pct('quality')} AS answer_quality, round_even(avg(greatest(latency_seconds, 0)), 2) AS latency, count(*) FILTER (passed) AS passed FROM scored""",
    "intent_classify": f"""SELECT request_id, {_TYPE} AS query_type, {', '.join(f'({c}) AS {n}' for n, c in _FLAGS.items())},
      CASE WHEN {_FLAGS['is_admission_date_query']} THEN 'admission_date' WHEN {_FLAGS['is_how_to_apply_query']} THEN 'how_to_apply' WHEN {_has(_R.ADMISSION)} THEN 'admission_query' ELSE {_TYPE} END AS label FROM {_ASKED}""",
    "route_domain_scores": f"""WITH t AS (SELECT *, {_TASK} AS task FROM {_ASKED}), s AS (SELECT request_id, task, {', '.join(f'{c} AS {d}' for d, c in _SCORES.items())} FROM t)
      SELECT request_id, task, CASE WHEN greatest({', '.join(_SCORES)}) <= 0 THEN 'general' {' '.join(f'''WHEN {d} = greatest({', '.join(_SCORES)}) THEN '{d}' ''' for d in _R.DOMAINS if d in _SCORES)} END AS domain FROM s""",
    "hybrid_in_scope": """WITH d AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents WHERE text IS NOT NULL),
      stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d), posts AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d) WHERE term IN ('annual', 'fee', 'of', 'the', 'hostel') GROUP BY ALL),
      terms AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM posts, stats GROUP BY term),
      scores AS (SELECT doc_id, round(sum(idf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(mean, 1)))), 6) AS score FROM posts JOIN terms USING (term), stats GROUP BY doc_id)
      SELECT source AS query_id, doc_id AS chunk_id, rank FROM (SELECT d.source, s.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY score DESC, s.doc_id) AS rank FROM scores s JOIN d USING (doc_id) WHERE d.source IN (SELECT source FROM mix_target)) WHERE rank <= 5""",
    "event_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events, round(round(sum(value), 4), 2) AS value FROM events GROUP BY ALL",
    "event_sliding": """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, round(round(sum(value), 4), 2) AS value
      FROM (SELECT value, unnest(generate_series(time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 18 HOURS, time_bucket(INTERVAL 6 HOURS, ts), INTERVAL 6 HOURS)) AS w FROM events) GROUP BY w""",
    "event_sessions": """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS events, round(round(sum(value), 4), 2) AS value FROM s GROUP BY user_id, g""",
    "governing_admissions": f"""WITH RECURSIVE {_LINKS}, e AS ({_LAST}), r AS (SELECT DISTINCT source_id, target_id, regexp_replace(lower(regexp_replace(relation_type, '^\\s+|\\s+$', '', 'g')), '[\\s_-]+', '_', 'g') AS k FROM relationship WHERE source_id <> '' AND target_id <> ''),
      g AS (SELECT DISTINCT id AS program_id, source_id AS admission_id, 'governs' AS how FROM e JOIN r ON target_id = id AND k = 'admission_governs' WHERE entity_type = 'program'),
      a AS (SELECT id, unnest(string_split(path, ' > ')) AS ancestor, depth - generate_subscripts(string_split(path, ' > '), 1) + 1 AS distance FROM tree),
      c AS (SELECT e.id AS program_id, source_id AS admission_id, row_number() OVER (PARTITION BY e.id ORDER BY distance, source_id) AS n FROM e JOIN a ON a.id = e.id AND ancestor <> e.id JOIN r ON target_id = ancestor AND k = 'admission_covers' WHERE entity_type = 'program' AND e.id NOT IN (SELECT program_id FROM g))
      FROM g UNION ALL SELECT program_id, admission_id, 'covers' FROM c WHERE n = 1""",
}
