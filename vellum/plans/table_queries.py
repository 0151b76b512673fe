"""Queries on library, retrieval and clustering operators, and the extensions on the star schema and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import vectors
from vellum.operators import clustering, corpus, critic, retrieval, topics
from vellum.operators.text_splitter import split_text
from vellum.sources.tables import load
from vellum.streaming.events import sessions, windowed_counts
from vellum.workflow import graph as wf
from vellum.workflow.nodes import REGISTRY
from vellum.workflow.rows import run_observed

ROUTES = [("web", [".html", ".com"]), ("numbered", [".org"])]


def _pages(spark, sf_dir):
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return load(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"))


def router_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.route(_pages(spark, sf_dir), "host", ROUTES).select("page_id", "route", "confidence")


def router_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.route(_pages(spark, sf_dir), "host", ROUTES).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = corpus.route(_pages(spark, sf_dir), "host", ROUTES)
    web = routed.where("route = 'web'").select("page_id", F.lit("html").alias("handled_by"))
    rest = routed.where("route <> 'web'").select("page_id", F.lit("other").alias("handled_by"))
    return web.unionByName(rest)


def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in (".pdf", ".TXT", ".exe", "", ".csv")])
    files = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a/file"), "doc_id", F.get(kinds, (F.col("doc_id") % 5).cast("int"))).alias("path"), (F.col("n_chars") * 20000).alias("size_bytes"))
    return corpus.validate_uploads(files).select("doc_id", "extension", "mime_type", "valid", "error")


def batch_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "documents").select("source", F.concat(F.lit("f"), "doc_id", F.lit(".pdf")).alias("path"), (F.col("n_chars") * 3000).alias("size_bytes"))
    return corpus.validate_batch(files, "source")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_stats(load(spark, sf_dir, "documents"), ["source"], "n_chars", "lang")


def corpus_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_wins(load(spark, sf_dir, "documents"), [F.col("text")], [F.col("doc_id")]).select("doc_id", "source", "n_chars")


def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "source")
    given, index = docs.where("file_id % 3 = 0"), docs.where("file_id % 7 <> 1")
    found, missing = corpus.build_corpus(given, index, docs.where("file_id % 2 = 0").select("file_id"))
    return found.select("file_id", F.lit("found").alias("state")).unionByName(missing.select("file_id", F.lit("missing").alias("state")))


def library_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    old, new = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    return corpus.upsert_latest(old, new, "user_id", "ts", "event_id")


def library_list_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return events.orderBy(F.desc("ts"), "event_id").limit(100)


def library_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id")
    return corpus.reconcile(docs.where("doc_id % 3 > 0"), docs.where("doc_id % 5 > 0"), "doc_id")


def _queries(spark, sf_dir):
    """The queries of the vector searches: every fiftieth vector."""
    return load(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def vector_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(load(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 5)


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dimension"))


def knn_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = load(spark, sf_dir, "embeddings")
    return retrieval.vote(retrieval.top_k(store, _queries(spark, sf_dir), 5), store, "vec_id", "query_id")


def positional_chunk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("index"), "text")
    vecs = load(spark, sf_dir, "embeddings").select((F.col("vec_id") % 100).alias("conv_id"), F.floor(F.col("vec_id") / 100).alias("index"), "vec_id")
    return retrieval.join_by_position(turns, vecs, ["conv_id", "index"]).select("conv_id", "index", "vec_id", F.char_length("text").alias("chars"))


def _answers(spark, sf_dir):
    """Every item of the benchmark, asked of all documents; vectors of the default embedder are all plain."""
    index = retrieval.index_documents(load(spark, sf_dir, "documents"))
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return retrieval.retrieve(index, asked, plain=True)


def qa_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _answers(spark, sf_dir)
    return found.select("query_id", F.posexplode("retrieved").alias("pos", "r")).select("query_id", F.col("r.rank").alias("rank"), F.col("r.source").alias("source"), F.col("r.score").alias("score"))


def qa_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _answers(spark, sf_dir)
    return found.select("query_id", F.md5(retrieval.build_prompt(F.col("retrieved"), F.col("question"))).alias("prompt_md5"))


def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", F.col("role").alias("source")))).alias("c"))
    chunks = F.transform("c", lambda x: F.struct(x.text.alias("text"), F.when(x.source != "system", x.source).alias("source")))
    out = {n: F.md5(retrieval.build_prompt(chunks, F.lit("Why?"), n)) for n in ("qa_concise", "summary")}
    custom = retrieval.build_prompt(chunks, F.lit("Why?"), "{context}|{chunks}|{question}", F.lit("ctx"), "Be brief.")
    return turns.select("conv_id", *[c.alias(k) for k, c in out.items()], F.md5(custom).alias("custom"))


def _claims(spark, sf_dir):
    vecs = load(spark, sf_dir, "embeddings")
    claims = vecs.where("vec_id % 5 = 0").select("label", F.col("vec_id").alias("claim_id"), F.col("embedding").alias("claim_vector"))
    evidence = vecs.where("vec_id % 5 <> 0").select("label", F.col("vec_id").alias("evidence_id"), F.col("embedding").alias("evidence_vector"))
    return retrieval.review_claims(claims, evidence, "label", "claim_id", "evidence_id", 0.75)


def critic_embedding_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("label", "claim_id", "max_similarity", "passed", "severity")


def critic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.review_score(_claims(spark, sf_dir), "label")


def _strict(prompt: Column) -> Column:
    """A provider by rule: claims from 0.5 on are supported, those under 0.2 are high issues and get a mark, the others medium ones."""
    line = r"(?m)^\[\d+\] CLAIM \(similarity ([0-9.E-]+)\): (.*)$"
    told = F.arrays_zip(F.regexp_extract_all(prompt, F.lit(line), 1).cast("array<double>").alias("s"), F.regexp_extract_all(prompt, F.lit(line), 2).alias("claim"))
    issue = lambda c: F.struct(F.when(c["s"] < 0.2, "high").otherwise("medium").alias("severity"), c["claim"].alias("claim"))
    mended = lambda c: F.struct(c["claim"].alias("original"), F.concat(F.lit("(unverified) "), c["claim"]).alias("corrected"))
    reply = F.struct(
        F.size(F.filter(told, lambda c: c["s"] >= 0.5)).alias("supported_count"),
        F.transform(F.filter(told, lambda c: c["s"] < 0.5), issue).alias("issues"),
        F.transform(F.filter(told, lambda c: c["s"] < 0.2), mended).alias("corrections"),
    )
    return F.when(prompt.isNotNull(), F.concat(F.lit("```json\n"), F.to_json(reply), F.lit("\n```")))


def critic_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's assistant turns against its other turns; similarity: the share of a claim's words that a turn has."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    answers = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(listed.text, "\n").alias("text"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0))
    claims = retrieval.claim_rows(answers, "conv_id").withColumn("w", words("claim"))
    said = turns.where("role <> 'assistant'").select("conv_id", "turn", F.explode(words("text")).alias("word"))
    shared = claims.select("conv_id", "claim_index", F.explode("w").alias("word")).join(said, ["conv_id", "word"]).groupBy("conv_id", "claim_index", "turn").count()
    best = shared.groupBy("conv_id", "claim_index").agg(F.max(F.struct("count", (-F.col("turn")).alias("t"))).alias("b"))
    texts = turns.select("conv_id", F.col("turn").alias("_turn"), F.col("text").alias("evidence"))
    found = claims.join(best, ["conv_id", "claim_index"], "left").withColumn("_turn", -F.col("b.t")).join(texts, ["conv_id", "_turn"], "left")
    given = found.select("conv_id", "claim_index", "claim", F.coalesce(F.col("b.count") / F.size("w"), F.lit(0.0)).alias("max_similarity"), "evidence")
    out = critic.review_hybrid(answers, given, "conv_id", provider=_strict)
    return out.select(
        "conv_id", "total_claims", "passed_claims", "confidence_score", "is_supported", "source_alignment", "consistency",
        F.array_join(F.transform("issues", lambda x: F.concat(x.severity, F.lit(":"), x.claim)), "|").alias("issues"),
        F.size("corrections").cast("long").alias("n_corrections"),
        F.md5("corrected_response").alias("corrected_md5"),
    )


def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    weights = clustering.tfidf(docs, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    return clustering.top_terms(weights, "lang").withColumn("weight", F.round("weight", 4))


def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_summary(clustering.cluster_topics(load(spark, sf_dir, "documents"), k=4))


def topic_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.vocabulary(load(spark, sf_dir, "documents"), "doc_id").select("kind", "term", "n", "at")


def cluster_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    assigned = clustering.cluster_topics(docs, k=4).select("doc_id", "cluster")
    return clustering.top_terms(clustering.tfidf(docs, "doc_id").join(assigned, "doc_id"), "cluster")


def centroid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.centroid_similarity(load(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustering.centroid_similarity(load(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return clustering.cluster_summary(rows.withColumnRenamed("label", "cluster"), "vec_id")


def feedback_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, " Positive ").when(F.col("toxic") == 1, "angry").otherwise("negative").alias("sentiment"), F.when(F.col("doc_id") % 2 == 0, "fix").otherwise("  ").alias("correction"))
    return corpus.validate_feedback(rows).select("doc_id", "valid", "signal", "error")


def feedback_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_validate(spark, sf_dir).groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("rejected"))


#: Uploads of at most 10,485 bytes; plans in JSON; dates of the calendar; texts to split.
_EACH = {
    "nodes": [
        {"id": "upload", "type": "document-upload", "config": {"max_file_size_mb": 0.01}},
        {"id": "plan", "type": "router-agent"},
        {"id": "dates", "type": "date-normalizer", "config": {"strict": True}},
        {"id": "split", "type": "text-splitter"},
    ],
    "edges": [
        {"source": "upload", "source_port": "document", "target": "plan", "target_port": "plan"},
        {"source": "plan", "source_port": "steps", "target": "dates", "target_port": "text"},
        {"source": "dates", "source_port": "text", "target": "split", "target_port": "text"},
    ],
}


def _files(spark, sf_dir):
    """Documents as files with a plan: some of the wrong kind, too large, with JSON that breaks off or a day that isn't there."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    id_ = F.col("doc_id")
    path = F.concat(F.lit("in/"), id_.cast("string"), F.when(F.col("source") == "src3", ".exe").otherwise(".txt"))
    reply = F.concat(F.lit('{"steps": [{"agent": "reader", "instruction": "'), id_.cast("string"), F.when(id_ % 7 == 0, '"').otherwise('"}]}'))
    due = F.when(id_ % 11 == 0, "Due 31/02/2020. ").otherwise("Due 29/02/2020. ")
    return docs.select("doc_id", path.alias("path"), F.col("n_chars").alias("size_bytes"), reply.alias("reply"), F.concat(due, "text").alias("text"))


def for_each_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = REGISTRY["for-each"].run({"documents": _files(spark, sf_dir)}, {"subgraph": _EACH, "key": "doc_id"})["results"]
    return wf.outcome_counts(results)


def for_each_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = REGISTRY["for-each"].run({"documents": _files(spark, sf_dir)}, {"subgraph": _EACH, "key": "doc_id"})["results"]
    return results.where("status = 'failure'").groupBy("node", "error").agg(F.count(F.lit(1)).alias("n"))


def table_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", "table row").when(F.col("role") == "assistant", "table column header").otherwise("table projected row header")).alias("l"))
    shape = corpus.table_counts(F.col("l"))
    return labels.select("conv_id", shape["rows"].alias("n_rows"), shape["columns"].alias("n_columns"))


def workflow_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cleaner and splitter as a workflow graph."""
    g = wf.Graph.from_dict(
        {
            "nodes": [{"id": "in", "type": "corpus-input"}, {"id": "clean", "type": "text-cleaner", "config": {"normalize_casing": "lower"}}, {"id": "split", "type": "text-splitter", "config": {"chunk_size": 256, "chunk_overlap": 56}}],
            "edges": [{"source": "in", "source_port": "documents", "target": "clean", "target_port": "text"}, {"source": "clean", "source_port": "text", "target": "split", "target_port": "text"}],
        }
    )
    runs = wf.compose(g, REGISTRY, {"in": {"documents": load(spark, sf_dir, "documents").select("doc_id", "text", "source")}}, mode="relaxed")
    if runs["split"].error:
        raise RuntimeError(runs["split"].error)
    return runs["split"].outputs["chunks"].groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("text")).alias("chars"))


def workflow_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each node of a run has observed."""
    seen = run_observed(wf.Graph.from_dict(_EACH), REGISTRY, _files(spark, sf_dir))
    told = [tuple(r[k] for k in ("node", "level", "status", "rows_in", "rows_out", "failed")) for r in seen]
    return spark.createDataFrame(told, "node string, level int, status string, rows_in long, rows_out long, failed long")


def extension_order_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    customers, nations = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")
    return joined.groupBy("n_name").agg(F.sum(cents).alias("revenue_cents"), F.countDistinct("o_orderkey").alias("orders"))


def extension_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return rows


def extension_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = load(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    return rows.select("o_custkey", "o_orderkey", "rank")


def extension_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windowed_counts(load(spark, sf_dir, "events"), "1 hour")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


def extension_event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(load(spark, sf_dir, "events"), "30 minutes")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def chunk_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split_text(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), size=1000, overlap=0)
    return parts.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.max("index").alias("last_index"))


_NAMES = (
    "router_route router_counts branch_merge upload_validation batch_validation corpus_stats corpus_dedup_first corpus_union library_upsert_latest "
    "library_list_recent library_reconcile vector_topk_per_query vector_norms knn_label_vote positional_chunk_join qa_retrieve qa_prompt "
    "prompt_templates critic_embedding_claims critic_score critic_hybrid tfidf_top_terms topic_clusters topic_vocabulary cluster_keywords centroid_similarity cluster_representatives feedback_validate "
    "feedback_signal for_each_counts for_each_failures table_shape workflow_chunks workflow_run_report extension_order_revenue extension_rollup extension_top_orders "
    "extension_event_windows extension_event_sessions chunk_source_counts"
)
QUERIES = {n: globals()[n] for n in _NAMES.split()}
