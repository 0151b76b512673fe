"""Vector store and question answering: embeddings joined to chunks, cosine top-k, prompts, claims checked against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import vectors
from vellum.functions.text import chunks as split_chunks
from vellum.functions.text import claims as split_claims
from vellum.functions.text import is_blank, strip
from vellum.operators import products

#: Queries that are sent out at a time; more are dealt with in blocks.
QUERY_BLOCK = 2_000

#: Prompt templates.
TEMPLATES = {
    "qa_with_sources": (
        "Answer the question based ONLY on these documents. Cite which document each fact comes from. "
        "If the documents do not contain the answer, say so.\n\nDOCUMENTS:\n{chunks}\n\nQuestion: {question}\n\nAnswer:"
    ),
    "qa_concise": "Provide a concise answer based on the context below.\n\nContext:\n{chunks}\n\nQuestion: {question}\n\nAnswer:",
    "summary": "Summarize the following documents.\n\nDocuments:\n{chunks}\n\nSummary:",
    "analysis": "Analyze the following documents and extract key findings.\n\nDocuments:\n{chunks}\n\nAnalysis focus: {question}\n\nAnalysis:",
}
NO_DOCUMENTS = "[No relevant documents found]"


def embed_chunks(chunks: DataFrame, text_col: str = "text", embed=vectors.hashed_embedding) -> DataFrame:
    """``chunks`` with vector; blank ones are dropped. ``embed``: a Column function or pandas UDF from text to array."""
    return chunks.where(~is_blank(F.col(text_col))).withColumn("vector", embed(F.col(text_col)))


def join_by_position(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with their vectors by document and ordinal; chunks without a vector stay."""
    return left.join(right, keys, "left")


def top_k(
    store: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vector: str = "embedding",
    key: str = "vec_id",
    query_key: str = "query_id",
    query_vector: str = "query",
    plain: bool = False,
) -> DataFrame:
    """query_key, key, score (4 decimals), rank: the ``k`` most similar rows of the store for each query.

    Every row meets every query, in blocks of products (module products); of a batch only what may be among the best goes on.
    Vectors that aren't plain meet the others one by one. Ties in the rounded score go by ``key``. ``plain``: the store's vectors
    are known to be plain and as long as the queries', so it isn't read once more to look for others.
    """
    size = queries.agg(F.mode(F.greatest(F.size(query_vector), F.lit(0)))).first()[0] or 0
    odd, even = (store, None) if plain else _split(store, vector, size), _split(queries, query_vector, size)
    found = products.nearest(odd[0], even[0], size, k, key, vector, query_key, query_vector, True, 1e-4)
    for rows, asked in ((odd[1], queries), (odd[0], even[1])):
        if rows is not None and asked is not None:
            found = found.unionByName(_one_by_one(rows, asked, vector, key, query_key, query_vector))
    order = W.partitionBy(query_key).orderBy(F.desc("score"), key)
    scored = found.select(query_key, key, F.round("raw", 4).alias("score"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _split(rows: DataFrame, vector: str, size: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows with plain vectors of ``size`` components; the others, None if there are none."""
    good = products.plain(vector, size) if size else F.lit(False)
    rest = rows.where(~good)
    return rows.where(good), None if rest.isEmpty() else rest


def _one_by_one(store: DataFrame, queries: DataFrame, vector: str, key: str, query_key: str, query_vector: str) -> DataFrame:
    n = queries.count()
    blocks, out = max(1, -(-n // QUERY_BLOCK)), None
    score = vectors.cosine(F.col(vector), F.col(query_vector), F.col("_n"), F.col("_m"))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b)
        rows = store.select(key, vector, vectors.norm(F.col(vector)).alias("_n"))
        asked = part.select(query_key, query_vector, vectors.norm(F.col(query_vector)).alias("_m"))
        met = rows.crossJoin(F.broadcast(asked)).select(query_key, key, score.alias("raw"))
        out = met if out is None else out.unionByName(met)
    return out


def index_documents(docs: DataFrame, size: int = 512, overlap: int = 100, key: str = "doc_id", text_col: str = "text", embed=vectors.hashed_embedding) -> DataFrame:
    """key, chunk_text, index, vector: chunks trimmed, empty ones dropped, numbered anew. Narrow: no shuffle."""
    trimmed = F.filter(F.transform(split_chunks(F.col(text_col), size, overlap), lambda c: strip(c["text"])), lambda t: t != "")
    parts = docs.select(key, F.posexplode(trimmed).alias("index", "chunk_text")).select(key, "chunk_text", "index")
    return embed_chunks(parts, "chunk_text", embed)


def save_index(index: DataFrame, path: str) -> int:
    """Writes an index in place of what lies at ``path``; the number of chunks stored."""
    index.write.mode("overwrite").parquet(path)
    return index.sparkSession.read.parquet(path).count()


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def format_chunks(chunks: Column) -> Column:
    """``[i] text (source: s)`` joined by blank lines; ``chunks``: array of (text, source)."""
    lines = F.transform(
        chunks,
        lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c.text, F.when(c.source.isNotNull(), F.concat(F.lit(" (source: "), c.source, F.lit(")"))).otherwise("")),
    )
    return F.when(F.size(chunks) > 0, F.array_join(lines, "\n\n")).otherwise(NO_DOCUMENTS)


def build_prompt(chunks: Column, question: Column, template: str = "qa_with_sources", context: Column | None = None, system: str = "") -> Column:
    """A prompt by one of TEMPLATES, or by a template of the caller's with {chunks}, {context} and {question}."""
    out = F.lit(TEMPLATES.get(template, template))
    for name, value in (("{chunks}", format_chunks(chunks)), ("{context}", context if context is not None else F.lit("")), ("{question}", question)):
        out = F.replace(out, F.lit(name), value)
    return F.concat(F.lit(f"[SYSTEM]\n{system}\n\n[USER]\n"), out) if system else out


def retrieve(
    index: DataFrame, questions: DataFrame, k: int = 5, embed=vectors.hashed_embedding, question: str = "question", query_key: str = "query_id", plain: bool = False
) -> DataFrame:
    """query_key, question, and the retrieved chunks: array of (text, source, score, rank), best first.

    Texts go along with the keys of the few chunks that may be among the best, so the index is read once. ``plain``: see top_k().
    """
    asked = questions.select(query_key, question).withColumn("query", embed(F.col(question)))
    store = index.withColumn("chunk_key", F.struct("doc_id", "index", "chunk_text"))
    found = top_k(store, asked, k, "vector", "chunk_key", query_key, plain=plain)
    one = F.struct("rank", F.col("chunk_key.chunk_text").alias("text"), F.col("chunk_key.doc_id").cast("string").alias("source"), "score")
    listed = found.groupBy(query_key).agg(F.array_sort(F.collect_list(one)).alias("retrieved"))
    return questions.select(query_key, question).join(listed, query_key, "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast(listed.schema["retrieved"].dataType)))


def claim_rows(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, claim_index, claim."""
    return docs.select(key, F.posexplode(split_claims(F.col(text_col))).alias("claim_index", "claim"))


def review_claims(claims: DataFrame, evidence: DataFrame, group: str, claim_key: str, evidence_key: str, threshold: float = 0.75) -> DataFrame:
    """group, claim_key, max_similarity, best_evidence, passed, severity: dot products of claims with the evidence of their group.

    ``claims``: group, claim_key, claim_vector. ``evidence``: group, evidence_key, evidence_vector. The first of equal ones wins.
    """
    size = claims.agg(F.mode(F.greatest(F.size("claim_vector"), F.lit(0)))).first()[0] or 0
    told, held = _split(claims, "claim_vector", size), _split(evidence, "evidence_vector", size)
    found = products.nearest(held[0], told[0], size, 1, evidence_key, "evidence_vector", claim_key, "claim_vector", False, 0.0, group)
    sim = F.coalesce(vectors.dot(F.col("claim_vector"), F.col("evidence_vector")), F.lit(0.0))
    for some, rest in ((claims, held[1]), (told[1], held[0])):
        if some is not None and rest is not None:
            found = found.unionByName(some.join(rest, group).select(group, claim_key, evidence_key, sim.alias("raw")))
    # Each claim is there once without evidence, which is less than any similarity.
    none = found.schema
    alone = claims.select(group, claim_key, F.lit(None).cast(none[evidence_key].dataType).alias(evidence_key), F.lit(None).cast("double").alias("raw"))
    best = found.unionByName(alone).groupBy(group, claim_key).agg(F.max(F.struct(F.col("raw").alias("s"), (-F.col(evidence_key)).alias("e"))).alias("b"))
    best = best.withColumn("b", F.struct(F.coalesce("b.s", F.lit(0.0)).alias("s"), F.col("b.e").alias("e")))
    s = F.col("b.s")
    severity = F.when(s >= threshold, None).when(s < 0.2, "high").when(s < threshold * 0.7, "medium").otherwise("low")
    return best.select(group, claim_key, F.round(s, 4).alias("max_similarity"), (-F.col("b.e")).alias("best_evidence"), (s >= threshold).alias("passed"), severity.alias("severity"))


def review_score(reviewed: DataFrame, group: str) -> DataFrame:
    """group, total_claims, passed_claims, confidence_score, source_alignment, is_supported."""
    out = reviewed.groupBy(group).agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if("passed").alias("passed_claims"),
        F.coalesce(F.bool_or(F.col("severity") == "high"), F.lit(False)).alias("has_high"),
    )
    accuracy = F.col("passed_claims") / F.col("total_claims")
    confidence = F.when(F.col("has_high"), F.greatest(F.lit(0.0), accuracy - 0.3)).otherwise(accuracy)
    return out.select(
        group,
        "total_claims",
        "passed_claims",
        F.round(confidence, 4).alias("confidence_score"),
        F.round(accuracy, 4).alias("source_alignment"),
        ((confidence >= 0.7) & ~F.col("has_high")).alias("is_supported"),
    )


def vote(neighbours: DataFrame, labels: DataFrame, key: str, query_key: str, label: str = "label") -> DataFrame:
    """The commonest label among each query's neighbours; ties go by label."""
    counted = neighbours.join(labels.select(key, label), key).groupBy(query_key, label).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(query_key).agg(F.max_by(label, F.struct("n", -F.col(label))).alias(label), F.max("n").alias("votes"))
