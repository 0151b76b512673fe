"""The queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import audit, centroids, chat, decontaminate, lines, packing, quality, rans, sharding, simhash, substrings, topk, warc
from vellum.llm.common import Scratch, load
from vellum.llm.tokens import tokenizer_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = load(spark, sf_dir, "labels").where("quality = 1")
    rows = quality.judge(load(spark, sf_dir, "documents"), trusted, keep=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rows.select("doc_id", *[F.col(f"_{c}").alias(c) for c in names])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(load(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return rows.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc32").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.col("_grown").alias("grown_shard"),
    )


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.find_repeats(load(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontaminate.digest_items().alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").path("archive")
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    warc.write_archive(pages, folder, min_payload=0)
    found = warc.read_captures(pages, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "rans").path("archive")
    rans.write_archive(load(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return rans.read_archive(spark, folder).withColumnRenamed("id", "doc_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = lines.mark_repeated_lines(load(spark, sf_dir, "documents"), min_run=2)
    return marked.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.array_join("_kept", "\n"), 256).alias("kept_sha256"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.format_trees(chat.replies_of_turns(turns))
    back = out.select(F.col("tree").alias("conv_id"), "formatted", chat.parse(F.col("formatted")).alias("t"), "loss_spans")
    told = F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    loss = chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    return back.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, last = centroids.cluster(load(spark, sf_dir, "embeddings"), count=16, rounds=3, width=64, scale=64)
    rows = centroids.report(found, last, Scratch(spark, "centroids"))
    return rows.select(F.col("id").alias("vec_id"), F.col("number").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_substrings": op4_substrings,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash": op6_simhash,
    "op7_warc": op7_warc,
    "op8_rans": op8_rans,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat": op10_chat,
    "op11_topk": op11_topk,
    "op12_centroids": op12_centroids,
    "op13_audit": op13_audit,
}

#: The words of operator 5, with a list function of DuckDB.
_OP5_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op12_sql() -> str:
    near = """SELECT vec_id, y, cluster, distance FROM (
  SELECT vec_id, y, k AS cluster, list_sum(list_transform(range(1, 65), lambda i: (y[i] - c[i]) * (y[i] - c[i])))::BIGINT AS distance, n
  FROM kept, c{0}
) QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, cluster) = 1"""
    parts = [
        f"""kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS y, row_number() OVER () AS n
  FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), y) - 1 AS k, y AS c FROM kept ORDER BY k LIMIT 16
)"""
    ]
    for i in range(3):
        parts.append(f"a{i} AS ({near.format(i)})")
        parts.append(
            f"""m{i} AS (
  SELECT cluster, list(v ORDER BY i) AS c
  FROM (SELECT cluster, i, (sum(y[i]) - (sum(y[i]) % count(*) + count(*)) % count(*)) // count(*) AS v FROM a{i}, range(1, 65) AS t(i) GROUP BY cluster, i)
  GROUP BY cluster
), c{i + 1} AS (SELECT k, coalesce(m.c, o.c) AS c FROM c{i} AS o LEFT JOIN m{i} AS m ON k = cluster)"""
        )
    parts.append(f"a3 AS ({near.format(3)})")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON cluster = k"""


ORACLES: dict[str, str] = {
    "op4_substrings": r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM docs, unnest(range(1, len(w) - 33)) AS t(i)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM again, unnest(range(i, i + 35)) AS t(p)
), kept AS (
  SELECT d.doc_id, string_agg(d.x, ' ' ORDER BY d.p) AS text, count(*) AS n
  FROM (SELECT doc_id, p, w[p] AS x FROM docs, unnest(range(1, len(w) + 1)) AS t(p)) AS d
  ANTI JOIN gone AS g ON d.doc_id = g.doc_id AND d.p = g.p GROUP BY d.doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)""",
    "op5_decontaminate": f"""
WITH items AS (
  SELECT item_id, {_OP5_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS win
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), docs AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_OP5_WORDS} END AS w FROM documents
), hits AS (
  SELECT d.doc_id, d.i, win.n, win.item_id
  FROM (SELECT doc_id, i, n, w[i : i + n - 1] AS win
        FROM docs, (SELECT DISTINCT n FROM windows) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)) AS d
  JOIN windows AS win ON d.n = win.n AND d.win = win.win
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)""",
    "op9_line_dedup": r"""
WITH split AS (
  SELECT doc_id, coalesce(string_split(text, chr(10)), []) AS l FROM documents
), lines AS (
  SELECT doc_id, i, l[i] AS x, regexp_matches(l[i], '[^\x20\x09-\x0D]') AS word
  FROM split, unnest(range(1, len(l) + 1)) AS t(i)
), runs AS (
  SELECT doc_id, i, x, lead(x) OVER w AS y, lead(i) OVER w AS j FROM lines WHERE word WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT doc_id, i, j FROM runs WHERE y IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY doc_id, i) > 1
), gone AS (
  SELECT doc_id, i FROM later UNION SELECT doc_id, j FROM later
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE word) AS n_lines, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed,
         string_agg(x, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text
  FROM lines l LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split LEFT JOIN kept k USING (doc_id)""",
    "op10_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(replace(replace(text, '<', '<\'), '[', '[\'))
       + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 17
              ELSE 9 + 4 * octet_length(encode(role)) END AS size
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(size))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op11_topk": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND {_FINITE}
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score
  FROM v AS q JOIN v AS x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op12_centroids": _op12_sql(),
    "op13_audit": r"""
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS e
  FROM split LEFT JOIN told USING (doc_id)
), masks AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failed GROUP BY ALL
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f AS a, f AS b, f AS c, f AS d, f AS e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS prior FROM orders, range(1, 6) AS t(step)
), told_all AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (WHERE m & (own | prior) = 0) AS kept, sum(n) FILTER (WHERE m & own <> 0 AND m & prior = 0) AS removed,
         sum(n) FILTER (WHERE m & own <> 0 AND m & prior <> 0) AS redundant, sum(n) FILTER (WHERE m = own) AS unique_fails,
         sum(good) FILTER (WHERE m & own <> 0 AND m & prior = 0) AS good_lost, sum(toxic) FILTER (WHERE m & own <> 0 AND m & prior = 0) AS toxic_lost
  FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM told_all""",
}
