"""The node types of workflow graphs: each wraps an operator, over whole relations.

Nodes that need an engine or model which isn't installed are listed all the same; they fail when planned, saying what they need. A
model or engine is given as the config value "provider", "engine" or "detector".
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import clustering, comparison, corpus, date_normalizer, images, language, masker, providers, regex_extractor, relative_dates, retrieval, text_cleaner, text_corrector
from vellum.operators.text_splitter import split_text
from vellum.sources import files
from vellum.workflow.graph import ConfigField as C
from vellum.workflow.graph import Graph, NodeType, Port
from vellum.workflow.rows import outcomes, rejected, run_rows

Inputs, Config = dict[str, DataFrame], dict[str, Any]


def _need(config: Config, key: str, what: str) -> Any:
    if config.get(key) is None:
        raise RuntimeError(f"{what} is not installed; give one as {key!r}")
    return config[key]


def _text(column: str, port: str = "text"):
    """Outputs with ``column`` as the new text."""

    def wrap(df: DataFrame) -> dict[str, DataFrame]:
        return {port: df.drop("text").withColumnRenamed(column, "text"), "all": df}

    return wrap


REGISTRY: dict[str, NodeType] = {}


def node(type_: str, category: str, inputs: str, outputs: str, *fields: C, requires: str | None = None):
    """``inputs``/``outputs``: "name:type" words; an input with "?" is optional."""

    def ports(spec: str) -> tuple[Port, ...]:
        return tuple(Port(n.rstrip("?"), t, not n.endswith("?")) for n, t in (w.split(":") for w in spec.split()))

    def add(run):
        REGISTRY[type_] = NodeType(type_, category, ports(inputs), ports(outputs), run, tuple(fields), requires)
        return run

    return add


node("document-upload", "ingestion", "file:any", "document:document", C("max_file_size_mb", "number", default=50))(
    lambda i, c: {"document": corpus.validate_uploads(i["file"], max_mb=float(c["max_file_size_mb"])).where("valid")}
)
node("document-batch-upload", "ingestion", "documents:document[]", "documents:document[] rejected:json", C("max_file_size_mb", "number", default=50))(
    lambda i, c: (lambda d: {"documents": d.where("valid"), "rejected": d.where("NOT valid")})(corpus.validate_uploads(i["documents"], max_mb=float(c["max_file_size_mb"])))
)


@node("corpus-input", "clustering", "documents?:document[] index?:document[] file_ids?:json", "corpus:corpus documents:text missing:json", C("folder_name"))
def _corpus(i: Inputs, c: Config):
    """The documents given and those of ``file_ids`` that the index has, the first of each key; the ids that nothing has."""
    if not {"documents", "file_ids"} & set(i) or ("file_ids" in i and "index" not in i):
        raise ValueError("a corpus needs documents, or file ids and an index")
    out = {}
    docs = i.get("documents")
    if "file_ids" in i:
        docs, out["missing"] = corpus.build_corpus(i["index"].limit(0) if docs is None else docs, i["index"], i["file_ids"])
    key = next((k for k in ("file_id", "doc_id", "path") if k in docs.columns), None)
    if key is not None and "file_ids" in i:
        docs = corpus.first_wins(docs, [F.col(key)], [F.col(x) for x in docs.columns if not docs.schema[x].dataType.typeName() == "map"])
    return out | {"corpus": docs.withColumn("corpus_name", F.lit(c.get("folder_name", ""))), "documents": docs}


@node("document-parser", "ingestion", "document:any", "text:text data:json", C("parse_entire_document", "boolean", default=True), C("include_tables", "boolean", default=True),
      C("include_headers_footers", "boolean", default=True), C("sheet_name"), C("max_rows_per_sheet", "number", default=5000), C("max_file_size_mb", "number", default=50))
def _parser(i: Inputs, c: Config):
    out = files.parse_documents(i["document"], bool(c["parse_entire_document"]), bool(c["include_tables"]), bool(c["include_headers_footers"]), c.get("sheet_name"), int(c["max_rows_per_sheet"]), float(c["max_file_size_mb"]))
    return {"text": out.where("status = 'success'"), "data": out}


@node("file-converter", "ingestion", "document:document", "converted_path:document text:text", C("output_mode", "select", default="text", options=("text", "pdf")), requires="an office suite for pdf")
def _converter(i: Inputs, c: Config):
    if c["output_mode"] == "pdf":
        return {"converted_path": _need(c, "engine", "a converter to PDF")(i["document"])}
    return {"text": files.parse_documents(i["document"])}


@node("watermark-remover", "ingestion", "document:image", "cleaned_document:image", C("threshold", "number", default=200), requires="an inpainting engine")
def _watermark(i: Inputs, c: Config):
    engine = _need(c, "engine", "an inpainting engine")
    return {"cleaned_document": images.transform_images(i["document"], lambda p: engine(p, images.watermark_mask(p, int(c["threshold"]))))}


@node("contrast-enhancer", "preprocessing", "image:image", "image:image", C("cutoff", "slider", default=1), C("contrast", "slider", default=1.35), C("brightness", "slider", default=1.08), C("sharpness", "slider", default=1.1))
def _contrast(i: Inputs, c: Config):
    values = {k: float(c[k]) for k in ("cutoff", "contrast", "brightness", "sharpness")}
    return {"image": images.transform_images(i["image"], lambda p: images.enhance(p, **values))}


node("image-denoise", "preprocessing", "image:image", "image:image", C("method", "select", default="median", options=("median", "gaussian")))(
    lambda i, c: {"image": images.transform_images(i["image"], lambda p, m=c["method"]: images.denoise(p, m))}
)
node("orientation-detector", "preprocessing", "image:image", "image:image")(lambda i, c: {"image": images.orient(i["image"], c.get("detector"))})

for _name, _joiner in (("ocr-node", " "), ("paddle-ocr", "\n"), ("handwriting-ocr", "\n")):

    @node(_name, "extraction", "document:image", "text:text lines:json", requires="an OCR engine")
    def _ocr(i: Inputs, c: Config, joiner: str = _joiner):
        lines = images.recognize(i["document"], _need(c, "engine", "an OCR engine"))
        return {"text": corpus.ocr_summary(lines, ["origin"], "line", joiner=joiner), "lines": lines}


node("barcode-reader", "extraction", "image:image", "text:text barcodes_data:json", requires="a barcode decoder")(
    lambda i, c: (lambda d: {"text": corpus.ocr_summary(d, ["origin"], "line"), "barcodes_data": d})(images.recognize(i["image"], _need(c, "engine", "a barcode decoder")))
)
node("table-extractor", "extraction", "document:json", "tables:table", requires="a table detector")(
    lambda i, c: {"tables": i["document"].withColumn("shape", corpus.table_counts(F.col("labels")))}
)
node("document-structure-analyzer", "structure", "document:json", "structure:json summary:json", requires="a partitioner")(
    lambda i, c: {"structure": i["document"], "summary": corpus.element_summary(i["document"], ["doc_id"], "category")}
)


@node("text-cleaner", "normalization", "text:text", "text:text all:json", C("fix_hyphenation", "boolean", default=True), C("collapse_whitespace", "boolean", default=True),
      C("strip_special_chars", "boolean", default=False), C("normalize_casing", "select", default="none", options=("none", "lower", "upper", "title")),
      C("normalize_dates", "boolean", default=False), C("date_output_format", "select", default="YYYY-MM-DD", options=tuple(date_normalizer.FORMATS)))
def _cleaner(i: Inputs, c: Config):
    names = ("fix_hyphenation", "collapse_whitespace", "strip_special_chars", "normalize_casing", "normalize_dates", "date_output_format")
    return _text("cleaned_text")(text_cleaner.clean_text(i["text"], **{k: c[k] for k in names}))


node("text-corrector", "normalization", "text:text", "text:text all:json", C("dictionary", "json", required=True), C("max_edit_distance", "number", default=1))(
    lambda i, c: _text("corrected_text")(text_corrector.correct_text(i["text"], c["dictionary"], max_distance=int(c["max_edit_distance"])))
)
node("date-normalizer", "normalization", "text:text", "text:text all:json", C("format", "select", default="YYYY-MM-DD", options=tuple(date_normalizer.FORMATS)), C("hijri", "boolean", default=True), C("strict", "boolean", default=False), C("reference"))(
    lambda i, c: _text("normalized_text")(
        relative_dates.find_all_dates(i["text"], c["reference"], fmt=c["format"], hijri=bool(c["hijri"]))
        if c.get("reference")
        else date_normalizer.normalize_dates(i["text"], fmt=c["format"], hijri=bool(c["hijri"]))
    )
)
node("masker", "preprocessing", "text:text", "text:text all:json", C("kinds", "tags", default=list(masker.KINDS)), C("mask", default="█"))(
    lambda i, c: _text("masked_text")(masker.mask_text(i["text"], kinds=tuple(c["kinds"]), mask=c["mask"]))
)
node("regex-extractor", "extraction", "text:text", "extracted:json stats:json", C("patterns", "json", required=True))(
    lambda i, c: (lambda rules: {"extracted": regex_extractor.extract_fields(i["text"], rules), "stats": regex_extractor.extraction_stats(i["text"], rules)})(
        [regex_extractor.Pattern(**p) if isinstance(p, dict) else p for p in c["patterns"]]
    )
)
node("semantic-extractor", "extraction", "text:text", "extracted:json", C("fields", "tags", required=True))(
    lambda i, c: {"extracted": providers.semantic_extract(i["text"], list(c["fields"]), c.get("provider", providers.offline))}
)
node("language-detector", "extraction", "text:text", "languages:json", C("detection_mode", "select", default="document", options=("document", "paragraph", "sentence")), C("min_probability", "slider", default=0.1), C("max_languages", "number", default=5))(
    lambda i, c: {"languages": language.detect_languages(i["text"], c["detection_mode"], min_probability=float(c["min_probability"]), max_languages=int(c["max_languages"]))}
)


@node("gap-checker", "checking", "text:text", "report:json score:json", C("template", "select", default="invoice_fr", options=tuple(regex_extractor.CHECKLISTS)), C("checklist", "json"), C("threshold", "slider", default=0.85))
def _gaps(i: Inputs, c: Config):
    fields = c.get("checklist") or regex_extractor.CHECKLISTS[c["template"]]
    fields = [regex_extractor.Field(**f) if isinstance(f, dict) else f for f in fields]
    return {"report": regex_extractor.gap_fields(i["text"], fields), "score": regex_extractor.gap_score(i["text"], fields, threshold=float(c["threshold"]))}


node("translator", "analysis", "text:text", "text:text all:json", C("from_lang", default="en"), C("to_lang", default="fr"), requires="a translator")(
    lambda i, c: _text("translated_text")(providers.translate(i["text"], c["from_lang"], c["to_lang"], c.get("provider")))
)
node("sentiment-analyzer", "analysis", "text:text", "sentiment:json")(lambda i, c: {"sentiment": providers.sentiment(i["text"], c.get("provider", providers.offline))})
node("text-splitter", "rag", "text:text", "chunks:chunks", C("chunk_size", "number", default=512), C("chunk_overlap", "number", default=100))(
    lambda i, c: {"chunks": split_text(i["text"], "text", int(c["chunk_size"]), int(c["chunk_overlap"]))}
)
node("embedding-node", "rag", "chunks:chunks", "embeddings:embedding")(lambda i, c: {"embeddings": retrieval.embed_chunks(i["chunks"])})
node("vector-store", "rag", "embeddings:embedding query_embedding:embedding", "results:chunks", C("top_k", "number", default=5), C("vector", default="vector"), C("key", default="chunk_id"))(
    lambda i, c: {"results": retrieval.top_k(i["embeddings"], i["query_embedding"], int(c["top_k"]), c["vector"], c["key"])}
)
node("index-documents", "rag", "documents:text", "index:embedding")(lambda i, c: {"index": retrieval.index_documents(i["documents"])})


@node("qa-chat", "rag", "question:text index:embedding", "answer:text retrieved_chunks:chunks", C("top_k", "number", default=5))
def _qa(i: Inputs, c: Config):
    found = retrieval.retrieve(i["index"], i["question"], int(c["top_k"]))
    prompt = retrieval.build_prompt(F.col("retrieved"), F.col("question"))
    return {"retrieved_chunks": found, "answer": found.withColumn("answer", c.get("provider", providers.offline)(prompt))}


node("prompt-builder", "rag", "chunks:chunks", "prompt:text", C("prompt_template", default="qa_with_sources"), C("system_prompt", default=""))(
    lambda i, c: {"prompt": i["chunks"].withColumn("prompt", retrieval.build_prompt(F.col("retrieved"), F.col("question"), c["prompt_template"], system=c["system_prompt"]))}
)
node("feedback-collector", "rag", "feedback:json", "signal:json stored:json")(lambda i, c: (lambda d: {"signal": d, "stored": d.where("valid")})(corpus.validate_feedback(i["feedback"])))


@node("topic-clustering", "clustering", "corpus:any", "clusters:json assignments:table", C("k", "number"), C("max_k", "number", default=8))
def _topics(i: Inputs, c: Config):
    out = clustering.cluster_topics(i["corpus"], k=int(c["k"]) if c.get("k") else None, max_k=int(c["max_k"]))
    return {"assignments": out, "clusters": clustering.cluster_summary(out).join(clustering.cluster_labels(i["corpus"], out), "cluster", "left")}


node("comparison-agent", "agents", "original_document:text revised_document:text", "comparison:json", C("mode", "select", default="line", options=("line", "paragraph")), C("ignore_whitespace", "boolean", default=True), C("ignore_case", "boolean", default=False))(
    lambda i, c: {
        "comparison": comparison.compare(
            i["original_document"].select("doc_id", F.col("text").alias("original")).join(i["revised_document"].select("doc_id", F.col("text").alias("revised")), "doc_id"),
            mode=c["mode"], ignore_whitespace=c["ignore_whitespace"], ignore_case=c["ignore_case"],
        )
    }
)
node("critic-agent", "validation", "claims:embedding evidence:embedding", "verdict:json score:json", C("threshold", "slider", default=0.75))(
    lambda i, c: (lambda d: {"verdict": d, "score": retrieval.review_score(d, "doc_id")})(retrieval.review_claims(i["claims"], i["evidence"], "doc_id", "claim_id", "evidence_id", float(c["threshold"])))
)
node("router", "orchestration", "document:any", "route:json", C("rules", "json", default=[]), C("default_route", default=corpus.DEFAULT_ROUTE), C("path", default="path"))(
    lambda i, c: {"route": corpus.route(i["document"], c["path"], [(n, list(e)) for n, e in c["rules"]], c["default_route"])}
)


@node("for-each", "orchestration", "documents:any", "results:json rejected:json", C("subgraph", "json"), C("key", default="doc_id"), C("port"))
def _for_each(i: Inputs, c: Config):
    """Each document's outcome in a subgraph, and the rows that its nodes rejected; without a subgraph, the documents as they are."""
    docs = i["documents"]
    if not c.get("subgraph"):
        return {"results": docs}
    runs = run_rows(Graph.from_dict(c["subgraph"]), REGISTRY, docs, c["key"], c.get("port"))
    return {"results": outcomes(runs, docs, c["key"]), "rejected": rejected(runs, docs, c["key"])}


node("router-agent", "agents", "plan:json", "steps:json")(lambda i, c: {"steps": providers.plan_steps(i["plan"])})
node("table-agent", "agents", "table:table", "answer:text", C("aggregation", "select", default="count", options=("count", "sum", "avg", "min", "max")), C("column", default="value"))(
    lambda i, c: {"answer": providers.ask_table(i["table"], c["aggregation"], c["column"])}
)
node("answer-generator", "agents", "agent_results:json", "answer:text")(lambda i, c: {"answer": providers.answers(i["agent_results"])})
node("summarizer", "agents", "text:text", "text:text all:json", C("style", "select", default="short", options=tuple(providers.STYLES)))(
    lambda i, c: _text("summary")(providers.summarize(i["text"], c["style"], c.get("provider")))
)
node("image-agent", "agents", "image:image", "interpretation:text", requires="a vision model")(
    lambda i, c: {"interpretation": providers.interpret_images(i["image"], _need(c, "provider", "a vision model"), "data")}
)


def missing_requirements() -> dict[str, str]:
    """Node types that need something from outside, and what."""
    return {t: n.requires for t, n in REGISTRY.items() if n.requires}
