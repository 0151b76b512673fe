"""Ready-made workflow graphs over the node types of this library."""

from __future__ import annotations

from vellum.workflow.graph import Graph


def _graph(name: str, nodes: dict[str, tuple[str, dict] | str], edges: str) -> Graph:
    """``edges``: "source.port > target.port" lines; "source ? condition > target" is a control edge."""
    out = []
    for line in filter(None, map(str.strip, edges.splitlines())):
        left, right = (x.strip() for x in line.split(" > "))
        if " ? " in left:
            source, condition = left.split(" ? ")
            out.append({"source": source, "target": right, "kind": "control", "condition": condition})
        else:
            (s, sp), (t, tp) = left.split("."), right.split(".")
            out.append({"source": s, "source_port": sp, "target": t, "target_port": tp})
    listed = [{"id": i, "type": n if isinstance(n, str) else n[0], "config": {} if isinstance(n, str) else n[1]} for i, n in nodes.items()]
    return Graph.from_dict({"id": name, "nodes": listed, "edges": out})


def parse_and_split(size: int = 512, overlap: int = 100) -> Graph:
    """Files into text, cleaned, then chunks."""
    split = ("text-splitter", {"chunk_size": size, "chunk_overlap": overlap})
    return _graph("parser", {"parse": "document-parser", "clean": "text-cleaner", "split": split}, "parse.text > clean.text\nclean.text > split.text")


def topics(max_k: int = 8) -> Graph:
    return _graph("clustering", {"corpus": "corpus-input", "topics": ("topic-clustering", {"max_k": max_k})}, "corpus.corpus > topics.corpus")


def comparison(mode: str = "line") -> Graph:
    nodes = {"original": "document-parser", "revised": "document-parser", "compare": ("comparison-agent", {"mode": mode})}
    return _graph("comparison", nodes, "original.text > compare.original_document\nrevised.text > compare.revised_document")


def rag(top_k: int = 5) -> Graph:
    """Texts indexed; questions answered from the chunks that are most alike."""
    return _graph("rag", {"clean": "text-cleaner", "index": "index-documents", "ask": ("qa-chat", {"top_k": top_k})}, "clean.text > index.documents\nindex.index > ask.index")


def protected() -> Graph:
    """Personal data masked before anything is split and embedded."""
    nodes = {"clean": "text-cleaner", "mask": "masker", "split": "text-splitter", "embed": "embedding-node"}
    return _graph("protected", nodes, "clean.text > mask.text\nmask.text > split.text\nsplit.chunks > embed.chunks")


def routed(rules: list | None = None) -> Graph:
    """Files by extension: those that can be parsed are, the rest are left to an OCR engine."""
    rules = rules or [["parser", [".docx", ".xlsx", ".csv", ".txt", ".md"]]]
    nodes = {"route": ("router", {"rules": rules}), "parse": "document-parser", "clean": "text-cleaner"}
    return _graph("routing", nodes, "route.route > parse.document\nroute ? parser > parse\nparse.text > clean.text")


TEMPLATES = {"parser": parse_and_split, "clustering": topics, "comparison": comparison, "rag": rag, "protected": protected, "routing": routed}
