"""Reply trees formatted as conversations (operator 10). Built-in functions only.

Messages point to the message that they answer. Iterative self-joins go up from every message to its root by pointer
doubling: round k joins each message with its 2^k-th ancestor and adds up the scores between them, so a tree of depth d takes log2(d)
rounds of one row a message. A root-to-leaf path is then a leaf, its score and its length. The branches of a tree are ranked by score (the
sum over the path, its mean, or the leaf's own), and only the chosen ones are listed, by the ancestors of the same rounds: what is written grows
with the messages and the chosen paths, not with all leaves' depths. Each chosen path becomes one conversation.

Template. ``<s>``, then for each turn ``[TAG] text [/TAG]``; an assistant's turn ends in ``</s>``. TAG is INST for user,
SYS for system, ANS for assistant and X with the role's UTF-8 hex digits for others. Inside texts, ``<`` and ``[`` are
followed by a backslash, so no control string can stand in a text; taking the backslashes out again gives
the text back, whatever it was. The loss mask covers each assistant's text, as spans of code points.

Edge cases. Null roles and texts count as empty. Turns of a conversation are in the order of turn, then role, then text;
null turns come first. Messages whose parent isn't there are roots; a circle of messages has no root, so no path goes through
it, nor through a reply that hangs off it. Of equal scores the branch with the least leaf id comes first. Rows with the same message id are one message. A very long
conversation is numbered in parts of TURNS turns; the formatted conversation is one value. Extra columns are left out. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, dense_rank_by_bucket

TAGS = {"user": "INST", "system": "SYS", "assistant": "ANS"}
BEGIN, END = "<s>", "</s>"
#: Values of turn that are numbered together.
TURNS = 1024


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<"))


def _tag(role: Column) -> Column:
    out = F.concat(F.lit("X"), F.hex(F.encode(role, "UTF-8")))
    for name, tag in TAGS.items():
        out = F.when(role == name, F.lit(tag)).otherwise(out)
    return out


def _role(tag: Column) -> Column:
    out = F.decode(F.unhex(F.substr(tag, F.lit(2))), "UTF-8")
    for name, known in TAGS.items():
        out = F.when(tag == known, F.lit(name)).otherwise(out)
    return out


def format_turn(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """(formatted turn, where the loss mask begins in it, its length): the length is 0 but for assistants."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    tag, body = _tag(role), escape(text)
    close = F.when(role == "assistant", F.lit(END)).otherwise(F.lit(""))
    turn = F.concat(F.lit("["), tag, F.lit("] "), body, F.lit(" [/"), tag, F.lit("]"), close)
    return turn, F.length(tag) + 3, F.when(role == "assistant", F.length(body)).otherwise(F.lit(0))


def format_paths(turns: DataFrame, by: list[str], order: list[str], role: str = "role", text: str = "text") -> DataFrame:
    """(by, formatted, loss_spans): one conversation for each value of ``by``; spans are (start, end) in code points."""
    turn, begins, length = format_turn(F.col(role), F.col(text))
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = turns.select(*by, *order, turn.alias("turn"), begins.alias("b"), length.alias("n"))
    rows = rows.withColumn("at", F.col("b") + len(BEGIN) + F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)))
    span = F.struct(F.col("at").cast("int").alias("start"), (F.col("at") + F.col("n")).cast("int").alias("end"))
    listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, "turn", span.alias("span")))).alias("t"))
    return listed.select(
        *by,
        F.concat(F.lit(BEGIN), F.array_join(F.transform("t", lambda x: x.turn), "")).alias("formatted"),
        F.filter(F.transform("t", lambda x: x.span), lambda s: s.end > s.start).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    body = F.substr(formatted, F.lit(len(BEGIN) + 1))
    pieces = F.filter(F.split(body, r" \[/[A-Z0-9]+\](?:</s>)?", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _role(F.regexp_extract(p, r"^\[([A-Z0-9]+)\]", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"^\[[A-Z0-9]+\] ", "")).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """What lies under the loss mask, unescaped span by span and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start + 1, s.end - s.start))), "")


def replies_of_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A linear conversation as a reply tree: (tree, id, parent, score, role, text); each turn answers the one before."""
    rows = conversations.select(*[F.col(f"`{c}`").alias(n) for c, n in ((conv, "tree"), (turn, "turn"), (role, "role"), (text, "text"))])
    # Null turns come first: they have the least bucket.
    bucket = F.coalesce(F.floor(F.col("turn") / TURNS).cast("long"), F.lit(-(1 << 62)))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    n = F.col("n") + 1
    numbered = dense_rank_by_bucket(rows.withColumn("tree", F.struct("tree")), ["tree"], bucket, order, "n")
    return numbered.select("tree.tree", n.alias("id"), F.nullif(n - 1, F.lit(0)).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def branches(messages: DataFrame, keep: int = 1, scratch: Scratch | None = None, rank_by: str = "sum") -> DataFrame:
    """(tree, leaf, rank, depth, id): the messages of the ``keep`` best branches of each tree, depth 0 at the root.

    ``messages``: tree, id, parent, score. ``rank_by``: "sum" of the path's scores, "mean" or the "leaf"'s score.
    """
    scratch = scratch or Scratch(messages.sparkSession, "chat")
    nodes = scratch.write(
        messages.groupBy("tree", "id").agg(F.min("parent").alias("parent"), F.min(F.coalesce("score", F.lit(0.0))).alias("score")), "nodes"
    )
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ids = nodes.select("tree", F.col("id").alias("up"))
    here = nodes.alias("n").join(ids.alias("i"), same("n.tree", "i.tree") & (F.col("n.parent") == F.col("i.up")), "left")
    # up: the message ``len`` steps up, null if the path ended; total: the scores below it.
    state = scratch.write(here.select("n.tree", "n.id", F.col("i.up").alias("up"), F.col("n.score").alias("total"), F.lit(1).cast("long").alias("len")), "state")
    longest = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    jumps, step, first = [], 1, state
    while step <= longest and not state.where("up IS NOT NULL").isEmpty():
        jumps.append(scratch.write(state.where("up IS NOT NULL").select("tree", "id", "up"), "jump"))
        joined = state.alias("a").join(state.alias("b"), same("a.tree", "b.tree") & (F.col("a.up") == F.col("b.id")), "left")
        total = F.col("a.total") + F.coalesce(F.col("b.total"), F.lit(0.0))
        after = joined.select("a.tree", "a.id", "b.up", total.alias("total"), (F.col("a.len") + F.coalesce("b.len", F.lit(0))).alias("len"))
        state, step = scratch.write(after, "state"), 2 * step
    # What still has a message above it after so many steps is in a circle or hangs off one.
    parents = first.where("up IS NOT NULL").select("tree", F.col("up").alias("id")).distinct()
    leaf = state.where("up IS NULL").alias("s").join(parents.alias("p"), same("s.tree", "p.tree") & (F.col("s.id") == F.col("p.id")), "left_anti")
    own = leaf.alias("l").join(nodes.alias("n"), same("l.tree", "n.tree") & (F.col("l.id") == F.col("n.id"))) if rank_by == "leaf" else leaf.alias("l")
    value = {"sum": "l.total", "mean": F.col("l.total") / F.col("l.len"), "leaf": "n.score"}[rank_by]
    value = F.col(value) if isinstance(value, str) else value
    ranked = own.select("l.tree", F.col("l.id").alias("leaf"), "l.len", value.alias("value"))
    best = W.partitionBy("tree").orderBy(F.desc("value"), "leaf")
    chosen = scratch.write(ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep), "chosen")
    path = chosen.select("tree", "leaf", "rank", "len", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("dist"))
    for k, jump in enumerate(jumps):
        up = path.alias("p").join(jump.alias("j"), same("p.tree", "j.tree") & (F.col("p.id") == F.col("j.id")))
        up = up.select("p.tree", "p.leaf", "p.rank", "p.len", F.col("j.up").alias("id"), (F.col("p.dist") + (1 << k)).alias("dist"))
        path = scratch.write(path.union(up), "path")
    return path.select("tree", "leaf", "rank", (F.col("len") - 1 - F.col("dist")).cast("int").alias("depth"), "id")


def format_trees(messages: DataFrame, keep: int = 1, rank_by: str = "sum") -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans) for ``messages``: tree, id, parent, score, role, text."""
    scratch = Scratch(messages.sparkSession, "chat")
    rows = scratch.write(messages, "messages")
    chosen = branches(rows, keep, scratch, rank_by)
    order = W.partitionBy("tree", "id").orderBy("role", "text")
    one = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("tree", "id", "role", "text")
    joined = chosen.alias("c").join(one.alias("m"), F.col("c.tree").eqNullSafe(F.col("m.tree")) & (F.col("c.id") == F.col("m.id")))
    return format_paths(joined.select("c.tree", "c.leaf", "c.rank", "c.depth", "m.role", "m.text"), ["tree", "leaf", "rank"], ["depth"])
