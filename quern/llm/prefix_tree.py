r"""Chat formatting as a prefix tree: conversations that begin with the same turns share them.

A turn is formatted as `### role: text</turn>\n`; backslashes and control strings inside roles and texts get a
backslash before them, so formatting can be undone exactly. A node is a distinct sequence of turns, named by a chained
digest. Sorted by their digest paths, conversations stand in depth-first order; each node is emitted once, by the
first conversation that holds it. With each node go its place in the tree's token sequence, the position id of its
first token (its ancestors' tokens count, siblings' don't) and the intervals of that sequence that its tokens may
attend to: its ancestors', with neighbouring ones merged. Loss falls on assistants' texts alone.

Tokens are code points, or those of a tokenizer file (`tokenizers` format), which encodes each node by itself.

Scale: one global sort of digest paths; a tree that holds a third of all conversations is spread over many tasks.
Places come from running sums within sort partitions plus one number for each partition. Only a single conversation
has to fit a task.

Defined results: null roles and texts count as empty; rows are taken by turn, null turns first, ties by role and
text. Repeated rows are turns of their own. Rows with a null conv_id are one conversation. Other input columns are
ignored. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.llm.common import written

END = "</turn>\n"
CONTROL = re.compile(r"\\|###|</turn>")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LOSS_ROLE = "assistant"


def head(role: str) -> str:
    return f"### {ROLE_CONTROL.sub(lambda m: chr(92) + m[0], role)}: "


def formatted(role: str, text: str) -> str:
    return head(role) + CONTROL.sub(lambda m: chr(92) + m[0], text) + END


def parsed(chat: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(chat):
        m = TURN.match(chat, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((ESCAPED.sub(r"\1", m[1]), ESCAPED.sub(r"\1", m[2])))
        at = m.end()
    return out


def _encoder(tokenizer: str | None):
    if tokenizer is None:
        return lambda s: None, len
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    ids = lambda s: t.encode(s, add_special_tokens=False).ids
    return ids, lambda s: len(ids(s))


def _paths(chats: DataFrame, tokenizer: str | None) -> DataFrame:
    """chats(conv_id, turns) with path (node digests) and sizes (tokens of each node)."""

    def run(batches):
        import pyarrow as pa

        _, size = _encoder(tokenizer)
        for b in batches:
            paths, sizes = [], []
            for turns in b.column("turns").to_pylist():
                at, path = b"", []
                for t in turns:
                    role, text = (t[k].encode("utf-8", "surrogatepass") for k in ("role", "text"))
                    at = hashlib.blake2b(b"%s%d:%s%s" % (at, len(role), role, text), digest_size=16).digest()
                    path.append(at.hex())
                paths.append(path)
                sizes.append([size(formatted(t["role"], t["text"])) for t in turns])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turns"), pa.array(paths, pa.list_(pa.string())), pa.array(sizes, pa.list_(pa.int64()))], names=["conv_id", "turns", "path", "sizes"])

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.mapInArrow(run, f"conv_id {kind}, turns array<struct<role:string,text:string>>, path array<string>, sizes array<bigint>")


NODE = "node string, parent string, tree string, depth int, role string, piece string, tokens array<int>, n_tokens bigint, place bigint, start bigint, position bigint, attends array<struct<start:bigint,end:bigint,first:bigint,last:bigint>>, loss_start int, loss_end int"


def prefix_tree(turns: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, turn, role, text) to (nodes, leaves).

    nodes, in depth-first order by place: formatted piece, start in its tree's sequence, position, attends (intervals of
    that sequence, with the places of their first and last nodes), loss_start and loss_end (code points of the piece,
    end exclusive; null: no loss). leaves(conv_id, node): where each conversation ends.
    """
    plain = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = plain.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    chats = chats.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    chats = written(_paths(chats, tokenizer), "paths")
    # the id holds the sort partition in its high bits, then the row's number in it
    order = chats.orderBy("path", "conv_id").select("conv_id", "turns", "path", "sizes", F.monotonically_increasing_id().alias("rank"))
    order = written(order, "order")
    steps = order.select("rank", F.posexplode(F.arrays_zip("path", "sizes")).alias("depth", "z")).select("rank", "depth", F.col("z.path").alias("node"), F.col("z.sizes").alias("n"))
    nodes = written(steps.groupBy("node").agg(F.min("rank").alias("owner"), F.min("depth").alias("depth"), F.min("n").alias("n")).withColumn("part", F.shiftright("owner", 33)), "nodes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each sort partition
    parts = nodes.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("c")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("part").orderBy("owner", "depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = nodes.withColumns({"n1": F.coalesce(F.sum("n").over(inside), F.lit(0)), "c1": F.coalesce(F.count("n").over(inside), F.lit(0))}).join(F.broadcast(parts), "part")
    placed = placed.select("node", "owner", (F.col("n0") + F.col("n1")).alias("at"), (F.col("c0") + F.col("c1")).alias("place"))
    ways = steps.join(placed, "node").groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("depth", "at", "place", "owner"))).alias("way"))
    full = order.join(ways, "rank").select("rank", "turns", "path", "sizes", "way")

    schema = to_arrow_schema(StructType.fromDDL(NODE))

    def emit(batches):
        import pyarrow as pa

        encode, _ = _encoder(tokenizer)
        for b in batches:
            out = []
            for row in b.to_pylist():
                root, position, seen = row["way"][0]["at"], 0, []
                for d, (t, node, n, w) in enumerate(zip(row["turns"], row["path"], row["sizes"], row["way"], strict=True)):
                    start = w["at"] - root
                    if w["owner"] == row["rank"]:
                        piece = formatted(t["role"], t["text"])
                        loss = t["role"] == LOSS_ROLE
                        out.append({
                            "node": node, "parent": row["path"][d - 1] if d else None, "tree": row["path"][0], "depth": d, "role": t["role"], "piece": piece, "tokens": encode(piece),
                            "n_tokens": n, "place": w["place"], "start": start, "position": position, "attends": [dict(s) for s in seen],
                            "loss_start": len(head(t["role"])) if loss else None, "loss_end": len(piece) - len(END) if loss else None,
                        })
                    position += n
                    if seen and seen[-1]["end"] == start:
                        seen[-1] |= {"end": start + n, "last": w["place"]}
                    else:
                        seen.append({"start": start, "end": start + n, "first": w["place"], "last": w["place"]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return written(full.mapInArrow(emit, NODE), "tree"), order.select("conv_id", F.element_at("path", -1).alias("node"))


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(nodes, leaves) to conv_id, pieces: array<struct<position,piece,loss_start,loss_end>>, from what leaves attend to."""
    own = F.struct(F.col("start"), (F.col("start") + F.col("n_tokens")).alias("end"), F.col("place").alias("first"), F.col("place").alias("last"))
    spans = leaves.join(nodes.select("node", F.array_append("attends", own).alias("spans")), "node")
    spans = spans.select("conv_id", F.explode("spans").alias("s")).select("conv_id", F.explode(F.sequence("s.first", "s.last")).alias("place"))
    pieces = spans.join(nodes.select("place", F.struct("position", "piece", "loss_start", "loss_end").alias("p")), "place")
    return pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("pieces"))


def digests(chats: DataFrame) -> DataFrame:
    """read_back()'s rows to turns and text under the loss mask, parsed and unescaped, as counts and digests."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = []
            for pieces in b.column("pieces").to_pylist():
                chat = "".join(p["piece"] for p in pieces)
                turns = parsed(chat)
                loss = "".join(ESCAPED.sub(r"\1", p["piece"][p["loss_start"] : p["loss_end"]]) for p in pieces if p["loss_start"] is not None)
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                made.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(chat)))
            columns = list(zip(*made, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
