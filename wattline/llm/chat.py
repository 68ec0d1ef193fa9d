"""Chat formatting in prefix trees: conversations that begin alike share the tokens of those turns.

A turn's node is the hash of its role, its text and the node before it, so conversations with the same
first turns have the same first nodes.  Distinct conversations, sorted by their nodes, list the trees depth
first: each adds the nodes in which it differs from the one before it.  Range partitions sort them; sums
over the partitions place every node in one long stream of tokens.  A node carries its position id (tokens
on its way from the root) and the intervals of the stream that its ancestors fill, adjacent ones merged:
these, and the node itself causally, are what its tokens attend to.

Template of a turn: `### role: text</turn>` and a newline.  In roles and texts a backslash goes before every
backslash, before a `#` with two more behind it, and before `</turn>`; in roles also before `:`.  So control
strings within texts never read as the template's, and all comes back.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import ROWS, filled, stored
from wattline.llm.order import ranged

# fixed values: the template
HEAD, COLON, FOOT = "### ", ": ", "</turn>\n"
_ESCAPED = re.compile(r"\\|#(?=##)|</turn>")
_ESCAPED_ROLE = re.compile(r"[\\:]|#(?=##)|</turn>")
_UNESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def segment(role: str, text: str) -> tuple[str, str, str]:
    """A formatted turn: header, escaped text, end."""
    return HEAD + _ESCAPED_ROLE.sub(lambda m: "\\" + m[0], role) + COLON, escape(text), FOOT


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns; other strings are an error."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


class Codec:
    """Text to token ids and back without loss: code points, or a byte-level tokenizer's file.

    A `.json` file is read by the tokenizers library, a `.tiktoken` file of ranks by tiktoken, with the
    pattern that cuts texts before merging.  Ids are kept in two bytes each if all fit, else in four.
    """

    def __init__(self, path: str | None = None, pattern: str | None = None):
        self.kind, size = np.dtype("<u4"), 0x110000
        if path is None:
            self.encode_one, self.decode_one = lambda text: list(map(ord, text)), lambda ids: "".join(map(chr, ids))
        elif path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
            library = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode_one, self.decode_one, size = library.encode_ordinary, library.decode, library.n_vocab
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True  # their strings in a text are ordinary text
            self.encode_one = lambda text: library.encode(text, add_special_tokens=False).ids
            self.decode_one, size = lambda ids: library.decode(ids, skip_special_tokens=False), library.get_vocab_size()
        if size <= 1 << 16:
            self.kind = np.dtype("<u2")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encode_one(text), self.kind)

    def decode(self, ids: bytes) -> str:
        """The text of ids as they are kept."""
        return self.decode_one(np.frombuffer(ids, self.kind).tolist())


@functools.cache
def _codec(tokenizer: tuple[str | None, str | None]) -> Codec:
    return Codec(*tokenizer)


@dataclass
class Formatted:
    """The tokens of all conversations, as tables.

    `packed`: one row per node: node, part and start (place in the stream; parts are consecutive), n (tokens),
    ids (bytes, as `Codec` keeps them), position (id of its first token; they count on), attends (intervals
    [first, end) of the stream), loss (the interval under the loss mask, null for none), ends (a
    conversation ends here).
    `heads`: for each part, the rows of earlier parts that its first node attends to, marked with that part.
    `index`: (conv, node), the last node of each conversation.
    """

    packed: DataFrame
    heads: DataFrame
    index: DataFrame
    tokenizer: tuple[str | None, str | None]


def _content(role: Column, text: Column) -> Column:
    spelled = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.sha2(spelled.cast("binary"), 256))


def _paths(turns: DataFrame) -> DataFrame:
    """(conv, nodes, contents) of every conversation, its hashes in order; texts stay behind."""
    conv = turns.schema["conv"].dataType.simpleString()
    lined = turns.select("conv", "turn", "role", "content").repartition("conv")
    lined = lined.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "content").select("conv", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        now, contents, kind = nothing, [], None

        def chained() -> list[bytes]:
            out, last = [], b""
            for content in contents:
                last = hashlib.sha256(last + content).digest()
                out.append(last)
            return out

        for batch in batches:
            kind, done = batch.schema.field("conv").type, []
            for who, content in zip(batch.column("conv").to_pylist(), batch.column("content").to_pylist()):
                if who != now or now is nothing:
                    if contents:
                        done.append((now, chained(), contents))
                    now, contents = who, []
                contents.append(content)
            yield batch_of(done, kind)
        if contents:
            yield batch_of([(now, chained(), contents)], kind)

    def batch_of(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*done)] if done else [[], [], []]
        kinds = [kind, pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv", "nodes", "contents"])

    return lined.mapInArrow(run, f"conv {conv}, nodes array<binary>, contents array<binary>")


def _segments(turns: DataFrame, tokenizer: tuple[str | None, str | None]) -> DataFrame:
    """(content, role, ids, n_head, n_body, n): the tokens of each distinct turn."""
    distinct = turns.groupBy("content").agg(F.first("role").alias("role"), F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            parts = [[codec.encode(x) for x in segment(r, t)] for r, t in zip(roles, texts)]
            ids = pa.array([b"".join(p.tobytes() for p in part) for part in parts], pa.binary())
            head, body, foot = (np.array([len(part[k]) for part in parts], np.int64) for k in range(3))
            counts = [pa.array(x) for x in (head, body, head + body + foot)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), batch.column("role"), ids, *counts], names=["content", "role", "ids", "n_head", "n_body", "n"]
            )

    return distinct.mapInArrow(run, "content binary, role string, ids binary, n_head bigint, n_body bigint, n bigint")


def _depth_first(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of distinct paths in depth-first order, and for each part the path above its first node.

    A path meets the one before it in its range partition; the first one of a partition meets the last
    one of the partition before, from a table of one row per partition.
    """
    order = ranged(paths.dropDuplicates(["node"]), ["nodes"], "chat-order")
    ends = order.groupBy("part").agg(F.max_by("nodes", "at").alias("last"), F.min("at").alias("at"))
    ends = ends.select("part", "at", F.lag("last").over(Window.orderBy("part")).alias("before"))
    line = Window.partitionBy("part").orderBy("at")
    met = order.withColumn("previous", F.lag("nodes").over(line)).join(ends.drop("part"), "at", "left")
    met = met.withColumn("previous", F.coalesce("previous", "before"))
    same = F.zip_with("nodes", "previous", lambda a, b: a.eqNullSafe(b))
    differs = F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1
    shared = F.when(F.col("previous").isNull(), 0).otherwise(F.coalesce(differs, F.size("nodes"))).cast("int")
    met = met.withColumn("shared", shared)
    steps = F.arrays_zip("nodes", "contents")
    added = F.slice(steps, F.col("shared") + 1, F.size("nodes") - F.col("shared"))
    last = F.size("nodes") - F.col("shared") - 1
    new = met.select("part", "at", "shared", last.alias("last"), F.posexplode(added).alias("k", "step")).select(
        F.col("step.nodes").alias("node"), F.col("step.contents").alias("content"), "part", "at",
        (F.col("shared") + F.col("k")).alias("depth"), (F.col("k") == F.col("last")).alias("ends"),
    )
    above = met.join(ends.select("at"), "at", "left_semi").filter("shared > 0")
    above = above.select(F.col("part").alias("reader"), F.explode(F.slice("nodes", 1, "shared")).alias("node"))
    return new, above


def _placed(nodes: DataFrame) -> DataFrame:
    """`nodes` with start: sums of n within a part and over the parts before."""
    sums = nodes.groupBy("part").agg(F.sum("n").alias("all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sums = sums.select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"))
    line = Window.partitionBy("part").orderBy("at", "depth").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n").over(line), F.lit(0))
    return nodes.withColumn("within", within).join(sums, "part").withColumn("start", F.col("before") + F.col("within")).drop("within", "before")


def _sighted(placed: DataFrame, above: DataFrame) -> DataFrame:
    """(node, position, attends) of every node: a task walks a part with the stack of ancestors."""
    told = above.join(placed.select("node", "start", "n", "depth"), "node")
    told = told.select("reader", F.lit(True).alias("told"), "node", "start", "n", "depth")
    own = placed.select(F.col("part").alias("reader"), F.lit(False).alias("told"), "node", "start", "n", "depth")
    lined = own.unionByName(told).repartition("reader").sortWithinPartitions("reader", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []  # entries: end of the node, position after it, its ancestors and itself merged
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("reader", "told", "node", "start", "n", "depth")]
            out = []
            for reader, told_only, node, start, n, depth in zip(*columns):
                if reader != part:
                    part, stack = reader, []
                del stack[depth:]
                position, seen = stack[-1] if stack else (0, ())
                if not told_only:
                    out.append((node, position, [{"first": a, "end": b} for a, b in seen]))
                if seen and seen[-1][1] == start:
                    stack.append((position + n, (*seen[:-1], (seen[-1][0], start + n))))
                else:
                    stack.append((position + n, (*seen, (start, start + n))))
            columns = [list(c) for c in zip(*out)] if out else [[], [], []]
            span = pa.struct([("first", pa.int64()), ("end", pa.int64())])
            kinds = [pa.binary(), pa.int64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "position", "attends"])

    return lined.mapInArrow(run, "node binary, position bigint, attends array<struct<first: bigint, end: bigint>>")


def format_chats(
    df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str | None = None,
    pattern: str | None = None, loss_role: str = "assistant",
) -> Formatted:
    """The conversations of `df` as one stream of tokens in which shared first turns appear once.

    Turns go by `turn` (nulls first), ties by role, then by a hash of the text.  Null roles and texts are
    empty ones, a null key is a conversation like any other, repeated rows are turns of their own, and
    equal conversations end in the same node.  Texts of any length are one turn; the tokenizer (see `Codec`; a
    file at the same path on every machine; without one, tokens are code points) sees each distinct turn once.  Other columns of `df` are not read, so no names clash.  An empty table
    gives empty tables.
    """
    turns = df.select(F.col(key).alias("conv"), F.col(turn).alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    turns = turns.withColumn("content", _content(F.col("role"), F.col("text")))
    paths = stored(_paths(turns).withColumn("node", F.element_at("nodes", -1)), "chat-paths")
    codec = (tokenizer, pattern)
    segments = stored(_segments(turns, codec), "chat-segments")
    nodes, above = _depth_first(paths)
    above = stored(above, "chat-above")
    placed = stored(_placed(nodes.join(segments.select("content", "n"), "content")), "chat-layout")
    sighted = _sighted(placed, above)
    first = F.col("start") + F.col("n_head")
    loss = F.when(F.col("role") == loss_role, F.struct(first.alias("first"), (first + F.col("n_body")).alias("end")))
    nodes = stored(placed.select("node", "content", "part", "start", "ends").join(sighted, "node"), "chat-nodes")

    def packed(rows: DataFrame) -> DataFrame:
        return rows.join(segments, "content").select("node", "part", "start", "n", "ids", "position", "attends", loss.alias("loss"), "ends")

    heads = above.select(F.col("reader").alias("_part"), "node").join(nodes, "node").withColumn("part", F.col("_part"))
    return Formatted(packed(nodes), packed(heads), paths.select("conv", "node"), codec)


def read_back(done: Formatted) -> DataFrame:
    """What the tokens say of every conversation: (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    A task reads a part of the stream in order.  Ancestors of a node are told by its intervals alone; their
    hashes so far are copied and go on, so each shared turn is read once.
    """
    rows = done.packed.withColumn("told", F.lit(False)).unionByName(done.heads.withColumn("told", F.lit(True)))
    lined = rows.repartition("part").sortWithinPartitions("part", "start")
    tokenizer, names = done.tokenizer, ["node", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []  # entries: end in the stream, turns, hash of turns, loss, its hash, characters
        codec = _codec(tokenizer)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            columns = [batch.column(c).to_pylist() for c in ("node", "part", "start", "n", "ids", "attends", "loss", "ends", "told")]
            out = []
            for node, at, start, n, ids, attends, loss, ends, told_only in zip(*columns):
                if at != part:
                    part, stack = at, []
                parent = attends[-1]["end"] if attends else -1
                while stack and stack[-1][0] != parent:
                    stack.pop()
                if attends and not stack:
                    raise ValueError("a node without its ancestors")
                _, turns, hashed, chars, masked, length = stack[-1] if stack else (0, 0, hashlib.sha256(), 0, hashlib.sha256(), 0)
                hashed, masked = hashed.copy(), masked.copy()
                if loss:
                    first, end = ((loss[edge] - start) * codec.kind.itemsize for edge in ("first", "end"))
                    text = codec.decode(ids[first:end])
                    formatted = codec.decode(ids[:first]) + text + codec.decode(ids[end:])
                    text = unescape(text)
                    masked.update(text.encode())
                    chars += len(text)
                else:
                    formatted = codec.decode(ids)
                for role, text in read_turns(formatted):
                    hashed.update(f"{role}\n{text}\n".encode())
                    turns += 1
                length += len(formatted)
                stack.append((start + n, turns, hashed, chars, masked, length))
                if ends and not told_only:
                    out.append((node, turns, hashed.hexdigest(), chars, masked.hexdigest(), length))
            columns = [list(c) for c in zip(*out)] if out else [[] for _ in names]
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "node binary, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return done.index.join(lined.mapInArrow(run, schema), "node").select("conv", *names[1:])
