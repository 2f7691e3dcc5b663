"""Conversations as prefix trees: shared turns once, depth first, with attention intervals.

A node is a turn together with all turns before it, so conversations that begin alike
share nodes. Nodes are laid out in one depth-first line of token ids. Each node has

* ``start`` and ``length``: its tokens' place in the line;
* ``position``: the position id of its first token, that is, the tokens before it on
  its own path;
* ``ancestors``: the intervals of the line that its tokens may attend to besides
  their own node;
* the span of its text under the loss, for turns of the assistant.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlab.llm.tokens import encoder
from matchlab.llm.words import chunks
from matchlab.session import durable

# The template's fixed values.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"

SALTS = 16

_GUARD, _GUARDED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """The text without any control string: a backslash is put between ``<`` and ``|``."""
    return _GUARD.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _GUARDED.sub(r"<\1|", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and the code points that its text takes there."""
    head = OPEN + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def turn_of(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, text = _SEGMENT.fullmatch(formatted).groups()
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
    return role, unescape(text)


def _nodes_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turn_no, node, parent, formatted, loss_start, loss_end), streamed turn by turn."""
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, node, n = object(), None, 0
        for part in chunks(batches, "text"):
            out = []
            for conv, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != current:
                    current, node, n = conv, None, 0
                body = b"%b%d:" % (node or b"", len(role.encode())) + (role + text).encode()
                parent, node = node, hashlib.sha256(body).digest()[:16]
                formatted, start, end = segment(role, text)
                graded = role == ASSISTANT
                out.append((conv, n, node, parent, formatted, start if graded else 0, end if graded else 0))
                n += 1
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), types)],
                ["conv_id", "turn_no", "node", "parent", "formatted", "loss_start", "loss_end"],
            )

    return rows.mapInArrow(task, "conv_id long, turn_no long, node binary, parent binary, formatted string, loss_start long, loss_end long")


def _places(rows: DataFrame) -> DataFrame:
    """(node, heads, nth) from (conv_id, turn_no, node, head): a node's place in the tree.

    A run of nodes without a branch is a chain. ``heads`` are the first nodes of the
    chains down to the node's own, ``nth`` its place in that; so a conversation of many
    turns needs no list of them.
    """
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heads, nth = object(), [], 0
        for batch in batches:
            out = []
            for conv, node, head in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "node", "head"))):
                if conv != current:
                    current, heads = conv, []
                heads, nth = ([*heads, node], 0) if head else (heads, nth + 1)
                out.append((node, heads, nth))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.list_(pa.binary()), pa.int64()))], ["node", "heads", "nth"]
            )

    return rows.select("conv_id", "turn_no", "node", "head").mapInArrow(task, "node binary, heads array<binary>, nth long").dropDuplicates(["node"])


def _tokens(nodes: DataFrame, vocabulary: str) -> DataFrame:
    nodes_schema = (
        "node binary, parent binary, heads array<binary>, nth long, formatted string, loss_start long, loss_end long, length long, ids binary"
    )

    def task(batches):
        for part in chunks(batches, "formatted"):
            ids, offsets = encoder(vocabulary).encode(part.column("formatted"))
            raw, at = ids.astype("<u4").tobytes(), (4 * offsets).tolist()
            body = pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary())
            yield part.append_column("length", pa.array(np.diff(offsets))).append_column("ids", body)

    return nodes.mapInArrow(task, nodes_schema)


def write_tree(
    turns: DataFrame, folder: str, vocabulary: str, conv_column: str = "conv_id", turn_column: str = "turn",
    role_column: str = "role", text_column: str = "text",
) -> None:
    """Write ``folder/nodes`` (the line) and ``folder/turns`` (which nodes a conversation has).

    Turns are ordered by turn number, ties by role and text; repeated turns stay. A null
    role or text is empty; turns without conversation id are one conversation. Extra
    columns are ignored; an empty table writes empty tables. Conversations are streamed
    turn by turn. Intervals are one for each chain above a node, since a chain lies
    together in the line, so their number grows with the branches and not the turns.
    """
    rows = turns.select(
        F.col(conv_column).cast("long").alias("conv_id"), F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column), F.lit("")).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    taken = durable(_nodes_of(rows))
    taken.select("conv_id", "turn_no", "node").write.parquet(f"{folder}/turns")
    distinct = durable(taken.drop("conv_id", "turn_no").dropDuplicates(["node"]))
    branches = distinct.groupBy("parent").agg(F.count("*").alias("n")).where("n > 1 and parent is not null")
    # One parent may have a third of all nodes: its children meet it in SALTS places.
    branches = branches.select(F.col("parent").alias("branch"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("place"))
    met = (F.col("parent") == F.col("branch")) & (F.pmod(F.xxhash64("node"), F.lit(SALTS)) == F.col("place"))
    heads = distinct.join(branches, met, "left").select("node", F.expr("parent is null or branch is not null").alias("head"))
    places = _places(taken.select("conv_id", "turn_no", "node").join(heads, "node"))
    # Arrays compare element by element and a prefix comes first: this order is depth first.
    ranged = distinct.join(places, "node").select("node", "parent", "heads", "nth", "formatted", "loss_start", "loss_end")
    ranged = durable(ranged).repartitionByRange("heads", "nth").sortWithinPartitions("heads", "nth")
    nodes = durable(_tokens(ranged, vocabulary).withColumn("part", F.spark_partition_id()))
    parts = nodes.groupBy("part").agg(F.sum("length").alias("size"))
    base = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    within = Window.partitionBy("part").orderBy("heads", "nth").rowsBetween(Window.unboundedPreceding, -1)
    line = durable(
        nodes.withColumn("before", F.coalesce(F.sum("length").over(within), F.lit(0))).join(base, "part")
        .withColumn("start", F.col("base") + F.col("before")).withColumn("chain", F.element_at("heads", -1)).drop("part", "base", "before")
    )
    chains = line.groupBy("chain").agg(F.min("start").alias("from"), F.max(F.col("start") + F.col("length")).alias("to"), F.first("heads").alias("heads"))
    chains = durable(chains)
    up = chains.select("chain", F.explode(F.slice("heads", 1, F.size("heads") - 1)).alias("above")).join(
        chains.select(F.col("chain").alias("above"), F.col("from").alias("start"), F.col("to").alias("end")), "above"
    )
    up = up.groupBy("chain").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("above"), F.sum(F.col("end") - F.col("start")).alias("over")
    )
    whole = chains.select("chain", "from").join(up, "chain", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    own = F.when(F.col("nth") > 0, F.array(F.struct(F.col("from").alias("start"), F.col("start").alias("end")))).otherwise(none)
    line.join(whole, "chain").select(
        "node", "parent", "chain", "nth", "start", "length", (F.coalesce("over", F.lit(0)) + F.col("start") - F.col("from")).alias("position"),
        F.concat(F.coalesce("above", none), own).alias("ancestors"), "formatted", "loss_start", "loss_end", "ids",
    ).write.parquet(f"{folder}/nodes")


def read_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each turn, from the written tree: ``conv_id, turn_no, role, text, formatted, graded``.

    ``graded`` is the part of the formatted turn under the loss, unescaped.
    """
    nodes = spark.read.parquet(f"{folder}/nodes").select("node", "formatted", "loss_start", "loss_end")
    rows = spark.read.parquet(f"{folder}/turns").join(nodes, "node")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "formatted"):
            formatted = part.column("formatted").to_pylist()
            spans = zip(part.column("loss_start").to_pylist(), part.column("loss_end").to_pylist())
            role, text = zip(*map(turn_of, formatted))
            graded = [unescape(f[a:b]) for f, (a, b) in zip(formatted, spans)]
            yield pa.RecordBatch.from_arrays(
                [part.column("conv_id"), part.column("turn_no"), pa.array(role), pa.array(text), part.column("formatted"), pa.array(graded)],
                ["conv_id", "turn_no", "role", "text", "formatted", "graded"],
            )

    return rows.select("conv_id", "turn_no", "formatted", "loss_start", "loss_end").mapInArrow(
        task, "conv_id long, turn_no long, role string, text string, formatted string, graded string"
    )


def read_line(spark: SparkSession, folder: str, vocabulary: str) -> DataFrame:
    """Each different conversation as a reader of the line sees it, one row for each turn.

    ``conv_id`` is the place in the line at which the conversation's last turn starts.
    Its turns are the nodes in the intervals which that turn attends to, and itself, in
    the order of their position ids (``turn_no``). ``role, text, formatted, graded`` are
    decoded from the nodes' token ids.
    """
    nodes = spark.read.parquet(f"{folder}/nodes")
    begin = F.when(F.col("nth") > 0, F.element_at("ancestors", -1)["start"]).otherwise(F.col("start"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [np.frombuffer(x.as_buffer(), "<u4").tolist() for x in batch.column("ids")]
            formatted = encoder(vocabulary).tokenizer.decode_batch(coded, skip_special_tokens=False)
            spans = zip(batch.column("loss_start").to_pylist(), batch.column("loss_end").to_pylist())
            turns = list(map(turn_of, formatted))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("chain_start", "start", "position")), *(pa.array([t[i] for t in turns], pa.string()) for i in (0, 1)),
                    pa.array(formatted, pa.string()), pa.array([unescape(f[a:b]) for f, (a, b) in zip(formatted, spans)], pa.string()),
                ],
                ["chain_start", "start", "position", "role", "text", "formatted", "graded"],
            )

    line = nodes.select(begin.alias("chain_start"), "start", "position", "ids", "loss_start", "loss_end").mapInArrow(
        task, "chain_start long, start long, position long, role string, text string, formatted string, graded string"
    )
    last = _last_turns(spark, folder).select("node").distinct().join(nodes.withColumn("chain_start", begin), "node")
    # The turn's own chain up to it and with it is one interval.
    above = F.filter("ancestors", lambda a: a["start"] < F.col("chain_start"))
    own = F.struct(F.col("chain_start").alias("start"), (F.col("start") + F.col("length")).alias("end"))
    seen = last.select(F.col("start").alias("conv_id"), F.explode(F.concat(above, F.array(own))).alias("seen"))
    seen = seen.select("conv_id", F.col("seen.start").alias("chain_start"), F.col("seen.end").alias("end"))
    rows = seen.join(line, "chain_start").where("start < end")
    return rows.select("conv_id", F.col("position").alias("turn_no"), "role", "text", "formatted", "graded")


def _last_turns(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/turns").groupBy("conv_id").agg(F.max_by("node", "turn_no").alias("node"))


def line_digests(spark: SparkSession, folder: str, vocabulary: str) -> DataFrame:
    """``digests`` of every conversation, each different one read from the line once."""
    found = digests(read_line(spark, folder, vocabulary)).withColumnRenamed("conv_id", "start")
    nodes = spark.read.parquet(f"{folder}/nodes").select("node", "start")
    return _last_turns(spark, folder).join(nodes.join(found, "start").drop("start"), "node").drop("node")


def digests(turns: DataFrame) -> DataFrame:
    """Counts and digests of each conversation from its turns, streamed in order.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    """
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    columns = ("conv_id", "role", "text", "formatted", "graded")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, state = [], None

        def out():
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

        def close():
            conv, n, whole, chars, graded, formatted = state
            done.append((conv, n, whole.hexdigest(), chars, graded.hexdigest(), formatted))

        for part in chunks(batches, "formatted"):
            for conv, role, text, formatted, graded in zip(*(part.column(c).to_pylist() for c in columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(graded)
                state[4].update(graded.encode())
                state[5] += len(formatted)
            if done:
                yield out()
                done = []
        if state is not None:
            close()
            yield out()

    return rows.select("conv_id", "turn_no", *columns[1:]).mapInArrow(
        task, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
