"""Chat formatting over a prefix tree.

Conversations that share initial turns share them in the output: sorted by the
hashes of their turns, conversations with a common beginning stand together, and
a pack writes each turn of their tree once, depth first. A pack is a text and its
nodes; a node (one turn) has its stretch of the text, the position id of its first
character (as if its conversation stood alone), the stretches of its ancestors,
which are all that it may attend to besides its own earlier characters, and the
stretch under the loss mask (an assistant's text). Unit of all of these is the
code point; ``expand`` gives them per character.

The template is ``<s>role[INST]text[/INST]</s>`` per turn. A control string inside
a role or text gets a backslash after its first character, and a backslash is
doubled, so the template's own marks are the only ones and escaping is undone
exactly. Equal conversations are one leaf, whatever their number; packs are cut at
``PACK_CHARS``, so no shared beginning, however common, must fit one task.
A conversation longer than that is a pack by itself, whole.

Turns stand in the order of turn (null first), role and text. Null roles and texts
count as empty; rows that repeat are turns that repeat; a row without conversation
id is a conversation of its own. Columns with clashing names are left aside. An empty
table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import map_arrow
from .common import load, stored

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
PACK_CHARS = 65_536
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)

PACK_SCHEMA = (
    "text string, nodes array<struct<parent:int,start:int,end:int,position:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>>, "
    "leaves array<struct<path:string,node:int>>"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "\\" in text or "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


class Pack:
    """A text in the making, with the path of the conversation that was added last."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []

    def add(self, path_id: str, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            role, text = turn
            head, body = f"<s>{escape(role)}[INST]", escape(text)
            piece = f"{head}{body}[/INST]</s>"
            parent = self.path[-1][1] if self.path else -1
            above = self.nodes[parent] if self.path else None
            attends = [*above["attends"], {"start": above["start"], "end": above["end"]}] if above else []
            if len(attends) > 1 and attends[-2]["end"] == attends[-1]["start"]:
                attends = [*attends[:-2], {"start": attends[-2]["start"], "end": attends[-1]["end"]}]
            node = {"parent": parent, "start": self.size, "end": self.size + len(piece), "position": above["position"] + above["end"] - above["start"] if above else 0, "loss_start": self.size + len(head), "loss_end": self.size + len(head), "attends": attends}
            if role == "assistant":
                node["loss_end"] += len(body)
            self.path.append((turn, len(self.nodes)))
            self.nodes.append(node)
            self.parts.append(piece)
            self.size += len(piece)
        self.leaves.append({"path": path_id, "node": self.path[-1][1]})

    def row(self) -> dict:
        return {"text": "".join(self.parts), "nodes": self.nodes, "leaves": self.leaves}


def expand(pack: dict) -> tuple[np.ndarray, np.ndarray]:
    """Per code point of a pack: its position id, and whether it is under the loss mask."""
    positions, loss = np.zeros(len(pack["text"]), np.int64), np.zeros(len(pack["text"]), bool)
    for n in pack["nodes"]:
        positions[n["start"] : n["end"]] = n["position"] + np.arange(n["end"] - n["start"])
        loss[n["loss_start"] : n["loss_end"]] = True
    return positions, loss


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id, path (the hash of all turns), key (a hash per turn, in a row), turns."""
    hashed = F.substring(F.sha2(F.concat("role", F.lit("\n"), "text").cast("binary"), 256), 1, 32)
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select("conv_id", lone.alias("lone"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("conv_id", "lone", F.struct("turn", "role", "text", hashed.alias("hash")).alias("t"))
    whole = rows.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    key = F.array_join(F.transform("ts", lambda t: t["hash"]), "")
    return whole.select("conv_id", key.alias("key"), F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).withColumn("path", F.sha2(F.col("key").cast("binary"), 256))


def packs_of(conversations: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """Packs of the distinct conversations (path, key, turns): text, nodes, leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, pack = None, Pack()

        def out(p: Pack) -> pa.RecordBatch:
            nonlocal schema
            if schema is None:
                span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                node = pa.struct([*((n, pa.int32()) for n in ("parent", "start", "end", "position", "loss_start", "loss_end")), ("attends", pa.list_(span))])
                schema = pa.schema([("text", pa.string()), ("nodes", pa.list_(node)), ("leaves", pa.list_(pa.struct([("path", pa.string()), ("node", pa.int32())])))])
            return pa.RecordBatch.from_pylist([p.row()], schema=schema)

        for batch in batches:
            for path, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pack.add(path, [(t["role"], t["text"]) for t in turns])
                if pack.size >= pack_chars:
                    yield out(pack)
                    pack = Pack()
        if pack.leaves:
            yield out(pack)

    once = conversations.groupBy("path", "key").agg(F.first("turns").alias("turns"))
    in_order = once.repartitionByRange("key").sortWithinPartitions("key").select("path", "turns")
    return map_arrow(in_order, run, PACK_SCHEMA)


def read_back(packs: DataFrame) -> DataFrame:
    """Per leaf, from the packs alone: path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pack in batch.to_pylist():
                text, nodes = pack["text"], pack["nodes"]
                for leaf in pack["leaves"]:
                    at, chain = leaf["node"], []
                    while at >= 0:
                        chain.append(nodes[at])
                        at = nodes[at]["parent"]
                    chain.reverse()
                    own = chain[-1]
                    formatted = "".join(text[a["start"] : a["end"]] for a in own["attends"]) + text[own["start"] : own["end"]]
                    if len(formatted) != own["position"] + own["end"] - own["start"]:
                        raise ValueError("position ids and attention intervals disagree")
                    turns = parse(formatted)
                    loss = "".join(unescape(text[n["loss_start"] : n["loss_end"]]) for n in chain)
                    said = "".join(f"{role}\n{body}\n" for role, body in turns)
                    rows.append((leaf["path"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_arrow(packs, run, "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation that says the template's own marks.
EXTRA = "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(EXTRA))
    conversations = stored(conversations_of(turns), "chat-conversations")
    packs = stored(packs_of(conversations), "chat-packs")
    return conversations.select("conv_id", "path").join(read_back(packs), "path").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _sql() -> str:
    times = lambda c, s: f"((length({c}) - length(replace({c}, '{s}', ''))) // {len(s)})"
    size = lambda c: f"length({c}) + " + " + ".join(times(c, s) for s in ("\\", *CONTROL))
    return f"""
    WITH t AS (
      SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT conv_id, NULL, turn, role, text FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)),
    g AS (
      SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
             CAST(sum({sum(map(len, CONTROL))} + {size("role")} + {size("text")}) AS BIGINT) AS formatted_chars
      FROM t GROUP BY conv_id, lone)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


QUERIES = {"op4_chat_format": op4_chat_format}
ORACLES = {"op4_chat_format": _sql()}
