"""Chat formatting as a prefix tree.

Conversations that share their first turns share the nodes of those turns; a
node's key is the digest of all turns up to it. Sorted by their paths (the keys of
their nodes, root first), conversations come in depth-first order: each one emits
the nodes that the one before it does not share, so every node's tokens are emitted
once. The sort is by range, each partition is one pass with the current path as its
only state, and the driver joins the partitions' ends (a path and a sum each). No
tree has to fit one task, and the work is linear in the number of turns.

Each node holds its tokens, the position of the first along its own path, and the
intervals of the stream that it attends to: its ancestors, those that touch made one.

The template is ``<s>[INST]role[/INST]text</s>``. Control strings inside roles and
texts get a backslash behind their first character, and written-out escapes one
more, so the escape can be taken back. The loss mask covers assistant texts.

Defined results. Null roles and texts count as empty. Rows are ordered by turn
(nulls first), then role, then text; repeated rows are turns of their own. A null
conversation id is a conversation. Other columns are not read. No rows, no result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written
from quillspark.llm.tokcount import encoder

OPEN, HEAD_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
TRAINED = "assistant"
_TAIL = r"(?=/?s>|/?INST\]|\|endoftext\|>)"
_ESCAPE, _UNESCAPE = re.compile(r"([<\[])(\\*)" + _TAIL), re.compile(r"([<\[])\\(\\*)" + _TAIL)
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
#: Hex digits of a key in a path; equal prefixes of different keys fall back on the whole key.
STEP = 16


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and end of a turn."""
    return f"{OPEN}{escape(role)}{HEAD_END}", escape(text), CLOSE


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; anything else in it is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
    return turns


_INTS, _LISTS = pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))


def _conversations(vocabulary: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for part in parts:
            out = []
            for conv in part.to_pylist():
                key, keys, tokens, loss, chars = b"", [], [], [], []
                for turn in conv["turns"]:
                    pieces = format_turn(turn["role"] or "", turn["text"] or "")
                    ids = [enc.ids(p) for p in pieces]
                    key = hashlib.sha256(key + "".join(pieces).encode()).digest()[:16]
                    keys.append(key.hex())
                    tokens.append(ids[0] + ids[1] + ids[2])
                    loss.append([len(ids[0]), len(ids[0]) + (len(ids[1]) if turn["role"] == TRAINED else 0)])
                    chars.append(sum(map(len, pieces)))
                out.append((conv["conv_id"], keys[-1], "".join(k[:STEP] for k in keys), keys, tokens, loss, chars))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), _LISTS, _LISTS, _INTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "leaf", "path", "keys", "tokens", "loss", "chars"])

    return run


def _shared(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted paths -> each node's offset among the partition's own tokens."""
    number = TaskContext.get().partitionId()
    before: list[str] = []
    offsets: list[int] = []
    place = end = 0
    for part in parts:
        out = []
        for keys, tokens in zip(part.column(1).to_pylist(), part.column(2), strict=True):
            new = _shared(keys, before)
            offsets, start = offsets[:new], end
            sizes = [len(t) for t in tokens]
            for n in sizes[new:]:
                offsets.append(end)
                end += n
            before = keys
            out.append((number, place, new, list(offsets), sizes, end - start))
            place += 1
        cols = list(zip(*out, strict=True)) or [[]] * 6
        types = (pa.int32(), pa.int64(), pa.int32(), _INTS, _INTS, pa.int64())
        yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*part.schema.names, "part", "place", "new", "offsets", "sizes", "n_new"])


def _joined_ends(ends: list) -> dict[int, tuple[int, int, dict[int, int]]]:
    """For each partition: where its tokens start in the stream, how many of its
    first tokens the partitions before have emitted, and where those are."""
    found: dict[int, tuple[int, int, dict[int, int]]] = {}
    keys: list[str] = []
    at: list[int] = []
    base = 0
    for e in ends:
        new = _shared(e.first.keys, keys)
        had = sum(e.first.sizes[:new])
        kept = dict(zip(e.first.offsets[:new], at[:new], strict=True))
        found[e.part] = base, had, kept
        keys, at = e.last.keys, [kept[o] if o < had else base + o - had for o in e.last.offsets]
        base += e.total - had
    return found


def _emitted(sent):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for row in part.to_pylist():
                base, had, kept = sent.value[row["part"]]
                at = [kept[o] if o < had else base + o - had for o in row["offsets"]]
                attends: list[dict] = []
                position = 0
                for k, (o, n) in enumerate(zip(row["offsets"], row["sizes"], strict=True)):
                    if k >= row["new"] and o >= had:
                        out.append((row["keys"][k], row["keys"][k - 1] if k else None, k, row["tokens"][k], row["loss"][k], row["chars"][k], at[k], n, position, [dict(x) for x in attends]))
                    if attends and attends[-1]["to"] == at[k]:
                        attends[-1]["to"] += n
                    else:
                        attends.append({"from": at[k], "to": at[k] + n})
                    position += n
            cols = list(zip(*out, strict=True)) or [[]] * 10
            span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
            types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(span))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["node", "parent", "depth", "tokens", "loss", "n_chars", "offset", "n_tokens", "position", "attends"])

    return run


def _paths(sent):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = []
            for number, offsets in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                base, had, kept = sent.value[number]
                at.append([kept[o] if o < had else base + o - had for o in offsets])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at, _INTS)], ["leaf", "offsets"])

    return run


def prefix_tree(turns: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, members)`` of ``turns`` (conv_id, turn, role, text).

    nodes: ``node``, ``parent``, ``depth``, ``tokens``, ``loss`` (interval of trained
    tokens inside the node, may be empty), ``n_chars``, ``offset`` (of the first token
    in the stream), ``n_tokens``, ``position`` (along the path) and ``attends``
    (ancestors' intervals of the stream, root first). members: ``conv_id`` and the
    ``offsets`` of its nodes, root first.
    """
    row = F.struct("turn", "role", "text")
    convs = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    kinds = "leaf string, path string, keys array<string>, tokens array<array<int>>, loss array<array<int>>, chars array<long>"
    rows = written(convs.mapInArrow(_conversations(vocabulary), f"conv_id long, {kinds}"))
    ordered = rows.drop("conv_id").dropDuplicates(["leaf"]).repartitionByRange("path", "leaf").sortWithinPartitions("path", "leaf")
    fields = "keys array<string>, tokens array<array<int>>, loss array<array<int>>, chars array<long>"
    placed = ordered.select("leaf", "keys", "tokens", "loss", "chars").mapInArrow(_placed, f"leaf string, {fields}, part int, place long, new int, offsets array<long>, sizes array<long>, n_new long")
    placed = written(placed)
    end = F.struct("keys", "offsets", "sizes")
    ends = placed.groupBy("part").agg(F.min_by(end, "place").alias("first"), F.max_by(end, "place").alias("last"), F.sum("n_new").alias("total")).orderBy("part")
    sent = turns.sparkSession.sparkContext.broadcast(_joined_ends(ends.collect()))  # a row per partition
    spans = "array<struct<from:long,to:long>>"
    nodes = placed.mapInArrow(_emitted(sent), f"node string, parent string, depth int, tokens array<int>, loss array<int>, n_chars long, offset long, n_tokens long, position long, attends {spans}")
    paths = placed.select("leaf", "part", "offsets").mapInArrow(_paths(sent), "leaf string, offsets array<long>")
    return written(nodes), rows.select("conv_id", "leaf").join(paths, "leaf").select("conv_id", "offsets")


_READ = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def _read(vocabulary: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for part in parts:
            out = []
            for conv in part.to_pylist():
                segments = [enc.text(n["tokens"]) for n in conv["nodes"]]
                turns = parse("".join(segments))
                # the mask's own tokens, not the parsed turns
                loss = "".join(unescape(enc.text(n["tokens"][slice(*n["loss"])])) for n in conv["nodes"])
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                out.append((conv["conv_id"], len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(map(len, segments))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _READ, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def read_back(nodes: DataFrame, members: DataFrame, vocabulary: str) -> DataFrame:
    """Each conversation, read from the nodes of its path."""
    wanted = members.select("conv_id", F.posexplode("offsets").alias("k", "offset"))
    found = wanted.join(nodes.select("offset", "tokens", "loss"), "offset")
    convs = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "tokens", "loss"))).alias("nodes"))
    return convs.mapInArrow(_read(vocabulary), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_SQL_ESCAPED = r"""length(regexp_replace(coalesce({0}, ''), '([<\[])(\\*)(/?s>|/?INST\]|\|endoftext\|>)', '\1\2\\\3', 'g'))"""
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum({_SQL_ESCAPED.format("role")} + {_SQL_ESCAPED.format("text")} + {len(OPEN + HEAD_END + CLOSE)}) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""
