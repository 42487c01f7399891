r"""Chat formatting into prefix trees.

A turn is formatted as ``### role:\ntext\n</turn>\n``.  Inside roles and texts a backslash is doubled
and a backslash is put into every control string (``##`` to ``#\#``, ``</turn>`` to ``<\/turn>``; in
roles ``:`` to ``\:``), so no control string is left there and unescape() gives the text back.

Conversations are ordered by the hashes of their turns, so those that share initial turns are
neighbours; runs of neighbours are packed into trees of a bounded number of conversations and
characters.  A tree emits each shared turn once, depth-first.  With the tokens go position ids (a
turn's go on from its parent's), a loss mask (the text of assistant turns), and for each turn the
intervals of emitted tokens that its ancestors fill: what its tokens may attend to besides the
earlier tokens of the turn.

Defined results: null text and null role are empty; rows of a conversation are ordered by turn
(nulls first), then role, then text; repeated rows are turns of their own; a null conv_id is an id
like others; equal conversations end at the same turn of a tree, or at equal turns of two trees; a
conversation longer than a tree's limit is a tree of its own; an empty table gives an empty table;
further columns aren't looked at.  A conversation is one training example and is put together
in one task; conversations that share turns, however many, are not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import VOCAB_PATH, encode_text, encoding, map_rows

MAX_CONVERSATIONS, MAX_CHARS = 256, 1_000_000
LOSS_ROLE = "assistant"
_HEAD, _MID, _END = "### ", ":\n", "\n</turn>\n"
_ROLE = re.compile(r"### ((?:\\.|[^\\:])*+):\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def segments(role: str, text: str) -> tuple[str, str, str]:
    """A turn's head, body and end; only the body can bear loss."""
    return _HEAD + escape(role).replace(":", "\\:") + _MID, escape(text), _END


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _ROLE.match(formatted, at)
        end = formatted.find(_END, m.end()) if m else -1  # escaped texts have no end mark
        if end < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(formatted[m.end() : end])))
        at = end + len(_END)
    return turns


class Tree:
    """A prefix tree that emits as it grows; conversations come in path order."""

    def __init__(self, encode):
        self.encode = encode
        self.tokens: list[int] = []
        self.positions: list[int] = []
        self.loss: list[bool] = []
        self.nodes: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []  # turn, node
        self.chars = self.conversations = 0

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        self._leave(shared)
        for turn in turns[shared:]:
            self._emit(turn)
        self.nodes[self.path[-1][1]]["convs"].append(conv_id)
        self.conversations += 1

    def _leave(self, depth: int) -> None:
        for _, node in self.path[depth:]:
            self.nodes[node]["subtree_end"] = len(self.tokens)
        del self.path[depth:]

    def _emit(self, turn: tuple[str, str]) -> None:
        parent = self.path[-1][1] if self.path else -1
        spans: list[dict] = []
        position = 0
        if parent >= 0:
            up = self.nodes[parent]
            own = {"start": up["start"], "end": up["end"]}
            spans = [dict(s) for s in up["ancestors"]]
            if spans and spans[-1]["end"] == own["start"]:
                spans[-1]["end"] = own["end"]
            else:
                spans.append(own)
            position = self.positions[up["end"] - 1] + 1
        start = len(self.tokens)
        for i, part in enumerate(segments(*turn)):
            ids = self.encode(part)
            self.tokens += ids
            self.loss += [i == 1 and turn[0] == LOSS_ROLE] * len(ids)
            self.chars += len(part)
        self.positions += range(position, position + len(self.tokens) - start)
        self.nodes.append({"parent": parent, "depth": len(self.path), "start": start, "end": len(self.tokens), "subtree_end": None, "ancestors": spans, "convs": []})
        self.path.append((turn, len(self.nodes) - 1))

    def row(self) -> dict:
        self._leave(0)
        return {"token_ids": self.tokens, "position_ids": self.positions, "loss_mask": self.loss, "nodes": self.nodes}


_NODES = "nodes array<struct<parent:int,depth:int,start:int,end:int,subtree_end:int,ancestors:array<struct<start:int,end:int>>,convs:array<bigint>>>"
_TREES = f"token_ids array<int>, position_ids array<int>, loss_mask array<boolean>, {_NODES}"


def prefix_trees(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", max_conversations: int = MAX_CONVERSATIONS, max_chars: int = MAX_CHARS, vocab_path: str = VOCAB_PATH) -> DataFrame:
    """A row per tree: token_ids, position_ids, loss_mask and nodes (turns, depth-first)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    said = F.struct(F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("t"))
    whole = df.groupBy(F.col(conv_id).cast("long").alias("c")).agg(F.array_sort(F.collect_list(said)).alias("turns"))
    whole = whole.withColumn("path", F.transform("turns", lambda x: F.xxhash64(x["r"], x["t"])))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = whole.repartitionByRange(parts, "path", "c").sortWithinPartitions("path", "c")
    ordered = ordered.select("c", F.transform("turns", lambda x: F.struct(x["r"].alias("r"), x["t"].alias("t"))).alias("turns"))
    schema = to_arrow_schema(_parse_datatype_string(_TREES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = lambda t: encode_text(t, vocab_path)
        tree = Tree(encode)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if tree.conversations and (tree.conversations >= max_conversations or tree.chars >= max_chars):
                        yield pa.RecordBatch.from_pylist([tree.row()], schema=schema)
                        tree = Tree(encode)
                    tree.add(row["c"], [(t["r"], t["t"]) for t in row["turns"]])
        if tree.conversations:
            yield pa.RecordBatch.from_pylist([tree.row()], schema=schema)

    return ordered.mapInArrow(run, _TREES)


def read_back(tree: dict, decode) -> Iterator[tuple[int | None, str, str, list[int]]]:
    """(conv_id, formatted text, text under the loss mask, position ids) of a tree's conversations.

    decode: token ids to text.  Uses each last turn's attention intervals and its own tokens.
    """
    for node in tree["nodes"]:
        if node["convs"]:
            ids, loss, positions = ([x for s in (*node["ancestors"], node) for x in tree[c][s["start"] : s["end"]]] for c in ("token_ids", "loss_mask", "position_ids"))
            formatted, learnt = decode(ids), unescape(decode(list(compress(ids, loss))))
            for conv in node["convs"]:
                yield conv, formatted, learnt, positions


def conversation_digests(trees: DataFrame, vocab_path: str = VOCAB_PATH) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, read from the trees."""

    def rows(batch: list[dict]) -> list[dict]:
        decode = encoding(vocab_path).decode
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out = []
        for tree in batch:
            for conv, formatted, learnt, positions in read_back(tree, decode):
                if positions != list(range(len(positions))):
                    raise ValueError("position ids don't follow the path")
                turns = parse(formatted)
                out.append({
                    "conv_id": conv,
                    "n_turns": len(turns),
                    "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)),
                    "loss_chars": len(learnt),
                    "loss_sha256": sha(learnt),
                    "formatted_chars": len(formatted),
                    "n_tokens": len(positions),
                })
        return out

    return map_rows(trees, rows, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint", 4)
