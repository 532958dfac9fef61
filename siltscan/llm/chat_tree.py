"""Chat formatting as a prefix tree.

Every turn is a node named by a digest of its role, its text and its parent's name, so conversations
that share initial turns share nodes. The distinct paths of a tree go into packs of bounded size (a tree whose first turn is very
common is cut into several packs, its shared turns once in each). A pack is emitted depth-first: shared turns once,
each node with its place in the pack, the position id of its first code point (the length of its ancestors), and the intervals of the pack that
it attends to (its ancestors and itself). Only assistant texts lie under the loss mask.

The template marks turns with control strings; inside roles and texts a backslash is put before every control string and every
backslash, which unescaping takes away again, so each conversation can be read back from its pack.

Laws for odd input: null texts and roles count as empty; turns are taken in order of turn, then role and text, a
null turn first; repeated rows are turns of their own; rows with a null conv_id make one conversation; an empty table gives no
packs; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan.llm.common import materialise, sliced, table

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[SAYS]", "[/ROLE]")
TO_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
MARK = re.compile(r"\\.|(" + "|".join(map(re.escape, CONTROLS)) + ")", re.DOTALL)
PATHS = 256
PROBE = "</s>[INST] ok [/INST]"


def escape(text: str) -> str:
    return TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where in it the loss mask begins and ends (equal: nowhere)."""
    body = escape(text)
    if role == "user":
        return f"<s>[INST]{body}[/INST]", 0, 0
    if role == "assistant":
        return f"{body}</s>", 0, len(body)
    return f"[ROLE]{escape(role)}[SAYS]{body}[/ROLE]", 0, 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at, held = [], 0, {}
    for m in MARK.finditer(formatted):
        mark = m[1]
        if mark is None:
            continue
        part, at = formatted[at : m.start()], m.end()
        if mark == "[/INST]":
            out.append(("user", unescape(part)))
        elif mark == "</s>":
            out.append(("assistant", unescape(part)))
        elif mark == "[SAYS]":
            held["role"] = unescape(part)
        elif mark == "[/ROLE]":
            out.append((held.pop("role"), unescape(part)))
    return out


def _name(parent: bytes, role: str, text: str) -> bytes:
    h = hashlib.sha256(parent)
    for x in (role, text):
        raw = x.encode("utf-8", "surrogatepass")
        h.update(len(raw).to_bytes(8, "little") + raw)
    return h.digest()[:16]


TURNS = "conv_id long, depth int, n_turns long, root binary, leaf binary, parent binary, node binary, role string, text string"


def turns(conversations: DataFrame) -> DataFrame:
    """One row a turn, named within the tree. Conversations arrive sorted; one at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        last: object = run
        rows: list[tuple] = []

        def close() -> None:
            parent, names = b"", []
            for role, text in held:
                names.append(_name(names[-1] if names else b"", role, text))
            for i, (role, text) in enumerate(held):
                parent = names[i - 1] if i else b""
                rows.append((last, i, len(held), names[0], names[-1], parent, names[i], role, text))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)
            rows.clear()
            return made

        for batch in sliced(batches, 1024):
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != last:
                    if held:
                        close()
                    held, last = [], conv
                held.append((role or "", text or ""))
            if len(rows) > 512:
                yield flush()
        if held:
            close()
        if rows:
            yield flush()

    put = conversations.select(F.col("conv_id").cast("long"), "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return put.select("conv_id", "role", "text").mapInArrow(run, TURNS)


NAMES = [c.split()[0] for c in TURNS.split(", ")]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.string()]
NODE = "struct<node: binary, parent: binary, start: long, end: long, position: long, loss_start: long, loss_end: long, attends: array<struct<start: long, end: long>>, leaf: boolean>"
PACK = f"root binary, bucket int, text string, nodes array<{NODE}>"
NODE_TYPE = pa.list_(pa.struct([
    ("node", pa.binary()), ("parent", pa.binary()), ("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
    ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("leaf", pa.bool_()),
]))


def emit(nodes: list[dict]) -> tuple[str, list[dict]]:
    """Depth-first text of a pack and its nodes; no recursion, so depth is not limited."""
    children: dict[bytes, list[dict]] = {}
    for n in sorted(nodes, key=lambda n: n["node"], reverse=True):
        children.setdefault(n["parent"], []).append(n)
    parts, out, at = [], [], 0
    stack = [(n, 0, []) for n in children.get(b"", [])]
    while stack:
        n, position, seen = stack.pop()
        text, a, b = segment(n["role"], n["text"])
        end = at + len(text)
        attends = [*seen[:-1], (seen[-1][0], end)] if seen and seen[-1][1] == at else [*seen, (at, end)]
        out.append({
            "node": n["node"], "parent": n["parent"], "start": at, "end": end, "position": position, "loss_start": at + a, "loss_end": at + b,
            "attends": [{"start": x, "end": y} for x, y in attends], "leaf": n["leaf"],
        })
        parts.append(text)
        stack += [(c, position + len(text), attends) for c in children.get(n["node"], [])]
        at = end
    return "".join(parts), out


def packs(named: DataFrame, paths: int = PATHS) -> DataFrame:
    """Rows of turns() -> packs."""
    many = named.select("root", "leaf").distinct().groupBy("root").count().where(F.col("count") > paths)
    cut = materialise(many.select("root", F.ceil(F.col("count") / paths).cast("int").alias("cuts")))  # so that the join's hot roots are split
    put = named.join(cut, "root", "left").withColumn("bucket", F.pmod(F.xxhash64("leaf"), F.coalesce("cuts", F.lit(1))).cast("int"))
    put = put.repartition("root", "bucket")  # else the join's dealing by root would bring all packs of a root to one task
    nodes = put.groupBy("root", "bucket", "node").agg(F.first("parent").alias("parent"), F.first("role").alias("role"), F.first("text").alias("text"), F.max(F.col("leaf") == F.col("node")).alias("leaf"))

    def run(key: tuple, tbl: pa.Table) -> pa.Table:
        text, out = emit(tbl.select(["node", "parent", "role", "text", "leaf"]).to_pylist())
        return pa.table({"root": pa.array([key[0].as_py()], pa.binary()), "bucket": pa.array([key[1].as_py()], pa.int32()), "text": pa.array([text]), "nodes": pa.array([out], NODE_TYPE)})

    return nodes.groupBy("root", "bucket").applyInArrow(run, PACK)


def read_back(packed: DataFrame) -> DataFrame:
    """What each path of a pack says, from the pack's text, intervals and loss spans alone."""
    schema = "leaf binary, read_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 16):
            rows = []
            for text, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_name = {n["node"]: n for n in nodes}
                for n in nodes:
                    if not n["leaf"]:
                        continue
                    formatted = "".join(text[a["start"] : a["end"]] for a in n["attends"])
                    said = parse(formatted)
                    spans, up = [], n
                    while up:
                        spans.append((up["loss_start"], up["loss_end"]))
                        up = by_name.get(up["parent"])
                    loss = "".join(unescape(text[a:b]) for a, b in reversed(spans))
                    rows.append((n["node"], len(said), digest("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), digest(loss), len(formatted)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)

    return packed.select("text", "nodes").mapInArrow(run, schema)


def op6_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    named = materialise(turns(said.unionByName(probe)))
    found = read_back(packs(named))
    heads = named.where("depth = 0").select("conv_id", "n_turns", "leaf")
    return heads.join(found, "leaf").select("conv_id", F.col("read_turns").alias("n_turns"), "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLE = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '(\\\\|<s>|</s>|\\[INST\\]|\\[/INST\\]|\\[ROLE\\]|\\[SAYS\\]|\\[/ROLE\\])', '\\\\\\1', 'g') AS body,
    regexp_replace(role, '(\\\\|<s>|</s>|\\[INST\\]|\\[/INST\\]|\\[ROLE\\]|\\[SAYS\\]|\\[/ROLE\\])', '\\\\\\1', 'g') AS escaped_role FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 4 ELSE 19 + length(escaped_role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op6_chat_tree": op6_chat_tree}
ORACLES = {"op6_chat_tree": ORACLE}
