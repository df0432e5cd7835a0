"""Chat formatting as a prefix tree: conversations that share their first turns share those turns' tokens.

Every turn is formatted as marks around its role and text; control strings inside either are escaped, reversibly.
A turn's name is the hash chain of all turns up to it, so equal beginnings have equal names. The
conversations are sorted by their lists of names over all partitions, which is a depth-first order of the
tree: a conversation emits the turns that its predecessor in this order does not share. What a partition needs
from those before it (the open branch and the next offset) follows from one short summary per partition.

Each emitted node has its tree, its place `start` in the tree's depth-first token sequence, `position` (its first
token's distance from the root along the branch; the following tokens count on), the intervals of its
ancestors, which it may attend to besides its own earlier tokens, and the interval under the loss mask.

Defined cases: null text or role is empty; rows of a conversation are ordered by turn, then role and text (nulls
first); repeated rows are repeated turns; a null conv_id is one conversation; an empty table gives no tree. A single
conversation is the unit that one task holds.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import shared, travels
from raregrain.session import ensure_checkpoint_dir

travels(__name__)

#: Marks of the template and the control strings that texts must not contain (fixed values).
BEGIN, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = [BEGIN, MIDDLE, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LEARNT_ROLE = "assistant"

NODE = ("array<struct<start:bigint,n:int,depth:int,parent:bigint,position:bigint,role:string,text:string,"
        "loss_start:int,loss_end:int,attends:array<struct<start:bigint,end:bigint>>>>")


def escape(text: str) -> str:
    """Backslashes doubled, and one put after the first character of every control string."""
    return re.sub("|".join(map(re.escape, CONTROL)), lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\\\|\\", lambda m: "\\" if len(m[0]) == 2 else "", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The formatted turn and the interval of its (escaped) text, in code points."""
    head, body = BEGIN + escape(role or "") + MIDDLE, escape(text or "")
    return head + body + END, len(head), len(head) + len(body)


def _names(turns) -> list[bytes]:
    names, last = [], b""
    for t in turns:
        role, text = (t["role"] or "").encode("utf-8", "surrogatepass"), (t["text"] or "").encode("utf-8", "surrogatepass")
        last = hashlib.blake2b(last + len(role).to_bytes(8, "big") + role + text, digest_size=16).digest()
        names.append(last)
    return names


def _common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Branch:
    """The branch open at some point of the depth-first order: names and offsets of its nodes, and the next offset."""

    def __init__(self, names=(), starts=(), following=0):
        self.names, self.starts, self.following = list(names), list(starts), following

    def enter(self, names: list[bytes], sizes: list[int]) -> int:
        """Goes on to the conversation `names`; returns how many of its nodes were open already."""
        k = _common(self.names, names)
        if k == 0:
            self.following = 0
        del self.names[k:], self.starts[k:]
        for name, size in zip(names[k:], sizes[k:], strict=True):
            self.names.append(name)
            self.starts.append(self.following)
            self.following += size
        return k


def _chains(turns: DataFrame, count: Callable[[str], int] | None) -> DataFrame:
    """One row per conversation: names, formatted turns and their token counts."""
    import pyarrow as pa

    convs = turns.select("conv_id", F.struct("turn", "role", "text").alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = dict(convs.dtypes)["conv_id"]

    def chain(batches):
        for batch in batches:
            names, sizes = [], []
            for turns_ in batch.column("turns").to_pylist():
                names.append(_names(turns_))
                texts = [format_turn(t["role"], t["text"])[0] for t in turns_]
                sizes.append([len(x) if count is None else count(x) for x in texts])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turns"), pa.array(names, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32()))],
                                             names=["conv_id", "turns", "names", "sizes"])

    return convs.mapInArrow(chain, f"conv_id {kind}, turns {dict(convs.dtypes)['turns']}, names array<binary>, sizes array<int>")


def _openings(rows: DataFrame) -> dict[int, tuple]:
    """For each partition the branch that is open where it begins. One row per partition reaches the driver."""
    import pyarrow as pa
    from pyspark import TaskContext

    def summarise(batches):
        branch, first, trees = Branch(), None, 0
        for batch in batches:
            for names, sizes in zip(batch.column("names").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                first = first or (names, sizes)
                trees += branch.enter(names, sizes) == 0
        if first:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([first[0]], pa.list_(pa.binary())),
                "first_sizes": pa.array([first[1]], pa.list_(pa.int32())), "names": pa.array([branch.names], pa.list_(pa.binary())),
                "starts": pa.array([branch.starts], pa.list_(pa.int64())), "following": pa.array([branch.following], pa.int64()), "trees": pa.array([trees], pa.int64())})

    got = rows.select("names", "sizes").mapInArrow(
        summarise, "part int, first array<binary>, first_sizes array<int>, names array<binary>, starts array<bigint>, following bigint, trees bigint").collect()
    opening, at = {}, Branch()
    for r in sorted(got, key=lambda r: r["part"]):
        opening[r["part"]] = (list(at.names), list(at.starts), at.following)
        first, names, starts = [bytes(x) for x in r["first"]], [bytes(x) for x in r["names"]], list(r["starts"])
        k = _common(at.names, first)
        if r["trees"] == 1 and k:  # the partition goes on with the open tree and stays in it
            shift = at.following - sum(r["first_sizes"][:k])
            same = min(k, _common(first, names))
            at = Branch(names, at.starts[:same] + [s + shift for s in starts[same:]], r["following"] + shift)
        else:
            at = Branch(names, starts, r["following"])
    return opening


def build(turns: DataFrame, count: Callable[[str], int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of the prefix trees over `turns`: conv_id, turn, role, text.

    `count` gives a formatted turn's number of tokens; by default tokens are code points.
    nodes: tree, start, n, depth, parent, position, role, text, loss_start, loss_end, attends. members: conv_id, tree,
    leaf (start of the conversation's last node).
    """
    import pyarrow as pa
    from pyspark import TaskContext

    spark = turns.sparkSession
    ensure_checkpoint_dir(spark)
    # the id is part of the order, so that many equal conversations spread over partitions as well
    rows = _chains(turns, count).repartitionByRange("names", "conv_id").sortWithinPartitions("names", "conv_id").checkpoint()
    opening = spark.sparkContext.broadcast(_openings(rows))
    node = pa.struct([("start", pa.int64()), ("n", pa.int32()), ("depth", pa.int32()), ("parent", pa.int64()), ("position", pa.int64()), ("role", pa.string()),
                      ("text", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()),
                      ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def emit(batches):
        branch = Branch(*opening.value.get(TaskContext.get().partitionId(), ()))
        for batch in batches:
            trees, leaves, new = [], [], []
            for turns_, names, sizes in zip(*[batch.column(c).to_pylist() for c in ("turns", "names", "sizes")], strict=True):
                k = branch.enter(names, sizes)
                spans = [{"start": s, "end": s + n} for s, n in zip(branch.starts, sizes, strict=True)]
                position, out = sum(sizes[:k]), []
                for d in range(k, len(names)):
                    role = turns_[d]["role"] or ""
                    text, a, b = format_turn(role, turns_[d]["text"])
                    learnt = role == LEARNT_ROLE
                    out.append({"start": branch.starts[d], "n": sizes[d], "depth": d, "parent": branch.starts[d - 1] if d else None, "position": position, "role": role,
                                "text": text, "loss_start": a if learnt else None, "loss_end": b if learnt else None, "attends": spans[:d]})
                    position += sizes[d]
                trees.append(names[0])
                leaves.append(branch.starts[-1])
                new.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(trees, pa.binary()), pa.array(leaves, pa.int64()), pa.array(new, pa.list_(node))],
                                             names=["conv_id", "tree", "leaf", "new"])

    out = shared(rows.mapInArrow(emit, f"conv_id {dict(rows.dtypes)['conv_id']}, tree binary, leaf bigint, new {NODE}"))
    nodes = out.filter(F.size("new") > 0).select("tree", F.explode("new").alias("x")).select("tree", "x.*")
    return nodes, out.select("conv_id", "tree", "leaf")


def with_tokens(nodes: DataFrame) -> DataFrame:
    """Adds, for code-point tokens, `tokens`, `positions` and `mask` (1 under the loss) to every node."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    return nodes.withColumn("tokens", F.transform(chars, lambda c: F.ascii(c))).withColumn(
        "positions", F.expr("transform(sequence(0, n - 1), i -> position + i)")).withColumn(
        "mask", F.expr("transform(sequence(0, n - 1), i -> if(i >= loss_start and i < loss_end, 1, 0))"))


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id and `turns` (array of text, loss_start, loss_end in order), rebuilt from the emitted nodes alone.

    A conversation's last node attends to its ancestors' intervals; each interval is looked up as a node of the
    tree. Conversations that end in one node are rebuilt once.
    """
    leaves = members.select("tree", "leaf").distinct()
    asked = leaves.join(nodes.select("tree", F.col("start").alias("leaf"), "n", "attends"), ["tree", "leaf"]).select(
        "tree", "leaf", F.explode(F.concat("attends", F.array(F.struct(F.col("leaf").alias("start"), (F.col("leaf") + F.col("n")).alias("end"))))).alias("a"))
    parts = asked.select("tree", "leaf", F.col("a.start").alias("start"), F.col("a.end").alias("end")).join(
        nodes.select("tree", "start", (F.col("start") + F.col("n")).alias("end"), "text", "loss_start", "loss_end"), ["tree", "start", "end"])
    whole = parts.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("start", "text", "loss_start", "loss_end"))).alias("turns"))
    return members.join(whole, ["tree", "leaf"])


def digests(rebuilt: DataFrame) -> DataFrame:
    """Per conversation: turns, their digest, the text under the loss mask and its digest, and the formatted length."""
    import pyarrow as pa

    pattern = re.compile(re.escape(BEGIN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END), re.S)

    def read(batches):
        for batch in batches:
            rows = []
            for turns in batch.column("turns").to_pylist():
                every, learnt, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for t in turns:
                    size += len(t["text"])
                    for m in pattern.finditer(t["text"]):
                        n += 1
                        every.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                    if t["loss_start"] is not None:
                        text = unescape(t["text"][t["loss_start"]:t["loss_end"]])
                        chars += len(text)
                        learnt.update(text.encode("utf-8", "surrogatepass"))
                rows.append((n, every.hexdigest(), chars, learnt.hexdigest(), size))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                                             names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(rebuilt.dtypes)["conv_id"]
    return rebuilt.select("conv_id", "turns").mapInArrow(
        read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
