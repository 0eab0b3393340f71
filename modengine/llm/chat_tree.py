"""Chat formatting as a prefix tree: shared initial turns are emitted once.

Every turn is rendered by a template that marks its borders and escapes control
strings in texts reversibly. Conversations are put into the order of their
paths (the chain of turn hashes) by a range sort, which is the depth-first order
of the tree: of all conversations through a node the first one emits it. So a
conversation's row holds the turns that no earlier one has, as one segment of the
stream: its start, its position ids from ``position`` on, the loss spans, and the
intervals of the stream that its ancestors fill, which it attends to beside
itself.

No tree is gathered: the range sort cuts between conversations, also between
equal ones; the first conversation of a node is a combined minimum; stream places
are running sums in two steps, inside a sorted part and over the parts.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window as Wd, functions as F

from .common import written

START, END = "<|im_start|>", "<|im_end|>"
_PART = 40  # bits of a number inside a sorted part


def escape(text: str) -> str:
    """No ``<|`` is left: between ``<`` and ``|`` one backslash is put in. Texts
    that hold such a sequence with backslashes get one more, so it is reversible."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """On one line as well."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    found = re.findall(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", formatted, re.S)
    return [(unescape_role(role), unescape(text)) for role, text in found]


_TURNS = "array<struct<text:string,chars:long,loss_from:long,loss_to:long,node:string,key:string>>"


def _rendered(learn: str):
    @F.pandas_udf(_TURNS)
    def turns(conversations: pd.Series) -> pd.Series:
        out = []
        for rows in conversations:
            chain, found = b"", []
            for row in rows:
                role = row["role"] or ""
                text, a, b = render(role, row["text"] or "")
                own = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                chain = hashlib.md5(chain + own).digest()
                learned = role == learn
                found.append({
                    "text": text, "chars": len(text), "loss_from": a if learned else None, "loss_to": b if learned else None,
                    "node": chain.hex(), "key": own.hex(),
                })
            out.append(found)
        return pd.Series(out)

    return turns


def tree(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """One row per conversation: conv_id, ``branch`` (its number in depth-first
    order), ``start`` and ``text`` (its own segment of the stream; empty if all its
    turns stand elsewhere), ``position`` (of the segment's first character in the
    conversation), ``ancestors`` (array of segment, start, end: the stream intervals
    of the turns before, in order; ``segment`` is the start of the segment that
    holds them), ``loss`` (array of start, end in its own segment), ``n_turns``.

    Positions count code points. Null roles and texts count as empty; rows go by
    turn (null first), then role and text; a repeated row is a turn of its own.
    Rows without a conversation id form one conversation. Empty tables give none.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    whole = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    told = whole.select("conv_id", _rendered(learn)("rows").alias("turns"))
    ordered = told.withColumn("path", F.transform("turns", lambda t: t["key"])).repartitionByRange("path", "conv_id")
    parts = written(ordered.withColumn("part", F.spark_partition_id()))
    inside = Wd.partitionBy("part").orderBy("path", "conv_id")
    number = F.shiftleft(F.col("part").cast("long"), _PART) + F.row_number().over(inside)
    convs = written(parts.withColumn("branch", number).drop("path"))

    # The first conversation through a node emits it.
    steps = convs.select("branch", F.posexplode("turns").alias("at", "t")).select("branch", "at", F.col("t.node").alias("node"))
    shared = written(steps.groupBy("node").agg(F.count("*").alias("n"), F.min("branch").alias("owner")).filter("n > 1").drop("n"))
    owners = steps.join(shared, "node").filter("owner < branch").groupBy("branch").agg(F.sort_array(F.collect_list(F.struct("at", "owner"))).alias("owners"))
    known = convs.join(owners, "branch", "left").withColumn("k", F.coalesce(F.size("owners"), F.lit(0)))
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, t: s + t["chars"])
    known = known.withColumns({
        "position": chars(F.slice("turns", F.lit(1), F.col("k"))),
        "own": F.slice("turns", F.col("k") + 1, F.greatest(F.size("turns") - F.col("k"), F.lit(0))),
    })
    known = written(known.withColumn("new", chars("own")))

    # Stream places: sums inside a sorted part, and over the parts before it.
    parts_sum = known.groupBy("part").agg(F.sum("new").alias("s"))
    ahead = parts_sum.select("part", (F.sum("s").over(Wd.orderBy("part")) - F.col("s")).alias("base"))  # a row for each sorted part
    run = F.sum("new").over(Wd.partitionBy("part").orderBy("branch")) - F.col("new")
    placed = written(known.withColumn("run", run).join(ahead, "part").withColumn("start", F.col("base") + F.col("run")).drop("run", "base"))

    # Ancestors: runs of turns with one owner, found in the owner's segment.
    lengths = F.transform("turns", lambda t: t["chars"])
    before = placed.filter("k > 0").select("branch", F.inline("owners"), lengths.alias("lengths"))
    turn_chars = F.get("lengths", F.col("at"))
    along = Wd.partitionBy("branch").orderBy("at")
    before = before.select("branch", "owner", turn_chars.alias("c"), (F.sum(turn_chars).over(along) - turn_chars).alias("from"))
    runs = before.groupBy("branch", "owner").agg(F.min("from").alias("from"), F.sum("c").alias("chars"))
    segments = written(placed.select(F.col("branch").alias("owner"), F.col("start").alias("segment"), F.col("position").alias("at")))
    where = F.col("segment") + F.col("from") - F.col("at")
    found = runs.join(segments, "owner").select("branch", "from", F.struct("segment", where.alias("start"), (where + F.col("chars")).alias("end")).alias("i"))
    ancestors = found.groupBy("branch").agg(F.transform(F.sort_array(F.collect_list(F.struct("from", "i"))), lambda x: x["i"]).alias("ancestors"))
    starts = F.aggregate("own", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")), lambda acc, t: F.struct(
        (acc["at"] + t["chars"]).alias("at"),
        F.when(t["loss_from"].isNotNull(), F.array_append(acc["spans"], F.struct((acc["at"] + t["loss_from"]).alias("start"), (acc["at"] + t["loss_to"]).alias("end"))))
        .otherwise(acc["spans"]).alias("spans"),
    ), lambda acc: acc["spans"])
    none = F.array().cast("array<struct<segment:long,start:long,end:long>>")
    return placed.join(ancestors, "branch", "left").select(
        "conv_id", "branch", "start", F.array_join(F.transform("own", lambda t: t["text"]), "").alias("text"), "position",
        F.coalesce("ancestors", none).alias("ancestors"), starts.alias("loss"), F.size("turns").cast("long").alias("n_turns"),
    )


def read_back(stream: DataFrame) -> DataFrame:
    """(conv_id, branch, parts): for every conversation of a tree its text and loss
    spans, gathered from the stream by its ancestor intervals and its segment."""
    segments = stream.filter("text <> ''").select(F.col("start").alias("segment"), F.col("text").alias("owned"), F.col("loss").alias("owned_loss"))
    asked = stream.select("branch", F.inline("ancestors"))
    offset = (F.col("start") - F.col("segment")).cast("int")
    length = (F.col("end") - F.col("start")).cast("int")
    inside = F.filter("owned_loss", lambda x: (x["start"] >= offset) & (x["end"] <= offset + length))
    moved = F.transform(inside, lambda x: F.struct((x["start"] - offset).alias("start"), (x["end"] - offset).alias("end")))
    found = asked.join(segments, "segment").select("branch", F.struct(
        F.col("start").alias("at"), F.substring("owned", offset + 1, length).alias("text"), moved.alias("loss"),
    ).alias("part"))
    gathered = found.groupBy("branch").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    own = F.array(F.struct(F.col("start").alias("at"), "text", "loss"))
    none = F.array().cast("array<struct<at:long,text:string,loss:array<struct<start:long,end:long>>>>")
    return stream.join(gathered, "branch", "left").select("conv_id", F.concat(F.coalesce("parts", none), own).alias("parts"))


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(stream: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from the stream."""

    @F.pandas_udf(_DIGEST)
    def digest(conversations: pd.Series) -> pd.DataFrame:
        out = []
        for parts in conversations:
            formatted = "".join(p["text"] for p in parts)
            learned = "".join(unescape(p["text"][s["start"]:s["end"]]) for p in parts for s in p["loss"])
            said = parse(formatted)
            sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learned), sha(learned), len(formatted)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return read_back(stream).select("conv_id", digest("parts").alias("d")).select("conv_id", "d.*")
