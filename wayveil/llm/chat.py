"""Chat formatting with quotation linking.

Lines that begin with quote marks (">", nested as ">>" or "> >") are quoted passages; their level is the number of marks.
A passage is a run of lines of one level. Lines inside a fenced block (``` or ~~~) are code and never quotes, nor are lines
of an interpreter's session: runs of marked lines that all begin with ">>>" or "...", one of them at least with ">>>",
where no neighbouring line has fewer marks. A line that introduces a quote ("Ann wrote:") is taken out with it, if the quote
follows at once or after blank lines; everything else, white space included, stays as it is.

Each message offers the hashes of its own unquoted body, of its paragraphs and of its lines, normalised (case, white space,
marks); quoted passages are hashed alike and joined to the earlier messages of the same conversation that offer them. A
message replies to the latest original of its first-level quotes, or else of the lowest level with a known one, or, where
it quotes nothing known, to the message before it. Conversations are ordered by depth in the reply tree, then by turn, and
are written without their quotes.

Places inside a conversation and the latest offer before a message are found over blocks of rows and their totals, so a
conversation that holds a third of all rows is many blocks, whatever its turns are. Messages of one turn are ordered by
role and then by the hash of their text; repeated rows are messages of their own. A null text is empty; a null turn comes
first; a null conversation is a conversation. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import bounded_batches, cut

#: Rows of a block of offers and asks.
BLOCK = 4096
_MARKS = r"^[ \t]*(?:>[ \t]?)+"
_QUOTE, _FENCE, _SESSION = re.compile(_MARKS), re.compile(r"^[ \t]*(```|~~~)"), re.compile(r"^[ \t]*(>>>($|[ \t])|\.\.\.($|[ \t]))")
#: How mail programs introduce a quote, in four languages.
_INTRODUCES = re.compile(r"^(on .{0,120} wrote|am .{0,120} schrieb.{0,80}|le .{0,120} a écrit|el .{0,120} escribió)\s*:\s*$", re.I)


def parsed(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without its quotes, and (level, passage) of each quote; one pass over its lines."""
    if ">" not in text:
        return text, []
    lines = text.split("\n")
    levels, fenced = [], False
    for line in lines:
        if _FENCE.match(line):
            fenced = not fenced
        marks = None if fenced else _QUOTE.match(line)
        levels.append(marks[0].count(">") if marks else 0)
    _unmark_sessions(lines, levels)
    body, quotes, k = [], [], 0
    quote_ahead, ahead = [False] * len(lines), False  # whether the next line that is not blank is a quoted one
    for k in range(len(lines) - 1, -1, -1):
        quote_ahead[k] = ahead
        ahead = levels[k] > 0 if levels[k] or lines[k].strip() else ahead
    passage: list[str] = []
    for k, line in enumerate(lines):
        if levels[k]:
            passage.append(_QUOTE.sub("", line).rstrip("\r"))
            if k + 1 == len(lines) or levels[k + 1] != levels[k]:
                if any(x.strip() for x in passage):
                    quotes.append((levels[k], "\n".join(passage)))
                passage = []
        elif not (quote_ahead[k] and _INTRODUCES.match(line)):
            body.append(line)
    return "\n".join(body), quotes


def _unmark_sessions(lines: list[str], levels: list[int]) -> None:
    """Levels 0 for the lines of an interpreter's session."""
    k = 0
    while k < len(lines):
        if levels[k] != 3 or not _SESSION.match(lines[k]):
            k += 1
            continue
        upto = k
        while upto < len(lines) and levels[upto] in (0, 3) and _SESSION.match(lines[upto]):
            upto += 1
        if not (k and levels[k - 1]) and not (upto < len(lines) and levels[upto]):
            levels[k:upto] = [0] * (upto - k)
        k = upto


def normalised(text: Column) -> Column:
    """Lower case, no quote marks, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"(?m)" + _MARKS, "")), r"\s+", " "))


def without_quotes(messages: DataFrame) -> DataFrame:
    """body and quotes (array of (level, passage)) in place of text."""
    keys = [c for c in messages.columns if c != "text"]
    kind = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parsed(x or "") for x in batch.column("text").to_pylist()]
            quotes = [[{"level": level, "passage": passage} for level, passage in q] for _, q in found]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array([x for x, _ in found], pa.string()), pa.array(quotes, kind)], names=[*keys, "body", "quotes"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.select(*keys).schema)
    return messages.select(*keys, "text").mapInArrow(parse, f"{own}, body string, quotes array<struct<level:int,passage:string>>")


def numbered(table: DataFrame) -> DataFrame:
    """Messages with their place (0, 1, ...) in their conversation, from places in sorted partitions of bounded size."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = table.select("conv_id", "turn", "role", text.alias("text")).withColumn("text_key", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["turn", "role", "text_key", "row"]
    spread = cut(base.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    sizes = spread.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = spread.withColumn("inside", F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order)) - 1)
    return inside.join(cut(before), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))).select("conv_id", (F.col("before") + F.col("inside")).cast("long").alias("place"), "turn", "role", "text")


def _hashes(text: Column) -> Column:
    """Distinct hashes of the whole, its paragraphs and its lines; longer pieces first."""
    pieces = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n"))
    some = F.filter(F.transform(pieces, normalised), lambda x: x != "")
    return F.array_distinct(F.transform(some, lambda x: F.xxhash64(x, F.length(x))))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, place, parent): for messages with quotes of earlier messages, the latest of the best quoted, by lowest level.

    messages: conv_id, place, body, quotes. A quote is known by its whole passage, or else by any of its pieces.
    """
    asks = messages.where(F.size("quotes") > 0).select("conv_id", "place", F.explode("quotes").alias("q"))
    asks = cut(asks.select("conv_id", "place", "q.level", F.posexplode(_hashes(F.col("q.passage"))).alias("piece", "hash")))
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    convs = asks.select(F.col("conv_id").alias("_c")).distinct()
    wanted = asks.select(F.col("conv_id").alias("_c"), F.col("hash").alias("_h")).distinct()
    offers = messages.join(convs, same, "left_semi").select("conv_id", "place", F.explode(_hashes(F.col("body"))).alias("hash"))
    offers = offers.join(wanted, same & (F.col("hash") == F.col("_h")), "left_semi")
    # The latest offer before an ask: in the ask's block of places, or the last one of the blocks before.
    none = F.lit(None).cast("int")
    events = asks.select("conv_id", "hash", "place", "level", "piece", F.lit(True).alias("asks")).union(offers.select("conv_id", "hash", "place", none, none, F.lit(False)))
    events = cut(events.withColumn("block", F.floor(F.col("place") / BLOCK)))
    offered = F.when(~F.col("asks"), F.col("place"))
    inside = W.partitionBy("conv_id", "hash", "block").orderBy("place", F.desc("asks")).rowsBetween(W.unboundedPreceding, 0)
    near = events.withColumn("near", F.max(offered).over(inside)).where("asks")
    blocks = events.groupBy("conv_id", "hash", "block").agg(F.max(offered).alias("last"))
    far = F.max("last").over(W.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    far = cut(blocks.select(F.col("conv_id").alias("_c"), F.col("hash").alias("_h"), F.col("block").alias("_b"), far.alias("far")).where("far is not null"))
    met = near.join(far, same & (F.col("hash") == F.col("_h")) & (F.col("block") == F.col("_b")), "left").withColumn("origin", F.coalesce("near", "far")).where("origin is not null")
    return met.groupBy("conv_id", "place").agg(F.max_by("origin", F.struct(-F.col("level"), -F.col("piece"), F.col("origin"))).alias("parent"))


def _depths(messages: DataFrame, linked: DataFrame) -> DataFrame:
    """(conv_id, place, depth) of messages in conversations with links: pointers doubled until all reach a root."""
    convs = linked.select(F.col("conv_id").alias("_c")).distinct()
    some = messages.select("conv_id", "place").join(convs, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    up = linked.select(F.col("conv_id").alias("_c"), F.col("place").alias("_p"), "parent")
    state = some.join(up, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("place") == F.col("_p")), "left").select("conv_id", "place", F.coalesce("parent", F.col("place") - 1).alias("up"))
    state = cut(state.withColumn("depth", (F.col("up") >= 0).cast("long")))
    while state.where("up >= 0").limit(1).count():
        far = state.select(F.col("conv_id").alias("_c"), F.col("place").alias("_p"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        step = state.join(far, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("up") == F.col("_p")), "left")
        state = cut(step.select("conv_id", "place", F.coalesce("_up", F.lit(-1)).alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")))
    return state.select("conv_id", "place", "depth")


def chat(table: DataFrame) -> DataFrame:
    """Per message of table (conv_id, turn, role, text): conv_id, turn, role, place, parent, depth, n_quotes, text, chat.

    place: in turn order. parent: the place it replies to (null: none). depth: in the reply tree; (depth, place) is the
    reply order. n_quotes: passages taken out. text: without quotes. chat: the message in chat markup.
    """
    bounded_batches(table.sparkSession)
    messages = cut(without_quotes(numbered(table)))
    linked = cut(links(messages))
    deep = _depths(messages, linked)
    key = lambda df, p: df.select(F.col("conv_id").alias(f"_c{p}"), F.col("place").alias(f"_p{p}"), *[c for c in df.columns if c not in ("conv_id", "place")])
    on = lambda p: F.col("conv_id").eqNullSafe(F.col(f"_c{p}")) & (F.col("place") == F.col(f"_p{p}"))
    joined = messages.join(key(linked, 1), on(1), "left").join(key(deep, 2), on(2), "left")
    parent = F.coalesce("parent", F.when(F.col("place") > 0, F.col("place") - 1))
    said = F.concat(F.lit("<|im_start|>"), F.coalesce(F.col("role").cast("string"), F.lit("user")), F.lit("\n"), F.col("body"), F.lit("<|im_end|>"))
    return joined.select("conv_id", "turn", "role", "place", parent.alias("parent"), F.coalesce("depth", "place").alias("depth"), F.size("quotes").cast("long").alias("n_quotes"), F.col("parent").isNotNull().alias("by_quote"), F.col("body").alias("text"), said.alias("chat"))
