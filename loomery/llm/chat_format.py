"""Chat formatting by event-sourced reconstruction.

The log of a conversation has events (conv, seq, kind, msg, role, text): `start` gives a
message its role, `delta` appends streamed text, `edit` replaces the text so far, and
`regenerate` drops what the message and all later messages had before it. The fold is done
for each message by itself: which events a regeneration undoes is found over the events'
numbers alone, and only a message's own deltas meet in a task, so that no conversation,
however long, is gathered. Rendered turns are joined to parts of a bounded size.

Template: `### Role: text</turn>` and a line feed. Inside of texts a backslash is doubled, and
one is put before `###` and before the slash of `</turn>`; taking away each backslash that stands
before a character undoes it. The loss mask is the spans of assistant texts in each part.

Defined cases: null texts and roles are empty; an event with a null conversation belongs to
one conversation without a number; equal events count each; events of a message are taken by
seq; a message without a surviving event is not rendered; an empty log gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
PART_CHARS = 1 << 20
DELTA_CHARS = 256


def fold(log: DataFrame) -> DataFrame:
    """(conv, msg, role, text) of each message that is left at the end of the log."""
    # the last regeneration that undoes a message: the largest seq among those of it or earlier ones
    light = log.select("conv", "msg").distinct().withColumn("undo", F.lit(None).cast("long"))
    undo = log.where("kind = 'regenerate'").select("conv", "msg", F.col("seq").alias("undo"))
    run = W.partitionBy("conv").orderBy("msg", F.col("undo").isNull()).rowsBetween(W.unboundedPreceding, 0)
    both = light.unionByName(undo).withColumn("own", F.col("undo").isNull()).withColumn("cut", F.max("undo").over(run))
    cuts = both.where("own and cut is not null").select(F.col("conv").alias("c_conv"), F.col("msg").alias("c_msg"), "cut")
    alive = log.join(cuts, F.col("conv").eqNullSafe(F.col("c_conv")) & (F.col("msg") == F.col("c_msg")), "left").where("cut is null or seq >= cut")
    item = F.struct("seq", F.when(F.col("kind").isin("delta", "edit"), F.coalesce("text", F.lit(""))).otherwise("").alias("text"))
    messages = alive.groupBy("conv", "msg").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.coalesce(F.max(F.when(F.col("kind") == "edit", F.col("seq"))), F.min("seq")).alias("since"),
        F.array_sort(F.collect_list(item)).alias("items"),
    )
    text = F.array_join(F.transform(F.filter("items", lambda e: e["seq"] >= F.col("since")), lambda e: e["text"]), "")
    return messages.select("conv", "msg", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("###"), F.lit("\\###")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(messages: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv, part, n_turns, formatted, loss) with loss an array of (start, end) in formatted."""
    known = F.col("role").isin(*ROLES)
    other = F.concat(F.lit("\\"), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:")))
    head = F.concat(F.lit("### "), F.when(known, F.initcap("role")).otherwise(other), F.lit(": "))
    turns = messages.select("conv", "msg", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + 8)
    before = F.sum("size").over(W.partitionBy("conv").orderBy("msg").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    # only numbers go through the running sum
    places = turns.select("conv", "msg", "size").withColumn("before", before).select(F.col("conv").alias("p_conv"), F.col("msg").alias("p_msg"), "before")
    placed = turns.join(places, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("msg") == F.col("p_msg")))
    placed = placed.withColumn("part", F.floor(F.col("before") / part_chars).cast("long"))
    turn = F.struct("msg", F.concat("head", "body", F.lit("</turn>\n")).alias("shown"), F.length("head").alias("from"), F.length("body").alias("n"), (F.col("role") == "assistant").alias("learn"), "before")
    parts = placed.groupBy("conv", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.min("before").alias("zero"))
    start = lambda t: t["before"] - F.col("zero") + t["from"]
    loss = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(start(t).alias("start"), (start(t) + t["n"]).alias("end")))
    return parts.select("conv", "part", F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"), loss.alias("loss"))


_TURN = re.compile(r"### (\\?)((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.DOTALL)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, parsed from the formatted text alone."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        yield (unescaped(m[2]) if m[1] else m[2].lower()), unescaped(m[3])
        at = m.end()


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, from its parts in order: (conv, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars). A part is in memory at a time."""
    columns = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None

        def ended():
            return pd.DataFrame([[now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]]], columns=columns).astype({"conv": "Int64"})

        done = []
        for batch in batches:
            for conv, formatted, loss in zip(batch["conv"], batch["formatted"], batch["loss"]):
                conv = None if pd.isna(conv) else int(conv)
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(ended())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    text = unescaped(formatted[span["start"] : span["end"]])
                    now[3] += len(text)
                    now[4].update(text.encode("utf-8", "surrogatepass"))
                now[5] += len(formatted)
            if len(done) >= 1000:
                yield pd.concat(done)
                done = []
        if now is not None:
            done.append(ended())
        if done:
            yield pd.concat(done)

    ordered = parts.repartition("conv").sortWithinPartitions("conv", "part").select("conv", "formatted", "loss")
    return ordered.mapInPandas(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_log(conversations: DataFrame) -> DataFrame:
    """A log that ends in the rows of conversations (conv_id, turn, role, text): each row is a message of its own,
    with a start and deltas of some characters. Of every four messages (by a hash) one is first drafted, with a draft of
    the next message behind it, and regenerated, which undoes both; another is drafted and edited."""
    msg = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select(F.col("conv_id").alias("conv"), msg.alias("msg"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("way", F.pmod(F.xxhash64("conv", "msg"), F.lit(4)))

    def event(kind: str, text: Column, later: int = 0) -> Column:
        role = F.col("role") if kind == "start" else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), (F.col("msg") + later).alias("msg"), role.alias("role"), text.alias("text"))

    nothing, draft = F.lit(""), F.reverse("text")
    undone = F.array(event("start", nothing), event("delta", draft), event("start", nothing, 1), event("delta", draft, 1), event("regenerate", nothing))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))
    deltas = F.transform(pieces, lambda x: event("delta", x))
    edited = F.array(event("delta", draft), event("edit", F.left("text", F.lit(DELTA_CHARS))))
    none = F.slice(undone, 1, 0)
    parts = F.concat(F.when(F.col("way") == 0, undone).otherwise(none), F.array(event("start", nothing)), F.when(F.col("way") == 1, F.concat(edited, F.slice(deltas, 2, 1 << 30))).otherwise(deltas))
    events = rows.select("conv", F.col("msg").alias("of"), F.posexplode(parts).alias("i", "e"))
    return events.select("conv", (F.col("of") * (1 << 24) + F.col("i")).alias("seq"), "e.kind", "e.msg", "e.role", "e.text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return read_back(render(fold(as_log(rows.unionByName(more))))).withColumnRenamed("conv", "conv_id")


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>') AS body FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN role
      ELSE '\' || replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>'), ':', '\:') END) + 2 + length(body) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
