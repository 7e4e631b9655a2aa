"""Audit events and the chats they came from."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

WINDOW_S, SHORT_QUERY, NEWEST = 900, 12, 500


def _strings(value) -> Iterator[str]:
    """All strings of a JSON value, in order, without keys; a stack, for chats nest deeply."""
    todo = [value]
    while todo:
        top = todo.pop()
        if isinstance(top, str):
            yield top
        elif isinstance(top, (list, dict)):
            todo.extend(reversed(list(top.values() if isinstance(top, dict) else top)))


def _decoded(chat: str | None) -> list[str]:
    try:
        return list(_strings(json.loads(chat or "")))
    except ValueError:
        return [chat or ""]


@F.pandas_udf(ArrayType(StringType()))
def chat_strings(chats: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The strings of a chat stored as JSON, escapes decoded; a text that is not JSON is one string."""
    for part in chats:
        yield part.map(_decoded)


def with_users(chats: DataFrame, users: DataFrame) -> DataFrame:
    """chats (chat_id, user_id, ...) with email and name."""
    return chats.join(users.select(F.col("id").alias("user_id"), "email", "name"), "user_id", "left")


def newest_chats(chats: DataFrame, n: int = NEWEST) -> DataFrame:
    """The n chats that changed last: the report looks at no others."""
    return chats.orderBy(F.desc("updated_at"), "chat_id").limit(n)


def by_chat_id(events: DataFrame, chats: DataFrame) -> DataFrame:
    """events (event_id, at, chat_id) whose chat exists, with its columns and delta_seconds."""
    return events.join(chats, "chat_id").withColumns({"delta_seconds": _delta(F.col("at"), F.col("updated_at")), "match_kind": F.lit("chat_id")})


def containing(asked: DataFrame, tried: DataFrame) -> DataFrame:
    """(q, chat_id, no): for each text q of asked, the chats of tried (chat_id, strings) one of whose strings contains it, whatever
    the case, and the number of the first such string.

    Each task makes an automaton of the texts that it has (Aho-Corasick) and runs it over each string once: no text is compared with
    each chat. tried is sent to all tasks, so it must be small: by_text gives it the newest chats only.
    """
    spark = asked.sparkSession
    rows = tried.select("chat_id", F.transform("strings", F.lower).alias("strings")).toArrow()
    shared = spark.sparkContext.broadcast((rows["chat_id"].to_pylist(), rows["strings"].to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids, strings = shared.value
        for batch in batches:
            automaton, texts = ahocorasick.Automaton(), batch.column("q").to_pylist()
            for i, q in enumerate(texts):
                automaton.add_word(q, i)
            if not texts:
                continue
            automaton.make_automaton()
            found: dict[tuple[int, int], int] = {}
            for c, said in enumerate(strings):
                for n, text in enumerate(said or []):
                    for _, i in automaton.iter(text or ""):
                        found.setdefault((i, c), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([texts[i] for i, _ in found], pa.string()), pa.array([ids[c] for _, c in found], kind), pa.array(list(found.values()), pa.int32())], ["q", "chat_id", "no"]
            )

    kind = rows.schema.field("chat_id").type
    texts = asked.select("q").distinct().where("q <> ''")
    return texts.mapInArrow(run, f"q string, chat_id {dict(tried.dtypes)['chat_id']}, no int")


def by_text(events: DataFrame, chats: DataFrame, n: int = NEWEST, most: int = 5) -> DataFrame:
    """events (event_id, at, query) with the chats that contain the query, whatever the case: the `most` newest.

    A query of fewer than SHORT_QUERY characters also needs a chat that changed within WINDOW_S. chats hold strings,
    an array; only the n newest are tried, so the broadcast side has n rows whatever the table. Equal queries are looked for
    once, and come to their events as the list of their chats, the newest first.
    """
    tried = newest_chats(chats, n)
    asked = events.where("query <> ''").withColumn("q", F.lower("query"))
    hits = containing(asked, tried).join(F.broadcast(tried.select("chat_id", F.unix_micros("updated_at").alias("us"))), "chat_id")
    chat = F.struct((-F.col("us")).alias("late"), F.col("chat_id").alias("chat_id"), F.col("no"))
    lists = hits.groupBy("q").agg(F.array_sort(F.collect_list(chat)).alias("found"))
    near = lambda c: F.coalesce(F.abs(F.unix_seconds("at") + F.floor(c["late"] / 1_000_000)) <= WINDOW_S, F.lit(True)) | (F.length("query") >= SHORT_QUERY)
    rows = asked.join(lists, "q").withColumn("found", F.slice(F.filter("found", near), 1, most))
    rows = rows.select("*", F.posexplode("found").alias("place", "hit")).drop("found", "q").withColumn("place", F.col("place") + 1)
    rows = rows.drop("chat_id").withColumns({"chat_id": F.col("hit.chat_id"), "no": F.col("hit.no")}).drop("hit")
    found = rows.join(F.broadcast(tried), "chat_id")
    text = F.substring(F.get("strings", F.col("no")), 1, 500)
    found = found.withColumns({"matched_text": text, "delta_seconds": _delta(F.col("at"), F.col("updated_at")), "match_kind": F.lit("text")})
    return found.drop("strings", "no")


def correlated(events: DataFrame, chats: DataFrame) -> DataFrame:
    """Matches by chat_id, and by text for the events that have none."""
    hard = by_chat_id(events, chats.drop("strings"))
    rest = events.join(hard.select("event_id").distinct(), "event_id", "left_anti").drop("chat_id")
    return hard.unionByName(by_text(rest, chats), allowMissingColumns=True)


def _delta(a: Column, b: Column) -> Column:
    return F.abs(F.unix_seconds(a) - F.unix_seconds(b))
