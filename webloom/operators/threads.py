"""Chat threads: permanent links to resolved, formatted discussions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom import errors, schemas
from webloom.functions.html import OUTPUT_BYTES
from webloom.functions.text import escape_yaml, truncate_with_note

MENTION = r"(?s)<@([^>|]*)[^>]*>"
NO_AUTHOR = "(no author)"


def mentioned_ids(text: Column) -> Column:
    """User ids of the mentions <@id> and <@id|label>, in order; an unclosed one ends the search."""
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))


def mention_spans(text: Column) -> Column:
    """array<struct<user_id,start,end>> of the mentions, places in bytes of UTF-8, the end exclusive: running sums of what lies
    between them and of themselves."""
    gaps = F.transform(F.split(text, MENTION, -1), F.octet_length)
    found = F.transform(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)), F.octet_length)
    each = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, n: F.struct(g.alias("gap"), n.alias("n"))), mentioned_ids(text), lambda x, i: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), i.alias("user_id")))
    none = F.array().cast(f"array<{schemas.MENTION}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        return F.struct((first + x["n"]).alias("at"), F.concat(acc["spans"], F.array(F.struct(x["user_id"].alias("user_id"), first.alias("start"), (first + x["n"]).alias("end")))).alias("spans"))

    return F.when(text.isNotNull(), F.aggregate(each, start, step, lambda acc: acc["spans"]))


def substitute_mentions(text: Column, names: Column) -> Column:
    """Mentions as @name by a map of names; @id where the map has none."""
    gaps = F.split(text, MENTION, -1)
    ids = mentioned_ids(text)
    return F.array_join(F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.lit("@"), F.coalesce(F.try_element_at(names, F.get(ids, i - 1)), F.get(ids, i - 1)), g))), "")


def display_name(users: DataFrame) -> DataFrame:
    """(user, name): the display name unless empty, else the real name, else the id."""
    return users.select("user", F.coalesce(F.nullif("display_name", F.lit("")), "real_name", "user").alias("name"))


def thread_messages(links: DataFrame, messages: DataFrame) -> DataFrame:
    """(key, is_thread, idx, user, text, ts) of links (key, link). A link into a thread takes the thread; one to a
    message takes its thread if it has replies, else the message at or before it.

    The latest message at or before a link is found by one sort of links and messages. A channel's time is dealt out by its
    hours, so that a busy channel has many groups: within an hour the last message before a link, before that the last
    message of an earlier hour, of which there is one row each."""
    l = links.select("key", "link.channel", F.col("link.ts").alias("at"), F.col("link.thread_ts").alias("root"))
    at_or_before = messages.select("channel", F.col("ts").alias("m_ts"), "thread_ts", "user", "text", "reply_count").filter(F.col("thread_ts").isNull() | (F.col("thread_ts") == F.col("m_ts")))
    latest = latest_before(l.filter("root IS NULL").select("key", "channel", "at"), at_or_before)
    replied = F.coalesce("m.reply_count", F.lit(0)) > 0
    alone = latest.filter(~replied).select("key", F.lit(False).alias("is_thread"), "m.user", "m.text", "m.ts")
    roots = l.filter("root IS NOT NULL").select("key", "channel", "root").unionByName(latest.filter(replied).select("key", "channel", F.col("at").alias("root")))
    inside = messages.select("channel", F.coalesce("thread_ts", "ts").alias("root"), "user", "text", "ts")
    # a first message may be recorded by itself and within its thread
    threads = roots.join(inside, ["channel", "root"]).select("key", F.lit(True).alias("is_thread"), "user", "text", "ts").dropDuplicates(["key", "ts"])
    return alone.unionByName(threads).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("ts", F.coalesce("ts", F.lit("")))


def latest_before(links: DataFrame, messages: DataFrame) -> DataFrame:
    """(key, channel, at, m) of the links (key, channel, at) that have a message (channel, m_ts, user, text, reply_count) at
    or before `at`: the last one, and of those of one time the one with most replies."""
    hour = lambda ts: F.coalesce(F.floor(F.split_part(ts, F.lit("."), F.lit(1)).try_cast("long") / 3600), F.lit(-1))
    said = messages.select("channel", hour(F.col("m_ts")).alias("hour"), F.col("m_ts").alias("t"), F.struct("m_ts", F.coalesce("reply_count", F.lit(0)).alias("n"), "user", "text", F.col("m_ts").alias("ts"), "reply_count").alias("m"))
    asked = links.select("channel", hour(F.col("at")).alias("hour"), F.col("at").alias("t"), "key")
    by_hour = said.groupBy("channel", "hour").agg(F.max("m").alias("m"))
    # one row an hour: the last message of the hours before
    earlier = Window.partitionBy("channel").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = by_hour.unionByName(asked.select("channel", "hour", F.lit(None).cast(by_hour.schema["m"].dataType).alias("m")).distinct()).groupBy("channel", "hour").agg(F.max("m").alias("m"))
    before = hours.select("channel", "hour", F.max("m").over(earlier).alias("before"))
    both = said.select("channel", "hour", "t", "m", F.lit(None).cast(links.schema["key"].dataType).alias("key"), F.lit(0).alias("asks")).unionByName(asked.select("channel", "hour", "t", F.lit(None).cast(by_hour.schema["m"].dataType).alias("m"), "key", F.lit(1).alias("asks")))
    within = Window.partitionBy("channel", "hour").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("last", F.max("m").over(within)).filter("asks = 1")
    done = found.join(before, ["channel", "hour"], "left").select("key", "channel", F.col("t").alias("at"), F.coalesce("last", "before").alias("m"))
    return done.filter("m IS NOT NULL").select("key", "channel", "at", F.struct("m.user", "m.text", "m.ts", "m.reply_count").alias("m"))


def resolve(messages: DataFrame, users: DataFrame) -> DataFrame:
    """messages (key, is_thread, user, text, ts) with author and mentions by name: ids are looked up once each."""
    names = display_name(users)
    wanted = messages.select("key", F.explode(F.array_union(F.array_compact(F.array("user")), mentioned_ids(F.col("text")))).alias("user")).distinct()
    maps = wanted.join(names, "user").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("user", "name"))).alias("names"))
    joined = messages.join(maps, "key", "left").withColumn("names", F.coalesce("names", F.create_map().cast("map<string,string>")))
    author = F.when(F.col("user").isNull(), NO_AUTHOR).otherwise(F.coalesce(F.try_element_at("names", F.col("user")), F.col("user")))
    return joined.select("key", "is_thread", author.alias("author"), substitute_mentions(F.col("text"), F.col("names")).alias("text"), "ts")


def reply_text(author: Column, ts: Column, text: Column) -> Column:
    return F.concat(F.lit("\n\n---\n\n"), author, F.when(ts == "", "").otherwise(F.concat(F.lit(" ("), ts, F.lit(")"))), F.lit(":\n"), text)


def thread_head(link: Column, channel_name: Column, author: Column, n_replies: Column) -> Column:
    """YAML with the linked message's ts and the first message's author."""
    line = lambda name, value: F.concat(F.lit(f'{name}: "'), value, F.lit('"\n'))
    return F.concat(
        F.lit("---\n"),
        line("workspace", escape_yaml(link["workspace"])),
        line("channel", escape_yaml(channel_name)),
        line("author", escape_yaml(author)),
        line("ts", link["ts"]),
        F.when(n_replies > 0, F.concat(F.lit("replies: "), n_replies.cast("string"), F.lit("\n"))).otherwise(""),
        line("url", escape_yaml(link["raw_url"])),
        F.lit("---\n\n"),
    )


def first_bytes(messages: DataFrame, limit: int) -> DataFrame:
    """(key, author, n, size, body, ends) of each key's messages (key, is_thread, author, text, ts): the first one's author, the
    number of the others that count as replies, the bytes of all their text in order, and as much of that text as the first
    `limit` bytes need. `ends` says whether all of it ends in a line end.

    Running sums of bytes tell before anything is gathered which messages begin within the limit; later ones are only counted."""
    in_order = Window.partitionBy("key").orderBy("ts", "author", "text")
    placed = messages.withColumn("i", F.row_number().over(in_order)).filter((F.col("i") == 1) | F.col("is_thread"))
    part = F.when(F.col("i") == 1, F.col("text")).otherwise(reply_text(F.col("author"), F.col("ts"), F.col("text")))
    sized = placed.withColumn("part", part).withColumn("upto", F.sum(F.octet_length("part")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    begins = F.col("upto") - F.octet_length("part") <= limit
    return sized.groupBy("key").agg(
        F.min_by("author", "i").alias("author"),
        (F.count("*") - 1).alias("n"),
        F.max("upto").alias("size"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(begins, F.struct("i", "part")))), lambda x: x["part"]), "").alias("body"),
        F.max_by(F.endswith("part", F.lit("\n")) | (F.col("part") == ""), "i").alias("ends"),  # the head ends in one
    )


def fetch_threads(links: DataFrame, messages: DataFrame, users: DataFrame, channels: DataFrame) -> DataFrame:
    """links (key, link) with output (at most 100,000 bytes) and error. Unknown users and channels keep their ids; a link
    without messages is the error 'message not found'."""
    resolved = resolve(thread_messages(links, messages), users)
    by = first_bytes(resolved, OUTPUT_BYTES)
    named = links.withColumn("channel", F.col("link.channel")).join(channels.select("channel", F.col("name").alias("_name")), "channel", "left").drop("channel")
    joined = named.join(by, "key", "left")
    channel = F.coalesce(F.concat(F.lit("#"), F.col("_name")), F.col("link.channel"))
    head = thread_head(F.col("link"), channel, F.col("author"), F.col("n"))
    # a text that does not end in a line end gets one
    last = F.when(F.col("ends"), "").otherwise("\n")
    total = F.octet_length(head) + F.col("size") + F.octet_length(last)
    text = truncate_with_note(F.concat(head, F.col("body"), F.when(F.octet_length("body") == F.col("size"), last).otherwise("")), OUTPUT_BYTES, total)
    found = F.col("n").isNotNull()
    kind = F.when(~found, F.lit("Api"))
    return joined.select(*links.columns, F.when(found, text).alias("output"), errors.error("chat", kind, F.lit("message not found")).alias("error"))
