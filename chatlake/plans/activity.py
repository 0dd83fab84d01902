"""Queries of the analytics operators: filters, counts, series, order statistics, ranks, reply joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions.text import bar, domain, highlight, preview, script_words, split_words, unicode_words
from chatlake.functions.time import at, monday_week, timeframe
from chatlake.operators import aggregates as A
from chatlake.operators import filters, order_stats, ranking, replies
from chatlake.operators.dedup import first_copies
from chatlake.plans.problems import KEPT_SQL
from chatlake.plans.tables import HUB_SQL, NOW, OTHER, USER, count_ranks, entities, hub, messages, participants

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, run, sql: str | None = None) -> None:
    """Register a query over the kept messages (``run`` gets spark and folder) and its SQL, in which ``kept`` may be read."""
    QUERIES[name] = run
    if sql:
        SQL[name] = f"WITH {KEPT_SQL} {sql}" if not sql.startswith(",") else f"WITH {KEPT_SQL}{sql}"


def _m(fn):
    return lambda spark, folder: fn(messages(spark, folder))


def _e(fn):
    return lambda spark, folder: fn(entities(spark, folder))


START, END = timeframe(NOW, "week")
_TS = "to_timestamp(date_unixtime)::TIMESTAMP"
_DAY = "strftime(make_timestamp(date_unixtime * 1000000), '%Y-%m-%d')"
_AT = "make_timestamp(date_unixtime * 1000000)"


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id", "date_unixtime")


# Filters and projections
_add("fil1_conjunction", _m(lambda m: _ids(m.where(filters.matching(from_date=START, has_links=True, has_media=False)))), f"SELECT id, date_unixtime FROM kept WHERE date_unixtime >= {START} AND has_links = 1 AND has_media = 0")
_add("fil2_chat_filter", _m(lambda m: m.where(filters.chat_matching(from_text="2016-01-10", to_text="2016-01-20T12:00:00", has_media="1")).select("id", "date")), "SELECT id, date FROM kept WHERE date >= '2016-01-10' AND date <= '2016-01-20T12:00:00' AND has_media = 1")
_add("fil4_time_range", _m(lambda m: _ids(m.where(filters.within(START, END)))), f"SELECT id, date_unixtime FROM kept WHERE date_unixtime BETWEEN {START} AND {END}")
_add("fil5_newest_of_user", _m(lambda m: _ids(filters.newest_of_user(m, USER))), f"SELECT id, date_unixtime FROM kept WHERE from_id = '{USER}' ORDER BY date_unixtime DESC, id LIMIT 100")
_add("fil6_name_contains", lambda s, d: filters.named_like(participants(s, d), "first_name", "vE").select("user_id", "first_name"), "SELECT user_id, first_name FROM participants WHERE contains(lower(first_name), 've')")
_add("fil7_text_length", _m(lambda m: m.where(F.length("text_plain") > 150).select("id", F.length("text_plain").cast("long").alias("n"))), "SELECT id, length(text_plain) AS n FROM kept WHERE length(text_plain) > 150")
_add("fil8_flags", _m(lambda m: m.agg(*[F.count_if(F.col(c) == 1).alias(c) for c in ("has_links", "has_photo", "is_edited")], F.count("forwarded_from").alias("forwards"))), "SELECT count(*) FILTER (has_links = 1) AS has_links, count(*) FILTER (has_photo = 1) AS has_photo, count(*) FILTER (is_edited = 1) AS is_edited, count(forwarded_from) AS forwards FROM kept")
_add("fil9_in_given_order", _m(lambda m: filters.in_given_order(m, [500030, 500010, 1, 500020, 500010]).select("pos", "id")), "SELECT pos, id FROM (VALUES (0::BIGINT, 500030::BIGINT), (1, 500010), (2, 1), (3, 500020), (4, 500010)) v(pos, id) JOIN kept USING (id)")
_add("fil10_exclude_self", _m(lambda m: _ids(m.where(F.col("from_id") != USER))), f"SELECT id, date_unixtime FROM kept WHERE from_id <> '{USER}'")
_add("fil11_active_users", _m(lambda m: filters.active_users(m, 20, START)), f"SELECT from_id, max(from_name) AS name, count(*) AS msg_count FROM kept WHERE from_id <> '' AND text_plain <> '' AND date_unixtime >= {START} GROUP BY from_id HAVING count(*) >= 20")
_add("fil13_previews", _m(lambda m: m.select("id", preview(F.col("text_plain"), 80).alias("text"), F.length("text_plain").cast("long").alias("n"))), "SELECT id, substr(text_plain, 1, 80) AS text, length(text_plain) AS n FROM kept")

# Scalar functions
_add("sca4_script_words", _m(lambda m: m.select("id", F.size(script_words(F.col("text_plain"))).cast("long").alias("n")).where("n > 0")), r"SELECT id, len(regexp_extract_all(lower(text_plain), '[\x{0590}-\x{05FF}a-z]+')) AS n FROM kept WHERE n > 0")
_add("sca5_unicode_words", _m(lambda m: m.select("id", F.array_join(unicode_words(F.col("text_plain")), " ").alias("words"))), r"SELECT id, array_to_string(regexp_extract_all(lower(text_plain), '[\p{L}\p{N}\p{M}_\x{200C}\x{200D}]+'), ' ') AS words FROM kept")
_add("sca6_split_words", _m(lambda m: m.select("id", F.size(split_words(F.col("text_plain"))).cast("long").alias("n")).where("n >= 0")), r"SELECT id, len(list_filter(regexp_split_to_array(text_plain, '[\p{Z}\s\x{85}\x{1C}-\x{1F}\v]+'), lambda w: w <> '')) AS n FROM kept WHERE text_plain IS NOT NULL")
_add("sca7_domains", _e(lambda e: e.where("type = 'link'").select("id", domain(F.col("value")).alias("domain"))), r"SELECT id, regexp_extract(value, '^https?://(?:www\.)?([^/]+)', 1) AS domain FROM entities WHERE type = 'link'")
_add("sca8_calendar", _m(lambda m: m.groupBy(monday_week(F.col("date_unixtime")).alias("week"), F.weekday(at(F.col("date_unixtime"))).cast("long").alias("monday_first")).agg(F.count("*").alias("n"))), f"SELECT strftime({_AT}, '%Y-W%W') AS week, (isodow({_AT}) - 1)::BIGINT AS monday_first, count(*) AS n FROM kept GROUP BY 1, 2")
_add("sca18_highlight", _m(lambda m: m.where(F.contains(F.lower("text_plain"), F.lit("storm"))).select("id", highlight(F.col("text_plain"), "storm").alias("text"))), "SELECT id, regexp_replace(text_plain, '(?i)(storm)', '<b>\\1</b>', 'g') AS text FROM kept WHERE contains(lower(text_plain), 'storm')")
_add("sca19_bar", _m(lambda m: A.by_hour(m).select("hour", bar(F.col("count"), F.lit(200_000), 400).alias("bar"))), f"SELECT hour({_AT}) AS hour, repeat('█', floor(count(*) / 200000 * 400)::BIGINT) AS bar FROM kept GROUP BY 1")

# Totals and series
_add("agg1_totals", _m(A.totals), """SELECT count(*) AS total_messages, count(DISTINCT from_id) AS total_users, min(date_unixtime) AS first_message, max(date_unixtime) AS last_message,
    (max(date_unixtime) - min(date_unixtime)) // 86400 AS days_span, count(*) FILTER (has_media = 1) AS has_media, count(*) FILTER (has_photo = 1) AS has_photo, count(*) FILTER (has_links = 1) AS has_links,
    count(*) FILTER (has_mentions = 1) AS has_mentions, count(*) FILTER (is_edited = 1) AS is_edited, count(reply_to_message_id) AS replies, count(forwarded_from) AS forwards FROM kept""")
_add("agg1_entity_counts", _e(A.entity_counts), "SELECT type, count(*) AS count FROM entities GROUP BY type")
_add("agg2_overview", _m(lambda m: A.overview(m, START, END).select("total_messages", "active_users", "first_message", "last_message", "days")), f"""SELECT count(*) AS total_messages, count(DISTINCT from_id) AS active_users, min(date_unixtime) AS first_message, max(date_unixtime) AS last_message,
    greatest(1, (max(date_unixtime) - min(date_unixtime)) // 86400) AS days FROM kept WHERE date_unixtime BETWEEN {START} AND {END}""")
_add("agg2_overview_means", _m(lambda m: A.overview(m, START, END).select("messages_per_day", "users_per_day", "messages_per_user")))
_PER_USER = f"""per_user AS (SELECT from_id, arg_max(from_name, (date_unixtime, id)) AS name, count(*) AS message_count, sum(has_links)::BIGINT AS link_count, sum(has_media)::BIGINT AS media_count,
    coalesce(sum(length(text_plain)), 0)::BIGINT AS char_count, min(date_unixtime) AS first_message, max(date_unixtime) AS last_message, count(DISTINCT {_DAY}) AS active_days FROM kept WHERE from_id <> '' GROUP BY from_id)"""
_add("agg3_top_users", _m(A.top_users), f", {_PER_USER} SELECT * FROM per_user ORDER BY message_count DESC, from_id LIMIT 20")
_LEADERS = f""", {_PER_USER}, people AS (SELECT user_id AS from_id, trim(concat_ws(' ', first_name, last_name)) AS full_name,
    CASE WHEN is_creator = 1 THEN 'creator' WHEN is_admin = 1 THEN 'admin' WHEN is_bot = 1 THEN 'bot' END AS role FROM participants),
    board AS (SELECT from_id, coalesce(name, 'Unknown') AS name, message_count, role FROM per_user LEFT JOIN people USING (from_id)
    UNION ALL SELECT from_id, CASE WHEN coalesce(full_name, '') = '' THEN 'Unknown' ELSE full_name END, 0, role FROM people WHERE from_id NOT IN (SELECT from_id FROM per_user))
    SELECT *, CASE WHEN message_count > 0 THEN row_number() OVER (ORDER BY message_count DESC, from_id) END AS rank FROM board ORDER BY message_count DESC, from_id"""
_add("agg4_leaderboard", lambda s, d: A.leaderboard(messages(s, d), participants(s, d), 50, 10).select("from_id", "name", "message_count", "role", "rank"), f"{_LEADERS} LIMIT 50 OFFSET 10")
_add("agg4_leaderboard_means", lambda s, d: A.leaderboard(messages(s, d), participants(s, d), 50).select("from_id", "char_count", "active_days", "percentage", "daily_average"))
_add("agg5_user_stats", _m(lambda m: A.user_stats(m, USER)), f"""SELECT count(*) AS message_count, sum(has_links)::BIGINT AS links, sum(has_media)::BIGINT AS media, count(reply_to_message_id) AS replies_sent, min(date_unixtime) AS first_message, max(date_unixtime) AS last_message,
    (SELECT count(*) FROM kept r JOIN kept p ON r.reply_to_message_id = p.id WHERE p.from_id = '{USER}') AS replies_received FROM kept WHERE from_id = '{USER}'""")
_add("agg6_user_hours", _m(lambda m: A.by_hour(m.where(F.col("from_id") == USER), dense=True)), f"SELECT h AS hour, count(id) AS count FROM range(24) t(h) LEFT JOIN kept ON hour({_AT}) = h AND from_id = '{USER}' GROUP BY h")
_add("agg7_profile", _m(lambda m: A.user_profile(m, USER).select("total_messages", "total_chars", "max_length", "photos_sent", "mentions_made", "edits", "forwards_sent", "replies_sent", "active_days")), f"""SELECT count(*) AS total_messages, sum(text_length)::BIGINT AS total_chars, max(text_length) AS max_length, sum(has_photo)::BIGINT AS photos_sent, sum(has_mentions)::BIGINT AS mentions_made,
    sum(is_edited)::BIGINT AS edits, count(forwarded_from) AS forwards_sent, count(reply_to_message_id) AS replies_sent, count(DISTINCT {_DAY}) AS active_days FROM kept WHERE from_id = '{USER}'""")
_add("agg7_profile_means", _m(lambda m: A.user_profile(m, USER).select("avg_length", "daily_average", "messages_per_calendar_day", "reply_ratio")))
_add("agg7_replies_to", _m(lambda m: replies.partners(m, USER, sent=True)), f"SELECT p.from_id AS user_id, count(*) AS count FROM kept r JOIN kept p ON r.reply_to_message_id = p.id WHERE r.from_id = '{USER}' AND p.from_id <> '{USER}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_add("agg7_replies_from", _m(lambda m: replies.partners(m, USER, sent=False)), f"SELECT r.from_id AS user_id, count(*) AS count FROM kept r JOIN kept p ON r.reply_to_message_id = p.id WHERE p.from_id = '{USER}' AND r.from_id <> '{USER}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_add("agg7_monthly", _m(lambda m: A.series(m.where(F.col("from_id") == USER), "month")), f"SELECT strftime({_AT}, '%Y-%m') AS label, count(*) AS value FROM kept WHERE from_id = '{USER}' GROUP BY 1")
_add("agg8_hours", _m(A.by_hour), f"SELECT hour({_AT}) AS hour, count(*) AS count FROM kept GROUP BY 1")
_add("agg8_hours_dense", _m(lambda m: A.by_hour(m, dense=True)), f"SELECT h AS hour, count(id) AS count FROM range(24) t(h) LEFT JOIN kept ON hour({_AT}) = h GROUP BY h")
_add("agg9_weekdays", _m(lambda m: A.by_weekday(m, dense=True)), f"SELECT d AS weekday, count(id) AS count FROM range(7) t(d) LEFT JOIN kept ON dayofweek({_AT}) = d GROUP BY d")
_add("agg10_months", _m(lambda m: A.series(m, "month")), f"SELECT strftime({_AT}, '%Y-%m') AS label, count(*) AS value FROM kept GROUP BY 1")
_add("agg11_hourly_series", _m(lambda m: A.series(m, "hour")), f"SELECT strftime({_AT}, '%Y-%m-%d %H:00') AS label, count(*) AS value FROM kept GROUP BY 1")
_add("agg11_daily_users", _m(lambda m: A.series(m, "day", users=True)), f"SELECT {_DAY} AS label, count(DISTINCT from_id) AS value FROM kept GROUP BY 1")
_add("agg11_weekly_users", _m(lambda m: A.series(m, "week", users=True)), f"SELECT strftime({_AT}, '%Y-W%W') AS label, count(DISTINCT from_id) AS value FROM kept GROUP BY 1")
_add("agg12_heatmap", _m(A.heatmap), f"SELECT c // 24 AS weekday, c % 24 AS hour, count(id) AS count FROM range(168) t(c) LEFT JOIN kept ON dayofweek({_AT}) * 24 + hour({_AT}) = c GROUP BY c")

# Order statistics
_lengths = _m(lambda m: order_stats.percentiles(m.where("text_length > 0"), "text_length", [25, 75, 90, 95, 99]))
_SORTED = ", sorted AS (SELECT list_sort(list({x})) AS v FROM {rows})"


def _points(points: list[int]) -> str:
    return ", ".join(f"v[floor({p} / 100::DOUBLE * (len(v) - 1))::BIGINT + 1] AS p{p}" for p in points)


_MID = "(v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2 AS median"
_add("agg13_16_length_stats", _lengths, _SORTED.format(x="text_length", rows="kept WHERE text_length > 0") + f" SELECT len(v) AS count, v[1] AS min, v[-1] AS max, {_MID}, {_points([25, 75, 90, 95, 99])} FROM sorted")
_add("agg15_kth_smallest", _m(lambda m: order_stats.kth_smallest(m, "text_length", 1000)), "SELECT text_length AS value FROM kept WHERE text_length IS NOT NULL ORDER BY 1 LIMIT 1 OFFSET 1000")
_SECONDS = ", gaps AS (SELECT r.from_id, r.date_unixtime - p.date_unixtime AS seconds FROM kept r JOIN kept p ON r.reply_to_message_id = p.id WHERE r.date_unixtime > p.date_unixtime)"
_add("agg17_reply_seconds", _m(lambda m: order_stats.percentiles(replies.reply_seconds(m), "seconds", [75, 90, 95])), _SECONDS + _SORTED.format(x="seconds", rows="gaps") + f" SELECT len(v) AS count, v[1] AS min, v[-1] AS max, {_MID}, {_points([75, 90, 95])} FROM sorted")
_add("agg18_histogram", _m(lambda m: order_stats.time_histogram(m.where("date_unixtime > 0"), "date_unixtime", 10_000)), """, span AS (SELECT min(date_unixtime) AS low, max(date_unixtime) AS high FROM kept WHERE date_unixtime > 0),
    spine AS (SELECT unnest(range(low, high + 1, 10000)) AS bucket_start FROM span), counted AS (SELECT low + (date_unixtime - low) // 10000 * 10000 AS bucket_start, count(*) AS n FROM kept, span WHERE date_unixtime > 0 GROUP BY 1)
    SELECT bucket_start, coalesce(n, 0) AS count FROM spine LEFT JOIN counted USING (bucket_start)""")
_add("agg19_buckets", _m(lambda m: order_stats.bucketed(m, "date_unixtime", 3600, START, END).select("id", "bucket_no", "place")), f"SELECT id, (date_unixtime - {START}) // 3600 AS bucket_no, row_number() OVER (PARTITION BY (date_unixtime - {START}) // 3600 ORDER BY id) AS place FROM kept WHERE date_unixtime BETWEEN {START} AND {END}")
_add("agg20_daily_histogram", _m(lambda m: order_stats.last_buckets(order_stats.time_histogram(m.where("date_unixtime > 0"), "date_unixtime", 86_400), 10)), """, span AS (SELECT min(date_unixtime) AS low, max(date_unixtime) AS high FROM kept WHERE date_unixtime > 0),
    spine AS (SELECT unnest(range(low, high + 1, 86400)) AS bucket_start FROM span), counted AS (SELECT low + (date_unixtime - low) // 86400 * 86400 AS bucket_start, count(*) AS n FROM kept, span WHERE date_unixtime > 0 GROUP BY 1)
    SELECT bucket_start, coalesce(n, 0) AS count FROM spine LEFT JOIN counted USING (bucket_start) ORDER BY 1 DESC LIMIT 10""")
_add("agg21_known_hours", _m(lambda m: A.by_hour(m, skip_unknown=True)), f"SELECT hour({_AT}) AS hour, count(*) AS count FROM kept WHERE date_unixtime <> 0 GROUP BY 1")
_add("agg22_most_frequent", _m(lambda m: order_stats.most_frequent(m, "from_name", 15)), "SELECT from_name, count(*) AS count FROM kept WHERE from_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
_add("agg23_top_words", _m(A.top_words), r"SELECT word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text_plain), '[\x{0590}-\x{05FF}a-z]{3,}')) AS word FROM kept) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
_add("agg24_top_domains", _e(A.top_domains), r"SELECT regexp_extract(value, '^https?://(?:www\.)?([^/]+)', 1) AS domain, count(*) AS count FROM entities WHERE type = 'link' AND regexp_matches(value, '^https?://(?:www\.)?([^/]+)') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
_add("agg25_top_mentions", _e(A.top_mentions), "SELECT value, count(*) AS count FROM entities WHERE type = 'mention' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
_add("agg26_forward_sources", _m(A.forward_sources), "SELECT forwarded_from_id, arg_max(forwarded_from, (date_unixtime, id)) AS name, count(*) AS count FROM kept WHERE forwarded_from IS NOT NULL GROUP BY 1 ORDER BY 3 DESC, 1 NULLS FIRST LIMIT 20")
_add("agg27_top_links", lambda s, d: A.top_links_of(messages(s, d), entities(s, d), OTHER), f"SELECT value, count(*) AS count FROM entities JOIN kept ON message_id = kept.id WHERE entities.type = 'link' AND from_id = '{OTHER}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_add("agg28_mean_reply_time", _m(lambda m: replies.mean_reply_time(m).select("from_id", F.round("mean_seconds", 4).alias("mean_seconds"), "n")), f"{_SECONDS} SELECT from_id, round(avg(seconds), 4) AS mean_seconds, count(*) AS n FROM gaps WHERE seconds < 86400 GROUP BY from_id")
_add("agg29_table_stats", lambda s, d: A.table_stats(messages(s, d), entities(s, d)), "SELECT count(*) AS messages, count(DISTINCT from_id) AS users, min(date) AS first_date, max(date) AS last_date, (SELECT count(*) FROM entities) AS entities FROM kept")
_add("agg30_prompt_names", _m(lambda m: order_stats.most_frequent(m.where("from_name <> ''"), "from_name", 10)), "SELECT from_name, count(*) AS count FROM kept WHERE from_name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_add("agg32_entities_by_message", _e(lambda e: A.entities_by_message(e).select("message_id", F.size("entities").cast("long").alias("n"), F.element_at("entities", 1)["value"].alias("first"))), "SELECT message_id, count(DISTINCT (type, value)) AS n, min((type, value))[2] AS first FROM entities GROUP BY 1")
_add("agg33_means_of_active", _m(lambda m: A.means_of_active(m).select(F.round("mean_messages", 6).alias("mean_messages"))), "SELECT round(avg(n), 6) AS mean_messages FROM (SELECT count(*) AS n FROM kept WHERE from_id <> '' GROUP BY from_id)")
_add("agg33_top_link_sharers", _m(A.top_link_sharers), f", {_PER_USER} SELECT from_id, name, link_count FROM per_user WHERE link_count > 0 ORDER BY link_count DESC, from_id LIMIT 10")
_add("agg34_distinct", _m(lambda m: m.agg(F.countDistinct("from_id").alias("users"), F.countDistinct("text_plain").alias("texts"))), "SELECT count(DISTINCT from_id) AS users, count(DISTINCT text_plain) AS texts FROM kept")
_add("snk6_users_table", _m(A.users_table), "SELECT from_id, arg_min(from_name, delivery_id) AS display_name, min(date_unixtime) FILTER (date_unixtime > 0) AS first_seen, max(date_unixtime) FILTER (date_unixtime > 0) AS last_seen, count(*) AS message_count FROM kept WHERE from_id <> '' GROUP BY 1")

# Ranks
_INDEX = ", counts AS (SELECT from_id, count(*) AS n FROM kept WHERE from_id <> '' GROUP BY 1), total AS (SELECT count(DISTINCT n) AS k FROM counts)"
_add("rnk5_7_user_ranks", lambda s, d: count_ranks(s, d).select("from_id", "message_count", "rank", "total_users", F.round("percentile", 6).alias("percentile")), f"{_INDEX} SELECT from_id, n AS message_count, dense_rank() OVER (ORDER BY n DESC) AS rank, k AS total_users, round((k - dense_rank() OVER (ORDER BY n)) / k * 100, 6) AS percentile FROM counts, total")
_add("rnk6_8_user_by_rank", _m(lambda m: ranking.user_by_rank(m, 5)), f"{_INDEX} SELECT max(from_id) AS from_id, n AS message_count FROM counts GROUP BY n ORDER BY n DESC LIMIT 1 OFFSET 4")
_add("rnk9_competition", _m(ranking.competition_ranks), ", counts AS (SELECT from_id, count(*) AS n FROM kept GROUP BY 1) SELECT from_id, n, rank() OVER (ORDER BY n DESC) AS rank FROM counts")
_pairs = _m(lambda m: m.select(F.col("text_length").alias("key"), F.col("id").alias("value"), F.col("id").alias("seq")).where("key is not null"))
_add("rnk2_select", lambda s, d: ranking.select_kth(_pairs(s, d), 50), "SELECT text_length AS key, max(id) AS value FROM kept WHERE text_length IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 1 OFFSET 49")
_add("rnk3_rank_of", lambda s, d: ranking.rank_of(_pairs(s, d), 100), "SELECT count(DISTINCT text_length) FILTER (text_length <= 100) AS rank FROM kept")
_add("rnk1_4_in_order", lambda s, d: ranking.in_order(_pairs(s, d)), "SELECT text_length AS key, max(id) AS value FROM kept WHERE text_length IS NOT NULL GROUP BY 1")
_add("rnk12_top_in_range", _m(lambda m: ranking.top_in_range(m, START, END, "text_length", 10).select("id", "text_length")), f"SELECT id, text_length FROM kept WHERE date_unixtime BETWEEN {START} AND {END} ORDER BY text_length DESC NULLS LAST, id LIMIT 10")

# Top-k and pages
_add("srt1_top_k", _m(lambda m: order_stats.top_k(m, "photo_file_size", 20).select("id", "photo_file_size")), "SELECT id, photo_file_size FROM kept ORDER BY coalesce(photo_file_size, 0) DESC, id LIMIT 20")
_add("srt2_bottom_k", _m(lambda m: order_stats.top_k(m, "text_length", 20, largest=False).select("id", "text_length")), "SELECT id, text_length FROM kept ORDER BY coalesce(text_length, 0), id LIMIT 20")
_add("srt3_page", _m(lambda m: order_stats.page(m, [F.desc("date_unixtime"), F.col("id")], 50, 100).select("id", "date_unixtime")), "SELECT id, date_unixtime FROM kept ORDER BY date_unixtime DESC, id LIMIT 50 OFFSET 100")

# Joins
_add("joi1_answered", _m(lambda m: replies.answered(m).select("id", "parent_id", "from_id", "parent_from_id")), "SELECT r.id, p.id AS parent_id, r.from_id, p.from_id AS parent_from_id FROM kept r JOIN kept p ON r.reply_to_message_id = p.id")
_add("joi2_reply_network", _m(replies.reply_network), "SELECT r.from_id, p.from_id AS to_id, arg_max(r.from_name, r.id) AS from_name, arg_max(p.from_name, p.id) AS to_name, count(*) AS count FROM kept r JOIN kept p ON r.reply_to_message_id = p.id GROUP BY 1, 2 ORDER BY count DESC, 1 NULLS FIRST, 2 NULLS FIRST LIMIT 100")
_add("joi3_reply_preview", _m(lambda m: replies.with_reply_preview(m).select("id", "reply_to_name", "reply_to_text")), "SELECT m.id, p.from_name AS reply_to_name, substr(p.text_plain, 1, 100) AS reply_to_text FROM kept m LEFT JOIN kept p ON m.reply_to_message_id = p.id")
_add("joi4_link_messages", lambda s, d: replies.entity_messages(messages(s, d), entities(s, d), "link").select("id", "value"), "SELECT DISTINCT kept.id, value, date_unixtime FROM entities JOIN kept ON message_id = kept.id WHERE entities.type = 'link' ORDER BY date_unixtime DESC, kept.id, value LIMIT 100".replace("SELECT DISTINCT kept.id, value, date_unixtime", "SELECT id, value FROM (SELECT DISTINCT kept.id, value, date_unixtime") + ")")
_add("joi8_roles", lambda s, d: participants(s, d).select("user_id", F.when(F.col("is_creator") == 1, "creator").when(F.col("is_admin") == 1, "admin").when(F.col("is_bot") == 1, "bot").alias("role")).where("role is not null"), "SELECT user_id, CASE WHEN is_creator = 1 THEN 'creator' WHEN is_admin = 1 THEN 'admin' ELSE 'bot' END AS role FROM participants WHERE is_creator = 1 OR is_admin = 1 OR is_bot = 1")
_add("joi9_silent_members", lambda s, d: participants(s, d).join(messages(s, d).select(F.col("from_id").alias("user_id")), "user_id", "left_anti").select("user_id"), "SELECT user_id FROM participants WHERE user_id NOT IN (SELECT from_id FROM kept WHERE from_id IS NOT NULL)")
_add("joi10_conversation", _m(lambda m: replies.conversation_of(m, USER, OTHER).select("id", "from_id")), f"SELECT r.id, r.from_id FROM kept r JOIN kept p ON r.reply_to_message_id = p.id WHERE (r.from_id = '{USER}' AND p.from_id = '{OTHER}') OR (r.from_id = '{OTHER}' AND p.from_id = '{USER}') ORDER BY r.date_unixtime DESC, r.id LIMIT 100")


def _around(spark, folder) -> DataFrame:
    rows = messages(spark, folder)
    return replies.around(rows, hub(rows), 5).select("id", F.col("position").cast("long").alias("position"))


_add("joi13_neighbours", _around, f""", mark AS (SELECT date_unixtime AS t, id AS hub FROM kept WHERE id = {HUB_SQL}) SELECT id, position FROM (
    (SELECT id, -row_number() OVER (ORDER BY date_unixtime DESC, id DESC) AS position FROM kept, mark WHERE date_unixtime < t) UNION ALL
    (SELECT id, row_number() OVER (ORDER BY date_unixtime, id) FROM kept, mark WHERE date_unixtime > t) UNION ALL SELECT hub, 0 FROM mark) WHERE position BETWEEN -5 AND 5""")
_add("ded2_first_copies", lambda s, d: first_copies(entities(s, d), ["message_id", "type", "value"], [F.col("id")]).select("id"), "SELECT min(id) AS id FROM entities GROUP BY message_id, type, value")


# Details of profiles, pages and means; DuckDB rounds half to even with round_even
_MINE = f"kept WHERE from_id = '{USER}'"
_mine = lambda m: m.where(F.col("from_id") == USER)
_add("agg6_last_active_days", _m(lambda m: A.series(_mine(m), "day").orderBy(F.desc("label")).limit(30)), f"SELECT {_DAY} AS label, count(*) AS value FROM {_MINE} GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
_add("agg7_daily", _m(lambda m: A.series(_mine(m), "day").orderBy(F.desc("label")).limit(90)), f"SELECT {_DAY} AS label, count(*) AS value FROM {_MINE} GROUP BY 1 ORDER BY 1 DESC LIMIT 90")
_add("agg7_weekdays", _m(lambda m: A.by_weekday(_mine(m), dense=True)), f"SELECT d AS weekday, count(id) AS count FROM range(7) t(d) LEFT JOIN kept ON dayofweek({_AT}) = d AND from_id = '{USER}' GROUP BY d")
_add("agg7_forward_names", _m(lambda m: order_stats.most_frequent(_mine(m), "forwarded_from", 5)), f"SELECT forwarded_from, count(*) AS count FROM {_MINE} AND forwarded_from IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
_add("vie2_chat_page", lambda s, d: replies.chat_page(messages(s, d), entities(s, d), filters.chat_matching(from_text="2016-01-10"), 50, 20).select("id", "reply_to_name", "reply_to_text", F.size("entities").cast("long").alias("n_entities"), "total", "has_more"), """, rows AS (SELECT * FROM kept WHERE date >= '2016-01-10'), page AS (SELECT * FROM rows ORDER BY date, id LIMIT 50 OFFSET 20)
    SELECT page.id, p.from_name AS reply_to_name, substr(p.text_plain, 1, 100) AS reply_to_text, (SELECT count(DISTINCT (e.type, e.value)) FROM entities e WHERE e.message_id = page.id) AS n_entities,
    (SELECT count(*) FROM rows) AS total, 70 < (SELECT count(*) FROM rows) AS has_more FROM page LEFT JOIN kept p ON page.reply_to_message_id = p.id""")
_add("rnk7_percentile_above", lambda s, d: count_ranks(s, d).select("from_id", F.col("percentile_above").alias("percentile")), f"{_INDEX} SELECT from_id, round(100 * (k - dense_rank() OVER (ORDER BY n DESC) + 1) / k, 1) AS percentile FROM counts, total")
SQL["agg2_overview_means"] = f"""WITH {KEPT_SQL}, r AS (SELECT * FROM kept WHERE date_unixtime BETWEEN {START} AND {END}), d AS (SELECT count(DISTINCT from_id) AS u FROM r GROUP BY {_DAY}),
    t AS (SELECT count(*) AS n, count(DISTINCT from_id) AS u, greatest(1, (max(date_unixtime) - min(date_unixtime)) // 86400) AS days FROM r)
    SELECT round_even(n / days, 1) AS messages_per_day, (SELECT round_even(avg(u), 1) FROM d) AS users_per_day, round_even(n / greatest(1, u), 1) AS messages_per_user FROM t"""
SQL["agg4_leaderboard_means"] = f"""WITH {KEPT_SQL}, {_PER_USER}, board AS (SELECT from_id, char_count, active_days, message_count FROM per_user
    UNION ALL SELECT user_id, 0, 0, 0 FROM participants WHERE user_id NOT IN (SELECT from_id FROM per_user))
    SELECT from_id, char_count, active_days, round_even(message_count * 100 / (SELECT count(*) FROM kept), 2) AS percentage, round_even(message_count / greatest(1, active_days), 1) AS daily_average
    FROM board ORDER BY message_count DESC, from_id LIMIT 50"""
SQL["agg7_profile_means"] = f"""WITH {KEPT_SQL} SELECT round_even(avg(text_length), 1) AS avg_length, round_even(count(*) / count(DISTINCT {_DAY}), 1) AS daily_average,
    round_even(count(*) / greatest(1, (max(date_unixtime) - min(date_unixtime)) / 86400), 1) AS messages_per_calendar_day, round_even(count(reply_to_message_id) * 100 / count(*), 1) AS reply_ratio FROM {_MINE}"""

_add("rnk12_time_rank", _m(lambda m: ranking.time_rank(m, "date_unixtime", START)), f"SELECT count(DISTINCT date_unixtime) FILTER (date_unixtime <= {START}) AS rank FROM kept")
_add("rnk12_record_at_rank", _m(lambda m: ranking.record_at_rank(m, "date_unixtime", 500).select("id", "date_unixtime")), "SELECT id, date_unixtime FROM kept WHERE date_unixtime = (SELECT DISTINCT date_unixtime FROM kept WHERE date_unixtime IS NOT NULL ORDER BY 1 LIMIT 1 OFFSET 499) ORDER BY id DESC LIMIT 1")
