"""Analytics, ranks, replies, time: golden cases and properties."""

import statistics

from pyspark.sql import functions as F

from chatlake.functions import text, time
from chatlake.operators import aggregates as A
from chatlake.operators import filters, order_stats, ranking, replies


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_lower_nearest_percentiles(spark):
    for values in ([1, 2], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5], list(range(10_000, 0, -7)), [5]):
        df = spark.createDataFrame([(v,) for v in values], "x long")
        got = order_stats.percentiles(df, "x", [25, 75, 90, 29]).first()
        ordered = sorted(values)
        assert got["median"] == statistics.median(values) and got["count"] == len(values)
        for p in (25, 75, 90, 29):
            assert got[f"p{p}"] == ordered[int(p / 100 * (len(values) - 1))]
        assert order_stats.kth_smallest(df, "x", len(values) - 1).first()["value"] == ordered[-1]
    empty = order_stats.percentiles(spark.createDataFrame([], "x long"), "x", [90]).first()
    assert (empty["count"], empty["median"], empty["p90"]) == (0, 0.0, 0)


def test_histogram_starts_at_the_first_time(spark):
    df = spark.createDataFrame([(1700000500,), (1700000501,), (1700004000,), (None,)], "t long")
    assert rows_of(order_stats.time_histogram(df, "t", 1000)) == [(1700000500, 2), (1700001500, 0), (1700002500, 0), (1700003500, 1)]
    assert order_stats.time_histogram(df.where("false"), "t", 10).count() == 0


def test_monday_weeks_and_timeframes(spark):
    days = {1672531200: "2023-W00", 1672617600: "2023-W01", 1735603200: "2024-W53", 1704067200: "2024-W01"}
    df = spark.createDataFrame([(d,) for d in days], "t long").select("t", time.period(F.col("t"), "week").alias("w"))
    assert {r.t: r.w for r in df.collect()} == days
    assert time.timeframe(1_000_000, "yesterday") == (864_000, 950_400)
    assert time.timeframe(100, "5,9") == (5, 9) and time.timeframe(100, "nonsense") == (0, 100)
    spelled = spark.createDataFrame([("2024-01-02T03:04:05",), ("2024-01-02 03:04:05",), ("soon",), (None,)], "d string").select(time.parsed(F.col("d")).cast("string").alias("p"))
    assert [r.p for r in spelled.collect()] == ["2024-01-02 03:04:05"] * 2 + [None, None]


def test_ranks_with_ties(chat):
    rows = chat(*[{"id": n, "from_id": who} for n, who in enumerate("aaabbbccde")], {"id": 99, "from_id": ""}, {"id": 98})
    got = {r.from_id: (r.rank, r.total_users) for r in ranking.user_ranks(rows).collect()}
    assert got == {"a": (1, 3), "b": (1, 3), "c": (2, 3), "d": (3, 3), "e": (3, 3)}
    assert {r.from_id: r["rank"] for r in ranking.competition_ranks(rows).collect()} == {"a": 1, "b": 1, "c": 3, "d": 4, "e": 4, "": 4, None: 4}
    assert ranking.user_by_rank(rows, 1).first()["from_id"] == "b" and ranking.user_by_rank(rows, 9).count() == 0


def test_order_statistics_tree_semantics(spark):
    pairs = spark.createDataFrame([(100, "a", 1), (250, "b", 2), (100, "c", 3), (50, "d", 4)], "key long, value string, seq long")
    assert ranking.select_kth(pairs, 2).first()["value"] == "c" and ranking.select_kth(pairs, 4).count() == 0
    assert ranking.rank_of(pairs, 250).first()["rank"] == 3 and ranking.rank_of(pairs, 150).first()["rank"] == 2
    assert [r.key for r in ranking.in_order(pairs).collect()] == [50, 100, 250]


def test_filters(chat):
    rows = chat({"id": 1, "from_id": "a", "date_unixtime": 10, "has_links": 1, "text_plain": "x"}, {"id": 2, "from_id": "a", "date_unixtime": 20, "text_plain": ""}, {"id": 3, "date_unixtime": 30, "text_plain": "y"})
    assert [r.id for r in rows.where(filters.matching(user_id="a", from_date=0, to_date=15)).collect()] == [1]
    assert [r.id for r in rows.where(filters.matching(has_links=False)).orderBy("id").collect()] == [2, 3]
    assert [(r.pos, r.id) for r in filters.in_given_order(rows, [3, 9, 1, 3]).orderBy("pos").collect()] == [(0, 3), (2, 1), (3, 3)]
    assert rows_of(filters.active_users(rows, 1, 0)) == [("a", None, 1)]
    assert filters.sampled(rows, 2, 4).count() == 2


def test_replies_and_neighbours(chat):
    rows = chat(*[{"id": n, "from_id": w, "from_name": w.upper(), "date_unixtime": t, "reply_to_message_id": r} for n, w, t, r in ((1, "a", 10, None), (2, "b", 40, 1), (3, "a", 41, 2), (4, "a", 41, 1), (5, "b", 9, 77))])
    assert [(r.from_id, r.to_id, r["count"]) for r in replies.reply_network(rows).collect()] == [("a", "a", 1), ("a", "b", 1), ("b", "a", 1)]
    assert rows_of(replies.mean_reply_time(rows)) == [("a", 16.0, 2), ("b", 30.0, 1)]
    assert [(r.id, r.position) for r in replies.around(rows, 3, 5).orderBy("position").collect()] == [(5, -3), (1, -2), (2, -1), (3, 0)]
    hits = rows.where("id in (2)").select(F.col("id").alias("hit_id"))
    assert rows_of(replies.around_many(rows, hits, 1)) == [(2, 1, -1), (2, 3, 1)]
    assert rows_of(replies.with_reply_preview(rows).select("id", "reply_to_name"))[4] == (5, None)
    assert [r.user_id for r in replies.partners(rows, "a", sent=True).collect()] == ["b"]


def test_leaderboard_roles_and_silent_members(spark, chat):
    people = spark.createDataFrame([("a", "Ann", "A", 1, 1, 0), ("z", " ", None, 0, 0, 1), ("y", "Yo", "Lo", 0, 1, 0)], "user_id string, first_name string, last_name string, is_creator int, is_admin int, is_bot int")
    got = A.leaderboard(chat({"id": 1, "from_id": "a", "from_name": "Ann"}, {"id": 2, "from_id": "b"}), people).collect()
    assert [(r.from_id, r.name, r.role, r["rank"]) for r in sorted(got, key=lambda r: (-r.message_count, r.from_id))] == [("a", "Ann", "creator", 1), ("b", "Unknown", None, 2), ("y", "Yo Lo", "admin", None), ("z", "Unknown", "bot", None)]


def test_dense_counts_on_an_empty_table(chat):
    assert A.by_hour(chat(), dense=True).count() == 24 and A.heatmap(chat()).agg(F.sum("count")).first()[0] == 0


def test_text_expressions(spark):
    df = spark.createDataFrame([("  שלום wörld_1, It's Naïve-x 🚲ab ",), ("ab",), ("",), (None,)], "t string")
    got = df.select(text.script_words(F.col("t")).alias("s"), text.unicode_words(F.col("t")).alias("u"), text.trigrams(F.col("t")).alias("g"), text.split_words(F.col("t")).alias("w")).collect()
    assert got[0].s == ["שלום", "w", "rld", "it", "s", "na", "ve", "x", "ab"] and got[0].u[:2] == ["שלום", "wörld_1"]
    plain = "שלום wörld_1, it's naïve-x 🚲ab"
    assert set(got[0].g) == {plain[i : i + 3] for i in range(len(plain) - 2)}
    assert got[1].g == ["ab"] and got[2].g == [] and got[0].w[-1] == "🚲ab"
    links = spark.createDataFrame([("https://www.A.b:80?q",), ("http://x.y/z",), ("ftp://x",)], "t string").select(text.domain(F.col("t")).alias("d"))
    assert [r.d for r in links.collect()] == ["A.b:80?q", "x.y", ""]
    marked = df.limit(1).select(text.highlight(F.col("t"), '"naïve" OR wörld_1').alias("h")).first()["h"]
    assert "<b>wörld_1</b>" in marked and "<b>Naïve</b>" in marked
