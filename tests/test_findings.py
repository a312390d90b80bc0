"""Queries against their SQL on made-up tables: what the given tables don't hold."""

import duckdb
import pytest
from test_oracles import rows

from courtflow.plans import registry


def both(spark, folder, name, **tables):
    """A query's rows and its SQL's, over tables given as SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return rows(registry.QUERIES[name](spark, str(folder)).toPandas()), rows(con.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("at", ["-0.3", "-0.052", "0.2", "0.9"])
def test_pose_box_beyond_an_edge(spark, tmp_path, at):
    vectors = f"select i as vec_id, 0 as label, list_transform(range(64), lambda j: CAST(CASE WHEN j % 3 = 2 THEN 0.2 ELSE {at} + j * 0.0001 * i END AS FLOAT)) as embedding from range(5) t(i)"
    got, want = both(spark, tmp_path, "arr08_pose_box", embeddings=vectors)
    assert got == want and len(got[1]) == 5


def test_eligibility_where_rows_differ_in_mode(spark, tmp_path):
    """Rally 100 is that of the users 100 and 1000 to 1009, whose modes differ."""
    events = "select i as event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) HOUR as ts, CASE WHEN i % 11 = 10 THEN 100 ELSE 1009 - i % 11 END as user_id, 'view' as event_type, CAST(i AS DOUBLE) as value, '{\"k\": 5}' as props from range(200) t(i)"
    got, want = both(spark, tmp_path, "elg01_eligibility", events=events)
    assert got == want and len(got[1]) == 1


#: Tracks that come back to one point at every other frame, so that many turns are of 180 degrees or a hair less.
THERE_AND_BACK = """select u * 40 + f as event_id, TIMESTAMP '2024-01-01' + INTERVAL (f * 8) HOUR as ts, u as user_id, 'view' as event_type,
  CAST(hash(u * 41 + CASE WHEN f % 2 = 0 THEN 0 ELSE f END) % 100000 AS DOUBLE) / 100 as value, '{"k": ' || CAST(hash(u * 43 + CASE WHEN f % 2 = 0 THEN 0 ELSE f END) % 100 AS VARCHAR) || '}' as props from range(100) t(u), range(40) s(f)"""


@pytest.mark.parametrize("name", ["win17_reversals", "win18_merged_turns", "joi03_nearest_player", "evt1_reversal_events"])
def test_turns_of_equal_angles(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, events=THERE_AND_BACK)
    assert got == want and len(got[1]) > 500


@pytest.mark.parametrize("name", ["win17_reversals", "win18_merged_turns", "joi03_nearest_player", "evt1_reversal_events"])
def test_turns_whose_cosines_differ_in_the_last_bit(spark, tmp_path, name):
    """The C library gives both turns one angle, so that the first stays; the JVM's acos gives two."""
    points = "(0, 124.74, 71), (1, 24.55, 71), (2, 48.69, 52), (3, 34.13, 52), (4, 41.14, 92)"
    events = f"""SELECT u * 10 + f AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (f * 8) HOUR AS ts, u AS user_id, 'view' AS event_type, CAST(x AS DOUBLE) AS value, '{{"k": ' || CAST(y AS VARCHAR) || '}}' AS props
  FROM (VALUES {points}) t(f, x, y), range(3) s(u)"""
    got, want = both(spark, tmp_path, name, events=events)
    assert got == want and len(got[1]) == (6 if name == "win17_reversals" else 3)


@pytest.mark.parametrize("name", ["agg01_movement_summary", "agg03_player_report", "agg06_match_rollup", "agg07_match_shuttle", "agg34_strided_stats", "agg35_rally_stats", "sup57_running_distance", "sup64_match_totals", "win28_speed_extremes"])
def test_rows_of_one_frame_go_by_place(spark, name):
    """At sf0.1 users share rally ids, so a frame may have two rows of a player, whose order the SQL leaves open; here it is completed by place."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    sql = registry.ORACLE_SQL[name].replace("ORDER BY frame_id", "ORDER BY frame_id, court_x, court_y").replace("(speed, frame_id)", "(speed, (frame_id, court_x, court_y))")
    assert sql != registry.ORACLE_SQL[name]
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.sql(sql).df())


def events(value, users=60, user="CAST(hash(i * 7) % {users} AS BIGINT)", ts="TIMESTAMP '2024-01-01' + INTERVAL (CAST(hash(i) % 2592000 AS BIGINT)) SECOND", n=4000):
    """Events of fewer than 1,000 users, so that no two share a rally and the SQL leaves no order open."""
    return f"""SELECT i AS event_id, {ts} AS ts, {user.format(users=users)} AS user_id, ['view', 'click', 'purchase', 'signup', 'error'][CAST(1 + hash(i * 11) % 5 AS BIGINT)] AS event_type,
  {value} AS value, '{{"k": ' || CAST(hash(i * 17) % 100 AS VARCHAR) || '}}' AS props FROM range({n}) t(i)"""


VALUE = "CAST(hash(i * 13) % 100000 AS DOUBLE) / 100"


@pytest.mark.parametrize("off", ["NULL", "-1"])
def test_report_of_a_player_never_on_the_own_half(spark, tmp_path, off):
    got, want = both(spark, tmp_path, "agg03_player_report", events=events(f"CASE WHEN hash(i * 7) % 60 < 20 THEN {off} ELSE {VALUE} END"))
    assert got == want and len(got[1]) > 90


@pytest.mark.parametrize("name", ["agg01_movement_summary", "agg03_player_report", "agg06_match_rollup", "agg07_match_shuttle", "agg34_strided_stats", "geo13_hull_area", "sup64_match_totals"])
def test_rows_without_a_user(spark, tmp_path, name):
    """Their rally is null: the match's roll-up counts it as one."""
    got, want = both(spark, tmp_path, name, events=events(VALUE, user="CASE WHEN i % 30 > 0 THEN CAST(hash(i * 7) % {users} AS BIGINT) END"))
    assert got == want and len(got[1]) > 1


@pytest.mark.parametrize("name", ["agg01_movement_summary", "agg03_player_report", "agg06_match_rollup", "agg07_match_shuttle", "agg34_strided_stats", "agg35_rally_stats", "sup57_running_distance", "sup64_match_totals", "win28_speed_extremes"])
def test_rows_without_a_time(spark, tmp_path, name):
    """Their frame is null: they come last, as the SQL orders them."""
    got, want = both(spark, tmp_path, name, events=events(VALUE, ts="CASE WHEN i % 30 > 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (CAST(hash(i) % 2592000 AS BIGINT)) SECOND END"))
    assert got == want and len(got[1]) > 1


@pytest.mark.parametrize("name", ["agg07_match_shuttle", "sup64_match_totals"])
def test_times_within_a_second(spark, tmp_path, name):
    """Half a second before a frame begins, after 2024 and before it, is in the frame before."""
    half = "TIMESTAMP '2024-01-01' + INTERVAL (CAST(hash(i) % 90 AS INT) * 8 - 360) HOUR - INTERVAL 500 MILLISECOND"
    got, want = both(spark, tmp_path, name, events=events(VALUE, ts=half))
    assert got == want and len(got[1]) > 1


@pytest.mark.parametrize("name", ["agg07_match_shuttle", "sup64_match_totals"])
def test_events_without_an_id(spark, tmp_path, name):
    """They come after the others of their frame; no frame has two of them, whose order the SQL would leave open."""
    first = "row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 28800) ORDER BY event_id) = 1"
    got, want = both(spark, tmp_path, name, events=f"SELECT * REPLACE (CASE WHEN NOT {first} THEN event_id END AS event_id) FROM ({events(VALUE)})")
    assert got == want and len(got[1]) > 1
