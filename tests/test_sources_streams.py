"""Readers, writers and streams."""

from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from rankflow.operators import team
from rankflow.sources import readers, sinks
from rankflow.streaming import streams

T0 = dt.datetime(2026, 1, 1)


def player(p, result):
    return {"profile_id": p, "result": result, "civilization": "c", "civilization_randomized": False}


def test_gzipped_dump_mode_season_and_seasons_once(spark, tmp_path):
    record = lambda g: {"game_id": g, "started_at": "2026-01-01T05:30:00+02:00", "kind": "rm_2v2", "teams": [[player(1, "win"), player(2, "win")], [player(3, "loss"), player(4, "noresult")]]}
    for name, g in (("rm_2v2_s11.json.gz", 1), ("rm_2v2_s12.json.gz", 2)):
        (tmp_path / name).write_bytes(gzip.compress(json.dumps([record(g)]).encode()))
    dump = readers.read_dump(spark, str(tmp_path))
    assert {(r["game_id"], r["season"], r["mode"]) for r in dump.collect()} == {(1, 11, "rm_2v2"), (2, 12, "rm_2v2")}
    games, players = readers.teams_of(dump, 2)
    assert {str(r["started_at"]) for r in games.collect()} == {"2026-01-01 03:30:00"}  # UTC, without zone
    assert sorted((r["profile_id"], r["result"]) for r in players.filter("game_id = 1").collect()) == [(1, True), (2, True), (3, False), (4, None)]
    out = str(tmp_path / "games")
    sinks.append_new(games.filter("season = 11"), out, ["game_id"], "season")
    late = sinks.missing_seasons(games, spark.read.parquet(out))
    assert [r["season"] for r in late.collect()] == [12]
    sinks.overwrite_seasons(games.filter("season = 12"), out)
    sinks.overwrite_seasons(games.filter("season = 12"), out)
    assert sinks.row_count(spark, out) == 2


def test_files_by_name_and_events_in_order(spark, tmp_path):
    lines = ['{"player_slot": 1, "time_s": 9.5, "command_index": 2}', '{"player_slot": 2}']
    for name in ("12.jsonl", "x.jsonl", "3.txt"):
        (tmp_path / name).write_text("\n".join(lines))
    assert [(r["id"], r["path"].rpartition("/")[2]) for r in readers.list_files(spark, str(tmp_path)).collect()] == [(12, "12.jsonl")]
    events = readers.read_events(spark, str(tmp_path / "12.jsonl")).orderBy("replay_id", "time_s", "command_index").collect()
    assert [(r["replay_id"], r["time_s"], r["command_index"]) for r in events] == [(12, 0.0, 0), (12, 9.5, 2)]


def test_chunks_merge_by_name(spark, tmp_path):
    out = str(tmp_path / "chunks")
    sinks.write_chunk(spark.createDataFrame([(1, "a")], "k int, v string"), out)
    sinks.write_chunk(spark.createDataFrame([(2, 0.5)], "k int, w double"), out)
    assert {tuple(r) for r in readers.read_chunks(spark, out).select("k", "v", "w").collect()} == {(1, "a", None), (2, None, 0.5)}
    sinks.write_chunk(spark.range(2), str(tmp_path / "csv"), csv=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_parquet_or_else_csv(spark, tmp_path):
    assert sinks.write_table(spark.range(3), str(tmp_path / "a")) == str(tmp_path / "a")
    odd = spark.sql("SELECT 1 AS k, INTERVAL 3 MONTHS + INTERVAL 0 MONTHS AS y, make_interval(0, 1, 0, 2) AS i, array(1, 2) AS l")
    path = sinks.write_table(odd, str(tmp_path / "b"))
    assert path.endswith("b.csv") and spark.read.option("header", True).csv(path).first()["l"] == "[1,2]"


def test_absent_warehouse_and_reports(spark, tmp_path):
    absent = readers.table_or_empty(spark, str(tmp_path / "none"), "a int, b string")
    assert absent.count() == 0 and absent.columns == ["a", "b"]
    df = spark.createDataFrame([(1, 0.25, None)], "n int, p double, s string")
    assert sinks.markdown(df) == "| n | p | s |\n| --- | --- | --- |\n| 1 | 0.2500 |  |"
    sinks.write_report(df, str(tmp_path / "r"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first()["p"] == "0.25"
    sinks.write_report(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["n"] == 1


def test_patches_from_a_file_or_from_games(spark, tmp_path):
    (tmp_path / "p.csv").write_text("patch,patch_start_at,season\n10,2026-02-01,11\n")
    assert readers.read_patches(spark, str(tmp_path / "p.csv")).first()["patch"] in ("10", 10)
    games = spark.createDataFrame([("9", T0, 1), ("9", T0 + dt.timedelta(days=2), 2), (None, T0, 1)], "patch string, started_at timestamp_ntz, season int")
    assert [tuple(r) for r in readers.read_patches(spark, None, games).collect()] == [("9", T0.date(), 2)]


def test_tech_tree_flags(spark):
    items = '[{"pbgid": 1, "age": 2, "classes": ["Landmark", "building", "age_up"], "costs": {"food": 400, "gold": 200}}, {"pbgid": 2, "age": 1, "classes": ["worker"], "costs": {"food": 50}}, {"pbgid": 1, "age": 2}]'
    schema = "array<struct<pbgid:long,age:int,classes:array<string>,costs:struct<food:double,wood:double,gold:double,stone:double,vizier:double,olive_oil:double>>>"
    df = spark.createDataFrame([(items,)], "j string").select(F.from_json("j", schema).alias("data"))
    got = {r["pbgid"]: r for r in readers.tech_tree(df).collect()}
    assert set(got) == {1, 2} and got[2]["is_villager"] and got[2]["total_resources"] == 50


# Streams.


def stream_of(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        for part in (tmp_path / f"b{k}").glob("*.parquet"):
            part.rename(folder / f"{k}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def result_of(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


EVENT = "replay_id long, player_slot int, kind string, time_s double, value double, ts timestamp"


def event(slot, kind, seconds, value=1.0):
    return (7, slot, kind, float(seconds), value, T0 + dt.timedelta(seconds=seconds))


def test_cumulative_snapshots_correct_late_events(spark, tmp_path):
    batches = [[event(1, "unit", 10), event(1, "unit", 299, 2.0), event(1, "unit", 700)], [event(1, "unit", 400), event(2, "unit", 0)], [event(1, "unit", 905, None)]]
    rows = result_of(spark, streams.cumulative_snapshots(stream_of(spark, tmp_path, batches, EVENT)), "snaps", "update")
    last = {(r["player_slot"], r["minute"]): (r["events"], r["value"]) for r in rows}  # later rows correct earlier ones
    assert last == {(1, 5): (2, 3.0), (1, 10): (3, 4.0), (1, 15): (4, 5.0), (1, 20): (5, 5.0), (2, 5): (1, 1.0)}
    assert sum(r["player_slot"] == 1 and r["minute"] == 5 for r in rows) == 1


def test_tumbling_counts(spark, tmp_path):
    batches = [[event(1, "unit", 10), event(1, "unit", 20)], [event(1, "unit", 4000)]]
    rows = result_of(spark, streams.snapshot_counts(stream_of(spark, tmp_path, batches, EVENT)), "tumbling", "append")
    assert [(r["player_slot"], r["events"], r["value"]) for r in rows] == [(1, 2, 2.0)]


def test_changed_matches_once(spark, tmp_path):
    schema = "profile_id long, match_id long, started_at timestamp, polled_at timestamp"
    poll = lambda m, k: (1, m, T0, T0 + dt.timedelta(seconds=30 * k))
    rows = result_of(spark, streams.changed_matches(stream_of(spark, tmp_path, [[poll(5, 0)], [poll(5, 1)], [poll(6, 2), poll(6, 3)]], schema)), "changes", "append")
    assert sorted(r["match_id"] for r in rows) == [5, 6]


def test_requests_over_the_limit(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(seconds=k % 9)) for k in range(5)] + [("b", T0)] + [("z", T0 + dt.timedelta(hours=1))]
    found = result_of(spark, streams.requests_per_minute(stream_of(spark, tmp_path, [rows, [("z", T0 + dt.timedelta(hours=2))]], "client string, ts timestamp"), 4), "limits", "append")
    assert {r["client"] for r in found if r["limited"]} == {"a"} and max(r["n"] for r in found if r["client"] == "a") == 5


def test_values_are_refreshed_and_stale_ones_serve(spark):
    now, loads = [0.0], []

    def load():
        loads.append(now[0])
        if now[0] in (0.0, 50.0):
            return now[0]
        raise OSError("down")

    value = streams.Refreshed(load, 45, lambda: now[0])
    seen = []
    for now[0] in (0.0, 44.0, 50.0, 60.0, 95.0, 96.0):
        seen.append((value.get(), value.stale))
    assert seen == [(0.0, False), (0.0, False), (50.0, False), (50.0, False), (50.0, True), (50.0, True)] and loads == [0.0, 50.0, 95.0, 96.0]
    with pytest.raises(OSError):
        streams.Refreshed(lambda: 1 / 0 if False else (_ for _ in ()).throw(OSError("down")), 1).get()


def test_long_chains_become_one_component(spark):
    edges = [(i, i + 1) for i in range(300)]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "p1 long, p2 long")
    assert {r["component"] for r in team.components(both).collect()} == {0}
