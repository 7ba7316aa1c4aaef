from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from fleetlens.operators import integrity, joins

LOCK_DDL = ("pid int, locktype string, database long, relation long, page int, tuple int, virtualxid string, "
            "transactionid string, classid long, objid long, objsubid int, mode string, granted boolean")


def lock(pid, granted, relation=None, locktype="relation"):
    return (pid, locktype, None, relation, None, None, None, None, None, None, None, "m", granted)


def brute_force(locks, sessions):
    """Pairs of a waiting request and a request of another session on the same lock."""
    out = {}
    for w in locks:
        for b in locks:
            if not w[12] and w[1:11] == b[1:11] and w[0] != b[0] and w[0] in sessions and b[0] in sessions:
                out[(w[0], b[0])] = out.get((w[0], b[0]), 0) + 1
    return out


def test_blocking_pairs_match_brute_force(spark):
    rng = random.Random(3)
    locks = [lock(rng.randrange(20), rng.random() < 0.6, rng.choice([None, 1, 2, 3])) for _ in range(80)]
    sessions = {pid: f"u{pid}" for pid in range(18)}
    facts = spark.createDataFrame([(p, u, f"q{p}") for p, u in sessions.items()], "pid int, usename string, query string")
    contention = joins.lock_contention(spark.createDataFrame(locks, LOCK_DDL), facts).cache()
    expected = brute_force(locks, sessions)
    pairs = joins.blocking_pairs(contention, list(range(20)))
    got = {}
    for r in pairs.collect():
        key = (r.blocked_pid, r.blocking_pid)
        got[key] = got.get(key, 0) + r.pairs
        assert r.blocked_user == sessions[r.blocked_pid] and r.blocking_statement == f"q{r.blocking_pid}"
    assert got == expected
    # The linear form counts the same pairs from either side.
    for role in ("blocked", "blocking"):
        total = contention.filter(F.col("role") == role).agg(F.sum(F.col("requests") * F.col("partners"))).head()[0]
        assert total == sum(expected.values())


def test_no_contention_with_oneself(spark):
    facts = spark.createDataFrame([(1, "u", "q")], "pid int, usename string, query string")
    locks = spark.createDataFrame([lock(1, False), lock(1, True)], LOCK_DDL)
    assert joins.lock_contention(locks, facts).count() == 0


def test_foreign_keys_let_null_pass_and_compare_all_columns(spark, rows):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (2, None), (9, "a"), (9, "a")], "x int, y string")
    parent = spark.createDataFrame([(1, "a")], "px int, py string")
    assert rows(integrity.fk_check(child, parent, ["x", "y"], ["px", "py"])) == [(1, "b", 1), (9, "a", 2)]
    assert rows(integrity.fk_violations(child, parent, ["x", "y"], ["px", "py"])) == [(1, "b"), (9, "a"), (9, "a")]


def test_replica_lag_without_primary_or_optime(spark, rows):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    members = spark.createDataFrame([
        ("a", "p", "PRIMARY", at(30)), ("a", "s1", "SECONDARY", at(28)), ("a", "s2", "SECONDARY", None), ("a", "x", "ARBITER", at(1)),
        ("b", "s3", "SECONDARY", at(1))], "set string, name string, stateStr string, optimeDate timestamp")
    assert rows(joins.replica_lag(members)) == [("a", "s1", 2.0)]


def test_index_usage_states(spark, rows):
    indexes = spark.createDataFrame([("c", "_id_"), ("c", "used"), ("c", "idle"), ("c", "unknown")], "collection string, name string")
    usage = spark.createDataFrame([("c", "_id_", 0, "t"), ("c", "used", 5, "t"), ("c", "idle", 0, "t")],
                                  "collection string, name string, ops long, since string")
    got = joins.index_usage_join(indexes, usage)
    assert rows(got, "name", "stats_available", "accesses", "unused") == [
        ("_id_", True, 0, False), ("idle", True, 0, True), ("unknown", False, None, False), ("used", True, 5, False)]


def test_online_rebuild_looks_only_at_own_columns(spark, rows):
    indexes = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "object_id int, index_id int")
    index_columns = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 10)], "object_id int, index_id int, column_id int")
    columns = spark.createDataFrame([(1, 10, 35), (1, 11, 56), (2, 10, 56)], "object_id int, column_id int, system_type_id int")
    assert rows(joins.can_rebuild_online(indexes, index_columns, columns)) == [(1, 1, False), (1, 2, True), (2, 1, True)]


def test_hidden_objects_only_on_request(spark):
    stats = spark.createDataFrame([(".kibana", 5), ("logs", 9)], "name string, store_size_bytes long")
    none = spark.createDataFrame([], "name string, status string")
    maps = spark.createDataFrame([], "name string, mapping string")
    health = spark.createDataFrame([("logs", "green")], "name string, health string")
    merged = joins.merge_object_facts(stats, none, maps, health, {"status": "open", "health": "Unknown"})
    assert [(r.name, r.status, r.health) for r in merged.collect()] == [("logs", "open", "green")]
    everything = joins.merge_object_facts(stats, none, maps, health, {"status": "open", "health": "Unknown"}, include_hidden=True)
    assert [(r.name, r.health) for r in everything.collect()] == [("logs", "green"), (".kibana", "Unknown")]
