"""Schemas of landed telemetry, one per source view, as DDL.

Every table also carries ``server_id`` and ``snapshot_ts``.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

FLEET = "server_id string, snapshot_ts timestamp"

# Column names of the source views.
VIEWS = {
    "sessions": "pid int, usename string, application_name string, client_addr string, backend_start timestamp, "
                "state string, query_start timestamp, query string",
    "locks": "pid int, locktype string, database long, relation long, page int, tuple int, virtualxid string, "
             "transactionid string, classid long, objid long, objsubid int, mode string, granted boolean",
    "tables": "relid long, schemaname string, tablename string, total_bytes long, table_bytes long, seq_scan long, "
              "seq_tup_read long, n_tup_ins long, n_tup_upd long, n_tup_del long, n_live_tup long, n_dead_tup long, "
              "n_mod_since_analyze long, last_vacuum timestamp, last_autovacuum timestamp, last_analyze timestamp, "
              "last_autoanalyze timestamp",
    "index_stats": "schemaname string, tablename string, indexname string, idx_scan long, idx_tup_read long, "
                   "idx_tup_fetch long, index_bytes long",
    "statements": "query string, calls long, total_time double, mean_time double, rows long, shared_blks_hit long, "
                  "shared_blks_read long",
    "database_stats": "datname string, blks_hit long, blks_read long, numbackends int, datconnlimit int, "
                      "size_bytes long, datistemplate boolean",
    "replication_senders": "client_addr string, client_hostname string, client_port int, state string, "
                           "sent_location string, write_location string, flush_location string, "
                           "replay_location string, write_lag double, flush_lag double, replay_lag double",
    "checkpoints": "checkpoints_timed long, checkpoints_req long, checkpoint_write_time double, "
                   "checkpoint_sync_time double, buffers_checkpoint long, buffers_clean long, maxwritten_clean long, "
                   "buffers_backend long, buffers_backend_fsync long, buffers_alloc long, stats_reset timestamp",
    "replica_status": "channel_name string, slave_io_state string, slave_io_running string, slave_sql_running string, "
                      "seconds_behind_master long, last_io_errno int, last_io_error string, last_sql_errno int, "
                      "last_sql_error string, master_host string, master_port int, master_user string, "
                      "master_ssl_allowed string",
    "settings": "name string, value string",
    "replica_channels": "channel_name string, host string, port int, user string, service_state string, "
                        "thread_id long, last_error_number int, last_error_message string, last_error_timestamp timestamp",
    "index_physical": "object_id long, index_id int, avg_fragmentation_in_percent double, page_count long",
    "maintenance_log": "log_id long, execution_date timestamp, schema_name string, table_name string, "
                       "index_name string, operation string, fragmentation_before double, fragmentation_after double, "
                       "page_count long, duration_seconds int, error_message string",
    "collections": "db string, name string, count long, size long, storageSize long, avgObjSize double, "
                   "indexSizes map<string,long>, totalIndexSize long",
    "operations": "opid long, op string, ns string, secs_running long, client string, command string, active boolean",
    "profile": "ts timestamp, millis long, op string, ns string, command string, docsExamined long, nreturned long",
    "replica_members": "set string, name string, stateStr string, optimeDate timestamp, lastHeartbeat timestamp, pingMs long",
    "chunks": "ns string, shard string",
    "cache_info": "used_memory long, maxmemory long, mem_fragmentation_ratio double, keyspace_hits long, "
                  "keyspace_misses long, evicted_keys long, rejected_connections long, connected_clients long, "
                  "keyspace map<string,string>",
    "slow_log": "id long, start_time long, duration long, command array<string>, client_address string, client_name string",
    "keys": "key string, type string, bytes long",
    "search_cluster": "cluster_name string, status string, number_of_nodes int, active_shards int, "
                      "unassigned_shards int, total_docs long, store_size long",
    "search_indices": "name string, health string, status string, shards int, replicas int, docs_count long, "
                      "docs_deleted long, store_size_bytes long",
    "hosts": "peer string, data_center string, rack string, version string, tokens array<string>",
    "keyspaces": "name string, strategy_class string",
    "tables_inventory": "database string, name string, engine string, total_rows long, total_bytes long",
    "disks": "name string, path string, free_space long, total_space long",
    "hourly_points": "resource string, metric string, ts timestamp, average double, unit string",
    "series_points": "measurement string, tags map<string,string>, ts timestamp, value double",
}


def schema_of(view: str) -> StructType:
    return StructType.fromDDL(f"{FLEET}, {VIEWS[view]}")
