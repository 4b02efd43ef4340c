"""Schemas of the tables, and the fixed codes of the protocol being analysed."""

from pyspark.sql import types as T

#: Unsigned 64-bit numbers keep their full range.
U64 = T.DecimalType(20, 0)

APPLICATION, NOOP, CONFIGURATION = 0, 1, 2
PUT, DELETE = 1, 2
REQUEST_PUT, REQUEST_GET, REQUEST_DELETE = 1, 2, 3
STATUS = {1: "OK", 2: "NOT_FOUND", 3: "NOT_LEADER", 4: "TIMEOUT", 5: "INTERNAL", 6: "BAD_REQUEST", 7: "STALE", 8: "CONFLICT", 9: "BUSY"}
STABLE, JOINT = 1, 2
NEW, DUPLICATE, STALE, CONFLICT = "NEW", "DUPLICATE", "STALE", "CONFLICT"

#: Codes of the administration calls.
ADMIN_OPERATIONS = {1: "STATUS", 2: "SNAPSHOT", 3: "TRANSFER_LEADERSHIP", 4: "ADD_VOTER", 5: "REMOVE_VOTER"}
ADMIN_STATUS = {
    1: "OK",
    2: "NOT_LEADER",
    3: "BAD_REQUEST",
    4: "INTERNAL",
    5: "MEMBERSHIP_CHANGE_IN_PROGRESS",
    6: "LEADERSHIP_TRANSFER_IN_PROGRESS",
    7: "NOT_A_VOTER",
    8: "INVALID_CONFIGURATION",
    9: "TIMEOUT",
    10: "CANNOT_TRANSFER_TO_SELF",
    11: "TRANSFER_REJECTED",
}

#: Label vocabularies of the metrics.
OPERATIONS = ("get", "put", "delete")
STATUSES = ("ok", "not_found", "busy", "timeout", "not_leader", "bad_request", "internal")
RPCS = ("append_entries", "request_vote", "pre_vote", "install_snapshot", "timeout_now")
DOMAINS = ("log", "stable", "commit", "snapshot")
#: Histogram bounds, in seconds.
BOUNDS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)

#: Limits of the formats.
MAX_KEY, MAX_VALUE, MAX_COMMAND = 64 * 1024, 200 * 1024, 256 * 1024
MAX_VOTERS, MAX_ADDRESS, MAX_HINT = 31, 256, 256
MAX_ENTRIES, MAX_BYTES = 64, 512 * 1024
MAX_CHUNK = 256 * 1024
MAX_QUEUED, MAX_QUEUED_BYTES = 4096, 32 << 20
ENTRY_HEADER = 13


VOTER = "struct<node_id:decimal(20,0),addr:string>"
LOG = "log_index decimal(20,0), term decimal(20,0), kind tinyint, command binary"
COMMANDS = "log_index decimal(20,0), term decimal(20,0), kind tinyint, op tinyint, client_id binary, seq decimal(20,0), key binary, value binary"
KV = "key binary, value binary"
CLIENTS = "client_id binary, last_seq decimal(20,0), last_fingerprint binary, last_result tinyint"
SNAPSHOT = f"last_included_index decimal(20,0), last_included_term decimal(20,0), data binary, configuration array<{VOTER}>, configuration_present boolean"
MEMBERSHIP = f"mode tinyint, stable array<{VOTER}>, old_voters array<{VOTER}>, new_voters array<{VOTER}>"
ACKS = "key string, value string, phase string"
NODE_STATUS = (
    "reachable boolean, node bigint, role string, term bigint, leader bigint, last_log_index bigint, commit_index bigint, last_applied bigint, "
    "apply_lag bigint, snapshot_index bigint, snapshot_term bigint, membership string, voters array<bigint>"
)
TIMELINE = (
    "event string, at_seconds double, node bigint, leader bigint, term bigint, signal string, workers bigint, put_percent bigint, get_percent bigint, "
    "same_data_directory boolean, data_directory string, count bigint"
)
WORKLOAD = (
    "acknowledged_before bigint, acknowledged_after bigint, ambiguous_write_outcomes bigint, retired_sessions bigint, transient_read_failures bigint, "
    "stale_requests bigint, request_conflicts bigint, unexpected_protocol_errors bigint, unexpected_message string"
)
ACK_SUMMARY = "total_acknowledged bigint, verified_acknowledged bigint, verification_missing bigint"
MANIFEST = (
    "schema_version int, capture_tool_version string, scenario string, platform string, "
    "cluster struct<nodes:int,transport:string,persistence:string>, workload struct<workers:int,put_percent:int,get_percent:int>, "
    "failure struct<method:string,leader_id:bigint>, recovery struct<replacement_leader_id:bigint,restarted_node_id:bigint,same_data_directory:boolean>, "
    "result struct<acknowledged_writes:bigint,acknowledged_before_crash:bigint,acknowledged_after_failover:bigint,verified_acknowledged_writes:bigint,"
    "ambiguous_write_outcomes:bigint,retired_sessions:bigint,transient_read_failures:bigint,stale_request_errors:bigint,request_conflicts:bigint,"
    "unexpected_protocol_errors:bigint,status:string>"
)
EVENT_LOG = (
    "time timestamp, level string, msg string, node_id bigint, event string, term bigint, role string, listen string, peer_count bigint, "
    "last_log_index bigint, commit_index bigint, last_applied bigint, snapshot_index bigint, snapshot_term bigint"
)
