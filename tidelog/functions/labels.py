"""Code and name mappings: CASE expressions over the fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DOMAINS, OPERATIONS, RPCS, STATUS, STATUSES


def _case(code: Column, names: dict[int, str], other: str | None = None) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise(F.lit(other))


def kind_name(kind: Column) -> Column:
    return _case(kind, {0: "application", 1: "noop", 2: "configuration"})


def op_name(op: Column) -> Column:
    return _case(op, {1: "PUT", 2: "DELETE"})


def mode_name(mode: Column) -> Column:
    return _case(mode, {1: "stable", 2: "joint"})


def role_name(role: Column) -> Column:
    """Unknown roles are followers."""
    return _case(role, {0: "follower", 1: "candidate", 2: "leader"}, "follower")


def status_name(status: Column) -> Column:
    return _case(status, STATUS)


def metric_operation(operation: Column) -> Column:
    """The metrics' label of a request code; null for an unknown one, which isn't counted."""
    return _case(operation, {1: "put", 2: "get", 3: "delete"})


def metric_status(status: Column) -> Column:
    """The metrics' label of a response code: stale and conflicting requests count as internal, too."""
    return _case(status, {1: "ok", 2: "not_found", 3: "not_leader", 4: "timeout", 6: "bad_request", 9: "busy"}, "internal")


def known_operation(label: Column) -> Column:
    return F.when(label.isin(*OPERATIONS), label)


def known_status(label: Column) -> Column:
    return F.when(label.isin(*STATUSES), label).otherwise("internal")


def outcome_status(outcome: Column) -> Column:
    """The response code of an apply outcome: new and duplicate requests are answered alike."""
    return F.when(outcome.isin("NEW", "DUPLICATE"), 1).when(outcome == "STALE", 7).when(outcome == "CONFLICT", 8)


def read_failure_status(error: Column) -> Column:
    return F.when(error.isin("not_leader", "lost_leadership"), "NOT_LEADER").when(error.isin("timeout", "deadline", "canceled"), "TIMEOUT").otherwise("INTERNAL")


def client_outcome(error: Column) -> Column:
    """How a load generator counts a failed call: ambiguous writes may have happened, transport failures are retried."""
    return (
        F.when(error.isNull(), "ok")
        .when(error.isin("ambiguous", "timeout", "deadline"), "ambiguous")
        .when(error.isin("not_found", "not_leader", "busy", "no_leader"), "expected_read")
        .when(error.isin("connection_refused", "connection_reset", "eof"), "transport")
        .otherwise("unexpected")
    )


def message(status: Column, key: Column) -> Column:
    """A sentence for people."""
    return (
        F.when(status == "OK", "ok")
        .when(status == "NOT_FOUND", F.format_string("key %s not found", key))
        .when(status == "NOT_LEADER", "this node is not the leader")
        .when(status == "TIMEOUT", "timed out; a write may or may not have happened")
        .when(status == "BUSY", "the node is overloaded, try again")
        .when(status == "STALE", "the request is older than one already handled")
        .when(status == "CONFLICT", "the request number was used for another operation")
        .when(status == "BAD_REQUEST", "the request is malformed")
        .otherwise("internal error")
    )


def known_rpc(label: Column) -> Column:
    """Unknown calls aren't counted."""
    return F.when(label.isin(*RPCS), label)


def known_domain(label: Column) -> Column:
    return F.when(label.isin(*DOMAINS), label)


def metric_role(role: Column) -> Column:
    return role_name(role)


def client_error(status: Column) -> Column:
    """The error that a client raises for a response status; null for OK and NOT_FOUND, which are results."""
    named = F.when(status.isin("TIMEOUT", "BUSY", "BAD_REQUEST", "CONFLICT", "STALE"), F.lower(status)).otherwise("internal")
    return F.when(~status.isin("OK", "NOT_FOUND"), named)


def admin_status(error: Column) -> Column:
    """The administration status of an error's name; no error is OK."""
    return (
        F.when(error.isNull(), "OK")
        .when(error == "membership_change_in_progress", "MEMBERSHIP_CHANGE_IN_PROGRESS")
        .when(error == "leadership_transfer_in_progress", "LEADERSHIP_TRANSFER_IN_PROGRESS")
        .when(error == "not_a_voter", "NOT_A_VOTER")
        .when(error == "invalid_configuration", "INVALID_CONFIGURATION")
        .when(error == "cannot_transfer_to_self", "CANNOT_TRANSFER_TO_SELF")
        .when(error == "transfer_rejected", "TRANSFER_REJECTED")
        .when(error == "unknown_target_address", "BAD_REQUEST")
        .when(error == "not_leader", "NOT_LEADER")
        .when(error.isin("deadline", "canceled", "closed"), "TIMEOUT")
        .otherwise("INTERNAL")
    )


def admin_message(status: Column, hint: Column) -> Column:
    """A sentence for people about an administration status."""
    return (
        F.when(status == "OK", "done")
        .when((status == "NOT_LEADER") & (F.coalesce(F.length(hint), F.lit(0)) > 0), F.concat(F.lit("this node is not the leader; try "), hint))
        .when(status == "NOT_LEADER", "this node is not the leader, and knows of none")
        .when(status == "BAD_REQUEST", "the request is invalid")
        .when(status == "MEMBERSHIP_CHANGE_IN_PROGRESS", "another membership change is under way; look at the status first")
        .when(status == "LEADERSHIP_TRANSFER_IN_PROGRESS", "a leadership transfer is under way; look at the status first")
        .when(status == "NOT_A_VOTER", "no voter has that id")
        .when(status == "INVALID_CONFIGURATION", "the change would leave an invalid configuration")
        .when(status == "TIMEOUT", "timed out; it may or may not have happened, so look at the status first")
        .when(status == "CANNOT_TRANSFER_TO_SELF", "leadership can't be transferred to the leader itself")
        .when(status == "TRANSFER_REJECTED", "the target declined")
        .otherwise("internal error")
    )


def event_sentence(event: Column, node: Column, term: Column, count: Column) -> Column:
    """A sentence about a timeline event."""
    s = lambda c: c.cast("string")
    return (
        F.when(event == "cluster_ready", F.concat(F.lit("node "), s(node), F.lit(" leads in term "), s(term)))
        .when(event == "load_started", "clients begin to write and read")
        .when(event == "leader_crashed", F.concat(F.lit("node "), s(node), F.lit(", the leader, is killed")))
        .when(event == "replacement_leader", F.concat(F.lit("node "), s(node), F.lit(" leads in term "), s(term)))
        .when(event == "post_failover_progress", "the remaining majority commits writes")
        .when(event == "old_leader_restarted", F.concat(F.lit("node "), s(node), F.lit(" restarts from its data")))
        .when(event == "old_leader_caught_up", F.concat(F.lit("node "), s(node), F.lit(" has caught up")))
        .when(event == "acknowledged_writes_verified", F.concat(F.format_number(count, 0), F.lit(" acknowledged writes are still there")))
        .otherwise("a recorded event")
    )


def voter_list(config: Column) -> Column:
    """array<struct(id, addr)> of a map of voters, by number: the order of the wire form is free, so it is sorted."""
    return F.array_sort(F.transform(F.map_entries(config), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("addr"))))
