"""Typed errors of the ledger."""

from __future__ import annotations


class LedgerError(Exception):
    """Base of all errors raised by this package; fields are also attributes."""

    text = "ledger error"

    def __init__(self, **fields):
        self.fields = fields
        super().__init__(self.text.format(**fields))
        for name, value in fields.items():
            setattr(self, name, value)


def _error(name: str, text: str) -> type[LedgerError]:
    return type(name, (LedgerError,), {"text": text, "__doc__": text, "__module__": __name__})


InvalidEdgeType = _error("InvalidEdgeType", "edge type {edge_type!r} must match [A-Z0-9]+")
InvalidId = _error("InvalidId", "id {id!r} must not be empty or hold a pipe sign")
InvalidTimestamp = _error("InvalidTimestamp", "timestamp {value!r}: {reason}")
InvalidWeight = _error("InvalidWeight", "weight {weight!r} must be finite and not negative")
InvalidModelName = _error("InvalidModelName", "model name {name!r} must match [a-z][a-z0-9_]* with up to 48 signs")
SingleOpenViolation = _error("SingleOpenViolation", "{source_id} -> {target_id} ({edge_type}) has an open interval already")
OverlappingInterval = _error("OverlappingInterval", "{source_id} -> {target_id} ({edge_type}): interval from {valid_from} overlaps one from {other_from}")
DuplicateAssertion = _error("DuplicateAssertion", "{source_id} -> {target_id} ({edge_type}) from {valid_from} stands twice in one batch")
RecordedAtRegression = _error("RecordedAtRegression", "{id} would be recorded at {got}, not after {had}")
NotFound = _error("NotFound", "{id} is not there")
DimMismatch = _error("DimMismatch", "{got} dimensions, {expected} expected for model {model}")
ModelNotRegistered = _error("ModelNotRegistered", "model {model} is not registered")
SubgraphTooLarge = _error("SubgraphTooLarge", "the subgraph takes {n} bytes, more than {budget}")
NegativeEdgeWeight = _error("NegativeEdgeWeight", "{source_id} -> {target_id} has weight {weight}, with which shortest paths can't be computed")
ReplayCorrupt = _error("ReplayCorrupt", "log row {seq}: {reason}")
PayloadVersion = _error("PayloadVersion", "payload version {got} is newer than {max}")
ReplayNeedsArchive = _error("ReplayNeedsArchive", "the log doesn't reach back to {timestamp}: {hint}")
AttributeModeUnstated = _error("AttributeModeUnstated", "as_of {as_of} is set: say whether attributes are current or of that instant")
ArchiveWindow = _error("ArchiveWindow", "archive window: {reason}")
SnapshotIncompatible = _error("SnapshotIncompatible", "snapshot {path}: {reason}")
CurrentDrift = _error("CurrentDrift", "{n} rows of current belief differ from the assertions")
SchemaVersion = _error("SchemaVersion", "schema version {got}, {expected} expected")
