"""Schemas and value objects of the ledger."""

from __future__ import annotations

from dataclasses import dataclass, field

SCHEMA_VERSION = 1
#: Newest payload version that the fold reads; a payload without one is version 1.
PAYLOAD_VERSION = 2
CONCEPT_PAYLOAD_VERSION = 2
LINK_PAYLOAD_VERSION = 1

#: End of an interval that is still open.
OPEN = "9999-12-31T23:59:59.999999Z"

CONCEPT = "id string, title string, content string, embedding_model string, valid_from timestamp, valid_to timestamp, retired boolean, recorded_at timestamp"
LINK = "source_id string, target_id string, edge_type string, valid_from timestamp, valid_to timestamp, weight double, properties string, recorded_at timestamp"
LOG = "seq_id bigint, table_name string, entity_id string, operation string, payload string, recorded_at timestamp"
EMBEDDING = "model string, concept_id string, embedding array<float>"
ANNOTATION = "concept_id string, label string, value string, computed_at timestamp"

CONCEPT_PAYLOAD = "v int, title string, content string, embedding_model string, valid_from string, valid_to string, retired boolean"
LINK_PAYLOAD = "v int, source_id string, target_id string, edge_type string, valid_from string, valid_to string, weight double, properties string"

#: What names an edge belief; newer assertions with the same values supersede it.
BELIEF_KEY = ("source_id", "target_id", "edge_type", "valid_from")


@dataclass(frozen=True)
class ConceptUpsert:
    id: str
    title: str
    content: str = ""
    embedding_model: str | None = None
    valid_from: str = "1970-01-01T00:00:00.000000Z"
    valid_to: str = OPEN
    retired: bool = False


@dataclass(frozen=True)
class EdgeAssertion:
    source_id: str
    target_id: str
    edge_type: str
    valid_from: str
    valid_to: str = OPEN
    weight: float = 1.0
    properties: str = "{}"


@dataclass(frozen=True)
class Annotation:
    concept_id: str
    label: str
    value: str


@dataclass(frozen=True)
class Meta:
    """What a reconstructed state was made from."""

    timestamp: str
    seq_anchor: int = 0
    predates_recorded_history: bool = False


@dataclass(frozen=True)
class ArchiveReport:
    links: int = 0
    concepts: int = 0
    log_rows: int = 0
    sessions: int = field(default=1, compare=False)
