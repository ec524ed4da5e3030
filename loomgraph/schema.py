"""Closed sets and table shapes of the graph model (survey rows 1.2, 1.3)."""

from __future__ import annotations

# The model's enumerations.
NODE_TYPES = [
    "functional", "code_module", "implementation_file", "implementation_class", "implementation_function", "implementation_package",
    "implementation_symbol", "requirement", "task", "constraint", "decision", "interface", "documentation", "conversation", "artifact",
    "test", "issue", "note", "project_rule",
]
RELATION_TYPES = [
    "dependency", "reference", "interface", "data", "optional", "force_include", "force_exclude", "depends_on", "calls", "references",
    "affects", "constrains", "implements", "implemented_by", "derived_from", "conflicts_with", "supersedes", "related_to", "contains",
    "uses", "provides", "consumes", "produces", "feeds", "transforms", "triggers", "tests", "documents", "targets", "requires",
    "constrained_by", "applies_to",
]
MODES = ["AUTO", "MANUAL", "FORCE_INCLUDE", "FORCE_EXCLUDE"]
SCOPES = ["code", "context", "interface", "contract", "state", "decisions", "history", "content"]
PRIORITIES = ["critical", "high", "normal", "low"]
STATUSES = ["active", "resolved", "deprecated", "superseded", "archived", "stale"]
TERMINAL = ["resolved", "deprecated", "superseded", "archived"]
INACTIVE = [*TERMINAL, "stale"]
FACT_TYPES = ["IMPORT", "CALL", "REFERENCE", "INHERIT", "IMPLEMENT", "DATA_FLOW", "EVENT", "INTERFACE", "OPTIONAL_DEPENDENCY"]
FORWARD_TYPES = ["targets", "depends_on", "requires", "uses", "consumes", "produces", "feeds", "transforms", "triggers"]
CODE_EDGE_TYPES = ["dependency", "reference", "calls"]
CHECKED_EDGE_TYPES = ["dependency", "reference", "interface", "data", "optional"]

# Shapes of the tables of a graph. ``ord`` is the place in the source document: order is data.
NODES = (
    "ord bigint, id string, type string, title string, label string, content string, description string, provides array<string>, consumes array<string>, "
    "inputs array<string>, outputs array<string>, source string, created_by string, confidence double, derived_from array<string>, last_verified string, "
    "subject string, slot string, value string, priority string, status string, mode string, scope array<string>, path string, x double, y double, "
    "created_at string, updated_at string, metadata string"
)
EDGES = "ord bigint, source string, target string, type string, scope array<string>, mode string, confidence double, metadata string"
MAPPINGS = "ord bigint, functional string, implementation array<struct<id:string,path:string,capabilities:array<string>,mode:string>>, confidence double, created_by string, mode string, metadata string"
OVERRIDES = "kind string, id string, ord bigint"
RELATIONSHIPS = (
    "ord bigint, `from` string, from_symbol string, from_symbol_id string, `to` string, to_symbol_id string, type string, symbol string, "
    "confidence double, dynamic boolean, reason string, evidence array<struct<file:string,line:int,end_line:int,evidence:string>>"
)
SECTIONS = "doc_id string, idx int, level int, title string, page_start int, page_end int"
MESSAGES = "session string, pos bigint, role string, source struct<kind:string,plugin:string,form:string,callId:string>, content array<struct<type:string,text:string>>"
