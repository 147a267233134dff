"""Log and event processing as Spark DataFrame operators."""

from logweave.model import EVENT_SCHEMA, Fields, add_field, add_metadata, add_tag, from_documents, to_events
from logweave.operators.custom import python_step
from logweave.operators.enrich import enrich, geo, lookup, resolve_hosts, user_agent
from logweave.operators.extract import extract_grok, extract_regex
from logweave.operators.filter import filter_events
from logweave.operators.json import parse_json
from logweave.operators.mutate import mutate
from logweave.plans.flow import ConfigError, Flow, load_spec
from logweave.plans.registry import Registry, default_registry
from logweave.session import configure, shared_dir

__all__ = [
    "EVENT_SCHEMA", "ConfigError", "Fields", "Flow", "Registry", "add_field", "add_metadata", "add_tag",
    "configure", "default_registry", "enrich", "extract_grok", "extract_regex", "filter_events",
    "from_documents", "geo", "load_spec", "lookup", "mutate", "parse_json", "python_step", "resolve_hosts",
    "shared_dir", "to_events", "user_agent",
]
