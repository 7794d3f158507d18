"""Register analytics on Spark: entities, roles, relationships and successions
published as complete dated snapshots, searched, compared, profiled and audited
with DataFrame operators."""

__version__ = "0.1.0"
