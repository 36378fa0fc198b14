"""Topic, collection and fan-out writers."""

from newsflow.sinks.batch import Target, write_batch
from newsflow.sinks.stream import fan_out, run_available, write_collection, write_topic

__all__ = [
    "Target",
    "fan_out",
    "run_available",
    "write_batch",
    "write_collection",
    "write_topic",
]
