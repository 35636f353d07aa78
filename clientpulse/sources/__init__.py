from clientpulse.sources.readers import (
    infer_format,
    inventory,
    list_files,
    read_any,
    read_events,
    read_table,
    sample_rows,
    schema_rows,
)
from clientpulse.sources.sinks import (
    load_model,
    read_scores,
    save_model,
    write_events,
    write_report,
    write_scores,
    write_table,
)

__all__ = [
    "infer_format",
    "inventory",
    "list_files",
    "load_model",
    "read_any",
    "read_events",
    "read_scores",
    "read_table",
    "sample_rows",
    "save_model",
    "schema_rows",
    "write_events",
    "write_report",
    "write_scores",
    "write_table",
]
