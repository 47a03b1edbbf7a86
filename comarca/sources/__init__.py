"""Reading registers and model tables, writing model tables."""

from comarca.sources.csv import CORRUPT, scan_csv
from comarca.sources.model_store import (
    read_model,
    register_model,
    store,
    work_folder,
    write_model,
)
from comarca.sources.tables import SCHEMAS, table

__all__ = [
    "CORRUPT",
    "SCHEMAS",
    "read_model",
    "register_model",
    "scan_csv",
    "store",
    "table",
    "work_folder",
    "write_model",
]
