from .identity import FileRegister, check_ids, file_position_ids, hashed_ids, key_ids, landed_ids
from .readers import CheckedScan, read_checked_csv, read_delimited, read_indexed_csv, read_plain_csv, spread

__all__ = [
    "CheckedScan",
    "FileRegister",
    "check_ids",
    "file_position_ids",
    "hashed_ids",
    "key_ids",
    "landed_ids",
    "read_checked_csv",
    "read_delimited",
    "read_indexed_csv",
    "read_plain_csv",
    "spread",
]
