from .lineage import (
    LINEAGE,
    lineage_entries,
    lineage_pairs,
    lineage_text,
    merge_lineage,
    row_id_of,
    row_ids_of,
    with_source_rows,
)
from .ranking import roc_auc, roc_auc_value
from .sampling import balance_classes, random_split, sample_rows, split_at_rank, temporal_split
from .tracked import Tracked, track

__all__ = [
    "LINEAGE",
    "Tracked",
    "balance_classes",
    "lineage_entries",
    "lineage_pairs",
    "lineage_text",
    "merge_lineage",
    "random_split",
    "roc_auc",
    "roc_auc_value",
    "row_id_of",
    "row_ids_of",
    "sample_rows",
    "split_at_rank",
    "temporal_split",
    "track",
    "with_source_rows",
]
