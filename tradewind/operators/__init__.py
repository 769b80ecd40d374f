from tradewind.operators.checks import CheckFailed, check_not_null, check_unique, require_clean, run_checks
from tradewind.operators.dedupe import first_per_key, top_per_group
from tradewind.operators.ranking import global_ntile, global_rank
from tradewind.operators.silhouette import distance_sums, mean_silhouette, silhouettes
from tradewind.operators.upsert import (
    DuplicateKeys,
    insert_new,
    repeated_keys,
    require_unique,
    unseen,
    upsert,
)

__all__ = [
    "CheckFailed",
    "DuplicateKeys",
    "check_not_null",
    "check_unique",
    "distance_sums",
    "first_per_key",
    "global_ntile",
    "global_rank",
    "insert_new",
    "mean_silhouette",
    "repeated_keys",
    "require_clean",
    "require_unique",
    "run_checks",
    "silhouettes",
    "top_per_group",
    "unseen",
    "upsert",
]
