"""Table-level operators: dedup, lookups, surrogate keys, incremental loads, SCD2, quality."""

from .dedup import keep_first, min_per_key, distinct_values
from .lookup import broadcast_if_small, lookup, lookup_many, lookup_in_slices, estimated_bytes
from .surrogate import assign_keys, number_in_buckets
from .incremental import (stamp, upsert_by_key, append, high_water, after_event_mark,
                          empty_watermarks, read_mark, after_process_mark, set_mark,
                          require_newer, sync_schema)
from .scd2 import (scd2_changed, scd2_closed, scd2_new, scd2_initial, scd2_apply,
                   assert_unique_key)
from .quality import (not_null_violations, unique_violations, quality_summary, check_models, monthly_counts,
                      replace_months, summary_of_months)
from .materialize import materialize, scratch_scope
