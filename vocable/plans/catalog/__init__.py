"""Registered queries, one module per SURVEY section.  Importing registers them."""

from vocable.plans.catalog import (  # noqa: F401
    flagship,
    keys_filters,
    stats,
    vectors,
    lookup_split,
    batching_arrays,
    signal_eval,
    text,
    numbers_ml,
    streaming,
    sources,
)
