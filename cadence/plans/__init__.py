from cadence.plans.session import (  # noqa: F401
    bounded_broadcast,
    checkpoint_root,
    get_spark,
    local_table,
    materialize,
    scratch_path,
)
