from cadence.functions.timeops import (  # noqa: F401
    check_tz,
    local_date,
    local_period,
    local_ts,
    part_of_day,
    since,
    to_utc_ntz,
    utc_micros,
    weekday,
)
