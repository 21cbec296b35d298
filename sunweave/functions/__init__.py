"""Column expressions: no actions, no Python workers."""

from sunweave.functions.scalar import (  # noqa: F401
    clamp_non_negative,
    correlation,
    equal_width_bin,
    null_if_sentinel,
    numeric_columns,
    power_level,
)
from sunweave.functions.solar import (  # noqa: F401
    clear_sky_irradiance,
    clearness_index,
    cyclic_time,
    parse_day_hour,
    season,
)
