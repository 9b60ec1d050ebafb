"""Column-expression helpers (all JVM-side, no Python UDFs)."""

from .columns import (  # noqa: F401
    erfc,
    hash_u32,
    nan_to_null,
    normal_two_sided_p,
    ratio,
    ratio_of_sums,
    round_doubles,
    weighted_mean,
)
