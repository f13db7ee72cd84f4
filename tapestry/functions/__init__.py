"""Column-level helpers.  Every function takes and returns ``Column`` objects built
from ``pyspark.sql.functions`` so that they stay inside whole-stage codegen."""

from tapestry.functions.arrays import (  # noqa: F401
    cross_apply,
    distinct_groups,
    first_field,
    first_of,
    keyed_map,
    merge_arrays,
    merge_maps,
    non_empty,
    pick,
    shape,
)
from tapestry.functions.codes import classify, role_of, translate, yes_no  # noqa: F401
from tapestry.functions.keys import (  # noqa: F401
    base_name,
    clamp,
    first_non_empty,
    full_name,
    iso_ts,
    padded_name,
    split_code,
    surrogate_key,
)
from tapestry.functions.names import (  # noqa: F401
    clean_column,
    clean_field,
    clean_rule,
    clean_table,
    is_column_name,
    output_name,
    py_strip,
)
