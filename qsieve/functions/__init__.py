from .regex import java_ci, re2_ci, to_re2, union  # noqa: F401
from .scalars import (  # noqa: F401
    bom_ref, category_label, dependency_rule_id, file_extension, is_binary, language,
    location_label, lookup, map_lit, occurrence_label, sarif_level, severity_rank,
)
