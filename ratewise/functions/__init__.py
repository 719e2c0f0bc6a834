"""Column -> Column builders (no Python runs per row).

    from ratewise.functions import mcr_rating, severity_index, clean_text
"""

from ratewise.functions.rating import (  # noqa: F401
    descriptor_text,
    descriptors,
    explanation,
    final_rating,
    highest_concern,
    long_name,
    max_score,
    mcr_rating,
    rating_filter,
    rating_struct,
    recommendation,
)
from ratewise.functions.scores import clean_score, clip01, coerce_numeric  # noqa: F401
from ratewise.functions.severity import (  # noqa: F401
    category_percentages,
    csi_probability,
    kid_safe,
    rating_color,
    rescale,
    safety_level,
    sigmoid,
)
from ratewise.functions.severity import severity as severity_index  # noqa: F401  (module name stays free)
from ratewise.functions.text import char_count, clean_text, is_blank, word_count  # noqa: F401
