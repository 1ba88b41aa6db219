from cohortry.functions.nullrules import (  # noqa: F401
    as_number, contains_text, divide, in_set, log10_positive, log2_positive,
    matches, n_distinct, paste0, str_c, strict_mean,
)
