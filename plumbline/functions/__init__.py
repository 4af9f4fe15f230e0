from .expressions import (
    add_separator_join,
    binarize,
    bind,
    hashed_ngrams,
    normalise_array,
    number,
    parse_int_array,
    positive_flag,
    safe_log,
    word_ngrams,
)

__all__ = [
    "add_separator_join",
    "binarize",
    "bind",
    "hashed_ngrams",
    "normalise_array",
    "number",
    "parse_int_array",
    "positive_flag",
    "safe_log",
    "word_ngrams",
]
