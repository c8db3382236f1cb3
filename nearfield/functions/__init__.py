from .vector import (
    check_dim,
    has_all,
    l2,
    l2_arrow,
    l2_sql,
    l2sq,
    mean_vector,
    register_functions,
    vec_from_text,
    vec_to_text,
)

__all__ = [
    "check_dim",
    "has_all",
    "l2",
    "l2_arrow",
    "l2_sql",
    "l2sq",
    "mean_vector",
    "register_functions",
    "vec_from_text",
    "vec_to_text",
]
