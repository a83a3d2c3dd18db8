"""Column-level building blocks. Everything here returns a ``Column`` built from
built-in Spark SQL functions, so it stays inside the JVM and whole-stage codegen."""

from hearth.functions.arrays import (  # noqa: F401
    argmax, array_literal, has_nan, matrix_literal, matvec, one_hot, same_width, vec_add, vec_sum,
)
from hearth.functions.text import (  # noqa: F401
    any_contains, matches_target, strip_literals, tokenize, url_key,
)
