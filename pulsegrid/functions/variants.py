"""JSON texts as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What follows the text while it is parsed; a text that has it itself is followed by its own hash instead.
_END = "s9f0c7e41d2b86a35"


def whole_json(text: Column | str) -> Column:
    """The variant of a text that is one JSON value and nothing else; null for any other.

    Spark's parser stops where the first value ends and takes ``{"a":1} x`` for JSON.  Therefore the text is read as the
    first of two elements: only where it is exactly one value is what was put behind it the second.
    """
    text = F.col(text) if isinstance(text, str) else text
    end = F.when(text.contains(_END), F.concat(F.lit("s"), F.sha2(text.cast("binary"), 256))).otherwise(_END)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), end, F.lit('"]')))
    # Through an array of one, so that the text is parsed once.
    first = F.transform(F.array(pair), lambda p: F.when(F.try_variant_get(p, "$[1]", "string") == end, F.try_variant_get(p, "$[0]", "variant")))
    return F.get(first, F.lit(0))
