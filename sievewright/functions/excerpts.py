"""Where an excerpt's lines stand in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines of excerpts that stand for what was left out.
GAPS = ("...", "// ...")


def aligned(full: Column, excerpt: Column) -> Column:
    """``(first, last)``: places, from 1, at which the excerpt's lines stand in the text's, in order but with others between them,
    each as early as it can behind the one before. Lines compare trimmed; blank lines and gap marks don't count. Null where
    a line isn't there, or none counts.

    A fold over the excerpt whose state is the last place; a place of -1 says that a line was missing. ``full`` and ``excerpt``
    are arrays of lines.
    """
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    said = F.filter(F.transform(excerpt, strip), lambda x: (x != "") & ~x.isin(*GAPS))
    text = F.transform(full, strip)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"))

    def step(s: Column, line: Column) -> Column:
        hit = F.array_position(F.slice(text, s["at"] + 1, F.size(text)), line).cast("int")
        at = F.when((s["at"] < 0) | (hit == 0), -1).otherwise(s["at"] + hit)
        return F.struct(at.alias("at"), F.when(s["first"] == 0, at).otherwise(s["first"]).alias("first"))

    found = F.aggregate(said, start, step)
    return F.when(found["at"] > 0, F.struct(found["first"].alias("first"), found["at"].alias("last")))
