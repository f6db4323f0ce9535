"""Random alphabetic inputs, which no numeric parser accepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def _draw(seed: Column, what: Column, sides: int) -> Column:
    digest = F.md5(F.concat_ws(":", seed, what))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % sides


def random_inputs(rows: DataFrame, id_column: str, seed: int = 0) -> DataFrame:
    """``(id, args)``: one argument of random letters for every row of ``rows``.

    Length and letters come from a hash of seed and id, so a task that runs
    again draws the same text.
    """
    key = F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string"))
    spread = fixed.INPUT_MAX_LENGTH - fixed.INPUT_MIN_LENGTH + 1
    length = F.lit(fixed.INPUT_MIN_LENGTH) + _draw(key, F.lit("length"), spread)
    letters = F.transform(
        F.sequence(F.lit(1), length.cast("int")),
        lambda i: F.substring(
            F.lit(fixed.INPUT_LETTERS),
            (_draw(key, i.cast("string"), len(fixed.INPUT_LETTERS)) + 1).cast("int"),
            F.lit(1),
        ),
    )
    return rows.select(
        F.col(id_column).alias("id"), F.array(F.array_join(letters, "")).alias("args")
    )
