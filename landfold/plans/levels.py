"""Level-by-level walks down a parent table.

Each round is one equi-join of the last level with the children, written to the
shared checkpoint folder, so lineage stays one level deep and the number of
rounds is the depth of the tree, not its size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from landfold.session import cut_lineage


def descend(
    roots: DataFrame,
    children: DataFrame,
    step: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """Union of all levels. step(frontier, children) gives the next level; an empty level ends the walk.

    A cycle has no root, so it is never entered.
    """
    level = cut_lineage(roots)
    levels = [level]
    while True:
        level = cut_lineage(step(level, children))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)
