"""Order-dependent assignment: items choose in turn, and what is chosen is gone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy(items: DataFrame, choices: DataFrame, group: str, key: str, cost: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, item, assigned): in each group, items by key take the free choice of least cost (the smaller key of equals).

    The turn-taking is inherently sequential, so it runs as a fold within a group; groups run in parallel.
    """
    names = [c for c in items.columns if c not in (group, key)]
    fields = [F.col(key).alias("key"), *names]
    a = items.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("a"))
    b = choices.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("b"))
    both = a.join(b, group)
    kind = both.schema["b"].dataType.elementType["key"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("used"), F.array().cast(f"array<struct<item:{kind},assigned:{kind}>>").alias("pairs"))

    def step(s: Column, item: Column) -> Column:
        free = F.filter("b", lambda x: ~F.array_contains(s["used"], x["key"]))
        best = F.array_min(F.transform(free, lambda x: F.struct(cost(item, x).alias("cost"), x["key"].alias("key"))))["key"]
        return F.when(best.isNull(), s).otherwise(F.struct(F.array_append(s["used"], best).alias("used"), F.array_append(s["pairs"], F.struct(item["key"].alias("item"), best.alias("assigned"))).alias("pairs")))

    return both.select(group, F.inline(F.aggregate("a", start, step, lambda s: s["pairs"])))
