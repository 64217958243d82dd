"""Look-alikes of official names by a deletion-neighbourhood index.

Two words at an edit distance of at most ``most`` share a string that each becomes when at most ``most`` of its letters are
taken out. Those strings are the join key: a hash join of all names' and all tokens' strings, then the exact
distance. Work grows with the tokens and with the names, not with their product; equal tokens are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shortened(word: str, most: int) -> Column:
    """Array of the strings that a word becomes by taking out at most ``most`` letters, each once."""
    out = f"array({word})"
    for _ in range(most):
        out = f"array_distinct(concat({out}, flatten(transform({out}, w -> if(w = '', array(w), transform(sequence(1, length(w)), i -> concat(left(w, i - 1), substring(w, i + 1))))))))"
    return F.expr(out)


def lookalikes(tokens: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """token, official and distance of the distinct tokens (``token``) that are no name but near one (``name``).

    The nearest name is given, of equally near ones the least. Null and empty tokens and names are left out.
    A token longer or shorter than every name by more than ``most`` is near none and is not taken apart.
    """
    names = names.select("name").where("name <> ''").distinct()
    sizes = names.agg(F.min(F.length("name")).alias("lo"), F.max(F.length("name")).alias("hi"))
    fit = tokens.select("token").where("token <> ''").distinct().join(names.withColumnRenamed("name", "token"), "token", "left_anti")
    fit = fit.join(F.broadcast(sizes), F.length("token").between(F.col("lo") - most, F.col("hi") + most)).select("token")  # one row
    index = names.select("name", F.explode(shortened("name", most)).alias("part"))
    met = fit.select("token", F.explode(shortened("token", most)).alias("part")).join(index, "part").select("token", "name").distinct()
    near = met.withColumn("distance", F.levenshtein("token", "name", most)).where(F.col("distance") >= 1)
    best = near.groupBy("token").agg(F.min(F.struct("distance", "name")).alias("b"))
    return best.select("token", F.col("b.name").alias("official"), F.col("b.distance").alias("distance"))
