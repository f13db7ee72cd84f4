"""Connected components of a table of links, by label propagation with pointer
jumping.  Links and labels stay distributed; each round is written to the
shared folder, and one count a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapestry.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, label): every id that occurs in a link, with the
    smallest id it reaches.  Self links, repeated links and either direction
    are fine; links with a NULL end are dropped; no links give no rows.

    A round lowers each label to the smallest among the neighbours' labels and
    then to that label's own label, so paths shorten by about half each round.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(seen, labels["id"] == seen["a"]).select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = stage(low.join(far, "label", "left").select("id", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = new.select("id", "label")
        if not new.where("label <> was").limit(1).count():
            return labels
