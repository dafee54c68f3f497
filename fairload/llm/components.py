"""Connected components of a link table, by least labels with pointer jumping.

Every round takes the least label among a node and its neighbours, then follows the label's own label.
A label chain halves in length with each round, so rounds grow with the logarithm of the longest path.
Rounds are written to the shared folder; only one count of changed labels comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairload.llm.common import written


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of the long pairs (src, dst); root is the least node of the component.

    Nodes without a link are not in the result. Null ends are left out.
    """
    links = links.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    both = links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = written(both, f"{label}-links")
    roots = written(
        both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("root")),
        f"{label}-0",
    )
    rounds = 0
    while True:
        rounds += 1
        heard = (
            both.join(roots, both["dst"] == roots["node"])
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("root").alias("heard"))
        )
        nearer = roots.join(heard, "node").select(
            "node", "root", F.least("root", "heard").alias("next")
        )
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("jumped"))
        after = written(
            nearer.join(jump, "next").select(
                "node", F.col("jumped").alias("root"), (F.col("jumped") != F.col("root")).alias("changed")
            ),
            f"{label}-{rounds}",
        )
        changed = after.where("changed").count()
        roots = after.select("node", "root")
        if changed == 0:
            return roots
