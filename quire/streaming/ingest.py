"""Pages as a stream: recognised, assembled and saved as they arrive, resumed from a checkpoint.

A page is one row of the part table, so its cost doesn't grow with the document.  The sink replaces by
(id, index): a batch that is run again after a failure writes the same rows once more, and reading keeps one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import layout
from quire.sources.store import Store


def save_parts(blocks: DataFrame, store: Store, checkpoint: str, refine: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Assembles the blocks of each micro-batch's pages and saves the parts; all blocks of a page come together.

    ``refine`` maps blocks to blocks (an external model with its guard) before pages are assembled.
    """

    def batch(frame: DataFrame, number: int) -> None:
        ready = refine(frame) if refine else frame
        pages = layout.assemble_pages(ready)
        store.save("part", pages.select(F.col("doc_id").cast("string").alias("id"), F.col("page").alias("index"), F.col("markdown").alias("text")))

    return blocks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(store: Store, totals: DataFrame) -> DataFrame:
    """``id, done, total``: what of each document is saved."""
    done = store.read("part").groupBy("id").agg(F.count("*").alias("done"))
    return totals.join(done, "id", "left").select("id", F.coalesce("done", F.lit(0)).alias("done"), "total")
