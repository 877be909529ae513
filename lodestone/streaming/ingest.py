"""Streaming ingestion: every micro-batch is merged by id into the next version of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.registry import lookup
from lodestone.sources.catalog import Catalog
from lodestone.sources.mutation import latest, upsert


def ingest(stream: DataFrame, catalog: Catalog, name: str, seq: str, checkpoint: str) -> StreamingQuery:
    """Upsert a stream into ``name``: within a batch the highest ``seq`` of an id counts, and a later batch replaces an
    earlier one only with a higher or equal ``seq``. A batch that runs again after a failure gives the same rows."""
    id = catalog.schemas[name][1]

    def merge(batch: DataFrame, number: int) -> None:
        fresh = latest(batch, id, seq)
        if catalog._meta(name)["version"]:
            old = catalog.open(name).df
            newer = latest(old.join(fresh.select(id), id, "left_semi").unionByName(fresh), id, seq)
            fresh = upsert(old, newer, id)
        catalog.commit(name, fresh)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_from(source: str, catalog: Catalog, name: str, seq: str, checkpoint: str, **options: object) -> StreamingQuery:
    """The same from a registered source: a callable of the session and its options that gives a stream."""
    return ingest(lookup("ingestion", source)(catalog.spark, **options), catalog, name, seq, checkpoint)
