"""Request de-duplication inside a time to live, for batches and streams."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["actor", "key"]


def walk_requests(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Outcome of every delivery in time order: first, replay or conflict.

    A partition holds whole keys in time order and is read as a stream: only the
    open window of the current key is kept, so a key of any size needs constant
    memory.
    """
    ttl = pd.Timedelta(seconds=ttl_seconds)
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    columns = [*KEYS, "request_hash", "at", "seq"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", outcome string"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, opened, digest = None, None, None
        for batch in batches:
            outcomes = []
            for actor, key, request_hash, at in zip(batch["actor"], batch["key"], batch["request_hash"], batch["at"]):
                if (actor, key) != current or at > opened + ttl:
                    current, opened, digest = (actor, key), at, request_hash
                    outcomes.append("first")
                else:
                    outcomes.append("replay" if request_hash == digest else "conflict")
            yield batch.assign(outcome=outcomes)

    ordered = requests.select(*columns).repartition(*KEYS).sortWithinPartitions(*KEYS, "at", "seq")
    return ordered.mapInPandas(walk, schema)
