"""Changes of sources as a stream: snapshots come in, and what was added, changed or removed goes out.

The state of a URI is its last content hash. A URI is removed when event time has passed ``gap`` after it was last seen, which a timer
tells; so a source that is listed less often than every ``gap`` seems to go and come back. State is as large as the live sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "uri string, status string, seen_at timestamp"


def changes(snapshots: DataFrame, gap: str = "30 minutes", late: str = "0 seconds", unchanged: bool = False) -> DataFrame:
    """snapshots, a stream: uri, content_hash, seen_at (the time of the listing). uri, status (added, changed, removed and, if asked for, unchanged), seen_at (of
    the listing; for a removal the last one that had it)."""
    step_ms = int(pd.Timedelta(gap).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((key[0], "removed", pd.Timestamp(state.get[1], unit="ms")))
            state.remove()
        else:
            known, last = state.get if state.exists else (None, None)
            rows = sorted((int(t), h) for batch in batches for h, t in zip(batch["content_hash"], batch["at_ms"], strict=True))
            for at, content_hash in rows:
                if last is not None and at <= last:
                    continue  # a listing that is repeated
                status = "added" if last is None else "unchanged" if content_hash == known else "changed"
                if unchanged or status != "unchanged":
                    out.append((key[0], status, pd.Timestamp(at, unit="ms")))
                known, last = content_hash, at
            state.update((known, last))
            state.setTimeoutTimestamp(max(last + step_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["uri", "status", "seen_at"])

    rows = snapshots.where("uri IS NOT NULL AND seen_at IS NOT NULL").withWatermark("seen_at", late).select("uri", F.coalesce("content_hash", F.lit("")).alias("content_hash"), "seen_at", F.unix_millis("seen_at").alias("at_ms"))
    return rows.groupBy("uri").applyInPandasWithState(step, OUT, "content_hash string, last_ms long", "append", "EventTimeTimeout")
