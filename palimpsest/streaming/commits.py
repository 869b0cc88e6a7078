"""A commit for every micro-batch, and the changes between commits as a feed.

This goes beyond what versioned tables need: it lets a stream be the writer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.sources.repository import Repository


def committer(repo: Repository, table: str, order: Sequence[str], author: str = "") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: upserts the batch (the last row of a key by ``order`` counts) and commits.

    A batch that is run again after a failure finds its number in the log and does nothing: batches
    are numbered upwards, so the last one of this table tells, however many other commits came after it.
    """
    pattern = re.compile(rf"Batch (\d+) of {re.escape(table)}")

    def commit(batch: DataFrame, number: int) -> None:
        message = f"Batch {number} of {table}"
        done = next((int(m[1]) for _, c in repo.log() if (m := pattern.fullmatch(c.message))), -1)
        if done >= number:
            return
        draft = repo.draft()
        draft.insert_rows(table, batch, order)
        draft.commit(message, author)

    return commit


def commit_stream(rows: DataFrame, repo: Repository, table: str, order: Sequence[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(committer(repo, table, order)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def change_feed(repo: Repository, table: str, since: str, until: str = "HEAD") -> DataFrame:
    """Row changes of every commit after ``since`` up to ``until`` along first parents, with the commit's place and hash."""
    chain, at, stop = [], repo.resolve(until), repo.resolve(since)
    while at and at != stop:
        chain.append(at)
        above = repo.store.get_parents(at)
        at = above[0] if above else None
    if stop is None or at != stop:
        raise ValueError(f"{since!r} is not among the first parents of {until!r}")
    out = None
    for i, name in enumerate(reversed(chain)):
        before = repo.store.get_parents(name)[0]
        if table not in repo.snapshot(before).tables or table not in repo.snapshot(name).tables:
            continue
        part = repo.row_diff(table, before, name).select(F.lit(i).alias("n"), F.lit(name).alias("commit"), "*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"table {table!r} has no two versions in this range")
    return out
