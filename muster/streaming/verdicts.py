"""Pages as they land: each offset once, whatever is replayed, and verdicts before the stream ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from muster.operators import pages as P
from muster.streaming.spans import Spans

STATE = "spans string"
CELL = 1 << 20  # offsets that share a state, so that a long list is spread over tasks
VERDICTS = "dataset_id string, reported_count bigint, raw_count bigint, n_pages bigint, verdict string, released boolean"


def _spans(state: GroupState) -> Spans:
    return Spans(state.get[0] if state.exists else None)


def _accept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    spans = _spans(state)
    for frame in frames:
        frame = frame.sort_values(["page_start", "attempt"], kind="stable")
        fresh = [spans.add(start, len(ids)) for start, ids in zip(frame["page_start"].tolist(), frame["ids"], strict=True)]
        yield frame.loc[fresh, ["dataset_id", "page_start", "ids"]]
    state.update((spans.dump(),))


def first_pages(pages: DataFrame, *, cell: int = CELL) -> DataFrame:
    """``(dataset_id, page_start, ids)`` of the first page to land at each offset of a stream of pages.

    Files that land again, later attempts at an offset that was read, and pages that come late
    change nothing. The state is a few numbers for each ``cell`` offsets of a list; see ``Spans``. Pages without
    identifiers, and attempts that failed, are not looked at.
    """
    keyed = pages.where(P.succeeded() & F.col("page_start").isNotNull()).select(
        "dataset_id", F.floor(F.col("page_start") / cell).cast("bigint").alias("_cell"), "page_start", "attempt", "ids"
    )
    return keyed.groupBy("dataset_id", "_cell").applyInPandasWithState(
        _accept, "dataset_id string, page_start bigint, ids array<string>", STATE, "append", GroupStateTimeout.NoTimeout
    )


def land_identifiers(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the identifiers of every offset to the table at ``path``, once, also over restarts and replays."""
    return (
        P.flatten_pages(first_pages(pages)).writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def judge(spans: Spans, reported: int | None) -> str:
    """The verdict of ``operators.pages.page_verdict`` on what has landed so far."""
    if reported is None or reported < 0:
        return P.UNKNOWN_COUNT
    first: dict[str, int] = {}
    end = reach = expected = 0
    broken = False
    for start, upto, fault in spans.landed(P.REQUEST_ERROR):
        kinds = [fault] if fault else []
        if start != expected:
            kinds.append(P.GAP if start > expected else P.OVERLAP)
        for kind in kinds:
            first.setdefault(kind, start)
        if start > expected and not broken:
            reach, broken = expected, True
        expected, end = upto, max(end, upto)
    for kind in (P.MISSING_ID_LIST, P.EMPTY_PAGE, P.GAP, P.OVERLAP):
        if first.get(kind, reported) < reported:
            return kind
    return P.INCOMPLETE if (reach if broken else end) < reported else P.OK


def _judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    spans = _spans(state)
    reported = None
    seen = pd.concat(list(frames)).sort_values(["attempt", "page_start"], kind="stable")
    for start, attempt, size, fault, count in seen.itertuples(index=False, name=None):
        reported = None if pd.isna(count) else int(count)
        if spans.done is not None:
            continue
        if fault is None or pd.isna(fault):
            spans.add(int(start), int(size))
        else:
            spans.fail(int(start), int(attempt), fault)
    verdict = P.OK if spans.done is not None else judge(spans, reported)
    raw, n_pages = spans.done if spans.done is not None else spans.totals()
    if verdict == P.OK:
        spans.done = [raw, n_pages]  # what was read of a released list is all that is kept of it
    state.update((spans.dump(),))
    yield pd.DataFrame(
        {
            "dataset_id": [key[0]], "reported_count": pd.array([reported], dtype="Int64"), "raw_count": [raw], "n_pages": [n_pages],
            "verdict": [verdict], "released": [verdict == P.OK],
        }
    )


def running_verdicts(pages: DataFrame, searches: DataFrame) -> DataFrame:
    """``(dataset_id, reported_count, raw_count, n_pages, verdict, released)``, again whenever pages of a list land.

    ``pages`` is a stream, ``searches(dataset_id, reported_count)`` a table. A list is released as soon as it
    is whole, in whatever order its pages came, and stays so: what lands for it later is not looked at. The last row of a
    list is its verdict, the same as ``page_verdict`` gives of all pages, if attempts at an offset land
    in their order. Pages are reduced to numbers before they are dealt by list; the state of a list is its runs of
    pages, the offsets that failed, and two counts once it is released.
    """
    fault = P.attempt_fault()
    narrow = pages.where(F.col("page_start").isNotNull()).select(
        "dataset_id", "page_start", F.col("attempt").cast("bigint").alias("attempt"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("size"), fault.alias("fault"),
    )
    asked = narrow.join(searches.select("dataset_id", "reported_count"), "dataset_id")
    keyed = asked.select("dataset_id", "page_start", "attempt", "size", "fault", "reported_count")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _judge(key, (f[["page_start", "attempt", "size", "fault", "reported_count"]] for f in frames), state)

    return keyed.groupBy("dataset_id").applyInPandasWithState(run, VERDICTS, STATE, "update", GroupStateTimeout.NoTimeout)


def follow_verdicts(pages: DataFrame, searches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the verdicts of every micro-batch to a folder of its own below ``path``; one that is repeated replaces it."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        running_verdicts(pages, searches).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def last_verdicts(searches: DataFrame, path: str) -> DataFrame:
    """One row for every search: its last verdict; one without pages is judged by its count."""
    spark = searches.sparkSession
    told = spark.read.schema(f"{VERDICTS}, batch bigint").parquet(path)
    last = told.groupBy("dataset_id").agg(F.max_by(F.struct("raw_count", "n_pages", "verdict", "released"), "batch").alias("_last"))
    reported, none = F.col("reported_count"), F.lit(0).cast("bigint")
    bare = F.when(reported.isNull() | (reported < 0), P.UNKNOWN_COUNT).when(reported > 0, P.INCOMPLETE).otherwise(P.OK)
    return searches.select("dataset_id", "reported_count").join(last, "dataset_id", "left").select(
        "dataset_id", "reported_count", F.coalesce("_last.raw_count", none).alias("raw_count"),
        F.coalesce("_last.n_pages", none).alias("n_pages"), F.coalesce("_last.verdict", bare).alias("verdict"),
    )
