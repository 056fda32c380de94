"""Continuous checkout: carts arrive as files; each micro-batch is sold
against the stock left by all earlier micro-batches.

``readStream`` (JSON lines or Parquet files of carts) -> ``foreachBatch``:
the batch job (``operators.checkout.checkout``) runs on the micro-batch with
the latest published products, sales and sale items, and the three outputs
are published together as the store's next batch, marked with the micro-batch id
(``sources.tables``). A micro-batch that is replayed after a failure finds its
marker and is skipped, so the outputs are exactly-once. Within a micro-batch carts are
ordered by (ts, cart_id); across micro-batches by arrival.

With ``delay`` the stream sells in event time: ``hold_back`` keeps every cart in
the state store until the watermark (the latest time seen less the delay) has
passed the cart's time, so carts that arrive out of order by no more than the
delay are sold in the order of their times, whatever files they came in. A cart
that comes later still cannot be sold in its place any more; it is sold with the
next micro-batch, never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.checkout import checkout
from ..plans.lineage import cut_lineage, release
from ..sources.schema import CARTS
from ..sources.tables import TableStore


def seed_store(store: TableStore, products: DataFrame, sales: DataFrame | None = None,
               sale_items: DataFrame | None = None) -> None:
    """Publish the starting tables as batch 0."""
    appends, meta = {}, {"last_sale_id": 0, "last_item_id": 0}
    if sales is not None:
        appends["sales"] = sales
        meta["last_sale_id"] = int(sales.agg(F.max("id")).first()[0] or 0)
    if sale_items is not None:
        appends["sale_items"] = sale_items
        meta["last_item_id"] = int(sale_items.agg(F.max("id")).first()[0] or 0)
    store.publish(0, products=products, appends=appends, meta=meta)


def process_batch(store: TableStore, carts: DataFrame, batch_id: int) -> bool:
    """Sell one micro-batch; returns False when it was published before."""
    # batches are numbered by the store, which maintenance publishes to as well;
    # the marker's origin tells which micro-batch a batch is
    origin = f"stream-{int(batch_id)}"
    if store.has_origin(origin) or carts.isEmpty():
        return False
    batch, last = store.next_batch(), store.meta()
    known = "last_sale_id" in last and "last_item_id" in last
    res = checkout(carts, store.products(), store.appended("sales"), store.appended("sale_items"),
                   id_base=(last["last_sale_id"], last["last_item_id"]) if known else None)
    done = store.publish(batch, products=res.products,
                         appends={"sales": res.sales, "sale_items": res.sale_items},
                         meta={"last_sale_id": res.last_sale_id, "last_item_id": res.last_item_id}, origin=origin)
    # the batch is on disk now: drop what its jobs kept in memory, so a
    # long-running stream does not pile up cached blocks
    release()
    return done


#: The state store that ``transformWithState`` needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A held cart with the first whole millisecond that is not before its time.
HELD = T.StructType([T.StructField("due", T.LongType()), *CARTS.fields])
#: Held carts are dealt by hash to this many groups, each with its own state.
GROUPS = 256


class EventOrder(StatefulProcessor):
    """Holds a group's carts until the watermark has passed their time.

    The state is the list of held carts; one timer stands at the earliest of
    their times. Times are compared in whole milliseconds, rounded up, as
    watermark and timers count them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState("held", HELD)
        self._timer = handle.getValueState("timer", "due bigint")

    def _wait(self, due: int) -> None:
        """Set the group's timer to ``due`` if none stands earlier."""
        if self._timer.exists():
            now = self._timer.get()[0]
            if now <= due:
                return
            self._handle.deleteTimer(now)
        self._handle.registerTimer(due)
        self._timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed, held = timerValues.getCurrentWatermarkInMs(), []
        for r in rows:
            if r["due"] <= passed:
                yield _cart(r)      # too late for its place: sold now
            else:
                held.append(tuple(r[c] for c in HELD.names))
        if held:
            self._held.appendList(held)
            self._wait(min(due for due, *_ in held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed, kept = timerValues.getCurrentWatermarkInMs(), []
        for r in self._held.get():
            if r[0] <= passed:
                yield _cart(dict(zip(HELD.names, r, strict=True)))
            else:
                kept.append(tuple(r))
        self._timer.clear()
        if kept:
            self._held.put(kept)
            self._wait(min(due for due, *_ in kept))
        else:
            self._held.clear()

    def close(self) -> None:
        pass


def _cart(r) -> Row:
    return Row(**{c: r[c] for c in CARTS.names})


def hold_back(carts: DataFrame, delay: str, groups: int = GROUPS) -> DataFrame:
    """The stream ``carts`` in event time: each cart comes out once the
    watermark has passed its ``ts`` (a cart without a time is one of now).

    Carts are dealt to ``groups`` by a hash of all their columns, so no cart id
    or time makes a hot group. What is held is what arrived within the delay."""
    timed = (carts.withColumn("ts", F.coalesce("ts", F.current_timestamp())).withWatermark("ts", delay))
    due = F.ceil(F.unix_micros("ts") / F.lit(1000)).cast("bigint")
    # the copy of ``ts`` is no event-time column, so Spark filters no late carts
    dealt = timed.select(
        F.pmod(F.xxhash64(*CARTS.names), F.lit(groups)).alias("group"), due.alias("due"),
        *[F.timestamp_micros(F.unix_micros("ts")).alias(c) if c == "ts" else F.col(c) for c in CARTS.names])
    return dealt.groupBy("group").transformWithState(
        statefulProcessor=EventOrder(), outputStructType=CARTS, outputMode="append", timeMode="eventTime")


def start(spark: SparkSession, carts_dir: str, store_root: str, checkpoint_location: str,
          fmt: str = "json", max_files_per_trigger: int | None = None, available_now: bool = True,
          delay: str | None = None):
    """Start the stream; returns the ``StreamingQuery``.

    ``checkpoint_location`` must be on shared storage on a cluster. ``delay``
    (for instance "10 minutes") sells in event time, see above."""
    store = TableStore(spark, store_root)
    reader = spark.readStream.schema(CARTS).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(carts_dir)
    if delay:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        stream = hold_back(stream, delay)
    # a micro-batch is read several times, the state store's part must run once
    # and to its end, also for a batch that was published before
    whole = cut_lineage if delay else (lambda df: df)
    w = (stream.writeStream.foreachBatch(lambda df, bid: process_batch(store, whole(df), bid))
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
