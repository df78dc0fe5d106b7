"""A stream of NetFlow v9 and IPFIX datagrams decoded by the templates it announces, and scaled by the sampling rates it teaches.

Templates are state, and one exporter may send a third of everything, so an exporter's sets are dealt over slices: a data set goes to one
slice of its (exporter, domain); announcements go to all of them, as does the first and last use of a template in each idle time, taken
per Arrow batch before the shuffle. Every slice so knows every template and when it was last used, while bodies are spread. Sampling
rates are dealt out in the same way, as the last word of each set.

Sources must deliver arrival order across micro-batches, as landed files and topics do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftnet.operators import datagrams, flows

#: Slices that the sets of one (exporter, domain) are dealt over.
SLICES = 16
#: How long a late row may lag behind the newest one.
DELAY = "10 minutes"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ANNOUNCED, USED, DATA = 0, 1, 2
SET, RATE = 0, 1
_FIELD = np.dtype([("ie", "i4"), ("length", "i4"), ("pen", "i8")])


# -------------------------------------------------------------------------------------------------------------- layouts


def packed_fields(fields: Iterable[dict]) -> bytes:
    return np.array([(f["ie"], f["length"], f["pen"]) for f in fields], _FIELD).tobytes()


def _unpacked(layout: pa.Array) -> pa.Array:
    filled = layout.fill_null(b"").cast(pa.binary())
    _, offsets, values = filled.buffers()
    bounds = np.frombuffer(offsets, np.int32)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    data = values.to_pybytes()[bounds[0] : bounds[-1]] if values is not None else b""
    flat = np.frombuffer(data, _FIELD)
    columns = [pa.array(np.ascontiguousarray(flat[n])) for n in _FIELD.names]
    listed = pa.ListArray.from_arrays(pa.array(((bounds - bounds[0]) // _FIELD.itemsize).astype(np.int32)), pa.StructArray.from_arrays(columns, names=list(_FIELD.names)))
    return pa.compute.if_else(layout.is_valid(), listed, pa.scalar(None, listed.type)) if layout.null_count else listed


@F.arrow_udf(T.ArrayType(datagrams._FIELD))
def unpacked_fields(layout: pa.Array) -> pa.Array:
    """Layouts as :func:`datagrams.templates` gives them, of packed ones."""
    return _unpacked(layout)


# -------------------------------------------------------------------------------------------------------------- routing


def _announcements(sets: pa.Table) -> tuple[list[int], list[int], list[bytes], list[bool]]:
    """Row, template id, layout and kind of every usable template in the template sets among ``sets``."""
    rows, ids, layouts, options, known = [], [], [], [], {}
    version, set_id, body = (sets.column(n).to_pylist() for n in ("version", "set_id", "body"))
    for row, (v, s, data) in enumerate(zip(version, set_id, body)):
        plain, with_scope = (0, 1) if v == datagrams.VERSION_V9 else (2, 3)
        if s not in (plain, with_scope):
            continue
        key = (v, s, data)
        if key not in known:
            parsed = datagrams._template_set(data, v, s == with_scope)["templates"]
            known[key] = [(t["template_id"], packed_fields(t["fields"])) for t in parsed if sum(f["length"] for f in t["fields"])]
        for template_id, layout in known[key]:
            rows.append(row)
            ids.append(template_id)
            layouts.append(layout)
            options.append(s == with_scope)
    return rows, ids, layouts, options


def _ends_of_use(touches: pd.DataFrame, idle: int) -> pd.DataFrame:
    """First and last of the touches of a template in each idle time: a longer gap never lies inside one."""
    keys = ["exporter", "domain", "template_id", touches["recv_ts"] // idle]
    ordered = touches.sort_values("set_order").groupby(keys, dropna=False, sort=False)
    ends = pd.concat([ordered.head(1), ordered.tail(1)])
    return ends.drop_duplicates(["exporter", "domain", "template_id", "set_order"])


def routed(sets: DataFrame, *, slices: int, idle_seconds: float) -> DataFrame:
    """Sets as rows for the slices: announcements and ends of use for all slices, data sets for one."""
    idle = int(idle_seconds * 1_000_000)
    context = [f for f in sets.schema.fields if f.name not in ("set_id", "body")]
    added = "template_id int, body binary, layout binary, is_options boolean, kind int, slice int"
    schema = T.StructType([*context, *T.StructType.fromDDL(added).fields])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            set_id = table.column("set_id").to_numpy()
            is_data = set_id >= datagrams.FIRST_DATA_SET
            data = table.filter(pa.array(is_data))
            n = data.num_rows
            own = {f.name: data.column(f.name) for f in context} | {
                "template_id": data.column("set_id").cast(pa.int32()),
                "body": data.column("body"),
                "layout": pa.nulls(n, pa.binary()),
                "is_options": pa.nulls(n, pa.bool_()),
                "kind": pa.array(np.full(n, DATA, np.int32)),
                "slice": pa.array((data.column("arrival_no").to_numpy() % slices).astype(np.int32)),
            }
            yield from pa.table(own).combine_chunks().to_batches()

            told = table.filter(pa.array(~is_data))
            rows, ids, layouts, options = _announcements(told)
            facts = told.take(pa.array(rows, pa.int64()))
            micros = lambda t: t.column("recv_ts").cast(pa.int64()).to_numpy()
            heads = [
                pd.DataFrame({"exporter": t.column("exporter").to_pylist(), "domain": t.column("domain").to_numpy(), "template_id": i, "recv_ts": micros(t), "set_order": t.column("set_order").to_numpy()})
                for t, i in ((data, set_id[is_data]), (facts, np.array(ids, np.int64)))
            ]
            used = _ends_of_use(pd.concat(heads, ignore_index=True), idle)
            for kind, part in ((ANNOUNCED, heads[1].assign(layout=layouts, is_options=options)), (USED, used.assign(layout=None, is_options=None))):
                if not len(part):
                    continue
                copies = part.loc[part.index.repeat(slices)]
                given = {
                    "exporter": pa.array(copies["exporter"], pa.string()), "domain": pa.array(copies["domain"], pa.int64()),
                    "recv_ts": pa.array(copies["recv_ts"].to_numpy(), pa.int64()).cast(batch.schema.field("recv_ts").type),
                    "set_order": pa.array(copies["set_order"], pa.int64()), "arrival_no": pa.array(copies["set_order"] // datagrams.SETS_PER_DATAGRAM, pa.int64()),
                    "template_id": pa.array(copies["template_id"], pa.int32()), "layout": pa.array(copies["layout"], pa.binary()), "is_options": pa.array(copies["is_options"], pa.bool_()),
                    "kind": pa.array(np.full(len(copies), kind, np.int32)), "slice": pa.array(np.tile(np.arange(slices, dtype=np.int32), len(part))),
                }
                absent = {f.name: pa.nulls(len(copies), batch.schema.field(f.name).type) for f in context if f.name not in given}
                absent["body"] = pa.nulls(len(copies), pa.binary())
                columns = given | absent
                yield pa.record_batch({f.name: columns[f.name] for f in schema.fields})

    return sets.mapInArrow(deal, schema)


# ---------------------------------------------------------------------------------------------------------------- state


class Templates(StatefulProcessor):
    """The live templates of one slice of an (exporter, domain): layout, kind and last use of each.

    A template that was neither announced nor used for the idle time is dead until it is announced again. A timer takes dead ones out of
    the state, so that it holds what lives.
    """

    def __init__(self, columns: list[str], idle_seconds: float):
        self.columns, self.idle = columns, int(idle_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "template_id int", "layout binary, is_options boolean, touched long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["set_order", "kind"], kind="stable", ignore_index=True)
        frame["_now"] = frame["recv_ts"].to_numpy(dtype="datetime64[us]").astype("int64")
        latest = 0
        for template_id, part in frame.groupby("template_id"):
            of = (int(template_id),)
            layout, is_options, touched = self.live.getValue(of) or (None, False, None)
            now, kind = part["_now"].to_numpy(), part["kind"].to_numpy()
            before = np.concatenate([[now[0] if touched is None else touched], now[:-1]])
            # what holds from each row on: an announcement, or nothing after too long a silence
            changes = (kind == ANNOUNCED) | (now - before > self.idle)
            since = np.maximum.accumulate(np.where(changes, np.arange(len(part)), -1))
            layouts = [bytes(v) if k == ANNOUNCED else None for v, k in zip(part["layout"], kind)]
            options = part["is_options"].tolist()
            data = np.flatnonzero(kind == DATA)
            frame.loc[part.index[data], "layout"] = pd.Series([layout if since[i] < 0 else layouts[since[i]] for i in data], index=part.index[data], dtype=object)
            frame.loc[part.index[data], "is_options"] = pd.Series([bool(is_options if since[i] < 0 else options[since[i]]) for i in data], index=part.index[data], dtype=object)
            last = since[-1]
            layout, is_options = (layout, is_options) if last < 0 else (layouts[last], options[last])
            if layout is None:
                self.live.removeKey(of)
            else:
                self.live.updateValue(of, (layout, bool(is_options), int(now[-1])))
                latest = max(latest, int(now[-1]))
        if latest and not list(self.handle.listTimers()):
            self.handle.registerTimer((latest + self.idle) // 1000 + 1)
        out = frame[frame["kind"] == DATA]
        yield out[self.columns].assign(is_options=[v is True or v == 1 for v in out["is_options"]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        alive = []
        for of, (_, _, touched) in list(self.live.iterator()):
            if touched + self.idle < passed:
                self.live.removeKey(of)
            else:
                alive.append(touched)
        if alive:
            self.handle.registerTimer((min(alive) + self.idle) // 1000 + 1)
        yield from ()

    def close(self) -> None:
        pass


def _matched(captured: DataFrame, slices: int, idle_seconds: float, delay: str) -> DataFrame:
    """Data sets with the packed ``layout`` of their template."""
    captured.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    sets = datagrams.sets(datagrams.framed(captured))
    dealt = routed(sets, slices=slices, idle_seconds=idle_seconds).withWatermark("recv_ts", delay)
    fields = [f for f in dealt.schema.fields if f.name not in ("kind", "slice")]
    names = [f.name for f in fields]
    return dealt.groupBy("exporter", "domain", "slice").transformWithStateInPandas(
        Templates(names, idle_seconds), outputStructType=T.StructType(fields), outputMode="Append", timeMode="EventTime"
    )


def _with_fields(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fields", unpacked_fields("layout")).withColumn("event", F.when(F.col("layout").isNull(), "data_before_template")).drop("layout")


def matched_sets(
    captured: DataFrame, *, slices: int = SLICES, idle_seconds: float = datagrams.TEMPLATE_IDLE_SECONDS, delay: str = DELAY
) -> DataFrame:
    """The streaming form of :func:`datagrams.with_templates` over the sets of captured datagrams: data sets with their template."""
    return _with_fields(_matched(captured, slices, idle_seconds, delay))


def records(captured: DataFrame, **options) -> DataFrame:
    """Data records of a stream of datagrams, as :func:`datagrams.records` gives them."""
    return datagrams.records(matched_sets(captured, **options))


# --------------------------------------------------------------------------------------------------------------- rates

_TOLD = ["sampler_id", "interval_34", "random_50", "interval_305", "space_306"]


def _taught(batch: pa.RecordBatch, fields: pa.Array) -> pd.DataFrame:
    """(row, sampler, rate): what each set teaches, by :func:`flows.options_rate` or by element 34 in data; sampler -1 is the domain."""
    found = []
    for row, number, columns in datagrams.cut_columns(batch.column("body"), fields, _TOLD):
        told = pd.DataFrame({name: columns[name].to_pandas(integer_object_nulls=True) for name in _TOLD}, dtype="object").assign(row=row, number=number)
        found.append(told.loc[told[_TOLD[1:]].notna().any(axis=1)])
    told = pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=[*_TOLD, "row", "number"])
    options = batch.column("is_options").to_numpy(zero_copy_only=False)[told["row"].to_numpy(dtype=np.int64)].astype(bool)

    def rate(sampler, plain, random, interval, space) -> int | None:
        if interval is not None:
            return (interval + space) // interval if space is not None and interval > 0 else interval
        return random if random is not None else plain

    values = told[_TOLD].astype(object).where(told[_TOLD].notna(), None).itertuples(index=False, name=None)
    rates = [rate(*v) if with_scope else v[1] for v, with_scope in zip(values, options)]
    told["rate"] = [r if r is not None and 1 <= r <= flows.MAX_RATE else 0 for r in rates]
    told["sampler"] = np.where(options, told["sampler_id"].where(told["sampler_id"].notna(), -1), -1).astype(np.int64)
    told = told[told["rate"] > 0].sort_values(["row", "number"], kind="stable")
    # only the last word of a set on each sampler counts for later sets
    return told.drop_duplicates(["row", "sampler"], keep="last")[["row", "sampler", "rate"]].astype(np.int64)


def _rates_routed(matched: DataFrame, slices: int) -> DataFrame:
    """Data sets for one slice each, and what sets teach for all slices of their (exporter, domain)."""
    context = list(matched.schema.fields)
    schema = T.StructType([*context, *T.StructType.fromDDL("kind int, slice int, sampler long, rate long").fields])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.compute.and_(pa.compute.invert(batch.column("is_options")), batch.column("layout").is_valid()))
            n = own.num_rows
            added = {
                "kind": pa.array(np.full(n, SET, np.int32)), "slice": pa.array((own.column("arrival_no").to_numpy() % slices).astype(np.int32)),
                "sampler": pa.array(np.zeros(n, np.int64)), "rate": pa.array(np.zeros(n, np.int64)),
            }
            yield pa.record_batch({f.name: own.column(f.name) for f in context} | added)

            usable = batch.filter(batch.column("layout").is_valid())
            told = _taught(usable, _unpacked(usable.column("layout")))
            if not len(told):
                continue
            heads = pd.DataFrame({n: usable.column(n).to_pylist() for n in ("exporter", "domain", "set_order", "arrival_no")}).iloc[told["row"]].reset_index(drop=True)
            heads["sampler"], heads["rate"] = told["sampler"].to_numpy(), told["rate"].to_numpy()
            # repeats stay: another batch may hold sets between these
            copies = heads.loc[heads.index.repeat(slices)]
            given = {n: pa.array(copies[n], usable.schema.field(n).type) for n in ("exporter", "domain", "set_order", "arrival_no")}
            given |= {
                "is_options": pa.array(np.zeros(len(copies), bool)), "kind": pa.array(np.full(len(copies), RATE, np.int32)),
                "slice": pa.array(np.tile(np.arange(slices, dtype=np.int32), len(heads))), "sampler": pa.array(copies["sampler"].to_numpy()), "rate": pa.array(copies["rate"].to_numpy()),
            }
            yield pa.record_batch({f.name: given[f.name] if f.name in given else pa.nulls(len(copies), usable.schema.field(f.name).type) for f in schema.fields})

    return matched.mapInArrow(deal, schema)


class Rates(StatefulProcessor):
    """The sampling rates of one slice of an (exporter, domain): of each sampler, and of the domain under -1."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rates = handle.getMapState("rates", "sampler long", "rate long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # what a set teaches holds for the sets behind it
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["set_order", "kind"], kind="stable", ignore_index=True)
        known = {int(s): int(r) for (s,), (r,) in self.rates.iterator()}
        told = frame["kind"].to_numpy() == RATE
        domain, samplers, written = [], [], set()
        text = None
        for is_rate, sampler, rate in zip(told, frame["sampler"].tolist(), frame["rate"].tolist()):
            if is_rate:
                known[int(sampler)] = int(rate)
                written.add(int(sampler))
                text = None
            elif text is None:
                text = ",".join(f"{s}:{r}" for s, r in sorted(known.items()) if s >= 0)
            domain.append(known.get(-1, 0))
            samplers.append(text)
        for sampler in written:
            self.rates.updateValue((sampler,), (known[sampler],))
        out = frame.assign(domain_rate=np.array(domain, np.int64), sampler_rates=samplers)[~told]
        yield out[self.columns]

    def close(self) -> None:
        pass


def template_flows(
    captured: DataFrame, overrides: DataFrame | None = None, *, slices: int = SLICES, idle_seconds: float = datagrams.TEMPLATE_IDLE_SECONDS, delay: str = DELAY
) -> DataFrame:
    """The streaming form of :func:`siftnet.plans.flows.template_flows`: datagrams to flows, with templates and rates learned on the way."""
    dealt = _rates_routed(_matched(captured, slices, idle_seconds, delay), slices)
    fields = [f for f in dealt.schema.fields if f.name not in ("kind", "slice", "sampler", "rate")]
    output = T.StructType([*fields, T.StructField("domain_rate", T.LongType()), T.StructField("sampler_rates", T.StringType())])
    entered = dealt.groupBy("exporter", "domain", "slice").transformWithStateInPandas(
        Rates([f.name for f in output.fields]), outputStructType=output, outputMode="Append", timeMode="None"
    )
    cut = datagrams.records(_with_fields(entered), so_far=("interval_34", flows.MAX_RATE))
    of_sampler = F.try_element_at(F.str_to_map("sampler_rates", F.lit(","), F.lit(":")), F.col("sampler_id").cast("string")).try_cast("bigint")
    of_domain = F.nullif("domain_rate", F.lit(0).cast("bigint"))
    rates = [of_sampler, F.col("interval_34_so_far"), of_domain, F.lit(1)]
    if overrides is not None:
        cut = cut.join(overrides.select("exporter", F.col("rate").alias("_override")), "exporter", "left")
        rates.insert(0, F.col("_override"))
    rated = cut.withColumn("sampling_rate", F.coalesce(*rates).cast("bigint"))
    return flows.template_flows(rated.drop("domain_rate", "sampler_rates", "interval_34_so_far", "_override"))
