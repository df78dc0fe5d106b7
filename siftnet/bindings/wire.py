"""Flow datagrams built from the order lines with Spark expressions and decoded again; the lines are the oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftnet.bindings.registry import EVENTS_SQL, events, query, table
from siftnet.operators import datagrams, flows, segments, sequence, sflow
from siftnet.plans import flows as plan
from siftnet.session import checkpointed

IP10, IP11 = 10 * 2**24, 11 * 2**24


def b(expr: str, width: int) -> str:
    """SQL text: a number as big-endian bytes."""
    return f"unhex(lpad(hex(cast({expr} as bigint)), {2 * width}, '0'))"


def packed(*parts: tuple[str, int]) -> str:
    return "concat(" + ", ".join(b(e, w) for e, w in parts) + ")"


def digits(*parts: tuple[str, int]) -> str:
    """SQL text: the bytes of numbers (or texts, of width 0) as one hex text. Neighbours of eight bytes together are made as one number:
    a conversion for each field would cost more than all the rest of a payload."""
    words: list[list[tuple[str, int]]] = []
    for part in parts:
        if words and part[1] and words[-1][-1][1] and sum(width for _, width in words[-1]) + part[1] <= 8:
            words[-1].append(part)
        else:
            words.append([part])

    def written(word: list[tuple[str, int]]) -> str:
        if not word[0][1]:
            return f"hex({word[0][0]})"
        total, terms = sum(width for _, width in word), []
        left = total
        for expr, width in word:
            left -= width
            terms.append(f"shiftleft(cast({expr} as bigint), {8 * left})" if left else f"cast({expr} as bigint)")
        return f"lpad(hex({' | '.join(terms)}), {2 * total}, '0')"

    return "concat(" + ", ".join(written(word) for word in words) + ")"


def dotted(expr: str) -> str:
    return f"((({expr}) // 16777216) || '.' || (({expr}) // 65536 % 256) || '.' || (({expr}) // 256 % 256) || '.' || (({expr}) % 256))"


def landed(rows):
    """Payloads as a landed table holds them: values, not the expressions that made them. Without this step the
    optimizer would copy the making of a payload into every filter on it, and every pass over the table would make it anew."""
    return checkpointed(rows)


def by_order(lines, *, block="l_orderkey"):
    """Lines dealt by order (or by the ``block`` of orders) while they are still a few numbers: the bytes made of them are several times as large and stay in
    the task that makes them, because grouping by order needs no other shuffle. The number of partitions is given: joined to the size of
    the numbers, they would be too large for the bytes, and the grouping would spill."""
    return lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), block)


def joined(parts):
    """Byte strings of a short list in one."""
    return F.aggregate(parts, F.unhex(F.lit("")), lambda total, part: F.concat(total, part))


# --------------------------------------------------------------------------------------------------------------- v5

UPTIME = 4_000_000_000


def v5_datagrams(spark, sf_dir, chosen="true"):
    """One datagram per order (of those ``chosen`` by key), one record per line; every second header claims a record too many."""
    record = packed(
        (f"{IP10} + l_partkey", 4),
        (f"{IP11} + l_suppkey", 4),
        (f"if(l_linestatus = 'F', 0, {IP10} + 1)", 4),
        ("l_linenumber", 2),
        ("l_suppkey % 65536", 2),
        ("floor(l_quantity)", 4),
        ("floor(l_extendedprice)", 4),
        (f"{UPTIME} - l_partkey * 1000 - 5000", 4),
        (f"{UPTIME} - l_suppkey * 100", 4),
        ("l_partkey % 65536", 2),
        ("l_linenumber * 256 + 3", 2),
        ("0", 1),
        ("l_linenumber", 1),
        ("case l_returnflag when 'A' then 1 when 'N' then 6 else 17 end", 1),
        ("l_linenumber * 4", 1),
        ("l_partkey % 65536", 2),
        ("l_suppkey % 65536", 2),
        ("0", 4),
    )
    header = packed(
        ("5", 2),
        ("n + l_orderkey % 2", 2),
        (str(UPTIME), 4),
        ("1000000000 + l_orderkey", 4),
        ("500000000", 4),
        ("l_orderkey * 3 % 4294967296", 4),
        ("l_orderkey % 4", 2),
        ("16384 + l_orderkey % 3", 2),
    )
    lines = by_order(table(spark, sf_dir, "lineitem").where(chosen)).select("l_orderkey", F.expr(record).alias("r"))
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("rs"), F.count("*").alias("n"))
    seconds = F.expr("1000000002 + l_orderkey + if(l_orderkey % 10 = 0, 3600, 0)")
    return orders.select(
        F.col("l_orderkey").alias("arrival_no"),
        F.timestamp_seconds(seconds).alias("recv_ts"),
        F.concat(F.lit("192.0.2."), (F.col("l_orderkey") % 20).cast("string")).alias("exporter"),
        F.concat(F.expr(header), joined(F.col("rs"))).alias("payload"),
    )


_V5_SQL = f"""WITH l AS (
  SELECT *, 1000000000000 + l_orderkey * 1000 + 500 AS export_ms, greatest(l_orderkey % 3, 1) AS rate, l_returnflag = 'A' AS icmp,
    1000000002000 + l_orderkey * 1000 + CASE WHEN l_orderkey % 10 = 0 THEN 3600000 ELSE 0 END AS recv_ms FROM lineitem),
t AS (SELECT *, export_ms - l_suppkey * 100 AS end0, l_partkey * 1000 + 5000 - l_suppkey * 100 AS raw_duration FROM l),
d AS (SELECT *, CASE WHEN raw_duration < 0 THEN raw_duration + 4294967296 ELSE raw_duration END AS duration,
        CASE WHEN abs(end0 - recv_ms) > 900000 THEN recv_ms ELSE end0 END AS end_ms FROM t)
"""


@query(
    "netflow_v5_flows",
    _V5_SQL
    + f"""SELECT '192.0.2.' || (l_orderkey % 20) AS sampler_address, l_orderkey * 3 % 4294967296 AS sequence_number, rate AS sampling_rate,
  {dotted(f'{IP10} + l_partkey')} AS src_addr, {dotted(f'{IP11} + l_suppkey')} AS dst_addr,
  CASE WHEN l_linestatus <> 'F' THEN '10.0.0.1' END AS next_hop,
  CASE WHEN icmp THEN 0 ELSE l_partkey % 65536 END AS src_port, CASE WHEN icmp THEN 0 ELSE l_linenumber * 256 + 3 END AS dst_port,
  CASE WHEN icmp THEN l_linenumber * 256 + 3 END AS icmp_type_code,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 6 ELSE 17 END AS protocol,
  CAST(floor(l_extendedprice) AS BIGINT) * rate AS bytes, CAST(floor(l_quantity) AS BIGINT) * rate AS packets,
  l_linenumber AS input_if_index, l_suppkey % 65536 AS output_if_index, l_linenumber AS tcp_flags, l_linenumber * 4 AS tos,
  l_partkey % 65536 AS src_as, l_suppkey % 65536 AS dst_as,
  (CASE WHEN duration BETWEEN 0 AND 86400000 THEN end_ms - duration ELSE end_ms END) * 1000 AS start_us, end_ms * 1000 AS end_us FROM d""",
)
def netflow_v5_flows(spark, sf_dir):
    rows = plan.v5_flows(v5_datagrams(spark, sf_dir))
    return rows.select(
        "sampler_address", "sequence_number", "sampling_rate", "src_addr", "dst_addr", "next_hop", "src_port", "dst_port",
        "icmp_type_code", "protocol", "bytes", "packets", "input_if_index", "output_if_index", "tcp_flags", "tos", "src_as",
        "dst_as", F.unix_micros("flow_start").alias("start_us"), F.unix_micros("flow_end").alias("end_us"),
    )


@query(
    "netflow_v5_events",
    "SELECT DISTINCT l_orderkey AS arrival_no, 'malformed' AS event FROM lineitem WHERE l_orderkey % 2 = 1",
)
def netflow_v5_events(spark, sf_dir):
    return datagrams.v5_headers(v5_datagrams(spark, sf_dir)).where("event is not null").select("arrival_no", "event")


@query(
    "datagram_dispatch",
    """SELECT o_orderkey AS arrival_no, CASE o_orderkey % 6 WHEN 0 THEN 5 WHEN 1 THEN 9 WHEN 2 THEN 10 END AS version,
  CASE o_orderkey % 6 WHEN 3 THEN 'unknown_version' WHEN 4 THEN 'unknown_version' WHEN 5 THEN 'malformed' END AS event FROM orders""",
)
def datagram_dispatch(spark, sf_dir):
    payload = F.expr(
        f"case o_orderkey % 6 when 0 then {b('5', 2)} when 1 then {b('9', 2)} when 2 then {packed(('10', 2), ('o_orderkey', 8))} "
        f"when 3 then {b('7', 2)} when 4 then {b('o_orderkey % 1000 + 256', 2)} else {b('5', 1)} end"
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arrival_no"), payload.alias("payload"))
    return datagrams.dispatch(rows).select("arrival_no", "version", "event")


# ------------------------------------------------------------------------------------------------------ v9 and IPFIX

# Two layouts of template 300, as (element, length, enterprise) in wire order.
LAYOUTS = {
    0: [(8, 4, 0), (12, 4, 0), (1, 4, 0), (2, 4, 0), (7, 2, 0), (11, 2, 0), (4, 1, 0), (34, 4, 0), (152, 8, 0), (153, 8, 0), (9999, 3, 0)],
    1: [(153, 8, 0), (4, 1, 0), (12, 4, 0), (8, 4, 0), (9999, 3, 0), (34, 2, 0), (152, 8, 0), (7, 2, 0), (11, 4, 0), (2, 8, 0), (1, 8, 0)],
}
VALUES = {
    8: f"{IP10} + o_custkey",
    12: f"{IP11} + o_orderkey % 65536",
    1: "floor(o_totalprice)",
    2: "o_custkey + 1",
    7: "o_orderkey % 65536",
    11: "443",
    4: "6",
    34: "if(o_custkey % 4 = 0, o_custkey % 100, 0)",
    152: "1000000000000 + o_orderkey * 1000",
    153: "1000000001500 + o_orderkey * 1000",
    9999: "7",
}


def template_datagrams(spark, sf_dir, chosen="true"):
    """One datagram per order with one data record. Urgent orders announce the layout that their exporter uses from
    then on; even exporters speak v9, odd ones IPFIX."""
    o = table(spark, sf_dir, "orders").where(chosen).select(
        F.col("o_orderkey").alias("arrival_no"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
        (F.col("o_custkey") % 25).alias("exporter_no"),
    )
    announced = F.expr("if(o_orderpriority = '1-URGENT', o_orderkey % 2, null)")
    laid = segments.finish(segments.scan(o, ["exporter_no"], "arrival_no", last={"layout": announced}))

    def record(layout: int) -> str:
        return packed(*[(VALUES[ie], length) for ie, length, _ in LAYOUTS[layout]])

    def template(layout: int) -> str:
        fields = [(str(v), 2) for ie, length, _ in LAYOUTS[layout] for v in (ie, length)]
        return packed(("300", 2), (str(len(LAYOUTS[layout])), 2), *fields)

    data = F.expr(f"if(coalesce(layout, 0) = 0, {record(0)}, {record(1)})")
    templates = F.expr(f"if(o_orderpriority = '1-URGENT', if(o_orderkey % 2 = 0, {template(0)}, {template(1)}), null)")
    rows = laid.withColumn("d", data).withColumn("t", templates)
    set_bytes = {
        kind: f"concat({b(code, 2)}, {b(f'length({body}) + 4', 2)}, {body})"
        for kind, code, body in (("t", "if(exporter_no % 2 = 0, 0, 2)", "t"), ("d", "300", "d"))
    }
    body = F.expr(f"concat(coalesce({set_bytes['t']}, unhex('')), {set_bytes['d']})")
    rows = rows.withColumn("body", body)
    v9 = packed(("9", 2), ("1", 2), ("100000", 4), ("1000000002 + o_orderkey", 4), ("o_orderkey", 4), ("0", 4))
    ipfix = packed(("10", 2), ("length(body) + 16", 2), ("1000000002 + o_orderkey", 4), ("o_orderkey", 4), ("0", 4))
    made = rows.select(
        "arrival_no",
        F.timestamp_seconds(F.col("o_orderkey") + 1000000002).alias("recv_ts"),
        F.concat(F.lit("198.51.100."), F.col("exporter_no").cast("string")).alias("exporter"),
        F.expr(f"concat(if(exporter_no % 2 = 0, {v9}, {ipfix}), body)").alias("payload"),
    )
    return landed(made)


_TEMPLATE_SQL = """WITH o AS (
  SELECT *, o_custkey % 25 AS x, count(*) FILTER (o_orderpriority = '1-URGENT') OVER w AS announced
  FROM orders WINDOW w AS (PARTITION BY o_custkey % 25 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)),
d AS (SELECT * FROM o WHERE announced > 0),
r AS (SELECT *, coalesce(last_value(CASE WHEN o_custkey % 4 = 0 AND o_custkey % 100 > 0 THEN o_custkey % 100 END IGNORE NULLS)
  OVER (PARTITION BY x ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 1) AS rate FROM d)
"""


@query(
    "template_based_flows",
    _TEMPLATE_SQL
    + f"""SELECT o_orderkey AS arrival_no, '198.51.100.' || x AS sampler_address, CASE WHEN x % 2 = 0 THEN 2 ELSE 3 END AS flow_source, rate AS sampling_rate,
  {dotted(f'{IP10} + o_custkey')} AS src_addr, {dotted(f'{IP11} + o_orderkey % 65536')} AS dst_addr, o_orderkey % 65536 AS src_port, 443 AS dst_port, 6 AS protocol,
  CAST(floor(o_totalprice) AS BIGINT) * rate AS bytes, (o_custkey + 1) * rate AS packets,
  (1000000000000 + o_orderkey * 1000) * 1000 AS start_us, (1000000001500 + o_orderkey * 1000) * 1000 AS end_us FROM r""",
)
def template_based_flows(spark, sf_dir):
    rows = plan.template_flows(template_datagrams(spark, sf_dir))
    return rows.select(
        "arrival_no", "sampler_address", "flow_source", "sampling_rate", "src_addr", "dst_addr", "src_port", "dst_port", "protocol",
        "bytes", "packets", F.unix_micros("flow_start").alias("start_us"), F.unix_micros("flow_end").alias("end_us"),
    )


@query("data_before_template", _TEMPLATE_SQL + "SELECT o_orderkey AS arrival_no, 'data_before_template' AS event FROM o WHERE announced = 0")
def data_before_template(spark, sf_dir):
    decoded = plan.decoded_template_sets(template_datagrams(spark, sf_dir))
    return decoded.where("event is not null").select("arrival_no", "event")


@query(
    "announced_templates",
    """SELECT o_orderkey AS arrival_no, 300 AS template_id, 11 AS field_count, CASE WHEN o_orderkey % 2 = 0 THEN 44 ELSE 52 END AS min_length, CAST(NULL AS VARCHAR) AS verdict
FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def announced_templates(spark, sf_dir):
    sets = datagrams.sets(datagrams.framed(template_datagrams(spark, sf_dir)))
    return datagrams.templates(sets).select(
        "arrival_no", "template_id", F.size("fields").alias("field_count"),
        datagrams.min_record_length(F.col("fields")).alias("min_length"), "verdict",
    )


@query(
    "template_verdicts",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 5 = 0 THEN 'template_zero_min_len' WHEN l_suppkey % 5 = 1 OR l_suppkey % 5 = 3 THEN 'template_quarantined' END AS verdict,
  CASE l_suppkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 65 WHEN 2 THEN 1 WHEN 3 THEN 64 * 33 ELSE 4 + l_linenumber END AS min_length FROM lineitem""",
)
def template_verdicts(spark, sf_dir):
    def field(length: str) -> str:
        return f"struct(1 as ie, cast({length} as int) as length, 0L as pen)"

    layouts = (
        f"case l_suppkey % 5 when 0 then array({field('0')}) when 1 then array({field('65')}) when 2 then array({field('65535')}) "
        f"when 3 then array_repeat({field('64')}, 33) else array({field('4')}, {field('l_linenumber')}) end"
    )
    rows = table(spark, sf_dir, "lineitem").withColumn("fields", F.expr(layouts))
    return rows.select(
        "l_orderkey", "l_linenumber", datagrams.template_verdict(F.col("fields")).alias("verdict"),
        datagrams.min_record_length(F.col("fields")).alias("min_length"),
    )


@query(
    "template_cap",
    """SELECT s_nationkey AS domain, s_suppkey AS template_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) % 4 <> 0 AS admitted FROM supplier""",
)
def template_cap(spark, sf_dir):
    """Each domain announces a template every ten minutes; three live at once, and every fourth finds no room."""
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumn("n", F.row_number().over(order)).select(
        F.lit("e").alias("exporter"), F.col("s_nationkey").alias("domain"), F.col("s_suppkey").alias("template_id"),
        (F.col("n") * 1000 + F.col("s_nationkey")).cast("bigint").alias("set_order"), F.timestamp_seconds(F.col("n") * 600).alias("recv_ts"),
        F.lit(None).cast("string").alias("verdict"),
    )
    admitted = datagrams.capped_templates(s, cap=3)
    return admitted.select("domain", "template_id", "admitted")


@query(
    "template_sequence_loss",
    _TEMPLATE_SQL.rstrip()
    + """, h AS (SELECT *, x % 2 = 0 AS v9, x % 2 = 0 OR announced > 0 AS countable FROM o),
b AS (SELECT *, lag(o_orderkey) OVER w AS before, lag(countable) OVER w AS counted, (o_orderkey - lag(o_orderkey) OVER w - 1 + 4294967296) % 4294967296 AS delta
  FROM h WINDOW w AS (PARTITION BY x ORDER BY o_orderkey)),
e AS (SELECT *, CASE WHEN before IS NOT NULL AND counted AND delta > 0 THEN CASE WHEN delta >= 16777216 THEN 'seq_resync' ELSE 'seq_gap' END END AS event FROM b)
SELECT o_orderkey AS arrival_no, '198.51.100.' || x AS exporter, CASE WHEN v9 THEN 9 ELSE 10 END AS version, event, CASE WHEN event = 'seq_gap' THEN delta ELSE 0 END AS lost_units FROM e""",
)
def template_sequence_loss(spark, sf_dir):
    """Export loss from real headers: v9 counts datagrams, IPFIX the records that its templates let through."""
    captured = template_datagrams(spark, sf_dir)
    headers = datagrams.export_headers(datagrams.framed(captured, bodies=False), plan.decoded_template_sets(captured))
    return sequence.sequence_events(headers).select("arrival_no", "exporter", "version", "event", "lost_units")


# Fields of a wide layout per protocol, as (element, enterprise, length, parts of the value): nearly every element that is mapped.
V6_HEAD = ("2306139568115548160", 8)
WIDE = {
    9: [
        (27, 0, 16, [V6_HEAD, ("l_partkey % 65535 + 1", 8)]), (28, 0, 16, [V6_HEAD, ("l_suppkey % 65535 + 1", 8)]), (1, 0, 4, [("l_partkey", 4)]),
        (2, 0, 4, [("l_suppkey", 4)]), (4, 0, 1, [("6", 1)]), (5, 0, 1, [("l_linenumber * 4", 1)]), (6, 0, 1, [("18", 1)]), (7, 0, 2, [("l_partkey % 65536", 2)]),
        (11, 0, 2, [("l_linenumber + 8000", 2)]), (10, 0, 2, [("l_linenumber", 2)]), (14, 0, 4, [("l_suppkey", 4)]), (62, 0, 16, [V6_HEAD, ("9", 8)]),
        (16, 0, 4, [("l_partkey", 4)]), (17, 0, 4, [("l_suppkey", 4)]), (22, 0, 4, [("100000 - l_linenumber * 50", 4)]), (21, 0, 4, [("100000 - l_linenumber * 10", 4)]),
        (23, 0, 8, [("l_partkey * 2", 8)]), (24, 0, 3, [("l_suppkey * 2", 3)]), (58, 0, 2, [("l_linenumber", 2)]), (59, 0, 2, [("l_linenumber + 100", 2)]),
        (136, 0, 1, [("l_linenumber % 5", 1)]), (225, 0, 4, [(f"{IP10} + 1", 4)]), (226, 0, 4, [(f"{IP10} + 2", 4)]), (40003, 0, 2, [("l_linenumber + 1", 2)]),
        (228, 0, 2, [("l_linenumber + 2", 2)]), (233, 0, 1, [("1", 1)]), (9999, 0, 3, [("7", 3)]), (56701, 0, 12, [("concat('app', l_linenumber)", 0), ("0", 8)]),
    ],
    10: [
        (8, 0, 4, [(f"{IP10} + l_partkey", 4)]), (82, 0, 65535, [("if(l_suppkey % 3 = 0, 255, l_linenumber)", 1), ("if(l_suppkey % 3 = 0, 300, null)", 2), ("if(l_suppkey % 3 = 0, repeat('x', 300), repeat('y', l_linenumber))", 0)]),
        (12, 0, 4, [(f"{IP11} + l_suppkey", 4)]), (231, 0, 8, [("floor(l_extendedprice)", 8)]), (1, 29305, 4, [("l_suppkey", 4)]), (2, 29305, 2, [("l_linenumber", 2)]),
        (4, 0, 1, [("if(l_returnflag = 'A', 1, 17)", 1)]), (7, 0, 2, [("l_partkey % 65536", 2)]), (11, 0, 2, [("53", 2)]), (32, 0, 2, [("771", 2)]), (15, 0, 4, [("if(l_linestatus = 'F', 0, 3405803777)", 4)]),
        (62, 0, 16, [("0", 8), ("0", 8)]), (281, 0, 16, [V6_HEAD, ("l_linenumber", 8)]), (282, 0, 4, [("1", 4)]), (150, 0, 4, [("1000000000 + l_orderkey", 4)]),
        (151, 0, 4, [("1000000001 + l_orderkey", 4)]), (227, 0, 2, [("l_linenumber", 2)]), (302, 0, 4, [("l_linenumber", 4)]), (2, 9, 4, [("99", 4)]),
    ],
}


#: Orders that are dealt together.
BLOCK = 1 << 10


def wide_datagrams(spark, sf_dir):
    """One datagram per order with its template and a record per line; even orders come as v9, odd ones as IPFIX."""

    def record(version: int) -> str:
        parts = [part for _, _, _, given in WIDE[version] for part in given]
        absent = [i for i, (expr, _) in enumerate(parts) if expr.endswith("null)")]
        cuts = [0, *(j for i in absent for j in (i, i + 1)), len(parts)]
        runs = [digits(*parts[a:z]) for a, z in zip(cuts, cuts[1:]) if a < z]
        return "concat(" + ", ".join(f"coalesce({run}, '')" for run in runs) + ")"

    def template(version: int) -> str:
        specs = [("300", 2), (str(len(WIDE[version])), 2)]
        for ie, enterprise, length, _ in WIDE[version]:
            specs += [(str(ie + (32768 if enterprise else 0)), 2), (str(length), 2)] + ([(str(enterprise), 4)] if enterprise else [])
        return digits(("0" if version == 9 else "2", 2), (str(4 + sum(width for _, width in specs)), 2), *specs)

    # a landed table holds runs of arrivals together, so what is found per key and time is reduced where it is read
    blocks = table(spark, sf_dir, "lineitem").withColumn("block", F.expr(f"l_orderkey div {BLOCK}"))
    lines = by_order(blocks, block="block").select("block", "l_orderkey", F.expr(f"unhex(if(l_orderkey % 2 = 0, {record(9)}, {record(10)}))").alias("r"))
    orders = lines.groupBy("block", "l_orderkey").agg(joined(F.sort_array(F.collect_list("r"))).alias("data"))
    rows = orders.select("l_orderkey", "data", F.expr("octet_length(data)").alias("size"))
    v9 = digits(("9", 2), ("1", 2), ("100000", 4), ("1000000002 + l_orderkey", 4), ("l_orderkey", 4), ("0", 4))
    whole = f"size + 4 + octet_length({template(10)}) div 2 + 16"
    ipfix = digits(("10", 2), (whole, 2), ("1000000002 + l_orderkey", 4), ("l_orderkey", 4), ("0", 4))
    head = f"if(l_orderkey % 2 = 0, concat({v9}, {template(9)}), concat({ipfix}, {template(10)}))"
    data_set = digits(("300", 2), ("size + 4", 2))
    made = rows.select(
        F.col("l_orderkey").alias("arrival_no"), F.timestamp_seconds(F.col("l_orderkey") + 1000000002).alias("recv_ts"),
        F.concat(F.lit("203.0.113."), (F.col("l_orderkey") % 10).cast("string")).alias("exporter"),
        F.expr(f"concat(unhex(concat({head}, {data_set})), data)").alias("payload"),
    )
    return landed(made)


@query(
    "wide_template_flows",
    f"""WITH l AS (SELECT *, l_orderkey % 2 = 0 AS v9, 1000000002000 + l_orderkey * 1000 AS ms, l_returnflag = 'A' AND l_orderkey % 2 = 1 AS icmp,
    '2001:db8::' || printf('%x', l_partkey % 65535 + 1) AS a6, '2001:db8::' || printf('%x', l_suppkey % 65535 + 1) AS b6,
    {dotted(f'{IP10} + l_partkey')} AS a4, {dotted(f'{IP11} + l_suppkey')} AS b4 FROM lineitem),
f AS (SELECT *, unnest([false, true]) AS r FROM l)
SELECT l_orderkey AS arrival_no, '203.0.113.' || (l_orderkey % 10) AS sampler_address, CASE WHEN v9 THEN 2 ELSE 3 END AS flow_source, r AS reverse,
  CASE WHEN v9 THEN CASE WHEN r THEN l_partkey * 2 ELSE l_partkey END WHEN r THEN l_suppkey ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS bytes,
  CASE WHEN v9 THEN CASE WHEN r THEN l_suppkey * 2 ELSE l_suppkey END WHEN r THEN l_linenumber ELSE 0 END AS packets,
  CASE WHEN v9 THEN CASE WHEN r THEN b6 ELSE a6 END WHEN r THEN b4 ELSE a4 END AS src_addr, CASE WHEN v9 THEN CASE WHEN r THEN a6 ELSE b6 END WHEN r THEN a4 ELSE b4 END AS dst_addr,
  CASE WHEN icmp THEN 0 WHEN r THEN CASE WHEN v9 THEN l_linenumber + 8000 ELSE 53 END ELSE l_partkey % 65536 END AS src_port,
  CASE WHEN icmp THEN 0 WHEN r THEN l_partkey % 65536 ELSE CASE WHEN v9 THEN l_linenumber + 8000 ELSE 53 END END AS dst_port,
  CASE WHEN icmp THEN 771 END AS icmp_type_code, CASE WHEN v9 THEN 6 WHEN icmp THEN 1 ELSE 17 END AS protocol,
  CASE WHEN v9 THEN 18 END AS tcp_flags, CASE WHEN v9 THEN l_linenumber * 4 END AS tos,
  CASE WHEN v9 THEN CASE WHEN r THEN l_suppkey ELSE l_linenumber END END AS input_if_index, CASE WHEN v9 THEN CASE WHEN r THEN l_suppkey ELSE l_partkey END END AS src_as,
  CASE WHEN v9 THEN CASE WHEN r THEN l_linenumber + 100 ELSE l_linenumber END END AS src_vlan,
  CASE WHEN v9 THEN '2001:db8::9' WHEN l_linestatus <> 'F' THEN '203.0.113.1' END AS next_hop,
  CASE WHEN v9 THEN CASE WHEN r THEN '10.0.0.2' ELSE '10.0.0.1' END WHEN NOT r THEN '2001:db8::' || l_linenumber END AS post_nat_src_addr,
  CASE WHEN v9 THEN CASE WHEN r THEN l_linenumber + 2 ELSE l_linenumber + 1 END WHEN NOT r THEN l_linenumber END AS post_nat_src_port,
  CASE WHEN v9 THEN 1 END AS firewall_event, CASE WHEN v9 THEN l_linenumber % 5 END AS flow_end_reason, CASE WHEN v9 THEN 'app' || l_linenumber END AS app_name,
  CASE WHEN v9 THEN ms - l_linenumber * 50 ELSE ms - 2000 END * 1000 AS start_us, CASE WHEN v9 THEN ms - l_linenumber * 10 ELSE ms - 1000 END * 1000 AS end_us FROM f""",
)
def wide_template_flows(spark, sf_dir):
    """Layouts of nearly every element: IPv6, translation, both directions, variable length, enterprise numbers, application names."""
    rows = plan.template_flows(wide_datagrams(spark, sf_dir))
    return rows.select(
        "arrival_no", "sampler_address", "flow_source", "reverse", "bytes", "packets", "src_addr", "dst_addr", "src_port", "dst_port", "icmp_type_code", "protocol",
        "tcp_flags", "tos", "input_if_index", "src_as", "src_vlan", "next_hop", "post_nat_src_addr", "post_nat_src_port", "firewall_event", "flow_end_reason", "app_name",
        F.unix_micros("flow_start").alias("start_us"), F.unix_micros("flow_end").alias("end_us"),
    )


# ------------------------------------------------------------------------------------------------------- semantics


def empty_records(rows, given: dict[str, str]):
    """Decoded records with the given columns and null elsewhere."""
    numbers = [c for c in datagrams.COLUMNS if datagrams.ELEMENTS.get(c, ("u",))[0] == "u"]
    columns = []
    for name in datagrams.COLUMNS:
        kind = "bigint" if name in numbers else "string"
        columns.append(F.expr(given.get(name, "null")).cast(kind).alias(name))
    return rows.select(*rows.columns, *columns)


def line_records(spark, sf_dir):
    """Counter families by line number: 1 deltas, 2 deltas with reverse, 3 out-counters only, 4 initiator and responder,
    5 responder only, 6 running totals, 7 flow updates."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        F.col("l_orderkey").alias("arrival_no"), F.col("l_orderkey").alias("set_order"), F.col("l_linenumber").alias("record_no"),
        F.lit("192.0.2.1").alias("exporter"), F.col("l_suppkey").alias("sequence"), F.lit(9).alias("version"),
        F.lit(False).alias("is_options"), (F.col("l_suppkey") % 5 + 1).alias("sampling_rate"),
        F.lit(0).cast("bigint").alias("uptime_ms"), F.lit(1000000000000).alias("export_ms"),
        F.timestamp_seconds(F.lit(1000000000)).alias("recv_ts"),
    )
    n = "l_linenumber"
    return empty_records(
        rows,
        {
            "fwd_bytes": f"if({n} in (1, 2, 7), l_partkey, null)",
            "fwd_packets": f"if({n} in (1, 2, 7), l_suppkey, null)",
            "out_bytes": f"if({n} in (2, 3), l_partkey * 2, null)",
            "out_packets": f"if({n} in (2, 3), l_suppkey * 2, null)",
            "initiator_bytes": f"if({n} = 4, l_partkey, null)",
            "responder_bytes": f"if({n} in (4, 5), l_suppkey, null)",
            "total_bytes": f"if({n} = 6, l_partkey, null)",
            "fw_event": f"if({n} = 7, 5, null)",
            "protocol": "case l_returnflag when 'A' then 1 when 'N' then 6 else 58 end",
            "icmp": "if(l_linestatus = 'F', 771, null)",
            "src_port": "l_partkey % 65536",
            "dst_port": "l_suppkey % 65536",
            "src_v4": "'10.0.0.1'",
            "src_v6": "if(l_linestatus = 'F', '2001:db8::1', null)",
            "dst_v4": "'10.0.0.2'",
            "in_if": "3",
            "out_if": "4",
            "src_as": "l_partkey",
            "dst_as": "l_suppkey",
            "nat_src": "'192.0.2.9'",
            "nat_src_port": "55",
            "app_name": "'web'",
        },
    )


_SEMANTICS_SQL = """WITH l AS (
  SELECT *, l_suppkey % 5 + 1 AS rate, l_returnflag IN ('A', 'R') AS icmp,
    CASE WHEN l_linestatus = 'F' THEN '2001:db8::1' ELSE '10.0.0.1' END AS a FROM lineitem WHERE l_linenumber <= 4),
f AS (
  SELECT *, false AS reverse, CASE l_linenumber WHEN 3 THEN l_partkey * 2 ELSE l_partkey END AS b,
    CASE l_linenumber WHEN 3 THEN l_suppkey * 2 WHEN 4 THEN 0 ELSE l_suppkey END AS p FROM l
  UNION ALL
  SELECT *, true AS reverse, CASE l_linenumber WHEN 2 THEN l_partkey * 2 ELSE l_suppkey END AS b,
    CASE l_linenumber WHEN 2 THEN l_suppkey * 2 ELSE 0 END AS p FROM l WHERE l_linenumber IN (2, 4))
"""


@query(
    "flow_semantics",
    _SEMANTICS_SQL
    + """SELECT l_orderkey AS arrival_no, l_linenumber AS record_no, reverse, b * rate AS bytes, p * rate AS packets,
  CASE WHEN reverse THEN '10.0.0.2' ELSE a END AS src_addr, CASE WHEN reverse THEN a ELSE '10.0.0.2' END AS dst_addr,
  CASE WHEN icmp THEN 0 WHEN reverse THEN l_suppkey % 65536 ELSE l_partkey % 65536 END AS src_port,
  CASE WHEN icmp THEN 0 WHEN reverse THEN l_partkey % 65536 ELSE l_suppkey % 65536 END AS dst_port,
  CASE WHEN icmp THEN CASE WHEN l_linestatus = 'F' THEN 771 ELSE l_suppkey % 65536 END END AS icmp_type_code,
  CASE WHEN reverse THEN 4 ELSE 3 END AS input_if_index, CASE WHEN reverse THEN l_suppkey ELSE l_partkey END AS src_as,
  CASE WHEN NOT reverse THEN '192.0.2.9' END AS post_nat_src_addr, CASE WHEN reverse THEN 55 END AS post_nat_dst_port, 'web' AS app_name
FROM f WHERE NOT reverse OR b > 0 OR p > 0""",
)
def flow_semantics(spark, sf_dir):
    return flows.template_flows(line_records(spark, sf_dir)).select(
        "arrival_no", "record_no", "reverse", "bytes", "packets", "src_addr", "dst_addr", "src_port", "dst_port", "icmp_type_code",
        "input_if_index", "src_as", "post_nat_src_addr", "post_nat_dst_port", "app_name",
    )


@query(
    "double_count_guards",
    """SELECT CASE l_linenumber WHEN 5 THEN 'reverse_only_dropped' WHEN 6 THEN 'total_counters_skipped' ELSE 'nsel_update_skipped' END AS event, count(*) AS records
FROM lineitem WHERE l_linenumber >= 5 GROUP BY 1""",
)
def double_count_guards(spark, sf_dir):
    return flows.drop_events(line_records(spark, sf_dir))


@query(
    "flow_times",
    """WITH t AS (
  SELECT event_id AS arrival_no, epoch_us(ts) AS us, epoch_us(ts) // 1000000 * 1000 AS export_ms, user_id AS u, event_type,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS kind FROM events),
r AS (
  SELECT *, CASE kind WHEN 0 THEN export_ms - u * 1000 WHEN 1 THEN export_ms - u * 100000 WHEN 2 THEN export_ms - u * 10 WHEN 3 THEN export_ms - u * 5 - 1 END AS end_ms,
    CASE kind WHEN 0 THEN export_ms - u * 3000 WHEN 1 THEN export_ms - u * 100000 WHEN 2 THEN export_ms - u * 20 WHEN 3 THEN export_ms - u * 5 - 1 END AS start_ms FROM t),
c AS (SELECT *, abs(end_ms - us / 1000.0) > 900000 AS skewed FROM r)
SELECT arrival_no, CASE WHEN kind = 4 THEN us WHEN skewed THEN us - (end_ms - start_ms) * 1000 ELSE start_ms * 1000 END AS start_us,
  CASE WHEN kind = 4 OR skewed THEN us ELSE end_ms * 1000 END AS end_us FROM c""",
)
def flow_times(spark, sf_dir):
    """Milliseconds, seconds, uptime stamps across a wrap, NTP times and none at all."""
    e = events(spark, sf_dir)
    export = "(unix_micros(ts) div 1000000 * 1000)"
    rows = e.withColumn("recv_ts", F.col("ts")).withColumn("export_ms", F.expr(export)).withColumn("uptime_ms", F.lit(100).cast("bigint"))
    ntp = f"concat(lpad(hex(({export} - device_id * 5 - 1) div 1000 + 2208988800), 8, '0'), lpad(hex((({export} - device_id * 5 - 1) % 1000 * 4294967296 + 999) div 1000), 8, '0'))"
    records = empty_records(
        rows,
        {
            "start_ms": "if(event_type = 'view', export_ms - device_id * 3000, null)",
            "end_ms": "if(event_type = 'view', export_ms - device_id * 1000, null)",
            "end_s": "if(event_type = 'click', (export_ms - device_id * 100000) div 1000, null)",
            "start_uptime": "if(event_type = 'purchase', pmod(100 - device_id * 20, 4294967296), null)",
            "end_uptime": "if(event_type = 'purchase', pmod(100 - device_id * 10, 4294967296), null)",
            "end_ntp_ns": f"if(event_type = 'signup', {ntp}, null)",
        },
    )
    timed = flows.with_record_times(records, flows.receive_ms()).withColumnRenamed("_t", "t")
    return timed.select(
        "arrival_no",
        F.unix_micros(flows.to_timestamp(F.col("t.start_ms"))).alias("start_us"),
        F.unix_micros(flows.to_timestamp(F.col("t.end_ms"))).alias("end_us"),
    )


@query(
    "sampling_rate_resolution",
    "WITH "
    + EVENTS_SQL
    + """, l AS (
  SELECT *, device_id % 20 AS x, k % 3 AS sampler,
    CASE WHEN event_type = 'signup' THEN CASE k % 4 WHEN 0 THEN (k + 4 + 12) // (k + 4) WHEN 1 THEN k WHEN 2 THEN nullif(k % 3, 0) ELSE k + 1 END END AS learned FROM e),
s AS (
  SELECT *, last_value(CASE WHEN event_type = 'signup' AND k % 4 <> 3 THEN learned WHEN event_type = 'view' AND k % 10 = 5 THEN 77 END IGNORE NULLS) OVER (PARTITION BY x ORDER BY arrival_no ROWS UNBOUNDED PRECEDING) AS domain_rate,
    last_value(CASE WHEN event_type = 'signup' AND k % 4 = 3 THEN learned END IGNORE NULLS) OVER (PARTITION BY x, CASE WHEN event_type = 'signup' AND k % 4 <> 3 OR event_type = 'error' THEN -1 ELSE sampler END ORDER BY arrival_no ROWS UNBOUNDED PRECEDING) AS sampler_rate
  FROM l)
SELECT arrival_no, CAST(CASE WHEN x = 7 THEN 500 WHEN event_type <> 'error' AND sampler_rate IS NOT NULL THEN sampler_rate ELSE coalesce(domain_rate, 1) END AS BIGINT) AS sampling_rate
FROM s WHERE event_type <> 'signup'""",
)
def sampling_rate_resolution(spark, sf_dir):
    """Signups are options records (four encodings, the last bound to a sampler), views may carry a rate in-band."""
    rows = events(spark, sf_dir).select(
        "arrival_no", "event_type", "k",
        (F.col("device_id") % 20).cast("string").alias("exporter"), F.lit(0).alias("domain"),
        F.col("arrival_no").alias("set_order"), F.lit(0).alias("record_no"), (F.col("event_type") == "signup").alias("is_options"),
    )
    options = "event_type = 'signup'"
    records = empty_records(
        rows,
        {
            "interval_305": f"if({options} and k % 4 = 0, k + 4, if({options} and k % 4 = 2, k % 3, null))",
            "space_306": f"if({options} and k % 4 = 0, 12, null)",
            "random_50": f"if({options} and k % 4 in (1, 2), k, null)",
            "interval_34": f"if({options}, if(k % 4 = 3, k + 1, 9), if(event_type = 'view' and k % 10 = 5, 77, null))",
            "sampler_id": f"if({options} and k % 4 <> 3 or event_type = 'error', null, k % 3)",
        },
    )
    overrides = spark.createDataFrame([("7", 500)], "exporter string, rate bigint")
    return flows.with_sampling_rate(records, overrides).select("arrival_no", "sampling_rate")


# ------------------------------------------------------------------------------------------------------------- sFlow


def sflow_datagrams(spark, sf_dir, chosen="true"):
    """One datagram per order: a flow sample and a counter sample per line. Flag N is TCP in IPv4, A is UDP behind a VLAN
    tag, R is TCP in IPv6 behind a hop-by-hop header."""
    ethernet = packed(("1", 6), ("2", 6))
    ipv4 = packed(("69", 1), ("0", 1), ("100", 2), ("0", 4), ("64", 1), ("if(l_returnflag = 'A', 17, 6)", 1), ("0", 2), (f"{IP10} + l_partkey", 4), (f"{IP11} + l_suppkey", 4))
    ports = packed(("l_partkey % 65536", 2), ("l_linenumber + 8000", 2), ("0", 8), ("80", 1), ("18", 1), ("0", 6))
    ipv6 = packed(("6", 1), ("0", 5), ("0", 1), ("64", 1), ("2306139568115548160", 8), ("l_partkey % 65535 + 1", 8), ("2306139568115548160", 8), ("l_suppkey % 65535 + 1", 8), ("6", 1), ("0", 7))
    frame = (
        f"case l_returnflag when 'N' then concat({ethernet}, {b('2048', 2)}, {ipv4}, {ports}) "
        f"when 'A' then concat({ethernet}, {b('33024', 2)}, {b('5', 2)}, {b('2048', 2)}, {ipv4}, {ports}) "
        f"else concat({ethernet}, {b('34525', 2)}, {ipv6}, {ports}) end"
    )
    lines = by_order(table(spark, sf_dir, "lineitem").where(chosen)).withColumn("h", F.expr(frame))
    raw = f"concat({b('1', 4)}, {b('floor(l_quantity)', 4)}, {b('4', 4)}, {b('length(h)', 4)}, h)"
    gateway = packed(("1", 4), (f"{IP10} + 9", 4), ("64500", 4), ("l_suppkey", 4), ("1", 4), ("2", 4), ("2", 4), ("1", 4), ("l_linenumber", 4), ("1", 4), ("2", 4), ("65001", 4), ("l_partkey", 4))
    lines = lines.withColumn("raw", F.expr(raw)).withColumn("gw", F.expr(f"if(l_linestatus = 'O', {gateway}, unhex(''))"))
    records = f"concat({b('1', 4)}, {b('length(raw)', 4)}, raw, if(length(gw) > 0, concat({b('1003', 4)}, {b('length(gw)', 4)}, gw), unhex('')))"
    flow = (
        f"concat({b('l_orderkey % 4294967296', 4)}, {b('3', 4)}, {b('l_suppkey % 4', 4)}, {b('0', 4)}, {b('l_linenumber', 4)}, {b('1073741824 + l_linenumber', 4)}, "
        f"{b('l_suppkey', 4)}, {b('if(length(gw) > 0, 2, 1)', 4)}, {records})"
    )
    counters = packed(
        ("l_linenumber % 2 * l_partkey", 4), ("6", 4), ("1000000000", 8), ("1", 4), ("3", 4), ("l_partkey * 5000000000", 8), ("0", 12), ("l_suppkey", 4),
        ("l_linenumber", 4), ("0", 4), ("l_suppkey * 7000000000", 8), ("0", 12), ("4", 4), ("5", 4), ("0", 4),
    )
    counter = f"concat({b('1', 4)}, {b('16777216 * 3 + l_suppkey', 4)}, {b('1', 4)}, {b('1', 4)}, {b('88', 4)}, {counters})"
    items = lines.withColumn("f", F.expr(flow)).withColumn("c", F.expr(counter))
    both = f"concat({b('1', 4)}, {b('length(f)', 4)}, f, {b('2', 4)}, {b('length(c)', 4)}, c)"
    orders = items.select("l_orderkey", F.expr(both).alias("s")).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list("s")).alias("ss"), F.count("*").alias("n")
    )
    header = packed(("5", 4), ("1", 4), (f"{IP10} + l_orderkey % 65536", 4), ("0", 4), ("l_orderkey % 4294967296", 4), ("1000", 4), ("2 * n", 4))
    made = orders.select(
        F.col("l_orderkey").alias("arrival_no"),
        F.timestamp_seconds(F.col("l_orderkey") + 1000000000).alias("recv_ts"),
        # a generator makes the payload once, whatever filter reads it; it is read once, so it is not written
        F.explode(F.array(F.concat(F.expr(header), joined(F.col("ss"))))).alias("payload"),
    )
    return made


@query(
    "sflow_flows",
    f"""WITH l AS (SELECT *, l_suppkey % 4 AS rate, CAST(floor(l_quantity) AS BIGINT) AS q, l_linestatus = 'O' AS bgp FROM lineitem)
SELECT l_orderkey AS arrival_no, {dotted(f'{IP10} + l_orderkey % 65536')} AS sampler_address, rate AS sampling_rate,
  CASE WHEN l_returnflag = 'R' THEN '2001:db8::' || printf('%x', l_partkey % 65535 + 1) ELSE {dotted(f'{IP10} + l_partkey')} END AS src_addr,
  CASE WHEN l_returnflag = 'R' THEN '2001:db8::' || printf('%x', l_suppkey % 65535 + 1) ELSE {dotted(f'{IP11} + l_suppkey')} END AS dst_addr,
  l_partkey % 65536 AS src_port, l_linenumber + 8000 AS dst_port, CASE WHEN l_returnflag = 'A' THEN 17 ELSE 6 END AS protocol,
  CASE WHEN l_returnflag <> 'A' THEN 18 END AS tcp_flags, CASE WHEN rate > 1 THEN q * rate ELSE q END AS bytes,
  CASE WHEN rate > 1 THEN rate ELSE 1 END AS packets, l_linenumber AS input_if_index, l_suppkey AS output_if_index, l_linenumber AS drops,
  CASE WHEN bgp THEN '10.0.0.9' END AS next_hop, CASE WHEN bgp THEN l_suppkey END AS src_as, CASE WHEN bgp THEN l_partkey END AS dst_as,
  CASE WHEN bgp THEN l_linenumber || ' 65001 ' || l_partkey END AS as_path FROM l""",
)
def sflow_flows(spark, sf_dir):
    return plan.sflow_flows(sflow_datagrams(spark, sf_dir)).drop("timestamp", "recv_ts", "sample_no", "sequence_number", "flow_source")


@query(
    "sflow_interface_counters",
    f"""SELECT l_orderkey AS arrival_no, {dotted(f'{IP10} + l_orderkey % 65536')} AS sampler_address,
  CASE WHEN l_linenumber % 2 * l_partkey = 0 THEN l_suppkey ELSE l_partkey END AS if_index, 6 AS if_type, 1000000000 AS if_speed, 1 AS if_direction, 3 AS if_status,
  l_partkey * 5000000000 AS in_octets, l_suppkey AS in_discards, l_linenumber AS in_errors, l_suppkey * 7000000000 AS out_octets, 4 AS out_discards, 5 AS out_errors
FROM lineitem""",
)
def sflow_interface_counters(spark, sf_dir):
    rows = sflow.interface_counters(sflow.samples(sflow_datagrams(spark, sf_dir)))
    return rows.drop("timestamp", "sample_no", "record_no")


# -------------------------------------------------------------------------------------------------------- both listeners

# Orders by turns: v5, template-based, and sFlow (or, for the events, datagrams that are none of them).
V5_TURN, TEMPLATE_TURN, THIRD_TURN = ("{key} % 3 = " + str(i) for i in range(3))


def netflow_capture(spark, sf_dir):
    return landed(v5_datagrams(spark, sf_dir, V5_TURN.format(key="l_orderkey"))).unionByName(template_datagrams(spark, sf_dir, TEMPLATE_TURN.format(key="o_orderkey")))


_END_SQL = (
    _V5_SQL.replace("FROM lineitem", "FROM lineitem WHERE l_orderkey % 3 = 0").rstrip()
    + ", "
    + _TEMPLATE_SQL.replace("FROM orders", "FROM orders WHERE o_orderkey % 3 = 1").removeprefix("WITH ").replace("d AS (", "td AS (").replace("FROM d)", "FROM td)").rstrip()
    + f""", f AS (
  SELECT l_orderkey % 20 AS device, '192.0.2.' || (l_orderkey % 20) AS sampler_address, l_orderkey * 3 % 4294967296 AS sequence_number, rate AS sampling_rate,
    {dotted(f'{IP10} + l_partkey')} AS src_addr, {dotted(f'{IP11} + l_suppkey')} AS dst_addr, CASE WHEN icmp THEN 0 ELSE l_partkey % 65536 END AS src_port,
    CASE WHEN icmp THEN 0 ELSE l_linenumber * 256 + 3 END AS dst_port, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 6 ELSE 17 END AS protocol,
    CAST(floor(l_extendedprice) AS BIGINT) * rate AS bytes, CAST(floor(l_quantity) AS BIGINT) * rate AS packets, l_linenumber AS input_if_index, l_suppkey % 65536 AS output_if_index,
    l_linenumber AS tcp_flags, 0 AS drops, l_partkey % 65536 AS src_as, '' AS as_path, CASE WHEN l_linestatus <> 'F' THEN '10.0.0.1' ELSE '' END AS next_hop, 1 AS flow_source, end_ms * 1000 AS end_us FROM d
  UNION ALL
  SELECT x, '198.51.100.' || x, o_orderkey, rate, {dotted(f'{IP10} + o_custkey')}, {dotted(f'{IP11} + o_orderkey % 65536')}, o_orderkey % 65536, 443, 6,
    CAST(floor(o_totalprice) AS BIGINT) * rate, (o_custkey + 1) * rate, 0, 0, 0, 0, 0, '', '', CASE WHEN x % 2 = 0 THEN 2 ELSE 3 END, (1000000001500 + o_orderkey * 1000) * 1000 FROM r
  UNION ALL
  SELECT NULL, {dotted(f'{IP10} + l_orderkey % 65536')}, l_orderkey % 4294967296, l_suppkey % 4,
    CASE WHEN l_returnflag = 'R' THEN '2001:db8::' || printf('%x', l_partkey % 65535 + 1) ELSE {dotted(f'{IP10} + l_partkey')} END,
    CASE WHEN l_returnflag = 'R' THEN '2001:db8::' || printf('%x', l_suppkey % 65535 + 1) ELSE {dotted(f'{IP11} + l_suppkey')} END,
    l_partkey % 65536, l_linenumber + 8000, CASE WHEN l_returnflag = 'A' THEN 17 ELSE 6 END, CAST(floor(l_quantity) AS BIGINT) * greatest(l_suppkey % 4, 1), greatest(l_suppkey % 4, 1),
    l_linenumber, l_suppkey, CASE WHEN l_returnflag <> 'A' THEN 18 ELSE 0 END, l_linenumber, CASE WHEN l_linestatus = 'O' THEN l_suppkey ELSE 0 END,
    CASE WHEN l_linestatus = 'O' THEN l_linenumber || ' 65001 ' || l_partkey ELSE '' END, CASE WHEN l_linestatus = 'O' THEN '10.0.0.9' ELSE '' END, 0, NULL
  FROM lineitem WHERE l_orderkey % 3 = 2)
"""
)


@query(
    "flow_samples_end_to_end",
    _END_SQL
    + """SELECT coalesce(CASE WHEN flow_source = 1 THEN m.n_nationkey ELSE i.n_nationkey END + 100, 0) AS device_id, 7 AS probe_id, sampler_address, sequence_number, sampling_rate, src_addr, dst_addr,
  src_port, dst_port, protocol, bytes, packets, input_if_index, output_if_index, tcp_flags, drops, src_as, as_path, next_hop, flow_source, end_us
FROM f LEFT JOIN nation m ON m.n_nationkey = device AND m.n_regionkey < 4 LEFT JOIN nation i ON i.n_nationkey = device AND i.n_regionkey > 0""",
)
def flow_samples_end_to_end(spark, sf_dir):
    """The product: v5, v9, IPFIX and sFlow captures decoded, scaled, given their devices and deduplicated into the canonical table."""
    nations = table(spark, sf_dir, "nation").withColumn("id", (F.col("n_nationkey") + 100).cast("bigint"))
    devices = nations.where("n_regionkey < 4").select("id", F.lit(0).cast("bigint").alias("list_no"), F.concat(F.lit("192.0.2."), F.col("n_nationkey").cast("string")).alias("ip_address"))
    addresses = nations.where("n_regionkey > 0").select(
        F.col("id").alias("device_id"), F.lit(0).cast("bigint").alias("write_no"), F.concat(F.lit("198.51.100."), F.col("n_nationkey").cast("string")).alias("ip_address")
    )
    sampled = sflow_datagrams(spark, sf_dir, THIRD_TURN.format(key="l_orderkey"))
    rows = plan.flow_samples(netflow_capture(spark, sf_dir), sampled, devices, addresses, probe_id=7, policy="prefer-netflow")
    return rows.select(
        "device_id", "probe_id", "sampler_address", "sequence_number", "sampling_rate", "src_addr", "dst_addr", "src_port", "dst_port", "protocol", "bytes", "packets",
        "input_if_index", "output_if_index", "tcp_flags", "drops", "src_as", "as_path", "next_hop", "flow_source", F.unix_micros("flow_end").alias("end_us"),
    )


def _lost(rows: str, keys: str, order: str, sequence_no: str, increment: str, countable: str) -> str:
    """SQL rows (event) of the sequence gaps of datagrams."""
    delta = f"(({sequence_no} - lag({sequence_no}) OVER w - lag({increment}) OVER w) % 4294967296 + 4294967296) % 4294967296"
    return f"""SELECT CASE WHEN delta >= 16777216 THEN 'seq_resync' ELSE 'seq_gap' END AS event
  FROM (SELECT lag({countable}) OVER w AS counted, {delta} AS delta FROM {rows} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})) WHERE counted AND delta > 0"""


@query(
    "parse_events",
    _TEMPLATE_SQL.replace("FROM orders", "FROM orders WHERE o_orderkey % 3 = 1").rstrip()
    + f""", v AS (SELECT l_orderkey AS k, count(*) + l_orderkey % 2 AS declared FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey),
e AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'unknown_version' ELSE 'malformed' END AS event FROM orders WHERE o_orderkey % 3 = 2
  UNION ALL SELECT 'malformed' FROM v WHERE k % 2 = 1
  UNION ALL SELECT 'data_before_template' FROM o WHERE announced = 0
  UNION ALL {_lost("v", "k % 20, k % 4", "k", "k * 3", "declared", "true")}
  UNION ALL {_lost("o", "x", "o_orderkey", "o_orderkey", "1", "x % 2 = 0 OR announced > 0")})
SELECT event, count(*) AS total FROM e GROUP BY event""",
)
def parse_events(spark, sf_dir):
    """Everything the decoders refused or missed, of a capture that holds v5, template-based and foreign datagrams."""
    foreign = table(spark, sf_dir, "orders").where(THIRD_TURN.format(key="o_orderkey")).select(
        F.col("o_orderkey").alias("arrival_no"), F.timestamp_seconds(F.col("o_orderkey") + 1000000000).alias("recv_ts"), F.lit("192.0.2.200").alias("exporter"),
        F.expr(f"if(o_orderkey % 2 = 0, {b('7', 2)}, {b('9', 1)})").alias("payload"),
    )
    return plan.parse_events(netflow_capture(spark, sf_dir).unionByName(foreign))
