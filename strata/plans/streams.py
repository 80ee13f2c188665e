"""Streaming and file-to-gold queries registered with the driver.

All stage their input from the driver tables into the shared checkpoint
folder (``spark.checkpoint.dir``), load it from there and return what was
written.  Streams run with ``availableNow``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strata.operators.dedupe import keep_latest
from strata.operators.gold import customer_value, daily_revenue, daily_revenue_by_category
from strata.operators.quality import describe_model
from strata.plans.banking import CUST_MAST_SCHEMA, conform_customers, customer_value_suite
from strata.plans.catalog import (LINE_KEY, category_items, completed_transactions, line_order, raw_accounts, raw_event_json,
                                  raw_transactions, table)
from strata.plans.ecommerce import (RAW_COLUMNS, gold_daily_suite, gold_revenue_daily, silver_transactions,
                                    stream_silver_transactions, transactions_snapshot)
from strata.plans.oracle import CONFORMED, RAW_ACCOUNTS, RAW_JSON
from strata.plans.oracle import SQL as _SQL
from strata.session import materialize, scratch_path
from strata.sources.files import read_table
from strata.sources.incremental import DailyTable, build, read_daily, refresh, touched
from strata.sources.sinks import append_batches, materialize_gold, read_batches, write_overwrite
from strata.streaming.bronze import BronzeConfig, bronze_batch, bronze_stream
from strata.streaming.silver import latest_changes, publish_current, snapshot

EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")
TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
EVENT_TYPES = {"event_id": "bigint", "ts": f"timestamp:{TS_TEXT}", "user_id": "bigint",
               "event_type": "string", "value": "double", "props": "string"}


def event_text(spark: SparkSession, sf: str) -> DataFrame:
    """Events as legacy text; one value in 101 is the text ``n/a``."""
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.date_format("ts", TS_TEXT).alias("ts"),
        F.col("user_id").cast("string").alias("user_id"),
        "event_type",
        F.when(F.col("event_id") % 101 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"),
        "props",
    )


#: Rows of a staged file at most, about; so no task writes or reads more, however large the table.
STAGED = 250_000


def staged(df: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``df`` dealt to at least ``least`` files of about ``STAGED`` rows, and for each of the ``least`` the files that it
    has become: what a micro-batch takes for the number of batches to stay."""
    each = max(1, -(-df.count() // (STAGED * least)))
    return df.repartition(least * each), each


def stage_csv(df: DataFrame, path: str, files: int = 2) -> None:
    staged(df, files)[0].write.mode("append").option("header", "true").csv(path)


def events_config(spark: SparkSession, **more) -> BronzeConfig:
    paths = {k: scratch_path(spark, v) for k, v in
             (("source_path", "events"), ("target_path", "bronze"), ("checkpoint", "ckpt"))}
    return BronzeConfig(**{**paths, "expected": EVENT_TYPES, **more})


def bronze_events(b: DataFrame, *more: str) -> DataFrame:
    return b.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id",
                    "event_type", "value", "props", "_rescued_data", *more)


def q_bronze_stream(spark: SparkSession, sf: str) -> DataFrame:
    """ST1 / ST2 / ST4 / SRC1 / SRC5 / SRC8-SRC10 / SC13 / SC14: CSV files -> bronze
    Parquet partitioned by ingest date, run twice on one checkpoint (the second run
    must add nothing); files that the glob leaves out are not read, and every row
    names its file and its ingest date."""
    cfg = events_config(spark)
    stage_csv(event_text(spark, sf), cfg.source_path, 4)
    event_text(spark, sf).write.mode("append").json(cfg.source_path)  # not *.csv: left out
    bronze_stream(spark, cfg)
    bronze_stream(spark, cfg)          # restart: every file is already in the source log
    name = F.regexp_extract("_source_file", r"([^/]+)$", 1)
    return bronze_events(
        read_table(spark, cfg.target_path).withColumns({
            "from_csv": name.startswith("part-") & name.endswith(".csv"),
            "dated": F.col("_ingest_date") == F.to_date("_ingested_at")}), "from_csv", "dated")


def q_bronze_csv_drift(spark: SparkSession, sf: str) -> DataFrame:
    """SRC1 / ST4: a source whose later files have their columns in another order, then
    one column more and one less: columns go by name, the new one is rescued."""
    cfg = events_config(spark)
    ev = event_text(spark, sf)
    part = F.col("event_id").cast("bigint") % 3
    stage_csv(ev.where(part == 0), cfg.source_path)
    bronze_stream(spark, cfg)
    stage_csv(ev.where(part == 1).select(*reversed(EVENT_COLUMNS)), cfg.source_path)
    stage_csv(ev.where(part == 2).drop("props").withColumn("extra", F.concat(F.lit("x"), "user_id")), cfg.source_path)
    bronze_stream(spark, cfg)
    return bronze_events(read_batches(spark, cfg.target_path))


def q_bronze_parquet_drift(spark: SparkSession, sf: str) -> DataFrame:
    """SRC2 / ST4: Parquet files whose ``user_id`` turns from a number into text (some of it
    no number) and that gain a column; read as a batch (SRC4) and as a stream."""
    schema = StructType([StructField("event_id", LongType()), StructField("user_id", LongType()),
                         StructField("event_type", StringType())])
    cfg = events_config(spark, fmt="parquet", expected={}, schema=schema)
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    odd = F.col("event_id") % 2 == 1
    ev.where(~odd).drop("props").write.parquet(cfg.source_path)
    bronze_stream(spark, cfg)
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("u"), F.col("user_id"))).otherwise(F.col("user_id").cast("string"))
    ev.where(odd).withColumn("user_id", text).write.mode("append").parquet(cfg.source_path)
    bronze_stream(spark, cfg)
    rows = lambda df, how: df.select(F.lit(how).alias("load"), *schema.names, "_rescued_data")
    return rows(read_batches(spark, cfg.target_path), "stream").unionByName(rows(bronze_batch(spark, cfg), "batch"))


def q_bronze_json(spark: SparkSession, sf: str) -> DataFrame:
    """SRC3 / SRC6: JSON lines with drift and broken records; the schema is inferred from all
    the first files, remembered, and used again for the later ones."""
    cfg = events_config(spark, fmt="json", expected={}, glob="*.txt", schema_at=scratch_path(spark, "schema"))
    raw = raw_event_json(table(spark, sf, "events", spread=True))
    first = raw.where("event_id % 2 = 0").select(F.to_json(F.struct(F.col("event_id").alias("id"), "value")).alias("value"))
    first.write.text(cfg.source_path)
    bronze_stream(spark, cfg)
    later = raw.where("event_id % 2 = 1").select(F.to_json(F.struct(
        F.col("event_id").alias("id"), "value", F.lit(1).alias("new"))).alias("value"))
    later.write.mode("append").text(cfg.source_path)
    bronze_stream(spark, cfg)
    return read_batches(spark, cfg.target_path).select("id", "value", "_rescued_data")


NESTED_TYPES = {"id": "bigint", "customer": "struct<key:bigint,tier:bigint>", "items": "array<struct<line:bigint,qty:bigint>>"}


def nested_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as nested JSON records; of seven records, one has a quantity that is no number, one an undeclared
    field, one an object for the list, one no customer and one a text for the customer's key."""
    k = F.col("o_orderkey") % 7
    pair = lambda qty: F.format_string('{"line":2,"qty":%s}', qty)
    number = (F.col("o_custkey") % 50).cast("string")
    items = F.when(k == 3, F.format_string('{"line":1,"qty":%s}', number)).otherwise(F.concat(
        F.format_string('[{"line":1,"qty":%s},', number), F.when(k == 1, pair(F.lit('"n/a"'))).otherwise(pair(number)), F.lit("]")))
    key = F.when(k == 5, F.format_string('"K%s"', F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    tier = F.substring("o_orderpriority", 1, 1)
    customer = F.when(k == 4, F.lit("null")).otherwise(F.format_string(
        '{"key":%s,"tier":%s%s}', key, tier, F.when(k == 2, F.lit(',"vip":true')).otherwise("")))
    return table(spark, sf, "orders").select(
        k.alias("kind"), F.format_string('{"id":%s,"customer":%s,"items":%s}', F.col("o_orderkey").cast("string"), customer, items).alias("value"))


def q_bronze_nested(spark: SparkSession, sf: str) -> DataFrame:
    """SRC7 / SRC3 / SRC2 / ST4 on nested values: records with structs and lists that drift inside, as JSON
    lines (streamed) and as Parquet files whose nested types differ (a batch); what does
    not fit is kept under its path."""
    raw = nested_orders(spark, sf)
    out = []
    for fmt in ("json", "parquet"):
        cfg = events_config(spark, fmt=fmt, expected={}, schema=StructType.fromDDL(", ".join(f"{c} {t}" for c, t in NESTED_TYPES.items())))
        if fmt == "json":
            raw.select("value").write.text(cfg.source_path)
            cfg.glob = "*.txt"
            bronze_stream(spark, cfg)
            rows = read_batches(spark, cfg.target_path)
        else:
            for kinds in ((0, 4), (1,), (2,), (3,), (5, 6)):
                text = raw.where(F.col("kind").isin(*kinds)).select("value")
                schema = StructType.fromDDL(", ".join(f"{c} {_NESTED_AS[kinds[0]].get(c, t)}" for c, t in NESTED_TYPES.items()))
                text.select(F.from_json("value", schema).alias("r")).select("r.*").write.mode("append").parquet(cfg.source_path)
            rows = bronze_batch(spark, cfg)
        out.append(rows.select(F.lit(fmt).alias("load"), "id", F.col("customer.key").alias("customer_key"), F.col("customer.tier").alias("customer_tier"),
                               F.size("items").alias("n_items"), F.try_element_at("items", F.lit(1))["qty"].alias("qty_1"),
                               F.try_element_at("items", F.lit(2))["qty"].alias("qty_2"), "_rescued_data"))
    return out[0].unionByName(out[1])


#: How the Parquet files of a kind of record hold what differs from the declared types.
_NESTED_AS = {0: {}, 1: {"items": "array<struct<line:bigint,qty:string>>"}, 2: {"customer": "struct<key:bigint,tier:bigint,vip:boolean>"},
              3: {"items": "struct<line:bigint,qty:bigint>"}, 5: {"customer": "struct<key:string,tier:bigint>"}}


def q_silver_stream(spark: SparkSession, sf: str, files: int = 4) -> DataFrame:
    """ST3: line items arrive as Parquet files in ``files`` micro-batches and are
    appended; keep-latest over what was appended must equal keep-latest over all rows."""
    src, rows, ckpt, out = (scratch_path(spark, n) for n in ("lineitem-in", "silver-rows", "ckpt", "silver"))
    li = table(spark, sf, "lineitem")
    arriving, each = staged(li, files)
    arriving.write.parquet(src)
    stream = spark.readStream.schema(li.schema).option("maxFilesPerTrigger", str(each)).parquet(src)
    append_batches(stream, rows, ckpt)
    return snapshot(keep_latest(read_batches(spark, rows), LINE_KEY, line_order()), out)


def q_silver_state(spark: SparkSession, sf: str, files: int = 3) -> DataFrame:
    """ST3 / SRC10 / SRC12 with state: line items in ``files`` micro-batches a run, later ship dates first, through two runs of one
    checkpoint; the state store keeps each key's latest row, changes are appended to a named table, merged,
    and the current rows published as a table after each run."""
    src, ckpt, root = (scratch_path(spark, n) for n in ("lineitem-in", "ckpt", "published"))
    name = f"silver_{root[-12:]}"
    li = table(spark, sf, "lineitem")
    # the files of a micro-batch grow with the table, the micro-batches don't
    each = max(1, -(-li.count() // (2 * files * STAGED)))
    stream = lambda: spark.readStream.schema(li.schema).option("maxFilesPerTrigger", str(each)).parquet(src)
    order = line_order()
    late = F.col("l_shipdate") < F.lit("1995-06-17")
    for part in (li.where(~late), li.where(late | F.col("l_shipdate").isNull())):
        for i in range(files):
            part.where(F.pmod(F.hash("l_orderkey", "l_partkey"), F.lit(files)) == i).repartition(each).write.mode("append").parquet(src)
        latest_changes(stream(), f"{root}/changes", ckpt, LINE_KEY, order, compact_after=2)
        out = publish_current(spark, f"{root}/changes", name, f"{root}/table", LINE_KEY, order)
    return out


def q_transactions_stream(spark: SparkSession, sf: str) -> DataFrame:
    """ST3 on transactions with exact copies, later versions, ties and rows without a key:
    streamed in three micro-batches, then through a second checkpoint as well (which appends all rows
    again); valid silver and quarantine must equal the batch."""
    bronze, rows, snaps = (scratch_path(spark, n) for n in ("tx-bronze", "tx-rows", "tx-silver"))
    raw = raw_transactions(table(spark, sf, "orders", spread=True))
    arriving, each = staged(raw.where("order_id is not null and upper(trim(order_id)) <> 'NULL'"), 3)
    arriving.write.parquet(bronze)
    for _ in range(2):
        stream_silver_transactions(spark, bronze, rows, scratch_path(spark, "ckpt"), max_files_per_trigger=each)
    # keyless rows have nothing that tells a copy from a second row: they are streamed once
    staged(raw.where("order_id is null or upper(trim(order_id)) = 'NULL'"), 1)[0].write.parquet(f"{bronze}-keyless")
    stream_silver_transactions(spark, f"{bronze}-keyless", rows, scratch_path(spark, "ckpt"))
    valid, quarantine = transactions_snapshot(spark, rows, snaps)
    cols = ["order_id", F.col("transaction_timestamp").cast("timestamp_ntz").alias("transaction_timestamp"), "gross_amount"]
    return valid.select(F.lit("valid").alias("outcome"), *cols, F.lit("").alias("_reject_reason")).unionByName(
        quarantine.select(F.lit("quarantine").alias("outcome"), *cols, "_reject_reason"))


def _comments(stored: DataFrame, columns) -> Column:
    """The descriptions that the stored model's columns carry."""
    return F.lit("; ".join(f"{c}: {stored.schema[c].metadata.get('comment')}" for c in columns)).alias("comments")


def q_ecommerce_chain(spark: SparkSession, sf: str) -> DataFrame:
    """SRC4, SRC11-SRC13, DQ6 end to end: CSV files -> bronze (batch) -> silver, overwritten twice
    (partitioned; the second time without one status) -> read back -> documented gold table."""
    cfg = events_config(spark, expected={}, columns=(*RAW_COLUMNS, "origin"))
    raw = raw_transactions(table(spark, sf, "orders", spread=True)).withColumnRenamed("_source_file", "origin")
    stage_csv(raw, cfg.source_path)
    bronze = bronze_batch(spark, cfg).drop("_source_file", "_ingested_at", "_ingest_date", "_rescued_data") \
        .withColumnRenamed("origin", "_source_file")
    valid = materialize(silver_transactions(bronze)[0], "silver")
    silver, gold = scratch_path(spark, "silver"), scratch_path(spark, "gold")
    write_overwrite(valid, silver, partition_by=["order_status"])
    write_overwrite(valid.where("order_status <> 'PENDING'"), silver, partition_by=["order_status"])
    again = read_table(spark, silver)
    docs = gold_daily_suite().docs
    stored = materialize_gold(describe_model(gold_revenue_daily(again, status=None), docs), gold)
    return stored.select("transaction_date", "order_count", "daily_gross_revenue", _comments(stored, docs))


def q_mainframe_chain(spark: SparkSession, sf: str) -> DataFrame:
    """SRC2, SRC11-SRC13, DQ6 end to end for the mainframe dump: Parquet -> bronze stream ->
    silver table -> documented customer value."""
    cfg = events_config(spark, fmt="parquet", expected={}, schema=CUST_MAST_SCHEMA)
    raw_accounts(table(spark, sf, "customer"), table(spark, sf, "orders")).write.parquet(cfg.source_path)
    bronze_stream(spark, cfg)
    silver, gold = scratch_path(spark, "silver"), scratch_path(spark, "gold")
    write_overwrite(conform_customers(read_batches(spark, cfg.target_path)), silver)
    docs = customer_value_suite().docs
    stored = materialize_gold(describe_model(customer_value(read_table(spark, silver)), docs), gold)
    return stored.select("customer_id", "customer_lifetime_value", "customer_tier", "is_dormant_risk",
                         _comments(stored, docs))


def _late_batches(gold: DailyTable, rows: DataFrame) -> DataFrame:
    """``rows`` in a first load and three late batches (late rows of a year each; the last batch also moves
    orders that stood 30 days too early), the table refreshed after each."""
    kind, year = F.col("order_id") % 10, F.year(gold.day)
    late = F.when((kind < 4) & (kind > 0) & (year == 1995 + kind), kind).otherwise(0)
    moved = (kind == 4) & (year == 1999)
    rows = materialize(rows.withColumn("_batch", late).withColumn("_moved", moved), "silver_rows")
    wrong = F.when(F.col("_moved"), F.date_sub(gold.day, 30)).otherwise(F.col(gold.day))

    def state(batch: int) -> DataFrame:
        seen = rows.where(F.col("_batch") <= batch)
        return seen if batch == 3 else seen.withColumn(gold.day, wrong)

    build(gold, state(0))
    for batch in (1, 2, 3):
        changes = [rows.where(F.col("_batch") == batch)]
        if batch == 3:
            fixed = rows.where("_moved")
            changes += [fixed, fixed.withColumn(gold.day, wrong)]
        refresh(gold, state(batch), touched(gold, *changes))
    return read_daily(gold, rows.sparkSession)


def q_gold_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """G1 + W2 kept up to date by touched days through three late batches: equals the full build."""
    tx = completed_transactions(table(spark, sf, "orders"), "COMPLETED").where("order_status = 'COMPLETED'")
    rows = tx.withColumn("transaction_date", F.col("transaction_timestamp").cast("date"))
    gold = DailyTable(scratch_path(spark, "gold_daily"), lambda x: daily_revenue(x).drop("rolling_7d_avg_orders"),
                      "order_count", "rolling_7d_avg_orders")
    return _late_batches(gold, rows)


def q_gold_incremental_category(spark: SparkSession, sf: str) -> DataFrame:
    """G2 + W2 per category kept up to date by touched days through three late batches: equals the full build."""
    gold = DailyTable(scratch_path(spark, "gold_category"),
                      lambda x: daily_revenue_by_category(x).drop("rolling_7d_avg_orders"),
                      "order_count", "rolling_7d_avg_orders", keys=("category",))
    return _late_batches(gold, category_items(spark, sf)).select(
        "transaction_date", "category", "order_count", F.col("daily_gross_revenue").cast("decimal(38,4)").alias("daily_gross_revenue"),
        F.col("daily_tax_collected").cast("decimal(38,6)").alias("daily_tax_collected"), "rolling_7d_avg_orders")


STREAM_QUERIES = {
    "bronze_stream": q_bronze_stream,
    "bronze_csv_drift": q_bronze_csv_drift,
    "bronze_parquet_drift": q_bronze_parquet_drift,
    "bronze_json": q_bronze_json,
    "bronze_nested": q_bronze_nested,
    "silver_stream": q_silver_stream,
    "silver_state": q_silver_state,
    "transactions_stream": q_transactions_stream,
    "gold_incremental": q_gold_incremental,
    "gold_incremental_category": q_gold_incremental_category,
    "ecommerce_chain": q_ecommerce_chain,
    "mainframe_chain": q_mainframe_chain,
}


def _said(docs: dict[str, str]) -> str:
    return "'" + "; ".join(f"{c}: {t}" for c, t in docs.items()).replace("'", "''") + "' AS comments"


_NA = "CASE WHEN event_id % 101 = 0 THEN NULL ELSE value END AS value"

STREAM_SQL = {
    "bronze_stream": f"""SELECT event_id, ts, user_id, event_type, {_NA}, props,
       CASE WHEN event_id % 101 = 0 THEN '{{"value":"n/a"}}' END AS _rescued_data,
       TRUE AS from_csv, TRUE AS dated
FROM events""",
    "bronze_csv_drift": f"""SELECT event_id, ts, user_id, event_type, {_NA},
       CASE WHEN event_id % 3 = 2 THEN NULL ELSE props END AS props,
       CASE WHEN event_id % 3 = 2 AND event_id % 101 = 0
              THEN '{{"value":"n/a","extra":"x' || user_id || '"}}'
            WHEN event_id % 3 = 2 THEN '{{"extra":"x' || user_id || '"}}'
            WHEN event_id % 101 = 0 THEN '{{"value":"n/a"}}' END AS _rescued_data
FROM events""",
    "bronze_parquet_drift": """SELECT l.load, event_id,
       CASE WHEN event_id % 10 = 5 THEN NULL ELSE user_id END AS user_id, event_type,
       CASE WHEN event_id % 2 = 0 THEN NULL
            WHEN event_id % 10 = 5 THEN '{"user_id":"u' || user_id || '","props":' || to_json(props) || '}'
            ELSE '{"props":' || to_json(props) || '}' END AS _rescued_data
FROM events, (VALUES ('stream'), ('batch')) AS l(load)""",
    "bronze_json": f"""WITH {RAW_JSON}
SELECT event_id AS id, value, CASE WHEN event_id % 2 = 1 THEN '{{"new":"1"}}' END AS _rescued_data FROM raw""",
    "bronze_nested": r"""SELECT l.load, o_orderkey AS id,
       CASE WHEN k NOT IN (4, 5) THEN o_custkey END AS customer_key,
       CASE WHEN k <> 4 THEN substr(o_orderpriority, 1, 1)::BIGINT END AS customer_tier,
       CASE WHEN k <> 3 THEN 2 END AS n_items,
       CASE WHEN k <> 3 THEN o_custkey % 50 END AS qty_1,
       CASE WHEN k NOT IN (1, 3) THEN o_custkey % 50 END AS qty_2,
       CASE k WHEN 1 THEN '{"$.items[1].qty":"n/a"}'
              WHEN 2 THEN '{"$.customer.vip":"true"}'
              WHEN 3 THEN '{"items":"{\"line\":1,\"qty\":' || o_custkey % 50 || '}"}'
              WHEN 5 THEN '{"$.customer.key":"K' || o_custkey || '"}' END AS _rescued_data
FROM (SELECT *, o_orderkey % 7 AS k FROM orders), (VALUES ('json'), ('parquet')) AS l(load)""",
    "silver_stream": _SQL["keep_latest_lineitem"],
    "silver_state": _SQL["keep_latest_lineitem"],
    "transactions_stream": _SQL["transactions_stream"],
    "gold_incremental": _SQL["daily_revenue"],
    "gold_incremental_category": _SQL["revenue_by_category_daily"],
    "ecommerce_chain": f"""WITH {CONFORMED}
SELECT CAST(transaction_timestamp AS DATE) AS transaction_date, CAST(count(DISTINCT order_id) AS BIGINT) AS order_count,
       CAST(sum(gross_amount) AS DECIMAL(28,2)) AS daily_gross_revenue,
       {_said(gold_daily_suite().docs)}
FROM valid WHERE order_status <> 'PENDING' GROUP BY 1""",
    "mainframe_chain": f"""SELECT customer_id, customer_lifetime_value, customer_tier, is_dormant_risk,
       {_said(customer_value_suite().docs)}
FROM ({_SQL["customer_value"]})""",
}
