"""Derived inputs: the driver tables seen as surveys, networks, walks and texts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import hubs, pricing, sequence, tours
from gridloom.operators.paths import nearest_stations, shortest_paths
from gridloom.session import cut, kept

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Inputs:
    """Lazily built inputs over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def measured_lineitem(self) -> DataFrame:
        """lineitem with its amounts as exact decimals."""
        return self.lineitem.selectExpr(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
            "CAST(l_quantity AS BIGINT) AS qty",
            "CAST(l_extendedprice AS DECIMAL(18,2)) AS price",
            "CAST(l_discount AS DECIMAL(4,2)) AS disc",
            "CAST(l_tax AS DECIMAL(4,2)) AS tax",
        )

    @cached_property
    def survey(self) -> DataFrame:
        """One line reading per lineitem row, supplier nation to customer nation.

        Nations come last: a supplier joined to its nation first is no longer known
        to be small, and every line would be shuffled once more to meet it. Orders are
        looked up by hash within their partition; lines are not sorted for it.
        """
        def nation(key, name):
            return F.broadcast(self.nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name)))

        orders = self.orders.select("o_orderkey", "o_custkey").join(
            self.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).hint("shuffle_hash")
        rows = (
            self.measured_lineitem
            .join(self.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(nation("sk", "src"), F.col("s_nationkey") == F.col("sk"))
            .join(nation("dk", "dst"), F.col("c_nationkey") == F.col("dk"))
        )
        return rows.selectExpr(
            "concat_ws('-', lpad(CAST(l_orderkey AS STRING), 12, '0'), CAST(l_linenumber AS STRING), "
            "lpad(CAST(l_partkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0')) AS row_number",
            "CASE WHEN tax = 0.08 AND disc = 0.10 AND qty < 5 THEN '  ' ELSE src END AS source",
            "dst AS destination",
            "CASE l_returnflag WHEN 'A' THEN 'hydro' WHEN 'N' THEN 'thermal' END AS line_type",
            "CASE WHEN sk <> 13 AND disc > 0 THEN CAST(sk * 1.5 - 20 + CASE WHEN tax = 0.08 THEN 0.25 ELSE 0 END AS DECIMAL(9,4)) END AS src_lat",
            "CASE WHEN sk <> 13 THEN CAST(sk * 3.0 - 40 AS DECIMAL(9,4)) END AS src_lon",
            "CASE WHEN dk <> 13 AND disc > 0.01 THEN CAST(dk * 1.5 - 20 AS DECIMAL(9,4)) END AS dst_lat",
            "CASE WHEN dk <> 13 THEN CAST(dk * 3.0 - 40 AS DECIMAL(9,4)) END AS dst_lon",
            "CASE WHEN tax = 0 AND disc = 0.10 THEN NULL WHEN tax = 0 AND disc = 0 THEN CAST(0 AS DECIMAL(18,3)) "
            "ELSE CAST(price AS DECIMAL(18,3)) END AS distance_km",
            "CAST(qty * 10 AS BIGINT) AS voltage_kv",
            "CASE WHEN disc <> 0.05 THEN CAST(price * 2 AS DECIMAL(18,3)) END AS capacity_mw",
            "CAST(disc * 100 AS DECIMAL(9,3)) AS loss_percent",
            "CASE WHEN tax <> 0.01 THEN CAST(price * disc AS DECIMAL(18,4)) END AS energy_loss_mw",
        )

    @cached_property
    def lines_raw(self) -> DataFrame:
        """The survey as the text cells of a file, stray spaces and unreadable numbers included."""
        numbers = ("src_lat", "src_lon", "dst_lat", "dst_lon", "voltage_kv", "capacity_mw", "energy_loss_mw")
        return self.survey.selectExpr(
            "row_number", "concat(' ', source, '\\t') AS source", "concat(destination, '  ') AS destination",
            "line_type", *[f"CAST({c} AS STRING) AS {c}" for c in numbers],
            "CASE WHEN distance_km IS NULL THEN 'n/a' WHEN distance_km = 0 THEN ' -1e3 ' "
            "ELSE CAST(distance_km AS STRING) END AS distance_km",
            "CASE WHEN loss_percent = 1 THEN 'nan' WHEN loss_percent = 2 THEN '2d' "
            "ELSE concat(CAST(loss_percent AS STRING), ' ') END AS loss_percent")

    @cached_property
    def survey_clean(self) -> DataFrame:
        """The survey after the loader's own cleaning: no blank ends, no non-positive distance."""
        return self.survey.where("trim(source) <> ''").withColumn(
            "distance_km", F.when(F.col("distance_km") > 0, F.col("distance_km")))

    def _sparse(self, pairs: DataFrame) -> DataFrame:
        """Keep a pair if it is among the two busiest of either end."""
        def best(end, other):
            by = Window.partitionBy(end).orderBy(F.desc("qty"), other)
            return pairs.withColumn("rn", F.row_number().over(by)).where("rn <= 2").drop("rn")
        return best("a", "b").union(best("b", "a")).distinct()

    @cached_property
    def net(self) -> DataFrame:
        """The sparse nation network: one line per kept unordered pair."""
        pairs = (
            self.survey.where("trim(source) <> '' AND source <> destination")
            .groupBy(F.least("source", "destination").alias("a"), F.greatest("source", "destination").alias("b"))
            .agg(F.expr("CAST(sum(voltage_kv) / 10 AS BIGINT)").alias("qty"),
                 F.sum("energy_loss_mw").alias("loss"), F.max("loss_percent").alias("loss_percent"),
                 F.max("voltage_kv").alias("voltage_kv"), F.max("capacity_mw").alias("capacity_mw"))
        )
        return self._sparse(pairs).selectExpr(
            "a", "b",
            "CAST(CAST((200000000 + qty) div (2 * qty) AS DECIMAL(18,0)) * 0.001 AS DECIMAL(18,3)) AS distance_km",
            "voltage_kv", "capacity_mw", "loss_percent",
            "CASE WHEN a <> 'NATION_3' AND b <> 'NATION_3' THEN CAST(loss AS DECIMAL(24,4)) END AS energy_loss_mw",
        )

    @cached_property
    def net_cut(self) -> DataFrame:
        return cut(self.net)

    @cached_property
    def net_stations(self) -> DataFrame:
        return self.nation.select(F.col("n_name").alias("name"))

    @cached_property
    def _pairs_by_number(self) -> DataFrame:
        """(o_custkey, l_suppkey, qty, loss): a customer's lines meet in one task as they are, so grouping and ranking by customer shuffle nothing more."""
        return (
            self.measured_lineitem.selectExpr(
                "l_orderkey", "l_suppkey", "qty", "CAST(price * disc AS DECIMAL(18,4)) AS loss")
            .join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select("o_custkey", "l_suppkey", "qty", "loss").repartition("o_custkey")
            .groupBy("o_custkey", "l_suppkey").agg(F.sum("qty").alias("qty"), F.sum("loss").alias("loss"))
        )

    @cached_property
    def grid_pairs(self) -> DataFrame:
        return self._pairs_by_number.selectExpr("concat('C', o_custkey) AS a", "concat('S', l_suppkey) AS b", "qty", "loss")

    @cached_property
    def grid(self) -> DataFrame:
        """The customer-supplier network, whose stations and lines grow with the data. What `_sparse` keeps, ranked by numbers; ties go by name."""
        def best(end, other):
            by = Window.partitionBy(end).orderBy(F.desc("qty"), F.col(other).cast("string"))
            return self._pairs_by_number.withColumn("rn", F.row_number().over(by)).where("rn <= 2").drop("rn")
        return best("o_custkey", "l_suppkey").union(best("l_suppkey", "o_custkey")).distinct().selectExpr(
            "concat('C', o_custkey) AS a", "concat('S', l_suppkey) AS b",
            "CAST(CAST((200000000 + qty) div (2 * qty) AS DECIMAL(18,0)) * 0.001 AS DECIMAL(18,3)) AS distance_km",
            "CASE WHEN loss > 0 THEN CAST(loss AS DECIMAL(24,4)) END AS energy_loss_mw",
        )

    @cached_property
    def grid_cut(self) -> DataFrame:
        return kept(self.grid, "grid")

    @cached_property
    def grid_stations(self) -> DataFrame:
        return self.customer.selectExpr("concat('C', c_custkey) AS name").union(
            self.supplier.selectExpr("concat('S', s_suppkey) AS name"))

    @cached_property
    def event_lines(self) -> DataFrame:
        """Lines between event types that follow each other in some walk, but for one pair; one is without a loss reading.

        Pairs come from the walks themselves, each task's own made distinct first; the
        totals per type, one aggregated row each, are looked up for both ends.
        """
        pairs = self.walk_stops.where("prev_event_type IS NOT NULL").select(
            F.least("prev_event_type", "event_type").alias("a"), F.greatest("prev_event_type", "event_type").alias("b")).distinct()
        kinds = self.events.groupBy("event_type").agg(
            F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
        low = kinds.select(F.col("event_type").alias("a"), F.col("n").alias("low_n"), F.col("v").alias("low_v"))
        high = kinds.select(F.col("event_type").alias("b"), F.col("n").alias("high_n"), F.col("v").alias("high_v"))
        return (
            pairs.where("NOT (a = 'error' AND b = 'signup')").join(low, "a").join(high, "b")
            .selectExpr(
                "a", "b", "CAST(low_n + high_n AS DECIMAL(18,3)) AS distance_km",
                "CASE WHEN NOT (a = 'click' AND b = 'view') THEN CAST(low_v + high_v AS DECIMAL(18,4)) END AS energy_loss_mw")
        )

    @cached_property
    def feeders(self) -> DataFrame:
        """Strong lines only: an end's busiest pair, if enough runs over it. Many groups, some lone stations."""
        def busiest(end, other):
            by = Window.partitionBy(end).orderBy(F.desc("qty"), other)
            return self.grid_pairs.withColumn("rn", F.row_number().over(by)).where("rn = 1 AND qty >= 70").drop("rn")
        return busiest("a", "b").union(busiest("b", "a")).distinct().selectExpr(
            "a", "b", "CAST(qty AS DECIMAL(18,3)) AS distance_km")

    @cached_property
    def near(self) -> DataFrame:
        """The five stations nearest to every customer and supplier, and itself at rank 0."""
        return kept(nearest_stations(self.grid_cut, self.grid_stations.select(F.col("name").alias("origin")), 5), "near")

    @cached_property
    def instances(self) -> DataFrame:
        """(instance_id, name, km, rank, far): the full instances of six stations around every station, and how far the last is."""
        members = F.collect_list(F.struct(F.col("node").alias("name"), "km", "rank")).alias("members")
        full = self.near.where("origin IS NOT NULL").groupBy(F.col("origin").alias("instance_id")).agg(
            members, F.max("km").alias("far")).where(F.size("members") == 6)
        return full.select("instance_id", F.inline_outer("members"), "far")

    @cached_property
    def instance_tables_open(self) -> DataFrame:
        """Names and distances of every instance, from hub labels; no member is further than over the start."""
        limits = self.instances.select("instance_id", "name", (F.col("km") + F.col("far")).alias("max_km"))
        labels = hubs.hub_labels(self.grid_cut, limits.select("name", "max_km"))
        return hubs.label_matrices(tours.fitting_members(limits), labels, stored=True)

    @property
    def instance_costs(self) -> DataFrame:
        return tours.table_costs(self.instance_tables_open)

    @property
    def instance_distances(self) -> DataFrame:
        """Distances between members of one instance."""
        return self.instance_costs.select("origin", "node", "km").distinct()

    def leg_ways(self, legs: DataFrame) -> DataFrame:
        """Chains of stations for the legs of instance tours. Their lengths are known, so no search goes further."""
        lengths = legs.join(
            self.instance_costs.select("origin", F.col("node").alias("destination"), "km").distinct(), ["origin", "destination"])
        return shortest_paths(self.grid_cut, lengths.select("origin", F.col("km").alias("max_km")))

    @property
    def instance_tables(self) -> DataFrame:
        return tours.whole(self.instance_tables_open)

    @cached_property
    def instance_starts(self) -> DataFrame:
        return self.instances.where("rank = 0").select("instance_id", F.col("name").alias("start"))

    @cached_property
    def net_closure(self) -> DataFrame:
        return shortest_paths(self.net_cut, self.net_stations.select(F.col("name").alias("origin")))

    @cached_property
    def net_tours(self) -> DataFrame:
        """Nearest-neighbour tours of the nation network, one from every start."""
        members = self.net_stations.select(F.lit("net").alias("instance_id"), "name")
        tables = tours.matrices(tours.cost_pairs(members, self.net_closure))
        starts = self.net_stations.select(F.lit("net").alias("instance_id"), F.col("name").alias("start"))
        return cut(tours.nn_tours(tables, starts))

    @cached_property
    def net_orders(self) -> DataFrame:
        return self.net_tours.select(
            F.col("start").alias("tour_id"), "start", tours.stop_names().alias("stops"), "total_km")

    @cached_property
    def net_legs(self) -> DataFrame:
        """The legs of those tours with distance and path: (tour_id, step, origin, destination, km, path, is_direct)."""
        return tours.travelled_legs(tours.tour_legs(self.net_orders), self.net_closure, self.net_cut)

    @cached_property
    def walk_stops(self) -> DataFrame:
        """What each user did in order, a stay at one event type collapsed to its first event."""
        events = self.events.select("user_id", "ts", "event_id", "event_type", "value").withColumn(
            "hour", F.date_trunc("hour", "ts"))
        return sequence.collapse_repeats(events, ["user_id"], "hour", ["ts", "event_id"], "event_type")

    @staticmethod
    def _as_legs(stops: DataFrame, step: str) -> DataFrame:
        path = F.when(F.col("value") >= 1, F.array("prev_event_type", "event_type")).otherwise(
            F.array().cast("array<string>"))
        return stops.where("prev_event_type IS NOT NULL").select(
            F.col("user_id").cast("string").alias("route_id"), F.expr(step).alias("step"),
            F.col("prev_event_type").alias("origin"), F.col("event_type").alias("destination"), path.alias("path"))

    @cached_property
    def walk_hops(self) -> DataFrame:
        """Every user's walk as legs named by their event, which needs no numbering."""
        return self._as_legs(self.walk_stops, "event_id")

    @cached_property
    def walk_numbered(self) -> DataFrame:
        return sequence.with_position(self.walk_stops, ["user_id"], "hour", ["ts", "event_id"])

    @cached_property
    def walk_legs(self) -> DataFrame:
        """Every user's walk as numbered legs; a small event records no path."""
        return self._as_legs(self.walk_numbered, "step - 1")

    @cached_property
    def walk_counts(self) -> DataFrame:
        return pricing.step_counts(self.walk_hops, self.event_lines)

    @cached_property
    def half_counts(self) -> DataFrame:
        """Steps of each user's first and second half as two routes: route_id, user_id, label."""
        halves = self.walk_numbered.withColumn(
            "half", F.when(2 * (F.col("step") - 1) <= F.col("step_count") - 1, "classical").otherwise("hybrid"))
        legs = self._as_legs(
            halves.withColumn("user_id", F.concat_ws("/", "user_id", "half")), "step - 1")
        return pricing.step_counts(legs, self.event_lines).withColumn(
            "user_id", F.substring_index("route_id", "/", 1)).withColumn("label", F.substring_index("route_id", "/", -1))

    @cached_property
    def corpus(self) -> DataFrame:
        return self.documents.selectExpr(
            "'index' AS corpus_id", "concat('doc:', lpad(CAST(doc_id AS STRING), 12, '0')) AS id",
            "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'dataset' "
            "WHEN source IN ('src4', 'src5', 'src6') THEN 'code' ELSE 'doc' END AS kind",
            "concat(lang, ' document') AS title", "source AS locator", "text")

    @cached_property
    def md_docs(self) -> DataFrame:
        """Documents as Markdown: some line openings become headings, some become fenced code."""
        text = F.concat(F.lit("# "), "source", F.lit("\n\n"), "text")
        text = F.regexp_replace(text, "\n(A[a-z]* )", "\n\n## $1\n\n")
        text = F.regexp_replace(text, "\n(E[a-z]* )", "\n\n### $1\n\n")
        text = F.regexp_replace(text, "\n(I[a-z]* )", "\n```\n# $1\n```\n \n")
        return self.documents.select(
            F.col("doc_id"), F.concat(F.lit("Docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"),
            text.alias("text"), F.when(F.col("lang") == "en", "Kept as written.").alias("standing"), "lang")

    @cached_property
    def questions(self) -> DataFrame:
        """Planted benchmark passages, the same spelled backwards as questions off the topic, and what users asked in conversations."""
        return self.benchmark.selectExpr("concat('b', item_id) AS qid", "text AS question").union(
            self.benchmark.selectExpr("concat('o', item_id) AS qid", "reverse(text) AS question")).union(
            self.conversations.where("role = 'user'").selectExpr(
                "concat('c', conv_id, '.', turn) AS qid", "text AS question"))

    @cached_property
    def points(self) -> DataFrame:
        return self.embeddings.selectExpr(
            "vec_id AS id", "label",
            "CAST(embedding[0] AS DOUBLE) AS x", "CAST(embedding[1] AS DOUBLE) AS y")
