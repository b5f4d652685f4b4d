"""Queries: each applies operators to whole tables. ``ORACLES`` holds equivalent DuckDB SQL by the same names."""

from __future__ import annotations

import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import checks
from skein.functions import scalar
from skein.operators import graph, labels, metrics, raster, spatial, splits, text, timeseries
from skein.runtime import shared_folder, table
from skein.sources import readers, writers

REGISTRY: dict = {}

#: Contiguous windows over the days of ``events``, ends included.
PHASES = [
    (0, "dry", "2024-01-01", "2024-01-10", False, False),
    (1, "rising", "2024-01-11", "2024-01-14", False, False),
    (2, "peak", "2024-01-15", "2024-01-20", True, False),
    (3, "receding", "2024-01-21", "2024-01-30", True, True),
]
THRESHOLDS = [round(0.1 + 0.05 * k, 2) for k in range(17)]
#: Wards: simple rings over the plane of the synthetic places.
WARDS = [
    (1, [(0, 0), (40, 0), (40, 30), (0, 30)]),
    (2, [(40, 0), (90, 0), (65, 45)]),
    (3, [(0, 30), (40, 30), (60, 60), (30, 90), (0, 70)]),
    (4, [(70, 50), (95, 50), (95, 95), (82, 70), (70, 95)]),
]


def query(f):
    REGISTRY[f.__name__] = f
    return f


def phases(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(PHASES, "phase_id int, phase_name string, start string, end string, flooded boolean, receding boolean")
    return rows.withColumns({"start": F.to_date("start"), "end": F.to_date("end")})


def events(spark, d, kind: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type") == kind)


def amounts(spark, d) -> DataFrame:
    fine = timeseries.hourly(events(spark, d, "view"), "ts", "value")
    coarse = events(spark, d, "purchase").groupBy(F.to_date("ts").alias("date")).agg(F.sum("value").alias("total"))
    return timeseries.downscale(fine, coarse)


def totals(spark, d) -> DataFrame:
    return timeseries.phase_totals(amounts(spark, d), phases(spark))


@query
def downscale_hourly(spark, d):
    return amounts(spark, d).select("time", "date", F.round("share", 6).alias("share"), F.round("amount", 4).alias("amount"))


@query
def phase_totals(spark, d):
    return totals(spark, d)


@query
def phase_cumulative(spark, d):
    return timeseries.running_total(totals(spark, d))


@query
def phase_intensity(spark, d):
    return timeseries.intensity(totals(spark, d)).select("phase_id", "phase_name", "intensity")


@query
def wettest_days(spark, d):
    return timeseries.wettest(timeseries.daily(table(spark, d, "events"), "ts", "value"), 8)


@query
def peak_hour(spark, d):
    hours = timeseries.hourly(table(spark, d, "events"), "ts", "value")
    return timeseries.peak(hours.select("time", F.round("value", 3).alias("value")))


@query
def missing_daily_totals(spark, d):
    fine = timeseries.hourly(table(spark, d, "events"), "ts", "value")
    coarse = events(spark, d, "purchase").where("value > 250").groupBy(F.to_date("ts").alias("date")).agg(F.sum("value").alias("total"))
    return timeseries.missing_totals(fine, coarse)


def users(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id").distinct()


def named_sets(spark, d) -> dict[str, DataFrame]:
    rules = {"sar": ("error", 150), "model": ("purchase", 170), "news": ("signup", 190)}
    return {name: events(spark, d, kind).where(F.col("value") > over).select("user_id").distinct() for name, (kind, over) in rules.items()}


def before_and_still(spark, d):
    rows = events(spark, d, "error").where("value > 120")
    day = F.to_date("ts")
    return (
        rows.where(day.between("2024-01-15", "2024-01-20")).select("user_id").distinct(),
        rows.where(day.between("2024-01-21", "2024-01-30")).select("user_id").distinct(),
    )


def fused(spark, d) -> DataFrame:
    back = labels.recovered(*before_and_still(spark, d), "user_id")
    flags = phases(spark).select("phase_id", "flooded", "receding")
    return labels.fuse(users(spark, d), named_sets(spark, d), flags, back, "user_id")


@query
def fuse_labels(spark, d):
    return fused(spark, d)


@query
def source_agreement(spark, d):
    return labels.histogram(fused(spark, d).where("phase_id = 2"), "n_sources")


@query
def flooded_by_phase(spark, d):
    return labels.label_rates(fused(spark, d))


@query
def source_union(spark, d):
    return labels.union_of(list(named_sets(spark, d).values()), "user_id")


@query
def recovered_set(spark, d):
    return labels.recovered(*before_and_still(spark, d), "user_id")


@query
def still_flooded_set(spark, d):
    before, still = before_and_still(spark, d)
    return before.intersect(still)


@query
def recession_report(spark, d):
    return labels.recession(*before_and_still(spark, d), "user_id")


@query
def label_transitions(spark, d):
    return labels.transitions(fused(spark, d), phases(spark), "user_id")


@query
def broadcast_features(spark, d):
    per_phase = timeseries.running_total(totals(spark, d)).select("phase_id", "rainfall_t", "cumulative_rainfall_t")
    return labels.spread(users(spark, d), per_phase)


@query
def uniform_features(spark, d):
    return labels.uniform_within(broadcast_features(spark, d), "phase_id", "rainfall_t", "cumulative_rainfall_t")


@query
def tag_breakdown(spark, d):
    return labels.tag_counts(table(spark, d, "events"), "event_type", ["error", "purchase", "view"])


@query
def staggered_reveal(spark, d):
    moves = labels.transitions(fused(spark, d), phases(spark), "user_id").where("phase_id = 2")
    changes = moves.join(heights(spark, d), moves["user_id"] == F.col("node")).select(F.col("user_id").alias("key"), "y_t", "y_next", "elevation")
    return labels.staggered_reveal(changes)


def heights(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(F.round(F.avg("value"), 2).alias("elevation"))


def contacts(spark, d) -> DataFrame:
    """Users who signed up and who failed in the same hour."""
    a = events(spark, d, "signup").where("value > 100").select(F.col("user_id").alias("a"), F.date_trunc("hour", "ts").alias("h"))
    b = events(spark, d, "error").where("value > 100").select(F.col("user_id").alias("b"), F.date_trunc("hour", "ts").alias("h"))
    return a.join(b, "h").select("a", "b").distinct()


def predicted(spark, d) -> DataFrame:
    state = fused(spark, d).select(F.col("user_id").alias("node"), "phase_id", F.col("flood_label").alias("y"))
    steps = timeseries.intensity(totals(spark, d)).select("phase_id", "intensity")
    # the rule reads the intensity of the phase that a transition starts from
    pairs = steps.where("phase_id < 3").select("phase_id", (F.col("phase_id") + 1).alias("next_phase"), "intensity")
    pairs = pairs.join(F.broadcast(steps.agg((1.05 * F.avg("intensity")).alias("wet"))), F.lit(True))
    near = graph.adjacency(contacts(spark, d), "a", "b")
    return graph.propagate(state, near, heights(spark, d), pairs, rain_over=F.col("wet"), low_up_to=52.0)


def judged(spark, d) -> DataFrame:
    truth = labels.transitions(fused(spark, d), phases(spark), "user_id").select(F.col("user_id").alias("node"), "phase_id", F.col("y_next").alias("y_true"))
    share = F.col("node") % 20
    split = F.when(share < 14, "train").when(share < 17, "val").otherwise("test")
    return predicted(spark, d).join(truth, ["node", "phase_id"]).withColumn("split", split)


@query
def adjacency(spark, d):
    return graph.adjacency(contacts(spark, d), "a", "b")


@query
def rule_predict(spark, d):
    return predicted(spark, d)


@query
def rule_metrics(spark, d):
    return metrics.confusion(judged(spark, d))


@query
def metrics_by_split(spark, d):
    return metrics.confusion(judged(spark, d), "phase_id", "split")


@query
def comparison_table(spark, d):
    rows = judged(spark, d).withColumn("name", F.col("phase_id").cast("string"))
    rule = metrics.confusion(rows, "name", "split").select("name", "split", F.col("f1").alias("value"))
    base = metrics.confusion(rows.where("phase_id < 2").withColumn("y_pred", F.lit(1)), "name", "split").select("name", "split", F.col("f1").alias("value"))
    return labels.joined_reports(["0", "1", "2"], ["train", "val", "test"], rule_f1=rule, all_positive_f1=base)


def scored_documents(spark, d) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("lang", F.col("quality").alias("y_true"), F.col("n_chars").alias("score"))


@query
def auc_by_group(spark, d):
    return metrics.auc(scored_documents(spark, d), "lang")


@query
def threshold_sweep(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "A").cast("int").alias("y_true"), (F.col("l_discount") * 10).alias("score"))
    return metrics.threshold_sweep(rows, THRESHOLDS)


@query
def best_threshold(spark, d):
    return metrics.best_threshold(threshold_sweep(spark, d))


def ward_rows(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    split = F.when(F.col("c_nationkey") < 17, "train").when(F.col("c_nationkey") < 21, "val").otherwise("test")
    return rows.select("c_nationkey", split.alias("split"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").alias("x"))


@query
def ward_diagnostics(spark, d):
    return metrics.group_diagnostics(ward_rows(spark, d), "split", "c_nationkey", y="y", x="x")


@query
def split_informativeness(spark, d):
    return metrics.informativeness(ward_diagnostics(spark, d), "split", least_minority=30.0, least_corr=0.02)


@query
def verdict(spark, d):
    rows = ward_rows(spark, d).withColumnsRenamed({"y": "y_true", "x": "score"})
    aucs = metrics.auc(rows, "split").groupBy(F.lit(1).alias("k")).agg(F.max(F.when(F.col("split") == "val", F.col("auc"))).alias("val_auc"))
    found = split_informativeness(spark, d).groupBy(F.lit(1).alias("k")).agg(
        *[F.max(F.when(F.col("split") == s, F.col("n_informative"))).alias(f"{s}_informative") for s in ("val", "test")]
    )
    return aucs.join(found, "k").select("val_auc", "val_informative", "test_informative", metrics.verdict(F.col("val_auc"), F.col("val_informative"), F.col("test_informative")).alias("verdict"))


def segments(spark, d) -> DataFrame:
    """Streets: from the supplier's number to the part's size."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("l_suppkey").alias("u"), F.col("p_size").cast("long").alias("v")).distinct()
    return rows.select(scalar.segment_id(F.col("u").cast("string"), F.col("v").cast("string"), F.lit("0")).alias("segment_id"), "u", "v")


@query
def line_graph_edges(spark, d):
    return graph.line_edges(segments(spark, d))


@query
def line_graph_degree(spark, d):
    return graph.line_degree(segments(spark, d))


@query
def node_positions(spark, d):
    return graph.positions(segments(spark, d), "segment_id")


@query
def edge_index(spark, d):
    rows = segments(spark, d)
    return graph.edge_index(graph.line_edges(rows), graph.positions(rows, "segment_id"), "segment_id", "segment_id_from", "segment_id_to")


@query
def tiled_edge_index(spark, d):
    rows = graph.adjacency(contacts(spark, d), "a", "b").select(F.col("node").alias("src_pos"), F.col("neighbour").alias("dst_pos"))
    return graph.tiled(rows, 1000, 3)


@query
def edge_consistency(spark, d):
    return graph.edge_consistency(graph.line_edges(segments(spark, d)), segments(spark, d))


@query
def graph_profile(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")).union(table(spark, d, "part").select(F.col("p_size").cast("long")))
    return graph.graph_profile(segments(spark, d), nodes)


def sparse_links(spark, d) -> DataFrame:
    """Customers and their orders, which are numbered below zero."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("u"), (-F.col("o_orderkey") - 1).alias("v"))


@query
def weak_components(spark, d):
    return graph.weak_components(sparse_links(spark, d))


@query
def component_sizes(spark, d):
    return graph.component_sizes(graph.weak_components(sparse_links(spark, d)))


def hour_links(spark, d) -> DataFrame:
    """From the users of one hour to those of the next, among purchases."""
    rows = events(spark, d, "purchase").select("user_id", F.date_trunc("hour", "ts").alias("h"))
    after = rows.select(F.col("user_id").alias("v"), (F.col("h") - F.expr("INTERVAL 1 HOUR")).alias("h"))
    return rows.withColumnRenamed("user_id", "u").join(after, "h").select("u", "v").distinct()


@query
def strong_components(spark, d):
    return graph.strong_components(hour_links(spark, d))


@query
def neighbour_means(spark, d):
    near = graph.adjacency(contacts(spark, d), "a", "b")
    return graph.neighbour_mean(near, heights(spark, d), "elevation").withColumn("elevation_near", F.round("elevation_near", 4))


@query
def fingerprint(spark, d):
    return graph.fingerprint(segments(spark, d), "segment_id")


@query
def key_consistency(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return graph.key_consistency(a, table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k")


@query
def duplicate_segments(spark, d):
    return graph.duplicates(table(spark, d, "lineitem"), {"line": ["l_orderkey", "l_linenumber"], "pair": ["l_partkey", "l_suppkey"]})


@query
def passage_ids(spark, d):
    return text.with_passage_ids(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "passage_id")


@query
def label_upsert(spark, d):
    rows = table(spark, d, "events")
    stored = rows.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("labeled_at")).select("user_id", F.lit("view").alias("label"), "labeled_at")
    new = rows.where("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("labeled_at")).select("user_id", F.lit("click").alias("label"), "labeled_at")
    return text.upsert(stored, new, "user_id", "labeled_at")


@query
def labelling_progress(spark, d):
    return text.labelling_progress(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "quality")


def corpus(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")


def gazetteer(spark, d) -> DataFrame:
    """Names: the first two words of each benchmark passage."""
    name = F.regexp_extract("text", r"^([A-Za-z]+ [A-Za-z]+)", 1)
    return table(spark, d, "benchmark").select(name.alias("name"), F.col("item_id").cast("int").alias("place")).where("name <> ''")


@query
def html_paragraphs(spark, d):
    return readers.html_paragraphs(table(spark, d, "pages"), "page_id", "html")


@query
def phrase_candidates(spark, d):
    return text.phrases(corpus(spark, d), ["the", "in", "at", "of"])


@query
def novel_phrases(spark, d):
    return text.novel_phrases(phrase_candidates(spark, d), gazetteer(spark, d))[0]


@query
def covered_phrases(spark, d):
    return text.novel_phrases(phrase_candidates(spark, d), gazetteer(spark, d))[1]


@query
def exact_mentions(spark, d):
    return text.exact_mentions(corpus(spark, d), gazetteer(spark, d))


@query
def mentions_by_place(spark, d):
    rows = text.exact_mentions(corpus(spark, d), gazetteer(spark, d)).join(table(spark, d, "documents"), F.col("text_id") == F.col("doc_id"))
    return text.joined_mentions(rows, "name", "source")


@query
def ngram_windows(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("text_id"), "text")
    return text.windows(rows).groupBy("text_id", "n_words").agg(F.count("*").alias("n"), F.count_distinct(F.lower("span")).alias("n_distinct"))


@query
def fuzzy_mentions(spark, d):
    rows = text.geoparse(corpus(spark, d), gazetteer(spark, d))
    return rows.select("text_id", F.explode("matches").alias("m")).select("text_id", "m.*")


@query
def recall_of_known(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " ").alias("w"))
    known = F.array_distinct(F.array(F.element_at("w", 1), F.element_at("w", 2), F.element_at("w", 3)))
    found = F.array_distinct(F.array(F.lower(F.element_at("w", 1)), F.concat_ws(" ", F.element_at("w", 2), F.element_at("w", 4)), F.element_at("w", 5)))
    marked = text.recall_of_known(rows.select("item_id", known.alias("known"), found.alias("found")), "known", "found")
    return text.recall_report(marked)


@query
def precision_against_known_errors(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("span"), F.col("p_brand").alias("name"))
    wrong = table(spark, d, "part").where("p_size > 45").select(F.upper("p_name").alias("span"), F.col("p_brand").alias("name"))
    return text.precision_against(rows, wrong)


@query
def gazetteer_top1(spark, d):
    a = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("locality").alias("type"), F.col("n_nationkey").cast("long").alias("id"))
    b = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("landmark").alias("type"), F.col("r_regionkey").cast("long").alias("id"))
    c = table(spark, d, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, "road").otherwise("waterway").alias("type"), F.col("p_partkey").alias("id"))
    order = {"locality": 0, "landmark": 1, "candidate": 1, "waterway": 2, "road": 3}
    return text.top_by_priority(a.unionByName(b).unionByName(c), "name", "type", order, "id")


@query
def name_lookup(spark, d):
    names = table(spark, d, "part").select(F.concat(F.lit(" "), F.upper("p_type"), F.lit(" ")).alias("name")).distinct()
    kinds = table(spark, d, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n")).where("kind <> 'ECONOMY'")
    return text.lookup(names, kinds, "kind")


@query
def specific_names(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).union(table(spark, d, "nation").select("n_name")).union(table(spark, d, "region").select("r_name")).distinct()
    return names.where(scalar.has_name("name") & scalar.specific_name("name", ["asia", "europe"], least=5))


@query
def json_props(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", F.concat(F.lit("[{\"place\": \""), "event_type", F.lit("\", \"score\": "), F.col("value").cast("string"), F.lit("}]")).alias("j"))
    broken = F.when(F.col("event_type") == "view", F.lit("not json")).otherwise(F.col("j"))
    parsed = rows.withColumn("matches", scalar.parsed_matches(broken, "array<struct<place:string,score:double>>")).drop("j")
    return text.exploded_matches(parsed, "matches", F.col("event_type") != "click")


@query
def multi_value_names(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_type", F.lit("']"))).when(F.col("p_size") < 20, F.col("p_brand")).when(F.col("p_size") < 30, F.lit("[unquoted]")).alias("field"))
    return rows.select("p_partkey", F.explode(scalar.multi_values("field")).alias("value"))


@query
def located_signals(spark, d):
    rows = corpus(spark, d).join(text.exact_mentions(corpus(spark, d), gazetteer(spark, d)).groupBy("text_id").agg(F.collect_set("name").alias("found")), "text_id", "left")
    marked = text.located_signals(rows, F.expr("CASE WHEN contains(text, 'idiot') THEN 1 ELSE 0 END"), F.coalesce("found", F.array().cast("array<string>")))
    return marked.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.size("matches") > 0).alias("n_located"), F.count_if("deliverable").alias("n_deliverable"))


def grid(spark, d) -> DataFrame:
    """Vectors as a raster: a row per vector, a column per component."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v")).select("row", "col", F.col("v").cast("double").alias("value"))


def changes(spark, d) -> DataFrame:
    pre = grid(spark, d)
    post = pre.select("row", "col", (F.col("value") * F.col("value")).alias("value"))
    occurrence = pre.select("row", "col", F.when(F.col("col") % 16 == 3, F.lit(80.0)).otherwise(F.lit(10.0)).alias("value"))
    return raster.change_mask(pre, post, occurrence, k=1.5)


@query
def raster_change_mask(spark, d):
    return changes(spark, d).where("mask").select("row", "col", F.round("diff", 6).alias("diff"))


@query
def raster_sieve(spark, d):
    return raster.sieve(changes(spark, d), least=4).select("row", "col")


@query
def raster_region_areas(spark, d):
    return raster.region_areas(raster.mask_regions(changes(spark, d)), 0.01)


@query
def raster_slope(spark, d):
    return raster.slope(grid(spark, d), 30.0, 30.0).select("row", "col", F.round("slope_deg", 6).alias("slope_deg"))


@query
def raster_percentiles(spark, d):
    return metrics.percentiles(grid(spark, d), "value", [0.01, 0.05, 0.1, 0.5, 0.9])


@query
def raster_focal_median(spark, d):
    return raster.focal_median(grid(spark, d)).select("row", "col", F.round("median", 6).alias("median"))


@query
def raster_overlap(spark, d):
    cells = grid(spark, d)
    return raster.overlap(raster.over_threshold(cells, 0.1), raster.over_threshold(cells.withColumn("value", -F.col("value")), -0.15), 0.0009)


def places(spark, d, name: str, key: str) -> DataFrame:
    """Places derived from a key, spread over the plane."""
    k = F.col(key)
    return table(spark, d, name).select(key, ((k * 37) % 1009 / 10.09).alias("x"), ((k * 91) % 997 / 9.97).alias("y"))


def wards(spark) -> DataFrame:
    rows = [(n, [(float(x), float(y)) for x, y in ring]) for n, ring in WARDS]
    return spark.createDataFrame(rows, f"ward_no int, ring {spatial.POINTS}")


@query
def points_in_wards(spark, d):
    return spatial.points_in_polygons(places(spark, d, "customer", "c_custkey"), wards(spark), "c_custkey", "ward_no", 10.0).select("c_custkey", "ward_no")


@query
def nearest_site(spark, d):
    found = spatial.nearest(places(spark, d, "customer", "c_custkey"), places(spark, d, "supplier", "s_suppkey"), "c_custkey", "s_suppkey", 5.0)
    return found.withColumn("distance", F.round("distance", 6))


@query
def ward_fallback(spark, d):
    inside = spatial.points_in_polygons(places(spark, d, "customer", "c_custkey"), wards(spark), "c_custkey", "ward_no", 10.0)
    xs = wards(spark).select("ward_no", F.explode("ring").alias("p")).groupBy("ward_no").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))
    return spatial.with_fallback(inside, xs, "c_custkey", "ward_no", 10.0)


@query
def tiered_resolution(spark, d):
    spots = places(spark, d, "customer", "c_custkey")
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("mention_id"), F.concat(F.lit(" "), "c_mktsegment").alias("name"))
    mentions = names.join(spots, F.col("mention_id") == F.col("c_custkey")).select("mention_id", "name", "x", "y")
    named = spark.createDataFrame([(1, "Building"), (2, "MACHINERY ")], "entity_id int, name string")
    return spatial.tiered_resolution(mentions, named, wards(spark), 10.0)


BOXES = [(10.0, 10.0, 20.0, 25.0), (50.0, 5.0, 52.0, 90.0), (18.0, 20.0, 30.0, 40.0), (80.0, 80.0, 81.0, 81.0)]


def streets(spark, d) -> DataFrame:
    a = places(spark, d, "customer", "c_custkey")
    end = F.struct((F.col("x") + F.col("c_custkey") % 7 - 3).cast("double").alias("x"), (F.col("y") + F.col("c_custkey") % 5 - 2).cast("double").alias("y"))
    return a.select("c_custkey", F.array(F.struct("x", "y"), end).alias("geom"))


@query
def lines_in_extent(spark, d):
    boxes = spark.createDataFrame(BOXES, "x0 double, y0 double, x1 double, y1 double")
    return spatial.lines_meeting_boxes(streets(spark, d), boxes, "c_custkey", 5.0)


@query
def line_lengths(spark, d):
    return streets(spark, d).select("c_custkey", F.round(spatial.line_length(F.col("geom")), 3).alias("length_m"))


@query
def sampled_elevation(spark, d):
    lines = streets(spark, d)
    points = spatial.spaced_points(lines, "c_custkey", step=1.0, most=50).drop("k")
    sampled = spatial.sample_raster(points, grid(spark, d), 0.0, 100.0, 1.5, 0.5)
    return sampled.groupBy("c_custkey").agg(F.count("value").alias("n_valid"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query
def clipped_extent(spark, d):
    boxes = places(spark, d, "supplier", "s_suppkey").select("s_suppkey", (F.col("x") - 3).alias("x0"), (F.col("y") - 2).alias("y0"), (F.col("x") + 3).alias("x1"), (F.col("y") + 2).alias("y1"))
    cut = spatial.clipped_boxes(boxes, 10.0, 10.0, 60.0, 50.0)
    return cut.select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query
def area_by_zone(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return spatial.area_by_label(rows, "r_name", "n_name", area="s_acctbal")


@query
def ward_areas(spark, d):
    return wards(spark).select("ward_no", F.round(spatial.ring_area(F.col("ring")), 6).alias("area"), F.size("ring").cast("long").alias("n_corners"))


@query
def nearest_valid_cell(spark, d):
    cells = table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("cx"), F.floor(F.col("c_custkey") / 40).alias("cy"), (F.col("c_acctbal") - 9000).alias("value"))
    return spatial.nearest_valid_cell(cells, 11.3, 7.6)


@query
def colour_depth(spark, d):
    depth = spatial.interpolated([(0.0, 0.0), (0.02, 0.5), (0.05, 0.8), (0.1, 3.0)], F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy("l_discount").agg(F.count("*").alias("n")).select("l_discount", "n", F.round(depth, 6).alias("depth"))


@query
def column_statistics(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("l_discount"))
    return metrics.column_stats(rows, "l_quantity", "l_extendedprice", "l_discount")


def feature_rows(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), F.lit(3.0).alias("flat"))
    return rows.withColumn("train", F.col("o_custkey") % 10 < 7)


@query
def feature_standardizers(spark, d):
    stats = metrics.standardizers(feature_rows(spark, d), F.col("train"), "price", "flat")
    return stats.select(*[F.round(c, 4).alias(c) for c in stats.columns])


@query
def standardized_features(spark, d):
    rows = feature_rows(spark, d)
    out = metrics.standardize(rows.select("o_orderkey", "price", "flat"), metrics.standardizers(rows, F.col("train"), "price", "flat"), "price", "flat")
    return out.select("o_orderkey", F.round("price", 5).alias("price"), F.round("flat", 5).alias("flat"))


@query
def class_balance(spark, d):
    return metrics.class_balance(ward_rows(spark, d), "split", y="y")


@query
def metric_across_folds(spark, d):
    return metrics.across_folds(ward_diagnostics(spark, d), "split", metric="pct_positive")


@query
def largest_difference(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("list", F.col("l_quantity") * F.col("p_retailprice"))
    return metrics.largest_difference(rows, "l_extendedprice", "list")


@query
def reproduced(spark, d):
    rows = table(spark, d, "orders")
    again = rows.where("o_orderkey > 10").withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return metrics.reproduced(rows, again, "o_orderkey", "o_totalprice")


@query
def ward_split(spark, d):
    return splits.group_split(table(spark, d, "customer"), "c_nationkey", {"train": 0.70, "val": 0.15, "test": 0.15})


@query
def ward_folds(spark, d):
    return splits.group_folds(table(spark, d, "customer"), "c_nationkey", 4)


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("y"))


@query
def linear_probe(spark, d):
    model = splits.fit_probe(vectors(spark, d), "embedding", "y")
    scored = splits.predict_probe(model, vectors(spark, d), "embedding").select(F.col("y").alias("y_true"), (F.col("y_prob") >= 0.5).cast("int").alias("y_pred"))
    return metrics.confusion(scored)


@query
def leave_one_out(spark, d):
    return splits.leave_one_out(vectors(spark, d), "vec_id", "embedding", "y").withColumn("y_prob", F.round("y_prob", 6))


@query
def kpi_scalars(spark, d):
    rows = fused(spark, d)
    return rows.agg(
        F.count_distinct("user_id").alias("n_entities"),
        F.count_if((F.col("phase_id") == 2) & (F.col("flood_label") == 1)).alias("n_peak"),
        F.count_if((F.col("phase_id") == 3) & (F.col("flood_label") == 1)).alias("n_receding"),
    )


@query
def tensor_permuted(spark, d):
    per_phase = timeseries.running_total(totals(spark, d)).select("phase_id", "rainfall_t", "cumulative_rainfall_t")
    long = labels.spread(users(spark, d), per_phase).unpivot(["user_id", "phase_id"], ["rainfall_t", "cumulative_rainfall_t"], "feature", "value")
    return long.groupBy("user_id", "feature").pivot("phase_id", [0, 1, 2, 3]).agg(F.first("value")).withColumnsRenamed({str(k): f"t{k}" for k in range(4)})


@query
def dashboard_star(spark, d):
    """The spine of entities with elevation, split, truth and prediction at the peak, gaps filled."""
    peak = fused(spark, d).where("phase_id = 2").select("user_id", F.col("flood_label").alias("truth"))
    guess = predicted(spark, d).where("next_phase = 2").select(F.col("node").alias("user_id"), "y_pred")
    high = heights(spark, d).where("elevation > 49").select(F.col("node").alias("user_id"), "elevation")
    sources = named_sets(spark, d)["sar"].withColumn("seen", F.lit(1))
    rows = users(spark, d).join(high, "user_id", "left").join(peak, "user_id", "left").join(guess, "user_id", "left").join(sources, "user_id", "left")
    filled = {"elevation": F.round(F.coalesce("elevation", F.lit(0.0)), 1), "seen": F.coalesce("seen", F.lit(0))}
    colour = F.when(F.col("truth") == 1, F.when(F.col("y_pred") == 1, "hit").otherwise("miss")).otherwise(F.when(F.col("y_pred") == 1, "alarm").otherwise("dry"))
    return rows.withColumns(filled).withColumn("colour", colour).select("user_id", "elevation", "truth", "y_pred", "seen", "colour")


@query
def source_overlap(spark, d):
    """How the news source and the two others overlap, and who is in the news only."""
    sets = named_sets(spark, d)
    seen = labels.union_of([sets["sar"], sets["model"]], "user_id")
    return graph.key_consistency(sets["news"], seen, "user_id").withColumnsRenamed({"only_first": "news_only", "only_second": "others_only"})


@query
def graph_report(spark, d):
    """The line graph's report, a row per metric."""
    rows = segments(spark, d)
    profile = graph.graph_profile(rows, graph.nodes_of(rows))
    line = graph.line_degree(rows).agg(F.sum("n_edges").alias("n_line_edges"), F.max("n_edges").alias("most_at_a_junction"))
    parts = graph.weak_components(rows).agg(F.count_distinct("component").alias("n_components"))
    return metrics.metric_rows(profile).unionByName(metrics.metric_rows(line)).unionByName(metrics.metric_rows(parts))


@query
def fusion_report(spark, d):
    rows = fused(spark, d)
    peak = rows.where("phase_id = 2")
    counts = peak.agg(*[F.sum(c).cast("long").alias(c) for c in ("in_sar", "in_model", "in_news")], F.count_if(F.col("n_sources") >= 2).alias("two_or_more"))
    return metrics.metric_rows(counts).unionByName(metrics.metric_rows(rows.agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_entities"))))


@query
def first_scene(spark, d):
    """The first event of a type inside a window of time and a range of values."""
    rows = table(spark, d, "events").where("event_type = 'view' AND value BETWEEN 40 AND 60 AND ts >= '2024-01-10' AND ts < '2024-01-12'")
    return rows.orderBy("ts", "event_id").limit(1).select("event_id", "ts", "user_id")


@query
def daily_peaks(spark, d):
    """The hour of the largest sum of each day, the earliest among equals."""
    hours = timeseries.hourly(table(spark, d, "events"), "ts", "value").withColumn("value", F.round("value", 3))
    best = hours.groupBy(F.to_date("time").alias("date")).agg(F.min(F.struct((-F.col("value")).alias("v"), "time")).alias("b"))
    return best.select("date", F.col("b.time").alias("time"), (-F.col("b.v")).alias("value"))


@query
def penalty_grid(spark, d):
    rows = table(spark, d, "embeddings").select("embedding", (F.col("label") < 5).cast("int").alias("y"), (F.col("vec_id") % 12).alias("ward"))
    return splits.grid_search(rows, splits.group_folds(rows, "ward", 3), "ward", "embedding", "y", [0.01, 0.1])


@query
def utm_places(spark, d):
    """Places between 79 and 81 degrees east in metres of zone 44."""
    spots = places(spark, d, "supplier", "s_suppkey").select("s_suppkey", (79 + F.col("x") / 50).alias("lon"), (12 + F.col("y") / 50).alias("lat"))
    x, y = spatial.utm(F.col("lon"), F.col("lat"), 44)
    return spots.select("s_suppkey", F.round(x, 2).alias("easting"), F.round(y, 2).alias("northing"))


def scratch(spark, name: str) -> str:
    """A new place in the shared folder, for queries that write and read back."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query
def csv_hourly(spark, d):
    hours = timeseries.hourly(table(spark, d, "events"), "ts", "value")
    path = scratch(spark, "csv")
    writers.csv(hours.select(F.col("time").cast("timestamp_ntz").alias("time"), F.round("value", 3).alias("precipitation_mm")), path)
    return readers.csv(spark, path, readers.HOURLY)


@query
def csv_parts(spark, d):
    """Ids with leading zeros, quotes, commas and line ends come back as they were."""
    path = scratch(spark, "csv")
    said = F.concat(F.lit('say "'), "p_name", F.lit('",\n'), "p_type")
    writers.csv(table(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), said.alias("said")), path)
    return readers.csv(spark, path, "id string, said string")


def bent_streets(spark, d) -> DataFrame:
    """Streets of two straight parts."""
    a = places(spark, d, "customer", "c_custkey")
    k = F.col("c_custkey")
    middle = F.struct((F.col("x") + k % 7 - 3).cast("double").alias("x"), (F.col("y") + k % 5 - 2).cast("double").alias("y"))
    end = F.struct((F.col("x") + k % 3).cast("double").alias("x"), (F.col("y") + k % 11 - 5).cast("double").alias("y"))
    return a.select("c_custkey", F.array(F.struct("x", "y"), middle, end).alias("geom"))


@query
def geojson_streets(spark, d):
    path = scratch(spark, "geojson")
    writers.geojson_collection(bent_streets(spark, d), path)
    lines = readers.geojson_lines(spark, path, "c_custkey:bigint")
    return lines.select("c_custkey", "part", F.size("geom").alias("n_points"), F.round(spatial.line_length(F.col("geom")), 3).alias("length_m"))


@query
def geojson_wards(spark, d):
    path = scratch(spark, "geojson")
    writers.geojson_collection(wards(spark), path, geom="ring", kind="Polygon")
    rows = readers.geojson(spark, path, "ward_no:int")
    return rows.select("ward_no", "kind", F.round(spatial.ring_area(F.col("geom")), 6).alias("area"), F.size("geom").cast("long").alias("n_corners"), F.size("holes").cast("long").alias("n_holes"))


@query
def graphml_segments(spark, d):
    edges = segments(spark, d).select("u", "v", F.lit("0").alias("key"), (F.col("u") * 0.5 + F.col("v")).alias("length"))
    nodes = graph.nodes_of(edges).select("node", (F.col("node") * 0.25).alias("x"), (F.col("n_in") - F.col("n_out")).cast("double").alias("y"))
    path = scratch(spark, "graphml")
    writers.graphml(nodes, edges, path)
    back, lines = readers.graphml(spark, path)
    ends = lines.join(back, lines["u"] == back["node"]).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "key", "length", "x", "y")
    return ends


@query
def json_nations(spark, d):
    path = scratch(spark, "json")
    pair = F.struct("n_name", F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey") + 0.5))
    table(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(pair))).alias("value")).write.text(path)
    return readers.json_dict(spark, path).select("key", F.col("value")[0].alias("a"), F.col("value")[1].alias("b"))


@query
def npy_nations(spark, d):
    import numpy as np

    raw, path = io.BytesIO(), scratch(spark, "npy") + ".npy"
    rows = table(spark, d, "nation").orderBy("n_nationkey").select(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double"))
    np.save(raw, rows.toPandas().to_numpy())
    writers.put(spark, path, raw.getvalue())
    return readers.npy(spark, path).select(F.col("index")[0].alias("row"), F.col("index")[1].alias("col"), "value")


@query
def geotiff_pixels(spark, d):
    path = scratch(spark, "geotiff")
    gaps = grid(spark, d).withColumn("value", F.when(F.col("col") != 5, F.col("value")))
    writers.geotiff(gaps, path, x0=100.0, y0=50.0, dx=2.0, dy=4.0, tile=48)
    back = readers.geotiff(spark, path)
    return back.select(F.floor((50.0 - F.col("y")) / 4.0).cast("int").alias("row"), F.floor((F.col("x") - 100.0) / 2.0).cast("int").alias("col"), F.round("value", 6).alias("value"))


@query
def json_report(spark, d):
    path = scratch(spark, "report")
    writers.report(kpi_scalars(spark, d), path)
    return spark.read.json(path)


@query
def tensor_sink(spark, d):
    path = scratch(spark, "tensor")
    writers.tensor(tensor_permuted(spark, d), path)
    return spark.read.parquet(path)


@query
def wkt_streets(spark, d):
    path = scratch(spark, "wkt")
    ends = places(spark, d, "supplier", "s_suppkey").select("s_suppkey", F.floor("x").cast("double").alias("x"), F.floor("y").cast("double").alias("y"))
    lines = ends.select("s_suppkey", F.array(F.struct("x", "y"), F.struct((F.col("x") + 1).alias("x"), F.col("y"))).alias("geom"), F.array("s_suppkey").alias("parts"))
    writers.wkt(lines, path)
    return spark.read.parquet(path)


@query
def saved_probe(spark, d):
    from pyspark.ml.classification import LogisticRegressionModel

    path, fitted = scratch(spark, "model"), splits.fit_probe(vectors(spark, d), "embedding", "y")
    writers.model(fitted, path)
    one = splits.predict_probe(fitted, vectors(spark, d), "embedding").select("vec_id", "y_prob")
    two = splits.predict_probe(LogisticRegressionModel.load(path), vectors(spark, d), "embedding").select("vec_id", "y_prob")
    return metrics.reproduced(one, two, "vec_id", "y_prob")


@query
def layer_probes(spark, d):
    k = F.col("page_id")
    status = F.when(k % 7 == 0, F.lit(404)).when(k % 11 == 0, F.lit(None)).otherwise(F.lit(200))
    rows = table(spark, d, "pages").select(k.alias("layer"), status.cast("int").alias("status"), F.length("html").alias("n_bytes"))
    return readers.probe_verdicts(rows, least_bytes=1500)


@query
def fallback_input(spark, d):
    """The second of three places has the table; an absent one is an empty table."""
    read = lambda path: spark.read.parquet(path)
    first = readers.optional(spark, [f"{d}/none.parquet", f"{d}/region.parquet", f"{d}/nation.parquet"], read, "r_regionkey int, r_name string")
    return first.unionByName(readers.optional(spark, [f"{d}/none.parquet"], read, "r_regionkey int, r_name string"))


@query
def looked_up_names(spark, d):
    """Names by a lookup that fails in two ways; a failed one is unverified, not absent."""

    def fetch(names):
        for name in names:
            if name[0] in "AM":
                raise (OSError if name[0] == "A" else ValueError)(name)
        return {n: n.lower() for n in names if len(n) > 5}

    return readers.fetched(table(spark, d, "nation").select(F.col("n_name").alias("name")), fetch, batch=1)


@query
def drawn_geometry(spark, d):
    """Lines as they are drawn, or straight between their ends where they are not."""
    rows = bent_streets(spark, d)
    k, first, last = F.col("c_custkey"), F.element_at("geom", 1), F.element_at("geom", -1)
    none = F.array().cast(spatial.POINTS)
    drawn = F.when(k % 4 == 1, F.lit(None)).when(k % 4 == 2, none).when(k % 4 == 3, F.slice("geom", 1, 1)).otherwise(F.col("geom"))
    whole = spatial.coalesced_geometry(F.when(k % 4 == 0, F.col("geom")), first, last)
    return rows.select("c_custkey", spatial.valid_geometry(drawn).alias("status"), F.round(spatial.line_length(whole), 3).alias("length_m"))


@query
def complete_regions(spark, d):
    return checks.require_all(table(spark, d, "region"), "r_name", ["ASIA", "EUROPE", "AFRICA"])


@query
def mapped_labels(spark, d):
    label = scalar.mapped_label("event_type", {"error": 1, "purchase": 1, "click": 0, "signup": 0}, ["view"])
    return table(spark, d, "events").select("event_id", label.alias("label")).where("label IS NOT NULL")


@query
def flooded_neighbours(spark, d):
    flooded = heights(spark, d).where("elevation > 55").select("node")
    return graph.flooded_neighbours(graph.adjacency(contacts(spark, d), "a", "b"), flooded)


@query
def control_and_target(spark, d):
    cells = grid(spark, d)
    target = raster.over_threshold(cells, 0.1)
    return raster.sampled_means(cells, target.withColumn("mask", ~F.col("mask")), target, 1.0, 42)


@query
def homography_report(spark, d):
    """A projection fitted on nine control points, judged on all places."""
    spots = places(spark, d, "supplier", "s_suppkey").select("s_suppkey", "x", "y")
    u, v = spatial.apply_homography([1.1, 0.2, 5.0, -0.1, 0.9, 7.0, 0.0005, 0.0002], F.col("x"), F.col("y"))
    pairs = spots.withColumns({"u": u, "v": v})
    control = pairs.orderBy(F.pmod(F.col("s_suppkey") * 7, F.lit(101)), "s_suppkey").limit(9).select("x", "y", "u", "v")
    return spatial.homography_errors(spatial.fit_homography([tuple(r) for r in control.collect()]), pairs)


@query
def pooled_vectors(spark, d):
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, d, "embeddings").select("vec_id", F.array(v, F.reverse(v)).alias("vs"), F.array(F.lit(1.0), F.col("label").cast("double")).alias("ws"))
    pooled = rows.select("vec_id", text.weighted_mean_pool(F.col("vs"), F.col("ws")).alias("p"))
    return pooled.select("vec_id", F.posexplode("p").alias("col", "value")).select("vec_id", "col", F.round("value", 6).alias("value"))


@query
def first_events(spark, d):
    return spatial.first_per(table(spark, d, "events"), "user_id", F.col("ts"), F.col("event_id")).select("user_id", "ts", "event_id", "event_type")


@query
def end_to_end(spark, d):
    """Toxic texts as the truth, a word as the classifier, names as places."""
    found = text.exact_mentions(corpus(spark, d), gazetteer(spark, d)).groupBy("text_id").agg(F.collect_set("name").alias("found"))
    rows = corpus(spark, d).join(table(spark, d, "labels"), F.col("text_id") == F.col("doc_id")).join(found, "text_id", "left")
    marked = rows.select("toxic", F.expr("int(contains(text, 'the'))").alias("label"), F.coalesce("found", F.array().cast("array<string>")).alias("matches"))
    return text.end_to_end(marked, "toxic", "label", "matches")


@query
def run_report(spark, d):
    found = text.exact_mentions(corpus(spark, d), gazetteer(spark, d)).groupBy("text_id").agg(F.collect_set("name").alias("found"))
    rows = corpus(spark, d).join(found, "text_id", "left")
    return text.run_report(text.located_signals(rows, F.expr("int(contains(text, 'the'))"), F.coalesce("found", F.array().cast("array<string>"))))


@query
def labelled_passages(spark, d):
    known = text.with_passage_ids(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), "text").select("passage_id", F.col("quality").alias("label"))
    return text.labelled_corpus(table(spark, d, "documents").select("doc_id", "text"), known, "text").select("doc_id", "passage_id", "label")


@query
def tensor_report(spark, d):
    long = timeseries.running_total(totals(spark, d)).select(F.col("phase_id").alias("t"), "rainfall_t", "cumulative_rainfall_t")
    tensor = users(spark, d).select(F.col("user_id").alias("pos")).crossJoin(F.broadcast(long))
    tensor = tensor.withColumn("rainfall_t", F.when(F.col("pos") % 5 != 0, F.col("rainfall_t")))
    index = contacts(spark, d).select(F.col("a").alias("src_pos"), F.col("b").alias("dst_pos"))
    return checks.tensor_report(tensor, index, 1000, 4, ["rainfall_t", "cumulative_rainfall_t"])


@query
def accepted_labels(spark, d):
    rows = checks.accepted_labels(users(spark, d), fused(spark, d), "user_id", "phase_id", "flood_label", 4)
    return rows.groupBy("phase_id").agg(F.sum("flood_label").alias("n_flooded"), F.count("*").alias("n"))


@query
def added_metric(spark, d):
    rows = ward_rows(spark, d)
    sizes = rows.where("split <> 'train'").groupBy("split").agg(F.count("*").alias("value"))
    return metrics.added_metric(metrics.class_balance(rows, "split", y="y"), sizes, "n_rows", "split")


@query
def key_differences(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 5").select(F.col("l_orderkey").alias("k"))
    b = table(spark, d, "orders").where("o_orderkey % 50 <> 7").select(F.col("o_orderkey").alias("k"))
    return graph.key_differences(a, b, "k").select("side", "n", F.array_join("examples", ",").alias("examples"))


@query
def attribute_text(spark, d):
    rows = table(spark, d, "part").withColumn("tags", F.array("p_brand", "p_type"))
    return scalar.attributes(rows, ["p_partkey"], ["p_name", "p_size", "tags", "absent"])


@query
def spaced_points(spark, d):
    found = spatial.spaced_points(bent_streets(spark, d), "c_custkey", step=1.5, most=9)
    return found.select("c_custkey", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query
def bent_in_extent(spark, d):
    boxes = spark.createDataFrame(BOXES, "x0 double, y0 double, x1 double, y1 double")
    return spatial.lines_meeting_boxes(bent_streets(spark, d), boxes, "c_custkey", 5.0)


@query
def bent_in_wards(spark, d):
    return spatial.lines_meeting_polygons(bent_streets(spark, d), wards(spark).where("ward_no >= 3"), "c_custkey", 10.0)


@query
def nearest_drain(spark, d):
    """The nearest of the suppliers' lines to each street, both with their bends."""
    spots = places(spark, d, "supplier", "s_suppkey")
    line = F.array(F.struct("x", "y"), F.struct((F.col("x") + 2).alias("x"), (F.col("y") + 1).alias("y")), F.struct((F.col("x") + 3).alias("x"), (F.col("y") - 2).alias("y")))
    found = spatial.nearest_lines(bent_streets(spark, d), spots.select("s_suppkey", line.alias("geom")), "c_custkey", "s_suppkey", 5.0)
    return found.select("c_custkey", F.round("distance", 6).alias("distance"))


@query
def clipped_wards(spark, d):
    inside = spatial.clipped_polygons(wards(spark), [(20.0, 10.0), (80.0, 10.0), (80.0, 60.0), (20.0, 60.0)])
    return inside.select("ward_no", F.round(spatial.ring_area(F.col("ring")), 6).alias("area"))


@query
def metric_lengths(spark, d):
    spots = places(spark, d, "supplier", "s_suppkey").select("s_suppkey", (79 + F.col("x") / 50).alias("x"), (12 + F.col("y") / 50).alias("y"))
    line = F.array(F.struct("x", "y"), F.struct((F.col("x") + 0.01).alias("x"), (F.col("y") + 0.02).alias("y")))
    return spatial.metric_lengths(spots.select("s_suppkey", line.alias("geom")), "s_suppkey", digits=2)


@query
def region_outlines(spark, d):
    """The area that the outlines of each region enclose, holes taken off."""
    rings = raster.region_outlines(raster.mask_regions(changes(spark, d)))
    n = F.size("ring")
    term = F.transform(F.sequence(F.lit(1), n), lambda i: spatial._shoelace(F.element_at("ring", i), F.element_at("ring", F.when(i == n, F.lit(1)).otherwise(i + 1))))
    signed = F.aggregate(term, F.lit(0.0), lambda s, c: s + c) / 2
    return rings.select("region", signed.alias("a")).groupBy("region").agg(F.round(F.sum("a"), 6).alias("area"))


@query
def chosen_model(spark, d):
    rows = table(spark, d, "embeddings").select("embedding", (F.col("label") < 5).cast("int").alias("y"), (F.col("vec_id") % 12).alias("ward"))
    train, test = rows.where("ward < 9"), rows.where("ward >= 9")
    return splits.select_and_test(train, test, splits.group_folds(train, "ward", 3), "ward", "embedding", "y", [0.01, 0.1], THRESHOLDS)
