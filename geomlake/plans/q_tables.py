"""Queries of sources and sinks: map tables, upserts, text formats, completeness, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from geomlake.functions.vectors import near6, r6
from geomlake.plans.registry import query
from geomlake.sources import registry, store, timing
from geomlake.sources import tables as T
from geomlake.streaming import running

_MAPS = f"WITH {T.SQL_SUB}, m AS (SELECT unit AS map_name, subject AS unit_id, round(avg(value) + 1.7e-10, 6)::FLOAT AS value FROM sub GROUP BY ALL)"


def _maps(spark, sf_dir):
    s = T.subjects(spark, sf_dir).groupBy(F.col("unit").alias("map_name"), F.col("subject").alias("unit_id"))
    return s.agg(near6(F.avg("value")).cast("float").alias("value"))


@query("K01 K04 S01 S03", _MAPS + " SELECT map_name, unit_id, value FROM m WHERE map_name IN ('AF', 'RO')")
def partitioned_write_readback(spark, sf_dir):
    path = store.shared_folder(spark, "maps")
    store.write_maps(_maps(spark, sf_dir), path)
    return store.read_maps(spark, path, "AF", "RO").select("map_name", "unit_id", "value")


@query("K02 K03", _MAPS + " SELECT map_name, unit_id, value FROM m WHERE map_name NOT IN ('NF') UNION ALL SELECT 'NF', unit_id, (value * 2)::FLOAT FROM m WHERE map_name = 'AF' UNION ALL SELECT 'new', unit_id, value FROM m WHERE map_name = 'RO'")
def upsert_maps(spark, sf_dir):
    path, maps = store.shared_folder(spark, "maps"), _maps(spark, sf_dir)
    store.write_maps(maps, path)
    doubled = maps.where("map_name = 'AF'").select(F.lit("NF").alias("map_name"), "unit_id", (F.col("value") * 2).cast("float").alias("value"))
    store.upsert_maps(doubled.union(maps.where("map_name = 'RO'").select(F.lit("new").alias("map_name"), "unit_id", "value")), path)
    return store.read_maps(spark, path).select("map_name", "unit_id", "value")


@query("K08 U03", _MAPS + " SELECT DISTINCT map_name FROM m WHERE map_name NOT IN ('AF', 'NF') UNION ALL SELECT 'extra'")
def upsert_skip(spark, sf_dir):
    path, maps = store.shared_folder(spark, "maps"), _maps(spark, sf_dir)
    store.write_maps(maps.where("map_name IN ('AF', 'NF')"), path)
    wanted = maps.select("map_name").distinct().union(spark.createDataFrame([("extra",)], "map_name string"))
    return store.missing_maps(wanted, spark, path)


@query("K10 U01 E19", _MAPS + ", t AS (SELECT unit_id, 0 AS src, value FROM m WHERE map_name = 'AF' UNION ALL SELECT unit_id, 1, value FROM m WHERE map_name = 'RF') SELECT unit_id, arg_min(value, src) AS value FROM t GROUP BY unit_id")
def dedupe_union(spark, sf_dir):
    maps = _maps(spark, sf_dir)
    return store.consolidated([maps.where(F.col("map_name") == n).select("unit_id", "value") for n in ("AF", "RF")], "unit_id")


@query("S15 S16 E10", f"WITH {T.SQL_SUB}, f AS (SELECT subject, unit, block - 1995 AS block, value FROM sub) SELECT subject, unit, CAST(block // 3 AS INT) AS block, round(avg(value) + 1.7e-10, 6) + 0.0 AS value FROM f GROUP BY ALL")
def block_stack(spark, sf_dir):
    # Seven years in a stack of nine, whose last two blocks are empty: threes of years.
    fine = T.subjects(spark, sf_dir).select(F.lit(9).alias("n_blocks"), "subject", "unit", (F.col("block") - 1995).alias("block"), "value")
    return store.block_stack(fine.union(fine.withColumn("n_blocks", F.lit(18))), 3).select("subject", "unit", "block", near6("value").alias("value"))


@query("S02 S04", "SELECT c_custkey AS unit_id, n_name AS structure, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS INT) AS vertex FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 2)")
def unit_axis(spark, sf_dir):
    from pyspark.sql import Window

    nations = T.read(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(0, 2))
    units = T.read(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return units.select(F.col("c_custkey").alias("unit_id"), F.col("n_name").alias("structure"), (F.row_number().over(Window.partitionBy("n_nationkey").orderBy("c_custkey")) - 1).alias("vertex"))


@query("S09 W06", f"WITH {T.SQL_H} SELECT CAST(user_id AS BIGINT) AS sheet, CAST(tr // 168 AS INT) AS run, CASE WHEN unit = 'error' THEN '0' ELSE unit END AS label, unit = 'error' AS is_rest, tr % 168 + 0.0::DOUBLE AS start, value AS stop FROM h")
def timing_sheet_ffill(spark, sf_dir):
    h = T.hours(spark, sf_dir)
    run, order = F.floor(F.col("tr") / 168).cast("int"), F.col("event_id") * 4
    label = F.when(F.col("unit") == "error", "0").otherwise(F.col("unit"))
    body = F.concat_ws(",", label, (F.col("tr") % 168).cast("string"), F.col("value").cast("string"))
    parts = [(order, F.concat(F.lit("Run "), run.cast("string"), F.lit("\r"))), (order + 1, body), (order + 2, F.lit("broken,line")), (order + 3, F.lit("x,y,z"))]
    lines = h.select(F.col("user_id").alias("sheet"), F.explode(F.array(*[F.struct(n.alias("line_no"), t.alias("line")) for n, t in parts])).alias("l")).select("sheet", "l.line_no", "l.line")
    return timing.parsed_sheet(lines)


@query("S10", "SELECT CASE WHEN n_chars % 3 = 1 THEN string_split(source, ' ')[1] ELSE source END AS id FROM documents WHERE n_chars % 3 = 1")
def id_list(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents")
    lines = d.select(F.when(F.col("n_chars") % 3 == 0, F.lit("  ")).when(F.col("n_chars") % 3 == 1, F.concat(F.lit(" "), "source", F.lit(" kept by token"))).otherwise(F.concat(F.lit("# "), "source")).alias("value"))
    return timing.id_list(lines, first_token=True)


@query("S20 U03", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def completeness_anti(spark, sf_dir):
    return timing.expected_files(T.read(spark, sf_dir, "documents").select("doc_id"), T.read(spark, sf_dir, "labels"), "doc_id")


@query("S21", "SELECT 'class' AS problem, CAST(label AS VARCHAR) AS place FROM (SELECT DISTINCT label FROM embeddings WHERE label > 6) UNION ALL SELECT 'empty', '11'")
def class_partition_check(spark, sf_dir):
    rows = T.read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    return timing.strict_classes(rows, rows.count(), "vec_id", "label", tuple(map(str, [*range(7), 11])))


@query("S17", f"WITH {T.SQL_S}, m(roi, unit) AS (VALUES ('browse', 'view'), ('browse', 'click'), ('act', 'purchase'), ('act', 'signup'), ('all', 'view'), ('all', 'purchase'), ('all', 'error')) SELECT roi, run, k, round(avg(value), 6) + 0.0 AS v FROM s JOIN m USING (unit) GROUP BY ALL")
def multi_roi_scan(spark, sf_dir):
    masks = [("browse", "view"), ("browse", "click"), ("act", "purchase"), ("act", "signup"), ("all", "view"), ("all", "purchase"), ("all", "error")]
    return timing.roi_means(T.signal(spark, sf_dir), spark.createDataFrame(masks, "roi string, unit string")).select("roi", "run", "k", r6("value").alias("v"))


@query("K06 R07", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS INT) AS rank, '{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}' AS report FROM part")
def ranked_report(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return T.read(spark, sf_dir, "part").select("p_partkey", F.row_number().over(w).alias("rank"), F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("report"))


@query("S13 S14", "SELECT l_suppkey % 50 AS vertex, bool_or(l_quantity = 50) AS a, bool_or(l_discount = 0) AS b, bool_or(l_quantity = 50) OR bool_or(l_discount = 0) AS either FROM lineitem GROUP BY 1")
def mask_union(spark, sf_dir):
    m = T.read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("vertex")).agg(F.bool_or(F.col("l_quantity") == 50).alias("a"), F.bool_or(F.col("l_discount") == 0).alias("b"))
    return m.withColumn("either", F.col("a") | F.col("b"))


@query("S05 E01", "SELECT event_type AS unit, date_trunc('day', ts) AS day, count(*) AS n, round(avg(value), 6) AS m FROM events GROUP BY ALL")
def streamed_day_means(spark, sf_dir):
    return running.day_means(spark, f"{sf_dir}/events.parquet")


@query("F07", "SELECT * FROM (VALUES ('en', 'src0'), ('en', 'src99'), ('it', 'src1'), ('de', 'src2')) t(model, stream) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lang = model AND source = stream)")
def registry_check(spark, sf_dir):
    declared = registry.Registry({"en": ("src0", "src99"), "it": ("src1",), "de": ("src2",)}, (registry.Run("en_without_de", "en.src0", ("de.src2",)),))
    present = T.read(spark, sf_dir, "documents").select(F.col("lang").alias("model"), F.col("source").alias("stream"))
    return declared.missing(present, spark)


@query("K12", "WITH t AS (SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name) SELECT CAST(0 AS INT) AS line_no, '| r_name | n |' AS line UNION ALL SELECT 1, '|-|-|' UNION ALL SELECT CAST(row_number() OVER (ORDER BY r_name) + 1 AS INT), '| ' || r_name || ' | ' || n || ' |' FROM t")
def markdown_report(spark, sf_dir):
    r = T.read(spark, sf_dir, "region").join(T.read(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return registry.markdown(r.groupBy("r_name").agg(F.count("*").alias("n")), "r_name", "n", order="r_name")
