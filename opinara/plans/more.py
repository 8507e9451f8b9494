"""Further queries over the driver tables: sources and sinks, filters, labels, places, keywords, estimators, loaders.

Round trips write to the shared folder and read back; their SQL is that of the table they started from."""

from __future__ import annotations

import io
import json
import tarfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import scalar
from opinara.operators import adjustment, correlation, dimension, labels, panel, places, semantic, simulation, spectral, text
from opinara.plans import loaders, tasks
from opinara.plans.catalogue import CORR, EUROPE, OPINION, PAIRS, PANEL, RATER_NAMES, RATERS, SOCIETY, SQL, _CENT, _MAJ, _WORDS, _centroids, _counts, _user_values, q6, query, r6, rounded, society_pairs, the_pairs, the_panel, values
from opinara.session import shared_folder
from opinara.sources import adapters as ad
from opinara.sources import readers, sinks
from opinara.sources.store import ResultStore
from opinara.streaming import jobs


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ------------------------------------------------------------------------------------------------
_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


def _supplier(spark, sf):
    return ad.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("schema_names", "SELECT unnest(['l_orderkey','l_partkey','l_suppkey','l_linenumber','l_quantity','l_extendedprice','l_discount','l_tax','l_returnflag','l_linestatus','l_shipdate']) AS name")
def schema_names(spark, sf):
    return spark.createDataFrame([(n,) for n in readers.schema_names(spark, f"{sf}/lineitem.parquet")], "name string")


@query("csv_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_round_trip(spark, sf):
    path = scratch(spark, "csv")
    sinks.write_csv(_supplier(spark, sf), path)
    return readers.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", ["s_suppkey", "s_name", "s_acctbal"])


@query("csv_appended", "SELECT s_nationkey, count(*) AS n FROM (SELECT s_nationkey FROM supplier UNION ALL SELECT s_nationkey FROM supplier WHERE s_nationkey < 5) GROUP BY ALL")
def csv_appended(spark, sf):
    path = scratch(spark, "stats")
    sinks.append_csv(_supplier(spark, sf), path)
    sinks.append_csv(_supplier(spark, sf).where("s_nationkey < 5"), path)
    back = readers.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    return back.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("json_round_trip", _SUPPLIER)
def json_round_trip(spark, sf):
    path = scratch(spark, "json")
    sinks.write_json(_supplier(spark, sf), path)
    return spark.read.schema("s_suppkey long, s_name string, s_nationkey int, s_acctbal double").json(path)


@query("stata_round_trip", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def stata_round_trip(spark, sf):
    path = scratch(spark, "stata") + ".dta"
    sinks.write_stata(_supplier(spark, sf).select(F.col("s_suppkey").cast("double").alias("s_suppkey"), F.col("s_nationkey").cast("double").alias("s_nationkey"), "s_acctbal"), path)
    back = readers.read_stata(spark, path, "s_suppkey double, s_nationkey double, s_acctbal double", ["s_suppkey", "s_nationkey", "s_acctbal"])
    return back.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_acctbal")


@query("excel_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT n_nationkey, n_name, NULL FROM nation")
def excel_round_trip(spark, sf):
    path = scratch(spark, "book") + ".xlsx"
    sinks.write_excel({"first": _supplier(spark, sf), "second": ad.table(spark, sf, "nation")}, path)
    a = readers.read_excel(spark, path, "first", ["s_suppkey", "s_name", "s_acctbal"]).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))
    b = readers.read_excel(spark, path, "second", ["n_nationkey", "n_name"])
    return a.unionAll(b.select(F.col("n_nationkey").cast("long"), "n_name", F.lit(None).cast("double")))


@query("pickle_round_trip", "SELECT s_suppkey, s_name FROM supplier")
def pickle_round_trip(spark, sf):
    path = scratch(spark, "frame") + ".pkl"
    sinks.write_pickle(_supplier(spark, sf), path)
    return readers.read_pickles(spark, path, "s_suppkey long, s_name string", ["s_suppkey", "s_name"])


@query("tar_members", "SELECT n_name || '.txt' AS member, CAST(length(n_name) AS BIGINT) AS size FROM nation")
def tar_members(spark, sf):
    path, raw = scratch(spark, "members") + ".tar.gz", io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as t:
        for r in ad.table(spark, sf, "nation").collect():  # 25 rows
            info = tarfile.TarInfo(f"{r.n_name}.txt")
            info.size = len(r.n_name)
            t.addfile(info, io.BytesIO(r.n_name.encode()))
    sinks.write_bytes(spark, path, raw.getvalue())
    return readers.read_tar_members(spark, path, ".txt").select("member", F.octet_length("content").cast("long").alias("size"))


@query("matrix_round_trip", f"WITH {PANEL}, v AS (SELECT user_id, topic, sum(total)/sum(cnt) AS x FROM panel GROUP BY ALL), u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS row_id FROM (SELECT DISTINCT user_id FROM v)) SELECT row_id, topic, {q6('x')} AS value FROM v JOIN u ON v.user_id = u.user_id")
def matrix_round_trip(spark, sf):
    path = scratch(spark, "matrix") + ".npz"
    sinks.write_matrix(_user_values(spark, sf), path, ad.ORDER_TOPICS)
    return rounded(readers.read_matrix(spark, path, ad.ORDER_TOPICS).drop("file"), "value")


@query("dense_matrix", "SELECT n_nationkey AS row_id, 'key' AS topic, n_nationkey::DOUBLE AS value FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey::DOUBLE FROM nation WHERE n_regionkey <> 2")
def dense_matrix(spark, sf):
    rows = sorted((r.n_nationkey, r.n_regionkey) for r in ad.table(spark, sf, "nation").collect())  # 25 rows
    raw, path = io.BytesIO(), scratch(spark, "dense") + ".npy"
    np.save(raw, np.array([[a, np.nan if b == 2 else b] for a, b in rows], float))
    sinks.write_bytes(spark, path, raw.getvalue())
    return readers.read_matrix(spark, path, ["key", "region"]).drop("file")


@query("triples_by_year", f"WITH {PANEL} SELECT year, count(*) AS cells, {q6('sum(mean)')} AS total FROM panel GROUP BY year")
def triples_by_year(spark, sf):
    path = scratch(spark, "triples")
    sinks.write_partitioned(values(spark, sf), path, ["year"])
    return rounded(spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total")), "total")


@query("year_files", "SELECT CAST(o_orderdate AS DATE) AS file_date, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 3 GROUP BY ALL")
def year_files(spark, sf):
    folder = scratch(spark, "days")
    o = ad.table(spark, sf, "orders").where("year(o_orderdate) = 1997 and month(o_orderdate) = 3")
    # One folder a day, so that the date is in the path that a year's pattern matches.
    o.withColumn("day", F.to_date("o_orderdate")).repartition("day").write.partitionBy("day").parquet(f"{folder}/all")
    found = readers.with_file_date(spark.read.option("basePath", f"{folder}/all").parquet(f"{folder}/all/day=1997-*"))
    named = found.withColumn("file_date", F.to_date(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})", 1)))
    return named.groupBy("file_date").agg(F.count(F.lit(1)).alias("n"))


@query("text_lines", "SELECT count(*) AS lines, CAST(sum(length(s_name)) AS BIGINT) AS chars FROM supplier")
def text_lines(spark, sf):
    path = scratch(spark, "lines")
    _supplier(spark, sf).select("s_name").write.text(path)
    return readers.read_lines(spark, path).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("value")).alias("chars"))


@query("mixed_lines", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS who, o_orderpriority AS topic FROM orders WHERE o_orderkey % 4 <> 3")
def mixed_lines(spark, sf):
    o = ad.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("who"), F.col("o_orderpriority").alias("topic"), (F.col("o_orderkey") % 4).alias("kind"))
    as_json = F.concat(F.lit("x\t"), F.to_json(F.struct("id", "who", "topic")))
    tsv = F.concat_ws("\t", "id", "who", "topic", F.lit("y"))
    as_csv = F.concat(F.lit('"'), F.col("id"), F.lit('","'), F.col("who"), F.lit('","'), F.col("topic"), F.lit('"'))
    path = scratch(spark, "mixed")
    o.select(F.when(F.col("kind") == 0, as_json).when(F.col("kind") == 1, tsv).when(F.col("kind") == 2, as_csv).otherwise(F.lit("broken line"))).write.text(path)
    return readers.parse_mixed_lines(readers.read_lines(spark, path), "id string, who string, topic string", ["id", "who", "topic"], "id string, who string, topic string", 4)


@query("id_list", "SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_nationkey = 3")
def id_list(spark, sf):
    path = scratch(spark, "ids") + ".json"
    ids = [r.c_custkey for r in ad.table(spark, sf, "customer").where("c_nationkey = 3").select("c_custkey").collect()]  # an allow-list file is one document
    sinks.write_bytes(spark, path, json.dumps([*ids, *map(str, ids[:3]), "no number"]).encode())
    return readers.read_id_list(spark, path)


@query("batch_answers", "SELECT 'c-' || s_suppkey AS custom_id, s_name AS content FROM supplier WHERE s_suppkey % 3 <> 2")
def batch_answers(spark, sf):
    message = F.array(F.struct(F.struct(F.col("s_name").alias("content")).alias("message")))
    empty = F.array(F.struct(F.struct(F.lit("x").alias("role")).alias("message")))
    cid = F.concat(F.lit("c-"), F.col("s_suppkey").cast("string")).alias("custom_id")
    kind = F.col("s_suppkey") % 3
    line = F.when(kind == 0, F.to_json(F.struct(cid, message.alias("choices")))).when(kind == 1, F.to_json(F.struct(cid, F.struct(F.struct(message.alias("choices")).alias("body")).alias("response")))).otherwise(F.to_json(F.struct(cid, empty.alias("choices"))))
    path = scratch(spark, "answers")
    _supplier(spark, sf).select(line).write.text(path)
    return readers.read_responses(spark, path)


@query("log_metrics", "SELECT event_type AS file, 'value' AS name, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def log_metrics(spark, sf):
    e = ad.table(spark, sf, "events")
    lines = e.select(F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("  value: "), F.col("value").cast("string"))).otherwise(F.concat(F.lit("value: "), F.col("value").cast("string"))).alias("value"))
    noise = e.select(F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), F.lit("step 3 of 4").alias("value"))
    return readers.read_last_metrics(lines.unionAll(noise))


@query("word_vector_files", "SELECT vec_id AS word, round(embedding[1]::DOUBLE, 5) + 0.0 AS first, len(embedding) AS size FROM embeddings")
def word_vector_files(spark, sf):
    v = ad.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector"))
    path = scratch(spark, "vectors")
    sinks.write_word_vectors(v.where("cast(word as long) % 2 = 0"), f"{path}.txt")
    sinks.write_word_vectors(v.where("cast(word as long) % 2 = 1"), f"{path}.bin", binary=True)
    both = readers.read_word_vectors(spark, f"{path}.txt").unionAll(readers.read_word_vectors_binary(spark, f"{path}.bin"))
    return both.select(F.col("word").cast("long").alias("word"), (F.round(F.element_at("vector", 1).cast("double"), 5) + 0.0).alias("first"), F.size("vector").cast("long").alias("size"))


@query("daily_files", "SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT ts, user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY event_id) = 1) GROUP BY ALL")
def daily_files(spark, sf):
    path = scratch(spark, "daily")
    e = ad.table(spark, sf, "events").select(F.to_date("ts").alias("day"), "user_id", "event_id", "event_type")
    sinks.write_days(e, path, "day", "user_id", "event_id")
    sinks.write_days(e.where("day < date'2024-01-03'"), path, "day", "user_id", "event_id")  # again: the days are replaced
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("bounded_files", "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, true AS within FROM orders GROUP BY ALL")
def bounded_files(spark, sf):
    path = scratch(spark, "bounded")
    o = ad.opinions(spark, sf).select("post_id", "year")
    limit = max(50, o.count() // 20)
    sinks.write_bounded(o, path, "year", limit)
    per = spark.read.parquet(path).groupBy("year", F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("year").agg(F.sum("k").alias("n"), (F.max("k") <= limit).alias("within"))


@query("request_batches", "SELECT CAST(doc_id AS VARCHAR) AS custom_id, text AS content, 1 AS within FROM documents")
def request_batches(spark, sf):
    docs = ad.table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), "text")
    again = docs.unionAll(docs.where("post_id % 3 = 0"))  # repeated ids are sent once
    out = sinks.request_batches(again, "system", "model", 1000)
    back = F.from_json("value", "custom_id string, body struct<messages:array<struct<role:string,content:string>>>")
    return out.select(back.alias("j"), "batch").select("j.custom_id", F.element_at("j.body.messages", 2)["content"].alias("content"), F.lit(1).alias("within"))


@query("updated_predictions", "SELECT d.doc_id AS post_id, coalesce(l.quality, CASE WHEN d.doc_id % 2 = 0 THEN 7 END) AS relevance FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def updated_predictions(spark, sf):
    rows = ad.table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), F.when(F.col("doc_id") % 2 == 0, 7).alias("relevance"))
    return sinks.update_predictions(rows, ad.table(spark, sf, "labels").select(F.col("doc_id").alias("post_id"), F.col("quality").alias("relevance")), "relevance")


@query("slim_predictions", "SELECT d.doc_id AS post_id, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL OR l.toxic IS NOT NULL")
def slim_predictions(spark, sf):
    rows = ad.table(spark, sf, "documents").join(ad.table(spark, sf, "labels"), "doc_id", "left").withColumnRenamed("doc_id", "post_id")
    return sinks.slim_predictions(rows, ["quality", "toxic"])


@query("first_unlabelled_file", "SELECT 'documents' AS name")
def first_unlabelled_file(spark, sf):
    found = readers.first_without(spark, [f"{sf}/{t}.parquet" for t in ("labels", "documents", "events")], "quality")
    return spark.createDataFrame([(found.rsplit("/", 1)[1].removesuffix(".parquet"),)], "name string")


@query("skip_missing", "SELECT 'written' AS step, 1 AS n UNION ALL SELECT 'skipped', 1 UNION ALL SELECT 'absent', 1 UNION ALL SELECT 'read', 25")
def skip_missing(spark, sf):
    path = scratch(spark, "once")
    n = ad.table(spark, sf, "nation")
    first, again = sinks.write_once(n, path), sinks.write_once(n, path)
    rows = [("written", int(first)), ("skipped", int(not again)), ("absent", int(readers.read_if_exists(spark, path + "-none") is None)), ("read", readers.read_if_exists(spark, path).count())]
    return spark.createDataFrame(rows, "step string, n int")


@query("dated_paths", "SELECT DISTINCT 'out/' || strftime(ts, '%Y%m%d') || '_' || event_type || '.csv' AS path FROM events")
def dated_paths(spark, sf):
    """The file of each kind of event and day."""
    return ad.table(spark, sf, "events").select(scalar.dated_path(F.concat(F.lit("out/"), "event_type", F.lit(".csv")), F.col("ts")).alias("path")).distinct()


# --- filters and panels -----------------------------------------------------------------------------------------------
@query("country_rows", "SELECT 'in' AS side, count(*) AS n FROM customer WHERE CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END = 'MACHINERY' UNION ALL SELECT 'out', count(*) FROM customer WHERE CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END IS DISTINCT FROM 'MACHINERY'")
def country_rows(spark, sf):
    c = ad.table(spark, sf, "customer").withColumn("country", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")))
    count = lambda inside, name: panel.country_rows(c, "country", "MACHINERY", inside).agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(True, "in").unionAll(count(False, "out"))


@query("numeric_columns", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def numeric_columns(spark, sf):
    return panel.numeric_columns(ad.table(spark, sf, "supplier"))


@query("rows_of_year", f"WITH op AS ({OPINION}) SELECT post_id, topic FROM op WHERE year = 1997")
def rows_of_year(spark, sf):
    return panel.of_year(ad.opinions(spark, sf).withColumn("year", F.col("year").cast("string")), 1997).select("post_id", "topic")


@query("without_columns", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def without_columns(spark, sf):
    return panel.without(ad.table(spark, sf, "supplier"), "s_name", "no_such_column")


@query("adult_rows", "SELECT p_partkey FROM part WHERE p_size >= 18 AND p_brand = 'Brand#2'")
def adult_rows(spark, sf):
    return panel.adults(ad.table(spark, sf, "part"), "p_size", "p_brand", "Brand#2").select("p_partkey")


@query("fielded_everywhere", "SELECT c_custkey, c_mktsegment, c_acctbal AS a FROM customer")
def fielded_everywhere(spark, sf):
    c = ad.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("a"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal")).alias("b"))
    return panel.fielded_everywhere(c, "c_mktsegment", ["a", "b"])


@query("analysed_topics", f"WITH op AS ({OPINION}) SELECT topic, count(*) AS n FROM op WHERE topic IN ('1-URGENT', '5-LOW') GROUP BY topic")
def analysed_topics(spark, sf):
    registry = spark.createDataFrame([("posts", "1-URGENT", True), ("posts", "2-HIGH", False), ("posts", "5-LOW", True), ("other", "3-MEDIUM", True)], "platform string, topic string, analysed boolean")
    rows = ad.opinions(spark, sf).withColumn("platform", F.lit("posts"))
    return panel.analysed_only(rows, registry).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("period_lists", f"WITH op AS ({OPINION}) SELECT user_id, topic, count(*) AS n, {q6('min(opinion)')} AS first, {q6('max(opinion)')} AS last FROM op WHERE opinion IS NOT NULL AND year IN (1996, 1998) GROUP BY ALL")
def period_lists(spark, sf):
    return panel.period_lists(ad.opinions(spark, sf), [1996, 1998]).select("user_id", "topic", F.size("opinions").cast("long").alias("n"), r6(F.element_at("opinions", 1)).alias("first"), r6(F.element_at("opinions", -1)).alias("last"))


@query("preferred_average", f"WITH {PANEL}, w AS (SELECT user_id, avg(mean) AS v FROM panel WHERE topic = '2-HIGH' GROUP BY user_id), p AS (SELECT user_id, least(greatest(3 * sum(total)/sum(cnt), -2), 2) AS v FROM panel WHERE topic = '2-HIGH' GROUP BY user_id) SELECT 'years' AS kind, user_id, {q6('v')} AS value FROM w UNION ALL SELECT 'average', user_id, {q6('v')} FROM p")
def preferred_average(spark, sf):
    p = the_panel(spark, sf).where("topic = '2-HIGH'")
    years = [str(y) for y in range(1990, 2010)]
    wide = p.groupBy("user_id").pivot("year", [int(y) for y in years]).agg(F.first("mean"))
    ready = panel.pooled_average(p).select("user_id", (F.col("average") * 3).alias("average"), F.lit(9.0).alias("1997"))
    a = panel.preferred_average(wide, years).withColumn("kind", F.lit("years"))
    return rounded(a.unionByName(panel.preferred_average(ready, ["1997"]).withColumn("kind", F.lit("average"))), "value").select("kind", "user_id", "value")


@query("source_rollup", "SELECT source, arg_min(lang, doc_id) AS lang, round(avg(n_chars), 6) + 0.0 AS n_chars FROM documents GROUP BY source")
def source_rollup(spark, sf):
    return rounded(panel.source_rollup(ad.table(spark, sf, "documents"), "source", ["lang"], ["n_chars"], "doc_id"), "n_chars")


@query("topic_users", f"WITH {PANEL} SELECT year, topic, count(DISTINCT user_id) AS users FROM panel GROUP BY ALL")
def topic_users(spark, sf):
    return panel.topic_users(the_panel(spark, sf))


@query("users_over_periods", f"WITH {PANEL} SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, year FROM panel)) AS sum_over_periods, count(DISTINCT user_id) AS unique_users FROM panel")
def users_over_periods(spark, sf):
    return panel.users_over_periods(the_panel(spark, sf))


@query("hash_subset", "SELECT event_id FROM events ORDER BY substr(md5('0:' || event_id), 1, 12), event_id LIMIT 300")
def hash_subset(spark, sf):
    return panel.hash_subset(ad.table(spark, sf, "events"), 300, "event_id").select("event_id")


@query("shuffled_rows", "SELECT event_id, CAST('0x' || substr(md5('0:' || event_id), 1, 12) AS BIGINT) AS shuffle_key FROM events")
def shuffled_rows(spark, sf):
    return panel.shuffled(ad.table(spark, sf, "events").select("event_id"), "event_id")


@query("ordered_dedup", "SELECT conv_id, array_to_string(list_transform(list_sort(list_distinct(list(turn))), lambda x: x::VARCHAR), ',') AS turns FROM (SELECT conv_id, turn % 3 AS turn FROM conversations) GROUP BY conv_id")
def ordered_dedup(spark, sf):
    c = ad.table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t % 3).alias("t"))
    return c.select("conv_id", F.array_join(F.array_sort(scalar.ordered_distinct(F.col("t"))), ",").alias("turns"))


# --- correlations -----------------------------------------------------------------------------------------------------
def _social(where: str = "") -> str:
    return (
        f"WITH {PANEL}, v AS (SELECT user_id, topic, CAST(year AS VARCHAR) AS period, least(greatest(mean, -2), 2) AS value FROM panel {where} UNION ALL SELECT user_id, topic, 'average', least(greatest(sum(total)/sum(cnt), -2), 2) FROM panel {where} GROUP BY user_id, topic), "
        f"t AS (SELECT DISTINCT period, topic FROM v), s AS (SELECT a.period, a.topic AS t1, b.topic AS t2 FROM t a JOIN t b ON a.period = b.period AND a.topic < b.topic), p AS (SELECT a.period, a.topic AS t1, b.topic AS t2, a.value AS x, b.value AS y FROM v a JOIN v b ON a.user_id = b.user_id AND a.period = b.period AND a.topic < b.topic), "
        f"f AS (SELECT period, t1, t2, count(*) AS n, {CORR} AS r FROM p GROUP BY ALL) SELECT s.period, s.t1, s.t2, coalesce(n, 0) AS n, {q6('r')} AS r FROM s LEFT JOIN f ON s.period = f.period AND s.t1 = f.t1 AND s.t2 = f.t2"
    )


@query("social_pairwise", _social())
def social_pairwise(spark, sf):
    return rounded(correlation.social_pairwise(the_panel(spark, sf)), "r")


@query("social_pairwise_region", _social(f"WHERE user_id IN ({EUROPE} AND c_nationkey % 5 = 3 AND c_custkey % 7 = 0)"))
def social_pairwise_region(spark, sf):
    """A small allow-list, so that some pairs have no user in common."""
    some = ad.region_users(spark, sf, "EUROPE").join(ad.table(spark, sf, "customer").where("c_nationkey % 5 = 3 and c_custkey % 7 = 0").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi")
    return rounded(correlation.social_pairwise(panel.keep_users(the_panel(spark, sf), some)), "r")


@query("social_p_values")
def social_p_values(spark, sf):
    return rounded(correlation.with_p_values(social_pairwise(spark, sf)), "p_value")


_WLS = "WITH l AS (SELECT l_returnflag, l_extendedprice/1000 AS x, l_tax*100 AS y, l_quantity AS w FROM lineitem), s AS (SELECT l_returnflag, count(*) AS n, sum(w) AS w, sum(w*x) AS a, sum(w*y) AS b, sum(w*x*x) AS aa, sum(w*x*y) AS ab, sum(w*y*y) AS bb FROM l GROUP BY ALL), m AS (SELECT *, aa-a*a/w AS sxx, ab-a*b/w AS sxy, bb-b*b/w AS syy FROM s)"


def _weighted_rows(spark, sf):
    return ad.table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("x"), (F.col("l_tax") * 100).alias("y"), F.col("l_quantity").alias("w"))


@query("wls_summary", f"{_WLS} SELECT l_returnflag, n, round((b-sxy/sxx*a)/w, 6)+0.0 AS intercept, round(sxy/sxx, 6)+0.0 AS slope, round(sqrt((syy-sxy/sxx*sxy)/((n-2)*sxx)), 6)+0.0 AS se, round(sxy/sxx*sxy/syy, 6)+0.0 AS r2 FROM m")
def wls_summary(spark, sf):
    return rounded(correlation.wls(_weighted_rows(spark, sf), "x", "y", "w", ("l_returnflag",)).drop("p"), "intercept", "slope", "se", "r2")


@query("wls_p_values")
def wls_p_values(spark, sf):
    return rounded(correlation.wls(society_pairs(spark, sf), "x", "y", None, ("society",)), "p").select("society", "p")


@query("pairs_by_strength", f"WITH {PAIRS}, c AS (SELECT t1, t2, count(*) AS n, {q6(CORR)} AS r FROM pairs GROUP BY ALL) SELECT *, abs(r) AS abs_r FROM c WHERE r IS NOT NULL")
def pairs_by_strength(spark, sf):
    return correlation.by_strength(rounded(correlation.pairwise(the_pairs(spark, sf)), "r"))


@query("fisher_z", f"WITH {SOCIETY} SELECT society, {q6('avg(atanh(least(greatest(y, 0), 1-1e-12)))')} AS mean_z FROM soc GROUP BY society")
def fisher_z(spark, sf):
    return rounded(society_pairs(spark, sf).groupBy("society").agg(F.avg(scalar.fisher_z(F.col("y"))).alias("mean_z")), "mean_z")


@query("loess_at_pairs", f"WITH {SOCIETY}, n AS (SELECT society, count(*) AS n FROM soc WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY society), d AS (SELECT a.society, a.t1, a.t2, a.x AS p, b.x AS bx, b.y AS fy, abs(b.x-a.x) AS d, row_number() OVER (PARTITION BY a.society, a.t1, a.t2 ORDER BY abs(b.x-a.x)) AS rk, least(n, greatest(3, CAST(ceil(0.4::DOUBLE*n) AS INT))) AS k FROM soc a JOIN soc b ON a.society = b.society JOIN n ON n.society = a.society WHERE a.x IS NOT NULL AND a.y IS NOT NULL AND b.x IS NOT NULL AND b.y IS NOT NULL), h AS (SELECT society, t1, t2, max(d) FILTER (rk = k)*1.0001::DOUBLE AS h FROM d GROUP BY ALL), w AS (SELECT d.*, pow(greatest(1 - pow(d/h, 3), 0), 3) AS w FROM d JOIN h ON d.society = h.society AND d.t1 = h.t1 AND d.t2 = h.t2), s AS (SELECT society, t1, t2, sum(w) AS m0, sum(w*(bx-p)) AS m1, sum(w*(bx-p)**2) AS m2, sum(w*fy) AS u0, sum(w*(bx-p)*fy) AS u1 FROM w GROUP BY ALL) SELECT society, t1, t2, round((m2*u0-m1*u1)/(m0*m2-m1*m1), 4) + 0.0 AS fit FROM s")
def loess_at_pairs(spark, sf):
    return adjustment.loess_at_pairs(society_pairs(spark, sf)).withColumn("fit", F.round("fit", 4) + 0.0)


@query("similarity_summary", f"WITH {SOCIETY} SELECT society, count(x) AS pairs, {q6('avg(x)')} AS mean, {q6('stddev_pop(x)')} AS sd, {q6('min(x)')} AS least, {q6('quantile_cont(x, 0.25)')} AS q25, {q6('quantile_cont(x, 0.5)')} AS median, {q6('quantile_cont(x, 0.75)')} AS q75, {q6('max(x)')} AS most FROM soc GROUP BY society")
def similarity_summary(spark, sf):
    return rounded(adjustment.similarity_summary(society_pairs(spark, sf)), "mean", "sd", "least", "q25", "median", "q75", "most")


_RHO = "SELECT {g}, count(*) AS n, CASE WHEN count(*) > 1 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN round(corr(x, y), 6) + 0.0 END AS rho FROM k GROUP BY ALL"


@query("support_spearman", f"WITH {SOCIETY}, b AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(x) AS lo, max(x) AS hi FROM soc GROUP BY society)), i AS (SELECT society, x, y FROM soc, b WHERE x BETWEEN lo AND hi AND y IS NOT NULL), k AS (SELECT society, rank() OVER (PARTITION BY society ORDER BY x) + (count(*) OVER (PARTITION BY society, x) - 1)/2.0 AS x, rank() OVER (PARTITION BY society ORDER BY y) + (count(*) OVER (PARTITION BY society, y) - 1)/2.0 AS y FROM i) " + _RHO.format(g="society"))
def support_spearman(spark, sf):
    return rounded(correlation.spearman(adjustment.on_support(society_pairs(spark, sf)), "x", "y", ("society",)), "rho")


@query("level_summary")
def level_summary(spark, sf):
    return rounded(adjustment.level_summary(society_pairs(spark, sf), "1996"), "value", "lo", "hi")


@query("level_points", f"WITH {SOCIETY}, m AS (SELECT society, avg(y) AS y, avg(atanh(least(greatest(y, 0), 1-1e-12))) AS z FROM soc WHERE y IS NOT NULL GROUP BY society), r AS (SELECT * FROM m WHERE society = '1996') SELECT 'mean' AS what, society, {q6('y')} AS value FROM m UNION ALL SELECT 'ratio', m.society, {q6('r.y/m.y')} FROM m, r WHERE m.society <> '1996' UNION ALL SELECT 'gap', m.society, {q6('r.y-m.y')} FROM m, r WHERE m.society <> '1996' UNION ALL SELECT 'z_gap', m.society, {q6('r.z-m.z')} FROM m, r WHERE m.society <> '1996' UNION ALL SELECT 'dispersion', 'all', {q6('stddev_pop(z)')} FROM m UNION ALL SELECT 'range', 'all', {q6('max(y)-min(y)')} FROM m")
def level_points(spark, sf):
    """The values of ``level_summary``; its limits come from random draws."""
    return rounded(adjustment.level_summary(society_pairs(spark, sf), "1996", 50), "value").select("what", "society", "value")


_PERM = "t AS (SELECT DISTINCT t FROM (SELECT t1 AS t FROM soc UNION ALL SELECT t2 FROM soc)), perm AS (SELECT row_number() OVER () AS id, a.t AS a, b.t AS b, c.t AS c, d.t AS d, e.t AS e FROM t a, t b, t c, t d, t e WHERE a.t <> b.t AND a.t <> c.t AND a.t <> d.t AND a.t <> e.t AND b.t <> c.t AND b.t <> d.t AND b.t <> e.t AND c.t <> d.t AND c.t <> e.t AND d.t <> e.t), m AS (SELECT id, unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW']) AS f, unnest([a, b, c, d, e]) AS g FROM perm)"


@query("repairing", f"WITH {SOCIETY}, {_PERM}, p AS (SELECT m1.id, x.t1, x.t2, x.y AS x, z.y AS y, m1.f = m1.g AND m2.f = m2.g AS same FROM soc x JOIN m m1 ON m1.f = x.t1 JOIN m m2 ON m2.f = x.t2 AND m2.id = m1.id JOIN soc z ON z.society = '1998' AND z.t1 = least(m1.g, m2.g) AND z.t2 = greatest(m1.g, m2.g) WHERE x.society = '1996'), v AS (SELECT id, avg(abs(x-y)) AS diff, corr(x, y) AS corr FROM p GROUP BY id), own AS (SELECT avg(abs(a.y-b.y)) AS diff, corr(a.y, b.y) AS corr, count(*) AS n FROM soc a JOIN soc b ON a.t1 = b.t1 AND a.t2 = b.t2 AND a.society = '1996' AND b.society = '1998') SELECT 5 AS concepts, CAST(any_value(own.n) AS INT) AS pairs, {q6('any_value(own.diff)')} AS diff, {q6('avg(v.diff)')} AS diff_random, {q6('avg(CASE WHEN v.diff <= own.diff + 1e-12 THEN 1.0 ELSE 0 END)')} AS p_diff, {q6('any_value(own.corr)')} AS corr, {q6('avg(v.corr)')} AS corr_random, {q6('avg(CASE WHEN v.corr >= own.corr - 1e-12 THEN 1.0 ELSE 0 END)')} AS p_corr FROM v, own")
def repairing(spark, sf):
    return rounded(adjustment.repairing(society_pairs(spark, sf), "1996", "1998"), "diff", "diff_random", "p_diff", "corr", "corr_random", "p_corr")


# --- loaders ----------------------------------------------------------------------------------------------------------
@query("pair_table", f"WITH {PAIRS}, c AS (SELECT t1, t2, coalesce(CAST(year AS VARCHAR), 'average') AS period, count(*) AS n, {q6(CORR)} AS r FROM pairs GROUP BY GROUPING SETS ((t1, t2, year), (t1, t2))) SELECT t1, t2, t1 || '_' || t2 AS key, period, n, r, abs(r) AS abs_r FROM c WHERE period = 'average' AND t1 <> '3-MEDIUM' AND t2 <> '3-MEDIUM' AND r IS NOT NULL")
def pair_table(spark, sf):
    results = rounded(correlation.pairwise_with_average(the_pairs(spark, sf)), "r")
    return loaders.pair_table(results, [t for t in ad.ORDER_TOPICS if t != "3-MEDIUM"])


@query("similarity_variant", f"WITH {_CENT}, s AS (SELECT a.topic AS t1, b.topic AS t2, round(list_cosine_similarity(a.c, b.c), 6) + 0.0 AS s FROM c a JOIN c b ON a.topic < b.topic) SELECT t1, t2, t1 || '_' || t2 AS key, -s AS similarity FROM s")
def similarity_variant(spark, sf):
    s = rounded(semantic.centroid_similarity(_centroids(spark, sf)), "similarity")
    table = s.select("t1", "t2", F.lit("average").alias("period"), "similarity", (-F.col("similarity")).alias("similarity_curated"))
    return loaders.similarity_table(table.unionAll(table.withColumn("period", F.lit("2020"))), "curated")


@query("similarity_points", f"WITH {SOCIETY} SELECT t1 || '_' || t2 AS key, x, y FROM soc WHERE society = '1997' AND x IS NOT NULL AND y IS NOT NULL")
def similarity_points(spark, sf):
    p = society_pairs(spark, sf).where("society = '1997'")
    corr = loaders.pair_table(p.select("t1", "t2", F.lit("average").alias("period"), F.lit(1).alias("n"), F.col("y").alias("r")))
    sims = loaders.similarity_table(p.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), F.col("x").alias("similarity")), "selected")
    return loaders.similarity_points(corr, sims)


@query("signed_lookup", f"WITH {PAIRS}, c AS (SELECT t1, t2, {q6(CORR)} AS r FROM pairs GROUP BY ALL) SELECT t2 AS a, t1 AS b, r FROM c UNION ALL SELECT 'none', 'at all', NULL")
def signed_lookup(spark, sf):
    c = rounded(correlation.pairwise(the_pairs(spark, sf)), "r")
    wanted = c.select(F.col("t2").alias("a"), F.col("t1").alias("b")).unionAll(spark.createDataFrame([("none", "at all")], "a string, b string"))
    return loaders.signed_lookup(c, wanted)


@query("opinion_pair", f"WITH {PANEL}, v AS (SELECT user_id, topic, sum(total)/sum(cnt) AS x FROM panel GROUP BY ALL) SELECT user_id, {q6("max(x) FILTER (topic = '1-URGENT')")} AS x, {q6("max(x) FILTER (topic = '5-LOW')")} AS y FROM v WHERE topic IN ('1-URGENT', '5-LOW') GROUP BY user_id")
def opinion_pair(spark, sf):
    return rounded(loaders.opinion_pair(_user_values(spark, sf), "1-URGENT", "5-LOW"), "x", "y")


@query("first_available", f"WITH {PANEL} SELECT user_id, {q6('sum(total)/sum(cnt)')} AS x FROM panel GROUP BY user_id")
def first_available(spark, sf):
    """Users' opinions on a topic that nobody was asked about, else of a region without users, else over all topics."""
    each = _user_values(spark, sf)
    nobody = each.where("topic = '6-NEVER ASKED'").select("user_id", F.col("value").alias("x"))
    nowhere = each.join(ad.table(spark, sf, "customer").where("c_nationkey < 0").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi").select("user_id", F.col("value").alias("x"))
    pooled = the_panel(spark, sf).groupBy("user_id").agg((F.sum("total") / F.sum("cnt")).alias("x"))
    return rounded(loaders.first_available(nobody, nowhere, pooled), "x")


@query("top_keywords", f"WITH {_WORDS} SELECT topic, word, count::DOUBLE AS weight, CAST(row_number() OVER (PARTITION BY topic ORDER BY count DESC, word) AS INT) AS rank FROM c QUALIFY rank <= 7")
def top_keywords(spark, sf):
    return loaders.keywords(_counts(spark, sf).withColumn("word", F.concat(F.lit(" "), "word")), 7, weight="count")


@query("topic_path", "SELECT 'third' AS found")
def topic_path(spark, sf):
    found = loaders.topic_path(spark, [f"{sf}/no.parquet", f"{sf}/*.none", f"{sf}/nation.parquet", f"{sf}/region.parquet"])
    return spark.createDataFrame([("third" if found == f"{sf}/nation.parquet" else str(found),)], "found string")


@query("topic_opinions", f"WITH {PANEL} SELECT topic, user_id, {q6('avg(mean)')} AS average, count(*) AS periods FROM panel WHERE topic IN ('1-URGENT', '2-HIGH', '5-LOW') AND user_id IN ({EUROPE}) GROUP BY ALL")
def topic_opinions(spark, sf):
    """Three topics' files in three layouts, a column for each year, read back for the users of one region."""
    root, long = scratch(spark, "topics"), the_panel(spark, sf)
    for topic, layout in (("1-URGENT", 0), ("2-HIGH", 3), ("5-LOW", 4)):
        wide = long.where(F.col("topic") == topic).groupBy(F.col("user_id").cast("string").alias("user_id")).pivot("year").agg(F.first("mean"))
        wide.write.parquet(f"{root}/{loaders.TOPIC_LAYOUTS[layout].format(topic=topic)}")
    return rounded(loaders.topic_opinions(spark, root, ["1-URGENT", "2-HIGH", "5-LOW"], ad.region_users(spark, sf, "EUROPE")), "average")


@query(
    "coverage_table",
    f"WITH {PANEL}, k AS (SELECT year, user_id, count(DISTINCT topic) AS k, max((topic = '1-URGENT')::INT) AS u, max((topic = '5-LOW')::INT) AS l FROM panel GROUP BY ALL) "
    f"SELECT year, count(*) AS users, count(*) FILTER (k >= 2) AS users_2plus, {q6('avg(k)')} AS mean_topics, {q6('sum(k)/(count(*)*5.0)')} AS observed_share, CAST(sum(coalesce(u, 0)) AS BIGINT) AS \"users_1-URGENT\", CAST(sum(coalesce(l, 0)) AS BIGINT) AS \"users_5-LOW\" FROM k GROUP BY year",
)
def coverage_table(spark, sf):
    """Coverage of each year, with the users of two of the topics."""
    return rounded(panel.coverage(the_panel(spark, sf), 5, topics=("1-URGENT", "5-LOW")), "mean_topics", "observed_share")


@query(
    "carried_label_merge",
    "WITH a AS (SELECT l.doc_id AS post_id, quality AS label, lang, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE toxic = 0), b AS (SELECT doc_id AS post_id, toxic AS label FROM labels WHERE quality = 1) "
    "SELECT coalesce(a.post_id, b.post_id) AS post_id, a.label AS first, b.label AS second, lang, n_chars FROM a FULL JOIN b ON a.post_id = b.post_id",
)
def carried_label_merge(spark, sf):
    """Two raters' labels of overlapping posts; the first one's columns go along."""
    marks = ad.table(spark, sf, "labels").withColumnRenamed("doc_id", "post_id")
    first = marks.where("toxic = 0").join(ad.table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), "lang", "n_chars"), "post_id").withColumn("label", F.col("quality"))
    return labels.merge_raters([("first", first), ("second", marks.where("quality = 1").withColumn("label", F.col("toxic")))], carry=("lang", "n_chars"))


_EQUAL = "e AS (SELECT topic, d, avg(x) AS v FROM f GROUP BY ALL), s AS (SELECT topic, list(v ORDER BY d) AS c FROM e GROUP BY topic)"


@query("stored_centroids", f"WITH {_CENT}, {_EQUAL}, a AS (SELECT topic, {q6('list_cosine_similarity(c.c, s.c)')} AS cosine FROM c JOIN s USING (topic)) SELECT topic, cosine, (SELECT min(cosine) FROM a) AS least FROM a")
def stored_centroids(spark, sf):
    """Centroids of equal weights, stored and read back, against those of weighted keywords."""
    path, vectors = scratch(spark, "centroids"), ad.keyword_vectors(spark, sf)
    semantic.centroids(vectors, False).write.parquet(path)
    return rounded(semantic.centroid_agreement(semantic.centroids(vectors, True), spark.read.parquet(path)), "cosine", "least")


_BRIDGE = "b AS (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','5-LOW']) AS t, unnest(['u','h','m','l']) AS c)"


def _bridge(spark):
    return spark.createDataFrame([("1-URGENT", "u"), ("2-HIGH", "h"), ("3-MEDIUM", "m"), ("5-LOW", "l")], "topic string, concept string")


@query("concept_bridge", f"WITH {PAIRS}, {_BRIDGE}, c AS (SELECT t1, t2, {q6(CORR)} AS r FROM pairs GROUP BY ALL) SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, r FROM c JOIN b x ON t1 = x.t JOIN b y ON t2 = y.t")
def concept_bridge(spark, sf):
    return loaders.concept_bridge(rounded(correlation.pairwise(the_pairs(spark, sf)), "r"), _bridge(spark))


_CAND = f"""WITH {SOCIETY}, {_BRIDGE}, c AS (SELECT society, least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, y.c IS NOT NULL AS ok, soc.y AS r FROM soc JOIN b x ON t1 = x.t JOIN b y ON t2 = y.t),
j AS (SELECT p.a, p.b, p.r AS off_a, q.r AS off_b, s.r AS on_a, u.r AS on_b FROM c p JOIN c q ON p.a = q.a AND p.b = q.b JOIN c s ON p.a = s.a AND p.b = s.b JOIN c u ON p.a = u.a AND p.b = u.b WHERE p.society = '1996' AND q.society = '1997' AND s.society = '1998' AND u.society = '1999' AND p.r IS NOT NULL AND q.r IS NOT NULL AND s.r IS NOT NULL AND u.r IS NOT NULL),
g AS (SELECT *, abs(off_a-off_b) AS gap_off, abs(on_a-on_b) AS gap_on, abs(off_a-off_b)/(abs(on_a-on_b)+0.05) AS score FROM j)"""


@query("tutorial_candidates", f"{_CAND} SELECT a, b, {q6('gap_off')} AS gap_off, {q6('gap_on')} AS gap_on, {q6('score')} AS score, CAST(row_number() OVER (ORDER BY score DESC, a, b) AS INT) AS rank, CAST(row_number() OVER (ORDER BY off_a-off_b DESC, a, b) AS INT) AS by_gap FROM g")
def tutorial_candidates(spark, sf):
    p = society_pairs(spark, sf)
    of = lambda s: loaders.concept_bridge(p.where(F.col("society") == s).select("t1", "t2", F.col("y").alias("r")), _bridge(spark))
    found = loaders.tutorial_candidates(of("1996"), of("1997"), of("1998"), of("1999"))
    return rounded(found, "gap_off", "gap_on", "score").select("a", "b", "gap_off", "gap_on", "score", "rank", "by_gap")


@query("example_pair", f"{_CAND} SELECT a, b, {q6('off_a')} AS off_a, {q6('off_b')} AS off_b, {q6('on_a')} AS on_a, {q6('on_b')} AS on_b, {q6('score')} AS score FROM g ORDER BY g.score DESC, a, b LIMIT 1")
def example_pair(spark, sf):
    p = society_pairs(spark, sf)
    of = lambda s: loaders.concept_bridge(p.where(F.col("society") == s).select("t1", "t2", F.col("y").alias("r")), _bridge(spark))
    found = loaders.tutorial_candidates(of("1996"), of("1997"), of("1998"), of("1999")).where("rank = 1")
    return rounded(found, "off_a", "off_b", "on_a", "on_b", "score").select("a", "b", "off_a", "off_b", "on_a", "on_b", "score")


_YEARPR = f"WITH {PANEL}, m AS (SELECT year, topic, avg(mean) AS m FROM panel GROUP BY ALL), s AS (SELECT a.year, a.topic AS t1, b.topic AS t2, count(*) AS n, sum(a.mean*b.mean) AS s FROM panel a JOIN panel b ON a.user_id = b.user_id AND a.year = b.year AND a.topic <= b.topic GROUP BY ALL), c AS (SELECT s.year, t1, t2, CASE WHEN n > 1 THEN (s-n*m1.m*m2.m)/(n-1) ELSE 0 END AS c FROM s JOIN m m1 ON m1.year = s.year AND m1.topic = t1 JOIN m m2 ON m2.year = s.year AND m2.topic = t2), pr AS (SELECT year, sum(c) FILTER (t1 = t2)**2 / sum(c*c*CASE WHEN t1 = t2 THEN 1 ELSE 2 END) AS pr, count(DISTINCT t1) AS k FROM c GROUP BY year)"


def _year_pr(spark, sf):
    """PR of each year without eigenvalues, which is exact while the covariance is positive semidefinite."""
    cov = spectral.available_covariance(values(spark, sf), ("year",))
    twice = F.when(F.col("t1") == F.col("t2"), 1.0).otherwise(2.0)
    return cov.groupBy("year").agg(F.try_divide(F.pow(F.sum(F.when(F.col("t1") == F.col("t2"), F.col("cov"))), 2), F.sum(twice * F.col("cov") * F.col("cov"))).alias("pr"), F.count_distinct("t1").alias("k"))


@query("year_participation", f"{_YEARPR} SELECT year, {q6('pr')} AS pr, k FROM pr")
def year_participation(spark, sf):
    return rounded(_year_pr(spark, sf), "pr")


@query("spectral_means", f"{_YEARPR}, x AS (SELECT CASE WHEN year < 1998 THEN 'early' ELSE 'late' END AS source, pr/5 AS v FROM pr) SELECT source, {q6('avg(v)')} AS mean, {q6('min(v)')} AS least, {q6('max(v)')} AS most FROM x GROUP BY source")
def spectral_means(spark, sf):
    s = _year_pr(spark, sf).select(F.when(F.col("year") < 1998, "early").otherwise("late").alias("source"), "pr")
    k = spark.createDataFrame([("early", 5), ("late", 5)], "source string, k int")
    return rounded(loaders.spectral_means(s, k), "mean", "least", "most")


@query("period_spectrum", f"{_YEARPR} SELECT 's' AS source, CAST(year AS VARCHAR) AS period, {q6('pr')} AS pr, 1.0::DOUBLE AS lo, 2.0::DOUBLE AS hi FROM pr WHERE year = 1997")
def period_spectrum(spark, sf):
    s = rounded(_year_pr(spark, sf), "pr").select(F.lit("s").alias("source"), F.col("year").cast("string").alias("period"), "pr")
    boot = spark.createDataFrame([("s", "all", 1, 1.0, 2.0), ("t", "1997", 1, 5.0, 6.0)], "source string, period string, periods int, lo double, hi double")
    return loaders.period_spectrum(s, boot, "1997")


@query("topic_subset_spectrum", f"{_YEARPR}, e AS (SELECT year, sum(c) FILTER (t1 = t2)**2 / sum(c*c*CASE WHEN t1 = t2 THEN 1 ELSE 2 END) AS pr FROM c WHERE t1 <> '4-NOT SPECIFIED' AND t2 <> '4-NOT SPECIFIED' GROUP BY year) SELECT year, {q6('pr')} AS pr FROM e")
def topic_subset_spectrum(spark, sf):
    kept = values(spark, sf).where("topic <> '4-NOT SPECIFIED'")
    cov = spectral.available_covariance(kept, ("year",))
    twice = F.when(F.col("t1") == F.col("t2"), 1.0).otherwise(2.0)
    return rounded(cov.groupBy("year").agg((F.pow(F.sum(F.when(F.col("t1") == F.col("t2"), F.col("cov"))), 2) / F.sum(twice * F.col("cov") * F.col("cov"))).alias("pr")), "pr")


@query("word_overlap", f"WITH {_CENT}, s AS (SELECT a.topic AS t1, b.topic AS t2, round(list_cosine_similarity(a.c, b.c), 6) + 0.0 AS s FROM c a JOIN c b ON a.topic < b.topic), e AS (SELECT * FROM (SELECT 'low' AS which, t1, t2, s FROM s ORDER BY s, t1, t2 LIMIT 1) UNION ALL SELECT * FROM (SELECT 'high', t1, t2, s FROM s ORDER BY s DESC, t1, t2 LIMIT 1)), w AS (SELECT label AS t, vec_id::VARCHAR AS word, row_number() OVER (PARTITION BY label ORDER BY vec_id % 5 DESC, vec_id::VARCHAR) AS rank FROM embeddings QUALIFY rank <= 3) SELECT e.which, CAST(x.rank AS INT) AS rank, t1, t2, s AS similarity, x.word AS word_a, y.word AS word_b FROM e JOIN w x ON x.t = t1 JOIN w y ON y.t = t2 AND y.rank = x.rank")
def word_overlap(spark, sf):
    sims = rounded(semantic.centroid_similarity(_centroids(spark, sf)), "similarity")
    return loaders.word_overlap(sims, ad.keyword_vectors(spark, sf), 3)


@query("stored_word_overlap", f"SELECT *, 'miss,hit,miss' AS log FROM ({SQL['word_overlap']})")
def stored_word_overlap(spark, sf):
    """The word overlap from a result store: made, found again, and made anew for another number of words."""
    store, inputs = ResultStore(spark, f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"), [f"{sf}/embeddings.parquet"]
    store.get_or_make("word_overlap", inputs, {"words": 3}, lambda: word_overlap(spark, sf))
    found = store.get_or_make("word_overlap", inputs, {"words": 3}, lambda: word_overlap(spark, sf))
    store.get_or_make("word_overlap", inputs, {"words": 2}, lambda: word_overlap(spark, sf).where("rank <= 2"))
    return found.withColumn("log", F.lit(",".join(what for _, what in store.log)))


@query("shared_words", f"WITH {_WORDS}, k AS (SELECT topic, word FROM c WHERE topic IN ('src1', 'src2') QUALIFY row_number() OVER (PARTITION BY topic ORDER BY count DESC, word) <= 40) SELECT word, CASE WHEN count(*) = 2 THEN 'both' ELSE min(topic) END AS side FROM k GROUP BY word")
def shared_words(spark, sf):
    return loaders.shared_words(_counts(spark, sf).withColumnRenamed("count", "weight"), "src1", "src2", 40)


@query("task_sources", "WITH u AS (SELECT r_name, count(*) AS users FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name), t AS (SELECT 'one_year' AS task, unnest(['US','US','GB','GB']) AS country, unnest(['offline','online','offline','online']) AS medium, unnest(['us_survey','us_posts','gb_survey','gb_posts']) AS source) SELECT task, country, medium, source, users FROM t JOIN u ON r_name = CASE country WHEN 'US' THEN 'AMERICA' ELSE 'EUROPE' END")
def task_sources(spark, sf):
    """The sources of a task, with the users that the tables have in their regions."""
    t = tasks.task("one_year", "US, GB")
    country, medium = tasks.source_maps(t.regions)
    sources = spark.createDataFrame([(t.name, country[s], medium[s], s, {"US": "AMERICA", "GB": "EUROPE"}[country[s]]) for s in country], "task string, country string, medium string, source string, r_name string")
    c, n, r = (ad.table(spark, sf, name) for name in ("customer", "nation", "region"))
    users = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("users"))
    return users.join(F.broadcast(sources), "r_name").drop("r_name")


# --- labels -----------------------------------------------------------------------------------------------------------
def _same(a: str, b: str) -> str:
    return f"round(avg(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} = {b} THEN 1.0 ELSE 0 END), 6) + 0.0 AS same_{a}_{b}"


@query("label_table", f"WITH {_MAJ}, t AS (SELECT m.*, CASE WHEN post_id % 2 = 0 THEN 'even' ELSE 'odd' END AS topic FROM m) SELECT topic, count(*) AS labelled, count(*) FILTER (agreement_count >= 2) AS training_rows, {q6('avg(CASE WHEN agreement_count >= 2 THEN 1.0 ELSE 0 END)')} AS agree_2plus, {q6('count(*) FILTER (agreement_count >= 2 AND agreement_value <> -99) / count(*) FILTER (agreement_count >= 2)')} AS relevant_share, " + ", ".join(f"count(*) FILTER (agreement_value = {v}) AS label_{str(v).replace('-', 'm')}" for v in (-2, -1, 0, 1, 2)) + ", " + ", ".join(_same(a, b) for a, b in (("rater_a", "rater_b"), ("rater_a", "rater_c"), ("rater_b", "rater_c"))) + " FROM t GROUP BY topic")
def label_table(spark, sf):
    rows = ad.rater_labels(spark, sf).withColumn("topic", F.when(F.col("post_id") % 2 == 0, "even").otherwise("odd"))
    return rounded(labels.label_table(rows, RATER_NAMES, "topic"), "agree_2plus", "relevant_share", "same_rater_a_rater_b", "same_rater_a_rater_c", "same_rater_b_rater_c")


@query("training_targets", f"WITH {_MAJ} SELECT 'relevance' AS task, CASE WHEN agreement_value BETWEEN -2 AND 2 THEN 1 ELSE 0 END AS target, count(*) AS n FROM m WHERE agreement_count >= 2 GROUP BY ALL UNION ALL SELECT 'opinion', agreement_value, count(*) FROM m WHERE agreement_count >= 2 AND agreement_value <> -99 GROUP BY ALL")
def training_targets(spark, sf):
    m = labels.majority(ad.rater_labels(spark, sf), RATER_NAMES)
    out = None
    for task in ("relevance", "opinion"):
        part = labels.training_target(m, "agreement_count", "agreement_value", task).groupBy("target").agg(F.count(F.lit(1)).alias("n")).select(F.lit(task).alias("task"), "target", "n")
        out = part if out is None else out.unionAll(part)
    return out


@query("valid_labels", "SELECT c_custkey, CASE WHEN c_custkey % 8 - 3 BETWEEN -2 AND 2 THEN CAST(c_custkey % 8 - 3 AS INT) END AS label FROM customer")
def valid_labels(spark, sf):
    return ad.table(spark, sf, "customer").select("c_custkey", labels.valid_labels((F.col("c_custkey") % 8 - 3).cast("int")).alias("label"))


def _answer(x: Column) -> Column:
    return scalar.label_answer(x, skip="not specified")


def _answer_rows(spark, sf):
    """Orders' priorities as answers to a question about the order; pending orders have none."""
    return ad.table(spark, sf, "orders").select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("content"))


_ANSWERS = "SELECT o_orderkey AS post_id, o_custkey AS user_id, CASE WHEN contains(o_orderpriority, 'NOT SPECIFIED') THEN -99 ELSE TRY_CAST(o_orderpriority[1] AS INT) END AS opinion, o_orderstatus <> 'P' AND o_orderpriority IS NOT NULL AS answered FROM orders"


@query("attached_answers", f"WITH a AS ({_ANSWERS}) SELECT post_id, user_id, opinion FROM a WHERE answered")
def attached_answers(spark, sf):
    a = _answer_rows(spark, sf)
    return labels.attach_answers(a.select("post_id", "user_id"), a.select("post_id", "content"), _answer)


@query("user_stance", f"WITH a AS ({_ANSWERS}) SELECT user_id, count(*) AS posts, {q6('avg(opinion)')} AS stance FROM a WHERE answered AND opinion IS NOT NULL AND opinion <> -99 GROUP BY user_id")
def user_stance(spark, sf):
    return rounded(labels.user_stance(attached_answers(spark, sf)), "stance")


@query("answer_counts", f"WITH a AS ({_ANSWERS}) SELECT count(*) AS answers, count(opinion) AS read, count(*) FILTER (opinion = -99) AS irrelevant, " + ", ".join(f"count(*) FILTER (opinion = {v}) AS opinion_{str(v).replace('-', 'm')}" for v in (-2, -1, 0, 1, 2)) + " FROM a WHERE answered")
def answer_counts(spark, sf):
    return labels.answer_counts(_answer_rows(spark, sf).where("content is not null"), _answer)


@query("chinese_answers", "SELECT doc_id, TRY_CAST(regexp_extract(split_part(text, chr(10), 1), '(-?[0-9]+)', 1) AS INT) AS label FROM documents")
def chinese_answers(spark, sf):
    """Whole documents read as answers: their first lines hold no Chinese word, so that the number decides."""
    return ad.table(spark, sf, "documents").select("doc_id", scalar.label_answer_zh(F.col("text")).alias("label"))


@query(
    "support_answers",
    "SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'NOT') THEN -99 WHEN contains(o_orderpriority, 'LOW') THEN -1 WHEN contains(o_orderpriority, 'HIGH') THEN 1 ELSE 0 END AS three, "
    "CASE WHEN contains(o_orderpriority, 'NOT') THEN -99 WHEN contains(o_orderpriority, 'URGENT') THEN 2 WHEN contains(o_orderpriority, 'LOW') THEN -1 WHEN contains(o_orderpriority, 'HIGH') THEN 1 ELSE 0 END AS five FROM orders",
)
def support_answers(spark, sf):
    """Orders' priorities as stances."""
    words = ("NOT SPECIFIED", "NEVER", "URGENT", "LOW", "HIGH")
    return ad.table(spark, sf, "orders").select("o_orderkey", *[scalar.support_answer(F.col("o_orderpriority"), n == "five", words=words).alias(n) for n in ("three", "five")])


@query("place_answers", "SELECT page_id, TRY_CAST(regexp_extract(url, '\\b([012])\\b', 1) AS INT) AS verdict, CASE WHEN regexp_extract(url, '\\b([A-Za-z]{2})\\b', 1) IN ('de', 'es', 'fr') THEN upper(regexp_extract(url, '\\b([A-Za-z]{2})\\b', 1)) ELSE 'unknown' END AS country FROM pages")
def place_answers(spark, sf):
    """The verdict and the country that a page's url holds as words of their own."""
    return ad.table(spark, sf, "pages").select("page_id", scalar.place_answer(F.col("url")).alias("verdict"), scalar.iso_answer(F.col("url"), ["DE", "ES", "FR"]).alias("country"))


@query("sample_union", "SELECT 'low' AS topic, o_orderkey AS post_id, o_totalprice AS price, NULL AS status FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'high', o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderkey % 60 = 0")
def sample_union(spark, sf):
    o = ad.table(spark, sf, "orders")
    return labels.union_samples({"low": o.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("post_id"), F.col("o_totalprice").alias("price")), "high": o.where("o_orderkey % 60 = 0").select(F.col("o_orderkey").alias("post_id"), F.col("o_orderstatus").alias("status"))}).select("topic", "post_id", "price", "status")


@query("run_summary", "SELECT l_returnflag, l_linestatus, count(*) AS size, round(avg(l_tax), 6)+0.0 AS acc_mean, round(stddev_samp(l_tax), 6)+0.0 AS acc_sd FROM lineitem GROUP BY ALL")
def run_summary(spark, sf):
    runs = ad.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_tax").alias("acc"), F.lit(None).cast("double").alias("auc"))
    return rounded(labels.run_summary(runs, ["l_returnflag", "l_linestatus"], ["acc", "auc"]), "acc_mean", "acc_sd")


@query("batch_states", "SELECT CAST(o_orderkey % 10 AS INT) AS batch, CASE WHEN o_orderkey % 10 < 4 THEN 'retrieved' WHEN o_orderkey % 10 < 7 THEN 'submitted' WHEN o_orderkey % 10 = 9 THEN 'submitted' ELSE 'generated' END AS state, count(*) AS requests, count(*) FILTER (o_orderkey % 10 < 4 OR o_orderkey % 20 = 5) AS answered FROM orders GROUP BY o_orderkey % 10")
def batch_states(spark, sf):
    o = ad.table(spark, sf, "orders")
    requests = o.select((F.col("o_orderkey") % 10).cast("int").alias("batch"), F.col("o_orderkey").cast("string").alias("custom_id"))
    outputs = o.where("o_orderkey % 10 < 4 or o_orderkey % 20 = 5").select(F.col("o_orderkey").cast("string").alias("custom_id"))
    sent = spark.range(7).select(F.col("id").cast("int").alias("batch"))
    control = spark.createDataFrame([(9, "submitted"), (2, "generated")], "batch int, state string")
    return jobs.advance(control, requests, sent, outputs)


@query("open_requests", "SELECT CAST(o_orderkey AS VARCHAR) AS custom_id FROM orders WHERE o_orderkey % 3 <> 0")
def open_requests(spark, sf):
    r = ad.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("custom_id"))
    return jobs.open_requests(r, r.where("cast(custom_id as long) % 3 = 0"))


def length_scorer(texts: list[str]) -> tuple[np.ndarray, list[float]]:
    """A stand-in for a model: long texts are relevant, their opinion is the share of vowels."""
    logits = np.array([[1.0, 0.0] if len(t) < 500 else [0.0, 1.0] for t in texts])
    return logits, [sum(t.count(v) for v in "aeiou") / max(len(t), 1) for t in texts]


@query("scored_rows", f"SELECT doc_id AS post_id, CASE WHEN length(text) < 500 THEN 0 ELSE 1 END AS relevance, CASE WHEN length(text) >= 500 THEN {q6('(5*length(text) - length(replace(text, chr(97), chr(0))) * 0 - ' + ' - '.join(f'length(replace(text, chr({c}), {chr(39) * 2}))' for c in (97, 101, 105, 111, 117)) + ')/length(text)')} END AS opinion FROM documents")
def scored_rows(spark, sf):
    docs = ad.table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), "text")
    return rounded(jobs.score_rows(docs, "text", length_scorer), "opinion")


# --- text and places --------------------------------------------------------------------------------------------------
_KEYS = ((1, "the"), (2, "tion"), (3, "der"), (4, "que"), (5, "thetion"), (6, "on"), (7, "ation"))
_KEY_SQL = ", ".join(f"CASE WHEN strpos(text, '{k}') > 0 THEN struct_pack(e := strpos(text, '{k}') + {len(k) - 1}, l := {-len(k)}, id := {i}) END" for i, k in _KEYS)


@query("keyword_search", f"SELECT doc_id, CAST(list_min(list_filter([{_KEY_SQL}], lambda x: x IS NOT NULL)).id AS INT) AS keyword_id FROM documents WHERE {' OR '.join(f'contains(text, {chr(39)}{k}{chr(39)})' for _, k in _KEYS)}")
def keyword_search(spark, sf):
    return text.search_keywords(ad.table(spark, sf, "documents"), "text", _KEYS, "doc_id")


@query("topic_matches", "SELECT doc_id, 'a' AS topic FROM documents WHERE regexp_matches(text, 'tion|der') UNION ALL SELECT doc_id, 'b' FROM documents WHERE regexp_matches(text, 'que')")
def topic_matches(spark, sf):
    return text.topic_matches(ad.table(spark, sf, "documents").select("doc_id", "text"), "text", {"a": ["tion", "der"], "b": ["que"], "c": []}).select("doc_id", "topic")


@query("pooled_counts", f"WITH {_WORDS} SELECT word, CAST(sum(count) AS BIGINT) AS count FROM c GROUP BY word")
def pooled_counts(spark, sf):
    return text.pooled_counts(_counts(spark, sf))


@query("post_content", "SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN replace(text, chr(10), ' ') ELSE replace(text, chr(10), ' ') || '//' || replace(lang, chr(10), ' ') END AS content FROM documents d")
def post_content(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", scalar.post_content(F.col("text"), F.col("lang"), F.col("doc_id") % 2 == 1).alias("content"))


@query("clean_posts", r"WITH p AS (SELECT conv_id, turn, 'RT ' || chr(34) || 'http://a.b/c?d=1 @me ' || text || ' 中文 it''s.' AS t FROM conversations) SELECT conv_id, turn, regexp_replace(trim(replace(regexp_replace(regexp_replace(replace(replace(replace(replace(t, chr(34), ''), 'RT', ''), '.', ''), chr(39), ''), '[http|https]*://[a-zA-Z0-9.?/&=:_%,-~]*', '', 'gs'), '[一-龥]', '', 'g'), chr(10), ' ')), '[@].*?[ ]', '', 'gs') AS post FROM p")
def clean_posts(spark, sf):
    c = ad.table(spark, sf, "conversations")
    raw = F.concat(F.lit('RT "http://a.b/c?d=1 @me '), F.col("text"), F.lit(" 中文 it's."))
    return c.select("conv_id", "turn", scalar.clean_post(raw).alias("post"))


@query("clean_microblogs", r"WITH p AS (SELECT conv_id, turn, '“点击链接查看更多->”//@某人:转发' || text || '#话题#《书》…' AS t FROM conversations) SELECT conv_id, turn, trim(replace(regexp_replace(regexp_replace(replace(replace(replace(replace(t, '“', ''), '”', ''), '…', ''), '点击链接查看更多->', ''), '[a-zA-Z0-9.?/&=:_%,-~#《》]', '', 'gs'), '[//@].*?[:]', '', 'gs'), chr(10), ' ')) AS post FROM p")
def clean_microblogs(spark, sf):
    raw = F.concat(F.lit("“点击链接查看更多->”//@某人:转发"), F.col("text"), F.lit("#话题#《书》…"))
    return ad.table(spark, sf, "conversations").select("conv_id", "turn", scalar.clean_microblog(raw).alias("post"))


@query("noun_compounds", "WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, w[1] || ' ' || w[2] AS phrase FROM p WHERE len(w) = 2 AND w[2] IN ('ring', 'widget') AND w[1] IN ('small', 'red', 'ring')")
def noun_compounds(spark, sf):
    words = F.split(F.element_at(scalar.clauses(F.concat("p_name", F.lit("; 12"))), 1), " ")
    return ad.table(spark, sf, "part").select("p_partkey", F.explode(scalar.noun_compounds(words, ["ring", "widget"], ["small", "red"])).alias("phrase"))


@query("codebook_tokens", "WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), f AS (SELECT p_partkey, CASE w WHEN 'ring' THEN 'rings' ELSE w END AS word FROM w) SELECT word, count(*) AS n FROM f GROUP BY word")
def codebook_tokens(spark, sf):
    t = scalar.unglue(scalar.tokens(F.col("p_name")), {"ring": "rings"})
    return ad.table(spark, sf, "part").select(F.explode(t).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("word_ngrams", "WITH w AS (SELECT doc_id, string_split(lang || ' ' || source || ' x', ' ') AS w FROM documents) SELECT doc_id, w[1] || ' ' || w[2] AS a, w[2] || ' ' || w[3] AS b FROM w")
def word_ngrams(spark, sf):
    g = scalar.ngrams(F.split(F.concat_ws(" ", "lang", "source", F.lit("x")), " "), 2)
    return ad.table(spark, sf, "documents").select("doc_id", F.get(g, F.lit(0)).alias("a"), F.get(g, F.lit(1)).alias("b"))


_NORMAL = "' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower(url), '[.,;:/|()_-]', ' ', 'g'), '[0-9]', '', 'g'), ' +', ' ', 'g')) || ' '"
_PLACED = f"pl AS (SELECT page_id, url, {_NORMAL} AS w FROM pages)"


def _said(*phrases: str) -> str:
    return "(" + " OR ".join(f"contains(w, ' {p} ')" for p in phrases) + ")"


def _placed(spark, sf):
    """Pages as users: their urls are the texts that name a place."""
    return ad.table(spark, sf, "pages").select(F.col("page_id").alias("user_id"), F.col("url").alias("place"))


def _us(x: Column) -> Column:
    return places.home_or_abroad(x, ["cheap pills"], ["example com"], ["blog", "www"], ["example org"], ["utm_source"], ["FR"])


_US_CLASS = f"CASE WHEN url IS NULL OR trim(url) = '' THEN 'undecided' WHEN {_said('cheap pills')} THEN 'not_sure' WHEN {_said('example com', 'blog', 'www')} THEN 'us' WHEN {_said('example org')} OR contains(url, 'utm_source') THEN 'non_us' WHEN {_said('fr')} THEN 'us' ELSE 'undecided' END"


@query("home_cascade", f"WITH {_PLACED} SELECT page_id AS user_id, {_US_CLASS} AS class FROM pl")
def home_cascade(spark, sf):
    return _placed(spark, sf).select("user_id", _us(F.col("place")).alias("class"))


@query(
    "union_cascade",
    f"WITH {_PLACED} SELECT page_id AS user_id, CASE WHEN url IS NULL OR trim(url) = '' THEN 'undecided' WHEN {_said('cheap pills')} THEN 'non_eu' WHEN {_said('example net')} THEN 'eu' WHEN {_said('blog', 'www')} THEN 'non_eu' WHEN {_said('fr', 'de')} THEN 'eu' ELSE 'undecided' END AS class FROM pl",
)
def union_cascade(spark, sf):
    cls = places.union_or_not(F.col("place"), ["cheap pills"], ["example net"], ["FR", "DE"], ["blog", "www"])
    return _placed(spark, sf).select("user_id", cls.alias("class"))


@query(
    "country_cascade",
    f"WITH {_PLACED} SELECT page_id AS user_id, CASE WHEN contains(url, 'utm_source') THEN 'US' WHEN {_said('www')} THEN 'GB' WHEN {_said('blog')} THEN 'IE' WHEN {_said('m')} THEN 'PT' WHEN {_said('fr')} THEN 'FR' WHEN {_said('de')} THEN 'DE' WHEN {_said('es')} THEN 'ES' ELSE 'unknown' END AS country FROM pl",
)
def country_cascade(spark, sf):
    c = places.country_of(F.col("place"), {"utm_source": "US"}, {"www": "GB"}, {"blog": "IE", "m": "PT"}, ["FR", "DE", "ES"])
    return _placed(spark, sf).select("user_id", c.alias("country"))


def _merged_places(spark, sf):
    """What the rules leave open is settled by the language of the document of the page's id, as a second model's verdict."""
    found = _placed(spark, sf).select("place").distinct().withColumn("class", _us(F.col("place")))
    verdicts = _placed(spark, sf).join(ad.table(spark, sf, "documents").select(F.col("doc_id").alias("user_id"), F.col("lang").alias("verdict")), "user_id").select("place", "verdict")
    return places.merge_verdicts(found, verdicts, {"en": "us", "fr": "non_us", "de": "non_us"})


_MERGED = (
    f"{_PLACED}, vd AS (SELECT url, min(lang) AS verdict FROM pages JOIN documents ON page_id = doc_id GROUP BY url), cl AS (SELECT DISTINCT url, {_US_CLASS} AS class FROM pl), "
    "mg AS (SELECT cl.url, CASE WHEN class NOT IN ('undecided', 'not_sure') OR verdict IS NULL THEN class WHEN verdict = 'en' THEN 'us' WHEN verdict IN ('fr', 'de') THEN 'non_us' ELSE verdict END AS class FROM cl LEFT JOIN vd ON cl.url = vd.url)"
)


@query("merged_verdicts", f"WITH {_MERGED} SELECT url AS place, class FROM mg")
def merged_verdicts(spark, sf):
    return _merged_places(spark, sf)


@query("class_users", f"WITH {_MERGED} SELECT DISTINCT class, page_id AS user_id FROM pages JOIN mg USING (url)")
def class_users(spark, sf):
    return places.place_users(_placed(spark, sf), _merged_places(spark, sf))


@query("class_sizes", f"WITH {_MERGED} SELECT class, count(DISTINCT page_id) AS users FROM pages JOIN mg USING (url) WHERE page_id IN (SELECT o_custkey FROM orders) GROUP BY ALL")
def class_sizes(spark, sf):
    return places.class_sizes(class_users(spark, sf), ad.opinions(spark, sf))


@query("one_class_each", "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS class FROM customer")
def one_class_each(spark, sf):
    c = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    both = c.withColumn("class", F.lit("b")).unionAll(c.where("user_id % 2 = 0").withColumn("class", F.lit("a"))).unionAll(c.withColumn("class", F.lit("z")))
    return places.one_class_each(both, ["a", "b"])


# --- scalar functions -------------------------------------------------------------------------------------------------
@query("recoded_items", "SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 5 END AS confidence, CASE p_size % 4 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 3 END AS environment, round(CASE p_size % 5 WHEN 1 THEN 1 WHEN 2 THEN 1+4/3.0 WHEN 3 THEN 1+8/3.0 WHEN 4 THEN 5 END, 6) + 0.0 AS spread FROM part")
def recoded_items(spark, sf):
    p, five = ad.table(spark, sf, "part"), F.col("p_size") % 5
    return p.select("p_partkey", scalar.recode(five, {1: 1, 2: 2, 3: 4, 4: 5}).alias("confidence"), scalar.recode(F.col("p_size") % 4, {1: 1, 2: 5, 3: 3}).alias("environment"), r6(scalar.four_to_five(five)).alias("spread"))


@query("lenient_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS value FROM orders")
def lenient_numbers(spark, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    return ad.table(spark, sf, "orders").select("o_orderkey", scalar.to_double(raw).alias("value"))


@query("softmax_labels", "SELECT l_orderkey, l_linenumber, round(exp(l_tax*10)/(exp(l_tax*10)+exp(l_discount*10)), 6)+0.0 AS p, CASE WHEN l_tax >= l_discount THEN 0 ELSE 1 END AS label FROM lineitem")
def softmax_labels(spark, sf):
    logits = F.array(F.col("l_tax") * 10, F.col("l_discount") * 10)
    return ad.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(scalar.softmax_one(logits, 0)).alias("p"), scalar.argmax_label(logits).alias("label"))


@query("residual_angles", "SELECT l_orderkey, l_linenumber, round(degrees(asin(least(1, l_quantity/40))), 6)+0.0 AS angle, round(sqrt(greatest(0, 1-(l_quantity/40)**2)), 6)+0.0 AS cosine FROM lineitem")
def residual_angles(spark, sf):
    angle, cosine = scalar.residual_angle(F.col("l_quantity") / 40)
    return ad.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(angle).alias("angle"), r6(cosine).alias("cosine"))


@query("pretty_labels", "SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'one' WHEN 3 THEN 'three' ELSE n_nationkey::VARCHAR END AS label FROM nation")
def pretty_labels(spark, sf):
    return ad.table(spark, sf, "nation").select("n_nationkey", scalar.pretty_label(F.col("n_nationkey").cast("double"), {"1": "one", "3": "three"}).alias("label"))


@query("topic_aliases", "SELECT DISTINCT o_orderpriority AS topic, replace(lower(o_orderpriority), '_', '') AS alias FROM orders")
def topic_aliases(spark, sf):
    raw = F.concat(F.lit("topic- "), F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit("-_")))
    t = ad.table(spark, sf, "orders").select("o_orderpriority").distinct()
    return t.select(F.col("o_orderpriority").alias("topic"), scalar.alias_topic(raw).alias("alias"))


@query("lookup_names", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'open' END AS name FROM orders")
def lookup_names(spark, sf):
    return ad.table(spark, sf, "orders").select("o_orderkey", scalar.lookup(F.col("o_orderstatus"), {"P": "pending", "O": "open"}).alias("name"))


# --- keywords and vectors ---------------------------------------------------------------------------------------------
_SIMS = f"{_CENT}, s AS (SELECT e.vec_id, e.label AS topic, list_cosine_similarity(e.embedding::DOUBLE[], c.c) AS sim, c.topic = e.label AS own FROM embeddings e, c), k AS (SELECT topic, vec_id % 60 AS w, round(max(sim) FILTER (own), 9) AS a, round(max(sim) FILTER (NOT own), 9) AS o FROM s GROUP BY ALL), cand AS (SELECT k.topic, 'w' || k.w AS word, a, o, d.df FROM k JOIN (SELECT w, count(DISTINCT topic) AS df FROM k GROUP BY w) d ON k.w = d.w)"


def _candidates(spark, sf):
    own = semantic.anchor_scores(ad.keyword_vectors(spark, sf), _centroids(spark, sf).select("topic", F.col("centroid").alias("anchor")))
    k = own.withColumn("word", F.concat(F.lit("w"), (F.col("word") % 60).cast("string"))).groupBy("topic", "word").agg(F.round(F.max("anchor_sim"), 9).alias("anchor_sim"), F.round(F.max("other_sim"), 9).alias("other_sim"))
    return k.join(k.groupBy("word").agg(F.count_distinct("topic").alias("df")), "word")


@query("anchor_scores", f"WITH {_SIMS} SELECT topic, word, df, {q6('a')} AS anchor_sim, {q6('o')} AS other_sim FROM cand")
def anchor_scores(spark, sf):
    return rounded(_candidates(spark, sf), "anchor_sim", "other_sim").select("topic", "word", "df", "anchor_sim", "other_sim")


_RULES = f"{_SIMS}, ok AS (SELECT *, a >= 0.2 AND a > o AND (df = 1 OR a >= 0.3) AND NOT (topic = 1 AND word IN ('w1', 'w3')) AS pass FROM cand), kept AS (SELECT topic, word, a, o, 'rule' AS by_ FROM ok WHERE pass UNION ALL SELECT 2, 'added', 0.9, 0.1, 'review'), best AS (SELECT topic, word, a, o, 'fallback' AS by_ FROM ok WHERE topic NOT IN (SELECT topic FROM kept) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY a DESC, word DESC) = 1), sel AS (SELECT * FROM kept UNION ALL SELECT * FROM best)"


def _ruled(spark, sf):
    kind = dict(ad.keyword_vectors(spark, sf).dtypes)["topic"]
    dropped = spark.createDataFrame([(1, "w1"), (1, "w3")], f"topic {kind}, word string")
    added = spark.createDataFrame([(2, "added", 0.9, 0.1)], f"topic {kind}, word string, anchor_sim double, other_sim double")
    return semantic.keyword_rules(_candidates(spark, sf), 0.2, 0.3, dropped, added)


@query("keyword_rules", f"WITH {_RULES} SELECT topic, word, {q6('a')} AS anchor_sim, {q6('o')} AS other_sim, by_ AS selected_by FROM sel")
def keyword_rules(spark, sf):
    return rounded(_ruled(spark, sf), "anchor_sim", "other_sim")


_PARTS = "w AS (SELECT DISTINCT p_type AS topic, unnest([p_name, string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], 'far ' || p_brand]) AS word FROM part), a AS (SELECT topic, word, (length(word) * 7 + length(topic)) % 10 / 10.0::DOUBLE AS s FROM w WHERE word <> 'red widget'), t AS (SELECT DISTINCT topic FROM w), al AS (SELECT topic, word FROM a UNION ALL SELECT topic, 'red widget' FROM t), ok AS (SELECT topic, word, s, 1 AS k FROM a WHERE s >= 0.4 AND NOT EXISTS (SELECT 1 FROM al o WHERE o.topic = a.topic AND len(string_split(o.word, ' ')) > len(string_split(a.word, ' ')) AND len(list_filter(string_split(a.word, ' '), lambda x: NOT list_contains(string_split(o.word, ' '), x))) = 0) UNION ALL SELECT topic, 'red widget', 1.0, 0 FROM t)"


@query("keyword_top", f"WITH {_PARTS} SELECT topic, word, s AS anchor_sim, CASE k WHEN 0 THEN 'anchor' ELSE 'rule' END AS kind, CAST(row_number() OVER (PARTITION BY topic ORDER BY k, s DESC, word) AS INT) AS rank FROM ok QUALIFY rank <= 5")
def keyword_top(spark, sf):
    p = ad.table(spark, sf, "part")
    parts = F.split("p_name", " ")
    w = p.select(F.col("p_type").alias("topic"), F.explode(F.array("p_name", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.concat(F.lit("far "), "p_brand"))).alias("word")).distinct()
    sel = w.withColumn("anchor_sim", ((F.length("word") * 7 + F.length("topic")) % 10) / F.lit(10.0))
    return semantic.keyword_top(sel, w.select("topic").distinct().withColumn("anchor", F.lit("red widget")))


@query("phrase_vectors", "WITH v AS (SELECT vec_id::VARCHAR AS w, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN 'word' WHEN vec_id % 4 = 1 THEN 'composed' END AS source, round(CASE WHEN vec_id % 4 = 0 THEN embedding[1]::DOUBLE WHEN vec_id % 4 = 1 THEN (embedding[1]::DOUBLE + (SELECT e[1] FROM v WHERE w = '0'))/2 END, 6) + 0.0 AS first FROM embeddings WHERE vec_id % 4 <> 3")
def phrase_vectors(spark, sf):
    v = ad.keyword_vectors(spark, sf).select(F.col("word").cast("string").alias("word"), "vector")
    own = F.col("word").cast("long") % 4
    phrase = F.when(own == 0, F.col("word")).when(own == 1, F.concat("word", F.lit(" of the 0"))).otherwise(F.concat(F.lit("none "), "word", F.lit("x")))
    got = semantic.phrase_vectors(v.where(own != 3).select(phrase.alias("word")), v)
    return got.select(F.regexp_extract("word", r"(\d+)", 1).cast("long").alias("id"), "source", r6(F.get("vector", F.lit(0))).alias("first"))


def letter_provider(words: list[str]) -> list[list[float]]:
    """A stand-in for an embedding service."""
    return [[float(len(w)), float(w.count("1"))] for w in words]


@query("cached_vectors", "SELECT vec_id::VARCHAR AS word, vec_id % 3 = 0 AS cached, CASE WHEN vec_id % 3 = 0 THEN -1.0::DOUBLE ELSE length(vec_id::VARCHAR)::DOUBLE END AS first FROM embeddings")
def cached_vectors(spark, sf):
    w = ad.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("word"))
    cache = w.where("cast(word as long) % 3 = 0").withColumn("vector", F.array(F.lit(-1.0), F.lit(0.0)))
    return semantic.cached_vectors(w, cache, letter_provider).select("word", "cached", F.get("vector", F.lit(0)).alias("first"))


@query("nearest_topics", f"WITH {_CENT}, s AS (SELECT a.topic, b.topic AS other, list_cosine_similarity(a.c, b.c) AS s FROM c a JOIN c b ON a.topic <> b.topic) SELECT topic, CAST(arg_max(other, abs(s)) AS VARCHAR) AS subset, {q6('sqrt(1-max(abs(s))**2)')} AS residual, {q6('degrees(asin(sqrt(1-max(abs(s))**2)))')} AS angle FROM s GROUP BY topic")
def nearest_topics(spark, sf):
    """The best subset of one other topic: its span leaves the sine of the angle between the two."""
    found = semantic.subset_projection(_centroids(spark, sf)).where("size = 1")
    return rounded(found.select("topic", F.array_join(F.transform("subset", lambda t: t.cast("string")), ",").alias("subset"), "residual", "angle"), "residual", "angle")


@query("subset_projection")
def subset_projection(spark, sf):
    return rounded(semantic.subset_projection(_centroids(spark, sf)), "residual", "angle")


@query("centroid_conditioning")
def centroid_conditioning(spark, sf):
    return rounded(semantic.centroid_conditioning(_centroids(spark, sf)), "condition")


@query("centroid_table", f"WITH {_CENT}, n AS (SELECT label AS topic, count(*) AS n, sum(vec_id % 5 + 1)::DOUBLE AS weight_sum FROM embeddings GROUP BY label) SELECT n.topic, n.n, weight_sum, round(sqrt(list_dot_product(c, c)), 6) + 0.0 AS centroid_norm, len(c) AS size, round(c[1], 6) + 0.0 AS first FROM c JOIN n ON c.topic = n.topic")
def centroid_table(spark, sf):
    return _centroids(spark, sf).select("topic", "n", "weight_sum", r6(scalar.norm(F.col("centroid"))).alias("centroid_norm"), F.size("centroid").cast("long").alias("size"), r6(F.get("centroid", F.lit(0))).alias("first"))


@query("point_distances", "SELECT q.vec_id AS query, e.vec_id AS word, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) + 0.0 AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id")
def point_distances(spark, sf):
    v = ad.keyword_vectors(spark, sf).select("word", F.col("vector").cast("array<double>").alias("vector"))
    holes = v.select((-F.col("word") - 1).alias("word"), F.transform("vector", lambda x, i: F.when(i != 3, x)).alias("vector"))
    return semantic.point_distances(v.unionAll(holes), v.where("word % 20 = 0")).select("query", "word", (F.round("distance", 5) + 0.0).alias("distance"))


@query("borrowed_similarity", f"WITH {_CENT}, s AS (SELECT a.topic AS t1, b.topic AS t2, round(list_cosine_similarity(a.c, b.c), 6) + 0.0 AS s FROM c a JOIN c b ON a.topic < b.topic) SELECT 'x' || least(t1, t2) AS a, 'x' || greatest(t1, t2) AS b, s AS r FROM s WHERE t1 <> 3 AND t2 <> 3")
def borrowed_similarity(spark, sf):
    """A source's topics by the centroids of another's, through a map of topics."""
    sims = rounded(semantic.centroid_similarity(_centroids(spark, sf)), "similarity")
    m = _centroids(spark, sf).select("topic").where("topic <> 3").withColumn("concept", F.concat(F.lit("x"), F.col("topic").cast("string")))
    return loaders.concept_bridge(sims.withColumnRenamed("similarity", "r"), m)


@query("semantic_rank_variants")
def semantic_rank_variants(spark, sf):
    """Variants of the centroids, plain and centred, with the range of the ranks over them."""
    v, out = ad.keyword_vectors(spark, sf), None
    for name, weighted in (("weighted", True), ("equal", False)):
        for centred in (False, True):
            part = semantic.semantic_rank(semantic.centroids(v, weighted), centred).withColumn("variant", F.lit(name + ("_centred" if centred else "")))
            out = part if out is None else out.unionAll(part)
    ends = out.agg(F.min("pr").alias("least_pr"), F.max("pr").alias("most_pr"))
    return rounded(out.join(F.broadcast(ends)), "pr", "erank", "first_share", "mean_cosine", "least_pr", "most_pr")  # one row


# --- simulated grids --------------------------------------------------------------------------------------------------
_GRID = "g AS (SELECT l_returnflag AS pattern, CAST(l_linenumber AS BIGINT) AS n_rows, l_tax AS missing, CAST(l_quantity % 4 AS INT) + 1 AS n, sqrt(l_extendedprice)/10 AS pr, l_discount*sqrt(l_extendedprice) AS erank, l_quantity + sqrt(l_extendedprice) AS srank FROM lineitem), m AS (SELECT pattern, n_rows, missing, n, round(avg(pr), 9) AS pr, avg(erank) AS erank, avg(srank) AS srank FROM g GROUP BY ALL)"


def _grid(spark, sf):
    g = ad.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("pattern"), F.col("l_linenumber").cast("long").alias("n_rows"), F.col("l_tax").alias("missing"), ((F.col("l_quantity") % 4).cast("int") + 1).alias("n"), (F.sqrt("l_extendedprice") / 10).alias("pr"), (F.col("l_discount") * F.sqrt("l_extendedprice")).alias("erank"), (F.col("l_quantity") + F.sqrt("l_extendedprice")).alias("srank"))
    return simulation.cell_means(g).withColumn("pr", F.round("pr", 9))


@query("grid_cell_means", f"WITH {_GRID} SELECT pattern, n_rows, missing, n, {q6('pr')} AS pr, {q6('erank')} AS erank, {q6('srank')} AS srank FROM m")
def grid_cell_means(spark, sf):
    return rounded(_grid(spark, sf), "pr", "erank", "srank")


@query("grid_variation", f"WITH {_GRID} SELECT pattern, missing, n, {q6('stddev_samp(pr)/avg(pr)')} AS cv FROM m GROUP BY ALL")
def grid_variation(spark, sf):
    return rounded(simulation.variation(_grid(spark, sf), "n_rows"), "cv")


@query("grid_direction", f"WITH {_GRID}, d AS (SELECT pattern, n_rows, n, arg_min(pr, missing) AS lo, arg_max(pr, missing) AS hi FROM m GROUP BY ALL) SELECT pattern, n_rows, n, {q6('lo')} AS at_lowest, {q6('hi')} AS at_highest, {q6('(hi-lo)/lo')} AS relative_change FROM d")
def grid_direction(spark, sf):
    return rounded(simulation.direction(_grid(spark, sf)), "at_lowest", "at_highest", "relative_change")


_RANKED = "k AS (SELECT pattern, n_rows, missing, rank() OVER (PARTITION BY pattern, n_rows, missing ORDER BY n) + (count(*) OVER (PARTITION BY pattern, n_rows, missing, n) - 1)/2.0 AS x, rank() OVER (PARTITION BY pattern, n_rows, missing ORDER BY pr) + (count(*) OVER (PARTITION BY pattern, n_rows, missing, pr) - 1)/2.0 AS y FROM m)"


@query("grid_dimension_error", f"WITH {_GRID}, {_RANKED}, r AS (SELECT pattern, n_rows, missing, CASE WHEN count(*) > 1 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS rho FROM k GROUP BY ALL), e AS (SELECT pattern, n_rows, missing, avg(abs(pr-n)) AS mae, CASE WHEN count(*) > 1 AND var_pop(n) > 0 AND var_pop(pr) > 0 THEN corr(n, pr) END AS p FROM m GROUP BY ALL) SELECT e.pattern, e.n_rows, e.missing, {q6('mae')} AS mae, {q6('p')} AS pearson, {q6('rho')} AS spearman FROM e JOIN r ON e.pattern = r.pattern AND e.n_rows = r.n_rows AND e.missing = r.missing")
def grid_dimension_error(spark, sf):
    return rounded(simulation.dimension_error(_grid(spark, sf)), "mae", "pearson", "spearman")


@query("grid_pivot", f"WITH {_GRID} SELECT n_rows, n, {q6("avg(pr) FILTER (pattern = 'A')")} AS a, {q6("avg(pr) FILTER (pattern = 'R')")} AS r FROM m GROUP BY ALL")
def grid_pivot(spark, sf):
    wide = _grid(spark, sf).groupBy("n_rows", "n").pivot("pattern", ["A", "R"]).agg(F.avg("pr"))
    return rounded(wide.select("n_rows", "n", F.col("A").alias("a"), F.col("R").alias("r")), "a", "r")


@query("dimension_spaces")
def dimension_spaces(spark, sf):
    """All distance spaces of the estimator over all users."""
    return rounded(dimension.estimates(_user_values(spark, sf)), "pr", "erank", "srank", "mle", "mle_lo", "mle_hi", "two_nn")
