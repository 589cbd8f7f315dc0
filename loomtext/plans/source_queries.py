"""Registered queries that write by each writer and read by each reader, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection
from ..sources import readers, writers
from ..sources.scratch import folder
from ..streaming import scoring
from . import prompts
from .queries import ANSWER, PAIRS, query, table


@query("SELECT * FROM labels")
def compressed_lines(spark, sf_dir):
    """JSON lines, compressed."""
    labels, path = table(spark, sf_dir, "labels"), folder(spark, "lines")
    writers.json_lines(labels, path, "gzip")
    return readers.json_lines(spark, path, labels.schema)


@query("SELECT *, quality * 2 AS metric_double FROM labels")
def enriched_lines(spark, sf_dir):
    """Rows as they are, with a metric."""
    labels, path = table(spark, sf_dir, "labels"), folder(spark, "enriched")
    writers.enriched(labels, {"double": F.col("quality") * 2}, path)
    return readers.json_lines(spark, path, labels.withColumn("metric_double", F.col("quality") * 2).schema)


@query("SELECT doc_id, lang AS config, CASE WHEN doc_id % 2 = 0 THEN 'test' ELSE 'train' END AS split FROM documents WHERE lang = 'en' AND doc_id % 2 = 1")
def one_configuration(spark, sf_dir):
    """One configuration and split of a data set on disk."""
    path = folder(spark, "set")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("config"), F.when(F.col("doc_id") % 2 == 0, "test").otherwise("train").alias("split"))
    writers.parquet(docs, path, ["config", "split"])
    return readers.partitioned(spark, path, "en", "train")


@query("SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang")
def report_file(spark, sf_dir):
    """A report as CSV, its index first."""
    path = folder(spark, "report")
    writers.report_csv(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), path, "lang")
    return readers.csv_table(spark, path, "lang string, n long, chars long")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def grouped_files(spark, sf_dir):
    """CSV files for each group, with their configuration."""
    path = folder(spark, "groups")
    writers.grouped_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"], {"by": "status"})
    return readers.csv_table(spark, f"{path}/rows", "o_orderkey long, o_totalprice double, o_orderstatus string")


@query("SELECT CAST(n_nationkey AS BIGINT) AS s, CAST(n_nationkey + n_regionkey AS BIGINT) AS e FROM nation")
def span_files(spark, sf_dir):
    """Spans as one line of text."""
    path = folder(spark, "spans")
    long = lambda c: c.cast("long")
    spans = F.collect_list(F.struct(long(F.col("n_nationkey")).alias("s"), long(F.col("n_nationkey") + F.col("n_regionkey")).alias("e")))
    writers.span_text(table(spark, sf_dir, "nation").agg(spans.alias("spans")), path)
    return readers.span_text(spark, path).select(F.explode("spans").alias("x")).select("x.s", "x.e")


@query("SELECT doc_id, lang, 'part' AS stem FROM documents")
def folder_of_lines(spark, sf_dir):
    """All files of a folder, with what their names begin with."""
    path = folder(spark, "folder")
    writers.json_lines(table(spark, sf_dir, "documents").select("doc_id", "lang"), path)
    return readers.folder(spark, path, "doc_id long, lang string", "*.json").select("doc_id", "lang", F.substring_index("dataset_name", "-", 1).alias("stem"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS line_no, n_name AS value FROM nation")
def lines_of_text(spark, sf_dir):
    """Numbered lines of a whole text."""
    path = folder(spark, "text")
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x.n_name)
    table(spark, sf_dir, "nation").agg(F.array_join(names, "\n").alias("value")).write.text(path)
    return readers.text_lines(spark, path).select("line_no", "value")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def one_json_array(spark, sf_dir):
    """A file that is one JSON array; for small tables."""
    path = folder(spark, "array")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    nation.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return readers.json_array(spark, path, nation.schema)


@query("""SELECT r_name AS bucket_id, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS INTEGER) AS place, 'system:You know ' || r_name AS said, n_name AS names, n_nationkey AS keys
 FROM nation JOIN region ON r_regionkey = n_regionkey""")
def keyed_map(spark, sf_dir):
    """A file that is one map of structs with parallel arrays; for small tables."""
    path = folder(spark, "keyed")
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    own = nations.join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    message = F.array(F.struct(F.lit("system").alias("role"), F.concat(F.lit("You know "), F.col("r_name")).alias("content")))
    value = F.struct(message.alias("system_prompt"), F.transform("x", lambda x: x.n_name).alias("names"), F.transform("x", lambda x: x.n_nationkey).alias("keys"))
    own.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("r_name"), value)))).alias("value")).write.text(path)
    keyed = readers.keyed_json(spark, path, "map<string, struct<system_prompt: array<struct<role: string, content: string>>, names: array<string>, keys: array<int>>>")
    first = F.get(readers.as_messages(F.col("system_prompt")), 0)
    return readers.keyed_rows(keyed, ["names", "keys"]).select("bucket_id", "place", F.concat(first.role, F.lit(":"), first.content).alias("said"), "names", "keys")


@query("""SELECT r_name AS task, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS split, CAST(row_number() OVER (PARTITION BY r_name, n_nationkey % 2 ORDER BY n_nationkey) - 1 AS INTEGER) AS row_idx, n_nationkey AS k, n_name AS v
 FROM nation JOIN region ON r_regionkey = n_regionkey""")
def nested_records(spark, sf_dir):
    """A file of tasks, splits and their records; for small tables."""
    path = folder(spark, "nested")
    own = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).withColumn("split", F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd"))
    datas = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))))
    splits = own.groupBy("r_name", "split").agg(F.struct(datas.alias("datas")).alias("body")).groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("split", "body"))).alias("splits"))
    splits.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "splits")))).alias("value")).write.text(path)
    return readers.nested_json(spark, path, "struct<k: int, v: string>")


@query("SELECT n_nationkey, 'Where is ' || n_name || '?' || chr(10) || 'In region ' || n_regionkey AS prompt FROM nation")
def template_file(spark, sf_dir):
    """Prompts by a template from a file."""
    path = folder(spark, "template")
    spark.range(1).select(F.lit("Where is $Q$?\nIn region $DOC$").alias("value")).coalesce(1).write.text(path)
    template = F.lit(readers.prompt_template(spark, path))
    return table(spark, sf_dir, "nation").select("n_nationkey", prompts.choice_prompt(template, {"Q": F.col("n_name"), "DOC": F.col("n_regionkey").cast("string")}).alias("prompt"))


@query(f"""WITH {PAIRS}, t AS (SELECT conv_id, turn, {ANSWER.format("answer")} AS p, {ANSWER.format("question")} AS g FROM pairs),
s AS (SELECT *, CAST(coalesce(list_sum(list_transform(list_intersect(list_distinct(p), list_distinct(g)), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) AS DOUBLE) AS same FROM t)
SELECT conv_id, turn, round(2 * same / greatest(len(p) + len(g), 1), 6) AS score FROM s""")
def streamed_scores(spark, sf_dir):
    """Scores of predictions that arrive as files, until all that is there has been read."""
    inbox, out, state = (folder(spark, x) for x in ("inbox", "scores", "state"))
    pairs = selection.question_answer_pairs(table(spark, sf_dir, "conversations"))
    writers.json_lines(pairs.select("conv_id", "turn", F.col("answer").alias("pred_str"), F.array("question").alias("answers")), inbox)
    stream = scoring.scored(scoring.read(spark, inbox, "conv_id long, turn long, pred_str string, answers array<string>"))
    scoring.write(stream.select("conv_id", "turn", F.round("score", 6).alias("score")), out, state).awaitTermination()
    return spark.read.parquet(out)
