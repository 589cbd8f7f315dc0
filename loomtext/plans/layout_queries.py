"""Registered queries of layouts, prompts, reports and message edits, each over its whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import metrics as M
from ..functions import text as T
from ..operators import perplexity, reports, rows, selection
from . import prompts
from .part_queries import LENGTHS, joined
from .queries import PAIRS, WORDS, query, table


def _text(numbers):
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), " ")


def _lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(T.words(F.col("text")), F.char_length).alias("n"))


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{{-~{T.CJK_PUNCTUATION}]', '', 'g'), '\\s+', '', 'g') AS answer,
 (1.0 + CASE WHEN doc_id % 3 = doc_id % 5 THEN 1 ELSE 0 END) / 2 AS score FROM documents""")
def cjk_answers(spark, sf_dir):
    """Answers without punctuation and white space; the share of the numbers that a paragraph's mark names."""
    a, b = (F.col("doc_id") % 3).cast("string"), (F.col("doc_id") % 5).cast("string")
    score = M.retrieval_cjk_score(F.concat(F.lit("段落"), a, F.lit(","), b), F.concat(F.lit("段落"), b))
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_cjk_answer(F.col("text")).alias("answer"), score.alias("score"))


@query(f"""WITH t AS (SELECT doc_id, {LENGTHS} AS n FROM documents)
SELECT doc_id, {joined('list_transform(range(len(n)), lambda i: 10 + CASE WHEN doc_id % 2 = 0 THEN CAST(floor(i * 1999 / greatest(len(n) - 1, 1)) AS BIGINT) ELSE i END)')} AS places,
 {joined('CASE WHEN len(n) > 64 THEN list_transform(range(64, greatest(len(n) - 1, 64) + 1, 65), lambda p: p + 5) ELSE [] END')} AS beacons,
 {joined('list_transform(n[1:20], lambda x, i: 100 + i)')} AS question, {joined('list_transform(range(32 - len(n[1:20])), lambda i: 102 + len(n[1:20]) + i)')} AS answer FROM t""")
def position_layouts(spark, sf_dir):
    """Dense and spread ids of chunks, places of beacons, ids of a question and its answer."""
    n, size = F.col("n"), F.size("n")
    qa = A.qa_positions(F.slice(n, 1, 20), F.lit(100), F.lit(32))
    return _lengths(spark, sf_dir).withColumn("qa", qa).select(
        "doc_id", _text(A.chunk_positions(size, F.lit(10), F.lit(2000), F.col("doc_id") % 2 == 0)).alias("places"), _text(A.beacons(64, size, F.lit(5))).alias("beacons"),
        _text(F.col("qa.question")).alias("question"), _text(F.col("qa.answer")).alias("answer"),
    )


@query(f"""WITH t AS (SELECT doc_id, {LENGTHS} AS n FROM documents), i AS (SELECT doc_id, n, list_concat([1, 2], n[1:3], n[5:6], n[9:12]) AS ids FROM t)
SELECT doc_id, {joined('ids')} AS input_ids, len(ids) AS n_mask, {joined('list_transform(ids, lambda x, i: i + 6)')} AS position_ids,
 {joined('list_concat(list_transform(n[1:4], lambda x: -100), n[1:2])')} AS labels FROM i""")
def assembled_samples(spark, sf_dir):
    """System part, references and question in a row, and the labels of an answer."""
    n, numbers = F.col("n"), lambda *x: F.array(*map(F.lit, x))
    whole = A.assembled(numbers(1, 2), F.array(F.slice(n, 1, 3), F.slice(n, 5, 2)), F.slice(n, 9, 4), F.lit(None).cast("array<int>"))
    found = _lengths(spark, sf_dir).withColumn("s", whole).withColumn("a", A.answer_struct(F.slice(n, 1, 4), F.slice(n, 1, 2), F.lit(None).cast("array<int>")))
    places = F.transform("s.input_ids", lambda x, i: i + 7)
    return found.select("doc_id", _text(F.col("s.input_ids")).alias("input_ids"), F.size("s.attention_mask").cast("long").alias("n_mask"), _text(places).alias("position_ids"), _text(F.col("a.labels")).alias("labels"))


@query(f"""WITH t AS (SELECT doc_id, {LENGTHS} AS n FROM documents), p AS (SELECT doc_id, len(n) AS n, list_filter(range(len(n)), lambda i: n[i + 1] = 13) AS hits FROM t)
SELECT doc_id, {joined('CASE WHEN len(hits) > 0 THEN range(list_min(hits), list_max(hits) + 1) ELSE range(greatest(n - 3, 0), n) END')} AS places FROM p""")
def differing_places(spark, sf_dir):
    """From the first to the last place where three versions differ; the last three places if none does."""
    changed = lambda n: A.replaced(n, F.lit(13), F.lit(-1))
    return _lengths(spark, sf_dir).select("doc_id", _text(T.once(lambda a, b: A.first_differences(a, b, a, 3), F.col("n"), changed(F.col("n")))).alias("places"))


@query("""WITH r AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names, list(n_nationkey % 4 = 1 ORDER BY n_nationkey) AS g FROM nation GROUP BY 1),
s AS (SELECT *, list_filter(names, lambda x, i: g[i]) AS gold, list_filter(names, lambda x, i: NOT g[i]) AS others FROM r)
SELECT n_regionkey, array_to_string(CASE WHEN len(gold) > 0 THEN list_concat(others[1:2], gold[1:1], others[3:]) ELSE names END, ',') AS moved, array_to_string(gold[1:1], ',') AS gold,
 len(names) >= 2 AND list_contains(names, 'CHINA') AND len(list_distinct(names)) = len(names) AS valid FROM s""")
def gold_documents(spark, sf_dir):
    """The gold document at a given place, the gold one alone, and whether pairs hold a key."""
    own = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    documents = F.transform("x", lambda d: F.struct(d.n_name.alias("title"), (d.n_nationkey % 4 == 1).alias("isgold")))
    pairs = F.transform("x", lambda d: F.struct(d.n_name.alias("k"), d.n_nationkey.alias("v")))
    titles = lambda a: F.array_join(F.transform(a, lambda d: d.title), ",")
    return own.withColumn("d", documents).select("n_regionkey", titles(A.gold_at(F.col("d"), 2)).alias("moved"), titles(A.only_gold(F.col("d"))).alias("gold"), A.valid_pairs(pairs, F.lit("CHINA")).alias("valid"))


@query("""SELECT o_orderkey, a, b FROM orders, (VALUES (1), (2)) x(a), LATERAL (SELECT unnest([CAST(o_custkey % 7 AS INTEGER), CAST(o_custkey % 7 + 1 AS INTEGER)]) AS b) y""")
def candidate_combinations(spark, sf_dir):
    """All combinations of candidates, a row each."""
    lists = F.array(F.array(F.lit(1), F.lit(2)), F.array((F.col("o_custkey") % 7).cast("int"), (F.col("o_custkey") % 7 + 1).cast("int")))
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(A.combinations(lists)).alias("c"))
    return found.select("o_orderkey", F.get("c", 0).alias("a"), F.get("c", 1).alias("b"))


NAMES = [n for own in reports.REPORT.values() for n in own]
_CELL = "coalesce(max(score) FILTER (WHERE dataset_name = '{}'), CAST(0 AS DOUBLE))".format
_MEAN = lambda own: "round((" + " + ".join(map(_CELL, own)) + f") / {len(own)}, 6)"
_DEALT = f"""s AS (SELECT {NAMES}[doc_id % {len(NAMES)} + 1] AS dataset_name, CAST(doc_id % 10 AS DOUBLE) / 10 AS score, CASE WHEN n_chars < 4000 THEN '0-4k' WHEN n_chars < 8000 THEN '4-8k' ELSE '8k+' END AS bucket FROM documents)"""


def _dealt(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES)).cast("int"))
    return table(spark, sf_dir, "documents").select(name.alias("dataset_name"), ((F.col("doc_id") % 10).cast("double") / 10).alias("score"), F.col("n_chars").alias("length"), "doc_id")


@query(f"WITH {_DEALT}, b AS (SELECT dataset_name, bucket, 100 * avg(score) AS score FROM s GROUP BY 1, 2) SELECT bucket, " + ", ".join([f'round({_CELL(n)}, 6) AS "{n}"' for n in NAMES] + [f'{_MEAN(own)} AS "{g} Avg."' for g, own in reports.REPORT.items()] + [f'{_MEAN(NAMES)} AS "ALL Avg."']) + " FROM b GROUP BY bucket")
def wide_reports(spark, sf_dir):
    """A column for each data set and each group's average."""
    wide = reports.wide_report(reports.bucket_means(_dealt(spark, sf_dir), None))
    return wide.select("bucket", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in wide.columns if c != "bucket"])


@query(f"WITH {_DEALT} SELECT dataset_name, round_even(100 * avg(score), 2) AS score FROM s GROUP BY 1")
def data_set_means(spark, sf_dir):
    return reports.mean_scores(_dealt(spark, sf_dir))


@query("SELECT round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels")
def metric_means(spark, sf_dir):
    return reports.metric_means(table(spark, sf_dir, "labels"), ["quality", "toxic"]).select(F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


@query("""WITH m AS (SELECT o_orderstatus AS task, o_orderpriority AS ctx_length, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'P' GROUP BY 1, 2)
SELECT t.task, l.ctx_length, m.n FROM (SELECT DISTINCT o_orderstatus AS task FROM orders) t CROSS JOIN (SELECT DISTINCT o_orderpriority AS ctx_length FROM orders) l LEFT JOIN m USING (task, ctx_length)""")
def completed_grid(spark, sf_dir):
    """Every pair of task and length, with its count or null."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("task"), F.col("o_orderpriority").alias("ctx_length"))
    means = orders.where("o_orderkey % 3 = 0 and task <> 'P'").groupBy("task", "ctx_length").agg(F.count("*").alias("n"))
    return reports.full_grid(means, orders.select("task").distinct(), orders.select("ctx_length").distinct())


@query("SELECT conv_id, turn, role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations")
def next_tokens(spark, sf_dir):
    """The token that each place predicts; here the turn that follows."""
    tokens = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("token"))
    return perplexity.shifted(tokens).select(F.col("doc_id").alias("conv_id"), F.col("pos").alias("turn"), "role", "target")


@query("""WITH l AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(role || ':' || text ORDER BY turn) AS m, list(role || ':' || text ORDER BY turn) FILTER (WHERE role <> 'system') AS s FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(list_concat(r, ['user', 'assistant']), ',') AS waiting, array_to_string(list_concat(m[:-2], [r[-1] || ':done']), '|') AS finished,
 array_to_string(list_concat(['system:be brief'], coalesce(s, [])), '|') AS briefed, array_to_string(coalesce(s, []), '|') AS exported FROM l""")
def edited_messages(spark, sf_dir):
    """Messages with a waiting answer, another last content, another system message, and as exported."""
    said = lambda m: F.array_join(F.transform(m, lambda x: F.concat(x.role, F.lit(":"), x.content)), "|")
    own = F.col("messages")
    waiting = prompts.awaiting_answer(prompts.appended(own, "user", F.lit("and?")))
    return prompts.messages_of(table(spark, sf_dir, "conversations")).select(
        "conv_id", F.array_join(F.transform(waiting, lambda x: x.role), ",").alias("waiting"), said(prompts.with_last(own, F.lit("done"))).alias("finished"),
        said(prompts.with_system(own, F.lit("be brief"))).alias("briefed"), said(prompts.exported(prompts.with_system(own, F.lit("")))).alias("exported"),
    )


_STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')".format


@query(f"""WITH {PAIRS} SELECT conv_id, turn, question || ' </s>' || answer || '</s>' AS bare, 'Question: ' || question || chr(10) || 'Answer:' AS closed, replace('Question: ' || question || chr(10) || 'Answer:', 'Question', 'Statement') AS stated,
 {_STRIPPED("'Do.' || chr(10) || chr(10) || 'E' || chr(10) || chr(10) || 'P' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || '<context>' || chr(10) || " + _STRIPPED('answer') + " || chr(10) || '</context>'")} AS formatted,
 replace(replace('$DOC$ - $Q$', '$DOC$', {_STRIPPED('answer')}), '$Q$', {_STRIPPED('question')}) AS choice, 'system:be brief|user:' || question || '|assistant:call|user:' || answer AS request FROM pairs""")
def pair_prompts_of_turns(spark, sf_dir):
    """Prompts of question and answer: bare, closed book, as a statement, formatted, as a choice, as a tool request."""
    q, a = F.col("question"), F.col("answer")
    closed = prompts.closed_book_prompt(q)
    request = prompts.request(F.lit("be brief"), q, F.lit("call"), a)
    return selection.question_answer_pairs(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", prompts.bare_pair(q, a, "</s>").alias("bare"), closed.alias("closed"), prompts.statements(closed).alias("stated"),
        prompts.formatted_input(F.lit("Do."), F.lit("E"), F.lit("P"), a, q).alias("formatted"), prompts.choice_prompt(F.lit("$DOC$ - $Q$"), {"DOC": a, "Q": q}).alias("choice"),
        F.array_join(F.transform(request, lambda m: F.concat(m.role, F.lit(":"), m.content)), "|").alias("request"),
    )


@query(f"""WITH t AS (SELECT conv_id, turn, role, {LENGTHS} AS n FROM conversations)
SELECT conv_id, {joined("flatten(list(CASE WHEN role = 'assistant' THEN n ELSE list_transform(n, lambda x: -100) END ORDER BY turn))")} AS labels FROM t GROUP BY conv_id""")
def turn_labels(spark, sf_dir):
    """Labels of a conversation: the assistant's turns alone count."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("is_answer"), F.transform(T.words(F.col("text")), F.char_length).alias("ids"))
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "is_answer", "ids"))).alias("turns"))
    return own.select("conv_id", _text(prompts.masked_turns(F.col("turns"))).alias("labels"))


_MULTI = "CAST(coalesce(list_sum(list_transform(list_intersect(list_distinct(a), list_distinct(b)), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS DOUBLE)"


@query(f"""WITH {PAIRS}, t AS (SELECT conv_id, turn, answer, {WORDS.format('lower(answer)')} AS a, {WORDS.format('lower(question)')} AS b FROM pairs),
r AS (SELECT *, 100 * {_MULTI} / greatest(len(b), 1) AS recall FROM t)
SELECT conv_id, turn, round(recall, 6) AS recall, round(recall - (CAST(contains(lower(answer), 'the') AS INTEGER) + CAST(contains(lower(answer), 'qq') AS INTEGER)) * 100.0::DOUBLE / 3, 6) AS score FROM r""")
def recall_scores(spark, sf_dir):
    """Unigram recall, and less for each forbidden term."""
    found = M.recall_score(F.col("answer"), F.col("question"), F.array(F.lit("The"), F.lit("qq")))
    return selection.question_answer_pairs(table(spark, sf_dir, "conversations")).withColumn("r", found).select("conv_id", "turn", F.round("r.recall", 6).alias("recall"), F.round("r.score", 6).alias("score"))


TASKS = [("en", "Read.", "Text: {context}", "Who is {input}?"), ("de", "Lies.", "{context}", "Wer ist {input}?"), ("fr", "Lis.", "<{context}>", "Qui est {input}?")]


@query("""SELECT doc_id, s || chr(10) || chr(10) || replace(replace(c, '{context}', text), '{input}', source) || chr(10) || chr(10) || replace(replace(u, '{context}', text), '{input}', source) AS prompt
 FROM documents JOIN (VALUES """ + ", ".join(map(str, TASKS)) + """) v(lang, s, c, u) USING (lang)""")
def task_prompts(spark, sf_dir):
    """Prompts by the templates of each row's data set; rows of a data set without one are left out."""
    templates = spark.createDataFrame(TASKS, "dataset_name string, system_prompt string, context_template string, user_template string")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset_name"), F.col("text").alias("context"), F.col("source").alias("input"))
    return prompts.task_prompt(docs, templates).select("doc_id", "prompt")


@query(f"""WITH t AS (SELECT doc_id, {NAMES}[doc_id % {len(NAMES)} + 1] AS name FROM documents), m AS (SELECT * FROM (VALUES {", ".join(map(str, M.METRIC_OF.items()))}) v(name, metric))
SELECT doc_id, metric, CASE WHEN metric = 'count' OR metric = 'retrieval' THEN (1.0 + CAST(doc_id % 3 = doc_id % 5 AS INTEGER)) / 2 ELSE 0.0 END AS score FROM t JOIN m USING (name) WHERE metric IN ('count', 'retrieval', 'classification')""")
def dispatched_scores(spark, sf_dir):
    """The metric that each data set's name asks for; of those that SQL expresses."""
    metric_of = spark.createDataFrame(list(M.METRIC_OF.items()), "dataset_name string, metric string")
    a, b = (F.col("doc_id") % 3).cast("string"), (F.col("doc_id") % 5).cast("string")
    own = _dealt(spark, sf_dir).join(metric_of, "dataset_name").where(F.col("metric").isin("count", "retrieval", "classification"))
    own = own.withColumn("gold", F.when(F.col("metric") == "retrieval", F.concat(F.lit("Paragraph "), b)).otherwise(b))
    score = M.by_metric(F.col("metric"), F.concat(a, F.lit(" "), b), F.col("gold"), F.array(F.lit("x"), F.lit("y")))
    return own.select("doc_id", "metric", score.alias("score"))


@query("SELECT i, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_orderkey >= 0) WHERE i < 500")
def checked_first_rows(spark, sf_dir):
    """The first rows by a persisted index (the limit is the operator), after a check that every row passes."""
    kept = rows.required(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey") >= 0, "negative key")
    return rows.first_rows(rows.row_index(kept, "o_orderkey"), 500, "i").select("i", "o_orderkey")
