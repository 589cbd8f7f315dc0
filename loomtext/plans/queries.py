"""The registered queries of the engine, each over its whole tables, and the same in SQL.

The given tables stand in for the engine's records: conversations for question and answer turns, documents for contexts and
predictions, labels for judgements, events, pages and lineitem for numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import metrics as M
from ..functions import preferences as P
from ..functions import text as T
from ..operators import alignment, facts, packing, perplexity, reports, rows, selection
from . import prompts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"
ANSWER = r"list_filter(string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w not in ('', 'a', 'an', 'the'))"
PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a
 ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
CHUNKS = f"""tokens AS (SELECT doc_id, {WORDS.format("text")} AS t FROM documents),
chunks AS (SELECT doc_id, c.i AS chunk_id, t[c.i * 64 + 1 : c.i * 64 + 64] AS tokens FROM tokens, LATERAL (SELECT unnest(range(CAST(ceil(len(t) / 64) AS BIGINT))) AS i) c)"""
SCORED = f"""WITH {PAIRS}, {CHUNKS}, scored AS (SELECT p.conv_id, p.turn, c.chunk_id, array_to_string(c.tokens, ' ') AS chunk,
 len(list_intersect(list_distinct({WORDS.format("lower(p.question || ' ' || p.answer)")}), list_distinct(list_transform(c.tokens, lambda x: lower(x))))) AS overlap
 FROM pairs p JOIN chunks c ON c.doc_id = p.conv_id),
top AS (SELECT *, rn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC, chunk_id) AS rn FROM scored) WHERE rn <= 6)"""


def _scored(spark, sf_dir):
    pairs = selection.question_answer_pairs(table(spark, sf_dir, "conversations"))
    return selection.overlaps(pairs, selection.context_chunks(table(spark, sf_dir, "documents")))


@query(f"{SCORED} SELECT conv_id, turn, chunk_id, overlap, rn FROM top")
def critical_chunks(spark, sf_dir):
    return selection.top_chunks(_scored(spark, sf_dir)).select("conv_id", "turn", "chunk_id", "overlap", "rn")


@query(f"{SCORED} SELECT conv_id, turn, chunk_id, overlap FROM top QUALIFY min(overlap) OVER (PARTITION BY conv_id, turn) >= 3")
def critical_chunks_with_least(spark, sf_dir):
    return selection.with_least(selection.top_chunks(_scored(spark, sf_dir))).select("conv_id", "turn", "chunk_id", "overlap")


@query(f"{SCORED} SELECT conv_id, turn, chunk_id, overlap FROM top WHERE rn <= 3")
def half_chunks(spark, sf_dir):
    return selection.strategy(selection.top_chunks(_scored(spark, sf_dir)), "half").select("conv_id", "turn", "chunk_id", "overlap")


@query(f"{SCORED} SELECT conv_id, turn, chunk_id, overlap FROM top QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY rn DESC) <= 3")
def wrong_chunks(spark, sf_dir):
    return selection.strategy(selection.top_chunks(_scored(spark, sf_dir)), "wrong").select("conv_id", "turn", "chunk_id", "overlap")


@query(f"{SCORED} SELECT conv_id, turn, md5(string_agg(chunk, ' ' || chr(10) || ' ' ORDER BY chunk_id)) AS digest FROM top GROUP BY conv_id, turn")
def shared_context(spark, sf_dir):
    return selection.shared_context(selection.top_chunks(_scored(spark, sf_dir))).select("conv_id", "turn", F.md5("context").alias("digest"))


@query(f"{SCORED} SELECT conv_id, turn, count(*) AS n, count(*) FILTER (WHERE overlap > 6) AS critical FROM scored GROUP BY conv_id, turn")
def threshold_chunks(spark, sf_dir):
    return selection.classified(_scored(spark, sf_dir)).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.count_if("critical").alias("critical"))


@query(f"WITH {CHUNKS}, n AS (SELECT doc_id, max(chunk_id) + 1 AS n FROM chunks GROUP BY doc_id) SELECT doc_id, chunk_id, len(tokens) AS n_tokens FROM chunks JOIN n USING (doc_id) WHERE chunk_id < 8 OR chunk_id >= n - 8")
def head_tail_chunks(spark, sf_dir):
    return selection.head_tail_chunks(selection.context_chunks(table(spark, sf_dir, "documents"))).select("doc_id", "chunk_id", F.size("tokens").alias("n_tokens"))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def qa_pairs(spark, sf_dir):
    return selection.question_answer_pairs(table(spark, sf_dir, "conversations"))


@query(f"""WITH {PAIRS} SELECT f.conv_id, f.turn, f.question AS combined_question, f.answer AS final_answer, left(f.answer, 20) AS prefix_a, right(f.answer, 20) AS siffix_a
 FROM pairs f WHERE f.turn % 3 <> 0 AND f.turn % 5 <> 0""")
def three_way_alignment(spark, sf_dir):
    pairs = selection.question_answer_pairs(table(spark, sf_dir, "conversations"))
    full = pairs.select("conv_id", "turn", "question", F.col("answer").alias("label"), F.col("answer").alias("predict"))
    half = full.withColumn("predict", F.left("predict", F.lit(20))).withColumn("question", F.when(F.col("turn") % 3 == 0, F.concat("question", F.lit("?"))).otherwise(F.col("question")))
    wrong = full.where(F.col("turn") % 5 != 0).withColumn("predict", F.right("predict", F.lit(20)))
    out = alignment.three_way(full, half, wrong, ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.col("question").alias("combined_question"), F.col("full").alias("final_answer"), F.col("half").alias("prefix_a"), F.col("wrong").alias("siffix_a"))


F1 = f"""WITH {PAIRS}, t AS (SELECT d.lang AS dataset_name, d.n_chars AS length, {ANSWER.format("p.answer")} AS p, {ANSWER.format("p.question")} AS g FROM pairs p JOIN documents d ON d.doc_id = p.conv_id),
s AS (SELECT *, CAST(coalesce(list_sum(list_transform(list_intersect(list_distinct(p), list_distinct(g)), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) AS DOUBLE) AS same FROM t),
f AS (SELECT dataset_name, CASE WHEN length < 4000 THEN '0-4k' WHEN length < 8000 THEN '4-8k' ELSE '8k+' END AS bucket, CASE WHEN same = 0 THEN 0 ELSE 2 * (same / len(p)) * (same / len(g)) / (same / len(p) + same / len(g)) END AS score FROM s),
b AS (SELECT dataset_name, bucket, 100 * avg(score) AS score FROM f GROUP BY 1, 2)"""


@query(f"{F1} SELECT dataset_name, bucket, round(score, 6) AS score FROM b UNION ALL SELECT dataset_name, 'Avg.', round(avg(score), 6) FROM b GROUP BY 1")
def qa_f1_report(spark, sf_dir):
    pairs = selection.question_answer_pairs(table(spark, sf_dir, "conversations"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("lang").alias("dataset_name"), F.col("n_chars").alias("length"))
    scored = pairs.join(docs, "conv_id").withColumn("score", M.best_of(M.qa_f1, F.col("answer"), F.array("question")))
    return reports.with_average(reports.bucket_means(scored, None)).select("dataset_name", "bucket", F.round("score", 6).alias("score"))


@query(f"""WITH {PAIRS}, t AS (SELECT conv_id, turn, array_to_string({ANSWER.format("answer")}, ' ') AS p, array_to_string({ANSWER.format("left(question, 12)")}, ' ') AS a, array_to_string({ANSWER.format("right(answer, 9)")}, ' ') AS b FROM pairs)
 SELECT conv_id, turn, CAST(contains(p, a) OR contains(p, b) AS DOUBLE) AS score FROM t""")
def subspan_match(spark, sf_dir):
    pairs = selection.question_answer_pairs(table(spark, sf_dir, "conversations"))
    golds = F.array(F.left("question", F.lit(12)), F.right("answer", F.lit(9)))
    return pairs.select("conv_id", "turn", M.best_subspan_em(F.col("answer"), golds).alias("score"))


NUMBERS = r"list_filter(regexp_extract_all(url, '(\d+)', 1), lambda x: x <> '')"


@query(f"SELECT page_id, CASE WHEN len({NUMBERS}) = 0 THEN 0 ELSE len(list_filter({NUMBERS}, lambda x: x = CAST(page_id AS VARCHAR))) / len({NUMBERS}) END AS score FROM pages")
def count_scores(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", M.count_score(F.col("url"), F.col("page_id")).alias("score"))


@query(f"SELECT page_id, CASE WHEN page_id % 10 = 0 THEN NULL WHEN len({NUMBERS}) = 0 THEN 0 ELSE len(list_filter({NUMBERS}, lambda x: x = CAST(page_id AS VARCHAR))) / len({NUMBERS}) END AS score FROM pages")
def retrieval_scores(spark, sf_dir):
    gold = F.concat(F.when(F.col("page_id") % 10 == 0, "No ").otherwise("Paragraph "), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", M.retrieval_score(F.col("url"), gold).alias("score"))


CLASSES = ("en", "de", "es", "fr", "n", "e")


@query(f"""WITH t AS (SELECT doc_id, lang, list_filter({list(CLASSES)}, lambda c: contains(text, c) AND NOT (contains(lang, c) AND c <> lang)) AS m FROM documents WHERE lang IS NOT NULL)
 SELECT doc_id, CASE WHEN list_contains(m, lang) THEN 1.0::DOUBLE / len(m) ELSE 0.0::DOUBLE END AS score FROM t""")
def class_scores(spark, sf_dir):
    classes = F.array(*map(F.lit, CLASSES))
    return table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", M.classification_score(F.col("text"), F.col("lang"), classes).alias("score"))


@query(r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS pred FROM documents""")
def choice_answers(spark, sf_dir):
    ends = F.when(F.col("doc_id") % 4 == 0, "(A)").when(F.col("doc_id") % 4 == 1, "B, so (C) is not").when(F.col("doc_id") % 4 == 2, "**(C)**").otherwise("none of (A) to (D)")
    said = F.concat(F.regexp_replace("text", "The correct answer is", ""), F.lit(" The correct answer is "), ends)
    return table(spark, sf_dir, "documents").select("doc_id", T.choice_answer(said).alias("pred"))


JUDGED = """WITH j AS (SELECT d.lang AS dataset_name, l.quality AS judge, CASE WHEN l.toxic = 1 THEN 'easy' ELSE 'hard' END AS difficulty, CASE WHEN d.n_chars < 2000 THEN 'short' WHEN d.n_chars < 8000 THEN 'medium' ELSE 'long' END AS length, d.n_chars
 FROM labels l JOIN documents d USING (doc_id) WHERE d.lang IS NOT NULL)"""


def _judged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang", "n_chars")
    length = F.when(F.col("n_chars") < 2000, "short").when(F.col("n_chars") < 8000, "medium").otherwise("long")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("lang").alias("dataset_name"), (F.col("quality") == 1).alias("judge"), F.when(F.col("toxic") == 1, "easy").otherwise("hard").alias("difficulty"), length.alias("length"), "n_chars")


def _share(condition: str, name: str) -> str:
    return f"round(coalesce(sum(judge) FILTER (WHERE {condition}), 0) / greatest(count(*) FILTER (WHERE {condition}), 1), 6) AS \"{name}\""


@query(f"""{JUDGED} SELECT CASE WHEN grouping(dataset_name) = 1 THEN 'Overall' ELSE dataset_name END AS dataset_name, {_share("difficulty = 'easy'", "easy")}, {_share("difficulty <> 'easy'", "hard")},
 {_share("length = 'short'", "short")}, {_share("length = 'medium'", "medium")}, {_share("true", "all")} FROM j GROUP BY ROLLUP (dataset_name)""")
def choice_accuracy(spark, sf_dir):
    return reports.choice_accuracy(_judged(spark, sf_dir), digits=6)


MATRIX_CELLS = ", ".join(f"CAST(floor(100 * avg(judge) FILTER (WHERE b = '{b}')) AS INTEGER) AS \"{b}\"" for b in reports.BUCKETS)


@query(f"{JUDGED} SELECT dataset_name AS task, {MATRIX_CELLS} FROM (SELECT *, CASE WHEN n_chars < 4000 THEN '0-4k' WHEN n_chars < 8000 THEN '4-8k' ELSE '8k+' END AS b FROM j) GROUP BY 1")
def accuracy_matrix(spark, sf_dir):
    scored = _judged(spark, sf_dir).select(F.col("dataset_name").alias("task"), reports.bucket(F.col("n_chars")).alias("ctx_length"), F.col("judge").alias("correct"))
    return reports.accuracy_matrix(scored, list(reports.BUCKETS))


@query()
def rouge_l(spark, sf_dir):
    pairs = selection.question_answer_pairs(table(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", "turn", M.rouge_l_long()(F.col("answer"), F.col("question")).alias("score"))


@query()
def code_similarity(spark, sf_dir):
    pairs = selection.question_answer_pairs(table(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", "turn", M.code_sim(F.col("answer"), F.col("question")).alias("score"))


TOKENS = f"""tokens AS (SELECT doc_id, w.i AS pos, w.i * 10 AS s, w.i * 10 + len(t[w.i + 1]) AS e, 0.1::DOUBLE + (len(t[w.i + 1]) % 7) * 0.25::DOUBLE AS loss_full, 0.1::DOUBLE + (len(t[w.i + 1]) % 7) * 0.25::DOUBLE + (w.i % 5) AS loss_short
 FROM (SELECT doc_id, {WORDS.format("text")} AS t FROM documents), LATERAL (SELECT unnest(range(len(t))) AS i) w)"""


def _tokens(spark, sf_dir):
    """A token table: places ten apart, losses by length and place."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.words(F.col("text"))).alias("pos", "token"))
    loss = 0.1 + (F.char_length("token") % 7) * 0.25
    return own.select("doc_id", "pos", (F.col("pos") * 10).alias("s"), (F.col("pos") * 10 + F.char_length("token")).alias("e"), loss.alias("loss_full"), (loss + F.col("pos") % 5).alias("loss_short"))


@query(f"""WITH {TOKENS}, d AS (SELECT doc_id, exp(avg(loss_full)) AS ppl, count(*) AS n, exp(avg(loss_full) FILTER (WHERE loss_short - loss_full > 2 AND loss_full < 2)) AS longppl, count(*) FILTER (WHERE loss_short - loss_full > 2 AND loss_full < 2) AS k FROM tokens GROUP BY doc_id)
 SELECT round(sum(longppl * k) / sum(k), 6) AS longppl, round(sum(ppl * n) / sum(n), 6) AS ppl FROM d WHERE longppl IS NOT NULL""")
def weighted_perplexity(spark, sf_dir):
    out = perplexity.corpus_scores(perplexity.document_scores(_tokens(spark, sf_dir)))
    return out.select(F.round("longppl", 6).alias("longppl"), F.round("ppl", 6).alias("ppl"))


@query(f"WITH {TOKENS} SELECT doc_id, CASE WHEN pos >= 32 THEN CAST(floor((pos - 32) / 16) AS BIGINT) END AS win, count(*) AS n, count(*) FILTER (WHERE loss_short - loss_full > 2 AND loss_full < 2) AS n_key FROM tokens GROUP BY 1, 2")
def sliding_windows(spark, sf_dir):
    own = _tokens(spark, sf_dir).groupBy("doc_id", perplexity.window_of(32, 16).alias("win"))
    return own.agg(F.count("*").alias("n"), F.count_if(perplexity.is_key()).alias("n_key"))


@query(f"""WITH {TOKENS}, spans AS (SELECT doc_id, k.i * 70 AS s, k.i * 70 + 35 AS e FROM (SELECT doc_id, max(pos) AS m FROM tokens GROUP BY doc_id), LATERAL (SELECT unnest(range(m // 7 + 1)) AS i) k)
 SELECT t.doc_id, count(*) AS n, count(*) FILTER (WHERE k.doc_id IS NOT NULL) AS n_key FROM tokens t LEFT JOIN spans k ON k.doc_id = t.doc_id AND t.s >= k.s AND t.e <= k.e GROUP BY 1""")
def key_tokens(spark, sf_dir):
    tokens = _tokens(spark, sf_dir).select("doc_id", "pos", "s", "e")
    spans = tokens.where("pos % 7 = 0").select("doc_id", "s", (F.col("s") + 35).alias("e"))
    return perplexity.inside(tokens, spans).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("is_key").alias("n_key"))


@query("""WITH p AS (SELECT user_id, event_id % 97 AS s, event_id % 97 + 1 + event_id % 3 AS e FROM events),
 f AS (SELECT *, CASE WHEN lag(e) OVER w = s THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY user_id ORDER BY s, e)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e) AS island FROM f) SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, island""")
def merged_intervals(spark, sf_dir):
    spans = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 97).alias("s"), (F.col("event_id") % 97 + 1 + F.col("event_id") % 3).alias("e"))
    return perplexity.merged_intervals(spans, "user_id")


@query("""WITH t AS (SELECT doc_id, 5 + doc_id % 50 AS n, 5 + doc_id % 50 + n_chars AS l FROM documents), k AS (SELECT *, CAST(ceil(l / n) AS BIGINT) AS k FROM t)
 SELECT doc_id, md5(array_to_string(list_transform(range(k), lambda i: CAST((i * (l - n)) // greatest(k - 1, 1) AS VARCHAR)), ',')) AS digest FROM k""")
def covering_starts(spark, sf_dir):
    n = 5 + F.col("doc_id") % 50
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(A.covering_starts(n, n + F.col("n_chars")).cast("array<string>"), ",")).alias("digest"))


@query(f"""WITH t AS (SELECT doc_id, range(1, len({WORDS.format("text")}) + 1) AS x FROM documents), c AS (SELECT doc_id, CASE WHEN len(x) <= 15 THEN x ELSE list_concat(x[1:7], x[len(x) - 7 : len(x)]) END AS x FROM t)
 SELECT doc_id, array_to_string(list_concat(x, list_transform(range(20 - len(x)), lambda i: -100)), ',') AS ids FROM c""")
def cut_and_padded(spark, sf_dir):
    ids = F.transform(T.words(F.col("text")), lambda _, i: i + 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(A.pad(A.middle_cut(ids, 15), 20, A.IGNORED).cast("array<string>"), ",").alias("ids"))


@query("""WITH t AS (SELECT doc_id, 1 + doc_id % 9 AS n FROM documents) SELECT doc_id, array_to_string(list_transform(range(n), lambda i: CAST(50 + i * (7750 // n) AS VARCHAR) || '-' || CAST(50 + (i + 1) * (7750 // n) - 1 AS VARCHAR)), ',') AS layout FROM t""")
def chunk_layout(spark, sf_dir):
    layout = A.chunk_layout((1 + F.col("doc_id") % 9).cast("int"), F.lit(8000), F.lit(50), F.lit(200))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(layout, lambda x: F.concat(x.begin.cast("string"), F.lit("-"), x.beacon.cast("string"))), ",").alias("layout"))


@query("""WITH n AS (SELECT *, 'f' || (conv_id % 16) AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS num FROM conversations), s AS (SELECT *, dense_rank() OVER (PARTITION BY file ORDER BY conv_id) - 1 AS sample_num FROM n)
 SELECT file, sample_num, num AS question_num, 'answer ' || turn AS answer, count(*) FILTER (WHERE role <> 'assistant') OVER w AS n_facts, CASE WHEN lag(role) OVER v <> 'assistant' THEN 1 ELSE 0 END AS n_supports
 FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn), v AS (PARTITION BY conv_id ORDER BY turn) QUALIFY role = 'assistant'""")
def fact_samples(spark, sf_dir):
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").withColumn("file", F.concat(F.lit("f"), (F.col("conv_id") % 16).cast("string")))
    num = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    plain = F.regexp_replace("text", r"\s+", " ")
    line = F.concat(F.col("num").cast("string"), F.lit(" "), F.when(F.col("role") == "assistant", F.concat(plain, F.lit("\tanswer "), F.col("turn").cast("string"), F.lit("\t"), (F.col("num") - 1).cast("string"))).otherwise(plain))
    lines = turns.withColumn("num", num).select("file", F.struct("conv_id", "turn").alias("line_no"), line.alias("value"))
    found = facts.question_facts(facts.sessions(facts.parsed_lines(lines)))
    supports = F.size(F.filter("facts", lambda f: f.supports))
    return found.select("file", "sample_num", "question_num", "answer", F.size("facts").alias("n_facts"), supports.alias("n_supports"))


def _noise(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    noise = facts.sentences(docs).select((F.col("doc_id") % 64).alias("stream"), (F.col("doc_id") * 100_000 + F.col("sent_no")).alias("sent_no"), "tokens")
    budgets = table(spark, sf_dir, "conversations").select("conv_id").distinct().select((F.col("conv_id") % 64).alias("stream"), F.col("conv_id").alias("sample_num"), F.lit(120).alias("budget"))
    return facts.greedy_samples(noise, budgets)


@query()
def noise_samples(spark, sf_dir):
    return _noise(spark, sf_dir).select("sample_num", "part", F.array_join("tokens", " ").alias("text"))


@query()
def facts_in_noise(spark, sf_dir):
    noise = _noise(spark, sf_dir).select("sample_num", "part", "tokens")
    own = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("sample_num"), F.col("turn").alias("fact_no"), T.words(F.col("text")).alias("tokens"))
    sizes = own.groupBy("sample_num").agg(F.sum(F.size("tokens")).alias("facts_size")).withColumn("sample_size", F.lit(120) + F.col("facts_size"))
    laid = facts.interleaved(noise, own.join(noise.select("sample_num").distinct(), "sample_num", "left_semi"), facts.feasible_places(noise, sizes))
    return laid.select("sample_num", F.array_join(F.col("fact_positions").cast("array<string>"), ",").alias("fact_positions"), F.array_join("tokens", " ").alias("text"))


def _chat(spark, sf_dir, name):
    own = prompts.messages_of(table(spark, sf_dir, "conversations"))
    return own.select("conv_id", F.md5(prompts.render(F.col("messages"), prompts.by_name(name))).alias("digest"))


@query("SELECT conv_id, md5(string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>', '' ORDER BY turn)) AS digest FROM (SELECT * FROM conversations) GROUP BY conv_id")
def chat_with_headers(spark, sf_dir):
    # This template's system text stands around an empty message, which counts as none.
    return _chat(spark, sf_dir, "llama-3")


@query("SELECT conv_id, md5('<|im_start|>system' || chr(10) || '<|im_end|>' || chr(10) || string_agg(CASE role WHEN 'system' THEN 'system' ELSE '<|im_start|>' || role END || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def chat_markup(spark, sf_dir):
    return _chat(spark, sf_dir, "chatml")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
 SELECT conv_id, md5('[INST] ' || string_agg(CASE WHEN i = 0 THEN text || ' ' WHEN i % 2 = 0 THEN '[INST] ' || text || ' ' ELSE '[/INST] ' || text || ' </s><s>' END, '' ORDER BY i)) AS digest FROM n GROUP BY conv_id""")
def chat_instructions(spark, sf_dir):
    return _chat(spark, sf_dir, "llama-2")


@query("""WITH n AS (SELECT doc_id // 5 AS grp, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) AS i, source, text AS t FROM documents)
 SELECT grp, md5(string_agg('Document [' || i || '](Title: ' || source || ') ' || t, chr(10) ORDER BY i) || chr(10) || chr(10) || 'Question: q' || grp || chr(10) || 'Answer:') AS digest FROM n GROUP BY grp""")
def document_prompts(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("grp"), F.struct("doc_id", F.col("source").alias("title"), "text").alias("d"))
    listed = own.groupBy("grp").agg(F.array_sort(F.collect_list("d")).alias("docs"))
    return listed.select("grp", F.md5(prompts.document_prompt(F.col("docs"), F.concat(F.lit("q"), F.col("grp").cast("string")))).alias("digest"))


@query("""WITH n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))
 SELECT n_regionkey, string_agg(CASE WHEN i = 1 THEN '{' ELSE ' ' END || '"' || n_name || '": "' || n_nationkey || '"' || CASE WHEN i = c THEN '}' ELSE ',' END, chr(10) ORDER BY i) AS pairs FROM n GROUP BY n_regionkey""")
def pair_prompts(spark, sf_dir):
    own = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    pairs = F.transform("x", lambda p: F.struct(p.n_name.alias("k"), p.n_nationkey.cast("string").alias("v")))
    return own.select("n_regionkey", prompts.pairs_text(pairs).alias("pairs"))


@query("""WITH a AS (SELECT source AS dataset_name, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT source AS dataset_name, count(*) AS n FROM documents WHERE source < 'f' OR doc_id % 2 = 0 GROUP BY 1)
 SELECT dataset_name FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.dataset_name = a.dataset_name AND b.n = a.n)""")
def unfinished_sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset_name"))
    return reports.unfinished(docs, docs.where("dataset_name < 'f' or doc_id % 2 = 0"))


@query("""WITH r AS (SELECT -10 * l_discount - 1 AS chosen, (-20 * l_tax - l_quantity / 10) / 2 AS rejected, l_extendedprice / 10000 AS sft FROM lineitem), x AS (SELECT *, 2.0::DOUBLE * ((chosen - rejected) - 0.3::DOUBLE) AS x FROM r),
 l AS (SELECT *, greatest(-x, 0) + ln(1 + exp(-abs(x))) AS sigmoid, greatest(0, 1 - x) AS hinge, 2.0::DOUBLE * chosen AS c, 2.0::DOUBLE * rejected AS j FROM x)
 SELECT round(avg(0.1::DOUBLE * sft + sigmoid), 6) AS avg_loss, round(avg(sigmoid), 6) AS avg_sigmoid, round(avg(hinge), 6) AS avg_hinge, round(avg(c), 6) AS avg_chosen, round(avg(j), 6) AS avg_rejected, round(avg(CASE WHEN c - j > 0 THEN 1.0 ELSE 0.0 END), 6) AS avg_accuracy, round(avg(c - j), 6) AS avg_margin FROM l""")
def preference_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    logps = li.select((-10 * F.col("l_discount") - 1).alias("chosen"), (-20 * F.col("l_tax")).alias("rejected_1"), (-F.col("l_quantity") / 10).alias("rejected_2"), (F.col("l_extendedprice") / 10000).alias("sft"))
    means = alignment.preference_metrics(alignment.losses(logps, 2.0, 0.3, 0.1))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query(f"""WITH t AS (SELECT doc_id, source, len({WORDS.format("text")}) AS size FROM documents) SELECT doc_id, source, CAST(sum(size) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS "end", CAST(sum(size) OVER (PARTITION BY doc_id // 8) AS BIGINT) AS weight_sum FROM t""")
def packed_boundaries(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(T.words(F.col("text"))).alias("size"))
    return packing.group_weights(packing.boundaries(sizes, "source", "doc_id", "size"), 8, "size", "doc_id").select("doc_id", "source", "end", "weight_sum")


LABELS = ("en", "ch", "ab", "qu")


@query(f"""WITH t AS (SELECT doc_id, lang, split_part(split_part(split_part(split_part(lower(text), '.', 1), '<context>', 1), '<example>', 1), 'question', 1) AS o, lower(left(text, 8)) AS q FROM documents WHERE lang IS NOT NULL),
 f AS (SELECT doc_id, lang, list_filter({list(LABELS)}, lambda x: contains(o, x) AND NOT contains(q, x)) AS m FROM t) SELECT doc_id, list_contains(m, lang) AND len(m) = 1 AS correct FROM f""")
def label_matches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    return docs.select("doc_id", M.label_match(F.col("lang"), F.col("text"), F.left("text", F.lit(8)), F.array(*map(F.lit, LABELS))).alias("correct"))


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE len({WORDS.format('text')}) < 500) AS below, max(len({WORDS.format('text')})) AS highest FROM documents")
def length_distribution(spark, sf_dir):
    return rows.length_class(table(spark, sf_dir, "documents"), T.words(F.col("text")), 500).select("n", "below", "highest")


@query("""WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
 SELECT CASE WHEN i < (n // 7) * (7 - n % 7) THEN i // greatest(n // 7, 1) ELSE (7 - n % 7) + (i - (n // 7) * (7 - n % 7)) // (n // 7 + 1) END AS part, count(*) AS n_rows, min(i) AS first, max(i) AS last FROM i GROUP BY 1""")
def near_equal_parts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    n = orders.count()
    indexed = rows.row_index(orders, "o_orderkey")
    return indexed.groupBy(P.near_equal_part(F.col("i"), F.lit(n), 7).alias("part")).agg(F.count("*").alias("n_rows"), F.min("i").alias("first"), F.max("i").alias("last"))


@query("""SELECT doc_id, '[' || doc_id || ', ' || (doc_id + n_chars) || '];[' || n_chars || ', ' || (n_chars + 1) || ']' AS line FROM documents""")
def span_lines(spark, sf_dir):
    line = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(","), (F.col("doc_id") + F.col("n_chars")).cast("string"), F.lit("];[ "), F.col("n_chars").cast("string"), F.lit(", "), (F.col("n_chars") + 1).cast("string"), F.lit("]"))
    return table(spark, sf_dir, "documents").select("doc_id", T.format_spans(T.parse_spans(line)).alias("line"))
