"""Registered queries of single functions, each over its whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import preferences as P
from ..functions import text as T
from ..operators import rows
from .queries import WORDS, query, table

FIRST_SENTENCE = "split_part(split_part(split_part(lower(text), '.', 1), '<context>', 1), '<example>', 1)"


@query(f"""SELECT doc_id, split_part(ltrim(text, chr(10)), chr(10), 1) AS first_line, split_part(text, ' the ', 1) AS up_to, least(CAST(1 AS DOUBLE), CAST(0.01 AS DOUBLE) * len({WORDS.format('text')})) AS penalty,
 len(list_distinct({WORDS.format('lower(text)')})) AS n_terms, contains({FIRST_SENTENCE}, lower(lang)) AS found FROM documents""")
def text_cuts(spark, sf_dir):
    """First line, cut at a stop mark, length penalty, term set and lenient match."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.first_line(text).alias("first_line"), T.cut_at_stop(text, " the ").alias("up_to"), T.length_penalty(text).alias("penalty"),
        F.size(T.term_set(text)).alias("n_terms"), T.lenient_match(F.col("lang"), text).alias("found"),
    )


@query("""SELECT doc_id, lang || '/' || doc_id AS tag, lang AS stem, 'runs-' || lang AS name, CASE WHEN doc_id % 2 = 0 THEN 'e' ELSE lang END AS config,
 'deep_' || CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'no' END AS flags FROM documents""")
def run_names(spark, sf_dir):
    """Run tag, file stem, output name, split of a configuration and name of a set of flags."""
    lang, name = F.col("lang"), F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.run_tag(F.concat(F.lit("runs/x/"), lang, F.lit("/"), name)).alias("tag"), T.file_stem(F.concat(lang, F.lit(".a.jsonl"))).alias("stem"),
        T.output_name(F.lit("runs/x"), F.concat(lang, F.lit(".jsonl"))).alias("name"), T.split_config(F.when(F.col("doc_id") % 2 == 0, F.concat(lang, F.lit("-e"))).otherwise(lang)).alias("config"),
        T.config_name(F.create_map(F.lit("deep"), F.col("doc_id") % 3 == 0, F.lit("template"), F.lit(True))).alias("flags"),
    )


@query("""WITH l AS (SELECT doc_id, string_split(replace(text, '. ', chr(10)), chr(10)) AS l FROM documents)
SELECT doc_id, regexp_replace(array_to_string(l[3:greatest(len(l) - 2, 2)], chr(10)), '^\\s+|\\s+$', '', 'g') AS context, regexp_replace(l[len(l)], '^\\s+|\\s+$', '', 'g') AS question FROM l""")
def context_layouts(spark, sf_dir):
    """Context and question of a text laid out in lines."""
    lines = F.replace(F.col("text"), F.lit(". "), F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", T.split_layout(lines).alias("r")).select("doc_id", F.coalesce("r.context", F.lit("")).alias("context"), "r.question")


LENGTHS = f"list_transform({WORDS.format('text')}, lambda x: length(x))"


def joined(list_: str) -> str:
    return f"array_to_string(list_transform({list_}, lambda x: CAST(x AS VARCHAR)), ' ')"


@query(f"""WITH t AS (SELECT doc_id, {WORDS.format('text')} AS w, {LENGTHS} AS n FROM documents)
SELECT doc_id, {joined('list_concat(n, list_transform(range(greatest(300 - len(n), 0)), lambda x: 0))')} AS ids, {joined('list_concat(list_transform(n, lambda x: 1), list_transform(range(greatest(300 - len(n), 0)), lambda x: 0))')} AS mask,
 {joined('list_concat(list_transform(n, lambda x: -100), n)')} AS labels, {joined('list_filter(n, lambda x, i: i > 1 AND i % 2 = 0)')} AS every_other, {joined('list_transform(n, lambda x: CASE WHEN x = 3 THEN -1 ELSE x END)')} AS replaced,
 CAST(coalesce(list_position(w, 'the'), 0) - 1 AS INTEGER) AS place, CAST(2 * len(n) AS INTEGER) AS total FROM t""")
def token_arrays(spark, sf_dir):
    """Padding with its mask, labels of the answer alone, every other item, replaced items, place of an item, total length."""
    found = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w")).withColumn("n", F.transform("w", F.char_length))
    n, text = F.col("n"), lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return found.withColumn("p", A.pad_with_mask(n, 300)).select(
        "doc_id", text(F.col("p.ids")).alias("ids"), text(F.col("p.mask")).alias("mask"), text(A.masked_labels(n, n)).alias("labels"), text(A.every_other(n, 1)).alias("every_other"),
        text(A.replaced(n, F.lit(3), F.lit(-1))).alias("replaced"), A.place_of(F.col("w"), F.lit("the")).alias("place"), A.total_length(F.array(n, n)).alias("total"),
    )


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(-l_discount - 0.1 AS DOUBLE) AS c, CAST(-l_tax - 0.2 AS DOUBLE) AS r FROM lineitem),
o AS (SELECT *, (c - r) - (ln(1 - exp(c)) - ln(1 - exp(r))) AS odds FROM t)
SELECT l_orderkey, l_linenumber, round(odds, 6) AS odds, round(-0.1 * ln(1 + exp(-odds)), 6) AS loss, round(0.3 * -c - 0.1 * ln(1 + exp(-odds)), 6) AS combined FROM o""")
def preference_odds(spark, sf_dir):
    """Log odds of chosen and rejected, their loss, and the loss beside that of the chosen."""
    chosen, rejected = (-F.col("l_discount") - 0.1).cast("double"), (-F.col("l_tax") - 0.2).cast("double")
    loss = P.odds_loss(chosen, rejected, 0.1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(P.log_odds(chosen, rejected), 6).alias("odds"), F.round(loss, 6).alias("loss"), F.round(P.combined_loss(-chosen, loss, 0.3), 6).alias("combined"))


@query("""WITH i AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT i // greatest((n + 6) // 7, 1) AS ceil_part, i // greatest(n // 7, 1) AS floor_part, count(*) AS n_rows FROM i GROUP BY 1, 2""")
def even_parts(spark, sf_dir):
    """Blocks by the ceiling and by the floor of the mean size."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    n = F.lit(orders.count())
    indexed = rows.row_index(orders, "o_orderkey")
    return indexed.groupBy(P.ceil_part(F.col("i"), n, 7).alias("ceil_part"), P.floor_part(F.col("i"), n, 7).alias("floor_part")).agg(F.count("*").alias("n_rows"))


@query("SELECT lang, count(*) AS n_rows, sum(n_chars) AS chars FROM documents WHERE doc_id % 3 <> 0 AND doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL GROUP BY lang")
def complete_rows(spark, sf_dir):
    """Rows without any null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("other"))
    return rows.complete(docs).groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("chars"))


@query("SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders")
def prefixed_columns(spark, sf_dir):
    """The columns of a prefix, without it."""
    return rows.prefixed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(1).alias("other")), "o_")


@query("SELECT doc_id FROM documents WHERE lower(lang) <> 'long' AND length(text) < 2000")
def short_rows(spark, sf_dir):
    """Rows of short contexts that are not of the long class."""
    return rows.short_enough(table(spark, sf_dir, "documents"), "lang", "text", 2000).select("doc_id")


@query("SELECT lang, quality, count(*) AS n_rows FROM (SELECT doc_id, lang, NULL AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels) GROUP BY lang, quality")
def union_rows(spark, sf_dir):
    """Tables one after another; a column that one lacks is null there."""
    both = rows.union_all(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return both.groupBy("lang", "quality").agg(F.count("*").alias("n_rows"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unlabelled_rows(spark, sf_dir):
    """Rows that are not done yet."""
    return rows.without(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


VERDICTS = ["C, I, y", "I,I,y", "c,i,n", "only one", "a, b, c"]


@query("""SELECT doc_id, CAST([1, 1, 0, -1, 0][doc_id % 5 + 1] AS INTEGER) AS score FROM documents""")
def judge_scores(spark, sf_dir):
    """Score of a judge's first line; five kinds of lines stand in for judgements, the last of no known one."""
    line = F.concat(F.lit("##Judgement: "), F.get(F.array(*map(F.lit, VERDICTS)), (F.col("doc_id") % 5).cast("int")), F.lit("\n"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", P.judgement_score(P.judgement(line)).cast("int").alias("score"))
