"""Question samples of numbered fact lines, and facts laid into noise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import hash_choice


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Of (file, line_no, value): phrase_num, text, answer and reference_num (null for facts)."""
    number = F.substring_index("value", " ", 1).cast("int")
    rest = F.substring(F.col("value"), F.instr(F.col("value"), " ") + 1, F.char_length("value"))
    parts = F.split(rest, "\t")
    references = F.transform(F.filter(F.split(F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), " "), "[\t ]"), lambda x: x != ""), lambda x: x.cast("int"))
    return lines.select("file", "line_no", number.alias("phrase_num"), F.trim(F.get(parts, 0)).alias("text"), F.get(parts, 1).alias("answer"), F.when(F.size(parts) > 1, references).alias("reference_num"))


def sessions(parsed: DataFrame) -> DataFrame:
    """sample_num: a new sample of its file begins at each line number 1.  A file is a window of its own, so there is no global sort."""
    order = Window.partitionBy("file").orderBy("line_no")
    return parsed.withColumn("sample_num", F.sum((F.col("phrase_num") == 1).cast("int")).over(order) - 1)


def question_facts(numbered: DataFrame) -> DataFrame:
    """One row for each question: file, sample_num, question_num, question, answer, facts (struct phrase_num, text, supports) of its sample before it.

    A running list over the sample's lines; answered lines of the sample are no facts.
    """
    order = Window.partitionBy("file", "sample_num").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    facts = F.collect_list(F.when(F.col("answer").isNull(), F.struct("phrase_num", "text"))).over(order)
    out = numbered.withColumn("_facts", facts).where("answer is not null")
    facts = F.transform("_facts", lambda f: F.struct(f.phrase_num.alias("phrase_num"), f.text.alias("text"), F.array_contains(F.col("reference_num"), f.phrase_num).alias("supports")))
    return out.select("file", "sample_num", F.col("phrase_num").alias("question_num"), F.col("text").alias("question"), "answer", facts.alias("facts"))


def with_few_facts(samples: DataFrame, most: int) -> DataFrame:
    """The question counts as one."""
    return samples.where(F.size("facts") + 1 <= most)


def sentences(docs: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """doc_id, sent_no, tokens of sentences with so many words; without `most` they may be of any length."""
    own = docs.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("sent_no", "sentence"))
    own = own.withColumn("tokens", F.filter(F.split("sentence", r"(?U)\s+"), lambda w: w != "")).where(F.size("tokens") >= least).drop("sentence")
    return own if most is None else own.where(F.size("tokens") <= most)


def greedy_samples(noise: DataFrame, budgets: DataFrame, stream: str = "stream") -> DataFrame:
    """stream, sample_num, part, tokens: each stream's sentences in order fill its samples' budgets one after another.

    The last sentence of a sample is cut and its rest is lost; what follows feeds the next sample.  A stream is one sequential
    fold: streams run side by side.  noise: stream, sent_no, tokens; budgets: stream, sample_num, budget.
    """
    rows = noise.select(stream, F.lit(1).alias("kind"), F.col("sent_no").cast("long").alias("n"), "tokens", F.lit(0).cast("long").alias("budget"))
    rows = rows.unionByName(budgets.select(stream, F.lit(0).alias("kind"), F.col("sample_num").cast("long").alias("n"), F.array().cast("array<string>").alias("tokens"), F.col("budget").cast("long").alias("budget")))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by stream, budgets first: only a stream's open budgets are held.
        now, open_budgets, part = None, [], 0
        for frame in batches:
            out = []
            for name, kind, n, tokens, budget in frame.itertuples(index=False):
                if name != now:
                    now, open_budgets, part = name, [], 0
                if kind == 0:
                    open_budgets.append([n, budget])
                    continue
                while open_budgets and open_budgets[0][1] <= 0:
                    open_budgets.pop(0)
                    part = 0
                if not open_budgets:
                    continue
                taken = list(tokens)[: open_budgets[0][1]]
                out.append((name, open_budgets[0][0], part, taken))
                open_budgets[0][1] -= len(taken)
                part += 1
            yield pd.DataFrame(out, columns=[stream, "sample_num", "part", "tokens"])

    kind = noise.schema[stream].dataType.simpleString()
    return rows.repartition(stream).sortWithinPartitions(stream, "kind", "n").mapInPandas(fold, f"{stream} {kind}, sample_num long, part int, tokens array<string>")


def feasible_places(noise: DataFrame, sizes: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """sample_num, places: parts of the noise before which facts may stand.

    Without bounds any place, the end included; else those whose start lies in the given share of the sample, facts left out.
    sizes: sample_num, sample_size, facts_size.
    """
    order = Window.partitionBy("sample_num").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = noise.withColumn("at", F.coalesce(F.sum(F.size("tokens")).over(order), F.lit(0))).join(sizes, "sample_num")
    if start is None or end is None:
        return at.groupBy("sample_num").agg(F.sequence(F.lit(0), F.count("*").cast("int")).alias("places"))
    inside = (F.col("at") >= F.floor(F.col("sample_size") * start)) & (F.col("at") < F.floor(F.col("sample_size") * end) - F.col("facts_size"))
    return at.groupBy("sample_num").agg(F.array_sort(F.collect_list(F.when(inside, F.col("part").cast("int")))).alias("places"))


def interleaved(noise: DataFrame, facts: DataFrame, places: DataFrame, seed: int = 0) -> DataFrame:
    """sample_num, fact_positions, tokens: facts, in their order, before drawn parts of the noise.

    facts: sample_num, fact_no, tokens.  Draws come from hashes and are sorted, so facts keep their order.  A sample without a
    place for its facts stops the query.
    """
    n = facts.groupBy("sample_num").agg(F.count("*").cast("int").alias("n"))
    checked = F.when(F.size("places") > 0, F.col("places")).otherwise(F.raise_error("no place for facts").cast("array<int>"))
    drawn = F.array_sort(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.get(F.col("places"), F.pmod(F.xxhash64(F.col("sample_num"), i, F.lit(seed)), F.size("places")).cast("int"))))
    chosen = places.withColumn("places", checked).join(n, "sample_num").select("sample_num", drawn.alias("fact_positions"))
    order = Window.partitionBy("sample_num").orderBy("fact_no")
    laid = facts.withColumn("k", F.row_number().over(order) - 1).join(chosen, "sample_num").select("sample_num", F.get("fact_positions", "k").alias("pos"), F.lit(0).alias("kind"), F.col("k").cast("long").alias("ord"), "tokens")
    rows = laid.unionByName(noise.select("sample_num", F.col("part").cast("int").alias("pos"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("ord"), "tokens"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "kind", "ord", "tokens")))
    return rows.groupBy("sample_num").agg(F.flatten(F.transform(ordered, lambda x: x.tokens)).alias("tokens")).join(chosen, "sample_num").select("sample_num", "fact_positions", "tokens")


def drawn_places(places: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement for each sample, sorted."""
    draws = [F.get("places", hash_choice(["sample_num"], F.size("places"), seed + i).cast("int")) for i in range(n)]
    return places.select("sample_num", F.array_sort(F.array(*draws)).alias("fact_positions"))
