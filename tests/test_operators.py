import json
import random

import numpy as np
import pytest
from loomtext.operators import alignment, facts, packing, perplexity, reports, rows, selection
from loomtext.plans import client, prompts
from loomtext.sources import readers, schemas, writers
from loomtext.streaming import scoring
from pyspark.sql import functions as F


def test_fact_samples(spark, tmp_path):
    text = "1 Mary moved to the bathroom.\n2 John went to the hallway.\n3 Where is Mary? \tbathroom\t1\n4 Daniel went back to the hallway.\n5 Where is Daniel? \thallway\t4 2\n1 A b.\n2 Q? \tx\t1\n"
    (tmp_path / "a.txt").write_text(text)
    got = facts.question_facts(facts.sessions(facts.parsed_lines(readers.text_lines(spark, str(tmp_path)))))
    found = sorted((r.sample_num, r.question_num, r.question, r.answer, [(f.phrase_num, f.supports) for f in r.facts]) for r in got.collect())
    assert found == [(0, 3, "Where is Mary?", "bathroom", [(1, True), (2, False)]), (0, 5, "Where is Daniel?", "hallway", [(1, False), (2, True), (4, True)]), (1, 2, "Q?", "x", [(1, True)])]
    assert facts.with_few_facts(got, 3).count() == 2


def test_noise_fold_and_interleaving(spark):
    rng = random.Random(3)
    noise = [(s, n, [f"{s}.{n}.{k}" for k in range(rng.randint(1, 9))]) for s in range(3) for n in range(40)]
    budgets = [(s, 10 * s + k, rng.randint(0, 30)) for s in range(3) for k in range(4)] + [(9, 99, 5)]
    expected = {}
    for s in range(3):
        line = [t for a, _, t in noise if a == s]
        for _, k, b in [x for x in budgets if x[0] == s]:
            own = []
            while b > 0 and line:
                t = line.pop(0)[:b]
                own.append(t)
                b -= len(t)
            expected[k] = own
    made = facts.greedy_samples(spark.createDataFrame(noise, "stream long, sent_no long, tokens array<string>"), spark.createDataFrame(budgets, "stream long, sample_num long, budget int"))
    got = {}
    for r in made.orderBy("sample_num", "part").collect():
        got.setdefault(r.sample_num, []).append(r.tokens)
    assert got == {k: v for k, v in expected.items() if v}
    own = spark.createDataFrame([(k, i, [f"F{i}"]) for k in got for i in range(3)], "sample_num long, fact_no int, tokens array<string>")
    sizes = spark.createDataFrame([(k, 40, 3) for k in got], "sample_num long, sample_size int, facts_size int")
    places = facts.feasible_places(made, sizes)
    for r in facts.interleaved(made, own, places).collect():
        assert [t for t in r.tokens if t[0] == "F"] == ["F0", "F1", "F2"] and [t for t in r.tokens if t[0] != "F"] == [t for x in got[r.sample_num] for t in x]
        assert r.fact_positions == sorted(r.fact_positions)
    some = facts.feasible_places(made, sizes, 0.1, 0.5).collect()
    for r in some:
        starts = np.cumsum([0, *map(len, got[r.sample_num])])[:-1]
        assert r.places == [i for i, a in enumerate(starts) if 4 <= a < 20 - 3]
    with pytest.raises(Exception, match="no place"):
        facts.interleaved(made, own, places.withColumn("places", F.array().cast("array<int>"))).collect()
    assert all(len(r.fact_positions) == 4 for r in facts.drawn_places(places, 4).collect())


def test_intervals_and_perplexity(spark):
    spans = spark.createDataFrame([(1, *x) for x in [(0, 3), (3, 5), (7, 9), (9, 12), (13, 14)]], schemas.KEY_SPANS)
    assert sorted((r.s, r.e) for r in perplexity.merged_intervals(spans).collect()) == [(0, 5), (7, 12), (13, 14)]
    rng = random.Random(2)
    spans = [(d, a, a + rng.randint(0, 9)) for d in (1, 2) for a in rng.sample(range(60), 8)]
    tokens = [(d, p, a, a + rng.randint(0, 4)) for d in (1, 2, 3) for p, a in enumerate(rng.sample(range(60), 25))]
    got = perplexity.inside(spark.createDataFrame(tokens, "doc_id long, pos int, s long, e long"), spark.createDataFrame(spans, schemas.KEY_SPANS))
    assert {(r.doc_id, r.pos, r.is_key) for r in got.collect()} == {(d, p, any(d == x and a >= s and b <= e for x, s, e in spans)) for d, p, a, b in tokens}
    rows_ = spark.createDataFrame([(1, 0, 0, 1, 1.0, 4.0), (1, 1, 1, 2, 3.0, 9.0), (2, 0, 0, 1, 1.0, 1.0)], schemas.TOKENS)
    scores = {r.doc_id: r for r in perplexity.document_scores(rows_).collect()}
    assert scores[1].longppl == pytest.approx(np.exp(1)) and scores[1].ppl == pytest.approx(np.exp(2)) and scores[2].longppl is None
    assert perplexity.corpus_scores(perplexity.document_scores(rows_)).first().ppl == pytest.approx(np.exp(2))
    shifted = perplexity.shifted(rows_.withColumn("token", F.col("pos"))).where("doc_id = 1").orderBy("pos").collect()
    assert [r.target for r in shifted] == [1, None]


def test_reports(spark, tmp_path):
    scored = spark.createDataFrame([("qasper_e", 10, 0.5), ("qasper_e", 5000, 0.25), ("qasper_e", 5001, 0.5), ("hotpotqa_e", 9000, 1.0)], "dataset_name string, length long, score double")
    means = reports.bucket_means(scored)
    got = {(r.dataset_name, r.bucket): r.score for r in reports.with_average(means).collect()}
    assert got == {("qasper_e", "0-4k"): 50.0, ("qasper_e", "4-8k"): 37.5, ("hotpotqa_e", "8k+"): 100.0, ("qasper_e", "Avg."): 43.75, ("hotpotqa_e", "Avg."): 100.0}
    wide = {r.bucket: r.asDict() for r in reports.wide_report(means).collect()}
    assert wide["0-4k"]["qasper_e"] == 50.0 and wide["0-4k"]["Single-Document QA Avg."] == 25.0 and wide["0-4k"]["musique"] == 0.0 and len(wide["0-4k"]) == 22
    assert reports.wide_report(means, strict=True).first()["ALL Avg."] == 0.0
    judged = spark.createDataFrame([("a", True, "easy", "short"), ("a", False, "hard", "short"), ("b", True, "hard", "medium")], "dataset_name string, judge boolean, difficulty string, length string")
    table = {r.dataset_name: tuple(r)[1:] for r in reports.choice_accuracy(judged).collect()}
    assert table == {"a": (1.0, 0.0, 0.5, 0.0, 0.5), "b": (0.0, 1.0, 0.0, 1.0, 1.0), "Overall": (1.0, 0.5, 0.5, 1.0, 0.67)}
    matrix = reports.accuracy_matrix(spark.createDataFrame([("t", "4k", True), ("t", "4k", True), ("t", "4k", False)], "task string, ctx_length string, correct boolean"), ["4k", "8k"]).first()
    assert (matrix["4k"], matrix["8k"]) == (66, None)
    grid = reports.full_grid(spark.createDataFrame([("t", "4k", 1.0)], "task string, ctx_length string, v double"), spark.createDataFrame([("t",), ("u",)], "task string"), spark.createDataFrame([("4k",), ("8k",)], "ctx_length string"))
    assert grid.count() == 4
    assert [r[0] for r in reports.unfinished(scored, scored.where("length <> 10")).collect()] == ["qasper_e"]
    writers.report_csv(reports.with_average(means), f"{tmp_path}/r", "bucket")
    assert readers.csv_table(spark, f"{tmp_path}/r").columns == ["bucket", "dataset_name", "score"]


def test_given_results(spark):
    """Sums over 15 + 6 + 20 judged rows in the proportions of a known report."""
    kinds = [("easy", "short", 2, 7), ("hard", "short", 3, 5), ("hard", "medium", 1, 3)]
    judged = [("Code", i < right, d, n) for d, n, right, of in kinds for i in range(of)]
    got = reports.choice_accuracy(spark.createDataFrame(judged, "dataset_name string, judge boolean, difficulty string, length string")).where("dataset_name = 'Code'").first()
    assert got.easy == 0.29 and got.hard == 0.5 and got["all"] == 0.4


def test_selection(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "alpha beta"), (1, 2, "assistant", "gamma"), (1, 3, "user", "x"), (2, 0, "assistant", "y")], "conv_id long, turn long, role string, text string")
    pairs = selection.question_answer_pairs(turns)
    assert [tuple(r) for r in pairs.collect()] == [(1, 1, "alpha beta", "gamma")]
    docs = spark.createDataFrame([(1, "alpha beta x gamma Beta y z alpha"), (2, ""), (3, None)], "doc_id long, text string")
    scored = selection.overlaps(pairs, selection.context_chunks(docs, 2))
    assert sorted((r.chunk_id, r.overlap) for r in scored.collect()) == [(0, 2), (1, 1), (2, 1), (3, 1)]
    top = selection.top_chunks(scored, 3)
    assert sorted((r.rn, r.chunk_id) for r in top.collect()) == [(1, 0), (2, 1), (3, 2)]
    assert selection.with_least(top, 2).count() == 0 and selection.with_least(top, 1).count() == 3
    assert selection.shared_context(selection.strategy(top, "half", 2)).first().context == "alpha beta \n x gamma"
    assert sorted(r.chunk_id for r in selection.strategy(top, "wrong", 1).collect()) == [2]
    assert selection.classified(scored, 1).where("critical").count() == 1 and selection.classified(scored, None, 2).where("critical").count() == 2
    nested = spark.createDataFrame([(["c", "s", "q1", "a1", "q2", "a2", "q3"],)], "conversations array<string>")
    assert [tuple(r.pair) for r in selection.pairs_of_array(nested).collect()] == [("q1", "a1"), ("q2", "a2")]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_alignment(spark):
    make = lambda p, qs: spark.createDataFrame([(i, q, p + q, "l", ["c"]) for i, q in qs], "row_idx long, question string, predict string, label string, context_lst array<string>")
    out = alignment.preference_rows(alignment.three_way(make("f", [(0, "a"), (1, "b"), (2, "c")]), make("h", [(0, "a"), (1, "x")]), make("w", [(0, "a"), (1, "b"), (2, "c")]))).collect()
    assert [tuple(r) for r in out] == [(["c"], "a", "fa", "l", "ha", "wa")]


def test_sources_and_sinks(spark, tmp_path):
    at = str(tmp_path)
    (tmp_path / "a.json").write_text(json.dumps([{"dataset_name": "d", "row_idx": 1, "conversations": [{"role": "user", "content": "x"}]}]))
    assert readers.json_array(spark, f"{at}/a.json", schemas.CONVERSATIONS).first().conversations[0].content == "x"
    writers.json_lines(spark.createDataFrame([("d", "p", ["g"], 5)], schemas.PREDICTION), f"{at}/lines", "gzip")
    assert readers.json_lines(spark, f"{at}/lines", schemas.PREDICTION).first().answers == ["g"]
    (tmp_path / "set").mkdir()
    (tmp_path / "set/musique.x.jsonl").write_text('{"pred_str": "p", "length": 3, "output": "extra"}\n')
    (tmp_path / "set/other.txt").write_text("no")
    assert [(r.dataset_name, r.answers) for r in readers.folder(spark, f"{at}/set", schemas.PREDICTION).collect()] == [("musique", None)]
    (tmp_path / "k.json").write_text(json.dumps({"b1": {"system_prompt": "be", "query": ["q1", "q2"]}, "b2": {"system_prompt": [{"role": "system", "content": "c"}], "query": ["q3"]}}))
    keyed = readers.keyed_rows(readers.keyed_json(spark, f"{at}/k.json", schemas.KEYED), ["query", "user_second_query"])
    found = keyed.select("bucket_id", "place", "query", readers.as_messages(F.col("system_prompt")).alias("m")).orderBy("bucket_id", "place").collect()
    assert [(r.bucket_id, r.query, r.m[0].content) for r in found] == [("b1", "q1", "be"), ("b1", "q2", "be"), ("b2", "q3", "c")]
    (tmp_path / "n.json").write_text(json.dumps({"qa1": {"test": {"datas": [{"x": 1}, {"x": 2}]}}}))
    assert [(r.task, r.split, r.row_idx, r.x) for r in readers.nested_json(spark, f"{at}/n.json", "struct<x: int>").collect()] == [("qa1", "test", 0, 1), ("qa1", "test", 1, 2)]
    (tmp_path / "s.txt").write_text("[0, 5];[7, 12]\n[1, 1]\n")
    spans = readers.span_text(spark, f"{at}/s.txt")
    assert [tuple(s) for s in spans.first().spans] == [(0, 5), (7, 12)]
    writers.span_text(spans, f"{at}/spans")
    assert spark.read.text(f"{at}/spans").first()[0] == "[0, 5];[7, 12]"
    np.save(tmp_path / "x.npy", np.arange(10).reshape(5, 2))
    assert sorted((r.row_idx, r["values"]) for r in readers.npy(spark, f"{at}/x.npy", 2).collect())[4] == (4, [8.0, 9.0])
    df = spark.createDataFrame([(1, "a", "s1"), (2, "b", "s2")], "row_idx long, config string, split string")
    writers.parquet(df, f"{at}/p", ["config", "split"])
    assert readers.partitioned(spark, f"{at}/p", "a").count() == 1 and readers.head(df, 2).count() == 1
    writers.grouped_csv(df, f"{at}/g", ["config"], {"k": 1})
    assert json.loads(spark.read.json(f"{at}/g/config").first().config) == {"k": 1}
    writers.enriched(df, {"len": F.char_length("config")}, f"{at}/e")
    assert spark.read.json(f"{at}/e").first().metric_len == 1
    (tmp_path / "t.prompt").write_text("Q {q}\n\n")
    assert readers.prompt_template(spark, f"{at}/t.prompt") == "Q {q}"


def test_prompts(spark):
    kind = "messages array<struct<role: string, content: string>>"
    talk = spark.createDataFrame([([("user", "hi"), ("assistant", "yo"), ("user", "go")],)], kind)
    v = lambda c: talk.select(c.alias("v")).first().v
    m, named = F.col("messages"), prompts.by_name
    assert v(prompts.render(prompts.awaiting_answer(m), named("llama3"))) == "".join(f"<|start_header_id|>{r}<|end_header_id|>\n\n{c}" for r, c in [("user", "hi<|eot_id|>"), ("assistant", "yo<|eot_id|>"), ("user", "go<|eot_id|>"), ("assistant", "")])
    assert v(prompts.render(m, named("llama2"), "sys")) == "[INST] <<SYS>>\nsys\n<</SYS>>\n\nhi [/INST] yo </s><s>[INST] go "
    assert v(prompts.render(m, named("llama2"))) == "[INST] hi [/INST] yo </s><s>[INST] go "
    assert v(prompts.render(m, named("chatml"), "s")) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\ngo<|im_end|>\n"
    base = {"name": "t", "system_template": "{system_message}", "system_message": "S", "user": "U", "assistant": "A", "sep": "|", "sep2": "#"}
    want = {
        "ADD_COLON_SINGLE": "S|U: hi|A: yo|U: go|A:", "ADD_COLON_TWO": "S|U: hi|A: yo#U: go|A:", "ADD_COLON_SPACE_SINGLE": "S|U: hi|A: yo|U: go|A: ", "NO_COLON_SINGLE": "SUhi|Ayo|Ugo|A", "NO_COLON_TWO": "SUhi|Ayo#Ugo|A",
        "ADD_NEW_LINE_SINGLE": "S|U\nhi|A\nyo|U\ngo|A\n", "CHATGLM": "S|[Round 0]|U：hi|A：yo|[Round 1]|U：go|A：", "CHATINTERN": "S<s>U:hi|\nA:yo#\n<s>U:go|\nA:", "DOLLY": "SU:\nhi|A:\nyo#\n\nU:\ngo|A:\n",
        "RWKV": "SU: hi\n\nA: yo\n\nU: go\n\nA:", "PHOENIX": "SU: <s>hi</s>A: <s>yo</s>U: <s>go</s>A: <s>", "ROBIN": "S|U:\nhi|A:\nyo|U:\ngo|A:\n", "FALCON_CHAT": "S|U: hi|A: yo|U: go|A:", "CHATGLM3": "SU\nhiA\nyoU\ngoA",
        "DEEPSEEK_CHAT": "SU: hi|A: yo#U: go|A:", "METAMATH": "S|U:\nhi|A: #yoU:\ngo|A: #", "YUAN2": "S#hi<n>yo<n>go|", "GEMMA": "<bos><start_of_turn>U\nhi|<start_of_turn>A\nyo|<start_of_turn>U\ngo|<start_of_turn>A\n", "CLLM": "S|U: go|A:", "DEFAULT": "S\nU: hi\nA: yo\nU: go\nA:",
    }
    for style, text in want.items():
        assert v(prompts.render(prompts.awaiting_answer(m), {**base, "style": style})) == text, style
    assert len(prompts.FRAMES) == 23
    with pytest.raises(Exception, match="twice"):
        v(prompts.alternating(F.concat(m, F.slice(m, 3, 1))))
    assert v(prompts.exported(prompts.with_system(m, F.lit(""))))[0].role == "user" and v(prompts.with_last(m, F.lit("z")))[2].content == "z" and len(v(prompts.appended(m, "assistant", F.lit("k")))) == 4
    assert v(prompts.bare_pair(F.lit("q"), F.lit("a"), "</s>")) == "q </s>a</s>"
    turns = F.from_json(F.lit('[{"is_answer":false,"ids":[1,2]},{"is_answer":true,"ids":[3]}]'), "array<struct<is_answer: boolean, ids: array<int>>>")
    assert v(prompts.masked_turns(turns)) == [-100, -100, 3]
    assert v(prompts.formatted_input(F.lit("I"), F.lit("E"), F.lit("P"), F.lit(" c {question} "), F.lit("q"))) == "I\n\nE\n\nP\n\nQuestion: q\n\n<context>\nc {question}\n</context>"
    templates = spark.createDataFrame([("d", "sys", "C: {context}", "Q: {input}")], "dataset_name string, system_prompt string, context_template string, user_template string")
    row = spark.createDataFrame([("d", "ctx", "in")], "dataset_name string, context string, input string")
    assert prompts.task_prompt(row, templates).first().prompt == "sys\n\nC: ctx\n\nQ: in"
    assert v(prompts.choice_prompt(F.lit("$DOC$ $Q$"), {"DOC": F.lit(" d "), "Q": F.lit("q")})) == "d q" and v(prompts.statements(F.lit("Question: Q"))) == "Statement: Q" and v(prompts.closed_book_prompt(F.lit("q"))) == "Question: q\nAnswer:"
    assert [x.role for x in v(prompts.request(F.lit("s"), F.lit("q"), F.lit("t"), F.lit("u")))] == ["system", "user", "assistant", "user"]


def test_client(spark):
    def _shout():
        def call(texts):
            if any(t == "bad" for t in texts):
                raise ValueError(t for t in texts)
            return [t.upper() for t in texts]

        return call

    frame = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "row_idx long, prompt string")
    assert {r.row_idx: r.predict for r in client.generate(frame, _shout, batch=2, tries=2).collect()} == {1: "A", 2: None, 3: "C"}
    assert {r.row_idx: r.predict for r in client.generate(frame, _shout, failed="").collect()}[2] == ""
    assert client.answered(client.generate(frame, _shout)).count() == 2
    judged = client.judged(spark.createDataFrame([(1, "c,i,y")], "row_idx long, judge_prompt string"), _shout).first()
    assert judged.judgement == [True, True, True] and judged.judge_score == 1


def test_rows_and_packing(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 2, "x"), (2, 3, "y")], "row_idx long, chosen_ids int, t string")
    assert rows.complete(df).count() == 2 and rows.prefixed(df, "chosen").columns == ["ids"] and rows.without(df, df.where("t = 'x'"), ["t"]).count() == 2
    with pytest.raises(Exception, match="wrong"):
        rows.required(df, F.col("t") == "x", "wrong").count()
    assert rows.required(df, F.col("row_idx") >= 0, "wrong").count() == 3 and rows.union_all(df, df.drop("t")).count() == 6
    docs = spark.createDataFrame([("long", "x"), ("short", "x"), ("short", "x" * 9)], "length string, context string")
    assert rows.short_enough(docs, longest=5).count() == 1
    sizes = {r[0] for r in spark.range(300).select(rows.mixed_length(["id"], [4, 8], 0.5)).collect()}
    assert sizes == {4, 8} and rows.dealt(df, 3).rdd.getNumPartitions() == 3
    many = spark.range(10).select(F.col("id").alias("row_idx"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("inputs"), F.lit(1.0).alias("weight"))
    assert packing.whole_groups(many, 4).count() == 8 and packing.group_weights(many, 4).where("row_idx = 9").first().weight_sum == 2.0
    warm = {r.row_idx: (r.inputs, r.weight) for r in packing.warmed(many, 1, 2).collect()}
    assert warm[0] == ([1, 2], 2.0) and warm[1] == ([1, 2, 3], 1.0)
    both = packing.collated(many.withColumn("labels", F.col("inputs")), ["inputs"], ["labels"], 4).first()
    assert both.inputs == [1, 2, 3, 0] and both.labels == [1, 2, 3, -100]
    assert 0 < packing.curriculum(spark.range(400).withColumnRenamed("id", "row_idx")).where("sparse").count() < 100


def test_stream_agrees_with_table(spark, tmp_path):
    kind = schemas.PREDICTION + ", ts timestamp"
    data = spark.sql("select 'd' as dataset_name, 'the cat' as pred_str, array('cat', 'dog') as answers, 5L as length, timestamp'2024-01-01 00:00:01' as ts union all select 'd', 'x', array('y'), 5L, timestamp'2024-01-01 00:05:00' union all select 'd', 'x', array('x'), 5L, timestamp'2024-01-02 00:00:00'")
    data.write.json(f"{tmp_path}/in")
    stream = scoring.windowed_means(scoring.scored(scoring.read(spark, f"{tmp_path}/in", kind)))
    assert stream.isStreaming
    scoring.write(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = {(str(r.start), r.score, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("2024-01-01 00:00:00", 0.5, 2)}  # the last window is still open
    assert scoring.scored(data).agg(F.sum("score")).first()[0] == 2.0


def test_long_sentences_count(spark):
    docs = spark.createDataFrame([(1, "Short one. " + "w " * 250 + "end. Last."), (2, "no marks " * 300)], "doc_id long, text string")
    assert {(r.doc_id, len(r.tokens)) for r in facts.sentences(docs).collect()} == {(1, 2), (1, 251), (1, 1), (2, 600)}
    assert {len(r.tokens) for r in facts.sentences(docs, 2, 251).collect()} == {2, 251}


def test_row_index_with_gaps_and_repeats(spark, tmp_path):
    from loomtext.plans.queries import QUERIES

    keys = [5, 900, 900, None, -3, 70_000_000_000, 12, None, 12, 12, 4]
    orders = spark.createDataFrame([(k,) for k in keys], "o_orderkey long")
    found = sorted((r.i, r.o_orderkey) for r in rows.row_index(orders, "o_orderkey").collect())
    assert [k for _, k in found] == [*sorted(k for k in keys if k is not None), None, None] and [i for i, _ in found] == list(range(len(keys)))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    parts = sorted(QUERIES["near_equal_parts"](spark, str(tmp_path)).collect())
    assert [tuple(p) for p in parts] == [(0, 1, 0, 0), (1, 1, 1, 1), (2, 1, 2, 2), (3, 2, 3, 4), (4, 2, 5, 6), (5, 2, 7, 8), (6, 2, 9, 10)]
    many = spark.range(250_000).select((F.col("id") * 7 % 250_000 * 3).alias("k"))
    assert rows.row_index(many, "k").where("i * 3 <> k").count() == 0
    assert rows.row_index(orders.limit(0), "o_orderkey").count() == 0


def test_boundaries_over_ranges(spark, monkeypatch):
    draw = random.Random(5)
    items = [(draw.choice(["a", "b", None]), draw.choice([None, *range(40)]), draw.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(items, "key string, place int, size int")
    place = lambda p: (p is None, p or 0)
    expected = sorted((str(k), str(p), n, sum(m for j, q, m in items if j == k and place(q) <= place(p))) for k, p, n in items)
    own = F.when(F.col("place").isNull(), 9).otherwise(F.floor(F.col("place") / 10)).cast("int")
    for ranges in (rows.ranged, lambda df, by: df.withColumn("_range", own)):
        monkeypatch.setattr(packing, "ranged", ranges)
        assert sorted((str(r.key), str(r.place), r.size, r.end) for r in packing.boundaries(df, "key", "place", "size").collect()) == expected
    assert packing.boundaries(df.limit(0), "key", "place", "size").count() == 0
