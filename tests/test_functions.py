import math
import random
from difflib import SequenceMatcher

import pytest
from loomtext.functions import arrays as A
from loomtext.functions import metrics as M
from loomtext.functions import preferences as P
from loomtext.functions import text as T
from pyspark.sql import functions as F


def value(spark, column):
    got = spark.range(1).select(column.alias("v")).first().v
    return got


def ints(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")


def strings(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(T.normalize_answer(F.lit("The  Cat, an É-a!"))) == "cat éa"
    assert v(T.normalize_cjk_answer(F.lit("你 好，A。"))) == "你好a"
    assert v(T.first_line(F.lit("\n\na b\nc"))) == "a b" and v(T.stripped_first_line(F.lit(" a \nb"))) == "a"
    assert v(T.choice_answer(F.lit("*The correct answer is* (B)"))) == "B" and v(T.choice_answer(F.lit("The correct answer is C"))) == "C" and v(T.choice_answer(F.lit("none"))) is None
    assert v(T.lenient_match(F.lit("Hall"), F.lit("the HALLWAY. bath"))) and not v(T.lenient_match(F.lit("bath"), F.lit("the HALLWAY. bath")))
    assert v(T.preprocess_output(F.lit("Kitchen Question: x"))) == "kitchen " and v(T.preprocess_output(F.lit("Kitchen Question: x"), strict=True)) == "kitchen question: x"
    assert v(T.cut_at_stop(F.lit("ab<|eot_id|>c"))) == "ab" and v(T.length_penalty(F.lit("a b"))) == 0.02
    assert tuple(v(T.split_layout(F.lit("h1\nh2\nc1\nc2\nq0\nq")))) == ("c1\nc2", "q") and tuple(v(T.split_layout(F.lit("a\n\nb\n\nq "), True))) == ("a\n\nb", "q")
    assert v(T.run_tag(F.lit("x/y/z"))) == "y/z" and v(T.file_stem(F.lit("a.b.c"))) == "a" and v(T.output_name(F.lit("p/q"), F.lit("n.json"))) == "p-n"
    assert v(T.split_config(F.lit("a-b"))) == "b" and v(T.split_config(F.lit("ab"))) == "ab"
    assert v(T.config_name(F.create_map(F.lit("examples"), F.lit(True), F.lit("template"), F.lit(True), F.lit("post"), F.lit(False)))) == "examples_yes_post_no"
    assert v(T.format_spans(T.parse_spans(F.lit("[0, 5];[7, 12]")))) == "[0, 5];[7, 12]"
    assert v(T.fill(F.lit("$Q$ $D$"), {"$Q$": F.lit(" q "), "$D$": F.lit(None).cast("string")})) == "q "
    assert v(T.normalize_answer(F.lit(None).cast("string"))) is None and v(T.words(F.lit(""))) == []


def test_metrics(spark):
    v = lambda c: value(spark, c)
    assert v(M.qa_f1(F.lit("the a cat cat sat"), F.lit("cat cat cat"))) == pytest.approx(2 * (2 / 3) * (2 / 3) / (4 / 3))
    assert v(M.qa_f1(F.lit(""), F.lit("x"))) == 0.0 and v(M.qa_f1(F.lit("x"), F.lit(""))) == 0.0
    assert v(M.count_score(F.lit("3 of 3 or 4"), F.lit("3"))) == pytest.approx(2 / 3) and v(M.count_score(F.lit("none"), F.lit("3"))) == 0.0
    assert v(M.retrieval_score(F.lit("Paragraph 7"), F.lit("Paragraph 7"))) == 1.0 and v(M.retrieval_score(F.lit("7"), F.lit("x"))) is None and v(M.retrieval_cjk_score(F.lit("段落7"), F.lit("段落7"))) == 1.0
    assert v(M.classification_score(F.lit("a city and country"), F.lit("city"), strings("city", "country", "it"))) == 0.5
    assert v(M.classification_score(F.lit("abc ab b"), F.lit("abc"), strings("ab", "b", "abc"))) == 1.0 and v(M.classification_score(F.lit("abc ab b"), F.lit("abc"), strings("ab", "b", "abc"), strict=True)) == 0.5
    assert v(M.best_subspan_em(F.lit("The answer is Paris."), strings("paris", "rome"))) == 1.0 and v(M.best_subspan_em(F.lit("x"), strings(""))) == 1.0
    assert v(M.best_of(M.qa_f1, F.lit("b"), strings("a x", "b"))) == 1.0 and v(M.best_of(M.qa_f1, F.lit("b"), strings())) == 0.0
    assert v(M.lcs_length(strings(*"abcdef"), strings(*"bxdezf"))) == 4
    assert v(M.label_match(F.lit("kitchen"), F.lit("In the Kitchen."), F.lit("where?"), strings("kitchen", "hallway")))
    assert not v(M.label_match(F.lit("kitchen"), F.lit("kitchen or hallway"), F.lit("where?"), strings("kitchen", "hallway")))
    assert v(M.label_match(F.lit("apple,milk"), F.lit("apple and milk"), F.lit("what?"), strings("apple", "milk", "football")))
    assert v(M.label_match(F.lit("n,e"), F.lit("n,e"), F.lit("how?"), strings("n,e", "s,e")))
    got = v(M.recall_score(F.lit("a b bad"), F.lit("a b c d"), strings("bad", "worse")))
    assert got.recall == 50.0 and got.score == pytest.approx(50 - 100 / 3)
    rng = random.Random(1)
    rows = [(" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 12))), " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 12)))) for _ in range(60)] + [(None, "a"), ("a", None)]
    frame = spark.createDataFrame(rows, "p string, g string")

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    found = frame.select("p", "g", M.rouge_l(F.col("p"), F.col("g")).alias("a"), M.rouge_l_long()(F.col("p"), F.col("g")).alias("b"), M.code_sim(F.col("p"), F.col("g")).alias("c"), M.segmented_f1()(F.col("p"), F.col("g")).alias("d")).collect()
    for r in found:
        a, b = (r.p or "").split(), (r.g or "").split()
        n = lcs(a, b)
        want = 2 * n / (len(a) + len(b)) if n else 0.0
        assert r.b == pytest.approx(want) and (r.p is None or r.g is None or r.a == pytest.approx(want))
        assert r.c == pytest.approx(round(100 * SequenceMatcher(None, r.p or "", r.g or "").ratio()) / 100)
    assert v(M.code_line(F.lit("\n# no\nx = 1 // c\ny = 2\n"))) == "y = 2" and v(M.code_line(F.lit("#"))) == ""


def test_arrays(spark):
    v = lambda c: value(spark, c)
    assert v(A.chunks(ints(1, 2, 3, 4, 5), 2)) == [[1, 2], [3, 4], [5]] and v(A.chunks(ints(), 2)) == []
    assert v(A.head_tail(ints(*range(9)), 2, 3)) == [0, 1, 6, 7, 8] and v(A.head_tail(ints(1, 2), 2, 2)) == [1, 2]
    assert v(A.middle_cut(ints(*range(9)), 5)) == [0, 1, 6, 7, 8] and v(A.middle_cut(ints(1), 5)) == [1] and v(A.prompt_cut(ints(*range(9)), 106, 2)) == [0, 1, 7, 8]
    assert v(A.pad(ints(1), 3, -100)) == [1, -100, -100] and v(A.pad(ints(1, 2), 1)) == [1, 2]
    assert tuple(v(A.pad_with_mask(ints(5, 6), 3))) == ([5, 6, 0], [1, 1, 0])
    assert v(A.masked_labels(ints(1, 2), ints(3))) == [-100, -100, 3] and v(A.replaced(ints(1, 2), F.lit(1), F.lit(9))) == [9, 2]
    assert v(A.covering_starts(F.lit(5), F.lit(120))) == list(range(0, 120, 5)) and v(A.covering_starts(F.lit(7), F.lit(20))) == [0, 6, 13] and v(A.covering_starts(F.lit(4), F.lit(4))) == [0]
    assert v(A.covering_positions(F.lit(2), F.lit(3))) == [[0, 1], [1, 2]]
    with pytest.raises(Exception, match="longer"):
        v(A.covering_starts(F.lit(9), F.lit(3)))
    p = v(A.positions(F.lit(4), F.lit(20), F.lit("k")))
    assert len(p) == 4 and p == list(range(p[0], p[0] + 4)) and p[-1] < 20 and v(A.positions(F.lit(3), F.lit(3), F.lit("k"))) == [0, 1, 2] and v(A.positions(F.lit(0), F.lit(3), F.lit("k"))) == []
    assert [tuple(x) for x in v(A.chunk_layout(F.lit(2), F.lit(30), F.lit(4), F.lit(6)))] == [(4, 13), (14, 23)]
    assert v(A.chunk_positions(F.lit(3), F.lit(10), F.lit(9), F.lit(True))) == [10, 14, 18] and v(A.chunk_positions(F.lit(3), F.lit(10), F.lit(9), F.lit(False))) == [10, 11, 12]
    assert tuple(v(A.qa_positions(ints(7, 7), F.lit(9), F.lit(5)))) == ([10, 11], [13, 14, 15])
    assert v(A.beacons(3, F.lit(12), F.lit(100))) == [103, 107, 111] and v(A.beacons(3, F.lit(2), F.lit(0))) == []
    assert v(A.assembled(ints(1), F.array(ints(2), ints(3)), ints(4), ints(0, 1, 2, 3))).input_ids == [1, 2, 3, 4]
    assert sorted(v(A.combinations(F.array(ints(1, 2), ints(3), ints(4, 5))))) == [[1, 3, 4], [1, 3, 5], [2, 3, 4], [2, 3, 5]]
    d = v(A.drawn(ints(*range(10)), 2, F.lit("k")))
    assert len(set(d)) == 2 and d == sorted(d) and v(A.drawn(ints(1), 2, F.lit("k"))) == [1]
    assert v(A.every_other(strings("c", "s", "q", "a", "r", "b"), 2)) == ["q", "r"] and v(A.every_other(strings("c", "s", "q", "a"), 3)) == ["a"]
    docs = F.from_json(F.lit('[{"t":"a","isgold":false},{"t":"g","isgold":true},{"t":"b","isgold":false}]'), "array<struct<t: string, isgold: boolean>>")
    assert [x.t for x in v(A.gold_at(docs, 2))] == ["a", "b", "g"] and [x.t for x in v(A.only_gold(docs))] == ["g"]
    assert v(A.place_of(ints(4, 5), F.lit(5))) == 1 and v(A.place_of(ints(4), F.lit(5))) == -1 and v(A.total_length(F.array(ints(1, 2), ints(3)))) == 3
    assert v(A.first_differences(ints(1, 2, 3, 4), ints(1, 9, 3, 4), ints(1, 2, 8, 4), 2)) == [1, 2] and v(A.first_differences(ints(1, 2), ints(1, 2), ints(1, 2), 1)) == [1]
    pairs = F.from_json(F.lit('[{"k":"a","v":"1"},{"k":"b","v":"2"}]'), "array<struct<k: string, v: string>>")
    assert v(A.valid_pairs(pairs, F.lit("a"))) and not v(A.valid_pairs(pairs, F.lit("z")))


def test_preferences(spark):
    v = lambda c: value(spark, c)
    sig = lambda x: -math.log(1 / (1 + math.exp(-x)))
    assert v(P.sigmoid_loss(F.lit(0.7), 2.0, 0.3, 0.1)) == pytest.approx(sig(0.8) * 0.9 + sig(-0.8) * 0.1)
    assert v(P.hinge_loss(F.lit(0.1), 2.0, 0.0)) == pytest.approx(0.8) and v(P.negative_log_sigmoid(F.lit(-800.0))) == 800.0
    c, r = -0.5, -1.5
    odds = (c - r) - (math.log1p(-math.exp(c)) - math.log1p(-math.exp(r)))
    assert v(P.log_odds(F.lit(c), F.lit(r))) == pytest.approx(odds) and v(P.odds_loss(F.lit(c), F.lit(r), 0.5)) == pytest.approx(0.5 * -sig(odds))
    assert v(P.judgement(F.lit("##Judgement: C, i, Y\nmore"))) == [True, True, True] and v(P.judgement(F.lit("c,c,y"))) == [False] * 3 and v(P.judgement(F.lit("c,i"))) is None
    assert [v(P.judgement_score(P.judgement(F.lit(t)))) for t in ("x", "C,I,Y", "C,I,N")] == [-1, 1, 0]
    sizes = {}
    for i in range(7):
        k = v(P.near_equal_part(F.lit(i), F.lit(7), 3))
        sizes[k] = sizes.get(k, 0) + 1
    assert sizes == {0: 2, 1: 2, 2: 3}
    assert [v(P.near_equal_part(F.lit(i), F.lit(2), 3)) for i in range(2)] == [1, 2]
    assert [v(P.ceil_part(F.lit(i), F.lit(7), 3)) for i in range(7)] == [0, 0, 0, 1, 1, 1, 2] and v(P.floor_part(F.lit(1), F.lit(2), 5)) == 1


def test_overlap_counts_multisets(spark):
    draw = random.Random(7)
    pairs = [[[draw.choice(["a", "b", "ab", "", "c"]) for _ in range(draw.randrange(12))] for _ in range(2)] for _ in range(60)] + [[["a", None, "a"], ["a", None, None]]]
    found = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    known = lambda x: [t for t in x if t is not None]
    expected = {i: sum(min(known(a).count(t), known(b).count(t)) for t in set(known(a))) for i, (a, b) in enumerate(pairs)}
    for few in (64, 1, -1):
        assert {r.i: r.n for r in found.select("i", M.overlap(F.col("a"), F.col("b"), few).alias("n")).collect()} == expected
