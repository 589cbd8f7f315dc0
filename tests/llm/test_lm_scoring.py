import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
from loomtext.llm import lm_scoring as L
from loomtext.llm.subwords import vocabulary_path


def test_base_by_brute_force_and_model_on_held_out(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    rows += [(9001, None), (9002, ""), (9003, "THE the\x0bÉ &&& \x85x"), (None, "the end"), (9003, "again")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    train = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for _, t in train for w in split(t))
    tokens, size = sum(c.values()) + len(train), sum(c.values()) + 2 * len(train) + len(c) + 2 - len(train)
    expected = []
    for i, t in rows:
        n = [c[w] for w in split(t)] + [len(train)]
        expected.append((str(i), i is None or zlib.crc32(str(i).encode()) % 7 == 2, len(n), sum(x > 0 for x in n), tokens, round(sum(math.log10((x + 1) / size) for x in n), 6)))
    found = L.score(docs, head_words=300, steps=150).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == sorted(expected)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > 1.3 * sum(r.base_score for r in held)  # it spells the words that the base need not
    assert L.score(docs.limit(0), steps=1).count() == 0


def test_windows_score_each_target_once():
    n = np.array([0, 1, 23, 24, 25, 100])
    own, place, counts = L.windows(n + 1)
    seen = Counter(zip(np.repeat(own, L.STRIDE)[counts.ravel()].tolist(), place[:, L.CONTEXT :][counts].tolist(), strict=True))
    assert seen == Counter((k, t) for k, m in enumerate(n) for t in range(m + 1))


def model(width=16):
    coder = L.Subwords(vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    corpus = np.zeros(coder.size)
    corpus[:70] = np.arange(70) % 9 + 1
    return L.Attention(corpus, 5, width, seed=1)


def test_gradient_by_differences():
    m, rng = model(), np.random.default_rng(2)
    ids, targets = rng.integers(0, m.pad + 1, (3, L.WINDOW)), rng.integers(0, m.end + 1, (3, L.STRIDE))
    ids[:, L.CONTEXT] = 1
    counts = rng.random((3, L.STRIDE)) < 0.8
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}

    def loss():
        y = m.forward(ids)["y"][counts]
        return -(m.log(y, targets[counts]) + np.where(targets[counts] == m.unseen, math.log(m.others), 0)).mean()

    found = m.gradient(ids, targets, counts)
    for k, p in m.p.items():
        at = np.unravel_index(np.abs(found[k]).argmax(), p.shape)
        p[at] += 1e-4
        up = loss()
        p[at] -= 2e-4
        down = loss()
        p[at] += 1e-4
        assert np.isclose((up - down) / 2e-4, found[k][at], rtol=2e-2, atol=1e-5), k


def test_steps_reuse_their_memory():
    code = """
import resource
import numpy as np
from loomtext.llm import common, lm_scoring as L

common.roomy()
m = L.Attention(np.arange(3000) % 9 + 1.0, 5)
ids, targets, counts = np.ones((256, L.WINDOW), int), np.ones((256, L.STRIDE), int), np.ones((256, L.STRIDE), bool)
for _ in range(4):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    m.train(ids, targets, counts, 3, 256)
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
"""
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert int(found.stdout) < 2000  # pages of three steps


def test_later_ids_change_nothing():
    m, rng = model(), np.random.default_rng(4)
    ids = rng.integers(0, m.unseen, (2, L.WINDOW))
    changed = ids.copy()
    changed[:, 30:] = 3
    a, b = m.forward(ids)["y"], m.forward(changed)["y"]
    assert np.allclose(a[:, : 30 - L.CONTEXT], b[:, : 30 - L.CONTEXT]) and not np.allclose(a, b)


def test_probabilities_of_all_ids_sum_to_one():
    m, rng = model(), np.random.default_rng(6)
    y = rng.normal(size=(1, 16))
    each = np.exp([m.log(y, np.array([t]))[0] for t in range(m.end + 1)])
    assert np.isclose(each[: m.unseen].sum() + each[m.unseen] * (len(m.dense) - m.unseen) + each[m.end], 1)


def test_scorer_is_the_model():
    m, rng = model(), np.random.default_rng(5)
    n = np.array([0, 1, L.STRIDE - 1, L.STRIDE, 3 * L.WINDOW + 7])
    ids = rng.integers(0, m.unseen + 1, int(n.sum()))
    found = L.Scorer(m).score(ids, n)
    for k, own in enumerate(np.split(ids, np.cumsum(n)[:-1])):
        stream, total = [m.end, *own.tolist(), m.end], 0.0
        for t in range(1, len(stream)):  # the target at t, after the window's ids up to t - 1
            begin = (t - 1) // L.STRIDE * L.STRIDE
            window = [stream[i] if 0 <= i < len(stream) else m.pad for i in range(begin - L.CONTEXT, begin + L.STRIDE)]
            y = m.forward(np.array([window]))["y"][0, t - 1 - begin]
            total += m.log(y[None], np.array([stream[t]]))[0] / math.log(10)
        assert np.isclose(found[k], total, rtol=1e-4), k


def test_attention_is_what_predicts():
    rng = np.random.default_rng(3)
    # Each id stands again five places later, so only attention to earlier ids can tell it.
    ids = np.tile(rng.integers(0, 60, (400, 5)), (1, L.WINDOW // 5 + 1))[:, : L.WINDOW + 1]
    m = model(32)
    inputs, targets, counts = ids[:, :-1], ids[:, L.CONTEXT + 1 :], np.ones((400, L.STRIDE), bool)
    m.train(inputs[:300], targets[:300], counts[:300], 600)
    mean = lambda: L.Scorer(m).windows_log10(inputs[300:], targets[300:], counts[300:]).mean()
    whole = mean()
    m.p["o"] *= 0
    assert mean() < whole - 0.5


def test_passes_train_on_all_partitions(spark):
    docs = spark.createDataFrame([(i, f"the cat {i % 7} sat on the mat " * (1 + i % 5)) for i in range(80)], "doc_id long, text string").repartition(3)
    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    counts = L.word_counts(docs.select("text"))
    assert {bytes(r.word): r.n for r in counts.collect()}[b"cat"] == sum(1 + i % 5 for i in range(80))
    m = L.fitted(docs, 80, counts, path, 50, 100, 5)
    found = L.passed(docs, m, path, 1, 0)
    assert found.keys() == m.p.keys() and all(found[k].shape == m.p[k].shape for k in found)
    texts = L.pa.array(["the cat 3 sat on the mat"])
    score = lambda: L.Scorer(m).score(*L.texts_as_ids(texts, L.Words(L.Subwords(path), m.dense, {}, 1))[2:4])[0]
    before = score()
    m.p |= found
    assert score() > before and not L.passed(docs.limit(0), m, path, 1, 0)


def test_every_training_id_is_trained_on_once(spark, tmp_path, monkeypatch):
    (tmp_path / "recording.py").write_text("""
import uuid
import numpy as np
from loomtext.llm import lm_scoring as L

class Recording(L.Attention):
    def gradient(self, ids, targets, counts):
        np.save(f"{self.at}/{uuid.uuid4().hex}.npy", np.bincount(targets[counts], minlength=self.pad))
        return super().gradient(ids, targets, counts)
""")
    spark.sparkContext.addPyFile(str(tmp_path / "recording.py"))
    from recording import Recording

    rows = [(i, f"the cat {i} sat on the mat {i % 7} " * (1 + 5 * i % 67)) for i in range(300)] + [(301, None), (302, ""), (303, "long " * 9000), (303, "long " * 9000)]
    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    train = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    coder = L.subwords(path)
    ids = np.concatenate([coder.encode(t.split())[0] for t in train])
    m = Recording(np.bincount(ids, minlength=coder.size).astype(float), len(train))
    m.at = str(tmp_path)
    monkeypatch.setattr(L, "fitted", lambda *_: m)
    L.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sum(map(np.load, tmp_path.glob("*.npy"))).tolist() == [*np.bincount(m.dense[ids], minlength=m.end).tolist(), len(train)]


def test_words_encode_each_for_itself():
    coder = L.Subwords(vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    words = ["the", "x\xa0", "\xa0", "\xa0y", "it's", "\u3000z", "日本", "''", "a\x85b", "end\u2003"]
    for rest in (words, words[::-1]):
        ids, n = coder.encode(rest)
        alone = [coder.encode([w])[0].tolist() for w in rest]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == alone


def test_further_pieces_are_the_most_frequent_pairs():
    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    coder, words = L.subwords(path), {"zqzqzqxj": 40, "xjzq": 30, "qxjqxj,zq": 20, "vvvvv": 9, "once": 1}
    parts, expected = Counter(), []
    for word, n in words.items():
        for piece in re.findall(r" ?[a-z]+|,", " " + word):
            parts[tuple(coder.encoding.decode_single_token_bytes(i) for i in coder.encoding.encode_ordinary(piece))] += n
    for _ in range(6):
        pairs = Counter()
        for piece, n in parts.items():
            for pair in zip(piece, piece[1:], strict=False):
                pairs[pair] += n
        pair = min(pairs, key=lambda x: (-pairs[x], x))
        expected.append(b"".join(pair))
        merged = Counter()
        for piece, n in parts.items():
            out, i = [], 0
            while i < len(piece):
                step = 2 if piece[i : i + 2] == pair else 1
                out.append(b"".join(piece[i : i + step]))
                i += step
            merged[tuple(out)] += n
        parts = merged
    more = L.continued(words, path, 6, 1)
    assert list(more) == expected
    ids, n = L.Subwords(path, more).encode(list(words))
    assert b"".join(L.Subwords(path, more).encoding.decode_tokens_bytes(ids.tolist())).decode().split() == list(words)
    assert n.sum() < coder.encode(list(words))[1].sum() and not L.continued(words, path, 6, 1000)


def test_classes_cost_less_than_equal_ones():
    mass = 1 / np.arange(1, 3001)
    begin = L.classes(mass)
    sizes = np.diff(begin)
    assert begin[0] == 0 and begin[-1] == len(mass) and (sizes > 0).all()
    cost = len(sizes) + (np.add.reduceat(mass, begin[:-1]) / mass.sum() * sizes).sum()  # outputs that an id needs, in the mean
    assert cost < 0.75 * 2 * math.sqrt(len(mass))


def test_texts_are_cut_once(spark):
    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    rows = [(i, f"The cat {i} sat &&& on\x0bthe mat " * (i % 4)) for i in range(60)] + [(60, None), (61, " "), (62, "\xa0 \u65e5\u672c the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    more = L.continued({"cat": 5, "mat": 5}, path, 3, 1)
    coder = L.subwords(path, more)
    m = L.Attention(np.bincount(coder.encode(["the", "cat", "sat"])[0], minlength=coder.size).astype(float), 5, more=more)
    coded = L.encoded(docs.withColumn("pass", L.F.lit(0)), m, path, {"the": 9}, 100, 0.0, 1)
    found = {r.doc_id: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in coded.where("ids is not null").collect()}
    split = lambda t: [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())]
    assert found == {i: m.dense[coder.encode(split(t))[0]].tolist() for i, t in rows}
    assert coded.where("ids is null").agg({"tf": "sum"}).first()[0] == sum(w != "the" for _, t in rows for w in split(t))
    by_texts, by_ids = L.passed(docs, m, path, 1, 0), L.passed(coded, m, path, 1, 0)
    assert by_texts.keys() == by_ids.keys() and all(by_texts[k].shape == by_ids[k].shape for k in by_ids)


def test_words_outlive_a_full_store():
    coder = L.subwords(vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    own = L.Words(coder, np.arange(coder.size, dtype=np.int32), {"a3": 4}, 10, cached=6)
    for begin in (0, 5, 2, 0):
        words = [f"a{i}" for i in range(begin, begin + 8)]
        at = own.places(L.pa.array(words))
        assert own.subwords(at, np.array([8]))[0].tolist() == coder.encode(words)[0].tolist()
        assert (own.counted[at] > 0).tolist() == [w == "a3" for w in words] and np.isclose(own.base[at].sum(), math.log10(0.5) if "a3" in words else 0)
