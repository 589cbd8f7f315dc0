import random
import zlib

import pytest
from loomtext.llm import packing, subwords

TEXTS = ["", None, "One two, three's", "word " * 5000, "É à\x1fb c d\u0085e", "x" * 3000, "İstanbul ΟΔΟΣ Σ. Été DON'T we'LL ﬁne ①2²", "áb ǅ ẞ 한국어 日本語。", "don't 12345 &&& ###"] + [f"alpha beta {i} gamma" * (i % 37) for i in range(200)]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(subwords.vocabulary_path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return [b"".join(i.to_bytes(4, "little") for i in x.ids) for x in t.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


def test_words_encode_as_whole_texts_do(whole):
    assert subwords.WordBpe(subwords.vocabulary_path("word_bpe_49k.json")).encode([t or "" for t in TEXTS]) == whole


def test_random_texts_encode_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    path, rng = subwords.vocabulary_path("word_bpe_49k.json"), random.Random(4)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    letters = "aABz'st  \n\x1f\x85\xa0\u2003\u3000éÉÅßİΣςß\u0301\u0308\u0331\u0323\ufb1e9½²日本가힣!?.,<|>_-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    texts += ["H\u0331\u0323", "T\u0308\u0301", "İ\ufb1e", "\xa0", "\xa0 a", "<|endoftext|>", "A\u030a\u0323"]
    coder = subwords.WordBpe(path, cached=5000)
    found = [x for at in range(0, len(texts), 700) for x in coder.encode(texts[at : at + 700])]
    assert found == [b"".join(i.to_bytes(4, "little") for i in x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def test_long_words_are_merged_by_ranks_as_by_pairs():
    from tokenizers import Tokenizer

    path, rng = subwords.vocabulary_path("word_bpe_49k.json"), random.Random(6)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["".join(rng.choice(["ab", "aa", "é", "lo", "e", "日", "in", "th"]) for _ in range(rng.choice((90, 150, 2000)))) for _ in range(60)] + ["\0\x7f\xad x", "a" * 5000]
    coder = subwords.WordBpe(path)
    assert coder.by_ranks
    assert coder.encode(texts) == [b"".join(i.to_bytes(4, "little") for i in x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def test_ranks_that_join_other_pairs_are_refused():
    letters = subwords.byte_letters()
    vocab = {x + end: i for i, (end, x) in enumerate((end, x) for end in ("", "</w>") for x in letters)}

    def ranks(*merges, **more):
        own = vocab | {a + b: len(vocab) + i for i, (a, b) in enumerate(merges)}
        return subwords.ranks_of({"vocab": own, "merges": [list(x) for x in merges], "end_of_word_suffix": "</w>"} | more)

    assert ranks(("a", "b"), ("ab", "c</w>"))[b"abc "] == len(vocab) + 1
    # Its pairs leave b c joined first, after which ranks would join a to it.
    assert ranks(("b", "c"), ("a", "b"), ("ab", "c")) is None
    assert ranks(("a", "b"), dropout=0.1) is None and ranks(("a", "b"), ("a", "b")) is None


def test_another_file_is_used_as_it_is():
    from tokenizers import Tokenizer

    path = subwords.vocabulary_path("byte_bpe_50k.json")
    texts = ["Some text, twice", "", " x"]
    assert subwords.WordBpe(path).encode(texts) == [b"".join(i.to_bytes(4, "little") for i in x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def place_plainly(sizes, window, most):
    """A bounded-space packer, word for word: full windows and those left open, as lists of lengths."""
    full, left = [], []
    for n in sizes:
        while n:
            fits = [w for w in left if sum(w) + n <= window]
            if n >= window or not fits and len(left) < most:
                w, m = [], min(n, window)
                left.append(w)
            elif fits:
                w, m = max(fits, key=sum), n
            else:
                w = max(left, key=sum)
                m = window - sum(w)
            w.append(m)
            n -= m
            if sum(w) == window:
                full.append(w)
                left = [x for x in left if x is not w]
    return full, left


def test_placement_against_a_plain_packer():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randint(1, rng.choice((10, 60, 300))) for _ in range(rng.randrange(120))]
        packer = packing.Packer(0, 64, 4)
        for i, n in enumerate(sizes):
            packer.place([i, 0, b"\0" * (4 * n), n])
        lengths = lambda windows: [[len(p[2]) // 4 for p in w] for w in windows]
        assert (lengths(packer.closed), lengths(w[1] for w in packer.open)) == place_plainly(sizes, 64, 4)


def test_every_id_lies_in_one_piece_and_sequences_are_gapless(spark, whole):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string").repartition(5)
    rows = packing.pack(docs, keep_ids=True).collect()
    for i, ids in enumerate(whole):
        own = sorted((r for r in rows if r.doc_id == (i or None)), key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == ids + (1).to_bytes(4, "little")
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(ids) // 4 + 1 and r.length == len(r.ids) // 4 for r in own)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
