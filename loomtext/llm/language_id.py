"""Language identification of whole, possibly mixed texts.

Words are scored under every learned language by smoothed character n-grams (1 to 3, with word ends).  The script of a word's
letters narrows the languages to those that use the script; Viterbi over the words, with a penalty for each switch, labels
spans.  A document's language is the one with most letters in its spans, its score that share of all letters.

The n-gram tables are fitted on at most `fit_docs` documents of each language, the first by hash; everything else covers all rows.

Nulls: a null text, or one without letters, is `und` with score 0 and no spans.  A null doc_id is kept and counts as held out.
Long texts are labelled whole.  Ties go to the language that sorts first.  Equal rows get equal answers.  Other columns are
ignored.  An empty table gives no rows; with nothing to learn from, all is `und`.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, tidied

#: First code points of script blocks, in order, and the script that starts there (0: none).
SCRIPTS = [
    (0x41, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Other"), (0x900, "Devanagari"), (0x980, "Bengali"),
    (0xA00, "Other"), (0xB80, "Tamil"), (0xC00, "Other"), (0xE00, "Thai"), (0xE80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0xFF66, "Kana"), (0xFFA0, "Other"), (0x20000, "Han"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_INDEX = np.array([0] + [_NAMES.index(n) + 1 for _, n in SCRIPTS])
SLOTS = 1 << 18


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def script_of(word: str) -> int:
    """The script of the first letter, 0 if there is none."""
    for c in word:
        if c.isalpha():
            return int(_INDEX[np.searchsorted(_STARTS, ord(c), "right")])
    return 0


def slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of all n-grams of all words, and where each word's begin."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(n + 1)[:-1]])  # the space before each word
    x, k = codes + np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    h1 = x * k
    h2 = (h1[:-1] ^ (x[1:] << np.uint64(21))) * k
    h3 = (h2[:-1] ^ (x[2:] << np.uint64(21))) * k
    # A word of n letters with its two spaces has n one-, n + 1 two- and n three-grams.
    sizes = 3 * n + 1
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty(int(sizes.sum()), np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    within = np.arange(len(out)) - begin[word]
    m, at = n[word], first[word]
    one, two = within < m, (within >= m) & (within < 2 * m + 1)
    three = within >= 2 * m + 1
    shift = np.uint64(64 - 18)
    out[one] = (h1[at[one] + 1 + within[one]] >> shift).astype(np.int64)
    out[two] = (h2[at[two] + within[two] - m[two]] >> shift).astype(np.int64)
    out[three] = (h3[at[three] + within[three] - 2 * m[three] - 1] >> shift).astype(np.int64)
    return out, begin


class Model:
    def __init__(self, rows: list[tuple[str, str]], clip: float = 6.0, penalty: float = 8.0):
        self.langs = sorted({lang for lang, _ in rows})
        self.clip, self.penalty = clip, penalty
        counts = np.zeros((SLOTS, len(self.langs)))
        scripts = np.zeros((len(_NAMES) + 1, len(self.langs)))
        for k, lang in enumerate(self.langs):
            words = Counter(w for own, text in rows if own == lang for w in text.lower().split())
            names = [w for w in words if script_of(w)]
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                where, begin = slots(part)
                weight = np.fromiter((words[w] for w in part), float, len(part))
                counts[:, k] += np.bincount(where, np.repeat(weight, np.diff(np.append(begin, len(where)))), SLOTS)
                scripts[:, k] += np.bincount([script_of(w) for w in part], weight, len(_NAMES) + 1)
        table = np.log((counts + 0.05) / (counts.sum(0) + 0.05 * SLOTS)) if self.langs else counts
        self.table = (table - table.max(1, keepdims=True) if self.langs else table).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(0))
        self.uses = (share >= 0.001) | ~(share >= 0.001).any(1, keepdims=True)  # a script that no language uses narrows nothing
        self.uses[0] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        where, begin = slots(words)
        score = np.add.reduceat(self.table[where], begin, 0) / 2
        script = np.fromiter(map(script_of, words), np.int64, len(words))
        letters = np.fromiter((sum(map(str.isalpha, w)) for w in words), np.int64, len(words))
        score = np.maximum(score - score.max(1, keepdims=True), -self.clip)
        score[~self.uses[script]] = -4 * self.clip
        score[letters == 0] = 0
        self.known.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.rows, self.letters = np.concatenate([self.rows, score]), np.concatenate([self.letters, letters])

    def label(self, texts: list[str | None], cached: int = 150_000) -> list[tuple[str, float, list]]:
        split = [(t or "").lower().split() for t in texts]
        if len(self.known) > cached:
            self.forget()
        if not self.langs:
            return [("und", 0.0, []) for _ in texts]
        new = list(set().union(*split).difference(self.known))
        for first in range(0, len(new), 16_384):  # the n-grams of all would take far more memory than the words
            self.learn(new[first : first + 16_384])
        of = self.known.__getitem__
        n = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter((of(w) for own in split for w in own), np.int64, int(n.sum()))
        paths = viterbi(self.rows[ids], n, self.penalty)
        letters, at, out = self.letters[ids], 0, []
        for m in n.tolist():
            path, weight = paths[at : at + m], letters[at : at + m]
            at += m
            total = np.bincount(path, weight, len(self.langs))
            if not total.sum():
                out.append(("und", 0.0, []))
                continue
            ends = np.append(np.flatnonzero(np.diff(path)) + 1, m)
            spans, start = [], 0
            for e in ends.tolist():
                spans.append((start, e, self.langs[path[start]]))
                start = e
            out.append((self.langs[int(total.argmax())], float(total.max() / total.sum()), spans))
        return out


def viterbi(scores: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word of texts that lie one after another; all texts advance together, a word at a time."""
    order = np.argsort(-n, kind="stable")
    first = (np.cumsum(n) - n)[order]
    alive = np.searchsorted(-n[order], -np.arange(n.max(initial=0)), "left")  # texts with more than t words
    back = np.full(scores.shape, -1, np.int16)  # -1: stay, else the label before
    best = np.zeros((len(n), scores.shape[1]), np.float32)
    every = np.arange(len(n))
    for t, k in enumerate(alive.tolist()):
        now = best[:k]
        if t:
            top = now.argmax(1)
            jump = now[every[:k], top] - np.float32(penalty)
            moved = jump[:, None] > now
            back[first[:k] + t] = np.where(moved, top[:, None].astype(np.int16), np.int16(-1))
            np.maximum(now, jump[:, None], out=now)
        now += scores[first[:k] + t]
    path = np.zeros(len(scores), np.int64)
    label = best.argmax(1)
    for t in range(len(alive) - 1, -1, -1):
        k = int(alive[t])
        at = first[:k] + t
        path[at] = label[:k]
        came = back[at, label[:k]]
        label[:k] = np.where(came >= 0, came, label[:k])
    return path


def fit(docs: DataFrame, fit_docs: int = 500) -> Model:
    """Learns from documents that aren't held out, at most fit_docs of each language, the first by hash."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Twice as many by hash as are wanted go to the window, not each task's first: what is shuffled does not grow with the corpus.
    share = F.lit(0.0)
    for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect():  # a row for each language
        share = F.when(F.col("lang") == r.lang, 2.0 * fit_docs / r.n).otherwise(share)
    near = (F.xxhash64("doc_id").cast("double") / 2.0**63 + 1) / 2 <= share
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    chosen = known.where(near).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= fit_docs)
    return Model([(r.lang, r.text) for r in chosen.select("lang", "text").collect()])


def identify(docs: DataFrame, model: Model, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in `also`, lang_pred, score, and spans of words [start, end) with their language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        own = shared.value
        for batch in slices(batches, 1024):
            found = own.label(batch.column("text").to_pylist())
            spans = pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found], kind)
            # The text goes to Python once and comes back only where it is asked for.
            known = [batch.column(x) for x in given]
            yield pa.RecordBatch.from_arrays([*known, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), spans], names=[*given, "lang_pred", "score", "spans"])
        own.forget()  # a worker keeps the model from task to task, but not its words

    given = ["row", *(["text"] if "text" in also else [])]
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(x) for x in also if x != "text")).alias("row")
    known = docs.select(row, F.col("text").cast("string").alias("text"))
    types = ", ".join(f"{x} {known.schema[x].dataType.simpleString()}" for x in given)
    out = known.mapInArrow(tidied(run), f"{types}, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")
    return out.select("row.doc_id", *(x if x == "text" else f"row.{x}" for x in also), "lang_pred", "score", "spans")
