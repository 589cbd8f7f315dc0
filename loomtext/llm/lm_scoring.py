"""Language-model scores of whole texts, beside a unigram base.

Tokens of the base are ASCII-lower-cased words and one end; its counts cover every training document.  The model is a causal
self-attention network over subword ids (a public byte-level vocabulary, each word with its leading space, continued by up to
3,000 merges that are most frequent in the training documents' 50,000 or fewer most frequent words) and gives the distribution
of the next id itself: a softmax over classes of ids and one over the ids of a class; frequent ids lie in short classes.  Ids that no training document has share one place, evenly, so all probabilities sum to one.

The network is trained in numpy.  Its output biases start as the log counts of all training documents.  It is warmed up on the
driver on at most `fit_windows` windows of about `fit_docs` documents, then trained by all executors on every id of every
training document, once, in `passes` passes of disjoint documents (dealt by hash): each partition trains the model on its own,
and after a pass their weights are averaged.  Texts are cut into ids once and stored for the passes and the scores.  They are scored in windows of `CONTEXT + STRIDE` ids that overlap by CONTEXT, so
each id is scored once, with batched attention under a causal mask.

For the base the frequent words' counts are broadcast (`head_words` at most); a text's other words meet theirs in a join.

Nulls: a null text counts as empty and has its end as only token; a null doc_id counts as held out.  Equal rows are scored each
for itself.  Long texts are scored whole.  With no training documents all counts are zero and the model is near uniform.  Other
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import math
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .byte_bpe import load_ranks, public_pattern
from .common import ascii_words, offsets, partition_id, roomy, slices, stored, tidied
from .subwords import vocabulary_path

CONTEXT, STRIDE = 16, 32
WINDOW = CONTEXT + STRIDE
#: A key is seen from its own place on.  One row for all places, as one long row is multiplied faster than many short ones.
SEEN = (np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32).reshape(1, -1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts, flat, and each text's number of them."""
    return ascii_words(pc.ascii_lower(texts.fill_null("")))


def word_counts(texts: DataFrame) -> DataFrame:
    """word binary, n long, of the one string column of `texts`."""

    def run(batches):
        for batch in slices(batches, 8192, 16 << 20):
            found = split(batch.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.binary()), found.field(1)], names=["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@functools.lru_cache(2)
def subwords(path: str, more: tuple[bytes, ...] = ()) -> Subwords:
    """One for each Python worker, which serves many tasks."""
    return Subwords(path, more)


class Subwords:
    """Ids of words, each with its leading space; the pieces `more` are merged after those of the file."""

    def __init__(self, path: str, more: tuple[bytes, ...] = ()):
        import tiktoken

        ranks = load_ranks(path)
        first = max(ranks.values()) + 1
        ranks |= {piece: first + i for i, piece in enumerate(more)}
        self.size = first + len(more)
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_pattern(), mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for piece, i in ranks.items() if piece[:1] == b" "]] = True

    def encode(self, words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each word's.  No word has a space, so an id that begins with one begins a word."""
        words, out = pa.array(words, pa.string()) if isinstance(words, list) else words, [np.zeros(0, np.int64)]
        for at in range(0, len(words), 4096):
            some = words.slice(at, 4096)
            line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
            out.append(self.encoding.encode_to_numpy(" " + line, disallowed_special=()).astype(np.int64))
        ids = np.concatenate(out)
        return ids, np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))


def continued(words: dict[str, int], path: str, number: int, least: int = 100) -> tuple[bytes, ...]:
    """The pieces of up to `number` further merges of a vocabulary: each time the pair that is most frequent in the counted words, `least` times at least."""
    import regex

    encoding, pattern, counted = subwords(path).encoding, regex.compile(public_pattern()), Counter()
    for word, n in words.items():
        for piece in pattern.findall(" " + word):  # no merge crosses these
            counted[piece] += n
    names: dict[int, bytes] = {}
    pieces = [[names.get(i) or names.setdefault(i, encoding.decode_single_token_bytes(i)) for i in encoding.encode_ordinary(x)] for x in counted]
    n, pairs, holders = list(counted.values()), Counter(), defaultdict(set)
    for i, parts in enumerate(pieces):
        for pair in zip(parts, parts[1:]):
            pairs[pair] += n[i]
            holders[pair].add(i)
    heap = [(-n, pair) for pair, n in pairs.items()]
    heapq.heapify(heap)
    found: dict[bytes, None] = {}
    while heap and len(found) < number and -heap[0][0] >= least:
        count, pair = heapq.heappop(heap)
        if pairs.get(pair, 0) != -count:
            continue  # it has changed since, and stands in the heap anew
        whole, touched = pair[0] + pair[1], set()
        found[whole] = None
        for i in holders.pop(pair):
            parts, merged = pieces[i], []
            for part in parts:
                if merged and (merged[-1], part) == pair:
                    merged[-1] = whole
                else:
                    merged.append(part)
            for sign, own in ((-1, parts), (1, merged)):
                for x in zip(own, own[1:]):
                    pairs[x] += sign * n[i]
                    touched.add(x)
            for x in zip(merged, merged[1:]):
                holders[x].add(i)
            pieces[i] = merged
        for x in touched:
            if pairs[x] > 0 and x != pair:
                heapq.heappush(heap, (-pairs[x], x))
        del pairs[pair]
    return tuple(found)


def id_counts(counts: DataFrame, path: str, more: tuple[bytes, ...] = ()) -> DataFrame:
    """id, n over all counted words."""

    def run(batches):
        coder = subwords(path, more)
        total = np.zeros(coder.size)
        for batch in slices(batches, 50_000):
            ids, n = coder.encode(batch.column(0).cast(pa.string()))
            total += np.bincount(ids, np.repeat(np.asarray(batch.column(1), dtype=np.float64), n), coder.size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "n"])

    return counts.select("word", "n").mapInArrow(run, "id int, n double").groupBy("id").agg(F.sum("n").alias("n"))


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For streams of so many targets: each window's stream, its input places (below 0 or past the end: none) and which targets count."""
    k = -(-lengths // STRIDE)
    own = np.repeat(np.arange(len(lengths)), k)
    start = (np.arange(len(own)) - (np.cumsum(k) - k)[own]) * STRIDE
    place = start[:, None] + np.arange(-CONTEXT, STRIDE)
    return own, place, place[:, CONTEXT:] < lengths[own][:, None]


def streams(ids: np.ndarray, n: np.ndarray, end: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts of n dense ids each, as streams end, ids, end: inputs, targets, which targets count, and each window's text."""
    first = np.cumsum(n + 2) - (n + 2) + 1
    stream = np.full(int((n + 2).sum()) + 1, end, np.int32)
    stream[0] = pad
    stream[np.repeat(first + 1 - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    own, place, counts = windows(n + 1)
    inside = (place >= 0) & (place <= n[own][:, None])
    at = np.where(inside, first[own][:, None] + place, 0)
    return stream[at], np.where(counts, stream[np.where(counts, at[:, CONTEXT:] + 1, 0)], end), counts, own


def runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of runs of sorted values."""
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return list(zip(values[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(values)], strict=True))


def softmax(z: np.ndarray) -> np.ndarray:
    w = np.exp(z - z.max(-1, keepdims=True))
    w /= w.sum(-1, keepdims=True)
    return w


def classes(mass: np.ndarray) -> np.ndarray:
    """Where classes of ids in a row begin, and the end.  A class is full when its part of all mass times its size is one: then a further
    class costs each id as much as longer classes would, so frequent ids lie in short ones."""
    ends, begins = np.cumsum(mass) / mass.sum(), [0]
    while begins[-1] < len(mass):
        a = begins[-1]
        full = (ends[a:] - (ends[a - 1] if a else 0)) * np.arange(1, len(mass) - a + 1) >= 1
        begins.append(a + int(full.argmax()) + 1 if full.any() else len(mass))
    return np.array(begins)


class Attention:
    """One causal head and one hidden layer; the next id by a softmax over classes and one within the class.

    Dense ids: those that training documents have, the most frequent first, then `unseen`, `end` (which also begins each text) and `pad`.
    Some of the first two and the ids in a row are a class.  `more` are the vocabulary's further pieces.
    """

    def __init__(self, corpus: np.ndarray, ends: float, width: int = 16, seed: int = 7, more: tuple[bytes, ...] = ()):
        ids = np.argsort(-corpus, kind="stable")[: np.count_nonzero(corpus)]
        self.more, self.unseen, self.end, self.pad = more, len(ids), len(ids) + 1, len(ids) + 2
        self.dense = np.full(len(corpus), self.unseen, np.int32)
        self.dense[ids] = np.arange(len(ids))
        self.others = max(1, len(corpus) - len(ids))  # they share the place `unseen`
        mass = np.append(corpus[ids], [1, ends]) + 0.5
        self.begin = classes(mass)
        self.group = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))
        top = np.add.reduceat(mass, self.begin[:-1])
        rng, d = np.random.default_rng(seed), width
        normal = lambda *shape: rng.normal(size=shape) / math.sqrt(shape[0])
        p = {
            "e": rng.normal(size=(len(ids) + 3, d)) * 0.5, "pos": rng.normal(size=(WINDOW, d)) * 0.2, "q": normal(d, d), "k": normal(d, d), "v": normal(d, d), "o": normal(d, d) * 0.5,
            "w1": normal(d, 2 * d), "b1": np.zeros(2 * d), "w2": normal(2 * d, d) * 0.5, "c": normal(d, len(top)) * 0.3, "cb": np.log(top / top.sum()),
            "u": rng.normal(size=(len(mass), d)) * 0.3 / math.sqrt(d), "ub": np.log(mass / top[self.group]),
        }
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def forward(self, ids: np.ndarray) -> dict:
        p, d = self.p, self.p["q"].shape[0]
        x = p["e"][ids]
        x += p["pos"]
        own = np.ascontiguousarray(x[:, CONTEXT:])
        # What is the same for all places is one product; numpy would make one for each window.
        # Queries meet keys as own @ (q k') @ x', and values pass `o` before they are mixed: the same sums by fewer products.
        q = all_places(own, p["q"] @ p["k"].T / np.float32(math.sqrt(d)))
        # A last column of ones, whose mean by the weights is their sum.
        v = np.ones((*x.shape[:2], d + 1), x.dtype)
        np.matmul(x.reshape(-1, d), p["v"] @ p["o"], out=v.reshape(-1, d + 1)[:, :d])
        a = q @ x.transpose(0, 2, 1)
        visible_exp(a, ids, self.pad)
        o = a @ v
        share = 1 / o[:, :, d:]
        o = o[:, :, :d] * share
        h = o + own
        r = all_places(h, p["w1"])
        r += p["b1"]
        np.maximum(r, 0, out=r)
        y = all_places(r, p["w2"])
        y += h
        return {"x": x, "own": own, "q": q, "v": v, "a": a, "share": share, "o": o, "h": h, "r": r, "y": y}

    def log(self, y: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probabilities of dense targets after hidden states; that of `unseen` is one of its ids'."""
        p, c = self.p, self.group[targets]
        out = np.log(softmax(y @ p["c"] + p["cb"])[np.arange(len(c)), c])
        for i, k in enumerate(c):
            a, b = self.begin[k], self.begin[k + 1]
            out[i] += np.log(softmax(p["u"][a:b] @ y[i] + p["ub"][a:b])[targets[i] - a])
        return out - np.where(targets == self.unseen, math.log(self.others), 0)

    def train(self, ids: np.ndarray, targets: np.ndarray, counts: np.ndarray, steps: int, batch: int = 64, rate: float = 0.006, seed: int = 11, warm: int = 20) -> None:
        """Adam on the mean negative log likelihood of the targets that count.  No window comes again before all others came."""
        rng, names = np.random.default_rng(seed), list(self.p)
        # All weights in a row, so that a step works on pieces that stay in the processor's cache.
        flat = np.concatenate([x.ravel() for x in self.p.values()])
        cuts = np.cumsum([x.size for x in self.p.values()])[:-1]
        self.p = {k: x.reshape(v.shape) for (k, v), x in zip(self.p.items(), np.split(flat, cuts), strict=True)}
        first, second, spare, room = np.zeros_like(flat), np.zeros_like(flat), np.empty(16384, flat.dtype), np.empty(16384, flat.dtype)
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1 if len(ids) else 1):
            order = order if len(order) else rng.permutation(len(ids))
            at, order = order[:batch], order[batch:]
            pace = rate * min(1, step / warm) * (1 - step / (steps + 1))
            found = self.gradient(ids[at], targets[at], counts[at])
            g = np.concatenate([found[k].ravel() for k in names])
            for a in range(0, len(flat), len(spare)):
                own, m, v = g[a : a + len(spare)], first[a : a + len(spare)], second[a : a + len(spare)]
                t, u = spare[: len(own)], room[: len(own)]
                m *= 0.9
                m += np.multiply(own, 0.1, out=t)
                v *= 0.98
                np.multiply(own, own, out=t)
                t *= 0.02
                v += t
                np.sqrt(np.multiply(v, 1 / (1 - 0.98**step), out=t), out=t)
                t += 1e-6
                flat[a : a + len(spare)] -= np.divide(np.multiply(m, pace / (1 - 0.9**step), out=u), t, out=u)

    def gradient(self, ids: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> dict:
        p, s, d = self.p, self.forward(ids), self.p["q"].shape[0]
        flat = lambda t: t.reshape(-1, t.shape[-1])
        # The targets that count, in the order of their classes, which is that of their ids.
        at = np.flatnonzero(counts.ravel())
        own = narrow(targets.ravel()[at], self.pad)
        order = np.argsort(own, kind="stable")
        at, own, scale = at[order], own[order].astype(np.int64), np.float32(1 / max(1, len(at)))
        group = self.group[own]
        # A last column of ones takes the biases along.
        y = np.ones((len(at), d + 1), s["y"].dtype)
        y[:, :d] = flat(s["y"])[at]

        ones, rows = np.ones(max(len(p["cb"]), int(np.diff(self.begin).max())), y.dtype), np.arange(len(at))

        def less_one(z, one):  # what a softmax has above its target, scaled
            bounded_exp(z)
            z *= (scale / (z @ ones[: z.shape[1]]))[:, None]
            z[rows[: len(z)], one] -= scale
            return z

        dz = less_one(y @ np.concatenate([p["c"], p["cb"][None]]), group)
        top, u, du = y.T @ dz, np.concatenate([p["u"], p["ub"][:, None]], 1), np.zeros((len(p["u"]), d + 1), p["u"].dtype)
        out = {"c": top[:d], "cb": top[d]}
        dys = dz @ p["c"].T
        for k, a, b in runs(group):
            begin, end = self.begin[k], self.begin[k + 1]
            if end - begin > 1:
                dm = less_one(y[a:b] @ u[begin:end].T, own[a:b] - begin)
                np.matmul(dm.T, y[a:b], out=du[begin:end])
                dys[a:b] += dm @ p["u"][begin:end]
        out["u"], out["ub"] = du[:, :d], du[:, d]
        dy = np.zeros_like(s["y"])
        flat(dy)[at] = dys
        out["w2"] = flat(s["r"]).T @ flat(dy)
        dm = all_places(dy, p["w2"].T)
        dm *= s["r"] > 0
        out["w1"], out["b1"] = flat(s["h"]).T @ flat(dm), np.ones(dm.size // (2 * d), dm.dtype) @ flat(dm)
        dh = all_places(dm, p["w1"].T)
        dh += dy
        do = np.empty((*dh.shape[:2], d + 1), dh.dtype)
        np.multiply(dh, s["share"], out=do[:, :, :d])
        np.negative(np.einsum("ijk,ijk->ij", do[:, :, :d], s["o"]), out=do[:, :, d])  # the mean by the weights a
        ds = do @ s["v"].transpose(0, 2, 1)
        ds *= s["a"]
        dq, dv = ds @ s["x"], s["a"].transpose(0, 2, 1) @ do[:, :, :d]
        met, mixed = flat(s["own"]).T @ flat(dq) / np.float32(math.sqrt(d)), flat(s["x"]).T @ flat(dv)
        out["q"], out["k"], out["v"], out["o"] = met @ p["k"], met.T @ p["q"], mixed @ p["o"].T, p["v"].T @ mixed
        dx = all_places(dv, (p["v"] @ p["o"]).T)
        dx += ds.transpose(0, 2, 1) @ s["q"]
        dh += all_places(dq, p["k"] @ p["q"].T / np.float32(math.sqrt(d)))
        dx[:, CONTEXT:] += dh
        out["pos"] = dx.sum(0)
        # Of each id the sum over its places; only a flat array is added to fast.
        out["e"] = np.zeros_like(p["e"])
        np.add.at(out["e"].reshape(-1), (ids.reshape(-1, 1).astype(np.int64) * d + np.arange(d)).ravel(), dx.ravel())
        return out


def all_places(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """x @ by for windows of places x, as one product."""
    return (x.reshape(-1, x.shape[-1]) @ by).reshape(*x.shape[:-1], by.shape[1])


def narrow(ids: np.ndarray, most: int) -> np.ndarray:
    """Dense ids as a kind that numpy sorts by digits, if they fit."""
    return ids.astype(np.uint16 if most < 1 << 16 else np.int64)


def visible_exp(a: np.ndarray, ids: np.ndarray, pad: int) -> None:
    """In place: the weights of windows' places, not yet shares, zero for later keys and `pad`."""
    bounded_exp(a)
    flat = a.reshape(len(a), -1)
    flat *= SEEN
    if (padded := (ids[:, 0] == pad) | (ids[:, -1] == pad)).any():
        a[padded] *= (ids[padded] != pad)[:, None, :]


def bounded_exp(z: np.ndarray) -> None:
    """In place; no sum of a row can overflow or vanish, so no maximum is sought."""
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)


class Scorer:
    """The model as tables: each id's input, which is also its key, its query and its value lie in one row, so a window takes one gather."""

    def __init__(self, model: Attention):
        p, d = model.p, model.p["q"].shape[0]
        self.dense, self.unseen, self.end, self.pad, self.width, self.group, self.begin = model.dense, model.unseen, model.end, model.pad, d, model.group, model.begin
        project = np.concatenate([np.eye(d), p["q"] @ p["k"].T / math.sqrt(d), p["v"] @ p["o"]], 1).astype(np.float32)
        self.table, self.pos = (np.concatenate([p[k] @ project, np.full((len(p[k]), 1), one, np.float32)], 1) for k, one in (("e", 1), ("pos", 0)))
        self.w1, self.b1, self.w2, self.c, self.cb, self.u, self.ub = (p[k] for k in ("w1", "b1", "w2", "c", "cb", "u", "ub"))
        self.one_of = math.log10(model.others)

    def hidden(self, ids: np.ndarray) -> np.ndarray:
        d = self.width
        x = self.table[ids]
        x += self.pos
        s = x[:, CONTEXT:, d : 2 * d] @ x[:, :, :d].transpose(0, 2, 1)
        visible_exp(s, ids, self.pad)
        h = s @ x[:, :, 2 * d :]  # the last column is 1, so its sum is that of the weights
        h = h[:, :, :d] / h[:, :, d:]
        h += x[:, CONTEXT:, :d]
        h = h.reshape(-1, d)
        m = h @ self.w1
        m += self.b1
        np.maximum(m, 0, out=m)
        h += m @ self.w2
        return h

    def windows_log10(self, ids: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each target, zero where it doesn't count."""
        out = np.zeros(targets.size)
        ones = np.ones(max(self.c.shape[1], int(np.diff(self.begin).max())), np.float32)
        for at in range(0, len(ids), 1024):
            y = np.concatenate([self.hidden(ids[k : min(k + 32, at + 1024)]) for k in range(at, min(at + 1024, len(ids)), 32)])
            order = np.flatnonzero(counts[at : at + 1024].ravel())
            flat = targets[at : at + 1024].ravel()[order]
            by_id = np.argsort(narrow(flat, self.pad), kind="stable")
            order, flat = order[by_id], flat[by_id]
            y, group = y[order], self.group[flat]
            p = np.empty(len(y), np.float32)
            for a in range(0, len(y), 2048):
                z = y[a : a + 2048] @ self.c
                z += self.cb
                bounded_exp(z)
                p[a : a + 2048] = z[np.arange(len(z)), group[a : a + 2048]] / (z @ ones[: z.shape[1]])
            for k, a, b in runs(group):
                begin, end = self.begin[k], self.begin[k + 1]
                if end - begin > 1:
                    z = y[a:b] @ self.u[begin:end].T
                    z += self.ub[begin:end]
                    bounded_exp(z)
                    p[a:b] *= z[np.arange(b - a), flat[a:b] - begin] / (z @ ones[: end - begin])
            found = np.log10(np.maximum(p, np.float32(1e-37)))
            found[flat == self.unseen] -= self.one_of
            out[at * STRIDE + order] = found
        return out.reshape(targets.shape)

    def score(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probabilities of texts of n dense ids each, ends included."""
        logs, ends = np.zeros(len(n)), np.cumsum(n)
        begin = 0
        while begin < len(n):  # texts of about so many ids at once; a longer one for itself
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 200_000, "right")))
            at, targets, counts, own = streams(ids[ends[begin] - n[begin] : ends[end - 1]], n[begin:end], self.end, self.pad)
            logs[begin:end] = np.bincount(own, self.windows_log10(at, targets, counts).sum(1), end - begin)
            begin = end
        return logs


class Words:
    """What is known of words: base log10 (0 for those that need the join), whether counted, and dense ids.  When full it keeps the half that it met first."""

    def __init__(self, coder: Subwords, dense: np.ndarray, head: dict[str, int], size: int, cached: int = 200_000):
        self.coder, self.dense, self.cached = coder, dense, cached
        self.head, self.logs = pa.array(list(head), pa.string()), np.log10((np.array([*head.values(), -1]) + 1.0).clip(1) / max(1, size))
        self.known = pa.array([], pa.string())
        self.base, self.counted, self.n, self.start, self.ids = np.zeros(0), np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def keep(self, most: int):
        self.ids = self.ids[: self.start[most]].copy()
        self.known = pa.concat_arrays([self.known[:most]])
        self.base, self.counted, self.n, self.start = (x[:most].copy() for x in (self.base, self.counted, self.n, self.start))

    def places(self, words: pa.Array) -> np.ndarray:
        """Of different words."""
        if len(self.known) > self.cached:
            self.keep(self.cached // 2)
        found = np.array(pc.index_in(words, value_set=self.known).fill_null(-1), np.int64)
        if (new := found < 0).any():
            found[new] = len(self.known) + np.arange(new.sum())
            names = words.filter(pa.array(new))
            ids, n = self.coder.encode(names)
            c = np.array(pc.index_in(names, value_set=self.head).fill_null(-1), np.int64)
            self.base = np.concatenate([self.base, np.where(c >= 0, self.logs[c], 0)])
            self.counted = np.concatenate([self.counted, np.where(c >= 0, 1, -1).astype(np.int8)])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            self.n = np.concatenate([self.n, n])
            self.ids = np.concatenate([self.ids, self.dense[ids]])
            self.known = pa.concat_arrays([self.known, names])
        return found

    def subwords(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The dense ids of texts of n words each, flat, and each text's number of them."""
        m = self.n[at]
        ends = np.concatenate([[0], np.cumsum(m)])
        place = np.repeat(self.start[at] - ends[:-1], m) + np.arange(int(ends[-1]))
        return self.ids[place], np.diff(np.concatenate([[0], ends[np.cumsum(n)]]))


def texts_as_ids(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Each word's place, each text's number of words, dense ids, each text's number of ids, and the words as a dictionary."""
    flat, n = split(texts)
    coded = flat.dictionary_encode()
    places = words.places(coded.dictionary)
    at = places[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.int64)
    return at, n, *words.subwords(at, n), coded


def as_binary(ids: np.ndarray, n: np.ndarray, pad: int) -> pa.Array:
    """Texts of n dense ids each, as bytes."""
    kind = id_kind(pad)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.append(0, np.cumsum(n)) * kind.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(kind).tobytes())])


def from_binary(column: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense ids, flat, and each text's number of them."""
    at, kind = offsets(column), id_kind(pad)
    data = column.buffers()[2]
    found = np.frombuffer(data, kind, (at[-1] - at[0]) // kind.itemsize, at[0]) if data and at[-1] > at[0] else np.zeros(0, kind)
    return found.astype(np.int32), np.diff(at) // kind.itemsize


def id_kind(pad: int) -> np.dtype:
    return np.dtype("<u2" if pad < 1 << 16 else "<u4")


def pass_of(passes: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text", F.lit("pass")), F.lit(passes)).cast("int")


def passed(train: DataFrame, model: Attention, path: str, passes: int, number: int, batch: int = 256, rate: float = 0.002) -> dict:
    """Weights after one of `passes` passes: every partition trains on all its documents of the pass, and what they reach is averaged by windows.

    `train` has texts, or the ids and the pass of each that `encoded` found.
    """
    shared = train.sparkSession.sparkContext.broadcast(model)
    names, ready = sorted(model.p), "ids" in train.columns

    def run(batches):
        import copy

        roomy()
        own, seen, held = copy.deepcopy(shared.value), 0, []
        words = None if ready else Words(subwords(path, own.more), own.dense, {}, 1)
        for part in slices(batches, 256, 1 << 19 if ready else 1 << 20):
            ids, n = from_binary(part.column(0), own.pad) if ready else texts_as_ids(part.column(0), words)[2:4]
            at, targets, counts, _ = streams(ids, n, own.end, own.pad)
            if len(at):
                # Each window once; few windows still make some steps.
                size = max(64, min(batch, len(at) // 16))
                own.train(at, targets, counts, -(-len(at) // size), size, rate, seed=seen, warm=4)
                seen += len(at)
        if seen:
            for k in names:
                flat = own.p[k].ravel().astype(np.float64) * seen
                held += [(f"{k} {i:06d}", flat[i : i + 65536].tobytes(), seen) for i in range(0, len(flat), 65536)]
        yield to_batch([[x[i] for x in held] for i in range(3)], PART)

    def summed(batches):
        total: dict = {}
        for part in slices(batches):
            for k, own, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                now = total.get(k, (0, 0))
                total[k] = now[0] + np.frombuffer(own), now[1] + n
        yield to_batch([list(total), [x[0].tobytes() for x in total.values()], [x[1] for x in total.values()]], PART)

    chosen = train.where((F.col("pass") if ready else pass_of(passes)) == number).select("ids" if ready else "text")
    kind = "part string, own binary, n long"
    found = chosen.mapInArrow(tidied(run), kind).repartition(16, "part").mapInArrow(summed, kind).collect()  # as many floats as the model has
    out = {}
    for k in names:
        own = sorted((r.part, bytes(r.own), r.n) for r in found if r.part.split()[0] == k)
        if own:
            out[k] = np.concatenate([np.frombuffer(x) / n for _, x, n in own]).reshape(model.p[k].shape).astype(np.float32)
    return out


_WORDS: dict = {}
PART = [("part", pa.string()), ("own", pa.binary()), ("n", pa.int64())]
#: Of a text: its ids and what the frequent words tell.  Of each other word of it: how often it stands there.
CODED = [("key", pa.int64()), ("doc_id", pa.int64()), ("pass", pa.int32()), ("word", pa.binary()), ("tf", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("ids", pa.binary())]
OUT = [("key", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]


def encoded(docs: DataFrame, model: Attention, path: str, frequent: dict[str, int], size: int, end_base: float, end_known: int) -> DataFrame:
    """CODED of doc_id, text, pass; every text is cut into words and ids once, for all passes and the scores."""
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((model.more, model.dense, model.pad, frequent))

    def run(batches):
        more, dense, pad, head = shared.value
        if name not in _WORDS:
            _WORDS.clear()
            _WORDS[name] = Words(subwords(path, more), dense, head, size)
        words, key = _WORDS[name], partition_id() << 33
        for batch in slices(batches, 1024, 2 << 20):
            at, n, ids, lengths, coded = texts_as_ids(batch.column(1), words)
            texts = len(n)
            doc = np.repeat(np.arange(texts), n)
            base = np.bincount(doc, words.base[at], texts) + end_base
            known = np.bincount(doc, words.counted[at] > 0, texts).astype(np.int64) + end_known
            yield to_batch([key + np.arange(texts), batch.column(0), batch.column(2), None, None, n + 1, known, base, as_binary(ids, lengths, pad)], CODED, texts)
            rare = words.counted[at] < 0
            if rare.any():
                pairs, tf = np.unique(doc[rare] * len(coded.dictionary) + np.asarray(coded.indices)[rare], return_counts=True)
                names = coded.dictionary.cast(pa.binary()).take(pa.array(pairs % len(coded.dictionary)))
                yield to_batch([key + pairs // len(coded.dictionary), None, None, names, tf, None, None, None, None], CODED, len(pairs))
            key += texts

    return stored(docs.mapInArrow(tidied(run), "key long, doc_id long, pass int, word binary, tf long, n_tokens long, known long, base double, ids binary"), "ids")


def score(docs: DataFrame, fit_docs: int = 2000, fit_windows: int = 20_000, head_words: int = 100_000, steps: int = 400, passes: int = 2, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    path = vocabulary or vocabulary_path("byte_bpe_multi_50k.tiktoken")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = docs.where(~held_out(F.col("doc_id")))
    n_train = train.count()
    counts = stored(word_counts(train.select("text")), "words")
    total = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, size = (total[0] or 0) + n_train, (total[0] or 0) + n_train + total[1] + (n_train > 0) + 1

    model = fitted(train, n_train, counts, path, fit_docs, fit_windows, steps)
    frequent = {bytes(r.word).decode(): r.n for r in lexicon.head(counts, head_words).collect()}  # head_words rows at most
    least = min(frequent.values(), default=1 << 62)
    number = F.when(~held_out(F.col("doc_id")), pass_of(passes))
    coded = encoded(docs.select("doc_id", "text", number.alias("pass")), model, path, frequent, size, math.log10((n_train + 1) / max(1, size)), int(n_train > 0))
    for number in range(passes):
        model.p |= passed(coded, model, path, passes, number)
    shared = spark.sparkContext.broadcast(Scorer(model))

    def run(batches):
        roomy()
        scorer = shared.value
        for batch in slices(batches, 1024, 1 << 20):
            key, doc_id, n_tokens, known, base, ids = batch.columns
            yield to_batch([key, doc_id, [b" %d" % k for k in key.to_pylist()], n_tokens, known, base, scorer.score(*from_binary(ids, scorer.pad))], OUT)

    # A text's own row has a word that no text has, so it goes to the join like the rest and meets no count.
    texts = coded.where(F.col("ids").isNotNull()).select("key", "doc_id", "n_tokens", "known", "base", "ids")
    texts = texts.mapInArrow(tidied(run), "key long, doc_id long, word binary, n_tokens long, known long, base double, score double")
    parts = texts.unionByName(coded.where(F.col("ids").isNull()).select("key", "word", "tf"), allowMissingColumns=True)
    rare = counts.where(F.col("n") < F.lit(least))
    met = parts.join(rare, "word", "left").groupBy("key").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("tf"))), F.lit(0))).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(F.col("tf") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(max(1, size))))), F.lit(0.0))).alias("base_score"),
        F.max("score").alias("score"),
    )
    return met.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def to_batch(columns: list, kinds: list, n: int | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[x for x, _ in kinds])


def fitted(train: DataFrame, n_train: int, counts: DataFrame, path: str, fit_docs: int, fit_windows: int, steps: int, merges: int = 3000) -> Attention:
    """A model of a vocabulary continued on the corpus, with its id counts as biases, warmed up on windows of a hash sample of training documents."""
    more = continued({bytes(r.word).decode(): r.n for r in lexicon.head(counts, 50_000).orderBy("word").collect()}, path, merges)
    coder = subwords(path, more)
    corpus = np.zeros(coder.size)
    for r in id_counts(counts, path, more).collect():  # as many rows as the vocabulary has ids at most
        corpus[r.id] = r.n
    model = Attention(corpus, n_train, more=more)
    part = min(1.0, 1.2 * fit_docs / max(1, n_train))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30))
    texts = train.where(draw < int(part * (1 << 30))).orderBy(draw, "doc_id", "text").limit(fit_docs).select("text").toArrow()["text"].combine_chunks()
    _, _, ids, n, _ = texts_as_ids(texts if isinstance(texts, pa.Array) else pa.array([], pa.string()), Words(coder, model.dense, {}, 1))
    at, targets, counts, _ = streams(ids, n, model.end, model.pad)
    chosen = np.sort(np.random.default_rng(5).permutation(len(at))[:fit_windows])
    model.train(at[chosen], targets[chosen], counts[chosen], steps)
    return model
