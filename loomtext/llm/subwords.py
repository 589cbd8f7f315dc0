"""Subword ids of whole texts, word by word, with a bounded cache of words.

The vocabulary drops white space and no merge crosses it, so a text's ids are its words' ids in order.  Texts are normalised as
the tokenizer's file says (composed, then lower case) before they are cut into words.  A word is cut into pieces by the file's
own pattern; the pieces of all new words are merged in one call, as each piece ends with an id of the suffix that closes it.
Where ranks give the same merges as the file's pairs do (see `ranks_of`), tiktoken merges them, with a space for the suffix.
Another kind of tokenizer file is used as it is, text by text.
"""

from __future__ import annotations

import importlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import TOKENIZER_PACKAGE, ascii_words

#: Letters that str.lower() treats by their neighbours or expands.
_ODD_CASE = re.compile("[\u0130\u03a3]")
#: The normalisers and the last splitter that `encode` follows.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def vocabulary_path(name: str, package: str = TOKENIZER_PACKAGE) -> str:
    return importlib.import_module(package).path(name)


def normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if _ODD_CASE.search(text) else text.lower()


def piece_pattern(file: dict) -> str | None:
    """The pattern of pieces, if the file is of the kind that can be encoded piece by piece."""
    normalizer, splitter, model = (file.get(x) or {} for x in ("normalizer", "pre_tokenizer", "model"))
    steps = splitter.get("pretokenizers") or []
    known = normalizer.get("normalizers") == NORMAL and len(steps) == 2 and steps[1] == BYTES and model.get("end_of_word_suffix")
    if known and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "Regex" in steps[0]["pattern"]:
        return steps[0]["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")
    return None


def byte_letters() -> dict[str, int]:
    """The byte of each letter that byte-level vocabularies write it as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}


def ranks_of(model: dict) -> dict[bytes, int] | None:
    """Ids by bytes, a last space for the suffix, if merging by them is the same as merging by the model's pairs; else None.

    Pairs go in the order of their ids, but ranks join any two neighbours that make up a known token.  Merges within a token's
    bytes are the same wherever it stands, so if no token of its own ends with a pair that is not its merge, no text has one.
    """
    letters, suffix, vocab = byte_letters(), model["end_of_word_suffix"], model["vocab"]
    plain = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")

    def raw(token: str) -> bytes:
        end = token.endswith(suffix)
        return bytes(letters[c] for c in (token[: -len(suffix)] if end else token)) + b" " * end

    try:
        ranks = {raw(x + end): vocab[x + end] for x in letters for end in ("", suffix)}
        highest, made = max(ranks.values()), {}
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if vocab[left + right] <= highest:
                return None
            token = raw(left + right)
            highest = ranks[token] = vocab[left + right]
            made[token] = (raw(left), raw(right))
    except (KeyError, ValueError):
        return None
    if len(ranks) != 512 + len(model["merges"]) or any(model.get(x) for x in plain):
        return None
    return ranks if all(made_by_pairs(token, ranks, made) for token in made) else None


def made_by_pairs(token: bytes, ranks: dict[bytes, int], made: dict[bytes, tuple[bytes, bytes]]) -> bool:
    """Whether merging the token's bytes by ranks uses known pairs only."""
    parts = [token[i : i + 1] for i in range(len(token))]
    if token[-1:] == b" ":
        parts[-2:] = [token[-2:]]
    while len(parts) > 1:
        best, at = 1 << 60, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if rank < best:
                best, at = rank, i
        if at < 0:
            return True
        left, right = parts[at], parts[at + 1]
        if made.get(left + right) != (left, right):
            return False
        parts[at : at + 2] = [left + right]
    return True


class Known:
    """Ids of words, flat; `at` has each word's number."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.start, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def add(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        self.n, self.ids = np.concatenate([self.n, n]), np.concatenate([self.ids, ids])
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words by number, and the number of each one's."""
        m = self.n[places]
        ends = np.append(0, np.cumsum(m))
        return self.ids[np.repeat(self.start[places] - ends[:-1], m) + np.arange(int(ends[-1]))], m


class WordBpe:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers.  Of words it keeps the last `cached` to twice as many."""

    def __init__(self, path: str, cached: int = 250_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.cached = cached
        self.forget()
        pattern = piece_pattern(file)
        self.pieces = regex.compile(pattern + "|\n") if pattern else None
        ranks = ranks_of(file["model"]) if pattern else None
        self.by_ranks = None
        if not pattern:
            self.whole = Tokenizer.from_file(path)
            self.whole.encode_special_tokens = True
        else:
            suffix, vocabulary = file["model"]["end_of_word_suffix"], file["model"]["vocab"]
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        if ranks:
            import tiktoken

            self.by_ranks = tiktoken.Encoding("ranks", pat_str=r"[^ \n]+ ", mergeable_ranks=ranks, special_tokens={})
        elif pattern:
            bare = file | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, BYTES]}}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            self.bare.encode_special_tokens = True

    def forget(self) -> None:
        self.before, self.now = Known(), Known()

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words without ASCII white space, and the number of each word's."""
        found = self.pieces.findall("\n".join(words) + "\n")
        parts = [" ".join(found[at : at + 8192]) for at in range(0, len(found), 8192)]
        if self.by_ranks:
            ids = np.concatenate([np.array(self.by_ranks.encode_ordinary(x + " "), "<u4") for x in parts])
        else:
            ids = np.concatenate([np.array(x.ids, "<u4") for x in self.bare.encode_batch_fast(parts, add_special_tokens=False)])
        closed = np.append(0, np.flatnonzero(self.closes[ids]) + 1)
        # Every word ends where as many pieces end as stand before its mark.
        marks = np.fromiter((i for i, x in enumerate(found) if x == "\n"), np.int64, len(words)) - np.arange(len(words))
        return ids, np.diff(np.append(0, closed[marks]))

    def places(self, words: list[str]) -> np.ndarray:
        """Of different words, in `now`."""
        if len(self.now.at) > self.cached:
            self.before, self.now = self.now, Known()
        at = self.now.at
        new = [w for w in words if w not in at]
        if self.before.at and new:
            again = [w for w in new if w in self.before.at]
            self.now.add(again, *self.before.of(self.before.places(again)))
            new = [w for w in new if w not in self.before.at]
        if new:
            self.now.add(new, *self.learn(new))
        return self.now.places(words)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.pieces:
            return [np.array(x.ids, "<u4").tobytes() for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        # Other white space than ASCII's stays within words, where no piece has it.
        flat, n = ascii_words(pa.array(list(map(normal, texts)), pa.string()))
        if not len(flat):
            return [b""] * len(texts)
        coded = flat.dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), "\n")
        at = self.places(joined[0].as_py().split("\n"))  # this may change `now`
        ids, m = self.now.of(at[np.asarray(coded.indices)])
        ends, raw = np.append(0, np.cumsum(m)), ids.tobytes()
        cuts = (4 * ends[np.append(0, np.cumsum(n))]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_ENCODERS: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One encoder for each Python worker, which serves many tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]
