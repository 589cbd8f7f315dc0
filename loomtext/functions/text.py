"""Text functions, Column to Column.  A null input gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII and CJK punctuation that answers are stripped of.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CJK_PUNCTUATION = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."
SPACE = "(?U)\\s+"


def once(then: Callable[..., Column], *values: Column) -> Column:
    """then(*values), each value evaluated once: what a lambda uses would else be evaluated anew for each element."""
    held = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(held, lambda x: then(*[x[f"v{i}"] for i in range(len(values))])), F.lit(0))


def words(text: Column) -> Column:
    """Split at Unicode white space, without empties."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and English articles, single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.array_join(words(F.regexp_replace(bare, "(?U)\\b(a|an|the)\\b", " ")), " ")


def answer_tokens(text: Column) -> Column:
    return words(normalize_answer(text))


def normalize_cjk_answer(text: Column) -> Column:
    """Lower case, without ASCII and CJK punctuation and any white space."""
    return F.regexp_replace(F.translate(F.lower(text), PUNCTUATION + CJK_PUNCTUATION, ""), SPACE, "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def first_line(text: Column) -> Column:
    """The first line after leading line ends."""
    return F.substring_index(F.ltrim(text, F.lit("\n")), "\n", 1)


def stripped_first_line(text: Column) -> Column:
    return strip(F.substring_index(text, "\n", 1))


def before(text: Column, *marks: str) -> Column:
    """What stands before the first of each mark."""
    for mark in marks:
        text = F.substring_index(text, mark, 1)
    return text


def lenient_match(target: Column, output: Column) -> Column:
    """Whether the lower-cased target is in the lower-cased output's first sentence."""
    return F.contains(before(F.lower(output), ".", "<context>", "<example>"), F.lower(target))


def preprocess_output(output: Column, strict: bool = False) -> Column:
    """Lower-cased, up to the first sentence, context, example or question; strict: a question ends it only if it is still in capitals, which it never is."""
    marks = (".", "<context>", "<example>") if strict else (".", "<context>", "<example>", "question")
    return before(F.lower(output), *marks)


def choice_answer(output: Column) -> Column:
    """A to D, after `The correct answer is`, in brackets or not; null if there is none."""
    bare = F.replace(output, F.lit("*"), F.lit(""))
    return F.coalesce(*[F.nullif(F.regexp_extract(bare, p, 1), F.lit("")) for p in (r"The correct answer is \(([A-D])\)", "The correct answer is ([A-D])")])


def cut_at_stop(text: Column, stop: str = "<|eot_id|>") -> Column:
    return before(text, stop)


def length_penalty(text: Column) -> Column:
    return F.least(F.lit(1.0), 0.01 * F.size(words(text)))


def term_set(text: Column) -> Column:
    """Distinct lower-cased words: the terms where no language tool is injected."""
    return F.array_distinct(words(F.lower(text)))


def split_layout(text: Column, paragraphs: bool = False) -> Column:
    """struct(context, question): lines without two at either end and the last line, or all paragraphs but the last, and that."""
    if paragraphs:
        parts = F.split(text, "\n\n")
        return F.struct(strip(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "\n\n")).alias("context"), strip(F.element_at(parts, -1)).alias("question"))
    lines = F.split(text, "\n")
    return F.struct(strip(F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 4, F.lit(0))), "\n")).alias("context"), strip(F.element_at(lines, -1)).alias("question"))


def run_tag(path: Column, joint: str = "/") -> Column:
    """The last two parts of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), joint)


def file_stem(name: Column) -> Column:
    """Up to the first dot."""
    return F.substring_index(name, ".", 1)


def output_name(path: Column, name: Column) -> Column:
    """First folder and stem."""
    return F.concat_ws("-", F.substring_index(path, "/", 1), file_stem(name))


def split_config(task: Column) -> Column:
    """What follows the dash, if there is one."""
    return F.get(F.split(task, "-"), F.when(F.contains(task, F.lit("-")), 1).otherwise(0))


def config_name(flags: Column, without: str = "template") -> Column:
    """A map of flags as key_yes or key_no, joined."""
    entries = F.filter(F.map_entries(flags), lambda e: e.key != without)
    return F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.when(e.value, "_yes").otherwise("_no"))), "_")


def parse_spans(line: Column) -> Column:
    """`[a, b];[c, d]` as array<struct<s, e>>."""
    pairs = F.transform(F.split(line, ";"), lambda x: F.from_json(x, "array<bigint>"))
    return F.transform(pairs, lambda p: F.struct(F.get(p, 0).alias("s"), F.get(p, 1).alias("e")))


def format_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(F.lit("["), x.s, F.lit(", "), x.e, F.lit("]"))), ";")


def fill(template: Column, values: dict[str, Column], strip_values: bool = True) -> Column:
    """Replaces marks by values, one after another."""
    for mark, value in values.items():
        template = F.replace(template, F.lit(mark), F.coalesce(strip(value) if strip_values else value, F.lit("")))
    return template
