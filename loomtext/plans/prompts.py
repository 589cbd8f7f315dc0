"""Chat templates and prompts as ordered aggregation and array functions.

A style says what stands around the system message and around each message; `FRAMES` holds these pieces, with {role}, {sep},
{sep2}, {turn_sep} (sep and sep2 by turns) and {round}.  A template is a row: name, style, system_template, system_message,
user, assistant, sep, sep2; `TEMPLATES` has a few, and any table of the same columns serves, so a registry of any size can be
read from a file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fill, strip


@dataclass(frozen=True)
class Frame:
    """head: with a system message; bare: without.  before, after: a message; waiting: a message yet to come."""

    head: str
    bare: str
    before: str
    after: str
    waiting: str


# The pieces of each separator style.
FRAMES = {
    "ADD_COLON_SINGLE": Frame("{system}{sep}", "{sep}", "{role}: ", "{sep}", "{role}:"),
    "ADD_COLON_TWO": Frame("{system}{sep}", "{sep}", "{role}: ", "{turn_sep}", "{role}:"),
    "ADD_COLON_SPACE_SINGLE": Frame("{system}{sep}", "{sep}", "{role}: ", "{sep}", "{role}: "),
    "NO_COLON_SINGLE": Frame("{system}", "", "{role}", "{sep}", "{role}"),
    "NO_COLON_TWO": Frame("{system}", "", "{role}", "{turn_sep}", "{role}"),
    "ADD_NEW_LINE_SINGLE": Frame("{system}{sep}", "", "{role}\n", "{sep}", "{role}\n"),
    "LLAMA2": Frame("{system}", "[INST] ", "{role} ", "{turn_sep}", "{role}"),
    "LLAMA3": Frame("{system}", "", "<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>{role}<|end_header_id|>\n\n"),
    "CHATGLM": Frame("{system}{sep}", "", "{round}{role}：", "{sep}", "{round}{role}："),
    "CHATML": Frame("{system}{sep}\n", "", "{role}\n", "{sep}\n", "{role}\n"),
    "CHATINTERN": Frame("{system}", "", "{begin}{role}:", "{turn_sep}\n", "{begin}{role}:"),
    "DOLLY": Frame("{system}", "", "{role}:\n", "{turn_sep}{gap}", "{role}:\n"),
    "RWKV": Frame("{system}", "", "{role}: ", "\n\n", "{role}:"),
    "PHOENIX": Frame("{system}", "", "{role}: <s>", "</s>", "{role}: <s>"),
    "ROBIN": Frame("{system}{sep}", "{sep}", "{role}:\n", "{sep}", "{role}:\n"),
    "FALCON_CHAT": Frame("{system}{sep}", "", "{role}: ", "{sep}", "{role}:"),
    "CHATGLM3": Frame("{system}", "", "{role}\n", "", "{role}"),
    "DEEPSEEK_CHAT": Frame("{system}", "", "{role}: ", "{turn_sep}", "{role}:"),
    "METAMATH": Frame("{system}{sep}", "", "{role}{opening}", "{closing}", "{role}{opening}"),
    "YUAN2": Frame("{system}{sep2}", "", "", "<n>", ""),
    "GEMMA": Frame("<bos>", "<bos>", "<start_of_turn>{role}\n", "{sep}", "<start_of_turn>{role}\n"),
    "CLLM": Frame("{system}{sep}", "{sep}", "{role}: ", "{turn_sep}", "{role}:"),
    "DEFAULT": Frame("{system}\n", "\n", "{role}: ", "\n", "{role}:"),
}
# Name, style, system_template, system_message, user, assistant, sep, sep2.
TEMPLATES = [
    ("llama-2", "LLAMA2", "[INST] <<SYS>>\n{system_message}\n<</SYS>>\n\n", "", "[INST]", "[/INST]", " ", " </s><s>"),
    ("llama-3", "LLAMA3", "<|start_header_id|>system<|end_header_id|>\n\n{system_message}<|eot_id|>", "", "user", "assistant", "", ""),
    ("mistral", "LLAMA2", "[INST] {system_message}\n", "", "[INST]", "[/INST]", " ", "</s>"),
    ("chatml", "CHATML", "<|im_start|>system\n{system_message}", "", "<|im_start|>user", "<|im_start|>assistant", "<|im_end|>", ""),
    ("plain", "ADD_COLON_SINGLE", "{system_message}", "", "USER", "ASSISTANT", "\n", ""),
]
COLUMNS = "name string, style string, system_template string, system_message string, user string, assistant string, sep string, sep2 string"
ALIASES = {"llama2": "llama-2", "llama3": "llama-3"}


def by_name(name: str, templates: list[tuple] = TEMPLATES) -> dict[str, str]:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    found = {t[0]: dict(zip(names, t, strict=True)) for t in templates}
    return found[ALIASES.get(name, name)]


def render(messages: Column, template: dict[str, str], system_message: Column | str | None = None) -> Column:
    """The prompt of messages (array of structs role, content; a null or empty content is yet to come) under one template."""
    style, sep, sep2 = template["style"], template["sep"], template["sep2"]
    frame = FRAMES[style]
    system = F.lit(template["system_message"]) if system_message is None else F.lit(system_message) if isinstance(system_message, str) else F.coalesce(system_message, F.lit(""))
    prompt = F.replace(F.lit(template["system_template"]), F.lit("{system_message}"), system)
    if style == "CLLM":
        messages = F.slice(messages, F.greatest(F.size(messages) - 1, F.lit(1)), 2)
    by_turn = lambda i, even, odd: F.when(i % 2 == 0, even).otherwise(odd)

    def pieces(text: str, m: Column, i: Column) -> Column:
        role = F.when(m.role == "user", template["user"]).when(m.role == "assistant", template["assistant"]).otherwise(m.role)
        role = by_turn(i, template["user"], template["assistant"]) if style == "LLAMA2" else role
        known = {
            "{role}": role, "{sep}": F.lit(sep), "{sep2}": F.lit(sep2), "{turn_sep}": by_turn(i, sep, sep2), "{begin}": by_turn(i, "<s>", ""), "{gap}": by_turn(i, "", "\n\n"),
            "{round}": F.when(i % 2 == 0, F.concat(F.lit("[Round "), (F.floor(i / 2) + (1 if template["name"] == "chatglm2" else 0)).cast("string"), F.lit(f"]{sep}"))).otherwise(""),
            "{opening}": by_turn(i, ":\n", ": " + sep2), "{closing}": by_turn(i, sep, ""),
        }
        out, rest = [], text
        while rest:
            at = min((rest.find(k) for k in known if k in rest), default=-1)
            if at < 0:
                out.append(F.lit(rest))
                break
            key = next(k for k in known if rest.startswith(k, at))
            out += [F.lit(rest[:at]), known[key]]
            rest = rest[at + len(key) :]
        return F.concat(*out) if out else F.lit("")

    def one(m: Column, i: Column) -> Column:
        content = F.replace(F.replace(m.content, F.lit("\r\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n")) if style == "RWKV" else m.content
        said = F.concat(pieces(frame.before, m, i), content, pieces(frame.after, m, i))
        if style == "LLAMA2":
            said = F.when(i == 0, F.concat(content, F.lit(" "))).otherwise(said)
        return F.when(F.coalesce(content, F.lit("")) != "", said).otherwise(pieces(frame.waiting, m, i))

    empty = system == "" if style in ("LLAMA2", "LLAMA3", "CHATGLM3", "FALCON_CHAT", "YUAN2") else prompt == ""
    around = lambda text: F.concat(*[F.lit("")] + [x for p in text.split("{system}") for x in (F.lit(p.replace("{sep}", sep).replace("{sep2}", sep2)), prompt)][:-1])
    body = F.array_join(F.transform(messages, one), "")
    if style == "YUAN2":
        body = F.concat(F.regexp_replace(body, "[<n>]+$", ""), F.lit(sep))
    return F.concat(F.when(empty, around(frame.bare)).otherwise(around(frame.head)), body)


def messages_of(turns: DataFrame) -> DataFrame:
    """conv_id, messages in the order of turns."""
    own = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(own, lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages"))


def alternating(messages: Column) -> Column:
    """The messages; an error if one role speaks twice in a row."""
    twice = F.exists(F.sequence(F.lit(0), F.greatest(F.size(messages) - 2, F.lit(0))), lambda i: F.coalesce(F.get(messages, i).role == F.get(messages, i + 1).role, F.lit(False)))
    return F.when(twice, F.raise_error("a role speaks twice").cast("array<struct<role: string, content: string>>")).otherwise(messages)


def awaiting_answer(messages: Column) -> Column:
    """With an empty assistant message; the last must be the user's."""
    more = F.concat(messages, F.array(F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"))))
    return F.when(F.element_at(messages, -1).role == "user", more).otherwise(F.raise_error("the last message is not the user's").cast("array<struct<role: string, content: string>>"))


def appended(messages: Column, role: str, content: Column) -> Column:
    return F.concat(messages, F.array(F.struct(F.lit(role).alias("role"), content.alias("content"))))


def with_last(messages: Column, content: Column) -> Column:
    last = F.element_at(messages, -1)
    return F.concat(F.slice(messages, 1, F.size(messages) - 1), F.array(F.struct(last.role.alias("role"), content.alias("content"))))


def with_system(messages: Column, content: Column) -> Column:
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), content.alias("content"))), F.filter(messages, lambda m: m.role != "system"))


def exported(messages: Column) -> Column:
    """Without an empty system message."""
    return F.filter(messages, lambda m: (m.role != "system") | (F.coalesce(m.content, F.lit("")) != ""))


def bare_pair(question: Column, answer: Column | None, eos: str) -> Column:
    """Without any template: question, space and eos before the answer and eos."""
    return question if answer is None else F.concat(question, F.lit(" " + eos), F.coalesce(F.concat(answer, F.lit(eos)), F.lit("")))


def masked_turns(turns: Column, value: int = -100) -> Column:
    """Of turns (structs is_answer, ids): labels of all ids, users' masked."""
    return F.flatten(F.transform(turns, lambda t: F.when(t.is_answer, t.ids).otherwise(F.transform(t.ids, lambda _: F.lit(value)))))


def request(system: Column, query: Column, tool: Column | None = None, second: Column | None = None) -> Column:
    """Messages of a tool-call request."""
    of = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(of("system", system), of("user", query), *([of("assistant", tool), of("user", second)] if tool is not None and second is not None else []))


def formatted_input(instruction: Column, examples: Column, post_prompt: Column, context: Column, question: Column, user: str = "Question: {question}\n\n<context>\n{context}\n</context>") -> Column:
    """Instruction, examples, post prompt, then question and stripped context; stripped as a whole.  Values are put in at once: a mark within a value stays."""
    parts, rest = [instruction, F.lit("\n\n"), examples, F.lit("\n\n"), post_prompt, F.lit("\n\n")], user
    known = {"{question}": question, "{context}": strip(context)}
    while rest:
        at, key = min(((rest.find(k), k) for k in known if k in rest), default=(-1, ""))
        if at < 0:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[:at]), known[key]]
        rest = rest[at + len(key) :]
    return strip(F.concat(*parts))


def task_prompt(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """prompt: system prompt, filled context and user template, a blank line between; templates has a row for each data set (a few), joined by name."""
    own = rows.join(F.broadcast(templates), "dataset_name")
    values = {"{context}": F.col("context"), "{input}": F.col("input")}
    filled = lambda c: fill(F.col(c), values, False)
    return own.withColumn("prompt", F.array_join(F.array("system_prompt", filled("context_template"), filled("user_template")), "\n\n"))


def choice_prompt(template: Column, row: dict[str, Column]) -> Column:
    """$DOC$, $Q$, $C_A$ and so on, replaced in turn by stripped values."""
    return fill(template, {f"${k}$": v for k, v in row.items()})


def statements(prompt: Column) -> Column:
    return F.replace(prompt, F.lit("Question"), F.lit("Statement"))


def document_prompt(documents: Column, question: Column, template: str = "{search_results}\n\nQuestion: {question}\nAnswer:") -> Column:
    """Document [i](Title: t) text, a line each, in the template."""
    lines = F.transform(documents, lambda d, i: F.concat(F.lit("Document ["), (i + 1).cast("string"), F.lit("](Title: "), d.title, F.lit(") "), d.text))
    return fill(F.lit(template), {"{search_results}": F.array_join(lines, "\n"), "{question}": question}, False)


def closed_book_prompt(question: Column, template: str = "Question: {question}\nAnswer:") -> Column:
    return F.replace(F.lit(template), F.lit("{question}"), question)


def pairs_text(pairs: Column) -> Column:
    """Key-value structs (k, v) as lines of a JSON-like object."""
    n = F.size(pairs)
    return F.array_join(F.transform(pairs, lambda p, i: F.concat(F.when(i == 0, "{").otherwise(" "), F.lit('"'), p.k, F.lit('": "'), p.v, F.lit('"'), F.when(i == n - 1, "}").otherwise(","))), "\n")
