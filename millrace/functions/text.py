"""String functions: cleaners, extractors, splitters and formats, as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.filters import trimmed

_BULLETS = r"\x{2022}\x{2023}\x{2043}\x{204c}\x{204d}\x{2219}\x{25cb}\x{25cf}\x{25d8}\x{25e6}\x{00b7}"


def newlines_stripped(text: Column) -> Column:
    """Runs of white space that hold a newline become one newline."""
    return F.regexp_replace(text, r"(?U)\s*\n\s*", "\n")


def extra_whitespace_cleaned(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"[\x{00a0}\n]", " "), " {2,}", " "))


def paragraphs_grouped(text: Column) -> Column:
    """Line breaks within a paragraph become spaces; blank lines still part paragraphs."""
    paragraphs = F.filter(F.split(text, r"\s*\n\s*\n\s*"), lambda p: trimmed(p) != "")
    return F.array_join(F.transform(paragraphs, lambda p: F.regexp_replace(trimmed(p), r"\s*\n\s*", " ")), "\n\n")


#: Cleaners by name. The public definitions are simplified where they rest on natural-language models.
CLEANERS: dict[str, Callable[..., Column]] = {
    "clean_extra_whitespace": extra_whitespace_cleaned,
    "clean_bullets": lambda t: F.regexp_replace(t, rf"^\s*[{_BULLETS}]\s*", ""),
    "clean_ordered_bullets": lambda t: F.regexp_replace(t, r"^\s*(?:[0-9A-Za-z]{1,2}\.)+(?:[0-9A-Za-z]{1,2})?\s+", ""),
    "clean_postfix": lambda t, pattern: F.regexp_replace(t, rf"[\s\-:]*(?:{pattern})\s*$", ""),
    "clean_prefix": lambda t, pattern: F.regexp_replace(t, rf"^(?:{pattern})[\s\-:]*", ""),
    "clean_dashes": lambda t: trimmed(F.regexp_replace(t, r"[-\x{2013}]", " ")),
    "clean_trailing_punctuation": lambda t: F.regexp_replace(trimmed(t), r"[.,:;]+$", ""),
    "clean_non_ascii_chars": lambda t: F.regexp_replace(t, r"[^\x00-\x7f]", ""),
    "group_broken_paragraphs": paragraphs_grouped,
    "remove_punctuation": lambda t: F.regexp_replace(t, r"\p{P}", ""),
    "replace_unicode_quotes": lambda t: F.regexp_replace(F.regexp_replace(t, r"[\x{2018}\x{2019}\x{201a}\x{201b}]", "'"), r"[\x{201c}\x{201d}\x{201e}\x{201f}]", '"'),
    "bytes_string_to_string": lambda t: F.decode(F.unhex(F.regexp_replace(t, r"\\x", "")), "utf-8"),
}
DEFAULT_CLEANERS = ["replace_unicode_quotes", "clean_non_ascii_chars", "group_broken_paragraphs", "clean_extra_whitespace"]


def cleaned(text: Column, options: Sequence[str | tuple[str, dict]] | None = None) -> Column:
    """A chain of cleaners; unknown names raise."""
    for option in DEFAULT_CLEANERS if options is None else options:
        name, args = (option, {}) if isinstance(option, str) else option
        if name not in CLEANERS:
            raise ValueError(f"{name!r} is not a cleaner; known: {sorted(CLEANERS)}")
        text = CLEANERS[name](text, **args)
    return text


def _all(pattern: str, group: int = 0) -> Callable[[Column], Column]:
    return lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(group))


def text_after(text: Column, pattern: str, index: int = 0) -> Column:
    """What follows the match of that number."""
    parts = F.split(text, pattern, index + 2)
    return trimmed(F.get(parts, F.lit(index + 1)))


def text_before(text: Column, pattern: str, index: int = 0) -> Column:
    """What stands before the match of that number (its own part, if index is not 0: after the match before)."""
    return trimmed(F.get(F.split(text, pattern, index + 2), F.lit(index)))


#: What each kind of extraction finds.
EXTRACTORS: dict[str, Callable[..., Column]] = {
    "extract_datetimetz": lambda t: F.regexp_extract(t, r"[A-Za-z]{3},\s\d{1,2}\s[A-Za-z]{3}\s\d{4}\s\d{2}:\d{2}:\d{2}\s[+-]\d{4}", 0),
    "extract_email_address": _all(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"),
    "extract_ip_address": _all(r"\b\d{1,3}(?:[.]\d{1,3}){3}\b"),
    "extract_ip_address_name": _all(r"[A-Za-z0-9-]*[.]*[A-Za-z0-9-]+[.][A-Za-z0-9-]+[.][A-Za-z0-9-]+"),
    "extract_mapi_id": _all(r"[0-9]*[.][0-9]*[.][0-9]*[.][0-9]*;", 0),
    "extract_ordered_bullets": lambda t: F.split(F.regexp_extract(t, r"^\s*((?:[0-9A-Za-z]{1,2}[.]){1,3}[0-9A-Za-z]{0,2})\s", 1), r"[.]"),
    "extract_text_after": text_after,
    "extract_text_before": text_before,
    "extract_us_phone_number": lambda t: F.regexp_extract(t, r"(?:\+?1[ -]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}", 0),
}


def extracted(text: Column, kind: str, **options) -> Column:
    if kind not in EXTRACTORS:
        raise ValueError(f"unsupported kind {kind!r}; known: {sorted(EXTRACTORS)}")
    return EXTRACTORS[kind](text, **options)


def first_int(text: Column) -> Column:
    """The first run of digits as a number (null: none, or beyond 64 bits)."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("long")


def task_list(text: Column) -> Column:
    """Names of the lines "number. name" of a numbered list, without punctuation."""
    lines = F.transform(F.split(trimmed(text), "\n"), lambda x: F.split(trimmed(x), r"\.", 2))
    named = F.transform(lines, lambda p: F.when((F.size(p) == 2) & p[0].rlike(r"[0-9]"), trimmed(F.regexp_replace(F.get(p, F.lit(1)), r"(?U)[^\w\s_]+", ""))))
    return F.filter(named, lambda x: x.isNotNull() & (x != ""))


def template_words(template: Column) -> Column:
    """What stands in braces, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([^}]*)\}"), F.lit(1)))


def template_filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with the given words filled in; others stay as they are."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{" + key + "}"), value.cast("string"))
    return template


def pascal(text: Column) -> Column:
    """PascalCase of a snake_case name; a name that is Pascal already stays."""
    words = F.split(F.regexp_replace(text, "^_+|_+$", ""), "_+")
    return F.when(text.rlike("^[A-Z][a-zA-Z0-9]*([A-Z][a-zA-Z0-9]*)*$"), text).otherwise(F.array_join(F.transform(words, F.initcap), ""))


def personas(text: Column) -> Column:
    """(name, description) pairs of "persona_name: ... persona_description: ..." sections."""
    both = F.regexp_extract_all(text, F.lit(r"(?s)persona_name:\s*(.*?)\s*persona_description:\s*(.*?)\s*(?=\d+\.\s*persona_name|\z)"), F.lit(0))
    return F.transform(both, lambda p: F.struct(
        F.regexp_extract(p, r"(?s)persona_name:\s*(.*?)\s*persona_description:", 1).alias("name"), trimmed(F.regexp_extract(p, r"(?s)persona_description:\s*(.*?)\s*(?:\d+\.\s*)?\z", 1)).alias("description")))


def graph_nodes(text: Column) -> Column:
    """(id, type) of each Node(id='…', type='…')."""
    pattern = r"Node\(id='(.*?)', type='(.*?)'\)"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("id"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("type"))


def graph_relationships(text: Column) -> Column:
    """(subj, obj, type, timestamp) of each Relationship(subj=Node(…), obj=Node(…), type='…'[, timestamp='…'])."""
    pattern = r"Relationship\(subj=Node\(id='(.*?)', type='.*?'\), obj=Node\(id='(.*?)', type='.*?'\), type='(.*?)'(?:, timestamp='(.*?)')?\)"
    part = lambda i, name: F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(name)
    return F.arrays_zip(part(1, "subj"), part(2, "obj"), part(3, "type"), part(4, "timestamp"))


def tagged_tasks(text: Column) -> Column:
    """(index, content) of each <task>…</task> in order, from 0."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<task>(.*?)</task>"), F.lit(1)), lambda c, i: F.struct(i.alias("index"), trimmed(c).alias("content")))


def api_call(text: Column) -> Column:
    """The first [Name(args)], or null."""
    return F.nullif(F.regexp_extract(text, r"\[(\w+)\((.*)\)\]", 0), F.lit(""))


def first_of(stages: Sequence[Sequence[Callable[[Column], Column]]], text: Column) -> Column:
    """Stages of strategies: within a stage the first that gives a value wins, a stage without one gives null."""
    for stage in stages:
        text = F.coalesce(*[f(text) for f in stage])
    return text


def boxed_simple(text: Column) -> Column:
    """The content of the first \\boxed{…} without nested braces, or null."""
    return F.when(text.rlike(r"(?s)\\boxed\{.*?\}"), trimmed(F.regexp_extract(text, r"(?s)\\boxed\{(.*?)\}", 1)))


def boxed_match(solution: Column, trace: Column) -> Column:
    """Both have a boxed answer and it is the same."""
    return F.coalesce(boxed_simple(solution) == boxed_simple(trace), F.lit(False))


def final_answer(text: Column) -> Column:
    """What follows "FINAL ANSWER: "."""
    at = F.instr(text, "FINAL ANSWER")
    return F.when(at == 0, F.lit("FINAL ANSWER not found")).otherwise(trimmed(F.substr(text, at + len("FINAL ANSWER: "))))


def number_of(text: Column) -> Column:
    """A number without "$", "%" and ","; infinity if it isn't one."""
    return F.coalesce(trimmed(F.translate(text, "$%,", "")).try_cast("double"), F.lit(float("inf")))


def plain(text: Column, punctuation: bool = False) -> Column:
    """Lower-cased without white space and, unless kept, without ASCII punctuation."""
    own = F.lower(F.regexp_replace(text, r"(?U)\s", ""))
    return own if punctuation else F.regexp_replace(own, r"[!-/:-@\[-`{-~]", "")


def answer_correct(answer: Column, truth: Column) -> Column:
    """Compares as a number, as a list separated by "," or ";", or as a string, as the truth suggests."""
    number = lambda t: trimmed(t).try_cast("double")
    mine, theirs = F.split(answer, "[,;]"), F.split(truth, "[,;]")
    each = F.zip_with(mine, theirs, lambda a, t: F.when(number(t).isNotNull(), number_of(a) == number(t)).otherwise(plain(a, True) == plain(t, True)))
    as_list = (F.size(mine) == F.size(theirs)) & F.forall(each, lambda x: F.coalesce(x, F.lit(False)))
    return F.coalesce(F.when(number(truth).isNotNull(), number_of(answer) == number(truth)).when(truth.rlike("[,;]"), as_list).otherwise(plain(answer) == plain(truth)), F.lit(False))


def question_for(question: Column, domain: str, requests: dict[str, str], instruction: str = "") -> Column:
    """A benchmark question, the request for its domain (the caller's texts; an unknown domain raises) and an instruction."""
    if domain not in requests:
        raise ValueError(f"unknown domain {domain!r}; known: {sorted(requests)}")
    return F.concat_ws("\n", question, F.lit(requests[domain]), F.lit(instruction))


def alpaca_text(instruction: Column, given: Column, output: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("### Instruction:\n"), instruction), F.concat(F.lit("\n### Input:\n"), given), F.concat(F.lit("\n### Response:\n"), output))


def alpaca_parts(text: Column) -> Column:
    """(instruction, input, output) of an alpaca text; one without instruction or response raises."""
    part = lambda name, after: trimmed(F.regexp_extract(text, rf"(?s)### {name}:\s*(.*?)\s*(?:{after}|\z)", 1))
    whole = F.struct(part("Instruction", "### Input:|### Response:").alias("instruction"), part("Input", "### Response:").alias("input"), part("Response", "### Instruction:").alias("output"))
    return F.when(text.contains("### Instruction:") & text.contains("### Response:"), whole).otherwise(F.raise_error(F.lit("not an alpaca text")).cast("struct<instruction:string,input:string,output:string>"))


def tool_calls(text: Column) -> Column:
    """The JSON texts in <tool_call> tags, single quotes made double; those that don't parse are left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1)), lambda c: F.replace(c, F.lit("'"), F.lit('"')))
    return F.filter(found, lambda c: F.try_parse_json(c).isNotNull())


def tool_response(text: Column) -> Column:
    """The JSON text in the first <tool_response> tag, or null."""
    own = F.replace(F.regexp_extract(text, r"(?s)<tool_response>\s*(.*?)\s*</tool_response>", 1), F.lit("'"), F.lit('"'))
    return F.when(F.try_parse_json(own).isNotNull(), own)


def option_chosen(message: Column, options: Column) -> Column:
    """The option whose number is the first in the message, or null."""
    return F.try_element_at(options, first_int(message).cast("int"))


def collection_name(content: Column) -> Column:
    """Ten plain characters of a content's name and six digits of its digest."""
    clean = F.substring(F.regexp_replace(F.lower(content), r"[^a-z0-9]", ""), 1, 10)
    return F.concat(clean, F.lit("_"), F.substring(F.md5(content), 1, 6))


def graph_identifier(text: Column) -> Column:
    """ASCII letters, digits and common CJK characters only."""
    return F.regexp_replace(text, r"[^a-zA-Z0-9\x{4e00}-\x{9fa5}]", "")


def relation_name(text: Column) -> Column:
    return F.upper(F.replace(text, F.lit(" "), F.lit("_")))


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur, by case-insensitive containment."""
    total = F.lit(0)
    for k in keywords:
        total = total + F.lower(text).contains(k.lower()).cast("int")
    return total.cast("long")


def sentences(text: Column, stops: str = ".") -> Column:
    """Trimmed pieces between full stops that aren't blank."""
    return F.filter(F.transform(F.split(text, f"[{stops}]"), trimmed), lambda s: s != "")


def physics_number(text: Column) -> Column:
    """A LaTeX number as plain text: a \\times 10^{b} as aEb, without dollars, \\text and spacing commands."""
    own = F.regexp_replace(text, r"\\times\s*10\^\{?(-?\d+)\}?", "e$1")
    own = F.regexp_replace(own, r"\\(?:text|mathrm|mathbf)\{([^}]*)\}", "$1")
    return trimmed(F.regexp_replace(own, r"\$|\\[,;! ]|\\left|\\right|~", ""))


def value_and_unit(text: Column) -> Column:
    """(value, unit) of "3.5e2 m/s"."""
    pattern = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:\s*[eE][+-]?\d+)?)\s*(.*?)\s*$"
    return F.struct(F.regexp_replace(F.regexp_extract(text, pattern, 1), " ", "").try_cast("double").alias("value"), F.regexp_extract(text, pattern, 2).alias("unit"))


def tolerance(value: Column, default: float = 1e-2) -> Column:
    """A relative tolerance from the number of significant digits, between the default and ten times it."""
    digits = F.length(F.regexp_replace(F.regexp_replace(value, r"[eE].*$", ""), r"^[+-]?0*\.?0*|[^0-9]", ""))
    return F.least(F.greatest(F.pow(F.lit(10.0), -digits.cast("double")), F.lit(default)), F.lit(10 * default))


def log_scores(names: Column, logs: Column) -> Column:
    """A map of token to score from parallel arrays."""
    return F.map_from_arrays(names, logs)


def tool_call_text(content: Column, name: Column, arguments: Column) -> Column:
    """A message with a tool call in its tag; name and arguments (a JSON text) as one object."""
    return F.concat(content, F.lit("\n<tool_call>\n{\"name\": \""), name, F.lit("\", \"arguments\": "), arguments, F.lit("}\n</tool_call>"))


def tool_response_text(name: Column, content: Column) -> Column:
    return F.concat(F.lit("<tool_response>\n{\"name\": \""), name, F.lit("\", \"content\": "), content, F.lit("}\n</tool_response>"))


def error_prefix(sentences_: Column, wrong_from: Column) -> Column:
    """The sentences before the first wrong one, whose place an oracle has found by halving."""
    return F.array_join(F.slice(sentences_, 1, F.greatest(wrong_from, F.lit(0))), ". ")
