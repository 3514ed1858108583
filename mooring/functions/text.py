"""Text expressions. All are built-in Column expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mooring.functions.bind import let

#: What a Unicode-aware strip takes off: white space and the four separators.
_SPACE = r"[\s\x1c-\x1f]+"
WORD = r"[\p{L}\p{N}_]+"
#: The function words kept in a skeleton.
FUNCTION_WORDS = "a an the and or but if then so to of in on for with as by is are was were be been being it this that these those from at into about".split()
SKELETON_GROUP, SKELETON_GROUPS, SKELETON_WORDS, SKELETON_CHARS = 16, 8, 20, 200


def text(c: Column) -> Column:
    """Null as empty text."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends; null stays null."""
    return F.regexp_replace(c, rf"(?U)\A{_SPACE}|{_SPACE}\z", "")


def blank(c: Column) -> Column:
    """Null, empty or nothing but white space."""
    return strip(text(c)) == ""


def capitalised(c: Column) -> Column:
    """First character upper case, all others lower case."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2**31 - 1)))


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor empty, else empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def steps(c: Column, separator: str = "\n\n") -> Column:
    """Steps of a trace: parts between blank lines, stripped, empty ones left out."""
    parts = F.split(strip(text(c)), separator.replace("\n", "\\n"), -1)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def has_word(c: Column) -> Column:
    """Is there any word in the text? A search that stops at the first."""
    return text(c).rlike(r"[\p{L}\p{N}_]")


def words(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores: the offline tokens."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(f"({WORD})"), F.lit(1))


def function_word_skeleton(c: Column) -> Column:
    """Function words of a text in lines of sixteen, at most eight lines.

    Without any function word the first twenty words, without any word the first
    200 characters. Word runs are maximal, so testing whole runs is the same as
    matching at word boundaries. Null counts as empty text.
    """
    every = F.regexp_extract_all(text(c), F.lit(f"({WORD})"), F.lit(1))
    kept = let(every, lambda all_: let(F.filter(all_, lambda w: F.lower(w).isin(FUNCTION_WORDS)), lambda own: F.when(F.size(own) > 0, own).otherwise(F.slice(all_, 1, SKELETON_WORDS))))

    def lines(k: Column) -> Column:
        n = F.least(F.ceil(F.size(k) / SKELETON_GROUP).cast("int"), F.lit(SKELETON_GROUPS))
        groups = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(k, i * SKELETON_GROUP + 1, SKELETON_GROUP), " "))
        return F.when(F.size(k) == 0, F.left(text(c), F.lit(SKELETON_CHARS))).otherwise(F.array_join(groups, "\n\n"))

    return let(kept, lines)


def block(c: Column, tag: str) -> Column:
    """Stripped body of the first ``<tag>...</tag>``, case-insensitive; else empty."""
    return strip(F.regexp_extract(c, f"(?is)<{tag}>(.*?)</{tag}>", 1))


def parse_reasoning(c: Column) -> Column:
    """Struct ``reason, skeleton, mode`` of a raw output.

    ``tagged``: a non-empty reason block; ``open_reason_tag``: else the text after
    the first open tag; ``raw``: else the whole text. Null counts as empty.
    """

    def parts(raw: Column) -> Column:
        return let(F.struct(raw.alias("raw"), block(raw, "reason").alias("reason"), F.instr(F.lower(raw), "<reason>").alias("at")), of)

    def of(p: Column) -> Column:
        mode = F.when(p["reason"] != "", "tagged").when(p["at"] > 0, "open_reason_tag").otherwise("raw")
        body = F.when(p["reason"] != "", p["reason"]).when(p["at"] > 0, strip(F.substring(p["raw"], p["at"] + 8, F.length(p["raw"])))).otherwise(p["raw"])
        return F.struct(body.alias("reason"), block(p["raw"], "skeleton").alias("skeleton"), mode.alias("mode"))

    return let(strip(text(c)), parts)


def format_conversation(messages: Column) -> Column:
    """``Role: content`` lines of an array of messages, stripped; null array: empty text.

    A null message is an empty line.
    """
    line = F.transform(messages, lambda m: F.when(m.isNull(), F.lit("")).otherwise(F.concat(capitalised(_role(m, "user")), F.lit(": "), _content(m))))
    return F.coalesce(strip(F.array_join(line, "\n")), F.lit(""))


def _field(m: Column, *names: str) -> list[Column]:
    return [m[n] for n in names]


def _role(m: Column, default: str) -> Column:
    return F.coalesce(F.nullif(m["role"], F.lit("")), F.nullif(m["from_role"], F.lit("")), F.lit(default))


def _content(m: Column) -> Column:
    return first_filled(*_field(m, "content", "value"))


def last_of(messages: Column, roles: tuple[str, ...]) -> Column:
    """Content of the last message whose role is one of ``roles``; empty text if none."""
    own = F.filter(messages, lambda m: F.lower(_role(m, "")).isin(*roles))
    return F.coalesce(_content(F.try_element_at(own, F.lit(-1))), F.lit(""))


def question_answer(messages: Column) -> Column:
    """Struct ``question, answer``: the last messages of each side.

    An empty question becomes the whole transcript; a null array two empty texts.
    """
    q = last_of(messages, ("user", "human"))
    return F.struct(
        F.when(messages.isNull(), "").when(q != "", q).otherwise(format_conversation(messages)).alias("question"),
        F.when(messages.isNull(), "").otherwise(last_of(messages, ("assistant", "gpt", "model"))).alias("answer"),
    )
