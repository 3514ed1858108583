"""Texts whose end is missing (problem 2).

Intact values are cut artificially (inside words, sentences, listings and tags,
at random places and at their source's length limits, with and without something
put after the cut) to make positives; a logistic regression over hashed features
of the closing characters, the punctuation, the shape of the last lines and the
length against the limit then scores every record.

Length limits are found in the data: a length (in characters or bytes) that far
more values of a source have than its neighbourhood would let expect.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooring.llm.common import TRAIN_CHARS, map_rows, sampled_rows
from mooring.llm.logistic import WIDTH, Hashed, score, train
from mooring.session import cut, spread

#: At most so many values of each field are read for training.
TRAIN_ROWS = 3000
#: Artificial cuts of each value; twice as many of texts in Han or kana, whose
#: last words are more various.
CUTS = 3
#: Share of the values that also give a looping copy, complete and cut.
LOOPS = 0.15
#: A length is a limit if at least this many values have it and at least this
#: many times the mean of the lengths around it.
LIMIT_COUNT, LIMIT_RATIO, LIMIT_AROUND = 8, 8.0, 50
#: Stored values that score as much in the first round are left out of the second.
SUSPECT = 0.4
#: Rows of the training set a feature must have.
RARE = 4
#: Scores of complete and cut texts lie far apart; this cut stands between them.
THRESHOLD = 0.45

_CLOSER = re.compile(r"</[A-Za-z][\w-]*\s*>\Z")
#: Things storage systems put after a cut, and the signs they begin with.
_AFTER_SIGNS = "…�[(<\\*_`&%"
_AFTER = re.compile(
    r"(?:(?:…|�+|\[[^\[\]\n]+\]|\([^()\n]+\)|<[a-z][a-z _/-]*/?>|\\(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]{0,2}|frac\{[^{}\n]*|[a-z]{0,8}\{?[^}\s]{0,12})?|\*{1,3}\d*|_{1,2}|`[^`\n]{0,12}|\(see [^)\n]{0,16}|&[a-z#0-9]{0,6}|%[0-9A-F]{0,2}))\Z"
)
_NOTE = re.compile(r"trunc|cut|trim|chars|more|omit|short|continu|clip|limit|kürz|gekürzt|tronq|cort|обрез|省略|截断", re.I)
_MARK = re.compile(r"[。？！]|[?!]|\.(?=[\s\"'’”»)\]*_]|\Z)|…(?=\s|\Z)")
_END_OK = "\"'’”»)]}*_"
_TAG_OPEN = re.compile(r"</?[A-Za-z]*\Z")
_BULLET = re.compile(r"\s*(?:[-*•]|\d{1,3}[.)]|\(\d{1,3}\))\s+")
_LABEL = re.compile(r"[^\W\d_][^:：\n]{0,40}[:：]\**\s*")
_FORMULA = re.compile(r"\s*(?:\$|\\|[A-Za-z]_?\{?\w?\}?\s*[=<>≤≥]|\{|[\d.]+(?:\.\.\.)?\s*\Z)")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def _kind(c: str) -> str:
    if not c:
        return "none"
    if c.isdigit():
        return "0"
    if _CJK.match(c):
        return "cjk"
    if c.isalpha():
        return "up" if c.isupper() else "low"
    return c if ord(c) < 0x3100 else "sym"


def _bucket(n: int) -> str:
    return str(n) if n < 6 else "6-9" if n < 10 else "10-19" if n < 20 else "20+"


def at_limit(text: str, limits: tuple) -> bool:
    """Is the text as long as one of the ``limits``, pairs (is_bytes, length)? Bytes may miss or exceed it by a character."""
    return any(-3 <= len(text.encode()) - n <= 2 if is_bytes else len(text) == n for is_bytes, n in limits)


def _at_limit(text: Column, limits: Column) -> Column:
    """The same in the JVM, for an array of limits; a null one has none."""
    off = lambda x: F.octet_length(text) - x["length"]
    return F.coalesce(F.exists(limits, lambda x: F.when(x["is_bytes"], off(x).between(-3, 2)).otherwise(F.length(text) == x["length"])), F.lit(False))


def features(text: str, at_its_limit: bool = False) -> list[str]:
    """Names of the binary features of one text; ``at_its_limit``: is it as long as a limit of its source?"""
    body = text.rstrip()
    while body.endswith(">") and (m := _CLOSER.match(body, max(0, body.rfind("</")))):
        body = body[: m.start()].rstrip()
    closed = "tagged" if "</" in text[len(body) :] else "bare"
    fence = "open" if text.count("```") % 2 else "even"
    at = "at" if at_its_limit else "off"
    after, m = "none", None
    if fence == "even":
        start = body.rfind("\n") + 1
        tip = min((i for i in (body.find(c, start) for c in _AFTER_SIGNS) if i >= 0), default=-1)
        m = _AFTER.search(body, tip) if tip >= 0 else None
    if m:
        what = m.group().strip()
        cut = body[: m.start()].rstrip()
        note = bool(_NOTE.search(what))
        # brackets that a writer would put are left alone unless they say that text is missing
        if what[:1] not in "([" or note:
            after, body = ("note" if note else what[:1]), cut
    line = body[body.rfind("\n") + 1 :]
    before = body[: len(body) - len(line)].rstrip("\n")
    prev = before[before.rfind("\n") + 1 :]
    last = 0
    for x in _MARK.finditer(line):
        last = x.end()
    rest = line[last:].strip(" \t")
    while rest and rest[0] in _END_OK and last:
        rest = rest[1:].strip()
    bullet = _BULLET.match(line) is not None
    whole = last == 0
    frag = _BULLET.sub("", rest, count=1) if whole and bullet else rest
    label = _LABEL.match(frag)
    value = frag[label.end() :] if label else ""
    words = re.findall(r"[^\W\d_]+", frag)
    cjk = len(_CJK.findall(frag))
    n_words = len(words) if not cjk else cjk // 2 + 1
    end = body[-1:]
    tag = _TAG_OPEN.match(body, max(0, body.rfind("<"))) is not None
    shape = (
        "tag" if tag else "code" if fence == "open" else "fence" if line.strip().startswith("```") or end == "`" else "closed" if not frag else "table" if line.lstrip().startswith("|") else "rule" if not words and re.fullmatch(r"[-=_*~ ]{3,}", line) else
        "label" if label and whole and len(value) <= 24 and len(re.findall(r"[^\W\d_]{4,}", value)) == 0 else "formula" if whole and _FORMULA.match(frag) and len([w for w in words if len(w) > 3]) < 2 else "symbol" if not words else ("list" if bullet and n_words <= 5 else "item" if bullet else "line") if whole else "mid"
    )
    list_before = _BULLET.match(prev) is not None and not _MARK.search(prev)
    lower = frag.lower()
    f = [
        f"shape={shape}", f"shape={shape}|end={_kind(end)}", f"shape={shape}|words={_bucket(n_words)}", f"shape={shape}|after={after}", f"shape={shape}|at={at}", f"shape={shape}|{closed}", f"after={after}", f"at={at}", f"end={_kind(end)}|{closed}", f"fence={fence}", f"whole={whole}|words={_bucket(n_words)}",
        f"end2={body[-2:].lower()}", f"shape={shape}|listed={list_before}", f"shape={shape}|comma={',' in frag}|{_bucket(n_words)}",
    ]
    if shape in ("line", "list", "item", "mid", "label"):
        w = words[-1].lower() if words and not cjk else lower[-2:]
        f += [f"{shape}|upper={frag[:1].isupper()}|listed={list_before}", f"{shape}|upper={frag[:1].isupper()}|listed={list_before}|{_bucket(n_words)}", f"{shape}|last={w}", f"{shape}|first={(words[0].lower() if words and not cjk else lower[:2])}", f"{shape}|end3={lower[-3:]}"]
    return f


def _takes_end(text: str, at: int) -> bool:
    """Does a cut at ``at`` take the end off a sentence, a listing or a tag?"""
    if text.count("```", 0, at) % 2:
        return not text[at - 3 : at].endswith("`") and "```" in text[at:]
    if _TAG_OPEN.search(text[max(0, at - 14) : at]) and ">" in text[at : at + 14]:
        return True
    start, stop = text.rfind("\n", 0, at) + 1, text.find("\n", at)
    line = text[start : stop if stop >= 0 else len(text)]
    if line.lstrip().startswith(("|", "```", "$", "\\", "{")) or "→" in line:
        return False
    marks, here = [m.end() for m in _MARK.finditer(line)], at - start
    if here in marks or not any(m > here for m in marks):
        return False
    got = _BULLET.sub("", line[max([m for m in marks if m <= here], default=0) : here].strip(), count=1)
    return len(re.findall(r"[^\W\d_]", got)) >= (2 if _CJK.search(got) else 3) and not re.fullmatch(r"[^\W\d_]+\s*\d*[:：.]?", got)


def _places(text: str, rng: random.Random, n: int) -> list[int]:
    """Up to ``n`` random offsets whose cut takes an end off."""
    out: list[int] = []
    for _ in range(8 * n):
        if len(out) >= n or len(text) < 12:
            break
        at = rng.randrange(6, len(text))
        if _takes_end(text, at):
            out.append(at)
    return out


def _spoil(text: str, rng: random.Random) -> str:
    """What storage or generation puts after a cut, at times."""
    r = rng.random()
    if r < 0.55:
        return text
    if r < 0.7:
        return text + rng.choice(["</reason>", "\n</reason>", "</REASON>\n", "\n"])
    return text + rng.choice(["…", " [truncated]", f"\n[+{rng.randrange(50, 900)} chars]", "<cut>", "\\", " (output trimmed)", "�", f" \\frac{{{rng.randrange(9, 999)}", f" **{rng.randrange(9)}", "\\u00", f" (see `{rng.choice('abkxq')}_"]) + rng.choice(["", "", "</reason>"])


def _loop(text: str, rng: random.Random) -> str:
    """A copy that ends in a phrase said again and again, without its final mark."""
    a = rng.randrange(0, max(1, len(text) - 30))
    unit = text[a : a + rng.randrange(8, 60)].strip().rstrip(".?!。？！")
    gap = rng.choice([" ", ", ", "\n"]) if not _CJK.search(unit) else rng.choice(["", ",", "\n"])
    out = text[:a] + gap.join([unit] * rng.randrange(4, 30))
    return out[: len(out) - rng.randrange(0, len(unit))].rstrip()


def training_set(values: list[tuple[str, tuple]], seed: int = 11, cuts: int = CUTS) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Features, labels and the value they are of: every value as it is (0) and ``cuts`` cut copies (1).

    The few stored values that were really cut stand among the 0s, outnumbered
    by artificial ones of the same kind.
    """
    rng = random.Random(seed)
    rows, y, of = [], [], []

    def add(i: int, text: str, limits: tuple, label: int) -> None:
        rows.append(features(text, at_limit(text, limits)))
        y.append(label)
        of.append(i)

    for i, (text, limits) in enumerate(values):
        if not text or not text.strip():
            continue
        add(i, text, limits, 0)
        more = 2 if _CJK.search(text) else 1
        if rng.random() < LOOPS * more and len(text) > 60 and "```" not in text:
            loop = _loop(text, rng)
            if re.search(r"[^\W\d_]\Z", loop):
                add(i, loop + rng.choice([".", ".</reason>"]), limits, 0)
                add(i, _spoil(loop, rng), limits, 1)
        spots = _places(text, rng, cuts * more)
        spots += [n for is_bytes, n in limits if not is_bytes and 12 < n < len(text) and _takes_end(text, n)]
        for at in spots:
            cut = _spoil(text[:at], rng)
            add(i, cut, limits if rng.random() < 0.5 else ((False, len(cut)),), 1)
    return rows, np.array(y, dtype=float), np.array(of, dtype=int)


def fit(values: list[tuple[str, tuple]]) -> np.ndarray:
    """Weights of the second of two rounds.

    In the first, models of one half, in which the many cut copies outweigh what
    was really cut, tell which stored values of the other half these are; they are
    left out of the 0s of the second round, in which both classes count alike.
    Features of fewer than RARE rows are dropped, so no value is learnt by heart. An empty sample gives a model that flags nothing.
    """
    rows, y, of = training_set(values)
    if not len(y):
        w = np.zeros((1 << 16) + 1)
        w[-1] = -1.0
        return w
    x = Hashed().matrix(rows)
    x[np.bincount(x.ravel(), minlength=WIDTH)[x] < RARE] = 0
    clean = y == 1
    for half in (0, 1):
        own, other = of % 2 == half, of % 2 != half
        clean[own] |= score(train(x[other], y[other]), x[own]) < SUSPECT
    return train(x[clean], y[clean], balanced=True)


class Judge:
    """Scores texts on a worker."""

    def __init__(self, w: np.ndarray):
        self.w, self.names = w, Hashed()

    def __call__(self, texts: list[str | None], at_its_limit: list) -> np.ndarray:
        out = np.zeros(len(texts))
        there = [i for i, t in enumerate(texts) if t and not t.isspace()]
        if there:
            out[there] = score(self.w, self.names.matrix([features(texts[i], bool(at_its_limit[i])) for i in there]))
        return out


def length_limits(lengths: DataFrame) -> DataFrame:
    """Length limits ``src, is_bytes, length`` among ``lengths(src, is_bytes, length, n)``, ``n`` values each.

    Neighbours are looked up in blocks of lengths, each with its margins, so a
    source with a large share of all values is no single task.
    """
    size = 20 * LIMIT_AROUND
    block = lambda shift: F.floor((F.col("length") + shift) / size)
    near = lengths.select("*", F.explode(F.array_distinct(F.array(*[block(x) for x in (-LIMIT_AROUND, 0, LIMIT_AROUND)]))).alias("_block"))
    w = Window.partitionBy("src", "is_bytes", "_block").orderBy("length").rangeBetween(-LIMIT_AROUND, LIMIT_AROUND)
    spikes = near.withColumn("around", F.sum("n").over(w) - F.col("n")).where(block(0) == F.col("_block"))
    return spikes.where((F.col("n") >= LIMIT_COUNT) & (F.col("n") >= LIMIT_RATIO * F.col("around") / (2 * LIMIT_AROUND))).select("src", "is_bytes", "length")


#: Limits that travel with the scoring function; more are joined.
LIMITS_SHIPPED = 100_000
_LIMITS = "array<struct<is_bytes:boolean,length:int>>"


def _by_source(limits: DataFrame) -> DataFrame:
    """``src, limits``: the limits of each source as one array, bounded by the lengths it has."""
    return limits.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("is_bytes", "length"))).cast(_LIMITS).alias("limits"))


def _with_limits(rows: DataFrame, limits: DataFrame, shipped: int = LIMITS_SHIPPED, salts: int = 16) -> DataFrame:
    """``rows`` with the array ``limits`` of their ``src`` (null if it has none).

    Up to ``shipped`` limits are broadcast; those of more sources are joined by a
    shuffle, in which the rows of a source are spread over ``salts`` keys.
    """
    per = _by_source(limits)
    if limits.count() <= shipped:
        return rows.join(F.broadcast(per), "src", "left")
    per = per.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("rec_id"), F.lit(salts)).cast("int")).join(per, ["src", "_salt"], "left").drop("_salt")


def _survey(values: DataFrame, train_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(length limits, hashes of the sample by field)`` of ``values(field, src, rec_id, text)``, in one pass over the texts."""
    h = F.xxhash64("rec_id")
    fit_for_training = (F.length(F.trim("text")) > 0) & (F.length("text") <= TRAIN_CHARS)
    each = F.array(
        F.struct(F.lit("chars").alias("what"), F.col("src").alias("of"), F.length("text").alias("at"), F.lit(None).cast("bigint").alias("h")),
        F.struct(F.lit("bytes").alias("what"), F.col("src").alias("of"), F.octet_length("text").alias("at"), F.lit(None).cast("bigint").alias("h")),
        F.struct(F.lit("sample").alias("what"), F.col("field").alias("of"), F.pmod(h, F.lit(train_rows)).cast("int").alias("at"), F.when(fit_for_training, h).alias("h")),
    )
    seen = values.where(F.col("text").isNotNull()).select(F.explode(each).alias("x")).groupBy("x.what", "x.of", "x.at").agg(F.count("*").alias("n"), F.min("x.h").alias("h"))
    seen = cut(seen)
    lengths = seen.where("what <> 'sample'").select(F.col("of").alias("src"), (F.col("what") == "bytes").alias("is_bytes"), F.col("at").alias("length"), "n")
    return cut(length_limits(lengths)), seen.where("what = 'sample' and h is not null").select(F.col("of").alias("field"), F.col("h").alias("_hash"))


def truncated(fields: dict[str, DataFrame], train_rows: int = TRAIN_ROWS, shipped: int = LIMITS_SHIPPED) -> DataFrame:
    """Scores every text of the fields: ``field, rec_id, source, score, truncated``.

    ``fields``: name to a frame ``rec_id BIGINT, source STRING, text STRING``.
    One model for all; null, empty and blank texts get a null score and are never
    cut off; repeated rows come out as often as they went in; other columns are
    dropped. Whole texts count: fences are matched over the whole length, the last
    line is read from its start. The texts are read three times: for lengths and
    the choice of the sample, for the sample, and to be scored.
    """
    values = [df.select(F.lit(name).alias("field"), F.col("rec_id").cast("bigint").alias("rec_id"), "source", "text") for name, df in fields.items()]
    both = values[0]
    for v in values[1:]:
        both = both.unionByName(v)
    src = F.concat_ws("|", "field", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    keyed = both.select("field", src.alias("src"), "rec_id", "text")
    limits, hashes = _survey(keyed, train_rows)
    chosen = sampled_rows(keyed.where((F.length(F.trim("text")) > 0) & (F.length("text") <= TRAIN_CHARS)), "rec_id", hashes, "field")
    sample = sorted((r.field, r.rec_id, r.text, tuple(map(tuple, r.limits or ()))) for r in _with_limits(chosen, limits, shipped).collect())
    weights = fit([(t, lim) for _, _, t, lim in sample]).astype(np.float32)

    def make():
        judge = Judge(weights)

        def work(b: pa.RecordBatch) -> dict:
            text = b.column(3).to_pylist()
            s = judge(text, b.column(4).to_pylist())
            return {"field": b.column(0), "rec_id": b.column(1), "source": b.column(2), "score": [float(x) if t and not t.isspace() else None for x, t in zip(s, text)]}

        return work

    scored = _with_limits(spread(both).withColumn("src", src), limits, shipped).select("field", "rec_id", "source", "text", _at_limit(F.col("text"), F.col("limits")).alias("at"))
    out = map_rows(scored, "field string, rec_id bigint, source string, score double", make)
    return out.withColumn("truncated", F.coalesce(F.col("score") >= THRESHOLD, F.lit(False)))


def shares(scored: DataFrame) -> DataFrame:
    """How often each source truncates: ``field, source, texts, cut, share`` (texts that are not blank).

    ``scored``: rows ``field, source, score, truncated``, a blank text having no score.
    """
    return scored.groupBy("field", "source").agg(F.count("score").alias("texts"), F.count_if("truncated").alias("cut")).withColumn("share", F.when(F.col("texts") > 0, F.col("cut") / F.col("texts")))
