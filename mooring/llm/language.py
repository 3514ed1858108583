"""Language of documents and of the segments of mixed ones (problem 8).

Sentences are cut out of a text (code, formulas, tags, quoted words, role and
step headings don't count), every sentence is scored by the frozen context trees
of :mod:`mooring.llm.ppm`, one for each language, and gets the language that codes
it shortest; neighbours of one language form a segment. The trees are trained on
the driver from a bounded sample of delivered labels. Labels may be wrong, so the
sample is sifted first: a sentence whose four-byte runs are more frequent under
another label than its own is left out. (Frequencies of whole runs, not of a byte
after its context, because a few wrongly labelled texts make up their own contexts
and would look at home in any tree that has seen them.)
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooring.llm.common import TRAIN_CHARS, hash_sample, map_rows
from mooring.llm.ppm import Model, _grams

#: Labelled documents a language, and bytes of their sentences, for training.
TRAIN_DOCS, TRAIN_BYTES = 600, 150_000
#: Sentences read of each of them, evenly spaced over the whole document.
TRAIN_SENTENCES = 8
#: Bits by which a sentence must be shorter in another language than that of
#: most of its document to count as one of that language, and bits a byte.
MARGIN_BITS, MARGIN_RATE = 20.0, 0.8
#: Bytes of text scored at once on a worker.
CHUNK_BYTES = 1 << 19

#: What doesn't count, each with the signs one of which it needs.
_BLANK = [
    ("```", re.compile(r"```.*?(?:```|\Z)", re.S)),
    ("`", re.compile(r"`[^`\n]*(?:`|$)", re.M)),
    ("$", re.compile(r"\$\$.*?\$\$|\$[^$\n]{1,80}\$", re.S)),
    ("\\", re.compile(r"\\\[.*?\\\]|\\\(.*?\\\)|\\[A-Za-z]+(?:\{[^{}\n]*\})*", re.S)),
    ("<", re.compile(r"<skeleton>.*?(?:</skeleton>|\Z)|</?[A-Za-z!][^<>\n]*>", re.S | re.I)),
    ("://", re.compile(r"https?://\S+")),
    ("@", re.compile(r"\S+@\S+\.\S+")),
    ('"', re.compile('"[^"\n]+"')),
    ("“„«‹「『《‘", re.compile("“[^”\n]+”|„[^“”\n]+[“”]|«[^»\n]+»|‹[^›\n]+›|「[^」\n]+」|『[^』\n]+』|《[^》\n]+》|‘[^’\n]{2,}’(?!\\w)")),
    ("'", re.compile(r"(?<![\w’'])'[^'\n]{2,}'(?!\w)")),
]


def _spaces(m: re.Match) -> str:
    s = m.group()
    return " " * len(s) if "\n" not in s else re.sub(r"[^\n]", " ", s)


_SENTENCE = re.compile(r"[^.?!。？！…\n]*(?:(?:\.(?!\s|\Z|[\"'”’»)\]])|…(?!\s|\Z))[^.?!。？！…\n]*)*(?:[.?!]+|[。？！…]+)[\"'”’»)\]]*")
_HEAD = re.compile(r"\s*(?:[-*•>#|]+\s+|\(?\d{1,3}[.)]\s+|\*{1,3})*(?:[^\W\d_]+\s*\d*\s*[:：]\s*)?(?:\*{1,3}\s*)?")
_RESULT = re.compile(r"\s*[^:：\n]{1,40}[:：]\**(?:(?![^\W\d_]{3}).)*\Z")
_NUMBER = re.compile(r"\d[\d.,/]*")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"(?:[぀-ヿ㐀-鿿][^぀-ヿ㐀-鿿]*){4}")


def _wordy(s: str) -> bool:
    """At least two words of eight letters in all, or four Han or kana characters."""
    if not s.isascii() and _HAN.search(s):
        return True
    n = letters = 0
    for m in _WORD.finditer(s):
        n, letters = n + 1, letters + m.end() - m.start()
        if n >= 2 and letters >= 8:
            return True
    return False


def sentences(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, letters and marks)`` of the sentences of a text, offsets in code points.

    A sentence ends with its mark on its own line and has at least two words of
    eight letters in all, or four Han or kana characters; a label with a mere
    result behind its colon is none.
    """
    if not text:
        return []
    for signs, p in _BLANK:
        if signs in text or len(signs) == 8 and any(x in text for x in signs):
            text = p.sub(_spaces, text)
    out = []
    at = 0
    for line in text.split("\n"):
        start = at
        at += len(line) + 1
        if line.isspace() or not line or line.lstrip()[:1] == "|":
            continue
        head = _HEAD.match(line).end()
        for m in _SENTENCE.finditer(line, head):
            s = m.group()
            if (":" in s or "：" in s) and _RESULT.match(s):
                continue
            if _wordy(s):
                out.append((start + m.start() + len(s) - len(s.lstrip()), start + m.end(), s))
    return out


def clean(sentence: str) -> bytes:
    """What of a sentence is scored: lower case, digits as one sign, single spaces."""
    return (" " + _NUMBER.sub("0", " ".join(sentence.lower().split()))).encode("utf-8", "replace")


def label_code(lang: Column, codes: list[tuple[str, str, str]]) -> Column:
    """The code a delivered label stands for, null for none.

    ``codes``: ``(code, English name, ISO 639-3)``. Case, white space, regions and
    scripts behind - or _ don't matter.
    """
    names = {x.lower(): c for row in codes for c in row[:1] for x in row}
    table = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    low = F.lower(F.regexp_replace(lang, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.element_at(F.split(low, "[-_]"), 1)))


def read_codes(lang_codes: DataFrame) -> list[tuple[str, str, str]]:
    """The small fixed table of languages."""
    return sorted((r.lang, r.english_name, r.iso3) for r in lang_codes.select("lang", "english_name", "iso3").collect())


def train_model(docs: DataFrame, lang_codes: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = TRAIN_DOCS) -> Model:
    """Trees trained from at most ``per_language`` labelled documents of each language.

    A language without any labelled sentence keeps an empty tree, which never wins.
    """
    codes = read_codes(lang_codes)
    names = [c for c, _, _ in codes]
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), label_code(F.col(label), codes).alias("c")).where(F.col("c").isNotNull() & (F.length("t") <= TRAIN_CHARS))
    got: dict[str, list[tuple[int, bytes]]] = {c: [] for c in names}
    for r in sorted(hash_sample(labelled, "k", per_language, by="c").collect(), key=lambda r: str(r.k)):
        own = sentences(r.t)
        n = min(len(own), TRAIN_SENTENCES)
        got[r.c] += [clean(own[i * len(own) // n][2]) for i in range(n)]

    def bounded(lists: dict) -> list[list[bytes]]:
        out = []
        for c in names:
            kept, used = [], 0
            for s in lists[c]:
                if used >= TRAIN_BYTES:
                    break
                kept.append(s)
                used += len(s)
            out.append(kept)
        return out

    return Model(names, bounded(_sift(names, got)))


def _sift(names: list[str], got: dict[str, list[bytes]]) -> dict[str, list[bytes]]:
    """The sentences at home under their own label."""
    flat = [(i, s) for i, c in enumerate(names) for s in got[c]]
    if not flat:
        return got
    runs = [_grams(np.frombuffer(s, np.uint8), 3) for _, s in flat]
    sizes = np.array([len(r) for r in runs])
    owner = np.repeat([i for i, _ in flat], sizes)
    keys, inv = np.unique(np.concatenate(runs), return_inverse=True)
    counts = np.bincount(inv * len(names) + owner, minlength=len(keys) * len(names)).reshape(-1, len(names))
    total = counts.sum(0)
    log = np.log((counts + 0.05) / (total + 0.05 * len(keys)))
    log[:, total == 0] = -1e9
    sums = np.add.reduceat(log[inv], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
    kept: dict[str, list[bytes]] = {c: [] for c in names}
    for (i, s), b in zip(flat, sums):
        if b[i] >= b.max():
            kept[names[i]].append(s)
    return kept


class Judge:
    """Languages of sentences, on a worker."""

    def __init__(self, model: Model):
        self.model = model
        self.empty = np.array([not len(self._own(i)) for i in range(len(model.classes))])

    def _own(self, i: int) -> np.ndarray:
        return np.flatnonzero(self.model.cost[0][:, i] < 8) if len(self.model.cost[0]) else np.empty(0)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        b = [self.model.bits(texts[i : j]) for i, j in _chunks(texts)]
        return np.concatenate(b) if b else np.zeros((0, len(self.model.classes)))

    def document(self, parts: list[tuple[int, int, str]], bits: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """Segments ``(start, end, class, confidence, sentences)`` of a document's sentences."""
        if not parts:
            return []
        best = bits.argmin(1)
        if (best == best[0]).all():
            b = bits.sum(0)
            return [(parts[0][0], parts[-1][1], int(best[0]), float(1 / np.exp2(np.clip(b[best[0]] - b, -1000, 60)).sum()), len(parts))]
        share = np.bincount(best, sizes, bits.shape[1])
        main = int(share.argmax())
        gain = bits[:, main] - bits.min(1)
        own = np.where(gain >= np.maximum(MARGIN_BITS, MARGIN_RATE * sizes), best, main)
        out = []
        at = 0
        while at < len(own):
            to = at
            while to + 1 < len(own) and own[to + 1] == own[at]:
                to += 1
            b = bits[at : to + 1].sum(0)
            p = np.exp2(np.clip(b[own[at]] - b, -1000, 60))
            out.append((parts[at][0], parts[to][1], int(own[at]), float(1 / p.sum()), to - at + 1))
            at = to + 1
        return out


def _chunks(texts: list[bytes]) -> list[tuple[int, int]]:
    out, start, used = [], 0, 0
    for i, t in enumerate(texts):
        used += len(t)
        if used >= CHUNK_BYTES:
            out.append((start, i + 1))
            start, used = i + 1, 0
    if start < len(texts):
        out.append((start, len(texts)))
    return out


def segments(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, segment INT, first INT, last INT, lang, confidence, sentences INT``.

    One row for each run of sentences in one language; ``first`` and ``last`` are
    the offsets (code points, end exclusive). A null, empty or blank text and one
    without a sentence have no rows; repeated rows come out as often as they went
    in. Confidence is the share of the language's likelihood among all, from the
    exact code lengths. No shuffle; the trees travel with the function (their
    size is bounded by TRAIN_BYTES and the number of languages).
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        judge = Judge(shared.value)
        names = judge.model.classes

        def work(b: pa.RecordBatch) -> dict | None:
            rows = []
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(keys), 512):
                parts = [sentences(t) for t in texts[i : i + 512]]
                flat = [clean(s) for p in parts for _, _, s in p]
                bits, sizes = judge.bits(flat), np.array([len(s) for s in flat], dtype=float)
                at = 0
                for k, p in zip(keys[i : i + 512], parts):
                    rows += [(k, n, *x) for n, x in enumerate(judge.document(p, bits[at : at + len(p)], sizes[at : at + len(p)]))]
                    at += len(p)
            if not rows:
                return None
            k, n, first, last, lang, conf, count = zip(*rows)
            return {"k": k, "segment": n, "first": first, "last": last, "lang": [names[x] for x in lang], "confidence": conf, "sentences": count}

        return work

    return map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), f"k {kind}, segment int, first int, last int, lang string, confidence double, sentences int", make, costly=True).withColumnRenamed("k", key)


def languages(docs: DataFrame, model: Model, lang_codes: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``key, label, langs ARRAY, lang, confidence, mixed, wrong`` for each document with a sentence.

    ``label``: the code of the delivered label or null; ``langs``: all languages
    with a sentence, sorted; ``lang`` and ``confidence``: that of most of the text;
    ``wrong``: no label, or one that isn't the language of a one-language text.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        judge = Judge(shared.value)
        names = judge.model.classes

        def work(b: pa.RecordBatch) -> dict | None:
            out = {c: [] for c in ("k", "label", "langs", "lang", "confidence")}
            keys, texts, labels = (c.to_pylist() for c in b.columns)
            for i in range(0, len(keys), 512):
                parts = [sentences(t) for t in texts[i : i + 512]]
                flat = [clean(s) for p in parts for _, _, s in p]
                bits, sizes = judge.bits(flat), np.array([len(s) for s in flat], dtype=float)
                at = 0
                for k, lab, p in zip(keys[i : i + 512], labels[i : i + 512], parts):
                    got = judge.document(p, bits[at : at + len(p)], sizes[at : at + len(p)])
                    at += len(p)
                    if got:
                        main = max(got, key=lambda x: x[1] - x[0])
                        for c, v in zip(out, (k, lab, sorted({names[x[2]] for x in got}), names[main[2]], main[3])):
                            out[c].append(v)
            return out if out["k"] else None

        return work

    rows = map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t"), label_code(F.col(label), read_codes(lang_codes)).alias("label")), f"k {kind}, label string, langs array<string>, lang string, confidence double", make, costly=True)
    return rows.withColumns({"mixed": F.size("langs") > 1, "wrong": F.col("label").isNull() | ((F.size("langs") == 1) & (F.col("label") != F.col("lang")))}).withColumnRenamed("k", key)


def found(checked: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, lang``: a row for each language of a document that is mixed or wrongly labelled."""
    return checked.where(F.col("mixed") | F.col("wrong")).select(key, F.explode("langs").alias("lang"))


