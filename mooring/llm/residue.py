"""Template residue, filler, error pages and script or check notices (problem 3).

All lines of all texts are counted by host in their normalised form (letters
lower-cased, numbers and hex ids as one sign; code and formulas as a hash). Lines a
host repeats in a large share of its records are its boilerplate and are subtracted.
A record is excluded when its residual holds *evidence*: a line, outside code,
formulas and quoted program text, that has an unfilled field or is filler, an error,
a check or a scripts notice. A record that holds nothing but boilerplate (lines that
recur as they are, numbers included, as these are content) is excluded when that has
evidence: a notice a host gives instead of any content is a case however often it
gives it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.llm.common import arrow_schema, map_rows
from mooring.llm.literals import Gate, literals
from mooring.session import cut, spread

#: A normalised line is boilerplate of a host when at least this share of the
#: host's records and at least this number of them have it. A line of one record
#: recurs nowhere; the number does not grow with the table.
BOILERPLATE_SHARE, BOILERPLATE_RECORDS = 0.05, 2

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_SPAN = re.compile(r"`[^`\n]*(?:`|$)", re.M)
_MATH = re.compile(r"\$\$.*?\$\$|\\[a-zA-Z]+(?:\{[^{}\n]*\}|\{\{[^{}\n]*\}\})*", re.S)
_QUOTED = re.compile("\"[^\"\n]+\"|“[^”\n]+”|«[^»\n]+»|「[^」\n]+」")
_TAG = re.compile(r"</?(?:reason|skeleton|think|answer)\s*>", re.I)
_NORMAL = re.compile(r"\b[0-9a-f]*\d[0-9a-f./]*\b|\d+")

#: A field nobody filled, in the notations of common template languages.
_FIELD = re.compile(
    r"""\{\{\s*[A-Za-z_][\w .\-]*\}\}            # {{ name }}
    | \{%\s*\w[^%\n]*%\}                         # {% if name %}
    | \$\{\s*[A-Za-z_]\w*\s*\}                   # ${name}
    | (?<![A-Za-z0-9_\\}{$^])\{[A-Za-z_]\w{2,}\} # {name}
    | \[\[\s*[A-Za-z_][\w ]*\]\]                 # [[name]]
    | <<\s*[A-Za-z_][\w ]*>>                     # <<name>>
    | @@\w+@@ | %%\w+%% | (?<![\w%])%[A-Z_]{3,}[A-Z0-9_]*% | %\(\w+\)s
    | (?<![A-Za-z0-9_])__[A-Z][A-Z0-9_]*__(?![A-Za-z0-9_])
    | \[\s*(?i:insert|your|enter|add|fill\ in|replace|placeholder)\b[^\]\n]{0,60}\]
    | \[[A-Z]{4,}(?:[_ ][A-Z0-9]+)*\](?!\S*\()   # [NAME]
    | <\s*(?i:your|insert|enter)\b[^>\n]{1,60}>
    | \bTODO\(\w*\)
    | (?m:^)\W{0,4}(?:TODO|FIXME|TBD)\b\s*:""",
    re.X,
)
#: Bracketed upper-case words that are log levels, not fields.
_LEVEL = re.compile(r"\[(?:ERROR|WARN|WARNING|INFO|DEBUG|FATAL|CRITICAL|TRACE)\]")
_NAME_TAG = re.compile(r"<([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*)>")
#: Tags that are markup.
_MARKUP = frozenset("REASON SKELETON THINK HTML HEAD BODY TITLE CENTER NOSCRIPT SCRIPT DIV SPAN CODE TABLE".split())

#: Words of the customary Latin filler.
_LATIN = frozenset(
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea eiusmod elit enim esse est et eu ex excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident qui quis reprehenderit sed sint sit sunt tempor ullamco ut velit veniam voluptate".split()
)
_STRONG_LATIN = _LATIN - frozenset("ad do ea est et eu ex id in non qui sed sit ut".split())
_KEYS = re.compile(r"^\W*(?:(?:tbd|tba|todo|fixme|x{2,}|asdf\w*|qwer\w*|hjkl|foo|bar|baz|blah|bla|lorem|ipsum|placeholder|dummy|test|n/a|sample text|filler text|text here|\.{3}|_{3,})\b\W*){2,}$|^\W*(?:tbd|tba|todo|placeholder|lorem ipsum|sample text|x{4,})\W*$", re.I)
_FILLER = re.compile(
    r"\b(?:dummy|placeholder|filler|sample|example|boilerplate)\s+(?:text|trace|reasoning|content|answer|output|paragraph)\b(?=[^.!?]{0,40}(?:[.!?]|$))"
    r"|\breplace\s+(?:this|me|before)\b|\bto\s+be\s+(?:added|filled|inserted|replaced|written|completed|provided)\b|\bgoes\s+here\b|\b(?:write|insert|enter|put|type|add)\s+(?:the|your|an?)\s+[\w ]{2,40}\s+(?:in\s+this\s+(?:block|field|box|section)|here)\b|\bcoming\s+soon\b"
    r"|\bhier\s+steht\s+(?:sp[äa]ter|demnächst)\b|\b(?:platzhalter|blindtext|mustertext)\b|\bwird\s+(?:noch|später)\s+(?:ergänzt|eingefügt)\b"
    r"|\btexte\s+(?:provisoire|à\s+remplacer|de\s+remplissage|fictif)\b|\bà\s+(?:remplacer|compléter)\b|\btexto\s+(?:provisional|de\s+relleno|provisorio|provisório|de\s+preenchimento|de\s+exemplo|de\s+ejemplo)\b|\bpor\s+(?:completar|rellenar)\b|\ba\s+(?:preencher|substituir)\b"
    r"|\btesto\s+(?:segnaposto|provvisorio|di\s+esempio)\b|\bda\s+(?:completare|sostituire|inserire)\b|\b(?:voorbeeldtekst|plaatshouder|nog\s+in\s+te\s+vullen|hier\s+komt\s+(?:later|de|het))\b|\baquí\s+va\s+(?:el|la|su)\b|\baqui\s+(?:vai|vem|entra)\s+[oa]\b|\bici\s+(?:viendra|le|la)\s+\w+\s*(?:[.!]|$)|\bqui\s+va\s+(?:il|la|lo|inserit)"
    r"|(?:здесь\s+будет|заполнить\s+позже|текст-заполнитель|вставьте\s+сюда)|此处填写|在此(?:填写|输入)|待(?:填写|补充)|占位|示例文本|ここに.{0,12}(?:入力|記入|書)|(?:仮|ダミー)の?(?:テキスト|文)|サンプルテキスト",
    re.I,
)

#: Standard reason phrases of HTTP errors.
_PHRASES = "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request time-?out|conflict|gone|length required|payload too large|uri too long|unsupported media type|unprocessable entity|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway time-?out"
_PAGE = re.compile(
    rf"<\s*(?:!doctype\s+html|html|body|noscript|title)\b|\{{\s*\"?(?:error|errors|status|code|message)\"?\s*:|\bstatus\s*=\s*[45]\d\d\b|^\W*(?:http\S*\s+)?(?:error\s+)?[45]\d\d\s*[:\-–]?\s*(?:{_PHRASES})\W*$|^\W*(?:{_PHRASES})\W*$"
    r"|traceback \(most recent call last\)|^\W*[\w.]*(?:Error|Exception)\s*:\s|^\W*(?:OutOfMemory|out of memory|segmentation fault|core dumped)\b|^\W*\[?(?:ERROR|FATAL)\]",
    re.I,
)
_ERROR = re.compile(
    r"^\W*(?:error|erreur|fehler|errore|erro|falha|fout|storing|ошибка|сбой|错误|錯誤|エラー|故障)\s*(?:n[o°.]\s*)?\(?#?\d{3}\)?\s*[:：\-–]"
    r"|\brate[ -]limit\s+(?:reached|exceeded|hit)|\b(?:quota|limit)\s+(?:exceeded|exhausted)|\bupstream\s+(?:closed|server|worker|error|timed|did|connect)|\b(?:service|site|server|system|page)\s+(?:is\s+)?(?:currently\s+|temporarily\s+)?(?:offline|down|unavailable|under\s+maintenance)|\bsomething\s+went\s+wrong\b|\b(?:please\s+)?try\s+again\s+(?:later|in\s+a)|\baccess\s+(?:is\s+)?denied\b|\b(?:request|connection)\s+(?:was\s+)?(?:timed\s+out|dropped|reset|refused|aborted|failed)\b|\b(?:could|can)\s*not\s+(?:find|load|open|display)\s+(?:this|the|that)\s+(?:page|file|resource)|\bpage\s+(?:was\s+)?not\s+found\b|\bcontact\s+(?:your|the)\s+administrator|\bgateway\s+closed\b|\bback\s+in\s+\d+\s+minutes\b|\btried\s+to\s+allocate\b"
    r"|(?:servicio|serviço|servizio|página|pagina|sitio|site|sito)\s.{0,24}(?:no\s+(?:está\s+)?disponible|indispon[íi]vel|non\s+(?:è\s+)?(?:disponibile|raggiungibile)|no\s+encontrad[ao]|não\s+encontrad[ao]|non\s+trovat[ao])|\bint[eé]ntelo\s+de\s+nuevo|\btente\s+novamente|\briprova\s+più\s+tardi|\bréessayez\b|\b(?:page|service)\s.{0,24}(?:introuvable|indisponible)|\b(?:dienst|seite|server)\s.{0,24}(?:nicht\s+(?:erreichbar|verfügbar|gefunden))|\bbitte\s+versuchen\s+sie\s+es\s+später|\b(?:dienst|pagina|server)\s.{0,24}niet\s+(?:beschikbaar|bereikbaar|gevonden)|\bprobeer\s+het\s+later"
    r"|(?:сервис|страница|сервер)\s.{0,24}(?:недоступ|не\s+найден)|попробуйте\s+позже|повторите\s+попытку|服务.{0,8}不可用|请稍后(?:重试|再试)|页面(?:未找到|找不到)|お試しください|(?:ページ|サービス).{0,10}(?:見つかりません|利用できません)",
    re.I,
)
_CHECK = re.compile(
    r"\b(?:verify|confirm|prove)\s+(?:that\s+)?you\s+(?:are|'re)\s+(?:a\s+|not\s+a\s+)?(?:human|robot|person)|\bnot\s+a\s+robot\b|\bcaptcha\b|\bchecking\s+(?:if\s+the\s+site|your\s+browser)|\b(?:please\s+)?(?:sign|log)\s?in\s+(?:again|to\s+(?:continue|view|see|access))|\bsession\s+(?:has\s+)?(?:expired|timed\s+out)"
    r"|\bmensch\s+sind\b|\bvous\s+êtes\s+(?:un\s+)?humain|\b(?:eres|es)\s+(?:un\s+)?humano\b|\bé\s+(?:um\s+)?humano\b|\bessere\s+(?:un\s+)?umano|\been\s+mens\s+bent|\bbitte\s+(?:melden\s+sie\s+sich|anmelden)|\bconnectez-vous\b|\binicie?\s+sesión|\binicie\s+(?:a\s+)?sessão|\baccedi\s+per\b|\blog\s+in\s+om\b|подтвердите,?\s+что\s+вы|войдите\s+(?:в|чтобы)|请(?:先)?登录|(?:验证|证明|确认)您?(?:是|不是)(?:真人|人类|机器人)|人机验证|ログインして|(?:人間|ロボットで(?:は)?ない)(?:である)?こと",
    re.I,
)
_SCRIPT = re.compile(r"java\s?script|ecmascript|\bscript(?:s|ing|e|en)?\b|скрипт|脚本|スクリプト", re.I)
_ENABLE = re.compile(
    r"\benabl|\bdisabled\b|\bturn(?:ed)?\b|\bswitch(?:ed)?\b|\brequire[sd]?\b|\bmust\s+be\b|\bhas\s+to\s+be\b|\bneeds?\b|\ballow\b|\bactivate|\bdoes\s+not\s+support|\bplease\b"
    r"|\bactiv(?:er|ez|ar|e|a)\b|\baktivier|\beinschalt|\bhabilit|\babilit|\battiv|\binschakel|\bzet\b|\bative\b|\bnecesari|\bnecessári|\brequis|\brequier|\bbenötig|\bvereist|\bnodig|включ|необходим|требу|启用|开启|打开|需要|有効|必要|オンに",
    re.I,
)
#: Signs that a sentence speaks about such a thing instead of being one.
_ABOUT = re.compile(
    r"\basks?\b|\bmeans\b|\bmeaning\b|\btells\s+the\b|\bdiscuss|\boption\s+[A-E]\b|\bdesigners?\b|\bquoted\b|\bprints?\b|\bexample\s+of\b|\bwhich\s+is\s+why\b|\bworks\s+without\b"
    r"|\bgefragt|\bantwort\s+[A-E]\b|\bbedeut|\bmeldet\b|\bstatuscode\b|\bindique\b|\bporte\s+sur\b|\bsignifie\b|\bsignifica\b|\bbetekent\b|означа|спрашива|含义|意思|问的是|意味|問われ",
    re.I,
)
#: Words for what a text is about; they govern a notice unless they are only what
#: it could not do, or are the reader's.
_SUBJECT = re.compile(r"\b(?:question|exercise|task|frage|aufgabe|pregunta|pergunta|domanda|vraag)\b|вопрос|题目|問題", re.I)
_OBJECT = re.compile(
    r"\b(?:your|ihre[rn]?|deine[rn]?|su|tu|votre|ta|sua|tua|uw|je|jouw|ваш\w*)\s+\Z|(?:您|你)的?\Z"
    r"|\b(?:process|handl|complet|load|answer|submit|generat|fetch|open|sav|send|perform|finish)\w*\s+(?:(?:the|this|that|a)\s+)?\Z|\b(?:thanks|thank\s+you)\s+for\s+(?:the\s+)?\Z",
    re.I,
)
_HAPPENED = re.compile(r"\s*(?:が(?:発生|起)|(?:has\s+|was\s+|is\s+)?(?:failed|aborted|timed\s+out|dropped|cancelled|canceled)\b)", re.I)
_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])")

#: What evidence begins with; a line is searched for those of which it has the literals.
_FIRST = (_PAGE, _FIELD, _ERROR, _CHECK, _SCRIPT, _KEYS, _FILLER)
_HAS_PAGE, _HAS_FIELD, _HAS_ERROR, _HAS_CHECK, _HAS_SCRIPT, _HAS_KEYS, _HAS_FILLER, _HAS_LATIN, _HAS_TAG = (1 << i for i in range(9))


@lru_cache(maxsize=1)
def _gate() -> Gate:
    return Gate([*map(literals, _FIRST), [[set(_STRONG_LATIN)]], [[{"<"}]]])


def _latin(line: str) -> bool:
    words = re.findall(r"[^\W\d_]+", line.lower())
    hits = sum(w in _LATIN for w in words)
    return hits >= 4 and hits >= 0.7 * len(words) and sum(w in _STRONG_LATIN for w in words) >= 3


def _about(sentence: str) -> bool:
    """Does the sentence speak about a notice instead of being one?"""
    return _ABOUT.search(sentence) is not None or any(not _OBJECT.search(sentence[: m.start()]) and not _HAPPENED.match(sentence, m.end()) for m in _SUBJECT.finditer(sentence))


def _stated(pattern: re.Pattern, line: str) -> bool:
    """Is a match in a sentence of the line that does not speak about it?"""
    ends, at = None, 0
    while m := pattern.search(line, at):
        ends = ends or [0, *(x.end() for x in _SENTENCE_END.finditer(line)), len(line)]
        start, stop = max(x for x in ends if x <= m.start()), min((x for x in ends if x >= m.end()), default=len(line))
        if not _about(line[start:stop]):
            return True
        at = m.start() + 1
        if at > len(line):
            break
    return False


def _evidence(line: str, text: str) -> str | None:
    """Kind of evidence of one stripped line of ``text``."""
    kind, has = None, _gate()(line)
    if not has:
        return None
    if has & _HAS_PAGE and _PAGE.search(line):
        kind = "error" if not re.search("<noscript", line, re.I) else "scripts"
    if kind is None:
        own = _LEVEL.sub(" ", _QUOTED.sub(" ", line))
        if has & _HAS_FIELD and _FIELD.search(own) or has & _HAS_TAG and any(t not in _MARKUP and f"</{t}>" not in text for t in _NAME_TAG.findall(own)):
            kind = "placeholder"
        elif has & _HAS_ERROR and _stated(_ERROR, own):
            kind = "error"
        elif has & _HAS_CHECK and _stated(_CHECK, own):
            kind = "check"
        elif has & _HAS_SCRIPT and _ENABLE.search(own) and _stated(_SCRIPT, own):
            kind = "scripts"
        elif has & _HAS_KEYS and _KEYS.match(own) and not _about(own):
            kind = "filler"
        if kind is None and (has & _HAS_FILLER and _stated(_FILLER, own) or has & _HAS_LATIN and any(map(_latin, [own, *_SENTENCE_END.split(own)]))):
            kind = "filler"
    return kind


def _mark(m: re.Match) -> str:
    """Stands for code or a formula in a line: its hash in letters no pattern takes for a word, or a blank if nothing is in it."""
    if not any(map(str.isalnum, m.group())):
        return " "
    return f" \ue000{''.join(chr(103 + int(c, 16)) for c in f'{xxhash.xxh32_intdigest(m.group()):x}')}\ue001 "


_MARKED = re.compile(" \ue000[g-v]*\ue001 ")


def _marked(text: str) -> str:
    if "`" in text:
        text = _SPAN.sub(_mark, _FENCE.sub(lambda m: f"\n{_mark(m)}\n", text))
    if "\\" in text or "$" in text:
        text = _MATH.sub(_mark, text)
    return _TAG.sub("", text) if "<" in text else text


def _hash(line: str) -> int:
    x = xxhash.xxh3_64_intdigest(line)
    return x - (1 << 64) if x >> 63 else x


def _forms(line: str) -> tuple[str, str]:
    """``(normalised, as it is)``; they are the same where the line has no number."""
    low = line.lower().strip()
    return _NORMAL.sub("#", low).strip(), low


def line_hashes(text: str) -> set[int]:
    """Hashes of the different lines of a text, normalised and as they are."""
    low = _marked(text).lower()
    out = {x.strip() for x in low.split("\n")}
    if (normal := _NORMAL.sub("#", low)) != low:
        out |= {x.strip() for x in normal.split("\n")}
    out.discard("")
    return set(map(_hash, out))


def lines(text: str | None) -> list[tuple[str | None, int, int]]:
    """``(kind of evidence or null, hash of the line normalised, hash of the line as it is)`` of a text with evidence.

    Lines with neither evidence nor a letter or digit are left out; a text without
    evidence has none, nor has a null or blank one.
    """
    if not text or text.isspace():
        return []
    own = [(line, _evidence(bare, text) if (bare := _MARKED.sub(" ", line).strip()) else None) for line in _marked(text).split("\n")]
    if not any(kind for _, kind in own):
        return []
    return [(kind, *map(_hash, _forms(line))) for line, kind in own if kind or any(map(str.isalnum, line))]


def evidence(text: str | None) -> list[str]:
    """Kind of each line with evidence; none for null and blank texts.

    Kinds: ``placeholder``, ``filler``, ``error``, ``check``, ``scripts``.
    """
    return [kind for kind, *_ in lines(text) if kind]


#: Line hashes a task holds before it sends their counts on.
HELD_LINES = 1 << 21


def _count(host: list[str | None], texts: list[str | None], held: dict) -> int:
    n = 0
    for h, t in zip(host, texts):
        own = held.setdefault(h, [0, []])
        own[0] += 1
        if t and not t.isspace():
            own[1] += (got := line_hashes(t))
            n += len(got)
    return n


def boilerplate(rows: DataFrame, share: float = BOILERPLATE_SHARE, records: int = BOILERPLATE_RECORDS) -> DataFrame:
    """``host, line``: the lines at least ``share`` of a host's records, and at least ``records`` of them, have.

    ``rows(host, text)``; a null host is a host of its own. Counted are all lines of
    all texts, a line once a record, normalised and, where they hold numbers, as
    they are too: each task sends on one row for each of its
    different lines of a host, and the line is part of the key, so no host is a hot
    spot. Hashes stand for the lines (64 bits).
    """
    schema = "host string, line bigint, n bigint"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for h, (n, own) in held.items():
                line, times = np.unique(np.array(own, np.int64), return_counts=True)
                size = len(line) + 1
                # the number of records stands beside the lines, under the line that is none
                yield pa.RecordBatch.from_arrays([pa.array([h] * size, pa.string()), pa.array([None, *line.tolist()], pa.int64()), pa.array([n, *times.tolist()], pa.int64())], schema=arrow)
            held.clear()

        n = 0
        for b in batches:
            n += _count(b.column(0).to_pylist(), b.column(1).to_pylist(), held)
            if n >= HELD_LINES:
                yield from out()
                n = 0
        yield from out()

    counts = spread(rows.select("host", "text")).mapInArrow(run, schema).groupBy("host", "line").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("line").isNull() | (F.col("n") >= records))
    counts = cut(counts)  # totals and lines are read from one count
    totals = counts.where("line is null").select(F.col("host").alias("_host"), F.col("n").alias("of"))
    own = counts.where("line is not null").join(totals, F.col("host").eqNullSafe(F.col("_host")))
    return own.where(F.col("n") >= share * F.col("of")).select("host", "line")


def residue(df: DataFrame, key: str, text: str, host: str, share: float = BOILERPLATE_SHARE, records: int = BOILERPLATE_RECORDS) -> DataFrame:
    """One row ``(key, kinds ARRAY<STRING>)`` for each record to exclude.

    ``key`` must be unique. A null host is a host of its own; null, empty and
    blank texts are never excluded; repeated texts count on their own; whole
    texts are read however long; an empty table gives no rows. The texts are read
    twice, to count their lines and to find evidence. Shuffled are counts of line
    hashes and the lines of the few records that have evidence.
    """
    kind = df.schema[key].dataType.simpleString()

    def make():
        def work(b: pa.RecordBatch) -> dict | None:
            rows = [(k, h, *x) for k, h, t in zip(*(c.to_pylist() for c in b.columns)) for x in set(lines(t))]
            return dict(zip(("k", "host", "kind", "line", "same"), zip(*rows))) if rows else None

        return work

    h = F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("null"))
    own = df.select(F.col(key).alias("k"), h.alias("host"), F.col(text).alias("text"))
    # rows of the few records with evidence, looked at more than once: kept, so the texts are read once
    told = cut(map_rows(own, f"k {kind}, host string, kind string, line bigint, same bigint", make, costly=True))
    often = boilerplate(own, share, records)
    shown = told.where("kind is not null")
    left = shown.join(often, ["host", "line"], "left_anti")
    only = shown.join(left, "k", "left_anti")
    # other lines as they are, since numbers are content
    other = told.where("kind is null").join(often.withColumnRenamed("line", "same"), ["host", "same"], "left_anti")
    nothing = only.join(other, "k", "left_anti")
    return left.unionByName(nothing).groupBy("k").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).withColumnRenamed("k", key)
