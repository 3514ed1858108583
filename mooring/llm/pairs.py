"""Defective entries of prompt and response pairs (problem 5).

Each answer and reasoning is aligned with the question of its method: shingle
containment finds candidates for copies and the longest common subsequence of
tokens decides; refusals are aligned, sentence by sentence, with refusal templates
by longest common subsequence, and count only if nothing else is left; the language comes
from the context trees of :mod:`mooring.llm.language`, a missing end from the
regression of :mod:`mooring.llm.truncation`. Each entry gets at most one defect,
the first of empty, copies_question, refusal, other_language, truncated.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache, reduce
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.functions.lcs import lcs_length
from mooring.llm import language, truncation
from mooring.llm.common import TRAIN_CHARS, hash_sample, map_rows

DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated")
#: Tokens of a shingle; share of the response's shingles that must be the
#: question's; share of both texts' tokens that the alignment must cover.
SHINGLE, CONTAINED, COVERED = 2, 0.8, 0.9
#: Share of a response's tokens that sentences aligned with refusal templates must
#: hold, and tokens any other sentence may have.
REFUSED, LEFT = 0.8, 4
#: Rows of the table read to train the end detector.
TRAIN_ROWS = 1500

_TAGS = re.compile(r"</?[A-Za-z][\w-]*\s*/?>")
#: Words that stand for no value.
_STAND_IN = frozenset(
    x.strip()
    for x in "none, null, nil, nan, na, n/a, undefined, unknown, empty, missing, blank, void, tbd, tba, no answer, no response, no reasoning, no output, no value, not available, not applicable, not provided, not given, answer missing, keine antwort, keine angabe, nicht verfügbar, entfällt, sin respuesta, no disponible, sin datos, pas de réponse, aucune réponse, non disponible, néant, sem resposta, não disponível, nessuna risposta, non disponibile, geen antwoord, niet beschikbaar, geen, нет ответа, нет данных, нет, 无, 無, 没有答案, 无答案, 暂无, 空, なし, 無回答, 該当なし, 回答なし".split(",")
)
_PREFIX = re.compile(r"^\W*(?:q|question|user|human|prompt|input|frage|pregunta|pergunta|domanda|vraag|вопрос|问题|题目|質問|問題|問)\s*\d*\s*[:：]\s*", re.I)
#: Combining marks, those of kana too.
_COMBINING = re.compile("[\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]+")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+")

#: Refusal templates. A template is put together from an opening, a
#: core, an act and an ending, of which only the core must be there; cores that say
#: it all have no act. Greetings and thanks may stand beside a refusal.
_OPENINGS = """
i'm sorry | i am sorry | i'm sorry but | i am sorry but | sorry | sorry but | my apologies | apologies | my apologies but | apologies but | unfortunately | regrettably | i'm afraid | i am afraid that | as an ai | as an assistant | as a language model | as an ai language model | i'm sorry but as an ai language model | thank you for the question but | i appreciate the question but | i have to say that
es tut mir leid | es tut mir leid aber | tut mir leid | leider | als assistent | als assistentin | als sprachmodell | als ki | ich bedaure | entschuldigung
lo siento | lo siento mucho | lo siento pero | lamentablemente | desafortunadamente | como asistente | como modelo de lenguaje | disculpe
je suis désolé | je suis désolée | je suis désolé mais | désolé | désolé mais | malheureusement | en tant qu'assistant | en tant qu'ia | en tant que modèle de langage | je regrette
desculpe | desculpe mas | lamento | lamento mas | infelizmente | sinto muito | como assistente | como modelo de linguagem
mi dispiace | mi dispiace ma | purtroppo | spiacente | come assistente | come modello linguistico
het spijt me | het spijt me maar | helaas | sorry maar | als assistent | als taalmodel
извините | извините но | простите | к сожалению | как помощник | как ассистент | как языковая модель | мне жаль | мне жаль но
抱歉 | 很抱歉 | 对不起 | 很遗憾 | 非常抱歉 | 作为助手 | 作为语言模型 | 作为一个人工智能 | 抱歉但是
申し訳ありませんが | 申し訳ございませんが | すみませんが | 残念ながら | アシスタントとして | 言語モデルとして | 恐れ入りますが
"""
_CORES = """
i can't | i cannot | i can not | i could not | i couldn't | i won't | i will not | i do not want to | i am unable to | i'm unable to | i am not able to | i'm not able to | i won't be able to | i will not be able to | i am not in a position to | i'm not in a position to | i am not allowed to | i'm not allowed to | i am not permitted to | i'm not permitted to | it is not possible for me to | it's impossible for me to | i must decline to | i have to decline to | i must refuse to | i have to refuse to | i refuse to | i decline to | i'd rather not | i would rather not | i prefer not to | i'd prefer not to | i would prefer not to | i don't feel comfortable | i do not feel comfortable | i'm not comfortable | my rules don't allow me to | my rules do not allow me to | my guidelines don't allow me to | my guidelines do not permit me to | my instructions don't permit me to | i will have to pass on | i have to pass on | we can't | we cannot | we are unable to
this is something i won't be able to help with | this is outside of what i may talk about | this topic is outside of what i may talk about | this goes against my guidelines | that goes against my rules | no comment on that from me | i can't | i cannot | i won't
dabei kann ich nicht helfen | dabei kann ich leider nicht helfen | damit kann ich nicht helfen | das kann ich nicht beantworten | das kann ich leider nicht beantworten | diese frage kann ich nicht beantworten | diese frage darf ich leider nicht beantworten | ich kann diese frage nicht beantworten | ich darf diese frage nicht beantworten | ich kann dir dabei nicht helfen | ich kann ihnen dabei nicht helfen | ich möchte diese frage nicht beantworten | ich muss diese anfrage ablehnen | muss ich diese anfrage ablehnen | dazu möchte ich mich nicht äußern | darüber möchte ich nicht sprechen | dazu kann ich nichts sagen | ich kann darauf nicht antworten
no puedo ayudar con esa solicitud | no puedo ayudarte con eso | no puedo responder a esta pregunta | no puedo contestar | no me es posible responder a esta pregunta | no me es posible ayudar con eso | debo negarme a contestar | debo rechazar esta solicitud | prefiero no opinar sobre este tema | prefiero no responder a esta pregunta | no puedo continuar con esta tarea
je ne peux pas vous aider | je ne peux pas vous aider avec cette demande | je ne peux pas répondre à cette question | il m'est impossible de répondre à cette question | il m'est impossible de vous aider | je dois refuser de répondre | je dois refuser cette demande | je préfère ne pas me prononcer sur ce sujet | je préfère ne pas répondre à cette question | je ne suis pas en mesure de répondre
não posso ajudar com esse pedido | não posso responder a esta pergunta | não me é possível responder a esta pergunta | devo recusar a resposta | devo recusar este pedido | tenho de recusar este pedido | prefiro não falar sobre este assunto | prefiro não responder a esta pergunta | não consigo ajudar com isso
non posso aiutarti con questa richiesta | non posso aiutare con questo | non posso rispondere a questa domanda | non mi è possibile rispondere a questa domanda | devo rifiutare di rispondere | devo rifiutare questa richiesta | preferisco non esprimermi su questo tema | preferisco non rispondere a questa domanda | non sono in grado di rispondere
daar kan ik niet bij helpen | daar kan ik u helaas niet mee helpen | hier kan ik niet mee helpen | deze vraag mag ik helaas niet beantwoorden | deze vraag kan ik niet beantwoorden | ik kan deze vraag niet beantwoorden | moet ik dit verzoek weigeren | ik moet dit verzoek weigeren | ik laat me hier liever niet over uit | daar kan ik geen antwoord op geven | ik wil deze vraag liever niet beantwoorden
я не могу помочь с этим запросом | я не могу помочь с этим | я не могу ответить на этот вопрос | ответить на этот вопрос невозможно | на этот вопрос ответить нельзя | я вынужден отказаться от ответа | я вынуждена отказаться от ответа | я предпочёл бы не обсуждать эту тему | я предпочла бы не отвечать на этот вопрос | мне нельзя отвечать на этот вопрос
我无法回答这个问题 | 我不能回答这个问题 | 这个问题我不能回答 | 我无法协助完成这个请求 | 我无法帮助您完成这个请求 | 我不能提供帮助 | 我必须拒绝回答 | 我必须拒绝这个请求 | 我不方便对此发表看法 | 我不便回答 | 我无法提供这方面的信息
その質問には回答できません | この質問には回答できません | この質問にはお答えできません | そのご依頼にはお応えできません | その依頼には対応できません | その話題については控えさせていただきます | 回答を控えさせていただきます | 回答をお断りします | お手伝いできません | お答えすることはできません
"""
_ACTS = """
help | help with that | help with this | help you with that | help you with this question | help with this request | assist | assist with that | assist you with that request | answer | answer that | answer this | answer this question | answer the question | answer your question | answering this question | answering this | discussing this | talking about that | doing that | provide an answer | provide an answer to this question | give an answer to that | provide that information | share that information | give that information | discuss it | discuss that | discuss this topic | talk about that | talk about this topic | talk about it | continue | continue with this task | continue with this | comply | comply with the request | comply with this request | fulfil this request | fulfill this request | this request | give advice on this subject | give an opinion on that | offer an opinion on this | produce such a text | write such a text | create that content | solve this one | solve this task | solve it | do that | do this | complete this task | complete the request | comment | comment on that | comment on this matter | respond | respond to that | respond to this question | engage with this topic | support this request | say | this one | that | with that
"""
_ENDINGS = """
at this time | at the moment | right now | for you | as it may cause harm | because it may cause harm | as it goes against my guidelines | as it goes against my rules | because of my guidelines | in any way | in good conscience | so i must decline | so i have to decline | so i will have to pass | so i'll pass | instead | today | i hope you understand
leider | im moment | ich bitte um verständnis
en este momento | por ahora
pour le moment | pour l'instant
neste momento | de momento
in questo momento | al momento
op dit moment
в данный момент | сейчас
目前 | 请谅解
現在 | ご了承ください
"""
#: What may stand beside a refusal without being an answer.
_BESIDE = """
thank you for the question | thank you for your question | thanks for asking | thanks for the question | thank you for your understanding | thank you for understanding | thank you for your patience | hello | hi | hello there | good day | sorry | my apologies | apologies | i'm sorry | i have read the task | i have read the question | i read your question | please consult a qualified person instead | please consult a qualified expert instead | please ask a qualified expert | let me know if you have another question | let me know if you have any other questions | is there anything else i can help with | is there anything else i can do for you | is there anything else you would like to discuss | i hope you understand | as an ai language model | it goes against my guidelines
danke für die frage | vielen dank für die frage | danke für dein verständnis | vielen dank für ihr verständnis | hallo | guten tag | ich habe die aufgabe gelesen | ich habe die frage gelesen | es tut mir leid | bitte wenden sie sich an eine fachperson | ich bitte um verständnis
gracias por la pregunta | gracias por su comprensión | gracias por tu comprensión | hola | buenos días | he leído el enunciado | he leído la pregunta | lo siento | por favor consulte a un especialista
merci pour la question | merci de votre compréhension | merci pour votre question | bonjour | j'ai lu l'énoncé | j'ai lu la question | je suis désolé | veuillez consulter un spécialiste
obrigado pela pergunta | obrigada pela pergunta | obrigado pela compreensão | olá | bom dia | li o enunciado | já li a pergunta | desculpe | consulte um especialista por favor
grazie per la domanda | grazie per la comprensione | ciao | salve | buongiorno | ho letto il testo | ho letto la domanda | mi dispiace | consulti uno specialista per favore
bedankt voor de vraag | bedankt voor uw begrip | hallo | goedendag | ik heb de opgave gelezen | ik heb de vraag gelezen | het spijt me | raadpleeg een deskundige
спасибо за вопрос | спасибо за понимание | здравствуйте | привет | я прочитал условие | я прочитал вопрос | я прочитала задачу | извините | обратитесь к специалисту
感谢您的提问 | 谢谢您的问题 | 谢谢理解 | 您好 | 你好 | 我已经读过题目 | 我看过这个问题 | 抱歉 | 请咨询专业人士
ご質問ありがとうございます | ご理解ください | ご理解いただけますと幸いです | こんにちは | 問題文を読みました | 質問を読みました | 申し訳ありません | 専門家にご相談ください
"""
#: Share of the tokens of a sentence and of a template that their alignment must cover, and of a part of a template alone.
ALIGNED, PART = 0.75, 0.8
_PART_END = re.compile(r"(?<=[.!?。！？])\s*|\n+")
#: Names of the languages in the languages, as stems.
_ASKED = {
    "en": "english englisch inglés anglais inglês inglese engels английск 英语 英文 英語",
    "zh": "chinese chinesisch chino chinois chinês cinese chinees китайск 中文 汉语 中国語",
    "de": "german deutsch alemán allemand alemão tedesco duits немецк 德语 ドイツ語",
    "es": "spanish spanisch español espagnol espanhol spagnolo spaans испанск 西班牙语 スペイン語",
    "fr": "french französisch francés français francês francese frans французск 法语 フランス語",
    "pt": "portuguese portugiesisch portugués portugais português portoghese portugees португальск 葡萄牙语 ポルトガル語",
    "it": "italian italienisch italiano italien italiaans итальянск 意大利语 イタリア語",
    "nl": "dutch niederländisch holländisch neerlandés holandés néerlandais holandês olandese nederlands нидерландск голландск 荷兰语 オランダ語",
    "ru": "russian russisch ruso russe russo русск 俄语 ロシア語",
    "ja": "japanese japanisch japonés japonais japonês giapponese japans японск 日语 日本語",
}
_ASKED_RE = {c: re.compile("|".join(rf"(?<!\w){w}" if w.isascii() or ord(w[0]) < 0x3000 else w for w in names.split()), re.I) for c, names in _ASKED.items()}
#: Letters below which the language of a text is not judged.
LEAST_LETTERS = 8


def is_empty(v: str | None) -> bool:
    """Missing, null, or nothing but blanks, marks, empty tags or a stand-in for no value."""
    if v is None:
        return True
    s = _TAGS.sub(" ", v)
    if not any(c.isalnum() for c in s):
        # a text of symbols only, such as a formula sign, says something; marks don't
        return all(unicodedata.category(c)[0] in "ZCP" or c in "<>|~^`=+$" for c in s)
    stand_in = lambda x: " ".join(x.split()).strip(" .,;:!?-–—_*\"'`()[]{}<>“”‘’「」。").casefold() in _STAND_IN
    s = s.strip()
    # one stand-in, or nothing but stand-ins on lines of their own
    return stand_in(s) or "\n" in s and all(stand_in(x) for x in s.split("\n") if any(map(str.isalnum, x)))


def tokens(s: str) -> list[str]:
    """Words, numbers and single Han or kana characters, without case, accents and width."""
    if s.isascii():
        return _TOKEN.findall(s.lower())
    return _TOKEN.findall(_COMBINING.sub("", unicodedata.normalize("NFKD", s).casefold()))


_question_tokens = lru_cache(maxsize=4096)(tokens)


def copies(question: str, v: str) -> bool:
    """Is ``v`` nothing but the question, in whatever writing?"""
    q, a = _question_tokens(question), tokens(_PREFIX.sub("", _TAGS.sub(" ", v)))
    if not q or not a or len(a) < 0.6 * len(q):
        return False
    shingles = {tuple(q[i : i + SHINGLE]) for i in range(len(q) - SHINGLE + 1)} or {tuple(q)}
    own = list(zip(*(a[i:] for i in range(SHINGLE)))) or [tuple(a)]
    if sum(map(shingles.__contains__, own)) < CONTAINED * len(own):
        return False
    if len(a) > 1.5 * len(q):  # said more than once
        times = round(len(a) / len(q))
        return lcs_length(q * times, a) >= COVERED * max(len(a), len(q) * times)
    return lcs_length(q, a) >= COVERED * max(len(a), len(q))


def _sentences(lists: str) -> list[list[str]]:
    return sorted({tuple(tokens(t)) for line in lists.strip().split("\n") for t in line.split("|")}, key=lambda t: (-len(t), t))


class _Parts:
    """Token templates, found by the tokens they share with a sentence."""

    def __init__(self, lists: str):
        self.own = [list(t) for t in _sentences(lists)]
        self.repeats = [len(t) - len(set(t)) for t in self.own]
        self.index: dict[str, list[int]] = {}
        for i, t in enumerate(self.own):
            for x in set(t):
                self.index.setdefault(x, []).append(i)

    def near(self, a: list[str], share: float) -> list[list[str]]:
        """Templates of whose tokens at least ``share`` align with ``a``, the longest first."""
        shared = Counter(i for x in set(a) for i in self.index.get(x, ()))
        # an alignment has no more tokens than both share, repeated ones of the template included
        near = sorted(i for i, n in shared.items() if n + self.repeats[i] >= share * len(self.own[i]))
        return [self.own[i] for i in near if lcs_length(self.own[i], a) >= share * len(self.own[i])]


@lru_cache(maxsize=1)
def _refusals() -> tuple[_Parts, _Parts, _Parts, _Parts, _Parts, int]:
    cores, *rest = (_Parts(x) for x in (_CORES, _OPENINGS, _ACTS, _ENDINGS, _BESIDE))
    return cores, *rest, sum(len(p.own[0]) for p in (cores, *rest[:3]))


def aligns(sentence: str | list[str]) -> bool:
    """Is the sentence, but for a few tokens, a refusal template?

    Cores that align give the template together with the longest opening, act and
    ending that align; then the whole template and the sentence must cover each
    other.
    """
    cores, openings, acts, endings, _, longest = _refusals()
    a = tokens(sentence) if isinstance(sentence, str) else sentence
    if not a or len(a) * ALIGNED > longest:
        return False
    near = cores.near(a, PART)
    if not near:
        return False
    first = lambda parts: next(iter(parts.near(a, 1.0)), [])
    opening, act, ending = first(openings), first(acts), first(endings)
    for core in near:
        for t in (core, opening + core + ending, opening + core + act, opening + core + act + ending):
            if min(len(t), len(a)) >= ALIGNED * max(len(t), len(a)) and lcs_length(t, a) >= ALIGNED * max(len(t), len(a)):
                return True
    return False


def beside(sentence: str | list[str]) -> bool:
    """Is the sentence a greeting, thanks or the like, which gives no answer?"""
    a = tokens(sentence) if isinstance(sentence, str) else sentence
    return any(lcs_length(t, a) >= ALIGNED * max(len(t), len(a)) for t in _refusals()[4].near(a, PART))


def _parts(s: str) -> Iterator[str]:
    """Sentences and lines, one at a time, as most texts are told by the first."""
    at = 0
    for m in _PART_END.finditer(s):
        yield s[at : m.start()]
        at = m.end()
    yield s[at:]


def refuses(v: str) -> bool:
    """Does ``v`` decline to respond and give nothing else?

    Every sentence is aligned with the refusal templates and with what may stand
    beside them; the sentences that align must hold REFUSED of the tokens, and no
    other may have more than LEFT.
    """
    n = covered = 0
    refused = False
    for part in _parts(_TAGS.sub(" ", v)):
        a = tokens(part)
        if not a:
            continue
        n += len(a)
        if aligns(a):
            refused = True
        elif not beside(a):
            if len(a) > LEFT:
                return False
            continue
        covered += len(a)
    return refused and covered >= REFUSED * n


def asked(question: str) -> set[str]:
    """Languages the question names."""
    return {c for c, p in _ASKED_RE.items() if p.search(question)}


class Checker:
    """Finds the defect of entries, on a worker."""

    def __init__(self, model, weights: np.ndarray):
        self.judge, self.ends = language.Judge(model), truncation.Judge(weights)
        self.names = model.classes

    def languages(self, texts: list[str]) -> list[str | None]:
        """Main language of each text; null where too little prose is in it."""
        parts = []
        for t in texts:
            p = [s for _, _, s in language.sentences(t)]
            if not p:  # no whole sentence: whatever prose there is
                rest = re.sub(r"```.*?(?:```|\Z)|`[^`\n]*`|\$\$.*?\$\$|</?[^<>\n]*>|\\[A-Za-z]+(?:\{[^{}\n]*\})*", " ", t, flags=re.S)
                words = [w for w in re.findall(r"[^\W\d_]+", rest) if len(w) > 1 or ord(w) > 0x3000]
                p = [rest] if len(words) >= 3 and sum(map(len, words)) >= LEAST_LETTERS or sum(ord(c) > 0x3000 for c in rest) >= 4 else []
            parts.append([language.clean(s) for s in p])
        flat = [s for p in parts for s in p]
        bits = self.judge.bits(flat) if flat else np.zeros((0, len(self.names)))
        out, at = [], 0
        for p in parts:
            b = bits[at : at + len(p)]
            at += len(p)
            if not len(p):
                out.append(None)
                continue
            size = np.array([len(s) for s in p], float)
            share = np.bincount(b.argmin(1), size, len(self.names))
            main = int(share.argmax())
            second = np.partition(b.sum(0), 1)[1] if len(self.names) > 1 else np.inf
            out.append(self.names[main] if share[main] >= 0.5 * size.sum() and (second - b.sum(0)[main] >= min(20, 0.8 * size.sum()) or len(p) > 1) else None)
        return out

    def __call__(self, pairs: list[tuple[str, str | None]]) -> list[str | None]:
        """Defect of each ``(question, entry)``; null for sound ones."""
        out: list[str | None] = [None] * len(pairs)
        open_ = []
        for i, (q, v) in enumerate(pairs):
            if is_empty(v):
                out[i] = "empty"
            elif q and copies(q, v):
                out[i] = "copies_question"
            elif refuses(v):
                out[i] = "refusal"
            else:
                open_.append(i)
        if not open_:
            return out
        texts = list(dict.fromkeys([t for i in open_ for t in (pairs[i][0], pairs[i][1]) if t]))
        lang = dict(zip(texts, self.languages(texts)))
        entries = list(dict.fromkeys(pairs[i][1] for i in open_))
        cut = dict(zip(entries, self.ends(entries, [()] * len(entries)) >= truncation.THRESHOLD))
        for i in open_:
            q, v = pairs[i]
            own, of = lang.get(v), lang.get(q) if q else None
            if own and of and own != of and own not in asked(q):
                out[i] = "other_language"
            elif cut[v]:
                out[i] = "truncated"
        return out


def pairs_of(question_map: Iterable, entry_map: Iterable | None) -> list[tuple[str, str | None, str | None]]:
    """``(method, question, entry)`` of one row; a repeated key of the entries counts once, the last."""
    own = dict(entry_map or ())
    return [(m, q, own.get(m)) for m, q in dict(question_map or ()).items()]


def defects(rows: DataFrame, model, key: str = "sample_idx", questions: str = "questions", fields: tuple[str, ...] = ("answers", "reasonings"), train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row ``(key, method, field, defect)`` for each defective entry.

    ``rows`` has maps from method to text; ``model``: language trees. Every key of
    ``questions`` has an entry in each field, a missing key or a null map being
    empty ones; a row with null or empty questions has none. A null question
    still lets entries be empty, refusals or truncated. Repeated rows come out as
    often as they went in; other columns are dropped. No shuffle.
    """
    kind = rows.schema[key].dataType.simpleString()
    sample: set[str] = set()
    chars = lambda f: F.coalesce(F.aggregate(F.map_values(f), F.lit(0), lambda n, v: n + F.coalesce(F.length(v), F.lit(0))), F.lit(0))
    size = reduce(lambda a, b: a + b, map(chars, fields))
    for r in hash_sample(rows.select(key, *fields).where(size <= TRAIN_CHARS), key, train_rows).collect():
        for f in fields:
            sample |= {v for v in (r[f] or {}).values() if v and len(v) > 20}
    weights = truncation.fit([(t, ()) for t in sorted(sample)]).astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        check = Checker(shared.value, weights)

        def work(b: pa.RecordBatch) -> dict | None:
            keys, qs, *maps = (c.to_pylist() for c in b.columns)
            out: list[tuple] = []
            for at in range(0, len(keys), 256):
                todo = [(k, m, f, q, v) for i in range(at, min(at + 256, len(keys))) for f, own in zip(fields, maps) for k in (keys[i],) for m, q, v in pairs_of(qs[i], own[i])]
                distinct = list(dict.fromkeys((q or "", v) for *_, q, v in todo))
                got = dict(zip(distinct, check(distinct)))
                out += [(k, m, f, got[q or "", v]) for k, m, f, q, v in todo if got[q or "", v]]
            if not out:
                return None
            return dict(zip(("k", "method", "field", "defect"), zip(*out)))

        return work

    return map_rows(rows.select(F.col(key).alias("k"), questions, *fields), f"k {kind}, method string, field string, defect string", make, costly=True).withColumnRenamed("k", key)
