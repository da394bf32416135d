"""Defective answers to prompts: empty, the prompt again, refusals, another language, broken off.

Copies: the answer is compressed with its prompt as a zstandard dictionary; what is left over is what the
answer adds. Language and refusals: dictionaries of words and phrases. Breaking off: open brackets and
quotations, and a model of terminal contexts, which counts over all answers how often the last words
before a place end a sentence, an item or a text there, and how often they go on. Only the contexts in
which some answer stops without a mark are counted: their hashes, as a bit table of fixed size, filter the
others before the shuffle, and the counts of the contexts themselves are exact: how words end is counted
over the different capitalised words of the whole collection, so that no figure depends on the partitions.
"""

from __future__ import annotations

import functools
import itertools
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.sentences import units
from glyphmill.llm.words import mix
from glyphmill.storage import materialise

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")

# Placeholders that stand for no answer, after folding and without marks.
PLACEHOLDERS = frozenset("na|none|null|nil|nan|undefined|empty|blank|no answer|no output|no response|no reply|no content|no text|nothing|left blank|not available|not applicable|tbd|leer|keine antwort|keine ausgabe|vide|aucune réponse|sans réponse|vacío|sin respuesta|пусто|нет ответа|无|空|無し|なし|回答なし".split("|"))

# Frequent words that few other languages of the list share.
FUNCTION_WORDS = {
    "en": "the and of a an in on to as at every this that these those from their them with some because which what was were did do does once another people who when while until although whereas unless but said through over before after beyond has have had they you your it its is are be by for not no or if into about give one how why where there then so would could can will more than any all we he she his her our my i me him us been being each other such only own same too very just should must may might again against between both during few most off out under up down here",
    "de": "der die das und ist nicht mit von dem den des ein eine einen einer einem eines im am in an zu zum zur auf für über trotz nach vor neben ohne gegen seit jeden jeder jede bei sich wir ich sie er es aber oder weil warum wie auch nur aus zwischen durch hat wird war als um so da sind dass noch schon wenn werden haben sein seine ihre unter bis kann man mehr sehr wurde dieser diese dieses kein keine",
    "fr": "le la les des de du un une et est dans pour par sur avec sans au aux chez car où pourquoi depuis avant après pendant vers près qui que ne pas ce cette ces il elle nous vous mais ou dès malgré côté même chaque certains en à a se son sa ses plus comme je tu ils elles leur leurs on dont entre sous lors été être avoir fait très tout tous toute",
    "es": "el la los las un una del de y e es en con por para según hacia desde antes después durante junto cerca porque dónde cada hay que no pero como más muy su sus al lo sin sobre se a está son este esta estos estas ese esa fue ser ha han entre cuando donde ya también hasta todo todos le les yo ni o si mi",
    "ru": "и в не на а как что это по из у после зачем каждый ещё без очень",
    "it": "il lo la i gli le di del della dei delle degli e in nel nella che non con per un una sono è dove perché dopo prima ogni a da si al su come più ma anche questo questa quello suo sua loro essere ha hanno tra fra quando se ci alla dalla sul sulla uno",
    "pt": "o a os as um uma de do da dos das e em no na com para não que por mais como são está onde depois antes cada se ao seu sua mas foi ser ele ela eles pelo pela isso este esta entre quando também já nos nas muito até sem sobre à às",
    "nl": "de het een van en in niet met voor op zijn naar ook maar bij uit om door waar waarom elke te dat die is was aan er ze hij wij ik je dit deze nog wel geen heeft hebben worden werd als dan over tot onder tussen zich",
    "sv": "och att det som en ett på är av för med den till inte om har han hon de var jag men så från vi när där eller under efter vid sin sitt sina kan ska skulle mycket hade över utan mellan",
    "da": "og at det som en et på er af for med den til ikke om har han hun de var jeg men så fra vi når der eller under efter ved sin sit sine kan skal ville meget havde over uden mellem også blev",
    "pl": "i w na z do się nie to że jest jak o ale po co tak od za przez był była było są dla czy już przed oraz jego jej ich który która które przy bez nad pod tylko może gdy więc",
    "cs": "a v na se je že do to s z o i jako ale po za od pro by byl byla bylo jsou není který která které při bez nad pod jen když také ve ze jeho její mezi",
    "ro": "și în de la cu pe nu este o un că din care pentru mai sau dar sunt fost era prin după fără între când unde ce își său sa lui ei lor al ale",
    "hu": "a az és hogy nem is egy ez volt van de meg csak ki be mint már után alatt között nélkül minden még vagy ha sem lesz azt ezt aki ami",
    "fi": "ja on ei se että hän oli joka mutta kun niin myös ovat tai jos kuin ole olla ennen jälkeen ilman kanssa mukaan sen tämä jossa mitä vain",
    "tr": "ve bir bu da de için ile çok ne daha gibi ama en olan olarak kadar sonra önce her şey ya veya değil ki mi mı var yok ben sen o biz onlar üzerinde arasında",
    "vi": "và của là có không được cho một những các trong với khi này đã để người như ra về lại từ thì cũng nhưng đến sau trước vào nhiều rất vì nên sẽ ở",
    "id": "dan yang di ke dari untuk dengan tidak ini itu pada adalah dalam akan juga oleh sebagai atau karena ada sudah telah mereka kami kita saya dia lebih setelah sebelum antara tetapi",
}

# Names of languages as prompts ask for them.
LANGUAGE_NAMES = {
    "en": "English Englisch englischer anglais inglés inglese английском английски 英語 英语 英文",
    "de": "German Deutsch deutscher allemand alemán немецком немецки ドイツ語 德语 德文",
    "fr": "French Französisch französischer français francés французском французски フランス語 法语 法文",
    "es": "Spanish Spanisch spanischer espagnol español испанском испански スペイン語 西班牙语",
    "ru": "Russian Russisch russischer russe ruso русском русски ロシア語 俄语 俄文",
    "zh": "Chinese Chinesisch chinesischer chinois chino китайском китайски 中国語 中文 汉语",
    "ja": "Japanese Japanisch japanischer japonais japonés японском японски 日本語 日语 日文",
    "ar": "Arabic Arabisch arabischer arabe árabe арабском арабски アラビア語 阿拉伯语 العربية",
    "hi": "Hindi хинди ヒンディー語 印地语 हिन्दी हिंदी",
    "th": "Thai Thailändisch thaï tailandés тайском タイ語 泰语 ไทย",
    "it": "Italian Italienisch italien italiano итальянском イタリア語 意大利语",
    "pt": "Portuguese Portugiesisch portugais portugués португальском ポルトガル語 葡萄牙语",
    "nl": "Dutch Niederländisch néerlandais neerlandés голландском オランダ語 荷兰语",
}
#: Words that stand before the language in such a request.
ASKING = r"(?:\bin|\binto|\bauf|\ben|\bна|\bпо|\bin\s+the|用|で書|\bin\s+plain|\bin\s+simple)"

# Phrases by which an answer declines, after folding; ~ stands for a few words.
REFUSALS = """i('m| am) (very |so |truly )?sorry,? (but )?i (can't|cannot|can not|won't|am unable|am not able|must)
i (can't|cannot|can not|could not|won't|will not|am unable to|'m unable to|am not able to|'m not able to|am not allowed to|am not permitted to|do not feel able to) (~)?(help|assist|write|answer|produce|provide|create|generate|complete|fulfil|fulfill|comply|continue|do (that|this|what)|support|respond|give|discuss|take)
won't be able to (do|help|write|answer|assist|complete|provide)
i (must|have to|need to|will have to|am going to have to) (~)?(decline|pass|refuse|say no|turn (this|it|that) down|abstain)
something (that )?i (have to|must|need to) decline
(isn't|is not) something (that )?i (can|could|am able to|will) (~)?
my (guidelines|rules|policies|policy|instructions|principles) (do not|don't|forbid|prohibit|prevent|keep|stop)
(i'd|i would) (rather|prefer) not
(i'd|i would) prefer to (pass|decline)
no answer can be given
as (a|an) (\\w+ )?(text|language|ai)?( |-)?(model|assistant|ai),? (~)?(cannot|can't|won't|am unable|am not)
(falls|lies|is) (outside|beyond) (of )?what i (may|can|am)
(against|outside) my (guidelines|rules|policies|policy)
i (respectfully )?(decline|refuse)
(kann|können|darf|möchte|werde|will) (ich|wir) (~)?(nicht|nichts|leider nicht|keine|keinen)
ich (kann|darf|möchte|werde|will) (~)?(nicht|nichts|leider|keine|keinen)
muss ich (~)?(ablehnen|verzichten|absagen)
ich (muss|lehne) (~)?(ablehnen|ab)\\b
tut mir leid,? (~)?nicht
(je|j') ?(ne )?(suis désolé|regrette|préfère ne pas|dois (~)?(refuser|décliner)|refuse|décline)
je ne (peux|puis|pourrai|saurais|souhaite) pas
il m'est impossible
m'est pas possible
(lo siento|lamento|me temo),? (~)?no (puedo|podré|me es posible)
no (me es posible|puedo|podré|debo) (~)?(ayudar|escribir|responder|hacer|cumplir|completar|atender|tratar|dar)
(prefiero|preferiría) no
(debo|tengo que) (~)?(rechazar|declinar|negarme)
я (~)?(не могу|не стану|не буду|не в состоянии|вынужден[аы]? (~)?отказ|отказыва)
(не могу|не смогу) (~)?(помочь|написать|ответить|выполнить)
(вынужден[аы]?|приходится|должен|должна) (~)?отказ
(предпоч\\w+|лучше) (~)?не (отвечать|писать|буду)
(できません|いたしかねます|お断り|お答えできません|お手伝いできません|書けません|応じられません|控えさせて|お受けできません|致しかねます|差し控え)
(抱歉|对不起|很遗憾)[，,]?.{0,12}(不能|无法|没法|不便)
我(不能|无法|没法|不便|拒绝)
(无法|不能)(完成|回答|提供|写|协助|满足|帮助)
(لا أستطيع|لا يمكنني|أعتذر|آسف|عذرا)
(क्षमा करें|माफ़ कीजिए|माफ़ करें|नहीं कर सकता|नहीं लिख सकता|मदद नहीं)
(ขออภัย|ขอโทษ|ไม่สามารถ|ไม่อาจ)"""
FINAL = ".!?…。！？｡।؟۔॥"
CLOSING = "\"”’'»」』)]）】>*_~`"
OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“”"}
TOKEN = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|[^\W\d_぀-ヿ㐀-鿿฀-๿]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*|[.!?…。！？｡।؟۔॥]+|\n|[^\w\s]|_")
CHARS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@functools.lru_cache(maxsize=1)
def refusal_pattern() -> re.Pattern[str]:
    few = r"(?:\S+ ){0,7}?\S*? ?"
    return re.compile("|".join(f"(?:{line.replace('(~)?', few).replace(' ~', ' ' + few)})" for line in REFUSALS.splitlines()))


#: Parts of words, one of which stands in every phrase of REFUSALS.
REFUSAL_STEMS = "sorry|can't|cannot|can not|could not|won't|will not|unable|not able|not allowed|not permitted|feel able|declin|i must|have to|need to|going to have|isn't something|is not something|my guidelines|my rules|my polic|my instructions|my principles|rather not|prefer|no answer can|what i |respectfully|refuse|ich |muss |tut mir leid|désolé|regrette|préfère|refus|déclin|je ne |impossible|m'est pas|siento|lamento|me temo|no me es|no puedo|no podr|no debo|prefier|preferir|debo |tengo que|я |не могу|не смогу|вынужд|приходится|должен|должна|предпоч|лучше|できません|かねます|お断り|書けません|応じられ|控え|抱歉|对不起|很遗憾|我不|我无|我没|我拒|无法|不能|لا أستطيع|لا يمكنني|أعتذر|آسف|عذرا|क्षमा|माफ़|नहीं|मदद|ขออภัย|ขอโทษ|ไม่สามารถ|ไม่อาจ"


@functools.lru_cache(maxsize=1)
def _stems() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, stem in enumerate(REFUSAL_STEMS.split("|")):
        a.add_word(stem, k)
    a.make_automaton()
    return a


@functools.lru_cache(maxsize=1)
def _format_marks() -> re.Pattern[str]:
    """All characters of the category Cf."""
    return re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cf") + "]")


def fold(text: str) -> str:
    """Plain lower case with single blanks, for comparisons."""
    if text.isascii():
        return " ".join(text.lower().split())
    shown = _format_marks().sub("", unicodedata.normalize("NFKC", text))
    return " ".join(shown.casefold().replace("’", "'").replace("‘", "'").split())


SHOWN = re.compile(r"[^\W_]")
MOST_PLACEHOLDER = max(map(len, PLACEHOLDERS))


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    letters = sum(1 for _ in itertools.islice(SHOWN.finditer(text), MOST_PLACEHOLDER + 1))
    if letters > MOST_PLACEHOLDER:  # more than any placeholder has
        return False
    words = " ".join("".join(c if c.isalnum() else " " if c not in "/.'" else "" for c in fold(text)).split())
    return words in PLACEHOLDERS or not words and not any(unicodedata.category(c) in ("So", "Sc") for c in text)


@functools.lru_cache(maxsize=512)
def _dictionary(prompt: str) -> tuple[str, zstandard.ZstdCompressor | None]:
    folded = fold(prompt)
    data = folded.encode()
    if len(data) < 8:  # shorter than a dictionary can be
        return folded, None
    return folded, zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)


EDGES = "\"'“”«»„「」>*_`.!?…。 "


def novelty(answer: str, prompt: str) -> tuple[int, float]:
    """Bytes that the folded answer adds to its prompt, and its length as a part of the prompt's."""
    folded, compressor = _dictionary(prompt)
    given, whole = answer.strip(EDGES), folded.strip(EDGES)
    if compressor is None:
        return (0 if given == whole else 10**6), 1.0
    data, own = given.encode(), whole.encode()
    part = len(data) / max(1, len(own))
    if part > 2:  # far too long for a copy, whatever it holds
        return len(data), part
    return len(compressor.compress(data)) - len(compressor.compress(own)), part


#: Labels before a prompt that is given back.
LABEL = re.compile(r"\s*[>\"'“«„*_#]*\s*(?:the |your |user |original )?(?:prompt|question|q|request|instructions?|task|you asked|you wrote|frage|aufgabe|demande|consigne|pregunta|вопрос|задание|質問|问题)\s*[:：]\s*", re.IGNORECASE)


def is_copy(answer: str, prompt: str, most_new: int = 20, new_part: float = 0.3, least_part: float = 0.6) -> bool:
    """The answer adds at most ``most_new`` bytes to the prompt, and ``new_part`` of its length; both are folded. Prompts under 8 bytes must be equal."""
    folded = fold(answer)
    label = LABEL.match(folded)
    new, part = novelty(folded[label.end() :] if label else folded, prompt)
    return new <= min(most_new, max(6, new_part * len(prompt.encode()))) and least_part <= part <= 1.6


QUOTE_ENDS = {'"': '"', "“": "”", "«": "»", "„": "“”", "「": "」", "『": "』"}
QUOTE_START = re.compile("[" + "".join(QUOTE_ENDS) + "]")


def unquoted(text: str) -> str:
    """The text with each quotation that closes in its line as a blank."""
    out, done, at, later = [], 0, 0, {}
    while (m := QUOTE_START.search(text, at)) is not None:
        k = m.start()
        if later.get(m[0], (-1, 0))[0] <= k:  # the next end of such a quotation, or of the line
            n = re.compile(f"[{QUOTE_ENDS[m[0]]}\n]").search(text, k + 1)
            later[m[0]] = (n.start() if n else len(text), bool(n) and n[0] != "\n")
        end, closes = later[m[0]]
        if closes:
            out += [text[done:k], " "]
            done = at = end + 1
        else:
            at = k + 1
    return "".join([*out, text[done:]])


def is_refusal(text: str) -> bool:
    """Declines outside of quotations, and hardly says anything else."""
    if next(_stems().iter(text.lower().replace("’", "'")), None) is None:
        return False
    bare = unquoted(text)
    if len(text) - len(bare) > 60:
        return False
    pattern, rest, hits = refusal_pattern(), 0, 0
    for a, b in units(bare):
        part = fold(bare[a:b])
        if pattern.search(part):
            hits += 1
        else:
            rest += len(part)
    return hits > 0 and rest <= 160 + 40 * hits


@functools.lru_cache(maxsize=1)
def _word_languages() -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for lang, words in FUNCTION_WORDS.items():
        for w in words.split():
            out.setdefault(w, {})[lang] = 1.0
    return {w: {k: 1 / len(v) for k in v} for w, v in out.items()}


@functools.lru_cache(maxsize=8192)
def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250:
        return "latin"
    if ch in "іїєґІЇЄҐ":
        return "uk"
    if ch in "پچژگکی":
        return "fa"
    for lo, hi, name in ((0x370, 0x400, "el"), (0x400, 0x530, "ru"), (0x590, 0x600, "he"), (0x600, 0x780, "ar"), (0x900, 0x980, "hi"), (0xE00, 0xE80, "th"), (0x3040, 0x3100, "kana"), (0x3400, 0xA000, "han"), (0xAC00, 0xD7B0, "ko"), (0x1E00, 0x1F00, "latin"), (0xFB50, 0xFE00, "ar"), (0xFE70, 0xFF00, "ar")):
        if lo <= o < hi:
            return name
    return "other"


def language_shares(text: str) -> dict[str, float]:
    """Share of the text's letters in each language, judged line by line and sentence by sentence; unjudged ones left out."""
    total: Counter[str] = Counter()
    known = _word_languages()
    for part in re.split(r"(?<=[.!?…。！？।؟:])[\"”»」)]*\s*|\n+", text):
        words = CHARS.findall(part)
        if not words:
            continue
        letters = "".join(words)
        if letters.isascii():
            scripts = Counter({"latin": len(letters)})
        else:
            scripts = Counter(map(_script, letters))
        latin = scripts.pop("latin", 0)
        kana, han = scripts.pop("kana", 0), scripts.pop("han", 0)
        if kana or han:
            total["ja" if kana * 12 >= han else "zh"] += 3 * (kana + han)
        for script, n in scripts.items():
            if script != "other":
                total[script] += n
        if latin:
            votes: Counter[str] = Counter()
            for w in words:
                for lang, v in known.get(w.lower(), {}).items():
                    votes[lang] += v
            if votes:
                (best, most), *others = votes.most_common(2)
                if not others or most > others[0][1]:
                    total[best] += latin
    whole = sum(total.values())
    return {k: v / whole for k, v in total.items()} if whole else {}


@functools.lru_cache(maxsize=512)
def expected_language(prompt: str) -> str | None:
    """The language that the prompt asks for, else its own."""
    for lang, names in LANGUAGE_NAMES.items():
        for name in names.split():
            if re.search(ASKING + r"[\s-]*(?:\w+\s+){0,1}?" + re.escape(name) + r"(?!\w)" if not _cjk(name) else re.escape(name) + r"(?:で|に)|用" + re.escape(name), prompt):
                return lang
    shares = language_shares(prompt)
    return max(shares, key=shares.get) if shares else None


def _cjk(word: str) -> bool:
    return any(_script(c) in ("kana", "han") for c in word)


SCRIPTS = {"ru": re.compile("[Ѐ-ԯ]"), "ja": re.compile("[぀-ヿ一-鿿]"), "ar": re.compile("[\u0600-ۿ]"), "hi": re.compile("[ऀ-ॿ]"), "th": re.compile("[฀-๿]")}


def _surely(text: str, lang: str) -> bool:
    """A quick look that finds most answers in the right language; the others are judged sentence by sentence."""
    if lang in SCRIPTS:
        own = len(SCRIPTS[lang].findall(text))
        if own < 0.6 * len(text):
            return False
        return lang != "ja" or len(re.findall("[぀-ヿ]", text)) * 8 > own
    if lang not in FUNCTION_WORDS:
        return False
    words, known = CHARS.findall(text), _word_languages()
    if not text.isascii() and len(FOREIGN_LETTERS.findall(text)) > 0.1 * len(text):
        return False
    votes: Counter[str] = Counter()
    for w in words:
        if (langs := known.get(w.lower())) is not None:
            votes.update(langs.keys())
    rest = max((n for k, n in votes.items() if k != lang), default=0)
    return votes[lang] >= 0.2 * len(words) > 0 and votes[lang] >= 1.25 * rest


#: Letters beyond Latin, Greek and their marks.
FOREIGN_LETTERS = re.compile("[\u0400-\u1dff\u2e80-\ud7ff\uf900-\ufaff]")


def is_other_language(text: str, prompt: str, least: float = 0.55) -> bool:
    wanted = expected_language(prompt)
    if not wanted or _surely(text, wanted):
        return False
    words = CHARS.findall(text)
    if wanted in FUNCTION_WORDS and len(words) >= 20 and sum(wanted in _word_languages().get(w.lower(), ()) for w in words) < 0.04 * len(words):
        return True  # whatever language it is, known or not: hardly a word of the wanted one's most frequent
    shares = language_shares(text)
    return bool(wanted and shares and sum(v for k, v in shares.items() if k != wanted) >= least and sum(map(len, words)) >= 12)


class Vocabulary:
    """Small numbers for tokens, with arrays of what they are; it is emptied when it has grown."""

    LIMIT = 400_000

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes, self.classes, self.flags = [], [], []

    def add(self, token: str) -> int:
        first = token[0]
        h = xxhash.xxh3_64_intdigest(token.lower())
        self.hashes.append(h)
        self.classes.append(NAME if first.isupper() and len(token) > 1 else DIGITS if first.isdigit() else h)
        self.flags.append(1 if first in FINAL else 2 if first == "\n" else 0)
        n = self.number[token] = len(self.number)
        return n

    def numbers(self, tokens: list[str]) -> list[int]:
        get, add = self.number.get, self.add
        return [n if (n := get(t)) is not None else add(t) for t in tokens]

    def fresh(self) -> Vocabulary:
        return Vocabulary() if len(self.number) > self.LIMIT else self


NAME, DIGITS, LINE, ENDING, START = (xxhash.xxh3_64_intdigest(x) for x in ("<name>", "<digits>", "<line>", "<ending>", "<start>"))
#: Contexts, most telling first: the last three words, with names and numbers as classes; the last two; two as written; the last.
KINDS = ("three", "two", "written", "one", "ending", "whole")


def contexts(numbers: list[int], vocabulary: Vocabulary, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the contexts (a row for each of the first four KINDS) of the tokens that aren't final marks, and whether an end follows."""
    at = np.asarray(numbers, np.int64)
    h, c = np.array(vocabulary.hashes, np.uint64)[at], np.array(vocabulary.classes, np.uint64)[at]
    flag = np.array(vocabulary.flags, np.int8)[at]
    stop = flag > 0
    before = lambda x, n: np.r_[np.full(min(n, len(x)), LINE, np.uint64), x[: max(0, len(x) - n)]]
    with np.errstate(over="ignore"):
        one = mix(h + np.uint64(side))
        two = mix(before(c, 1) * np.uint64(3) + mix(c + np.uint64(side + 10)))
        three = mix(before(c, 2) * np.uint64(5) + two)
        written = mix(before(h, 1) * np.uint64(7) + one)
    keep = ~stop
    return np.stack([three, two, written, one])[:, keep], np.r_[stop[1:], True][keep]


def lowered(word: str) -> str:
    """Lower case letter by letter, so that the start of a word is lowered as the start of it."""
    return word.lower() if word.isascii() else "".join(map(str.lower, word))


_POWER = np.uint64(0x9E3779B97F4A7C15)


def start_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all starts of the words, one after another, whether each is a whole word, and the word it is from."""
    low = [lowered(w) for w in words]
    size = np.fromiter(map(len, low), np.int64, len(low))
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(low)), size)
    first = np.cumsum(size) - size
    place = np.arange(len(points)) - first[owner]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), _POWER, np.uint64))
        run = np.cumsum(points * power[place])
        before = np.r_[np.zeros(1, np.uint64), run][first]
        return mix((run - before[owner]) ^ np.uint64(START)), place + 1 == size[owner], owner


def ending_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the last three letters of all starts of the words that have as many, and whether each is a whole word."""
    low = [lowered(w) for w in words]
    size = np.fromiter(map(len, low), np.int64, len(low))
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size) >= 2
    at = np.flatnonzero(at)
    three = points[at - 2] | points[at - 1] << np.uint64(21) | points[at] << np.uint64(42)
    return mix(three ^ np.uint64(ENDING)), (np.cumsum(size)[np.repeat(np.arange(len(low)), size)] - 1)[at] == at


def last_contexts(text: str, lines: bool, vocabulary: Vocabulary) -> tuple[list[int], str]:
    """Keys of the contexts at the end of the text, and its last word. As much of the text is read as its last words take."""
    reach = 240
    while True:
        tokens = TOKEN.findall(text[-reach:])[1 if len(text) > reach else 0 :]
        if not lines:
            tokens = [t for t in tokens if t != "\n"]
        while tokens and tokens[-1][0] in FINAL + "\n":
            tokens.pop()
        if len(tokens) > 3 or reach >= len(text):
            break
        reach *= 8
    if not tokens:
        return [], ""
    found, _ = contexts(vocabulary.numbers(["\n", "\n", *tokens]), vocabulary, 2 if lines else 1)
    last = tokens[-1] if len(tokens) < 2 or tokens[-2] != "#" else ""
    start = start_keys(tokens[-1:])[0][-1:]
    ending = ending_keys(tokens[-1:])[0][-1:] if len(lowered(tokens[-1])) > 2 else start
    return [*found[:, -1].view(np.int64).tolist(), *ending.view(np.int64).tolist(), *start.view(np.int64).tolist()], last


def may_end(ends: list[int], seen: list[int], last: str, lines: bool, least: float) -> bool:
    """Whether the counts (by KINDS, its own included once) let the text end there."""
    if last and last[0].isalpha() and seen[3] <= 3 and not _cjk(last):
        if not last[0].isupper():
            return False  # a word that is hardly found elsewhere is a part of one
        if seen[4] > 3 and ends[4] < 0.4 * seen[4]:
            return False
    rare = ends[5] / max(1, seen[5])
    if last and last[0].isalpha() and (rare < 0.05 and ends[3] > 0.4 * seen[3] or rare < 0.01 and ends[3] > 0.15 * seen[3]):
        return False  # found mostly where texts stop, and nearly always longer elsewhere
    for e, n in zip(ends[:4], seen[:4]):
        if n > 8:
            return (e - 1) / (n - 1) >= least
    return True


def _wanted(bits: int, needed) -> tuple[np.ndarray, np.uint64]:
    return np.unpackbits(np.frombuffer(needed.value, np.uint8)).astype(bool), np.uint64((1 << bits) - 1)


def _counts(word: list[str | None], key: np.ndarray, ends: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(key.view(np.int64)), pa.array(ends.astype(np.int64)), pa.array(seen.astype(np.int64))], ["word", "key", "ends", "seen"])


def _tally(bits: int, needed, line_categories: frozenset[str]):
    """Sums of the wanted contexts and starts, with no word; and the capitalised words whose endings are wanted, with no sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = _wanted(bits, needed)
        vocabulary, said = Vocabulary(), set()
        for batch in batches:
            vocabulary = vocabulary.fresh()
            line = vocabulary.numbers(["\n"])[0]
            sides: dict[int, list[int]] = {1: [line, line], 2: [line, line]}  # two between texts: none is a context of the next
            for text, category in zip(*(c.to_pylist() for c in batch.columns)):
                if not text or is_code(category):
                    continue
                lines = category in line_categories
                n = vocabulary.numbers(TOKEN.findall(text.rstrip()))
                sides[2 if lines else 1] += n if lines else [x for x in n if x != line]
                sides[2 if lines else 1] += [line, line]
            keys, hits = [], []
            for side, numbers in sides.items():
                found, e = contexts(numbers, vocabulary, side)
                for row in found:
                    want = table[(row & mask).astype(np.int64)]
                    keys.append(row[want])
                    hits.append(e[want])
            weights = [np.ones(len(x), np.int64) for x in keys]
            tokens, used = list(vocabulary.number), np.bincount(np.concatenate([np.asarray(x, np.int64) for x in sides.values()]), minlength=len(vocabulary.number))
            here = [k for k, w in enumerate(tokens) if used[k] and w[0].isalpha()]
            starts, whole, owner = start_keys([tokens[k] for k in here])
            want = table[(starts & mask).astype(np.int64)]
            keys.append(starts[want])
            hits.append(whole[want])
            weights.append(used[here][owner[want]] if len(here) else np.empty(0, np.int64))
            every, which = np.unique(np.concatenate(keys), return_inverse=True)
            w = np.concatenate(weights)
            yield _counts([None] * len(every), every, np.bincount(which, weights=np.concatenate(hits) * w, minlength=len(every)), np.bincount(which, weights=w, minlength=len(every)))
            names = [w for w in (tokens[k] for k in here) if w[0].isupper() and len(w) > 3 and w not in said]
            names = [w for w in names if table[(ending_keys([w])[0] & mask).astype(np.int64)].any()]
            said = said if len(said) < Vocabulary.LIMIT else set()  # only saves repeats
            said.update(names)
            none = np.zeros(len(names), np.int64)
            yield _counts(names, none.view(np.uint64), none, none)

    return run


def _endings(bits: int, needed):
    """Each word's wanted endings in place of the word; sums pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = _wanted(bits, needed)
        for batch in batches:
            word = batch.column(0)
            yield batch.filter(word.is_null()).select(["key", "ends", "seen"])
            keys, whole = ending_keys(word.drop_null().to_pylist())
            want = table[(keys & mask).astype(np.int64)]
            out = _counts([None] * int(want.sum()), keys[want], whole[want], np.ones(int(want.sum()), np.int64))
            yield out.select(["key", "ends", "seen"])

    return run


def is_code(category: str | None) -> bool:
    return category in ("source_code", "json_schema")


CODE_MARK = re.compile(r"\"\"\"|\'\'\'|\\.|[\"'()\[\]{}]|#[^\n]*|\n", re.DOTALL)


def open_code(text: str) -> bool:
    """Whether a bracket, brace or string is open at the end."""
    stack, quote = [], ""
    for mark in CODE_MARK.findall(text):
        if quote:
            if mark == quote:
                quote = ""
            elif len(quote) == 1 and len(mark) == 3 and mark[0] == quote:
                quote = ""  # an empty string and the next quote
        elif mark[0] in "\"'":
            quote = mark
        elif mark in "([{":
            stack.append(OPEN[mark])
        elif stack and mark == stack[-1]:
            stack.pop()
    return bool(stack or quote)


MARK = re.compile(r"[\"“”„«»「」『』()\[\]（）]")


def open_text(text: str) -> bool:
    """Whether a quotation or bracket is open at the end."""
    stack: list[str] = []
    plain = False
    for ch in MARK.findall(text):
        if ch == '"':
            plain = not plain
        elif stack and ch in stack[-1]:
            stack.pop()
        elif ch in OPEN:
            stack.append(OPEN[ch])
    return plain or bool(stack)


def last_unit(text: str, lines: bool) -> str:
    """The last line of a list, else the last sentence; a closed quotation with its frame is one."""
    block = re.split(r"\n" if lines else r"\n\s*\n", text)[-1]
    found = units(block, lines)
    return block[found[-1][0] : found[-1][1]] if found else ""


WIDTHLESS = re.compile("[\u00ad\u061c\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
#: Abbreviations after which no text ends.
HANGING = frozenset("Mr. Mrs. Ms. Dr. Prof. St. e.g. i.e. approx. vs. Fig. pp. No. z. d. ca. vgl. Nr. env. aprox. Sr. Sra. MM.".split())


def judged(text: str | None, prompt: str, category: str | None, line_categories: frozenset[str], vocabulary: Vocabulary) -> tuple[str | None, list[int], str, bool]:
    """The defect, if it shows without the model of terminal contexts; else keys of contexts to ask it, if the text lacks a mark."""
    none: tuple[str | None, list[int], str, bool] = (None, [], "", False)
    if is_empty(text):
        return "empty", *none[1:]
    if is_copy(text, prompt):
        return "copy", *none[1:]
    if is_refusal(text):
        return "refusal", *none[1:]
    if is_code(category):
        bare = text.strip().strip("`").strip()
        return "truncated" if open_code(bare) or bare.endswith((":", ",", "=", "+", "\\", "(", ".")) else None, *none[1:]
    if is_other_language(text, prompt):
        return "other_language", *none[1:]
    lines = category in line_categories
    shown = (text if text.isascii() else WIDTHLESS.sub("", text)).rstrip()
    core = shown.rstrip(CLOSING + " \u00a0\u3000")
    last_part = re.split(r"\n" if lines else r"\n\s*\n|(?<=[.!?…。！？])[\"”»」)]*\s", shown)[-1]
    if core and core[-1] in FINAL:
        cut = core.rsplit(None, 1)[-1] in HANGING or len(core) == len(shown) and open_text(last_part) and open_text(last_unit(shown, lines))
        return "truncated" if cut else None, *none[1:]
    if core[-1:] in (",", ";", "、", "，", "،"):
        return "truncated", *none[1:]
    if open_text(last_part) and not open_text(last_part[1:] if last_part[:1] in "\"”»」)" else last_part + "x") or open_text(last_part) and not shown.endswith(tuple(CLOSING)):
        return "truncated", *none[1:]
    keys, last = last_contexts(core if core and core[-1] not in ",;:" else shown, lines, vocabulary)
    return None, keys, last, lines


def _judge(line_categories: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            vocabulary = vocabulary.fresh()
            rows = []
            for key, text, prompt, category in zip(*(c.to_pylist() for c in batch.columns)):
                defect, keys, last, lines = judged(text, prompt or "", category, line_categories, vocabulary)
                if defect or keys:
                    rows.append((key, defect, keys, last, lines))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_())], ["id", "defect", "keys", "last", "lines"])

    return run


def _broken(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [key for key, last, lines, at, ends, seen in zip(*(c.to_pylist() for c in batch.columns)) if not may_end(*_in_order(at, ends, seen), last, lines, least)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(["truncated"] * len(ids), pa.string())], ["id", "defect"])

    return run


def _in_order(at: list[int], ends: list[int], seen: list[int]) -> tuple[list[int], list[int]]:
    e, n = [0] * len(KINDS), [0] * len(KINDS)
    for k, x, y in zip(at, ends, seen):
        e[k], n[k] = x, y
    return e, n


@dataclass
class PairDefects:
    """``found`` (id, defect), ``pairs`` (id, text, prompt, category): the pairs that were judged."""

    found: DataFrame
    pairs: DataFrame


def prompt_key(column):
    """A prompt's id without stray blanks, in upper case."""
    return F.upper(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def pair_defects(records: DataFrame, prompts: DataFrame, *, id_col: str = "sample_id", text_col: str = "text", prompt_col: str = "prompt_id", prompt_text_col: str = "text", category_col: str = "category", bits: int = 22, least: float = 0.12, line_categories: tuple[str, ...] = ("list",)) -> PairDefects:
    """Each defective answer with its defect, one at most, the first in the order of ``DEFECTS``.

    A record's rows are one pair: a row with a text goes before one without, then the least text holds.
    Records with a null id, or whose prompt isn't among ``prompts``, are not judged; a null text is an empty
    answer. A category ``repeat_of_X`` is that of prompt X. Code and JSON have no language. A prompt id given
    twice counts with its least text. ``bits`` is the size of the
    bit table that filters contexts. An unmarked end counts as whole if its context ends in a part of ``least`` or more.
    """
    p = prompts.select(prompt_key(F.col(prompt_col)).alias("pid"), F.col(prompt_text_col).alias("prompt"), F.col(category_col).alias("own")).where("pid is not null").groupBy("pid").agg(F.min(F.struct("prompt", "own")).alias("x")).select("pid", "x.prompt", "x.own")
    base = p.select(F.col("pid").alias("base"), F.col("own").alias("base_own"))
    p = p.withColumn("base", F.when(F.col("own").startswith("repeat_of_"), F.upper(F.substring("own", 11, 100)))).join(base, "base", "left").select("pid", "prompt", F.coalesce("base_own", "own").alias("category"))
    rows = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), prompt_key(F.col(prompt_col)).alias("pid")).where("id is not null")
    rows = rows.groupBy("id").agg(F.min(F.struct(F.col("text").isNull().alias("none"), "text", "pid")).alias("x")).select("id", "x.text", "x.pid")
    pairs = materialise(rows.join(p, "pid").select("id", "text", "prompt", "category"), "pairs")
    lines = frozenset(line_categories)
    first = materialise(pairs.mapInArrow(_judge(lines), "id string, defect string, keys array<long>, last string, lines boolean"), "judged")
    open_ends = first.where("defect is null")
    asked = open_ends.select("id", "last", "lines", F.posexplode("keys").alias("kind", "key"))
    slots = asked.select(F.col("key").bitwiseAND((1 << bits) - 1).alias("slot")).distinct().toArrow()["slot"].to_numpy()
    table = np.zeros(1 << bits, bool)
    table[slots] = True
    needed = records.sparkSession.sparkContext.broadcast(np.packbits(table).tobytes())
    sums = [F.sum("ends").alias("ends"), F.sum("seen").alias("seen")]
    tally = pairs.select("text", "category").mapInArrow(_tally(bits, needed, lines), "word string, key long, ends long, seen long").groupBy("word", "key").agg(*sums)
    counts = tally.select("word", "key", "ends", "seen").mapInArrow(_endings(bits, needed), "key long, ends long, seen long").groupBy("key").agg(*sums)  # words are different ones by now
    answered = asked.join(counts, "key").groupBy("id").agg(F.first("last").alias("last"), F.first("lines").alias("lines"), F.collect_list("kind").alias("kinds"), F.collect_list("ends").alias("ends"), F.collect_list("seen").alias("seen"))
    broken = answered.select("id", "last", "lines", "kinds", "ends", "seen").mapInArrow(_broken(least), "id string, defect string")
    return PairDefects(first.where("defect is not null").select("id", "defect").unionByName(broken), pairs)
