"""Refusals and reports of failure, recognised by aligning sentences with templates over classes of meaning.

A template is a short sequence of classes (who speaks, denial, act of answering, what one would know, failure ...), so it
covers every wording that its classes have words for, in each language of the word lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from graphloom.llm.lookalikes import plain_form

#: Everyday words of each class of meaning in English, German, French, Spanish, Hindi and Tamil, and of languages
#: without blanks. I: who speaks. N: denial. A: acts of answering. K: knowing. H: having. D: what one would know or hold. F: finding.
#: X: failure. M: the machinery. Q: giving up. S: regret. R: sending elsewhere or to later. P: politeness.
CLASSES = {
    "I": """i me my mine myself we us our ours i'm i've i'd i'll we're we've we'll assistant chatbot bot ai
        ich mir mich mein meine meinen meiner meinem wir uns unser unsere unseren unserer je j me moi mon ma mes nous notre nos yo mi mis nosotros nuestro nuestra nuestros nuestras
        मैं मुझे मेरे मेरी मेरा हम हमें हमारे हमारी हमारा நான் எனக்கு என்னால் என்னிடம் எங்களுக்கு எங்களால் எங்களிடம் நாங்கள் 我 我们 本系统 私 わたし 当方 ฉัน ผม ดิฉัน เรา""",
    "N": """not no none nothing cannot can't couldn't unable don't doesn't didn't isn't wasn't aren't won't wouldn't haven't hasn't never neither nor without nowhere unavailable unknown outside beyond silent lack lacks lacking missing insufficient
        forbidden prohibited impossible nicht kein keine keinen keiner keinem nichts nie außerhalb ohne unbekannt ne n pas aucun aucune rien jamais hors sans impossible incapable no ningún ninguna ninguno nada nunca fuera sin imposible
        नहीं न बाहर असमर्थ இல்லை முடியாது முடியவில்லை இயலாது இயலவில்லை தெரியாது தெரியவில்லை அப்பாற்பட்டது 无法 不能 没有 不 未 できません できない ません ない ไม่""",
    "A": """answer answering answered reply replying respond responding response help helping assist assisting assistance comment commenting say saying tell telling discuss discussing speak explain provide providing give giving offer offering share sharing disclose reveal
        advise guess guessing speculate process processing fulfil fulfill fetch engage unanswered confirm judge
        beantworten antworten antwort helfen sagen auskunft äußern mitteilen geben bearbeiten weiterhelfen erklären nennen raten répondre réponse aider dire commenter fournir donner traiter renseigner préciser indiquer
        responder respuesta ayudar decir comentar dar ofrecer informar procesar ayudarle ayudarte contestar facilitar atender
        उत्तर जवाब मदद सहायता बता बताना दे सकता सकती सकते कह பதிலளிக்க பதில் உதவ கூற சொல்ல வழங்க 回答 帮助 提供 答え お答え 回答 ตอบ ช่วย ให้""",
    "K": "know knowing aware sure certain weiß wissen bekannt sais savons connais sabemos पता मालूम தெரியும் 知道 知り รู้",
    "H": "have has had hold holds contain contains access habe haben hat liegt liegen vor ai avons dispose disposons tenemos disponemos पास",
    "D": """information info data record records source sources detail details document documents context evidence entry entries fact facts topic subject point matter question request scope remit opinion database base material result results output anything something index training clue idea
        angaben informationen information daten quelle quellen unterlagen thema frage ergebnis ergebnisse anfrage bereich informations renseignement renseignements données source sources sujet question élément éléments résultat résultats information domaine demande
        información datos dato fuente fuentes tema pregunta resultado resultados documentos detalle detalles ámbito solicitud जानकारी सूचना दायरे स्रोत विवरण डेटा प्रश्न सवाल தகவல் தகவல்கள் கேள்வி கேள்விக்கு விவரம் தரவு 信息 资料 数据 问题 情報 データ 質問 ข้อมูล คำถาม""",
    "F": "find finding found see locate located identify identified retrieve retrieved retrieving match matched mention mentions generated produced gave came finden gefunden fand trouve trouvé trouver trouvons disent dit encuentro encontrado encontré encontrar hallado मिली मिला மிले கிடைக்கவில்லை கிடைத்தது 找到 查到 見つかり พบ",
    "X": """error errors failed failure fail failing fails timeout timed exception refused denied crashed crash unreachable overloaded down offline interrupted disconnected issue problem trouble broke broken unexpected wrong exceeded exhausted
        fehler fehlgeschlagen ausgefallen störung zeitüberschreitung abgebrochen erreur échec échoué panne expiré délai error fallo falló falla agotado interrumpido त्रुटि विफल பிழை தோல்வி 错误 失败 超时 エラー 失敗 ข้อผิดพลาด""",
    "M": "llm api model models service server servers backend endpoint connection request system system's network host gateway running quota rate limit technical internal modell dienst server verbindung anfrage système modèle service serveur connexion requête sistema modelo servicio servidor conexión सर्वर सेवा सिस्टम சேவை சேவையகம் 系统 模型 服务器 サーバー システム ระบบ",
    "Q": """decline declining refuse refusing refrain abstain withhold passen ablehnen verweigern enthalte abstiens refuser préfère décline passe declino rechazo abstengo मना इनकार மறுக்கிறேன் 拒绝 控え ขอปฏิเสธ""",
    "S": "sorry afraid unfortunately regret regrettably apologies apologize apologise apology wish leid leider bedaure bedauern entschuldigung verzeihung désolé désolée regrette malheureusement pardon excusez siento lamento lamentablemente desgraciadamente disculpe perdón क्षमा खेद माफ़ माफ दुर्भाग्य மன்னிக்கவும் வருந்துகிறேன் 抱歉 对不起 申し訳 すみません ขออภัย ขอโทษ",
    "P": "hello hi hey thank thanks thankyou reaching dear welcome glad happy good great sure certainly hallo danke guten bonjour merci hola gracias buenos नमस्ते धन्यवाद வணக்கம் நன்றி 您好 你好 こんにちは สวัสดี",
    "R": "please contact ask visit consult try again later retry check rephrase instead elsewhere call email bitte fragen wenden büro erneut später sekretariat veuillez consultez voyez contactez secrétariat adressez réessayez consulte pregunte contacte oficina diríjase inténtelo vuelva कृपया संपर्क कार्यालय தயவுசெய்து அலுவலகத்தை தொடர்பு 请 联系 稍后 どうか お問い合わせ โปรด ติดต่อ",
}
#: Words that belong to several classes at once, such as verbs that say who speaks.
COMPOUND = {
    "dispongo": "IH", "tengo": "IH", "sé": "IK", "conozco": "IK", "puedo": "I", "podemos": "I", "prefiero": "IQ", "encuentro": "IF", "encontré": "IF", "desconozco": "INK", "ignoro": "INK",
    "தெரியாது": "NK", "தெரியவில்லை": "NK", "கிடைக்கவில்லை": "NF", "எனக்குத்": "I", "அறியேன்": "INK", "unanswered": "NA", "unclear": "NK", "unsure": "NK", "prefer": "Q",
}
#: Which sequences of classes, in this order within one sentence, decline, know nothing or report a failure.
TEMPLATES = (
    "INA", "NIA", "IAN", "IQ", "IND", "INK", "NIK", "INF", "IKN", "IDN", "NID", "NDD", "NDF", "DNF", "NFI", "NIF", "NIHD", "QA", "IQNA",
    "MX", "XM", "MN", "DX", "NXD", "XR", "SNA", "SNK", "SNF", "SND", "SX", "SQ",
)
#: Words that join others and say nothing themselves; they count neither for nor against a refusal.
JOINING = frozenset("""a an the to of in on at for with by from about this that these those it its is am are was were be been being as or and so if but which what who can could may might must should would will do did enough any here there right now moment than more just only very able out after rather
regarding concerning currently yet still your you der die das den dem ein eine einen zu zur zum auf dazu dabei da dies diese dieser dieses es ist sind und oder aber kann könnte muss hier derzeit gerade weil mit le la les l un une des du de d à au aux ce cet cette ces est sont et ou mais peux peut puis ici là-dessus là-bas là dessus sur pour en
el los las lo al del un una unos este esta esto ese esa eso es son y o pero puedo puede podemos aquí sobre con para en que इसका इसकी इस यह का की के को से में है हैं हूँ कर पर और या इதை இதற்கு இந்த இது பற்றி""".split())  # fmt: skip
#: Least share of a sentence's words, the question's own left out, that belong to classes or join others.
ACCOUNTED = 0.5

_CLASS = {w: c for c, words in reversed(CLASSES.items()) for w in words.split()} | COMPOUND
_UNSPACED = re.compile("(" + "|".join(sorted((re.escape(w) for w in (*_CLASS, *JOINING) if re.search(r"[぀-ヿ一-鿿฀-๿]", w)), key=len, reverse=True)) + ")")
_WORD = re.compile(r"[\wऀ-ॿ஀-௿฀-๿]+(?:'[^\W\d_]+)?")
_SENTENCE = re.compile(r"(?<=[.!?।。！？;；])\s+|\n+|(?<=[।。！？])|\s+[-–—]\s+")
#: What is no denial or only announces an answer.
_NUMBER = re.compile(r"\bno\.?\s*(?=\d)")
_LEAD = re.compile(r"^\W*(?:for|to) your (?:query|question|request)\W+|^\W*(?:here is what i found|you asked)\W+")
_ELISION = re.compile(r"\b([ldjnmtsc]|qu)'(?=[^\W\d_]{2})")
#: What ends in a full stop without ending a sentence: initials and capitalised short forms.
_ABBREVIATED = re.compile(r"(?:\b[A-Z]|\b[A-Z][a-z]{1,3}|[^\W\d_]\.[^\W\d_]+)\.$")


def _aligns(classes: str, template: str) -> bool:
    """Whether the template is a subsequence of the classes: its longest common subsequence with them is itself."""
    at = -1
    for c in template:
        at = classes.find(c, at + 1)
        if at < 0:
            return False
    return True


@lru_cache(maxsize=20_000)
def _shape(sentence: str) -> tuple[str, tuple[str, ...], int]:
    """Classes of a sentence in order, its words without class that tell something, and how many words have a class or join."""
    low = _ELISION.sub(r"\1 ", _LEAD.sub("", _NUMBER.sub(" ", sentence.lower())))
    if _UNSPACED.search(low):
        low = _UNSPACED.sub(r" \1 ", low)
    classes, other, known = [], [], 0
    for w in _WORD.findall(low):
        if c := _CLASS.get(w):
            classes.append(c)
            known += 1
        elif w in JOINING:
            known += 1
        elif not w.isdigit():
            other.append(w)
    return "".join(classes), tuple(other), known


@lru_cache(maxsize=50_000)
def _declines(classes: str) -> bool:
    # Who speaks and a denial, or a failure, must be there at all.
    return any(_aligns(classes, t) for t in TEMPLATES)


def _sentences(text: str) -> Iterator[str]:
    """The sentences of a text one by one; a short form's full stop ends none."""
    start = 0
    for m in _SENTENCE.finditer(text):
        if not _ABBREVIATED.search(text, max(start, m.start() - 12), m.start()):
            yield text[start : m.start()]
            start = m.end()
    yield text[start:]


def is_refusal(answer: str, asked: frozenset[str] = frozenset()) -> bool:
    """Whether an answer only declines, knows nothing or reports a failure.

    Some sentence aligns with a template and is mostly made of its kind of words; every other sentence is polite, regrets,
    sends elsewhere or declines too. Words of the question (asked) may name what is declined.
    """
    plain = plain_form(answer).replace("’", "'")
    declined = False
    for s in _sentences(plain):
        classes, other, known = _shape(s.strip())
        new = sum(w not in asked for w in other)
        if not known and not new:
            continue
        if _declines(classes) and known >= ACCOUNTED * (known + new):
            declined = True
        elif declined and not known and new <= 2 and not re.search(r"\d", s):
            continue  # the rest of a name that a full stop broke
        elif new and not ("R" in classes and known + new <= 12) and not (classes and set(classes) <= set("SIPD") and new <= 2):
            return False
    return declined
