"""The language of short texts by script and function words."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

#: Closed-class words (articles, pronouns, prepositions, conjunctions, auxiliaries, question words, negations) of the
#: Latin-script languages told apart. Words that carry a topic are no part of them.
COMMON = {
    "en": """the of and to in is are a an for on at by from with what which who whom whose how when where why do does did i you he she we they it my your his her its our their me him us them not no be been was were will would can could should
        may might must shall this that these those have has had there here about under over all each every any some before after until unless as or if but than then so because while during between into through against without within per""",
    "de": """der die das dem den des ein eine einen einem einer eines und oder aber zu zum zur im in ins am an auf aus bei vom von mit nach für über unter vor durch gegen ohne um ist sind war waren wird werden wurde kann können muss müssen soll darf
        hat haben nicht kein keine was wer wie wann wo wohin warum welche welcher welches ich du er sie es wir ihr mir mich sich dir uns ihre ihren seine mein meine dieser diese dieses jeder jede jeden alle nur noch auch als ab bis pro wenn dass weil gibt laut""",
    "fr": """le la les l un une des du de d au aux à a en dans sur sous par pour avec sans chez entre vers et ou mais donc car ni est sont était être ont a fait peut peuvent doit doivent ne n pas plus que qui quoi quel quelle quels quelles comment quand où pourquoi
        combien je j tu il elle on nous vous ils elles me m te se s ce cet cette ces c mon ma mes son sa ses notre nos votre vos leur leurs y chaque tout toute tous toutes avant après depuis dès selon lors si""",
    "es": """el la los las lo un una unos unas de del al a en con sin por para sobre entre hasta desde hacia según y e o u pero ni que quién quiénes qué cuál cuáles cómo cuándo dónde cuánto cuánta cuántos es son era está están ser ha han hay puede pueden debe deben
        no se me te le les nos su sus mi mis tu tus este esta estos estas ese esa eso aquel yo él ella ellos ellas cada todo toda todos todas más muy antes después si como donde""",
    "it": """il lo la i gli le un uno una di del dello della dei degli delle a al allo alla ai agli alle da dal dalla in nel nella nei con su sul sulla per tra fra e ed o ma che chi cosa quale quali come quando dove perché quanto è sono era essere ha hanno può possono deve
        non si mi ti ci vi io lui lei noi voi loro questo questa questi queste quello quella ogni tutti tutte più anche prima dopo se""",
    "pt": """o a os as um uma uns umas de do da dos das ao aos à às em no na nos nas num numa por pelo pela pelos para com sem sobre entre até desde e ou mas que quem qual quais como quando onde quanto é são era ser está estão tem têm há pode podem deve não
        se me te lhe eu ele ela nós eles elas seu sua seus suas meu minha este esta isto esse essa cada todo toda todos todas mais muito antes depois""",
    "nl": """de het een en of maar van in op aan uit bij voor naar met door over onder tot om is zijn was waren wordt worden kan kunnen moet mag heeft hebben niet geen wat wie welke hoe wanneer waar waarom ik jij hij zij wij jullie mijn uw hun zich dit dat deze die
        elke alle ook nog maar als per""",
}
WORDS = {lang: frozenset(words.split()) for lang, words in COMMON.items()}
#: Letters that one of them has and the others rarely have.
LETTERS = {"de": "äöüß", "fr": "àâçèêëîïôûùœ", "es": "áíóúñ¿¡", "pt": "ãõâêôç", "it": "àèìòù"}
#: Scripts of one language each, or of a group that is not told apart here and goes by the script's name.
SCRIPTS = (
    ("hi", r"[ऀ-ॿ]"), ("ta", r"[஀-௿]"), ("th", r"[฀-๿]"), ("ja", r"[぀-ヿ]"), ("zh", r"[一-鿿]"), ("ko", r"[가-힯]"), ("cyrillic", r"[Ѐ-ӿ]"), ("greek", r"[Ͱ-Ͽ]"), ("arabic", r"[؀-ۿ]"),
    ("hebrew", r"[֐-׿]"), ("bn", r"[ঀ-৿]"), ("pa", r"[਀-੿]"), ("gu", r"[઀-૿]"), ("te", r"[ఀ-౿]"), ("kn", r"[ಀ-೿]"), ("ml", r"[ഀ-ൿ]"),
)
_SCRIPTS = tuple((lang, re.compile(pattern)) for lang, pattern in SCRIPTS)
_BEYOND_LATIN = re.compile(r"[Ͱ-῿\u3040-\ud7ff]")
#: Words without the pieces of abbreviations: what a full stop follows or precedes within a word, and single letters before one.
_LATIN = re.compile(r"(?<![.\w])(?![^\W\d_]\.)[^\W\d_]+(?!\.\w)(?![^\W\d_])")


@lru_cache(maxsize=50_000)
def language(text: str) -> tuple[str, float]:
    """(language, margin): empty if nothing tells; the margin is the lead in matching words over the runner-up."""
    low = text.lower().replace(" et al", " ")
    if not text.isascii() and _BEYOND_LATIN.search(text):
        marks = {lang: len(pattern.findall(text)) for lang, pattern in _SCRIPTS if pattern.search(text)}
        if marks:
            if "ja" in marks:
                marks["ja"] += marks.get("zh", 0)
            lang = max(marks, key=marks.get)
            if marks[lang] > 0.4 * len(re.findall(r"[^\W\d_]", text)):
                return lang, float(marks[lang])
    seen = Counter(_LATIN.findall(low))
    if not seen:
        return "", 0.0
    score = {lang: float(sum([n for w, n in seen.items() if w in words])) for lang, words in WORDS.items()}
    if not text.isascii():
        for lang, letters in LETTERS.items():
            score[lang] += 0.7 * sum(map(low.count, letters))
    first, second = sorted(score, key=score.get, reverse=True)[:2]
    return (first, score[first] - score[second]) if score[first] > score[second] else ("", 0.0)
