"""Look-alike classes over strings and code points, and a rewriter to one everyday form.

Classes are the transitive closure (union-find) of three relations: a code point and its compatibility expansion,
a base letter with marks and its composed form, and letters of different scripts that look the same.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import ahocorasick
import regex

#: Fixed values (a part of Unicode's table of confusable characters): a Latin letter and the Greek and Cyrillic ones like it.
ALIKE = """
A Α А
B Β В
C Ϲ С
E Ε Е
H Η Н
I Ι І
J Ј
K Κ К
M Μ М
N Ν
O Ο О
P Ρ Р
S Ѕ
T Τ Т
X Χ Х
Y Υ У Ү
Z Ζ
a α а
c ϲ с
d ԁ
e е
h һ
i ι і
j ϳ ј
l ӏ
o ο о
p ρ р
q ԛ
s ѕ
u υ
v ν ѵ
w ԝ
x χ х
y γ у
"""
#: Letters of the everyday Russian and Greek alphabets, which can make up a whole word of their script.
RUSSIAN = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
GREEK = "αβγδεζηθικλμνξοπρςστυφχψω"
#: Hyphens that print like the ordinary one, and blanks that are not of a space or format category.
HYPHENS = "‐‑‒−﹘﹣－"
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
SCRIPTS = ("L", "G", "C")
COMPAT = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<circle>")
WORD = regex.compile(r"[\p{L}\p{M}]+")


def script_of(ch: str) -> str:
    """L, G or C for a Latin, Greek or Cyrillic letter, else an empty string."""
    o = ord(ch)
    if not ch.isalpha():
        return ""
    if o < 0x250 or 0x250 <= o < 0x2B0 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    return "C" if 0x400 <= o < 0x530 else ""


def everyday(ch: str) -> str:
    """The everyday spelling of one code point on its own: what a reader sees, in characters one types."""
    kind = unicodedata.category(ch)
    if ch in HYPHENS:
        return "-"
    if ch == "ɡ":
        return "g"
    if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
        return " "
    if kind in ("Cf", "Cc") or ch in UNSEEN or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    how = unicodedata.decomposition(ch).split(" ")[0]
    roman_or_ligature = 0x2160 <= ord(ch) <= 0x217F or 0xFB00 <= ord(ch) <= 0xFB06
    if how in COMPAT or roman_or_ligature or ord(ch) in (0x212A, 0x212B, 0x2126):
        return unicodedata.normalize("NFKC", ch)
    return ch


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.above: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.above.setdefault(x, x)
        while self.above[x] != x:
            self.above[x] = self.above[self.above[x]]
            x = self.above[x]
        return x

    def union(self, a: str, b: str) -> None:
        self.above[self.find(a)] = self.find(b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.above:
            out.setdefault(self.find(x), []).append(x)
        return out


def alike_groups() -> list[list[str]]:
    return [line.split() for line in ALIKE.strip().split("\n")]


@lru_cache(maxsize=1)
def shared_letters() -> dict[str, set[str]]:
    """Letter -> the scripts whose everyday alphabet has one that looks the same (its own included)."""
    usual = {"G": set(GREEK + GREEK.upper()), "C": set(RUSSIAN + RUSSIAN.upper())}
    out: dict[str, set[str]] = {}
    for group in alike_groups():
        scripts = {"L"} | {s for s in "GC" for ch in group[1:] if ch in usual[s]}
        for ch in group:
            out[ch] = scripts | ({script_of(ch)} if ch == group[0] else set())
    return out


def skeleton(word: str) -> str:
    """The word with each letter as the first of its look-alike group: words that look the same have one skeleton."""
    return word.translate(_FIRST)


_FIRST = {ord(ch): group[0] for group in alike_groups() for ch in group[1:]}


class Rewriter:
    """Rewrites strings to their plain form. counts: how often each code point occurs in the corpus, as far as known."""

    def __init__(self, counts: dict[str, int] | None = None, sequences: tuple[str, ...] = ()) -> None:
        counts = counts or {}
        classes = Classes()
        for group in alike_groups():
            for ch in group[1:]:
                classes.union(ch, group[0])
        for ch in counts:
            if (plain := everyday(ch)) != ch:
                classes.union(ch, plain)
        for s in sequences:
            classes.union(s, "".join(map(everyday, unicodedata.normalize("NFC", s))))
        rewrites: dict[str, dict[str, str]] = {s: {} for s in ("", *SCRIPTS)}
        for group in classes.members().values():
            usual = [x for x in group if all(everyday(ch) == ch for ch in x) and unicodedata.normalize("NFC", x) == x]
            often = sorted(usual, key=lambda x: (-counts.get(x, 0), x)) or [""]
            for script in SCRIPTS:
                own = [x for x in often if x and all(script_of(ch) in (script, "") for ch in x)]
                for x in group:
                    if own and x not in own:
                        rewrites[script][x] = own[0]
            for x in group:
                if x not in often:
                    rewrites[""][x] = next((y for y in often if len(x) > 1 or y == everyday(x)), often[0])
        self.automata = {}
        for script, table in rewrites.items():
            automaton = ahocorasick.Automaton()
            for x, y in table.items():
                if x:
                    automaton.add_word(x, (len(x), y))
            automaton.make_automaton()
            self.automata[script] = automaton if len(automaton) else None

    def _greedy(self, text: str, script: str) -> str:
        """Leftmost longest matches of the script's automaton, rewritten."""
        if not self.automata[script]:
            return text
        out, at = [], 0
        for end, (length, new) in self.automata[script].iter_long(text):
            out += [text[at : end + 1 - length], new]
            at = end + 1
        return "".join(out) + text[at:]

    def plain(self, text: str, chosen: dict[str, str] | None = None) -> tuple[str, list[str]]:
        """The plain form, and the skeletons of words whose script neither they nor their neighbours decide.

        chosen: the script to take for such skeletons.
        """
        # Odd code points that the corpus counts lack are spelt one by one, so that any text is handled.
        seen = self._greedy(unicodedata.normalize("NFC", text), "")
        seen = unicodedata.normalize("NFD", "".join(map(everyday, seen)))
        words = [(m.start(), m.end()) for m in WORD.finditer(seen)]
        own = [self._script(seen[a:b]) for a, b in words]
        decided = {s for s in own if s in SCRIPTS}
        out, at, open_words = [], 0, []
        for (a, b), script in zip(words, own):
            if script == "?":
                letters = {script_of(ch) for ch in seen[a:b]} - {""}
                key = skeleton(seen[a:b])
                if len(decided) == 1:
                    script = next(iter(decided))
                elif letters == {"L"}:
                    script = "L"
                else:
                    script = (chosen or {}).get(key, "")
                    open_words += [] if script else [key]
            out += [seen[at:a], self._greedy(seen[a:b], script) if script in SCRIPTS else seen[a:b]]
            at = b
        return unicodedata.normalize("NFC", "".join(out) + seen[at:]), open_words

    @staticmethod
    def _script(word: str) -> str:
        """The script that most letters of the word can only belong to; ? if all its letters are shared; empty if other."""
        votes = dict.fromkeys(SCRIPTS, 0)
        shared, letters = shared_letters(), 0
        for ch in word:
            if s := script_of(ch):
                letters += 1
                if len(shared.get(ch, {s})) == 1:
                    votes["L" if ord(ch) in _FIRST else s] += 1
        if not letters:
            return ""
        best = max(SCRIPTS, key=lambda s: votes[s])
        return best if votes[best] else "?"


@lru_cache(maxsize=1)
def default_rewriter() -> Rewriter:
    return Rewriter()


@lru_cache(maxsize=200_000)
def plain_form(text: str) -> str:
    """The plain form of a text on its own, without corpus counts; undecided words are taken as Latin."""
    if text.isascii():
        return text
    done, undecided = default_rewriter().plain(text)
    return default_rewriter().plain(text, dict.fromkeys(undecided, "L"))[0] if undecided else done
