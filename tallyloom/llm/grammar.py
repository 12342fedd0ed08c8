"""Weighted finite-state grammar of abusive clauses.

Small transducers read the words of a text as classes (insult, threat verb, future, target,
negation, report, quote, clause end). Four of them run in step, one state each for negation,
reported speech, target and threat; their composition is built as its states are met. On an
insult or a complete threat it writes the weight into the slot for what the clause makes of
it: plain, negated, reported, aimed at someone, or a threat. Insults are learned in any language; the
fixed word classes are English, German, French and Spanish only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Word classes. Fixed values.
TARGETS = "you your yours yourself they them he she him her du dich dir euch ihr sie tu te toi vous ils elles usted ustedes ellos ti os".split()
NEGATIONS = "not no never nobody none isn't aren't wasn't don't nicht kein keine keinen nie ne pas jamais aucun nunca jamás ningún ninguna".split()
REPORTS = "said says say claimed wrote quoted called reported sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó".split()
FUTURES = "will shall gonna going must should werde wirst muss vais va dois voy va debes".split()
THREATS = "kill hurt beat destroy shoot stab burn töten schlagen umbringen vernichten tuer frapper détruire matar golpear destruir".split()

INSULT, THREAT, FUTURE, TARGET, NEGATION, REPORT, QUOTE, PAUSE, END, OTHER = range(10)
SLOTS = ("plain", "negated", "reported", "aimed", "threat", "threat_off")
NEGATION_REACH = 3
PIECES = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»]|[.!?;\n]|,")
APOSTROPHE = re.compile("['’]")


def pieces(text: str) -> Iterator[str]:
    """Words, quotes and stops in order; an elision (l'ami, c'est) is several words, a contracted negation (don't) is one."""
    for m in PIECES.finditer(text):
        word = m.group()
        parts = APOSTROPHE.split(word)
        if len(parts) > 1 and "'".join(parts) in NEGATIONS:
            yield "'".join(parts)
        else:
            yield from parts


class Lexicon:
    """The lexical transducer: a trie of learned stems over letters, then whole words of the fixed classes."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.trie: dict = {}
        for stem, weight in stems.items():
            node = self.trie
            for ch in stem:
                node = node.setdefault(ch, {})
            node[""] = weight
        self.words = {w: c for words, c in ((FUTURES, FUTURE), (REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT)) for w in words}

    def insult(self, word: str) -> float | None:
        """The weight of the longest stem that the word starts with."""
        node, best = self.trie, None
        for ch in word:
            node = node.get(ch)
            if node is None:
                return best
            best = node.get("", best)
        return best

    def read(self, text: str) -> Iterable[tuple[int, float]]:
        for word in pieces(text):
            if word == ",":
                yield PAUSE, 0.0
            elif word in ".!?;\n":
                yield END, 0.0
            elif word in "\"“”„«»":
                yield QUOTE, 0.0
            elif (weight := self.insult(word)) is not None:
                yield INSULT, weight
            else:
                yield self.words.get(word, OTHER), 0.0


def negation(state: int, c: int) -> int:
    """How many more words a negation reaches."""
    return NEGATION_REACH if c == NEGATION else 0 if c == END else state if c in (QUOTE, PAUSE) else max(state - 1, 0)


def report(state: int, c: int) -> int:
    """0 own speech, 1 a clause that reports, 2 a quotation in it."""
    if c == REPORT:
        return max(state, 1)
    if c == QUOTE:
        return (0, 2, 0)[state]
    return 0 if c == END and state == 1 else state


def target(state: int, c: int) -> int:
    return 0 if c == END else 1 if c == TARGET else state


def threat(state: int, c: int) -> int:
    """0 nothing, 1 future, 2 verb after a future, 3 the verb has met its target now."""
    if c == END:
        return 0
    if c == FUTURE:
        return 1
    if c == THREAT:
        return 2 if state else 0
    if c == TARGET and state == 2:
        return 3
    return 1 if state == 3 else state


class Grammar:
    """The composition of the four machines with the lexicon; arcs are kept once they are found."""

    def __init__(self, stems: dict[str, float]):
        self.lexicon = Lexicon(stems)
        self.arcs: dict[tuple, tuple] = {}

    def arc(self, state: tuple[int, int, int, int], c: int) -> tuple[tuple[int, int, int, int], tuple[int, ...]]:
        got = self.arcs.get((state, c))
        if got is None:
            n, r, t, h = (f(s, c) for f, s in zip((negation, report, target, threat), state, strict=True))
            out: tuple[int, ...] = ()
            if c == INSULT:
                out = (1 if state[0] else 2 if state[1] else 0,) + ((3,) if t else ())
            elif h == 3:
                out = (5 if n or r else 4,)
            got = self.arcs[(state, c)] = ((n, r, t, h), out)
        return got

    def features(self, text: str) -> np.ndarray:
        """Weights written into each slot over the whole lower-cased text."""
        out, state = np.zeros(len(SLOTS)), (0, 0, 0, 0)
        for c, weight in self.lexicon.read(text):
            if c == OTHER and state == (0, 0, 0, 0):
                continue
            state, slots = self.arc(state, c)
            for slot in slots:
                out[slot] += weight if c == INSULT else 1.0
        return out

    def gate(self) -> str:
        """A regular expression that any text with a non-zero feature matches."""
        stems = "|".join(re.escape(s) for s in sorted(self.lexicon.stems))
        verbs = "|".join(THREATS)
        return rf"(?:^|[^\p{{L}}])(?:{stems + '|' if stems else ''}(?:{verbs})(?:$|[^\p{{L}}]))"
