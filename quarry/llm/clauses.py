"""Finite-state machines over the words of a clause: what it says against whom, whether denied, and whether as its own words.

A word becomes one symbol. Four small transducers read the symbols in turn, each rewriting what the one before it wrote:
threats (a harm soon after an intent), negation (an event soon after a denial), reported speech (an event after a verb of
speech or in quotes) and, in the last, targets and the strongest event. They are composed on the fly: a state of the
composition is the tuple of their states, and arcs are kept once they have been taken. A clause's end gives its class."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping
from functools import lru_cache

#: Symbols; those from HARM on can start an event. Insults have four tiers, the strongest last.
END, OTHER, QUOTE, DENIAL, SPEECH, YOU, PERSON, INTENT, HARM, INSULT = range(10)
TIERS = 4

# Closed word classes of English, German, French and Spanish.
DENIALS = "not no never neither nor nobody cannot nicht kein keine keinen nie niemals ne pas jamais non aucun nunca jamás ningún ninguna tampoco".split()
SPEECHES = "said says say wrote writes claimed claims called calls reported quoted according sagte sagt schrieb behauptete nannte laut dit disait écrit affirme selon dijo dice escribió afirma según llamó".split()
YOUS = "you your yours yourself u ya du dich dir dein deine euch euer vous votre vos tu toi ton tes usted ustedes vosotros ti tú".split()
PERSONS = "he she him her his they them their those these people everyone er ihm ihn ihnen leute il elle eux lui leur gens él ella ellos ellas gente".split()
INTENTS = "will gonna going shall want should deserve deserves let must werde werden will wirst soll sollte muss vais va vas allons veux dois devrait voy vas vamos quiero debe debería".split()
HARMS = (
    "kill murder hurt beat destroy shoot stab hang burn punch strangle die töten umbringen schlagen erschießen verletzen vernichten sterben tuer frapper détruire brûler mourir "
    "étrangler matar golpear destruir quemar morir herir disparar"
).split()

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[\"“”„«»]|[.!?;:|\n]")
#: Clauses end at these marks, or after so many words.
LONGEST = 25
CLAUSE = re.compile(rb"[^\x00]{1,%d}" % LONGEST)
#: How many words an intent reaches for a harm, and a denial for what it denies.
REACH = 3

#: An event: a tier, or 0 for a threat; denied; reported.
Event = tuple[int, bool, bool]
THREAT = 0


def _symbols() -> dict[str, int]:
    out = dict.fromkeys(HARMS, HARM)
    for names, symbol in ((INTENTS, INTENT), (PERSONS, PERSON), (YOUS, YOU), (SPEECHES, SPEECH), (DENIALS, DENIAL)):
        out |= dict.fromkeys(names, symbol)
    return out | dict.fromkeys("\"“”„«»", QUOTE) | dict.fromkeys(".!?;:|\n", END)


class Symbols(dict):
    """Word -> symbol; insults by the strongest tier among their atoms. Forgets all when it has grown to `most` words."""

    def __init__(self, lexicon: Mapping[str, int], most: int = 400_000):
        super().__init__()
        self.lexicon, self.closed, self.most = lexicon, _symbols(), most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        tier = max((self.lexicon.get(a, 0) for a in atoms(token)), default=0)
        closed = self.closed.get(token, DENIAL if token.endswith(("n't", "n’t")) else OTHER)
        self[token] = found = INSULT + tier - 1 if tier and closed == OTHER else closed
        return found


#: Lengths of the word beginnings that a lexicon can have, beside whole words.
BEGINNINGS = range(3, 10)


def atoms(word: str) -> list[str]:
    """The word (ending in a mark, so that it is no beginning) and its beginnings."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if k <= len(word))] if len(word) > 2 else []


def threat(state: int, symbol) -> tuple[int, object]:
    if symbol == INTENT:
        return REACH, symbol
    if symbol == HARM:
        return (0, (THREAT, False, False)) if state else (0, OTHER)
    if not isinstance(symbol, tuple) and symbol >= INSULT:
        symbol = (symbol - INSULT + 1, False, False)
    return max(0, state - 1), symbol


def negation(state: int, symbol) -> tuple[int, object]:
    if symbol == DENIAL:
        return REACH, symbol
    if isinstance(symbol, tuple) and state:
        symbol = (symbol[0], True, symbol[2])
    return max(0, state - 1), symbol


def speech(state: str, symbol) -> tuple[str, object]:
    """own, reported until the clause ends, or quoted until the quotes end."""
    if symbol == SPEECH:
        return state if state == "quoted" else "reported", symbol
    if symbol == QUOTE:
        return "own" if state == "quoted" else "quoted", symbol
    if isinstance(symbol, tuple) and state != "own":
        symbol = (symbol[0], symbol[1], True)
    return state, symbol


def _strength(e: Event) -> tuple:
    return not e[1], not e[2], e[0] == THREAT, e[0]


def strongest(state: tuple[Event | None, bool], symbol) -> tuple[tuple[Event | None, bool], object]:
    best, aimed = state
    if isinstance(symbol, tuple):
        best = symbol if best is None else max(best, symbol, key=_strength)
    return (best, aimed or symbol in (YOU, PERSON)), symbol


class Composed:
    """Transducers in a row as one machine."""

    def __init__(self, *parts: tuple[object, Callable]):
        self.start, self.steps = tuple(s for s, _ in parts), [f for _, f in parts]
        self.arcs: dict[tuple, tuple] = {}

    def _arc(self, state: tuple, symbol: int) -> tuple[tuple, bool]:
        out = []
        for at, step in zip(state, self.steps, strict=True):
            at, symbol = step(at, symbol)
            out.append(at)
        return tuple(out), isinstance(symbol, tuple)

    def run(self, symbols: bytes) -> tuple[tuple, int]:
        """The last state, and how many events were written."""
        state, events = self.start, 0
        for x in symbols:
            if (arc := self.arcs.get((state, x))) is None:
                arc = self.arcs[state, x] = self._arc(state, x)
            state, is_event = arc
            events += is_event
        return state, events


#: Classes: event (threat, tiers), denied, reported, aimed at somebody.
CLASSES = [(event, denied, reported, aimed) for event in range(TIERS + 1) for denied in (False, True) for reported in (False, True) for aimed in (False, True)]
_NUMBER = {c: i for i, c in enumerate(CLASSES)}


def grammar() -> Composed:
    return Composed((0, threat), (0, negation), ("own", speech), ((None, False), strongest))


_GRAMMAR = grammar()


@lru_cache(1 << 16)
def class_of(clause: bytes) -> tuple[int, int]:
    """The class of a clause's symbols (by its strongest event) and the number of its events."""
    state, events = _GRAMMAR.run(clause)
    best, aimed = state[-1]
    return (-1, 0) if best is None else (_NUMBER[(*best, aimed)], events)


def parse(text: str, symbols: Symbols) -> tuple[int, Counter]:
    """How many clauses a text has, and how many events are in the clauses of each class."""
    read, found = CLAUSE.findall(bytes(map(symbols.__getitem__, TOKEN.findall(text.lower())))), Counter()
    for c in read:
        if max(c) >= HARM:
            of, events = class_of(c)
            found[of] += events
    found.pop(-1, None)
    return len(read), found
