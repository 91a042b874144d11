"""Letter-to-sound by decision trees over letter context, for a pluggable table of nodes."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from prosodia.functions.arrow import Memo
from prosodia.functions.constants import ARPABET, NUCLEI
from prosodia.functions.phonology import possessive, will

_FOLD = {"þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ð": "d", "ø": "o", "ł": "l", "đ": "d", "ı": "i"}


def fold(word: str) -> str:
    """Latin letters without their marks; what has no ASCII form stays."""
    import unicodedata

    if word.isascii():
        return word
    return "".join(_FOLD.get(c) or unicodedata.normalize("NFD", c)[0] for c in word)


def arpabet_to_ipa(phones: list[str], table: Mapping[str, str] = ARPABET) -> str:
    """Symbols of phones such as EH1: the stress mark comes before; unstressed AH is a schwa; unknown phones vanish."""
    out = []
    for phone in phones:
        m = re.fullmatch(r"([A-Za-z]+?)([0-9])?", phone)
        if not m:
            continue
        base, stress = m[1].upper(), m[2]
        symbol = table.get("AH0" if base == "AH" and stress == "0" else base)
        if symbol:
            out.append({"1": "ˈ", "2": "ˌ"}.get(stress, "") + symbol)
    return "".join(out)


#: Symbols of a leaf's phones, as they are in ARPABET.
_leaf = Memo(lambda said: "" if said == "epsilon" else arpabet_to_ipa(said.split("-")), 1 << 12)


@dataclass(frozen=True)
class Node:
    """Asks whether the ``feature``-th of the eight letters around is ``value``; a leaf has phones."""

    feature: int = -1
    value: str = ""
    yes: int = -1
    no: int = -1
    phones: str = ""


def walk(nodes: list[Node], root: int, context: str) -> str:
    node = nodes[root]
    while node.feature >= 0:
        node = nodes[node.yes if context[node.feature] == node.value else node.no]
    return node.phones


def sound_out(word: str, nodes: list[Node], roots: Mapping[str, int]) -> str:
    """A reading from the trees: four letters on either side, # at the edges and 0 beyond; ``epsilon`` is silent and x-y
    are two phones."""
    folded = fold(word.strip().lower())
    padded = f"000#{folded}#000"
    out = []
    for i, c in enumerate(folded, 4):
        if c in roots:
            # Most letters are settled at their root, where nothing is asked.
            root = nodes[roots[c]]
            said = root.phones if root.feature < 0 else walk(nodes, roots[c], padded[i - 4 : i] + padded[i + 1 : i + 5])
            out.append(_leaf[said])
    return "".join(out)


_ONE = {
    "a": "ae1", "b": "b", "c": "k", "d": "d", "e": "eh1", "f": "f", "g": "g", "h": "hh", "i": "ih1", "j": "jh", "k": "k", "l": "l", "m": "m",
    "n": "n", "o": "aa1", "p": "p", "q": "k", "r": "r", "s": "s", "t": "t", "u": "ah1", "v": "v", "w": "w", "x": "k-s", "y": "iy0", "z": "z",
}


def small_trees() -> tuple[list[Node], dict[str, int]]:
    """One phone a letter, c before e, i and y soft, last e silent: a stand-in where no trained trees are supplied."""
    nodes: list[Node] = []
    roots = {}
    for letter, phones in _ONE.items():
        if letter == "e":
            nodes += [Node(4, "#", len(nodes) + 1, len(nodes) + 2), Node(phones="epsilon"), Node(phones=phones)]
            roots[letter] = len(nodes) - 3
        elif letter == "c":
            at = len(nodes)
            nodes += [Node(4, "e", at + 3, at + 1), Node(4, "i", at + 3, at + 2), Node(4, "y", at + 3, at + 4), Node(phones="s"), Node(phones="k")]
            roots[letter] = at
        else:
            nodes.append(Node(phones=phones))
            roots[letter] = len(nodes) - 1
    return nodes, roots


def stem_and_ending(word: str, sound: Callable[[str], str]) -> tuple[str, str]:
    """(reading, rule): possessives and 'll attach to the stem's own reading; a capitalised word in a ends in a schwa."""
    def stem(w: str) -> str:
        ipa = sound(w)
        return ipa + "ə" if ipa and w[:1].isupper() and w.lower().endswith("a") and not ipa.endswith("ə") else ipa

    for ending, put in (("'s", possessive), ("'ll", will)):
        head = word.removesuffix(ending)
        if head != word and head and (ipa := stem(head)):
            return ipa + put(ipa), ending
    return stem(word), ""


_STRESS = re.compile("[ˈˌː]")


def structural_flags(ipa: str) -> list[str]:
    """What is wrong with a reading by its build: no vowel, two main stresses, or a last run of consonants that needs one.

    ɹ may close a run, as a vowel does, but is none by itself.
    """
    out = []
    if len(_STRESS.sub("", ipa)) >= 2 and not any(c in NUCLEI for c in ipa):
        out.append("NO-NUCLEUS")
    if ipa.count("ˈ") >= 2:
        out.append("DOUBLE-STRESS")
    tail = _STRESS.sub("", re.search(f"[^{NUCLEI}ɹ]*$", ipa)[0])
    if re.search("(?<!l)[mnŋ]$|l$", tail) and len(tail) >= 2 and not (len(tail) == 2 and tail[0] == "ʔ"):
        out.append(f"NO-VOWEL-TAIL({tail})")
    return out
