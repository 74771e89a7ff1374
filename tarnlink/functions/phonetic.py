"""Double Metaphone as a table of contextual rules.

A rule is (letters at the place, what stands before, what follows, primary, alternate, letters consumed); the first
that fits gives the codes. Before and after are regular expressions over the word padded by blanks.
"""

from __future__ import annotations

import re
from functools import lru_cache

_VOWEL = "[AEIOUY]"
#: letter -> rules; an empty context always fits. X is "sh", 0 is "th".
_RULES: dict[str, list[tuple[str, str, str, str, str]]] = {
    "B": [("BB?", "", "", "P", "P")],
    "C": [
        ("CH", "^ ", "(?=(?:ARAC|ARIS|OR|YM|IA|EM)(?!E\\b))", "K", "K"),
        ("CH", "(?:VAN |VON |SCH|ORCHES|ARCHIT|ORCHID)", "", "K", "K"),
        ("CH", "(?:^ |[AOUE])", "(?=[LRNMBHFVW ])", "K", "K"),
        ("CH", "^ M", "", "K", "K"),
        ("CH", "^ ", "", "X", "X"),
        ("CH", "", "", "X", "K"),
        ("CIA", "", "", "X", "X"),
        ("CZ", "(?<!WI)", "", "S", "X"),
        ("CC(?=[IEH](?!U))", "(?:^ A|U)", "(?=E[ES]|E[EZ]|ES)", "KS", "KS"),
        ("CC(?=[IEH])", "(?<!^ M)", "", "X", "X"),
        ("C[KGQ]", "", "", "K", "K"),
        ("C(?=I[OEA])", "", "", "S", "X"),
        ("C(?=[IEY])", "", "", "S", "S"),
        ("C(?:C(?![EI])|[KQ])?", "", "", "K", "K"),
    ],
    "D": [("DG(?=[IEY])", "", "", "J", "J"), ("DG", "", "", "TK", "TK"), ("D[TD]", "", "", "T", "T"), ("D", "", "", "T", "T")],
    "F": [("FF?", "", "", "F", "F")],
    "G": [
        ("GH", "^ ", "(?=I)", "J", "J"),
        ("GH", "^ ", "", "K", "K"),
        ("GH", "[CGLRT]..?U", "", "F", "F"),
        ("GH", "(?:[BHD]..?.?|[BH]...)", "", "", ""),
        ("GH", "[^AEIOUY ]", "", "K", "K"),
        ("GH", "[^I ]", "(?= )", "K", "K"),
        ("GH", "", "", "", ""),
        ("GN", "^ [AEIOUY]", "", "KN", "N"),
        ("GN", "", "(?!EY)", "N", "KN"),
        ("GLI", "", "", "KL", "L"),
        ("G(?=Y|E[SPBLYIR]|I[BLNE])", "^ ", "", "K", "J"),
        ("G(?=ER|Y)", "(?<!DAN)(?<!RAN)(?<!MAN)(?<![EI])", "(?!GY|OGY)", "K", "J"),
        ("GG(?=[EIY])|G(?=[EIY])", "(?:VAN |VON |SCH)", "", "K", "K"),
        ("GG?(?=IER )", "", "", "J", "J"),
        ("GG?(?=[EIY])", "", "", "J", "K"),
        ("GG?", "", "", "K", "K"),
    ],
    "H": [("H(?=[AEIOUY])", "(?:^ |[AEIOUY])", "", "H", "H"), ("H", "", "", "", "")],
    "J": [
        ("JOSE(?= )", "^ ", "", "HS", "HS"),
        ("JJ?", "^ ", "", "J", "A"),
        ("JJ?", "[AEIOUY]", "(?=[AO])", "J", "H"),
        ("JJ?", "", "(?= )", "J", ""),
        ("JJ?", "", "(?![LTKSNMBZ])", "J", "J"),
        ("JJ?", "", "", "", ""),
    ],
    "K": [("KK?", "", "", "K", "K")],
    "L": [("LL(?=[AO]S? |E )", "[IA]", "", "L", ""), ("LL?", "", "", "L", "L")],
    "M": [("MB(?=ER| )", "U", "", "M", "M"), ("MM?", "", "", "M", "M")],
    "N": [("NN?", "", "", "N", "N")],
    "P": [("PH", "", "", "F", "F"), ("P[PB]?", "", "", "P", "P")],
    "Q": [("QQ?", "", "", "K", "K")],
    "R": [("R(?= )", "(?<!M)(?<!A)IE", "", "", "R"), ("RR?", "", "", "R", "R")],
    "S": [
        ("S(?=L )", "[IY]", "", "", ""),
        ("SUGAR", "^ ", "", "XKR", "SKR"),
        ("SH(?=EIM|OEK|OLM|OLZ)", "", "", "S", "S"),
        ("SH", "", "", "X", "X"),
        ("SI(?=[OA])", "", "", "S", "X"),
        ("S(?=[MNLW])", "^ ", "", "S", "X"),
        ("SZ", "", "", "S", "X"),
        ("SCH(?=ER|EN)", "", "", "X", "SK"),
        ("SCH(?=OO|UY|ED|EM)", "", "", "SK", "SK"),
        ("SCH(?=[^AEIOUYW])", "^ ", "", "X", "S"),
        ("SCH", "", "", "X", "X"),
        ("SC(?=[IEY])", "", "", "S", "S"),
        ("SC", "", "", "SK", "SK"),
        ("S(?= )", "[AO]I", "", "", "S"),
        ("S[SZ]?", "", "", "S", "S"),
    ],
    "T": [
        ("TION", "", "", "XN", "XN"),
        ("TIA|TCH", "", "", "X", "X"),
        ("TH(?=OM|AM)|TTH(?=OM|AM)", "", "", "T", "T"),
        ("TT?H", "", "", "0", "T"),
        ("T[TD]?", "", "", "T", "T"),
    ],
    "V": [("VV?", "", "", "F", "F")],
    "W": [
        ("WR", "", "", "R", "R"),
        ("W(?=[AEIOUY])", "^ ", "", "A", "F"),
        ("WH", "^ ", "", "A", "A"),
        ("W(?=SKI|SKY)", "[EO]", "", "", "F"),
        ("W(?= )", "[AEIOUY]", "", "", "F"),
        ("W(?:ICZ|ITZ)", "", "", "TS", "FX"),
        ("W", "", "", "", ""),
    ],
    "X": [("X(?= )", "(?:IAU|EAU|AU|OU)", "", "", ""), ("X(?:C|X)?", "^ ", "", "S", "S"), ("X[CX]?", "", "", "KS", "KS")],
    "Z": [("ZH", "", "", "J", "J"), ("Z(?=ZO|ZI|ZA)", "", "", "S", "TS"), ("ZZ?", "", "", "S", "S")],
}
_SILENT = re.compile("^ (?:GN|KN|PN|WR|PS)")
_COMPILED = {
    letter: [(re.compile(f"(?:{at}){after}"), re.compile(f"(?:{before})$") if before else None, one, two) for at, before, after, one, two in rules]
    for letter, rules in _RULES.items()
}


@lru_cache(1 << 16)
def double_metaphone(word: str) -> tuple[str, str]:
    """Primary and alternate code; the alternate is empty if it is the same."""
    text = " " + "".join(c for c in word.upper().replace("Ç", "S").replace("Ñ", "N") if "A" <= c <= "Z") + "  "
    one, two, i, end = [], [], 1, len(text) - 2
    if _SILENT.match(text):
        i = 2
    while i < end:
        c = text[i]
        if c in "AEIOUY":
            if i == 1:
                one.append("A")
                two.append("A")
            i += 1
            continue
        for at, before, first, second in _COMPILED[c]:
            found = at.match(text, i)
            if found and (before is None or before.search(text[:i])):
                one.append(first)
                two.append(second)
                i += max(1, len(found.group()))
                break
        else:
            i += 1
    a, b = "".join(one), "".join(two)
    return a, "" if a == b else b
