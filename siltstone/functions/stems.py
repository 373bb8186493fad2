"""English and Italian stems, after the published Snowball definitions of the two languages."""

from __future__ import annotations

import re

# fixed values: English suffix tables and exceptions
E_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
E_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
E_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
E_WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
E_KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
E_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# fixed values: Italian pronouns and suffixes
I_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
I_DELETE = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
I_IC = "azione azioni atore atori".split()
I_VERBS = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo "
    "Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir").split()


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part behind the first consonant that follows a vowel begins."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


E_VOWELS = "aeiouy"
E_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)\Z")
E_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|\A[aeiouy][^aeiouy])\Z")


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in E_WORDS or word in E_KEPT:
        return E_WORDS.get(word, word)
    w = re.sub(r"\Ay|(?<=[aeiouy])y", "Y", word.removeprefix("'"))
    special = re.match("gener|commun|arsen", w)
    r1 = special.end() if special else _region(w, E_VOWELS)
    r2 = _region(w, E_VOWELS, r1)
    w = re.sub(r"('s'|'s|')\Z", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in E_AFTER_1A:
        return w
    # 1b
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and re.search("[aeiouy]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif E_DOUBLE.search(w):
            w = w[:-1]
        elif len(w) <= r1 and E_SHORT.search(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in E_VOWELS:
        w = w[:-1] + "i"
    # 2
    s = _longest(w, [*E_STEP2, "ogi", "li"])
    if s and len(w) - len(s) >= r1:
        if s in E_STEP2:
            w = w[: -len(s)] + E_STEP2[s]
        elif s == "ogi" and w.endswith("logi"):
            w = w[:-1]
        elif s == "li" and w[-3:-2] and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    # 3
    s = _longest(w, [*E_STEP3, "ative"])
    if s and len(w) - len(s) >= r1:
        if s in E_STEP3:
            w = w[: -len(s)] + E_STEP3[s]
        elif len(w) - len(s) >= r2:
            w = w[: -len(s)]
    # 4
    s = _longest(w, [*E_STEP4, "ion"])
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not E_SHORT.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


I_VOWELS = "aeiouàèìòù"


def italian(word: str) -> str:
    w = word.translate(str.maketrans("áéíóú", "àèìòù"))
    w = re.sub("qu", "qU", w)
    w = re.sub(f"(?<=[{I_VOWELS}])[ui](?=[{I_VOWELS}])", lambda m: m[0].upper(), w)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in I_VOWELS:
            m = re.compile(f"[{I_VOWELS}]").search(w, 2)
        elif w[0] in I_VOWELS:
            m = re.compile(f"[^{I_VOWELS}]").search(w, 2)
        else:
            m = re.compile("(?s).").search(w, 2)
        rv = m.end() if m else len(w)
    r1 = _region(w, I_VOWELS)
    r2 = _region(w, I_VOWELS, r1)
    # attached pronouns
    s = _longest(w, I_PRONOUNS)
    if s:
        stem = w[: -len(s)]
        if stem.endswith(("ando", "endo")) and len(stem) - 4 >= rv:
            w = stem
        elif stem.endswith(("ar", "er", "ir")) and len(stem) - 2 >= rv:
            w = stem + "e"
    before = w
    w = _italian_suffix(w, r1, r2, rv)
    if w == before:
        s = _longest(w[rv:], I_VERBS)
        w = w[: len(w) - len(s)] if s else w
    if w and w[-1] in "aeioàèìò" and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.lower()


def _italian_suffix(w: str, r1: int, r2: int, rv: int) -> str:
    every = [*I_DELETE, *I_IC, "logia", "logie", "uzione", "uzioni", "usione", "usioni", "enza", "enze", "amento", "amenti", "imento", "imenti", "amente", "ità", "ivo", "ivi", "iva", "ive"]
    s = _longest(w, every)
    if not s:
        return w
    at, stem = len(w) - len(s), w[: -len(s)]

    def without(stem: str, *suffixes: str) -> str:
        e = _longest(stem, suffixes)
        return stem[: -len(e)] if e and len(stem) - len(e) >= r2 else stem

    if s in ("amento", "amenti", "imento", "imenti"):
        return stem if at >= rv else w
    if s == "amente":
        if at < r1:
            return w
        e = _longest(stem, ("iv", "os", "ic", "abil"))
        if e and len(stem) - len(e) >= r2:
            stem = stem[: -len(e)]
            if e == "iv":
                stem = without(stem, "at")
        return stem
    if at < r2:
        return w
    if s in I_DELETE:
        return stem
    if s in I_IC:
        return without(stem, "ic")
    if s in ("logia", "logie"):
        return stem + "log"
    if s in ("uzione", "uzioni", "usione", "usioni"):
        return stem + "u"
    if s in ("enza", "enze"):
        return stem + "ente"
    if s == "ità":
        return without(stem, "abil", "ic", "iv")
    cut = without(stem, "at")
    return without(cut, "ic") if cut != stem else stem


def stems(token: str) -> list[str]:
    """The stems that stand beside a token in the index and in a query: of both languages, where they are another word.

    Tokens under four bytes, with a digit or of an identifier have none.
    """
    if len(token.encode()) < 4 or "_" in token or any(c.isdigit() for c in token):
        return []
    out = []
    for s in (italian(token), english(token)):
        if s != token and s not in out and len(s.encode()) >= 2:
            out.append(s)
    return out
