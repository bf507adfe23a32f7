"""Reading product facts out of a listing title.

A title such as ``"hot deal: 5pk jimidryk ink refill, blk 0.25 L (ER-61788)"`` is cut into

* ``version``  - release of a software title, ``"9.5"``, ``"2008"`` (years may be shortened, numerals Roman),
* ``edition``  - one canonical edition word,
* ``size``     - one canonical measure such as ``"ml:250"``, whichever unit it was written in,
* ``colour``, ``pack`` (pieces per package) and ``model`` (maker's code),
* ``names``    - the words that are left: product line and maker.

Platform, medium, category words and sales talk carry no identity and are dropped.  Everything is a pure function
of the text; nothing is looked up in data.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Spellings of "no value".
MISSING = frozenset("|nan|n/a|na|none|null|unknown|not specified|unspecified|not available|not applicable|-|--|?|.|n.a.".split("|"))

# Edition words and their canonical form.
EDITIONS = {
    "standard": "standard", "std": "standard",
    "professional": "professional", "pro": "professional", "prof": "professional",
    "premium": "premium", "prem": "premium",
    "home": "home",
    "enterprise": "enterprise", "ent": "enterprise",
    "student": "student", "academic": "student", "education": "student",
    "deluxe": "deluxe", "dlx": "deluxe",
    "upgrade": "upgrade", "upg": "upgrade",
    "ultimate": "ultimate", "basic": "basic", "lite": "lite",
}

# Colours and their shorter spellings.
COLOURS = {
    "black": "black", "blk": "black", "white": "white", "wht": "white", "silver": "silver", "slvr": "silver",
    "graphite": "graphite", "grey": "graphite", "gray": "graphite", "red": "red", "blue": "blue", "green": "green",
    "yellow": "yellow", "pink": "pink", "gold": "gold",
}

# Sales talk, longest first where one holds another.
SALES_TALK = """while supplies last|ideal for beginners|retail packaging|no. 1 choice|no 1 choice|100% genuine|factory sealed|limited offer
special offer|trusted seller|award winning|free shipping|fast dispatch|as advertised|money saver|ships today|easy to use|best price|top rated
great gift|brand new|bestseller|must have|hot deal|in stock|clearance|original|buy now|**sale**|new!""".replace("\n", "|").split("|")

# Category, medium, platform and filler words of product titles; they never name a product.
GENERIC_WORDS = frozenset("""
accounting adventure air antivirus anti virus architect arithmetic art audio backup bank battery blank bookkeeping bottle box brain bulk
business by cable card case cassette cd charger choice clip clipart collection copier cord course cutter data dvd design designer digital-art
disk display download drawing drive e edition editing editor email ethernet external film filter flash flight floor for from game generous
graphics guard guide hard hdd helper house hybrid images income ink jewel keyboard kit lan language learn learning ledger lessons library mac
macintosh mail malware management manager math mathematics maths memory messaging mini mobile model monitor movie music network only package picture illustration
pack pad paint patch pc photo pilot plan planner portable power preparation printer printers privacy production program protection puzzle
puzzler recordable recorder recording refill return rom royalty free royalty-free screen server set simulation simulator small software solver sound speak stick studio
suite tape tax teacher thumb tool toolkit toner powder touch trainer translation trainer tutor typing usb use utility vector ver version video
virus voice win windows word works-suite and of the to in with no new sale offer special original bestseller clearance seller dispatch advertised genuine sealed packaging beginners
ideal supplies last while retail factory limited trusted award winning shipping money saver ships today easy best price top rated great gift brand
must have hot deal stock buy now fast as piece pieces pcs pk ed edition 3d inch metre metres meter meters litre litres gram grams gigabyte terabyte minutes minute hour hours
peripherals publishing games labs technologies digital media interactive systems electronics group works company inc ltd gmbh corp corporation limited llc
""".split())  # fmt: skip

# Those of the generic words that tell what kind of thing is sold.
CATEGORY_WORDS = frozenset("""accounting antivirus architect arithmetic backup bank battery bookkeeping cable cassette charger clip clipart copier cord design designer
disk drawing drive email filter flash flight graphics house income ink keyboard language ledger lessons mail malware math mathematics maths memory messaging monitor movie film
music network paint patch photo pilot planner printer privacy puzzle puzzler recorder recording refill server simulation simulator solver speak stick tape tax toner translation
typing vector video virus voice""".split())  # fmt: skip

_ROMAN = {r: str(i) for i, r in enumerate("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split(), 1)}
# Categories that hold an edition word without naming an edition.
_CATEGORIES = re.compile(r"(?<!\w)home[\W_]+(?:design\w*|archite\w*|planner)")
_INVISIBLE = re.compile("[­᠎​-‏ -‮⁠-⁤﻿]")
_SPACE = re.compile(r"\s+")
_TALK = re.compile("|".join(rf"(?<!\w){re.escape(p)}" + (r"(?!\w)" if p[-1].isalpha() else "") for p in SALES_TALK))
_MODEL = re.compile(r"(?<![a-z0-9])(?:model\s+)?#?([a-z]{2})[ \-]?(\d{5})(?!\d)")
_YEAR_SHORT = re.compile(r"'(\d\d)(?!\d)")
_PACK = re.compile(r"(?<![\w.])(?:(?:set|pack|box|case)[\W_]+of[\W_]+(\d{1,3})|(\d{1,3})[ \-]?(?:pcs|pieces|piece|pc\.|pk|pack|x))(?![\w])")
_NUM = r"(\d{1,3}(?:,\d{3})+|\d+(?:[.,]\d+)?)"
_UNITS = [
    ("mb", 1.0, r"mb|megabytes?"), ("mb", 1000.0, r"gb|g-?bytes?|gigabytes?"), ("mb", 1e6, r"tb|t-?bytes?|terabytes?"),
    ("mah", 1.0, r"mah"), ("mah", 1000.0, r"ah"),
    ("mm", 1.0, r"mm|millimet(?:er|re)s?"), ("mm", 10.0, r"cm|centimet(?:er|re)s?"), ("mm", 25.4, r"inch(?:es)?|in(?:\.|\b)|\""),
    ("ml", 1.0, r"ml|millilit(?:er|re)s?"), ("ml", 10.0, r"cl|centilit(?:er|re)s?"), ("ml", 1000.0, r"l|lit(?:er|re)s?"),
    ("g", 1000.0, r"kg|kilos?|kilograms?"), ("g", 1.0, r"g|grams?"),
    ("min", 60.0, r"h|hrs?|hours?"), ("min", 1.0, r"min(?:\.|\b)|minutes?|mins"),
    ("mm", 1000.0, r"m|met(?:er|re)s?"),
]
_SIZE = re.compile(rf"(?<![\w.,]){_NUM}[ \-/]{{0,3}}(?:" + "|".join(f"({u})" for _, _, u in _UNITS) + r")(?![a-z0-9])")
_TAPE = re.compile(r"(?<!\w)c(\d{2,3})(?!\w)")
_VERSION = re.compile(r"(?<!\w)(?:version|ver\.?|v\.?)\s?(\d{1,4}(?:\.\d{1,2})?)(?![\w])")
_BARE = re.compile(r"(?<![\w.,])(\d{1,4}(?:\.\d{1,2})?)(?![\w,%]|\.\d)")
_WORD = re.compile(r"[^\W_]+")
_LONG_WORD = re.compile(r"[a-z]{5,}")


def plain(text: str | None) -> str:
    """Lower case without accents, invisible characters and repeated white space; ``""`` for null."""
    if not text:
        return ""
    if text.isascii():
        return _SPACE.sub(" ", text).strip().lower()
    text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)).lower()
    return _SPACE.sub(" ", "".join(c for c in text if not unicodedata.combining(c))).strip()


def is_missing(text: str | None) -> bool:
    """Null, blank, or a spelling of "no value"."""
    return plain(text) in MISSING


def near(a: str, b: str, most: int) -> int:
    """Edit distance with adjacent swaps, or ``most + 1`` as soon as it is known to exceed ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before = prev
    return row[-1]


def shortened(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out; words within that many edits share at least one such form."""
    forms, layer = {word}, {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        forms |= layer
    return forms


#: Words of this length on are compared over their ends; shorter ones, and those up to two letters longer, as a whole.
ENDS = 12


def spelling_forms(word: str) -> set[str]:
    """Forms of which two words share one if they are within their slips (see ``slips``) of each other.

    A short word gives itself with up to two letters left out.  Of two slips in a long one, at most one lies in one of
    its ends, so each end with one letter left out will do, and the number of forms does not depend on the length.
    """
    forms = shortened(word, slips(word)) if len(word) < ENDS + 2 else set()
    if len(word) >= ENDS:
        forms |= {"<" + x for x in shortened(word[: ENDS // 2], 1)} | {x + ">" for x in shortened(word[-ENDS // 2 :], 1)}
    return forms


def slips(word: str) -> int:
    """Slips of the pen that a name of this length may hold."""
    return 0 if len(word) < 5 else 1 if len(word) < 7 else 2


def _index(words: set[str]) -> dict[str, tuple[str, ...]]:
    out: dict[str, list[str]] = {}
    for w in sorted(words):
        if len(w) >= 5:
            for form in shortened(w, 1 if len(w) < 8 else 2):
                out.setdefault(form, []).append(w)
    return {k: tuple(v) for k, v in out.items()}


_KNOWN = GENERIC_WORDS | set(EDITIONS) | set(COLOURS)
_FORMS = _index(set(_KNOWN))
_LONGEST = max(map(len, _KNOWN)) + 2


@lru_cache(maxsize=1 << 16)
def generic(word: str) -> str | None:
    """The known title word that this is, allowing one slip of the pen in words of five letters or more, two from eight on."""
    if word in _KNOWN:
        return word
    if len(word) < 5 or len(word) > _LONGEST or not word.isalpha():
        return None
    most = 1 if len(word) < 8 else 2
    met = {w for form in shortened(word, most) for w in _FORMS.get(form, ())}
    fit = [(d, w) for w in met if (d := near(word, w, 2)) <= (1 if len(w) < 8 else most)]
    return min(fit)[1] if fit else None


def _number(text: str) -> float:
    if re.fullmatch(r"\d{1,3}(,\d{3})+", text):
        return float(text.replace(",", ""))
    return float(text.replace(",", "."))


def _release(text: str) -> str:
    head, _, tail = text.partition(".")
    tail = tail.rstrip("0")
    return f"{int(head)}.{tail}" if tail else str(int(head))


def squeezed(text: str | None) -> str:
    """Letters and digits only: equal for titles that differ in case, spacing or punctuation."""
    return "".join(_WORD.findall(plain(text)))


def category_words(title: str | None) -> list[str]:
    """Words that tell what kind of thing the title offers, slips of the pen put right, sales talk left out."""
    return sorted({known for w in _WORD.findall(_TALK.sub(" | ", plain(title))) if (known := generic(w)) in CATEGORY_WORDS})


def parse(title: str | None, amend: bool = True) -> dict | None:
    """Facts of one title, or None for a missing title.

    ``forms`` holds the facts as they were worded (``"64 g-byte"`` and ``"64gb"`` differ), slips of the pen in known words
    put right, so that a listing entered again can be told from other wording.
    """
    if is_missing(title):
        return None
    t = plain(title).replace("``", '"').replace("''", '"').replace("\u2019", "'").replace("\u2033", '"')
    if amend:
        t = _LONG_WORD.sub(lambda m: generic(m[0]) or m[0], t)
    out = {"version": "", "edition": "", "size": "", "colour": "", "pack": "", "model": "", "names": []}
    forms = []

    def take(field, value, raw):
        if not out[field]:
            out[field] = value
            forms.append("".join(_WORD.findall(raw)))
        return " | "

    t = _CATEGORIES.sub(" | ", _TALK.sub(" | ", t))
    t = _MODEL.sub(lambda m: take("model", m[1] + m[2], m[1] + m[2]), t)
    t = _PACK.sub(lambda m: take("pack", str(int(m[1] or m[2])), m[0]), t)

    def size(m):
        k = next(i for i in range(len(_UNITS)) if m[2 + i])
        kind, factor, _ = _UNITS[k]
        value = _number(m[1]) * factor
        if kind == "mm" and (factor == 25.4 or (factor == 10.0 and "." in m[1])):
            kind, value = "inch", round(value / 25.4, 1)
        return take("size", f"{kind}:{value:g}", m[0])

    t = _SIZE.sub(size, t)
    if not out["size"]:
        t = _TAPE.sub(lambda m: take("size", f"min:{int(m[1])}", m[0]), t)

    t = _VERSION.sub(lambda m: take("version", _release(m[1]), m[0]), t)
    t = _YEAR_SHORT.sub(lambda m: take("version", str(int(m[1]) + (1900 if int(m[1]) > 60 else 2000)), m[0]), t)
    if not out["version"]:
        t = _BARE.sub(lambda m: take("version", _release(m[1]), m[0]), t)
    kept, broken = [], []
    words = _WORD.findall(t)
    for i, w in enumerate(words):
        known = generic(w) if amend else w if generic(w) == w else None
        if known in EDITIONS:
            take("edition", EDITIONS[known], known)
        elif known in COLOURS:
            take("colour", COLOURS[known], known)
        elif known is None:
            if not out["version"] and w in _ROMAN and i:
                take("version", _ROMAN[w], w)
            elif len(w) > 1 and not w.isdigit():
                kept.append(w)
                beside = words[max(0, i - 1) : i] + words[i + 1 : i + 2]
                if len(w) < 5 and all(generic(x) or len(x) > 6 for x in beside):
                    # part of a name that was broken in two, the other part of which looks like a known word
                    broken += [x + y for x, y in zip(words[max(0, i - 1) : i + 1], words[max(0, i - 1) + 1 : i + 2], strict=False) if len(x + y) < 10]
    if amend and not kept and not out["model"]:
        return parse(title, amend=False)
    out["names"], out["broken"] = kept, broken
    out["forms"] = " ".join(forms)
    return out
