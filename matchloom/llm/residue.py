"""Template residue, filler, error pages and script notices.

Every message of the corpus - a sentence, a title, a list of authors - goes through a fixed-depth prefix tree, the templates
that come out are classified once, and the verdicts are joined back to the parts of the documents that hold the messages.
Slots left open and filler, which have no wording of their own, are found apart from that inside each record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import parallel, spread, stored
from .document_parts import parts

# Names of the fields that templates ask for.
_FIELD = r"(?:author(?:s|[ _]names?)?|corresponding[ _]authors?|titles?|abstract|keywords?|introduction|conclusions?|results?|methods?|discussion|affiliations?|funding|acknowledge?ments?|names?|e-?mail|institute|text|date|titel|zusammenfassung|einleitung|ergebnisse|autor(?:en)?|titre|r[ée]sum[ée]|auteurs?|t[íi]tulo|resumen|autor(?:es)?|nombre|nom)"

# A field left as the template has it.
SLOT = re.compile(
    r"\{\{\s*[\w. |]{1,40}\s*\}\}|<<\s*[\w ]{1,40}\s*>>|@@\s*[\w ]{1,40}\s*@@|(?<!\w)__[A-Z][A-Z_]{1,40}__(?!\w)|\[\[[\w ]{1,40}(?:\|[^\]]{0,40})?\]\]"
    r"|[$#]\{\s*[\w. ]{1,40}\s*\}|<\?=?\s*\$?\w{1,40}\s*;?\s*\?>|<%=?\s*[\w. ]{1,40}\s*%>|%\([a-z_]{1,40}\)s"
    rf"|\[(?:your|ihr|ihre|votre|su)\s[^\]]{{1,40}}\]|\[[^\]]{{1,40}}\s(?:here|hier|ici|aqu[íi])\]|<[^<>]{{1,40}}\s(?:goes\s)?here>|\[(?:tbd|tba|todo)\b[^\]]{{0,40}}\]|\(enter\s[^)]{{1,40}}\)|x{{3,}}\s*\([^)]{{1,40}}to be supplied\)",
    re.I,
)

def _signed(lower: str) -> bool:
    """Whether a text in lower case holds a sign that every slot has one of; quicker than the pattern itself."""
    return "[" in lower or "<" in lower or "{{" in lower or "@@" in lower or "__" in lower or "${" in lower or "#{" in lower or "%(" in lower or "(enter" in lower or "xxx" in lower


#: Every slot begins with one of these; each begins with a plain character, so that the places are found quickly.
_SLOT_BEGINS = re.compile(r"\[|<|\{(?=\{)|@(?=@)|_(?=_)|\$(?=\{)|#(?=\{)|%(?=\()|\((?=[eE])|x(?=[xX])|X(?=[xX])")


def _slotted(text: str) -> bool:
    """Whether there is a slot in the text: the pattern is tried only where one may begin."""
    return any(SLOT.match(text, m.start()) for m in _SLOT_BEGINS.finditer(text))


# Wordings of residue, matched against a template from its first word on.
_PLACEHOLDER = rf"""(?:please )?(?:insert|enter|type|add|write|put) (?:your |the |an? )?\S+(?: \S+){{0,3}} here
click (?:here )?to (?:add|edit|enter)
please replace this (?:text|paragraph|sentence)
write about the \S+(?: \S+)? in this section
the (?:abstract|introduction|title|conclusion|paper) should (?:be|have|contain|state)
your (?:name|title|text|abstract|affiliation|address|e-?mail)\b(?: (?:here|goes here)|[,.;:]|$| ?and|\\thanks| your)
(?:firstname|first name|vorname|pr[ée]nom) (?:lastname|last name|nachname|nom)
author names?(?:$| ?[,\\])
(?:this is )?(?:a )?(?:dummy|sample|placeholder|example) (?:text|sentence|content|paragraph)
some text to fill
paragraph text
sample sentence
{_FIELD} goes here
dear .* thank you for
null null
(?:null|undefined|nan|none)[ ,]+(?:null|undefined|nan|none)
text (?:goes )?here
(?:bitte )?(?:geben sie|hier) .* (?:ein|einf[üu]gen|eingeben)
(?:veuillez )?(?:ins[ée]r(?:er|ez)|saisi(?:r|ssez)|[ée]cri(?:re|vez)) .* ici
(?:por favor )?(?:inserte|introduzca|escriba|a[ñn]ada) .* aqu[íi]
\\(?:lipsum|kant|blindtext|Blindtext|blindmathpaper|blinddocument)\b"""
_ERROR = r"""(?:http )?(?:error |erreur |fehler )?<\*>(?: :|:| -| –)? ?(?:gone|not found|forbidden|bad request|unauthorized|internal server error|service unavailable|gateway time-?out|bad gateway|too many requests|method not allowed|request time-?out|page|seite|p[áa]gina)
(?:http|error|erreur|fehler) <\*>
(?:error|erreur|fehler) ?:
sorry,? (?:but )?we (?:could|can) ?not
(?:sorry|oops|uh[- ]oh)[,.!: ]
(?:oops|whoops)
something (?:went wrong|broke)
(?:ticket|reference|request|incident|error|trace|support) ?(?:id|no\.?|number|code)?:? ?[<#(]?[a-z]*<\*>
this (?:record|page|document|site) has (?:been )?moved
if you are not redirected
too many requests
conversion failed
log \S*<\*>\S* (?:is |was )?kept
fatal:
uncaught (?:exception|error)
undefined is not a function
(?:traceback|stack trace|segmentation fault|exception in)
the server (?:encountered|could not|is)
internal server error
(?:the )?(?:full text|page|service|document|requested \S+)(?: \S+){0,4} (?:is|are) (?:temporarily |currently )?(?:unavailable|not available)
the requested (?:document|page|url|resource)
we apologi[sz]e for
download limit
(?:your )?session (?:has )?expired
(?:please )?(?:sign|log) in (?:again )?to
access (?:is )?(?:denied|forbidden)[.!]
access denied
you do not have permission
please confirm (?:that )?you are not
(?:please )?(?:verify|prove) (?:that )?you are (?:a )?human
gateway tim
(?:slow down and )?retry in
try again (?:later|tomorrow|in)
request(?:ed)? (?:id|reference)
(?:page|file|document|article) not found
zugriff verweigert
bitte melden sie sich
der dienst ist
das dokument konnte nicht
(?:die )?seite (?:wurde )?nicht gefunden
acc[èe]s refus[ée]
veuillez vous (?:connecter|identifier)
le (?:document|service)(?: demand[ée])? (?:n.a pas pu|n.est pas|est temporairement)
page introuvable
acceso denegado
(?:por favor )?inicie sesi[óo]n
no se pudo
el servicio no
p[áa]gina no encontrada"""
_SCRIPT = r"""(?:this|our|the) (?:page|site|reader|viewer|archive|website|application)(?: \S+){0,3} (?:requires?|needs?) (?:java-?script|scripts?|cookies)
this page requires
(?:please )?(?:allow|enable|activate|turn on|switch on) (?:java-?script|scripts?|scripting|cookies)
you (?:need|have) to (?:enable|activate|allow)
java-?script (?:is|must|has|appears)(?: \S+){0,2} (?:turned off|disabled|off|required|enabled|blocked)
switch it on to
scripting (?:appears|is|seems)
for full functionality
we are checking your browser
checking your browser
enable cookies
noscript:
(?:bitte )?aktivieren sie
ohne (?:skripte|java-?script)
(?:veuillez )?activer java-?script
veuillez activer
(?:cette page|ce site) (?:ne fonctionne pas|n[ée]cessite|requiert)
active java-?script
(?:por favor )?active
(?:esta p[áa]gina|este sitio) (?:necesita|requiere)"""
_FILLED = r"""lorem ipsum(?: dolor\b|\W*$)"""
# What pages carry around their content.
_CHROME = re.compile(r"home \| browse \| help|back to search|contact the archive|cookie settings|powered by \w+|\(c\) the archive|log in\b(?! (?:again )?to)|sign up|menu\b|skip to content", re.I)


def _framed(lower: str) -> bool:
    """Whether a text in lower case holds one of the signs that everything which ``_CHROME`` matches has."""
    return "menu" in lower or "log in" in lower or "sign up" in lower or "| browse" in lower or "back to search" in lower or "contact the archive" in lower or "cookie settings" in lower or "powered by" in lower or "(c) the archive" in lower or "skip to content" in lower


_KINDS = [(k, re.compile("(?:" + "|".join(f"(?:{p})" for p in text.split("\n")) + ")")) for k, text in (("placeholder", _PLACEHOLDER), ("error", _ERROR), ("script", _SCRIPT), ("filler", _FILLED))]

# Function words of the languages that articles are written in; words that pseudo-Latin filler uses too are left out.
_FUNCTION = frozenset("""the of and is are was were that to with we for in when from it its our by under as at this these an a be can or on not here which where each every has have
der die das und ist sind mit wir für von eine einer einem zu dass aus im bei auf wird den des dem ein es sich nicht für
le la les de des est sont nous pour une du que et dans un au aux sur avec par cette son sa
el los las y es son con que se para en un una del al por su lo como sobre bajo""".split())  # fmt: skip

_MATH = re.compile(r"\$\$.*?\$\$|\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)|\\begin\{(equation|align|eqnarray|gather|multline|displaymath|figure|table|tabular)\*?\}.*?\\end\{\1\*?\}", re.S)
_QUOTED = re.compile(r"\\(?:verb\*?(.)[^\n]*?\1|(?:texttt|emph|url|textit)\s*\{[^{}]*\})|``[^`]*?''|\\begin\{(verbatim|lstlisting)\}.*?\\end\{\2\}", re.S)
_MARK = re.compile(r"\\(?:cite\w*|ref|eqref|label|includegraphics|caption|footnote|item|inst|and|thanks)\b(?:\[[^\]]*\])*|\\[a-zA-Z]+\*?(?=[\s{\\]|$)")
_DIGIT = re.compile(r"\d")
_DIGITS = re.compile(r"[0-9a-f]*\d[0-9a-f]*|\d+", re.I)
#: From the first digit of a number on; what it has before that, a mask finds by going back.
_NUMBER = re.compile(r"[0-9][0-9a-f]*")
#: Letters of ASCII in lower case and line breaks as they are, everything else as spaces.
_LETTERS = bytes(c if c == 10 or 97 <= c <= 122 else 32 for c in range(256))
_ESCAPED = re.compile(r"\\([_$#&%{}])")
_TEXT_WORD = re.compile(r"[^\W\d_]+")
_FILLER_COMMAND = re.compile(r"\\(?:lipsum|kant|blindtext|Blindtext|blindmathpaper|blinddocument)\b(?:\[[^\]]*\])?")


def _judge(template: str) -> str:
    """Kind of residue that a wording in lower case is, or ``""``."""
    if _signed(template) and SLOT.fullmatch(template.strip(" .,;:")):
        return "placeholder"
    return next((k for k, p in _KINDS if p.match(template)), "")


def masked(message: str) -> str:
    """The message in lower case with single spaces, digits as wildcards."""
    return _without_digits(" ".join(message.lower().split()))


def _without_digits(lower: str) -> str:
    """A text in lower case with each number, and the letters up to f around its digits, as one wildcard."""
    if not lower.isascii():
        return _DIGITS.sub(WILD, lower) if _DIGIT.search(lower) else lower
    out, end = [], 0
    for m in _NUMBER.finditer(lower):
        start, stop = m.span()
        while start > end and lower[start - 1] in "abcdef":
            start -= 1
        out += (lower[end:start], WILD)
        end = stop
    return "".join(out) + lower[end:] if out else lower


#: Stands for a word that varies.
WILD = "<*>"
#: Words from which on a leaf of the tree branches no further.
DEPTH = 4
#: Templates up to which those of a leaf are bits of a number.
MANY = 256
#: A wording that stands alone in sections of this many papers of different titles is a template, whatever it says.
REPEATED = 5


class Leaf:
    """Templates of the messages that agree in their first words and their length.

    A message joins the template that agrees with it in most words, if these are at least ``alike`` of all; words that
    differ become wildcards.  Up to ``MANY`` templates, each is a bit in the numbers that stand for the words at each place,
    and these bits are added up for all templates at once.  Beyond that, templates are looked up over groups of positions:
    with one group more than words may differ, one group agrees in full, so no message is compared with each.
    """

    def __init__(self, length: int, alike: float = 0.7):
        self.length, self.differ = length, int(length * (1 - alike) + 1e-9)
        self.templates: list[list] = []  # words, members
        self.at: list[dict[str, int]] = []
        self.by: dict[tuple, set[int]] = {}

    def _most_alike(self, words: list[str]) -> tuple[int, int]:
        """The template, the first of several, that agrees with the words in most places, and their number."""
        sums: list[int] = []  # bit k of the i-th is bit i of the number of places at which template k agrees
        for at, word in zip(self.at, words[DEPTH:], strict=True):
            bits = at.get(word, 0)
            i = 0
            while bits:
                if i == len(sums):
                    sums.append(bits)
                    break
                sums[i], bits = sums[i] ^ bits, sums[i] & bits
                i += 1
        best, most = -1, 0
        for i in range(len(sums) - 1, -1, -1):
            if best & sums[i]:
                best &= sums[i]
                most += 1 << i
        return (best & -best).bit_length() - 1, most + min(DEPTH, self.length)

    def _place(self, k: int) -> None:
        for at, word in zip(self.at, self.templates[k][0][DEPTH:], strict=True):
            at[word] = at.get(word, 0) | 1 << k

    def _groups(self, words: list[str]) -> list[tuple]:
        free, k = self.length - DEPTH, self.differ + 1
        if free < k:
            return [(0,)]
        return [(g, *words[DEPTH + g * free // k : DEPTH + (g + 1) * free // k]) for g in range(k)]

    def add(self, words: list[str], member: tuple) -> None:
        templates = self.templates
        if not templates:  # most leaves hold one message, which is looked for by none
            templates.append([words, [member]])
            return
        least = self.length - self.differ
        if self.by:
            best, most = -1, least - 1
            for k in sorted(set().union(*(self.by.get(g, ()) for g in self._groups(words)))):
                same = sum(map(eq, templates[k][0], words))
                if same > most:
                    best, most = k, same
        else:
            if not self.at:
                self.at = [{} for _ in range(self.length - DEPTH)]
                self._place(0)
            best, most = self._most_alike(words)
        if best < 0 or most < least:
            best = len(templates)
            templates.append([words, [member]])
            if self.by:
                self._enter(best)
            elif best < MANY:
                self._place(best)
            else:
                self.at = []
                for k in range(best + 1):
                    self._enter(k)
            return
        t = templates[best]
        t[1].append(member)
        if most == self.length:
            return
        if self.by:
            for g in self._groups(t[0]):
                self.by[g].discard(best)
        for i, (a, b) in enumerate(zip(t[0], words, strict=True)):
            if a != b and self.at:
                self.at[i - DEPTH][a] ^= 1 << best
        t[0] = [a if a == b else WILD for a, b in zip(t[0], words, strict=True)]
        if self.by:
            self._enter(best)
        else:
            self._place(best)

    def _enter(self, k: int) -> None:
        for g in self._groups(self.templates[k][0]):
            self.by.setdefault(g, set()).add(k)


def classify(words: list[str], members: list[tuple]) -> str:
    """Kind of a template, or ``""``: by the wording that it, or its most frequent message, begins with, or by where it stands.

    ``members`` are ``(message, own, n, alone, titles)``.  A template of three fixed words or more, half of it fixed, that
    makes up a whole section nearly wherever it occurs, in papers of ``REPEATED`` different titles, is a placeholder:
    content that stands alone is not worded alike in different papers, and copies of one paper have one title.
    """
    template = " ".join(words)
    kind = _judge(template) or (_judge(members[0][0]) if members[0][0] != template else "")
    if kind or sum(m[3] for m in members) < REPEATED:
        return kind
    fixed = [w for w in words if WILD not in w and _TEXT_WORD.search(w) and w[0] not in "\\{$"]
    if len(fixed) < 3 or 2 * len(fixed) < len(words):
        return ""
    titles = 0
    for m in members:
        titles |= m[4]
    alone, n = sum(m[3] for m in members), sum(m[2] for m in members)
    return "placeholder" if (titles & (1 << 64) - 1).bit_count() >= REPEATED and 10 * alone >= 9 * n else ""


def _filler(words: list[str]) -> bool:
    """Words in no language: none of a dozen is a function word, or the same few over and over."""
    return _repeated(words) or _strange(words)


def _repeated(words: list[str]) -> bool:
    most = max(2, len(words) // 4)
    # where the first words all differ, as nearly everywhere, the others need not be looked at
    return len(words) >= 6 and len(set(words[: most + 1])) <= most and len(set(words)) <= most


def _strange(words: list[str]) -> bool:
    n = len(words)
    # more than one known word in twenty ends the search, as soon as so many are found
    if n < 6 or next(islice(filter(_FUNCTION.__contains__, words), n // 20, None), None):
        return False
    known = sum(map(_FUNCTION.__contains__, words))
    return (n >= 9 and 20 * known <= n) or (not known and 4 * len(set(words)) <= 3 * n)


def _unfilled(text: str) -> bool:
    """A slot with hardly a word beside it."""
    return _slotted(text) and len(_TEXT_WORD.findall(SLOT.sub(" ", text))) <= 3


def _sentences(text: str) -> list[str]:
    """Sentences with single spaces: a line ends one, and so does a full stop, exclamation or question mark before a space."""
    lines = [" ".join(line.split()) for line in text.split("\n")]
    return [s for line in lines if line for s in line.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")]


def messages_of(kind: str, content: str) -> list[tuple[str, str, int, int]]:
    """``(message, own, times, words)`` of a part: its different messages, masked; what each is found to be without its wording; how often it stands there and its words in all.

    A title or a list of authors is one message.  ``own`` is placeholder for a slot with hardly a word beside it, filler
    for words in no language and for repetition, else ``""``.  Names are in no language, so only repetition counts among
    authors.  Formulas and quoted wording are masked.
    """
    dummy = _FILLER_COMMAND.findall(content) if "\\" in content else []
    text = content
    if "\\" in text or "$" in text or "`" in text:
        if dummy:
            text = _FILLER_COMMAND.sub(" ", text)
        text = _QUOTED.sub(" quoted ", text)
        if not _slotted(text):
            text = _MATH.sub(" formula ", text)
        text = _ESCAPED.sub(r"\1", text)
    if kind in ("title", "author"):
        whole = " ".join(text.split())
        bare = _MARK.sub(" ", whole)
        words = _TEXT_WORD.findall(bare.lower())
        own = "placeholder" if _unfilled(bare) else "filler" if dummy or (_filler(words) if kind == "title" else _repeated(words)) else ""
        return [(masked(whole or " ".join(dummy)), own, 1, 1)] if whole or dummy else []
    if "\\" in text:
        text = _MARK.sub(" ", text)
    lower = text.lower()
    framed, signed = _framed(lower), _SLOT_BEGINS.search(text) is not None
    if framed or signed:
        sentences = []
        for s in _sentences(text):
            if framed and len(s) < 200 and _CHROME.search(s):
                s = " ".join(_CHROME.sub(" ", s).split())
                if not any(map(str.isalnum, s)):
                    continue
            sentences.append(s)
        lows = [s.lower() for s in sentences]
    else:
        sentences = lows = _sentences(lower)
    if not lows and not dummy:
        return []
    # the steps that go through every character take all sentences at once
    joined = "\n".join(lows)
    if joined.isascii():
        worded = [x.split() for x in joined.encode().translate(_LETTERS).decode().split("\n")]
    else:
        worded = [_TEXT_WORD.findall(low) for low in lows]
    found: dict[str, list] = {}
    others: list[str] = []
    for s, message, words in zip(sentences, _without_digits(joined).split("\n"), worded, strict=False):  # no sentences still join to one
        own, n = "", len(words)
        if signed and _unfilled(s):
            own = "placeholder"
        elif 6 <= n < 12 and len({*words[:3]}) == 3:  # as most are: too short and varied for repetition, and one known word will do
            if _FUNCTION.isdisjoint(words) and _strange(words):
                own = "filler"
        elif n >= 6 and _filler(words):
            own = "filler"
        if not own:
            others += words
        size, wild = message.count(" ") + 1, message.count(WILD)
        if wild:
            size -= 1 if wild == 1 else sum(WILD in w for w in message.split(" "))
        row = found.get(message)
        if row is None:
            found[message] = [own, 1, max(1, size)]
        else:
            row[1] += 1
            row[2] += max(1, size)
    # a long text has few different words for its length, so those of all sentences together are not held to be repeated
    again = False
    if found and len(found) < 3:
        times = sum(r[1] for r in found.values())
        again = times >= 4 * len(found) and sum(len(m.split()) for m in found) <= 10 * len(found)
    if again or _strange(others):
        for row in found.values():
            row[0] = row[0] or "filler"
    return [(m, *row) for m, row in found.items()] + [(masked(command), "filler", 1, 20) for command in dummy]


_READ = "row long, doc_id long, at int, part string, message string, own string, times int, words int, all int, title long"


def read_messages(documents: DataFrame) -> DataFrame:
    """One row for every different message of every part: document, number and kind of the part, message, times, words, those of the part, and a hash of the paper's title."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: list[tuple] = []  # row, document, number, kind, words and title of every part
            sizes: list[int] = []  # its messages
            messages, owns, times, words = [], [], [], []
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                cut = parts(text)
                title = next((xxhash.xxh64_intdigest(" ".join(c.lower().split())) >> 1 for k, c in cut if k == "title"), None)
                for at, (kind, content) in enumerate(cut):
                    found = messages_of(kind, content)
                    if found:
                        m, o, t, w = zip(*found, strict=True)
                        messages += m
                        owns += o
                        times += t
                        words += w
                        of.append((row, doc, at, kind, sum(w), title))
                        sizes.append(len(found))
            row, doc, at, kind, whole, title = zip(*of, strict=True) if of else ((),) * 6
            part = pa.array(np.repeat(np.arange(len(of)), np.array(sizes, "int64")))
            repeated = lambda values, type_: pa.array(values, type_).take(part)
            yield pa.RecordBatch.from_arrays(
                [
                    repeated(row, pa.int64()), repeated(doc, pa.int64()), repeated(at, pa.int32()), repeated(kind, pa.string()), pa.array(messages, pa.string()), pa.array(owns, pa.string()),
                    pa.array(times, pa.int32()), pa.array(words, pa.int32()), repeated(whole, pa.int32()), repeated(title, pa.int64()),
                ],
                names=[c.split()[0] for c in _READ.split(", ")],
            )

    texts = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    return texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(scan, _READ)


def _key(c: str = "message") -> list[Column]:
    """96 bits that stand for a message in a join."""
    return [F.xxhash64(c).alias("k1"), F.hash(c).alias("k2")]


def judged_messages(read: DataFrame) -> DataFrame:
    """``(message, template, kind)`` for the messages whose template, or own content, is residue: the tree over all messages of ``read``.

    Equal messages are counted first, so that a hot one is one row.  A leaf of the tree is read as a whole, its frequent messages
    first and equally frequent ones in alphabetical order, so the templates depend neither on order nor on partitions.
    """

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaf = None, None

        def ended() -> list[tuple]:
            out = []
            for words, members in leaf.templates if leaf else ():
                kind = classify(words, members)
                if kind or any(m[1] for m in members):
                    template = " ".join(words)
                    out += [(m[0], template, kind or m[1]) for m in members if kind or m[1]]
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ((),) * 3)], names=["message", "template", "kind"])

        for batch in batches:
            rows = []
            for m in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("message", "own", "n", "alone", "titles")), strict=True):
                words = m[0].split(" ")
                first = words[:DEPTH]
                if leaf is None or len(words) != leaf.length or first != key:
                    rows += ended()
                    key, leaf = first, Leaf(len(words))
                leaf.add(words, m)
            yield batch_of(rows)
        yield batch_of(ended())

    alone = (F.col("words") >= 0.9 * F.col("all")) & ~F.col("part").isin("title", "author")
    paper = F.when(alone & F.col("title").isNotNull(), F.expr("shiftleft(1L, cast(pmod(title, 64) as int))"))
    counted = read.groupBy("message").agg(F.max("own").alias("own"), F.count(F.lit(1)).alias("n"), F.count_if(alone).alias("alone"), F.coalesce(F.bit_or(paper), F.lit(0)).alias("titles"))
    split = F.split("message", " ")
    placed = counted.withColumn("leaf", F.struct(F.slice(split, 1, DEPTH).alias("first"), F.size(split).alias("length")))
    sorted_ = placed.repartition(parallel(read.sparkSession), "leaf").sortWithinPartitions("leaf", F.desc("n"), "message")
    return sorted_.drop("leaf").mapInArrow(mine, "message string, template string, kind string")


def _hits(documents: DataFrame) -> DataFrame:
    """Messages that are residue, in the parts that are: row, doc_id, at, part, template, kind, times, words."""
    read = stored(read_messages(documents))
    verdicts = stored(judged_messages(read))
    keyed = verdicts.select(*_key(), "template", "kind")
    hits = read.select("row", "doc_id", "at", "part", *_key(), "times", "words", "all").join(keyed, ["k1", "k2"]).drop("k1", "k2")
    bad = F.sum("words").over(Window.partitionBy("row", "at"))  # a part's messages are one document's, hence few
    return hits.withColumn("bad", bad).where("2 * bad >= all").drop("bad", "all")


def residue_parts(documents: DataFrame) -> DataFrame:
    """``(doc_id, part, kind)`` for every part of a document that is residue; kind placeholder, filler, error or script.

    A part is residue if half of its words are messages whose template is; its kind is that of most of these words.
    Comments, disabled drafts and missing includes are no parts, and quoted wording counts as content, so texts that
    write about residue stay.  Null and empty texts have no parts.  Copies are judged each, in any order alike.
    """
    by = _hits(documents).groupBy("row", "doc_id", "at", "part", "kind").agg(F.sum("words").alias("n"))
    return by.groupBy("row", "doc_id", "at", "part").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind")).select("doc_id", "part", "kind")


def mined_templates(documents: DataFrame) -> DataFrame:
    """``(template, kind, messages)``: templates of the messages in the parts found, of any length, as the tree over all messages has them."""
    return _hits(documents).groupBy("template", "kind").agg(F.sum("times").alias("messages"))


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents none of whose parts is residue, with all their columns."""
    return documents.join(residue_parts(documents).select("doc_id").distinct(), "doc_id", "left_anti").select(*documents.columns)
