import random
import re
import sys

import pytest

from matchloom.llm import residue
from matchloom.llm.residue import _DIGITS, _SLOT_BEGINS, SLOT, Leaf, _sentences, _slotted, _without_digits, messages_of, residue_parts, without_residue


def test_reading_takes_few_steps():
    """The steps that a sentence takes, of which the time to read a corpus is made, and templates of a small leaf, which are not indexed by groups."""
    r = random.Random(7)
    words = "the network of a mesh is bounded and its operator converges where every schedule has 17 fields".split()
    text = " ".join(" ".join(r.sample(words, 10)) + "." for _ in range(400))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = messages_of("section", text)
    finally:
        sys.setprofile(None)
    assert len(found) > 390 and all(own == "" for _, own, _, _ in found)
    assert calls < 20 * 400  # 29 a sentence when each was put in lower case, searched and masked alone
    leaf = Leaf(9)
    for w in ("one two three four five", "six seven eight nine ten", "two four six eight ten"):
        leaf.add(["a", "b", "c", "d", *w.split()], (w,))
    assert len(leaf.templates) == 3 and not leaf.by


def test_quick_steps_find_the_same():
    r = random.Random(8)
    bits = [*" \n\t.!?xXeE0139afgABCF{}[]<>@_$#%(", "\u0661", "\u00e9", "\u0130", "\u2028", ". ", "..\n", "xxx (to be supplied)", "{{name}}", "[Your Name]", "(Enter title)", "%(x)s", "${y}", "__A__", "<< z >>", "[TBD]"]
    sentence = re.compile(r"(?<=[.!?])\s+(?=\S)|\n\s*\n|\n")
    for _ in range(5000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(30)))
        assert _slotted(text) == (SLOT.search(text) is not None) and (_SLOT_BEGINS.search(text) or not SLOT.search(text))
        assert _without_digits(text.lower()) == _DIGITS.sub("<*>", text.lower())
        assert [s for s in _sentences(text) if s] == [s for s in (" ".join(p.split()) for p in sentence.split(text)) if s]


@pytest.mark.parametrize("many", [1, 5, 40, 10_000])
def test_leaf_of_any_size_finds_most_alike(monkeypatch, many):
    monkeypatch.setattr(residue, "MANY", many)
    r = random.Random(9)
    for length in (5, 6, 8, 13):
        messages = [["a", "b", "c", "d", *(r.choice(["x", "y", "z", "v", "w", "<*>"]) for _ in range(length - 4))] for _ in range(300)]
        leaf, plain = Leaf(length), []
        for m in messages:
            leaf.add(m, (" ".join(m),))
            same = [sum(a == b for a, b in zip(t[0], m, strict=True)) for t in plain]
            if not plain or max(same) < length - leaf.differ:
                plain.append((list(m), [(" ".join(m),)]))
            else:
                t = plain[same.index(max(same))]
                t[0][:] = [a if a == b else "<*>" for a, b in zip(t[0], m, strict=True)]
                t[1].append((" ".join(m),))
        assert [tuple(t) for t in leaf.templates] == plain


def test_residue_of_texts_without_messages(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["", " \n", "% only a comment", r"\maketitle"])], "doc_id long, text string")
    assert residue_parts(docs).count() == 0 and without_residue(docs).count() == 4
