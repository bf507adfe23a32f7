import random

import pytest
from pyspark.sql import functions as F

from matchloom.llm.document_parts import parts
from matchloom.llm.leakage import WORD, ItemIndex, Settings, carried, leaked_items, readable
from matchloom.llm.mixing import _copies, balanced_rates, mixture, reached_shares, token_sizes
from matchloom.llm.residue import Leaf, mined_templates, residue_parts, without_residue

ITEM = "Dr. Luvilol measured 79 volts across the luminous canyon and noted that the archive cools it by a third. Suppose an amber causeway doubles the archive; how many prisms remain if 572 are coiled?"
OTHER = "Dr. Kesat measured 12 volts across the folded rudder and noted that the valve heats it by a third. Suppose a tidal sluice mirrors the anvil; how many kilns remain if 31 are woven?"
# other items of the same pattern, which make its fixed words common
SAME = [OTHER.replace("Kesat", f"K{x}sat").replace("12", str(40 + i)).replace("folded rudder", f"{x}en dial").replace("valve heats", f"{x}el hides").replace("tidal sluice mirrors the anvil", f"{x}ous gear feeds the {x}ing") for i, x in enumerate("bo du fi ga ke".split())]
PROSE = "The sparse network converges on a coarse mesh and the operator is bounded. We compare it with the field of the previous section. "


def test_search_finds_all_above(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(20))) for i in range(120)]
    index = ItemIndex(items, Settings(block=4))
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(40)]
        terms = sorted({p for p in zip(words, words[1:], strict=False) if p in index.most})
        scores = {}
        for t in terms:
            for d, s in zip(*index.postings[t][:2], strict=True):
                scores[d] = scores.get(d, 0) + s
        for threshold in (2.0, 5.0, 9.0):
            assert sorted(index.search(terms, threshold)) == sorted(d for d, s in scores.items() if s >= threshold)


def test_leaked_items(spark):
    broken = ITEM.replace("luminous", "lumi-\nnous").replace("archive cools", r"archive \emph{cools}~\cite{a}").replace("572", "571")
    macro = r"\newcommand{\zza}{measured}" + ITEM.replace("measured", r"\zza{}")
    scrambled = " ".join(random.Random(1).sample(ITEM.split(), len(ITEM.split())))
    docs = [(1, PROSE + ITEM), (2, PROSE * 50 + broken), (3, macro), (4, scrambled), (5, OTHER), (6, PROSE), (7, None), (8, ""), (9, "% " + ITEM.replace(". ", ".\n% ")), (10, PROSE * 3000 + ITEM + PROSE * 3000), (1, PROSE + ITEM)]
    items = [(1, ITEM), (2, None), (3, "word")] + [(10 + i, t) for i, t in enumerate(SAME)]
    d = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    want = [(1, 1), (1, 1), (2, 1), (3, 1), (9, 1), (10, 1)]
    assert sorted((r.doc_id, r.item_id) for r in leaked_items(d, it).collect()) == want
    assert leaked_items(d.limit(0), it).count() == 0 == leaked_items(d, it.limit(0)).count()


def test_leaks_of_copies_and_short_lists(spark):
    words = ITEM.split()
    third = " ".join(words[: len(words) // 2])
    docs = [(1, PROSE + ITEM), (2, PROSE + third + " " + PROSE), (3, PROSE), (4, PROSE * 9 + " ".join(words[:9]) + " " + PROSE * 9 + " ".join(words[12:23]) + " " + PROSE * 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for texts in ([ITEM], [ITEM, OTHER], [ITEM] * 40 + [f"item number {i} has words {i}a {i}b {i}c of its own" for i in range(60)]):
        it = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
        want = sorted((doc, i) for doc in (1, 2, 4) for i, t in enumerate(texts) if t == ITEM)
        assert sorted((r.doc_id, r.item_id) for r in leaked_items(d, it).collect() if texts[r.item_id] == ITEM) == want


def test_leaks_do_not_depend_on_parts(spark):
    """Any number of items to an index gives the same links and shares."""
    docs = [(1, PROSE + ITEM), (2, PROSE + " ".join(ITEM.split()[:16]) + " " + PROSE), (3, OTHER), (4, " ".join(r"\emph{" + w + "}" for w in ITEM.split())), (5, PROSE)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(list(enumerate([ITEM, *SAME, ITEM, None])), "item_id long, text string")
    got = [sorted((r.doc_id, r.item_id, round(r.coverage, 9)) for r in leaked_items(d, it, index_items=k).collect()) for k in (1, 2, 3, 100)]
    assert got[0] == got[1] == got[2] == got[3] and {x[:2] for x in got[0]} >= {(1, 0), (1, 6), (2, 0), (4, 0), (4, 6)}


def test_leaks_in_dressed_words(spark):
    soft = " ".join(w[:2] + "\u00ad" + w[2:] if len(w) > 3 else w for w in ITEM.split())
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in ITEM)
    dashed = " ".join(w[:1] + r"\-" + w[1:] if len(w) > 2 else w for w in ITEM.split())
    d = spark.createDataFrame([(1, PROSE + soft), (2, wide + PROSE), (3, dashed), (4, PROSE)], "doc_id long, text string")
    it = spark.createDataFrame(list(enumerate([ITEM, *SAME])), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaked_items(d, it).collect()) == [(1, 0), (2, 0), (3, 0)]


def test_carried_in_any_order():
    index = ItemIndex([(i, t) for i, t in enumerate([ITEM, *SAME])], Settings())
    words, weight, half = index.words[0], index.weight, len(index.words[0]) // 2
    assert carried(words, words[half:] + ["x"] * 30 + words[:half], weight)[0] > 0.9
    assert min(carried(words, readable(OTHER), weight)) < 0.3


BAD = [
    r"\title{[YOUR TITLE]} \begin{document} " + PROSE, r"\author{{{author_name}}} \begin{document} " + PROSE, r"\begin{abstract} lorem ipsum dolor sit amet consectetur adipiscing elit sed tempor incididunt labore \end{abstract}" + PROSE,
    r"\section{Data} Write about the data in this section. \section{End} " + PROSE, "JavaScript is turned off in your browser. Switch it on to read this article. Powered by ShelfServe", "Error 404: página no encontrada",
    r"\section{A} \lipsum[1-4]", "<html><head><title>Error</title></head><body><h1>Access denied. You do not have permission to view this.</h1></body></html>", "Zugriff verweigert. Bitte melden Sie sich an.", r"\section{X} blah blah blah blah blah blah blah",
    "Menu 503 Service Unavailable Back to search", r"\section{X} asdf sdfg jkl asdf asd qwer jkl asdf sdfg asd",
]
GOOD = [
    PROSE, r"\section{A} We write \texttt{[YOUR NAME]} for an unfilled field and count 7 kinds of such fields. " + PROSE, "% TODO: {{affiliation}} -- ask coauthors\n" + PROSE, r"\section{A} \input{sections/a} \section{B} " + PROSE,
    r"Typesetters have used ``lorem ipsum'' as filler for long; we study how readers react to it.", r"\section{A} When access is denied the agent receives reward $-3$ and the session expires.", "Menu " + PROSE + "Back to search", "Our runs took 4 hours.",
    r"\title{Towards smooth schedule: Dalos metric} \author{F. L. Nezon} \begin{document} $$x = \frac{a}{b}$$ " + PROSE, PROSE * 5000,
]


def test_residue(spark):
    rows = [(i, t, "a", "b") for i, t in enumerate(BAD)] + [(100 + i, t, "a", "b") for i, t in enumerate(GOOD)] + [(200, None, "a", "b"), (201, "", "a", "b"), (0, BAD[0], "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, kind string")
    assert {r.doc_id for r in residue_parts(docs).collect()} == set(range(len(BAD)))
    assert without_residue(docs).columns == docs.columns and {r.doc_id for r in without_residue(docs).collect()} == {100 + i for i in range(len(GOOD))} | {200, 201}
    assert residue_parts(docs.limit(0)).count() == 0 and mined_templates(docs).count() > 3


def test_residue_beyond_first_words(spark):
    bad = [
        "This viewer requires JavaScript.", "This archive requires JavaScript.", "Service is temporarily unavailable.", "Full text is not available.", "Page is currently unavailable.", "A sample sentence goes here.",
        r"\section{A} " + "Content to follow. " * 4, r"\section{A} " + "Sample sentence goes here. " * 30,
    ]
    docs = spark.createDataFrame(list(enumerate([*bad, PROSE * 200, PROSE])), "doc_id long, text string")
    assert {r.doc_id for r in residue_parts(docs).collect()} == set(range(len(bad)))


def test_residue_in_fields_of_any_length(spark):
    slots = r" \and ".join(["[Your Name]"] * 40)
    bad = [r"\title{Lorem ipsum dolor sit amet}", r"\author{[Your Name] \and [Your Name]}", r"\author{{{first}} {{last}}}", rf"\author{{{slots}}}", r"\title{" + "asdf jkl " * 30 + "}", r"\title{Insert the title here " + "and more of it " * 12 + "}"]
    good = [r"\author{F. L. Nezon \and G. Bodi \and H. Kesat \and I. Luvil \and J. Domar \and K. Tiros \and L. Wemak}", r"\title{On the convergence of a sparse network to the coarse mesh of an operator that is bounded in the field of the previous section, and on what follows for the smooth schedule of it}"]
    docs = spark.createDataFrame([(i, t + r" \begin{document} " + PROSE) for i, t in enumerate([*bad, *good])], "doc_id long, text string")
    assert {r.doc_id for r in residue_parts(docs).collect()} == set(range(len(bad)))


def test_templates_of_long_parts(spark):
    docs = [(i, r"\section{A} " + "Sample sentence goes here. " * 30) for i in range(3)] + [(3, r"\section{A} Sample sentence goes here."), (4, "Error 404: page not found"), (5, "Error 503: page not found"), (6, PROSE)]
    want = [("error <*>: page not found", "error", 2), ("sample sentence goes here.", "placeholder", 91)]
    for cut in (1, 5):
        assert sorted(map(tuple, mined_templates(spark.createDataFrame(docs, "doc_id long, text string").repartition(cut)).collect())) == want


def test_repeated_wordings(spark):
    """What stands alone in sections of papers of different titles is a template, also where it varies; copies of one paper show nothing."""
    themes = "one two three four five six seven".split()
    paper = lambda title, section: rf"\title{{{title} of a sparse network}} \begin{{document}} {PROSE} \section{{A}} {section} \section{{B}} {PROSE} {title}"
    docs = [(i, paper(t, f"Kindly let the coordinator know how the {t} was done.")) for i, t in enumerate(themes)]
    docs += [(20 + i, paper("same", "The sparse network converges on the mesh of its operator.")) for i in range(9)]
    docs += [(40 + i, paper(t, f"The {t} network converges on the coarse mesh of its operator. {PROSE}")) for i, t in enumerate(themes)]
    docs += [(60, "Access denied to all of our users in here. You do not have permission."), (61, PROSE + "Access granted to some of our users in here. Access granted to none of our users in here.")]
    got = []
    for cut, seed in ((1, 1), (3, 2), (7, 3)):
        df = spark.createDataFrame(random.Random(seed).sample(docs, len(docs)), "doc_id long, text string").repartition(cut)
        got.append((sorted({r.doc_id for r in residue_parts(df).collect()}), sorted(map(tuple, mined_templates(df).collect()))))
    assert got[0] == got[1] == got[2] and got[0][0] == [*range(7), 60]
    assert ("kindly let the coordinator know how the <*> was done.", "placeholder", 7) in got[0][1]


def test_leaf_finds_most_alike():
    r = random.Random(6)
    messages = [["a", "b", "c", "d", *(r.choice("xyz") for _ in range(9))] for _ in range(300)]
    leaf, plain = Leaf(13), []
    for m in messages:
        leaf.add(m, (" ".join(m),))
        best, most = None, -1
        for t in plain:
            same = sum(a == b for a, b in zip(t, m, strict=True))
            if same > most:
                best, most = t, same
        if best is None or most < 13 - leaf.differ:
            plain.append(list(m))
        else:
            best[:] = [a if a == b else "<*>" for a, b in zip(best, m, strict=True)]
    assert [t[0] for t in leaf.templates] == plain and sum(len(t[1]) for t in leaf.templates) == 300


def test_parts():
    text = "\\title{A {B}}\\author{C}\\begin{document}\\begin{abstract}D\\end{abstract} E % no\n\\section{F} G \\iffalse H \\fi\\begin{thebibliography}{1}I\\end{thebibliography}"
    assert [(k, c.strip()) for k, c in parts(text)] == [("title", "A {B}"), ("author", "C"), ("abstract", "D"), ("body", "E"), ("section", "G")]


def test_mixture(spark):
    r = random.Random(1)
    sizes = spark.createDataFrame([(i, "abcd"[i % 4], r.randrange(0, 400)) for i in range(4000)] + [(9000, None, 10), (9001, "z", None)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2, 1), ("b", 0.3, 3, 1), ("c", 0.15, 1, 1), ("gone", 0.05, 4, 1)], "source string, target_share double, max_repeats int, copies int")
    _, state = balanced_rates(sizes, targets)
    assert all(s["done"] for s in state.values())
    used = _copies(sizes, targets)
    assert used.groupBy("source").agg(F.max("copies").alias("m")).collect() and all(x.m <= {"a": 2, "b": 3, "c": 1}[x.source] for x in used.groupBy("source").agg(F.max("copies").alias("m")).collect())
    got = {x.source: x.n for x in used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()}
    total = sum(got.values())
    assert {k: v / total for k, v in got.items()} == pytest.approx({"a": 0.5 / 0.95, "b": 0.3 / 0.95, "c": 0.15 / 0.95}, abs=0.01)
    assert _copies(sizes.limit(0), targets).count() == 0


def test_unfinished_balance_is_an_error(spark):
    sizes = spark.createDataFrame([(i, "ab"[i % 2], 1 + i * i % 97) for i in range(500)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 2)], "source string, target_share double, max_repeats int")
    with pytest.raises(RuntimeError, match="no balance after 2 rounds"):
        balanced_rates(sizes, targets, rounds=2)


def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, "a", "hello world", 5), (2, None, None, 5), (3, "a", "", 5), (4, "a", "x " * 20000, 5), (4, "a", "<|endoftext|>", 5)], "doc_id long, source string, text string, tokens int")
    got = [(r.doc_id, r.tokens) for r in token_sizes(docs).orderBy("doc_id", "tokens").collect()]
    assert got[:3] == [(1, 2), (2, 0), (3, 0)] and got[3][1] > 1 and got[4][1] >= 20000
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 0.0, 1)], "source string, target_share double, max_repeats int")
    assert mixture(docs, targets).count() == 3
    shares = {r.source: (r.share, r.most_copies) for r in reached_shares(docs, targets).collect()}
    assert shares == {"a": (1.0, 1), "b": (0.0, 0)}
