import random
import re
import unicodedata

from strandloom.llm import leaks, plans
from strandloom.session import table


def brute_words(text):
    text = unicodedata.normalize("NFKC", text)
    text = "".join(ch for ch in text if ord(ch) not in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
    return re.findall("[a-z0-9]+", re.sub(r"\\[A-Za-z]+", " ", text).lower())


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = brute_words(t or "")
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        w = brute_words(t or "")
        for k in range(len(w) - 11):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in leaks.leaks(d, "doc_id", "text", e, "item_id", "text").collect()}


ITEM = "Given that Penhem shifts Joruvel whenever the kernel of 12 grams is elastic, state the smallest chimeric coverage of Penhem."


def test_whole_tables_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf, "eval_items").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert {tuple(r) for r in plans.p7_found(spark, sf).collect()} == want and want


def test_other_writing(spark):
    docs = [
        (1, "x \\emph{" + ITEM.upper().replace(" ", " \\textbf ") + "}"),
        (2, ITEM.replace("smallest", "small\u00adest").replace("kernel", "\uff4bernel")),
        (3, "% " + " ".join(ITEM.split()[:12])),
        (4, " ".join(ITEM.split()[:11])),
        (5, None),
        (6, ""),
        (7, "word " * 30_000 + ITEM),
    ]
    items = [(10, ITEM), (11, ITEM + " More."), (12, "too short"), (13, None), (14, "")]
    want = brute(docs, items)
    assert {k for k, v in run(spark, docs, items).items() if v == "exact"} == want
    assert {(1, 10), (2, 11), (3, 10), (7, 10)} <= want and not any(d == 4 for d, _ in want)


def test_reparameterised_needs_consistent_slots(spark):
    """Wherever the item has a value again, the document has; a consistent run is enough, and two values may become one."""
    near = "the tank of Penhem that feeds Penhem at noon is drained by Penhem"
    change = lambda text, *new: re.sub("Penhem", lambda m, it=iter(new): next(it), text)
    docs = [
        (1, ITEM.replace("Penhem", "Zorqua").replace("Joruvel", "Basol").replace("12", "99")),
        (2, change(ITEM, "Zorqua", "Ulfe").replace("Joruvel", "Basol").replace("12", "99")),  # the first ten words and more are consistent
        (3, ITEM),
        (4, change(near, "Zorqua", "Zorqua", "Zorqua")),
        (5, change(near, "Zorqua", "Ulfe", "Mirk")),
        (6, "from 4 red and 4 blue balls in the box two are drawn"),
        (7, "from 4 red and 5 blue balls in the box two are drawn"),
    ]
    items = [(10, ITEM), (11, near), (12, "from 3 red and 5 blue balls in the box two are drawn"), (13, "from 3 red and 3 blue balls in the box two are drawn")]
    r = "reparameterised"
    assert run(spark, docs, items) == {(1, 10): r, (2, 10): r, (3, 10): "exact", (4, 11): r, (6, 12): r, (6, 13): r, (7, 12): r}


def test_values_of_several_words(spark):
    item = "A probe that holds 733 litres is filled from the vat in 9 hours at most."
    docs = [(1, item.replace("733", "1,200").replace("9 hours", "2,500 milliseconds")), (2, item.replace("733", "1 2 3 4 5 6 7").replace("9", "8"))]
    assert run(spark, docs, [(10, item)]) == {(1, 10): "reparameterised"}


STEMS = [  # a sentence; n is a name, # a number, u a unit and w an ordinary word that tells the questions of a family apart
    "A worker in n blends # u of n with # u of w w residue", "If the w of n doubles every # u while its w w stays at #, find the w", "Which w w would n need so that n never w the w of w",
    "Between # and # w w parts leave n each month, and n w the rest of w", "Suppose that # w parts of n are kept in # w w jars near the w of n", "Compute the w that n shows after # rounds of w w exchange with the w of n",
]


def _filled(rng, stem, words, names):
    """The sentence with values; ``words`` are given, so that it can be written again with other values."""
    words = iter(words)
    fill = {"n": lambda: rng.choice(names), "#": lambda: rng.choice([str(rng.randrange(10, 999)), f"{rng.randrange(1, 9)},{rng.randrange(100, 999)}"]), "u": lambda: rng.choice(["grams", "kilograms", "hours", "seconds", "litres"]), "w": lambda: next(words)}
    return " ".join(fill[t.rstrip(",")]() + ("," if t.endswith(",") else "") if t.rstrip(",") in fill else t for t in stem.split())


def test_recall_and_precision_of_planted_questions(spark):
    """Items are questions of six families; the documents have them with other values, or others of the same families."""
    rng = random.Random(11)
    spell = lambda: "".join(rng.choice(["ba", "ko", "ri", "tu", "le", "sna", "pro", "mi"]) for _ in range(4))
    ordinary = sorted({spell() for _ in range(300)})
    names, others = ([spell().capitalize() + x for _ in range(80)] for x in ("ul", "ex"))
    filler = lambda: " ".join(rng.choice(ordinary + others + ["the", "of", "and", "7", "\\alpha", "grams"]) for _ in range(rng.randrange(20, 200)))
    question = lambda: (stem := rng.choice(STEMS), tuple(rng.choice(ordinary) for _ in range(stem.split().count("w") + stem.split().count("w,"))))
    bank = [question() for _ in range(250)]
    items = [(i, [rng.choice(bank) for _ in range(rng.randrange(1, 4))]) for i in range(200)]
    text = [(i, " ".join((x := _filled(rng, *q, names))[0].upper() + x[1:] + "." for q in qs)) for i, qs in items]
    docs, want = [], set()
    for d in range(400):
        planted = [rng.choice(rng.choice(items)[1])] if d % 2 else []
        decoys = [q for q in (question() for _ in range(5)) if q not in bank]
        parts = [filler()] + [x for q in planted + decoys for x in (_filled(rng, *q, others) + ".", filler())]
        docs.append((d, " ".join(parts)))
        want |= {(d, i) for i, qs in items for q in planted if q in qs}
    got = {k for k, v in run(spark, docs, text).items() if v == "reparameterised"}
    recall, precision = len(got & want) / len(want), len(got & want) / len(got)
    print(f"recall {recall:.3f} precision {precision:.3f} pairs {len(want)}")
    assert recall >= 0.9 and precision >= 0.9


def test_ten_thousand_items_of_one_stem(spark):
    """A hot stem costs a row a window and class, whether its items tell apart by ordinary words or by values only."""
    made = []
    keep, leaks.materialize = leaks.materialize, lambda df, label: made.append((label, keep(df, label))) or made[-1][1]
    words = [f"{a}{b}" for a in ("red", "old", "dry", "hot", "low", "far", "wet", "big", "odd", "new") for b in ("ba", "ko", "ri", "tu", "le", "sna", "pro", "mi", "fe", "ga")]
    same = lambda k: f"A worker in Penhem{k} blends {k} grams of Zor{k} with 7 grams of red oak residue from the old mill"
    apart = [(20_000 + k, f"A worker in Penhem blends 4 grams of Zor with 7 grams of {words[k % 100]} {words[k // 100]} residue from a well") for k in range(10_000)]
    docs = [(d, same(f"9{d}")) for d in range(20)] + [(100, "A worker in Joru blends 5 grams of Basol with 9 grams of drysna newga residue from a well"), (101, "a worker in Joru blends 5 grams of Basol with 9 grams of salt")]
    try:
        got = run(spark, docs, [(k, same(k)) for k in range(10_000)] + apart)
    finally:
        leaks.materialize = keep
    item = next(k for k, t in apart if "drysna newga" in t)
    assert len(got) == 20 * 10_000 + 1 and got[100, item] == "reparameterised"
    assert [t.count() for label, t in made if label == "hits"][0] < 200


def test_windows_of_placeholders_only_are_keyed_by_their_words(spark):
    numbers = " ".join(map(str, range(100, 120)))
    assert run(spark, [(1, " ".join(map(str, range(300, 320)))), (2, numbers)], [(10, numbers)]) == {(2, 10): "exact"}


def test_empty_tables(spark):
    assert run(spark, [], [(1, ITEM)]) == {}
    assert run(spark, [(1, ITEM)], []) == {}


def test_random_words_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "a", "kernel", "Zor", "12", "days", "x1", "beam"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(5, 30))) for i in range(40)]
    docs = [(d, text(20) + " " + rng.choice(items)[1] + " " + text(15)) for d in range(60)]
    assert {k for k, v in run(spark, docs, items).items() if v == "exact"} == brute(docs, items)


def test_further_columns_with_clashing_names(spark):
    d = spark.createDataFrame([(1, ITEM, "x", 5, 2, "k"), (1, ITEM, "x", 5, 2, "k"), (None, ITEM, "y", None, 3, None)], "doc_id long, text string, item string, key long, pos long, id string")
    e = spark.createDataFrame([(10, ITEM, 7, "z"), (None, ITEM, None, None)], "item_id long, text string, doc_id long, passage string")
    got = leaks.leaks(d, "doc_id", "text", e, "item_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0, r["kind"]) for r in got) == [(0, 0, "exact"), (0, 10, "exact"), (1, 0, "exact"), (1, 10, "exact")]
