"""Leaks found as they stand, re-cased and with other values; look-alikes and clean texts left alone."""

import random

import pytest
import regex

from lineforge.llm import decontamination as D

ITEMS = [
    (1, "A train leaves the old station at 60 km per hour while Alice walks home and Alice meets Bob after 3 hours, how far did it go?"),
    (2, "Which of these rivers flows into the northern sea after passing through the three largest lakes of the region?"),
    (3, "Too short"),
    (4, None),
]


def frames(spark, docs):
    return (spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'h' AS hash"),
            spark.createDataFrame(ITEMS, "item_id long, text string"))


def found(spark, docs):
    a, b = frames(spark, docs)
    return {(r.doc_id, r.item_id): r for r in D.leaks(a, b).collect()}


def test_planted_cases(spark):
    lead = "some words before it. "
    docs = [
        (10, lead + ITEMS[0][1] + " and after"),
        (11, lead + ITEMS[0][1].replace("60", "75").replace("3", "12").replace("Alice", "Carol").replace("Bob", "Dan").replace("km", "miles")),
        (12, lead + ITEMS[0][1].replace("Alice walks", "Carol walks").replace("Alice meets", "Eve meets")),
        (13, (lead + ITEMS[1][1]).upper()),
        (14, lead + ITEMS[1][1].replace(" ", "\n ").replace("?", " !!")),
        (15, "Which of these rivers is long? " + lead),
        (16, None), (17, ""), (18, "a"), (19, "Too short"), (10, "other text"), (None, ITEMS[1][1]),
        (20, "x " * 20000 + ITEMS[1][1] + " y" * 20000),
    ]
    got = found(spark, docs)
    assert set(got) == {(10, 1), (11, 1), (12, 1), (13, 2), (14, 2), (19, 3), (None, 2), (20, 2)}
    assert got[11, 1].reparameterised and not got[10, 1].reparameterised and got[10, 1].n_slots >= 4
    assert got[12, 1].share < got[11, 1].share == 1  # one name stands for two: its windows are lost, the others remain


def test_clean_documents(spark):
    docs = [(1, ITEMS[1][1]), (1, "clean one"), (2, "clean"), (None, ITEMS[1][1]), (None, None), (3, ""), (2, "clean")]
    a, b = frames(spark, docs)
    out = D.clean_documents(a, b)
    assert out.columns == a.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted([("1", "clean one"), ("2", "clean"), ("2", "clean"), ("None", "None"), ("3", "")])
    assert D.leaks(a.limit(0), b).count() == 0 == D.leaks(a, b.limit(0)).count()
    assert D.clean_documents(a, b.limit(0)).count() == len(docs)


def canon(text):
    """(template, word) of every word."""
    text = regex.sub(r"[\p{Z}\s]+", " ", text or "")
    text = regex.sub(r"(?<=[\p{Ll}\p{Nd},;] )(?=\p{Lu}\p{Ll})", "\x01", text)
    text = regex.sub(r"(?<=\p{Nd})[.,](?=\p{Nd})", "\x03", text)
    text = regex.sub(r"\p{Nd}[\p{Nd}\x03]*", lambda m: f" \x02{m[0]} ", text).lower()
    words = [w for w in regex.sub(r"[^\p{L}\p{Nd}\x01\x02\x03 ]+", " ", text).split(" ") if w not in ("", "\x01")]
    return [("<num>" if w[0] == "\x02" else "<name>" if w[0] == "\x01" else "<unit>" if w in D.UNITS and i and words[i - 1][0] == "\x02" else w,
             w.translate({1: None, 2: None})) for i, w in enumerate(words)]


def reach(by_shift, n, share):
    places = set().union(*by_shift) if by_shift else set()
    run = any(all(p + k in s for k in range(D.MIN_RUN - 4)) for s in by_shift for p in s)
    return len(places) if n and places and (len(places) / n >= share or run) else 0


def consistent(item, doc, spots):
    """The places (item, document) of a shift without those of torn slots."""
    fills = {(k + o, item[k + o], doc[j + o][1]) for k, j in spots for o in range(5) if item[k + o][0] != item[k + o][1]}
    torn = set()
    for at, (kind, value), filling in fills:
        own = [f for f in fills if f[1] == (kind, value)]
        tops = {f[2] for f in own if 2 * sum(g[2] == f[2] for g in own) > len(own)}
        if (kind == "<num>" and tops and filling not in tops) or (kind != "<num>" and not tops):
            torn.add(at)
    return {k for k, _ in spots if not any(k + o in torn and item[k + o][0] != item[k + o][1] for o in range(5))}


def brute(docs, items, share=0.5):
    """(doc, item): (matched, windows) by comparing every window of every document with every item's."""
    out = {}
    for d, text in docs:
        doc = canon(text)
        for i, question in items:
            item = canon(question)
            if 0 < len(item) < 5:
                words, own = [w for _, w in item], [w for _, w in doc]
                at = [k for k in range(len(own) - len(words) + 1) if own[k:k + len(words)] == words]
                if at and (len(words) >= 3 or len(own) == len(words)):
                    out[d, i] = (1, 1)
                continue
            found = []
            for side in (0, 1):
                usable = [k for k in range(len(item) - 4) if side or sum(t == w for t, w in item[k:k + 5]) >= 3]
                shifts = {}
                for k in usable:
                    for j in range(len(doc) - 4):
                        if [x[side] for x in doc[j:j + 5]] == [x[side] for x in item[k:k + 5]]:
                            shifts.setdefault(j - k, set()).add((k, j))
                kept = [consistent(item, doc, s) if side == 0 else {k for k, _ in s} for s in shifts.values()]
                n = reach(kept, len(usable), share)
                if n:
                    found.append((n / len(usable), n, len(usable)))
            if found:
                out[d, i] = max(found)[1:]
    return out


def made(seed, n_docs=70):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "Delta", "Eps", "Zeta,", "12", "7.5", "3", "km", "of", "the", "is.", "and"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 3, 4, 7, 12, 20, 30])))) for i in range(16)]
    docs = []
    for d in range(n_docs):
        body = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.8:
            swap = {w: rng.choice(words) for w in rng.sample(words, 3)} if rng.random() < 0.5 else {}
            own = [swap.get(w, w) if rng.random() < 0.97 else rng.choice(words) for w in rng.choice(items)[1].split()]
            body += own[rng.randint(0, len(own) // 2):] if rng.random() < 0.3 else own
        docs.append((d, rng.choice([" ", "\n", "  "]).join(body + [rng.choice(words) for _ in range(rng.randint(0, 3))])))
    return docs + [(900, items[0][1]), (901, items[1][1].upper())], items


@pytest.mark.parametrize("seed,common", [(6, 64), (7, 64), (8, 1), (9, 0)])
def test_leaks_against_brute_force(spark, monkeypatch, seed, common):
    monkeypatch.setattr(D, "COMMON", common)
    docs, items = made(seed)
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows) for r in D.leaks(a, b).collect()}
    want = brute(docs, items)
    assert got == want and len(got) > 20


def test_common_windows_make_no_rows(spark, monkeypatch):
    """Thousands of questions begin alike; a document with that beginning is proposed for none of them."""
    monkeypatch.setattr(D, "COMMON", 5)
    begin = "what is the value of the sum of all"
    own = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{c}" for c in "abcdefghijklmnopqr")
    items = spark.createDataFrame([(i, f"{begin} {own(i)}") for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {begin} things"), (2, f"{begin} {own(7)}"), (3, own(8))], "doc_id long, text string")
    windows, lengths = D.benchmark_windows(items, D.WINDOW, D.MIN_SHARE)
    rows = docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "text")
    assert {(r.doc_id, r.item_id) for r in D.proposals(rows, windows, D.WINDOW, lengths).collect()} == {(2, 7), (3, 8)}
    assert {(r.doc_id, r.item_id): r.n_matched for r in D.leaks(docs, items).collect()} == {(2, 7): 23, (3, 8): 14}
    same = spark.createDataFrame([(i, begin) for i in range(50)], "item_id long, text string")   # nothing but common windows
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, same).collect()} == {(d, i) for d in (1, 2) for i in range(50)}


GERMAN = ("Welche der folgenden Aussagen über den Hafen von Hamburg und die alte Stadt Bremen ist richtig, wenn Kapitän Hansen im Winter "
          "nach Norden fährt?")


def leaked(spark, docs, items):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in D.leaks(a, b).collect()}


def test_case_and_line_breaks_hide_no_copy(spark):
    items = [(1, GERMAN), (2, "Calculate 3 + 4 + 5 + 6"), (3, "Too short"), (4, "Name three rivers"), (5, None), (6, "?!")]
    docs = [(1, GERMAN.lower()), (2, "so\n" + GERMAN.replace(" ", "\n")), (3, GERMAN.replace(" ", "  ").upper()), (4, "please calculate 3 + 4 + 5 + 6 now"),
            (5, "far too short to tell"), (6, "too  SHORT."), (7, "now name\nthree rivers, please"), (8, "three rivers"), (9, None), (10, "")]
    assert leaked(spark, docs, items) == {(1, 1), (2, 1), (3, 1), (4, 2), (6, 3), (7, 4)}
    assert D.clean_documents(*(spark.createDataFrame(x, f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id")))).count() == 4


def test_decimals_and_signs_are_one_number(spark):
    item = "A tank holds 12.5 liters and drains 0.75 liters each -3.5 minutes until 2,000.25 liters of water are gone"
    docs = [(1, item), (2, item.replace("12.5", "30").replace("0.75", "1.125").replace("-3.5", "8").replace("2,000.25", "17")),
            (3, item.replace("12.5", "8.25").replace("liters", "gallons").replace(" ", "\n"))]
    assert leaked(spark, docs, [(1, item)]) == {(1, 1), (2, 1), (3, 1)}


def test_a_torn_slot_costs_its_own_windows(spark):
    long = ("Early in the morning the old baker gives Alice a basket of bread for the market and asks whether the road along the river is open, "
            "because last week the bridge was closed and then Alice had to walk around the hill with all of the bread on a small cart until noon came")
    boxes = "A shop packs 2 boxes of red apples on the first shelf and 2 crates of green pears below it, how many pieces are there?"
    marked = "Every week the clerk meets Alice near the gate, then Alice reads, and Alice sleeps, and after that Bob walks with Bob to town"
    docs = [(1, long[::-1].replace("ecilA", "loraC", 1)[::-1]), (2, boxes.replace("2 boxes", "3 boxes").replace("2 crates", "5 crates")),
            (3, marked.replace("Alice", "Carol").replace("with Bob", "with Dan"))]
    assert docs[0][1].count("Alice") == 1 == docs[0][1].count("Carol") and len(long.split()) > 50
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, long), (2, boxes), (3, marked)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(D.matches(a, b)).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3)}
    assert got[2, 2].share == 1 and got[2, 2].reparameterised and got[1, 1].share < 1
    assert leaked(spark, docs, [(1, long), (2, boxes), (3, marked)]) == set(got)


def test_a_long_run_counts_whatever_its_share(spark):
    item = " ".join(f"word{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(59))
    run = lambda n: "lead " + " ".join(item.split()[20:20 + n]) + " end"
    assert leaked(spark, [(1, run(25)), (2, run(13)), (3, run(12)), (4, f"{run(8)} {run(9)}")], [(1, item)]) == {(1, 1), (2, 1)}
