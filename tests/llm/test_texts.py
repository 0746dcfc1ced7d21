"""Packing, leakage and repetition on small cases and against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeglean.llm import leakage, packing, repetition
from lakeglean.llm.words import canonical_words

DOC = "doc_id long, text string, part string, container int"


# -- packing --------------------------------------------------------------------
@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(1, 60))
def test_closest_is_optimal(lengths, room):
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums}
    got = packing.closest(Counter(lengths), room)
    assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)
    assert all(n <= Counter(lengths)[k] for k, n in got.items())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 40))
def test_packer_keeps_every_item(lengths, window):
    p = packing.Packer(50, window)
    bins = [b for i, n in enumerate(lengths) for b in p.add(n, (i, n))] + list(p.flush())
    assert sorted(x for b in bins for x in b) == list(enumerate(lengths))
    assert all(sum(n for _, n in b) <= 50 for b in bins)


def test_packing_leaves_little_room():
    rnd, p, n = random.Random(1), packing.Packer(2048), 0
    lengths = [min(2048, int(rnd.lognormvariate(5.5, 0.8)) + 1) for _ in range(20000)]
    bins = [b for x in lengths for b in p.add(x, x)]
    n = len(bins)
    assert sum(map(sum, bins)) / (n * 2048) > 0.999
    with pytest.raises(ValueError):
        list(p.add(4000, 1))


def test_pack_documents(spark, rows):
    long = "Über café 12 " * 900
    docs = [(1, "short text"), (2, None), (3, ""), (4, long), (4, long), (5, "a" * 20000), (None, "nameless"), (6, "<|endoftext|> \x00 ok")]
    out = packing.pack(rows(DOC, [(*d, "clash", 1) for d in docs]), capacity=256).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    for r in by[2] + by[3]:
        assert (r.n_tokens, r.n_pieces, r.container) == (0, 1, None)
    used = Counter()
    for r in out:
        if r.container:
            used[r.container] += r.n_tokens
    assert max(used.values()) <= 256 and len(by[None]) == 1
    for doc, text in ((4, long), (5, "a" * 20000)):
        pieces = sorted(by[doc][: by[doc][0].n_pieces], key=lambda r: r.piece)
        assert len(by[doc]) == (2 if doc == 4 else 1) * pieces[0].n_pieces and pieces[0].n_pieces > 1
        if doc == 5:
            raw = text.encode()
            assert b"".join(raw[r.first_byte:r.first_byte + r.n_bytes] for r in pieces) == raw and all(r.n_tokens == 256 for r in pieces[:-1])
    assert by[1][0].n_bytes == 10
    f = packing.fill(packing.pack(rows(DOC, [(*d, "clash", 1) for d in docs]), capacity=256), 256)
    assert f.filter("slack < 0").count() == 0
    assert packing.pack(rows(DOC)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(rows(DOC), capacity=0)


# -- words ----------------------------------------------------------------------
@pytest.mark.parametrize("text", [
    "The <b>café</b> opened&#44; GROßE Türen", "the cafÃ© opened, groÃ\u009fe tÃ¼ren", "the ca­fé ope​ned große türen", 'the\\ncaf\\u00e9 opened "große" türen',
    "THE CAFÉ OPENED -- GROSSE TÜREN!", "the\r\ncaf&eacute;\topened_große türen", "the café <!-- x --> opened große<br/>türen"])
def test_canonical_words(text):
    assert canonical_words(text) == ["the", "café", "opened", "grosse", "türen"]


# -- leakage --------------------------------------------------------------------
VOCABULARY = "ledger canary footer gable shard tuple orphan budget window snapshot lease query crate tower ridge moor epoch gauge".split()
LEAK_DOC, ITEM = "doc_id long, text string, item_id string", "item_id long, suite string, text string"


def sentence(rnd, n):
    return [rnd.choice(VOCABULARY) + rnd.choice(("", "s", "er")) for _ in range(n)]


def found(spark, rows, docs, items, **kw):
    out = leakage.leaks(rows(LEAK_DOC, [(*d, "clash") for d in docs]), rows(ITEM, [(i, "s", t) for i, t in items]), **kw)
    return {(r.doc_id, r.item_id): r for r in out.collect()}


def test_leak_kinds(spark, rows):
    rnd = random.Random(2)
    p = sentence(rnd, 40)
    item = "Answer the question.\n" + " ".join(p) + ".\nWhy?"
    numbered = "the gauge on tower17 read 40 mb when 17 crates and 40 mb of ledger moved to tower17 past the moor at ridge of the epoch"
    edited = p[5:35].copy()
    edited[7], edited[20] = "other", "changed"
    docs = [
        (1, "noise " + " ".join(p[3:26]).upper() + " noise"), (2, " ".join(p[:12])), (3, " ".join(edited)), (4, "Answer the question. Why?"), (5, None), (6, ""),
        (7, numbered.replace("40", "95").replace("17", "8")), (8, numbered.replace("40", "95", 1)), (9, "<p>" + ", ".join(p) + "</p>"), (9, "<p>" + ", ".join(p) + "</p>"), (10, ("filler words here " * 3000) + " ".join(p[10:32])), (None, " ".join(p)),
    ]
    got = found(spark, rows, docs, [(100, item), (101, numbered), (102, None), (103, "too short"), (100, item)])
    kinds = {k: r.kind for k, r in got.items()}
    assert kinds == {(1, 100): "verbatim", (3, 100): "edited", (7, 101): "reparameterised", (8, 101): "verbatim", (9, 100): "verbatim", (10, 100): "verbatim", (None, 100): "verbatim"}
    assert got[(7, 101)].n_slots >= 3 and got[(9, 100)].n_words == 40
    assert found(spark, rows, docs, [(100, item), (101, numbered)], block_chars=10).keys() == got.keys()
    assert found(spark, rows, [], [(100, item)]) == {} and found(spark, rows, docs, []) == {}


def brute(p, doc, least=20, every=8):
    """Whether some span of at least ``least`` words of p lies in doc with at most one edit in ``every``."""
    for s in range(len(p) - least + 1):
        prev = [0] * (len(doc) + 1)
        for n in range(1, len(p) - s + 1):
            cur = [n]
            for j, w in enumerate(doc, 1):
                cur.append(min(prev[j - 1] + (w != p[s + n - 1]), prev[j] + 1, cur[-1] + 1))
            prev = cur
            if n >= least and min(cur) * every <= n:
                return True
    return False


def test_names_and_units_are_found():
    names, units = leakage.names_and_units(["The keeper met Halvard near Ostrava. Halvard paid 30 florins and 45 florins.", "An order of 3 crates.", "The crates: Keeper Ostrava, 7 crates", "Der Hund Und Die Katze Im Haus"])
    assert names == {"halvard", "ostrava"} and units == {"florins", "crates"}
    assert leakage.names_and_units([]) == (frozenset(), frozenset())


def test_planted_reparameterised_leaks(spark, rows):
    """Other names, numbers and units throughout, changed consistently: found; inconsistently: not."""
    rnd = random.Random(21)
    items, docs, want = [], [], set()
    for i in range(40):
        filler = sentence(rnd, 30)
        for k, w in zip(range(2, 30, 4), ("Halvard", "40 florins", "Ostrava", "Halvard", "17 florins", "Ostrava", "40 florins")):
            filler[k] = w
        text = " ".join(filler)
        items.append((i, f"Read and answer.\n{text}."))
        other = text.replace("Halvard", f"Miro{'vw'[i % 2]}").replace("Ostrava", "Tallinn").replace("40", str(100 + i)).replace("17", str(200 + i))
        docs.append((i, f"before it {other} after it"))
        docs.append((100 + i, other.replace("Tallinn", "Riga", 1).replace(str(100 + i), "5", 1)))
        want.add((i, i))
    got = found(spark, rows, docs, items)
    assert {k for k, r in got.items() if r.kind == "reparameterised"} == want and set(got) == want


def test_leaks_against_brute_force():
    rnd = random.Random(4)
    items = [(i, " ".join(sentence(rnd, rnd.randrange(22, 60)))) for i in range(6)]
    index, wrong, hits = leakage.Index(items, 5, frozenset(), 20, 8), [], 0
    for d in range(120):
        i, text = rnd.choice(items)
        words = text.split()
        a = rnd.randrange(max(1, len(words) - 24))
        part = words[a:a + rnd.randrange(8, 40)]
        for _ in range(rnd.randrange(0, 6)):
            k = rnd.randrange(len(part))
            part[k:k + rnd.choice((0, 1, 1))] = rnd.choice(([], ["odd"], ["odd"]))
            part = part or ["odd"]
        doc = sentence(rnd, 15) + part + sentence(rnd, 15)
        got = {r[1] for r in index.search([(d, " ".join(doc))]) if r[2] != "reparameterised"}
        want = {j for j, t in items if brute(t.split(), doc)}
        hits += len(want)
        wrong += [(d, got ^ want)] if got != want else []
    assert hits > 30 and len(wrong) <= 3  # the greedy alignment may differ at the very limit


def searched(item, doc, **kw):
    """What the search says of one document and one passage of words."""
    index = leakage.Index([(1, " ".join(item))], **({"width": 5, "names": frozenset(), "least": 20, "every": 8} | kw))
    return [r[2:] for r in index.search([(7, " ".join(doc))])]


def test_leaks_with_out_of_order_quotes():
    p = [f"w{k // 26}{chr(97 + k % 26)}" for k in range(60)]
    p = [w.translate(str.maketrans("0123456789", "qxyzvwkjpu")) for w in p]  # no names or numbers
    run = p[:24]
    for k in (3, 10, 17):
        run[k] = "changed"
    assert searched(p, p[40:52] + ["four", "other", "words", "here"] + run) == [("edited", 24, 3, 0)]
    rnd = random.Random(8)
    hits = 0
    for _ in range(150):
        item, doc = sentence(rnd, rnd.randrange(30, 70)), sentence(rnd, 6)
        for _ in range(3):
            a = rnd.randrange(len(item) - 8)
            part = item[a:a + rnd.choice((10, 14, 19, 24, 30))]
            for _ in range(rnd.randrange(0, 5)):
                k = rnd.randrange(len(part))
                part[k:k + rnd.choice((0, 1, 1))] = rnd.choice(([], ["odd"], ["odd"]))
            doc += part + sentence(rnd, rnd.randrange(0, 6))
        got = [r for r in searched(item, doc) if r[0] != "reparameterised"]
        hits += len(got)
        assert bool(got) == brute(item, doc)
    assert 20 < hits < 150


def test_a_changed_number_is_one_edit():
    p = sentence(random.Random(10), 20)
    p[9:11] = ["5", "seconds"]
    doc = p.copy()
    doc[9], doc[3] = "five", "other"
    assert searched(p, doc) == [("edited", 20, 2, 0)]
    p = sentence(random.Random(11), 24)
    p[9:11] = ["5", "seconds"]
    for number in (["five"], ["of"], [], ["5", "or"]):  # with two other edits only five windows are left
        doc = p.copy()
        doc[4], doc[15] = "other", "changed"
        doc[9:10] = number
        assert brute(p, doc) and searched(p, doc) == [("edited", 24, 3, 0)]


def test_the_longest_leak_of_a_document_is_told():
    rnd = random.Random(12)
    p = sentence(rnd, 60)
    short = p[10:30]
    short[5] = "other"
    assert searched(p, short + sentence(rnd, 200) + p) == [("verbatim", 60, 0, 0)]
    assert searched(p, p + sentence(rnd, 200) + short) == [("verbatim", 60, 0, 0)]


def test_windows_follow_from_least_and_every(spark, rows):
    p = sentence(random.Random(13), 20)
    doc = ["changed" if k % 5 == 4 else w for k, w in enumerate(p)]
    got = found(spark, rows, [(1, " ".join(doc))], [(7, " ".join(p))], every=5)
    assert {k: (r.kind, r.n_words, r.n_edits) for k, r in got.items()} == {(1, 7): ("edited", 20, 4)}
    assert leakage.window_width(20, 8) == 5 and leakage.unchanged_windows(5, 20, 8) == 5
    for bad in ({"every": 5, "width": 5}, {"every": 1}, {"every": 0}, {"least": 0}, {"width": 0}):
        with pytest.raises(ValueError):
            found(spark, rows, [], [], **bad)


def test_alignment_steps():
    rnd = random.Random(9)
    for _ in range(60):
        a, b = sentence(rnd, 30), sentence(rnd, 8)
        part = a[3:28]
        for _ in range(2):
            k = rnd.randrange(len(part))
            part[k:k + rnd.choice((0, 1, 1))] = rnd.choice(([], ["odd"]))
        b += part
        words, edits, steps = leakage.align(a, b, -len(a), len(b), 20, 8, path=True)
        assert sum(i >= 0 for i, _, _ in steps) == words and sum(c for _, _, c in steps) == edits <= words / 8
        assert all(a[i] == b[j] for i, j, c in steps if not c)
        places, ends = [i for i, _, _ in steps if i >= 0], [j for _, j, _ in steps if j >= 0]
        assert places == list(range(places[0], places[0] + words)) and ends == list(range(ends[0], ends[0] + len(ends)))


def test_best_run_is_the_longest():
    rnd = random.Random(6)
    for _ in range(200):
        steps = [(i if rnd.random() < 0.95 else -1, i, int(rnd.random() < 0.2)) for i in range(rnd.randrange(1, 60))]
        got = leakage.best_run(steps, 5, 8)
        best = 0
        for a in range(len(steps)):
            n = e = 0
            for i, _, c in steps[a:]:
                n, e = n + (i >= 0), e + c
                if n >= 5 and e * 8 <= n:
                    best = max(best, n)
        assert (got[2] if got else 0) == best


# -- repetition -----------------------------------------------------------------
def share(text, run=5):
    w = canonical_words(text)
    seen, cover = set(), set()
    for i in range(len(w) - run + 1):
        g = tuple(w[i:i + run])
        if g in seen:
            cover |= set(range(i, i + run))
        seen.add(g)
    return len(w), len(cover)


def test_repetition_against_brute_force(spark, rows):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("a b c d".split()) for _ in range(rnd.randrange(0, 60))) for _ in range(60)] + [None, "", "x " * 3000, "One two, three four five.\r\nONE TWO THREE\nfour -- five!", "!!! ..."]
    docs = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(None, "a b c d e a b c d e", "", 0)] * 2
    out = repetition.clean_lines(rows(DOC, docs), rules=("repetition",)).collect()
    assert len(out) == len(docs)
    for r in out:
        text = "a b c d e a b c d e" if r.doc_id is None else texts[r.doc_id]
        n, k = share(text or "")
        assert (r.n_words, r.n_repeated) == (n, k) and r.rejected == (n > 0 and k / n >= 0.3) and r.repeated_share == (k / n if n else 0)
    assert repetition.clean_lines(rows(DOC)).count() == 0


def test_line_rules(spark, rows):
    text = "A full sentence stands here.\nHome | News | About | Contact\nno end mark on this line\nAll rights reserved by us.\n\nShort"
    others = [(i, "x\n  All rights reserved by us.\t\nAll rights reserved by us.", "", 0) for i in (2, 3)]
    r = repetition.clean_lines(rows(DOC, [(1, text, "", 0), *others]), shared_docs=3).filter("doc_id = 1").first()
    assert (r.n_lines, r.n_punctuation, r.n_navigation, r.n_boilerplate) == (6, 2, 1, 1) and r.n_lost == 15 and r.rejected and r.rejected_for == ["punctuation"]
    assert repetition.clean_lines(rows(DOC, [(1, text, "", 0), *others]), shared_docs=4).agg({"n_boilerplate": "max"}).first()[0] == 0
    assert not repetition.clean_lines(rows(DOC, [(1, text, "", 0)]), rules=("boilerplate",)).first().rejected
    for bad in ({"rules": ("nope",)}, {"run": 0}, {"reject": 0}, {"shared_docs": 1}):
        with pytest.raises(ValueError):
            repetition.clean_lines(rows(DOC), **bad)


def test_kept_text(spark, rows):
    text = "A full sentence stands here.\r\nHome | News | About | Contact\nAll rights reserved by us.\n\nShort, then: a Full sentence stands HERE. Groß end."
    texts = [text, None, "", "x y z v w x y z v w.", "Straße İx one two three.\nstraße İx one two three four."]
    docs = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(9, "All rights reserved by us.", "", 0)]
    got = {r.doc_id: r for r in repetition.clean_lines(rows(DOC, docs), keep=True, shared_docs=2).collect()}
    assert [got[i].kept_text for i in range(5)] == ["A full sentence stands here.\r\n\nShort, then: Groß end.", None, "", "x y z v w ", "Straße İx one two three.\nfour."]
    rnd = random.Random(14)
    docs = [(i, "\n".join(" ".join(rnd.choice("a b c d. e".split()) for _ in range(rnd.randrange(0, 12))) for _ in range(6)), "", 0) for i in range(40)]
    for r in repetition.clean_lines(rows(DOC, docs), keep=True).collect():
        assert len(canonical_words(r.kept_text)) == r.n_words - r.n_lost
    assert "kept_text" not in repetition.clean_lines(rows(DOC)).columns


def test_more_shared_lines_than_are_broadcast(spark, rows, monkeypatch):
    rnd = random.Random(15)
    lines = [f"line {i} holds word{i} and more." for i in range(60)]
    texts = ["\n".join(["everywhere, always.", *rnd.sample(lines, rnd.randrange(9))]) for _ in range(60)]
    docs = [(i // 2, t, "", 0) for i, t in enumerate([*texts, None, "", "\n\n", "---\n---", "---", "--\n---"])]
    docs += [(None, lines[0] + "\n  " + lines[0], "", 0)] * 2 + [docs[1]]
    held = Counter(x for _, t, *_ in docs for x in {x.strip() for x in (t or "").split("\n")})
    shared = {x for x, n in held.items() if n >= 3 and x.strip("-")}
    assert len({held[x] for x in shared}) > 4 and 0 < len(set(lines) - shared) and held["---"] == 3

    def left(t):
        return t and "".join(x for x in t.splitlines(True) if x.strip() not in shared)

    want = Counter((d, t and sum(x.strip() in shared for x in t.split("\n")) or 0, left(t)) for d, t, *_ in docs)
    for most, heavy in ((1 << 22, 1 << 16), (30, 1 << 16), (1, 1 << 16), (1, 10), (0, 1)):
        monkeypatch.setattr(repetition, "SHARED_LINES", most)
        monkeypatch.setattr(repetition, "HEAVY_DOCS", heavy, raising=False)
        out = repetition.clean_lines(rows(DOC, docs).repartition(3), rules=("boilerplate",), keep=True, shared_docs=3).collect()
        assert Counter((r.doc_id, r.n_boilerplate, r.kept_text) for r in out) == want, most
