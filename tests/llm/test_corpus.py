"""Search and deduplication operators against brute force on small corpora."""

import hashlib
import random
import re

import pytest

import __spark_entry__
from wiretide.llm import chat, decontaminate, graphs, langid, licenses, minhash, suffixes, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, cut string, node int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, short = [say(60), say(75), say(140)], say(40)
    texts = [say(rng.randint(5, 200)) for _ in range(60)]
    for p in shared:
        texts += [f"{say(20)} {p}, {say(15)}.", f"{p.upper()} {say(9)}", f"{say(70)}\n{p}"]
    texts += [f"{say(30)} {short} {say(30)}", f"{short} {say(50)}"]
    base = say(150).split()
    for _ in range(12):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    texts += [texts[0]] * 4 + [None, "", "...", "one", "one", "one two three", "lone " * 500, "wide " * 20000]
    rows = [(i, t, "en", "s", len(t or ""), "own", "own", 7) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, say(80), None, None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.95), (0.9, 0.99)):
        bands, rows = minhash.bands_and_rows(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128


def brute_classes(rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(r[1])) else frozenset() for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [set() for _ in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            same = len(a & b)
            equal_row = rows[i][:2] == rows[j][:2]
            if (same and same >= 0.8 * (len(a) + len(b) - same) - 1e-9) or equal_row:
                root[find(i)] = find(j)
                if a != b:
                    links[i].add(b)
                    links[j].add(a)
    return [find(i) for i in range(len(rows))], [len(x) for x in links], sets


def test_near_duplicates_equal_brute_force(spark, corpus, monkeypatch):
    rows, docs = corpus
    of, links, sets = brute_classes(rows)
    least = {}
    for r, c in zip(rows, of, strict=True):
        ids = [x for x in (least.get(c), r[0]) if x is not None]
        least[c] = min(ids) if ids else None
    want = sorted(((r[0], least[c], n) for r, c, n in zip(rows, of, links, strict=True)), key=str)
    for tile in (256, 4):  # the latter cuts components into tiles
        monkeypatch.setattr(minhash, "TILE", tile)
        got = minhash.near_duplicates(docs).collect()
        assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == want
    kept = minhash.one_of_each(docs).collect()
    assert len(kept) == len(set(of)) and {r["uid"] for r in kept} <= {"own", None}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 540)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r[0]: r[1] for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0
    stars = spark.createDataFrame(edges + [(b, b) for _, b in edges], "node long, head long")
    got = {r[0]: r[1] for r in graphs.star_components(stars).collect()}
    classes = {}
    for x in root:
        classes.setdefault(find(x), set()).add(got[x])
    assert set(got) == set(root) and all(len(c) == 1 for c in classes.values()) and len(set(got.values())) == len(classes)
    assert graphs.star_components(stars.limit(0)).count() == 0


def covered(rows, n):
    texts = {}
    for r in rows:
        texts[(r[0], r[1])] = words(r[1])
    where = {}
    for key, w in texts.items():
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), set()).add(key)
    out = {}
    for key, w in texts.items():
        hit = set()
        for i in range(len(w) - n + 1):
            if len(where[tuple(w[i : i + n])]) > 1:
                hit.update(range(i, i + n))
        if hit:
            out[key[0]] = hit
    return out


def test_minimisers_leave_no_window_out():
    import numpy as np

    rng = np.random.default_rng(2)
    for size in (24, 25, 26, 80, 400):
        key = rng.integers(0, 2**63, size, dtype=np.uint64)
        at = suffixes.minimisers(key, 25)
        assert all(((at >= i) & (at < i + 25)).any() for i in range(size - 24))
    assert len(suffixes.minimisers(np.zeros(1000, np.uint64), 25)) <= 1000 / 25 + 25


def test_repeats_equal_brute_force(spark, corpus):
    rows, docs = corpus
    want = covered(rows, 50)
    got, text = {}, {r[0]: r[1] for r in rows}
    for r in suffixes.repeats(docs, 50).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        assert words(text[r["doc_id"]][r["start_char"] : r["end_char"]]) == words(text[r["doc_id"]])[r["start_word"] : r["end_word"]]
    assert set(got) == set(want)
    assert all(got[k] <= want[k] for k in got)
    assert sum(map(len, got.values())) >= 0.98 * sum(map(len, want.values()))
    assert suffixes.repeats(docs.limit(0)).count() == 0


def covered_by_order(rows, n):
    """Words of each document that a document of lower (True) or higher id (False) has too."""
    where = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append((doc, i))
    out = {}
    for found in where.values():
        low, high = min(found)[0], max(found)[0]
        for doc, i in found:
            for later in [True] * (low < doc) + [False] * (high > doc):
                out.setdefault((doc, later), set()).update(range(i, i + n))
    return out


def reported(spans, rows):
    """Words by document and order; every passage of a span must stand in its partner, and no span may go on."""
    out, text = {}, {doc: words(t) for doc, t in rows}
    passages = {doc: {tuple(w[i : i + 50]) for i in range(len(w) - 49)} for doc, w in text.items()}
    found = spans.collect()
    assert len({(r["doc_id"], r["later"], r["other_id"], r["start_word"]) for r in found}) == len(found)
    for r in found:
        assert (r["other_id"] < r["doc_id"]) == r["later"] and r["other_id"] != r["doc_id"]
        own = text[r["doc_id"]]
        assert all(tuple(own[i : i + 50]) in passages[r["other_id"]] for i in range(r["start_word"], r["end_word"] - 49))
        out.setdefault((r["doc_id"], r["later"]), set()).update(range(r["start_word"], r["end_word"]))
    return out


@pytest.mark.parametrize("chunk", [1 << 16, 300])
def test_repeats_in_large_classes(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rng = random.Random(5)
    say = lambda n: [f"v{rng.randrange(100000)}" for _ in range(n)]
    line, base, texts = say(40), say(200), []
    texts += [say(15) + line + say(15) for _ in range(400)]
    for _ in range(40):  # a passage of 54 words in two documents, most of it the line
        left, right = say(7), say(7)
        for _ in range(2):
            texts.append(say(20) + left + line + right + say(20))
    for _ in range(200):  # edited copies
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = say(1)[0]
        texts.append(near)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = reported(suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 50), rows)
    assert got == covered_by_order(rows, 50)


@pytest.mark.parametrize("often_first", [False, True])
def test_repeats_many_times_in_one_document(spark, often_first):
    rng = random.Random(8)
    say = lambda n: [f"v{rng.randrange(100000)}" for _ in range(n)]
    passage = say(60)
    once, often = say(20) + passage + say(20), [w for _ in range(5) for w in say(20) + passage]
    rows = [(i, " ".join(t)) for i, t in enumerate([often, once] if often_first else [once, often])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = reported(suffixes.repeats(docs, 50), rows)
    assert got == covered_by_order(rows, 50)
    assert {k: len(v) for k, v in got.items()} == ({(0, False): 300, (1, True): 60} if often_first else {(0, False): 60, (1, True): 300})


@pytest.mark.parametrize("chunk", [1 << 16, 2])
def test_spans_have_the_partner_that_has_them(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    w = [f"w{i}" for i in range(119)]
    turned = [f"p{i % 3}" for i in range(90)]
    rows = [(1, w[:60]), (2, w[50:]), (3, w), (4, turned), (5, ["x", *turned[:50], "y"])]
    rows = [(i, " ".join(t)) for i, t in rows]
    found = suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50)
    assert reported(found, rows) == covered_by_order(rows, 50)
    of = {(r["doc_id"], r["other_id"], r["start_word"], r["end_word"]) for r in found.collect()}
    assert {x for x in of if x[0] == 3} == {(3, 1, 0, 60), (3, 2, 50, 119)}
    left = {r["doc_id"]: r["text"].split() for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {1: w[:60], 2: w[50:], 4: turned, 5: ["x", "y"]}


def test_cutting_keeps_the_first_and_the_rest(spark, corpus):
    rows, docs = corpus
    left = {r["doc_id"]: r for r in suffixes.without_repeats(docs, 50).collect()}
    repeated = covered(rows, 50)
    for r in rows:
        if r[0] not in repeated:
            assert left[r[0]]["text"] == r[1] and left[r[0]]["cut"] == r[6]
    assert all(r["n_chars"] == len(r["text"]) for r in left.values() if r["doc_id"] in repeated)
    once = spark.createDataFrame([(1, "a b " + " ".join(f"w{i}" for i in range(60)), 0), (2, "c " + " ".join(f"w{i}" for i in range(60)) + " d", 0)], "doc_id long, text string, n_chars int")
    assert {r["doc_id"]: r["text"].split() for r in suffixes.without_repeats(once).collect()} == {1: ["a", "b", *(f"w{i}" for i in range(60))], 2: ["c", "d"]}


def test_decontamination(spark, corpus, monkeypatch):
    rows, docs = corpus
    long = words(rows[10][1]) if len(words(rows[10][1])) > 14 else words(rows[61][1])
    items = [(1, " ".join(long[1:14])), (2, "one"), (10, "one, TWO three"), (3, None), (4, "..."), (5, "never seen words here at all in any text of it"), (1, " ".join(long[1:14]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = words(t)
        for x in [w] if 0 < len(w) < 10 else [w[k : k + 10] for k in range(len(w) - 9)]:
            windows.setdefault(tuple(x), set()).add(str(i))

    def expected(text):
        w, hit, names = words(text), set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    names |= ids
        return len(w), len(hit), sorted(names)

    want = sorted(((r[0], *expected(r[1])) for r in rows), key=str)
    for size in (1 << 16, 2):  # the latter needs several passes
        monkeypatch.setattr(decontaminate, "PASS_WINDOWS", size)
        got = decontaminate.decontaminate(docs, benchmark).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == want
    assert {r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()} == {r[0] for r in rows if not expected(r[1])[1]}
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), benchmark).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c x d e f g h i j"), (3, "a b c x x x d e f g h i j")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string")
    got = {r["doc_id"]: {h["kind"] for h in r["hits"]} for r in decontaminate.search(decontaminate.build_index(docs), items, 10, slop=1).collect()}
    assert got == {1: {"phrase"}, 2: {"near"}, 3: set()}


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.2
        text = [rng.choice(plain) for _ in range(40)]
        if bad:
            text[rng.randrange(40)] = rng.choice(["vile", "foul", "nasty"])
        rows.append((i, " ".join(text), i))
        if i % 3:
            labels.append((i, int(bad)))
    rows += [(900, None, 0), (901, "", 0), (902, "vile " * 30000, 0), (902, "vile " * 30000, 0), (None, "w1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    marks = spark.createDataFrame(labels + labels[:5] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.model(docs, marks)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    truth = {r[0]: bool({"vile", "foul", "nasty"} & set(words(r[1]))) for r in rows}
    assert sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in got) >= 0.97 * len(got)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and all(r["score"] >= 0.5 for r in got if r["doc_id"] is not None and r["doc_id"] not in {x["doc_id"] for x in kept.collect()})
    none = toxicity.model(docs, marks.limit(0))
    assert not len(none.terms) and toxicity.score(docs.limit(0), none).count() == 0
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, none).collect())


@pytest.mark.parametrize("share", [0.5, 0.15])
def test_toxicity_needs_few_of_the_positives(spark, share):
    """Toxic words are an open family of forms of two stems; most toxic texts have no label or a label 0."""
    rng = random.Random(5)
    syllable = [c + v for c in "bdfgklmnprst" for v in "aeiou"]
    say = lambda stem="": stem + "".join(rng.choice(syllable) for _ in range(rng.randint(2, 4)))
    rows, truth, labels = [], [], []
    for i in range(2400):
        text = [say() for _ in range(60)]
        truth.append(rng.random() < 0.2)
        if truth[-1]:
            for at in rng.sample(range(60), 3):
                text[at] = say(rng.choice(["zwix", "quoj"]))
        rows.append((i, " ".join(text)))
        if i % 2:
            labels.append((i, int(truth[-1] and rng.random() < share)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score(docs, toxicity.model(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    caught = [r["score"] >= 0.5 for r in got if truth[r["doc_id"]]]
    alarms = [r["score"] >= 0.5 for r in got if not truth[r["doc_id"]]]
    assert sum(caught) >= 0.9 * len(caught) and sum(alarms) <= 0.02 * len(alarms)


def test_toxicity_terms_against_python():
    import numpy as np
    import pyarrow as pa

    texts = ["Ein Wort, ein wort!", "", None, "żółw aa aa b", "x" * 20000]
    terms, (has,) = toxicity.frequencies(pa.array(texts), [np.ones(5, np.int64)])
    sets = []
    for t in texts:
        own = set()
        for w in (found := words((t or "").lower())):
            raw = b" " + w.encode() + b" "
            own |= {raw[i : i + n] for n in toxicity.PIECES for i in range(len(raw) - n + 1)} | {("word", w)}
        sets.append(own | set(zip(found, found[1:])))
    assert len(terms) == len(set().union(*sets)) and has.sum() == sum(map(len, sets))
    text, place, count, size = toxicity.entries(pa.array(texts), terms)
    assert np.bincount(text, minlength=5).tolist() == [len(s) for s in sets] and size.tolist() == [len(words(t)) for t in texts]
    assert set(count[text == 4].tolist()) == {1}
    assert sorted(count[text == 3].tolist())[-1] == 2


def test_nonnegative_risk():
    import numpy as np

    rng = np.random.default_rng(2)

    def some(n):
        per = rng.integers(0, 4, n)
        text = np.repeat(np.arange(n), per)
        return toxicity.Rows.of(n, text, rng.integers(0, 5, len(text)), rng.integers(1, 9, len(text)), rng.integers(9, 99, n))

    p, u = some(6), some(9)
    w = rng.normal(size=11)
    positive, negative, up, down = toxicity.risk(w, p, u, 0.3)
    for k in range(11):
        step = np.eye(11)[k] * 1e-6
        high, low = toxicity.risk(w + step, p, u, 0.3), toxicity.risk(w - step, p, u, 0.3)
        assert abs((high[0] - low[0]) / 2e-6 - up[k]) < 1e-6 and abs((high[1] - low[1]) / 2e-6 - down[k]) < 1e-6
    # With a prior far too high the risk of the negative class falls below zero; the fit stays finite.
    w = toxicity.train(p, u, 0.9, 5, toxicity.Fit(epochs=50, batch=5))
    assert np.isfinite(w).all() and (w[:-1] >= 0).all()


def test_language_models(spark):
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "tion", "and", "wh"], "fr": ["eau", "eux", "qué", "ère", "ou"], "de": ["sch", "ung", "ver", "ß", "ich"]}
    say = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."
    rows = [(i, say(lang := rng.choice(sorted(parts)), 30), lang, "x") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.learn(docs)
    test = [(i, say(lang := rng.choice(sorted(parts)), 8), lang, "x") for i in range(80)]
    odd = [(80, None, None, "x"), (81, "", "en", "x"), (82, "12 34 !?", "en", "x"), (83, "the ing " * 20000, "en", "x"), (83, "the ing " * 20000, "en", "x"), (84, "Жж" * 40, None, "x")]
    got = langid.predict(spark.createDataFrame(test + odd, docs.schema), model).collect()
    assert len(got) == 86
    by = {r["doc_id"]: r for r in got}
    assert sum(by[i]["lang_pred"] == lang for i, _, lang, _ in test) >= 78
    assert [by[i]["lang_pred"] for i in (80, 81, 82, 83)] == ["und", "und", "und", "en"]
    assert by[84]["rejected"] and by[84]["lang_pred"] in parts and not by[83]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got)
    empty = langid.learn(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}


def test_calibration_reads_every_training_text(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    rows = [(lang := rng.choice(["a", "b"]), "".join(rng.choice("abcd" if lang == "a" else "cdefgh ") for _ in range(rng.randint(1, 12))) + "c") for _ in range(5000)]
    rows += [("a", "..."), ("b", "")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model, other = langid.learn(docs.repartition(5)), langid.learn(docs.coalesce(1))
    assert (model.scale, model.limit) == (other.scale, other.limit)
    found = model.entropies(langid.Grams(pa.array([x for _, x in rows[:5000]])))
    true = np.array([model.langs.index(x) for x, _ in rows[:5000]])
    for i, lang in enumerate(model.langs):
        own = found[true == i, i]
        assert abs(model.limit[lang] - (own.mean() + 4 * own.std() + 0.1)) < 1e-5
    fit = [np.mean(np.log(np.exp(-s * found)[np.arange(5000), true] / np.exp(-s * found).sum(axis=1))) for s in langid.SCALES]
    assert model.scale == langid.SCALES[int(np.argmax(fit))]


def test_probabilities_sum_to_one(spark):
    import numpy as np

    docs = spark.createDataFrame([("x", "abab baba abba ab ba aab")], "lang string, text string")
    model = langid.learn(docs)
    context = [ord("a"), ord("b"), ord("a")]
    grams = np.array([(context[0] << 48) | (context[1] << 32) | (context[2] << 16) | s for s in range(1, 65536)], np.uint64)
    total = np.exp(model.log_probabilities(grams).astype(np.float64)).sum()
    assert abs(total - 1) < 0.01


def test_chat_folds_and_reads_back(spark):
    log = [
        ("c", 1, 1, "open", "user", "Hi"), ("c", 1, 2, "edit", "user", "Hello <#\\: there"), ("c", 2, 3, "open", "assistant", ""), ("c", 2, 4, "delta", "assistant", "dra"),
        ("c", 2, 5, "regenerate", "assistant", ""), ("c", 2, 7, "delta", "assistant", "### x: </turn>\n"), ("c", 2, 6, "delta", "assistant", "one "), ("c", 2, 8, "delta", "assistant", None),
        ("c", 3, 9, "open", "user", "gone"), ("c", 3, 10, "delete", "user", None), ("c", 4, 11, "delta", "system:", "late"), ("c", 5, 12, "odd", None, "?"), (None, 1, 1, "open", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id string, message int, seq int, kind string, role string, text string")
    got = {r["conv_id"]: r for r in chat.parse(chat.render(chat.fold(events))).collect()}
    assert [tuple(t) for t in got["c"]["turns"]] == [("user", "Hello <#\\: there"), ("assistant", "one ### x: </turn>\n"), ("system:", "late"), ("", "")]
    assert got["c"]["loss_text"] == "one ### x: </turn>\n"
    assert [tuple(t) for t in got[None]["turns"]] == [("", "")]
    assert chat.render(chat.fold(events.limit(0))).count() == 0


def test_chat_of_tables(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "é" * 1500), (1, 1, "assistant", "é" * 1500), (2, None, None, None), (3, 0, "assistant", "\\b\\l<\\"), (4, 0, "user", ""), (4, 1, "user", "x" * 200_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in __spark_entry__.queries()["op8_event_sourced_chat"](spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, 3000, sha("é" * 3000))
    assert got[3]["turns_sha256"] == sha("assistant\n\\b\\l<\\\n") and got[3]["loss_sha256"] == sha("\\b\\l<\\")
    assert got[4]["turns_sha256"] == sha("user\n\nuser\n" + "x" * 200_000 + "\n") and got[2]["turns_sha256"] == sha("\n\n")
    assert got[-7]["loss_sha256"] == sha("\\### Assistant: </turn> ok") and got[-7]["n_turns"] == 2


def test_licence_rules(spark):
    s = licenses.SENTENCES
    header = "# " + s["apache2.grant"] + ";\n# " + s["apache2.use"].replace("except", "except\n#") + ".\n# " + s["apache2.copy"] + "\n# " + s["apache2.disclaim"] + "."
    rows = [
        (1, header, "x"), (2, "Intro. " + s["mit.grant"] + ":\n\n" + s["mit.notice"] + ".\n" + s["mit.disclaim"].lower() + ".", "x"), (3, "text\n" + s["apache2.statement"] + ".", "x"), (4, s["mit.notice"] + ". " + s["mit.grant"] + ".", "x"),
        (5, "not " + s["mit.statement"], "x"), (6, None, "x"), (7, "", "x"), (8, (s["ccbync4.statement"] + ". ") * 3, "x"), (8, (s["ccbync4.statement"] + ". ") * 3, "x"), (9, "w " * 50000 + "\n" + s["gpl3.statement"], "x"),
    ]
    got = [(r["doc_id"], [m["rule"] for m in r["matches"]]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, matches string")).collect()]
    assert sorted(got) == [
        (1, ["apache2-header"]), (2, ["mit-text"]), (3, ["apache2-statement"]), (4, []), (5, []), (6, []), (7, []), (8, ["ccbync4-statement"] * 3), (8, ["ccbync4-statement"] * 3), (9, ["gpl3-statement"]),
    ]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
