"""Quality, language, licenses, decontamination, embeddings, packing and token counts, with odd rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import decontam, embed_dedup, langid, licenses, packing, quality, token_counts
from wayfold.llm.common import crc_remainder, local_components, worker_memory


def docs_of(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


# quality


def quality_rows(seed, n=400):
    rnd = random.Random(seed)
    good, bad = ["river", "stone", "light", "under", "often", "paper"], ["CLICK!!", "win$$$", "NOW!!", "###"]
    rows, labels = [], []
    for i in range(n):
        y = int(rnd.random() < 0.7)
        rows.append((i, " ".join(rnd.choice(good if y or rnd.random() < 0.4 else bad) for _ in range(rnd.randint(20, 60)))))
        labels.append((i, y, None))
    return rows, labels


def test_quality_held_out_accuracy_and_odd_rows(spark):
    rows, labels = quality_rows(1)
    docs = docs_of(spark, rows + [(1000, None), (1001, ""), (1002, "word " * 60_000), (5, rows[5][1])])
    known = spark.createDataFrame(labels + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known.where(crc_remainder("doc_id", 5) != 0))
    scored = quality.score(docs.withColumn("row", F.lit("clash")).withColumn("score", F.lit(9)), model)
    got = scored.collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got) and scored.columns == ["doc_id", "text", "row", "score"]
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in held]) > 0.97


def test_factorisation_identity():
    rng = np.random.default_rng(2)
    model = quality.Machine(np.zeros((0, 1)), 0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    at, x = np.array([3, 7, 20, 41]), rng.normal(size=4)
    pairs = sum(model.factors[a] @ model.factors[b] * x[i] * x[j] for (i, a), (j, b) in itertools.combinations(enumerate(at), 2))
    assert np.isclose(model.margin(at, x), 0.3 + model.weights[at] @ x + pairs)


def test_quality_sends_a_text_to_the_workers_once(spark):
    docs = docs_of(spark, [(1, "one two"), (2, None)])
    scored = quality.score(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")), text_col="TEXT")
    node = scored._jdf.queryExecution().analyzed()
    while "MapInArrow" not in node.nodeName():
        node = node.children().head()
    output = node.children().head().output()
    assert [output.apply(i).name() for i in range(output.size())] == ["row"]
    assert [(r.doc_id, r.text, r.score) for r in scored.orderBy("doc_id").collect()] == [(1, "one two", 0.5), (2, None, 0.5)]


def test_workers_let_go_of_what_other_operators_keep():
    path = packing.tokenizer_path()
    first = packing.Encoder.of(path)
    assert packing.Encoder.of(path) is first and worker_memory("packing")[path] is first
    assert worker_memory("quality") == {} and packing.Encoder.of(path) is not first


def test_quality_without_labels_and_with_metadata(spark):
    docs = docs_of(spark, [(1, "a b", 3.0, "x"), (2, None, None, "x")], ", weight double, y string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.fit(docs, none)).collect()] == [0.5, 0.5]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, metadata=["weight"])
    assert quality.score(docs, model, metadata=["weight"]).count() == 2 and quality.score(docs.limit(0), model, metadata=["weight"]).count() == 0


# language


def test_language_held_out_accuracy_and_odd_rows(spark):
    rnd = random.Random(3)
    stems = {"aa": ["the", "ing", "tion", "was", "ble"], "bb": ["eau", "oui", "ment", "que", "aile"], "cc": ["keit", "sch", "ung", "über", "ein"]}
    rows = [(i, " ".join("".join(rnd.choice(stems[g]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(6, 40))), g) for i in range(300) for g in [rnd.choice(list(stems))]]
    docs = docs_of(spark, rows + [(900, None, "aa"), (901, "12 !!", None), (902, "", "bb"), (903, "the " * 40_000, None), (904, "z" * 5000, None)], ", lang string")
    models = langid.fit(docs.where(crc_remainder("doc_id", 4) != 2))
    got = {r.doc_id: r for r in langid.predict(docs, models).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred == "aa" and got[904].lang_pred in stems
    held = [(got[i].lang_pred, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    empty = langid.fit(docs.limit(0))
    assert [r.lang_pred for r in langid.predict(docs.limit(2), empty).collect()] == ["und", "und"] and langid.predict(docs.limit(0), models).count() == 0


def test_every_language_has_a_model_however_rare(spark):
    rows = [(i, "the thing was thing", "aa") for i in range(400)] + [(1000 + i, "ung keit schung", f"r{i % 2}") for i in range(6)]
    docs = docs_of(spark, rows + [(2000, "oui que eau", None)], ", lang string")
    models = langid.fit(docs, max_docs=10)
    assert models.languages == ["aa", "r0", "r1"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, models).collect()}
    assert all(got[i][0] == lang[0] for i, _, lang in rows)


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "▁a": 1, "a": 2, "ab": 3, "b": 4, "ba": 5}
    table = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.1], [0.1, 0.3], [0.2, 0.2], [0.1, 0.1], [0, 0], [1e-7, 1e-7]])
    models = langid.Models(["x", "y"], pieces, table, np.zeros(2))

    def brute(word, column):
        if not word:
            return 1.0
        return sum((table[pieces[word[:k]], column] if word[:k] in pieces else (1e-7 if k == 1 else 0)) * brute(word[k:], column) for k in range(1, len(word) + 1))

    for word in ("▁ab", "▁abba", "▁aq", "▁babab"):
        assert np.allclose(models.word_scores([word])[0], np.log([brute(word, c) for c in (0, 1)]))


# licenses


def test_license_base_and_rules(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "GNU  General\nPublic--License v3 and cc.BY cc by-nc 4.0", None, "", "no words? 12",
        "SPDX-License-Identifier: GPL-2.0-or-later", "the MIT\tLicense, mit license", "cc bye mit licensed xapache license", "K cc by CC BY",
        "All rights reserved. " * 2000, "GNU Lesser General Public License, version 2.1",
    ]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, list(enumerate(texts)) + [(0, texts[0]), (None, texts[6])]).withColumn("words", F.lit(1))).collect() if r.doc_id is not None}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w = pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places = [(at, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for at in range(len(w)) if w[at: at + len(p)] == p]
        first, last = (min(places)[0], max(places)[0]) if places else (None, None)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), first, last), t
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {i: r.labels for i, r in got.items()}
    assert labels[0] == "apache,apache-2.0" and labels[1] == "cc-by,cc-by-nc-4.0,gpl,gpl-3.0" and labels[5] == "gpl-2.0" and labels[6] == "mit"
    assert labels[9] == "proprietary" and len(got[9].spans) == 2000 and labels[10] == "lgpl-2.1"
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_every_rule_passes_the_gate():
    gate = re.compile(licenses._gate().replace("\\x", "\\x"))
    rows = licenses.rule_rows()
    assert len(rows) > 300 and all(gate.search(r["needle"]) for r in rows)


def some_match(rnd, parsed):
    """A random string that a parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                kind, value = rnd.choice(arg)
                out += chr(value if str(kind) == "LITERAL" else rnd.randint(*value))
            case "BRANCH":
                out += some_match(rnd, rnd.choice(arg[1]))
            case "SUBPATTERN":
                out += some_match(rnd, arg[-1])
            case "MAX_REPEAT":
                out += "".join(some_match(rnd, arg[2]) for _ in range(rnd.randint(arg[0], min(arg[1], 2))))
            case _:
                raise ValueError(op)
    return out


def test_license_prefilter_loses_no_match(spark):
    rnd, extra = random.Random(10), [licenses.Rule("house", 30, 0.5, "house", "(?:our )?house rules"), licenses.Rule("any", 30, 0.5, "", "free for all")]
    rows, gate = licenses.rule_rows(extra), re.compile(licenses._gate(extra))
    made = [(r, some_match(rnd, re._parser.parse(r["pattern"]))) for r in rows for _ in range(8)]
    assert all(f" {r['needle']}" in f" {t} " and gate.search(t.upper()) for r, t in made)
    texts = ["A BSD-style license.", "licensed under the MIT", "Licenced under MIT terms", "our House-Rules", "free for all", "no match", *(f"x {t} y" for _, t in rnd.sample(made, 60))]
    want = set()
    for i, t in enumerate(texts):
        words = " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " "
        for r in rows:
            for m in re.finditer(f"(?<= )(?:{r['pattern']})(?= )", words):
                want.add((i, r["rule"], words[: m.start()].count(" ") - 1, words[: m.end()].count(" ") - 1))
    got = {(r.doc_id, r.rule, r["first"], r["last"]) for r in licenses.detections(docs_of(spark, list(enumerate(texts))), extra=extra).collect()}
    assert got == want and all(any(i == x[0] for x in got) for i in range(5))


# decontamination

ITEM = "A train leaves Paris with 240 people and after 3 hours Maria counts 120 km on the old map while Maria sleeps."
OTHER = "How many small red boxes fit on the long wooden table in the big room of the school?"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, ""), (None, ITEM), (5, "too short text")], "item_id long, text string")
    again = ITEM.replace("Maria", "Olga").replace("240", "77").replace("120 km", "9 miles")
    mixed = ITEM.replace("Maria counts", "Olga counts").replace("while Maria", "while Peter")
    rows = [
        (1, "Some words first. " + ITEM + " And more."), (2, "Other words. " + again), (3, "Text. " + mixed), (4, OTHER.upper().lower()), (5, None), (6, ""),
        (7, "A train leaves the town and a boy counts boxes on a map of the school room."), (8, "x " * 50_000 + OTHER), (1, "Some words first. " + ITEM + " And more."), (None, ITEM),
        (9, "pre " + ITEM + " " + OTHER),
    ]
    docs = docs_of(spark, rows).withColumn("hash", F.lit(1)).withColumn("size", F.lit(1))
    got = {r.doc_id: (r["items"], r.reparameterised) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {1: ("1", False), 2: ("1", True), 4: ("2", False), 8: ("2", False), 9: ("1,2", False)}
    assert sorted(r.doc_id or 0 for r in decontam.clean(docs, bench).collect()) == [0, 3, 5, 6, 7]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_one_changed_slot_does_not_hide_verbatim_windows(spark):
    from wayfold.llm import queries

    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    one = ITEM.replace("while Maria", "while Peter")  # (Maria, Maria) and (Maria, Peter)
    both = ITEM.replace("240", "77").replace("3 hours", "8 hours").replace("Maria counts", "Olga counts").replace("while Maria", "while Peter")
    rows = [(1, "Text. " + one), (2, "Text. " + ITEM.replace("Maria", "Olga")), (3, "Text. " + both), (4, "Nothing of it.")]
    got = {r.doc_id: r.n_windows for r in decontam.contaminated(docs_of(spark, rows), bench, per_window=True).collect()}
    assert set(got) == {1, 2, 3} and got[1] >= 4
    assert [r.doc_id for r in decontam.clean(docs_of(spark, rows), bench, per_window=True).collect()] == [4]
    seen = []
    real, decontam.contaminated = decontam.contaminated, lambda *a, **b: seen.append(b)
    try:
        queries.QUERIES["op5_template_decontamination"](spark, "/root/testdata/sf0.001")
    finally:
        decontam.contaminated = real
    assert seen == [{"per_window": True}]


def test_decontamination_finds_short_items_tables_and_names_anywhere(spark):
    items = [
        (1, "What is two plus two?"), (2, "12 7 3 55 Anna 9 km 8 Bob 14 2 31 7"), (3, "Name the capital of\n Norway\nAdd the number of people who live there"),
        (4, "What is the sum of 5 and the largest of all"),
    ]
    rows = [
        (1, "Question: WHAT is\n two plus two? Four."), (2, "see 12 7 3 55 anna 9 km 8 bob 14 2 31 7 end"), (3, "so name the Capital of Norway. add the number of people who live there"),
        (4, "Question: What is the sum of 6 and the largest of all"), (5, "two plus three"), (6, None), (7, ""), (8, "12 7 3 55 Anna 9 km 9 Bob 14 2 31 8"),
    ]
    bench = spark.createDataFrame([*items, (9, ""), (10, None)], "item_id long, text string")
    for per_window in (False, True):
        got = {r.doc_id: (r["items"], r.reparameterised) for r in decontam.contaminated(docs_of(spark, rows), bench, per_window=per_window).collect()}
        assert got == {1: ("1", False), 2: ("2", False), 3: ("3", False), 4: ("4", True)}


def test_decontamination_finds_every_shared_window(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(12, 40)))) for i in range(20)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rnd.randint(0, 60))]
        if i % 3 == 0:
            piece = items[rnd.randrange(20)][1].split()
            at = rnd.randint(0, len(piece) - 8)
            w[5:5] = piece[at: at + rnd.randint(8, 20)]
        rows.append((i, " ".join(w)))
    want = {}
    for i, t in rows:
        w = t.split()
        mine = {tuple(w[a: a + 10]) for a in range(len(w) - 9)}
        for k, item in items:
            p = item.split()
            if any(tuple(p[a: a + 10]) in mine for a in range(len(p) - 9)):
                want.setdefault(i, set()).add(k)
    got = {r.doc_id: set(map(int, r["items"].split(","))) for r in decontam.contaminated(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 10


# embeddings


def test_lattice_decoding_and_cells():
    rng = np.random.default_rng(5)
    vectors = embed_dedup.short_vectors()
    assert len(vectors) == 2400
    x = rng.normal(size=(300, 8))
    own = embed_dedup.decode(x)
    assert (((x - own) ** 2).sum(axis=1) <= 1 + 1e-9).all()
    around = ((x[:, None] - own[:, None] - vectors[None]) ** 2).sum(axis=2)
    assert (((x - own) ** 2).sum(axis=1)[:, None] <= around + 1e-9).all()
    row, cell = embed_dedup.probed(x, 0.2)
    for i in range(60):
        near = x[i] + 0.2 * rng.normal(size=(200, 8)) / 3.5
        near = near[((near - x[i]) ** 2).sum(axis=1) <= 0.04]
        assert set(embed_dedup.cell_hash(embed_dedup.decode(near)).tolist()) <= set(cell[row == i].tolist())


@pytest.mark.parametrize("chunk", [512, 5])
def test_embedding_links_equal_brute_force(spark, monkeypatch, chunk):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
    centres = rng.normal(size=(12, 24))
    rows, label = [], {}
    for i in range(240):
        noise = rng.choice([0.0, 0.12, 0.3, 0.5])
        v = centres[rng.integers(12)] + noise * rng.normal(size=24)
        rows.append((i * 3, [float(np.float32(z)) for z in v], int(rng.integers(2))))
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [1.0] * 5, 1), (904, rows[0][1], None), (905, [None] + [1.0] * 23, 1), (906, [], 0), (907, [2.0] * 5, 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if i < 900 or i in (903, 907)]
    u, v = [], []
    for (i, a, x), (j, b, y) in itertools.combinations(good, 2):
        if x == y and len(a) == len(b) and a @ b >= 0.93:
            u.append(i)
            v.append(j)
    node, root = local_components(np.array(u), np.array(v))
    component = dict(zip(node.tolist(), root.tolist()))
    for i, *_ in rows:
        c = component.get(i, i)
        assert got[i] == (u.count(i) + v.count(i), c, c == i)
    assert len(u) > 100 and embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# packing


def test_packing_is_a_packing_of_the_same_ids(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(7)
    texts = [" ".join(rnd.choice(["alpha", "Béta", "g7-x", "it's", "日本", "…"]) for _ in range(rnd.choice([0, 5, 60, 900, 9000]))) for _ in range(60)] + [None, "", "  <|endoftext|>\x1c a"]
    docs = docs_of(spark, list(enumerate(texts)) + [(3, texts[3])]).withColumn("part", F.lit(1)).withColumn("length", F.lit("z"))
    got = packing.pack(packing.pieces(docs), partition_pieces=20).toPandas()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, t in [*enumerate(texts), (3, texts[3])]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k // 4096, k, len(ids[k: k + 4096]), zlib.crc32(ids[k: k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted(want) == sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *np.cumsum(bin_.length)[:-1]] and bin_.length.sum() == bin_.sequence_length.iloc[0] <= 4096
    bound = packing.lower_bound(np.bincount(got.length, minlength=4097))
    assert bound <= got.sequence_id.nunique() <= bound + 1
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_lower_bound_and_best_fit():
    rnd = random.Random(8)
    for _ in range(60):
        lengths = np.array([rnd.randint(1, 12) for _ in range(rnd.randint(1, 9))])
        bins, offsets, fill = packing.best_fit_decreasing(lengths, 12)
        assert fill.max() <= 12 and fill.sum() == lengths.sum()
        best = next(k for k in range(1, 10) if any(max(np.bincount(c, lengths, k)) <= 12 for c in itertools.product(range(k), repeat=len(lengths))) or k == len(lengths)) if len(lengths) < 7 else len(fill)
        assert packing.lower_bound(np.bincount(lengths, minlength=13)) <= best <= len(fill)
    assert packing.lower_bound(np.bincount([7, 7, 7], minlength=13)) == 3


# token counts


def test_edited_counts_equal_full_counts(spark):
    rnd = random.Random(9)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "é", "12", "!", "re", "The", " don't", "\t", "日本"]
    rows = []
    for i in range(80):
        text = "".join(rnd.choice(parts) for _ in range(rnd.choice([0, 3, 800, 5000])))
        edits = [(rnd.randint(0, len(text) + 3), 0, "".join(rnd.choice(parts) for _ in range(rnd.choice([0, 2, 30])))) for _ in range(rnd.randint(0, 4))]
        rows.append((i, text, [(a, a + rnd.randint(0, rnd.choice([2, 40, 900])), t) for a, _, t in edits]))
    rows += [(900, None, None), (901, "", [(0, 0, None)]), (902, "x y", [(None, 1, "z")])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,stop:int,text:string>>")
    built = token_counts.build(frame)
    got = {r.doc_id: r for r in token_counts.update(built.join(frame.select("doc_id", "edits"), "doc_id")).collect()}
    for i, text, edits in rows:
        text = text or ""
        assert got[i].n_tokens_before == token_counts.count(text)
        for a, b, t in edits or []:
            a = min(a or 0, len(text))
            text = text[:a] + (t or "") + text[max(a, min(b, len(text))):]
        assert got[i].text == text and got[i].n_tokens == token_counts.count(text) == sum(got[i].leaf_tokens)
    assert token_counts.build(frame.limit(0)).count() == 0


def test_small_edits_encode_little():
    text = "some words of a long text " * 4000
    tree = token_counts.Tree.of(text)
    for at in (10, 50_000, 90_000):
        tree.edit(at, at + 3, "new")
    assert tree.total == token_counts.count(tree.text()) and tree.encoded < 6000
