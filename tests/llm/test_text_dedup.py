"""SimHash groups, repeated windows and components against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from wayfold.llm import anchored, components, simhash, substring_dedup, suffix_dedup
from wayfold.llm.common import local_components

SCHEMA = "doc_id long, text string, row string, marks int, key string, fp int"


def frame(spark, texts, schema=SCHEMA):
    """Rows (id, text) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "r", 1, "k", 2) for i, t in texts], schema)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rnd.randint(13, 60))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(3)]
        for _ in range(rnd.randint(0, 3)):
            parts.insert(rnd.randint(0, 3), rnd.choice(shared))
        out.append((i * 7 % n, rnd.choice([" ", "\n", "\t "]).join(parts)))
    out += [(1000, ""), (1001, None), (1002, out[3][1]), (1003, "x " * 300), (1004, "x " * 400), (1005, "a" * 700), (1006, "a" * 90)]
    return out


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute_words(rows, window):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for at in range(len(w) - window + 1):
            first.setdefault(tuple(w[at: at + window]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for at in range(len(w) - window + 1):
            if first[tuple(w[at: at + window])] < i:
                gone[at: at + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def brute_bytes(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - window + 1):
            piece = data[at: at + window]
            if piece in seen:
                gone[at: at + window] = True
            seen.add(piece)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(data), spans, np.frombuffer(data, np.uint8)[~gone].tobytes())
    return out


def test_substring_dedup(spark):
    rows = corpus(1)
    got = {r.doc_id: (r.n_words, sum(x.stop - x.start for x in r.intervals), r.kept_text) for r in substring_dedup.dedup(frame(spark, rows)).collect()}
    assert got == brute_words(rows, 13)


@pytest.mark.parametrize("crowded", [1, 10**9])
def test_crowded_anchors_give_the_same(spark, monkeypatch, crowded):
    monkeypatch.setattr(anchored, "CROWDED", crowded)
    monkeypatch.setattr(anchored, "HEAVY_HITS", 2)
    monkeypatch.setattr(anchored, "HEAVY_SAMPLE", 1 if crowded == 1 else 3)
    monkeypatch.setattr(anchored, "SHARD_CONTEXTS", 20)
    rows = corpus(2)
    got = {r.doc_id: (r.n_words, sum(x.stop - x.start for x in r.intervals), r.kept_text) for r in substring_dedup.dedup(frame(spark, rows)).collect()}
    assert got == brute_words(rows, 13)
    got = {r.doc_id: (r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_dedup.dedup(frame(spark, rows)).collect()}
    assert got == brute_bytes(rows, 100)


def test_suffix_dedup(spark):
    rows = corpus(3)
    got = {r.doc_id: (r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_dedup.dedup(frame(spark, rows)).collect()}
    assert got == brute_bytes(rows, 100)


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text), (9, "q " + text)]
    for dedup, kept in ((substring_dedup.dedup, "kept_text"), (suffix_dedup.dedup, "kept")):
        got = sorted((r.doc_id or -1, r[kept] if isinstance(r[kept], str) else bytes(r[kept]).decode()) for r in dedup(frame(spark, rows)).collect())
        assert [g[0] for g in got] == [-1, 5, 5, 9]
        assert got[0][1] == got[1][1] == got[2][1] == text
        assert got[3][1].strip() == "q"
        assert dedup(frame(spark, [])).count() == 0


def test_strip_keeps_columns_and_clean_texts(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text + "  end", "a", 7), (2, text, "b", 8), (3, "x\n" + text, "c", 9), (4, "own\n text", None, 3)], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in substring_dedup.strip(docs).collect()}
    assert set(got) == {1, 3, 4} and got[1].text == text + "  end" and got[3].text == "x" and got[3].n_chars == 1
    assert got[4].text == "own\n text" and substring_dedup.strip(docs).columns == docs.columns


def test_very_long_texts(spark):
    rnd = random.Random(4)
    long = " ".join(str(rnd.randint(0, 10**6)) for _ in range(120_000))
    rows = [(1, long), (2, "tail " + long[200_000:400_000]), (3, "b" * 300_000)]
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark, rows)).collect()}
    assert got[1].kept_text == long and len(got[2].intervals) == 1 and got[3].n_words == 1
    got = {r.doc_id: r for r in suffix_dedup.dedup(frame(spark, rows)).collect()}
    assert bytes(got[1].kept).decode() == long and bytes(got[2].kept) == b"tail " and bytes(got[3].kept) == b"b"


def test_repeat_groups_are_maximal(spark):
    rnd = random.Random(5)
    part = "".join(rnd.choice("abcdefgh ") for _ in range(150))
    rows = [(i, "".join(rnd.choice("xyz") for _ in range(50)) + part + "".join(rnd.choice("uvw") for _ in range(50))) for i in range(4)]
    groups = suffix_dedup.repeat_groups(frame(spark, rows)).collect()
    by = {}
    for g in groups:
        by.setdefault(g.group_id, []).append((g.doc_id, g.start, g.n_bytes))
    texts = dict(rows)
    assert groups and any({o[0] for o in v} == {0, 1, 2, 3} for v in by.values())
    for v in by.values():
        strings = {texts[d][s: s + n] for d, s, n in v}
        assert len(strings) == 1 and len(v) > 1 and v[0][2] >= 100


def test_lcp_intervals():
    found = set(suffix_dedup.interval_tree([1, 3, 0, 2]))
    assert found == {(3, 1, 1, 2), (1, 0, 0, 2), (2, 0, 3, 4)}


def test_fm_index_ranks():
    rnd = np.random.default_rng(6)
    sequence = rnd.integers(0, 37, 500)
    tree = substring_dedup.WaveletMatrix(sequence, 37)
    symbol, at = rnd.integers(0, 37, 300), rnd.integers(0, 501, 300)
    assert tree.rank(symbol, at).tolist() == [int((sequence[:a] == s).sum()) for s, a in zip(symbol, at)]


def brute_simhash(rows):
    def fingerprint(t):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i: i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, fingerprint(t)) for i, t in rows]
    parent = {i: i for i, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= 4:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (f"{p:016x}", root(i)) for i, p in prints}


def test_simhash(spark, monkeypatch):
    rows = corpus(7, 40)
    base = rows[5][1]
    rows += [(2000 + i, base + " " + "e" * (i % 3)) for i in range(40)] + [(3000, "One two"), (3001, "one TWO"), (3002, " \t")]
    want = brute_simhash(rows)
    for chunk in (1024, 3):
        monkeypatch.setattr(simhash.split_buckets, "__defaults__", (chunk,))
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
        assert got == want
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, rows), simhash.near_duplicates(frame(spark, rows))).collect()}
    assert kept == {c for _, c in want.values()}


def test_simhash_odd_rows(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    got = sorted(((r.doc_id or 0), r.component_id) for r in simhash.near_duplicates(frame(spark, [(4, "a b"), (4, "a b"), (None, "a b"), (2, "c d")])).collect())
    assert got == [(0, 4), (2, 2), (4, 4), (4, 4)]


def test_components_of_a_long_path_and_a_hub(spark):
    rnd = random.Random(8)
    path = [(i, i + 1) for i in range(0, 200)]
    rnd.shuffle(path)
    links = path + [(500, 501 + i) for i in range(300)] + [(7, 7), (None, 3), (900, 901), (901, 900)]
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    node, root = local_components(*np.array([x for x in links if None not in x]).T)
    want = {int(a): int(b) for a, b in zip(node, root)}
    assert got == want


def test_query_digest(spark, tmp_path):
    from wayfold.llm.queries import QUERIES

    rows = corpus(9)
    frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_bytes(rows, 100)
    for r in QUERIES["op6_suffix_intervals"](spark, str(tmp_path)).collect():
        n, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_spans, r.n_removed, r.kept_sha256) == (n, spans, n - len(kept), hashlib.sha256(kept).hexdigest())
    want = brute_words(rows, 13)
    for r in QUERIES["op7_fm_substrings"](spark, str(tmp_path)).collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_rows_that_share_an_id(spark):
    """Words: an equal id is no smaller id. Bytes: one row counts as the earlier, for all passages alike."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, passages = [], []
    for i in range(12):
        passage = [" ".join(word() for _ in range(20)) for _ in range(3)]
        passages.append(passage)
        rows += [(i, " ".join([word(), passage[0], word(), passage[1], passage[2]])), (i, " ".join([passage[2], word(), passage[0], word(), passage[1]]))]
    rows += [(20, " ".join(passages[3])), (20, " ".join([word(), *passages[3]])), (21, " ".join(passages[4]))]
    got = {}
    for r in substring_dedup.dedup(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_words - len(words(r.kept_text))))
    want = {}
    first = {}
    for i, t in rows:
        w = words(t)
        for at in range(len(w) - 12):
            first[tuple(w[at: at + 13])] = min(i, first.get(tuple(w[at: at + 13]), i))
    for i, t in rows:
        w, gone = words(t), set()
        for at in range(len(w) - 12):
            if first[tuple(w[at: at + 13])] < i:
                gone.update(range(at, at + 13))
        want.setdefault(i, []).append((len(w), len(gone)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(g == 0 for i in range(12) for _, g in got[i])
    lost = {}
    for r in suffix_dedup.dedup(frame(spark, rows)).collect():
        lost.setdefault(r.doc_id, []).append(r.n_bytes - len(r.kept))
    assert all(sorted(x > 0 for x in lost[i]) == [False, True] for i in range(12))


def test_words_of_odd_texts():
    for text in ("", " ", "a", " a  b\n", "\x0b\x1cé\tü", "a b", "a b ", "x" * 5000 + " y", "\n\n", "a\nb"):
        parsed = substring_dedup.parse_words(text)
        own = words(text)
        assert parsed.raw == b" ".join(own) and len(parsed.hashes) == len(own)
        assert parsed.contents(np.arange(len(own)), np.arange(1, len(own) + 1)) == own
    many = [f"{a}{b}" for a in "abcxyz" for b in range(3000)] + ["a", "aa", "aaa", "\x00", "\x00\x00"]
    assert len(set(substring_dedup.parse_words(" ".join(many)).hashes.tolist())) == len(set(many))
