"""Training-data operators against brute force on small fixtures, with the awkward rows:
nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import re

import pytest

from dealgrid.llm import (
    decontaminate, jaccard_join, language_id, license_scan, line_dedup, quality_rules, source_mix, toxicity, url_filter, warc)
from oracle_check import compare, duck_conn, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w30 ", "x30 ")
LONG = " ".join(f"l{i % 977}q{i % 31}" for i in range(400_000))
TEXTS = [(1, BASE), (2, NEAR), (3, BASE.upper()), (4, None), (5, ""), (6, "one two"), (7, "ONE  two\n"), (None, BASE),
         (8, "\t \n"), (2, NEAR), (9, "é" * 50 + "\nshared line of more than forty characters here\n"), (10, LONG),
         (11, "one two three four five six")]
SCHEMA = "doc_id long, text string, n_shingles string, score string, bucket string"


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x", None, "y") for i, t in rows], SCHEMA)


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("name", ["op2_url_filter", "op4_ngram_jaccard_join", "op5_line_dedup", "op8_warc", "op9_source_mixing",
                                  "op10_quality_rules"])
def test_query_equals_sql(spark, name):
    from dealgrid.llm.registry import ORACLE, QUERIES
    assert compare(*spark_rows(QUERIES[name](spark, SF)), *duck_rows(duck_conn(SF), ORACLE[name])) is None


def test_jaccard_join_equals_all_pairs(spark):
    got = jaccard_join.jaccard_classes(docs(spark)).collect()
    sets = [shingles(t) for _, t in TEXTS]
    root = list(range(len(TEXTS)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    low = {r: min((TEXTS[i][0] for i in range(len(TEXTS)) if root[i] == r and TEXTS[i][0] is not None), default=None) for r in root}
    want = sorted((str(TEXTS[i][0]), len(sets[i]), low[root[i]] if sets[i] else TEXTS[i][0]) for i in range(len(TEXTS)))
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == want
    assert low[root[0]] == low[root[1]] == 1


def linked(texts, ids):
    """(doc_id, n_shingles, component_id) by all pairs."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    low = {r: min(ids[i] for i in range(len(ids)) if root[i] == r) for r in root}
    return sorted((ids[i], len(sets[i]), low[root[i]]) for i in range(len(ids)))


@pytest.mark.parametrize("bits", [64, 5])
def test_jaccard_join_with_common_passages_and_clashing_names(spark, monkeypatch, bits):
    """Short texts that share a passage, a chain and many variants of one text, with small
    parts, so that every path runs; 5 bits: nearly all sets share their short names."""
    import random
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for k in range(60):
        own = [f"o{k}_{i}" for i in range(rng.randrange(3, 40))]
        texts.append(" ".join(own + passage if k % 2 else passage + own))
        if k % 3 == 0:
            texts.append(" ".join(own[:-1] + ["changed"] + passage if k % 2 else passage + own[:-1] + ["changed"]))
    base = [f"b{i}" for i in range(120)]
    for k in range(40):
        there = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 4)):
            there[at] = f"x{k}"
        texts.append(" ".join(there))
    for k in range(30):
        base = base[3:] + [f"c{k}_{i}" for i in range(3)]
        texts.append(" ".join(base))
    ids = rng.sample(range(1000), len(texts))
    monkeypatch.setattr(jaccard_join, "PART", 6)
    portions = jaccard_join._portions
    assert [len(x) for x in portions(range(10), lambda x: 1, 4)] == [4, 4, 2] and not list(portions([], len))
    frame = docs(spark, list(zip(ids, texts))).coalesce(2)
    assert len(jaccard_join._common_keys(frame.select("doc_id", "text"), 5, 80, 100, bits, frozenset()))
    got = jaccard_join.jaccard_classes(frame, bits=bits).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked(texts, ids)


@pytest.mark.parametrize("bits", [64, 5])
def test_jaccard_links_are_all_pairs(spark, monkeypatch, bits):
    """Variants of one text, all in one component, copies among them: every link counts."""
    import random
    rng = random.Random(7)
    texts = []
    for k in range(30):
        there = [f"b{i}" for i in range(120)]
        for at in rng.sample(range(120), rng.randrange(0, 4)):
            there[at] = f"x{k}"
        texts += [" ".join(there)] * rng.choice((1, 1, 2))
    texts += [None, "", "one two", "one two", BASE, NEAR]
    monkeypatch.setattr(jaccard_join, "PART", 6)
    links, members = jaccard_join.jaccard_links(docs(spark, list(enumerate(texts))).coalesce(2), bits=bits)
    sets = [shingles(t) for t in texts]
    near = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and 100 * len(a & b) >= 80 * len(a | b)}
    got = members.collect()
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in got) == [(i, len(s), sum(x == i for x, _ in near)) for i, s in enumerate(sets)]
    node = {r.doc_id: r.node for r in got}
    want = {(min(node[i], node[j]), max(node[i], node[j])) for i, j in near if sets[i] != sets[j]}
    assert sorted((r.a, r.b) for r in links.collect()) == sorted(want) and len(want) > 40


def test_block_keys_meet_at_the_limit():
    """Random sets at the similarity limit share a key in the band of the smaller one."""
    import numpy as np
    rng = np.random.default_rng(1)
    for n in [1, 4, 5, 9, 40, 63, 64, 65, 100, 127, 128, 300, 1000, 5000]:
        for _ in range(5):
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            lost = n // 9  # swapped shingles that keep 100 * both >= 80 * either
            b = np.unique(np.concatenate([a[rng.permutation(n)[:n - lost]], rng.integers(0, 1 << 64, lost, dtype=np.uint64)]))
            assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
            assert len(np.intersect1d(jaccard_join.set_keys(a, 80, 100), jaccard_join.set_keys(b, 80, 100)))
            grown = np.unique(np.concatenate([a, rng.integers(0, 1 << 64, n // 4, dtype=np.uint64)]))
            assert len(np.intersect1d(jaccard_join.set_keys(a, 80, 100), jaccard_join.set_keys(grown, 80, 100)))
            common = np.sort(jaccard_join.set_keys(a, 80, 100, whole=True)[::2])  # any list of common keys will do
            assert len(np.intersect1d(jaccard_join.set_keys(a, 80, 100, common), jaccard_join.set_keys(b, 80, 100, common)))
            assert len(np.intersect1d(jaccard_join.set_keys(a, 80, 100, common), jaccard_join.set_keys(grown, 80, 100, common)))


def test_empty_tables(spark):
    none = docs(spark, [])
    assert jaccard_join.jaccard_classes(none).count() == 0
    assert line_dedup.line_dedup_report(none).count() == 0 and line_dedup.dedup_lines(none).count() == 0
    assert quality_rules.quality_report(none).count() == 0 and license_scan.scan_licenses(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs(spark), items).count() == 0 and decontaminate.without_leaks(docs(spark), items).count() == len(TEXTS)
    machine = toxicity.train(docs(spark), labels)
    assert {r.predicted for r in toxicity.score(docs(spark), machine).collect()} == {0}
    assert toxicity.without_toxic(docs(spark), machine).columns == docs(spark).columns
    unknown = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.identify(unknown, language_id.train(unknown)).collect()] == ["und"]
    mixed = source_mix.mix(spark.createDataFrame([], "doc_id long, text string, source string"), source_mix.label_weights(labels))
    assert mixed.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_urls(pages, url_filter.rule_frame(spark)).count() == 0


def test_line_dedup_equals_brute_force(spark):
    line = "  Shared LINE of more than forty characters, in many texts \t"
    rows = [(i, f"own {i}\n{line}\nshort\n{line.lower()}") for i in range(1, 7)] + [(7, None), (8, ""), (None, line), (6, line), (9, "a\r\nb")]
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup_report(docs(spark, rows), batches=3).collect()}
    want = set()
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i in (6, None) or len(x.strip(" \t\n\x0b\x0c\r")) < 40]
        want.add((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    assert got == want
    out = line_dedup.dedup_lines(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert {r.text for r in out.collect() if r.doc_id == 1} == {"own 1\nshort"} and None in {r.text for r in out.collect()}


def test_line_runs_merge_levels(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for b in range(4):
        runs.add(spark.createDataFrame([(10 - b, 1, 1), (10 - b, 2, b)], "doc_id long, h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert [tuple(r) for r in runs.frequent(4).collect()] == [(1, 1, 10)]


def test_quality_edges(spark):
    rows = {r.doc_id: r for r in quality_rules.ledger(docs(spark, [(1, None), (2, "a b c a b c x"), (3, "l é\nl é\n \n \nl é"), (4, "#a $ %|")])).collect()}
    assert (rows[1].n_words, rows[1].fail_bits) == (0, 1)
    assert rows[2].n_repeat_words == 6
    assert (rows[3].n_dup_lines, rows[3].n_lines, rows[3].word_chars, rows[3].n_repeat_words) == (2, 3, 6, 6)
    assert rows[4].n_symbols == 4
    ledger = quality_rules.ledger(docs(spark))
    cut = {r.rule: (r.failed, r.only) for r in quality_rules.ablations(ledger, "strict-1").collect()}
    fails = [r.fail_bits for r in ledger.collect()]
    for i, rule in enumerate(quality_rules.RULES):
        assert cut[rule] == (sum(f >> i & 1 for f in fails), sum(f == 1 << i for f in fails))


def test_decontamination_finds_planted_windows(spark):
    items = spark.createDataFrame([(1, BASE), (2, "few words only"), (3, None), (4, " ".join(f"z{i}" for i in range(200)))],
                                  "item_id long, text string")
    long_item = [f"z{i}" for i in range(200)]
    edited = long_item[:70] + ["new"] + long_item[71:150] + ["word"] + long_item[151:]
    texts = [(1, "before " * 37 + BASE.upper() + " after" * 9), (2, "few  WORDS only"), (3, "some few words only here"),
             (4, " ".join(["k"] * 11 + edited + ["e"] * 5)), (5, " ".join(long_item[:100])), (None, BASE), (6, None), (7, LONG)]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in decontaminate.leaks(docs(spark, texts), items).collect()}
    assert set(got) == {(1, 1), (2, 2), (4, 4), (None, 1)}
    assert got[1, 1] == (1.0, 37, 60) and got[None, 1] == (1.0, 0, 60)
    assert got[4, 4][0] == pytest.approx((196 - 10) / (196 + 10)) and got[4, 4][1] == 11
    kept = {r.doc_id for r in decontaminate.without_leaks(docs(spark, texts), items).collect()}
    assert kept == {3, 5, 6, 7}


def test_decontamination_equals_all_windows(spark):
    """Items with parts swapped, inserted, deleted, doubled and cut by the text's ends, and
    items that repeat words, against every item-sized window."""
    import random
    from collections import Counter
    rng = random.Random(5)
    items, texts = {}, []
    for k, n in enumerate([12, 30, 40, 55, 59, 63, 90, 150, 300]):
        items[k] = [f"i{k}_{i if k % 4 else i % (n - 5)}" for i in range(n)]
        for kind in ("swap", "swap", "thirds", "insert", "delete", "double", "cut", "same"):
            w, at = list(items[k]), rng.randrange(n // 4, 3 * n // 4)
            if kind == "swap":
                w = w[at:] + w[:at]
            elif kind == "thirds":
                w = w[2 * n // 3:] + w[n // 3:2 * n // 3] + w[:n // 3]
            elif kind == "insert":
                w = w[:at] + [f"x{i}" for i in range(n // 20 + 1)] + w[at:]
            elif kind == "delete":
                w = w[:at] + w[at + n // 20 + 1:]
            elif kind == "double":
                w = w[at:] + w + w[:at]
            elif kind == "cut":
                w = w[n // 10:]
            fill = [[f"f{rng.randrange(50)}" for _ in range(0 if kind == "cut" and i == 0 else rng.randrange(40, 90))] for i in range(2)]
            texts.append((len(texts), " ".join(fill[0] + w + fill[1])))

    def grams(w):
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    want = {}
    for i, t in texts:
        text = grams(t.split())
        for k, w in items.items():
            own, n = Counter(grams(w)), len(w) - 4
            best = (0, 0)
            for s in range(1 - n, len(text)):
                part = text[max(s, 0):s + n]
                both = (own & Counter(part)).total() if own.keys() & set(part) else 0
                if 100 * both >= 80 * (n + len(part) - both):
                    best = max(best, (both / (n + len(part) - both), -max(s, 0)))
            if best[0]:
                want[i, k] = (best[0], -best[1], len(w))
    assert len(want) >= 50
    given = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in decontaminate.leaks(docs(spark, texts), given).collect()}
    assert got == want
    kept = {r.doc_id for r in decontaminate.without_leaks(docs(spark, texts), given).collect()}
    assert kept == {i for i, _ in texts} - {i for i, _ in want}


def test_toxicity_learns_on_held_out_rows(spark):
    clean = [f"plain words number {i} in a text of its own" for i in range(600)]
    rows = [(i, t + (" you idiot" if i % 5 == 1 else "")) for i, t in enumerate(clean)] + [(None, None), (9999, "")]
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    frame = docs(spark, rows)
    out = {r.doc_id: r for r in toxicity.score(frame, toxicity.train(frame, labels)).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id < 600]
    assert len(held) > 60 and all(r.predicted == int(r.doc_id % 5 == 1) for r in held)
    assert 0 <= out[9999].score < 0.5 and out[None].held_out is False


def test_machine_equals_pairwise_sum():
    import numpy as np
    m = toxicity.FactorizationMachine(np.zeros(1), 5, 0.3)
    m.weights[:] = [1, -2, 0.5, 3, 0]
    m.factors[:] = np.arange(20).reshape(5, 4) / 10
    slots = [0, 2, 3]
    want = 0.3 + sum(m.weights[slots]) + sum(m.factors[a] @ m.factors[b] for a in slots for b in slots if a < b)
    assert m.logits(np.zeros(3, int), np.array(slots), 1)[0] == pytest.approx(want)


def test_language_of_mixed_text(spark):
    en, de = "the house and the garden with some old trees".split(), "der hund und die katze auf einem alten haus".split()
    rows = [(i, " ".join((en if i % 2 else de)[(j * 7 + i) % 9] for j in range(30)), "en" if i % 2 else "de") for i in range(300)]
    rows += [(900, None, None), (901, "123 !!", "en"), (902, " ".join(en * 3 + de), None), (None, " ".join(de), "de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = language_id.train(frame)
    out = {r.doc_id: r for r in language_id.identify(frame, field).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows[:300])
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[None].lang_pred == "de"
    assert out[902].lang_pred == "en" and 0.6 < out[902].score < 0.9


def test_forward_backward_equals_enumeration():
    import itertools
    import numpy as np
    f = language_id.WordField(["a", "b"])
    f.moves[:] = [[0.7, -0.2], [0.1, 0.4]]
    e = np.random.default_rng(0).normal(size=(4, 1, 2))
    prob, _ = f.marginals(e, np.ones((4, 1), bool))
    want = np.zeros((4, 2))
    for path in itertools.product((0, 1), repeat=4):
        p = np.exp(sum(e[t, 0, x] for t, x in enumerate(path)) + sum(f.moves[a, b] for a, b in zip(path, path[1:])))
        for t, x in enumerate(path):
            want[t, x] += p
    assert np.allclose(prob[:, 0], want / want.sum(axis=1, keepdims=True))


def test_licenses_equal_plain_search(spark):
    notice = license_scan.TEMPLATES
    rows = [(1, f"a b c {notice['GPL-3.0']} d e"), (2, notice["MIT"].lower() + " x " * 50 + notice["MIT"]), (3, None), (4, "Released under the law"),
            (5, " ".join(f"t{i}" for i in range(997)) + " " + notice["MIT-grant"].replace("Software\"),", "Software\") ")), (None, notice["Apache-2.0"]), (6, LONG)]
    got = {(r.doc_id, r.license): (round(r.containment, 3), r.start_word) for r in license_scan.scan_licenses(docs(spark, rows)).collect()}
    want = {}
    for i, t in rows:
        for name, text in notice.items():
            part = len(shingles(text) & shingles(t)) / len(shingles(text))
            if part >= 0.8:
                want[i, name] = round(part, 3)
    assert {k: v[0] for k, v in got.items()} == want
    assert got[1, "GPL-3.0"][1] == 3 and got[2, "MIT"][1] == 0


def test_license_texts_and_short_lines(spark):
    from dealgrid.llm.license_texts import TEXTS
    fill = " ".join(f"t{i}" for i in range(700))
    lines = {"MIT (licensed under the MIT License)": "Licensed under the MIT License", "Reserved (All rights reserved.)": "All rights reserved.",
             "BSD-3-Clause (SPDX)": "SPDX-License-Identifier: BSD-3-Clause", "GPL-3-header": license_scan.REGISTERED["GPL-3-header"]}
    lines |= {f"{name}-text": text for name, text in TEXTS.items()}
    assert {"MIT", "BSD-3-Clause", "MPL-2.0", "LGPL-2.1", "ISC", "Apache-2.0", "GPL-3.0"} <= set(TEXTS)
    rows = [(i, f"{fill} {line} {fill}") for i, line in enumerate(lines.values())]
    got = {(r.doc_id, r.license): (r.containment, r.start_word) for r in license_scan.scan_licenses(docs(spark, rows)).collect()}
    for i, name in enumerate(lines):
        assert got[i, name] == (1.0, 700), name
    custom = license_scan.scan_licenses(docs(spark, [(1, "x All Rights reserved. y all rights reserved."), (2, "all rights"), (3, "all rights reserved.")]),
                                        {"r": "All rights reserved."}).collect()
    assert sorted((r.doc_id, r.start_word, r.n_places) for r in custom) == [(1, 1, 2), (3, 0, 1)]


def test_url_edges(spark):
    urls = ["https://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "ftp://x.net/fr/1", "http://x.net", "no scheme", None, "http:///en/",
            "https://example.com.evil.org/en/", "https://notexample.com/en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[2], "a"), (0, urls[0], "b")], "page_id long, url string, host string")
    rows = url_filter.judge_urls(pages, url_filter.rule_frame(spark)).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls) + 2
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][3] == got[None][3] == "block" and got[3] == ("x.net", "", None, "allow")
    assert got[4] == got[5] == ("", "", None, "allow") and got[6] == ("", "/en/", None, "allow")
    assert got[7][2:] == (None, "allow") and got[8][2:] == ("com/", "allow")


def test_warc_round_trip(spark, tmp_path):
    big = "é€" * 400 + "\r\nWARC/1.1\r\n\r\n" + "x\r" * 300 + "\r"
    html = [(1, big), (2, big), (5, big), (3, None), (4, ""), (6, "a\r\n"), (7, "\n\r"), (8, "small"), (9, "small"), (None, big), (10, "q" * 5000), (5, big)]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\n", h, "k") for i, h in html], "page_id long, url string, html string, keep string")
    warc.write_warc(pages.repartition(2), str(tmp_path / "w"), chunk=97)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    want = []
    for i, h in html:
        raw = (h or "").encode()
        again = h == big and i != 5
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert got == sorted(want, key=lambda x: x[:4])


def test_warc_files_hold_whole_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 3, raising=False)
    html = [(i, chr(97 + i) * (50 + 97 * i)) for i in range(12)]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in html], "page_id long, url string, html string")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        warc.write_warc(pages.coalesce(1), str(tmp_path / "w"), chunk=97)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    assert got == [(i, len(h), hashlib.sha1(h.encode()).hexdigest()) for i, h in html]


def test_mix_reaches_targets(spark):
    rows = [(i, "w " * (1 + i % 9), "a" if i % 3 else ("b" if i % 2 else None)) for i in range(900)] + [(None, None, "c"), (5000, "", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = source_mix.mix(frame).collect()
    assert sorted(out, key=str) == sorted(source_mix.mix(frame.repartition(5)).collect(), key=str) and len(out) == len(rows)
    for s in ("a", "b", None):
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 9 and own[0].target <= 3 * own[0].source_size
        assert all(r.taken <= 3 * r.size for r in own)
    assert sum({r.source: r.target for r in out}.values()) == pytest.approx(sum(r.size for r in out))


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline
    from dealgrid.llm.common import table, written
    docs_in = table(spark, SF, "documents")
    frame = docs_in
    leaked = {r.doc_id for r in decontaminate.leaks(docs_in, table(spark, SF, "benchmark")).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, frame, SF), name)
        assert after.columns == docs_in.columns
        before = {r.doc_id for r in frame.select("doc_id").collect()}
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        if name == "ngram_jaccard_join":
            sets = [shingles(r.text) for r in after.collect()]
            assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        if name == "benchmark_decontamination":
            assert decontaminate.leaks(after, table(spark, SF, "benchmark")).count() == 0 and not leaked & set(ids)
        frame = after
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == frame.count()
