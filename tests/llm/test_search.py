"""License scan, ranked lexical search and the prefix trie."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from compare import SF, duck, normal
from pyspark.sql import functions as F

from tessera.llm import lexical, license_scan, prefix_trie, queries
from tessera.llm.license_rules import BASE, CONFIDENCE, Rule, rules

EXTRA = "doc_id long, text string, item long, n long, terms string, spans int, label string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, 8, "x", 9, "y") for i, t in rows], EXTRA)


# license scan


def words_of(text):
    folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def plain_scan(text, found):
    """Every rule on every text, every pair of detections compared."""
    words = words_of(text)
    line = "".join(f" {w}" for w in words) + " "
    spans = []
    for k, rule in enumerate(found):
        spaced = license_scan.compiled(rule.pattern).pattern.decode()
        for m in re.finditer(spaced, line):
            start = line[: m.start()].count(" ")
            spans.append((start, start + m.group().count(" ") - 1, k))
    better = lambda x: (found[x[2]].priority, x[0] - x[1], x[2])
    kept = [s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] and better(o) < better(s) for o in spans)]
    base = sorted((i, label) for phrase, label, _ in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    best = {}
    for *_, k in kept:
        best[found[k].label] = min(best.get(found[k].label, 9), found[k].priority)
    score = 1.0
    for label in sorted(best):
        score *= 1.0 - CONFIDENCE[best[label]]
    own = {label for _, label in base}
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | set(best))), round(1 - score, 9))


LICENSES = [
    (1, "Licensed under CC BY-NC 4.0."), (2, None), (3, ""), (4, "  ... \n"), (5, "cc by cc-by CC\nBY, all rights\treserved. All Rights Reserved"), (6, "// SPDX-License-Identifier: (MIT OR Apache-2.0)\n"),
    (7, "This work is licensed under the GNU\n * General Public License, version 3."), (8, "mit der Hilfe von cc and by"), (9, "é" + "cc by" + "é xcc by ccby"), (5, "cc by"), (None, "Alle Rechte vorbehalten, all rights reserved"),
    (10, "word " * 50_000 + "cc by " * 2_000 + "GNU GPL v2 or any later version"), (11, "see https://creativecommons.org/licenses/by-sa/4.0/ and http://www.apache.org/licenses/LICENSE-2.0"), (12, " CC BY cc by　"),
    (13, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to use, copy, modify, merge"),
    (14, "redistribution and use in source and binary forms, with or without modification, are permitted. Tous droits réservés. general public license"),
]


def scanned(rows):
    return Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in rows)


def test_license_scan_by_brute_force(spark):
    found = rules()
    rows = license_scan.report(docs(spark, LICENSES)).collect()
    few = [(i, t) for i, t in LICENSES if len(t or "") < 10_000]
    assert scanned(r for r in rows if r.doc_id != 10) == Counter((i, *plain_scan(t, found)) for i, t in few)
    long = next(r for r in rows if r.doc_id == 10)
    assert (long.n_words, long.n_base, long.first_word, long.last_word, long.base_labels) == (54_008 - 1, 2_000, 50_000, 53_998, "cc-by") and "gpl-2.0" in long.labels
    assert license_scan.report(docs(spark, [])).count() == 0


def test_license_scan_of_a_whole_table(spark):
    found = rules()
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert scanned(queries.op11_license_scan(spark, SF).collect()) == Counter((r.doc_id, *plain_scan(r.text, found)) for r in table.collect())


def test_license_base_columns_agree_with_sql(spark):
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    at = " union all ".join(
        f"select doc_id, k - 1 as pos, '{label}' as label from w, unnest(range(1, n + 1)) x(k) where words[k:k + {len(p.split()) - 1}] = {p.split()}" for p, label, _ in BASE
    )
    want = duck(f"""
with w as (select doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words, len(words) as n from documents), places as ({at})
select doc_id, n as n_words, count(pos) as n_base, min(pos) as first_word, max(pos) as last_word, coalesce(string_agg(distinct label, ',' order by label), '') as base_labels
from w left join places using (doc_id) group by all""")
    found = queries.op11_license_scan(spark, SF).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").toPandas()
    assert normal(found) == normal(want)


def test_license_labels(spark):
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan.report(docs(spark, [x for x in LICENSES if x[0] not in (None, 5, 10)])).collect()}
    assert got[1] == {"cc-by", "cc-by-nc-4.0"} and got[7] == {"gpl", "gpl-3.0"} and {"cc-by-sa-4.0", "apache-2.0"} <= got[11] and "mit" in got[6] and got[13] == {"mit"} and got[8] == {""} and got[9] == {""}


def test_suppression_is_by_rank_and_containment():
    own = (Rule(2, "long", "a", "a b c d"), Rule(1, "short", "b", "b c"), Rule(2, "inside", "c", "c d"), Rule(2, "over", "d", "d e"), Rule(1, "same", "b", "b c"))
    held = {s[3] for s in license_scan.detections(b"A, b c; d. e", own)[1] if s[-1]}
    assert held == {"long", "short", "over"}  # the better rule stays inside the longer, overlaps stay, equal ones go by order


def test_rules_need_their_keywords():
    """A rule's pattern can't match where its keyword is not among the words."""
    found = rules()
    assert len(found) > 300
    for rule in found:
        assert re.search(rf"(?<![a-z0-9]){re.escape(rule.keyword)}(?![a-z0-9])", rule.pattern), rule


def test_many_detections_take_linear_time():
    found = rules()
    text = b"licensed under the gnu lesser general public license cc by sa " * 20_000
    n, spans = license_scan.detections(text, found)
    assert n == 220_000 and sum(s[5] for s in spans) == 40_000


# lexical search

ITEMS = [(1, "alpha beta alpha"), (2, "gamma"), (3, None), (4, "!!!"), (5, "zeta missing words"), (5, "zeta missing words"), (6, "alpha"), (6, "beta"), (None, "Gamma  delta"), (7, "ÀÉ x")]
TEXTS = [
    (1, "alpha beta"), (2, "Alpha, BETA; alpha"), (3, None), (4, ""), (5, " ... "), (6, "gamma gamma gamma"), (7, "gamma"), (8, "gamma"), (8, "gamma"), (None, "gamma"), (9, "x àÉ ÀÉ"), (10, "delta zeta " * 40_000), (11, "zeta"),
    (12, "beta " * 50), (13, "alpha beta"), (14, "alpha beta"), *[(k, "alpha and beta") for k in range(20, 40)],
]


def plain_search(documents, items, k=10):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    held = [(i, Counter(w), len(w)) for i, t in documents if (w := fold(t))]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, own, _ in held for t in own)
    out = []
    for item, text in set(items):
        found = []
        for doc, own, size in held:
            m = 100 - 75 + ((75 * size * n) // length)
            score = sum(int(np.floor(1000 * np.log((2 * n + 2) / (2 * df[t] + 1)))) * ((1_000_000_000 * own[t]) // (1000 * own[t] + 8 * m)) for t in fold(text) if t in own)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_lexical_by_brute_force(spark, monkeypatch):
    items = spark.createDataFrame([(i, t, 1, "z") for i, t in ITEMS], "item_id long, text string, item int, doc_id string")
    want = plain_search(TEXTS, ITEMS)
    for lane, read, band in ((65_536, 64, 8 << 20), (4, 1, 8 << 20), (3, 2, 10)):  # many lanes, short reads, several bands
        monkeypatch.setattr(lexical, "LANE_ROWS", lane)
        monkeypatch.setattr(lexical, "FIRST_READ", read)
        got = lexical.rank_documents(docs(spark, TEXTS).repartition(3), items, band_bytes=band).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert lexical.rank_documents(docs(spark, []), items).count() == 0
    assert lexical.rank_documents(docs(spark, TEXTS), items.limit(0)).count() == 0


def test_lexical_agrees_with_sql(spark):
    assert normal(queries.op12_lexical(spark, SF).toPandas()) == normal(duck(lexical.ORACLE))


def test_nra_reads_little_where_impacts_are_skewed():
    rng = np.random.default_rng(3)
    rows = 20_000
    lists = []
    for _ in range(4):
        value = np.sort((1e9 / (1 + np.arange(rows)) ** 1.2).astype(np.int64))[::-1]
        lists.append((np.concatenate([rng.permutation(100), 100 + rng.permutation(rows - 100)]), value))  # the best agree, the rest does not
    full = np.zeros(rows, np.int64)
    for row, value in lists:
        full[row] += value
    at, scores, read = lexical.nra(lists, rows, 10, np.zeros(0, np.int64))
    best = sorted(zip(-scores, at))[:10]
    assert best == sorted(zip(-full, range(rows)))[:10]
    assert read < 4 * rows / 5
    assert lexical.nra(lists, rows, 10, np.full(10, 1 << 40))[2] == 4 * lexical.FIRST_READ  # a better best k from elsewhere ends it at once


@pytest.mark.parametrize("seed", range(30))
def test_nra_is_exact_with_ties(seed):
    rng = np.random.default_rng(seed)
    rows, lists = int(rng.integers(1, 300)), []
    full = np.zeros(rows, np.int64)
    for _ in range(rng.integers(1, 6)):
        row = rng.permutation(rows)[: rng.integers(1, rows + 1)]
        value = np.sort(rng.integers(1, 6, len(row)))[::-1]
        full[row] += value
        lists.append((row, value))
    at, scores, _ = lexical.nra(lists, rows, 5, np.zeros(0, np.int64))
    want = sorted((-s, r) for r, s in enumerate(full) if s > 0)[:5]
    assert sorted(zip(-scores, at))[:5] == want and (scores == full[at]).all()


# prefix trie


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = (role or "", text or "")
            code = hashlib.sha256(f"{len(key[0].encode())}:{key[0]}{key[1]}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, code, key))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:]
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        has_child = {p[:-1] for p in nodes if p}
        ended = sorted(c for c in members if len(built[c]) == len(path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(p[:-1] == path for p in nodes if p), sum(p not in has_child for p in below),
            sum((len(nodes[p]) - 1) * words(p) for p in below), hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 3) for r in rows], "conv_id long, turn long, role string, text string, seq int, key string, n int")


def random_talk(seed, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for c in map(int, rng.choice(400, n, replace=False)):
        for turn in range(int(rng.integers(1, 7))):
            rows.append((c, None if rng.random() < 0.1 else turn, None if rng.random() < 0.1 else "ab"[turn % 2], [None, "", "a b", "c", "a b"][int(rng.integers(0, 5))]))
    return rows


ODD_TALK = [
    (None, 1, "a", "b"), (0, None, None, None), (0, 1, "a", "x"), (0, 1, "a", "x"), (0, 1, "b", "x y"), (1, 5, "a", "word " * 30_000), (2, 5, "a", "word " * 30_000), (3, 0, "a", "x"), (20, 0, "", ""), (23, 0, "a", "only"), (24, 0, "a", "only"),
    *[(k, t, "a", f"copy {t}") for k in range(1000, 1400) for t in range(3)], *[(5000, t, "a", str(t % 3)) for t in range(500)], (-3, 0, "a", "minus"),
]


@pytest.mark.parametrize("rows", [random_talk(1), random_talk(2, 40), ODD_TALK, [(23, 0, "a", "x")]])
def test_trie_by_brute_force(spark, monkeypatch, rows):
    want = plain_trie(rows)
    for block in (100_000, 20):
        monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block)
        monkeypatch.setattr(prefix_trie, "IDS", 4096 if block > 20 else 3)
        got = prefix_trie.trie(talk(spark, rows))
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(talk(spark, [])).count() == 0
    assert prefix_trie.trie(talk(spark, [(None, 1, "a", "b")])).count() == 0


def test_trie_agrees_with_sql(spark):
    assert normal(queries.op13_prefix_trie(spark, SF).toPandas()) == normal(duck(prefix_trie.ORACLE))
    odd = pd.DataFrame([r for r in ODD_TALK if r[0] != 5000], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    assert normal(prefix_trie.trie(talk(spark, [r for r in ODD_TALK if r[0] != 5000])).toPandas()) == normal(duck(prefix_trie.ORACLE, conversations=odd))


@pytest.mark.parametrize("seed", range(20))
def test_extents_are_those_of_a_plain_walk(seed):
    rng = np.random.default_rng(seed)
    shared = rng.integers(0, 5, int(rng.integers(1, 70)))
    row, depth = rng.integers(0, len(shared), 50), rng.integers(0, 6, 50)
    left, right = prefix_trie.extents(prefix_trie.sparse_table(shared), row, depth)
    for r, d, a, b in zip(row, depth, left, right):
        x = y = r
        while x > 0 and shared[x] >= d:
            x -= 1
        while y + 1 < len(shared) and shared[y + 1] >= d:
            y += 1
        assert (a, b) == (x, y)
    low = prefix_trie.lowest(prefix_trie.sparse_table(shared), left, right)
    assert low.tolist() == [shared[a : b + 1].min() for a, b in zip(left, right)]
