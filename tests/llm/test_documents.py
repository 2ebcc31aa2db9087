import zlib

import numpy as np
import pytest
from compare import SF, duck, normal
from pyspark.sql import functions as F

from tessera.llm import chat, line_dedup, lm_scoring, mixing, near_copies, packing, queries, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bin long, rank int, gone int"
LONG = "word " * 30_000
ODD = [
    (1, "one two three four five six seven"), (2, None), (3, ""), (4, " \n\t "), (5, "one two"), (6, LONG), (7, LONG), (8, "ÀÉ x"), (9, "<|endoftext|> it's  a\n\n b\t "),
    (1, "one two three four five six seven"), (None, "no id here at all"), (None, None), (10, "ONE two three four five six seven"),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1, 2, 3) for i, t in rows], SCHEMA)


def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# packing


def test_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for _, text in [*ODD, (0, "a<|endoftext|>\n <|endoftext|><|endoftext|> b"), (0, "<|endoftext|>"), (0, " <|endoftext"), (0, "\u3000x\u00a0 1 2\r\n\t🙂 'S")]:
        assert np.frombuffer(packing.token_bytes(text), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def check_packed(rows, documents):
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for i, text in documents:
        ids = packing.token_bytes(text) + np.array([2], "<u4").tobytes()
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for k, r in enumerate(own):
            assert r.start == at and (k == 0 or r.length == 1024) and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(ids)
    return seqs


def test_packing(spark):
    rows = packing.pack_documents(docs(spark)).collect()
    single = [x for x in dict(ODD).items() if x[0] not in (1, None)]
    check_packed([r for r in rows if r.doc_id not in (1, None)] and rows, single)
    assert sum(r.doc_id == 1 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_packing_by_brute_force(spark):
    """Every piece against the tokenizer itself, on whole test documents."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    table = sf_docs(spark)
    want = set()
    for r in table.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want |= {(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = packing.pack_documents(table).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in filled.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024


def test_packing_is_near_the_bound(spark):
    rows = packing.pack(packing.pieces(sf_docs(spark)), group_items=40).collect()
    seqs = {r.sequence_id for r in rows}
    bound = packing.lower_bound(np.array([r.length for r in rows]))
    assert bound <= len(seqs) <= bound * 1.02 + 2


def test_lower_bound_is_below_best_fit():
    rng = np.random.default_rng(0)
    for k in range(200):
        sizes = rng.integers(1, 1025, rng.integers(0, 40)) if k % 2 else rng.integers(340, 520, 30)
        bins, offsets, n = packing.best_fit(sizes)
        assert packing.lower_bound(sizes) <= n and (np.bincount(bins, weights=sizes, minlength=1) <= 1024).all()
    assert packing.lower_bound(np.array([513] * 7)) == 7 and packing.lower_bound(np.array([342] * 4)) == 2


# near-dedup


def brute_components(rows):
    prints = [(i, simhash.fingerprint((t or "").encode())) for i, t in rows if i is not None]
    label = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprint_by_hand():
    import xxhash

    words = "a B c d e".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), 42) for k in range(2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 2)
    assert simhash.fingerprint(b"a  B\tc\x0bd\x0ce") == want
    assert simhash.fingerprint(b" \n") == 0 and simhash.fingerprint(b"a b") == xxhash.xxh64_intdigest("a b", 42)


def test_near_duplicates_on_odd_rows(spark):
    found = simhash.near_duplicates(docs(spark)).collect()
    assert len(found) == len(ODD)
    want = brute_components(ODD)
    for r in found:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.fingerprint == f"{simhash.fingerprint((dict(ODD)[r.doc_id] or '').encode()):016x}"
    kept = [r.doc_id for r in simhash.keep_first(docs(spark)).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(want.values())) and kept.count(None) == 2
    assert simhash.keep_first(docs(spark, [])).columns == docs(spark).columns and simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_of_large_groups_are_split(spark, monkeypatch):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 1 << 62))
    prints = {center}
    while len(prints) < 400:
        x = center
        for b in rng.choice(64, 3, replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 300)}
    rows = [(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(sorted(prints))]
    distinct = spark.createDataFrame(rows, "fp long, rep long").withColumn("coords", simhash.coordinates(F.col("fp")))
    monkeypatch.setattr("tessera.llm.common.HOT_ROWS", 20)
    found = [{r.node: r.root for r in simhash.components(simhash.links(distinct, tile_rows=32, agree=k)).collect()} for k in (None, 3, 4)]
    roots = found[0]
    assert found[1] == found[2] == roots
    want = {k: k for _, k in rows}
    values = np.array([x for x, _ in rows], np.int64).view(np.uint64)
    for _ in range(8):
        for k in range(len(values)):
            near = np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 4)
            want[k] = min(want[int(j)] for j in near)
    assert all(roots.get(k, k) == want[k] for k in want)


def test_segments_follow_the_count():
    assert simhash.agreeing(10**6) == 2 and simhash.agreeing(10**9) == 3 and simhash.agreeing(10**11) == 4
    rng = np.random.default_rng(6)
    for agree in (2, 3, 4):
        masks = simhash.segment_masks(4, agree)
        for _ in range(200):
            flipped = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not flipped & m for m in masks)


def test_coordinates_are_computed_once_and_discard_pairs(spark):
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 1 << 63, 300)
    got = spark.createDataFrame([(int(x),) for x in prints], "fp long").select("fp", simhash.coordinates(F.col("fp")).alias("c")).collect()
    for r in got:
        assert [(r.fp ^ p).bit_count() for p in simhash.pivots().tolist()] == [int(x) for x in np.array([r.c]).view(np.int8)]
    seen = {}
    simhash.near_pairs(np.zeros(300, np.int64), np.array([r.fp for r in got]).view(np.uint64), np.array([r.c for r in got]), seen=seen)
    assert seen["met"] == 300 * 299 // 2 and seen["compared"] < seen["met"] / 20


def test_a_hot_fingerprint_keeps_all_its_rows(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.common.HOT_ROWS", 5)
    rows = [(k, "" if k % 3 else f"text number {k} of its own words") for k in range(100)] + [(None, "")] * 3
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == 103 and all(r.component_id == 1 for r in got if r.doc_id is None or r.doc_id % 3)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**{k: 0 for k in range(1, 61)}, 101: 100}


def jaccard(a, b):
    one, two = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(one & two) / len(one | two)


def test_near_copies_are_held_to_their_similarity(spark):
    import random

    rng = random.Random(3)
    rows = []
    for k in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60, 200, 600]))]
        rows.append((3 * k, " ".join(words)))
        for c in (1, 2):
            for _ in range(max(1, len(words) // rng.choice([45, 55, 70, 140]))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((3 * k + c, " ".join(words)))
    label = {i: i for i, _ in rows}
    for k in range(120):
        own, near = rows[3 * k : 3 * k + 3], lambda a, b: jaccard(a[1], b[1]) >= 0.8
        for _ in range(3):
            for a in own:
                label[a[0]] = min(label[b[0]] for b in own if near(a, b))
    far = sum((simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 4 for (i, a), (j, b) in zip(rows, rows[1:]) if label[i] == label[j])
    assert far > 40 and len(set(label.values())) > 150
    for table in (rows, [(i, t) for i, t in rows] + rows[:5] + [(0, "other text " * 9)]):
        kept = sorted((r.doc_id, r.text) for r in near_copies.keep_first(docs(spark, table)).collect())
        assert kept == sorted([r for r in rows if label[r[0]] == r[0]] + table[len(rows) + 5 :])


def test_near_copies_meet_by_fingerprint_and_pivots(spark):
    """Without any band, texts whose fingerprints are within 4 bits still meet and are held to their similarity; others don't."""
    base = [f"w{k}" for k in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["end"])), (3, "another text of quite other words"), (4, " ".join(f"v{k}" for k in range(2000)))]
    table = docs(spark, rows)
    hashed = near_copies._hashed(table)
    nodes = hashed.select("node", "doc_id", "h", "size", F.array().cast("array<long>").alias("bands"), "fp").cache()
    name, prints = {r.node: r.doc_id for r in nodes.collect()}, {r.doc_id: r.fp for r in nodes.collect()}
    assert near_copies.links(table, nodes).count() == 0
    by_print = near_copies.print_groups(nodes)
    found = [{name[r.a], name[r.b]} for r in near_copies.links(table, nodes, by_print=by_print).collect()]
    assert found == [{1, 2}] and ((prints[1] ^ prints[2]) & (2**64 - 1)).bit_count() <= 4
    sets = {i: near_copies.shingles(t.encode(), {})[1].tolist() for i, t in rows}
    assert all(prints[i] & (2**64 - 1) == sum((2 * sum(h >> k & 1 for h in own) > len(own)) << k for k in range(64)) for i, own in sets.items())
    all_meet = nodes.select("node", "size", F.lit(near_copies.BANDS).alias("band"), F.lit(7).cast("long").alias("key"))
    assert [{name[r.a], name[r.b]} for r in near_copies.links(table, nodes, by_print=all_meet).collect()] == [{1, 2}]  # who meets is held to the similarity


def test_near_copies_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([(k, f"one two three four five six {k % 2}", f"h{k}", k, "r", k) for k in range(4)], "doc_id long, text string, _h string, node long, row string, root long")
    got = near_copies.keep_first(rows)
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.where("doc_id < 2").collect()))


def test_long_texts_take_time_in_proportion(spark):
    """Forty and a hundred and sixty thousand lines in one text, with the passage rule."""
    import time

    took = []
    for n in (40_000, 40_000, 160_000):
        text = "\n".join(f"line {k} of a long text" for k in range(n))
        table = docs(spark, [(1, text), (2, text[: len(text) // 2])])
        began = time.time()
        kept = {r.doc_id: len(r.text) for r in line_dedup.dedup(table, passage_words=50).collect()}
        took.append(time.time() - began)
        assert kept[1] == len(text) and kept[2] < 40
    assert took[2] < 10 * took[1] + 5


def test_large_groups_of_near_copies_are_split(spark):
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(100)] + [(200, "a text of its own")]
    table = docs(spark, rows)
    hashed = near_copies._hashed(table)
    nodes = hashed.select("node", "doc_id", "h", "size", "bands")
    found = near_copies.components(near_copies.links(table, nodes, tile_rows=16)).collect()
    assert len(found) == 99 and len({r.root for r in found}) == 1


# line dedup


def test_line_dedup_agrees_with_sql(spark):
    assert normal(line_dedup.report(sf_docs(spark)).toPandas()) == normal(duck(line_dedup.ORACLE))


def test_line_dedup_on_odd_rows(spark):
    passage = "\n".join(f"shared line {k} of a passage" for k in range(12))
    rows = [*[x for x in ODD if x[0] not in (6, 7)], (20, "own start\n" + passage + "\nown end"), (21, "another start here\nand more\n" + passage), (22, "x y\nz"), (6, LONG), (7, LONG)]
    found = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows), passage_words=50).collect()}
    assert len(found) == len({i for i, _ in rows}) and line_dedup.dedup(docs(spark, rows), passage_words=50).columns == docs(spark).columns
    assert found[20] == dict(rows)[20] and found[22] == "x y\nz" and found[2] is None and found[6] == LONG and found[7] == ""
    assert found[21].startswith("another start here") and len(found[21].split("\n")) < 8
    assert line_dedup.dedup(docs(spark, [])).count() == 0


def test_chunks_alone_leave_single_lines(spark):
    rows = [(1, "a line\n" + LONG), (2, LONG), (3, LONG)]
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows)).collect()} == dict(rows)
    assert [r.text for r in line_dedup.dedup(docs(spark, rows), passage_words=50).orderBy("doc_id").collect()] == [rows[0][1], "", ""]


def test_hot_chunks_are_split(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.common.HOT_ROWS", 5)
    passage = "\n".join(f"shared line {k} of a passage" for k in range(12))
    rows = [(k, f"{passage}\nown line {k}" if k % 3 else f"other {k}\n\nend {k}") for k in range(90)]
    found = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows), passage_words=50).collect()}
    assert found == {k: t if k < 2 or k % 3 == 0 else f"own line {k}" for k, t in rows}


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 and "array_join" in str(c[0]) else F.hash(*c).cast("long"))
    rows = [(k, "\n".join(f"text {k % 4} line {j} of it" for j in range(9))) for k in range(12)]
    found = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert all(found[k] == rows[k][1] for k in range(4)) and all(len(found[k]) < len(rows[k][1]) for k in range(4, 12))


def test_rows_with_one_id_or_none_keep_their_own_lines(spark):
    passage = "\n".join(f"shared line {k} of a passage" for k in range(12))
    own = ["\n".join(f"own line {k} of text {n}" for k in range(30)) for n in range(4)]
    rows = [(1, passage), (None, f"{own[0]}\n{passage}"), (None, own[1]), (None, "short\nrow"), (30, f"{own[2]}\n{passage}"), (30, own[3]), (30, own[3])]
    found = [(r.doc_id, r.text) for r in line_dedup.dedup(docs(spark, rows), passage_words=50).collect()]
    assert len(found) == len(rows)
    for row in (rows[2], rows[3], rows[5]):
        assert found.count(row) == rows.count(row)
    assert all(any(i == j and set(text.split("\n")) <= set(other.split("\n")) for j, other in found) for i, text in ((None, own[0]), (30, own[2])))
    assert line_dedup.report(docs(spark, rows)).count() == len(rows)


def test_passages_of_few_lines_go_whole(spark):
    import random

    rng = random.Random(11)
    line = lambda least, most: " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randint(least, most)))
    rows, want = [], {}
    for k in range(210):
        passage = [line(26, 45) if k % 7 < 1 else line(12, 45) for _ in range(2 + k % 7)]
        while sum(len(x.split()) for x in passage) <= 50:
            passage[0] = line(26, 45)
        for i in (2 * k, 2 * k + 1):
            own = [line(1, 45) for _ in range(rng.randint(1, 12))]
            at = rng.randint(0, len(own))
            rows.append((i, "\n".join(own[:at] + ([""] if k % 5 == 0 else []) + passage + own[at:])))
            want[i] = "\n".join(own if i % 2 else rows[-1][1].split("\n")).replace("\n\n", "\n").strip("\n")
    found = {r.doc_id: r.text.replace("\n\n", "\n").strip("\n") for r in line_dedup.dedup(docs(spark, rows), passage_words=50).collect()}
    assert found == want


def test_a_line_repeated_in_a_row_keeps_its_first_run(spark):
    row = " ".join(["word"] * 26)
    text = "\n".join(["first line", *[row] * 7, "last line"])
    found = line_dedup.dedup(docs(spark, [(1, text)]), passage_words=50).first().text.split("\n")
    assert found[0] == "first line" and found[-1] == "last line" and 2 <= found.count(row) <= 4


# mixing


def test_mixing(spark):
    rows = [(k, "w " * 20, ("hot" if k % 3 else f"s{k % 12}")) for k in range(600)] + [(601, None, None), (602, "a b c", None), (603, "", "blank")]
    table = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    shown = mixing.mix(table, repetition=2.0).toPandas()
    assert set(shown.doc_id) == {i for i, _, _ in rows}
    again = mixing.mix(table, repetition=2.0).toPandas()
    assert sorted(map(str, shown.values.tolist())) == sorted(map(str, again.values.tolist()))
    tokens = shown.groupby(shown.source.fillna("~")).tokens.sum()
    first = shown.drop_duplicates("doc_id").groupby(shown.source.fillna("~")).tokens.sum()
    seen = tokens / first
    assert seen["hot"] == 1 and seen[["s0", "s3", "s6", "s9"]].between(1.0, 2.1).all() and abs(seen["~"] - 2) < 0.6
    weights = shown[shown.weight > 0].drop_duplicates("source").weight
    assert abs(weights.sum() - 1) < 1e-9
    budget = mixing.mix(table, repetition=None, entropy=0.9, budget=3000).toPandas()
    share = budget.groupby(budget.source.fillna("~")).tokens.sum() / budget.tokens.sum()
    assert abs(budget.tokens.sum() - 3000) < 200 and (-(share * np.log(share)).sum()) > 0.85 * np.log(6)
    assert mixing.mixed_documents(table, repetition=2.0).count() == len(shown)
    assert mixing.mix(table.limit(0)).count() == 0


def test_mixing_by_brute_force(spark):
    """The plan and every shown row replayed one document at a time; Spark gives the hashes alone."""
    import math
    from collections import defaultdict

    names = {"s0": 40, "s1": 90, "hot": 400, "big": 200}
    rows = [(k, "w " * (1 + k * 7 % 30), name) for name, n in names.items() for k in range(1000 * len(name), 1000 * len(name) + n)] + [(9, "w " * 50_000, "long"), (8, "", "hot")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for repetition, budget in ((2.0, None), (1.3, 20_000)):
        seed, blocks = mixing.SEED, mixing.BLOCKS
        made = table.select(
            "doc_id", "source", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)).cast("int").alias("block"), F.xxhash64("doc_id", F.lit(seed + 2)).alias("place"),
        ).withColumn("turn", F.xxhash64("block", "source", F.lit(seed + 1))).collect()
        size = {(i, s): len(t.split()) for i, t, s in rows}
        total = defaultdict(int)
        for (_, s), n in size.items():
            total[s] += n
        share = {s: n / sum(total.values()) for s, n in total.items()}
        spread = math.log(max(share.values()) / min(share.values()))
        power = max(0.0, 1 - math.log(repetition) / spread)
        raw = {s: x**power for s, x in share.items()}
        least = min(raw[s] / total[s] for s in raw)
        target = {s: raw[s] / least if budget is None else budget * raw[s] / sum(raw.values()) for s in raw}
        found = mixing.mix(table, repetition=repetition, budget=budget)
        plan = {s: n for s, n in target.items()}
        shown = defaultdict(int)
        for r in found.collect():
            shown[r.doc_id, r.source] += 1
        for s in total:
            spent = sum(size[k] * n for k, n in shown.items() if k[1] == s)
            most = max(n for k, n in size.items() if k[1] == s)
            assert plan[s] * 0.999 - 2 <= spent <= plan[s] * 1.001 + most, (s, spent, plan[s])
            whole = int((spent - most) // total[s]) if spent > most else 0
            order = sorted((r for r in made if r.source == s), key=lambda r: (r.turn, r.block, r.place, r.doc_id))
            times = [shown[r.doc_id, s] for r in order]
            assert max(times) - min(times) <= 1 and min(times) >= whole and times == sorted(times, reverse=True), s  # a prefix of the permuted blocks once more
    assert sum(shown.values()) > 0


def test_columns_of_the_mix_may_clash(spark):
    table = spark.createDataFrame([(k, "a b", f"s{k % 2}", 1, 2, 3, 4, 5) for k in range(20)], "doc_id long, text string, source string, times int, row int, mix_id int, tokens int, block int")
    made = mixing.mixed_documents(table)
    assert made.columns == table.columns and {tuple(r)[3:] for r in made.collect()} == {(1, 2, 3, 4, 5)} and made.select("doc_id").distinct().count() == 20
    assert mixing.mix(table).count() == made.count()


def test_tokens(spark):
    texts = ["", None, " a\tb\x0bc ", "é x y", "a\n\nb"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.tokens(F.col("text")).alias("n")).collect()
    assert [r.n for r in rows] == [0, 0, 3, 2, 2]


# language-model scores


def brute_losses(rows, targets, backoff=1.0):
    """(id, tokens, target loss, background loss) of each row, one token at a time."""
    import math
    from collections import Counter

    texts = [(i, ["<s>", *(t or "").encode().lower().split(), "</s>"]) for i, t in rows]
    texts = [(i, w if len(w) > 2 else []) for i, w in texts]
    grams = [(Counter(w[1:]), Counter(w[:-1]), Counter(zip(w, w[1:]))) for _, w in texts]
    total = {m: [Counter() for _ in range(3)] for m in "tb"}
    for (i, _), own in zip(texts, grams):
        for m in "tb" if i in targets else "b":
            for k in range(3):
                total[m][k].update(own[k])
    out = []
    for (i, words), own in zip(texts, grams):
        loss = []
        for m in "tb":
            less = own if m == "b" or i in targets else [Counter()] * 3
            n = sum(total[m][0].values()) - sum(less[0].values())
            total_loss = 0.0
            for u, w in zip(words, words[1:]):
                p = (total[m][0][w] - less[0][w] + 2.0**-20) / (n + 1)
                p = (total[m][2][u, w] - less[2][u, w] + backoff * p) / (total[m][1][u] - less[1][u] + backoff)
                total_loss -= math.log(p)
            loss.append(total_loss / max(len(words) - 1, 1))
        out.append((i, max(len(words) - 1, 0), *loss))
    return out


def test_lm_scores(spark):
    rng = np.random.default_rng(4)
    rows = ODD + [(100 + k, " ".join(f"v{x}" for x in rng.zipf(1.4, rng.integers(1, 60)) % 500)) for k in range(60)]
    rows += [(300, rows[-1][1]), (301, rows[-2][1])]
    targets = {1, 8, 6, *range(100, 140)}
    ids = spark.createDataFrame([(i, 1) for i in sorted(targets)] + [(None, 1), (1, 2)], "doc_id long, x int")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(brute_losses(rows, targets), key=key)
    got = sorted((tuple(r) for r in lm_scoring.score_documents(docs(spark, rows), ids).collect()), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:4] for g in got], [w[2:4] for w in want], atol=1e-9) and np.allclose([g[4] for g in got], [w[2] - w[3] for w in want], atol=1e-9)
    many = docs(spark, rows).repartition(7)  # more blocks, more parts, targets met by a join
    again = sorted((tuple(r) for r in lm_scoring.score_documents(many, ids, part_grams=50, broadcast_ids=0).collect()), key=key)
    assert np.allclose(np.array([g[1:] for g in again], float), np.array([g[1:] for g in got], float), atol=1e-9)
    assert lm_scoring.score_documents(docs(spark, []), ids).count() == 0
    assert {r.target_loss > 0 for r in lm_scoring.score_documents(docs(spark, rows), ids.limit(0)).where("tokens > 0").collect()} == {True}


def test_what_is_counted_grows_with_the_text(spark):
    sizes = []
    for sf in ("sf0.001", "sf0.01"):
        table = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        blocks = lm_scoring._blocks(table.select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(False).alias("target")))
        sizes.append(blocks.agg(F.sum("grams1"), F.sum("tokens")).first())
    assert sizes[1][0] / sizes[0][0] > 0.6 * sizes[1][1] / sizes[0][1]


# sharding


def test_sharding(spark):
    out, slot_map = sharding.shard_documents(docs(spark))
    rows = out.collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 1 for _, t in ODD)
    assert {r.text_crc32 for r in rows} == {zlib.crc32((t or "").encode()) for _, t in ODD}
    assert sharding.shard_documents(docs(spark, []))[0].count() == 0


def test_shards_are_even_and_maps_change_little(spark):
    out, slot_map = sharding.shard_documents(sf_docs(spark))
    sizes = {r["shard"]: r["n"] for r in out.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert len(sizes) == 8 and max(sizes.values()) <= 1.05 * sum(sizes.values()) / 8
    weights = sharding.slot_weights(sharding.measured(sf_docs(spark)))
    nine = sharding.rebalanced_map(spark, slot_map, weights, 9).collect()
    old = {r.vslot: r.shard for r in slot_map.collect()}
    moved = [r for r in nine if old[r.vslot] != r.shard]
    held = {}
    for r in nine:
        held[r.shard] = held.get(r.shard, 0) + r.slot_bytes
    assert {r.version for r in nine} == {2} and {r.vslot for r in nine} == set(old)
    assert sum(r.slot_bytes for r in moved) <= 0.2 * sum(held.values()) and max(held.values()) <= 1.3 * sum(held.values()) / 9


def test_sharding_by_brute_force(spark):
    """The first map and every place replayed row by row; Spark gives the hash alone."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    made = sharding.measured(table).collect()
    weight = {}
    for r in made:
        weight[r.vslot] = weight.get(r.vslot, 0) + r.size
    held, place = [0] * 8, {}
    for slot in sorted(weight, key=lambda v: (-weight[v], v)):
        k = min(range(8), key=lambda i: (held[i], i))
        held[k] += weight[slot]
        place[slot] = k
    want, filled = {}, [0] * 8
    for r in sorted(made, key=lambda r: (r.vslot, r.doc_id, r.text_crc32, r.size)):
        k = place[r.vslot]
        want[r.doc_id] = (r.size, r.text_crc32, "bytes", k, filled[k], None)
        filled[k] += 1
    got = {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in sharding.shard_documents(table)[0].collect()}
    assert got == want
    texts = {r.doc_id: r.text.encode() for r in table.collect()}
    assert all(got[i][:2] == (len(t) + 1, zlib.crc32(t)) for i, t in texts.items())


def test_maps_are_stored_and_edited(spark, tmp_path):
    path = f"file://{tmp_path}/maps"
    assert sharding.load_map(spark, path) is None
    rows, first = sharding.shard_documents(sf_docs(spark), map_path=path)
    was = {r.doc_id: r.shard for r in rows.collect()}
    same, again = sharding.shard_documents(sf_docs(spark), map_path=path)  # the newest map is used as it is
    assert {r.doc_id: (r.shard, r.map_version) for r in same.collect()} == {i: (k, 1) for i, k in was.items()}
    moved, second = sharding.rebalance_documents(sf_docs(spark), path, 9)
    now = {r.doc_id: (r.shard, r.map_version) for r in moved.collect()}
    assert {v for _, v in now.values()} == {2} and {k for k, _ in now.values()} == set(range(9))
    assert sum(k != was[i] for i, (k, _) in now.items()) <= 0.25 * len(now)
    assert sharding.load_map(spark, path).where("version = 2").count() == second.count() and sharding.load_map(spark, path, 1).count() == first.count()
    grown = sf_docs(spark).unionByName(sf_docs(spark).withColumn("doc_id", F.col("doc_id") + 10**9))
    out, _ = sharding.shard_documents(grown, 9, map_path=path)  # slots never seen get places in the next version
    assert out.count() == 2 * len(was) and {r.doc_id: r.shard for r in out.where(f"doc_id < {10**9}").collect()} == {i: k for i, (k, _) in now.items()}


def test_equal_texts_stay_in_one_shard(spark):
    """Copies of a text, with other ids or none, null and empty alike, unless they outgrow half a shard."""
    rows = [(k, f"text {k % 700} " + "w " * (k % 700 % 40)) for k in range(2100)] + [(None, "text 3 w w w "), (5000, None), (5001, ""), (None, None)] + [(k, "hot " * 40) for k in range(6000, 6600)]
    out, _ = sharding.shard_documents(docs(spark, rows))
    got = out.toPandas()
    shards = got[got["size"] != len("hot ") * 40 + 1].groupby("text_crc32").shard.nunique()
    hot = got[got["size"] == len("hot ") * 40 + 1]
    held = got.groupby("shard")["size"].sum()
    assert shards.max() == 1 and hot.shard.nunique() == 8 and held.max() - held.min() < 0.05 * held.mean()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)


def test_rows_without_ids_spread_over_slots(spark):
    out, _ = sharding.shard_documents(docs(spark, [(None, "same")] * 400))
    by = {}
    for r in out.collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert len(by) == 8 and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_many_copies_of_one_row_spread_over_slots_and_shards(spark):
    many = spark.range(30_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    other = spark.range(100, 20_100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows, slot_map = sharding.shard_documents(many.unionByName(other))
    got = rows.toPandas()
    assert len(got) == 50_000 and (got.doc_id == 5).sum() == 30_000
    held = got.groupby("shard")["size"].sum()
    assert len(held) == 8 and held.max() - held.min() < 0.01 * held.mean()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
    assert slot_map.agg(F.max("slot_rows")).first()[0] < 200


# chat


def test_chat_agrees_with_sql(spark):
    assert normal(chat.report(spark.read.parquet(f"{SF}/conversations.parquet")).toPandas()) == normal(duck(chat.ORACLE))


def test_calls_of_every_kind(spark):
    calls = [
        (1, 1, "a", "reply", '{"prompt":"p","chars":1}'), (1, 3, "b", "reply", '{"chars":2,"prompt":"q","uses":["a","zz"]}'), (1, 4, "b", "reply", "{}"),
        (1, 5, "c", "reply", '{"prompt":"p","chars":1,"uses":["d"]}'), (1, 6, "d", "reply", '{"prompt":"p","chars":1,"uses":["c"]}'),
        (1, 7, "e", "other", "{}"), (1, 8, None, "reply", "not json"), (2, 1, "a", "reply", '{"prompt":1,"chars":"x","z":null}'),
    ]
    results = [(1, 2, "a", "fine"), (1, 9, "b", None), (1, 10, "a", "again"), (1, 11, "x", "lost")]
    made = chat.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string"), spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"))
    got = {(r.conv_id, r.turn): r for r in made.collect()}
    assert len(got) == 10
    assert [got[(1, k)].status for k in (1, 3, 4, 5, 6, 7, 8, 10, 11)] == ["linked", "linked", "duplicate", "cycle", "cycle", "pending", "pending", "duplicate", "orphan"]
    assert (got[(1, 1)].level, got[(1, 3)].level) == (0, 1) and (1, 2) not in got
    assert got[(1, 1)].json == '{"arguments":{"chars":1,"prompt":"p"},"id":"a","level":0,"name":"reply","result":"fine"}'
    assert got[(2, 1)].problems == ["chars is not integer", "prompt is not string", "unknown z"] and got[(1, 7)].problems == ["unknown tool"] and got[(1, 8)].problems[0] == "missing chars"


def test_arguments_that_do_not_parse_are_kept(spark):
    import json

    odd = ["not json", '{"a":1,"a":2}', '{"prompt":', "\u0001 \"x\" \\", ""]
    calls = [(1, k, f"c{k}", "reply", x) for k, x in enumerate(odd)] + [(1, 90, "n", "reply", None), (1, 91, "g", "reply", '{"b":2,"a":"' + "long " * 30_000 + '"}')]
    got = {r.call_id: json.loads(r.json)["arguments"] for r in chat.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string"), spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")).collect()}
    assert [got[f"c{k}"] for k in range(len(odd))] == odd and got["n"] is None and got["g"] == {"a": "long " * 30_000, "b": 2}


@pytest.mark.parametrize("at_once", [7, 1 << 12])
def test_many_rows_without_identifiers_and_copies(spark, monkeypatch, at_once):
    monkeypatch.setattr(chat, "COPIES_AT_ONCE", at_once)
    calls = [(None if k % 2 else 1, k % 3, None, "reply", "{}") for k in range(60)] + [(2, 1, "a", "reply", "{}")] * 30 + [(2, 0, "a", "reply", "{}")]
    results = [(None, 0, "a", "x")] * 20 + [(2, 5, "a", "y")] * 20
    got = chat.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string"), spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")).collect()
    count = {}
    for r in got:
        count[r.kind, r.status] = count.get((r.kind, r.status), 0) + 1
    assert count == {("call", "pending"): 60, ("call", "linked"): 1, ("call", "duplicate"): 30, ("result", "orphan"): 20, ("result", "duplicate"): 19}
    assert [r.turn for r in got if r.status == "linked"] == [0]


def test_levels_are_longest_paths(spark):
    import json
    import random

    rng = random.Random(4)
    uses = {0: []} | {k: [k - 1] for k in range(1, 90)}  # a chain, then a graph, then a cycle with a tail
    uses |= {k: sorted({rng.randrange(80, k) for _ in range(rng.choice([1, 1, 2, 3]))}) for k in range(90, 140)}
    uses |= {200: [202], 201: [200], 202: [201], 203: [202, 5], 204: [203]}
    calls = [(1, k, f"c{k}", "reply", json.dumps({"uses": [f"c{j}" for j in v]})) for k, v in uses.items()]
    got = {r.call_id: r.level for r in chat.levels(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string")).collect()}
    want = {}
    for k in range(140):
        want[f"c{k}"] = 1 + max((want[f"c{j}"] for j in uses[k]), default=-1)
    assert got == want


def test_levels_have_no_most_rounds(spark, monkeypatch):
    import json

    monkeypatch.setattr(chat, "ROUNDS", 3, raising=False)
    calls = [(1, k, f"c{k}", "reply", json.dumps({"uses": [f"c{j}" for j in (k - 1, k - 2) if j >= 0]})) for k in range(9)]
    calls += [(1, 10, "x", "reply", '{"uses":["y"]}'), (1, 11, "y", "reply", '{"uses":["x"]}')]
    got = chat.levels(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string")).collect()
    assert {r.call_id: r.level for r in got} == {f"c{k}": k for k in range(9)}


def test_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, level int"
    rows = [(1, 0, "user", None, 1), (1, 1, "assistant", "x\"\n", 1), (1, 1, "assistant", "x\"\n", 1), (None, 0, "user", "a", 1), (2, None, "user", "", 1), (3, 0, None, None, 1), (3, 1, "tool", "t", 1)]
    got = chat.report(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.status for r in got) == ["duplicate", "linked", "pending", "pending", "plain", "plain"]
    assert chat.report(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("name", ["op2_nearest", "op4_topk"])
def test_searches_agree_with_sql(spark, name):
    assert normal(queries.QUERIES[name](spark, SF).toPandas()) == normal(duck(queries.ORACLES[name]))
