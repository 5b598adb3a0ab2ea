"""Operators that compare documents, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash

from tests.conftest import SF_SMALL
from transitlake.llm import decontamination, line_dedup, simhash_trie, substring_dedup
from transitlake.llm.components import connected_components
from transitlake.llm.gsaca import suffix_array
from transitlake.llm.common import write_table


def collected(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_suffix_array():
    rng = random.Random(1)
    for t in range(1500):
        s = bytes(rng.randrange(rng.choice([1, 2, 3, 26])) + 97 for _ in range(rng.randint(0, 40))) * rng.choice([1, 1, 3])
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_substrings(rows, length):
    seen, out = set(), []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = hashlib.blake2b(data[s:s + length], digest_size=16).digest()
            if w in seen:
                gone[s:s + length] = True
            seen.add(w)
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((i, len(data), int(gone.sum()), int(np.count_nonzero(np.diff(gone, prepend=False) & gone)), left))
    return Counter(out)


def test_substrings(spark, edge_docs, no_docs):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcdef ") for _ in range(rng.choice([30, 120, 300]))) for _ in range(12)]
    mixed = [(100 + i, "".join(rng.choice(parts) + rng.choice("xyzü") for _ in range(rng.randint(1, 8)))) for i in range(60)]
    rows = mixed + collected(edge_docs)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_substrings(in_order(rows), 100)
    for limit in (20_000, 2):  # 2: nearly every k-gram is split by window
        got = Counter(tuple(r)[:4] + (bytes(r.kept),) for r in substring_dedup.dedup(docs, max_contexts=limit).collect())
        assert got == want
    assert substring_dedup.dedup(no_docs).count() == 0


def brute_lines(rows, least):
    """Delete every line of a repeated run of at least ``least`` words, by all runs."""
    docs = [[x for x in (t or "").split("\n") if x.strip(line_dedup.SPACE)] for _, t in rows]
    first, gone = {}, set()
    for d, lines in enumerate(docs):
        for p in range(len(lines)):
            words = 0
            for e in range(p, min(len(lines), p + 70)):
                words += len(lines[e].split())
                if words >= least:
                    key = tuple(x.strip(line_dedup.SPACE) for x in lines[p:e + 1])
                    if first.setdefault(key, (d, p)) != (d, p):
                        gone |= {(d, i) for i in range(p, e + 1)}
    return [(i, len(docs[d]), sum((d, k) in gone for k in range(len(docs[d])))) for d, (i, _) in enumerate(rows)]


def test_line_runs(spark, edge_docs, no_docs):
    rng = random.Random(2)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([1, 2, 5, 12, 35]))) for _ in range(14)]
    mixed = [(100 + i, "\n".join(rng.choice([*pool, "", f"only {i} {k}"]) for k in range(rng.randint(0, 30)))) for i in range(50)]
    rows = in_order(mixed + [r for r in collected(edge_docs) if len(r[1] or "") < 10_000])
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = line_dedup._cleaned(docs, "doc_id", "text", 20).select("doc_id", "__n_lines", "__n_removed")
    assert Counter(map(tuple, got.collect())) == Counter(brute_lines(rows, 20))
    assert line_dedup.clean(no_docs).count() == 0


def fingerprint(text, width=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    bits = np.unpackbits(np.array([xxhash.xxh64(s, seed=42).intdigest() for s in shingles], "<u8").view(np.uint8).reshape(-1, 8),
                         axis=1, bitorder="little").astype(int).sum(axis=0)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def components(keys, linked):
    parent = {k: k for k in keys}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


def test_simhash(spark, edge_docs, no_docs):
    docs = edge_docs.select("doc_id", "text").union(spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    rows = collected(docs)
    fps = {t: fingerprint(t) for _, t in rows}
    label = components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, t in rows:
        if i is not None:
            least[label[fps[t]]] = min(i, least.get(label[fps[t]], i))
    want = Counter((i, f"{fps[t]:016x}", least.get(label[fps[t]])) for i, t in rows)
    out = simhash_trie.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r["__fingerprint"], r["__component"]) for r in out) == want
    assert sum(r["__first"] for r in out) == len(set(label.values()))
    kept = simhash_trie.representatives(edge_docs)
    assert kept.columns == edge_docs.columns and kept.where("doc_id = 7 and text like 'other%'").count() <= 1
    assert simhash_trie.near_duplicates(no_docs).count() == 0


def test_trie_links_lose_nothing(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(8)]
    fps = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for c in centres for _ in range(60)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    for bits, split in ((4, 200_000), (4, 5), (0, 5), (1, 5), (7, 5)):
        want = components(fps, lambda a, b: (a ^ b).bit_count() <= bits)
        roots = {r.node % 2**64: r.root % 2**64 for r in connected_components(simhash_trie.links(df, bits, split)).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(roots.get(f, f), set()).add(f)
        expected = {}
        for f, r in want.items():
            expected.setdefault(r, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_a_dense_unit_is_split_until_no_task_holds_it_whole(spark, monkeypatch):
    """Fingerprints that agree in 40 bits: one split of 8 bits leaves them
    together, so the units must be descended again."""
    rng = random.Random(9)
    head = rng.getrandbits(64) & ~((1 << 24) - 1)
    fps = sorted({head | rng.getrandbits(24) for _ in range(1500)})
    df = write_table(spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long"), "test-fingerprints")
    levels, descend = [], simhash_trie._descend

    def counted(rows, budgets):
        levels.append(rows.groupBy("turn", "depth", "u", "v").count().agg({"count": "max"}).first()[0])
        return descend(rows, budgets)

    monkeypatch.setattr(simhash_trie, "_descend", counted)
    roots = {r.node % 2**64: r.root % 2**64 for r in connected_components(simhash_trie.links(df, 4, 400)).collect()}
    assert len(levels) > 2 and levels[-1] > 400
    want = components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    same = {}
    for f in fps:
        assert same.setdefault(want[f], roots.get(f, f)) == roots.get(f, f)
    assert len(set(same.values())) == len(same)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert connected_components(edges.where("false")).count() == 0


def brute_leaks(rows, items):
    """(id, item) with a window of similarity 0.8 or more, over all windows."""
    import regex
    split = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    out = Counter()
    for i, t in rows:
        words = split(t)
        for item, text in items:
            own = split(text)
            k = min(5, len(own))
            if not own:
                continue
            grams = lambda w: Counter(tuple(w[j:j + k]) for j in range(len(w) - k + 1))
            want, best = grams(own), 0
            for s in range(max(1, len(words) - k + 1)):
                g = grams(words[s:s + len(own)])
                if g:
                    best = max(best, (want & g).total() / (want | g).total())
            out[i, item] += best >= 0.8 - 1e-12
    return Counter({k: v for k, v in out.items() if v})


def test_decontamination(spark, edge_docs, no_docs):
    rng = random.Random(9)
    item = [f"q{i}" for i in range(40)]
    changed = item[:]
    changed[20] = "other"
    items = [(1, " ".join(item)), (2, "three short words"), (3, ""), (None, "no id " + " ".join(f"z{i}" for i in range(20))),
             (4, " ".join(["again and"] * 12))]
    noise = lambda n: " ".join(f"n{rng.randrange(99)}" for _ in range(n))
    rows = [(1, noise(30) + " " + " ".join(item) + " " + noise(9)), (2, " ".join(changed)), (3, " ".join(item[:34])), (4, " ".join(item[:30])),
            (5, "THREE, short--words!"), (6, noise(50)), (7, " ".join(["again and"] * 30)), (8, None), (9, ""), (9, " ".join(item)),
            (10, noise(8) + " no id " + " ".join(f"Z{i}" for i in range(20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked, found = decontamination.leaks(docs, bench)
    got = Counter((r.doc_id, r.item_id) for r in marked.join(found, "__row").collect())
    assert got == brute_leaks(rows, items)
    kept = decontamination.clean(edge_docs, bench)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert decontamination.clean(docs, bench.where("false")).count() == len(rows)
    assert decontamination.clean(no_docs, bench).count() == 0


def test_leaks_far_from_the_items_fingerprint(spark):
    rows, items = [], []
    for i in range(1500):  # a short item cut off by the end of the text: 4 of 5 shingles
        item = [f"a{i}x{j}" for j in range(9)]
        items.append((i, " ".join(item)))
        rows.append((i, "some words " + " ".join(item[:8])))
    for i in range(1500, 1700):  # the end replaced by one repeated word: 89 of 111 shingles
        item = [f"a{i}x{j}" for j in range(104)]
        items.append((i, " ".join(item)))
        rows.append((i, " ".join(item[:93] + [f"z{i}"] * 11)))
    marked, found = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"),
                                          spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_total) for r in marked.join(found, "__row").collect())
    assert got == Counter((i, i, *((4, 5) if i < 1500 else (89, 111))) for i in range(1700))


def test_window_fingerprints(spark):
    from pyspark.sql import functions as F
    rng = random.Random(0)
    rows = [(i, [rng.getrandbits(64) - 2**63 for _ in range(n)]) for i, n in enumerate((0, 1, 2, 7, 300))]
    for r in spark.createDataFrame(rows, "i int, h array<long>").withColumn("s", decontamination.simhash(F.col("h"))).collect():
        bits = [x % 2**64 for x in r.h]
        assert r.s % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in bits) > len(bits))
