import hashlib
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from transitlake.llm import collocations, quality_classifier, token_alignment
from transitlake.llm.sentencepiece_codec import model_path

SF_MID = "/root/testdata/sf0.01"
BYTE, PIECE = model_path("byte_bpe_50k.json"), model_path("piece_bpe_32k.model")


# --- operator 11 -----------------------------------------------------------

def plain_alignment(docs):
    """Token lists, common ends and counts document by document."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    symbol = token_alignment.byte_of_symbol()
    found, held = [], Counter()
    for doc_id, text in docs:
        groups = []
        if text:
            e = a.encode(" " + text, add_special_tokens=False)
            side_a = [(i, bytes(symbol[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
            side_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
                      for i, p in zip(b.encode(text), b.encode(text, out_type=str))]
            if all(b"".join(x for _, x in s) == (" " + text).encode() for s in (side_a, side_b)):
                ends = [list(np.cumsum([len(x) for _, x in s])) for s in (side_a, side_b)]
                at = [0, 0]
                for end in sorted(set(ends[0]) & set(ends[1])):
                    group = []
                    for k, side in enumerate((side_a, side_b)):
                        upto = bisect_right(ends[k], end)
                        group.append([i for i, _ in side[at[k]:upto]])
                        at[k] = upto
                    groups.append(group)
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        held.update(links.keys())
        found.append((doc_id, groups, links))
    best = defaultdict(int)
    for (p, _), c in held.items():
        best[p] = max(best[p], c)
    out = []
    for doc_id, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
                    sum(m for k, m in links.items() if held[k] == best[k[0]]), sum(m * held[k] for k, m in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, held


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_alignment_equals_the_plain_one(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = token_alignment.op11_alignment(spark, SF_SMALL)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert order(tuple(r)[:8] for r in got.collect()) == order(plain_alignment(docs)[0])


def test_alignment_of_odd_texts_and_many_blocks(spark):
    odd = ["a  b   c", "\n\nfoo \n bar\tbaz", "x▁y z", "<|endoftext|> hi <s> </s>", "naïve café 日本語 テスト 🙂🙂 ok", "a" * 3000, " lead", "trail  ",
           " nb sp", "\x00 nul", "é ‍ x\u0085y", "'s 't I'll we've 12345 6 7", "　全角 空白", "", None, " ", "\n",
           "ab" * 4000 + " " * 3000 + "é" * 2000, "{}" * 2000 + "\n" * 500 + " - " * 900, "日" * 1500 + "🙂" * 1500]
    docs = list(enumerate(odd * 2))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want, held = plain_alignment(docs)
    rows, pairs = token_alignment.alignment(df, BYTE, PIECE, block_bytes=100, max_entries=40)
    cols = ["doc_id", *token_alignment.COUNTS[:4], "n_best", "count_sum", "groups"]
    assert order(tuple(r) for r in rows.select(*cols).collect()) == order(want)
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == dict(held)
    assert {r.doc_id: r.n_a for r in rows.collect()}[2] == 0  # U+2581 is not given back


def test_blocks_are_read_one_at_a_time(spark, monkeypatch):
    import pyarrow.parquet as pq
    write, written = token_alignment.write_table, []
    monkeypatch.setattr(token_alignment, "GROUP_BYTES", 1, raising=False)
    monkeypatch.setattr(token_alignment, "write_table", lambda *a, **b: written.append(write(*a, **b)) or written[-1])
    docs = [(i, f"quixotry number {i * 7919} hello world") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        rows, _ = token_alignment.alignment(df, BYTE, PIECE, block_bytes=100)
    finally:
        spark.conf.set(key, before)
    of = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written[0].inputFiles()]
    assert sum(m.num_rows for m in of) == written[0].count() > 1
    assert all(m.row_group(i).num_rows == 1 for m in of for i in range(m.num_row_groups))  # a reader holds a row group
    assert "collect_list" not in rows._jdf.queryExecution().toString()  # would hold the pairs of up to 128 blocks
    cols = ["doc_id", *token_alignment.COUNTS[:4], "n_best", "count_sum"]
    assert order(tuple(r) for r in rows.select(*cols).collect()) == order(r[:7] for r in plain_alignment(docs)[0])


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    sides = token_alignment._sides(BYTE, PIECE, 1000)
    texts = ["日本" * 40 + " quixotry" * 3, "x" * 500]
    expand = token_alignment.align(sides, *sides.encode([" " + t for t in texts]))
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", 0)
    count = token_alignment.align(sides, *sides.encode([" " + t for t in texts]))
    assert (expand["keys"] == count["keys"]).all() and (expand["number"] == count["number"]).all()


def test_overlaps_and_rendered_groups(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, "")], "doc_id long, text string")
    rows, _ = token_alignment.alignment(df, BYTE, PIECE, render=True)
    r = {x.doc_id: x for x in rows.collect()}
    assert r[2].groups == "" and r[2].n_links == 0
    assert r[1].n_overlaps == r[1].n_a + r[1].n_b - r[1].n_groups and r[1].groups.count("|") == r[1].n_groups


def test_long_text_in_segments(monkeypatch):
    sides = token_alignment._sides(BYTE, PIECE, 100_000)
    text = "\n".join(f"Line {i} of a long text, naïve{i * 7919} end." for i in range(300))
    whole = token_alignment.align_texts(sides, [text])
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", 1000)
    monkeypatch.setattr(token_alignment.segments, "__defaults__", (1000,))
    assert len(token_alignment.segments(" " + text)) > 5
    parts = token_alignment.align_texts(sides, [text])
    assert all(np.array_equal(whole[k], parts[k]) for k in whole)
    assert token_alignment.align_texts(sides, [text + " ▁"])["n_a"].sum() == 0


def test_alignment_of_edge_rows(spark, edge_docs, no_docs):
    docs = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    clash = edge_docs.withColumns({c: F.lit("own") for c in ("block", "pairs", "links", "__text", "id", "known")})
    rows, _ = token_alignment.alignment(clash, BYTE, PIECE)
    cols = ["doc_id", *token_alignment.COUNTS[:4], "n_best", "count_sum", "groups"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in rows.select(*cols).collect()), key=key) == sorted(plain_alignment(docs)[0], key=key)
    assert token_alignment.alignment(no_docs, BYTE, PIECE)[0].count() == 0


# --- operator 12 -----------------------------------------------------------

def test_quality_tells_held_out_labels_apart(spark):
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", "quality")
    rows = quality_classifier.op12_quality(spark, SF_MID)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.count() == 1000
    rows = rows.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted != r.quality for r in held) <= 0.03 * len(held)


def test_quality_learns_from_permitted_rows_only(spark):
    docs = quality_classifier.vectors(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    used = quality_classifier.training_rows(docs, labels).collect()
    assert used and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in used)
    both = spark.createDataFrame([(0, 1), (0, 0), (0, None), (2, 7)], "doc_id long, quality int")
    assert {r.quality for r in quality_classifier.training_rows(docs, both).collect()} == {0}


def test_margin_is_the_difference_of_normal_log_densities(spark):
    rng = np.random.default_rng(3)
    d = len(quality_classifier.FEATURES)
    x = rng.normal(size=(400, d)) @ rng.normal(size=(d, d))
    y = (np.arange(400) % 4 == 0).astype(int)
    x[y == 1] += 1.5
    fold = np.arange(400) % 3
    df = spark.createDataFrame([(int(f), int(c), v.tolist()) for f, c, v in zip(fold, y, x)], "fold int, quality int, __x array<double>").repartition(5)
    moments = quality_classifier.class_moments(df)
    to_pooled, to_diagonal = 0.3, 0.1
    model = quality_classifier.discriminant(moments, [0, 1, 2], (to_pooled, to_diagonal))
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    n = np.bincount(y)
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / 400
    pooled = (1 - to_diagonal) * pooled + (to_diagonal + 1e-6) * np.diag(np.diag(pooled))
    want = 0
    for c, sign in ((0, -1), (1, 1)):
        s = (1 - to_pooled) * cov[c] + to_pooled * pooled
        e = x - x[y == c].mean(axis=0)
        want = want + sign * (np.log(n[c] / 400) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e))
    assert np.allclose(model.margin(x), want, atol=1e-6)


def test_text_vectors_do_not_depend_on_the_slice():
    texts = ["", "One two two two.\nOne\nOne", "AB## cd$$ | | 12 !!", "é 日本 🙂   x", "w " * 5000]
    together = quality_classifier.text_vectors(texts)
    assert np.isfinite(together).all() and together.shape == (5, len(quality_classifier.FEATURES))
    assert np.allclose(together, np.vstack([quality_classifier.text_vectors([t]) for t in texts]))
    at = dict(zip(quality_classifier.FEATURES, together[1]))
    assert at["adjacent_odds"] == pytest.approx(np.log((2 + 0.5) / (6 - 2 + 10)))  # two two, One One
    assert at["line_odds"] == pytest.approx(np.log((1 + 0.5) / (3 - 1 + 3)))


def test_quality_of_edge_rows(spark, edge_docs, no_docs):
    edge, none = quality_classifier.vectors(edge_docs), quality_classifier.vectors(no_docs)
    labelled = edge.withColumn("quality", F.lit(1))
    assert {r["__score"] for r in quality_classifier.fit(labelled).score(edge).collect()} == {1.0}
    assert {r["__score"] for r in quality_classifier.fit(labelled.where("false")).score(edge).collect()} == {0.0}
    docs = quality_classifier.vectors(spark.read.parquet(f"{SF_MID}/documents.parquet"))
    model = quality_classifier.fit(quality_classifier.training_rows(docs, spark.read.parquet(f"{SF_MID}/labels.parquet")))
    clash = edge_docs.withColumns({c: F.lit("own") for c in ("__text", "__score", "__x", "fold", "quality")})
    rows = model.score(quality_classifier.vectors(clash, carry=["__text", "__score", "__x", "fold"]))
    assert rows.columns == ["doc_id", "__text", "fold", "__score"] and rows.count() == 16
    assert rows.where("__score is null or __score < 0 or __score > 1").count() == 0 and rows.where("__text = 'own'").count() == 16
    assert model.score(none).count() == 0


# --- operator 13 -----------------------------------------------------------

def plain_collocations(rows, min_count, max_words, top):
    import re
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    f = {p: c for p, c in f.items() if c >= min_count}
    inside = defaultdict(set)
    for (lang, w), c in f.items():
        for k in range(1, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i:i + k]].add(c)
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2 or any(c >= a for c in inside[lang, w]):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                    for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


@pytest.mark.parametrize("min_count,block,max_broadcast", [(2, 1 << 20, 0), (3, 400, 1 << 20), (5, 1000, 0)])
def test_collocations_equal_the_plain_ones(spark, edge_docs, min_count, block, max_broadcast):
    made = [(lang, text) for lang in ("en", None, "und", "") for text in
            ("New York, new york\tcity hall. a a a a a b! New York city\x0bof the city hall", "of the city hall of the\r\nnew york",
             "word " * 30, "a.b.a.b", "É é a é")] * 3
    rows = made + [(r.lang, r.text) for r in edge_docs.collect()] * 2
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("block", "phrase", "f")}).repartition(3)
    got = collocations.top_collocations(df, top=50, min_count=min_count, block_bytes=block, max_broadcast=max_broadcast)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, min_count, 5, 50)


def test_collocations_of_an_empty_table(spark, no_docs):
    assert collocations.top_collocations(no_docs).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 7_000_000_000_123_457
    phrases = spark.createDataFrame([("x", "a b", 2, big - 1), ("x", "a", 1, big + 5), ("x", "b", 1, big)], "lang string, phrase string, n_words int, f long")
    words = spark.createDataFrame([("x", 9 * big + 11)], "lang string, n long")
    assert collocations.scored(phrases, words).first().score == 1000 * (big - 1) * (9 * big + 11) // ((big + 5) * big)


def test_windows_keep_every_word_and_its_context():
    data = b"aa bb cc dd ee ff gg hh.ii jj " + b"k" * 50 + b" ll mm nn oo pp"
    parts = list(collocations.windows(data, 12, 2))
    assert len(parts) > 3 and b"".join(own for own, _ in parts).replace(b".", b"") == data.replace(b".", b"")
    assert any(context.split() for _, context in parts)
