"""Operators that work row by row, against plain versions of themselves."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from transitlake.llm import html_mincut, quality_ledger, secret_scan, sentencepiece_codec, url_filter


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("table", [10, 300_000])
def test_chunks_encode_like_the_library(spark, edge_docs, table):
    from sentencepiece import SentencePieceProcessor
    path = sentencepiece_codec.model_path()
    sp = SentencePieceProcessor(model_file=path)
    docs = edge_docs.select("doc_id", "text").union(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(str((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids).encode())))
                  for i, t in texts_of(docs) for ids in [sp.encode(t or "", add_bos=True, add_eos=True)])
    got = sentencepiece_codec.digests(docs, path, max_entries=table).drop("decoded_chars").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_token_ids_decode(edge_docs, no_docs):
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    out = sentencepiece_codec.encode_decode(edge_docs, sentencepiece_codec.model_path()).collect()
    assert len(out) == 16 and all(sp.decode(r.token_ids) == r.decoded for r in out)
    assert sentencepiece_codec.encode_decode(no_docs, sentencepiece_codec.model_path()).count() == 0


def plain_base(text):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    return sorted([(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[2]) >= 6]
                  + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
                  + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans(spark, edge_docs, no_docs):
    docs = edge_docs.select("doc_id", "text").union(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text"))
    names = ("assign", "access", "hex")
    want = sorted(str((i, hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in plain_base(t or "")).encode()).hexdigest()))
                  for i, t in texts_of(docs))
    assert sorted(str(tuple(r)) for r in secret_scan.scan(docs).select("doc_id", "base_sha256").collect()) == want
    assert secret_scan.scan(no_docs).count() == 0


def test_random_strings_and_exclusions():
    enc = secret_scan._encoder(secret_scan.vocabulary_path())
    spans = lambda t: [(k, t[s:e]) for s, k, e in secret_scan.find_spans([t], enc, 2.3)[0]]
    assert spans("é key q9Xv27ZkP0mTz84LwBnR end") == [(3, "q9Xv27ZkP0mTz84LwBnR")]
    for ordinary in ("5f2d1b3c-9a8e-4c21-b0d7-0123456789ab", "D41D8CD98F00B204E9800998ECF8427E", "release_2024_candidate_12",
                     "internationalisation", "4041894974608795", "see/also/the/manual"):
        assert spans(f"a {ordinary} b") == []
    assert spans("ſecret=abcdefgh") == []  # only A-Z in either case


def test_random_strings_of_letters_and_among_words():
    enc = secret_scan._encoder(secret_scan.vocabulary_path())
    spans = lambda t: [(k, t[s:e]) for s, k, e in secret_scan.find_spans([t], enc, 2.3)[0]]
    words, rng = "com/documents/shared/folder/annual-report-presentation/", random.Random(2)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
                     "abcdefghijklmnopqrstuvwxyz0123456789"):
        for n in (24, 40):
            some = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(100)]
            assert sum(spans(f"é {x} b") == [(3, x)] for x in some) >= 99
            # the run as a whole, where that compresses badly too
            assert sum(spans(f"é {words}{x} b") in ([(3, x)], [(3, words + x)]) for x in some) >= 99
    x = "q9Xv27ZkP0mTz84LwBnR"
    assert spans(f"é {words}{x}/presentation/of/documents") == [(3, x)]
    assert spans(f"é {x}/password=abcdefgh") == [(3, x + "/"), (0, "password=abcdefgh")]
    for ordinary in (f"{words}5f2d1b3c-9a8e-4c21-b0d7-0123456789ab", "ArrayIndexOutOfBoundsException", "MAX_CONNECTION_TIMEOUT",
                     "a_b_c_d_e_f_g_h_1_2_3", "my-documents/password=abcdefgh"):
        assert [s for s in spans(f"a {ordinary} b") if s[0] == 3] == []


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)} if len(grams) < 2000 else None
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), None if covered is None else len(covered))


def test_measures(spark, edge_docs, no_docs):
    words = [" ".join(random.Random(s).choice("abc") for _ in range(40)) for s in range(20)]
    more = spark.createDataFrame([(100 + i, w + "\n\n" + w[:30]) for i, w in enumerate(words)], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").union(more)
    got = sorted(str(tuple(r)) for r in quality_ledger.ledger(docs).where("n_words < 2000")
                 .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted(str((i, *plain_measures(t or ""))) for i, t in texts_of(docs) if len((t or "").split()) < 2000)
    assert quality_ledger.ablations(quality_ledger.ledger(no_docs)).count() == 0


def test_ablation_counts(spark):
    book = quality_ledger.ledger(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).cache()
    rows = {(r.version, r.without): r for r in quality_ledger.ablations(book).collect()}
    for p in quality_ledger.POLICIES:
        for rule in p.rules:
            without = quality_ledger.Policy("x", tuple(r for r in p.rules if r != rule))
            assert rows[p.version, rule].n_kept == quality_ledger.apply_policy(book, without).where("kept").count()


PAGES = [
    ("<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a href=/>Home</a></nav>"
     "<div class='cookie-notice'>We use cookies.</div><article><h1>Head</h1><p>One&nbsp;&amp; two\n three<br>four"
     "<aside>Buy this</aside><form><input><label>Mail</label></form><p>Five <b>six</b>.</article>"
     "<section id=comments><article class=comment><p>I disagree entirely with this.</p></article></section>"
     "<footer>&copy; us</footer>", "Head\nOne & two three\nfour\nFive six."),
    ("<body><div id=menu><a href=a>A</a> <a href=b>B</a></div><div><p>This page has no article element, but it has a long "
     "sentence in a paragraph.</p><p>And a second one, which follows it and ends as sentences do.</p></div>"
     "<div class=sidebar>More links</div></body>",
     "This page has no article element, but it has a long sentence in a paragraph.\n"
     "And a second one, which follows it and ends as sentences do."),
    ("", ""), (None, ""), ("<p", ""), ("<!-- only a comment --><style>p{}</style>", ""),
]


def test_pages(spark):
    pages = spark.createDataFrame([(i, h, "own") for i, (h, _) in enumerate(PAGES)] + [(0, PAGES[0][0], None)],
                                  "page_id long, html string, text string")
    got = sorted((r.page_id, r["__text"], r["__chars"]) for r in html_mincut.extract(pages, carry=["text"]).collect())
    assert got == sorted([(i, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(0, PAGES[0][1], len(PAGES[0][1]))])
    assert html_mincut.extract(pages.where("false")).count() == 0


def test_open_head_and_form_around_the_page():
    body = ("<div id=menu><a href=a>A</a></div><div><p>This page has a long sentence in a paragraph, and it says more than "
            "one thing.</p><p>And a second one, which follows it and ends as sentences do.</p></div>")
    text = ("This page has a long sentence in a paragraph, and it says more than one thing.\n"
            "And a second one, which follows it and ends as sentences do.")
    article = "<article><h1>Head</h1><p>Short.</p><form><p>Your mail</p></form><p>Last.</p></article>"
    for head in ("<html><head><title>T</title><meta charset=x><script>var a</script>", "<head><title>T</title>\n", "<head>"):
        assert html_mincut.main_text(f"{head}<body>{body}") == text
        assert html_mincut.main_text(f"{head}{body}") == text
        assert html_mincut.main_text(f"{head}</head><body>{body}</body></html>") == text
        assert html_mincut.main_text(f"{head}<body>{article}") == "Head\nShort.\nLast."
    plain = "Words that stand right behind the head, without any tag, still are the text of the page."
    assert html_mincut.main_text("<head><title>T</title>" + plain) == plain
    for form in ("<form method=post id=aspnetForm><input type=hidden>", "<form><label>Search the site</label><select><option>x</select>"):
        for end in ("</form>", ""):
            assert html_mincut.main_text(f"<body>{form}{body}{end}</body>") == text
            assert html_mincut.main_text(f"<body>{form}<div>{article}</div>{end}</body>") == "Head\nShort.\nLast."
    assert html_mincut.main_text(f"<body>{body}<form><p>Please give us your mail address, we write once a month, not more.</p>"
                                 "<button>Go</button></form>") == text


def test_given_pages_give_their_article(spark):
    import html
    for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", x))).strip() for x in re.split("<(?:/?p|br|/?h1)>", body)]
        assert html_mincut.main_text(r.html) == "\n".join(x for x in blocks if x)


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 6)
        keep, drop = ([round(rng.random() * 4, 1) for _ in range(n)] for _ in "ab")
        edges = [(i, j, round(rng.random() * 2, 1)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda side: (sum(d if s else k for s, k, d in zip(side, keep, drop))
                             + sum(w for i, j, w in edges if side[i] != side[j]))
        best = min(cost(s) for s in itertools.product((False, True), repeat=n))
        assert abs(cost(html_mincut.min_cut(keep, drop, edges)) - best) < 1e-6


def test_cascade_is_exact(spark):
    hosts = [(f"h{i}.example.net", i % 7 == 0) for i in range(3000)]
    universe = spark.createDataFrame(hosts, "key string, listed boolean")
    levels = url_filter.build_cascade(universe, first_hashes=2, next_hashes=1)
    assert len(levels) > 2
    wrong = universe.where(url_filter.member(F.col("key"), levels) != F.col("listed"))
    assert wrong.count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.A.Org", "x://a.org/fr?://b", "http://m.example.org/es/1#x", "http://b.com",
            "http://example.com/fr/2", "http://example.com/de/2", "http://example.org/en/12", "http://notexample.org/es/", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("b.com",), ("elsewhere.net",)], "host string")
    got = [tuple(r) for r in url_filter.judge(df, listed).orderBy("page_id").select("__host", "__path", "__rule", "__verdict").collect()]
    assert got == [("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
                   ("www.a.org", "", None, "allow"), ("a.org", "/fr", "org/", "allow"), ("m.example.org", "/es/1", "example.org/es/", "block"),
                   ("b.com", "", None, "block"), ("example.com", "/fr/2", "com/fr/", "allow"), ("example.com", "/de/2", "com/de/", "block"),
                   ("example.org", "/en/12", "example.org/en/1", "block"), ("notexample.org", "/es/", "org/", "allow"), ("b:", "//c/d", None, "allow")]
    assert url_filter.judge(df.where("false"), listed.where("false")).count() == 0
