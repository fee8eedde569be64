"""Operators 11 to 13 against brute force, on edge cases and on the smallest driver tables."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriescast.llm import conversations as C
from seriescast.llm import html_text as H
from seriescast.llm import queries
from seriescast.llm import tokenizer_pairs as P
from tests.conftest import SF_SMALL

RND = random.Random(11)


# ------------------------------------------------------------------ 11, conversations
def _cheapest(rows):
    """Every series of edits of (role, text, seen) rows, without states or ranks."""
    best = None

    def go(i, cost, audit, roles, out, inserts):
        nonlocal best
        if (best and cost > best[0]) or not re.fullmatch("s?(ua)*u?", roles):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, "\n".join(out))
        if inserts < 2:
            for r in ("user", "assistant"):
                go(i, cost + 2, audit + "I", roles + r[0], out + [r + ":"], inserts + 1)
        if i < len(rows):
            role, text, seen = rows[i]
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            cut = bool(shown) and shown[-1] not in ".!?"
            go(i + 1, cost + 3, audit + "D", roles, out, 0)
            if shown and not seen:
                go(i + 1, cost + cut, audit + "K", roles + (role[:1] or "-"), out + [f"{role}:{text}"], 0)
                for r in ("user", "assistant"):
                    go(i + 1, cost + 2 + cut, audit + "R", roles + r[0], out + [f"{r}:{text}"], 0)

    go(0, 0, "", "", [], 0)
    return best


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _brute11(rows):
    """conv_id -> result, of (conv_id, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in rows:
        key = [" " if x is None else str(x) for x in (conv, turn)]
        code = zlib.crc32(":".join(key).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        copies = [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
        convs.setdefault(conv, []).extend(copies)
    out = {}
    for conv, left in convs.items():
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, n = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in left:
            again = (role, text) in seen
            seen.add((role, text))
            judged.append((role, text, again))
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not last else "duplicate" if again else "truncated" if last not in ".!?" else None
            if fault:
                n[fault] += 1
        turns = [t for t, _, _ in left if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        cost, audit, text = _cheapest(judged)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, _sha(text))
    return out


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
TEXTS = ["Yes.", "No!", "why?", "well", "", " \t\n", None, "ok. ", "a.b", "été"]


def _conversations():
    rows = []
    for conv in [*range(120), None]:
        for turn in range(RND.randint(1, 5)):
            rows.append((conv, RND.choice([turn, turn, turn, None, turn + 7]), RND.choice(ROLES), RND.choice(TEXTS)))
            if RND.random() < .15:
                rows.append(rows[-1])
    return rows


def _got11(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


KIND11 = "conv_id long, turn long, role string, text string"


def test_op11_against_brute_force(spark):
    rows = _conversations()
    # columns with names the operator uses inside
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND11 + ", digest string, timed int").repartition(7)
    assert _got11(C.repair(df)) == _brute11(rows)


def test_op11_large_repeats_are_joined(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_IDS", 0)
    rows = _conversations()
    assert _got11(C.repair(spark.createDataFrame(rows, KIND11))) == _brute11(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]),
                          st.sampled_from(["a.", "b", "", "c!"]), st.booleans()), max_size=5))
def test_op11_edits(rows):
    r = C.Repair(spill=8)
    for i, row in enumerate(rows):
        r.add(i, *row)
    cost, audit, text = _cheapest(rows)
    got = r.result()
    assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, _sha(text))


def test_op11_one_giant_conversation(spark):
    """Far more rows than an Arrow batch: state is carried and backpointers are spilled."""
    n = 60_000
    df = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role",
                                   "concat('text ', id % 50000, '.') AS text")
    got = C.repair(df).collect()[0]
    left = []
    for i in range(n):
        code = zlib.crc32(f"7:{i}".encode()) % 20
        text = f"text {i % 50000}."
        row = ("user" if code == 4 or i % 2 == 0 else "assistant",
               "" if code == 1 else text[:-1] if code == 2 else text)
        left += [row] * {0: 0, 3: 2}.get(code, 1)
    small, seen = C.Repair(spill=1 << 40), set()
    for i, row in enumerate(left):
        small.add(i, *row, row in seen)
        seen.add(row)
    want = small.result()
    assert [got[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")] == [
        want[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")]
    assert len(got["audit"].replace("I", "")) == len(left)


def test_op11_empty(spark):
    assert C.repair(spark.createDataFrame([], KIND11)).collect() == []


# ------------------------------------------------------------------ 12, tokenizers
def _brute12(texts):
    import sentencepiece
    import tokenizers

    one = tokenizers.Tokenizer.from_file(P.BYTE_BPE)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=P.PIECE_BPE)
    letters = {c: b for c, b in P._byte_letters().items()}

    def spans(tokens):
        at, out = 0, []
        for i, t in tokens:
            out.append((i, at, at + len(t)))
            at += len(t)
        return out

    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(letters[c] for c in one.id_to_token(i)))
             for i in one.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = []
        for i in two.encode(text or ""):
            p = two.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()))
        if not text or any(b"".join(t for _, t in x) != whole for x in (a, b)):
            a = b = []
        a, b = spans(a), spans(b)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        links = [(i, k) for i, s, e in a for k, u, v in b if s < v and u < e]
        shown, low = [], 0
        for end in ends:
            sides = [",".join(str(i) for i, s, e in x if low < e <= end) for x in (a, b)]
            shown.append("|".join(sides))
            low = end
        docs.append((len(a), len(b), len(ends), links, ";".join(shown)))
    count, best = {}, {}
    for d in docs:
        for pair in set(d[3]):
            count[pair] = count.get(pair, 0) + 1
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    return [(na, nb, ng, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links),
             _sha(shown) if na else "") for na, nb, ng, links, shown in docs]


TEXTS12 = [None, "", " ", "one", "one two  three", "<|endoftext|> <s> </s>", "the ▁ sign", "\t tabs\r\n\n and 日本語 Ärger 🙂",
           "x" * 3000, " " * 500, "password = 'hunter22'", "the the the the", "one two  three", "ﬁ ligature 1234567 don't",
           "\x00 nul", "the house of the rising sun"] + [
    "".join(RND.choice(["the ", "house", "Straße ", "été ", "42", "\n", "'s ", "日", "  "]) for _ in range(60)) for _ in range(25)]


@pytest.mark.parametrize("shard", [P.SHARD, 40])
def test_op12_against_brute_force(spark, shard):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(TEXTS12)] + [(None, "the house", "k", 1)],
                               "doc_id long, text string, a string, pair int").repartition(5)
    got = {(r["doc_id"] if r["doc_id"] is not None else len(TEXTS12)): r for r in P.aligned(df, shard=shard).collect()}
    want = _brute12(TEXTS12 + ["the house"])
    for i, w in enumerate(want):
        g = got[i]
        assert (g["n_a"], g["n_b"], g["n_groups"], g["n_links"], g["n_best"], g["count_sum"],
                _sha(g["groups"]) if g["n_a"] else g["groups"]) == w, TEXTS12[i]


def test_op12_query(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet' WHERE length(text) < 2500").fetchall()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.aligned(df).collect()}
    for (i, _), w in zip(rows, _brute12([t for _, t in rows])):
        g = got[i]
        assert (g["n_a"], g["n_b"], g["n_groups"], g["n_links"], g["n_best"], g["count_sum"]) == w[:6]
    whole = queries.op12_tokenizer_pairs(spark, SF_SMALL)
    assert whole.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_op12_same_ids_as_the_json(spark):
    import tokenizers

    one = tokenizers.Tokenizer.from_file(P.BYTE_BPE)
    one.encode_special_tokens = True
    texts = [r[0] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    texts += [f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in range(0, 0x3000)] + [" " * 5000, "a" * 9000, "\n" * 999]
    assert [x.tolist() for x in P.byte_encoder().encode(texts)] == [one.encode(" " + t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 100, 50_000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 60, n).astype(np.uint64))
    made = P.PerfectHash(keys)
    assert sorted(made.index(keys)) == list(range(len(keys)))


def test_op12_empty(spark):
    assert P.aligned(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ------------------------------------------------------------------ 13, pages
LONG1 = ("It was a long day on the sea and the ship was at rest in the bay, with the crew on the deck and the captain "
         "at the wheel. They had come from the north and it was not clear to them that the storm was over by then.")
LONG2 = ("The second paragraph of the story is also long enough to be of use to the reader, and it is in the middle of "
         "the page with the rest of the text that they have to read for the test to be of any use at all to us here.")
PLAIN = f"""<html><head><title>T</title><style>p{{}}</style></head><body>
<header><h1>Site name</h1></header>
<div id="topMenu"><a href=1>Home</a> <a href=2>News</a></div>
<div class="cookie-notice">We use cookies to improve the experience of the site for you and for the people that are on it.</div>
<div><a href=1>One</a> | <a href=2>Two</a> | <a href=3>Three</a></div>
<h2>A story of the sea</h2><p>{LONG1}</p><p>Short   one&nbsp;&amp; <b>bold</b>.</p><!-- <p>{LONG2}</p> --><p>{LONG2}<script>if (a < b) c("</p>")</script></p>
<aside><p>{LONG1}</p></aside><section class="comments"><p>{LONG2}</p></section>
<form><p>{LONG1}</p><select><option>x</select></form><div style="display: none">{LONG2}</div>
<div><a href="/x">Related: another story of the sea</a></div><p>&copy; 2020 The Company</p></body></html>"""
WANT = ["A story of the sea", LONG1, "Short one & bold.", LONG2]


def test_op13_page_without_article():
    assert H.main_text(PLAIN).split("\n") == WANT


def test_op13_article_decides():
    body = "<nav><ul><li>a</ul></nav><p>{}</p><article><h1>Head</h1><p>tiny<p>zzz qqq {}<br>x<footer>f</footer></article><p>{}</p>"
    assert H.main_text(body.format(LONG1, "kk " * 40, LONG2)) == "Head\ntiny\nzzz qqq " + "kk " * 40 + "x"


@pytest.mark.parametrize("html, text", [
    ("", ""), ("<", "<"), ("<p>", ""), ("just the words", "just the words"), ("<p>&lt;b&gt; &amp;amp;</p>", "<b> &amp;"),
    ("<p title='a > b'>x</p>", "x"), ("<nav><p>never closed", "never closed"), ("<script>x = 1", "x = 1"),
    ("a<!-- open <p>b</p>", "a\nb"), ("<p>one<br><br>two</p>", "one\ntwo"), ("<p>a \n b</p>", "a b")])
def test_op13_small_pages(html, text):
    assert H.main_text(html) == text


def test_op13_labels():
    good, near, bad, short = (H.Block(t, 0, False, False, -1) for t in (
        LONG1, LONG1[:100], "Lorem ipsum dolor " * 10, "Words"))
    assert [H.first_pass(b) for b in (good, near, bad, short)] == ["good", "near", "bad", "short"]
    page = [bad, short, good, short, near, short, bad, short, bad, near, bad]
    keep = H.second_pass(page, [H.first_pass(b) for b in page])
    assert keep == [False, False, True, True, True, False, False, False, False, False, False]


def test_op13_linear_time():
    import time

    for part in ("<a ", "<p title=\"", "<script>", "<!--", "<div>", "<p '", "</div>", "&amp"):
        t = time.time()
        H.main_text(part * 100_000)
        assert time.time() - t < 20, part


def test_op13_query(spark):
    pages = spark.createDataFrame([(1, "u", PLAIN, "x"), (None, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x")],
                                  "page_id long, url string, html string, raw string")
    got = sorted((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in H.extract(pages).collect())
    text = "\n".join(WANT)
    assert got == [(0, None, "", 0), (1, "u", text, len(text)), (2, "u", "", 0), (2, "u", "", 0)]
    assert H.extract(pages.limit(0)).collect() == []


def test_op13_articles_of_the_table(spark):
    """Every page of the driver's table: the article element's blocks, by a plain parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.blocks.append("") if tag not in ("b", "br") else self.handle_data(" " if tag == "br" else "")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if tag != "b":
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    rows = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in queries.op13_html_text(spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    for r in rows:
        p = Article()
        p.feed(r["html"])
        assert got[r["page_id"]] == "\n".join(t for t in (" ".join(x.split()) for x in p.blocks) if t)
