"""Operators that judge one text at a time: rules, personal data, licenses, language, extraction, benchmark."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidgraph.llm import decontaminate, html_extract, language_id, licenses, pii, quality_rules
from tests.llm import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    total = sum(int(c) for c in d[::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
    return total % 10 == 0


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and plain_luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15],
    }


PIECES = st.sampled_from(["a", "@", ".", "-", "+", "1", "2", "90", " ", "(", ")", "é", "%", "\n", "4539 1488 0343 6467", "192.168.1.1", "+1 (555) 123-4567", "x@y.zz", "256", "٣", "token = \"", "https://"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=25))
def test_base_spans_are_those_of_a_search(parts):
    text = "".join(parts)
    spans = pii.Scan(text).spans
    assert {k: spans[k] for k in pii.BASE} == plain_spans(text)


def test_more_kinds_and_mask():
    text = 'key token = "24be64439e3e49cf46b2d7c90f36" or DE89 3704 0044 0532 0130 00 at https://me:pw@host/ and a@b.co'
    assert pii.mask(text) == 'key token = "<secret>" or <iban> at https://<login>@host/ and <email>'
    assert pii.Scan("DE89 3704 0044 0532 0130 01").spans["iban"] == []
    assert pii.Scan("0" * 6000 + ".1.1.1").spans["ip"] == [(0, 6006)]
    assert pii.mask(None) is None and pii.mask("") == ""


def test_pii_rows(spark):
    rows = [*awkward.texts(), (60, "mail a.b@c.de, 10.0.0.1 and +49 30 1234567"), (61, "é 4539148803436467")]
    got = {(r.doc_id, r.spans): r for r in pii.find_spans(awkward.documents(spark, rows)).collect()}
    assert (60, "email:5:13,ip:15:23,phone:28:42") in got and (61, "card:2:18") in got
    for i, t in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, found in plain_spans(t or "").items() for a, b in found)
        assert any(r.doc_id == i and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() for r in got.values())
    assert pii.find_spans(awkward.documents(spark, [])).collect() == []


def plain_measures(t):
    t = t or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("seed", range(30))
def test_measures(seed):
    rng = random.Random(seed)
    t = "".join(rng.choice(["a ", "b ", "c\n", "d\t", "é#", "\n", "x y z ", "a b c d e f g h i\n", "\x85", "\xa0 "]) for _ in range(rng.randrange(150)))
    assert quality_rules.measure(t.encode())[:5] == plain_measures(t)


def test_ledger_policies_and_ablations(spark):
    rows = awkward.texts()
    book = quality_rules.ledger(awkward.documents(spark, rows)).persist()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in book.collect())
    assert got == sorted((-1 if i is None else i, *plain_measures(t)) for i, t in rows)
    judged = quality_rules.apply_policy(quality_rules.apply_policy(book, "base", "base"), "v1")
    assert judged.where("kept and not base").count() == 0
    by_id = {r.doc_id: r for r in judged.collect() if r.doc_id is not None}
    assert by_id[1].kept and not by_id[14].kept and not by_id[8].kept
    for policy, rules in quality_rules.POLICIES.items():
        table = {r.rule: r for r in quality_rules.ablations(book, policy).collect()}
        bits = [r.failed & quality_rules.mask(rules) for r in book.collect()]
        for rule in quality_rules.RULES:
            if rule.name in rules:
                row = table[rule.name]
                assert (row.fail, row.fail_only_this, row.pass_all) == (sum(bool(b & 1 << rule.bit) for b in bits), sum(b == 1 << rule.bit for b in bits), sum(b == 0 for b in bits))
    assert quality_rules.ledger(awkward.documents(spark, [])).collect() == []


def test_rising_is_longest():
    rng = random.Random(4)
    for _ in range(200):
        v = [rng.randrange(30) for _ in range(rng.randrange(12))]
        got = [v[i] for i in licenses.rising(v)]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max([best[j] for j in range(i) if v[j] < v[i]], default=0)
        assert all(a < b for a, b in zip(got, got[1:], strict=False)) and len(got) == max(best, default=0)


def test_patience_pairs_rise_and_agree():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(25))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert licenses.patience(list("xaby"), list("ab")) == [(1, 0), (2, 1)]


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"].split()
    edited = " ".join([*mit[:30], "some", "other", *mit[33:]])
    rows = [*awkward.texts(), (70, f"Intro the of and {edited} tail."), (71, licenses.TEMPLATES["mit"] + "\n" + licenses.TEMPLATES["mit"]), (72, "İ Licensed under CC BY-NC 4.0. All rights reserved"), (73, "all of the rights are reserved to the software"), (74, " ".join(mit[:80]))]
    got = sorted((r.doc_id, r.license) for r in licenses.find_licenses(awkward.documents(spark, rows)).collect())
    assert got == [(70, "mit"), (71, "mit"), (71, "mit"), (72, "all-rights-reserved"), (72, "cc-by-nc-4.0-notice")]
    text = rows[-3][1]
    assert sorted(text[a:b] for _, a, b, _, _ in licenses.scan(text, [licenses.Template(k, v) for k, v in licenses.TEMPLATES.items()])) == ["All rights reserved", "Licensed under CC BY-NC 4.0"]
    assert licenses.find_licenses(awkward.documents(spark, [])).collect() == []


@pytest.mark.parametrize("gap", range(1, 33, 4))
def test_common_words_before_a_license(gap):
    """The whole license is found, not what a window from an earlier head word holds of it; a damaged copy before it stays a find."""
    known = [licenses.Template(k, v) for k, v in licenses.TEMPLATES.items() if k in ("mit", "isc", "bsd", "gpl-3.0")]
    for name in ("mit", "isc", "bsd", "gpl-3.0"):
        text, size = licenses.TEMPLATES[name], len(licenses.words_of(licenses.TEMPLATES[name]))
        fill = " zzz" * min(gap, size // 5 - 1)
        before = f"{licenses.words_of(text)[1]}{fill} {licenses.words_of(text)[2]}{fill} "
        whole = [f for f in licenses.scan(before + text + " end", known) if f[0] == name]
        assert whole == [(name, len(before), len(before) + len(text.rstrip(".")), size, size)]
        damaged = " ".join(text.split()[: -(size // 8)])
        two = [f for f in licenses.scan(f"{before}{damaged} {text}", known) if f[0] == name]
        assert len(two) == 2 and two[0][3] < two[1][3] == size


def plain_finds(words, template, coverage):
    """Every start and every window: the most words that patience aligns, and where."""
    size = len(template)
    known = set(template)
    places = [i for i, w in enumerate(words) if w in known]
    best = None
    for width in (size + size * (100 - coverage) // 100 + 2, 2 * size):
        for k in range(len(places)):
            pairs = licenses.patience([words[i] for i in places[k : k + width]], template)
            if 100 * len(pairs) >= coverage * size:
                found = (len(pairs), -(places[k + pairs[-1][0]] - places[k + pairs[0][0]]), -places[k + pairs[0][0]])
                best = max(best or found, found)
        if best:
            return best
    return None


@pytest.mark.parametrize("name", ["mit", "isc", "gpl-3.0", "zlib", "mpl-2.0"])
def test_licenses_with_insertions(name):
    """Insertions of up to the widest gap, in one or more places, with and without common words, against every window."""
    rng = random.Random(name)
    template = licenses.Template(name, licenses.TEMPLATES[name])
    size = len(template.words)
    for n in (1, 5, size // 5, size // 3, licenses.widest_gap(size)):
        for places in (1, 2, 3):
            for kind in ("zzz", "mixed"):
                words = list(template.words)
                for at in sorted(rng.sample(range(1, size), places), reverse=True):
                    some = min(n, licenses.widest_gap(size))
                    words[at:at] = ["zzz" if kind == "zzz" or rng.random() < 0.8 else rng.choice(["the", "of", "to", "and"]) for _ in range(some)]
                text = ["before", "the", *words, "of", "after"]
                want = plain_finds(text, template.words, 80)
                got = licenses.scan(" ".join(text), [template])
                assert want and want[0] >= 0.8 * size
                if kind == "zzz":
                    assert want[0] == size and len(got) == 1
                assert [(f[3], f[0]) for f in got][:1] == [(want[0], name)] and len(got) == 1
    apart = " zzz" * (licenses.widest_gap(size) + 1) + " "
    assert licenses.scan(apart.join([" ".join(template.words[: size // 2]), " ".join(template.words[size // 2 :])]), [template]) == []


def test_every_template_finds_itself():
    known = [licenses.Template(k, v) for k, v in licenses.TEMPLATES.items()]
    for name, text in licenses.TEMPLATES.items():
        assert name in [f[0] for f in licenses.scan(f"before it {text} after it", known)]


def labelled(spark, n=400):
    rng = random.Random(7)
    kinds = {"en": ["the", "and", "thing", "with", "from", "other"], "de": ["der", "und", "nicht", "über", "zeit", "schön"], "es": ["que", "ción", "niño", "para", "este", "los"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(kinds))
        rows.append((i, " ".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(2, 60))), lang))
    rows += [(n, None, "en"), (n + 1, "123 !!", "en"), (n + 2, "", None), (None, "und der zeit nicht", "de"), (n + 3, "the other thing", None), (0, rows[0][1], rows[0][2])]
    return rows, spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)


def test_language(spark):
    import zlib

    rows, df = labelled(spark)
    got = language_id.identify(spark, df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(by_id[r[0]].held_out == (r in held) for r in rows)
    judged = [r for r in held if r[2] and r[1] and re.search(r"[^\W\d_]", r[1])]
    assert np.mean([by_id[r[0]].lang_pred == r[2] for r in judged]) > 0.98
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (400, 401, 402))
    assert by_id[None].lang_pred == "de" and by_id[403].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    tagged = language_id.tag(spark, df, language_id.fit(spark, df))
    assert tagged.columns == [*df.columns, "__language"] and tagged.where("__language.lang_pred = 'und'").count() == 3
    none = df.where("doc_id is null")
    assert [r.lang_pred for r in language_id.identify(spark, none).collect()] == ["und"]
    assert language_id.identify(spark, df.limit(0)).collect() == []


def test_language_of_long_texts():
    """A text of a million characters and more keeps its language, and the score of a short one."""
    rng = random.Random(11)
    kinds = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 9))) for _ in range(20_000)] for k, a in (("x", "abcdefghijklmn"), ("y", "ghijklmnopqrst"), ("z", "mnopqrstuvwxyz"))}
    some = [(k, " ".join(rng.choice(words) for _ in range(300))) for k, words in kinds.items() for _ in range(40)]
    model = language_id.train(np.array([language_id.spectrum(t) for _, t in some]), [k for k, _ in some])
    for k, words in kinds.items():
        texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (300, 8_000, 200_000, 350_000)]
        assert len(texts[2]) > 1_000_000
        lang, score = language_id._predict_some([None, *texts, "1 2"], model)
        assert lang == ["und", k, k, k, k, "und"] and min(score[1:5]) > 0.9 * score[1] > 0.6


def test_against_exact_kernel_ridge():
    """With every row a landmark, the regressions are those of kernel ridge regression solved with the whole kernel matrix."""
    rows, _ = made_up(60)
    grams = [{t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in (f" {t} " for t, _ in rows)]
    order = sorted(set().union(*grams))
    vectors = np.array([[g in x for g in order] for x in grams], np.uint8)
    labels = [k for _, k in rows]
    for ridge in (1e-4, 1e-2):
        model = language_id.train(vectors[:40], labels[:40], landmarks=40, ridge=ridge)
        kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams[:40]] for a in grams])
        targets = np.array([[1.0 if k == x else -1.0 for x in model.languages] for k in labels[:40]])
        weight = np.array([40 / labels[:40].count(k) / len(model.languages) for k in labels[:40]])
        exact = kernel @ np.linalg.solve(kernel[:40] + np.diag(ridge * 40 / weight), targets)
        assert np.abs(model.margins(vectors) - exact).max() < 0.01
        few = language_id.train(vectors[:40], labels[:40], landmarks=20, ridge=ridge)
        assert (few.margins(vectors).argmax(axis=1) == exact.argmax(axis=1)).mean() > 0.9


def made_up(n):
    """Texts of three invented languages of 20,000 words each, as (text, language), and the words of each."""
    rng = random.Random(12)
    kinds = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 9))) for _ in range(20_000)] for k, a in (("x", "abcdefghijklmn"), ("y", "ghijklmnopqrst"), ("z", "mnopqrstuvwxyz"))}
    names = list(kinds)
    return [(" ".join(rng.choice(kinds[names[i % 3]]) for _ in range(rng.randrange(20, 80))), names[i % 3]) for i in range(n)], kinds


@pytest.mark.parametrize("size", [10, 1_000, 30_000, 150_000])
def test_language_at_any_length(size):
    """30 percent of the words are of no language that the model knows."""
    rng = random.Random(size)
    some, kinds = made_up(300)
    model = language_id.train(np.array([language_id.spectrum(t) for t, _ in some]), [k for _, k in some])
    texts, want = [], []
    for k, words in kinds.items():
        for _ in range(max(1, min(20, 20_000 // size))):
            texts.append(" ".join(rng.choice(words) if rng.random() < 0.7 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(size)))
            want.append(k)
    lang, score = language_id._predict_some(texts, model)
    assert np.mean([a == b for a, b in zip(lang, want, strict=True)]) >= 0.98 and (size < 1_000 or min(score) > 0.4)


def test_spectrum_against_kernel():
    a, b = "Schöne Zeit!", "schön  zeitig"
    grams = lambda t: {(" " + re.sub(r"[^a-zäöüß]+", " ", t.lower()))[i : i + n] for n in range(1, 5) for i in range(len(re.sub(r"[^a-zäöüß]+", " ", t.lower())) + 2 - n)}
    va, vb = language_id.spectrum(a), language_id.spectrum(b)
    assert abs(int(va.sum()) - len(grams(a))) <= 1 and abs(int((va & vb).sum()) - len(grams(a) & grams(b))) <= 1
    assert language_id.spectrum("12 !") is None and language_id.spectrum("日本") is not None


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="post-17"><header>H</header><nav><ul><li><a href=x>menu</a></ul></nav>
<div class="col-9"><div class="entry-{n} main"><h1>Head &amp; line</h1><p>First {n}  para&shy;graph<br>goes&nbsp;on.<p><b>Second, with bold</b> text &lt;here&gt;.
<aside>side</aside><div class="advert">buy</div><script>if (a < b) document.write("<p>no</p>")</script><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>
<form><input><p>form</p></form><!-- comment <p>x</p> --><div class="comments"><p>reader says</p></div></div></div><div id="cookie-notice">cookies</div><footer>F</footer></body>"""
TEXT = "Head & line\nFirst {n} para\xadgraph goes on.\nSecond, with bold text <here>.\none\ntwo\na b"


def test_extraction(spark):
    rows = [(n, f"https://Host.example/{n}", PAGE.replace("{n}", str(n))) for n in range(5)]
    rows += [(10, "https://host.example/x", "<body class=post-3><div class=col-2><div class='main entry-8'>kept text<p></div></div><div>" + "longer than the other " * 20 + "</div>"), (11, None, "<p>no host"), (12, "http://[bad", "plain"), (13, "https://host.example/y", None), (14, "u", ""), (15, "u", "<nav>only menu</nav>"), (None, None, "<p>x</p>" * 3), (0, rows[0][1], rows[0][2]), (16, "u", "<script>never closed"), (17, "https://host.example/z", "<p>lacks the path</p>")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, text string, n_chars int, host string").repartition(3)
    got = {}
    for r in html_extract.extract_pages(spark, df).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append((r.url, r.text))
    for n in range(5):
        assert got[n][0] == (rows[n][1], TEXT.replace("{n}", str(n)))
    assert len(got[0]) == 2 and got[10][0][1] == "kept text" and got[17][0][1] == "lacks the path"
    assert [got[i][0][1] for i in (11, 12, 13, 14, 15, 16)] == ["no host", "plain", "", "", "", ""] and got[None][0][1] == "x\nx\nx"
    assert html_extract.extract_pages(spark, df.limit(0)).collect() == []
    paths = {r.host: r.path for r in html_extract.host_paths(spark, df).collect()}
    assert paths["host.example"] == "/div.col-#/div.entry-#.main"


LONG = "A long sentence of the body that goes on for a while. " * 8
MENU = "<div class=teasers><a href=x>another page of ours to read</a> <a href=y>and one more of them</a></div>"


@pytest.mark.parametrize(
    "page",
    [
        "<article><h1>Head</h1><div class=lead><p>Lead.</p></div><div class=body><p>{}</p></div></article>" + MENU,
        "<main><h1>Head</h1><section class=a><p>Lead.</p></section><section class=b><p>{}</p></section></main>" + MENU,
        "<article><div class=x><h1>Head</h1></div><div class=y><div><div><p>Lead.</p></div></div><div><div><p>{}</p></div></div></div></article>" + MENU,
        "<div id=page><h1>Head</h1><div class=lead><p>Lead.</p></div><div class=body><p>{}</p></div></div>" + MENU * 3,
        "<main><h1>Head</h1><article><p>Lead.</p><p>{}</p></article></main>" + MENU,
        "<div class=post><h1>Head</h1></div><div class=post><p>Lead.</p></div><div class=post><p>{}</p></div>",
    ],
)
def test_parts_in_wrappers_of_their_own(spark, page):
    want = f"Head\nLead.\n{LONG.strip()}"
    source = "<body><nav><p>menu</p></nav>" + page.format(LONG) + "<footer>F</footer></body>"
    assert html_extract.extract(source, None) == want and html_extract.extract(source, "/other") == want
    df = spark.createDataFrame([(n, "https://a.example/", source) for n in range(3)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract_pages(spark, df).collect()} == {want}


BODY = "A long sentence of the article that goes on for a while, and then some more. " * 6


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "page-with-header", "pageWithHeader", "layout-sidebar-left", "withoutMenu main", "search-page", "header-and-all"])
def test_names_that_only_mention(name):
    for key in ("class", "id"):
        page = f"<div {key}='{name}'><div class=sidebar><a href=x>link of a sidebar</a></div><p>{BODY}</p><p>{BODY}</p><div class=comments><p>{BODY * 9}</p></div></div>"
        assert html_extract.extract(f"<body>{page}</body>", None) == f"{BODY.strip()}\n{BODY.strip()}"
    around = f"<div class=site-header><div class=top-menu>menu words</div><article><p>short</p></article></div>"
    assert html_extract.extract(around, None) == "short"
    for out in ("sidebar", "siteHeader", "main-nav-box", "cookie-notice", "ad", "post_comments_list"):
        assert html_extract.extract(f"<div><div class='{out}'>gone</div><p>{BODY}</p></div>", None) == BODY.strip()


def plain_text(page):
    """What html.parser sees inside the outermost article elements of a page without anything to leave out."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        inside, done, part = 0, None, ""

        def cut(self):
            if joined := " ".join(self.part.split()):
                self.done.append(joined)
            self.part = ""

        def handle_starttag(self, tag, attributes):
            if tag == "article":
                self.inside += 1
            if self.inside and tag in html_extract.BLOCKS:
                self.cut()
            if self.inside and tag == "br":
                self.part += " "

        def handle_endtag(self, tag):
            if self.inside and tag in html_extract.BLOCKS:
                self.cut()
            if tag == "article":
                self.inside -= 1

        def handle_data(self, data):
            if self.inside:
                self.part += data

    reader = Reader()
    reader.done = []
    reader.feed(page)
    return "\n".join(reader.done)


@pytest.mark.parametrize("seed", range(4))
def test_extraction_against_a_plain_parser(spark, seed):
    """Hosts with several layouts, articles cut into sections, nested lists, tables and links, quoted > and character references."""
    rng = random.Random(seed)
    words = ["word", "a &amp; b", "caf&eacute;", "&#x41;bc", "<b>bold</b>", "<a href='x?a>b'>link</a>", "one<br>two", "<!-- <p>no</p> -->", "x &lt; y", "<i title=\"a>b\">i</i>"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(6, 25)))
    kinds = [lambda: f"<p>{line()}</p>", lambda: f"<h2>{line()}</h2>", lambda: f"<ul><li>{line()}</li><li>{line()}</li></ul>", lambda: f"<blockquote><p>{line()}</p></blockquote>", lambda: f"<div><div>{line()}</div></div>", lambda: f"<section><p>{line()}</p><p>{line()}</p></section>"]
    rows, want = [], {}
    for n in range(40):
        article = "".join(rng.choice(kinds)() for _ in range(rng.randrange(2, 9)))
        wrap = rng.choice(["<article>{}</article>", "<article class='post-{n}'>{}</article>", "<main><article><div class=body>{}</div></article></main>", "<article><section>{}</section></article>"])
        article = wrap.replace("{}", article).replace("{n}", str(n))
        page = f"<!doctype html><html><body class='has-sidebar'><header>site</header><nav><ul><li><a href=/>home</a></ul></nav><div class='wrap page-{n}'>{article}</div><aside>aside</aside><footer>foot</footer></body></html>"
        rows.append((n, f"https://host{n % 3}.example/{n}", page))
        want[n] = plain_text(article)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_extract.extract_pages(spark, df).collect()} == want


@pytest.mark.parametrize("page", ["<a " * 200_000, "<a \"" * 100_000, "< " * 300_000 + ">", "<a ' > '" * 60_000, "</i>" * 200_000, "<div>" * 100_000 + "deep" + "</div>" * 100_000, "<ul>" + "<span>" * 30_000 + "<li>" * 30_000, "<p>" + "<b>" * 50_000 + "<div>" * 50_000, "<script>" * 50_000, "<!--" * 100_000, "&amp" * 100_000, "<div " + "a=\"b\" " * 50_000 + ">x", "<div class='" + "a " * 100_000 + "'>x"])
def test_hostile_pages(page):
    import time

    began = time.thread_time()
    html_extract.extract(f"<div><p>{BODY}</p>{page}", "/div/p")
    html_extract.main_container(html_extract.parse(page))
    assert time.thread_time() - began < 12


def test_deep_pages_don_t_recurse():
    assert html_extract.extract("<div>" * 20_000 + "deep" + "</div>" * 20_000, None) == "deep"


def plain_align(p, t, limit):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != c), row[j] + 1, new[j - 1] + 1))
        row = new
    best = min(row)
    return (best, max(j for j, v in enumerate(row) if v == best)) if best <= limit else None


def codes(text):
    return np.array([ord(c) for c in text], np.uint32)


def edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        k, at = rng.random(), rng.randrange(len(t) or 1)
        if k < 0.4:
            t.insert(at, rng.choice("abcxyz"))
        elif k < 0.7 and t:
            t.pop(at)
        elif t:
            t[at] = rng.choice("abcxyz")
    return "".join(t)


@pytest.mark.parametrize("seed", range(10))
def test_banded_alignment(seed):
    rng = random.Random(seed)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(6))) + edited(rng, p, rng.randrange(5)) + "".join(rng.choice("abc") for _ in range(rng.randrange(6)))
        limit = rng.randrange(5)
        assert decontaminate.align(codes(p), codes(t), limit) == plain_align(p, t, limit)


@pytest.mark.parametrize("seed", range(4))
def test_filter_loses_no_region(seed):
    rng = random.Random(seed)
    items = [(i, awkward.prose(rng, rng.randrange(8, 50))) for i in range(30)]
    index = decontaminate.build(items)
    for _ in range(40):
        i, item = rng.choice(items)
        text = awkward.prose(rng, rng.randrange(60)) + " " + edited(rng, item, rng.randrange(len(item) // 9 + 1)) + " " + awkward.prose(rng, rng.randrange(60))
        folded = decontaminate.fold(text)
        found = {index.ids[n]: e for n, _, _, e in decontaminate.hits(folded, index)}
        for n, p in enumerate(index.texts):
            best = plain_align(p.tolist(), folded.tolist(), int(index.edits[n])) if index.ids[n] == i else None
            if best:
                assert found[i] == best[0]
        for n, s, length, e in decontaminate.hits(folded, index):
            assert plain_align(index.texts[n].tolist(), folded[s : s + length].tolist(), e) is not None


def test_contaminated_rows(spark, monkeypatch):
    rng = random.Random(9)
    items = [(1, awkward.prose(rng, 40)), (2, awkward.prose(rng, 30)), (3, None), (4, "?!"), (5, "Tiny one"), (6, awkward.prose(rng, 25))]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    rows = [*awkward.texts(), (80, "before " + items[0][1].upper().replace(" ", "\n ") + " after"), (81, edited(rng, items[1][1], 3)), (82, "a tiny, one here"), (83, items[0][1][: len(items[0][1]) // 2]), (None, items[5][1])]
    docs = awkward.documents(spark, rows)
    want = {(80, 1), (81, 2), (82, 5), (None, 6)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, docs, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, docs, bench).collect()} == want
    assert decontaminate.contaminated(spark, docs, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(spark, docs.limit(0), bench).collect() == []
    kept = decontaminate.drop_contaminated(spark, docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3 and kept.where(F.col("doc_id").isin(80, 81, 82)).count() == 0


@pytest.mark.parametrize("size", range(10, 32))
def test_short_items_keep_their_edits(size):
    rng = random.Random(size)
    for k in range(20):
        item = "".join(rng.choice("abcdefgh") for _ in range(size))
        text = "x" * rng.randrange(9) + " " + edited(rng, item, rng.randrange(size * 8 // 100 + 1)) + " " + "yz" * rng.randrange(9)
        index = decontaminate.build([(k, item)])
        best = plain_align(codes(item).tolist(), codes(text).tolist(), size * 8 // 100)
        assert [e for _, _, _, e in decontaminate.hits(decontaminate.fold(text), index)] == ([best[0]] if best else [])


def test_many_short_items_against_plain_alignment():
    """All lengths up to the q-gram bound at once: what plain alignment finds, the pieces find."""
    rng = random.Random(21)
    items = [(size, "".join(rng.choice("abcdefgh") for _ in range(size))) for size in range(1, 40)]
    index = decontaminate.build(items)
    for _ in range(150):
        size, item = rng.choice(items)
        text = "x" * rng.randrange(9) + " " + edited(rng, item, rng.randrange(size * 8 // 100 + 1)) + " " + "yz" * rng.randrange(9)
        folded = decontaminate.fold(text)
        found = {index.ids[n]: e for n, _, _, e in decontaminate.hits(folded, index)}
        for i, p in items:
            limit = i * 8 // 100
            if i <= 8:
                assert (i in found) == (f" {p} " in f" {text} ")
            else:
                best = plain_align(codes(p).tolist(), folded.tolist(), limit)
                assert found.get(i) == (best[0] if best else None)


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 50)
    bench = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((10, 30, 20, 70, 5, 5, 45))], "item_id long, text string")
    assert [[len(t) for _, t in block] for block in decontaminate._blocks(bench)] == [[10, 30], [20], [70], [5, 5], [45]]


def test_rows_without_id_are_decontaminated(spark, monkeypatch):
    bench = spark.createDataFrame([(1, awkward.prose(random.Random(3), 40)), (2, awkward.prose(random.Random(4), 30))], "item_id long, text string")
    held = [r.text for r in bench.collect()]
    docs = awkward.documents(spark, [(None, "before " + held[0]), (None, held[1] + " after"), (None, "a text of its own"), (None, None), (5, held[0]), (5, "other"), (6, "")])
    for _ in range(2):
        kept = decontaminate.without_contaminated(spark, docs, bench)
        assert kept.columns == docs.columns
        assert sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in kept.collect()) == [(-1, ""), (-1, "a text of its own"), (5, "other"), (6, "")]
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 1)
    assert decontaminate.without_contaminated(spark, docs, bench.limit(0)).count() == 7
