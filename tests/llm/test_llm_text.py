"""Operators 3, 4, 7, 8 and 10: personal data, rules, test items, pages, weak labels."""

import hashlib
import math
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from aidlens.llm import common, decontamination, html_text, pii, quality_rules, weak_labels
from conftest import SMALL

from .conftest import ODD, prose

# --- PII --------------------------------------------------------------------

PERSONAL = [
    "mail jo.98@mail5.example.com or +1 (017) 555-7713 now", "ip 187.50.237.187, card 4111 1111 1111 1111.", "no 256.1.1.1 nor 4111 1111 1111 1112",
    "a@b c@d.e.f@g.hi x@y.z.", "+12 +1234567890123456789 +1(2)3-4 5.6 7890", "1.2.3.4.5.6.7.8", "0000000000000 and 12345678901234567890", "",
]


def reference_spans(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    out = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(rules.values()) for m in re.finditer(p, text) if ok(m[0])]
    return ",".join(f"{list(rules)[k]}:{s}:{e}" for s, k, e in sorted(out))


@pytest.mark.parametrize("text", PERSONAL)
def test_base_spans(text):
    assert pii.shown(pii.base_spans(text)) == reference_spans(text)


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789012345 .-+()@aZé\n") for _ in range(rng.randint(0, 60)))
        assert pii.shown(pii.base_spans(text)) == reference_spans(text)


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)

    def card():
        digits = [rng.randint(0, 9) for _ in range(15)]
        return next(c for x in range(10) if pii.luhn(c := "".join(map(str, [*digits, x]))))

    texts = []
    for k in range(80):
        kind = [f"{prose(1, k)}.{rng.randint(10, 99)}@mail{k % 9}.example.com", ".".join(str(rng.randint(1, 254)) for _ in range(4)), card(),
                f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", str(rng.randint(1900, 2030))][k % 5]
        texts.append(f"{prose(3, k)} {kind} {prose(3, k + 1)}")
    return pii.train([(t, pii.base_spans(t)) for t in texts])


def test_decoding_is_the_best_of_all_segmentations(field):
    rng = random.Random(5)
    for text in ["x +1 (017) 555-7713 y", "4111111111111111 187.50.237.187", "a.b@c.de 12"]:
        atoms = pii._ATOM.findall(text)[:9]
        score = {(i, j): max(field.scores(f)) for i in range(len(atoms)) for j in range(i + 1, len(atoms) + 1) if (f := pii.features(atoms, i, j))}

        def best(i):
            if i == len(atoms):
                return 0.0
            return max([best(i + 1), *(s + best(j) for (a, j), s in score.items() if a == i)])

        got = sum(score[i, j] for i, j, _ in field.decode(atoms))
        assert got == pytest.approx(max(0.0, best(0)))
    assert rng


def test_long_runs_and_long_regions_cost_little(field):
    assert pii.base_spans("7" * 300_000 + " 1.2.3.4.5 " + "1." * 50_000)[0] == (300_001, 300_008, pii.KINDS.index("ip"))
    text = " ".join(str(100 + k % 900) for k in range(3_000))
    tracemalloc.start()
    base, spans = pii.all_spans(text, field)
    assert tracemalloc.get_traced_memory()[1] < 16_000_000
    tracemalloc.stop()
    assert [s for s in spans if s not in base and any(s[0] < e and b < s[1] for b, e, _ in base)] == []


def test_the_field_finds_what_the_patterns_merge(field):
    a, b = "4111111111111111", "187.50.237.187"
    base, spans = pii.all_spans(f"pay {a} {a} today, host {b} ok", field)
    assert [pii.KINDS[k] for _, _, k in base] == ["ip"]
    assert sorted(pii.KINDS[k] for _, _, k in spans) == ["card", "card", "ip"]


def test_plain_numbers_are_left_alone(field):
    for text in ["in 2024 we had 1,000 of 12 and 3.14", "no 4111111111111112 here", "token 5aad00685accefdd91653537b82ad0dab3", "v1.2.3 at 10:30"]:
        assert pii.all_spans(text, field) == ([], [])


def test_find_over_rows(odd, docs_of, field):
    assert pii.find(docs_of([]), pii.fit(docs_of([]))).collect() == []
    rows = pii.find(odd, field).collect()
    assert len(rows) == len(ODD)
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in rows)
    got = pii.find(docs_of(list(enumerate(PERSONAL))), field).collect()
    for r in got:
        want = reference_spans(PERSONAL[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k) for k in pii.KINDS]


def test_fit_learns_from_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert pii.fit(docs).weights


def test_mask_keeps_columns_and_nulls(odd, field):
    out = pii.mask(odd, field)
    assert out.columns == odd.columns
    assert sorted((r.text or "") for r in out.collect()) == sorted((t or "") for _, t in ODD)
    assert pii.masked_text("to a.b.12@mail4.example.com or 187.50.237.187!", field) == "to [EMAIL] or [IP]!"


# --- quality rules ----------------------------------------------------------


def reference_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    repeated = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = text.split("\n")
    dup = sum(1 for k, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line) and line in lines[:k])
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)]


def test_counts_equal_brute_force():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab c\n\t\r\x0b#*é ") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    for text in [*texts, *(t for _, t in ODD if t and len(t) < 3000)]:
        assert quality_rules.rule_stats(text)[0] == reference_stats(text)


def test_every_count_reaches_the_forest():
    plain = prose(60, 1)
    stats = lambda t: dict(zip(quality_rules.FEATURES, quality_rules.rule_stats(t)[1], strict=True))
    assert stats("")["word_length"] == stats("")["log_words"] == stats("")["dup_lines"] == 0
    assert stats("a b c\n\nd\na b c\na b c")["dup_lines"] == 0.5
    assert stats("a b c d a b c")["repeat_words"] == 6 / 7
    assert stats("x" * 100_000)["word_length"] == 60
    assert stats(plain)["log_words"] == pytest.approx(np.log(1 + len(plain.split())))


def test_paths_are_those_of_a_plain_walk():
    x = np.random.default_rng(2).normal(size=(300, 4))
    forest = quality_rules.grow(x, 20, 64, 1)
    for row in x[:20]:
        total = 0.0
        for t in range(20):
            node = 0
            while forest.feature[t, node] >= 0:
                node = forest.left[t, node] + (row[forest.feature[t, node]] >= forest.split[t, node])
            total += forest.path[t, node]
        assert forest.score(row[None])[0] == pytest.approx(2 ** (-total / 20 / forest.unit))
    far = np.full((1, 4), 9.0)
    assert forest.score(far)[0] > forest.score(np.zeros((1, 4)))[0]


def test_threshold_spares_good_rows():
    scores = np.array([0.1, 0.2, 0.3, 0.4, 0.8, 0.9])
    good = np.array([True, True, True, True, False, False])
    assert 0.4 < quality_rules.calibrated(scores, good, 0.0) < 0.8
    assert quality_rules.calibrated(scores, np.ones(6, bool), 0.1) == np.inf


def test_held_out_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    forest = quality_rules.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality_rules.measured(docs, forest).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    bad = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)
    assert sum(r.kept for r in good) >= 0.97 * len(good)


def test_one_row_of_each_labelled_id_is_learnt(docs_of, spark, monkeypatch):
    rows = [(k, prose(60, k)) for k in range(20)] + [(3, prose(60, 100 + k)) for k in range(50)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    seen = []
    grow = quality_rules.grow
    monkeypatch.setattr(quality_rules, "grow", lambda x, *rest: seen.append(x) or grow(x, *rest))
    for some in (rows, rows[::-1]):
        quality_rules.fit(docs_of(some), labels, sample=20)
    assert [len(x) for x in seen] == [20, 20]
    assert (seen[0] == seen[1]).all()


def test_rules_over_odd_rows(odd, docs_of, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.fit(odd, empty) is None
    rows = quality_rules.measured(odd, None).collect()
    assert sorted(r.n_words for r in rows) == sorted(len(common.WORD.findall(t or "")) for _, t in ODD)
    assert all(r.kept == (not r.base_failed) for r in rows)
    kept = quality_rules.kept_rows(odd, None)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert quality_rules.measured(docs_of([]), None).collect() == []


# --- benchmark --------------------------------------------------------------


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row), row.index(min(row))


def test_bit_parallel_distance():
    rng = random.Random(4)
    for _ in range(500):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        assert decontamination.nearest(decontamination.masks(item), len(item), text) == least_distance(item, text)


def test_matches_equal_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        items = [(k, "".join(rng.choice("abcd ") for _ in range(rng.randint(20, 60))).strip()) for k in range(4)]
        text = ""
        for _ in range(6):
            copy = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(["", "a", "bb"])
            text += "".join(copy) + "".join(rng.choice("abcd ") for _ in range(30))
        text = decontamination.normal(text)
        found = decontamination.Matcher(items, 0.1).matches(text)
        want = {k: d for k, t in items if (d := least_distance(t, text)[0]) <= int(0.1 * len(t))}
        assert {k: d for k, d, _, _ in found} == want
        assert all(least_distance(dict(items)[k], text[s:e])[0] == d for k, d, s, e in found)


def test_items_of_repeated_phrases_are_not_lost():
    """Pieces that occur again name false places, in any order, before the true one."""
    rng = random.Random(3)
    phrases = ["".join(rng.choice("abcdefgh ") for _ in range(12)) for _ in range(12)]
    some = lambda n: "".join(rng.choice(phrases) for _ in range(n))
    for _ in range(400):
        item = decontamination.normal(some(12))
        copy = list(item)
        for _ in range(6):
            copy[rng.randrange(len(copy))] = rng.choice(["", "a", "zz"])
        text = decontamination.normal(some(6) + "".join(copy) + some(6))
        distance = decontamination.nearest(decontamination.masks(item), len(item), text)[0]
        want = [(1, distance)] if distance <= int(0.06 * len(item)) else []
        assert [m[:2] for m in decontamination.Matcher([(1, item)], 0.06).matches(text)] == want


def test_items_in_blocks_and_odd_rows(spark, docs_of, odd):
    item = prose(30, 11)
    changed = item.replace(" ", "\n", 3).upper()[:-1] + "x"
    rows = [(1, f"{prose(50, 1)} {changed} {prose(20, 2)}"), (2, prose(90, 3)), (3, item), (3, item), (None, item), (4, None), (5, "")]
    bench = spark.createDataFrame([(1, item), (2, prose(25, 12)), (3, None), (4, ""), (5, " "), (None, prose(9, 4))], "item_id long, text string")
    for most in (10, 10_000):
        found = decontamination.find(docs_of(rows, extra=True), bench, most_chars=most).collect()
        assert sorted((str(r.doc_id), r.item_id, r.distance) for r in found) == [("1", 1, 1), ("3", 1, 0), ("3", 1, 0), ("None", 1, 0)]
        kept = decontamination.clean(docs_of(rows, extra=True), bench, most_chars=most)
        assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5]
    none = bench.limit(0)
    assert decontamination.find(odd, none).collect() == [] and decontamination.clean(odd, none).count() == len(ODD)
    assert decontamination.find(docs_of([]), bench).collect() == []


# --- pages ------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p><p>x";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- <p>hidden</p> -->
<div class="ad">Buy this now, it is long enough to look like text.</div>%s
<div id="comments"><p>I do not agree with this article at all, it is wrong in every way.</p></div>
<form><input value="x"><button>Send</button></form><footer>&copy; site <a href="/c">contact</a></footer></body></html>"""
BODY = """<%s><h1>A  title &amp; more</h1><p><b>First&nbsp;one</b> with a <a href="/x">link</a>,<br>and a break.<p>Second
paragraph of the article, %s</p><p>Short.</p><script>track()</script></%s>"""


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
def test_article_is_found_in_any_element(tag):
    page = PAGE % (BODY % (tag, prose(40, 5), tag))
    assert html_text.main_text(page) == "\n".join(
        ["A title & more", "First one with a link, and a break.", f"Second paragraph of the article, {prose(40, 5)}", "Short."]
    )


def test_article_of_the_given_pages(spark):
    import html

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        inner = re.search(r"<article>(.*)</article>", raw[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(filter(None, blocks))
        assert (r.text, r.n_chars) == (want, len(want))


ARTICLE = "".join(f"<p>{prose(60, k)}</p>" for k in range(6))
ARTICLE_TEXT = "\n".join(prose(60, k) for k in range(6))


@pytest.mark.parametrize("page", [
    f"<body><svg viewBox='0 0 1 1'/><div>{ARTICLE}</div></body>",
    f"<body><math/><div>{ARTICLE}</div><svg><text>drawn</text></svg></body>",
    f"<body><svg><style/><svg><text>a</text></svg><text>b</text></svg><div>{ARTICLE}</div></body>",
    f"<body><svg><path d='M0'><div>{ARTICLE}</div><svg></svg></body>",
    f"<body><svg><foreignObject><div>in a drawing</div></foreignObject></svg><div>{ARTICLE}</div></body>",
    f"<body><div><video src='v'></div><div>{ARTICLE}</div><p><video>old browser</video></p></body>",
    *(f"<body><{name}><div>{ARTICLE}</div></body>" for name in ("svg", "math", "object", "canvas", "audio", "video", "template")),
])
def test_embedded_elements_end_where_they_should(page):
    assert html_text.main_text(page) == ARTICLE_TEXT


@pytest.mark.parametrize("name", ["content has-sidebar", "no-comments", "article-header", "modal", "post with_related"])
def test_names_do_not_exclude_the_article(name):
    beside = "<div class='comments'><p>a comment on it</p></div>"
    page = f"<body><div class='share'>share it</div><div class='{name}'><div>{ARTICLE}</div>{beside}</div></body>"
    assert html_text.main_text(page) == ARTICLE_TEXT


def test_a_drawing_within_a_line_does_not_part_it():
    page = f"<body><div>{ARTICLE}<p>before <a href='/x'><svg><text>x</text></svg>a link</a> after</p></div></body>"
    assert html_text.main_text(page) == f"{ARTICLE_TEXT}\nbefore a link after"


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "<p>", "</p></div>", "<a href='x'>y", "<script>", "<!--", "<p>" * 3000, "<div>" * 3000 + "x", "a<b", "<p class=>x", "&#xZZ; &amp"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page), str)


LONG = "".join(f"<p>{prose(100, 50 + k)}</p>" for k in range(80))


@pytest.mark.parametrize("beside", ["class='comments'", "class='cookie-notice'", "id='comment-list'", "class='site notice'", "class='advert'", "class='ad big'"])
@pytest.mark.parametrize("page", [
    "<body><div>{a}</div><div {b}>{c}</div></body>", "<body><article>{a}<div {b}>{c}</div></article></body>", "<body><main><div>{a}</div><section {b}>{c}</section></main></body>",
    "<body><div {b}>{c}</div><div class='sidebar'><h1></h1>{c}</div><main>{a}</main></body>",
])
def test_what_is_named_as_beside_goes_whatever_its_size(page, beside):
    short = "".join(f"<p>{prose(40, k)}</p>" for k in range(2))
    assert html_text.main_text(page.format(a=short, b=beside, c=LONG)) == f"{prose(40, 0)}\n{prose(40, 1)}"


@pytest.mark.parametrize("page", ["<div class='modal'><article>{a}</article></div>", "<div class='sidebar'><h1>Title</h1>{a}</div>", "<div class='page header'><div><h1>Title</h1></div>{a}</div>"])
def test_what_encloses_the_article_stays(page):
    text = html_text.main_text(f"<body><div>{'<p>a line</p>' * 3}</div>{page.format(a=ARTICLE)}</body>")
    assert text.endswith(ARTICLE_TEXT)


def test_adverts_in_a_line_go():
    page = f"<body><div>{ARTICLE}<p>one <span class='advert'>buy <span>this</span> now</span>two <b id=ads>x</b>three <i>four</i></p></div></body>"
    assert html_text.main_text(page) == f"{ARTICLE_TEXT}\none two three four"


def test_sections_and_what_they_hold_stay():
    more = "<div><h2>Part two</h2><p>Short end.</p></div><p hidden>not shown</p>"
    want = f"{ARTICLE_TEXT}\nPart two\nShort end."
    assert html_text.main_text(f"<body><div><div>{ARTICLE}</div>{more}</div></body>").startswith(want)
    page = f"<article><div>{ARTICLE}</div>{more}<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <object>an object</object></p></article>"
    assert html_text.main_text(page) == f"{want}\nnot shown\nso x=1 and an object"


@pytest.mark.parametrize("part", ["<a ", "<a \"", "<a '\"", "<!", "<", "</p>", "<p><section>", "<svg>", "<a href=\">", "<span class=ad>", "<div><h1>"])
def test_time_is_linear_in_the_page(part):
    times = []
    for n in (10_000, 80_000):
        start = time.process_time()
        html_text.main_text(part * n)
        times.append(time.process_time() - start)
    assert times[1] < 24 * times[0] + 1


def test_densities_sums_and_choice_equal_the_definition():
    rng = random.Random(17)

    def made(depth):
        name = rng.choice(["div", "section", "ul", "blockquote"])
        inner = "".join(made(depth - 1) if depth and rng.random() < 0.6 else rng.choice(
            [f"<p>{prose(rng.randint(1, 30), rng.random())}</p>", f"<a href='x'>{prose(3, rng.random())}</a>", "text ", "<b>bold</b>"]) for _ in range(rng.randint(1, 4)))
        return f"<{name}>{inner}</{name}>"

    def sums(node):
        """(characters, tags, link characters, link tags) by going down each time."""
        out = [*own[id(node)]]
        for child in node.blocks():
            out = [a + b for a, b in zip(out, sums(child))]
            out[1] += 1
        return out

    def walk(node):
        yield node
        for child in node.blocks():
            yield from walk(child)

    for _ in range(60):
        root = html_text.parse(f"<body>{made(4)}{made(3)}</body>")
        own = {id(n): (n.chars, n.tags, n.link_chars, n.link_tags) for n in walk(root)}
        whole = sums(root)
        want = {}
        for node in walk(root):
            c, t, lc, lt = sums(node)
            t, lt, lx = max(t, 1), max(lt, 1), max(lc, 1)
            base = math.log(c / max(c - lc, 1) * lc + whole[2] / max(whole[0], 1) * c + math.e) if c else 0
            want[id(node)] = 0.0 if not c else c / t * math.log(c * t / (lx * lt)) / (math.log(base) if base > 1 else 1) if c * t > lx * lt else c / t * 1e-3
        order = html_text.weigh(root)
        assert [id(n) for n in order] == [id(n) for n in walk(root)]
        for node in order:
            assert node.density == pytest.approx(max(want[id(node)], 0.0))


def test_text_without_markup_is_kept():
    assert html_text.main_text("just   a line") == "just a line"


def test_pages_with_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<p>" + "word " * 50_000 + "</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    out = html_text.extract(pages).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 0, 249_999]
    assert html_text.extract(pages.limit(0)).collect() == []


# --- weak labels ------------------------------------------------------------


def test_estimation_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    right, speaks = np.array([0.9, 0.8, 0.95, 0.7]), np.array([0.9, 0.7, 0.5, 0.8])
    votes = np.where(rng.random((20_000, 4)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes = np.where(rng.random((20_000, 4)) < speaks, votes, 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.estimate(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.05 and np.abs(model.accuracy() - right).max() < 0.06


def test_posterior_is_bayes_rule():
    model = weak_labels.LabelModel(0.7, np.array([[[0.6, 0.3, 0.1], [0.1, 0.2, 0.7]], [[0.5, 0.4, 0.1], [0.2, 0.2, 0.6]]]))
    got = model.posterior(np.array([[1, -1], [0, 1]]))
    want = [0.7 * a / (0.7 * a + 0.3 * b) for a, b in ((0.7 * 0.2, 0.1 * 0.5), (0.2 * 0.6, 0.3 * 0.1))]
    assert got == pytest.approx(want)


def test_score_is_the_vectors_product():
    scorer = weak_labels.Scorer(np.random.default_rng(0).normal(size=1 << 12))
    for text in ("", "one", prose(200, 3), "a a a B! 12"):
        words = common.WORD.findall(text)
        at, value = scorer.vector(words)
        assert scorer.score(words) == pytest.approx(scorer.weights[at] @ value)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = weak_labels.classify(docs, weak_labels.fit(docs)).join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1


def test_weak_labels_over_odd_rows(odd, docs_of):
    assert weak_labels.classify(docs_of([]), weak_labels.fit(docs_of([]))).collect() == []
    assert len(weak_labels.classify(odd, weak_labels.fit(odd)).collect()) == len(ODD)


def test_forest_and_threshold_come_from_all_labelled_rows(spark, rows):
    """The threshold by counts equals the one over all scores at once, and no labelled row is left out."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    good = rng.random(3000) < 0.8
    scores = np.round(np.where(good, rng.normal(0.4, 0.05, 3000), rng.normal(0.5, 0.05, 3000)), 3).clip(0, 1)
    table = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(scores, good)], "score double, good boolean").repartition(4)
    for spare in (0.0, 0.005, 0.2):
        assert quality_rules.threshold(table, spare) == pytest.approx(quality_rules.calibrated(scores, good, spare))
    assert quality_rules.threshold(table.filter("good"), 0.1) == np.inf
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("w"), (F.col("doc_id") * k).cast("string"))))
    docs = spark.range(1, 9001).withColumnRenamed("id", "doc_id").withColumn("text", text)
    read, grow = [], quality_rules.grow
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality_rules, "threshold", lambda scored, spare: read.append(scored.count()) or 1.0)
        m.setattr(quality_rules, "grow", lambda x, *rest: read.append((len(x), rest[-1].shape)) or grow(x, *rest))
        quality_rules.fit(docs, docs.select("doc_id", F.lit(1.0).alias("quality")), trees=200)
    assert read[0][0] > 8900 and read[0][1] == (200, 256) and read[1] == 9000
