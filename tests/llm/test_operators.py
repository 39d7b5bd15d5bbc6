"""Each operator against brute force, an exact round trip or held-out accuracy, with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns whose names clash with the operators' own."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickfold.llm import decontamination, histogram_sort, hyperdimensional, license_scan, lsh_forest, packing, prefix_tree, quality_rules, queries, shared, warc, wrapper_induction

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, pool=400):
    dice = random.Random(seed)
    names = ["".join(dice.choice("abcdefghij") for _ in range(dice.randint(2, 8))) for _ in range(pool)]
    return [dice.choice(names) for _ in range(n)]


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("kept", "_w", "shard", "key", "size", "score", "lang_pred", "node", "component", "component_id", "deal", "start", "ids", "length", "digest", "a", "b", "_group", "_kept", "_text"):
        df = df.withColumn(c, F.lit("clash"))
    return df


LONG = " ".join(words(30_000, 1))
ODD = [(None, "a null id with some words"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, LONG), (7, LONG), (7, LONG), (8, "%%% &&& ###"), (9, "日本語 текст ünïcode 😀 " * 5), (10, "x\x00y \x1c z")]


def empty(spark):
    return docs_of(spark, []).limit(0)


# ---- quality rules


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    g = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, cover = collections.Counter(g), set()
    for i, x in enumerate(g):
        if n[x] > 1:
            cover.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark):
    rep = "a b c d e f g h\na b c d e f g h\n\n"
    texts = [*ODD, (20, rep * 3), (21, " ".join("abcdefgh" * 3)), (22, "x " * 9), (23, "p q r s t u v w x " * 2 + "end"), (24, "same\nsame\n same\n")]
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs_of(spark, texts), labels).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=key) == sorted([(i, *counts(t)) for i, t in texts], key=key)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (r.kept == (not r.base_failed)) for r in got)
    assert quality_rules.quality_rules(empty(spark), labels.limit(0)).count() == 0


def test_cutoffs_are_safe_and_useful(spark):
    dice = random.Random(5)
    texts, marks = [], []
    for i in range(6000):
        good = i % 4 != 0
        t = " ".join(dice.choice("alpha beta gamma delta omega".split()) + str(dice.randint(0, 10**6)) + ("" if good else "%%%") for _ in range(30))
        texts.append((i, t))
        marks.append((i, int(good), 0))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(docs_of(spark, texts), labels).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in out)
    # random labels tell nothing: no good document may go
    noise = spark.createDataFrame([(i, dice.randint(0, 1), 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    measured = shared.cut(quality_rules.measures(docs_of(spark, texts)), "test")
    assert not quality_rules.calibrate(measured, noise)["en"].get("symbols")


def test_kept_equals_a_plain_calibration(spark):
    """Rates, exact tails and choices made by hand, over two languages, one with too few labels."""
    import math

    dice, texts, marks = random.Random(8), [], []
    for i in range(4000):
        bad = i % 3 == 0
        junk = ["%%%"] * dice.choice([0, 0, 1, 6] if bad else [0, 0, 0, 0, 0, 0, 1]) + ["!"] * dice.choice([0, 4] if bad else [0, 0, 0, 1])
        texts.append((i, " ".join([f"w{dice.randrange(10**6)}" for _ in range(30)] + junk)))
        marks.append((i, int(not bad), 0))
    df = docs_of(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "rare").when(F.col("doc_id") % 10 < 4, None).otherwise("en"))
    out = quality_rules.quality_rules(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    of = lambda i: "rare" if i % 10 == 0 else "und" if i % 10 < 4 else "en"
    rules = quality_rules.RULES
    rate = {r.doc_id: {k: r[k] for k in rules} for r in out if not r.base_failed}
    strata = {s: [i for i in rate if of(i) == s] for s in ("en", "und", "rare")}
    strata = {s: x for s, x in strata.items() if sum(i % 3 != 0 for i in x) >= math.log(0.05 / 5) / math.log(0.99)}
    assert set(strata) == {"en", "und"}
    chosen = {}
    for s, own in strata.items():
        good, bad = [i for i in own if i % 3], [i for i in own if i % 3 == 0]
        for k in rules:
            best = 0.0
            for c in quality_rules.GRID:
                lost = sum(rate[i][k] > c for i in good)
                if sum(math.comb(len(good), j) * 0.01**j * 0.99 ** (len(good) - j) for j in range(lost + 1)) > 0.05 / (2 * len(rules)):
                    break
                gain = sum(rate[i][k] > c for i in bad) / len(bad) - 10 * lost / len(good)
                if gain > best:
                    best, chosen[s, k] = gain, c
    assert chosen and {r.doc_id: r.kept for r in out} == {r.doc_id: not r.base_failed and all(r[k] <= chosen.get((of(r.doc_id), k), 9) for k in rules) for r in out}
    assert {r.kept for r in out if of(r.doc_id) == "rare"} == {True}


def test_binomial_tail():
    assert quality_rules.binomial_tail(0, 10, 0.1) == pytest.approx(0.9**10)
    assert quality_rules.binomial_tail(10, 10, 0.1) == pytest.approx(1)
    assert quality_rules.binomial_tail(2, 50, 0.1) == pytest.approx(sum(__import__("math").comb(50, i) * 0.1**i * 0.9 ** (50 - i) for i in range(3)))
    assert quality_rules.binomial_tail(0, 0, 0.1) == 1


# ---- wrapper induction


def page(i, body, nav="home news", article=True, extra=""):
    wrap = f"<article>{body}</article>" if article else f"<div id=x>{body}</div>"
    return (i, f"https://Host.example.org/{i}", f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>{nav}</a></li></ul></nav><!-- c --><div class=\"ad\">buy</div>{wrap}{extra}<footer>&copy; host</footer></body></html>")


def test_main_text_of_articles(spark):
    rows = [
        page(1, "<h1>Title &amp; more</h1><p><b>First<br>line\n  two<p>Caf&eacute;&nbsp;<i>x</i>y &lt;tag&gt;</p><ul><li>one<li>two</ul>"),
        page(2, "<p>Text</p><div class='comments'><p>nice</p></div><aside>side</aside><form><p>mail</p></form><section id='respond'>r</section>"),
        page(3, "<header><h1>Head</h1></header><p>Body</p>", extra="<div class='cookie-notice'>We use cookies</div><article class='comment'>hey</article>"),
        (4, None, None), (None, "", ""), (5, "http://h/5", "just text &amp; <b>bold</b>"), (6, "http://h/6", "<p>" + "w " * 60_000 + "</p>"), (6, "http://h/6", "<div>" * 3000 + "deep" + "</div>" * 3000), (7, "x", "<p>a < b and c<1</p><p>unclosed <b"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in wrapper_induction.main_text(df).collect():
        got[r.page_id].append(r.text)
    assert got[1] == ["Title & more\nFirst line two\nCafé xy <tag>\none\ntwo"]
    assert got[2] == ["Text"] and got[3] == ["Head\nBody"] and got[4] == [""] and got[None] == [""] and got[5] == ["just text & bold"]
    assert sorted(map(len, got[6])) == [4, 119_999] and got[7][0].startswith("a < b and c<1")
    assert wrapper_induction.main_text(df.limit(0)).count() == 0


def test_template_is_learned_from_pages_without_article(spark):
    rows = [page(i, f"<div class='k'>Welcome to our site</div><p>{' '.join(words(20, i))}</p><p>{' '.join(words(12, -i - 1))}</p><div class='k'>All prices in euro</div>", article=False) for i in range(20)]
    got = wrapper_induction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == " ".join(words(20, r.page_id)) + "\n" + " ".join(words(12, -r.page_id - 1)) for r in got)


def texts_of(spark, rows, **more):
    return {r.page_id: r.text for r in wrapper_induction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **more).collect()}


def own_words(i):
    return f"<p>{' '.join(words(20, i))}</p><p>{' '.join(words(12, -i - 1))}</p>"


def test_slots_that_first_pages_lack_and_other_wordings(spark):
    rows = [page(i, ("" if i == 0 else "<div>Opening hours as usual</div>") + own_words(i) + f"<div>{'We moved' if i < 2 else 'Thanks for reading us'}</div>", article=False) for i in range(20)]
    got = texts_of(spark, rows)
    for i in range(2, 20):
        assert got[i] == "\n".join(" ".join(words(n, k)) for n, k in ((20, i), (12, -i - 1)))
    assert "hours" not in got[1] and "hours" not in got[0]
    off = texts_of(spark, rows, induction=False)
    assert all("Thanks for reading us" in off[i] and "Thanks" not in got[i] for i in range(2, 20))


def test_class_words_only_break_ties(spark):
    said = "<p>First</p><div class='notice'><p>Second, long enough to be read</p></div><section class='discussion'><p>Third</p></section><div class='story related-work'>Fourth</div>"
    rows = [(1, "http://a/1", f"<article class='post no-sidebar comments-open'>{said}<div class='ad-box'>Buy</div><ul class='comment-list'><li>nice</li></ul></article>")]
    rows += [(i, f"http://b/{i}", f"<div class='content with-sidebar'>{own_words(i)}</div><div class='sidebar'>{' '.join(words(3, i))}</div>") for i in range(2, 5)]
    rows += [(5, "http://c/5", f"<form id=aspnetForm><div class='main-wrapper'><article>{own_words(5)}</article></div></form>"), (6, "http://c/6", f"<div class='comments'>{'all of the page ' * 9}</div>")]
    got = texts_of(spark, rows)
    assert got[1] == "First\nSecond, long enough to be read\nThird\nFourth"
    assert got[3] == "\n".join(" ".join(words(n, k)) for n, k in ((20, 3), (12, -4))) and got[5].count("\n") == 1 and got[6].startswith("all of the page")


def test_constant_parts_of_articles_and_copies_of_articles(spark):
    """A box in all articles goes, an article that is all over its host stays."""
    rows = [page(i, own_words(i) + "<p>Read more on our site</p>") for i in range(20)]
    rows += [(100 + i, f"http://copies/{i}", page(i, "<h1>One</h1>" + own_words(7), nav=f"n{i}")[2]) for i in range(30)]
    got = texts_of(spark, rows)
    assert not any("Read more" in got[i] for i in range(20)) and {got[100 + i] for i in range(30)} == {"One\n" + "\n".join(" ".join(words(n, k)) for n, k in ((20, 7), (12, -8)))}


def test_scripts_references_and_depth(spark):
    rows = [(1, "u", "<p>a</p><script src=a/>var x=1;</script><p>b</p>"), (2, "u2", "<p>&am<b>p;lt;</b> &lt;</p>"), (3, "u3", "<div>" * 500 + "<p>deep</p><nav>menu</nav>" + "<nav>" * 2000 + "x" + "</nav>" * 2000 + "<p>end</p>" + "</div>" * 500), (4, "u4", "<svg/><p>c</p><p>d<svg><text>no</text></svg></p>"), (5, "u5", "<p>one<div>two</div>three"), (6, "u6", "<span><p>in</p></span>")]
    got = texts_of(spark, rows)
    assert got == {1: "a\nb", 2: "&amp;lt; <", 3: "deep\nend", 4: "c\nd", 5: "one\ntwo\nthree", 6: "in"}


def test_pages_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(wrapper_induction, "GROUP", 50)
    rows = [(i if i % 9 else None, f"http://host{i % 100 // 70}/{i}", page(i, "<div>Opening hours</div>" * (i % 3 > 0) + own_words(i // 2), article=i % 5 == 0)[2]) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, *others = (sorted(map(str, wrapper_induction.main_text(df.repartition(n)).collect())) for n in (1, 4, 64))
    assert all(x == one for x in others) and len(one) == 400
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    assert sorted(map(str, wrapper_induction.main_text(df).collect())) == one
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_matching_equals_a_plain_tree_matcher():
    def plain(a, b):
        if a.key != b.key:
            return 0
        x, y = a.blocks, b.blocks
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain(x[i], y[j]))
        return 1 + m[-1][-1]

    def made(dice, depth):
        return "".join(f"<{t}>{made(dice, depth - 1)}</{t}>" for t in dice.choices(["div", "section", "ul"], k=dice.randint(0, 4) if depth else 0))

    for seed in range(150):
        dice = random.Random(seed)
        a, b = (wrapper_induction.parse(made(dice, 3)) for _ in range(2))
        pairs = []
        size = wrapper_induction.match(wrapper_induction.Slot(a), b, pairs)
        assert size == plain(a, b) == len(pairs) == len({id(n) for _, n in pairs})


def test_tree_matching_keeps_order():
    slot = wrapper_induction.Slot(wrapper_induction.parse("<div><p>a</p><h2>b</h2><p>c</p></div>"))
    assert wrapper_induction.match(slot, wrapper_induction.parse("<div><h2>b</h2><p>c</p></div>"), []) == 4
    assert wrapper_induction.match(slot, wrapper_induction.parse("<div><h2>b</h2><table></table><p>c</p></div>"), []) == 4
    assert wrapper_induction.match(slot, wrapper_induction.parse("<section></section>"), []) == 1


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in queries.op2_wrapper_induction(spark, SF).collect():
        body = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


# ---- licences


def test_license_scan_against_brute_force(spark):
    near = license_scan.TEMPLATES["MIT-grant"].replace("without limitation", "with no limits")
    texts = [*ODD, (30, "Intro. licensed UNDER the apache license,  version 2.0 and more"), (31, " ".join(words(500, 3)) + "\n" + near + "\n" + LONG[:4000]), (32, "Permission is hereby granted to nobody"), (33, "All rights\nreserved."), (34, "rights reserved all")]
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan(docs_of(spark, texts)).collect()}
    expected = {}
    plain = lambda t: [w for x in (t or "").lower().split() if (w := x.strip(license_scan.EDGE))]
    for i, t in texts:
        w = plain(t)
        for name, template in license_scan.TEMPLATES.items():
            x = plain(template)
            q = min(5, len(x))
            own = {tuple(x[k : k + q]) for k in range(len(x) - q + 1)}
            share = len(own & {tuple(w[k : k + q]) for k in range(len(w) - q + 1)}) / len(own)
            if share >= 0.8:
                expected[i, name] = share
    assert got == pytest.approx(expected) and {30, 31, 33} == {i for i, _ in got}
    assert license_scan.scan(empty(spark)).count() == 0
    assert (1 - license_scan.CONTAINED / (3 - license_scan.CONTAINED)) ** license_scan.bands_for(license_scan.CONTAINED / (3 - license_scan.CONTAINED)) <= license_scan.MISS


def test_bands_hold_their_promise_for_every_template():
    """Windows that hold just CONTAINED of a template, and otherwise other words: the bands miss them as seldom as said."""
    library = license_scan.Library({**license_scan.TEMPLATES, "long": " ".join(words(700, 4, 5000))})
    for (size, m), own in library.classes.items():
        for name, full in own:
            if m > 1:
                n, held = len(full), -(-len(full) * 4 // 5)
                jaccard = held / (2 * m + n - held)
                assert (1 - jaccard) ** library.bands[size, m] <= license_scan.MISS, name


def test_stretched_notice_and_templates_of_a_table(spark):
    full = " ".join(words(300, 6, 5000))
    table = spark.createDataFrame([("L", full), ("none", None)], "name string, text string").withColumn("doc_id", F.lit("clash"))
    templates = license_scan.templates_of(table)
    w = full.split()
    spread = " ".join(w[:150] + words(100, 9) + w[150:])
    got = license_scan.scan(docs_of(spark, [(1, LONG[:5000] + " " + spread + " " + LONG[:3000]), (2, " ".join(w[:200]))]), templates).collect()
    at = len(license_scan.word_hashes(LONG[:5000]))
    assert [(r.doc_id, r.license, r.first_word, r.n_words) for r in got] == [(1, "L", at, 400)]
    with pytest.raises(ValueError):
        license_scan.templates_of(table, most_bytes=10)


# ---- histogram sort


def check_shards(rows, texts, shards):
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((i is not None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in texts)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    return {k: sum(r.size for r in v) for k, v in by.items()}


def test_shards_of_odd_texts(spark):
    check_shards(histogram_sort.shard(docs_of(spark, ODD), 24).collect(), ODD, 24)
    assert histogram_sort.shard(empty(spark), 24).count() == 0
    assert [r.shard for r in histogram_sort.shard(docs_of(spark, ODD), 1).collect()] == [0] * len(ODD)


@pytest.mark.parametrize("hot", [0, 1500])
def test_shards_are_even_and_groups_stay_together(spark, hot):
    texts = [(i, " ".join(words(20 + i % 30, i))) for i in range(3000)] + [(-1 - i, "the same text again and again") for i in range(hot)] + [(10_000 + i, f"pair {i // 2} " * 5) for i in range(300)]
    rows = histogram_sort.shard(docs_of(spark, texts), 8, cell_rows=200).collect()
    sizes = check_shards(rows, texts, 8)
    mean, most = sum(sizes.values()) / 8, max(r.size for r in rows)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 0.02 * mean + 2 * most
    of = collections.defaultdict(set)
    for r in rows:
        of[r.text_crc32].add(r.shard)
    together = sum(len(v) == 1 for k, v in of.items())
    assert together >= len(of) - 7  # only a group that a splitter has to cut


@pytest.mark.parametrize("cell_rows", [100, 50_000])
def test_slots_follow_the_keys_at_every_size(spark, cell_rows):
    texts = [(i, f"text {i} " * (1 + i % 9)) for i in range(1500)] + [(i, "hot") for i in range(2000, 2800)] + [(7, "twice")] * 300
    rows = histogram_sort.shard(docs_of(spark, texts), 5, cell_rows=cell_rows).collect()
    check_shards(rows, texts, 5)
    order = [(r.key, r.doc_id) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


# ---- chats


TURNS = "conv_id long, turn long, role string, text string"


def test_prefix_trees_round_trip(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "user", None), (1, 1, None, "x\\<"), (2, None, "user", "late"), (2, 0, "assistant", "<turn assistant>\n</turn>\n\\"), (None, 0, "assistant", "<|endoftext|> ünï 😀\r\n "), (3, 0, "as>sis\\tant", ""), (4, 0, "user", "same"), (4, 0, "user", "same")]
    for i in range(100, 400):
        rows += [(i, 0, "system", "shared start"), (i, 1, "user", f"question {i % 7}"), (i, 2, "assistant", f"answer {i % 50}")]
    df = spark.createDataFrame(rows, TURNS).withColumn("key", F.lit("clash")).withColumn("t", F.lit("clash"))
    path = queries.tokenizer_path("byte_bpe_50k.json")
    trees = shared.cut(prefix_tree.positions(prefix_tree.trees(df, path, most=400)), "trees")
    back = {r.conv_id: r for r in prefix_tree.read_back(trees, path).collect()}
    by = collections.defaultdict(list)
    for c, *r in rows:
        by[c].append(r)
    assert set(back) == set(by)
    for c, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        assert back[c].roles == [t[1] or "" for t in turns] and back[c].texts == [t[2] or "" for t in turns]
        assert back[c].loss == "".join(t[2] or "" for t in turns if t[1] == "assistant")
    some = trees.collect()
    assert sum(len(t.ids) for t in some) < 0.5 * sum(len(prefix_tree.tokenizer(path).encode(r.formatted).ids) for r in back.values())
    for t in some:
        assert len(t.position_ids) == len(t.ids)
        for n in t.nodes:
            assert n.position == sum(a.end - a.start for a in n.attends) and all(a.end <= n.start for a in n.attends)
    assert prefix_tree.trees(df.limit(0), path).count() == 0


def test_formatted_query(spark):
    r = {x.conv_id: x for x in queries.op5_prefix_tree(spark, SF).collect()}
    said = r"\### Assistant: </turn> ok"
    assert r[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and r[-7].loss_chars == len(said)


# ---- languages


def test_languages(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = hyperdimensional.identify(docs, docs, carry=("doc_id", "lang")).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_languages_of_odd_texts(spark):
    df = docs_of(spark, ODD)
    got = hyperdimensional.identify(df, df).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 8)} == {"und"} and {r.lang_pred for r in got if r.doc_id in (6, 7)} == {"en"}
    assert {r.lang_pred for r in hyperdimensional.identify(df, df.where("false")).collect()} == {"und"}
    assert hyperdimensional.identify(empty(spark), empty(spark)).count() == 0


def test_predictions_equal_a_plain_predictor(spark):
    """Dense vectors made letter by letter, for every document of the smallest table."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    s = hyperdimensional.Space()

    @__import__("functools").cache
    def gram(x):
        a, b, c = (s.letters[s.of[ord(k)] if k != " " else 0].astype(int) for k in x)
        return np.roll(a, 2) * np.roll(b, 1) * c

    def bundle(text):
        v, n = np.zeros(hyperdimensional.DIMENSIONS), collections.Counter()
        for w in "".join(k if k.isalpha() else " " for k in text or "").split():
            w = f" {w} "
            n.update(w[i : i + 3] for i in range(len(w) - 2))
        for x, k in n.items():
            v += k * gram(x)
        return v

    own, made = collections.defaultdict(lambda: 0), {i: bundle(t) for i, t, _ in rows}
    for i, t, lang in rows:
        if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
            own[lang] = own[lang] + made[i]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in hyperdimensional.identify(df, df, carry=("doc_id",)).collect():
        v = made[r.doc_id]
        cosines = {k: p @ v / np.linalg.norm(p) / np.linalg.norm(v) for k, p in own.items()} if v.any() else {}
        if cosines:
            assert cosines[r.lang_pred] == pytest.approx(max(cosines.values())) and r.score == pytest.approx(max(0, max(cosines.values())), abs=1e-6)
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_bundles_are_sums_of_bound_letters():
    s = hyperdimensional.Space(64, 1)
    codes, n = s.trigrams("Abba, abba!")
    assert n.sum() == 8 and len(codes) == 4  # " ab", "abb", "bba", "ba ", twice each
    v = np.zeros(64)
    for x in (" ab", "abb", "bba", "ba "):
        a, b, c = (s.letters[0 if k == " " else ord(k) - 96].astype(int) for k in x)
        v += 2 * np.roll(a, 2) * np.roll(b, 1) * c
    assert np.array_equal(s.bundle(codes, n), v)


# ---- archives


def test_archives_round_trip(spark):
    big = "<p>" + "x" * 300 + "</p>"
    rows = [(5, "http://a/ b\n", big), (3, "http://b/", big), (9, None, big), (None, "u", big), (3, "http://b/", big), (4, "c", "tiny"), (6, "d", "tiny"), (7, "e", None), (8, "f", ""), (10, "g", "é" * 500_000), (11, "http://x/%20y", "\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first", F.lit("clash"))
    index = warc.archive(df)
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index).collect()]
    expected = []
    for i, u, h in rows:
        b = (h or "").encode()
        again = h == big and i != 3
        expected.append((i, u, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert sorted(map(str, got)) == sorted(map(str, expected))
    one = index.orderBy("path", "offset").collect()
    assert all(a.offset + a.length == b.offset for a, b in zip(one, one[1:]) if a.path == b.path)
    sidecar = spark.read.json(one[0].path + ".idx").collect()
    assert [(x.offset, x.length) for x in sidecar] == [(x.offset, x.length) for x in one if x.path == one[0].path]
    again = warc.read(warc.normalise(index.select("path").distinct(), shared.new_path(spark, "again")))  # many members in, the same out
    assert sorted(map(str, [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in again.collect()])) == sorted(map(str, expected))
    assert warc.read(warc.archive(df.limit(0))).count() == 0


def test_truncated_stream_is_an_error():
    raw = warc.record(1, "u", b"payload", "d", "response", None)
    assert list(warc.records(iter([raw[:10], raw[10:] + raw]))) == [raw, raw]
    with pytest.raises(ValueError):
        list(warc.records(iter([raw[:-3]])))


def test_cut_gzip_streams_are_errors():
    import gzip

    whole = gzip.compress(b"".join(warc.record(i, "u", b"payload" * 50, "d", "response", None) for i in range(5)))
    inflate = lambda raw: list(warc.records(warc.inflated(pa.BufferReader(raw))))
    assert len(inflate(whole)) == 5 and len(inflate(whole + whole)) == 10
    z = __import__("zlib").compressobj(9, 8, 31)
    three = b"".join(z.compress(warc.record(i, "u", b"payload", "d", "response", None)) for i in range(3)) + z.flush(__import__("zlib").Z_SYNC_FLUSH)
    for raw in (whole[:-8], whole[:-1], whole[: len(whole) // 2], three):
        with pytest.raises(ValueError, match="inside a gzip member"):
            inflate(raw)


def test_archives_of_other_tools(spark, tmp_path):
    import gzip

    def made(kind, block, *more):
        return "\r\n".join(["WARC/1.0", f"WARC-Type:{kind}", f"WARC-Record-ID: <urn:x:{kind}>", *more, f"content-length:   {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    parts = [made("warcinfo", b"software: x\r\n"), b"\r\n", made("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Target-URI: http://a/", "X-Folded: one", "\ttwo"), made("response", http, "WARC-Target-URI: http://a/\u00e9", "Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:ABC"), made("metadata", b"")]
    (tmp_path / "other.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    archives = spark.createDataFrame([(f"file://{tmp_path}/other.warc.gz",)], "path string")
    index = warc.normalise(archives, shared.new_path(spark, "other"))
    rows = {r.type: r for r in index.collect()}
    assert {k: (r.record_id, r.uri, r.digest, r.page_id) for k, r in rows.items()} == {"warcinfo": ("<urn:x:warcinfo>", None, None, None), "request": ("<urn:x:request>", "http://a/", None, None), "response": ("<urn:x:response>", "http://a/\u00e9", "sha1:ABC", None), "metadata": ("<urn:x:metadata>", None, None, None)}
    back = {r.record_type: r for r in warc.read(index).collect()}
    assert bytes(back["response"].payload) == http and back["response"].payload_digest == "sha1:ABC" and back["response"].payload_bytes == len(http)
    assert back["warcinfo"].payload_digest == hashlib.sha256(b"software: x\r\n").hexdigest() and back["metadata"].payload_bytes == 0


def test_many_archives_are_many_tasks(spark):
    df = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 40) for i in range(64)], "page_id long, url string, html string").repartition(16)
    folder = shared.new_path(spark, "many")
    archives = warc.write(warc.decide(df), f"{folder}/raw")
    index = warc.normalise(archives, f"{folder}/records")
    files = len([x for x in index.inputFiles()])
    assert archives.count() > 4 and files > 4 and index.select("path").distinct().count() == archives.count()


# ---- decontamination


def test_planted_passages_are_found_and_others_left(spark):
    items = [(i, " ".join(words(40, 1000 + i, 5000))) for i in range(30)] + [(90, "short test"), (91, None), (92, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit("clash"))
    dice, texts, planted = random.Random(3), list(ODD), set()
    for i in range(100, 400):
        body = words(300, i, 3000)
        if i % 3 == 0:
            k = i % 30
            x = items[k][1].split()
            for _ in range(0 if i % 2 else 6):  # edits
                x[dice.randrange(len(x))] = dice.choice(["edited", "changed"])
            if i % 4 == 0:
                x = x[:20] + ["put", "in"] + x[20:]
            body[100:100] = [w.upper() + "," for w in x]
            planted.add((i, k))
        texts.append((i, " ".join(body)))
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs_of(spark, texts), bench).collect()}
    assert planted <= set(got) and {i for i, _ in got} == {i for i, _ in planted}
    r = got[103 + 2, (103 + 2) % 30]
    assert r.score == 1.0 and (r.first_word, r.last_word) == (100, 139)
    assert decontamination.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert decontamination.contaminated(empty(spark), bench).count() == 0


def test_parts_of_a_common_item_are_found(spark):
    """All n-grams of the item are common, and those of the part are in more texts than the others."""
    item = words(40, 2000, 5000)
    texts = [(i, " ".join(words(20, i, 3000) + item[: 20 if i < 10 else None])) for i in range(130)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontamination.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {i: 0.5 if i < 10 else 1.0 for i in range(130)}


def test_found_pairs_equal_seed_and_align_over_all_pairs(spark):
    """Every text with every item: pairs that share a seed are aligned by the textbook, in whole texts."""
    def score(a, b):
        top, row = 0.0, [0.0] * (len(b) + 1)
        for x in a:
            new = [0.0]
            for j, y in enumerate(b):
                new.append(max(0.0, row[j] + (1 if x == y else -0.5), row[j + 1] - 0.5, new[j] - 0.5))
            row = new
            top = max(top, *row)
        return top / len(a)

    dice = random.Random(12)
    items = [(i, words(dice.choice([4, 15, 30]), 50 + i, 300)) for i in range(12)]
    texts = []
    for i in range(60):
        body = words(80, 900 + i, 300)
        for k in dice.sample(range(12), 2):
            x = [w if dice.random() > 0.03 * (i % 6) else dice.choice(body) for w in items[k][1]]
            at = dice.randrange(len(body))
            body[at:at] = x[: dice.randint(3, len(x))]
        texts.append((i if i % 10 else None, " ".join(body)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    expected = collections.defaultdict(float)
    for i, t in texts:
        for k, x in items:
            n = decontamination.seed(len(x))
            if grams(t.split(), n) & grams(x, n) and (s := score(x, t.split())) >= decontamination.SCORE:
                expected[i, k] = max(s, expected[i, k])
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs_of(spark, [*texts, texts[3], texts[0]]), bench).collect()}
    assert len(expected) > 40 and got == pytest.approx(dict(expected))


def test_a_copy_with_every_fourth_or_fifth_word_edited_is_found(spark):
    items = [(i, words(n, 3000 + i, 5000)) for i, n in enumerate((15, 20, 24, 25, 40, 59))]
    texts = []
    for i, x in items:
        x = [w if k % (4 if len(x) < 25 else 5) else "edited" for k, w in enumerate(x)]
        texts.append((i, " ".join([*words(60, i, 3000), *x, *words(60, 100 + i, 3000)])))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs_of(spark, texts), bench).collect()} == {(i, i) for i, _ in items}


def test_alignment_against_the_textbook():
    def plain(a, b):
        h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0.0, h[i][j] + (1 if x == y else -0.5), h[i][j + 1] - 0.5, h[i + 1][j] - 0.5)
        return max(map(max, h))

    dice = random.Random(1)
    for _ in range(100):
        a, b = ([dice.randrange(4) for _ in range(dice.randint(1, 20))] for _ in range(2))
        assert decontamination.align(np.array(a), np.array(b))[0] == plain(a, b)


def test_benchmark_in_blocks_finds_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    item = words(30, 4000, 5000)  # parts of it, far apart in one text, and a text of its words out of order
    bench = bench.unionByName(spark.createDataFrame([(-1, " ".join(item)), (-2, "two words"), (-3, None), (-4, "İΣ word ΑΣ")], "item_id long, text string"))
    own = [*ODD, (-1, " ".join([*words(500, 1, 3000), *item[:15], *words(500, 2, 3000), *item[5:25], *words(9, 3, 3000)])), (-2, " ".join(sorted(item))), (-3, "x İΣ, WORD (ΑΣ) y")]
    docs = docs.unionByName(docs_of(spark, own).select(docs.columns))
    whole = sorted(map(tuple, decontamination.contaminated(docs, bench).collect()), key=str)
    assert {(-1, -1), (5, -2), (-3, -4)} <= {r[:2] for r in whole}
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 400)
    for places in (decontamination.PLACES, 1 << 15):  # the smaller bitmap is full of chance hits
        monkeypatch.setattr(decontamination, "PLACES", places)
        assert sorted(map(tuple, decontamination.contaminated(docs, bench).collect()), key=str) == whole
    assert decontamination.contaminated(empty(spark), bench).count() == 0


# ---- packing


def test_pieces_are_whole_and_packed(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    texts = [*ODD, *[(100 + i, " ".join(words(5 + 7 * i % 900, i))) for i in range(300)], (50, "İ Σς don't it's'll <|endoftext|> ½12a3 é ́x ﬁ ß ẞ"), (51, "a\tb\r\nc d e")]
    rows = packing.pack(docs_of(spark, texts), path, group_pieces=100).collect()
    t = Tokenizer.from_file(path)
    expected = collections.Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x in texts)
    parts, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = tuple(np.frombuffer(r.ids, "<u4").tolist())
        assert len(ids) == r.length
        parts[r.doc_id, r.doc_tokens].append((r.start, ids))
        seqs[r.sequence_id].append(r)
    total = collections.Counter()
    for (i, n), own in parts.items():
        for start, ids in own:
            assert sum(k for (d, x), k in expected.items() if d == i and len(x) == n and x[start : start + len(ids)] == ids) > 0
            total[i] += len(ids)
    assert total == collections.Counter({i: sum(k * len(x) for (d, x), k in expected.items() if d == i) for i in {d for d, _ in expected}})
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    whole = sum(r.length for r in rows)
    assert len(seqs) <= whole // 4096 + 6
    joined = packing.sequences(spark.createDataFrame(rows)).collect()
    assert len(joined) == len(seqs) and all(len(r.ids) == 4 * r.ends[-1] for r in joined)
    assert packing.pack(empty(spark), path).count() == 0


def test_first_fit_against_a_plain_one():
    dice = random.Random(2)
    for _ in range(50):
        lengths = sorted((dice.randint(1, 100) for _ in range(dice.randint(1, 80))), reverse=True)
        rooms, expected = [], []
        for x in lengths:
            k = next((i for i, r in enumerate(rooms) if r >= x), len(rooms))
            if k == len(rooms):
                rooms.append(100)
            expected.append((k, 100 - rooms[k]))
            rooms[k] -= x
        assert packing.first_fit(lengths, 100) == expected


# ---- near duplicates


def lowered(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def brute(texts, k, percent):
    sets, up = {}, {}
    for i, t in texts:
        w = WORD.findall(lowered(t))
        s = frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets.setdefault(i, []).append(s)
        up[i] = i

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    each = [(i, s) for i, own in sets.items() for s in own if s]
    for a in range(len(each)):
        for b in range(a):
            (i, s), (j, q) = each[a], each[b]
            if root(i) != root(j) and 100 * len(s & q) >= percent * len(s | q):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return sets, {i: root(i) for i in up}


def variants():
    texts, dice = [], random.Random(9)
    base = words(150, 77, 3000)
    for i in range(160):  # a star of near copies, from nearly equal to unlike
        x = list(base)
        for _ in range(dice.randint(0, 14)):
            x[dice.randrange(len(x))] = f"new{dice.randrange(10**6)}"
        texts.append((1000 + i, " ".join(x)))
    texts += [(2000 + i, " ".join(base).upper()) for i in range(50)]
    texts += [(3000 + i, " ".join(words(60, i // 2, 3000) + ["tail"] * (i % 2))) for i in range(100)]
    return texts + [(i, t) for i, t in ODD if i is not None]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, k, percent):
    texts = variants()
    sets, root = brute(texts, k, percent)
    got = lsh_forest.near_duplicates(docs_of(spark, [*texts, (None, "a null id with some words")]), words=k, percent=percent).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: r.component_id for r in got} == {**root, None: None}
    assert all(r.n_shingles in map(len, sets.get(r.doc_id, [()])) or r.doc_id is None for r in got) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_in_blocks_and_deep_regions(spark, monkeypatch):
    texts = variants()
    _, root = brute(texts, 3, 85)
    monkeypatch.setattr(lsh_forest, "REGION", 20)
    monkeypatch.setattr(lsh_forest, "BLOCK_TEXTS", 30)
    got = lsh_forest.near_duplicates(docs_of(spark, texts), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert lsh_forest.near_duplicates(empty(spark)).count() == 0


def test_dense_group_of_added_words_stays_whole(spark, monkeypatch):
    """Texts that share a body and add words of their own agree in all minima of most trees: one region, over REGION."""
    body = " ".join(words(400, 78, 3000))
    texts = [(i, f"{body} own{i}") for i in range(70)]
    _, root = brute(texts, 3, 85)
    monkeypatch.setattr(lsh_forest, "REGION", 20)
    got = lsh_forest.near_duplicates(docs_of(spark, texts), words=3, percent=85).collect()
    assert set(root.values()) == {0} and {r.doc_id: r.component_id for r in got} == root and [r.doc_id for r in got if r.kept] == [0]


def test_unlike_texts_under_one_id_are_compared_as_others(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK_TEXTS", 5)
    a, b = (" ".join(words(60, k, 3000)) for k in (1, 2))
    texts = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a + " still"), (None, " ".join(words(60, 9, 3000))), (4, a), (4, a)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in lsh_forest.near_duplicates(docs_of(spark, texts)).collect()), key=str)
    assert got == sorted([(1, None, False), (1, 1, True), (2, None, False), (3, 1, False), (None, None, True), (None, None, True), (4, None, False), (4, None, False)], key=str)
    kept = [(r.doc_id, r.text) for r in lsh_forest.one_of_each(docs_of(spark, [*texts, (8, None), (8, None), (9, ""), (None, None)])).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, a + " still"), (1, b), texts[5], (8, None), (9, ""), (None, None)]))


def test_large_groups_with_and_without_a_middle(spark, monkeypatch):
    """Far members of a large group are linked through others than the pivot; chains have no middle at all."""
    monkeypatch.setattr(lsh_forest, "BLOCK_TEXTS", 12)
    base = words(120, 70, 4000)
    texts = [(i, " ".join(base[: 120 - i % 4] + [f"own{i}"])) for i in range(120)]
    chain = words(400, 71, 4000)
    texts += [(1000 + i, " ".join(chain[5 * i : 5 * i + 120])) for i in range(50)]  # each only near the next ones
    _, root = brute(texts, 3, 85)
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(docs_of(spark, texts), words=3, percent=85).collect()}
    assert got == root and len(set(root.values())) < 40


def test_recall_in_a_dense_template_family(spark, monkeypatch):
    """Texts of one template whose own pairs are at the threshold, in regions cut to any depth."""
    monkeypatch.setattr(lsh_forest, "REGION", 8)
    body, texts = words(200, 31, 4000), []
    for i in range(150):
        x = body[:140] + words(60, 5000 + i, 4000)
        for k in range(2):
            y = list(x)
            for _ in range(4 * k):
                y[random.Random(i).randrange(140, 200)] = f"e{i}"
            texts.append((2 * i + k, " ".join(y)))
    _, root = brute(texts, 3, 85)
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(docs_of(spark, texts), words=3, percent=85).collect()}
    pairs = [i for i in root if root[i] != i]
    assert len(pairs) > 100 and sum(got[i] == root[i] for i in pairs) >= 0.95 * len(pairs) and all(got[i] in (root[i], i) for i in root)


def test_depth_keeps_its_promise():
    for s in (0.5, 0.8, 0.85, 0.95):
        assert (1 - s ** lsh_forest.depth_for(s)) ** lsh_forest.TREES <= lsh_forest.MISS or lsh_forest.depth_for(s) == 1


def test_components_of_chains_and_hubs(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (5000, 4999)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and got[5000] == 4999


# ---- the pipeline


def test_pipeline_loses_no_document_for_its_id(spark):
    """Unlike texts under one id and under none pass every stage, equal rows are one from the third stage on, and a
    contaminated text goes alone."""
    import corpus_pipeline as c

    whole = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    clean = [r.text for r in whole.orderBy("doc_id").collect() if r.text and r.lang == "en" and 100 < len(r.text.split()) < 400 and len(set(r.text.split())) > 60][:40]
    own = [" ".join(random.Random(i).sample(t.split(), len(t.split()))) for i, t in enumerate(clean)][:6]
    rows = [(1, own[0]), (1, own[1]), (None, own[2]), (None, own[3]), (1, own[4] + " " + item), (None, item + " " + own[5]), (1, own[0]), (None, own[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    for name, stage in c.STAGES[2:4]:
        docs = shared.cut(stage(spark, docs, SF), name)
        assert docs.columns == list(c.COLUMNS)
    assert sorted(map(str, ((r.doc_id, r.text) for r in docs.collect()))) == sorted(map(str, rows[:4]))
    pieces = c.packed(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.start == 0) == ["1", "1", "None", "None"]


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_kept", F.lit(1))
    nulls = spark.createDataFrame([(None, None, None, None, None, 1), (10**9, None, None, None, None, 1)], docs.schema)
    now, sizes = docs.unionByName(docs.limit(3)).unionByName(nulls), []
    for name, stage in c.STAGES:
        now = shared.cut(stage(spark, now, SF), name)
        sizes.append(now.count())
        if name != "packing":
            assert now.columns == list(c.COLUMNS)
    assert sizes == [*sorted(sizes[:4], reverse=True), sizes[4]] and sizes[3] > 100
    assert now.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).where("n <> d").count() == 0
    for name, stage in c.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_known_parts_stay_few_within_one_text():
    """The remembered parts are bounded at every moment, not only between texts, and ids are the whole tokenizer's."""
    import public_tokenizers

    from tickfold.llm import packing

    t = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"), most=50)
    texts = ["", "\n", " a  B\n\u00c9t\u00e9 \u00c9T\u00c9! x-1 it's \u65e5\u672c na\u00efve,, \u00ff\u0130 \u00b5 \xa0z", " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)), " ".join(chr(97 + i % 26) + chr(97 + i // 26) for i in range(600))]
    assert t.fast and t.encode(texts) == t.whole(texts)
    assert max(map(len, (t.known, t.words, t.marks))) <= 50
